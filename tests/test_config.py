import pytest

from skein.plans.config import Config, load_env, parse, write_atomically
from skein.streaming.poll import poll_text


def test_config():
    assert parse("") == Config()
    c = parse('[knowledge]\nscan_interval = 600\ninclude = ["*.md"]\n[chunks]\ntarget = 10\nmost = 20\n[search]\nper_file = 3\n')
    assert (c.scan_interval, c.include, c.limits.most, c.search.per_file) == (600, ("*.md",), 20, 3)
    for bad in ("[knowledge]\nscan_interval = 7\n", "[other]\nx = 1\n", "[knowledge]\nmetric = 'x'\n", "[chunks]\ntarget = 9\nmost = 1\n"):
        with pytest.raises(ValueError):
            parse(bad)


def test_env_and_files(tmp_path):
    assert load_env("# c\nexport A='x y'\nB=1=2\n bad line\n") == {"A": "x y", "B": "1=2"}
    write_atomically(str(tmp_path / "c.toml"), "x = 1\n")
    assert (tmp_path / "c.toml").read_text() == "x = 1\n" and len(list(tmp_path.iterdir())) == 1


def test_polling_sees_new_files_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("one\ntwo")
    seen = []
    for _ in range(2):
        q = poll_text(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/check", lambda df, i: seen.extend((r.relative_path, r.content) for r in df.collect()))
        q.awaitTermination(60)
        (tmp_path / "in/b c+.txt").write_text("three")
    assert sorted(seen) == [("a.txt", "one\ntwo"), ("b c+.txt", "three")]
    with pytest.raises(ValueError):
        poll_text(spark, "x", "y", print, seconds=5)
