"""The Merkle manifest against a plain version, with nulls, ties and tampering."""

import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from skein.llm import merkle_manifest
from skein.sources.scratch import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root string"


def h(text):
    return sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(leaves):
    """(root, path of each leaf) of digests in order."""
    nodes, paths, own = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for i, at in enumerate(own):
            run, slot = runs[at // 8], at % 8
            paths[i].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
            own[i] = at // 8
        nodes = [h("".join(run)) for run in runs]
    return nodes[0], paths


def plain(rows):
    held = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        fields = (doc_id, source, lang, n_chars, text)
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        changed = text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        held[lang].append((doc_id is not None, doc_id or 0, plain_leaf(fields), plain_leaf((*fields[:4], changed)) if hit else None, doc_id))
    langs = sorted(held, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: plain_tree([x[2] for x in sorted(held[k], key=lambda x: x[:3])]) for k in langs}
    root, tops = plain_tree([trees[k][0] for k in langs])
    out = []
    for k, top in zip(langs, tops, strict=True):
        for row, path in zip(sorted(held[k], key=lambda x: x[:3]), trees[k][1], strict=True):
            folded = row[3] or row[2]
            for left, right in path + top:
                folded = h(left + folded + right)
            out.append((row[4], row[2], trees[k][0], root, h("".join(a + b for a, b in path + top)), folded, folded == root))
    return out


def documents():
    rows = [(i, f"Text {i} ÄB" if i % 3 else f"lower {i}", "en", f"s{i % 4}", i) for i in range(150)]
    rows += [(i, None if i % 2 else "", "de", None, None) for i in range(9)] + [(5, "One", "fr", "s", 1)]
    rows += [(None, "no id", None, "s", 2), (None, "no id", None, "s", 2), (7, "Twice", None, "s", 3), (7, "twice", None, "s", 3), (7, "Twice", None, "s", 3)]
    rows += [(i, "X", f"l{i:02}", "s", 0) for i in range(20)] + [(1000, "LONG " * 200_000, "en", "s", 1)]
    return rows


def answer(spark, rows, tmp_path):
    frame = spark.createDataFrame([(*r, "other", "other") for r in rows], SCHEMA)
    frame.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    out = merkle_manifest.query(spark, str(tmp_path))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return [tuple(r) for r in out.collect()]


@pytest.mark.parametrize("rows", [documents(), documents()[:1], documents()[:8], documents()[:9], []], ids=["all", "one", "a run", "two runs", "none"])
def test_manifest(spark, tmp_path, rows):
    got = answer(spark, rows, tmp_path)
    assert sorted(got, key=str) == sorted(plain(rows) if rows else [], key=str)
    if len(rows) > 100:
        changed = {r[0] for r in got if not r[6]}
        assert changed == {r[0] for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and (r[1] or "") != (r[1] or "").replace("T", "t").replace("B", "b").replace("O", "o").replace("X", "x").replace("LONG", "long")} | changed
        assert changed and all(zlib.crc32(str(i).encode()) % 3 == 0 for i in changed)


def test_numbers_within_a_hot_key_come_from_many_parts(spark):
    rows = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS key", "(id * 7919) % 3000 AS id", "sha2(cast(id AS string), 256) AS hash").repartition(6)
    out, most = merkle_manifest.numbered(rows, ["id", "hash"], Scratch(spark, "test"))
    assert most == 2000
    for key in "ab":
        got = [r.pos for r in out.where(f"key = '{key}'").orderBy("id").collect()]
        assert got == list(range(len(got)))
