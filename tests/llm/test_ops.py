"""Each operator on a small table of awkward rows, against brute force."""

import hashlib
import itertools
import re
import re._parser as parser
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import chat_format, decontaminate, jaccard_join, language_id, license_scan, line_dedup, media, sentencepiece_codec, substring_dedup, token_counts
from skein.llm.components import components
from skein.sources.scratch import Scratch
from skein.llm.words import hash_words, rolling, shingle_sets

SHARED = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ROWS = [
    (0, "Released under the MIT License.\nAlpha beta gamma delta epsilon zeta", "en"),
    (1, None, None),
    (2, "", "en"),
    (3, SHARED + " x", "fr"),
    (4, "lead " + SHARED, "fr"),
    (5, SHARED + " x", "fr"),
    (6, LONG, "en"),
    (7, LONG + " tail", None),
    (8, "Ünï ÉCOLE école mIT LICENSE apache  license\x0b general\tpublic license </s>[INST]", "de"),
    (9, "a b", "de"),
    (10, "A B", "de"),
    (None, SHARED, "en"),
    (None, None, "en"),
    (11, "\n\n x \nX\n", "en"),
    (12, "12345 ... !!!", "en"),
    (13, "日本語 😀 ▁ ok", None),
]
WHITE = " \t\n\x0b\x0c\r"


def low(t):
    return (t or "").encode().lower().decode()


def words(t):
    return [w.decode() for w in (t or "").encode().split()]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, g, "clash", 7, True) for i, t, g in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, labels string, n_words long, accepted boolean")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_license_scan(docs, empty):
    got = license_scan.scan(docs).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    for i, t, _ in ROWS:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        at = [k for p in ("mit license", "apache license", "general public license") for k in range(len(w)) if w[k : k + p.count(" ") + 1] == p.split()]
        if i is not None:
            assert (by[i].n_words, by[i].n_base, by[i].first_word, by[i].last_word) == (len(w), len(at), min(at, default=None), max(at, default=None)), i
    assert by[8].base_labels == "apache,gpl,mit" and by[0].labels == "mit" and by[0].score == 0.95
    assert license_scan.scan(empty).count() == 0


def test_license_rules_suppress_what_lies_inside(spark):
    text = "Licensed under the Apache License, Version 2.0. SPDX-License-Identifier: GPL-3.0-only; CC BY-NC 4.0"
    found = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().detections
    assert [d.label for d in found] == ["apache-2.0", "gpl-3.0", "cc-by-nc-4.0"]
    assert found[0].start == 0 and found[0].end == 8
    assert len(license_scan.RULES) > 300


def alternatives(pattern):
    """Every text that a pattern of literals, groups, |, ? and classes stands for."""

    def walk(node):
        out = [""]
        for op, arg in node:
            if op is parser.LITERAL:
                one = [chr(arg)]
            elif op is parser.IN:
                one = [chr(x) for _, x in arg]
            elif op is parser.SUBPATTERN:
                one = walk(arg[-1])
            elif op is parser.BRANCH:
                one = [x for b in arg[1] for x in walk(b)]
            else:
                assert op is parser.MAX_REPEAT and arg[:2] == (0, 1), op
                one = ["", *walk(arg[2])]
            out = [a + b for a in out for b in one]
        return out

    return walk(parser.parse(pattern))


def test_license_alternatives_pass_the_prefilter(spark):
    around = {"name": "{}", "grant": "released under {}", "header": "this file is {}", "field": "license {}"}
    rows = []
    for i, (_, name, spdx, _) in enumerate(license_scan.LICENSES):
        rows += [(f"{form}:{i}", text.format(x)) for form, text in around.items() for x in {" ".join(x.split()) for x in alternatives(license_scan.compiled(name))}] + [(f"tag:{i}", "spdx license identifier " + spdx)]
    rows += [(f"notice:{i}", x) for i, (_, text, _) in enumerate(license_scan.NOTICES) for x in alternatives(text)]
    # a rule's own detection spans the whole text, and only another that spans it can stand for it
    for r in license_scan.scan(spark.createDataFrame(rows, "doc_id string, text string").repartition(4)).collect():
        assert any(d.start == 0 and d.end == r.n_words for d in r.detections), (r.doc_id, r.text)
    spelled = [("wtfpl", "do what the fuck you want to public license"), ("cc0-1.0", "Creative Commons Zero 1.0 Universal"), ("cc-by-4.0", "Creative Commons Attribution 4.0"), ("cc-by-sa-4.0", "Creative Commons Attribution-ShareAlike 4.0"), ("cc-by-nc-4.0", "Creative Commons Attribution Non-Commercial 4.0"), ("cc-by-nd-4.0", "Creative Commons Attribution NoDerivatives 4.0"), ("cc-by-nc-4.0", "CC BY-NC 4.0")]
    assert [r.labels for r in license_scan.scan(spark.createDataFrame(spelled, "doc_id string, text string")).collect()] == [x for x, _ in spelled]


def test_line_dedup(spark, docs, empty):
    def brute(rows, least):
        key = lambda x: low(x.strip(WHITE))
        count = {}
        for t in rows:
            for k in {key(x) for x in (t or "").split("\n")} - {""}:
                count[k] = count.get(k, 0) + 1
        return [[x for x in (t or "").split("\n") if count.get(key(x), 0) < least] for t in rows]

    rows = [(i, f"Common {i % 3}\n own {i}\nCOMMON {i % 3} \n\n") for i in range(12)] + [(99, None), (None, "common 0"), (5, "common 1\nÉ"), (6, "é")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("x"))
    got = line_dedup.drop_common_lines(df, min_docs=4).collect()
    want = brute([t for _, t in rows], 4)
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(i), "\n".join(x)) for (i, _), x in zip(rows, want, strict=True))
    assert line_dedup.drop_common_lines(docs).count() == len(ROWS) and line_dedup.drop_common_lines(empty).count() == 0


def test_jaccard_join(spark, docs, empty):
    base = [f"t{i}" for i in range(60)]
    rows = [(i, t) for i, t, _ in ROWS] + [(100 + i, " ".join(base[: 60 - i])) for i in range(12)] + [(200 + i, " ".join(base[:k] + ["EDIT"] + base[k + 1 :])) for i, k in enumerate(range(0, 60, 7))] + [(300, " ".join(base).upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {}
    for i, t in rows:
        w = low(t).split(" ") if t is None else [x.decode() for x in low(t).encode().split()]
        w = [x for x in w if x]
        if i is not None:
            sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = jaccard_join.near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == {i: (len(s), find(i)) for i, s in sets.items()}
    assert jaccard_join.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("edits", [1, 2])
def test_near_copies_do_not_meet_in_all_pairs(spark, monkeypatch, edits):
    """A text and m copies with edits: with one edit they link through the text, mostly not with each other; with two, hardly at all."""
    verify, seen = jaccard_join.verify, []

    def counted(pairs, *args):
        seen[-1] += pairs.count()
        return verify(pairs, *args)

    monkeypatch.setattr(jaccard_join, "verify", counted)
    for m in (100, 200):
        seen.append(0)
        rng = np.random.default_rng(m)
        rows = [(0, " ".join(f"t{i}" for i in range(60)))]
        for i in range(1, m + 1):
            w = [f"t{i}" for i in range(60)]
            for k in rng.choice(np.arange(5, 55), edits, replace=False):
                w[k] = f"e{i}_{k}"
            rows.append((i, " ".join(w)))
        got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        if edits == 1:
            assert {r.component_id for r in got} == {0}
    assert seen[1] <= 2.5 * seen[0] + 20 and seen[1] <= 6 * 200


def test_components_reach_the_smallest(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95)], "a long, b long")
    assert {r.node: r.root for r in components(edges, Scratch(spark, "t")).collect()} == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}
    assert components(edges.limit(0), Scratch(spark, "t")).count() == 0


def test_later_links_join_known_components(spark):
    """Links found one after the other place classes as all of them at once do; links within a component change nothing."""
    scratch = Scratch(spark, "t")
    rng = np.random.default_rng(4)
    rounds = [[(int(a), int(b)) for a, b in rng.integers(0, 60, (25, 2)) if a < b] for _ in range(3)] + [[]]
    placed = spark.createDataFrame([(i, i, i, 9, i) for i in range(60)], "cid long, rep long, gid long, n long, root long")
    for i, links in enumerate(rounds):
        placed = jaccard_join._place(placed, spark.createDataFrame(links, "a long, b long"), scratch, own=i == 0)
    root = list(range(60))
    for a, b in [x for r in rounds for x in r]:
        low, high = sorted((root[a], root[b]))
        root = [low if x == high else x for x in root]
    assert {r.cid: r.root for r in placed.collect()} == dict(enumerate(root))


def test_media(docs, empty):
    got = {r.doc_id: r for r in media.extract(media.store(docs)).collect() if r.doc_id is not None}
    for i, t, _ in ROWS:
        if i is not None:
            data = (t or "").encode()
            payload = data + bytes(-len(data) % 64 or (0 if data else 64))
            assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[3].feature == got[5].feature and got[3].media_sha256 == got[5].media_sha256
    table = media.from_ipc(got[6].tensors)
    assert table.num_rows == got[6].n_windows > 0 and table.column("log_mel").type.shape == [media.WINDOW, media.MELS]
    assert media.from_ipc(got[2].tensors).num_rows == 0
    assert media.extract(media.store(empty)).count() == 0


def test_media_query_stores_tensors_and_reads_them(docs, spark, tmp_path, monkeypatch):
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    stored, save = [], media.Scratch.save

    def kept(self, df, name, *a, **k):
        out = save(self, df, name, *a, **k)
        stored.extend(out.collect() if name == "tensors" else [])
        return out

    monkeypatch.setattr(media.Scratch, "save", kept)
    monkeypatch.setattr(media, "BATCH_BYTES", 1 << 14)
    got = {(r.doc_id, r.payload_sha256): r for r in media.query(spark, f"file://{tmp_path}").collect()}
    assert len(stored) == len(ROWS) and sum(r.n_windows for r in stored) > 10
    for r in stored:
        table = media.from_ipc(r.tensors)
        assert table.num_rows == r.n_windows == got[r.doc_id, r.payload_sha256].n_windows and table.column("log_mel").type.shape == [media.WINDOW, media.MELS]
    plain = media.extract(media.store(docs), tensors=False).collect()
    assert {k: r.feature for k, r in got.items()} == {(r.doc_id, r.payload_sha256): r.feature for r in plain}
    other = media.extract(media.store(docs)).withColumn("tensors", F.lit(media.to_ipc([(0.0, 1.0)], np.ones((1, media.WINDOW, media.MELS), np.float32))))
    with pytest.raises(Exception, match="differs from its features"):
        media.read_back(other).collect()


def test_media_segments_and_resampling():
    assert media.segments(np.array([0, 0.1, 1, 0.1, 0.01, 0.1, 0])) == [(1, 4)]
    tone = np.rint(127 * np.sin(np.arange(4000) * 2 * np.pi * 440 / media.RATE_IN) + 128).astype(np.uint8)
    up = media.resample(tone, 0, 6000)
    spectrum = np.abs(np.fft.rfft(up[600:5400]))
    assert abs(spectrum.argmax() * media.RATE / 4800 - 440) < 4
    assert np.array_equal(up[999:3001], media.resample(tone, 999, 3001))
    # every output by the definition: zeros between samples, one filter over all, every DOWN-th stays
    x = np.zeros(len(tone) * media.UP)
    x[:: media.UP] = (tone.astype(float) - 128) / 128
    whole = np.convolve(x, media.PHASES.T.reshape(-1))[media.UP * (media.TAPS - 1 - media.TAPS // 2) :][:: media.DOWN][:6000]
    assert np.abs(up - whole).max() < 1e-4


def test_media_log_mel_is_the_plain_one_in_any_slices(monkeypatch):
    data = np.frombuffer(LONG[:20_000].encode(), np.uint8)
    mels, energy = media.log_mel(data)
    wave = media.resample(data, 0, 30_000)
    for i in (0, 7, len(mels) - 1):
        frame = np.zeros(media.FRAME)
        frame[: len(wave[i * media.HOP :][: media.FRAME])] = wave[i * media.HOP :][: media.FRAME]
        power = np.abs(np.fft.rfft(frame * media.HANN, media.FFT)) ** 2
        assert np.abs(mels[i] - np.log(power @ media.BANK + 1e-6)).max() < 1e-2 and abs(energy[i] - (frame**2).mean()) < 1e-5
    monkeypatch.setattr(media, "SLICE", 1000)
    assert np.abs(media.log_mel(data)[0] - mels).max() < 1e-3


def test_media_very_long_text():
    spans, windows = media.features(media.pad(b"lorem ipsum dolor " * (20_000_000 // 18)))
    assert len(spans) == len(windows) > 3000 and windows.shape[1:] == (media.WINDOW, media.MELS)


def test_decontaminate(spark, docs, empty):
    items = [(0, SHARED), (1, " ".join(f"w{i}" for i in range(500, 530))), (2, "a b"), (3, ""), (4, None), (5, SHARED.replace("five", "FIVE").replace("one", "zzz")), (6, "never there at all in these"), (7, SHARED)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for i, t, _ in ROWS:
        for j, u in items:
            w, v = words(low(t)), words(low(u))
            k = min(5, len(v))
            if v:
                s, q = ({tuple(x[n : n + k]) for n in range(len(x) - k + 1)} for x in (w, v))
                if len(s & q) >= 0.8 * len(q):
                    want.append((str(i), j, len(s & q), len(q)))
    got = [(str(r.doc_id), r.item_id, r.n_common, r.n_item) for r in decontaminate.find_leaks(docs, bench).collect()]
    assert sorted(got) == sorted(want) and any(x[1] == 1 for x in got)
    flagged = decontaminate.count_leaks(docs, bench).collect()
    assert sum(r.n_items for r in flagged) == len(want) and len(flagged) == len(ROWS)
    assert decontaminate.find_leaks(empty, bench).count() == 0 and decontaminate.find_leaks(docs, bench.limit(0)).count() == 0


def test_decontaminate_in_blocks(docs, spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    bench = spark.createDataFrame([(i, SHARED.replace(" ", "\n\t"[i % 2])) for i in range(3)], "item_id long, text string")
    assert [len(b) for b in decontaminate.blocks(bench)] == [2, 1]
    assert {r.item_id for r in decontaminate.find_leaks(docs, bench).collect()} == {0, 1, 2}


@pytest.mark.parametrize(("block", "group"), [(7, 3), (1 << 16, 1 << 12)])
def test_token_counts(docs, empty, monkeypatch, block, group):
    monkeypatch.setattr(token_counts, "GROUP", group)
    files = Scratch(docs.sparkSession, "t").save(token_counts.write_files(docs.coalesce(2), block=block), "files")
    order = files.where("block IS NULL").select("file", "first", F.posexplode("doc_ids").alias("pos", "doc_id")).select("file", (F.col("first") + F.col("pos")).alias("ordinal"), "doc_id")
    got = sorted((str(r.doc_id), r.n_tokens) for r in order.join(token_counts.count(files), ["file", "ordinal"]).collect())
    assert got == sorted((str(i), len(token_counts.tokens(t or "", token_counts.VOCABULARY))) for i, t, _ in ROWS)
    assert token_counts.count(token_counts.write_files(empty)).count() == 0


def test_language_id(spark, docs, empty):
    texts = {"aa": "lorem ipsum dolor sit amet consectetur ", "bb": "quick brown foxes jump over lazy dogs "}
    rows = [(i, (texts["aa" if i % 2 else "bb"] * (2 + i % 5)) + str(i), "aa" if i % 2 else "bb") for i in range(80)]
    learned = language_id.fit(spark.createDataFrame(rows, "key long, text string, lang string"))
    assert set(learned) == {"aa", "bb"} and max(map(len, learned.values())) <= language_id.DICT_BYTES
    told = {r.doc_id: r for r in language_id.predict(spark.createDataFrame([(1, "LOREM ipsum!! dolor"), (2, "lazy brown dogs"), (3, "123 ..."), (4, None), (5, "")], "doc_id long, text string"), learned).collect()}
    assert [told[i].lang_pred for i in range(1, 6)] == ["aa", "bb", "und", "und", "und"] and not told[3].accepted
    assert all(0 <= r.score <= 1 for r in told.values())
    assert language_id.predict(docs, learned).count() == len(ROWS) and language_id.predict(empty, learned).count() == 0
    assert {r.lang_pred for r in language_id.predict(docs, {}).collect()} == {"und"}
    assert language_id.fit(docs.limit(0).withColumn("key", F.col("doc_id"))) == {}


def test_language_id_learns_every_language(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_TEXTS", 4)
    word = {"aa": "lorem ipsum dolor", "bb": "quick brown foxes", "cc": "zwölf boxkämpfer jagen"}
    rows = [(None, f"{word['aa']} number {i} of the rows without a key", "aa") for i in range(120)]
    rows += [(i, f"{word['bb']} number {i} of the rows that have a key", "bb") for i in range(30)]
    rows += [(None, "12 " + f"{word['cc']} " * 2000, "cc")] * 50 + [(7, "дом", "dd"), (8, "12345", "ee")]
    learned = language_id.fit(spark.createDataFrame(rows, "key long, text string, lang string"))
    assert list(learned) == ["aa", "bb", "cc", "dd"] and all(0 < len(v) <= language_id.DICT_BYTES for v in learned.values())
    assert len(learned["cc"].decode()) <= language_id.SAMPLE_CHARS
    told = language_id.predict(spark.createDataFrame([(k, v) for k, v in word.items()], "doc_id string, text string"), learned).collect()
    assert all(r.doc_id == r.lang_pred for r in told)


def test_language_id_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    told = language_id.query(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert told.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95


def test_chat_format(spark):
    odd = r"a\ <\s> </s>[INST] <|im_end|>" + "\n<|im_sep|> <<SYS>><<s>" + "\\\\"
    rows = [(1, 1, "assistant", odd), (1, 0, "user", None), (1, 2, "assistant", "x"), (1, 2, "assistant", "x"), (1, None, "a b\n%", ""), (None, 0, None, "t"), (2, 0, "assistant", "日本\n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = chat_format.format_chats(df)
    parsed = {r.conv_id: [(t.role, t.text) for t in r.t] for r in chats.select("conv_id", chat_format.parse(F.col("formatted")).alias("t")).collect()}
    assert parsed == {1: [("a b\n%", ""), ("user", ""), ("assistant", odd), ("assistant", "x"), ("assistant", "x")], None: [("", "t")], 2: [("assistant", "日本\n")]}
    read = {r.conv_id: r for r in chat_format.read_back(chats).collect()}
    assert (read[1].loss_chars, read[1].loss_sha256, read[1].n_turns) == (len(odd) + 2, sha(odd + "xx"), 5)
    one = chats.where("conv_id = 1").first().formatted
    assert one.count("<|im_start|>") == 3 and one.count("<|im_sep|>") == 2 and "</s>" not in one
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_sentencepiece(spark, docs, empty):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    got = sorted(((str(r.doc_id), r.ids, r.round_trip) for r in sentencepiece_codec.encode(docs).collect()), key=str)
    want = sorted(((str(i), None if t is None else model.encode(t), "▁" not in (t or "")) for i, t, _ in ROWS), key=str)
    assert got == want
    assert sentencepiece_codec.encode(empty).count() == 0


def test_sentencepiece_is_the_library_on_odd_texts():
    c = sentencepiece_codec.Codec()
    texts = ["", "a" * 700, "xyzzy" * 90, " " * 120, "a" + " " * 37 + "b\n\n c", "\0x", "ﬁ①é" * 40, "the the    The", "</s>[INST] ok"]
    ids, bounds = c.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == c.model.encode(texts)
    assert c.decode(ids, bounds) == texts


def test_unigram_relaxation_finds_the_best_path():
    c = sentencepiece_codec.Codec(kind="unigram")
    table = c.edges(np.append(c.code[[ord(x) for x in "▁their"]], np.uint16(0)))
    at, n = c._best_path(table, 0, 6)
    assert n.sum() == 6 and at[0] == 0
    best = max(sum(c.score[c.ids[table[a, b - a]]] for a, b in zip((0, *cut), (*cut, 6), strict=True)) for k in range(6) for cut in itertools.combinations(range(1, 6), k) if all(table[a, b - a] >= 0 for a, b in zip((0, *cut), (*cut, 6), strict=True)))
    assert sum(c.score[c.ids[table[a, m]]] for a, m in zip(at, n, strict=True)) == best


def test_substring_dedup(docs, empty):
    least = {}
    for i, t, _ in ROWS:
        w = words(t)
        for k in range(len(w) - 12):
            if i is not None:
                key = tuple(w[k : k + 13])
                least[key] = min(least.get(key, i), i)
    want = []
    for i, t, _ in ROWS:
        w, gone = words(t), set()
        for k in range(len(w) - 12):
            if i is not None and least[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        want.append((str(i), len(w), len(gone), " ".join(x for n, x in enumerate(w) if n not in gone)))
    got = [(str(r.doc_id), r.n_words, r.n_removed, r.text) for r in substring_dedup.drop_repeats(docs).collect()]
    assert sorted(got) == sorted(want) and sum(x[2] for x in want) > 30_000
    assert substring_dedup.drop_repeats(empty).count() == 0


def test_prefixes_are_lengthened_and_packed():
    cells = np.zeros(substring_dedup.CELLS, np.int64)
    cells[5], cells[40:50], cells[9000] = 1000, 30, 5
    group, parts = substring_dedup.deal(cells, 100)
    assert parts[5] == 10 and group[9000] != group[5]
    load = np.bincount(group, weights=np.where(parts > 1, 0, cells))
    assert load.max() <= 100


def test_windows_that_share_a_hash_are_told_by_the_second():
    order, head = substring_dedup._runs(np.array([7, 3, 7, 7, 3], np.uint64), np.array([1, 5, 2, 1, 5], np.uint16))
    assert head.tolist() == [True, False, True, False, True] and set(order[:2]) == {1, 4} and set(order[2:4]) == {0, 3}


def test_word_hashes_do_not_depend_on_the_chunk():
    a, _ = hash_words([b"x y", b"", b"zz x"], lower=True)
    b, bounds = hash_words([b"ZZ  X\t"], lower=True)
    assert a[2:].tolist() == b.tolist() and bounds.tolist() == [0, 2] and a[0] == a[3]
    assert len(rolling(a, 5)) == 0 and [len(s) for s in shingle_sets([None, b"", b"a", b"a b c d e f"])] == [0, 0, 1, 2]
