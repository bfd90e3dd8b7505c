"""Top k over blocks of postings: the same rows as scoring everything, from fewer postings."""

from random import Random

import pytest
from pyspark.sql import functions as F

from skein.operators import lexical
from skein.sources.scratch import Scratch


@pytest.fixture(scope="module")
def index(spark):
    rng = Random(1)
    words = [f"w{i}" for i in range(300)]
    rows = [(f"{i}:1:0", " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(300)], k=rng.randint(1, 60))), f"t{i % 7}", "", f"f-{i}.md") for i in range(3000)]
    frame = spark.createDataFrame(rows, "chunk_id string, text string, title string, heading_path string, filename string")
    return lexical.build(frame, Scratch(spark, "test"))


@pytest.mark.parametrize("asked", [[["w0"]], [["w250"], ["w0"], ["w1"]], [["w299"], ["nothing"]], [["w3", "w1"], ["w2"]], [["f", "17", "md"], ["w5"]], [["nothing"]], []])
def test_same_as_scoring_everything(index, asked):
    some = index.lengths.where("chunk_id LIKE '%3:1:0'").select("chunk_id")
    for k, live in ((1, None), (10, some), (500, None)):
        scored = lexical.bm25(index, asked)
        want = lexical.top(scored if live is None else scored.join(live, "chunk_id", "left_semi"), k).collect()
        got = lexical.bm25_top(index, asked, k, live).collect()
        assert [(r.chunk_id, round(r.score, 9)) for r in got] == [(r.chunk_id, round(r.score, 9)) for r in want]


def test_reads_few_blocks(spark, index, monkeypatch):
    read = []
    inner = lexical._matches

    def counted(posted, phrases, weights=lexical.WEIGHTS):
        read.append(posted.count())
        return inner(posted, phrases, weights)

    monkeypatch.setattr(lexical, "_matches", counted)
    monkeypatch.setattr(lexical, "FIRST", 2)
    asked = [["w280"], ["w0"]]
    lexical.bm25(index, asked).collect()
    lexical.bm25_top(index, asked, 5).collect()
    assert len(read) == 3 and sum(read[1:]) < read[0]
    assert index.blocks.agg(F.sum("df")).first()[0] == index.postings.select("term", "chunk_id").distinct().count()


def test_batch_phrases(spark, index):
    queries = spark.createDataFrame([(1, "w250 f-17.md w0"), (2, "w0"), (3, "..."), (4, "F-17.MD"), (5, "w0 w0")], "query_id int, text string")
    got = {}
    for r in lexical.bm25_batch(index, queries).collect():
        got.setdefault(r.query_id, {})[r.chunk_id] = round(r.score, 9)
    for i, asked in ((1, [["w250"], ["f", "17", "md"], ["w0"]]), (2, [["w0"]]), (4, [["f", "17", "md"]]), (5, [["w0"]])):
        assert got[i] == {r.chunk_id: round(r.score, 9) for r in lexical.bm25(index, asked).collect()}
    assert 3 not in got and got[4].keys() == {"17:1:0"}
