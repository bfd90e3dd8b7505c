"""Searches without an index: the same rows as with one, from one pass over the chunks."""

from random import Random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.functions import lexing
from skein.functions.matching import Best, Phrases
from skein.operators import lexical
from skein.plans.tables import Tables
from skein.sources.scratch import Scratch

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def chunks(spark):
    rng = Random(2)
    words = ["a", "b-c", "b", "c.a", "Straße", "été", "ﬁn", "c"]
    rows = [(f"{i}:1:0", " ".join(rng.choices(words, k=rng.randint(0, 12))) if i % 9 else None, f"t {i % 7} a", "b > c" if i % 3 else "", f"f-{i}.md") for i in range(400)]
    # copies: equal scores
    rows += [(f"{i}:2:0", *rows[i][1:]) for i in range(0, 400, 3)]
    return spark.createDataFrame(rows, "chunk_id string, text string, title string, heading_path string, filename string").repartition(3)


def test_batch_is_the_join_of_all(spark, chunks, monkeypatch):
    """Every query's best, of several blocks, with equal scores, repeated ids and texts that ask for nothing."""
    queries = spark.createDataFrame([(1, "a b-c"), (2, "c.a f-17.md strasse"), (3, "..."), (4, None), (1, "ete c c"), (5, "a"), (6, "FIN b"), (7, "nowhere")], "query_id int, text string")
    live = chunks.where("chunk_id NOT LIKE '%7:1:0'").select("chunk_id")
    index = lexical.build(chunks, Scratch(spark, "test"))
    scored = lexical.bm25_batch(index, queries).join(live, "chunk_id", "left_semi").withColumn("score", F.round("score", 9))
    want = [tuple(r) for r in lexical.top(scored, 6, per="query_id").select("query_id", "rank", "chunk_id", "score").orderBy("query_id", "rank").collect()]
    for at_once, held in ((1000, 200_000), (2, 14)):
        monkeypatch.setattr(lexical, "AT_ONCE", at_once)
        monkeypatch.setattr(lexical, "SCORES", held)
        got = lexical.batch_top(chunks, queries, 6, Scratch(spark, "test"), live).withColumn("score", F.round("score", 9))
        assert [tuple(r) for r in lexical.top(got, 6, per="query_id").select("query_id", "rank", "chunk_id", "score").orderBy("query_id", "rank").collect()] == want
    assert len(want) == 4 * 6 and lexical.batch_top(chunks, queries.limit(0), 6, Scratch(spark, "test"), live).count() == 0


def test_batch_writes_no_index(spark, monkeypatch):
    monkeypatch.setattr(Tables, "index", lambda t: pytest.fail("the index was built"))
    from skein.plans.queries import QUERIES

    assert QUERIES["fts_batch_topk"](spark, SF).count() == 10 * spark.read.parquet(f"{SF}/benchmark.parquet").count()


def test_phrases_stand_whole():
    some = [("a",), ("a", "b"), ("b", "a", "b"), ("a", "a")]
    rows = [["a", "b", "a", "b"], [], ["a"], ["b"], ["a", "a", "a"], ["x", "a", "x", "b"]]
    at, found = Phrases(some).find(pa.array(rows))
    want = [(r, i) for r, x in enumerate(rows) for i, p in enumerate(some) for j in range(len(x)) if tuple(x[j : j + len(p)]) == p]
    assert sorted(zip(at.tolist(), found.tolist(), strict=True)) == sorted(want)
    assert not len(Phrases([]).find(pa.array(rows))[0])


def test_best_holds_few_of_many_equal_rows():
    best = Best(3, 2, 2e-9)
    for a in range(0, 5000, 500):
        scores = np.tile([0.5, 0.0], (500, 1)) + np.array([0.0, 1.0]) * np.arange(a, a + 500)[::-1, None]
        rows, queries = np.nonzero(scores <= best.bounds(scores) + best.margin)
        best.add(queries, scores[rows, queries], pa.array([f"{i:04d}" for i in range(a, a + 500)]), rows)
    assert [len(x) for x in best.kept] == [3, 3] and best.kept[0] == [(0.5, "0000"), (0.5, "0001"), (0.5, "0002")]
    assert best.kept[1] == [(0.0, "0499"), (1.0, "0498"), (2.0, "0497")]


def test_folding(spark):
    texts = ["ascii", "ÉTÉ Straße", "ﬁne ﬂow", "µ ſ ς", "ŉ ΐ և", "x" * 50 + "ﬃ"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(lexing.fold(F.col("t"))).collect()]
    assert got == [t.casefold() for t in texts]
