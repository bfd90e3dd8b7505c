"""Segmentation against the best of all ways to cut a run."""

import math
from random import Random

from pyspark.sql import functions as F

from skein.functions import lexing, segmenting
from skein.session import ship

WORDS = {"北京": 50, "大学": 40, "北京大学": 30, "生": 5, "学生": 60, "大": 10, "活": 3, "生活": 45, "中心": 20, "研究": 25, "研究生": 15}


def plain(run, words):
    """The largest score over all cuts."""
    total = sum(words.values())
    score = lambda w: math.log(words[w] / total) if w in words else -math.log(total + 1) if len(w) == 1 else -math.inf
    if not run:
        return 0.0
    return max(score(run[:i]) + plain(run[i:], words) for i in range(1, min(len(run), 4) + 1))


def test_paths_are_the_best():
    rng, made = Random(1), segmenting.trie(WORDS)
    total = sum(WORDS.values())
    for _ in range(200):
        run = "".join(rng.choices("北京大学生活中心研究新", k=rng.randint(1, 9)))
        words = segmenting.segment_text(run, made).split()
        assert "".join(words) == run
        assert math.isclose(sum(math.log(WORDS[w] / total) if w in WORDS else -math.log(total + 1) for w in words), plain(run, WORDS))
    assert segmenting.segment_text("去北京大学研究生活 ok", made).split() == ["去", "北京大学", "研究", "生活", "ok"]
    assert segmenting.segment_text("", made) == "" and segmenting.segment_text("北" * 5000, segmenting.trie({})).split() == ["北"] * 5000


def test_columns_and_search_terms(spark):
    ship(spark)
    rows = spark.createDataFrame([(0, "研究生活 at 北京大学."), (1, "no such letters"), (2, None), (3, "")], "i int, t string")
    text = segmenting.segmented(spark, F.col("t"), WORDS)
    got = {r.i: r.terms for r in rows.select("i", lexing.terms(text).alias("terms")).collect()}
    assert got == {0: ["研究", "生活", "at", "北京大学"], 1: ["no", "such", "letters"], 2: [], 3: []}
    assert lexing.phrases(segmenting.segment_text("北京大学 生活", segmenting.trie(WORDS))) == [["北京大学"], ["生活"]]
