"""Words of scripts that are written without spaces, by a given dictionary.

The dictionary (word, how often) becomes a trie that goes to the tasks once.  In a run
of Han, kana or Thai letters every word of it that begins at a place is an edge; the
most probable path through the run is found from its end, and what no word covers
stands as single letters.  Everything else in a text stays as it is, so segmented text
can go through any function of this package; a query goes through :func:`segment_text`.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Letters of scripts without spaces between words.
RUN = re.compile("[฀-๿぀-ヿ㐀-䶿一-鿿豈-﫿]+")
#: Words of a dictionary at most: the bound of what is broadcast.
MOST_WORDS = 2_000_000


def trie(words: dict[str, int]) -> tuple[dict, float]:
    """(a trie whose nodes map a letter to the next one, and "" to the word's log probability; that of an unknown letter)."""
    if len(words) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} words")
    total, top = sum(words.values()) or 1, {}
    for word, n in words.items():
        if word and n > 0:
            node = top
            for letter in word:
                node = node.setdefault(letter, {})
            node[""] = math.log(n / total)
    return top, -math.log(total + 1)


def _cut(run: str, top: dict, unknown: float) -> list[str]:
    """The words of the most probable path; of equal ones the one whose first word is longer."""
    best = [(0.0, 0)] * (len(run) + 1)
    for i in range(len(run) - 1, -1, -1):
        best[i] = unknown + best[i + 1][0], i + 1
        node = top
        for j in range(i, len(run)):
            node = node.get(run[j])
            if node is None:
                break
            if "" in node and (score := node[""] + best[j + 1][0]) >= best[i][0]:
                best[i] = score, j + 1
    out, at = [], 0
    while at < len(run):
        out.append(run[at : best[at][1]])
        at = best[at][1]
    return out


def segment_text(text: str, made: tuple[dict, float]) -> str:
    """The text with spaces around and between the words of its runs."""
    return RUN.sub(lambda m: f" {' '.join(_cut(m[0], *made))} ", text)


def segmented(spark: SparkSession, text: Column, words: dict[str, int]) -> Column:
    """The text with spaces between words; null stays null, and a text without such letters is not sent to Python's path."""
    sent = spark.sparkContext.broadcast(trie(words))

    @F.pandas_udf("string")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: segment_text(t, sent.value), na_action="ignore")

    return F.when(text.rlike(RUN.pattern), cut(F.when(text.rlike(RUN.pattern), text))).otherwise(text)
