"""What the operators hold beside their results: workers' memory, and tables on disk."""

from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

from skein import session
from skein.llm import decontaminate, jaccard_join, language_id, sentencepiece_codec


@pytest.mark.parametrize("stage", ["language_id", "jaccard_join", "decontaminate", "sentencepiece"])
def test_tasks_of_the_pipeline_give_their_memory_back(spark, monkeypatch, stage):
    docs = spark.createDataFrame([(1, "a few words of text")], "doc_id long, text string")
    frame, runs = type(docs), []
    real = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *rest: (runs.append(f), real(self, f, *rest))[1])
    if stage == "language_id":
        language_id.predict(docs, {"en": b"words of a text"})
    elif stage == "jaccard_join":
        jaccard_join.signatures(docs, np.zeros(1 << jaccard_join.CELL_BITS, np.int32))
    elif stage == "decontaminate":
        decontaminate.count_leaks(docs, spark.createDataFrame([(7, "an item of some words")], "item_id long, text string"))
    else:
        sentencepiece_codec.encode(docs)
    given = []
    monkeypatch.setattr(session, "give_back", lambda: given.append(1))
    for run in runs:
        assert list(run(iter([]))) == []
    assert len(given) == len(runs) == 1


def test_prefixes_are_gone_once_the_postings_stand(spark, monkeypatch):
    roots = []

    class Kept(jaccard_join.Scratch):
        def __init__(self, *args):
            super().__init__(*args)
            roots.append(self.root)

    monkeypatch.setattr(jaccard_join, "Scratch", Kept)
    rows = [(i, " ".join(f"w{i // 2}x{j}" for j in range(30 + i % 2))) for i in range(40)]
    slim, placed = jaccard_join.place_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    tables = [pq.read_schema(f).names for root in roots for f in Path(root.removeprefix("file://")).rglob("*.parquet")]
    assert ["doc_id", "n", "cid"] in tables and not any("prefix" in names for names in tables)
    # groups are numbered in parts, and no number is given twice
    assert placed.select("gid").distinct().count() == 40 and placed.select("root").distinct().count() == 20 and slim.count() == 40
