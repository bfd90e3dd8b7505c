"""Every stage of the pipeline on awkward rows: nulls anywhere, empty texts, repeated rows, clashing columns, an empty table."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, accepted string, _id string, pieces string, n_items string"


def rows():
    prose = "the people walk along the river every morning before work begins and the house stands near the water " + " ".join(f"letter{chr(97 + k)}" for k in range(26)) + " and so on until the evening comes again over the quiet fields"
    boiler = "all rights reserved by the owners"
    out = [(i, f"{prose} {i}\n{boiler}", "en", "s", 1) for i in range(14)]
    out += [(20, "", "en", "s", 0), (21, None, "en", "s", None), (22, " \n ", None, None, None), (None, None, None, None, None), (None, prose, None, None, None), (23, prose.upper(), "en", "s", 3), (23, prose.upper(), "en", "s", 3), (24, "word " * 40_000, "en", "s", 4)]
    return [(*r, "x", "y", "z", "w", "v") for r in out]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_awkward_rows(spark, tmp_path, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(f"file://{tmp_path}/in")
    docs = spark.read.parquet(f"file://{tmp_path}/in")
    out = stage(spark, docs, SF)
    got = out.collect()
    last = name == corpus_pipeline.STAGES[-1][0]
    assert out.columns == corpus_pipeline.COLUMNS or last
    was = sorted(((r[0], r[1]) for r in rows()), key=str)
    if name == "language_id":
        assert not any(r.text is None or not any(c.isalpha() for c in r.text) for r in got)
    elif name == "line_dedup":
        assert len(got) == len(was)
        texts = {r.doc_id: (r.text, r.n_chars) for r in got}
        assert texts[3] == (rows()[3][1].split("\n")[0], len(rows()[3][1].split("\n")[0]))  # the length is that of what is left
        assert texts[20] == ("", 0) and texts[21][0] in ("", None) and texts[24][0] == "word " * 40_000
    elif name == "jaccard_join":
        kept = [(r.doc_id, r.text) for r in got]
        # the 14 near copies become one row; the upper-case copies and the row without an id are near copies of each other
        assert sum(r.text is not None and r.text.endswith("owners") for r in got) == 1 and {(20, ""), (21, None), (22, " \n "), (None, None)} <= set(kept)
        assert len([t for _, t in kept if t and t.lower().startswith("the people")]) <= 2 and len(kept) <= 7
    elif name == "decontaminate":
        assert sorted(((r.doc_id, r.text) for r in got), key=str) == was
    else:
        assert len(got) == len(was)
    empty = stage(spark, docs.where(F.lit(False)), SF)
    assert empty.count() == 0 and empty.columns == out.columns
