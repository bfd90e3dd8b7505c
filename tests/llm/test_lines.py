"""Line dedup: what a document is, long documents, and runs."""

import pytest
from pyspark.sql import functions as F

from skein.llm import line_dedup


def test_documents_are_told_by_id_and_text(spark):
    rows = [(1, "same\nonce")] * 12 + [(2, f"other {i}\nshared") for i in range(12)] + [(None, "none")] * 12 + [(3, "none"), (3, None), (4, "")]
    got = line_dedup.drop_common_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert all(r.n_dropped == 0 for r in got if r.doc_id in (1, None, 3, 4))  # repeated rows are one document
    assert all((r.n_dropped, r.n_lines) == (1, 2) and "shared" not in r.text for r in got if r.doc_id == 2)


def test_long_document_and_runs(spark):
    many = [f"line {i}" for i in range(40_000)]
    rows = [(0, "\n".join(many))] + [(i, "\n".join(many[: 20 * i])) for i in range(1, 12)]
    got = {r.doc_id: r for r in line_dedup.drop_common_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].n_lines == 40_000 and got[0].n_dropped == 60 and got[0].text == "\n".join(many[60:])
    assert got[2].text == "" and got[2].n_dropped == 40


def test_settled_lines_leave_later_batches(spark):
    runs = line_dedup.LineRuns(spark, fan_out=2, settled=3)
    for i in range(4):
        docs = spark.createDataFrame([(10 * i + k, f"same\nown {i} {k}\npair {i // 2}") for k in range(3)], "doc_id long, text string")
        runs.add(line_dedup.line_table(docs))
    # 'same' is settled by the first batch and stays out of the others
    assert sorted(r.n_docs for r in runs.counts().collect()) == [1] * 12 + [3] * 3
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    tables = spark.sql("SHOW TABLES").where(F.col("tableName").startswith("skein_run_")).count()
    runs.close()
    assert tables == 1 and spark.sql("SHOW TABLES").where(F.col("tableName").startswith("skein_run_")).count() == 0


def test_runs_that_settle_too_early_are_refused(spark):
    docs = spark.createDataFrame([(i, "same") for i in range(40)], "doc_id long, text string")
    with pytest.raises(ValueError, match="settled"):
        line_dedup.drop_common_lines(docs, min_docs=30, runs=line_dedup.LineRuns(spark, settled=10))
    runs = line_dedup.LineRuns(spark, settled=30)
    assert line_dedup.drop_common_lines(docs, min_docs=30, runs=runs).where("n_dropped = 1").count() == 40
    runs.close()
