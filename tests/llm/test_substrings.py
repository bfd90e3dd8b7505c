"""Substring dedup: texts of one doc_id that a short hash would take for one."""

from pyspark.sql import functions as F

from skein.llm import substring_dedup


def test_texts_of_equal_short_hashes_keep_their_own_marks(spark):
    words = "one two three four five six seven eight nine ten eleven twelve thirteen"
    texts = spark.range(400_000).select(F.concat(F.lit(words + " "), F.col("id").cast("string")).alias("text"))
    low = F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF))
    a, b = sorted(texts.groupBy(low).agg(F.collect_list("text").alias("t")).where("size(t) > 1").first()["t"])[:2]
    longer = b + " " + words.replace("one", "other")
    rows = [(1, a), (5, a), (5, b), (5, longer), (None, a)]
    got = {(r.doc_id, r.n_words): (r.n_removed, r.text) for r in substring_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect() if (r.doc_id, r.n_words) != (5, 14) or r.text != b.split()[-1]}
    assert got[1, 14] == (0, a) and got[None, 14] == (0, a)
    assert got[5, 14] == (14, "")  # document 1 has all of its windows
    assert got[5, 27] == (13, " ".join(longer.split()[13:]))
