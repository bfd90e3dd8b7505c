"""Line dedup on levelled sorted runs of line hashes (DataFrame functions only).

The texts are read once to hash their lines: (document, position, hash) of every
line is written to a table by batch.  Each batch counts its lines' documents and
merge-anti-joins the runs: lines that a run has already settled, that is, holds
for ``min_docs`` documents, are known to be common and need no more counting.
What is left becomes a run of its own, a table bucketed and sorted by hash, so
that the merge joins of later batches neither shuffle nor sort it.  A full level
of runs is compacted into one run of the next level.  When all batches are in,
the positions of common lines go back to their documents, and the texts are read
a second time without hashing a line again.

Nulls, ties and edges: a null or empty text is one empty line; an empty key is
never dropped; documents are told apart by doc_id and text: repeated rows (and
rows without doc_id that hold one text) count as one document, rows that share
a doc_id but not a text count each; every input row gives one result row; an
empty table gives an empty result; columns other than doc_id and text are not
read by the counting and pass through :func:`drop_common_lines` unchanged.
"""

from __future__ import annotations

import string
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import Scratch

BLANKS = " \t\n\x0b\x0c\r"
#: Documents from which on a line counts as boilerplate.
MIN_DOCS = 10
#: Runs of a level that are compacted into one of the next.
FAN_OUT = 2
#: Batches in which one call takes in a whole table.
BATCHES = 4


def lines(text: Column) -> Column:
    """Lines of a text, at \\n; null is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without ASCII blanks at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.length(bare) == F.octet_length(bare)
    # lower() also maps letters outside A-Z, so it serves ASCII lines alone
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def text_hash(text: Column) -> Column:
    """What tells texts of one doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_table(docs: DataFrame, batches: int = 1) -> DataFrame:
    """(doc_id, text_hash, pos, h1, h2, batch) of every line; the 128 bits of its key are null where that is empty."""
    told = docs.select("doc_id", text_hash(docs["text"]).alias("text_hash"), F.posexplode(lines(docs["text"])).alias("pos", "line"))
    key = line_key(F.col("line"))
    batch = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(batches)).cast("int")
    return told.select("doc_id", "text_hash", "pos", F.when(key != "", F.xxhash64(key)).alias("h1"), F.when(key != "", F.xxhash64(F.lit(7), key)).alias("h2"), batch.alias("batch"))


@dataclass
class LineRuns:
    """Levelled sorted runs of (h1, h2, n_docs); a line's documents are the sum over the runs, or ``settled`` and more."""

    spark: SparkSession
    fan_out: int = FAN_OUT
    settled: int = MIN_DOCS
    levels: list[list[DataFrame]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.scratch = Scratch(self.spark, "line-runs")
        self._names: dict[int, str] = {}

    def _run(self, df: DataFrame, level: int) -> DataFrame:
        """A run written with a bucket for each shuffle partition, sorted within."""
        name, buckets = f"skein_run_{uuid.uuid4().hex}", int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.format("parquet").bucketBy(buckets, "h1", "h2").sortBy("h1", "h2").option("compression", "zstd").option("path", self.scratch.path(f"level{level}")).saveAsTable(name)
        run = self.spark.table(name)
        self._names[id(run)] = name
        return run

    def _drop(self, run: DataFrame) -> None:
        self.scratch.drop(run)
        self.spark.sql(f"DROP TABLE IF EXISTS {self._names.pop(id(run))}")

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def counts(self) -> DataFrame | None:
        """Documents of every line over all runs."""
        return _summed(self.runs()) if self.runs() else None

    def unsettled(self, counted: DataFrame) -> DataFrame:
        """Rows (h1, h2, n_docs) whose line no run holds for enough documents, by a merge-anti-join with each run."""
        for r in self.runs():
            counted = counted.join(r.where(F.col("n_docs") >= self.settled).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return counted

    def add(self, table: DataFrame) -> None:
        """Take in a batch of :func:`line_table` as a run of its own, then compact full levels."""
        held = table.where("h1 IS NOT NULL").select("doc_id", "text_hash", "h1", "h2").distinct()
        counted = held.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"))
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self._run(self.unsettled(counted), 0))
        level = 0
        while len(self.levels[level]) >= self.fan_out:
            old = self.levels[level]
            merged = self._run(_summed(old), level + 1)
            self.levels[level] = []
            for r in old:
                self._drop(r)
            if len(self.levels) == level + 1:
                self.levels.append([])
            level += 1
            self.levels[level].append(merged)

    def close(self) -> None:
        """Delete the runs."""
        for r in self.runs():
            self._drop(r)
        self.levels = []


def _summed(runs: list[DataFrame]) -> DataFrame:
    """Runs merged into one: full merge joins on the hash, which neither shuffle nor sort bucketed runs."""
    out = runs[0]
    for r in runs[1:]:
        # a union of bucketed tables under an aggregate is no substitute: Spark 4.1 then plans no exchange and does not add up
        more = r.select("h1", "h2", F.col("n_docs").alias("_more")).hint("merge")
        out = out.join(more, ["h1", "h2"], "full").select("h1", "h2", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("_more", F.lit(0))).alias("n_docs"))
    return out


def drop_common_lines(docs: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES, runs: LineRuns | None = None) -> DataFrame:
    """``docs`` with its text less the lines that ``min_docs`` documents hold, and columns n_lines and n_dropped (such columns are replaced).

    ``runs`` may hold earlier batches, which count too; these documents are added to
    it.  A run stops counting a line that ``settled`` documents hold, so ``min_docs``
    above that is an error.  A document that comes in two calls counts in both.
    """
    if runs is not None and min_docs > runs.settled:
        raise ValueError(f"min_docs ({min_docs}) is above the runs' settled ({runs.settled}): lines are not counted that far")
    docs = docs.drop("n_lines", "n_dropped", "_id", "_hash", "_gone")
    scratch = Scratch(docs.sparkSession, "lines")
    table = scratch.save(line_table(docs, batches), "hashes", by="batch")
    held = runs or LineRuns(docs.sparkSession, settled=min_docs)
    for i in range(batches):
        held.add(table.where(F.col("batch") == i))
    common = scratch.save(held.counts().where(F.col("n_docs") >= min_docs).select("h1", "h2"), "common")
    if runs is None:
        held.close()
    found = table.where("h1 IS NOT NULL").join(common, ["h1", "h2"], "left_semi")
    gone = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_set("pos").alias("_gone"))
    both = docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]) & (text_hash(docs["text"]) == gone["_hash"]), "left")
    gone, text = F.col("_gone"), F.coalesce(docs["text"], F.lit(""))
    # the array of one element binds a document's lines, which are split once
    stay = lambda ls: F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), gone)
    kept = F.get(F.transform(F.array(lines(docs["text"])), lambda ls: F.array_join(F.transform(stay(ls), lambda i: F.get(ls, i)), "\n")), F.lit(0))
    columns = [F.when(gone.isNotNull(), kept).otherwise(text).alias(c) if c == "text" else docs[c] for c in docs.columns]
    n_lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    return both.select(*columns, n_lines.alias("n_lines"), F.when(gone.isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_dropped"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: line counts and the digest of what is kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_common_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, md5(coalesce(text, '')) AS told, row_number() OVER () AS r FROM documents
), l AS (
  SELECT r, doc_id, told, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
  FROM l
), common AS (
  SELECT line_key FROM (SELECT DISTINCT line_key, doc_id, told FROM k WHERE line_key <> '') GROUP BY 1 HAVING count(*) >= 10
), f AS (
  SELECT k.*, c.line_key IS NOT NULL AS gone FROM k LEFT JOIN common c USING (line_key)
)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY r
"""
