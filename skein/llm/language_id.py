"""Language identification by compression.

Each language has a raw-content zstandard dictionary: training texts (their first
``SAMPLE_CHARS`` characters) in lower case, everything but letters as single spaces.  A text, in the same form,
is encoded with every dictionary, and the language whose dictionary gives the
fewest bytes wins.  Short texts are encoded at a higher level.  A decision is rejected where the runner
up comes within ``MIN_MARGIN`` of the winner.

Nulls, ties and edges: a null text, or one without a letter, is ``und`` with
score 0 and rejected; ties go to the language that sorts first; null labels are
never learned; with nothing to learn from, every text is ``und``; repeated rows
and a null doc_id get a result row each; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import sparing

UNKNOWN = "und"
#: Bytes of each dictionary: the documented bound of the training sample.
DICT_BYTES = 96 << 10
#: Languages at most; more labels than that are an error, not a silent cut.
MAX_LANGS = 400
#: About how many labelled texts of a language are drawn to fill its dictionary.
SAMPLE_TEXTS = 160
#: Longest piece of a training text, in characters; predictions take whole texts.
SAMPLE_CHARS = 16_000
#: Relative margin of the second best below which a decision is rejected.
MIN_MARGIN = 0.001
LEVEL = 3
#: Texts under so many bytes are encoded at SHORT_LEVEL.
SHORT_BYTES, SHORT_LEVEL = 2_000, 9

#: a-z and what is not ASCII stay; the rest becomes spaces.
_LETTERS = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def bare(text: str) -> bytes:
    """The text's letters in lower case, other ASCII as single spaces."""
    return b" ".join(text.lower().encode().translate(_LETTERS).split())


def encoders(raw: bytes, level: int) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)


def held_out(doc_id: Column) -> Column:
    """The rows that nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(labelled: DataFrame) -> dict[str, bytes]:
    """A dictionary for each language from rows (text, lang, and ``key``; the sample is drawn by a hash of key and text).

    Every label with a text that holds a letter is learned, or it is an error.
    Rows of one key and text are drawn once, and at most ``4 * SAMPLE_TEXTS`` rows
    of a language come to the driver.
    """
    scale = 1 << 40
    rows = labelled.where("lang IS NOT NULL").where(F.col("text").rlike(r"\pL"))
    rows = rows.select("lang", "text", F.pmod(F.xxhash64("key", "text"), F.lit(scale)).alias("place"))
    # repeated rows share a place: they neither crowd a language's draw nor leave it empty
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("place").alias("n"), F.min("place").alias("least")).limit(MAX_LANGS + 1).collect()
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], max(r["least"] + 1, min(scale, scale * SAMPLE_TEXTS // max(1, r["n"]))))])
    drawn = rows.where(F.col("place") < share[F.col("lang")])
    # long texts give a piece that starts at their first letter
    piece = F.substring(F.regexp_replace("text", r"\A\PL+", ""), 1, SAMPLE_CHARS)
    drawn = drawn.select("lang", "place", piece.alias("text")).groupBy("lang", "place").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy("place")
    drawn = drawn.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= 4 * SAMPLE_TEXTS).select("lang", "place", "text").orderBy("lang", "place")
    held: dict[str, bytes] = {r["lang"]: b"" for r in sorted(counts, key=lambda r: r["lang"])}
    for r in drawn.toLocalIterator():
        if len(held[r["lang"]]) < DICT_BYTES:
            held[r["lang"]] = b" ".join(x for x in (held[r["lang"]], bare(r["text"])) if x)[:DICT_BYTES]
    if missing := [k for k, v in held.items() if not v]:
        raise ValueError(f"languages without a dictionary: {missing}")
    return held


def predict(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and accepted; columns of these names are replaced.

    The dictionaries are ``DICT_BYTES`` for each language, so what is sent to
    the executors does not grow with the documents.
    """
    docs = docs.drop("lang_pred", "score", "accepted")
    names = sorted(dictionaries)
    sent = docs.sparkSession.sparkContext.broadcast([dictionaries[k] for k in names])
    out = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long, short = ([encoders(raw, level) for raw in sent.value] for level in (LEVEL, SHORT_LEVEL))
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            letters = pc.fill_null(pc.match_substring_regex(text, r"\pL"), False).to_pylist()
            langs, scores, accepted = [], [], []
            for t, has in zip(text, letters, strict=True):
                if not has or not names:
                    langs.append(UNKNOWN), scores.append(0.0), accepted.append(False)
                    continue
                data = bare(t.as_py())
                sizes = [len(m.compress(data)) for m in (short if len(data) < SHORT_BYTES else long)]
                best = min(range(len(sizes)), key=sizes.__getitem__)
                rest = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best])
                margin = (rest - sizes[best]) / rest
                langs.append(names[best]), scores.append(min(1.0, margin)), accepted.append(margin >= MIN_MARGIN)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())], names=out.names)

    return docs.mapInArrow(sparing(run), out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document; learned from the documents that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learned = fit(docs.where(~held_out(F.col("doc_id"))).select("text", "lang", F.col("doc_id").alias("key")))
    told = predict(docs.select("doc_id", "text"), learned)
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")
