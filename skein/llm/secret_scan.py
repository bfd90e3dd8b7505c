"""Secret scans: rules for known kinds, and a likelihood ratio for random strings (DataFrame functions only).

Three base kinds are regexes, each matched leftmost and without overlap.  What
they don't know is found by two character Markov models, of random strings and
of ordinary identifiers: a model is a table of how often a character follows
another, counted from labelled samples.  A long run of token characters is a
secret where its log-likelihood ratio, the sum over its pairs of neighbours, is
above ``NATS``.  Samples are any rows (sample, random); :func:`samples` labels
those of a bounded draw of documents: words and compounds of words are ordinary,
digests of them, in base64, in hex and in capitals, are random.

Positions are code points.  A regex is run once to extract and, where it has
found something, once to split; a fold over the stretches between matches
gives the places, so a long text with many matches costs no more than its length.

Nulls, ties and edges: a null text is empty and has no span; kinds may overlap
each other, and each span stays; a random string that touches a base span is
left to it; repeated rows and a null doc_id get a result row each; without
samples every pair is as likely in both models and nothing is added; an empty
table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_scan import _bound, _fold

#: Base kinds in their order: regex, and what of a match must be how long (a group and characters).
KINDS = (
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
RANDOM = "random"
#: Texts without one of these hold no match of the kind.
KEYWORDS = {"assign": r"(?i)passw|secret|token|key", "access": "AKIA", "hex": r"[0-9a-f]{24}"}
#: What may be a random string.
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
#: Characters of the models; every other one is "other".
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
CELLS = len(ALPHABET) + 1
#: Log-likelihood ratio from which a string is random: odds of e^10 against the ordinary.
NATS = 10.0
#: Documents, about, that samples are drawn from: the documented bound of the training sample.
SAMPLE_DOCS = 50
#: Regex of the words and numbers that samples are made of.
WORD = r"[A-Za-z]{4,}|[0-9]{2,}"
#: How many pairs the characters' own frequencies count for in what follows a character.
PRIOR = 2

_SPAN = "struct<start:bigint,`end`:bigint>"
_FULL = "struct<start:bigint,place:int,`end`:bigint,llr:double>"


# -- models ---------------------------------------------------------------


def drawn(docs: DataFrame, n_docs: int, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """About ``sample_docs`` of the ``n_docs`` texts, by their digests."""
    at = F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("double")
    return docs.where("text IS NOT NULL").where(at * F.lit(float(n_docs)) < F.lit(sample_docs * 2.0**32)).select("text")


def samples(texts: DataFrame) -> DataFrame:
    """(sample, random) of texts: words, compounds of neighbours and paths as ordinary, digests of words as random."""
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    pairs = texts.select(F.explode(F.arrays_zip(words.alias("a"), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))).alias("b"))).alias("p")).select("p.a", "p.b").distinct()
    a, b = F.col("a"), F.coalesce("b", F.lit(""))
    made = [a, F.lower(F.concat(a, F.lit("_"), b)), F.concat(F.lower(a), F.initcap(b)), F.concat_ws("-", a, b), F.concat_ws("/", a, b), F.upper(F.concat(a, F.lit("_"), b))]
    ordinary = pairs.select(F.explode(F.array(*made)).alias("sample")).distinct()
    digest = F.sha2("sample", 256)
    packed = F.replace(F.base64(F.unhex(digest)), F.lit("="), F.lit(""))
    both = ordinary.select(F.explode(F.array(
        F.struct("sample", F.lit(False).alias("random")),
        F.struct(packed.alias("sample"), F.lit(True).alias("random")),
        F.struct(F.substring(digest, 1, 40).alias("sample"), F.lit(True).alias("random")),
        F.struct(F.substring(F.upper(packed), 1, 20).alias("sample"), F.lit(True).alias("random")),
    )).alias("s"))
    return both.select("s.*")


def _cells(text: Column) -> Column:
    """The alphabet's places of a text's characters, from 0; what is not in it is the last cell."""
    return F.transform(F.split(text, ""), lambda c: F.pmod(F.instr(F.lit(ALPHABET), c) - 1, F.lit(CELLS)))


def _pairs(text: Column) -> Column:
    """Cells of the characters' neighbourhoods: first * CELLS + second."""
    return _bound(_cells(text), lambda c: F.zip_with(F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))), lambda x, y: x * CELLS + y))


def fit(labelled: DataFrame) -> list[float]:
    """The log-likelihood ratio of each pair of characters, from rows (sample, random).

    Counts of a fixed number of cells come to the driver.  What follows a character
    is smoothed by how often it stands anywhere, and that by one for each character,
    so that a pair that no sample holds is as unlikely as its characters are.
    """
    cells = labelled.where("sample <> ''").select("random", F.explode(_pairs(F.col("sample"))).alias("cell"))
    rows = cells.groupBy("random", "cell").agg(F.count(F.lit(1)).alias("n")).collect()  # 2 * CELLS^2 at most
    logs = {}
    for kind in (True, False):
        counts = [[0] * CELLS for _ in range(CELLS)]
        for r in rows:
            if r["random"] == kind:
                counts[r["cell"] // CELLS][r["cell"] % CELLS] = r["n"]
        total = sum(map(sum, counts))
        own = [(sum(column) + 1) / (total + CELLS) for column in zip(*counts, strict=True)]
        logs[kind] = [math.log((n + PRIOR * p) / (sum(row) + PRIOR)) for row in counts for n, p in zip(row, own, strict=True)]
    return [round(a - b, 6) for a, b in zip(logs[True], logs[False], strict=True)]


def ratio(text: Column, table: list[float]) -> Column:
    """The log-likelihood ratio of a text: above 0 it looks random."""
    known = F.from_json(F.lit(json.dumps(table)), "array<double>")
    return F.aggregate(_pairs(text), F.lit(0.0), lambda total, cell: total + F.get(known, cell))


# -- spans ----------------------------------------------------------------


def _stretches(text: Column, regex: str) -> Column:
    """(hit, start, end) of each match, in order."""
    hits, parts = F.regexp_extract_all(text, F.lit(regex), F.lit(0)), F.split(text, regex, -1)

    def step(at: Column, x: Column) -> Column:
        start = at + F.length(x["part"])
        end = start + F.length(x["hit"])
        return F.struct(end.alias("state"), F.struct(x["hit"].alias("hit"), start.alias("start"), end.alias("end")).alias("found"))

    # the part after the last hit has none beside it
    pairs = F.filter(F.arrays_zip(hits.alias("hit"), parts.alias("part")), lambda x: x["hit"].isNotNull())
    return _bound(pairs, lambda p: _fold(p, F.lit(0).cast("long"), "struct<hit:string,start:bigint,`end`:bigint>", step))


def base_spans(text: Column, kind: str) -> Column:
    """The spans of a base kind: matches that are long enough; null where the text can't hold one."""
    _, regex, group, least = next(k for k in KINDS if k[0] == kind)
    told = lambda x: F.length(F.regexp_extract(x["hit"], regex, group) if group else x["hit"])
    if not group:  # a greedy run that is too short ends where a longer one would begin
        regex = regex[:-1] + "{%d,}" % (least - len("AKIA") if kind == "access" else least)
    kept = F.filter(_stretches(text, regex), lambda x: told(x) >= least)
    return F.when(text.rlike(KEYWORDS[kind]), F.transform(kept, lambda x: F.struct(x["start"], x["end"])))


def random_spans(text: Column, table: list[float]) -> Column:
    """(start, end, llr) of long runs of token characters that look random; null where the text has no such run."""
    scored = F.transform(_stretches(text, CANDIDATE), lambda x: F.struct(x["start"], x["end"], ratio(x["hit"], table).alias("llr")))
    return F.when(text.rlike(CANDIDATE), F.filter(scored, lambda x: x["llr"] >= NATS))


def _apart(found: Column, base: Column) -> Column:
    """Spans of ``found`` that touch none of ``base``, by one walk over both in the order of their starts."""
    both = F.array_sort(F.concat(
        F.transform(base, lambda x: F.struct(x["start"].alias("start"), F.lit(0).alias("place"), x["end"].alias("end"), F.lit(0.0).alias("llr"))),
        F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(1).alias("place"), x["end"].alias("end"), x["llr"].alias("llr"))),
    ))

    def after(reach: Column, x: Column) -> Column:
        """Found spans that begin behind all base spans before them; the reach goes on."""
        free = (x["place"] == 1) & (x["start"] >= reach)
        return F.struct(F.when(x["place"] == 0, F.greatest(reach, x["end"])).otherwise(reach).alias("state"), F.when(free | (x["place"] == 0), x).alias("found"))

    def before(next_: Column, x: Column) -> Column:
        """The same from the right: those that end before the next base span."""
        free = (x["place"] == 1) & (x["end"] <= next_)
        return F.struct(F.when(x["place"] == 0, F.least(next_, x["start"])).otherwise(next_).alias("state"), F.when(free, x).alias("found"))

    right = _bound(both, lambda xs: _fold(xs, F.lit(0).cast("long"), _FULL, after))
    return F.reverse(_bound(F.reverse(right), lambda xs: _fold(xs, F.lit(2**62).cast("long"), _FULL, before)))


def scan(docs: DataFrame, table: list[float]) -> DataFrame:
    """``docs`` with ``spans``: structs of kind, start, end (exclusive) and llr (null for base kinds), by start, then kind; a column of this name is replaced."""
    docs = docs.drop("spans", "_text", "_random", "_base", *[f"_{k[0]}" for k in KINDS])
    text, none = F.col("_text"), F.array().cast(f"array<{_SPAN}>")
    out = docs.withColumn("_text", F.coalesce(docs["text"], F.lit("")))
    out = out.withColumns({f"_{kind}": F.coalesce(base_spans(text, kind), none) for kind, *_ in KINDS} | {"_random": random_spans(text, table)})
    out = out.withColumn("_base", F.concat(*[F.col(f"_{k[0]}") for k in KINDS]))

    def told(spans: str, i: int, kind: str) -> Column:
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("place"), x["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(None).cast("double").alias("llr")))

    every = [told(f"_{kind}", i, kind) for i, (kind, *_) in enumerate(KINDS)]
    added = F.when(F.size("_random") > 0, _apart(F.col("_random"), F.col("_base")))
    added = F.transform(added, lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS)).alias("place"), x["end"].alias("end"), F.lit(RANDOM).alias("kind"), x["llr"].alias("llr")))
    added = F.coalesce(added, F.array().cast("array<struct<start:bigint,place:int,`end`:bigint,kind:string,llr:double>>"))
    spans = F.transform(F.array_sort(F.concat(*every, added)), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["llr"].alias("llr")))
    return out.withColumn("spans", spans).drop("_text", "_random", "_base", *[f"_{k[0]}" for k in KINDS])


def written(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    table = fit(samples(drawn(docs, docs.count())))
    out = scan(docs, table)
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"] != RANDOM)
    return out.select("doc_id", *[count(kind) for kind, *_ in KINDS], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    cell = f"(strpos({quote(ALPHABET)}, {{}}) - 1 + {CELLS}) % {CELLS}"
    kinds = [(i, kind, regex, group, least) for i, (kind, regex, group, least) in enumerate(KINDS)]
    hits = "\n  UNION ALL ".join(f"SELECT r, {i} AS place, {quote(kind)} AS kind, {group} AS grp, {least} AS least, string_split_regex(t, {quote(regex)}) AS parts, regexp_extract_all(t, {quote(regex)}) AS hits, regexp_extract_all(t, {quote(regex)}, {group}) AS told FROM d" for i, kind, regex, group, least in kinds)
    pairs = "(SELECT {1}, unnest(list_zip(cs[1:len(cs) - 1], cs[2:])) AS p FROM (SELECT {1}, string_split({0}, '') AS cs FROM {2}))"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), drawn AS (
  SELECT regexp_extract_all(text, '{WORD}') AS w FROM documents
  WHERE text IS NOT NULL AND ('0x' || substr(md5(text), 1, 8))::BIGINT::DOUBLE * (SELECT count(*) FROM documents) < {SAMPLE_DOCS} * 4294967296.0::DOUBLE
), nb AS (SELECT DISTINCT w[i] AS a, coalesce(w[i + 1], '') AS b, w[i + 1] IS NULL AS last_ FROM (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM drawn)
), ordinary AS (
  SELECT DISTINCT unnest([a, lower(a || '_' || b), lower(a) || upper(b[1]) || lower(b[2:]), CASE WHEN last_ THEN a || '-' ELSE a || '-' || b END, CASE WHEN last_ THEN a || '/' ELSE a || '/' || b END, upper(a || '_' || b)]) AS s FROM nb
), dug AS (SELECT s, sha256(s) AS h, replace(to_base64(unhex(sha256(s))), '=', '') AS e FROM ordinary
), labelled AS (
  SELECT s AS sample, false AS random FROM dug UNION ALL SELECT e, true FROM dug UNION ALL SELECT substr(h, 1, 40), true FROM dug UNION ALL SELECT substr(upper(e), 1, 20), true FROM dug
), seen AS (
  SELECT random, {cell.format("p[1]")} AS a, {cell.format("p[2]")} AS b, count(*) AS n FROM {pairs.format("sample", "random", "labelled")} GROUP BY ALL
), grid AS (
  SELECT random, a, b, coalesce(n, 0) AS n FROM (SELECT * FROM (VALUES (true), (false)) v(random), range({CELLS}) x(a), range({CELLS}) y(b)) LEFT JOIN seen USING (random, a, b)
), own AS (
  SELECT *, sum(n) OVER (PARTITION BY random, a) AS of_a, (sum(n) OVER (PARTITION BY random, b) + 1) / (sum(n) OVER (PARTITION BY random) + {CELLS})::DOUBLE AS p FROM grid
), logs AS (SELECT random, a, b, ln((n + {PRIOR} * p) / (of_a + {PRIOR})) AS l FROM own
), ratios AS (SELECT x.a, x.b, round(x.l - y.l, 6) AS llr FROM logs x JOIN logs y ON x.a = y.a AND x.b = y.b AND x.random AND NOT y.random
), raw AS (
  {hits}
  UNION ALL SELECT r, {len(KINDS)}, '{RANDOM}', 0, 16, string_split_regex(t, '{CANDIDATE}'), regexp_extract_all(t, '{CANDIDATE}'), regexp_extract_all(t, '{CANDIDATE}') FROM d
), placed AS (
  SELECT r, place, kind, least, hits[i] AS hit, told[i] AS told, length(array_to_string(parts[1:i], '')) + length(array_to_string(hits[1:i - 1], '')) AS a
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM raw)
), span AS (SELECT r, place, kind, a, a + length(hit) AS z, hit FROM placed WHERE length(told) >= least
), tokens AS (SELECT DISTINCT hit FROM span WHERE kind = '{RANDOM}'
), scored AS (
  SELECT hit, sum(llr) AS llr FROM (SELECT hit, {cell.format("p[1]")} AS a, {cell.format("p[2]")} AS b FROM {pairs.format("hit", "hit", "tokens")}) JOIN ratios USING (a, b) GROUP BY 1
), kept AS (
  SELECT r, place, kind, a, z FROM span WHERE kind <> '{RANDOM}'
  UNION ALL
  SELECT r, place, kind, a, z FROM span x JOIN scored USING (hit) WHERE kind = '{RANDOM}' AND llr >= {NATS}
    AND NOT EXISTS (SELECT 1 FROM span y WHERE y.r = x.r AND y.kind <> '{RANDOM}' AND y.a < x.z AND x.a < y.z)
), out_ AS (
  SELECT r, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
         string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, place) FILTER (WHERE kind <> '{RANDOM}') AS base, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, place) AS spans
  FROM kept GROUP BY 1
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN out_ USING (r)
"""


SQL = _sql()
