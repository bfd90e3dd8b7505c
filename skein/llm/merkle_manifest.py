"""Merkle manifest of a table: a tree per key and one over the keys' roots.

Rows become leaves, a digest of their columns.  Leaves are numbered within
their key by a range partition and the counts of its parts, so that no key is
sorted in one task.  A level of the tree is a table of numbered nodes.  Windows
over blocks of it hold seven lag and seven lead columns, masked by a node's slot
and its run's length: they are the node's siblings, and the first child of each
run hashes the run to its parent.  Proofs are joined from the root down by
(key, number of the run), which is even at every level, whatever the keys.

Nulls, ties and edges: a null column is ``-`` in its leaf; a null key is a tree
of its own and comes first; null ids come first, rows of one id are ordered by
their leaves; equal rows are equal leaves in a row each; a key of one row has
that leaf as its root; a table of one key has that key's root; an empty table
has no root and an empty result; other columns are not read.  A row whose id is
null is not tampered with.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import Scratch

#: Consecutive nodes of which a parent is made.
FAN = 8
#: Nodes of a window: whole runs, few enough that no task holds a large part of a level.
BLOCK = FAN * FAN
#: What a leaf is made of, in this order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "array<struct<left:binary,right:binary>>"
_PLACE_BITS = 33


def digest(value: Column) -> Column:
    """The 32 bytes of a text's or a binary's sha256."""
    return F.unhex(F.sha2(value, 256))


def joined(digests: Column) -> Column:
    """H of digests that stand one after the other as 32 bytes each: sha256 of their hex text."""
    return digest(F.lower(F.hex(digests)))


def told(value: Column) -> Column:
    """A column in a leaf: its length in bytes and its text, or ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    """The digest of a row."""
    return digest(F.concat(*map(told, values)))


def tree_key(value: Column) -> Column:
    """A key that is never null and sorts as its value does, null first."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def numbered(rows: DataFrame, order: Sequence[str], scratch: Scratch) -> tuple[DataFrame, int]:
    """``rows`` with ``pos``, their place within ``key`` by ``order`` from 0, and ``n``, the key's rows; and the largest n.

    Rows are dealt out by ranges of (key, order) and sorted within a part; a part's
    first place and its count of each key are all that the parts need of each other.
    """
    by = [F.col("key"), *[F.col(c).asc_nulls_first() for c in order]]
    spot = F.monotonically_increasing_id()
    placed = scratch.save(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_spot", spot), "sorted")
    part = F.shiftright("_spot", _PLACE_BITS)
    runs = placed.groupBy("key", part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_spot").alias("_first"))
    whole = Window.partitionBy("key")
    before = F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    # a row for each part and key; one more for a key that several parts hold
    runs = scratch.save(runs.withColumns({"_before": F.coalesce(before, F.lit(0)), "n": F.sum("_n").over(whole)}).select("key", "_part", "_first", "_before", "n"), "runs")
    most = runs.agg(F.max("n")).first()[0] or 0
    out = placed.withColumn("_part", part).join(runs, ["key", "_part"])
    return out.withColumn("pos", F.col("_before") + F.col("_spot") - F.col("_first")).drop("_spot", "_part", "_first", "_before"), most


def with_siblings(nodes: DataFrame) -> DataFrame:
    """Nodes (key, pos, n, hash) with ``left`` and ``right``, their siblings' digests, and on each run's first child ``parent``."""
    over = Window.partitionBy("key", F.floor(F.col("pos") / BLOCK)).orderBy("pos")
    slot = F.pmod(F.col("pos"), F.lit(FAN))
    size = F.least(F.lit(FAN).cast("long"), F.col("n") - (F.col("pos") - slot))
    empty = F.lit(b"")
    back = [F.when(slot >= k, F.lag("hash", k).over(over)).otherwise(empty) for k in range(FAN - 1, 0, -1)]
    ahead = [F.when(slot + k < size, F.lead("hash", k).over(over)).otherwise(empty) for k in range(1, FAN)]
    wide = nodes.select("*", F.concat(*back).alias("left"), F.concat(*ahead).alias("right"))
    return wide.withColumn("parent", F.when((slot == 0) & (F.col("n") > 1), joined(F.concat("hash", "right"))))


@dataclass(frozen=True)
class Tree:
    """``levels`` of nodes (key, pos, n, hash, left, right, ...), leaves first; a key's root is its node of the level where n is 1."""

    levels: list[DataFrame]

    def roots(self) -> DataFrame:
        """(key, root) of every key."""
        out = None
        for level in self.levels:
            some = level.where("n = 1").select("key", F.col("hash").alias("root"))
            out = some if out is None else out.unionByName(some)
        return out

    def paths(self, roots: DataFrame, scratch: Scratch) -> DataFrame:
        """The leaves with ``path``, their siblings from the leaf up, and the other columns of ``roots`` (key, path, ...), where a key's path goes on."""
        rest = [c for c in roots.columns if c not in ("key", "path")]
        above = None
        for height in range(len(self.levels) - 1, -1, -1):
            level = self.levels[height].drop("parent", *rest)
            here = level.where("n = 1").join(roots, "key")
            if above is not None:
                up = above.select("key", F.col("pos").alias("_run"), F.col("path").alias("_path"), *rest)
                below = level.where("n > 1").withColumn("_run", F.floor(F.col("pos") / FAN)).join(up, ["key", "_run"])
                step = F.array(F.struct("left", "right")).cast(_PATH)
                here = here.unionByName(below.withColumn("path", F.concat(step, "_path")).drop("_run", "_path"), allowMissingColumns=True)
            if height:
                here = scratch.save(here.select("key", "pos", "path", *rest), "paths")
            above = here
        return above


def build(leaves: DataFrame, order: Sequence[str], scratch: Scratch) -> Tree:
    """The tree over rows (key, hash, ...), each key's ascending by ``order``; further columns stay with the leaves."""
    nodes, most = numbered(leaves, order, scratch)
    levels = [scratch.save(with_siblings(nodes), "level")]
    while most > 1:
        up = levels[-1].where("parent IS NOT NULL").select("key", F.floor(F.col("pos") / FAN).alias("pos"), F.ceil(F.col("n") / FAN).alias("n"), F.col("parent").alias("hash"))
        levels.append(scratch.save(with_siblings(up), "level"))
        most = -(-most // FAN)
    return Tree(levels)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda h, x: joined(F.concat(x["left"], h, x["right"])))


def proof(path: Column) -> Column:
    """All siblings of a path, as digests one after the other."""
    return F.aggregate(path, F.lit(b""), lambda acc, x: F.concat(acc, x["left"], x["right"]))


def manifest(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, str | None]:
    """(leaves with path and subroot, hex root) of rows (key, hash, id, ...): a tree for each key, and one over the keys in their order."""
    tree = build(rows, ["id", "hash"], scratch)
    subroots = scratch.save(tree.roots().select(F.lit("").alias("key"), F.col("key").alias("of"), F.col("root").alias("hash")), "subroots")
    top = build(subroots, ["of"], scratch)
    found = top.roots().first()
    nothing = F.array().cast(_PATH)
    ends = top.paths(subroots.limit(1).select("key", nothing.alias("path")), scratch)
    ends = scratch.save(ends.select(F.col("of").alias("key"), F.col("hash").alias("subroot"), "path"), "ends")
    return tree.paths(ends, scratch), found["root"].hex() if found else None


def tampered(text: Column) -> Column:
    """The text with A-Z in lower case and every other character as it is."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its leaf, roots, proof, and whether what is read again folds to the root."""
    scratch = Scratch(spark, "merkle")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    hit = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0, F.lit(False))
    again = leaf([tampered(F.col(c)) if c == "text" else F.col(c) for c in COLUMNS])
    leaves = docs.select(tree_key(F.col("lang")).alias("key"), F.col("doc_id").alias("id"), leaf([F.col(c) for c in COLUMNS]).alias("hash"), F.when(hit, again).alias("again"))
    # the texts are read and hashed once; all that follows carries digests
    out, root = manifest(scratch.save(leaves, "leaves"), scratch)
    hexed = lambda c: F.lower(F.hex(c))
    out = out.select(
        F.col("id").alias("doc_id"), hexed("hash").alias("leaf"), hexed("subroot").alias("subroot"), F.lit(root).cast("string").alias("root"),
        hexed(joined(proof(F.col("path")))).alias("proof_sha256"), hexed(folded(F.coalesce("again", "hash"), F.col("path"))).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(depth: int = 7, top: int = 3) -> str:
    """SQL for up to 8^depth rows of a key and 8^top keys: a level of the trees is a statement of its own."""
    told_ = ", ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in COLUMNS)
    # crc32 of a decimal id: eight shifts for each of its characters
    crc = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda a, x: xor(xor(a, x) >> 1, 3988292384::BIGINT * (xor(a, x) & 1))), 4294967295::BIGINT)"""
    out = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, sha256(concat({told_})) AS leaf, {crc} % 3 = 0 AS hit,
         sha256(concat({told_.replace("text::VARCHAR", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")})) AS again
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d
), a0 AS (SELECT lang, pos, leaf AS hash, count(*) OVER (PARTITION BY lang) AS n FROM leaves"""
    for i in range(depth):
        out += f"\n), a{i + 1} AS (SELECT lang, pos // 8 AS pos, sha256(string_agg(hash, '' ORDER BY pos)) AS hash, (any_value(n) + 7) // 8 AS n FROM a{i} WHERE n > 1 GROUP BY 1, pos // 8"
    roots = "\n  UNION ALL ".join(f"SELECT lang, hash FROM a{i} WHERE n = 1" for i in range(depth + 1))
    out += f"\n), subroots AS ({roots}\n), keys AS (SELECT lang, hash AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM subroots"
    out += "\n), b0 AS (SELECT place AS pos, subroot AS hash, count(*) OVER () AS n FROM keys"
    for i in range(top):
        out += f"\n), b{i + 1} AS (SELECT pos // 8 AS pos, sha256(string_agg(hash, '' ORDER BY pos)) AS hash, (any_value(n) + 7) // 8 AS n FROM b{i} WHERE n > 1 GROUP BY pos // 8"
    out += "\n), root AS (" + " UNION ALL ".join(f"SELECT hash AS root FROM b{i} WHERE n = 1" for i in range(top + 1))
    out += "\n), p0 AS (SELECT l.r, l.doc_id, l.leaf, l.lang, l.pos, k.subroot, k.place, '' AS proof, CASE WHEN hit THEN again ELSE leaf END AS h FROM leaves l JOIN keys k ON k.lang IS NOT DISTINCT FROM l.lang"
    step = 0
    for table, on, at, depth_ in (("a", "g.lang IS NOT DISTINCT FROM p.lang AND ", "pos", depth), ("b", "", "place", top)):
        for i in range(depth_):
            runs = f"SELECT {'lang, ' if table == 'a' else ''}pos // 8 AS run, list(hash ORDER BY pos) AS hs FROM {table}{i} WHERE n > 1 GROUP BY ALL"
            here = f"({at} // {8**i}) % 8"
            left, right = f"array_to_string(hs[1:{here}], '')", f"array_to_string(hs[{here} + 2:], '')"
            cols = f"CASE WHEN hs IS NULL THEN proof ELSE proof || {left} || {right} END AS proof, CASE WHEN hs IS NULL THEN h ELSE sha256({left} || h || {right}) END AS h"
            out += f"\n), p{step + 1} AS (SELECT r, doc_id, leaf, p.lang, pos, subroot, place, {cols} FROM p{step} p LEFT JOIN ({runs}) g ON {on}g.run = {at} // {8 ** (i + 1)}"
            step += 1
    return out + f"\n)\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified FROM p{step}, root"


SQL = _sql()
