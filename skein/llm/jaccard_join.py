"""N-gram Jaccard join by grouped prefixes, and its connected components.

A document's set is its distinct five-word shingles.  Documents with one set are
a class.  In one global order of shingles, rare ones first, two sets that link
share one of their first ``n - ceil(0.8 n) + 1`` shingles: the prefix.  Classes
with the same prefix and size are a group, and the join runs over groups:

1. A histogram of shingle hashes over a fixed number of cells gives the order.
   Any order is right; this one keeps frequent shingles out of prefixes.
2. Prefixes of groups become postings by shingle.  Size and position filters
   bound the overlap that a pair can still reach.
3. Of each posting list every member is verified with its neighbour by size and
   with the list's hub: the group whose prefix stands in the longest lists, which
   for a family of near copies is the text that they were made from.  The links
   make components.  Rounds follow over lists that still hold several components:
   members meet the hub, the best member outside its component, and a neighbour
   in a random order.  A family costs a few pairs for each member, not all pairs.
4. What is left are group pairs across components that share a shingle.  Their
   known overlap and their odd sketches bound the similarity from above; pairs
   that neither bound rules out are expanded to their members and verified.

An odd sketch holds for each of a fixed number of cells the parity of a set's
shingles in it.  Two sets differ in at least as many shingles as their sketches
in cells, so a pair that the sketch rules out is no link: near copies that do
not link are told apart before a text is read.  For sets of more than about a
thousand shingles the sketch rules out less, never too much.

Verification counts the intersection of the whole sets.  Comparing the sketches
of a list's unlinked members stays quadratic in their number (an exact join has
no other way for texts that are all just under the threshold); rows are made for
pairs that pass only.

Nulls, ties and edges: null text and text without words have an empty set,
linked with nothing; fewer than five words are one shingle; repeated rows share
a class; a row with a null doc_id takes the component of its class, or null where
only such rows hold that set; an empty table gives an empty result; columns beyond doc_id and text are
not read.  Shingles are compared by 64-bit hashes, sets and prefixes by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import sparing
from ..sources.scratch import Scratch
from .components import components
from .words import U64, mix, shingle_sets, utf8

#: Similarity: 100 * intersection >= PERCENT * union.
PERCENT = 80
SHINGLE = 5
#: Cells of the frequency histogram: what is sent to every executor, fixed.
CELL_BITS = 18
#: Rounds at most between the first and the last pass.
ROUNDS = 3
#: Rows (16 bytes and a long each) whose texts are looked up by a broadcast instead of a shuffle of all texts.
BROADCAST_ROWS = 500_000
#: Parts in which prefixes are shuffled, one after the other, so that a part of the exchange is on disk at a time.
SLICES = 4
#: 64-bit words of an odd sketch.
SKETCH = 16
_ROWS = 64


def frequencies(docs: DataFrame, k: int = SHINGLE) -> np.ndarray:
    """Documents that hold a shingle of each cell."""
    size = 1 << CELL_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                sets = list(shingle_sets(utf8(batch.column("text").slice(at, 500)), k))
                total += np.bincount((np.concatenate(sets) >> U64(64 - CELL_BITS)).astype(np.int64), minlength=size)
        parts = total.astype("<i4").reshape(_ROWS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(_ROWS), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["part", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_py(), "<i4").astype(np.int64) for b in table.column("counts"))
        return pa.table({"part": table.column("part").slice(0, 1), "counts": pa.array([np.minimum(total, 2**31 - 1).astype("<i4").tobytes()], pa.binary())})

    rows = docs.select("text").mapInArrow(sparing(run), "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary").collect()
    out = np.zeros((_ROWS, size // _ROWS), np.int64)
    for r in rows:
        out[r["part"]] = np.frombuffer(r["counts"], "<i4")
    return out.reshape(-1).astype(np.int32)


def set_hash(s: np.ndarray, salt: int = 0) -> bytes:
    """128 bits for a whole set."""
    with np.errstate(over="ignore"):
        total, turned = s.sum(dtype=U64), mix(s).sum(dtype=U64)
        both = np.array([total, turned], U64) * U64(0x9E3779B97F4A7C15) + U64(len(s)) + U64(salt)
        return mix(both ^ np.bitwise_xor.reduce(s, initial=0)).tobytes()


def odd_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the parities of its shingles in 64 * SKETCH cells, as SKETCH signed words."""
    cells = 64 * SKETCH
    at = np.concatenate([np.empty(0, np.int64), *[(s * U64(0xD6E8FEB86659FD93) >> U64(32)).astype(np.int64) % cells + i * cells for i, s in enumerate(sets)]])
    odd = np.bincount(at, minlength=len(sets) * cells) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8").reshape(len(sets), SKETCH)


def signatures(docs: DataFrame, counts: np.ndarray, percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """(doc_id, n, cid, gid, prefix, sketch): set size, class, group, the prefix in its order, and the odd sketch."""
    sent = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                n, cid, gid, prefix = [], [], [], []
                sets = list(shingle_sets(utf8(part.column("text")), k))
                for s in sets:
                    size = len(s)
                    n.append(size)
                    if not size:
                        cid.append(None), gid.append(None), prefix.append(np.empty(0, np.int64))
                        continue
                    most = size - -(-percent * size // 100) + 1
                    weight = freq[(s >> U64(64 - CELL_BITS)).astype(np.int64)]
                    low = s[np.lexsort((s, weight))[:most]]
                    cid.append(set_hash(s))
                    gid.append(set_hash(low, size))
                    prefix.append(low.astype(np.int64))
                bounds = np.concatenate(([0], np.cumsum([len(x) for x in prefix])))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(prefix)))
                sketches = pa.ListArray.from_arrays(pa.array(range(0, (len(sets) + 1) * SKETCH, SKETCH), pa.int32()), pa.array(odd_sketches(sets).reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(cid, pa.binary()), pa.array(gid, pa.binary()), lists, sketches], names=["doc_id", "n", "cid", "gid", "prefix", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sparing(run), "doc_id long, n long, cid binary, gid binary, prefix array<long>, sketch array<long>")


def _may_link(n1: str, p1: str, n2: str, p2: str, percent: int) -> str:
    """Sizes and places of a shared shingle that leave a link possible."""
    need = f"{percent} * ({n1} + {n2})"
    return f"100 * least({n1}, {n2}) >= {percent} * greatest({n1}, {n2}) AND {100 + percent} * (1 + least({n1} - 1 - {p1}, {n2} - 1 - {p2})) >= {need}"


def _close(s1: str, n1: str, s2: str, n2: str, percent: int) -> str:
    """Sketches that leave a link possible; true where one is null."""
    apart = " + ".join(f"bit_count({s1}[{i}] ^ {s2}[{i}])" for i in range(SKETCH))
    return f"coalesce({100 + percent} * ({apart}) <= {100 - percent} * ({n1} + {n2}), true)"


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, scratch: Scratch, percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """The pairs (a, b) of classes whose sets link, by their representatives' whole texts; ``hub_b``: b is in many pairs, else a may be.

    The text of a class in many pairs is brought in last, so that no shuffle carries a copy of it for each pair.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    wanted = scratch.save(wanted.join(classes.select("cid", "rep"), "cid"), "wanted")
    few = wanted.count() <= BROADCAST_ROWS
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(F.broadcast(wanted) if few else wanted, "rep").select("cid", "text")
    texts = scratch.save(texts, "texts")
    turned = pairs.select(F.when(F.col("hub_b"), F.col("b")).otherwise(F.col("a")).alias("u"), F.when(F.col("hub_b"), F.col("a")).otherwise(F.col("b")).alias("v"))
    both = turned.join(texts.select(F.col("cid").alias("v"), F.col("text").alias("tv")), "v").join(texts.select(F.col("cid").alias("u"), F.col("text").alias("tu")), "u").select("u", "v", "tu", "tv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ends = []
                for name in ("u", "v"):
                    ids, text = part.column(name).to_pylist(), part.column("t" + name)
                    # rows that repeat a doc_id may bring another text: a class is told by its set
                    texts = [t or b"" for t in utf8(text)]
                    own = dict(zip(list(dict.fromkeys(texts)), shingle_sets(list(dict.fromkeys(texts)), k), strict=True))
                    ends.append((ids, [own[t] for t in texts]))
                (u, su), (v, sv) = ends
                hashes = {id(s): set_hash(s) for s in (*su, *sv)}
                keep = []
                for x, y, a, b in zip(su, sv, u, v, strict=True):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * common >= percent * (len(x) + len(y) - common) and hashes[id(x)] == a and hashes[id(y)] == b)
                yield part.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    found = both.mapInArrow(sparing(run), "u binary, v binary").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    links = scratch.save(found, "links")
    for done in (wanted, texts):
        scratch.drop(done)
    scratch.tidy()
    return links


def place_classes(docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(sizes, classes): (doc_id, n, cid) of each row; (cid, rep, gid, n, root) of each class, root being its component."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    sigs = scratch.save(signatures(docs, frequencies(docs, k), percent, k), "signatures")
    own = scratch.save(sigs.drop("prefix"), "own")
    known = sigs.where("n > 0 AND doc_id IS NOT NULL")
    # a group's number is unique where a short hash may not be; a group of one class has that class's sketch
    groups = []
    for i in range(SLICES):
        some = known.where(_slice("gid") == i).groupBy(F.col("gid").alias("key")).agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.min("cid").alias("cid"), F.when(F.min("cid") == F.max("cid"), F.first("sketch")).alias("sketch"))
        groups.append(some.withColumn("gid", F.monotonically_increasing_id() * SLICES + i))
    groups = prefixed = scratch.save_all(groups, "prefixed")
    scratch.drop(sigs)
    scratch.tidy()
    known = own.where("n > 0 AND doc_id IS NOT NULL")
    classes = known.groupBy("cid").agg(F.min("doc_id").alias("rep"), F.first("gid").alias("key"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = scratch.save(classes.join(groups.select("key", "gid"), "key").drop("key"), "classes")
    slim = scratch.save(own.select("doc_id", "n", "cid"), "sizes")
    scratch.drop(own)
    # prefixes are read for the postings only
    groups = scratch.save(prefixed.select("gid", "n", "cid", "sketch"), "groups")
    shared = _postings(prefixed, scratch, percent)
    scratch.tidy()

    def class_pairs(found: DataFrame) -> DataFrame:
        """Pairs (a, b, hub_b) of classes, a < b, for pairs (hub, gid) of groups."""
        x, y = (groups.select(F.col("gid").alias(g), F.col("cid").alias(c), F.col("n").alias("n" + c), F.col("sketch").alias("s" + c)) for g, c in (("hub", "x"), ("gid", "y")))
        met = scratch.save(found.distinct(), "met")
        close = met.join(x, "hub").join(y, "gid").where(_close("sx", "nx", "sy", "ny", percent))
        return close.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max(F.expr("x > y")).alias("hub_b"))

    # first pass: hubs, neighbours, and classes of one group
    within = classes.select(F.lag("cid").over(Window.partitionBy("gid").orderBy("cid")).alias("a"), F.col("cid").alias("b")).where("a IS NOT NULL")
    pairs = class_pairs(_meetings(shared, None, percent)).unionByName(within.withColumn("hub_b", F.lit(False)))
    tried = scratch.save(pairs, "tried")
    links = verify(tried, classes, docs, scratch, percent, k)
    placed = _place(classes.select("cid", "rep", "gid", "n", F.col("cid").alias("root")), links, scratch, own=True)
    # a list whose members are one component stays so: later rounds read the lists that are still open
    open_ = scratch.save(_open(shared, placed), "open")
    scratch.drop(shared)
    for turn in range(ROUNDS):
        new = class_pairs(_meetings(open_, turn, percent))
        new = scratch.save(new.join(tried, ["a", "b"], "left_anti"), "new")
        if new.isEmpty():
            break
        found = verify(new, classes, docs, scratch, percent, k)
        tried = scratch.save(tried.unionByName(new), "tried")
        if found.isEmpty():
            break
        placed, was = _place(placed, found, scratch), open_
        open_ = scratch.save(_open(was.drop("r0", "r1"), placed), "open")
        scratch.drop(was)
    # last pass: group pairs across components
    open_ = open_.join(groups.select("gid", "sketch"), "gid")
    left, right = (open_.select("tok", *[F.col(c).alias(c + s) for c in ("gid", "n", "p", "r0", "r1", "sketch")]) for s in ("x", "y"))
    apart = F.expr("gidx < gidy AND NOT (r0x = r1x AND r0y = r1y AND r0x = r0y) AND " + _may_link("nx", "px", "ny", "py", percent) + " AND " + _close("sketchx", "nx", "sketchy", "ny", percent))
    crossing = left.join(right, (left["tok"] == right["tok"]) & apart).drop("tok")
    # shingles of a pair that pass come first among those it shares: up to the last of them the overlap is known
    crossing = crossing.groupBy("gidx", "gidy").agg(F.count(F.lit(1)).alias("c"), F.max("px").alias("px"), F.max("py").alias("py"), F.first("nx").alias("nx"), F.first("ny").alias("ny"))
    crossing = crossing.where(f"{100 + percent} * (c + least(nx - 1 - px, ny - 1 - py)) >= {percent} * (nx + ny)").select("gidx", "gidy")
    members = placed.join(classes.select("cid", "sketch"), "cid")
    x, y = (members.select(F.col("gid").alias("gid" + s), F.col("cid").alias(s), F.col("root").alias("r" + s), F.col("n").alias("n" + s), F.col("sketch").alias("s" + s)) for s in ("x", "y"))
    close = "rx <> ry AND " + _close("sx", "nx", "sy", "ny", percent)
    expanded = crossing.join(x, "gidx")
    expanded = expanded.join(y, (expanded["gidy"] == y["gidy"]) & F.expr(close)).select("x", "y")
    mixed = _spans(placed).where("r0 < r1").select(F.col("gid").alias("gidx")).join(x, "gidx")
    inner = mixed.join(y, (mixed["gidx"] == y["gidy"]) & F.expr("x < y AND " + close)).select("x", "y")
    rest = expanded.unionByName(inner).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit(False).alias("hub_b")).distinct()
    rest = scratch.save(rest.join(tried, ["a", "b"], "left_anti"), "rest")
    more = verify(rest, classes, docs, scratch, percent, k)
    return slim, _place(placed, more, scratch)


def _slice(key: str) -> Column:
    """The part, of SLICES, that a key belongs to; independent of the hash by which Spark deals it."""
    return F.pmod(F.xxhash64(key), F.lit(SLICES))


def _postings(groups: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """(tok, gid, n, p, weight) of the shingles that prefixes of two groups or more hold; weight: how long the lists of a group's prefix are.  ``groups`` is dropped."""
    postings = groups.select("gid", "n", F.posexplode("prefix").alias("p", "tok"))
    listed = [postings.where(_slice("tok") == i).withColumn("l", F.count(F.lit(1)).over(Window.partitionBy("tok"))).where("l > 1") for i in range(SLICES)]
    listed = scratch.save_all(listed, "lists")
    scratch.drop(groups)
    weight = listed.groupBy("gid").agg((F.sum("l") / F.expr(f"first(n) - ceil({percent} * first(n) / 100) + 1")).alias("weight"))
    shared = scratch.save(listed.join(weight, "gid").drop("l"), "postings")
    scratch.drop(listed)
    return shared


def _meetings(lists: DataFrame, turn: int | None, percent: int) -> DataFrame:
    """Pairs (hub, gid) of groups to try: a few for each posting.  Without a turn no component is known yet."""
    over = Window.partitionBy("tok")
    if turn is None:
        lists, order, second = lists.withColumns({"r0": F.col("gid"), "r1": F.col("gid")}), ("n", "gid"), None
    else:
        order, second = (F.xxhash64("gid", "tok", F.lit(turn)), "gid"), F.col("weight") if turn == 0 else F.xxhash64("gid", F.lit(turn))
    who = [F.col(c).alias(c) for c in ("gid", "n", "p", "r0", "r1")]
    met = lists.withColumns({"near": F.lag(F.struct(*who)).over(over.orderBy(*order)), "hub": F.max(F.struct(F.col("weight").alias("w"), *who)).over(over)})
    met = met.withColumns({"hub": F.col("hub").dropFields("w")})
    others = [F.col("hub"), F.col("near")]
    if second is not None:
        outside = F.expr("NOT (r0 = r1 AND hub.r0 = hub.r1 AND r0 = hub.r0)")
        met = met.withColumn("second", F.max(F.when(outside, F.struct(second.alias("w"), *who))).over(over)).withColumn("second", F.col("second").dropFields("w"))
        others.append(F.col("second"))
    met = met.select("gid", "n", "p", "r0", "r1", F.explode(F.array(*others)).alias("o")).where("o IS NOT NULL AND o.gid <> gid AND NOT (r0 = r1 AND o.r0 = o.r1 AND r0 = o.r0)")
    return met.where(_may_link("o.n", "o.p", "n", "p", percent)).select(F.col("o.gid").alias("hub"), "gid")


def _place(placed: DataFrame, links: DataFrame, scratch: Scratch, own: bool = False) -> DataFrame:
    """Classes with the components that further links (a, b) put them in; ``own``: so far each is its own component.

    Links are read as links between components, so that a round costs what it has found, not what is known.
    """
    if links.isEmpty():
        return placed
    if not own:
        roots = placed.select("cid", "root")
        links = links.join(roots.toDF("a", "ra"), "a").join(roots.toDF("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    moved = components(links, scratch).toDF("root", "to")
    return scratch.save(placed.join(moved, "root", "left").select("cid", "rep", "gid", "n", F.coalesce("to", "root").alias("root")), "placed")


def _spans(placed: DataFrame) -> DataFrame:
    """The smallest and largest component of each group's classes."""
    return placed.groupBy("gid").agg(F.min("root").alias("r0"), F.max("root").alias("r1"))


def _open(shared: DataFrame, placed: DataFrame) -> DataFrame:
    """Postings (tok, gid, n, p, weight, r0, r1) of the shingles that more than one component holds."""
    over = Window.partitionBy("tok")
    marked = shared.join(_spans(placed), "gid")
    return marked.withColumns({"t0": F.min("r0").over(over), "t1": F.max("r1").over(over)}).where("t0 < t1").drop("t0", "t1")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the smallest doc_id that links reach."""
    sigs, placed = place_classes(docs, percent, k)
    name = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    component = Scratch(docs.sparkSession, "components").save(placed.join(name, "root").select("cid", "component_id"), "named")
    return sigs.join(component, "cid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the size of its set and its component."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS k
  FROM (SELECT doc_id, words, unnest(range(1, greatest(1, len(words) - 4) + 1)) AS i FROM w WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id HAVING 100 * count(*) >= 80 * (any_value(nx.n) + any_value(ny.n) - count(*))
), reach AS (
  SELECT doc_id, doc_id AS r FROM w UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r
)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(r)::BIGINT AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN reach USING (doc_id) GROUP BY 1, 2
"""
