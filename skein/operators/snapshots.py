"""Versioned tables that are merged when they are read.

A table is made of parts, one for each source.  A commit adds to a part immutable
Parquet segments of new rows and delete files of keys, so it writes what changed and
nothing else; a read anti-joins the rows with the keys that later commits deleted.
Segments of one size class are merged into one when they are many.

What stands where is told by a pointer, a JSON file for each version, which is
written last.  A commit names the version it began from.  If others have committed
since, it is carried over to theirs as long as they wrote none of the parts that it
touches; else it fails and nothing changes.  Paths go through Spark's file systems,
so a store may be anywhere that Spark reads.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..schema import conform, schema

#: The column that tells the rows of each table apart.
KEYS = {
    "knowledge_tables": "table_id", "retrieval_profiles": "profile_id", "sources": "id", "source_files": "id", "sync_jobs": "id", "sync_runs": "id",
    "chunks": "chunk_id", "vectors": "chunk_id", "rebuilt_vectors": "chunk_id", "postings": "chunk_id", "chunk_lengths": "chunk_id", "vector_deletions": "chunk_id",
}
#: Tables whose segments are sorted, so that files and row groups that a search does not need are not read.
SORTED = {"postings": ("term", "chunk_id")}
#: The part of a table that was written as a whole.
WHOLE = "*"
#: Segments of a size class, or delete files, that are merged into one.
FAN_OUT = 8


class Conflict(RuntimeError):
    """The store has moved on since the version that a commit began from."""


@dataclass(frozen=True)
class Change:
    """Rows that a part of a table gets, and keys (a column of the key's name) whose rows so far go; ``whole`` drops all that the part held."""

    part: str
    add: DataFrame | None = None
    delete: DataFrame | None = None
    whole: bool = False


def merge_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: of rows with equal keys the new one stays."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def newest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Per key the row that is highest in ``order``; of equal ones the one with the largest hash of all columns."""
    by = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc(F.xxhash64(*rows.columns)))
    return rows.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def cascade(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent still stands."""
    return children.join(parents.select(F.col("id").alias(key)), key, "left_semi")


def _meet(a: str, b: str) -> bool:
    return a == b or WHOLE in (a, b)


class Store:
    """Tables of one catalog under a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- versions ---------------------------------------------------------

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _pointers(self) -> list[int]:
        if not self.fs.exists(self._path("versions")):
            return []
        return sorted(int(s.getPath().getName()) for s in self.fs.listStatus(self._path("versions")) if s.getPath().getName().isdigit())

    def version(self) -> int:
        """The number of the last commit; 0 before the first."""
        return max(self._pointers(), default=0)

    def state(self, version: int | None = None) -> dict:
        """What a version is made of: segments and delete files by table and part, when each part was written last, counters and sums."""
        now = self.version() if version is None else version
        if not now:
            return {"tables": {}, "revisions": {}, "counters": {}, "sums": {}, "notes": {}}
        # a few hundred bytes for each part: read on the driver, without a job
        held = self.fs.open(self._path(f"versions/{now}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(held, "UTF-8"))
        finally:
            held.close()

    def revision(self, name: str, part: str) -> int:
        """The version that wrote a part of a table last."""
        return max((v for p, v in self.state()["revisions"].get(name, {}).items() if _meet(p, part)), default=0)

    def _advance(self, base: int, touched: Iterable[tuple[str, str]], change, reads: Iterable[tuple[str, str]] = ()) -> int:
        """Write the next pointer, made from the current one by ``change``, unless another commit since ``base`` wrote what this one touches or rests on."""
        touched, reads = list(touched), list(reads)
        while True:
            now = self.version()
            state = self.state(now)
            for name, part in [*touched, *reads]:
                if any(_meet(p, part) and v > base for p, v in state["revisions"].get(name, {}).items()):
                    raise Conflict(f"{name}, {part}: written since version {base}")
            change(state)
            for name, part in touched:
                state["revisions"].setdefault(name, {})[part] = now + 1
            try:
                # creating the file fails if another commit took its number
                out = self.fs.create(self._path(f"versions/{now + 1}"), False)
            except Exception:
                if self.version() > now:
                    continue
                raise
            out.write(bytearray(json.dumps(state).encode()))
            out.close()
            return now + 1

    # -- reading ----------------------------------------------------------

    def read(self, name: str, part: str | None = None, version: int | None = None) -> DataFrame:
        """A table's rows, or those of a part (and of what was written as a whole)."""
        parts = self.state(version)["tables"].get(name, {})
        if part is not None:
            parts = {p: x for p, x in parts.items() if _meet(p, part)}
        return self._merged(name, [r[0] for x in parts.values() for r in x["rows"]], [d for x in parts.values() for d in x["deletes"]])

    def _merged(self, name: str, rows: list[str], deletes: list[str]) -> DataFrame:
        if not rows:
            return self.spark.createDataFrame([], schema(name))
        key, columns = KEYS[name], [f.name for f in schema(name)]
        out = self.spark.read.schema(T.StructType([*schema(name), T.StructField("_seq", T.LongType())])).parquet(*[f"{self.root}/{r}" for r in rows])
        if deletes:
            gone = self._deletes(name, deletes).groupBy(F.col(key).alias("_key")).agg(F.max("_seq").alias("_gone"))
            out = out.join(gone, (out[key] == gone["_key"]) & (out["_seq"] < gone["_gone"]), "left_anti")
        return out.select(*columns)

    def _deletes(self, name: str, paths: list[str]) -> DataFrame:
        key = KEYS[name]
        return self.spark.read.schema(T.StructType([schema(name)[key], T.StructField("_seq", T.LongType())])).parquet(*[f"{self.root}/{d}" for d in paths])

    # -- writing ----------------------------------------------------------

    def _write(self, name: str, rows: DataFrame, kind: str) -> list:
        """[path, rows] of a new segment or delete file."""
        path, seen = f"data/{name}/{kind}-{uuid.uuid4().hex}", Observation()
        writer = rows.observe(seen, F.count(F.lit(1)).alias("n")).write
        if name in SORTED:
            writer = writer.option(f"parquet.bloom.filter.enabled#{SORTED[name][0]}", "true")
        writer.parquet(f"{self.root}/{path}")
        return [path, int(seen.get.get("n", 0))]

    def _segment(self, name: str, rows: DataFrame, seq: int) -> list:
        rows = conform(rows, name)
        if name in SORTED:
            rows = rows.repartitionByRange(*SORTED[name]).sortWithinPartitions(*SORTED[name])
        return self._write(name, rows.withColumn("_seq", F.lit(seq).cast("long")), "rows")

    def commit(self, changed: dict[str, DataFrame | Change | list[Change]], base: int, sums: dict[str, dict[str, float]] | None = None, notes: dict | None = None) -> int:
        """Write changes (a DataFrame is a whole table), then the pointer; ``sums`` are added to the version's own, ``notes`` are set in it."""
        made: list[tuple[str, Change, list | None, list | None]] = []
        for name, some in changed.items():
            for c in some if isinstance(some, list) else [some if isinstance(some, Change) else Change(WHOLE, some, whole=True)]:
                # rows of this commit are younger than its deletes
                add = self._segment(name, c.add, base + 1) if c.add is not None else None
                gone = self._write(name, c.delete.select(F.col(KEYS[name]).cast(schema(name)[KEYS[name]].dataType)).withColumn("_seq", F.lit(base + 1).cast("long")), "gone") if c.delete is not None else None
                made.append((name, c, add, gone))

        def change(state: dict) -> None:
            for name, c, add, gone in made:
                table = state["tables"].setdefault(name, {})
                if c.whole:
                    for p in [p for p in table if _meet(p, c.part)] if c.part == WHOLE else [c.part]:
                        table.pop(p, None)
                part = table.setdefault(c.part, {"rows": [], "deletes": []})
                if add and add[1]:
                    part["rows"].append(add)
                if gone and gone[1]:
                    part["deletes"].append(gone[0])
            for group, values in (sums or {}).items():
                own = state["sums"].setdefault(group, {})
                for k, v in values.items():
                    own[k] = own.get(k, 0) + v
            state["notes"].update(notes or {})

        return self._advance(base, {(name, c.part): None for name, c, _, _ in made}, change)

    def take_place(self, name: str, by: str, base: int, reads: Iterable[str] = (), notes: dict | None = None) -> int:
        """Table ``name`` becomes what table ``by`` holds, by the pointer alone, as long as neither they nor the tables it rests on were written since ``base``."""

        def change(state: dict) -> None:
            held = state["tables"].pop(by, {}).values()
            state["tables"][name] = {WHOLE: {k: [x for p in held for x in p[k]] for k in ("rows", "deletes")}}
            state["notes"].update(notes or {})

        return self._advance(base, [(name, WHOLE), (by, WHOLE)], change, [(r, WHOLE) for r in reads])

    def reserve(self, name: str, n: int) -> int:
        """The first of ``n`` ids of a table that nobody gets again, whatever becomes of them."""
        first = self.read(name).agg(F.coalesce(F.max(KEYS[name]), F.lit(0))).first()[0] + 1 if name not in self.state()["counters"] else 0
        got: list[int] = []

        def change(state: dict) -> None:
            got[:] = [max(first, state["counters"].get(name, 1))]
            state["counters"][name] = got[0] + n

        self._advance(self.version(), [], change)
        return got[0]

    # -- upkeep -----------------------------------------------------------

    def compact(self, name: str, part: str) -> bool:
        """Merge the segments of a full size class of a part, and its delete files where they are many; whether there was any."""
        base = self.version()
        state = self.state(base)
        table = state["tables"].get(name, {})
        own = table.get(part, {"rows": [], "deletes": []})
        by: dict[int, list] = {}
        for r in own["rows"]:
            by.setdefault(int(math.log(max(1, r[1]), FAN_OUT)), []).append(r)
        full = next((rows for _, rows in sorted(by.items()) if len(rows) >= FAN_OUT), [])
        alone = len(full) == len(own["rows"]) and (part == WHOLE or WHOLE not in table)
        if not full and len(own["deletes"]) < FAN_OUT:
            return False
        merged = self._segment(name, self._merged(name, [r[0] for r in full], own["deletes"]), base + 1) if full else None
        # keys still count for the segments that stay
        kept = [] if alone and full else own["deletes"]
        if len(kept) >= FAN_OUT:
            key = KEYS[name]
            kept = [self._write(name, self._deletes(name, kept).groupBy(key).agg(F.max("_seq").alias("_seq")), "gone")[0]]

        def change(state: dict) -> None:
            rows = [r for r in own["rows"] if r not in full]
            state["tables"][name][part] = {"rows": rows + ([merged] if merged and merged[1] else []), "deletes": kept}

        self._advance(base, [(name, part)], change)
        return True

    def expire(self, keep: int = 2) -> int:
        """Delete pointers but the last ``keep``, and the files that only they name; returns how many files went."""
        versions = self._pointers()
        files = lambda v: {f for t in self.state(v)["tables"].values() for p in t.values() for f in [*[r[0] for r in p["rows"]], *p["deletes"]]}
        held = set().union(*[files(v) for v in versions[-keep:]])
        old = versions[:-keep]
        gone = set().union(*[files(v) for v in old]) - held
        for name in [*gone, *[f"versions/{v}" for v in old]]:
            self.fs.delete(self._path(name), True)
        return len(gone)
