"""Text files: folders walked by tasks, contents hashed and read by tasks.

A walk expands a frontier of folders: each task lists its folders and those below
them until it has seen enough entries, and hands back the folders that it did not
get to as the next round's frontier.  Nothing is listed on the driver, and a folder
that the scope excludes as a whole is not entered.  Files are hashed in blocks, so
that a large one needs no more memory than a block, and are read only where they are
to be indexed.  A file that is not the one that was listed is refused.  The file system
is one that all machines mount.
"""

from __future__ import annotations

import codecs
import hashlib
import os
import re
import stat
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.globs import EXCLUDE, HARD_EXCLUDED, glob_regex
from .scratch import Scratch

_SCAN = "source_id string, root string, relative_path string, mtime_ns long, size long, dev long, ino long"
_COLUMNS = [c.split()[0] for c in _SCAN.split(", ")]
#: Entries that a task lists before it hands its other folders back.
ENTRIES = 20_000
#: Bytes of a block, and of contents that a task holds at once besides one file.
BLOCK, HELD = 1 << 20, 16 << 20


def safe_root(root: str) -> bool:
    """An existing directory by its own canonical name, not a link, with no hard-excluded part."""
    return why_unsafe(root) is None


def why_unsafe(root: str) -> str | None:
    """Why a root may not be a source's; null where it may."""
    try:
        info = os.lstat(root)
    except OSError:
        return "root does not exist or can't be read"
    if stat.S_ISLNK(info.st_mode):
        return "root is a link"
    if not stat.S_ISDIR(info.st_mode):
        return "root is not a directory"
    if os.path.realpath(root) != os.path.abspath(root):
        return "root is reached through a link"
    if not {p.lower() for p in Path(root).parts}.isdisjoint(HARD_EXCLUDED):
        return "root stands in a directory that is never indexed"
    return None


def root_identity(root: str) -> str | None:
    """Device and number of a root folder: another one by the same name has another identity."""
    try:
        info = os.lstat(root)
    except OSError:
        return None
    return f"{info.st_dev}:{info.st_ino}"


def pruned(exclude: Sequence[str]) -> str:
    """A regex for ``folder + "/"`` of the folders that a pattern excludes with everything below; it matches nothing where there is none."""
    return "|".join(f"(?:{glob_regex(p.removesuffix('/**'))})" for p in exclude if p.endswith("/**") and p != "**/.*/**") or r"(?!)"


def scan(spark: SparkSession, source_id: str, root: str, exclude: Sequence[str] | None = None, entries: int = ENTRIES) -> DataFrame:
    """Regular files under a root; links, hidden, hard-excluded and excluded directories are not entered.  Any error ends the scan: a partial list would look like deletions."""
    prune = pruned(EXCLUDE if exclude is None else exclude)

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        skip = re.compile(prune)
        open_ = [folder for frame in frames for folder in frame["folder"]]
        seen, rows = 0, []
        while open_ and seen < entries:
            folder = open_.pop()
            with os.scandir(os.path.join(root, folder)) as found:
                for e in found:
                    seen += 1
                    info = e.stat(follow_symlinks=False)
                    path = f"{folder}/{e.name}".lstrip("/")
                    if e.name.startswith(".") or e.name.lower() in HARD_EXCLUDED:
                        continue
                    if stat.S_ISDIR(info.st_mode):
                        if not skip.search(path + "/"):
                            open_.append(path)
                    elif stat.S_ISREG(info.st_mode):
                        rows.append((source_id, root, path, info.st_mtime_ns, info.st_size, info.st_dev, info.st_ino, False))
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=[*_COLUMNS, "folder"])
                        rows = []
        rows += [(source_id, root, folder, None, None, None, None, True) for folder in open_]
        if rows:
            yield pd.DataFrame(rows, columns=[*_COLUMNS, "folder"]).astype({c: "Int64" for c in _COLUMNS[3:]})

    scratch = Scratch(spark, "walk")
    frontier, found = spark.createDataFrame([("",)], "folder string"), None
    while True:
        made = scratch.save(frontier.mapInPandas(walk, _SCAN + ", folder boolean"), "round")
        files = made.where("NOT folder").drop("folder")
        found = files if found is None else found.unionByName(files)
        left = made.where("folder").select(F.col("relative_path").alias("folder"))
        if left.isEmpty():
            return found
        # the folders that are left are dealt out to all tasks
        frontier = left.repartition(spark.sparkContext.defaultParallelism, "folder")


@contextmanager
def _opened(row):
    """(file, error) of a listed file: it must be the one that was listed, no link, before and after it is read."""
    same = lambda i: (i.st_mtime_ns, i.st_size, i.st_dev, i.st_ino) == (row.mtime_ns, row.size, row.dev, row.ino)
    told = {"error": ""}
    try:
        fd = os.open(os.path.join(row.root, row.relative_path), os.O_RDONLY | os.O_NOFOLLOW)
    except OSError as e:
        told["error"] = type(e).__name__
        yield None, told
        return
    with os.fdopen(fd, "rb") as f:
        if not same(os.fstat(fd)):
            told["error"] = "changed since the scan"
            yield None, told
            return
        yield f, told
        if not same(os.fstat(fd)):
            told["error"] = "changed while it was read"


def digests(listed: DataFrame) -> DataFrame:
    """(source_id, relative_path, sha256, error) of listed files, read a block at a time; the error tells bytes that are not UTF-8, too."""

    def one(row) -> tuple[str | None, str]:
        total, text, error = hashlib.sha256(), codecs.getincrementaldecoder("utf-8")(), ""
        with _opened(row) as (f, told):
            while f is not None and (block := f.read(BLOCK)):
                total.update(block)
                try:
                    text.decode(block)
                except UnicodeDecodeError:
                    error, text = "not UTF-8", codecs.getincrementaldecoder("latin-1")()
            try:
                text.decode(b"", True)
            except UnicodeDecodeError:
                error = "not UTF-8"
        return (None, told["error"]) if told["error"] else (total.hexdigest(), error)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [one(r) for r in frame.itertuples(index=False)]
            yield frame[["source_id", "relative_path"]].assign(sha256=[d for d, _ in got], error=[e for _, e in got])

    return listed.select(*_COLUMNS).mapInPandas(run, "source_id string, relative_path string, sha256 string, error string")


def read(listed: DataFrame) -> DataFrame:
    """``listed`` with sha256, content and error: bytes are decoded strictly, and one bad file harms no other."""

    def one(row) -> tuple[str | None, str | None, str]:
        with _opened(row) as (f, told):
            data = f.read() if f is not None else b""
        if told["error"]:
            return None, None, told["error"]
        digest = hashlib.sha256(data).hexdigest()
        try:
            return digest, data.decode("utf-8"), ""
        except UnicodeDecodeError:
            return digest, None, "not UTF-8"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows, held = [], 0
            for r in frame.itertuples(index=False):
                rows.append((r.source_id, r.relative_path, r.mtime_ns, r.size, *one(r)))
                held += r.size
                if held >= HELD:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names)

    out = "source_id string, relative_path string, mtime_ns long, size long, sha256 string, content string, error string"
    names = [c.split()[0] for c in out.split(", ")]
    return listed.select(*_COLUMNS).mapInPandas(run, out)
