"""Search: request checks, authorization, degradation and the result's shape.

Everything over chunks is one lazy plan; the driver sees the sources table and
at most ``candidates`` rows, before the reranker is called.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexing import phrases
from ..operators import access, fusion, lexical, vectors
from ..operators.snapshots import Store
from ..sources.scratch import Scratch

MAX_TOP_K = 20
#: Candidates of each stage that diagnostics show.
SHOWN = 10
Embed = Callable[[list[str]], list[list[float]]]
Rerank = Callable[[str, list[str]], list[tuple[int, float]]]


@dataclass(frozen=True)
class Settings:
    vector_recall: int = 40
    keyword_recall: int = 20
    candidates: int = 20
    per_file: int = 2

    @classmethod
    def of_candidates(cls, limit: int) -> Settings:
        """The limits that one ``candidate_limit`` stands for: four times as many vectors, itself elsewhere."""
        return cls(vector_recall=4 * limit, keyword_recall=limit, candidates=limit)


@dataclass
class Result:
    status: str
    query: str
    rows: list[dict] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    #: Candidates of each stage, milliseconds of each step, and the settings; for those who ask.
    diagnostics: dict = field(default_factory=lambda: {"stages": {}, "milliseconds": {}, "settings": {}})

    @contextmanager
    def timed(self, step: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.diagnostics["milliseconds"][step] = round(1000 * (time.perf_counter() - began), 1)

    def show(self, stage: str, rows: list[dict], score: str) -> None:
        """The first candidates of a stage, in its order."""
        self.diagnostics["stages"][stage] = [{"rank": i + 1, "chunk_id": r["chunk_id"], "score": r[score]} for i, r in enumerate(rows[:SHOWN])]


def recall(allowed: DataFrame, words: DataFrame, near: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ranked keyword and vector channels: limits apply before, ranks after the authorization filter."""
    ids = allowed.select("chunk_id")
    return fusion.ranked(words.join(ids, "chunk_id", "left_semi"), "fts"), fusion.ranked(near.join(ids, "chunk_id", "left_semi"), "vector")


class Searcher:
    """Hybrid search over the tables that ``load`` returns by name; it is called again where a fresh state counts.

    ``index`` gives the lexical index of the chunks.  Without it one is built from
    the chunks and kept until they change; :meth:`over` a store reads the one that
    the store's commits keep.
    """

    def __init__(self, load: Callable[[str], DataFrame], consent: str, space: str, embed: Embed, rerank: Rerank, settings: Settings = Settings(), tables: tuple[str, ...] = ("text",), index: Callable[[], lexical.Index] | None = None):
        self.load, self.consent, self.space, self.embed, self.rerank, self.settings, self.tables = load, consent, space, embed, rerank, settings, tables
        self.index = index or self._built
        self._indexed: tuple[tuple, Scratch, lexical.Index] | None = None

    @classmethod
    def over(cls, store: Store, consent: str, space: str, embed: Embed, rerank: Rerank, settings: Settings = Settings()) -> Searcher:
        """Search what plans.ingest has committed to a store."""
        from .ingest import with_roots

        load = lambda name: with_roots(store.read(name)) if name == "sources" else store.read(name)
        return cls(load, consent, space, embed, rerank, settings, index=lambda: lexical.stored(store))

    def _policy(self) -> list[tuple]:
        """What a search's permission rests on, for each source: flags, consent, scope and the identity of its root."""
        s = access.eligibility(self.load("sources"), self.consent)
        scope = [F.coalesce(F.array_join(c, "\n"), F.lit("-")).alias(c) for c in ("include_patterns", "exclude_patterns")]
        root = F.coalesce("root_identity", F.lit("-")) if "root_identity" in s.columns else F.lit("-")
        return sorted(tuple(r) for r in s.select("id", "enabled", F.coalesce("consent_identity", F.lit("-")), "scope_cleanup_pending", F.coalesce("why_not", F.lit("")), *scope, root.alias("root")).collect())

    def search(self, query: str, top_k: int = 5, table_ids: list[str] | None = None, source_ids: list[str] | None = None) -> Result:
        out = Result("invalid_request", query)
        if not query.strip():
            out.warnings.append("query must not be empty")
        elif isinstance(top_k, bool) or not isinstance(top_k, int) or not 1 <= top_k <= MAX_TOP_K:
            out.warnings.append(f"top_k must be between 1 and {MAX_TOP_K}")
        elif strange := sorted(set(table_ids or ()) - set(self.tables)):
            out.warnings.append("unknown table_ids: " + ", ".join(strange))
        else:
            return self._run(query, top_k, source_ids)
        return out

    def _run(self, query: str, top_k: int, source_ids: list[str] | None) -> Result:
        try:
            policy = self._policy()
        except Exception as e:
            return Result("unavailable", query, warnings=[f"catalog unavailable: {type(e).__name__}"])
        why = {p[0]: p[4] for p in policy}
        asked = list(dict.fromkeys(source_ids or ()))
        if strange := sorted(set(asked) - set(why)):
            return Result("invalid_request", query, warnings=["unknown source_ids: " + ", ".join(strange)])
        if shut := sorted(i for i in asked if why[i] == "disabled"):
            return Result("invalid_request", query, warnings=["requested source_ids are disabled: " + ", ".join(shut)])
        pool = asked or [i for i in why if why[i] != "disabled"]
        stale = sorted(i for i in pool if why[i])
        if asked and stale:
            return Result("consent_required", query, warnings=["one or more requested sources require renewed provider consent or scope cleanup"])
        if pool and len(stale) == len(pool):
            return Result("consent_required", query, warnings=["all enabled sources require renewed provider consent or scope cleanup"])
        out = Result("no_results", query)
        if stale:
            out.warnings.append("some enabled sources were skipped because provider consent is stale or scope cleanup is pending: " + ", ".join(stale))
        use = [i for i in pool if not why[i]]
        if not use:
            return out
        sources = self.load("sources").where(F.col("id").isin(use))
        allowed = access.authorized(access.active_chunks(self.load("chunks"), self.load("source_files"), sources), sources)
        out.diagnostics["settings"] = asdict(self.settings) | {"top_k": top_k, "sources": use, "space": self.space}
        fused = self._fused(query, sources, allowed, use, out)
        hydrated = fused.where(F.col("rrf_rank") <= self.settings.candidates).join(allowed, "chunk_id")
        with out.timed("recall and fusion"):
            rows = [r.asDict() for r in hydrated.orderBy("rrf_rank").limit(self.settings.candidates).collect()]
        for channel in ("fts", "vector"):
            out.diagnostics["stages"].setdefault(channel, [])
        out.show("fusion", rows, "rrf_score")
        if not rows:
            return out
        with out.timed("policy"):
            try:
                now = self._policy()
            except Exception as e:
                out.warnings.append(f"authorization policy recheck unavailable: {type(e).__name__}")
                return out
        if now != policy:
            out.warnings.append("authorization policy changed during search")
            return out
        with out.timed("rerank"):
            ordered = self._reranked(query, rows, out)
        out.show("rerank", ordered, "score")
        out.rows = self._select(ordered, top_k)
        out.show("final", out.rows, "score")
        out.status = "ok" if out.rows else "no_results"
        return out

    def _built(self) -> lexical.Index:
        """An index of the chunks, written again when their table has changed; the one before is deleted."""
        chunks = self.load("chunks")
        key = chunks.semanticHash(), tuple(sorted(chunks.inputFiles()))
        if self._indexed is None or self._indexed[0] != key:
            if self._indexed is not None:
                self._indexed[1].clear()
            scratch = Scratch(chunks.sparkSession, "index")
            self._indexed = key, scratch, lexical.build(chunks, scratch)
        return self._indexed[2]

    def _fused(self, query: str, sources: DataFrame, allowed: DataFrame, use: list[str], out: Result) -> DataFrame:
        index = self.index()
        live = access.active_chunks(self.load("chunks"), self.load("source_files"), sources).select("chunk_id")
        words = lexical.top(lexical.bm25(index, phrases(query)).join(live, "chunk_id", "left_semi"), self.settings.keyword_recall)
        with out.timed("keyword"):
            found = words.collect()  # at most keyword_recall rows
        words = words.sparkSession.createDataFrame(found, words.schema)
        near = words.where(F.lit(False))
        try:
            with out.timed("embedding"):
                at = self.embed([query])[0]
        except Exception as e:
            out.warnings.append(f"vector recall unavailable: {type(e).__name__}")
        else:
            with out.timed("vector"):
                near = self._near(at, use, out) or near
        channels = recall(allowed, words, near)
        # at most keyword_recall and vector_recall rows
        both = channels[0].unionByName(channels[1]).orderBy("channel", "rank").collect()
        for name in ("fts", "vector"):
            out.show(name, [r.asDict() for r in both if r["channel"] == name], "score")
        return fusion.rrf([words.sparkSession.createDataFrame(both, channels[0].schema)])

    def _near(self, at: list[float], use: list[str], out: Result) -> DataFrame | None:
        """Vector recall; a failing read is tried once more on a fresh table."""
        for last in (False, True):
            try:
                rows = vectors.nearest(self.load("vectors"), at, self.settings.vector_recall, space=self.space, source_ids=use)
                found = rows.collect()  # at most vector_recall rows
            except Exception as e:
                if last:
                    out.warnings.append(f"vector recall unavailable after one retry: {type(e).__name__}")
            else:
                if last:
                    out.warnings.append("vector recall recovered after reopening the backend")
                return rows.sparkSession.createDataFrame(found, rows.schema)
        return None

    def _reranked(self, query: str, rows: list[dict], out: Result) -> list[dict]:
        """Candidates in the reranker's order, then the rest in fusion order."""
        from ..sources.providers import rerank_document

        try:
            told = self.rerank(query, [rerank_document(r) for r in rows])
        except Exception as e:
            out.warnings.append(f"rerank unavailable: {type(e).__name__}")
            return [r | {"score": r["rrf_score"]} for r in rows]
        order: dict[int, float] = {}
        for i, score in told:
            if 0 <= i < len(rows):
                order.setdefault(i, score)
        if not order:
            out.warnings.append("reranker returned no valid result indexes; using RRF")
        first = [rows[i] | {"score": s} for i, s in order.items()]
        return first + [r | {"score": r["rrf_score"]} for i, r in enumerate(rows) if i not in order]

    def _select(self, rows: list[dict], top_k: int) -> list[dict]:
        seen: dict[tuple, int] = {}
        out = []
        for r in rows:
            key = (r["source_id"], r["relative_path"])
            seen[key] = seen.get(key, 0) + 1
            if seen[key] <= self.settings.per_file and len(out) < top_k:
                out.append({"source": f"{r['source_id']}/{r['relative_path']}", "heading_path": r["heading_path"], "text": r["text"], "start_line": r.get("start_line"), "end_line": r.get("end_line"), "score": r["score"], "chunk_id": r["chunk_id"]})
        return out


def as_groups(result: Result, table: str = "text") -> dict:
    """The public shape of a result; closed to other fields."""
    rows = [{k: v for k, v in r.items() if k != "chunk_id" and v is not None} for r in result.rows]
    return {"status": result.status, "query": result.query, "groups": [{"table": table, "results": rows}] if rows else [], "warnings": result.warnings}
