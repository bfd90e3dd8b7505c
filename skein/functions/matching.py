"""Kernels over Arrow columns: phrases in rows of terms, and the best rows of many queries at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Phrases:
    """Different phrases (runs of terms) as a trie: nodes are numbered, a step goes by node and term."""

    def __init__(self, phrases: Sequence[Sequence[str]]):
        known = sorted({t for p in phrases for t in p})
        code = {t: i for i, t in enumerate(known)}
        self.terms, self.width = pa.array(known, pa.string()), max(1, len(known))
        nodes: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for i, p in enumerate(phrases):
            at = 0
            for t in p:
                at = nodes.setdefault((at, code[t]), len(nodes) + 1)
            ends[at] = i
        steps = sorted((a * self.width + c, to) for (a, c), to in nodes.items())
        self.keys, self.to = (np.array([s[j] for s in steps], np.int64) for j in (0, 1))
        self.ends = np.full(len(nodes) + 1, -1, np.int64)
        self.ends[list(ends)] = list(ends.values())
        self.inner = np.zeros(len(nodes) + 1, bool)
        self.inner[[a for a, _ in nodes]] = True

    def find(self, column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and phrases, one for each place where a phrase stands whole in a row's terms."""
        values = column.flatten()
        code = pc.fill_null(pc.index_in(values, value_set=self.terms.cast(values.type)), -1).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(column)), pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False))
        place = np.flatnonzero(code >= 0)
        node, start = np.zeros(len(place), np.int64), row[place]
        rows, found = [start[:0]], [node[:0]]
        while len(place):
            key = node * self.width + code[place]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[i] == key
            node, start, place = self.to[i[there]], start[there], place[there] + 1
            whole = self.ends[node] >= 0
            rows.append(start[whole])
            found.append(self.ends[node[whole]])
            on = self.inner[node] & (place < len(code))
            node, start, place = node[on], start[on], place[on]
            on = (row[place] == start) & (code[place] >= 0)
            node, start, place = node[on], start[on], place[on]
        return np.concatenate(rows), np.concatenate(found)


class Best:
    """Of each of ``n`` queries the ``k`` lowest scores, equal ones by key.

    Scores that lie above the k-th by no more than ``margin`` stay too, as rounding
    may bring them level; of rows with one score k stay at most, so what is held is
    bounded also where very many rows are equal.
    """

    def __init__(self, k: int, n: int, margin: float = 0.0):
        self.k, self.margin = k, margin
        #: The k-th score of each query so far.
        self.most = np.full(n, np.inf)
        self.kept: list[list[tuple[float, str]]] = [[] for _ in range(n)]

    def bounds(self, scores: np.ndarray, queries: np.ndarray | None = None) -> np.ndarray:
        """For scores (rows × queries, all or those named) the most that a query's k-th can be, by what is kept and by these rows."""
        most = self.most.copy() if queries is None else self.most[queries]
        if len(scores) > self.k:
            some = np.flatnonzero(np.isinf(most))
            if len(some):
                most[some] = np.partition(np.nan_to_num(scores[:, some], nan=np.inf, posinf=np.inf, neginf=-np.inf), self.k - 1, axis=0)[self.k - 1]
        return most

    def add(self, queries: np.ndarray, scores: np.ndarray, keys: pa.Array, rows: np.ndarray) -> None:
        """Candidates: their query, score and row in ``keys``."""
        if not len(queries):
            return
        order = np.argsort(queries, kind="stable")
        queries, scores, names = queries[order], scores[order].tolist(), keys.take(pa.array(rows[order])).to_pylist()
        starts = np.flatnonzero(np.r_[True, queries[1:] != queries[:-1]]).tolist()
        for a, b in zip(starts, [*starts[1:], len(queries)], strict=True):
            q = int(queries[a])
            self.kept[q] = self._cut(self.kept[q] + list(zip(scores[a:b], names[a:b], strict=True)))
            if len(self.kept[q]) >= self.k:
                last = self.kept[q][self.k - 1][0]
                self.most[q] = last if last == last else np.inf

    def _cut(self, some: list[tuple[float, str]]) -> list[tuple[float, str]]:
        # what is no number comes last, as in SQL
        some.sort(key=lambda x: (x[0] != x[0], x[0] if x[0] == x[0] else 0.0, x[1]))
        out, same = [], 0
        for i, x in enumerate(some):
            if i >= self.k and not x[0] <= some[self.k - 1][0] + self.margin:
                break
            same = same + 1 if i and x[0] == some[i - 1][0] else 1
            if same <= self.k:
                out.append(x)
        return out

    def rows(self, ids: pa.Array, names: Sequence[str]) -> pa.RecordBatch:
        """(query id, key, score) of all that is kept; ``ids`` are the queries' own."""
        n = [len(x) for x in self.kept]
        told = [x for some in self.kept for x in some]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array([x[1] for x in told], pa.string()), pa.array([x[0] for x in told], pa.float64())], names=list(names))
