"""SentencePiece encoding and decoding by suffix-array matching.

A batch of texts is normalised by the model and cut where no piece can cross (a
space mark after another character).  The distinct cuts are concatenated and
indexed by a suffix array over code points.  Every piece of the vocabulary is
binary-searched in it; its occurrence range gives edges (position, length,
piece).  Edges are dealt by position, and then relaxed: for a unigram model the
best path to every position; for a BPE model the adjacent pair with the best
edge is merged, leftmost first, until no edge spans a pair.  Characters without
a piece become their UTF-8 byte pieces.

Nulls, ties and edges: a null text has null ids; an empty one has none; repeated
rows and a null doc_id get a result row each; equal scores go to the leftmost
pair; a cut of any length is handled (very long ones by a heap, not in rounds);
memory holds one batch of about ``CHUNK_CHARS`` characters; other columns pass
through; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import sparing

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
CHUNK_CHARS = 4 << 20
#: Cuts over so many characters are merged with a heap.
LONG = 96
#: Distinct cuts whose ids a worker remembers.
REMEMBERED = 500_000
NONE = np.int32(np.iinfo(np.int32).max)


class Codec:
    """Encoder and decoder of one model.  ``kind`` is bpe or unigram."""

    def __init__(self, path: str = MODEL, kind: str = "bpe"):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.kind = kind
        size = m.vocab_size()
        plain = [i for i in range(size) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        text = {i: m.id_to_piece(i) for i in plain}
        if any(MARK in p.lstrip(MARK) for p in text.values()):
            raise ValueError("a piece crosses a space mark")
        # line ends too, where no piece holds one
        gap = MARK + "\n" * all("\n" not in p for p in text.values())
        self.cuts = re.compile(f"{MARK}*[^{gap}]+|{MARK}+|\n").findall
        self.bytes_id = np.array([m.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        self.unknown = m.unk_id()
        self.fallback = not (self.bytes_id == self.unknown).any()
        self.surface = [b""] * size
        for b, i in enumerate(self.bytes_id):
            if self.fallback:
                self.surface[i] = bytes([b])
        for i, p in text.items():
            self.surface[i] = p.replace(MARK, " ").encode()
        if not self.fallback:
            self.surface[self.unknown] = b" \xe2\x81\x87 "
        self.surface_size = np.array([len(x) for x in self.surface])
        self.surface_at = np.cumsum(self.surface_size) - self.surface_size
        self.surface_bytes = np.frombuffer(b"".join(self.surface), dtype=np.uint8)
        # the alphabet of the pieces: 1, 2, ...; 0 ends a cut; one more for any other character
        letters = sorted({c for p in text.values() for c in p})
        self.code = np.zeros(0x110000, dtype=np.uint16)
        self.other = np.uint16(len(letters) + 1)
        self.code[:] = self.other
        for n, c in enumerate(letters):
            self.code[ord(c)] = n + 1
        self.width = -(-max(len(p) for p in text.values()) // 4) * 4
        self.ids = np.array(plain, dtype=np.int32)
        self.length = np.array([len(text[i]) for i in plain])
        self.score = np.array([m.get_score(i) for i in range(size)], dtype=np.float64)
        self.matrix = np.zeros((len(plain), self.width), dtype=np.uint16)
        for row, i in enumerate(plain):
            self.matrix[row, : self.length[row]] = self.code[[ord(c) for c in text[i]]]
        # rank 0 is the best score; pieces of one score share a rank
        order = np.unique(-self.score[self.ids], return_inverse=True)
        self.rank = order[1].astype(np.int32)
        self.index: dict[str, int] = {}
        self.at, self.size, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def forget(self, but: set[str] = frozenset()) -> None:
        """Drop the ids of cuts met so far: of cut i they are flat[at[i] : at[i] + size[i]]."""
        keep = [c for c in but if c in self.index]
        old = np.array([self.index[c] for c in keep], dtype=np.int64)
        size = self.size[old]
        ends = np.cumsum(size)
        self.flat = self.flat[np.arange(int(size.sum())) + np.repeat(self.at[old] - (ends - size), size)]
        self.at, self.size, self.index = ends - size, size, dict(zip(keep, range(len(keep)), strict=True))

    # -- matching ---------------------------------------------------------

    def suffixes(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(windows, suffix array): positions in the order of what stands there, as deep as a piece is long."""
        n = len(codes)
        padded = np.concatenate((codes, np.zeros(self.width, np.uint16)))
        windows = np.lib.stride_tricks.sliding_window_view(padded, self.width)[:n]
        key = np.zeros(n, np.uint64)
        for k in range(4):
            key = (key << np.uint64(16)) | padded[k : k + n]
        depth = 4
        while True:  # ranks by 4 code points, then twice as many each time
            order = np.argsort(key)
            if depth >= self.width:
                return windows, order
            ahead = key[order]
            rank = np.empty(n, np.uint64)
            rank[order] = np.concatenate(([1], 1 + np.cumsum(ahead[1:] != ahead[:-1]))) if n else []
            key = rank << np.uint64(32)
            if n > depth:
                key[: n - depth] |= rank[depth:]
            depth *= 2

    def ranges(self, windows: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every piece the range of the suffix array that begins with it."""
        n, rows = len(order), np.arange(len(self.matrix))
        inside = np.arange(self.width) < self.length[:, None]

        def bound(upper: bool) -> np.ndarray:
            low, high = np.zeros(len(rows), np.int64), np.full(len(rows), n, np.int64)
            for _ in range(int(n).bit_length()):
                open_ = low < high
                mid = (low + high) // 2
                there = windows[order[np.minimum(mid, n - 1)]]
                differs = (there != self.matrix) & inside
                at = differs.argmax(1)
                same = ~differs[rows, at]
                less = there[rows, at] < self.matrix[rows, at]
                right = open_ & (np.where(same, upper, less))
                low = np.where(right, mid + 1, low)
                high = np.where(open_ & ~right, mid, high)
            return low

        return bound(False), bound(True)

    def edges(self, codes: np.ndarray) -> np.ndarray:
        """table[position, length]: row of the piece that stands there, or -1."""
        windows, order = self.suffixes(codes)
        low, high = self.ranges(windows, order)
        hits = high - low
        piece = np.repeat(np.arange(len(hits)), hits)
        first = np.repeat(low - np.concatenate(([0], np.cumsum(hits)[:-1])), hits)
        position = order[np.arange(len(piece)) + first]
        table = np.full((len(codes), self.width + 1), -1, dtype=np.int32)
        table[position, self.length[piece]] = piece
        return table

    # -- relaxing ---------------------------------------------------------

    def _merge(self, table: np.ndarray, start: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, lengths) of the symbols left when every word is merged to the end, one pair of each word a round."""
        rank = np.append(self.rank, NONE).astype(np.int64)
        flat, columns, most = table.reshape(-1), self.width + 1, np.int64(NONE)
        length = np.ones(len(start), dtype=np.int64)
        done_s, done_l = [], []

        def pair(i: np.ndarray) -> np.ndarray:
            """The rank of what symbol i and the next one would make."""
            total = length[i] + length[i + 1]
            found = flat[start[i] * columns + np.minimum(total, self.width)]
            return np.where((word[i] == word[i + 1]) & (total <= self.width), rank[found], most)

        start, length, word = np.append(start, 0), np.append(length, self.width), np.append(word, -1)
        key = np.append(pair(np.arange(len(start) - 1)), most)
        while len(start) > 1:
            heads = np.flatnonzero(word[1:] != word[:-1]) + 1
            heads = np.concatenate(([0], heads[:-1])) if word[0] >= 0 else heads
            best = np.minimum.reduceat((key[:-1] << 32) | np.arange(len(key) - 1), heads)
            live = best >> 32 != most
            stays = np.append(np.repeat(live, np.diff(np.append(heads, len(start) - 1))), True)
            done_s.append(start[~stays]), done_l.append(length[~stays])
            pick = best[live] & 0xFFFFFFFF
            length[pick] += length[pick + 1]
            stays[pick + 1] = False
            at = np.cumsum(stays)[pick] - 1
            start, length, word, key = start[stays], length[stays], word[stays], key[stays]
            key[at] = pair(at)
            before = at[at > 0] - 1
            key[before] = pair(before)
        s, n = np.concatenate(done_s), np.concatenate(done_l)
        by = np.argsort(s, kind="stable")
        return s[by], n[by]

    def _merge_long(self, table: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for one long word, by a heap of pairs."""
        size = [1] * (b - a)
        left, right = list(range(-1, b - a - 1)), [*range(1, b - a), -1]
        heap: list[tuple[int, int, int, int]] = []

        def push(i: int) -> None:
            j = right[i]
            if j >= 0 and size[i] + size[j] <= self.width and (row := table[a + i, size[i] + size[j]]) >= 0:
                heapq.heappush(heap, (int(self.rank[row]), i, size[i], size[j]))

        for i in range(b - a - 1):
            push(i)
        while heap:
            _, i, n, m = heapq.heappop(heap)
            j = right[i]
            if size[i] != n or j < 0 or size[j] != m:
                continue
            size[i] += m
            size[j] = 0
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            if left[i] >= 0:
                push(left[i])
            push(i)
        keep = [i for i in range(b - a) if size[i]]
        return np.array(keep) + a, np.array([size[i] for i in keep])

    def _best_path(self, table: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """The best-scored path over a word's edges, relaxed in order of position."""
        low = float(self.score.min()) - 10.0
        best, back = [0.0] + [-np.inf] * (b - a), [0] * (b - a + 1)
        for i in range(b - a):
            row = table[a + i]
            for n in range(1, min(self.width, b - a - i) + 1):
                if row[n] >= 0:
                    s = best[i] + self.score[self.ids[row[n]]]
                elif n == 1:
                    s = best[i] + low
                else:
                    continue
                if s > best[i + n]:
                    best[i + n], back[i + n] = s, i
        cuts, i = [], b - a
        while i > 0:
            cuts.append((a + back[i], i - back[i]))
            i = back[i]
        return np.array([c[0] for c in cuts[::-1]]), np.array([c[1] for c in cuts[::-1]])

    def _learn(self, cuts: list[str]) -> None:
        """Ids of cuts that are not known yet."""
        joined = "\0".join(cuts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lengths = np.fromiter(map(len, cuts), np.int64, len(cuts))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        codes = self.code[points]
        codes[ends] = 0
        table = self.edges(codes)
        found_s, found_n = [], []
        slow = lengths > LONG if self.kind == "bpe" else np.ones(len(cuts), bool)
        inside = np.repeat(~slow, lengths + 1)
        inside[ends] = False
        at = np.flatnonzero(inside)
        if len(at):
            word = np.repeat(np.arange(len(cuts)), lengths + 1)[at]
            for out, x in zip((found_s, found_n), self._merge(table, at, word), strict=True):
                out.append(x)
        for w in np.flatnonzero(slow):
            run = self._merge_long if self.kind == "bpe" else self._best_path
            for out, x in zip((found_s, found_n), run(table, int(starts[w]), int(ends[w])), strict=True):
                out.append(x)
        s, n = np.concatenate(found_s), np.concatenate(found_n)
        by = np.argsort(s, kind="stable")
        s, n = s[by], n[by]
        rows = table[s, n]
        ids = np.where(rows >= 0, self.ids[rows], np.int32(-1))
        bounds = np.searchsorted(s, np.append(starts, len(codes)))
        sizes, missing = np.diff(bounds), np.add.reduceat(ids < 0, bounds[:-1])
        if missing.any():  # these cuts get more ids than symbols
            parts, last = [], 0
            for w in np.flatnonzero(missing):
                a, b = bounds[w], bounds[w + 1]
                own = self._spell(ids[a:b], s[a:b] - starts[w], cuts[w])
                parts += [ids[last:a], own]
                sizes[w], last = len(own), b
            ids = np.concatenate([*parts, ids[last:]])
        first = len(self.size)
        self.index.update(zip(cuts, range(first, first + len(cuts)), strict=True))
        self.at = np.concatenate((self.at, len(self.flat) + np.cumsum(sizes) - sizes))
        self.size = np.concatenate((self.size, sizes))
        self.flat = np.concatenate((self.flat, ids.astype(np.int32)))

    def _spell(self, ids: np.ndarray, at: np.ndarray, cut: str) -> np.ndarray:
        """Characters without a piece as bytes, or as one unknown id for each run."""
        out: list[int] = []
        for i, p in zip(ids, at, strict=True):
            if i >= 0:
                out.append(int(i))
            elif self.fallback:
                out.extend(int(self.bytes_id[b]) for b in cut[p].encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return np.array(out, dtype=np.int32)

    # -- texts ------------------------------------------------------------

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): the piece ids of whole text i are ``ids[bounds[i]:bounds[i+1]]``."""
        cuts = list(map(self.cuts, self.model.normalize(texts))) if texts else []
        distinct = set(chain.from_iterable(cuts))
        if len(self.index) > REMEMBERED:
            self.forget(distinct)
        held, n = [], 0
        for c in distinct.difference(self.index):
            held.append(c)
            n += len(c) + 1
            if n > CHUNK_CHARS // 4:
                self._learn(held)
                held, n = [], 0
        if held:
            self._learn(held)
        counts = np.fromiter(map(len, cuts), np.int64, len(cuts))
        here = dict(zip(distinct, map(self.index.__getitem__, distinct), strict=True))
        which = np.fromiter(map(here.__getitem__, chain.from_iterable(cuts)), np.int64, int(counts.sum()))
        size = self.size[which]
        ends = np.cumsum(size)
        ids = self.flat[np.arange(int(size.sum())) + np.repeat(self.at[which] - (ends - size), size)]
        return ids, np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts that ids stand for, without the mark put before the first word."""
        size = self.surface_size[ids]
        ends = np.cumsum(size)
        data = self.surface_bytes[np.arange(int(size.sum())) + np.repeat(self.surface_at[ids] - (ends - size), size)].tobytes()
        edges = np.concatenate(([0], ends))[bounds].tolist()
        return [data[a:b].decode("utf-8", "replace").removeprefix(" ") for a, b in zip(edges[:-1], edges[1:], strict=True)]


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, kind: str) -> Codec:
    """The model, loaded once in each Python worker."""
    if (path, kind) not in _codecs:
        _codecs[path, kind] = Codec(path, kind)
    return _codecs[path, kind]


def encode(docs: DataFrame, path: str = MODEL, kind: str = "bpe") -> DataFrame:
    """``docs`` with ids (array of int, null for a null text), n_pieces, and the digest of what the ids decode to; columns of these names are replaced."""
    docs = docs.drop("ids", "n_pieces", "decoded_sha256", "round_trip")
    out = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("round_trip", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, kind)
        for batch in batches:
            at = 0
            text = batch.column(batch.schema.get_field_index("text"))
            sizes = pc.fill_null(pc.utf8_length(text), 0).to_numpy(zero_copy_only=False)
            while at < batch.num_rows:
                n = max(1, int(np.searchsorted(np.cumsum(sizes[at : at + 4000]), CHUNK_CHARS)))
                part = batch.slice(at, n)
                at += n
                texts = text.slice(at - n, n).to_pylist()
                ids, bounds = c.encode([t or "" for t in texts])
                decoded = c.decode(ids, bounds)
                mask = pa.array([t is None for t in texts])
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids), mask=mask)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, lists, pa.array(np.diff(bounds), pa.int64()), pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()), pa.array([d == (t or "") for d, t in zip(decoded, texts, strict=True)], pa.bool_())], names=out.names
                )

    return docs.mapInArrow(sparing(run), out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its piece ids and the digest of the text that they decode to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs).select("doc_id", "n_pieces", "ids", "decoded_sha256", "round_trip")
