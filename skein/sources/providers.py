"""Embedding and rerank providers: a protocol, offline defaults, and HTTP clients.

Providers are called from tasks for chunks (plans.ingest) and from the driver for a query.  A repeated call is harmless: vectors are keyed by the hash
of their input.
"""

from __future__ import annotations

import hashlib
import json
import math
import urllib.error
import urllib.request
from collections.abc import Callable

BATCH = 32
TIMEOUT = 60


class ProviderActionRequired(RuntimeError):
    """The provider refuses until its account or key is settled (401, 402, 403)."""


def checked(vectors: list[list[float]], dimensions: int) -> list[list[float]]:
    """Unit vectors of the right length; anything else is an error."""
    out = []
    for v in vectors:
        norm = math.sqrt(sum(float(x) * float(x) for x in v))
        if len(v) != dimensions or not math.isfinite(norm) or norm == 0:
            raise ValueError("provider returned a vector that is of another length, zero or not finite")
        out.append([float(x) / norm for x in v])
    return out


def realign(rows: list[dict], n: int, value: str) -> list:
    """Values of response rows in the order of their indexes, which must be 0 .. n-1 once each."""
    if sorted(r.get("index", -1) if isinstance(r.get("index"), int) and not isinstance(r.get("index"), bool) else -1 for r in rows) != list(range(n)):
        raise ValueError("provider returned other indexes than asked for")
    return [r[value] for r in sorted(rows, key=lambda r: r["index"])]


def with_instruction(texts: list[str], instruction: str) -> list[str]:
    return [f"{instruction}\n{t}" if instruction else t for t in texts]


def hashing_embedder(dimensions: int) -> Callable[[list[str]], list[list[float]]]:
    """An offline embedder: words are counted in hashed, signed cells."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dimensions
            for w in t.lower().split() or [""]:
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % dimensions] += 1.0 if h >> 63 else -1.0
            if not any(v):
                v[0] = 1.0
            out.append(v)
        return checked(out, dimensions)

    return embed


def overlap_reranker(query: str, documents: list[str]) -> list[tuple[int, float]]:
    """An offline reranker: the share of the query's words that a document holds."""
    asked = set(query.lower().split())
    scored = [(i, len(asked & set(d.lower().split())) / max(1, len(asked))) for i, d in enumerate(documents)]
    return sorted(scored, key=lambda x: (-x[1], x[0]))


def rerank_document(row: dict) -> str:
    """The retrieval text of a candidate."""
    name = row.get("filename") or row["relative_path"].rsplit("/", 1)[-1]
    parts = (("Title: ", row.get("title")), ("Heading path: ", row.get("heading_path")), ("Filename: ", name), ("Text:\n", row.get("text")))
    return "\n".join(label + value for label, value in parts if value)


def _post(url: str, key: str, body: dict) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
    try:
        with urllib.request.urlopen(request, timeout=TIMEOUT) as r:
            return json.load(r)
    except urllib.error.HTTPError as e:
        if e.code in (401, 402, 403):
            raise ProviderActionRequired(f"provider action required: HTTP {e.code}") from e
        raise


def http_embedder(url: str, model: str, key: str, dimensions: int, instruction: str = "") -> Callable[[list[str]], list[list[float]]]:
    def embed(texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for a in range(0, len(texts), BATCH):
            part = with_instruction(texts[a : a + BATCH], instruction)
            told = _post(f"{url}/embeddings", key, {"model": model, "input": part, "dimensions": dimensions})
            out += checked(realign(told["data"], len(part), "embedding"), dimensions)
        return out

    return embed


def http_reranker(url: str, model: str, key: str) -> Callable[[str, list[str]], list[tuple[int, float]]]:
    def rerank(query: str, documents: list[str]) -> list[tuple[int, float]]:
        told = _post(f"{url}/rerank", key, {"model": model, "query": query, "documents": documents, "top_n": len(documents)})
        return [(r["index"], float(r["relevance_score"])) for r in told["results"]]

    return rerank
