"""Hard negatives against brute force, and the bounds of the vertical scan."""

import math
from random import Random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, rank string"


def plain(rows, every=50, positives=5, negatives=3):
    """Rows (id, vector, label) after the contract's own words."""
    held = {}
    for i, v, label in sorted((r for r in rows if None not in r and not any(x is None or not math.isfinite(x) for x in r[1])), key=lambda r: (r[0], r[2], [math.floor(256 * x) for x in r[1]])):
        held.setdefault(i, (label, [math.floor(256 * x) for x in v]))
    out = []
    for a, (label, v) in held.items():
        if a % every:
            continue
        scores = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, (other, w) in held.items() if i != a and len(w) == len(v)]
        for p, pos, _ in sorted(s for s in scores if s[2] == label)[:positives]:
            fit = sorted(s for s in scores if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p)[:negatives]
            out += [(a, pos, n + 1, i, -p, -s) for n, (s, i, _) in enumerate(fit)]
    return sorted(out)


def vectors(n, seed=1, dims=24, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dims)) * 0.3
    out = []
    for i in range(n):
        label = int(rng.integers(labels))
        out.append((i, [float(np.float32(x)) for x in centres[label] + rng.normal(size=dims) * 0.3], label))
    return out


def answer(spark, rows, **args):
    frame = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(3)
    frame = frame.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label", "rank")
    return sorted(tuple(r) for r in hn.mine(frame, F.col("id") % 50 == 0, **args).collect())


def test_equal_to_brute_force(spark):
    rows = vectors(600)
    assert answer(spark, rows) == plain(rows) and len(plain(rows)) > 100
    # many small groups find the same
    assert answer(spark, rows, group_rows=37) == plain(rows)


def test_ties_copies_nulls_and_ranges(spark):
    rows = vectors(200, seed=2)
    same = rows[0][1]
    rows += [(1000 + i, same, i % 2) for i in range(120)]  # copies of an anchor in two labels
    rows += [(3, rows[3][1], rows[3][2]), (4, rows[5][1], 9)]  # a repeated row, an id of two rows
    rows += [(None, same, 1), (2000, None, 1), (2001, same, None), (2002, [float("nan")] * 24, 1), (2003, [float("inf")] * 24, 1), (2004, [None] * 24, 1), (2050, [0.0] * 24, 1), (2051, [1.0] * 5, 1), (2100, [1.0] * 5, 1), (2101, [0.6] * 5, 2), (2150, [], 1)]
    assert answer(spark, rows) == plain(rows)


def test_large_components_are_exact(spark):
    rows = [(i, [float(np.float32(x * 3000.0)) for x in v], label) for i, v, label in vectors(150, seed=3)]
    assert answer(spark, rows) == plain(rows) and max(abs(x) for r in rows for x in r[1]) * 256 > 2**19


def test_empty_and_lonely(spark):
    assert answer(spark, []) == [] == answer(spark, [(0, [1.0], 1)]) == answer(spark, [(0, [1.0], 1), (1, [1.0], 1)])
    assert answer(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.6], 2), (3, [0.99], 2), (4, [0.1], 2)]) == [(0, 1, 1, 2, 65536, 39168)]


@pytest.mark.parametrize("scale", [1, 1 << 22])
def test_bounds_prune_without_loss(scale):
    rng = np.random.default_rng(4)
    rows = rng.integers(-200, 200, (500, 32)) * (np.arange(32) < 6) + rng.integers(-3, 3, (500, 32))
    own = hn.Columns(np.arange(500), rng.integers(0, 3, 500), rows * scale)
    seen = []
    inner = own.scan

    def scan(anchor, alive, limits, shrink):
        seen.append((len(alive), len(inner(anchor, alive, limits, shrink)[0])))
        return inner(anchor, alive, limits, shrink)

    own.scan = scan
    score = own.rows @ own.rows[0]
    got = own.best(int(own.ids[0]), 1, own.rows[0], 5)
    want = sorted((-int(s), int(i)) for s, i, lab in zip(score, own.ids, own.labels, strict=True) if lab == 1 and i != own.ids[0])[:5]
    assert got == [(i, -s) for s, i in want]
    assert seen[0][1] < seen[0][0] / 4  # most rows never reached their last dimension


def test_random_windows():
    rng = Random(6)
    rows = np.array([[rng.randint(-50, 50) for _ in range(16)] for _ in range(300)])
    own = hn.Columns(np.arange(300), np.array([rng.randint(0, 2) for _ in range(300)]), rows)
    for a in range(0, 300, 17):
        score = own.rows @ own.rows[a]
        windows = [(w, w + rng.randint(0, 4000)) for w in (rng.randint(-3000, 9000) for _ in range(5))]
        got = own.within(int(own.labels[a]), own.rows[a], windows, 3)
        for (low, high), some in zip(windows, got, strict=True):
            fit = sorted((-int(s), int(i)) for s, i, lab in zip(score, own.ids, own.labels, strict=True) if lab != own.labels[a] and low <= s <= high)[:3]
            assert some == [(i, -s) for s, i in fit]
