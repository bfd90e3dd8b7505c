"""Families of near copies with several edits: the components are those of all pairs."""

import itertools
from random import Random

from skein.llm import jaccard_join


def test_families_are_the_components_of_all_pairs(spark):
    rng = Random(8)
    rows = []
    for family in range(3):
        base = [f"f{family}w{i}" for i in range(40 + 10 * family)]
        for _ in range(30):
            words = list(base)
            for k in rng.sample(range(len(words)), rng.randint(0, 3)):
                words[k] = f"x{rng.randint(0, 5)}"
            rows.append((len(rows), " ".join(words)))
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in sets} and len(set(got.values())) > 3
