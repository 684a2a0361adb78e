"""Requirement search of rows that ask for their own values against a plain sort of all candidates."""

import numpy as np
import pyarrow as pa
import pytest

from turfline.operators import alikesearch as A
from turfline.operators import blocksearch as B

FAMILIES = ["a", "a", "b", "c"]
FACTORS = [(0.9, 1.2, 1.0, 0.8), (1.1, 0.8, 0.85, 1.2)]


def plain(values, ids, clubs, variants, k, use_clubs):
    """Per row and variant the ids of the k best."""
    n = len(FAMILIES)
    asked = B.Asked(values[:, :n], np.zeros((len(ids), n), int), np.ones((len(ids), n)), FAMILIES)
    out = {}
    for i, v in enumerate(variants):
        x = values[:, v.view * n : (v.view + 1) * n]
        key = asked.key(asked.losses(x, x), v)
        for r in range(len(ids)):
            live = [c for c in range(len(ids)) if c != r and not (use_clubs and clubs[c] == clubs[r])]
            out[ids[r], i] = [ids[c] for c in sorted(live, key=lambda c: (key[r, c], ids[c]))[:k]]
    return out


def people(n, kind, views=1):
    rng = np.random.default_rng(n)
    if kind == "ties":
        x = np.round(rng.uniform(0, 100, (n, 4 * views)) / 5) * 5
    elif kind == "dense":
        x = 50 + rng.normal(0, 4, (n, 4 * views))
    else:
        x = rng.uniform(0, 100, (n, 4 * views))
    return x, rng.permutation(n * 3)[:n], rng.integers(0, 3, n)


def jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b))


@pytest.mark.parametrize("kind", ["ties", "dense", "even"])
@pytest.mark.parametrize("n", [3, 40, 400])
@pytest.mark.parametrize("clubs", [False, True])
def test_lists_equal_sorting_all(kind, n, clubs):
    variants = [B.Variant(m, f) for m in B.METHODS for f in [None, *FACTORS]]
    x, ids, club = people(n, kind)
    want = plain(x, ids, club, variants, 5, clubs)
    cells = np.column_stack([x, club])
    picked = A.Picked(A.Plan(FAMILIES, variants, 5, clubs), [(0, [])], [(pa.array(ids), cells, None)])
    for at in range(0, n, 150):
        picked.meet(pa.array(ids[at : at + 150]), cells[at : at + 150])
    for i in range(len(variants)):
        for r, me in enumerate(ids):
            assert picked.who[i, r][np.isfinite(picked.key[i, r])].tolist() == want[me, i], (i, r)


def test_overlaps_of_views_and_weights(spark):
    x, ids, club = people(150, "ties", 2)
    variants = [B.Variant("weighted_rms"), B.Variant("weighted_rms", FACTORS[0]), B.Variant("weighted_rms", FACTORS[1]), B.Variant("weighted_rms", None, 1)]
    want = plain(x, ids, club, variants, 5, True)
    rows = [("g", int(i), int(c), v.tolist()) for i, c, v in zip(ids, club, x, strict=True)]
    candidates = spark.createDataFrame(rows, "role string, id long, club long, values array<double>")
    own = spark.createDataFrame([(*r[:3], r[3][:4]) for r in rows], candidates.schema)
    bases = {"ids": (0, {"weights": [1, 2], "profiles": [3]})}
    got = A.overlaps(own, candidates, ["role"], FAMILIES, variants, bases, 5, clubs=True, asked=40, block=64).collect()
    assert sorted(r.id for r in got) == sorted(ids.tolist())
    for r in got:
        base = want[r.id, 0]
        assert r.ids == base
        assert r.weights == pytest.approx(np.mean([jaccard(base, want[r.id, i]) for i in (1, 2)]))
        assert r.profiles == pytest.approx(jaccard(base, want[r.id, 3]))
