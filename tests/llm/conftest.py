import random

import pytest

CLASH = "uid size node score rank ids part digest kept label margin features spans word n rid source_key range level place hash at".split()


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) pairs, with further columns whose names operators use inside."""

    def build(rows, **columns):
        rows = list(rows)
        extra = {c: (lambda i, c=c: f"{c}{i}") for c in CLASH if c not in columns} | columns
        schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in extra)
        return spark.createDataFrame([(d, t, *[f(i) for f in extra.values()]) for i, (d, t) in enumerate(rows)], schema)

    return build


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty, white, repeated, tied and very long texts."""
    rng = random.Random(4)
    long = " ".join(rng.choice(["alpha", "beta", "gamma,", "Delta.", "12", "é"]) for _ in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three"), (None, "one two three"), (None, None)]
    rows += [(6, "same text here again and again"), (6, "same text here again and again"), (7, "same text here again and again")]
    return [*rows, (8, long), (9, long + " end"), (-3, "MIXED Case été 日本 😀 x")]
