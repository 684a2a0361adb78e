import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from turfline.llm import lexical_search as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k):
    """All rows as (item_id, rank, doc_id, score) by scoring every document."""
    held = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n, total, out = len(held), sum(sum(c.values()) for _, c in held), []
    df = Counter(t for _, c in held for t in c)
    for item, text in items:
        terms, scored = TERM.findall((text or "").translate(LOWER)), []
        for d, c in held:
            m, score = 75 + 25 * sum(c.values()) * n // total, 0
            for t in terms:
                if c[t]:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
            if score:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, term string")


def corpus(seed=5):
    rng = random.Random(seed)
    words = [f"t{i}" for i in range(200)] + ["Été", "日本語", "The", "the"]
    weights = [1 / (i + 1) for i in range(200)] + [1, 1, 3, 3]
    docs = [(rng.randint(0, 10**6), " ".join(rng.choices(words, weights, k=rng.randint(0, 80)))) for _ in range(500)]
    docs += [(5000 - i, "the t7 t190 copy, again") for i in range(200)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 25)))) for i in range(30)]
    return docs, [*items, (90, None), (91, ""), (92, "nowhere!"), (93, "the the t190"), (93, "t190 the the"), (None, "t7")]


@pytest.mark.parametrize("asked", [S.ASKED, 40])
def test_against_plain(spark, frame, odd, asked):
    docs, items = corpus()
    docs = docs + odd
    index = frame(docs).repartition(5).transform(S.build_index).checkpoint()
    got = S.search(index, items_of(spark, items), 7, asked).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(docs, items, 7)


def test_small_blocks(spark, frame):
    docs, items = corpus(6)
    rows = frame(docs)
    index = S.build_index(rows.repartition(40)).checkpoint()
    assert index.count() > 20
    got = S.search(index, items_of(spark, items), 3).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(docs, items, 3)


def test_sparse_table_answers_every_range():
    rng = np.random.default_rng(1)
    n = 70
    ids, lengths = np.arange(n), rng.integers(5, 50, n)
    asked = S.Asked(np.array([0, 0]), np.array([1, 1]), np.array([3, 8]), np.array([1, 2]), n, int(lengths.sum()), {3: n, 8: 20})
    places = np.concatenate([np.arange(n), np.sort(rng.choice(n, 20, False))])
    tf = rng.integers(1, 4, len(places))
    tables = S.Tables(ids, lengths, np.array([3, 8]), np.array([n, 20]), places, tf, asked)
    for a in range(n):
        for b in range(a, n + 1):
            bound, split = tables.bounds(np.array([[a]]), np.array([[b]]), np.array([[1]]))
            values = tables.value[a:b]
            assert bound[0] == (values.max() if b > a else 0)
            if b > a:
                assert split[0] == a + values.argmax()


def test_few_documents_are_scored():
    """Where few documents hold the rare terms, the bounds leave most of the others out."""
    rng = np.random.default_rng(2)
    n = 4000
    ids, lengths = np.arange(n), np.full(n, 30)
    rare = np.sort(rng.choice(n, 25, False))
    asked = S.Asked(np.zeros(2, int), np.zeros(2, int), np.array([1, 2]), np.array([1, 1]), n, 30 * n, {1: n - 5, 2: 25})
    tables = S.Tables(ids, lengths, np.array([1, 2]), np.array([n - 5, 25]), np.concatenate([np.arange(n - 5), rare]), np.ones(n + 20, int), asked)
    found = S.Found(1, 20)
    assert S.rank_block(tables, asked, found) < 60
    assert found.ids[0].tolist() == rare[:20].tolist() or set(found.ids[0]) <= set(rare.tolist())


def test_empty_tables(spark, frame, odd):
    nothing = S.build_index(frame([])).checkpoint()
    assert S.search(nothing, items_of(spark, [(1, "a b")])).collect() == []
    index = S.build_index(frame(odd)).checkpoint()
    assert S.search(index, items_of(spark, [])).collect() == []
    assert S.search(index, items_of(spark, [(1, None)])).collect() == []


def test_written_blocks_are_files(spark, frame, monkeypatch, tmp_path):
    """Spark's writer and reader hold all large rows of a file, so the query writes a block a file."""
    held = []
    docs, _ = corpus()
    monkeypatch.setattr(S, "table", lambda spark, folder, name: frame(docs * 50).repartition(1) if name == "documents" else None)
    monkeypatch.setattr(S, "build_index", lambda rows, made=S.build_index: made(rows).select("*").unionByName(made(rows)).coalesce(1))
    monkeypatch.setattr(S, "search", lambda index, items: held.append(index))
    S.query(spark, str(tmp_path))
    assert held[0].count() > 1
    assert len(held[0].inputFiles()) == held[0].count()
