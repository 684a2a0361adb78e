import random

import numpy as np
import pyarrow as pa

from turfline.llm import circulant_minhash as C


def shingles(text, width):
    words = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) if text else ""
    words = words.encode().split()
    return {tuple(words[i : i + width]) for i in range(max(len(words) - width + 1, 1))} if words else set()


def brute(rows, width, percent):
    """(doc_id, set size, component) of every row with an id."""
    sets = [(d, shingles(t, width)) for d, t in rows]
    root = {d: d for d, _ in sets if d is not None}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((top(a), top(b)))
                root[high] = low
    return sorted((d, len(s), top(d)) for d, s in sets if d is not None)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(words)), rng.random()
        if kind < 0.6:
            words[at] = f"e{rng.randrange(40)}"
        elif kind < 0.8:
            del words[at]
        else:
            words.insert(at, f"n{rng.randrange(40)}")
    return " ".join(words)


def test_large_group_of_near_copies_equals_brute_force(frame):
    """Copies from hardly to heavily changed, many just under the threshold of one another."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(90)]
    rows = [(i, edited(rng, base, rng.choice([0, 1, 1, 2, 3, 4, 5, 6]))) for i in range(250)]
    other = [f"v{i}" for i in range(60)]
    rows += [(1000 + i, edited(rng, other, rng.choice([2, 3]))) for i in range(60)]
    rows += [(2000 + i, " ".join(base[i % 30 : i % 30 + 62])) for i in range(60)]
    rng.shuffle(rows)
    for width in (4, 5):
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in C.near_duplicates(frame(rows), width).collect())
        assert got == brute(rows, width, 80)


def test_odd_rows(frame, odd):
    got = C.near_duplicates(frame(odd), 4).collect()
    assert len(got) == len(odd)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == brute(odd, 4, 80)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[1].kept and by[2].kept and by[3].kept and by[6].kept and not by[7].kept and not by[9].kept
    copy = [r for r in got if r.doc_id is None and r.n_shingles]
    assert copy[0].component_id == 5 and not copy[0].kept
    assert C.near_duplicates(frame([])).collect() == []


def test_deduplicated_keeps_one_of_each(frame, odd):
    docs = frame(odd + [(None, "only without id"), (None, "only without id")])
    rows = C.deduplicated(docs)
    assert rows.columns == docs.columns
    texts = sorted(str(r.text) for r in rows.collect())
    assert len([t for t in texts if t.startswith("alpha") or len(t) > 1000]) == 1
    assert texts.count("same text here again and again") == 1 and texts.count("only without id") == 1
    assert texts.count("one two three") == 1 and C.deduplicated(frame([])).collect() == []


def test_signature_is_circulant_and_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    a, b = np.unique(pool[:900]), np.unique(pool[100:])
    x, y = C.signature(a, 288), C.signature(b, 288)
    assert abs((x == y).mean() - 0.8) < 0.1
    base = a.astype(np.uint32)
    C._scatter(base)
    for shift in (0, 1, 287):
        moved = base + np.uint32(shift)
        C._scatter(moved)
        assert moved.min() == x[shift]


def test_short_texts_are_one_shingle():
    sets = list(C.shingle_sets(pa.array(["a b", "A  b", "b a", "", None, "a b c d e"]), 4))
    assert sets[0].tolist() == sets[1].tolist() != sets[2].tolist()
    assert [len(s) for s in sets] == [1, 1, 1, 0, 0, 2]
