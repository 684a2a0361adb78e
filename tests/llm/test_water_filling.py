import re
from collections import defaultdict

from turfline.llm import water_filling as W


def plain(targets, weights, total, cap):
    """Clamp and reshare until none is above."""
    taken, free = {}, set(targets)
    while free:
        left = total - sum(taken.values())
        level = left / sum(weights[s] for s in free)
        above = {s for s in free if level * weights[s] > cap * targets[s]}
        if not above:
            return taken | {s: level * weights[s] for s in free}
        taken |= {s: cap * targets[s] for s in above}
        free -= above
    return taken


def test_targets_and_taken(frame):
    rows = [(i, "w " * (1 + i * 7 % 40)) for i in range(400)]
    names = ["b", "a", "é", "zz", None]
    docs = frame(rows, source=lambda i: names[0] if i % 3 else names[i % 5])
    got = W.mix(docs).collect()
    sizes = defaultdict(int)
    for r in got:
        assert r.size == 1 + r.doc_id * 7 % 40
        sizes[r.source_key] += r.size
    order = sorted(sizes)
    want = plain(sizes, dict(zip(order, [5, 2, 1, 5, 2], strict=False)), 1.5 * sum(sizes.values()), 2)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source_key] and abs(r.target - want[r.source_key]) < 1e-6
        assert r.taken == r.size * r.repetitions <= 2 * r.size
        taken[r.source_key] += r.taken
    assert all(abs(taken[s] - want[s]) <= 20 for s in sizes)
    assert sorted(map(tuple, W.mix(docs).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_rows_of_the_mix(frame):
    docs = frame([(i, "w " * (1 + i % 5)) for i in range(60)], source=lambda i: f"s{i % 3}")
    want = {r.doc_id: r.repetitions for r in W.mix(docs).collect()}
    rows = W.mixed_rows(docs)
    assert rows.columns == docs.columns
    seen = defaultdict(int)
    for r in rows.collect():
        seen[r.doc_id] += 1
    assert {d: n for d, n in want.items() if n} == seen


def test_odd_rows(frame, odd, spark):
    got = W.mix(frame(odd, source=lambda i: None if i % 2 else "s")).collect()
    assert len(got) == len(odd)
    count = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in odd if d is not None}
    assert all(r.size == count[r.doc_id] for r in got if r.doc_id is not None)
    assert W.mix(frame([], source=lambda i: "s")).collect() == []
    assert W.mixed_rows(frame([], source=lambda i: "s")).collect() == []
