import zlib

import numpy as np

from turfline.llm import jump_shards as J


def walk(key, shards):
    """The published walk on plain integers."""
    here, ahead = -1, 0
    while ahead < shards:
        here = ahead
        key = (key * 2862933555777941757 + 1) % 2**64
        ahead = int((here + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return here


def test_walk_and_growth():
    keys = np.array([0, 1, 2, 2**63, 2**64 - 1, *range(1000, 4000)], np.uint64)
    for shards in (1, 2, 7, 40, 41):
        assert J.jump(keys, shards).tolist() == [walk(int(k), shards) for k in keys]
    old, new = J.jump(keys, 40), J.jump(keys, 41)
    assert set(new[old != new]) == {40} and 0 < (old != new).mean() < 0.06


def test_against_plain(frame, odd):
    rows = odd + [(i, f"text {i}") for i in range(100, 700)]
    got = J.with_slots(J.assign(frame(rows), 7)).collect()
    plain = sorted((walk((d or 0) % 2**64, 7), (d is not None, d or 0), zlib.crc32((t or "").encode()), len((t or "").encode()) + 16) for d, t in rows)
    have = sorted((r.shard, (r.doc_id is not None, r.doc_id or 0), r.text_crc32, r.size, r.slot, r.grown_shard) for r in got)
    assert [h[:4] for h in have] == plain
    slots = {}
    for shard, _, _, _, slot, grown in sorted(have, key=lambda h: (h[0], h[4])):
        assert slot == slots.get(shard, 0) and grown in (shard, 7)
        slots[shard] = slot + 1


def test_empty_and_columns(frame, odd):
    assert J.with_slots(J.assign(frame([]))).collect() == []
    docs = frame(odd)
    assert set(docs.columns) < set(J.sharded(docs).columns) and J.sharded(docs).count() == len(odd)
