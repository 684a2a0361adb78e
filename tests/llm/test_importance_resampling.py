import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from turfline.llm import importance_resampling as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, target, share, least, run=1, buckets=10_000):
    """Every row as (doc_id, n_features, weight, score, rank)."""

    def buckets_of(text):
        words = WORD.findall((text or "").translate(LOWER))
        runs = [" ".join(words[i : i + n]) for n in range(1, run + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    raw, wanted = [buckets_of(t) for _, t in docs], [buckets_of(t)[1] for t in target]
    s, t = np.zeros(buckets), np.zeros(buckets)
    for _, found in raw:
        np.add.at(s, found, 1)
    for found in wanted:
        np.add.at(t, found, 1)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + buckets) / ((a + 1) * (t.sum() + buckets)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for at, ((doc, _), (words, found)) in enumerate(zip(docs, raw, strict=True)):
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        rows.append([doc, len(found), weight, score, None, words, at])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, r in enumerate(fit[: share * len(fit) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def targets(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "item_id long, text string, bucket string")


def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)] + ["été", "日本", "A" * 60, "MiXed"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(400)]
    docs += [(1000, docs[5][1])] * 150 + [(None, docs[7][1])] * 20
    return docs, [" ".join(rng.choices(words[:40], k=30)) for _ in range(10)] + [None, ""]


@pytest.mark.parametrize("run", [1, 3])
def test_against_plain(spark, frame, odd, run):
    docs, wanted = corpus()
    docs = docs + odd
    got = R.resample(frame(docs).repartition(7), targets(spark, wanted), share=30, least=5, run=run).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(docs, wanted, 30, 5, run)


def test_crc_of_any_length():
    words = ["a", "été", "日本", "x" * 47, "y" * 48, "z" * 49, "w" * 5000]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    got = R.crc_update(np.zeros(len(words), np.uint32), data, starts, ends)
    assert got.tolist() == [zlib.crc32(w.encode()) for w in words]
    again = R.crc_update(got, data, starts, ends)
    assert again.tolist() == [zlib.crc32((w + w).encode()) for w in words]


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_cutoff_is_the_sorted_place(spark, parts):
    rng = random.Random(parts)
    keys = [(rng.randint(-3, 3), rng.randint(0, 2), rng.randint(0, 1), i) for i in range(500)]
    keys = [(-9, 4, 4, i) if i < 180 else k for i, k in enumerate(keys)]
    frame = spark.createDataFrame(keys, ", ".join(f"{c} long" for c in R.KEY)).repartition(parts)
    for place in (1, 90, 180, 181, 250, 500):
        assert R.cutoff(frame, place) == sorted(keys)[place - 1]
    with pytest.raises(ValueError):
        R.cutoff(frame, 501)


def test_each_round_discards_a_quarter():
    rng = random.Random(8)
    parts = [sorted(rng.sample(range(100_000), rng.randint(1, 300))) for _ in range(30)]
    said = [(0, len(p), p[(len(p) - 1) // 2], 0, 0, 0) for p in parts]
    pivot, every = R._weighted_median(said)[0], sorted(k for p in parts for k in p)
    below = sum(k <= pivot for k in every)
    assert len(every) / 4 <= below <= len(every) * 3 / 4 + 1


def test_empty_tables(spark, frame):
    assert R.resample(frame([]), targets(spark, ["a b"])).collect() == []
    docs = [(i, f"word{i} other text") for i in range(5)]
    for wanted in ([], [None]):
        got = R.resample(frame(docs), targets(spark, wanted), share=100, least=1).collect()
        assert sorted((tuple(r) for r in got), key=repr) == plain(docs, wanted, 100, 1)
