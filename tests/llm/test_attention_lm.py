import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from turfline.llm import attention_lm as A


def words(text):
    return (text or "").encode().lower().split()


def held(d):
    return zlib.crc32(str(d).encode()) % 5 == 1


@pytest.mark.parametrize("head", [1 << 19, 8])
def test_baseline_equals_the_formula(frame, odd, head):
    """Both with all words in the head table and with nearly all of them joined."""
    rng = random.Random(2)
    rows = [(d, t) for d, t in odd if d is not None] + [(100 + i, " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randrange(40)))) for i in range(200)]
    got = A.score(frame(rows), head=head).collect()
    assert len(got) == len(rows)
    train = [t for d, t in rows if not held(d)]
    counts = Counter(w for t in train for w in words(t))
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    plain = Counter()
    for d, t in rows:
        own = [counts[w] for w in words(t)] + [len(train)]
        base = sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in own)
        plain[d, held(d), len(own), sum(c > 0 for c in own), n, round(base, 4)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == plain
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_no_rows_and_no_training_rows(frame):
    assert A.score(frame([])).collect() == []
    only = [d for d in range(100) if held(d)][:3]
    got = A.score(frame([(d, "some words") for d in only])).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and abs(r.score + 10) < 40 for r in got)


def test_gradient_is_the_slope():
    rng = np.random.default_rng(0)
    w = A.Weights({n: x.astype(np.float64) for n, x in A.Weights.fresh().items()})
    e, target = rng.normal(size=(3, A.WINDOW, A.FEATURES)), rng.integers(0, A.CLASSES, (3, A.WINDOW))
    live = (rng.random((3, A.WINDOW)) < 0.8).astype(float)
    _, grad = A.gradient(w, e, target, live)
    for name in w:
        at = tuple(rng.integers(0, s) for s in w[name].shape)
        kept, ends = w[name][at], []
        for step in (1e-5, -1e-5):
            w[name][at] = kept + step
            ends.append(A.gradient(w, e, target, live)[0])
        w[name][at] = kept
        assert abs((ends[0] - ends[1]) / 2e-5 - grad[name][at]) < 1e-5


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(4)
    w = A.Weights.fresh()
    features = rng.normal(size=(A.VOCABULARY, A.FEATURES)).astype(np.float32)
    w["out"] = rng.normal(size=w["out"].shape).astype(np.float32)
    scale = np.float32(A.KEYS**-0.5)
    return {
        "q": features @ w["q"] * scale, "k": features @ w["k"], "v": features @ w["v"], "c": features @ w["c"] + w["shift"],
        "factors": A.distance_factors(rng.normal(0, 0.3, A.WINDOW)), "out": w["out"], "prior": w["prior"],
        "classes": np.arange(A.VOCABULARY) % A.CLASSES, "groups": np.arange(A.VOCABULARY) % A.GROUPS,
        "table": -rng.random((A.GROUPS, A.VOCABULARY)).astype(np.float32),
    }


def slow(ids, m):
    """One id at a time over the windows that overlap."""
    full, total, bias = [A.END, *ids], 0.0, np.log(np.maximum(m["factors"][-1][::-1], 1e-30))
    for i, target in enumerate(ids):
        start = 0 if i < A.WINDOW else ((i - A.WINDOW) // A.STRIDE + 1) * A.STRIDE
        seen = full[start : i + 1]
        s = np.array([m["q"][full[i]] @ m["k"][j] for j in seen], float) + bias[: len(seen)][::-1]
        a = np.exp(s - s.max())
        a /= a.sum()
        hidden = np.maximum(sum(x * m["v"][j].astype(float) for x, j in zip(a, seen, strict=True)) + m["c"][full[i]], 0)
        logits = hidden @ m["out"] + m["prior"]
        p = np.exp(logits - logits.max())
        total += math.log10(p[m["classes"][target]] / p.sum()) + float(m["table"][m["groups"][full[i]], target])
    return total


def test_every_id_is_scored_once_with_context(model):
    rng = np.random.default_rng(5)
    ids = [rng.integers(0, 3000, n) for n in (1, 5, 31, 32, 33, 56, 57, 200)]
    got = A.log_likelihoods(ids, model)
    assert np.allclose(got, [slow(i.tolist(), model) for i in ids], atol=2e-3)
    assert np.allclose(A.log_likelihoods([ids[7]], model), got[7:], atol=2e-3)


def test_the_mask_hides_the_future(model):
    a = np.arange(20) + 100
    b = a.copy()
    b[10:] += 500
    q, k, v = (np.stack([model[n][x] for x in (a, b)]) for n in ("q", "k", "v"))
    pad = [np.concatenate([x, np.zeros((2, A.WINDOW - 20, x.shape[-1]), np.float32)], 1) for x in (q, k, v)]
    mixed, _ = A.attend(*pad, model["factors"])
    assert np.allclose(mixed[0, :10], mixed[1, :10]) and not np.allclose(mixed[0, 10:20], mixed[1, 10:20])


def test_shares_sum_to_one():
    counts = np.zeros(A.VOCABULARY)
    counts[:50] = 7
    classes = np.arange(A.VOCABULARY) % A.CLASSES

    class Rows:
        """Stands for the frame of ids: id 3 follows group 1 twice."""

        def mapInArrow(self, *_):  # noqa: N802
            return self

        groupBy = agg = mapInArrow  # noqa: N815

        def toArrow(self):  # noqa: N802
            import pyarrow as pa

            return pa.table({"code": [A.VOCABULARY + 3], "n": [2]})

    table = A.shares_of_class(Rows(), np.zeros(A.VOCABULARY, int), classes, counts)
    sums = np.array([np.bincount(classes, weights=10.0 ** row.astype(float)) for row in table[:3]])
    assert np.allclose(sums, 1, atol=1e-3) and table[1, 3] > table[0, 3]


def _batches(texts):
    return iter([pa.RecordBatch.from_arrays([pa.array([np.asarray(t, "<u2").tobytes() for t in texts], pa.binary())], ["ids"])])


def test_windows_follow_the_length_of_a_text():
    lengths = [0, 1, A.WINDOW, A.SPAN, A.SPAN + 1, 5 * A.SPAN + 7]
    texts = [np.arange(n) % 997 for n in lengths]
    windows = [np.frombuffer(w, "<u2") for b in A._sampled(_batches(texts)) for w in b.column(0).to_pylist()]
    assert len(windows) == sum(max(-(-n // A.SPAN), 1) for n in lengths)
    assert all(len(w) <= A.WINDOW + 1 for w in windows)
    for w, (text, first) in zip(windows, [(t, f) for t in texts for f in range(0, max(len(t), 1), A.SPAN)]):
        span = np.concatenate([[A.END], text])[first : first + A.SPAN + 1]
        assert any(np.array_equal(span[i : i + len(w)], w) for i in range(len(span)))


def test_surroundings_count_every_neighbour_of_whole_texts():
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 50, n) for n in (0, 1, 2, 400, 5000)]
    want = np.zeros((A.VOCABULARY, 2, A.BUCKETS))
    for text in texts:
        for a, b in zip([A.END, *text[:-1]], text):
            want[b, 0, a % A.BUCKETS] += 1
            want[a, 1, b % A.BUCKETS] += 1
    got = np.zeros(want.size)
    for batch in A._surroundings(_batches(texts)):
        got[batch.column(0).to_numpy()] += batch.column(1).to_numpy()
    assert np.array_equal(got.reshape(want.shape), want)
    features, counts = A.id_features(got)
    assert np.array_equal(counts, np.bincount(np.concatenate(texts), minlength=A.VOCABULARY))
    assert features.shape == (A.VOCABULARY, A.FEATURES) and np.isfinite(features).all()
    assert np.isfinite(A.id_features(np.zeros(want.size))[0]).all()
