import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from turfline.llm import quality_classifier as Q


def corpus(n=900, seed=1):
    """Good prose and three kinds of junk, with labels."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeimnorst") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.randrange(8, 60))]
        good = rng.random() < 0.7
        text = " ".join(own)
        if not good:
            text = [" ".join(w + "***" for w in own), " ".join(w.upper() + "!!" for w in own), " ".join([own[0]] * 30)][i % 3]
        rows.append((i, text))
        labels.append((i, int(good), 0))
    return rows, labels


@pytest.fixture(scope="module")
def fitted(spark, frame):
    rows, labels = corpus()
    docs = frame(rows)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return docs, labels, Q.fit(docs, table, max_train=400)


def test_held_out_accuracy(fitted, spark):
    docs, labels, model = fitted
    truth = {i: q for i, q, _ in labels}
    from pyspark.sql import functions as F

    rows = docs.select("doc_id", Q.score(model, F.col("text")).alias("s")).collect()
    assert all(0 <= r.s <= 1 for r in rows)
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 200 and np.mean([(r.s >= 0.5) == truth[r.doc_id] for r in held]) > 0.97


def test_scores_follow_the_formula(fitted):
    _, _, model = fitted
    texts = pa.array(["good words here", "", None, "LOUD!! LOUD!! LOUD!!"], pa.string())
    got = Q.score_texts(texts, model)
    slope, shift = model["curve"]
    for text, score in zip(["good words here", "", ""], got, strict=False):
        found = next(iter(Q.indicators(pa.array([text]))))
        x = model["scale"][found].astype(float)
        margin = model["bias"] + (model["weights"][found].astype(float).sum() / np.sqrt((x**2).sum()) if len(x) else 0)
        assert abs(score - 1 / (1 + np.exp(-(slope * margin + shift)))) < 1e-4
    assert got[1] == got[2]


def test_indicators_are_the_distinct_ngrams():
    one, two = Q.indicators(pa.array(["ab ab ab", "ab"]))
    assert set(two) < set(one) and len(one) == len(set(one))
    # 1 to 4 byte runs of "ab" and one word
    assert len(two) == 4
    rng = np.arange(3)
    assert [f[1].any() for f in Q.word_patterns(np.array([5, 5, 5, 6], np.uint64))][:2] == [True, True] and len(rng) == 3


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 40, 8)) for _ in range(80)]
    labels = np.array([int(3 in r or 7 in r or rng.random() < 0.2) for r in rows])
    scale = rng.normal(0, 1, 40)
    w, alpha = Q.dual_descent(labels, rows, scale, np.zeros(41), np.zeros(80), 1.0, 400)
    x = np.zeros((80, 41))
    for i, r in enumerate(rows):
        x[i, r] = Q.unit(scale, r)
    x[:, 40] = 1
    y = np.where(labels, 1.0, -1.0)
    assert np.allclose(w, (alpha * y) @ x) and alpha.min() >= 0 and alpha.max() <= 1
    primal = 0.5 * w @ w + np.maximum(0, 1 - y * (x @ w)).sum()
    assert primal - (alpha.sum() - 0.5 * w @ w) < 0.05


def test_no_labels_and_one_class(spark, frame, odd):
    docs, shape = frame(odd), "doc_id long, quality int, toxic int"
    from pyspark.sql import functions as F

    for labels, want in (([], 0.5), ([(4, 1, 0), (5, 1, 0), (8, 1, 0), (2, None, 0), (None, 0, 0)], 1.0)):
        model = Q.fit(docs, spark.createDataFrame(labels, shape))
        if labels and model.get("constant") == 0.5:  # all of them in the calibration part
            continue
        got = [r[0] for r in docs.select(Q.score(model, F.col("text"))).collect()]
        assert got == [want] * len(odd)


def test_several_texts_of_one_id_fit_alike(spark, frame):
    rows, labels = corpus(240, seed=4)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    more = [*rows, *[(i, text[::-1]) for i, text in rows[::5]], *rows[::7], (rows[0][0], None)]
    one = Q.fit(frame(more), table)
    two = Q.fit(frame(more[::-1]).repartition(5), table)
    assert one["bias"] == two["bias"] and one["curve"] == two["curve"]
    assert np.array_equal(one["weights"], two["weights"]) and np.array_equal(one["scale"], two["scale"])


def test_no_documents(spark, frame):
    from pyspark.sql import functions as F

    docs = frame([(1, "a")]).where("doc_id < 0")
    model = Q.fit(docs, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    assert model == {"constant": 0.5} and docs.select(Q.score(model, F.col("text"))).collect() == []
