"""Quality classifier: naive Bayes support vectors (Wang and Manning 2012).

A text becomes indicators of its hashed n-grams: bytes in runs of 1 to 4, words alone and in
pairs, and the patterns of word runs: one word 2, 3 or 4 times in a row, and words that come
back at distance 2 or 3 throughout a run of 4 or 6. Each indicator is scaled by the log-count ratio of the two classes, the vector
is brought to length one, and a linear hinge-loss model with bias is fitted by dual
coordinate descent. A logistic curve, fitted on rows the model has not seen, turns margins
into scores.

The fit takes at most ``MAX_TRAIN`` labelled rows: those of the allowed folds with the
smallest digests of their ids, in all classes alike. They are packed into ``PARTS`` blocks
of features. Each round solves every block's dual by itself from the shared weights, and the
averaged changes make the next weights, so no task holds all rows and the driver only sums
weight vectors of fixed length. Scoring reads every whole text once.

Defined results: null and empty texts have no n-gram and get the bias alone; of several
labels of one id the largest counts, and of several texts that of the least digest is learned
from; null labels and null ids are left out; with rows of one class only every score is that
class, with no labelled row 0.5 (predicted 1), and no documents give no scores; repeated rows
score alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turfline.llm.common import crc_fold, mix64, span_hashes, table, text_slices, word_bounds
from turfline.session import settle

FOLDS, HELD_OUT = 3, 1
MAX_TRAIN, PARTS, HELD_PARTS = 8192, 16, 3
DIMS = 1 << 17
ROUNDS, PASSES, COST, SMOOTH = 8, 3, 1.0, 1.0


def word_patterns(words: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(words spanned, flags by first word) of the repetition patterns."""
    out = []
    for lag, times in ((1, 1), (1, 2), (1, 3), (2, 2), (3, 3)):
        same = words[lag:] == words[:-lag]
        flags = same[: max(len(same) - times + 1, 0)].copy()
        for t in range(1, times):
            flags &= same[t : t + len(flags)]
        out.append((lag + times, flags))
    return out


def indicators(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted feature numbers of each text."""
    seen = np.zeros(DIMS, bool)
    shift = np.uint64(64 - DIMS.bit_length() + 1)
    for _, _, data, offsets in text_slices(texts, 1 << 19):
        byte = data.astype(np.uint64)
        grams, code = [], np.zeros(len(data), np.uint64)
        for n in range(1, 5):
            code = code[: len(data) - n + 1] if n > 1 else code
            code = (code << np.uint64(8)) | byte[n - 1 :] if len(code) else code
            grams.append((mix64(code + (np.uint64(n) << np.uint64(56))) >> shift).astype(np.int32))
        starts, ends, rows = word_bounds(data, offsets)
        words = span_hashes(data, starts, ends)
        pairs = mix64(words[:-1] * np.uint64(3) + words[1:]) if len(words) else words
        single, double = (words >> shift).astype(np.int32), (pairs >> shift).astype(np.int32)
        bounds = np.searchsorted(rows, np.arange(len(offsets)))
        patterns = word_patterns(words)
        for i in range(len(offsets) - 1):
            a, b = offsets[i], offsets[i + 1]
            for n, gram in enumerate(grams, 1):
                if b - a >= n:
                    seen[gram[a : b - n + 1]] = True
            u, v = bounds[i], bounds[i + 1]
            seen[single[u:v]] = True
            if v - u > 1:
                seen[double[u : v - 1]] = True
            for number, (span, flags) in enumerate(patterns):
                if v - u >= span and flags[u : v - span + 1].any():
                    seen[number] = True
            found = np.flatnonzero(seen)
            seen[found] = False
            yield found


def _packed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in frames:
        features = [f.astype("<i4").tobytes() for f in indicators(batch.column("text"))]
        columns = [batch.column(c) for c in ("part", "rank", "digest", "label")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(features, pa.binary())], ["part", "rank", "digest", "label", "features"])


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int) -> DataFrame:
    """Feature rows (part, rank, label, features) of the bounded sample, settled."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max((F.col("quality") > 0).cast("int")).alias("label"))
    known = known.where(crc_fold("doc_id", FOLDS) != HELD_OUT)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    chosen = chosen.withColumn("rank", F.xxhash64("doc_id")).withColumn("part", F.pmod("rank", F.lit(PARTS)).cast("int"))
    # At most max_train rows of four numbers: a bounded broadcast that spares a shuffle of texts.
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(settle(chosen, "sample")), "doc_id")
    # Of several texts of one id the one of the least digest is taken, so reruns agree.
    digest = F.sha2(F.coalesce("text", F.lit(b"")), 256).alias("digest")
    packed = texts.select("part", "rank", digest, "label", "text").mapInArrow(_packed, "part int, rank long, digest string, label int, features binary")
    one = packed.groupBy("part", "rank", "label").agg(F.min_by("features", "digest").alias("features"))
    return settle(one.select("part", "rank", "label", "features"), "features")


def _gathered(frame: pd.DataFrame) -> pd.DataFrame:
    """One block: its labels and features as one row."""
    frame = frame.sort_values("rank")
    sizes = np.array([len(f) // 4 for f in frame["features"]], "<i8")
    return pd.DataFrame(
        {"part": [int(frame["part"].iloc[0])], "labels": [frame["label"].to_numpy("<i4").tobytes()], "sizes": [sizes.tobytes()], "features": [b"".join(frame["features"])]}
    )


def _rows(block) -> tuple[np.ndarray, list[np.ndarray]]:
    sizes = np.frombuffer(block.sizes, "<i8")
    return np.frombuffer(block.labels, "<i4"), np.split(np.frombuffer(block.features, "<i4"), np.cumsum(sizes)[:-1])


def _class_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for block in frame.itertuples():
            labels, rows = _rows(block)
            for label in (0, 1):
                own = [r for y, r in zip(labels, rows, strict=True) if y == label]
                counts = np.bincount(np.concatenate([*own, np.zeros(0, np.int32)]), minlength=DIMS)
                yield pd.DataFrame({"label": [label], "rows": [len(own)], "counts": [counts.astype("<f4").tobytes()]})


def dual_descent(
    labels: np.ndarray, rows: list[np.ndarray], scale: np.ndarray, weights: np.ndarray, alphas: np.ndarray, cost: float, passes: int
) -> tuple[np.ndarray, np.ndarray]:
    """Coordinate descent on the dual of the hinge loss (Hsieh et al. 2008) from given weights
    and alphas; returns both. The last weight is the bias. Vectors have length one."""
    w, alphas = weights.astype(np.float64), alphas.copy()
    order = np.random.default_rng(5)
    vectors = [unit(scale, r) for r in rows]
    for _ in range(passes):
        for i in order.permutation(len(rows)):
            y, r, x = (1.0 if labels[i] else -1.0), rows[i], vectors[i]
            slack = y * (x @ w[r] + w[-1]) - 1.0
            new = min(max(alphas[i] - slack / 2.0, 0.0), cost)
            step = (new - alphas[i]) * y
            if step:
                w[r] += step * x
                w[-1] += step
                alphas[i] = new
    return w, alphas


def unit(scale: np.ndarray, features: np.ndarray) -> np.ndarray:
    x = scale[features]
    norm = np.sqrt(x @ x)
    return x / norm if norm > 0 else x


def _solved(scale: np.ndarray, weights: np.ndarray, alphas: dict[int, np.ndarray]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for block in frame.itertuples():
                labels, rows = _rows(block)
                own = alphas.get(block.part, np.zeros(len(rows)))
                w, new = dual_descent(labels, rows, scale, weights, own, COST, PASSES)
                yield pd.DataFrame(
                    {"part": [block.part], "change": [(w - weights).astype("<f4").tobytes()], "alphas": [new.astype("<f8").tobytes()]}
                )

    return run


def _margins(scale: np.ndarray, weights: np.ndarray):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for block in frame.itertuples():
                labels, rows = _rows(block)
                margins = [float(unit(scale, r) @ weights[r] + weights[-1]) for r in rows]
                yield pd.DataFrame({"label": labels, "margin": margins})

    return run


def logistic_curve(margins: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """(slope, shift) of the logistic curve of greatest penalised likelihood, by Newton steps."""
    theta, x = np.array([2.0, 0.0]), np.column_stack([margins, np.ones(len(margins))])
    prior, keep = np.array([2.0, 0.0]), np.diag([0.1, 0.1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (p - labels) + keep @ (theta - prior)
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, grad)
        theta = theta - move
        if np.abs(move).max() < 1e-9:
            break
    return max(float(theta[0]), 0.1), float(theta[1])


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> dict:
    """The model: scaled weights per feature, bias, curve; or a constant score."""
    rows = training_rows(docs, labels, max_train)
    shape = "part int, labels binary, sizes binary, features binary"
    blocks = settle(rows.groupBy("part").applyInPandas(_gathered, shape), "blocks")
    fitted = blocks.where(F.col("part") >= HELD_PARTS)
    counts, sizes = {0: np.zeros(DIMS), 1: np.zeros(DIMS)}, {0: 0, 1: 0}
    counted = settle(fitted.mapInPandas(_class_counts, "label int, rows long, counts binary"), "counts")
    for row in counted.toLocalIterator():
        counts[row["label"]] += np.frombuffer(row["counts"], "<f4")
        sizes[row["label"]] += row["rows"]
    if not sizes[0] or not sizes[1]:
        return {"constant": 0.5 if not sizes[0] + sizes[1] else float(sizes[1] > 0)}
    ratio = [np.log((counts[c] + SMOOTH) / (counts[c] + SMOOTH).sum()) for c in (0, 1)]
    scale = ratio[1] - ratio[0]
    weights, alphas = np.zeros(DIMS + 1), {}
    for _ in range(ROUNDS):
        solved = fitted.mapInPandas(_solved(scale.astype(np.float32), weights.astype(np.float32), alphas), "part int, change binary, alphas binary")
        # Written first: reading an unwritten frame row by row would run one task after the other.
        solved = settle(solved, "solved").orderBy("part")
        total, seen, news = np.zeros(DIMS + 1), 0, {}
        for row in solved.toLocalIterator():
            total += np.frombuffer(row["change"], "<f4")
            news[row["part"]] = np.frombuffer(row["alphas"], "<f8")
            seen += 1
        weights = weights + total / seen
        alphas = {p: alphas.get(p, 0.0) + (a - alphas.get(p, 0.0)) / seen for p, a in news.items()}
    held = blocks.where(F.col("part") < HELD_PARTS).mapInPandas(_margins(scale, weights), "label int, margin double").toPandas()
    slope, shift = logistic_curve(held["margin"].to_numpy(), held["label"].to_numpy(float)) if len(held) else (2.0, 0.0)
    return {"scale": scale.astype(np.float32), "weights": (scale * weights[:-1]).astype(np.float32), "bias": float(weights[-1]), "curve": (slope, shift)}


def score_texts(texts: pa.Array, model: dict) -> np.ndarray:
    if "constant" in model:
        return np.full(len(texts), model["constant"])
    out, (slope, shift) = np.zeros(len(texts)), model["curve"]
    for i, found in enumerate(indicators(texts)):
        norm = np.sqrt(np.square(model["scale"][found], dtype=np.float64).sum())
        margin = model["bias"] + (model["weights"][found].sum(dtype=np.float64) / norm if norm > 0 else 0.0)
        out[i] = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -500, 500)))
    return out


def score(model: dict, text: Column) -> Column:
    """Score column of a text column. The model of fixed size travels as a broadcast variable."""
    shared = SparkSession.active().sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(score_texts(texts, shared.value))

    return scored(F.coalesce(text.cast("binary"), F.lit(b"")))


QUERY = "op1_naive_bayes_svm"


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = fit(docs, table(spark, folder, "labels"))
    scored = docs.select("doc_id", (crc_fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


ORACLE_SQL = None
