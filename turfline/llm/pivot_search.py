"""Exact top-k search by inner product over a pivot-distance index.

Vectors are keyed by their nearest pivot and the distance to it, sorted by that key and cut
into blocks: each block is one annulus around one pivot. A query searches annuli from the
nearest outwards. A vector of an annulus [low, high] around p is at least
max(d(q, p) - high, low - d(q, p)) away (triangle inequality), so an annulus whose bound
exceeds the distance of the k-th best hit so far is skipped, and the search is exact.

Inner products are searched as distances: every vector gets one more coordinate that lifts
it to the largest norm, so that |q - x|^2 = |q|^2 + M^2 - 2 q.x orders as the product does.

Pivots are fitted on a bounded sample: the ``SAMPLE`` rows with the smallest digest of id
and vector, three rounds of k-means. Every row is indexed. Queries are searched in blocks
of 1,024 against blocks of 2,048 rows; only the best k per query leave a task.

Defined results: vectors that are null, empty, or hold null or non-finite components take
no part; shorter vectors are padded with zeros; a row's own id is never its hit; a repeated
id with equal components counts once; ties go to the smaller id; null ids take no part; an
empty table gives an empty result. Products are exact while they stay below 2^63.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turfline.llm.common import table
from turfline.session import settle

SAMPLE, PIVOTS = 2048, 32
QUERY_BLOCK, DATA_BLOCK = 1024, 2048
#: Annuli per query block and pivot that each round looks at; the last round takes all.
ROUNDS = (2, None)
HITS = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v): components as floor(scale * x), rows that take part only."""
    whole = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    kept = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine)
    return kept.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(whole, lambda x: F.floor(x * scale).cast("long")).alias("v"),
    )


def _matrix(lists, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), np.int64)
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0))


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Vectors with the coordinate that brings them to the largest squared norm ``top``."""
    x = x.astype(np.float64)
    return np.hstack([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))[:, None]])


def fit_pivots(sample: np.ndarray, count: int = PIVOTS, rounds: int = 3) -> np.ndarray:
    """Pivots by k-means from the first distinct rows of the sample."""
    seeds = np.unique(sample, axis=0)
    centres = seeds[np.linspace(0, len(seeds) - 1, min(count, len(seeds))).astype(int)]
    for _ in range(rounds):
        near = _distances(sample, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        sizes = np.bincount(near, minlength=len(centres))
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def _keyed(pivots: np.ndarray, width: int, top: float, lift: bool):
    """Add the nearest pivot and the distance to it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = _matrix(frame["v"].tolist(), width)
            y = _lifted(x, top) if lift else np.hstack([x.astype(float), np.zeros((len(x), 1))])
            d = _distances(y, pivots)
            near = d.argmin(1)
            yield pd.DataFrame(
                {"pivot": near.astype(np.int32), "dist": d[np.arange(len(d)), near], "vec_id": frame["vec_id"], "v": [r.astype("<i8").tobytes() for r in x]}
            )

    return run


def _blocks(size: int):
    """Pack rows sorted by (pivot, dist) into blocks of one pivot each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, waiting = TaskContext.get().partitionId(), 0, None

        def packed(rows: pd.DataFrame) -> dict:
            return {
                "block": (part << 32) + number, "pivot": int(rows["pivot"].iloc[0]), "low": float(rows["dist"].min()),
                "high": float(rows["dist"].max()), "ids": rows["vec_id"].to_numpy("<i8").tobytes(), "data": b"".join(rows["v"]),
            }

        for frame in frames:
            rows = frame if waiting is None else pd.concat([waiting, frame])
            out = []
            runs = [g for _, g in rows.groupby("pivot", sort=True)]
            for i, run_rows in enumerate(runs):
                last = i == len(runs) - 1
                full = len(run_rows) // size * size if last else len(run_rows)
                for at in range(0, full, size):
                    out.append(packed(run_rows.iloc[at : at + size]))
                    number += 1
                waiting = run_rows.iloc[full:] if last else None
            if out:
                yield pd.DataFrame(out)
        if waiting is not None and len(waiting):
            yield pd.DataFrame([packed(waiting)])

    return run


BLOCK = "block long, pivot int, low double, high double, ids binary, data binary"


def build_blocks(rows: DataFrame, pivots: np.ndarray, width: int, top: float, size: int, lift: bool) -> DataFrame:
    """The rows keyed, sorted by (pivot, distance) and packed into annuli."""
    keyed = rows.mapInPandas(_keyed(pivots, width, top, lift), "pivot int, dist double, vec_id long, v binary")
    order = ["pivot", "dist", "vec_id"]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    return settle(ranged.mapInPandas(_blocks(size), BLOCK), "annuli")


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of one query: higher score first, then smaller id."""
    if len(scores) > k:
        least = np.partition(scores, -k)[-k]
        at = np.flatnonzero(scores >= least)
        ids, scores = ids[at], scores[at]
    ids, first = np.unique(ids, return_index=True)
    scores = scores[first]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _searched(k: int, width: int, top: float, pivots: np.ndarray):
    """Best k per query over the (query block, annulus) pairs of a task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def emptied() -> pd.DataFrame:
            rows = [(q, i, s) for q, (ids, scores) in held.items() for i, s in zip(ids, scores, strict=True)]
            held.clear()
            return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

        for frame in frames:
            for row in frame.itertuples():
                q_ids, ids = np.frombuffer(row.q_ids, "<i8"), np.frombuffer(row.ids, "<i8")
                q = np.frombuffer(row.q_data, "<i8").reshape(-1, width)
                x = np.frombuffer(row.data, "<i8").reshape(-1, width)
                flat = np.hstack([q.astype(float), np.zeros((len(q), 1))])
                own = _distances(flat, pivots[row.pivot : row.pivot + 1])[:, 0]
                bound = np.maximum(np.maximum(own - row.high, row.low - own), 0)
                reach = np.frombuffer(row.reach, "<f8") if row.reach is not None else np.full(len(q), np.inf)
                open_ = np.flatnonzero(bound <= reach * (1 + 1e-9) + 1e-6)
                if not len(open_):
                    continue
                exact = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * width < 2**53
                kind = np.float64 if exact else np.int64
                products = (q[open_].astype(kind) @ x.T.astype(kind)).astype(np.int64)
                for i, at in enumerate(open_):
                    others = ids != q_ids[at]
                    hit = best(ids[others], products[i][others], k)
                    if q_ids[at] in held:
                        before = held[q_ids[at]]
                        hit = best(np.concatenate([before[0], hit[0]]), np.concatenate([before[1], hit[1]]), k)
                    held[q_ids[at]] = hit
            if len(held) > 100_000:
                yield emptied()
        yield emptied()

    return run


def _reach(k: int, width: int, top: float):
    """Per query block: the distance within which each query's k-th best hit lies."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples():
                q_ids, q = np.frombuffer(row.q_ids, "<i8"), np.frombuffer(row.q_data, "<i8").reshape(-1, width)
                kth = dict(zip(row.hit_ids if row.hit_ids is not None else [], row.hit_kth if row.hit_kth is not None else [], strict=True))
                norms = (q.astype(float) ** 2).sum(1)
                far = np.array([n + top - 2.0 * kth[i] if i in kth else np.inf for i, n in zip(q_ids.tolist(), norms, strict=True)])
                out.append({"q_block": row.q_block, "reach": np.sqrt(np.maximum(far, 0)).astype("<f8").tobytes(), "widest": float(np.sqrt(max(far.max(), 0)))})
            yield pd.DataFrame(out, columns=["q_block", "reach", "widest"])

    return run


def _spans(width: int, pivots: np.ndarray):
    """Per query block and pivot: the least and greatest distance of its queries."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                q = np.frombuffer(row.q_data, "<i8").reshape(-1, width).astype(float)
                d = _distances(np.hstack([q, np.zeros((len(q), 1))]), pivots)
                yield pd.DataFrame({"q_block": row.q_block, "pivot": np.arange(len(pivots), dtype=np.int32), "near": d.min(0), "far": d.max(0)})

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best vectors."""
    spark = vectors.sparkSession
    rows, asked = settle(quantised(vectors), "vectors"), settle(quantised(queries), "queries")
    size = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    facts = rows.agg(F.max(F.size("v")).alias("width"), F.max(size).alias("top")).first()
    longest = asked.agg(F.max(F.size("v"))).first()[0]
    if facts["width"] is None or longest is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width, top = max(facts["width"], longest), float(facts["top"])
    sample = rows.orderBy(F.xxhash64("v", "vec_id"), "vec_id").limit(SAMPLE).toPandas()
    pivots = fit_pivots(_lifted(_matrix(sample["v"].tolist(), width), top))
    annuli = build_blocks(rows, pivots, width, top, DATA_BLOCK, lift=True)
    asked = build_blocks(asked, pivots, width, top, QUERY_BLOCK, lift=False).select(
        F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data")
    )
    spans = settle(asked.mapInPandas(_spans(width, pivots), "q_block long, pivot int, near double, far double"), "spans")
    gap = F.greatest(F.col("near") - F.col("high"), F.col("low") - F.col("far"), F.lit(0.0))
    met = spans.join(annuli.select("block", "pivot", "low", "high"), "pivot").select("q_block", "pivot", "block", gap.alias("gap"))
    nearest = F.row_number().over(W.partitionBy("q_block", "pivot").orderBy("gap", "block"))
    met = settle(met.withColumn("turn", nearest), "meetings")

    hits, after = None, 0
    for until in ROUNDS:
        pairs = met.where(F.col("turn") > after)
        if until is not None:
            pairs, after = pairs.where(F.col("turn") <= until), until
        if hits is None:
            pairs = pairs.withColumn("reach", F.lit(None).cast("binary"))
        else:
            kth = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") == k)
            of = asked.mapInPandas(_members, "q_block long, query_id long").join(kth, "query_id")
            lists = of.groupBy("q_block").agg(F.collect_list("query_id").alias("hit_ids"), F.collect_list("kth").alias("hit_kth"))
            reach = asked.join(lists, "q_block", "left").mapInPandas(_reach(k, width, top), "q_block long, reach binary, widest double")
            pairs = pairs.join(settle(reach, "reach"), "q_block").where(F.col("gap") <= F.col("widest") * (1 + 1e-9) + 1e-6)
        meetings = pairs.drop("pivot").join(asked, "q_block").join(annuli, "block")
        found = meetings.select("q_ids", "q_data", "reach", "pivot", "low", "high", "ids", "data").mapInPandas(
            _searched(k, width, top, pivots), HITS
        )
        found = found if hits is None else found.union(hits)
        order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranked = found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        hits = settle(ranked.select("query_id", "vec_id", "score", "rank"), "hits").select("query_id", "vec_id", "score", "rank")
        if until is None:
            return hits.select("query_id", "rank", "vec_id", "score")
        hits = hits.drop("rank")
    return hits


def _members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for row in frame.itertuples():
            yield pd.DataFrame({"q_block": row.q_block, "query_id": np.frombuffer(row.q_ids, "<i8")})


QUERY = "op8_pivot_search"


def query(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT DISTINCT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored
)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 5
"""
