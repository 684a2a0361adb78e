"""Importance resampling towards a target text distribution, drawn by exact selection.

Every feature, a run of words, falls into one of ``BUCKETS`` buckets by its crc32. The counts
of all raw and of all target texts give each bucket a gain, the logarithm of its smoothed
likelihood ratio in thousandths. A document's weight is the mean gain of its features, looked
up in one array of fixed size, and its score adds Gumbel noise that its id alone decides, so
the highest scores are a draw without replacement in proportion to the ratios.

The draw is a selection, not a sort. In each round every part of the remaining keys reports
its size and its median; the median of these medians, weighted by the sizes, has at least a
quarter of the remaining keys on either side, so the side without the cutoff key is discarded
whole. The report of a round already describes both sides of its pivot, so a round is one
pass; the remaining keys are written anew whenever they have fallen to a quarter. Only the
winners are then put in order, by ranges, and numbered.

Keys are (-score, doc_id, n_features, row): ties go to the smaller id. Defined results: null
or empty texts have no features, weight 0 and are not drawn; null ids count as the empty text
in the noise and lose ties; each of several equal rows is a document of its own; an empty
table gives an empty result, empty targets gains of their smoothed counts. Other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turfline.llm.common import LOWER, NO_TERM, table, text_slices, word_bounds
from turfline.operators.ordering import row_index
from turfline.session import settle

BUCKETS, RUN, LEAST, SHARE, SEED = 10_000, 1, 20, 10, 2024
#: Words longer than this many bytes go through zlib one by one.
SHORT = 48
KEY = ("falling", "doc", "n_features", "row")


def _crc_table() -> np.ndarray:
    """Remainders of all bytes for the reflected polynomial of crc32."""
    rest = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        rest = np.where(rest & 1, (rest >> 1) ^ np.uint32(0xEDB88320), rest >> 1).astype(np.uint32)
    return rest


CRC = _crc_table()


def crc_update(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of each span appended to what ``state`` (0 at first) is the crc32 of."""
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    falling, at = lengths[order], starts[order]
    crc = ~state.astype(np.uint32)[order]
    first = int(np.searchsorted(-falling, -SHORT, side="left"))
    for turn in range(min(int(falling.max(initial=0)), SHORT)):
        k = int(np.searchsorted(-falling, -turn, side="left"))
        own = crc[first:k]
        crc[first:k] = CRC[(own ^ data[at[first:k] + turn]) & np.uint32(0xFF)] ^ (own >> np.uint32(8))
    crc = ~crc
    for i in range(first):
        crc[i] = zlib.crc32(data[at[i] : at[i] + falling[i]].tobytes(), int(crc[i]))
    out = np.empty_like(crc)
    out[order] = crc
    return out


def features(texts, run: int, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, words per row, buckets of the features, their rows) of slices of texts."""
    space = np.array([32], np.uint8)
    for first, end, data, offsets in text_slices(texts):
        folded = LOWER[data]
        starts, ends, rows = word_bounds(folded, offsets, gap=NO_TERM)
        crc, alive = np.zeros(len(starts), np.uint32), np.arange(len(starts))
        found, owners = [], []
        for length in range(1, run + 1):
            if length > 1:
                alive = alive[alive + length - 1 < len(starts)]
                alive = alive[rows[alive] == rows[alive + length - 1]]
                blank = np.zeros(len(alive), np.int64)
                crc = crc_update(crc[: len(starts)][alive], space, blank, blank + 1)
            last = alive + length - 1
            crc = crc_update(crc, folded, starts[last], ends[last])
            found.append(crc % np.uint32(buckets))
            owners.append(rows[alive])
            whole = np.zeros(len(starts), np.uint32)
            whole[alive] = crc
            crc = whole
        words = np.bincount(rows, minlength=end - first)
        yield first, end, words, np.concatenate(found).astype(np.int64), np.concatenate(owners)


def bucket_counts(texts: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts; every task sends a row per bucket at most."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, _, found, _ in features(batch.column(0), run, buckets):
                total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.record_batch({"bucket": held.astype(np.int32), "n": total[held]})

    parts = texts.select("text").mapInArrow(counted, "bucket int, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of every bucket in thousandths; the driver holds two arrays of ``buckets`` numbers."""

    def counts(texts: DataFrame) -> np.ndarray:
        out = np.zeros(buckets)
        for bucket, n in bucket_counts(texts, run, buckets).collect():
            out[bucket] = n
        return out

    s, t = counts(raw), counts(target)
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, run: int = RUN) -> DataFrame:
    """(doc_id, words, n_features, weight) of every row."""
    buckets = len(gain)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, words, found, rows in features(batch.column("text"), run, buckets):
                n = np.bincount(rows, minlength=end - first)
                total = np.bincount(rows, weights=gain[found], minlength=end - first).astype(np.int64)
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                ids = batch.column("doc_id").slice(first, end - first)
                yield pa.RecordBatch.from_arrays([ids, pa.array(words), pa.array(n), pa.array(weight)], ["doc_id", "words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(weighed, "doc_id long, words long, n_features long, weight long")


def noise(seed: int) -> Column:
    """Gumbel noise in thousandths from the seed and the id."""
    own = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    draw = F.conv(F.substring(F.sha2(own.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((draw + 0.5) / 4294967296.0))).cast("long")


def _key() -> Column:
    return F.struct(*[F.col(c) for c in KEY])


def _bound(key: tuple[int, ...]) -> Column:
    return F.struct(*[F.lit(int(v)).cast("long").alias(c) for c, v in zip(KEY, key, strict=True)])


def _reports(pivot: tuple[int, ...] | None):
    """What one part says of its keys up to ``pivot`` and beyond: side, how many, their median."""

    def report(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = [f.to_numpy(np.int64) for f in frames]
        keys = np.concatenate(kept) if kept else np.zeros((0, len(KEY)), np.int64)
        upto = np.zeros(len(keys), bool)
        if pivot is not None:
            open_ = np.ones(len(keys), bool)
            for column, v in zip(keys.T, pivot, strict=True):
                upto |= open_ & (column < v)
                open_ &= column == v
            upto |= open_
        said = []
        for side, own in ((0, keys[upto]), (1, keys[~upto])):
            if len(own):
                middle = np.lexsort(own.T[::-1])[(len(own) - 1) // 2]
                said.append((side, len(own), *own[middle]))
        if said:
            yield pd.DataFrame(said, columns=["side", "n", *KEY])

    return report


def _weighted_median(said: list) -> tuple[int, ...]:
    ordered = sorted((tuple(r[2:]), r[1]) for r in said)
    half, upto = (sum(n for _, n in ordered) + 1) // 2, 0
    for key, n in ordered:
        upto += n
        if upto >= half:
            return key
    raise ValueError("no keys")


def cutoff(keys: DataFrame, place: int) -> tuple[int, ...]:
    """The ``place``-th smallest key (from 1) by weighted medians of the parts' medians."""
    schema = "side int, n long, " + ", ".join(f"{c} long" for c in KEY)
    left, stored, held = keys, None, 0
    said = left.mapInPandas(_reports(None), schema).collect()
    while True:
        held = sum(r.n for r in said)
        if not 1 <= place <= held:
            raise ValueError("place outside the keys")
        if all(r.n == 1 for r in said):
            return sorted(tuple(r[2:]) for r in said)[place - 1]
        stored = stored or held
        if held * 4 <= stored:
            left, stored = settle(left, "selection"), held
        pivot = _weighted_median(said)
        both = left.mapInPandas(_reports(pivot), schema).collect()
        upto = [r for r in both if r.side == 0]
        below = sum(r.n for r in upto)
        if place == below:
            return pivot
        if place < below:
            left, said = left.where(_key() <= _bound(pivot)), upto
        else:
            left, said, place = left.where(_key() > _bound(pivot)), [r for r in both if r.side == 1], place - below


def resample(
    docs: DataFrame,
    target: DataFrame,
    share: int = SHARE,
    least: int = LEAST,
    seed: int = SEED,
    run: int = RUN,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_features, weight, score, and rank among the
    floor(share/100) of the documents with ``least`` words that are drawn, else null."""
    weighed = weigh(docs, gains(docs, target, run, buckets), run)
    scored = weighed.withColumn("score", F.col("weight") + noise(seed)).withColumns(
        {
            "falling": -F.col("score"),
            "doc": F.coalesce("doc_id", F.lit((1 << 63) - 1)),
            "row": F.monotonically_increasing_id(),
            "fit": F.col("words") >= least,
        }
    )
    scored = settle(scored, "scored")
    result = ["doc_id", "n_features", "weight", "score"]
    place = share * scored.where("fit").count() // 100
    unranked = F.lit(None).cast("long").alias("rank")
    if place == 0:
        return scored.select(*result, unranked)
    last = _bound(cutoff(scored.where("fit").select(*KEY), place))
    drawn = F.col("fit") & (_key() <= last)
    winners = scored.where(drawn).select(*result, "row", F.lit(0).alias("all"), _key().alias("key"))
    ranked = row_index(winners, ["all"], "key", "row", "rank").select(*result, "rank")
    return ranked.unionByName(scored.where(~drawn).select(*result, unranked))


QUERY = "op11_importance_resampling"


def query(spark: SparkSession, folder: str) -> DataFrame:
    return resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


ORACLE_SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
), said AS (
  SELECT 0 AS target, doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
  UNION ALL
  SELECT 1, item_id, -row_number() OVER (), regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), used AS (
  SELECT target, doc_id, r, unnest(words) AS word FROM said
), vocabulary AS (
  SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM used)
), hashed AS (
  SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT))),
    lambda c, b: xor(t[xor(c % 256, b) + 1], c // 256))) % 10000 AS bucket
  FROM vocabulary, crc
), found AS (
  SELECT u.target, u.r, h.bucket FROM used u JOIN hashed h ON u.word = h.word
), counts AS (
  SELECT bucket, CAST(count(*) FILTER (target = 0) AS DOUBLE) AS s, CAST(count(*) FILTER (target = 1) AS DOUBLE) AS t FROM found GROUP BY bucket
), gain AS (
  SELECT bucket, CAST(floor(1000e0 * ln((t + 1) * ((SELECT sum(s) FROM counts) + 10000) / ((s + 1) * ((SELECT sum(t) FROM counts) + 10000)))) AS BIGINT) AS g FROM counts
), weights AS (
  SELECT r, CAST(count(*) AS BIGINT) AS n, CAST(floor(CAST(sum(g) AS DOUBLE) / count(*)) AS BIGINT) AS w
  FROM found JOIN gain USING (bucket) WHERE target = 0 GROUP BY r
), scored AS (
  SELECT d.doc_id, d.r, coalesce(n, 0) AS n_features, coalesce(w, 0) AS weight,
    coalesce(w, 0) + CAST(floor(-1000e0 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5e0) / 4294967296e0))) AS BIGINT) AS score
  FROM said d LEFT JOIN weights USING (r) WHERE d.target = 0
), ranked AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, n_features, r) AS rank, (10 * count(*) OVER ()) // 100 AS drawn FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= drawn THEN rank END AS rank FROM scored LEFT JOIN ranked USING (r)
"""
