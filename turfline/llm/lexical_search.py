"""Ranked lexical search with range-maximum sparse tables over posting lists.

The index is a table of blocks. A block holds some ``BLOCK`` bytes of text: its documents in
ascending id order with their lengths, and for every term, by 64-bit hash, the places and
frequencies of the documents that hold it. It does not depend on any query. A written block is a
file of its own, so that neither its writer nor its reader holds more than a few blocks.

A search reads the blocks once for the document frequencies of the asked terms and once to
rank. In a block every asked posting list gets a sparse table of the places of its largest
impacts. An interval of documents is bounded by the sum, over the item's terms, of the
weighted largest impacts in it, each of them one range-maximum answer. The interval of the highest bound comes
first: it is split at its maximum-impact document, that of the term which adds most; this
document is scored in full, and the two intervals beside it get bounds of their own. An item
is done with a block when no interval left can reach its k-th best. All items of a bundle take such
steps side by side in numpy, ``WIDE`` intervals each. What an item has found in earlier blocks of a task
bounds the later ones, so a task sends k rows per item at most; they are merged in two levels.

Items are taken in bundles of about ``ASKED`` terms, dealt by a hash of their row, so what the driver
and the tasks hold of the items is bounded at any number of items; every bundle reads the
index again. Everything else is exact: no term, posting or document is left out.

Equal scores go to the smaller id; null ids come last. Defined results: null or empty texts
count for nothing and are never found; items without terms have no rows; equal rows are
documents, or items, of their own; an empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turfline.llm.common import LOWER, NO_TERM, ragged, signed, span_hashes, table, text_slices, word_bounds
from turfline.operators.ordering import top_k
from turfline.session import settle

TOP, BLOCK, ASKED, WIDE = 20, 1 << 23, 1 << 20, 4
#: Padded cells (items x terms) that are searched together.
CELLS = 1 << 16
NO_ID = (1 << 63) - 1
INDEX = (
    "n_docs long, n_terms long, ids array<long>, lengths array<int>, "
    "terms array<long>, counts array<int>, places array<int>, tf array<int>"
)


def terms_of(texts, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, term hashes, rows relative to the first) of runs of texts of some
    ``limit`` bytes; texts are cut and hashed in smaller slices, whose hashes alone are kept."""
    began, upto, held, own, size = 0, 0, [], [], 0
    for first, end, data, offsets in text_slices(texts):
        folded = LOWER[data]
        starts, ends, rows = word_bounds(folded, offsets, gap=NO_TERM)
        held.append(signed(span_hashes(folded, starts, ends)))
        own.append(rows + (first - began))
        upto, size = end, size + len(data)
        if size >= limit:
            yield began, upto, np.concatenate(held), np.concatenate(own)
            began, held, own, size = upto, [], [], 0
    if held:
        yield began, upto, np.concatenate(held), np.concatenate(own)


def postings(terms: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct terms ascending, postings of each, rows, frequencies); ``rows`` ascend."""
    order = np.argsort(terms, kind="stable")
    terms, rows = terms[order], rows[order]
    new_term = np.ones(len(terms), bool)
    new_term[1:] = terms[1:] != terms[:-1]
    new = new_term.copy()
    new[1:] |= rows[1:] != rows[:-1]
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(terms)))
    own = np.flatnonzero(new_term[at])
    return terms[at[own]], np.diff(np.append(own, len(at))), rows[at], tf


def _lists(flat: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat.astype(kind)))


def build_index(docs: DataFrame) -> DataFrame:
    """The block table of all rows of ``docs`` with a term."""

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.take(pa.array(np.argsort(batch.column("id").to_numpy(), kind="stable")))
            ids = batch.column("id").to_numpy()
            for first, end, terms, rows in terms_of(batch.column("text")):
                lengths = np.bincount(rows, minlength=end - first)
                held = np.flatnonzero(lengths)
                place = np.cumsum(lengths > 0) - 1
                if not len(held):
                    continue
                words, counts, at, tf = postings(terms, place[rows])
                flat = [(ids[first:end][held], np.int64), (lengths[held], np.int32), (words, np.int64), (counts, np.int32), (at, np.int32), (tf, np.int32)]
                sums = [pa.array([len(held)], pa.int64()), pa.array([len(terms)], pa.int64())]
                names = [x.split()[0] for x in INDEX.split(", ")]
                yield pa.RecordBatch.from_arrays([*sums, *(_lists(*x) for x in flat)], names)

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), "text")
    return rows.mapInArrow(indexed, INDEX)


def item_terms(items: DataFrame) -> DataFrame:
    """(row, item_id, term, repeats) of every item's distinct terms."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, terms, rows in terms_of(batch.column("text")):
                words, counts, at, tf = postings(terms, rows)
                own = pa.array(first + at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").take(own), batch.column("item_id").take(own), pa.array(np.repeat(words, counts)), pa.array(tf.astype(np.int64))],
                    ["row", "item_id", "term", "repeats"],
                )

    own = F.coalesce(F.col("item_id").cast("long"), F.lit(NO_ID)).alias("item_id")
    rows = items.select(F.monotonically_increasing_id().alias("row"), own, "text")
    return rows.mapInArrow(listed, "row long, item_id long, term long, repeats long")


class Asked:
    """A bundle of items: their terms with weights, in groups of items of similar length."""

    def __init__(self, rows, item_ids, terms, repeats, n_docs: int, n_terms: int, frequency: dict[int, int]):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.terms = np.array(sorted(frequency), np.int64)
        df = np.array([frequency[t] for t in self.terms.tolist()], np.float64)
        self.weight = np.floor(1000 * np.log((2.0 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
        place = np.searchsorted(self.terms, terms)
        place = np.minimum(place, max(len(self.terms) - 1, 0))
        known = self.terms[place] == terms if len(self.terms) else np.zeros(len(terms), bool)
        keep = np.flatnonzero(known)
        keep = keep[self.weight[place[keep]] > 0]
        order = keep[np.argsort(rows[keep], kind="stable")]
        self.rows, starts, sizes = np.unique(rows[order], return_index=True, return_counts=True)
        self.item_ids = item_ids[order][starts]
        self.groups = []
        by_size = np.argsort(sizes, kind="stable")
        at = 0
        while at < len(by_size):
            end = at + 1
            while end < len(by_size) and sizes[by_size[end]] * (end + 1 - at) <= CELLS:
                end += 1
            own = by_size[at:end]
            wide = int(sizes[own].max())
            columns = np.arange(wide)
            real = columns < sizes[own][:, None]
            cells = order[np.where(real, starts[own][:, None] + columns, 0)]
            self.groups.append((own, np.where(real, place[cells], -1), np.where(real, repeats[cells], 0)))
            at = end


class Tables:
    """The asked postings of a block with the sparse table of their largest values."""

    def __init__(self, ids, lengths, terms, counts, places, tf, asked: Asked):
        self.ids, n = ids, max(asked.n_terms, 1)
        found = np.searchsorted(asked.terms, terms)
        found = np.minimum(found, len(asked.terms) - 1)
        own = np.flatnonzero(asked.terms[found] == terms)
        begins = np.cumsum(counts) - counts
        take = ragged(begins[own], counts[own])
        self.docs, tf = places[take].astype(np.int64), tf[take].astype(np.int64)
        term = np.repeat(found[own], counts[own])
        m = 100 - 25 + (25 * lengths.astype(np.int64) * asked.n_docs) // n
        impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[self.docs])
        self.value = asked.weight[term] * impact
        self.key = term * len(ids) + self.docs
        self.from_, self.to = np.zeros(len(asked.terms), np.int64), np.zeros(len(asked.terms), np.int64)
        ends = np.cumsum(counts[own])
        self.from_[found[own]], self.to[found[own]] = ends - counts[own], ends
        size, longest = len(self.value), int(counts[own].max(initial=1))
        levels = longest.bit_length()
        best = np.arange(size, dtype=np.int32)
        self.best = np.zeros((levels, size), np.int32)
        self.best[0] = best
        for level in range(1, levels):
            half = 1 << (level - 1)
            left, right = best[: len(best) - half], best[half:]
            best = np.where(self.value[right] > self.value[left], right, left)
            self.best[level, : len(best)] = best
        self.log = np.zeros(longest + 1, np.int64)
        self.log[1:] = np.floor(np.log2(np.arange(1, longest + 1))).astype(np.int64)

    def bounds(self, left: np.ndarray, right: np.ndarray, repeats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Summed largest values of the posting ranges of each interval, and the split document."""
        held = right > left
        level = self.log[right - left]
        a = self.best[level, np.where(held, left, 0)]
        b = self.best[level, np.where(held, right - (1 << level), 0)]
        best = np.where(self.value[b] > self.value[a], b, a)
        adds = np.where(held, repeats * self.value[best], 0)
        most = adds.argmax(1)
        return adds.sum(1), self.docs[best[np.arange(len(best)), most]]


class Found:
    """The best k of every item so far: scores fall, ids rise where scores are equal."""

    def __init__(self, n: int, k: int):
        self.score = np.zeros((n, k), np.int64)
        self.ids = np.full((n, k), -(1 << 63), np.int64)

    def hopeful(self, items: np.ndarray, bound: np.ndarray, least_id: np.ndarray) -> np.ndarray:
        last, last_id = self.score[items, -1], self.ids[items, -1]
        return (bound > last) | ((bound == last) & (least_id < last_id))

    def add(self, items: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        fit = self.hopeful(items, score, ids)
        items, score, ids = items[fit], score[fit], ids[fit]
        own, k = np.unique(items), self.score.shape[1]
        who = np.concatenate([np.repeat(own, k), items])
        score = np.concatenate([self.score[own].ravel(), score])
        ids = np.concatenate([self.ids[own].ravel(), ids])
        order = np.lexsort((ids, -score, who))
        who = who[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        first = order[place < k]
        self.score[own], self.ids[own] = score[first].reshape(-1, k), ids[first].reshape(-1, k)


def rank_block(tables: Tables, asked: Asked, found: Found) -> int:
    """Search one block for all items; returns how many documents were scored in full."""
    scored, size = 0, len(tables.ids)
    if not len(tables.value):
        return 0
    for own, terms, repeats in asked.groups:
        real = terms >= 0
        left = np.where(real, tables.from_[terms], 0)
        right = np.where(real, tables.to[terms], 0)
        item = np.arange(len(own))
        low, high = np.zeros(len(own), np.int64), np.full(len(own), size)
        bound, split = tables.bounds(left, right, repeats)
        while True:
            keep = found.hopeful(own[item], bound, tables.ids[np.minimum(low, size - 1)])
            order = np.flatnonzero(keep)
            if not len(order):
                break
            order = order[np.lexsort((low[order], -bound[order], item[order]))]
            who = item[order]
            next_ = (np.arange(len(who)) - np.searchsorted(who, who)) < WIDE
            now, later = order[next_], order[~next_]
            scored += len(now)
            i, d, a, b = item[now], split[now], left[now], right[now]
            pos = np.where(terms[i] >= 0, np.searchsorted(tables.key, np.maximum(terms[i], 0) * size + d[:, None]), a)
            pos = np.clip(pos, a, b)
            hit = (pos < b) & (tables.docs[np.minimum(pos, len(tables.docs) - 1)] == d[:, None])
            score = np.where(hit, repeats[i] * tables.value[np.minimum(pos, len(tables.docs) - 1)], 0).sum(1)
            found.add(own[i], score, tables.ids[d])
            sides = [(a, pos, low[now], d), (pos + hit, b, d + 1, high[now])]
            new = [np.concatenate(x) for x in zip(*sides, strict=True)]
            two = np.concatenate([i, i])
            top, at = tables.bounds(new[0], new[1], repeats[two])
            left, right = np.concatenate([left[later], new[0]]), np.concatenate([right[later], new[1]])
            low, high = np.concatenate([low[later], new[2]]), np.concatenate([high[later], new[3]])
            item, bound, split = np.concatenate([item[later], two]), np.concatenate([bound[later], top]), np.concatenate([split[later], at])
    return scored


def _arrays(batch: pa.RecordBatch, i: int) -> list[np.ndarray]:
    return [batch.column(c)[i].values.to_numpy() for c in ("ids", "lengths", "terms", "counts", "places", "tf")]


def frequencies(index: DataFrame, asked: np.ndarray) -> dict[int, int]:
    """Documents that hold each asked term; the answer is bounded by the bundle."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(asked), np.int64)
        for batch in batches:
            terms, counts = (batch.column(c).flatten().to_numpy() for c in ("terms", "counts"))
            place = np.minimum(np.searchsorted(asked, terms), len(asked) - 1)
            held = asked[place] == terms
            total += np.bincount(place[held], weights=counts[held], minlength=len(asked)).astype(np.int64)
        held = np.flatnonzero(total)
        yield pa.record_batch({"term": asked[held], "n": total[held]})

    parts = index.select("terms", "counts").mapInArrow(counted, "term long, n long")
    return dict(parts.groupBy("term").agg(F.sum("n")).collect())


def _ranked(index: DataFrame, asked: Asked, k: int) -> DataFrame:
    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Found(len(asked.rows), k)
        for batch in batches:
            for i in range(batch.num_rows):
                rank_block(Tables(*_arrays(batch, i), asked), asked, found)
        item, place = np.nonzero(found.score)
        part = np.full(len(item), TaskContext.get().partitionId())
        score, ids = found.score[item, place], found.ids[item, place]
        yield pa.record_batch({"row": asked.rows[item], "item_id": asked.item_ids[item], "part": part, "score": score, "doc_id": ids})

    kinds = "row long, item_id long, part long, score long, doc_id long"
    best = index.mapInArrow(ranked, kinds).withColumn("part", F.col("part") % 64)
    order = [F.desc("score"), F.asc("doc_id")]
    return top_k(top_k(best, ["row", "part"], order, k), ["row"], order, k)


def search(index: DataFrame, items: DataFrame, k: int = TOP, asked: int = ASKED) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every row of ``items`` in a
    written ``index``; bundles of some ``asked`` terms are searched one after another."""
    spark = index.sparkSession
    n_docs, n_terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    listed = settle(item_terms(items), "asked")
    bundles = max(1, -(-listed.count() // asked))
    out = None
    for bundle in range(bundles):
        rows = listed.where(F.pmod(F.xxhash64("row"), F.lit(bundles)) == bundle).toPandas()
        columns = [rows[c].to_numpy() for c in ("row", "item_id", "term", "repeats")]
        known = frequencies(index, np.unique(columns[2])) if len(rows) else {}
        if known:
            own = settle(_ranked(index, Asked(*columns, n_docs, n_terms, known), k), "ranked")
            out = own if out is None else out.unionByName(own)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    id_of = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return out.select(id_of("item_id"), F.col("rank").cast("int").alias("rank"), id_of("doc_id"), "score")


QUERY = "op12_lexical_search"


def query(spark: SparkSession, folder: str) -> DataFrame:
    index = settle(build_index(table(spark, folder, "documents")), "index", a_file=1)
    return search(index, table(spark, folder, "benchmark"))


ORACLE_SQL = r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
), items AS (
  SELECT item_id, row_number() OVER () AS i, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS word FROM benchmark
), asked AS (
  SELECT item_id, i, word, count(*) AS q FROM items GROUP BY item_id, i, word
), sizes AS (
  SELECT r, doc_id, CAST(len(words) AS BIGINT) AS n FROM docs WHERE len(words) > 0
), totals AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes
), held AS (
  SELECT r, word, count(*) AS tf FROM (SELECT r, unnest(words) AS word FROM docs) WHERE word IN (SELECT word FROM asked) GROUP BY r, word
), weights AS (
  SELECT word, CAST(floor(1000e0 * ln(CAST(2 * (SELECT docs FROM totals) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held GROUP BY word
), scores AS (
  SELECT a.item_id, a.i, s.doc_id, s.r, CAST(sum(a.q * g.w * ((1000000000 * h.tf) // (1000 * h.tf + 12 * (100 - 25 + (25 * s.n * t.docs) // t.terms)))) AS BIGINT) AS score
  FROM asked a JOIN weights g USING (word) JOIN held h USING (word) JOIN sizes s USING (r), totals t
  GROUP BY a.item_id, a.i, s.doc_id, s.r
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id, r) AS rank FROM scores WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
