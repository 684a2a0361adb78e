"""Near-duplicate detection by circulant MinHash (Li and Li 2022) with exact verification.

Two permutations of the 32-bit numbers make all coordinates of a signature: the first
scatters the shingles, the second, shifted by one more place for every coordinate and
wrapping around, gives the values whose minimum is kept. 48 bands of 6 coordinates find a
pair of similarity 0.8 but for 5 in 10 million; every candidate is verified on full sets.

1. One pass over the whole texts: set size, a 128-bit digest of the set, 48 band keys.
2. Documents of one digest are one node, named by the least doc_id. Copies go no further.
3. Every bucket of a band key has a centre, the node whose buckets are fullest, so one of
   the least changed copies. Nodes are compared with their best centre, then with those
   centres that are not yet in their component; verified links are joined.
4. A node apart from a centre may still be like another node of that centre. Both differ
   from a common reference R (the centre and what most of its nodes add): u lacks M of R and
   adds E. Two sets are similar iff |D(u) ^ D(y)| <= b, D = M + E, b = (|u| + |y|) (100 - p) /
   (100 + p). As they share at most min(m, m') lacks, either e + e' + |m - m'| <= b, or they
   share additions, enough of them. Only such pairs are verified: the others cannot be links.

So every candidate pair is verified, excluded by this bound, or linked through others.

Defined results: null or white texts have the empty set, are linked with nothing and kept;
a text of fewer words than a shingle is one shingle; rows that share a doc_id are versions
of one document; a null id takes part only as a copy, its component is the least id of the
texts equal to it, or null; repeated rows are judged alike; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turfline.llm.common import mix64, row_key, signed, table, words_of
from turfline.llm.components import components
from turfline.session import settle

BANDS, ROWS = 48, 6
WIDTH, PERCENT = 5, 80
COLUMNS = 2048


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    step = np.uint64(0x9FB21C651E98DF25)
    for first, end, words, rows in words_of(texts):
        bounds = np.searchsorted(rows, np.arange(end - first + 1))
        with np.errstate(over="ignore"):
            n = max(len(words) - width + 1, 0)
            runs = np.zeros(n, np.uint64)
            for j in range(width):
                runs = runs * step + words[j : j + n]
            runs = mix64(runs + np.uint64(width))
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if b - a >= width:
                    yield np.unique(runs[a : b - width + 1])
                elif b > a:
                    whole = np.uint64(0)
                    for w in words[a:b]:
                        whole = whole * step + w
                    yield mix64(np.array([whole + np.uint64(b - a)], np.uint64))
                else:
                    yield np.zeros(0, np.uint64)


def _scatter(x: np.ndarray) -> None:
    """A bijection of the 32-bit numbers, in place."""
    spare = np.empty_like(x)
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        np.multiply(x, np.uint32(factor), out=x)
    np.right_shift(x, np.uint32(16), out=spare)
    np.bitwise_xor(x, spare, out=x)


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """Minima of the second permutation over the scattered shingles, one shift each."""
    base = shingles.astype(np.uint32)
    _scatter(base)
    shifts = np.arange(size, dtype=np.uint32)[:, None]
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(base), COLUMNS):
        values = base[None, at : at + COLUMNS] + shifts
        _scatter(values)
        np.minimum(out, values.min(axis=1), out=out)
    return out


def band_keys(coordinates: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band, the band's number included."""
    grid, keys = coordinates.reshape(bands, rows).astype(np.uint64), np.arange(bands, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(rows):
            keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + grid[:, j])
    return keys


def _profiled(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, keys, known = [], [], [], {}
            for shingles in shingle_sets(batch.column("text"), width):
                digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
                if digest not in known:
                    known[digest] = band_keys(signature(shingles, bands * rows), bands, rows) if len(shingles) else np.zeros(0, np.uint64)
                sizes.append(len(shingles))
                digests.append(digest)
                keys.append(known[digest])
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = pa.array(signed(np.concatenate([*keys, np.zeros(0, np.uint64)])), pa.int64())
            columns = [
                batch.column("uid"), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                pa.ListArray.from_arrays(pa.array(offsets), flat),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["uid", "doc_id", "n_shingles", "digest", "bands"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([s.tobytes() for s in shingle_sets(batch.column("text"), width)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sets], ["node", "shingles"])

    return run


def _compared(extras: bool):
    """Sizes and overlap of each pair; on request what the first set adds to the second."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, others, shared, added = [], [], [], []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                sizes.append(len(x))
                others.append(len(y))
                shared.append(int(np.count_nonzero(both[1:] == both[:-1])))
                if extras:
                    added.append(signed(np.setdiff1d(x, y, assume_unique=True)))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(e) for e in added])]).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*added, np.zeros(0, np.int64)]))) if extras else pa.nulls(len(sizes), pa.list_(pa.int64()))
            numbers = [pa.array(c, pa.int64()) for c in (sizes, others, shared)]
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), *numbers, lists], ["u", "v", "nu", "nv", "shared", "extras"])

    return run


def compared(pairs: DataFrame, sets: DataFrame, extras: bool = False) -> DataFrame:
    """(u, v, nu, nv, shared, extras) of the pairs (u, v), from full sets. Settled."""
    first = pairs.select("u", "v").join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u")
    both = first.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v").select("u", "v", "a", "b")
    return settle(both.mapInArrow(_compared(extras), "u long, v long, nu long, nv long, shared long, extras array<long>"), "compared")


def similar(rows: DataFrame, percent: int) -> DataFrame:
    """The links (u, v) among compared pairs."""
    return rows.where(100 * F.col("shared") >= percent * (F.col("nu") + F.col("nv") - F.col("shared"))).select("u", "v")


def labelled(rows: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
    """Add the component of a node column; a node without links is its own."""
    own = labels.select(F.col("node").alias(node), F.col("component").alias(name))
    return rows.join(own, node, "left").withColumn(name, F.coalesce(name, node))


def hidden_pairs(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of nodes of one centre that may be links though one is apart from the
    centre; ``stars`` has (node, centre, own, at): components of node and centre."""
    apart = F.col("own") != F.col("at")
    open_centres = stars.where(apart).select("centre").distinct()
    near = settle(stars.join(open_centres, "centre", "left_semi").withColumn("apart", apart), "open")
    seen = compared(near.select(F.col("node").alias("u"), F.col("centre").alias("v")), sets, extras=True)
    added = seen.select(F.col("v").alias("centre"), F.col("u").alias("node"), F.explode("extras").alias("s"))
    crowd = near.groupBy("centre").agg(F.count("*").alias("nodes"))
    common = added.groupBy("centre", "s").agg(F.count("*").alias("times")).where("times > 1").join(crowd, "centre")
    common = settle(common.where(2 * F.col("times") > F.col("nodes")).select("centre", "s"), "common")
    of_all = common.groupBy("centre").agg(F.count("*").alias("all"))
    of_node = added.join(common, ["centre", "s"]).groupBy("centre", "node").agg(F.count("*").alias("has"))
    facts = near.join(seen.select(F.col("v").alias("centre"), F.col("u").alias("node"), "nu", "nv", "shared"), ["centre", "node"])
    facts = facts.join(of_all, "centre", "left").join(of_node, ["centre", "node"], "left").fillna(0, ["all", "has"])
    lacks = F.col("nv") - F.col("shared") + F.col("all") - F.col("has")
    facts = settle(
        facts.select("centre", "node", "own", "apart", F.col("nu").alias("n"), lacks.alias("m"), (F.col("nu") - F.col("shared") - F.col("has")).alias("e")),
        "facts",
    )
    u, y = F.col("x"), F.col("y")
    bound = (u["n"] + y["n"]) * (100 - percent) / (100 + percent) + 1e-9
    open_pair = (u["own"] != y["own"]) & (~y["apart"] | (u["node"] < y["node"]))
    whole = F.struct("node", "own", "apart", "n", "m", "e")
    left, right = facts.where("apart").select("centre", whole.alias("x")), facts.select("centre", whole.alias("y"))
    close = left.join(right, "centre").where(open_pair & (u["e"] + y["e"] + F.abs(u["m"] - y["m"]) <= bound))
    rare = added.join(common, ["centre", "s"], "left_anti").join(facts, ["centre", "node"])
    left, right = rare.where("apart").select("centre", "s", whole.alias("x")), rare.select("centre", "s", whole.alias("y"))
    needed = (u["m"] + u["e"] + y["m"] + y["e"] - bound) / 2 - F.least(u["m"], y["m"])
    # Two nodes share at most the lesser number of additions.
    possible = open_pair & (needed <= F.least(u["e"], y["e"]))
    both = left.join(right, ["centre", "s"]).where(possible).groupBy("centre", "x", "y").agg(F.count("*").alias("times"))
    both = both.where(F.col("times") >= needed)
    pick = [F.col("x.node").alias("u"), F.col("y.node").alias("v")]
    return close.select(*pick).union(both.select(*pick)).distinct()


def near_duplicates(
    docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """Per row of ``docs``: uid (key of id and text), doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = docs.select(row_key().alias("uid"), "doc_id", F.col("text").cast("binary").alias("text"))
    shape = "uid long, doc_id long, n_shingles long, digest binary, bands array<long>"
    profiles = settle(texts.mapInArrow(_profiled(width, bands, rows), shape), "profiles")
    linked = profiles.where("n_shingles > 0")
    groups = linked.groupBy("digest").agg(F.min("doc_id").alias("node"), F.min("uid").alias("first_uid"), F.first("bands").alias("bands"))
    groups = settle(groups, "groups")
    filed = groups.where(F.col("node").isNotNull()).select("node", F.explode("bands").alias("key"))
    full = filed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = settle(filed.join(full, "key"), "members")
    weights = members.groupBy("node").agg(F.sum("size").alias("weight"))
    heaviest = F.max_by("node", F.struct("weight", -F.col("node")))
    centres = members.join(weights, "node").groupBy("key").agg(heaviest.alias("centre"), F.max("weight").alias("pull"))
    stars = members.join(centres, "key").where("node <> centre").select("node", "centre", "pull").distinct()
    stars = settle(stars, "stars")

    nodes = stars.select(F.col("node").alias("doc_id")).union(stars.select(F.col("centre").alias("doc_id"))).distinct()
    # A merge join at any size: the nodes grow with the documents and are never broadcast.
    whole = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(nodes.hint("merge"), "doc_id", "left_semi")
    sets = settle(whole.mapInArrow(_sets(width), "node long, shingles binary"), "sets")
    best = stars.groupBy("node").agg(F.max_by("centre", F.struct("pull", -F.col("centre"))).alias("centre"))
    best = best.select(F.col("node").alias("u"), F.col("centre").alias("v"))
    links = similar(compared(best, sets), percent)
    labels = settle(components(links), "labels")
    for left_over in (False, True):
        named = settle(labelled(labelled(stars, labels, "node", "own"), labels, "centre", "at"), "named")
        if left_over:
            pairs = hidden_pairs(named, sets, percent)
        else:
            pairs = named.where("own <> at").select(F.col("node").alias("u"), F.col("centre").alias("v")).distinct()
        links = links.union(similar(compared(pairs, sets), percent))
        labels = settle(components(links), "labels")

    known = groups.join(labels, "node", "left").select("digest", "first_uid", F.coalesce("component", "node").alias("component_id"))
    joined = profiles.drop("bands").join(known, "digest", "left")
    alone = F.col("n_shingles") == 0
    joined = joined.withColumn("component_id", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")))
    kept = F.when(F.col("component_id").isNull(), alone | (F.col("uid") == F.col("first_uid"))).otherwise(
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    )
    return joined.select("uid", "doc_id", "n_shingles", "component_id", kept.alias("kept"))


def deduplicated(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, columns unchanged."""
    name = "_row_key_of_near_duplicates"
    kept = near_duplicates(docs, width, percent).where("kept").select(F.col("uid").alias(name)).distinct()
    own = docs.withColumn(name, row_key())
    return own.join(kept, name, "left_semi").dropDuplicates([name]).drop(name)


QUERY = "op6_circulant_minhash"


def query(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), width=4).drop("uid")


ORACLE_SQL = """
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), placed AS (
  SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM worded WHERE len(w) > 0
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS s FROM placed
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), reached AS (
  SELECT doc_id AS node, doc_id AS root FROM documents
  UNION
  SELECT l.v, r.root FROM reached r JOIN links l ON l.u = r.node WHERE r.root < l.v
)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, r.root AS component_id, d.doc_id = r.root AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
JOIN (SELECT node, min(root) AS root FROM reached GROUP BY node) r ON r.node = d.doc_id
"""
