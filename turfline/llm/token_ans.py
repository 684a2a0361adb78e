"""Token ids as binary files under a static range asymmetric numeral system.

One frequency table, counted over all documents, is shared by all blocks. A block holds
whole consecutive documents, at least ``BLOCK`` ids, and is coded on its own: 32 lanes take
the ids in turn, each with a 64-bit state in [2^31, 2^63) that gives off 32-bit words.
Every 512 turns the states and the place in the words are kept as a checkpoint, from which
decoding can start; the ids behind each checkpoint and the block carry crc32 checksums.
Decoding runs all checkpoints of a batch of blocks side by side.

Files under a path: ``blocks`` (part, number, first, n_docs, n_tokens, frame), in ascending
id order over the parts; ``frequencies`` (id, frequency); ``parts`` (part, before), the ids
before each part. A frame is, little-endian: header, one null flag, id and length per
document, the checkpoints, the words, and the checksum of all that.

Defined results: a null text has the end id alone; null doc_ids come first; repeated rows
are each written; rows equal in id are ordered by a digest of their ids; an empty table
gives files without blocks. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turfline.llm.common import table
from turfline.llm.subwords import chunk_ids, word_tokenizer
from turfline.session import scratch_path, settle

END_ID = 2
LANES, BITS, TURNS, BLOCK = 32, 20, 512, 1 << 16
SYMBOLS = 1 << 16
LOW = np.uint64(1 << 31)
MAGIC = b"TLANS1\0\0"
HEADER = "<8sHBxIQIQI"
#: Ids that are coded or decoded side by side, padding included.
BATCH = 1 << 22


class Frequencies:
    """Quantised frequencies that sum to 2^BITS, with the lookup tables of both directions."""

    def __init__(self, frequency: np.ndarray):
        self.frequency = frequency
        cumulative = np.concatenate([[0], np.cumsum(frequency)[:-1]])
        # The last symbol is padding: it owns the whole range, so coding it changes nothing.
        self.f = np.append(frequency, 1 << BITS).astype(np.uint64)
        self.c = np.append(cumulative, 0).astype(np.uint64)
        self.symbol = np.repeat(np.arange(SYMBOLS, dtype=np.uint16), frequency)
        self.crc = zlib.crc32(frequency.astype("<u4").tobytes())

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Frequencies:
        """Every id that occurs keeps a frequency of 1 at least; the most frequent takes the rest."""
        total = max(int(counts.sum()), 1)
        scaled = np.maximum((counts > 0).astype(np.int64), np.floor(counts / total * (1 << BITS)).astype(np.int64))
        while (over := int(scaled.sum()) - (1 << BITS)) != 0:
            top = int(scaled.argmax())
            scaled[top] -= over if over < 0 else min(over, int(scaled[top] + 1) // 2)
        return cls(scaled)


def encode(blocks: list[np.ndarray], table: Frequencies) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per block of ids: (words, checkpoint states [n, LANES], checkpoint places)."""
    turns = np.array([-(-len(b) // LANES) for b in blocks])
    order = np.argsort(-turns, kind="stable")
    base, flat = np.zeros(len(blocks), np.int64), []
    at = 0
    for rank, i in enumerate(order):
        base[rank] = at
        padded = np.full(turns[i] * LANES, SYMBOLS, np.int32)
        padded[: len(blocks[i])] = blocks[i]
        flat.append(padded)
        at += len(padded)
    flat = np.concatenate(flat)
    most, lanes, ranked = int(turns.max()), np.arange(LANES), turns[order]
    state = np.full((len(blocks), LANES), LOW)
    words = np.zeros((most, len(blocks), LANES), np.uint32)
    given = np.zeros((most, len(blocks), LANES), bool)
    kept: dict[int, np.ndarray] = {}
    shift, word = np.uint64(BITS), np.uint64(32)
    for turn in range(most - 1, -1, -1):
        k = int(np.searchsorted(-ranked, -turn, side="left"))
        symbols = flat[base[:k, None] + turn * LANES + lanes]
        f, x = table.f[symbols], state[:k]
        full = x >= (f << np.uint64(63 - BITS))
        given[turn, :k] = full
        words[turn, :k] = x.astype(np.uint32)
        x = np.where(full, x >> word, x)
        q, r = np.divmod(x, f)
        state[:k] = (q << shift) + r + table.c[symbols]
        if turn % TURNS == 0:
            kept[turn // TURNS] = state[:k].copy()
    out: list = [None] * len(blocks)
    for rank, i in enumerate(order):
        used = given[: turns[i], rank]
        points = range(-(-int(turns[i]) // TURNS))
        upto = np.concatenate([[0], np.cumsum(used.sum(1))])
        out[i] = (words[: turns[i], rank][used], np.array([kept[p][rank] for p in points], np.uint64), np.array([upto[p * TURNS] for p in points], np.int64))
    return out


def decode(jobs: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], table: Frequencies) -> list[np.ndarray]:
    """Ids of each block from (words, states, places, n_tokens), all checkpoints side by side."""
    flat = np.concatenate([j[0] for j in jobs] + [np.zeros(1, np.uint32)]).astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum([len(j[0]) for j in jobs])])
    pieces = []
    for at, (_, states, places, n) in enumerate(jobs):
        for p in range(len(states)):
            own = min(n - p * TURNS * LANES, TURNS * LANES)
            after = states[p + 1] if p + 1 < len(states) else np.full(LANES, LOW)
            pieces.append((own, at, p, states[p], starts[at] + places[p], after))
    pieces.sort(key=lambda p: -p[0])
    n = np.array([p[0] for p in pieces])
    turns = -(-n // LANES)
    state = np.array([p[3] for p in pieces], np.uint64)
    place = np.array([p[4] for p in pieces], np.int64)
    lanes, most = np.arange(LANES), int(turns.max(initial=0))
    out = np.zeros((len(pieces), most, LANES), np.uint16)
    low_bits, shift, word = np.uint64((1 << BITS) - 1), np.uint64(BITS), np.uint64(32)
    for turn in range(most):
        k = int(np.searchsorted(-turns, -turn, side="left"))
        x = state[:k]
        slot = x & low_bits
        symbols = table.symbol[slot]
        y = table.f[symbols] * (x >> shift) + slot - table.c[symbols]
        live = turn * LANES + lanes < n[:k, None]
        wants = (y < LOW) & live
        rank = np.cumsum(wants, axis=1)
        read = flat[np.minimum(place[:k, None] + rank - 1, len(flat) - 1)]
        y = np.where(wants, (y << word) | read, y)
        state[:k] = np.where(live, y, x)
        place[:k] += rank[:, -1]
        out[:k, turn] = symbols
    ids: list[list] = [[None] * len(j[1]) for j in jobs]
    for i, (own, at, p, _, _, after) in enumerate(pieces):
        if not np.array_equal(state[i], after):
            raise ValueError("a checkpoint does not lead to the next one")
        ids[at][p] = out[i].reshape(-1)[:own]
    return [np.concatenate(parts) if parts else np.zeros(0, np.uint16) for parts in ids]


def pack_frame(doc_ids: list, lengths: list[int], ids: np.ndarray, coded, table: Frequencies) -> bytes:
    words, states, places = coded
    step = TURNS * LANES
    sums = [zlib.crc32(ids[p * step : (p + 1) * step].astype("<u4").tobytes()) for p in range(len(states))]
    body = b"".join(
        [
            struct.pack(HEADER, MAGIC, LANES, BITS, len(doc_ids), len(ids), len(states), len(words), table.crc),
            bytes(d is None for d in doc_ids),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array(lengths, "<u4").tobytes(),
            places.astype("<u8").tobytes(),
            np.array(sums, "<u4").tobytes(),
            states.astype("<u8").tobytes(),
            words.astype("<u4").tobytes(),
        ]
    )
    return body + struct.pack("<I", zlib.crc32(body))


def open_frame(frame: bytes, table: Frequencies) -> dict:
    if zlib.crc32(frame[:-4]) != struct.unpack("<I", frame[-4:])[0]:
        raise ValueError("block checksum differs")
    magic, lanes, bits, docs, n, points, words, crc = struct.unpack_from(HEADER, frame)
    if (magic, lanes, bits, crc) != (MAGIC, LANES, BITS, table.crc):
        raise ValueError("block of another format or frequency table")
    at = struct.calcsize(HEADER)

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(frame, kind, count, at)
        at += found.nbytes
        return found

    nulls = take("u1", docs)
    doc_ids = [None if z else int(d) for z, d in zip(nulls, take("<i8", docs), strict=True)]
    lengths, places, sums = take("<u4", docs), take("<u8", points).astype(np.int64), take("<u4", points)
    states = take("<u8", points * LANES).reshape(points, LANES)
    return {"doc_ids": doc_ids, "lengths": lengths, "sums": sums, "job": (take("<u4", words), states, places, n)}


def open_frames(frames: list[bytes], table: Frequencies) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(doc ids, lengths, ids) of each frame, checksums verified."""
    opened = [open_frame(f, table) for f in frames]
    step = TURNS * LANES
    for frame, ids in zip(opened, decode([f["job"] for f in opened], table), strict=True):
        for p, crc in enumerate(frame["sums"]):
            if zlib.crc32(ids[p * step : (p + 1) * step].astype("<u4").tobytes()) != crc:
                raise ValueError("checkpoint checksum differs")
        yield frame["doc_ids"], frame["lengths"], ids


def _tokenised(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = chunk_ids(path, END_ID)
        for batch in batches:
            ids = known.encode(batch.column(1)).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return run


def tokenised(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids as little-endian 16-bit bytes with the end id)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_tokenised(tokenizer), "doc_id long, ids binary")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS, np.int64)
    for batch in batches:
        for ids in batch.column(0):
            total += np.bincount(np.frombuffer(ids.as_buffer(), "<u2"), minlength=SYMBOLS) if len(ids.as_buffer()) > SYMBOLS else 0
        short = [i.as_buffer() for i in batch.column(0) if len(i.as_buffer()) <= SYMBOLS]
        total += np.bincount(np.frombuffer(b"".join(short), "<u2"), minlength=SYMBOLS)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["id", "n"])


def shared_frequencies(tokens: DataFrame) -> Frequencies:
    """The table over all documents; at most one row per id of the vocabulary is collected."""
    rows = tokens.select("ids").mapInArrow(_counted, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(SYMBOLS, np.int64)
    for row in rows:
        counts[row["id"]] = row["n"]
    return Frequencies.of_counts(counts)


FRAMES = "part int, number long, first long, n_docs long, n_tokens long, frame binary"


def _framed(frequency: np.ndarray):
    """Cut sorted documents into blocks and code the blocks of a batch side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part = Frequencies(frequency), TaskContext.get().partitionId()
        number = first = 0
        ready: list[tuple[list, list[int], np.ndarray]] = []

        def coded() -> pa.RecordBatch:
            nonlocal number, first
            rows = []
            for (docs, lengths, ids), block in zip(ready, encode([r[2] for r in ready], table), strict=True):
                rows.append((part, number, first, len(docs), len(ids), pack_frame(docs, lengths, ids, block, table)))
                number, first = number + 1, first + len(ids)
            ready.clear()
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, ["part", "number", "first", "n_docs", "n_tokens", "frame"])

        docs, texts, size = [], [], 0
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                docs.append(doc_id)
                texts.append(ids)
                size += len(ids) // 2
                if size >= BLOCK:
                    longest = max([size, *(len(r[2]) for r in ready)])
                    if ready and longest * (len(ready) + 1) > BATCH:
                        yield coded()
                    ready.append((docs, [len(t) // 2 for t in texts], np.frombuffer(b"".join(texts), "<u2")))
                    docs, texts, size = [], [], 0
        if docs:
            ready.append((docs, [len(t) // 2 for t in texts], np.frombuffer(b"".join(texts), "<u2")))
        if ready:
            yield coded()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Encode every text of ``docs`` and write the files under ``path``."""
    spark = docs.sparkSession
    tokens = settle(tokenised(docs, tokenizer or word_tokenizer()), "tokens")
    table = shared_frequencies(tokens)
    seen = np.flatnonzero(table.frequency)
    listed = [(int(i), int(table.frequency[i])) for i in seen]
    spark.createDataFrame(listed, "id int, frequency int").coalesce(1).write.parquet(f"{path}/frequencies")
    order = ["doc_id", "tie"]
    ranged = tokens.withColumn("tie", F.xxhash64("ids")).repartitionByRange(*order).sortWithinPartitions(*order, "ids")
    ranged.select("doc_id", "ids").mapInArrow(_framed(table.frequency), FRAMES).write.parquet(f"{path}/blocks")
    parts = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts.select("part", before.alias("before")).write.parquet(f"{path}/parts")


def read_frequencies(spark: SparkSession, path: str) -> Frequencies:
    frequency = np.zeros(SYMBOLS, np.int64)
    for row in spark.read.parquet(f"{path}/frequencies").collect():
        frequency[row["id"]] = row["frequency"]
    return Frequencies(frequency)


def _read(frequency: np.ndarray, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Frequencies(frequency)
        for batch in batches:
            parts, firsts, frames = (batch.column(i).to_pylist() for i in range(3))
            sizes = [struct.unpack_from(HEADER, f)[4] for f in frames]
            at = 0
            while at < len(frames):
                end, total = at, 0
                while end < len(frames) and (end == at or total + sizes[end] <= BATCH):
                    total += sizes[end]
                    end += 1
                rows = []
                opened = open_frames(frames[at:end], table)
                for part, first, (docs, lengths, ids) in zip(parts[at:end], firsts[at:end], opened, strict=True):
                    wide, spot = ids.astype("<u4"), 0
                    for doc, length in zip(docs, lengths.tolist(), strict=True):
                        own = wide[spot : spot + length].tobytes()
                        rows.append((doc, part, first + spot, length, zlib.crc32(own), own if with_ids else None))
                        spot += length
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "at", "n_tokens", "ids_crc32", "ids"])
                at = end

    return run


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids as little-endian 32-bit bytes) of the files."""
    table = read_frequencies(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks").select("part", "first", "frame")
    kinds = "doc_id long, part int, at long, n_tokens long, ids_crc32 long, ids binary"
    rows = blocks.mapInArrow(_read(table.frequency, with_ids), kinds)
    parts = spark.read.parquet(f"{path}/parts")
    found = rows.join(parts, "part").withColumn("start", F.col("before") + F.col("at"))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


QUERY = "op2_range_ans"


def query(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    write_tokens(table(spark, folder, "documents"), path)
    return read_tokens(spark, path, with_ids=False)


ORACLE_SQL = None
