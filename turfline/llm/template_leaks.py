"""Benchmark decontamination over canonical templates.

Words lose their outer punctuation and case; numbers, names and units become typed
placeholders that keep what they stood for as a slot. A name is a word with one capital at
its start that does not open a sentence; such a word that opens one, and a word with other
capitals (McDonald, NASA), may be a name or not, and windows with them are hashed in either
reading of each. A unit is a listed word right after a number, or the tail of one (5kg). Every window of ``WINDOW`` words of a benchmark item and of a
document has a 64-bit template hash. The hashes of all items mark a bit table of fixed size; document windows
that miss it cannot match, the others are hash-joined with the items' windows. Windows with
placeholders are also hashed as they stand, so that a copy in other capitals matches too.

An item leaks into a document if matched windows cover at least ``COVER`` of its words
along one alignment (up to ``DRIFT`` words of insertions or losses), and the slots agree:
the same benchmark value always has the same document value, except for at most a tenth of
the slots; if the readings as names spoil that, the other windows decide alone. So a question asked again with other numbers or names is caught, while mere
likeness of form is not; windows with fewer than ``PLAIN`` plain words prove nothing.

Items shorter than a window are one window of their own length. Defined results: null or
empty texts and items match nothing; null ids of documents are reported as null, of items
take no part; repeated rows are reported once; empty tables give an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turfline.llm.common import mix64, row_key, table
from turfline.session import settle

WINDOW, COVER, DRIFT, PLAIN = 6, 0.5, 8, 3
#: Bits of the table that document windows must hit; its size does not depend on the data.
MARKS = 23
NUMBER, NAME, UNIT = 1, 2, 3
FACTOR = np.uint64(0xD1342543DE82EF95)
#: Words taken as units after a number.
UNITS = set(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres "
    "mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours "
    "day days week weeks month months year years percent % $ usd eur dollar dollars cent cents euro euros "
    "mph kmh c f degrees".split()
)
NUMERAL = re.compile(r"(\d+(?:[.,:/]\d+)*)-?(\w*)")
OUTER = re.compile(r"^\W+|\W+$")
ENDS = (".", "!", "?", ":", "|")
MARKS_AROUND = ".,;:!?*#&|\"'()"
#: Texts whose words are canonicalised at once.
TOGETHER = 1 << 20


class Words(dict):
    """Chunk -> number of its entry (hash, kind, whether a sentence ends, plain form).

    Kinds: 0 plain, NUMBER, NAME if not at the start of a sentence, UNIT if after a number,
    CAPITALS for a word that may be a name, GLUED for a number with its unit attached, EMPTY without any letter or digit."""

    EMPTY, CAPITALS, GLUED, KEPT = -1, 8, 9, 250_000

    def __init__(self):
        super().__init__()
        #: What a placeholder can stand for; None for plain words, which take no slot.
        self.plain: list[str | None] = []
        self.new: list[tuple[int, int, bool]] = []
        self.known = 0
        self.arrays = np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, np.int8), np.zeros(1 << 14, bool)

    def __missing__(self, chunk: str) -> int:
        core, ends = chunk, False
        if not chunk.isalnum():
            core = chunk.strip(MARKS_AROUND)
            core = core if core.isalnum() else OUTER.sub("", core)
            ends = chunk.rstrip("*#$%&\"')]}").endswith(ENDS)
        kind, plain = 0, core.casefold()
        if not core:
            kind = self.EMPTY
        elif core[0].isdigit() and (found := NUMERAL.fullmatch(core)):
            after = chunk[chunk.index(core) + len(core) :][:1]
            if found[2].casefold() in UNITS or (after == "%" and not found[2]):
                kind = self.GLUED
            elif not found[2]:
                kind = NUMBER
        elif plain in UNITS:
            kind = UNIT
        elif core[0].isupper() and core[1:].islower():
            kind = NAME
        elif len(core) > 1 and core[0].isupper():
            kind = self.CAPITALS
        self[chunk] = number = len(self.plain)
        self.plain.append(plain if kind > 0 else None)
        self.new.append((xxhash.xxh64_intdigest(plain.encode("utf-8", "surrogatepass")), kind, ends))
        return number

    def facts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, kinds and sentence ends of all entries; only new ones are filled in."""
        while len(self.plain) > len(self.arrays[0]):
            self.arrays = tuple(np.concatenate([x, np.zeros_like(x)]) for x in self.arrays)
        if self.new:
            for column, array in enumerate(self.arrays):
                array[self.known : len(self.plain)] = [r[column] for r in self.new]
            self.known = len(self.plain)
            self.new.clear()
        return self.arrays


def canonical(texts: list[str | None], words: Words) -> tuple[np.ndarray, ...]:
    """(template codes, kinds, entries, rows, literal codes) of the words of all texts."""
    entry, opens, sizes = [], [], np.zeros(len(texts), np.int64)
    for row, text in enumerate(texts):
        before = len(entry)
        for line in (text or "").split("\n"):
            opens.append(len(entry))
            entry += map(words.__getitem__, line.split())
        sizes[row] = len(entry) - before
    entry, rows = np.array(entry, np.int64), np.repeat(np.arange(len(texts)), sizes)
    opens = [o for o in opens if o < len(entry)]
    hashes, kind_of, ends_of = words.facts()
    if not len(entry):
        return np.zeros(0, np.uint64), entry, entry, rows, np.zeros(0, np.uint64)
    codes, kinds = hashes[entry], kind_of[entry]
    start = np.zeros(len(entry), bool)
    start[opens] = True
    before = np.concatenate([[0], kinds[:-1]])
    before[start] = 0
    start[1:] |= ends_of[entry[:-1]]
    kinds = np.where(((kinds == NAME) & start) | (kinds == Words.CAPITALS), 0, kinds)
    kinds = np.where((kinds == UNIT) & (before != NUMBER), 0, kinds)
    glued = kinds == Words.GLUED
    if glued.any():  # a number with its unit attached reads as the number, then the unit
        times = np.where(glued, 2, 1)
        tail = np.zeros(int(times.sum()), bool)
        tail[np.cumsum(times)[glued] - 1] = True
        codes, kinds, entry, rows = (np.repeat(x, times) for x in (codes, kinds, entry, rows))
        kinds = np.where(tail, UNIT, np.where(kinds == Words.GLUED, NUMBER, kinds))
    solid = kinds != Words.EMPTY
    codes, kinds, entry, rows = codes[solid], kinds[solid], entry[solid], rows[solid]
    return np.where(kinds > 0, kinds.astype(np.uint64), codes), kinds, entry, rows, codes


def may_be_names(kinds: np.ndarray, entries: np.ndarray, words: Words) -> np.ndarray:
    """Plain words that would be names elsewhere or are written in other capitals."""
    if not len(entries):
        return np.zeros(0, bool)
    own = words.facts()[1][entries]
    return (kinds == 0) & ((own == NAME) | (own == Words.CAPITALS))


def window_hashes(
    codes: np.ndarray, kinds: np.ndarray, rows: np.ndarray, literal: np.ndarray, maybe: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first words, whether literal, bits of the words read as names) of the windows of
    ``width`` words: as templates if they hold enough plain words, in all readings of the words
    that may be names, and as they stand if they hold placeholders."""
    n = max(len(codes) - width + 1, 0)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
    plain, bits = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for j in range(width):
        plain += kinds[j : j + n] == 0
        bits |= maybe[j : j + n].astype(np.int64) << j
    inside = rows[:n] == rows[width - 1 :]

    def runs(mixed: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(width):
                out = out * FACTOR + mixed[at + j]
        return out

    shapes, exact = np.flatnonzero(inside & (plain >= PLAIN)), np.flatnonzero(inside & (plain < width) & (width >= PLAIN))
    mixed = mix64(codes)
    found, places, masks = [runs(mixed, shapes)], [shapes], [np.zeros(len(shapes), np.int64)]
    some = np.flatnonzero((bits[shapes] > 0) & (plain[shapes] > PLAIN))
    first, base, own, spare = shapes[some], found[0][some], bits[shapes[some]], plain[shapes[some]] - PLAIN
    name = mix64(np.array([NAME], np.uint64))[0]
    for mask in range(1, 1 << width) if len(some) else ():
        where = [j for j in range(width) if mask >> j & 1]
        if len(where) > width - PLAIN:
            continue
        read = np.flatnonzero(((own & mask) == mask) & (spare >= len(where)))
        if not len(read):
            continue
        hashes, at = base[read], first[read]
        with np.errstate(over="ignore"):
            for j in where:  # a run is a polynomial, so a word is exchanged by its term
                hashes = hashes + (name - mixed[at + j]) * np.uint64(pow(int(FACTOR), width - 1 - j, 1 << 64))
        found.append(hashes)
        places.append(at)
        masks.append(np.full(len(read), mask, np.int64))
    found.append(runs(mix64(literal), exact))
    places.append(exact)
    masks.append(np.zeros(len(exact), np.int64))
    places = np.concatenate(places)
    with np.errstate(over="ignore"):
        hashes = mix64(np.concatenate(found) + np.uint64(width))
    return hashes, places, np.repeat([False, True], [len(places) - len(exact), len(exact)]), np.concatenate(masks)


def _slots(kinds: np.ndarray, entries: np.ndarray, words: Words, at: int, width: int, mask: int = 0) -> list[str]:
    """What the placeholders of a window stand for; the words of ``mask`` are names."""
    out = []
    for j, (k, e) in enumerate(zip(kinds[at : at + width], entries[at : at + width], strict=True)):
        if k > 0 or mask >> j & 1:
            out.append(f"{k if k > 0 else NAME}{words.plain[e]}")
    return out


ITEMS = "item_id long, n_words int, place int, width int, hash long, item_named boolean, slots array<string>"


def _item_windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        words, out = Words(), []
        codes, kinds, entries, rows, literal = canonical(frame["text"].tolist(), words)
        maybe = may_be_names(kinds, entries, words)
        bounds = np.searchsorted(rows, np.arange(len(frame) + 1))
        for item, a, b in zip(frame["item_id"], bounds[:-1], bounds[1:], strict=True):
            width = min(WINDOW, b - a)
            found = window_hashes(codes[a:b], kinds[a:b], rows[a:b], literal[a:b], maybe[a:b], width) if width else ([], [], [], [])
            for h, at, exact, mask in zip(*found, strict=True):
                slots = [] if exact else _slots(kinds, entries, words, a + at, width, int(mask))
                out.append((item, b - a, at, width, int(h.view(np.int64)), mask > 0, slots))
        yield pd.DataFrame(out, columns=["item_id", "n_words", "place", "width", "hash", "item_named", "slots"])


def bit_table(windows: DataFrame) -> np.ndarray:
    """Bits of the item windows, by the leading bits of their hashes: 2^MARKS bits at any size."""
    mark = F.shiftrightunsigned("hash", 64 - MARKS)
    bits = windows.select(F.shiftright(mark, 6).alias("cell"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - MARKS}) & 63 as int))").alias("bit"))
    table = np.zeros(1 << (MARKS - 6), np.int64)
    for row in bits.groupBy("cell").agg(F.bit_or("bit").alias("bits")).collect():
        table[row["cell"]] = row["bits"]
    return table.view(np.uint64)


HITS = "uid long, doc_id long, at int, hash long, named boolean, slots array<string>"


def _matched(shared, widths: list[int]):
    """Document windows whose bit is set, with their slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, words = shared.value, Words()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            uids, ids = batch.column("uid").to_pylist(), batch.column("doc_id").to_pylist()
            first = 0
            while first < len(texts):
                end, size = first, 0
                while end < len(texts) and (end == first or size + len(texts[end] or "") <= TOGETHER):
                    size += len(texts[end] or "")
                    end += 1
                if len(words.plain) > Words.KEPT:
                    words = Words()
                codes, kinds, entries, rows, literal = canonical(texts[first:end], words)
                maybe = may_be_names(kinds, entries, words)
                starts, out = np.searchsorted(rows, np.arange(end - first)), []
                for width in widths:
                    hashes, places, exact, masks = window_hashes(codes, kinds, rows, literal, maybe, width)
                    marks = hashes >> np.uint64(64 - MARKS)
                    hit = (table[(marks >> np.uint64(6)).astype(np.int64)] >> (marks & np.uint64(63))) & np.uint64(1)
                    for i in np.flatnonzero(hit):
                        at = int(places[i])
                        row = int(rows[at])
                        slots = [] if exact[i] else _slots(kinds, entries, words, at, width, int(masks[i]))
                        out.append((uids[first + row], ids[first + row], at - int(starts[row]), int(hashes[i].view(np.int64)), bool(masks[i]), slots))
                if out:
                    kinds_of = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.list_(pa.string())]
                    columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds_of, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, ["uid", "doc_id", "at", "hash", "named", "slots"])
                first = end

    return run


def agreement(asked: list[list[str]], found: list[list[str]]) -> tuple[float, int]:
    """(share of slots that follow the commonest value for their benchmark value, changed values)."""
    seen: dict[str, dict[str, int]] = {}
    for a, b in zip(asked, found, strict=True):
        for x, y in zip(a, b, strict=True):
            own = seen.setdefault(x, {})
            own[y] = own.get(y, 0) + 1
    total = sum(sum(v.values()) for v in seen.values())
    best = {x: max(v, key=lambda y: (v[y], y)) for x, v in seen.items()}
    return (sum(v[best[x]] for x, v in seen.items()) / total if total else 1.0), sum(x != y for x, y in best.items())


LEAKS = "doc_id long, item_id long, coverage double, changed_slots int, first_word int, last_word int"


def _aligned(frame: pd.DataFrame, cover: float) -> tuple[float, int, int, int] | None:
    """(coverage, changed slots, first, last word) of the best alignment, if it is a leak."""
    frame = frame.assign(n=-frame["slots"].map(len)).sort_values("n", kind="stable").drop_duplicates(["at", "place", "width"])
    shift = (frame["at"] - frame["place"]).to_numpy()
    frame = frame.iloc[np.lexsort((frame["at"], shift))]
    shift = np.sort(shift)
    n, width = int(frame["n_words"].iloc[0]), int(frame["width"].iloc[0])
    places, best = frame["place"].to_numpy(), None
    for a in np.unique(np.searchsorted(shift, np.unique(shift))):
        b = int(np.searchsorted(shift, shift[a] + DRIFT, side="right"))
        marked = np.zeros(n, bool)
        for j in range(width):
            marked[places[a:b] + j] = True
        share = marked.mean()
        if share >= cover and (best is None or share > best[0]):
            same, changed = agreement(frame["asked"].iloc[a:b].tolist(), frame["slots"].iloc[a:b].tolist())
            if same >= 0.9:
                at = frame["at"].iloc[a:b]
                best = (float(share), changed, int(at.min()), int(at.max()) + width - 1)
    return best


def _judged(cover: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """The best alignment of one item in one document, if it is a leak: of the windows without
        words read as names, or of all windows where that covers more."""
        named = (frame["named"] | frame["item_named"]).to_numpy()
        best = None if named.all() else _aligned(frame[~named], cover)
        if named.any() and (best is None or best[0] < 1) and (more := _aligned(frame, cover)) and (best is None or more[0] > best[0]):
            best = more
        rows = [] if best is None else [(frame["doc_id"].iloc[0], frame["item_id"].iloc[0], *best)]
        out = pd.DataFrame(rows, columns=["doc_id", "item_id", "coverage", "changed_slots", "first_word", "last_word"])
        return out.assign(uid=frame["uid"].iloc[0])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, cover: float = COVER) -> DataFrame:
    """One row per document and leaked item, items of one text by their least id:
    uid, doc_id, item_id, coverage, changed_slots, first_word, last_word."""
    spark = docs.sparkSession
    items = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    items = items.groupBy("text").agg(F.min("item_id").cast("long").alias("item_id"))
    windows = settle(items.select("item_id", "text").mapInPandas(_item_windows, ITEMS), "item-windows")
    widths = sorted(row["width"] for row in windows.select("width").distinct().collect())
    shared = spark.sparkContext.broadcast(bit_table(windows))
    texts = docs.select(row_key().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    hits = settle(texts.mapInArrow(_matched(shared, widths), HITS), "hits")
    asked = windows.withColumnRenamed("slots", "asked")
    met = hits.join(asked, "hash").where(F.size("asked") == F.size("slots"))
    return met.groupBy("uid", "item_id").applyInPandas(_judged(cover), f"{LEAKS}, uid long")


def decontaminated(docs: DataFrame, benchmark: DataFrame, cover: float = COVER) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item, columns unchanged."""
    name = "_row_key_of_leaks"
    bad = leaks(docs, benchmark, cover).select(F.col("uid").alias(name)).distinct()
    return docs.withColumn(name, row_key()).join(settle(bad, "leaks"), name, "left_anti").drop(name)


QUERY = "op10_template_leaks"


def query(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("uid")


ORACLE_SQL = None
