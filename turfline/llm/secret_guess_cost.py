"""Secret scan: fixed patterns, and guess cost of values in a credential's place.

The guess cost of a value is the least number of guesses over all its segmentations into
words, dates, repeats, keyboard walks and brute-force spans (after Wheeler 2016), in decimal
digits and found by dynamic programming:

* a word costs its rank in the corpus' own dictionary, times variants of capitals and of
  look-alike characters;
* a date costs its days and forms; a repeat the cost of what repeats times the count;
* a walk is a chain of straight runs over neighbouring keys, or letters of the alphabet: it
  costs its start, and for each run its direction and length; the next run turns at the last
  key or starts beside the key where the last one started, and one of the same direction and
  length costs a choice of two;
* brute force costs a digit per character.

Every place, unit, count, run and part of a run takes part in the segmentation, so a walk or
date may also end early before another span.

A value that stands where a credential is named (password, pin, bearer, private key ...) and
that costs at least ``COSTLY`` digits becomes a span of kind ``guess``, unless a fixed
pattern has found it already. So placeholders such as "changeme" or "password2024" stay.

The dictionary is the ``DICTIONARY`` most frequent words of 3 to 24 letters of all
documents, counted in full; what it lacks is guessed otherwise. Positions are code points.

Defined results: null counts as the empty text and has no span; repeated rows are scanned
alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turfline.llm.common import table
from turfline.operators.ordering import row_index
from turfline.session import settle

DICTIONARY = 20_000
COSTLY = 10.0
KINDS = ["assign", "access", "hex", "guess"]
#: The patterns of the base kinds, and the least length of what they find.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{32,}")
CUES = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: What names a credential, and what may stand between two parts of a name.
NAMES = ("password", "passwd", "pwd", "passphrase", "passcode", "secret", "secret_?key", "token", "api_?key", "access_?key", "private_?key", "auth_?key", "credential", "credentials", "pin")
CONTEXT = re.compile(
    rf"""(?ai)(?<![a-z])(?:{"|".join(sorted(NAMES, key=len, reverse=True))})"""
    r"""["']?[\x20\t]*(?:[:=]+>?|\bis\b)[\x20\t]*["'`]?([^\s"'`,;<>]{6,})|(?<![a-z])bearer[\x20\t]+([^\s"'`,;<>]{12,})"""
)
#: Cheap test that ``CONTEXT`` can match: its names in both spellings, without those that hold another.
SPELLED = {n.replace("_?", x) for n in (*NAMES, "bearer") for x in ("", "_")}
CONTEXT_CUES = tuple(sorted(n for n in SPELLED if not any(m != n and m in n for m in SPELLED)))
#: Rows of a keyboard and other sequences that walks follow.
ROWS = ["`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz"]
LOOKS = str.maketrans("4@8310!5$7+2", "aabeloissttz")
SHIFTED = str.maketrans("~!@#$%^&*()_+{}|:\"<>?", "`1234567890-=[]\\;',./")


def _directions() -> dict[tuple[str, str], frozenset[str]]:
    """Directions in which one key follows another: along a row or the alphabet, or, on the
    keyboard, to one of the two touching keys of the next row."""
    out: dict[tuple[str, str], set[str]] = {}

    def link(a: str, b: str, name: str) -> None:
        out.setdefault((a, b), set()).add(f"{name}+")
        out.setdefault((b, a), set()).add(f"{name}-")

    for row, name in zip(ROWS, ["row", "row", "row", "row", "letter"], strict=True):
        for a, b in zip(row, row[1:], strict=False):
            link(a, b, name)
    grid = [ROWS[0][1:], *ROWS[1:4]]
    for upper, lower in zip(grid, grid[1:], strict=False):
        for i, a in enumerate(lower):
            for side, b in enumerate(upper[i : i + 2]):
                link(a, b, f"up{side}")
    return {pair: frozenset(names) for pair, names in out.items()}


DATE = re.compile(
    r"(?:(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01]))"
    r"|(?:(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|[12]\d|3[01])\2(?:(?:19|20)\d\d|\d\d))|(?:19|20)\d\d"
)


class GuessCost:
    """Least guess cost of a value, in decimal digits."""

    def __init__(self, ranked: list[str]):
        self.rank = {w: math.log10(i + 1) for i, w in enumerate(ranked)}
        self.longest = max(map(len, ranked), default=0)
        self.near = _directions()

    def words(self, value: str) -> Iterator[tuple[int, int, float]]:
        low = value.lower()
        plain = low.translate(LOOKS)
        for start in range(len(value)):
            for end in range(start + 3, min(start + self.longest, len(value)) + 1):
                for form, swapped in ((low, 0), (plain, 1)):
                    cost = self.rank.get(form[start:end])
                    if cost is None or (swapped and form[start:end] == low[start:end]):
                        continue
                    span = value[start:end]
                    big = sum(c.isupper() for c in span)
                    if big in (0, 1, len(span)):
                        cost += math.log10(2) if big else 0.0
                    else:
                        cost += math.log10(sum(math.comb(len(span), k) for k in range(1, min(big, len(span) - big) + 1)))
                    changed = sum(a != b for a, b in zip(form[start:end], low[start:end], strict=True))
                    yield start, end, cost + changed * math.log10(2)

    def dates(self, value: str) -> Iterator[tuple[int, int, float]]:
        for start, c in enumerate(value):
            if c.isdigit():
                for end in range(start + 4, min(start + 10, len(value)) + 1):
                    if found := DATE.fullmatch(value, start, end):
                        days = 120 if end - start == 4 and value[start : start + 2] in ("19", "20") else 120 * 366
                        yield start, end, math.log10(days * (4 if found[1] or found[2] else 1))

    def runs(self, value: str) -> dict[int, list[tuple[int, frozenset[str]]]]:
        """Straight runs by the place of their last key: where they start, and their directions."""
        keys, out = value.translate(SHIFTED).lower(), {}
        for last in range(1, len(keys)):
            ways = self.near.get((keys[last - 1], keys[last]))
            if ways:
                own = [(last - 1, ways)]
                own += [(start, both) for start, before in out.get(last - 1, ()) if (both := before & ways)]
                out[last] = own
        return out

    def walk_ends(self, value: str) -> Iterator[tuple[int, float, list[float]]]:
        """For every end in turn (end, least cost of what ends there in a walk); the caller adds
        the cost of everything up to each end to the list that it is given with the first one."""
        keys, runs = value.translate(SHIFTED).lower(), self.runs(value)
        best: list[float] = []
        cost: dict[int, list[float]] = {}
        turned: dict[int, float] = {}
        for end in range(len(value) + 1):
            last, least = end - 1, math.inf
            if last in runs:
                held = []
                for start, ways in runs[last]:
                    size = last - start
                    fresh = math.log10(8 * size)
                    way = best[start] + (1.0 if start else 0.0) + math.log10(47) + fresh
                    way = min(way, turned.get(start, math.inf) + fresh)
                    for (before, old), paid in zip(runs.get(start - 1, ()), cost.get(start - 1, ()), strict=True):
                        if (keys[before], keys[start]) in self.near:
                            same = start - 1 - before == size and ways & old
                            way = min(way, paid + math.log10(8) + (math.log10(2) if same else fresh))
                    held.append(way)
                cost[last], turned[last] = held, min(held)
                least = turned[last]
            yield end, least, best

    def repeats(self, value: str) -> Iterator[tuple[int, float, int, int]]:
        """(end, cost of one unit, its length, greatest count) of everything that repeats and ends
        there. A unit that is best priced as a repeat itself is left to its own unit."""
        codes = np.array([ord(c) for c in value])
        periods = {}
        for unit in range(1, min(32, len(value) // 2) + 1):
            same = codes[unit:] == codes[:-unit]
            at = np.arange(1, len(same) + 1)
            run = at - np.maximum.accumulate(np.where(same, 0, at))
            if (run >= unit).any():
                periods[unit] = run
        once: dict[str, float | None] = {}
        for end in range(2, len(value) + 1):
            for unit, run in periods.items():
                if end > unit and run[end - unit - 1] >= unit:
                    part = value[end - unit : end]
                    if part not in once:
                        cost, inner = max(self.least(part), 0.3), (part + part).find(part, 1)
                        root = max(self.least(part[:inner]), 0.3) if inner < unit else math.inf
                        once[part] = None if cost >= root + math.log10(unit / inner) - 1e-12 else cost
                    if once[part] is not None:
                        yield end, once[part], unit, int(run[end - unit - 1]) // unit + 1

    def least(self, value: str) -> float:
        """Dynamic programming over end positions. Every further span costs one more digit and
        neighbouring brute-force characters form one span."""
        ends: dict[int, list[tuple[int, float]]] = {}
        for spans in (self.words, self.dates):
            for start, end, cost in spans(value):
                ends.setdefault(end, []).append((start, cost))
        again: dict[int, list[tuple[float, int, int]]] = {}
        for end, *repeat in self.repeats(value):
            again.setdefault(end, []).append(tuple(repeat))
        counts = np.log10(np.arange(1, len(value) + 2))
        paid, brute = np.zeros(len(value) + 1), math.inf
        for end, walked, best in self.walk_ends(value):
            if end == 0:
                best.append(0.0)
                continue
            loose = 1.0 + min(brute, best[end - 1] + (1.0 if end > 1 else 0.0))
            options = [loose, walked, *(best[s] + max(c, 0.3) + (1.0 if s else 0.0) for s, c in ends.get(end, ()))]
            for cost, unit, most in again.get(end, ()):
                # From the shortest, of two units, to the longest.
                before = paid[end - 2 * unit :: -unit][: most - 1] + counts[1:most]
                further = 1.0 if end > most * unit else 0.0
                before[:-1] += 1.0
                options.append(min(float(before[:-1].min(initial=math.inf)), float(before[-1]) + further) + cost)
            brute = loose
            best.append(min(options))
            paid[end] = best[end]
        return paid[-1] if value else 0.0


def scan(text: str, costs: GuessCost | None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all spans, sorted."""
    low, found = text.lower(), []
    if any(c in low for c in CUES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if costs is not None and any(c in low for c in CONTEXT_CUES):
        found.sort()
        starts, reach = [s for s, _, _ in found], []
        for _, _, e in found:
            reach.append(max(e, reach[-1] if reach else 0))
        for m in CONTEXT.finditer(text):
            a, b = m.span(1) if m[1] is not None else m.span(2)
            value = text[a:b].rstrip(".!?)*#$%&")
            before = bisect.bisect_left(starts, a + len(value))
            free = not before or reach[before - 1] <= a
            if free and len(value) >= 6 and costs.least(value) >= COSTLY:
                found.append((a, 3, a + len(value)))
    return sorted(found)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial word counts, given off whenever many have gathered."""
    seen: Counter[bytes] = Counter()

    def emptied() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
        seen.clear()
        return out

    strip = re.compile(rb"[a-z\x80-\xff]{3,48}")
    for batch in batches:
        for text in batch.column(0):
            own = Counter((text.as_buffer().to_pybytes() if text.is_valid else b"").lower().split())
            for chunk, n in own.items():
                word = chunk.strip(b".,;:!?\"'()*#$%&|")
                if strip.fullmatch(word):
                    seen[word] += n
            if len(seen) > 200_000:
                yield emptied()
    yield emptied()


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> list[str]:
    """The most frequent words of all documents, most frequent first, ties by code point.

    The driver gets the sizes of the frequency classes and then ``size`` words, whatever the
    number of tasks: the words above the class in which the list ends, and of that class the
    first ones by ranges."""
    texts = docs.select(F.col("text").cast("binary").alias("text"))
    counts = texts.mapInArrow(_counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = counts.select(F.col("word").cast("string").alias("word"), "n").where(F.length("word") <= 24)
    words = settle(words.withColumn("class", F.floor(F.log2("n") * 8).cast("int")), "words")
    sizes = dict(words.groupBy("class").agg(F.count("*")).collect())
    above, edge = 0, None
    for edge in sorted(sizes, reverse=True):
        if above + sizes[edge] >= size:
            break
        above += sizes[edge]
    if edge is None:
        return []
    last = words.where(F.col("class") == edge).select("word", "n", F.lit(0).alias("all"), (-F.col("n")).alias("falling"))
    last = row_index(last, ["all"], "falling", "word", "place").where(F.col("place") <= size - above)
    found = words.where(F.col("class") > edge).select("word", "n").unionByName(last.select("word", "n")).collect()
    return [r["word"] for r in sorted(found, key=lambda r: (-r["n"], r["word"].encode()))]


SPANS = "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string"


def _scanned(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = GuessCost(shared.value)
        names = ["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"]
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                spans = scan(text or "", costs)
                base = [s for s in spans if s[1] < 3]
                n = Counter(k for _, k, _ in spans)
                rows.append((n[0], n[1], n[2], n[3], hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    return run


def secrets(docs: DataFrame, size: int = DICTIONARY) -> DataFrame:
    """Per row of ``docs``: doc_id, counts per kind, digest of the base spans, all spans."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionary(docs, size))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_scanned(shared), SPANS)


QUERY = "op3_guess_cost"


def query(spark: SparkSession, folder: str) -> DataFrame:
    return secrets(table(spark, folder, "documents"))


ORACLE_SQL = None
