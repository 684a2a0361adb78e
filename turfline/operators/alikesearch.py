"""Requirement search of rows that ask for their own values, all alike: no sides, equal weights.

Then weights are the same for all queries, and one pass over the candidates serves every variant. A
block of queries and one of candidates give two kinds of marks. Rough distances come from one matrix
product per view and balance of families; a variant's weights lie within a ratio of those, so a
pair beyond that share of the k-th best distance is among no k best. Unmet features are counted on
the places of the values in the block, 16 bits each; a pair with more of them than the k-th best
can have is left out. Only marked pairs get exact keys, those of ``blocksearch``. Every candidate
block of a group is met once by every task, so the cost is rows x group at a few nanoseconds a
pair; memory is the k best of a task's queries and one block. Only the lists of the base variants
and the overlaps of the others with them leave a task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turfline.functions.constants import EXACT_TOLERANCE
from turfline.operators import similarity as S
from turfline.operators.blocksearch import Variant

#: Queries of a block, candidates of a block, and lists times blocks that a task holds.
ASKED, BLOCK, LISTS = 4096, 16384, 160
#: What rounding to 6 decimals may add to a distance, and what sums of shares may differ by.
ROUNDED, SHARE = 2e-6, 2e-9
#: Marked pairs that are measured at once, and how many times k a query may have in a block before that is bounded.
HELD, MANY = 1 << 18, 8


class Metric:
    """Rough distances that bound several variants: a view, the axes' roots and the variants' ratios."""

    def __init__(self, view: int, balanced: bool, families: Sequence[str]):
        self.view = view
        base = np.array([1.0 / list(families).count(g) if balanced else 1.0 for g in families])
        self.base, self.root = base, np.sqrt(base)
        self.variants: list[int] = []
        self.low: dict[int, float] = {}
        self.grow = 1.0

    def take(self, place: int, weight: np.ndarray):
        ratio = weight / weight.sum() / self.base
        self.variants.append(place)
        self.low[place] = float(np.sqrt(ratio.min()))
        self.grow = max(self.grow, float(np.sqrt(ratio.max() / ratio.min())))


class Plan:
    """Weights, metrics and kinds of the variants."""

    def __init__(self, families: Sequence[str], variants: Sequence[Variant], k: int, clubs: bool):
        self.n, self.k, self.clubs, self.variants = len(families), k, clubs, list(variants)
        self.weights, metrics = [], {}
        self.hybrid, self.share = [], []
        for i, v in enumerate(variants):
            w = np.ones(self.n) if v.factors is None else np.array(v.factors, float)
            balanced = v.method == "family_rms"
            if balanced:
                total = {g: sum(x for x, h in zip(w, families, strict=True) if h == g) for g in families}
                w = np.array([x / total[g] for x, g in zip(w, families, strict=True)])
            self.weights.append(w)
            if v.method in ("hybrid", "satisfaction") and v.view:
                raise ValueError("unmet features are counted in the first view")
            if v.method == "satisfaction":
                self.share.append(i)
                continue
            if v.method == "hybrid":
                self.hybrid.append(i)
            at = (v.view, balanced)
            metrics.setdefault(at, Metric(*at, families)).take(i, w)
        self.metrics = list(metrics.values())
        # The least and the greatest share that some number of unmet features can have.
        ordered = {i: np.sort(self.weights[i]) for i in self.share}
        self.least = {i: np.concatenate([[0.0], np.cumsum(w)]) / w.sum() for i, w in ordered.items()}
        self.most = {i: np.concatenate([[0.0], np.cumsum(w[::-1])]) / w.sum() for i, w in ordered.items()}

    def distance(self, losses: list[np.ndarray], place: int) -> np.ndarray:
        w, total = self.weights[place], 0.0
        for x, v in zip(w, losses, strict=True):
            total = total + x * v * v
        return np.floor(np.sqrt(total / sum(w)) * 1e6 + 0.5) / 1e6

    def shares(self, unmet: list[np.ndarray], place: int) -> np.ndarray:
        w, total = self.weights[place], 0.0
        for x, v in zip(w, unmet, strict=True):
            total = total + x * v
        return np.floor(total / sum(w) * 1e9 + 0.5) / 1e9


def _least(values: np.ndarray, k: int) -> np.ndarray | None:
    """No less than the k-th least of every row: that of the least of every few."""
    fold = max(1, min(S.FOLD, values.shape[1] // (8 * k)))
    few = values[:, : values.shape[1] // fold * fold].reshape(len(values), fold, -1).min(axis=1)
    return np.partition(few, k - 1, axis=1)[:, k - 1] if few.shape[1] >= k else None


def _first(row: np.ndarray, name: np.ndarray, key: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What is not beyond the k-th key of its row; rows ascend."""
    at = np.flatnonzero(np.diff(row, prepend=-1))
    size = np.diff(np.append(at, len(row)))
    wide = int(size.max(initial=0))
    if wide > k and len(at) * wide <= 8 * len(row):
        own = np.repeat(np.arange(len(at)), size)
        grid = np.full((len(at), wide), np.inf)
        grid[own, np.arange(len(row)) - at[own]] = key
        near = key <= np.partition(grid, k - 1, axis=1)[own, k - 1]
        row, name, key = row[near], name[near], key[near]
    return row, name, key


class Picked:
    """The k best of every variant for the queries of a task so far."""

    def __init__(self, plan: Plan, bases: Sequence[tuple[int, Sequence[Sequence[int]]]], hosts):
        self.plan, self.bases = plan, bases
        self.ids = pa.concat_arrays([ids for ids, _, _ in hosts])
        cells = np.concatenate([cells for _, cells, _ in hosts])
        self.names, self.target, self.club = self.ids.to_numpy(zero_copy_only=False), cells[:, : plan.n], cells[:, -1]
        shape = (len(plan.variants), len(self.names), plan.k)
        self.key, self.who = np.full(shape, np.inf), np.zeros(shape, np.int64)

    def bar(self, place: int) -> np.ndarray:
        return self.key[place, :, -1]

    def out(self, rows, names: np.ndarray, clubs: np.ndarray) -> np.ndarray:
        """Pairs that do not count: a row itself and, where asked, its club."""
        mine = self.names[rows] == names
        return mine | (self.club[rows] == clubs) if self.plan.clubs else mine

    def meet(self, ids, cells: np.ndarray):
        plan, names, clubs = self.plan, ids.to_numpy(zero_copy_only=False), cells[:, -1]
        view = lambda i: cells[:, i * plan.n : (i + 1) * plan.n]
        # How many unmet features the k-th best has; where it is none, the distance bounds the hybrid key too.
        worst = np.max([self.bar(i) for i in plan.hybrid], axis=0) if plan.hybrid else np.zeros(len(self.names))
        allow = np.minimum(np.floor(worst / 1000.0), plan.n)
        deep = allow >= 1
        for metric in plan.metrics:
            limit = np.zeros(len(self.names))
            for i in metric.variants:
                if i in plan.hybrid:
                    limit = np.maximum(limit, np.where(deep, 0.0, (self.bar(i) + ROUNDED) / metric.low[i]))
                else:
                    limit = np.maximum(limit, (self.bar(i) + ROUNDED) / metric.low[i])
            self.near(metric, limit, deep, view(metric.view), names, clubs)
        if plan.share or (plan.hybrid and deep.any()):
            most = np.where(deep, allow, -1) if plan.hybrid else np.full(len(self.names), -1)
            for i in plan.share:
                most = np.maximum(most, np.searchsorted(plan.least[i], self.bar(i) + SHARE, "right") - 1)
            self.few(most, deep, view(0), names, clubs)

    def near(self, metric: Metric, limit, deep, b, names, clubs):
        """Candidates within the limits of a metric."""
        held, count = [], 0
        for part, rough, base, off in S._rough(self.target * metric.root, b * metric.root):
            lim = limit[part]
            within = lambda lim: np.packbits(rough <= S._limit((lim + S.SLACK) ** 2 + off - base, rough, True), axis=1)  # noqa: B023, E731
            marks = within(lim)
            many = np.flatnonzero(np.bitwise_count(marks).sum(axis=1, dtype=np.int64) > MANY * self.plan.k)
            if len(many):
                # The block holds better ones than were known: its own k-th bounds them first.
                rows = np.arange(part.start, part.stop)[many]
                least = _least(np.where(self.out(rows[:, None], names, clubs), np.float32(np.inf), rough[many]), self.plan.k)
                if least is not None:
                    reach = np.sqrt(np.maximum(least + base[many] + off[many], 0.0))
                    lim = lim.copy()
                    lim[many] = np.minimum(lim[many], reach * metric.grow + ROUNDED / min(metric.low.values()))
                    marks = within(lim)
            row, col = S._marked(marks)
            held.append((row + part.start, col))
            count += len(row)
            if count > HELD:
                self.measure(metric, held, deep, b, names, clubs)
                held, count = [], 0
        self.measure(metric, held, deep, b, names, clubs)

    def measure(self, metric: Metric, held, deep, b, names, clubs):
        if not held:
            return
        row, col = (np.concatenate(x) for x in zip(*held, strict=True))
        keep = ~self.out(row, names[col], clubs[col])
        row, col = row[keep], col[keep]
        losses = [np.abs(self.target[row, f] - b[col, f]) for f in range(self.plan.n)]
        shallow = None
        for i in metric.variants:
            if i not in self.plan.hybrid:
                self.add(i, row, names[col], self.plan.distance(losses, i))
                continue
            if shallow is None:
                shallow = np.flatnonzero(~deep[row])
                own = [v[shallow] for v in losses]
                unmet = sum((v > EXACT_TOLERANCE).astype(np.int16) for v in own) if len(shallow) else None
            if len(shallow):
                self.add(i, row[shallow], names[col[shallow]], unmet * 1000.0 + self.plan.distance(own, i))

    def few(self, most, deep, b, names, clubs):
        """Candidates with few enough unmet features, counted on 8 bits of the places of their values in
        the block: never more than there are."""
        plan, step = self.plan, max(1, S.CELLS // len(b))
        places, low, width, sure = [], [], [], []
        for f in range(plan.n):
            values, place = np.unique(b[:, f], return_inverse=True)
            size = len(values)
            coded = lambda x: np.clip(x, 0, size - 1) * 256 // size  # noqa: B023, E731
            begin = np.searchsorted(values, self.target[:, f] - EXACT_TOLERANCE)
            end = np.searchsorted(values, self.target[:, f] + EXACT_TOLERANCE, "right")
            # One value more on either side, or one less for what is met for sure, takes up rounding in the sums.
            first, last = coded(begin - 1), coded(end)
            places.append(coded(place.reshape(-1)).astype(np.uint8))
            low.append(first.astype(np.uint8)[:, None])
            width.append((last - first).astype(np.uint8)[:, None])
            sure.append((places[-1].astype(np.int16), (coded(begin) + 1).astype(np.int16)[:, None], (coded(end - 1) - 1).astype(np.int16)[:, None]))
        held, count = [], 0
        space = np.empty((3, min(step, len(self.names)), len(b)), np.uint8)
        for i in range(0, len(self.names), step):
            part = slice(i, min(i + step, len(self.names)))
            unmet, gap, far = space[:, : part.stop - i]
            unmet[:] = 0
            for place, begin, wide in zip(places, low, width, strict=True):
                np.subtract(place, begin[part], out=gap)
                np.greater(gap, wide[part], out=far.view(bool))
                np.add(unmet, far, out=unmet)
            bound = most[part]
            within = lambda bound: np.packbits(unmet < (bound + 1).astype(np.uint8)[:, None], axis=1)  # noqa: B023, E731
            marks = within(bound)
            many = np.flatnonzero((np.bitwise_count(marks).sum(axis=1, dtype=np.int64) > MANY * plan.k) & (bound > 0))
            if len(many):
                rows = np.arange(part.start, part.stop)[many]
                most_unmet = sum(((x < s[rows]) | (x > e[rows])).view(np.uint8) for x, s, e in sure)
                least = _least(np.where(self.out(rows[:, None], names, clubs), np.uint8(255), most_unmet), plan.k)
                if least is not None:
                    least = np.minimum(least, plan.n).astype(np.int64)
                    reach = least
                    for j in plan.share:
                        reach = np.maximum(reach, np.searchsorted(plan.least[j], plan.most[j][least] + SHARE, "right") - 1)
                    bound = bound.copy()
                    bound[many] = np.minimum(bound[many], reach)
                    marks = within(bound)
            row, col = S._marked(marks)
            held.append((row + part.start, col))
            count += len(row)
            if count > HELD:
                self.count(held, deep, b, names, clubs)
                held, count = [], 0
        self.count(held, deep, b, names, clubs)

    def count(self, held, deep, b, names, clubs):
        if not held:
            return
        row, col = (np.concatenate(x) for x in zip(*held, strict=True))
        # Once k meet everything, only smaller ids come before them, and the distance bounds the hybrid key.
        full = ~deep
        for i in self.plan.share:
            full &= self.bar(i) == 0.0
        last = np.max([self.who[i, :, -1] for i in self.plan.share], axis=0) if self.plan.share else np.zeros(len(full), np.int64)
        last = np.where(full, last, np.iinfo(np.int64).max)
        early = names[col] < last[row]
        row, col = row[early], col[early]
        keep = ~self.out(row, names[col], clubs[col])
        row, col = row[keep], col[keep]
        losses = [np.abs(self.target[row, f] - b[col, f]) for f in range(self.plan.n)]
        unmet = [v > EXACT_TOLERANCE for v in losses]
        for i in self.plan.share:
            self.add(i, row, names[col], self.plan.shares(unmet, i))
        far = np.flatnonzero(deep[row])
        if len(far) and self.plan.hybrid:
            whole = sum(v[far].astype(np.int16) for v in unmet) * 1000.0
            own = [v[far] for v in losses]
            for i in self.plan.hybrid:
                self.add(i, row[far], names[col[far]], whole + self.plan.distance(own, i))

    def add(self, place: int, row: np.ndarray, name: np.ndarray, key: np.ndarray):
        """Keep the k best of the old and new candidates; rows ascend."""
        last = self.bar(place)[row]
        live = (key < last) | ((key == last) & np.isfinite(key) & (name < self.who[place, row, -1]))
        row, name, key = row[live], name[live], key[live]
        if not len(row):
            return
        k = self.plan.k
        row, name, key = _first(row, name, key, k)
        at = np.flatnonzero(np.diff(row, prepend=-1))
        size = np.diff(np.append(at, len(row)))
        own, wide = row[at], int(size.max())
        if len(at) * wide <= 8 * len(row):
            # Old and new ones of a row side by side, sorted row by row.
            line = np.repeat(np.arange(len(at)), size)
            keys, who = np.full((len(at), k + wide), np.inf), np.zeros((len(at), k + wide), np.int64)
            keys[:, :k], who[:, :k] = self.key[place, own], self.who[place, own]
            spot = k + np.arange(len(row)) - at[line]
            keys[line, spot], who[line, spot] = key, name
            best = np.lexsort((who, keys), axis=1)[:, :k]
            self.key[place, own], self.who[place, own] = np.take_along_axis(keys, best, 1), np.take_along_axis(who, best, 1)
            return
        old, rank = np.nonzero(np.isfinite(self.key[place, own]))
        old = own[old]
        row = np.concatenate([old, row])
        row, name, key = S._best(row, np.concatenate([self.who[place, old, rank], name]), np.concatenate([self.key[place, old, rank], key]), k)
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        self.key[place, row, rank], self.who[place, row, rank] = key, name

    def result(self):
        found = [np.isfinite(x) for x in self.key]
        live = np.flatnonzero(found[self.bases[0][0]].any(axis=1))
        columns = [self.ids.take(pa.array(live))]
        for base, groups in self.bases:
            held, who = found[base][live], self.who[base][live]
            ends = np.concatenate([[0], np.cumsum(held.sum(axis=1))])
            columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(who[held], pa.int64())))
            for group in groups:
                total, lists = np.zeros(len(live)), np.zeros(len(live), np.int64)
                for i in group:
                    other = found[i][live]
                    both = (who[:, :, None] == self.who[i][live][:, None, :]) & held[:, :, None] & other[:, None, :]
                    common, n = both.sum(axis=(1, 2)), other.sum(axis=1)
                    total += np.where(n > 0, common / np.maximum(held.sum(axis=1) + n - common, 1), 0.0)
                    lists += n > 0
                mean = np.divide(total, lists, out=np.zeros(len(live)), where=lists > 0)
                columns.append(pa.array(mean, mask=lists == 0))
        return columns


def overlaps(
    rows: DataFrame, candidates: DataFrame, keys: Sequence[str], families: Sequence[str], variants: Sequence[Variant],
    bases: dict[str, tuple[int, dict[str, Sequence[int]]]], k: int = 10, clubs: bool = False, asked: int = ASKED, block: int = BLOCK,
) -> DataFrame:
    """Every row of ``rows`` (keys, id, club, values) asks for its own values: keys, id and, per entry of
    ``bases``, its ``k`` best of the base variant, in order, with the mean Jaccard of that list with those
    of the variants in each named group. Ties go to the smaller id; rows without a candidate are left out.

    candidates: keys, id, club, values (the views one after another; no value is missing). A row never meets
    itself, nor its club where ``clubs`` is set. Order and keys are those of ``blocksearch.best``."""
    keys, n = list(keys), len(families)
    views = max(v.view for v in variants) + 1
    plan = Plan(families, variants, k, clubs)
    vector = lambda values: F.concat(values, F.array(F.col("club").cast("double"))).alias("vec")
    asks = rows.select(*keys, "id", vector(F.concat(*[F.col("values")] * views)), F.lit(1.0).alias("more"))
    others = candidates.select(*keys, "id", vector(F.slice("values", 1, views * n)), F.lit(0.0).alias("more"))
    hosts, blocks = S._packed(asks, keys, asked, 50.0), S._packed(others, keys, block, 50.0)
    kind = blocks.schema["ids"].dataType.elementType
    extra = []
    for name, (_, groups) in bases.items():
        extra += [(name, T.ArrayType(T.LongType())), *[(group, T.DoubleType()) for group in groups]]
    schema = S._schema(hosts, keys, kind, extra)
    tour = partial(Picked, plan, [(base, list(groups.values())) for base, groups in bases.values()])
    return S._toured(hosts, blocks, keys, False, tour, schema, max(1, LISTS // len(variants)))
