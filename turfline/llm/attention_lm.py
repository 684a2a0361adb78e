"""Language-model scores by a causal self-attention model in numpy.

Texts are subword ids of a public tokenizer and one end id. The model is one attention
layer over the last ``WINDOW`` ids: fixed features of each id, queries, keys and values from
them, a bias per distance, a rectified hidden layer, and a softmax over ``CLASSES`` classes
of ids; an id's own share of its class comes from its count (class-factored softmax).

* Counts, features, classes and groups of ids cover all training texts in full. Features come
  from how often ``BUCKETS`` buckets of ids stand before and after each id; classes are k-means
  clusters of what stands before, groups of what stands after.
* Weights are trained by data-parallel Adam steps: every started ``SPAN`` ids of a training
  text give one window, placed by a digest; each round all tasks run side by side over their
  windows from the shared weights, and Spark averages the results. So the windows grow with
  the length of the corpus.
* Scoring reads every whole text in windows that overlap by ``WINDOW - STRIDE`` ids, each id
  scored once with at least that much context, in masked batches.

Beside it stands the word unigram baseline. Words are counted by 64-bit hashes over all
training texts. The most frequent (at most ``HEAD`` of them, by whole octaves of frequency)
travel to the tasks as a table of bounded size, the others are joined, so every count is used.

Defined results: null and empty texts are the end alone; with no training text all counts
are 0 and the model is uniform; repeated rows are each counted and scored; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turfline.llm.common import crc_fold, ragged, signed, table, words_of
from turfline.llm.subwords import chunk_ids, word_tokenizer
from turfline.session import settle

FOLDS, HELD_OUT = 5, 1
HEAD = 1 << 19
VOCABULARY, END = 49_409, 49_408
WINDOW, STRIDE, SPAN = 32, 24, 1024
FEATURES, KEYS, HIDDEN, CLASSES, GROUPS, BUCKETS = 32, 16, 16, 32, 128, 32
PRIOR, SMOOTH = 4.0, 3.0
ROUNDS, LEAST_STEPS, BATCH, RATE = 3, 60, 128, 0.01
TOGETHER = 256


# Words and the unigram baseline.


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, _, words, _ in words_of(batch.column(0)):
            own, n = np.unique(words, return_counts=True)
            hashes.append(own)
            counts.append(n)
        both, back = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(back, weights=np.concatenate(counts), minlength=len(both)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(signed(both)), pa.array(total)], ["word", "n"])


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n): occurrences of each word hash in the training texts. Settled."""
    train = texts.where(~F.col("held_out")).select("text")
    return settle(train.mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")


def head_words(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of the most frequent words: as many octaves of frequency as
    hold at most ``most`` words."""
    octave = F.floor(F.log2("n")).cast("int")
    sizes = {r["o"]: r["w"] for r in counts.groupBy(octave.alias("o")).agg(F.count("*").alias("w")).collect()}
    kept, least = 0, 64
    for o in sorted(sizes, reverse=True):
        if kept + sizes[o] > most:
            break
        kept, least = kept + sizes[o], o
    rows = counts.where(octave >= least).toArrow()
    words, n = (np.asarray(rows.column(c).combine_chunks(), np.int64) for c in ("word", "n"))
    order = np.argsort(words.view(np.uint64))
    return words.view(np.uint64)[order], n[order]


def _read(shared, tokenizer: str):
    """Per text: its subword ids and its baseline from the head words, the rest as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, ends, floor = shared.value
        known = chunk_ids(tokenizer, END)
        logs = np.log10(counts + 0.5) - floor
        for batch in batches:
            texts, size = batch.column("text"), batch.num_rows
            n_tokens, n_known, base = np.ones(size, np.int64), np.full(size, int(ends > 0)), np.full(size, np.log10(ends + 0.5) - floor)
            tails, tail_sizes = [np.zeros(0, np.uint64)], np.zeros(size, np.int64)
            for first, end, own, rows in words_of(texts):
                distinct, back = np.unique(own, return_inverse=True)
                at = np.minimum(np.searchsorted(words, distinct), max(len(words) - 1, 0))
                hit = words[at] == distinct if len(words) else np.zeros(len(distinct), bool)
                value = np.where(hit, logs[at] if len(words) else 0.0, 0.0)
                n = end - first
                n_tokens[first:end] += np.bincount(rows, minlength=n)
                n_known[first:end] += np.bincount(rows, weights=hit[back], minlength=n).astype(np.int64)
                base[first:end] += np.bincount(rows, weights=value[back], minlength=n)
                lost = ~hit[back]
                tails.append(own[lost])
                tail_sizes[first:end] = np.bincount(rows[lost], minlength=n)
            offsets = np.concatenate([[0], np.cumsum(tail_sizes)]).astype(np.int32)
            tail = pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(np.concatenate(tails))))
            ids = known.encode(texts).cast(pa.binary())
            columns = [
                batch.column("rid"), batch.column("doc_id"), batch.column("held_out"), pa.array(n_tokens), pa.array(n_known), pa.array(base), tail, ids,
            ]
            yield pa.RecordBatch.from_arrays(columns, ["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "tail", "ids"])

    return run


READ = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, tail array<long>, ids binary"


# The model.


class Weights(dict):
    """Named float32 arrays of fixed shapes."""

    @classmethod
    def fresh(cls) -> Weights:
        rng = np.random.default_rng(11)

        def start(*shape: int) -> np.ndarray:
            return rng.normal(0, 0.3 / np.sqrt(shape[0]), shape).astype(np.float32)

        return cls(
            q=start(FEATURES, KEYS), k=start(FEATURES, KEYS), v=start(FEATURES, HIDDEN), c=start(FEATURES, HIDDEN),
            bias=np.zeros(WINDOW, np.float32), shift=np.full(HIDDEN, 0.1, np.float32), out=start(HIDDEN, CLASSES), prior=np.zeros(CLASSES, np.float32),
        )


def distance_factors(bias: np.ndarray) -> np.ndarray:
    """exp of the distance bias where a place may look, 0 where the mask forbids it."""
    gap = np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None, :]
    return np.where(gap >= 0, np.exp(bias[np.maximum(gap, 0)]), 0.0).astype(np.float32)


def attend(q: np.ndarray, k: np.ndarray, v: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masked attention of a batch: (mixed values, attention shares)."""
    shares = q @ k.transpose(0, 2, 1)
    np.minimum(shares, 30.0, out=shares)
    np.exp(shares, out=shares)
    shares *= factors
    shares /= shares.sum(-1, keepdims=True)
    return shares @ v, shares


def gradient(w: Weights, e: np.ndarray, target: np.ndarray, live: np.ndarray) -> tuple[float, Weights]:
    """Mean loss over the live places and its gradient."""
    scale = np.float32(KEYS**-0.5)
    q, k, v = e @ w["q"] * scale, e @ w["k"], e @ w["v"]
    mixed, shares = attend(q, k, v, distance_factors(w["bias"]))
    hidden = np.maximum(mixed + e @ w["c"] + w["shift"], 0)
    logits = hidden @ w["out"] + w["prior"]
    logits -= logits.max(-1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(-1, keepdims=True)
    own = np.take_along_axis(p, target[..., None], -1)
    count = np.float32(max(live.sum(), 1))
    loss = float(-(np.log(np.maximum(own[..., 0], 1e-12)) * live).sum() / count)
    d = p
    np.put_along_axis(d, target[..., None], own - 1, -1)
    d *= (live / count)[..., None]

    def outer(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.reshape(-1, a.shape[-1]).T @ b.reshape(-1, b.shape[-1])

    dh = (d @ w["out"].T) * (hidden > 0)
    dp = dh @ v.transpose(0, 2, 1)
    ds = shares * (dp - (dp * shares).sum(-1, keepdims=True))
    dq, dk, dv = ds @ k * scale, ds.transpose(0, 2, 1) @ q, shares.transpose(0, 2, 1) @ dh
    by_gap = ds.sum(0)
    bias = np.array([np.trace(by_gap, offset=-g) for g in range(WINDOW)], np.float32)
    return loss, Weights(
        q=outer(e, dq), k=outer(e, dk), v=outer(e, dv), c=outer(e, dh), bias=bias, shift=dh.sum((0, 1)), out=outer(hidden, d), prior=d.sum((0, 1))
    )


def adam(w: Weights, batches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[Weights, float]:
    """Adam steps from given weights; returns the weights and the mean loss."""
    w, first, second, losses = Weights({n: x.copy() for n, x in w.items()}), {}, {}, []
    for step, (e, target, live) in enumerate(batches, 1):
        loss, grad = gradient(w, e, target, live)
        losses.append(loss)
        for name, g in grad.items():
            m = first[name] = 0.9 * first.get(name, 0) + 0.1 * g
            s = second[name] = 0.99 * second.get(name, 0) + 0.01 * g * g
            w[name] = (w[name] - RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return w, float(np.mean(losses)) if losses else 0.0


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of each text: one of every started ``SPAN`` ids, placed by a digest of the span."""
    for batch in batches:
        windows = []
        for value in batch.column(0):
            full = np.concatenate([[END], np.frombuffer(value.as_buffer(), "<u2")]).astype("<u2")
            for first in range(0, max(len(full) - 1, 1), SPAN):
                span = full[first : first + SPAN + 1]
                at = zlib.crc32(span.tobytes()) % max(len(span) - WINDOW, 1)
                windows.append(span[at : at + WINDOW + 1].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(windows, pa.binary())], ["window"])


def _padded(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids with END as padding, live places) of windows."""
    ids, live = np.full((len(windows), WINDOW + 1), END, np.int64), np.zeros((len(windows), WINDOW), np.float32)
    for i, raw in enumerate(windows):
        own = np.frombuffer(raw, "<u2")
        ids[i, : len(own)] = own
        live[i, : len(own) - 1] = 1
    return ids, live


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids before, ids) of whole texts, about a million places at a time."""
    before, ids, size = [], [], 0
    for batch in batches:
        for value in batch.column(0):
            own = np.frombuffer(value.as_buffer(), "<u2").astype(np.int64)
            before += [np.array([END], np.int64)[: len(own)], own[:-1]]
            ids.append(own)
            size += len(own)
            if size > 1 << 20 or len(ids) > 4096:
                yield np.concatenate(before), np.concatenate(ids)
                before, ids, size = [], [], 0
    if ids:
        yield np.concatenate(before), np.concatenate(ids)


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task, over all ids: how often a bucket of ids stands before and after each id."""
    total = np.zeros(VOCABULARY * 2 * BUCKETS, np.int64)
    for before, ids in _slices(batches):
        total += np.bincount(ids * (2 * BUCKETS) + before % BUCKETS, minlength=len(total))
        total += np.bincount(before * (2 * BUCKETS) + BUCKETS + ids % BUCKETS, minlength=len(total))
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["code", "n"])


def summed(rows: DataFrame, counted, size: int) -> np.ndarray:
    """The sum of the tasks' counts by code, made by Spark: one array of the given size."""
    found = rows.mapInArrow(counted, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size)
    out[np.asarray(found.column("code").combine_chunks())] = np.asarray(found.column("n").combine_chunks())
    return out


def id_features(around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, counts) of all ids: per side the leading components of the square roots of
    the smoothed shares of the buckets, weighted by the roots of the counts."""
    sides = around.reshape(VOCABULARY, 2, BUCKETS)
    counts, parts = sides[:, 0].sum(-1), []
    for side in (sides[:, 0], sides[:, 1]):
        n = side.sum(-1, keepdims=True)
        usual = (side.sum(0) + 1) / (side.sum() + BUCKETS)
        x = np.sqrt((side + SMOOTH * usual) / (n + SMOOTH)) - np.sqrt(usual)
        weight = np.sqrt(n)
        vectors = np.linalg.eigh((x * weight).T @ x)[1][:, ::-1][:, : FEATURES // 2]
        x = x @ (vectors * np.where(vectors.sum(0) < 0, -1, 1))
        spread = np.sqrt((x**2 * weight).sum() / max(weight.sum(), 1) / x.shape[1])
        parts.append(x / max(spread, 1e-6))
    return np.concatenate(parts, 1).astype(np.float32), counts


def clusters(points: np.ndarray, weight: np.ndarray, count: int, rounds: int = 12) -> np.ndarray:
    """Weighted k-means; seeds are the heaviest distinct points."""
    order = np.argsort(-weight, kind="stable")
    seeds = points[order]
    _, at = np.unique(seeds.round(5), axis=0, return_index=True)
    centres = seeds[np.sort(at)[:count]]
    near = np.zeros(len(points), np.int64)
    for _ in range(rounds):
        near = ((centres**2).sum(1)[None, :] - 2 * points @ centres.T).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points * weight[:, None])
        size = np.bincount(near, weights=weight, minlength=len(centres))
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-9)[:, None], centres).astype(np.float32)
    return near


def _group_counts(groups: np.ndarray):
    """Per task: how often each id follows each group of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(GROUPS * VOCABULARY, np.int64)
        for before, ids in _slices(batches):
            total += np.bincount(groups[before] * VOCABULARY + ids, minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["code", "n"])

    return run


def shares_of_class(rows: DataFrame, groups: np.ndarray, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """log10 share of each id in its class after each group, over all training ids."""
    after = summed(rows, _group_counts(groups), GROUPS * VOCABULARY).reshape(GROUPS, VOCABULARY)
    own = (counts + 0.5) / np.bincount(classes, weights=counts + 0.5, minlength=CLASSES)[classes]
    for row in after:
        inside = np.bincount(classes, weights=row, minlength=CLASSES)
        row[:] = np.log10((row + PRIOR * own) / (inside + PRIOR)[classes])
    return after.astype(np.float32)


def _trained(shared, w: Weights):
    """Steps of one task over its windows, again until ``LEAST_STEPS`` are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, classes = shared.value
        held, made = [], 0
        state, weight = w, 0

        def prepared(rows: list[bytes]):
            ids, live = _padded(rows)
            return features[ids[:, :-1]], classes[ids[:, 1:]], live

        def steps(rows: list[bytes]) -> Iterator:
            for at in range(0, len(rows), BATCH):
                yield prepared(rows[at : at + BATCH])

        for batch in batches:
            rows = batch.column(0).to_pylist()
            weight += len(rows)
            made += -(-len(rows) // BATCH)
            if made <= LEAST_STEPS:
                held += rows
            state, _ = adam(state, steps(rows))
        while held and made < LEAST_STEPS:
            made += -(-len(held) // BATCH)
            state, _ = adam(state, steps(held))
        if weight:
            flat = np.concatenate([state[n].ravel() for n in sorted(state)]).astype(np.float64)
            flat = np.append(flat * weight, weight)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["place", "value"])

    return run


def train(rows: DataFrame) -> dict:
    """The model's tables, all of them of the size of the vocabulary at most."""
    spark = rows.sparkSession
    texts = rows.where(~F.col("held_out")).select("ids")
    windows = settle(texts.mapInArrow(_sampled, "window binary"), "windows")
    features, counts = id_features(summed(texts, _surroundings, VOCABULARY * 2 * BUCKETS))
    classes, groups = np.arange(VOCABULARY) % CLASSES, np.zeros(VOCABULARY, np.int64)
    seen = np.flatnonzero(counts)
    if len(seen):
        groups[seen] = clusters(features[seen, FEATURES // 2 :], np.sqrt(counts[seen]), GROUPS)
        classes[seen] = clusters(features[seen, : FEATURES // 2], np.sqrt(counts[seen]), CLASSES)
    w = Weights.fresh()
    shared = spark.sparkContext.broadcast((features, classes))
    shapes = {name: w[name].shape for name in sorted(w)}
    for _ in range(ROUNDS if len(seen) else 0):
        moved = windows.mapInArrow(_trained(shared, w), "place long, value double")
        sums = moved.groupBy("place").agg(F.sum("value").alias("value")).toArrow().sort_by("place")
        flat = np.asarray(sums.column("value").combine_chunks())
        at, mean = 0, (flat[:-1] / flat[-1]).astype(np.float32)
        for name, shape in shapes.items():
            size = int(np.prod(shape))
            w[name] = mean[at : at + size].reshape(shape)
            at += size
    table = shares_of_class(texts, groups, classes, counts)
    scale = np.float32(KEYS**-0.5)
    return {
        "q": features @ w["q"] * scale, "k": features @ w["k"], "v": features @ w["v"], "c": features @ w["c"] + w["shift"],
        "factors": distance_factors(w["bias"]), "out": w["out"], "prior": w["prior"], "classes": classes.astype(np.int32), "groups": groups, "table": table,
    }


def windows_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first place, first place scored) of the windows over rows of given lengths."""
    extra = np.maximum(-(-(lengths - WINDOW) // STRIDE), 0)
    row = np.repeat(np.arange(len(lengths)), extra + 1)
    number = ragged(np.zeros(len(lengths), np.int64), extra + 1)
    return row, number * STRIDE, np.where(number > 0, number * STRIDE + WINDOW - STRIDE, 0)


def log_likelihoods(ids: list[np.ndarray], model: dict) -> np.ndarray:
    """log10 probability of each id sequence; every id is scored once."""
    lengths = np.array([len(i) for i in ids], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    targets = np.concatenate([*ids, np.zeros(0, np.int64)]).astype(np.int64)
    inputs = np.concatenate([[END], targets[:-1]]) if len(targets) else targets
    inputs[starts[:-1]] = END
    out = np.bincount(np.repeat(np.arange(len(ids)), lengths), weights=model["table"][model["groups"][inputs], targets], minlength=len(ids))
    row, place, scored = windows_of(lengths)
    grid, classes = np.arange(WINDOW), model["classes"][targets]
    for at in range(0, len(row), TOGETHER):
        r, p = row[at : at + TOGETHER], place[at : at + TOGETHER]
        where = p[:, None] + grid
        live = where < lengths[r][:, None]
        flat = np.where(live, starts[r][:, None] + where, 0)
        x = np.where(live, inputs[flat], END)
        mixed, _ = attend(model["q"][x], model["k"][x], model["v"][x], model["factors"])
        score = live & (where >= scored[at : at + TOGETHER][:, None])
        hidden = np.maximum(mixed[score] + model["c"][x[score]], 0)
        logits = hidden @ model["out"] + model["prior"]
        own = logits[np.arange(len(logits)), classes[flat[score]]]
        np.exp(np.minimum(logits, 60.0, out=logits), out=logits)
        gained = (own - np.log(logits.sum(-1))) / np.float32(np.log(10))
        out += np.bincount(np.broadcast_to(r[:, None], score.shape)[score], weights=gained, minlength=len(ids))
    return out


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            ids = [np.frombuffer(v.as_buffer(), "<u2") for v in batch.column("ids")]
            scores, first = np.zeros(len(ids)), 0
            while first < len(ids):
                end, size = first, 0
                while end < len(ids) and (end == first or size + len(ids[end]) <= 1 << 18):
                    size += len(ids[end])
                    end += 1
                scores[first:end] = log_likelihoods(ids[first:end], model)
                first = end
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(scores)], ["rid", "score"])

    return run


def score(docs: DataFrame, tokenizer: str | None = None, head: int = HEAD) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"),
    )
    counts = word_counts(texts)
    facts = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = texts.where(~F.col("held_out")).count()
    total, distinct = facts["n"] + ends, facts["v"] + int(ends > 0)
    floor = float(np.log10(total + 0.5 * (distinct + 1)))
    words, n = head_words(counts, head)
    shared = spark.sparkContext.broadcast((words, n, ends, floor))
    numbered = texts.withColumn("rid", F.monotonically_increasing_id())
    rows = settle(numbered.mapInArrow(_read(shared, tokenizer or word_tokenizer()), READ), "read")
    tail = rows.select("rid", F.explode("tail").alias("word")).groupBy("rid", "word").agg(F.count("*").alias("times"))
    joined = tail.join(counts, "word", "left")
    value = F.log10(F.coalesce("n", F.lit(0)) + 0.5) - floor
    rest = joined.groupBy("rid").agg(
        F.sum(F.col("times") * value).alias("tail_base"), F.sum(F.when(F.col("n") > 0, F.col("times"))).alias("tail_known")
    )
    model = spark.sparkContext.broadcast(train(rows))
    scores = settle(rows.select("rid", "ids").mapInArrow(_scored(model), "rid long, score double"), "scores")
    whole = rows.select("rid", "doc_id", "held_out", "n_tokens", "n_known", "base").join(scores, "rid").join(rest, "rid", "left")
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("tail_base", F.lit(0.0))).alias("base_score"), "score",
    )


QUERY = "op5_attention_lm"


def query(spark: SparkSession, folder: str) -> DataFrame:
    return score(table(spark, folder, "documents"))


ORACLE_SQL = None
