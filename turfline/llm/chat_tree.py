r"""Chat formatting as a prefix tree: shared initial turns are emitted once, depth-first.

Template. A turn reads ``### role: text</turn>\n``. Inside texts and roles a backslash goes
before every backslash and ``#``, inside roles before ``:``, and between ``<`` and ``/``, so
neither mark can occur in them; dropping each escaping backslash gives the text back. Mark,
text and end of a turn are encoded apart with a lossless byte-level vocabulary, so the tokens
of an assistant's text, and nothing else, are a range: the loss mask.

Tree. A node is an initial run of turns, known by its length and two 64-bit lanes: the
exclusive or of the hashes of (turn, place) so far. That is a running total, so one long
conversation is scanned in parts like any other sequence. Chains of nodes without branching
form segments; a node's path is the list of the first nodes of its segments. Sorted by (path,
length), which is done by ranges, the nodes stand in depth-first order, and running totals
give each its ``place`` and its ``start`` in one token stream. Position ids count from
``position``, the tokens above the node. A token may attend to the token ranges in
``ancestors`` and to the earlier tokens of its own node; neighbouring ranges are merged, so
their number is that of the branchings above, not of the turns.

Tokens are made once per distinct turn. Everything but the distinct turns' texts moves as
hashes. Reading back takes the written nodes alone: the ranges of a conversation's last node
name the nodes of its turns; a digest over a conversation is sequential, so its turns pass
one task as a stream, of which only one turn is held.

Rows go by turn, then by a digest. Defined results: null texts and roles count as empty; null
turns come last; rows with a null conv_id are one conversation; equal conversations end in
the same node; repeated rows are turns of their own; an empty table gives empty results.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turfline.llm.common import table
from turfline.session import settle

NO_ID = (1 << 63) - 1
LEARNED = "assistant"
IN_TEXT, IN_ROLE = re.compile(r"[\\#]|(?<=<)/"), re.compile(r"[\\#:]|(?<=<)/")
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
TURN = re.compile(r"### ((?:[^\\:]|\\.)*): (.*)</turn>\n", re.DOTALL)
END = "</turn>\n"
#: Hexadecimal digits of a segment in a path.
STEP = 32
RANGES = "ancestors array<struct<start:long,end:long,first:long,last:long>>"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def codec(path: str):
    """The tokenizer, with the strings of special tokens taken as ordinary text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def escape(text: str, inside: re.Pattern = IN_TEXT) -> str:
    return inside.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def mark(role: str) -> str:
    return f"### {escape(role, IN_ROLE)}: "


def opened(formatted: str) -> tuple[str, str]:
    """(role, text) of a formatted turn."""
    role, text = TURN.fullmatch(formatted).groups()
    return unescape(role), unescape(text)


def turns(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text, d1, d2) of every row; d1 and d2 are a digest of role and text."""
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv"),
        F.coalesce(F.col("turn").cast("long"), F.lit(NO_ID)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    lanes = {f"d{i}": F.xxhash64(F.lit(i), "role", F.lit(-i), "text") for i in (1, 2)}
    return rows.withColumns(lanes)


def encoded(rows: DataFrame, path: str) -> DataFrame:
    """Tokens of every distinct turn: (d1, d2, role, tokens, loss_from, loss_to, n_tokens)."""

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, tokenizer = {}, codec(path)

        def fixed(text: str) -> list[int]:
            if len(text) > 100:
                return tokenizer.encode(text, add_special_tokens=False).ids
            if text not in known:
                known[text] = tokenizer.encode(text, add_special_tokens=False).ids
            return known[text]

        for frame in frames:
            bodies = tokenizer.encode_batch([escape(t) for t in frame["text"]], add_special_tokens=False)
            out = []
            for role, body in zip(frame["role"], bodies, strict=True):
                head, tail, ids = fixed(mark(role)), fixed(END), body.ids
                learned = (len(head), len(head) + len(ids)) if role == LEARNED else (0, 0)
                out.append(([*head, *ids, *tail], *learned, len(head) + len(ids) + len(tail)))
            tokens = pd.DataFrame(out, columns=["tokens", "loss_from", "loss_to", "n_tokens"], index=frame.index)
            yield pd.concat([frame[["d1", "d2", "role"]], tokens], axis=1)

    distinct = rows.groupBy("d1", "d2").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    kinds = "d1 long, d2 long, role string, tokens array<int>, loss_from int, loss_to int, n_tokens long"
    return distinct.mapInPandas(encode, kinds)


_TOTAL = {"sum": (F.sum, lambda a, b: a + b), "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b))}


def carried(rows: DataFrame, key: str, order: list[str], running: dict[str, tuple[Column, str]]) -> DataFrame:
    """Running totals along ``order`` inside ``key``, over the ordered parts in ``part``: each
    part is scanned alone, and the totals of the parts before it are carried in."""
    rows = rows.withColumns({f"_{name}": value for name, (value, _) in running.items()})
    upto = W.partitionBy(key, "part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(key).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy(key, "part").agg(*[_TOTAL[how][0](f"_{name}").alias(f"_{name}") for name, (_, how) in running.items()])
    carry = totals.select(
        key, "part", *[F.coalesce(_TOTAL[how][0](f"_{name}").over(before), F.lit(0).cast("long")).alias(f"_before_{name}") for name, (_, how) in running.items()]
    )
    local = rows.withColumns({name: _TOTAL[how][0](f"_{name}").over(upto) for name, (_, how) in running.items()})
    whole = local.join(carry, [key, "part"])
    whole = whole.withColumns({name: _TOTAL[how][1](F.col(name), F.col(f"_before_{name}")) for name, (_, how) in running.items()})
    return whole.drop(*[f"{p}_{name}" for name in running for p in ("", "_before")])


def in_parts(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` dealt out by ranges of ``order`` and written, with the number of the range."""
    return settle(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), name)


def chains(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per turn: conv, part, pos (from 1), its node (n1, n2, pos) and the node before (m1, m2)."""
    order = ["turn", "d1", "d2", "salt"]
    salted = rows.select("conv", "turn", "d1", "d2", F.monotonically_increasing_id().alias("salt"))
    numbered = carried(in_parts(salted, ["conv", *order], "turns"), "conv", order, {"pos": (F.lit(1).cast("long"), "sum")})
    own = {f"h{i}": F.xxhash64(f"d{i}", "pos") for i in (1, 2)}
    chained = carried(numbered.withColumns(own), "conv", ["pos"], {"n1": (F.col("h1"), "xor"), "n2": (F.col("h2"), "xor")})
    before = {f"m{i}": F.col(f"n{i}").bitwiseXOR(F.col(f"h{i}")) for i in (1, 2)}
    kept = chained.withColumns(before).select("conv", "part", "pos", "d1", "d2", "n1", "n2", "m1", "m2")
    return settle(kept.join(sizes, ["d1", "d2"]), "chains")


def _segment() -> Column:
    return F.concat(*[F.lpad(F.hex(c), STEP // 2, "0") for c in ("n1", "n2")])


def _merged(ranges: Column) -> Column:
    """Ranges in order, neighbouring ones made one."""
    last = lambda done: F.element_at(done, -1)
    joined = lambda done, x: F.concat(
        F.slice(done, 1, F.size(done) - 1),
        F.array(F.struct(last(done)["start"].alias("start"), x["end"].alias("end"), last(done)["first"].alias("first"), x["last"].alias("last"))),
    )
    step = lambda done, x: F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end"] == x["start"]), joined(done, x)).otherwise(
        F.concat(done, F.array(x))
    )
    return F.aggregate(ranges, F.lit([]).cast(RANGES.split(" ", 1)[1]), step)


def build(conversations: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, leaves), both written.

    nodes: place, start, position, role, tokens, loss_from, loss_to, ancestors, in any order of
    rows; by ``start`` their tokens are the stream. leaves: conv_id and the place of the node of
    its last turn.
    """
    rows = turns(conversations)
    texts = settle(encoded(rows, path or vocabulary()), "texts")
    chained = chains(rows, texts.select("d1", "d2", "n_tokens"))
    node = ["n1", "n2", "pos"]
    found = chained.groupBy(*node).agg(*[F.min(c).alias(c) for c in ("conv", "d1", "d2", "m1", "m2", "n_tokens")])
    found = settle(found, "nodes")
    # Written, so that the join on it stands alone and a hot first turn can be split.
    branching = settle(found.where("pos > 1").groupBy("m1", "m2", "pos").agg(F.count("*").alias("children")).where("children > 1"), "branching")
    marked = chained.select("conv", "part", *node, "m1", "m2", "n_tokens").join(branching, ["m1", "m2", "pos"], "left")
    head = ((F.col("pos") == 1) | F.col("children").isNotNull()).cast("long")
    scan = carried(
        marked.withColumn("head", head), "conv", ["pos"], {"heads": (F.col("head"), "sum"), "below": (F.col("n_tokens"), "sum")}
    )
    scan = settle(scan.select("conv", "pos", "n1", "n2", "head", "heads", (F.col("below") - F.col("n_tokens")).alias("position")), "scan")
    so_far = W.partitionBy("conv").orderBy("heads").rowsBetween(W.unboundedPreceding, 0)
    paths = scan.where("head = 1").select("conv", "heads", F.concat_ws("", F.collect_list(_segment()).over(so_far)).alias("path"))
    own = scan.select("conv", "pos", "heads", "position")
    pathed = found.drop("m1", "m2").join(own, ["conv", "pos"]).join(paths, ["conv", "heads"]).drop("heads", "conv")
    ordered = in_parts(pathed.withColumn("all", F.lit(0)), ["path", "pos"], "depth-first")
    placed = carried(ordered, "all", ["path", "pos"], {"place": (F.lit(1).cast("long"), "sum"), "end": (F.col("n_tokens"), "sum")})
    placed = settle(
        placed.select("path", *node, "d1", "d2", "position", (F.col("place") - 1).alias("place"), (F.col("end") - F.col("n_tokens")).alias("start"), "end"),
        "placed",
    )
    segments = placed.groupBy("path").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("place").alias("first"), F.max("place").alias("last"))
    segments = settle(segments, "segments")
    depth = F.expr(f"explode(sequence(1, CAST(length(path) / {STEP} AS INT) - 1))")
    above = segments.where(F.length("path") > STEP).select("path", depth.alias("depth"))
    above = above.withColumn("upper", F.expr(f"substring(path, 1, depth * {STEP})"))
    spans = segments.select(F.col("path").alias("upper"), F.struct("start", "end", "first", "last").alias("span"))
    lists = above.join(spans, "upper").groupBy("path").agg(F.sort_array(F.collect_list("span")).alias("above"))
    begins = segments.select("path", F.col("first").alias("opens"), F.col("start").alias("opens_at"))
    inner = F.when(
        F.col("place") > F.col("opens"),
        F.array(F.struct(F.col("opens_at").alias("start"), F.col("start").alias("end"), F.col("opens").alias("first"), (F.col("place") - 1).alias("last"))),
    )
    kind = RANGES.split(" ", 1)[1]
    ranges = F.concat(F.coalesce("above", F.lit([]).cast(kind)), F.coalesce(inner, F.lit([]).cast(kind)))
    spread = placed.join(begins, "path").join(lists, "path", "left").withColumn("ancestors", _merged(ranges))
    nodes = spread.select("d1", "d2", "place", "start", "position", "ancestors").join(texts, ["d1", "d2"])
    nodes = settle(nodes.select("place", "start", "position", "role", "tokens", "loss_from", "loss_to", "ancestors"), "tree")
    ends = scan.groupBy("conv").agg(F.max("pos").alias("pos"), F.max_by("n1", "pos").alias("n1"), F.max_by("n2", "pos").alias("n2"))
    leaves = ends.join(placed.select(*node, "place"), node)
    return nodes, settle(leaves.select(F.when(F.col("conv") != NO_ID, F.col("conv")).alias("conv_id"), "place"), "leaves")


def decoded(nodes: DataFrame, path: str | None = None) -> DataFrame:
    """(place, role, text, learned, formatted) of the turn of every node, from its tokens alone;
    learned is the text under the loss mask, formatted the number of its characters as formatted."""
    path = path or vocabulary()

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = codec(path)
        for frame in frames:
            out = []
            for place, tokens, begin, end in frame.itertuples(index=False):
                formatted = tokenizer.decode(list(tokens), skip_special_tokens=False)
                learned = tokenizer.decode(list(tokens[begin:end]), skip_special_tokens=False)
                out.append((place, *opened(formatted), unescape(learned), len(formatted)))
            yield pd.DataFrame(out, columns=["place", "role", "text", "learned", "formatted"])

    columns = nodes.select("place", "tokens", "loss_from", "loss_to")
    return columns.mapInPandas(decode, "place long, role string, text string, learned string, formatted long")


def paths_of(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """(conv_id, place): the node of every turn of every conversation, from the ranges of its leaf."""
    ends = leaves.join(nodes.select("place", "ancestors"), "place")
    ranges = F.concat(F.transform("ancestors", lambda r: F.struct(r["first"].alias("first"), r["last"].alias("last"))), F.array(F.struct(F.col("place").alias("first"), F.col("place").alias("last"))))
    spans = ends.select("conv_id", F.explode(ranges).alias("span"))
    return spans.select("conv_id", F.explode(F.sequence("span.first", "span.last")).alias("place"))


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digests of conversations whose turns come in order; one turn is held at a time."""
    conv, state = None, None

    def closed():
        return (conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

    columns = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    for frame in frames:
        out = []
        for key, role, text, learned, formatted in frame.itertuples(index=False):
            if key != conv:
                if state is not None:
                    out.append(closed())
                conv, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            state[2] += len(learned)
            state[3].update(learned.encode())
            state[4] += formatted
        yield pd.DataFrame(out, columns=columns)
    if state is not None:
        yield pd.DataFrame([closed()], columns=columns)


def read_back(nodes: DataFrame, leaves: DataFrame, path: str | None = None) -> DataFrame:
    """Per conversation, from the written tree: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars."""
    on_path = paths_of(nodes, leaves).withColumn("conv", F.coalesce("conv_id", F.lit(NO_ID)))
    said = on_path.join(decoded(nodes, path), "place").select("conv", "place", "role", "text", "learned", "formatted")
    dealt = said.repartition("conv").sortWithinPartitions("conv", "place").drop("place")
    kinds = "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    read = dealt.mapInPandas(_digests, kinds)
    return read.withColumn("conv_id", F.when(F.col("conv") != NO_ID, F.col("conv"))).select("conv_id", *[c for c in read.columns if c != "conv"])


QUERY = "op13_chat_tree"
PROBE = "\\### Assistant: </turn> ok"


def query(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, LEARNED, PROBE)], given.schema)
    return read_back(*build(given.unionByName(probe)))


ORACLE_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, 14 + length(role) + length(text)
    + length(regexp_replace(role, '[^\\#:]', '', 'g')) + (length(role) - length(replace(role, '</', ''))) // 2
    + length(regexp_replace(text, '[^\\#]', '', 'g')) + (length(text) - length(replace(text, '</', ''))) // 2 AS formatted
  FROM rows
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(formatted) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
