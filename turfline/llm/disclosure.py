"""Information-theoretic sanitisation of personal data (DataFrame functions only).

Protected entities are found by fixed patterns: e-mail and IP addresses, card and phone
numbers. A document that holds one may hold terms that give it away even when it is masked.
Following information-theoretic sanitisation (Sanchez and Batet 2016), the corpus says how
strongly: with N documents, D(e) of them holding entity e, D(t) holding term t and D(e, t)
holding e and, anywhere outside all entities, t,

    disclosure = log(D(e, t) N / (D(e) D(t))) / log(N / D(e)),

the part of the entity's information that the term reveals; 1 means that every document
with the term has the entity. A term whose disclosure reaches ``GENERALISE`` is generalised
to its first letter, from ``REMOVE`` on it is removed, at every place of the documents that
hold the entity. D(e, t) of pairs seen in fewer than ``SUPPORT`` different texts may be
chance and is discounted, as in back-off estimates: it counts ``DISCOUNT`` times. So the
entities of one or two texts take part, and their terms must be the rarer. Documents without
entities are never changed.

Entities of the same documents have the same disclosures, so they are counted as one: a long
text with very many entities of its own makes no pairs of each of them with each term. As
D(e, t) is at most D(e), only terms with D(t) <= N^(1 - GENERALISE) D(e)^GENERALISE can
disclose; this bound is exact and goes before the pairs.

Patterns are written so that the JVM matches them without recursion and in linear time; they
find exactly what the plain ones in the comments find. Positions are code points, from the
lengths of matches and of what lies between them.

Defined results: null counts as the empty text and has no span; a null text is no document
of the statistics; an entity that all documents hold has no information and discloses
nothing; repeated rows are one document of the statistics and are judged alike; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turfline.llm.common import row_key, table
from turfline.session import settle

KINDS = ["email", "ip", "card", "phone"]
SUPPORT, DISCOUNT, GENERALISE, REMOVE = 3, 0.25, 0.75, 0.9
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
TERM = r"[\p{L}\p{N}]{3,}"
#: Stands for every letter and digit of an entity; words with it overlap an entity.
HIDDEN = "\ue000"
OPEN_TERM = rf"[\p{{L}}\p{{N}}{HIDDEN}]{{3,}}"
BLOCK = 256
SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda s, x: s + x)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of at most 19 digits passes the check sum."""

    def value(i: Column) -> Column:
        digit = F.substr(number, F.length(number) - i, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(digit)

    places = F.sequence(F.lit(0), F.length(number) - 1)
    return total(F.transform(places, value)) % 10 == 0


def holds(kind: str, match: Column) -> Column:
    """Whether a match of the pattern is one of the kind."""
    if kind == "ip":
        return match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        right = let(digits(match), lambda d: F.length(d).between(14, 19) & luhn(d))
        return F.when(F.length(match) >= 14, right).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits(match)).between(10, 15)
    return F.lit(True)


def may_hold(kind: str, text: Column) -> Column:
    """Cheap test that a text could match."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    return text.rlike("[0-9][0-9. -]")


def found(kind: str, text: Column) -> Column:
    """Struct of the matches of a text and of the pieces between them; null where none can be."""
    pattern = F.lit(PATTERNS[kind])
    both = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("hits"), F.split(text, PATTERNS[kind], -1).alias("gaps"))
    return F.when(may_hold(kind, text), both)


def placed(hits: Column, gaps: Column, kept: Column, made, none: Column) -> Column:
    """``made(start, hit)`` of the matches whose numbers are ``kept``.

    Lengths are summed over blocks of matches, so a text with very many matches costs no
    quadratic time and only the kept matches are placed."""
    numbers = F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / BLOCK).cast("int"))
    steps = F.zip_with(gaps, hits, lambda g, h: F.length(g) + F.coalesce(F.length(h), F.lit(0)))

    def one(steps: Column, before: Column, i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        upto = F.element_at(before, block + 1) + total(F.slice(steps, block * BLOCK + 1, i - block * BLOCK))
        return made(upto + F.length(F.element_at(gaps, i + 1)), F.element_at(hits, i + 1))

    def over(steps: Column, kept: Column) -> Column:
        blocks = F.transform(numbers, lambda b: total(F.slice(steps, b * BLOCK + 1, F.lit(BLOCK))))
        before = let(blocks, lambda bl: F.transform(numbers, lambda b: total(F.slice(bl, F.lit(1), b))))
        return let(before, lambda be: F.transform(kept, lambda i: one(steps, be, i)))

    return let(kept, lambda k: F.when(F.size(k) > 0, let(steps, lambda st: over(st, k))).otherwise(none))


def positions(kind: str, pair: Column) -> Column:
    """Spans (start, kind number, end, value) of the matches that hold."""
    none = F.array().cast(SPANS)

    def span(start: Column, hit: Column) -> Column:
        return let(
            F.struct(start.alias("start"), hit.alias("hit")),
            lambda x: F.struct(
                x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"),
                (x["start"] + F.length(x["hit"])).alias("end"), x["hit"].alias("value"),
            ),
        )

    def spans(p: Column) -> Column:
        hits = p["hits"]
        kept = F.filter(F.sequence(F.lit(0), F.size(hits) - 1), lambda i: holds(kind, F.element_at(hits, i + 1)))
        return placed(hits, p["gaps"], kept, span, none)

    return F.when(F.size(pair["hits"]) > 0, let(pair, spans)).otherwise(none)


def hidden(text: Column, spans: Column) -> Column:
    """The text with ``HIDDEN`` for the letters and digits of the spans, all else in its place.
    Spans of one kind never overlap, so kinds are hidden one after the other."""

    def step(text: Column, own: Column) -> Column:
        def piece(i: Column) -> Column:
            start = F.when(i > 0, F.element_at(own, F.greatest(i, F.lit(1)))["end"]).otherwise(F.lit(0))
            last = i == F.size(own)
            end = F.when(last, F.length(text)).otherwise(F.element_at(own, F.when(last, F.lit(1)).otherwise(i + 1))["start"])
            value = F.when(last, F.lit("")).otherwise(F.element_at(own, F.when(last, F.lit(1)).otherwise(i + 1))["value"])
            return F.concat(F.substr(text, start + 1, end - start), F.regexp_replace(value, r"[\p{L}\p{N}]", HIDDEN))

        return F.when(F.size(own) > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.size(own)), piece), "")).otherwise(text)

    out = F.translate(text, HIDDEN, " ")
    for kind in map(F.lit, range(len(KINDS))):
        own = F.filter(spans, lambda s: s["kind"] == kind)  # noqa: B023
        out = let(F.struct(out.alias("text"), own.alias("own")), lambda x: step(x["text"], x["own"]))
    return out


def entities(docs: DataFrame) -> DataFrame:
    """Per row: uid, doc_id, spans in order; where there are any, digest of the text and the
    text with the spans hidden. Settled."""
    rows = docs.select(
        row_key().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").isNotNull().alias("present"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    raw = rows.withColumns({kind: found(kind, F.col("text")) for kind in KINDS})
    each = raw.withColumns({kind: F.coalesce(positions(kind, F.col(kind)), F.array().cast(SPANS)) for kind in KINDS})
    spans = each.select("uid", "doc_id", "present", "text", F.array_sort(F.concat(*KINDS)).alias("spans"))
    # Two spans of one start and kind cannot be, so the order is by start, then kind.
    return settle(
        spans.select(
            "uid", "doc_id", "present", "spans",
            F.when(F.size("spans") > 0, F.xxhash64("text")).alias("text_digest"),
            F.when(F.size("spans") > 0, hidden(F.col("text"), F.col("spans"))).alias("open_text"),
        ),
        "entities",
    )


def distinct_terms(text: Column, pattern: str) -> Column:
    hits = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return F.array_distinct(F.transform(hits, F.lower))


def held_by(found_entities: DataFrame) -> DataFrame:
    """(uid, owners, with_entity): the entities of each document, those of the same documents
    as one. ``owners`` is a digest of the set of documents."""
    key = lambda s: F.concat(s["kind"].cast("string"), F.lit(":"), F.when(s["kind"] >= 2, digits(s["value"])).otherwise(F.lower(s["value"])))
    each = found_entities.where(F.size("spans") > 0).select("uid", F.explode(F.array_distinct(F.transform("spans", key))).alias("entity"))
    each = settle(each.distinct(), "entity-documents")
    sets = each.groupBy("entity").agg(
        F.count("*").alias("with_entity"), F.bit_xor(F.xxhash64(F.lit(1), "uid")).alias("a"), F.bit_xor(F.xxhash64(F.lit(2), "uid")).alias("b")
    )
    sets = sets.select("entity", "with_entity", F.xxhash64("with_entity", "a", "b").alias("owners"))
    return settle(each.join(sets, "entity").select("uid", "owners", "with_entity").distinct(), "owners")


def document_counts(docs: DataFrame) -> DataFrame:
    """(term, documents) over the whole texts of all documents; every row of a text counts."""
    return docs.select(F.explode(distinct_terms(F.col("text"), TERM)).alias("term")).groupBy("term").agg(F.count("*").alias("with_term"))


def disclosures(docs: DataFrame, found_entities: DataFrame) -> DataFrame:
    """(uid, term, disclosure) of the terms that disclose an entity of the document. Settled."""
    documents = found_entities.where("present").agg(F.count("*").cast("double").alias("n"))
    terms = found_entities.where(F.size("spans") > 0).select("uid", "text_digest", F.explode(distinct_terms(F.col("open_text"), OPEN_TERM)).alias("term"))
    terms = terms.where(~F.contains("term", F.lit(HIDDEN))).distinct()
    met = terms.join(settle(document_counts(docs), "document-counts"), "term").join(F.broadcast(documents))
    met = met.join(held_by(found_entities), "uid")
    most = (1 - GENERALISE) * F.log("n") + GENERALISE * F.log("with_entity")
    pairs = settle(met.where(F.log("with_term") <= most + 1e-9).select("uid", "text_digest", "owners", "term", "with_entity", "with_term", "n"), "pairs")
    both = pairs.groupBy("owners", "term").agg(
        F.count("*").alias("with_both"), F.count_distinct("text_digest").alias("texts"), *[F.first(c).alias(c) for c in ["with_entity", "with_term", "n"]]
    )
    seen = F.when(F.col("texts") < SUPPORT, F.lit(DISCOUNT)).otherwise(F.lit(1.0)) * F.col("with_both")
    gained = F.log(seen * F.col("n") / (F.col("with_entity") * F.col("with_term")))
    share = gained / F.nullif(F.log(F.col("n") / F.col("with_entity")), F.lit(0.0))
    rated = both.select("owners", "term", share.alias("disclosure")).where(F.col("disclosure") >= GENERALISE)
    found_terms = pairs.select("uid", "owners", "term").join(rated, ["owners", "term"])
    return settle(found_terms.groupBy("uid", "term").agg(F.max("disclosure").alias("disclosure")), "disclosures")


TERMS = "array<struct<start:int,kind:int,end:int,by:string>>"


def term_marks(text: Column, risky: Column) -> Column:
    """Marks of every place of the ``risky`` terms (term, by) in a text with hidden spans. The
    terms are dealt into short lists, as each word is looked up."""
    none = F.array().cast(TERMS)

    def marks(pair: Column, lists: Column) -> Column:
        def looked_up(hit: Column) -> Column:
            return let(F.lower(hit), lambda low: F.filter(F.element_at(lists, F.pmod(F.hash(low), F.size(lists)) + 1), lambda x: x["term"] == low))

        def mark(start: Column, hit: Column) -> Column:
            return let(
                F.struct(start.alias("start"), hit.alias("hit")),
                lambda x: F.struct(
                    x["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), (x["start"] + F.length(x["hit"])).alias("end"),
                    F.element_at(looked_up(x["hit"]), 1)["by"].alias("by"),
                ),
            )

        hits = pair["hits"]
        kept = F.filter(F.sequence(F.lit(0), F.size(hits) - 1), lambda i: F.size(looked_up(F.element_at(hits, i + 1))) > 0)
        return F.when(F.size(hits) > 0, placed(hits, pair["gaps"], kept, mark, none)).otherwise(none)

    pair = F.struct(F.regexp_extract_all(text, F.lit(OPEN_TERM), F.lit(0)).alias("hits"), F.split(text, OPEN_TERM, -1).alias("gaps"))
    n = F.least(F.floor(F.size(risky) / 8).cast("int") + 1, F.lit(BLOCK))
    lists = F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.filter(risky, lambda x: F.pmod(F.hash(x["term"]), n) == b))
    both = F.struct(pair.alias("pair"), lists.alias("lists"))
    return F.when(F.size(risky) > 0, let(both, lambda x: marks(x["pair"], x["lists"]))).otherwise(none)


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in [*KINDS, "term"]])
    one = F.transform(
        spans,
        lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")),
    )
    return F.array_join(one, ",")


def sanitise(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: uid, doc_id, counts per kind, digest of the base spans, ``marks``
    (start, kind, end, what replaces it; an empty text removes it) and ``spans`` as text."""
    known = entities(docs)
    by = F.when(F.col("disclosure") < REMOVE, F.concat(F.upper(F.substring("term", 1, 1)), F.lit("."))).otherwise(F.lit(""))
    risky = disclosures(docs, known).groupBy("uid").agg(F.collect_list(F.struct("term", by.alias("by"))).alias("risky"))
    none = F.array().cast(TERMS)
    masks = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    base = F.transform("spans", lambda s: F.struct(s["start"], s["kind"], s["end"], F.element_at(masks, s["kind"] + 1).alias("by")))
    marked = known.join(risky, "uid", "left")
    marked = marked.withColumn("terms", F.when(F.col("risky").isNotNull(), term_marks(F.col("open_text"), F.col("risky"))).otherwise(none))
    rows = settle(marked.select("uid", "doc_id", "spans", "terms", F.array_sort(F.concat(base, "terms")).alias("marks")), "marks")

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return rows.select(
        "uid", "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.size("terms").cast("long").alias("n_term"),
        F.sha2(_written(F.col("spans")).cast("binary"), 256).alias("base_sha256"), _written(F.col("marks")).alias("spans"), "marks",
    )


def sanitised_texts(docs: DataFrame) -> DataFrame:
    """``docs`` with entities masked and disclosing terms generalised or removed in ``text``."""
    name = "_row_key_of_marks"
    marks = sanitise(docs).select(F.col("uid").alias(name), F.col("marks").alias(f"{name}_marks")).where(F.size(f"{name}_marks") > 0)
    joined = docs.withColumn(name, row_key()).join(marks.dropDuplicates([name]), name, "left")
    text = F.col("text")
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, mark: Column) -> Column:
        between = F.substr(text, state["at"] + 1, F.greatest(mark["start"] - state["at"], F.lit(0)))
        inside = mark["start"] < state["at"]
        out = F.when(inside, state["out"]).otherwise(F.concat(state["out"], between, mark["by"]))
        return F.struct(F.greatest(state["at"], mark["end"]).alias("at"), out.alias("out"))

    def finish(state: Column) -> Column:
        return F.concat(state["out"], F.substr(text, state["at"] + 1, F.length(text)))

    marked = F.when(F.col(f"{name}_marks").isNotNull(), F.aggregate(f"{name}_marks", begin, step, finish)).otherwise(text)
    return joined.select(*[marked.alias(c) if c == "text" else F.col(c) for c in docs.columns])


QUERY = "op4_disclosure"


def query(spark: SparkSession, folder: str) -> DataFrame:
    return sanitise(table(spark, folder, "documents")).drop("uid", "marks")


ORACLE_SQL = None
