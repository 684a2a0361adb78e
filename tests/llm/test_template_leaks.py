import random

from turfline.llm import template_leaks as T

ITEM = (
    "A train leaves Paris at 9 with 120 people and Alice drives 60 km to Lyon while Bob waits 3 hours "
    "for Alice there and pays 15 % more than the others do"
)
OTHER = (
    "Yesterday a train leaves Rome at 8 with 95 people and Carol drives 75 miles to Milan while Dave waits 2 days "
    "for Carol there and pays 20% more than the others do"
)


def found(docs, items):
    return sorted((r.doc_id, r.item_id) for r in T.leaks(docs, items).collect())


def test_exact_changed_and_clean(spark, frame):
    rng = random.Random(1)
    filler = " ".join(rng.choice("lorem ipsum dolor sit amet elit sed do".split()) for _ in range(3000))
    loose = OTHER.split()
    loose[11:11] = ["indeed", "so"]
    rows = [
        (1, ITEM), (2, f"{filler}. {ITEM}. {filler}"), (3, OTHER), (4, ITEM.lower()), (5, ITEM.upper()), (6, " ".join(loose)),
        (7, ITEM.replace(" ", "*** ")), (8, filler), (9, "A train leaves town"), (10, None), (11, ""),
        (12, "In all 9 towns with 120 people Alice drives 60 km to the sea and rests"), (13, ITEM), (13, ITEM),
    ]
    items = spark.createDataFrame([(5, ITEM), (6, ITEM), (7, None), (8, ""), (None, "some other item text is here now")], "item_id long, text string")
    assert found(frame(rows), items) == [(d, 5) for d in (1, 2, 3, 4, 5, 6, 7, 13)]
    by = {r.doc_id: r for r in T.leaks(frame(rows), items).collect()}
    assert by[1].changed_slots == 0 and by[3].changed_slots >= 8 and by[1].coverage == 1.0


def test_slots_must_agree(spark, frame):
    """The same benchmark name must always have the same value in the document."""
    item = "When Ann gives the red box to Ben then Ann takes the old map from Ben and Ann sees that Ben leaves Ann alone at last"
    same = item.replace("Ann", "Eve").replace("Ben", "Sam")
    names = iter(["Eve", "Sam", "Kim", "Lea", "Tom", "Ida", "Max", "Zoe"])
    mixed = " ".join(next(names) if w in ("Ann", "Ben") else w for w in item.split())
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert found(frame([(1, same), (2, mixed)]), items) == [(1, 1)]


def test_short_items_and_partial_passages(spark, frame):
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, "tiny item here now"), (3, "two words")], "item_id long, text string")
    rows = [(1, " ".join(words[:26])), (2, " ".join(words[:12])), (3, "so a tiny item here now then"), (None, "tiny item here now"), (4, "two words")]
    got = sorted((str(r.doc_id), r.item_id) for r in T.leaks(frame(rows), items).collect())
    assert got == [("1", 1), ("3", 2), ("None", 2)]


def test_decontaminated_keeps_the_others(spark, frame, odd):
    docs = frame([*odd, (50, ITEM), (51, "clean text of no item")])
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    rows = T.decontaminated(docs, items)
    assert rows.columns == docs.columns
    got = sorted(str(r.text) for r in rows.collect())
    assert got == sorted([str(t) for _, t in odd] + ["clean text of no item"])
    none = spark.createDataFrame([], "item_id long, text string")
    assert T.leaks(docs, none).collect() == [] and T.leaks(frame([]), items).collect() == []


def test_words_become_placeholders():
    words = T.Words()
    text = "If Alice has 12 apples and buys 5kg of pears for $3.50 then ALICE pays 20% to Bob in 7 km.\nBob runs"
    _, kinds, entries, _, _ = T.canonical([text], words)
    got = " ".join({0: "w", T.NUMBER: "<n>", T.NAME: "<a>", T.UNIT: "<u>"}[int(k)] for k in kinds)
    assert got == "w <a> w <n> w w w <n> <u> w w w <n> w w w <n> <u> w <a> w <n> <u> w w"
    assert [words.plain[e] for k, e in zip(kinds, entries, strict=True) if k == T.NAME] == ["alice", "bob"]


def test_names_that_open_sentences_or_have_other_capitals(spark, frame):
    short = "Maria buys 4 red pens. Jonas buys 7 blue pens. Maria sells 2 pens."
    other = short.replace("Maria", "Petra").replace("Jonas", "Felix")
    merged = other.replace(". Felix", " and Felix")
    capitals = "so then McDonald asks how many maps NASA gave O'Brien after McDonald had left the old town near NASA"
    changed = capitals.replace("McDonald", "Miller").replace("NASA", "ESA").replace("O'Brien", "Kim")
    mixed = "so then Miller asks how many maps ESA gave Kim after Kohl had left the old town near UNO"
    items = spark.createDataFrame([(1, short), (2, capitals)], "item_id long, text string")
    rows = [(1, other), (2, f"Well, {merged}"), (3, mixed), (4, changed), (5, short.lower()), (6, capitals)]
    assert found(frame(rows), items) == [(1, 1), (2, 1), (4, 2), (5, 1), (6, 2)]
