import hashlib
import math
import random
import re

from turfline.llm import disclosure as D

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    return sorted((m.start(), i, m.end()) for i, k in enumerate(PLAIN) for m in re.finditer(PLAIN[k], text or "") if valid(k, m[0]))


def test_base_spans(frame, odd):
    rng = random.Random(3)
    rows = odd + [
        (100, "a@b.com%x@y.org 1.2.3.4.5.6.7.8 001.0255.0.0"), (101, "4111 1111 1111 1111, 4111-1111-1111-1112"),
        (102, "+1 (743) 555-3824 +44 20 7946 0958. +1((((( 5 +12"), (103, "9" * 30_000), (104, "1.1" * 3_000), (105, "1 " * 20_000),
        (106, "é😀 joe@mail.example.com 😀 10.0.0.1 " * 300), (107, "a" * 50_000 + "@"), (108, "@.@a.b+-1" * 2_000),
    ]
    rows += [(200 + i, "".join(rng.choice("a1.@+- ()9%é😀4.1") for _ in range(rng.randrange(120)))) for i in range(300)]
    got = D.sanitise(frame(rows)).collect()
    assert len(got) == len(rows)
    names = list(PLAIN)
    texts = {d: t for d, t in rows if d is not None}
    for r in got:
        if r.doc_id is None:
            continue
        want = brute(texts[r.doc_id])
        written = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in want)
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest(), r.doc_id
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for _, k, _ in want) for i in range(4))
        assert set(written.split(",")) <= set(r.spans.split(",")) and r.n_term == len(r.spans.split(",")) - len(written.split(","))


def test_disclosing_terms(frame):
    rows = [(i, f"Contact the wizard Zephyrine at joe@x.org number {i} please") for i in range(6)]
    rows += [(100 + i, f"Filler please contact the number {i} something else wizard") for i in range(200)]
    rows += [(400, "Zephyrine alone is not beside any address")]
    docs = frame(rows)
    texts = {r.doc_id: r.text for r in D.sanitised_texts(docs).collect()}
    # zephyrine: in 7 documents, 6 with the address; wizard, contact, the: in nearly all
    share = math.log(6 * 207 / (6 * 7)) / math.log(207 / 6)
    assert 0.9 < share < 1
    assert texts[3] == "Contact the wizard  at <EMAIL> number 3 please" and texts[400] == rows[-1][1]
    assert all(texts[d] == t for d, t in rows[6:])
    assert D.sanitised_texts(docs).columns == docs.columns


def test_generalised_between_thresholds_and_support(frame):
    rows = [(i, f"Doctor Quill of ward{i} has joe@x.org here {i}") for i in range(4)]
    rows += [(10 + i, f"Doctor Quill {i}") for i in range(5)] + [(50 + i, f"Doctor no {i} has been here") for i in range(300)]
    rows += [(500, "Rare bird eve@y.org"), (501, "Rare bird eve@y.org"), (502, "Rare bird eve@y.org ")]
    texts = {r.doc_id: r.text for r in D.sanitised_texts(frame(rows)).collect()}
    assert texts[0] == "Doctor Q. of ward0 has <EMAIL> here 0"
    # two different texts only: below the support
    assert texts[500] == "Rare bird <EMAIL>"


def test_odd_rows_and_no_rows(frame, odd):
    docs = frame(odd)
    before = sorted(str(t) for _, t in odd)
    assert sorted(str(r.text) for r in D.sanitised_texts(docs).collect()) == before
    assert D.sanitise(frame([])).collect() == [] and D.sanitised_texts(frame([])).collect() == []


def test_terms_of_whole_documents_at_every_place(frame):
    """A term far from the entity discloses it too, and every copy of it is marked."""
    far = " ".join(["filler text here"] * 40)
    rows = [(i, f"Zephyrine {far} writes from joe@x.org now. {far} Again zephyrine, number {i}") for i in range(6)]
    rows += [(100 + i, f"filler text here writes from now again number {i}") for i in range(300)]
    rows += [(400, "Zephyrine alone, no address")]
    texts = {r.doc_id: r.text for r in D.sanitised_texts(frame(rows)).collect()}
    assert texts[2] == f" {far} writes from <EMAIL> now. {far} Again , number 2" and texts[400] == rows[-1][1]


def test_entities_of_one_text(frame):
    """One text is enough for words that hardly any other has; words of a span or joined to it stay."""
    rows = [(1, "Quixotic gardener eve@y.org and ann@z.org, éabc1.2.3.4 writes; 😀 quixotic! again")]
    rows += [(10 + i, f"gardener writes and again {i}") for i in range(1500)]
    got = {r.doc_id: r for r in D.sanitise(frame(rows)).collect()}
    assert got[1].spans == "term:0:8,email:18:27,email:32:41,ip:47:54,term:65:73" and got[1].n_term == 2
    assert {r.spans for d, r in got.items() if d != 1} == {""}
