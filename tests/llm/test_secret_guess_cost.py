import hashlib
import math
import random
import re

from turfline.llm import secret_guess_cost as S

RANKED = "the of and password to in that secret monkey dragon correct horse battery staple admin welcome love".split()


def base(text):
    out = []
    for kind, pattern, least, group in (
        ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
        ("access", r"AKIA[A-Z0-9]+", 16, 0), ("hex", r"[0-9a-f]+", 32, 0),
    ):
        out += [(m.start(), ["assign", "access", "hex"].index(kind), m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return sorted(out)


def test_base_kinds(frame, odd):
    rng = random.Random(1)
    parts = ["password", "TOKEN", "api_key", "ApiKey", "secret", "=", ":", ' "', "'", " ", "\n", "é", "😀", "abcdef01" * 4, "AKIA" + "Q7" * 8, "x9-_.=/+", "ſecret", "toKen: "]
    rows = odd + [(100 + i, "".join(rng.choice(parts) for _ in range(30))) for i in range(400)]
    got = S.secrets(frame(rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for d, t in rows:
        want = base(t or "")
        text = ",".join(f"{['assign', 'access', 'hex'][k]}:{s}:{e}" for s, k, e in want)
        match = [r for r in by[d] if r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()]
        assert match, (d, t)
        assert (match[0].n_assign, match[0].n_access, match[0].n_hex) == tuple(sum(k == n for _, k, _ in want) for n in range(3))
        assert set(text.split(",")) - {""} <= set(match[0].spans.split(","))


def test_guess_spans_need_cost_and_context():
    costs = S.GuessCost(RANKED)

    def kinds(text):
        return [(k, text[s:e]) for s, k, e in S.scan(text, costs)]

    assert kinds("my pwd: x9K#pQ7!vLm2.") == [(3, "x9K#pQ7!vLm2")]
    assert kinds("bearer eyJhbGciOi.JIUzI1NiIsIn.R5cCI6") == [(3, "eyJhbGciOi.JIUzI1NiIsIn.R5cCI6")]
    assert kinds("pwd: correcthorse") == kinds("pwd: monkeymonkey") == kinds("pwd: 2024-01-31") == kinds("pwd: qwertyuiop") == []
    assert kinds("x9K#pQ7!vLm2 stands alone") == kinds("") == []
    # What a fixed pattern has found is not found again.
    assert kinds("token = abcdefgh12345678XYZ") == [(0, "token = abcdefgh12345678XYZ")]


ROWS = ["`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./"]
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def headings(a, b):
    """Directions from key a to key b, from places on the board."""
    found = set()
    for row in [*ROWS, LETTERS]:
        if a in row and b in row and abs(row.index(a) - row.index(b)) == 1:
            found.add(("letter" if row is LETTERS else "row", row.index(b) - row.index(a)))
    place = {c: (y, x - (1 if y == 0 else 0)) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
    if a in place and b in place:
        (ya, xa), (yb, xb) = place[a], place[b]
        for side in (0, 1):
            if yb == ya - 1 and xb == xa + side and xb >= 0:
                found.add((f"up{side}", 1))
            if ya == yb - 1 and xa == xb + side and xa >= 0:
                found.add((f"up{side}", -1))
    return found


def straight(keys, i, j):
    """Directions that all steps of keys i..j share."""
    return set.intersection(*(headings(a, b) for a, b in zip(keys[i:j], keys[i + 1 : j + 1], strict=True)))


def walks_from(keys, start):
    """All (end, cost) of walks that begin at ``start``, by going through all chains of runs."""
    def extend(i, j, ways, cost):
        yield j + 1, cost
        for k in range(j + 1, len(keys)):
            if turn := straight(keys, j, k):
                yield from extend(j, k, turn, cost + math.log10(8 * (k - j)))
        if j + 2 < len(keys) and headings(keys[i], keys[j + 1]):
            for k in range(j + 2, len(keys)):
                if jump := straight(keys, j + 1, k):
                    same = k - j - 1 == j - i and jump & ways
                    yield from extend(j + 1, k, jump, cost + math.log10(8) + math.log10(2 if same else 8 * (k - j - 1)))

    for j in range(start + 1, len(keys)):
        if ways := straight(keys, start, j):
            yield from extend(start, j, ways, math.log10(47) + math.log10(8 * (j - start)))


def plain_least(value, words):
    """Least cost over every way to cut the value into spans, each priced on its own."""
    low, known = value.lower(), {w: i + 1 for i, w in enumerate(words)}
    looks = dict(zip("4@8310!5$7+2", "aabeloissttz", strict=True))

    def priced(i):
        for j in range(i + 1, len(value) + 1):
            yield j, float(j - i)
            span = value[i:j]
            for form in {low[i:j], "".join(looks.get(c, c) for c in low[i:j])}:
                if len(form) >= 3 and form in known:
                    big = sum(c.isupper() for c in span)
                    forms = 1 if big == 0 else 2 if big in (1, len(span)) else sum(math.comb(len(span), k) for k in range(1, min(big, len(span) - big) + 1))
                    yield j, max(0.3, math.log10(known[form] * forms * 2 ** sum(a != b for a, b in zip(form, low[i:j], strict=True))))
            if re.fullmatch(r"(19|20)\d\d", span):
                yield j, math.log10(120)
            if re.fullmatch(r"(19|20)\d\d(0?[1-9]|1[0-2])(0?[1-9]|[12]\d|3[01])|(0?[1-9]|[12]\d|3[01]){2}((19|20)\d\d|\d\d)", span):
                yield j, math.log10(120 * 366)
            for unit in range(1, (j - i) // 2 + 1):
                if (j - i) % unit == 0 and span == span[:unit] * ((j - i) // unit):
                    yield j, max(0.3, plain_least(span[:unit], words)) + math.log10((j - i) / unit)
        yield from walks_from(low, i)

    best = [0.0] + [math.inf] * len(value)
    for i in range(len(value)):
        for j, cost in priced(i):
            best[j] = min(best[j], best[i] + cost + (1.0 if i else 0.0))
    return best[-1]


def test_least_cost_is_the_best_segmentation():
    costs, rng = S.GuessCost(RANKED), random.Random(3)
    parts = ["love", "the", "a", "7", "1999", "asd", "Q", "zz", "qwe", "1qaz", "2wsx", "fed", "aab", "31121999", "fghj", "tr", "P@ss"]
    for _ in range(400):
        value = "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))[:11]
        assert abs(costs.least(value) - plain_least(value, RANKED)) < 1e-9, value
    for value in ("aabaabaabaab", "qwertyuiop", "1qaz2wsx3edc"):
        assert abs(costs.least(value) - plain_least(value, RANKED)) < 1e-9, value


def test_walks_and_repeats_are_no_secrets():
    costs = S.GuessCost(RANKED)
    for value in ("qwertyuiopasdfghjkl", "1qaz2wsx3edc", "qazwsxedcrfv", "zxcvbnmasdfghjkl", "aabaabaabaab", "abcdefghijklmnop"):
        assert S.scan(f"passcode: {value}", costs) == [], value
    assert costs.least("aabaabaabaab") < 4 and costs.least("qwertyuiop") < 4 and costs.least("zxcvbnm") < 4
    assert costs.least("") == 0.0


def test_long_values_stay_cheap_to_price():
    costs = S.GuessCost(RANKED)
    for value in ("a" * 20_000, "ab" * 10_000, "qw" * 5_000, "".join(random.Random(1).choices("abcdefghij0123", k=20_000))):
        assert costs.least(value) > 0


def test_known_shapes_are_cheap():
    costs = S.GuessCost(RANKED)
    assert costs.least("P@ssw0rd") < 5 < costs.least("kT5vQ0xZ")
    assert costs.least("a" * 40) < 4 and costs.least("abcdefghijkl") < 7 and costs.least("31.12.1999") < 7


def test_dictionary_counts_whole_corpus(frame):
    rows = [(1, "Alpha beta, beta BETA."), (2, None), (3, "gamma alpha x9 of"), (4, "beta")]
    assert S.dictionary(frame(rows), 2) == ["beta", "alpha"]
    assert S.dictionary(frame(rows), 9) == ["beta", "alpha", "gamma"]
    tied = [(i, f"word{chr(97 + i)} common") for i in range(20)]
    assert S.dictionary(frame(tied), 4) == ["common", "worda", "wordb", "wordc"] and S.dictionary(frame([]), 4) == []
    assert S.secrets(frame([])).collect() == []


def test_every_name_of_a_credential_alone():
    """Whether a value is found depends on its own name only, not on other words of the text."""
    costs = S.GuessCost(RANKED)
    names = "password passwd pwd passphrase passcode secret secretkey secret_key token apikey api_key accesskey access_key"
    names += " accessKey PrivateKey private_key authkey AUTH_KEY credential credentials pin"
    for name in names.split():
        for text in (f"{name}: x9#F!kQ2$v", f"shopping {name}: x9#F!kQ2$v"):
            assert [(k, text[s:e]) for s, k, e in S.scan(text, costs)] == [(3, "x9#F!kQ2$v")], text
    assert S.scan("bearer x9#F!kQ2$vLm", costs) == [(7, 3, 19)]
