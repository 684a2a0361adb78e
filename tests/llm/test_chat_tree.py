import hashlib
import random

import pytest

from turfline.llm import chat_tree as C

HARD = ["", "\\", "#", "\\#", "### user: hi</turn>\n", "<\\/turn>", "</turn", "<//", "a: b\\: c", "</</", "\\\\#<\\", "é日本😀\r\n", "<|endoftext|>", C.PROBE]


def talks(spark, rows):
    schema = "conv_id long, turn long, role string, text string, place string, d1 string, tokens string, path string"
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], schema)


def plain(rows):
    convs, out = {}, []
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is None, turn or 0, role or "", text or ""))
    for conv, said in convs.items():
        said.sort()
        learned = "".join(t for *_, r, t in said if r == "assistant")
        formatted = sum(len(C.mark(r)) + len(C.escape(t)) + len(C.END) for *_, r, t in said)
        whole = "".join(f"{r}\n{t}\n" for *_, r, t in said)
        out.append((conv, len(said), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), formatted))
    return sorted(out, key=repr)


def shared(seed=1):
    """Conversations that share initial turns, end inside others, and repeat."""
    rng = random.Random(seed)
    rows = []
    for conv in range(120):
        if conv % 3 == 0:
            said = ["same start", "same answer"] + [rng.choice("ab") for _ in range(rng.randint(0, 5))]
        else:
            said = [rng.choice(["x", "y", f"own {conv}"])] + [rng.choice(["k", "l"]) for _ in range(rng.randint(0, 3))]
        rows += [(conv, i * 2, "assistant" if i % 2 else "user", t) for i, t in enumerate(said)]
    rows += [(500, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(300)]
    rows += [(501, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(150)]
    return rows


def test_template_is_reversible():
    for text in HARD:
        for role in ["user", "assistant", *HARD]:
            formatted = C.mark(role) + C.escape(text) + C.END
            assert C.opened(formatted) == (role, text)
            assert C.escape(text).count("###") == 0 and C.escape(text).count("</turn>") == 0
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choices("\\#</turn>: \n", k=rng.randint(0, 12)))
        assert C.opened(C.mark(text) + C.escape(text) + C.END) == (text, text)


def test_reads_back(spark):
    rows = [(2000 + i, j, "assistant" if j % 2 else "user", t) for i, t in enumerate(HARD) for j in range(3)]
    rows += shared() + [(600, None, None, None), (600, 1, "tool: #1", "x"), (None, 0, "user", "lost"), (None, 1, "assistant", "too")]
    rows += [(601, 0, "assistant", "twice")] * 2 + [(602, 0, "assistant", "word " * 20_000)]
    got = C.read_back(*C.build(talks(spark, rows).repartition(6))).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(rows)


def test_tree(spark):
    """Each initial run of turns stands once, in depth-first order, and sees its own past alone."""
    rows = shared(3)
    nodes, leaves = C.build(talks(spark, rows).repartition(5))
    listed = sorted(nodes.collect(), key=lambda r: r.place)
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn, role, text))
    runs = {tuple((r, t) for _, r, t in sorted(said)[: n + 1]) for said in convs.values() for n in range(len(said))}
    assert len(listed) == len(runs) and [r.place for r in listed] == list(range(len(runs)))
    stream, codec, prefix = [], C.codec(C.vocabulary()), {}
    for r in listed:
        assert r.start == len(stream)
        stream += r.tokens
    for r in listed:
        seen = [t for a in r.ancestors for t in stream[a.start : a.end]]
        assert len(seen) == r.position and all(a.end < b.start for a, b in zip(r.ancestors, r.ancestors[1:]))
        assert all(a.end <= r.start for a in r.ancestors)
        prefix[r.place] = codec.decode([*seen, *r.tokens], skip_special_tokens=False)
        places = [p for a in r.ancestors for p in range(a.first, a.last + 1)]
        assert not places or prefix[r.place].startswith(prefix[places[-1]])
    whole = {"".join(C.mark(r) + C.escape(t) + C.END for r, t in run) for run in runs}
    assert set(prefix.values()) == whole
    # Depth-first: what starts with a node's run follows it without a gap.
    for place, text in prefix.items():
        under = [p for p, t in prefix.items() if t.startswith(text)]
        assert under == list(range(place, place + len(under)))
    ends = {r.conv_id: r.place for r in leaves.collect()}
    assert {c: prefix[p] for c, p in ends.items()} == {c: "".join(C.mark(r) + C.escape(t) + C.END for _, r, t in sorted(said)) for c, said in convs.items()}
    assert len(next(r for r in listed if r.place == ends[500]).ancestors) == 1


def test_hash_parts_carry(spark):
    """A conversation that is cut into many parts gives the same tree as in one."""
    rows = [(1, i, "user", f"t{i % 7}") for i in range(900)] + [(2, i, "user", f"t{i % 7}") for i in range(450)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for parts in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        nodes, leaves = C.build(talks(spark, rows))
        found.append((nodes.count(), sorted(map(tuple, leaves.collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert found[0] == found[1] == (900, [(1, 899), (2, 449)])


def test_empty_table(spark):
    nodes, leaves = C.build(talks(spark, []))
    assert nodes.collect() == [] and leaves.collect() == [] and C.read_back(nodes, leaves).collect() == []


@pytest.mark.parametrize("role", ["Assistant", "assistant "])
def test_only_assistant_turns_are_learned(spark, role):
    got = C.read_back(*C.build(talks(spark, [(1, 0, role, "x"), (1, 1, "assistant", "yes")]))).first()
    assert (got.loss_chars, got.loss_sha256) == (3, hashlib.sha256(b"yes").hexdigest())
