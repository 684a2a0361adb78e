"""Interval context in bands and line numbers from byte ranges against plain loops."""

import random

import pytest

from turfline.operators.counting import on_pitch_context
from turfline.sources.readers import read_lines

EVENTS = (
    "match_id bigint, at double, period int, possession bigint, possession_team bigint, team_id bigint, "
    "event_type string, subtype string, event_id bigint"
)
INTERVALS = "match_id bigint, player_id bigint, team_id bigint, start_s double, end_s double"


def plain_context(events, intervals):
    met = {}
    for m, player, team, start, end in intervals:
        for em, at, period, poss, holder, actor, kind, _, _ in events:
            if m != em or period > 4 or None in (start, end, at) or not start <= at <= end:
                continue
            met.setdefault((m, player), []).append((team, period, poss, holder, actor, kind))
    out = {}
    for key, rows in met.items():
        whole = all(p is not None and h is not None for _, _, p, h, _, _ in rows)
        own = {(t, n, p, h) for t, n, p, h, _, _ in rows if h == t}
        other = {(t, n, p, h) for t, n, p, h, _, _ in rows if h != t}
        passes = sum(
            kind == "Pass" and actor == t and p is not None and h is not None
            for t, _, p, h, actor, kind in rows
        )
        out[key] = (len(own) if whole else None, len(other) if whole else None, passes)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_context_in_bands_equals_the_plain_overlap(spark, seed):
    draw = random.Random(seed)
    events, n = [], 0
    for match in range(4):
        for _ in range([0, 1, 40, 300][match]):
            n += 1
            missing = match == 2 and draw.random() < 0.05
            events.append(
                (match, None if draw.random() < 0.02 else float(draw.randrange(0, 600)), draw.randrange(1, 6),
                 None if missing else draw.randrange(1, 30), draw.randrange(1, 3), draw.randrange(1, 3),
                 draw.choice(["Pass", "Shot"]), None, n)
            )
    intervals = []
    for match in range(4):
        for player in range(12):
            for _ in range(draw.randrange(1, 3)):
                a, b = (float(draw.randrange(-100, 800)) for _ in range(2))
                if draw.random() < 0.8:
                    a, b = min(a, b), max(a, b)
                ends = (a, None) if draw.random() < 0.05 else (a, b)
                intervals.append((match, player, 1 + player % 2, *ends))
    # Bounds far outside the clock, an interval of one moment, the same moment for all events.
    intervals += [(3, 50, 1, -1e18, 1e18), (3, 51, 2, 100.0, 100.0), (1, 50, 1, -1e18, 1e18)]
    got = on_pitch_context(spark.createDataFrame(events, EVENTS), spark.createDataFrame(intervals, INTERVALS))
    found = {
        (r.match_id, r.player_id): (r.own_possessions, r.opponent_possessions, r.team_passes)
        for r in got.collect()
    }
    assert found == plain_context(events, intervals)


def test_context_joins_no_event_on_the_match_alone(spark):
    events = spark.createDataFrame([(1, 5.0, 1, 1, 1, 1, "Pass", None, 1)], EVENTS)
    intervals = spark.createDataFrame([(1, 7, 1, 0.0, 9.0)], INTERVALS)
    rows = on_pitch_context(events, intervals)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "band" in plan and "edge" in plan
    assert not on_pitch_context(events.limit(0), intervals).collect()
    assert not on_pitch_context(events, intervals.limit(0)).collect()


def test_lines_of_large_files_are_numbered_over_byte_ranges(spark, tmp_path):
    draw = random.Random(5)
    texts = {
        "a.txt": ["x" * draw.randrange(0, 60) + str(i) for i in range(2_000)],
        "b.txt": ["only"],
        "c.txt": ["", "", "third", ""],
    }
    for name, lines in texts.items():
        ends = "\r\n" if name == "a.txt" else "\n"
        (tmp_path / name).write_bytes((ends.join(lines) + ("" if name == "b.txt" else ends)).encode())
    (tmp_path / "empty.txt").write_bytes(b"")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        spark.conf.set("spark.sql.files.openCostInBytes", "16")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        rows = read_lines(spark, str(tmp_path)).collect()
    finally:
        for k, value in keep.items():
            spark.conf.set(k, value)
    found = {}
    for r in rows:
        found.setdefault(r.file, {})[r.line] = r.raw
    assert found == {name: dict(enumerate(lines, 1)) for name, lines in texts.items()}
