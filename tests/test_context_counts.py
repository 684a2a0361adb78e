"""Interval context of one interval per player: plain overlap, and rows that grow with events and intervals only."""

import random

from turfline.operators import counting as C
from tests.test_bands import EVENTS, INTERVALS, plain_context


def test_context_by_counts(spark, monkeypatch):
    draw = random.Random(8)
    events = [
        (draw.randrange(3), float(draw.randrange(0, 90)), draw.randrange(1, 6), None if draw.random() < 0.01 else draw.randrange(1, 25),
         draw.randrange(1, 4), draw.randrange(1, 4), draw.choice(["Pass", "Shot"]), None, n)
        for n in range(400)
    ]
    intervals = [(m, p, 1 + p % 3, *sorted((float(draw.randrange(-5, 95)), float(draw.randrange(-5, 95))))) for m in range(4) for p in range(25)]
    intervals += [(0, 90, 1, float("-inf"), float("inf")), (1, 91, None, 0.0, 50.0), (2, 92, 7, 30.0, 30.0), (2, 93, 1, 30.0, None)]
    # No band is met: every player has one interval.
    monkeypatch.setattr(C, "_context_in_bands", None)
    got = C.on_pitch_context(spark.createDataFrame(events, EVENTS), spark.createDataFrame(intervals, INTERVALS))
    found = {(r.match_id, r.player_id): (r.own_possessions, r.opponent_possessions, r.team_passes) for r in got.collect()}
    want = plain_context(events, intervals)
    assert {k: v for k, v in found.items() if k != (1, 91)} == {k: v for k, v in want.items() if k != (1, 91)}
    # Without a team no possession is own or the opponent's.
    assert found[1, 91][2] == 0 and found[1, 91][:2] in ((0, 0), (None, None))
