"""Pitch geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turfline.functions.constants import (
    BOX_X,
    BOX_Y,
    FINAL_THIRD_X,
    GRID_X,
    GRID_Y,
    PITCH_LENGTH,
    PITCH_WIDTH,
)
from turfline.functions.measures import col


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def to_reference_pitch(
    x, y, length, width, *, centered=False, y_down=False, attack_left=None, allow_outside=False
) -> tuple[Column, Column]:
    """Provider coordinates on the 105 x 68 pitch; null pair when outside."""
    x, y = col(x), col(y)
    shift = 0.5 if centered else 0.0
    u = x / F.lit(float(length)) + shift
    v = y / F.lit(float(width)) + shift
    if y_down:
        v = 1 - v
    if attack_left is not None:
        flip = F.lit(attack_left) if isinstance(attack_left, bool) else col(attack_left)
        u, v = F.when(flip, 1 - u).otherwise(u), F.when(flip, 1 - v).otherwise(v)
    valid = _finite(x) & _finite(y)
    if not allow_outside:
        valid = valid & u.between(-1e-9, 1 + 1e-9) & v.between(-1e-9, 1 + 1e-9)
    return F.when(valid, u * PITCH_LENGTH), F.when(valid, v * PITCH_WIDTH)


def from_reference_pitch(x, y, length, width, *, centered=False, y_down=False, attack_left=False):
    """Inverse of :func:`to_reference_pitch`."""
    u, v = col(x) / PITCH_LENGTH, col(y) / PITCH_WIDTH
    if attack_left:
        u, v = 1 - u, 1 - v
    if y_down:
        v = 1 - v
    shift = 0.5 if centered else 0.0
    return (u - shift) * float(length), (v - shift) * float(width)


def on_pitch(x, y) -> Column:
    """Inside the reference pitch, borders included."""
    return col(x).between(0, PITCH_LENGTH) & col(y).between(0, PITCH_WIDTH)


def parse_pair(x, y, length: float, width: float) -> tuple[Column, Column]:
    """Scaled, rounded pair; both null when either is out of range."""
    x, y = col(x), col(y)
    valid = _finite(x) & _finite(y) & x.between(0, length) & y.between(0, width)
    return (
        F.when(valid, F.round(x * PITCH_LENGTH / length, 6)),
        F.when(valid, F.round(y * PITCH_WIDTH / width, 6)),
    )


def in_box(x, y) -> Column:
    """Inside the attacked penalty area."""
    return col(x).between(*BOX_X) & col(y).between(*BOX_Y)


def enters_box(x, y, ex, ey) -> Column:
    return ~in_box(x, y) & in_box(ex, ey)


def enters_final_third(x, ex) -> Column:
    return (col(x) < FINAL_THIRD_X) & (col(ex) >= FINAL_THIRD_X)


def travelled(x, y, ex, ey) -> Column:
    return F.hypot(col(ex) - col(x), col(ey) - col(y))


def goal_distance(x, y) -> Column:
    return F.hypot(F.lit(PITCH_LENGTH) - col(x), F.lit(PITCH_WIDTH / 2) - col(y))


def progressive_relative(x, y, ex, ey, attack_left: Column | None = None) -> Column:
    """Gain of at least 10 m and a quarter of the starting distance."""
    x, y, ex, ey = map(col, (x, y, ex, ey))
    if attack_left is not None:
        x, ex = (F.when(attack_left, PITCH_LENGTH - c).otherwise(c) for c in (x, ex))
        y, ey = (F.when(attack_left, PITCH_WIDTH - c).otherwise(c) for c in (y, ey))
    before = goal_distance(x, y)
    return before - goal_distance(ex, ey) >= F.greatest(F.lit(10.0), before * 0.25)


def progressive_zone(x, y, ex, ey) -> Column:
    """30 m in the own half, 15 m across halfway, 10 m in the attacking half."""
    x, ex = col(x), col(ex)
    half = PITCH_LENGTH / 2
    gain = goal_distance(x, y) - goal_distance(ex, ey)
    needed = (
        F.when((x < half) & (ex < half), 30.0)
        .when((x < half) & (ex >= half), 15.0)
        .when((x >= half) & (ex >= half), 10.0)
    )
    return F.coalesce(gain >= needed, F.lit(False))


def grid_cell(x, y) -> tuple[Column, Column]:
    """12 x 8 cell; the far edge belongs to the last cell."""
    gx = F.least(F.lit(GRID_X - 1), F.floor(col(x) / PITCH_LENGTH * GRID_X)).cast("int")
    gy = F.least(F.lit(GRID_Y - 1), F.floor(col(y) / PITCH_WIDTH * GRID_Y)).cast("int")
    return gx, gy
