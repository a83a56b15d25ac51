"""Shot geometry and a simple goal expectation (Column in, Column out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: rink and danger geometry in feet and degrees
NET_X = 89.0
HIGH_DANGER_DISTANCE = 15.0
MID_DANGER_DISTANCE = 30.0
HIGH_DANGER_ANGLE = 45.0

# fixed values: goal share by shot type before distance and danger, and the danger factors
XG_BASE_RATES = {
    "wrist": 0.06, "slap": 0.04, "snap": 0.07, "tip": 0.12,
    "deflection": 0.12, "backhand": 0.05, "wrap-around": 0.08,
}
XG_OTHER = 0.05
DANGER_FACTORS = {"high": 2.5, "mid": 1.5, "low": 0.7}
XG_CAP = 0.5


def _net(x: Column) -> Column:
    return F.when(x > 0, F.lit(NET_X)).otherwise(F.lit(-NET_X))


def shot_distance(x: Column, y: Column) -> Column:
    dx = x - _net(x)
    return F.sqrt(dx * dx + y * y)


def shot_angle(x: Column, y: Column) -> Column:
    """Degrees off the straight line to the net; behind the net counts as 90."""
    return F.when(F.abs(x) > NET_X, F.lit(90.0)).otherwise(F.abs(F.degrees(F.atan2(y, F.abs(_net(x) - x)))))


def danger_class(distance: Column, angle: Column) -> Column:
    close = (distance <= HIGH_DANGER_DISTANCE) & (angle <= HIGH_DANGER_ANGLE)
    return F.when(close, F.lit("high")).when(distance <= MID_DANGER_DISTANCE, F.lit("mid")).otherwise(F.lit("low"))


def expected_goal(distance: Column, shot_type: Column, danger: Column) -> Column:
    def lookup(value: Column, table: dict[str, float], other: float) -> Column:
        out = F.when(F.lit(False), F.lit(0.0))
        for key, number in table.items():
            out = out.when(value == key, F.lit(number))
        return out.otherwise(F.lit(other))

    raw = lookup(shot_type, XG_BASE_RATES, XG_OTHER) * F.exp(-distance / 30.0) * lookup(danger, DANGER_FACTORS, 1.0)
    return F.least(raw, F.lit(XG_CAP))
