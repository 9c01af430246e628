"""Per-pitch expressions: outcome flags, keys, game state and physics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from moundworks import schema as S


def flag(predicate: Column) -> Column:
    """1 where true, 0 where false or NULL."""
    return F.when(predicate, 1).otherwise(0)


def happened(events: list[str]) -> Column:
    return flag(F.col("description").isin(events))


def outcome_flags() -> dict[str, Column]:
    speed, angle = F.col("launch_speed"), F.col("launch_angle")
    return {
        "whiff_flag": happened(S.WHIFF_EVENTS),
        "swing_flag": happened(S.SWING_EVENTS),
        "called_strike_flag": happened(["called_strike"]),
        "hard_hit_flag": flag(speed >= S.HARD_HIT_SPEED),
        "barrel_flag": flag((speed >= S.BARREL_SPEED) & angle.between(*S.BARREL_ANGLES)),
    }


def composite_key(*columns: str) -> Column:
    """Parts joined by '_'; NULL when any part is NULL."""
    parts: list[Column] = []
    for c in columns:
        parts += [F.lit("_"), F.col(c).cast("string")]
    return F.concat(*parts[1:])


def base_state() -> Column:
    """Occupied bases as bits 1, 2 and 4."""
    return sum(
        (F.col(base).isNotNull().cast("int") * bit
         for base, bit in (("on_2b", 2), ("on_3b", 4))),
        F.col("on_1b").isNotNull().cast("int"),
    )


def is_top() -> Column:
    return flag(F.col("inning_topbot") == "Top")


def fielding_win(top: Column, home: Column, away: Column) -> Column:
    """The fielding side's win: home in the top half, away in the bottom; a tie is no win."""
    return F.when((top == 1) & (home > away), 1).when((top == 0) & (away > home), 1).otherwise(0)


def season_of(date: Column) -> Column:
    return F.year(F.to_date(date))


def length(*sides: Column) -> Column:
    """Euclidean norm."""
    total = sides[0] * sides[0]
    for side in sides[1:]:
        total = total + side * side
    return F.sqrt(total)


def movement() -> dict[str, Column]:
    """Induced vertical and horizontal break in inches."""
    return {"ivb": F.col("pfx_z") * S.INCHES_PER_FOOT, "hb": F.col("pfx_x") * S.INCHES_PER_FOOT}


def break_direction() -> Column:
    return F.degrees(F.atan2(F.col("ivb"), F.col("hb")))


def time_to_plate() -> Column:
    return F.try_divide(-F.col("release_pos_y"), F.col("vy0"))


def at_plate(axis: str) -> Column:
    """Velocity along ``axis`` when the ball reaches the plate."""
    return F.col(f"v{axis}0") + F.col(f"a{axis}") * F.col("t_plate")


def approach_angle(axis: str) -> Column:
    return F.degrees(F.atan(F.try_divide(F.col(f"v{axis}_plate"), F.col("vy_plate"))))
