"""Scores and levels; all of them columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def level(score: Column, *steps: tuple[float, str], otherwise: str = "low", strict: bool = False) -> Column:
    """The first step that the score reaches, or passes if ``strict``."""
    out = None
    for limit, word in steps:
        hit = score > limit if strict else score >= limit
        out = F.when(hit, word) if out is None else out.when(hit, word)
    return out.otherwise(otherwise)


def structural_score(fan_in: Column, fan_out: Column, in_cycle: Column) -> Column:
    raw = 8 * fan_in + 5 * fan_out + F.when(in_cycle, 30).otherwise(0) + F.when(fan_in > 5, 10).otherwise(0) + F.when(fan_out > 5, 10).otherwise(0)
    return F.least(raw, F.lit(100)).cast("long")


def structural_level(score: Column) -> Column:
    return level(score, (80, "critical"), (60, "high"), (30, "medium"))


def delete_score(direct: Column, callers: Column, functions: Column) -> Column:
    """Before it is capped; the level goes by this."""
    return 30 * direct + 20 * callers + 10 * functions


def delete_level(raw: Column) -> Column:
    return level(raw, (100, "critical"), (60, "high"), (30, "medium"))


def move_level(direct: Column) -> Column:
    return level(8 * direct, (80, "high"), (40, "medium"), strict=True)


def modify_level(total: Column) -> Column:
    return level(total, (15, "high"), (8, "medium"), strict=True)


def change_risk(kind: Column, direct: Column, indirect: Column, callers: Column, functions: Column) -> Column:
    """struct(level, score) of a change; kinds but delete and move count as modify."""
    cap = lambda x: F.least(x, F.lit(100)).cast("long")
    raw, total = delete_score(direct, callers, functions), direct + indirect
    both = lambda lev, score: F.struct(lev.alias("level"), score.alias("score"))
    return F.when(kind == "delete", both(delete_level(raw), cap(raw))).when(kind == "move", both(move_level(direct), cap(8 * direct))).otherwise(both(modify_level(total), cap(5 * total)))


def coupling_level(average: Column) -> Column:
    return level(average, (5, "Critical"), (3, "High"), (1.5, "Moderate"), otherwise="Low")


def coupling_severity(total: Column) -> Column:
    return level(total, (10, "critical"), (6, "high"), otherwise="moderate")


def share(part: Column, total: Column) -> Column:
    """Per cent, 50 of nothing."""
    return F.when(total == 0, F.lit(50.0)).otherwise(F.round(100.0 * part / total, 6))


def health(average: Column) -> Column:
    return F.least(F.lit(100.0), average / 8 * 100)


def confidence_bucket(confidence: Column) -> Column:
    return level(confidence, (0.8, "high"), (0.6, "medium"))


def signed(x: Column) -> Column:
    return F.format_string("%+d", x.cast("long"))
