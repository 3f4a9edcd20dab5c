"""Scalar measures of process mining, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CAUSES, CAUSED_BY, PARALLEL, UNRELATED, INFREQUENT = "->", "<-", "||", "#", "~"
SEPARATOR = " > "


def check_threshold(threshold: float) -> float:
    if not 0 < threshold < 1:
        raise ValueError(f"threshold must lie between 0 and 1, both excluded: {threshold}")
    return threshold


def counts_only(value: Column, *counts: Column) -> Column:
    """value, or an error where a count is negative."""
    bad = F.lit(False)
    for c in counts:
        bad = bad | (c < 0)
    return F.when(bad, F.raise_error(F.lit("counts must not be negative")).cast("double")).otherwise(value)


def filled(count: Column, message: str) -> Column:
    """A count of a one-row aggregate, or an error where it is 0: the query tells by itself that its input is empty."""
    return F.when(count == 0, F.raise_error(F.lit(message)).cast("bigint")).otherwise(count)


def dependency(ab: Column, ba: Column) -> Column:
    """How surely a is followed by b rather than b by a, from -1 to 1."""
    a, b = ab.cast("double"), ba.cast("double")
    return counts_only((a - b) / (a + b + F.lit(1.0)), ab, ba)


def footprint(ab: Column, ba: Column, threshold: float) -> Column:
    """The relation of an ordered pair."""
    d = dependency(ab, ba)
    return F.when((ab == 0) & (ba == 0), UNRELATED).when(d >= F.lit(threshold), CAUSES).when(d <= F.lit(-threshold), CAUSED_BY).when((ab > 0) & (ba > 0), PARALLEL).otherwise(INFREQUENT)


def self_loop(n: Column) -> Column:
    return n.cast("double") / (n.cast("double") + F.lit(1.0))


def two_loop(aba: Column, bab: Column) -> Column:
    both = (aba + bab).cast("double")
    return both / (both + F.lit(1.0))


def fitness(missing: Column, consumed: Column, remaining: Column, produced: Column) -> Column:
    d = lambda c: c.cast("double")
    return F.lit(0.5) * (F.lit(1.0) - d(missing) / d(consumed)) + F.lit(0.5) * (F.lit(1.0) - d(remaining) / d(produced))


def dispersion(q1: Column, q3: Column) -> Column:
    """Quartile dispersion; 0 where both quartiles are 0; raises for quartiles that are negative or out of order."""
    value = F.when((q1 == 0) & (q3 == 0), 0.0).otherwise((q3 - q1) / (q3 + q1))
    bad = (q1 < 0) | (q3 < q1)
    return F.when(bad, F.raise_error(F.lit("quartiles must be in order and not negative")).cast("double")).otherwise(value)


def micros(start: Column, end: Column) -> Column:
    """Whole microseconds between two times."""
    return F.timestamp_diff("MICROSECOND", start, end)


def weighted_total(micro: Column, n: Column) -> Column:
    """The sum of microseconds that occur n times each, as a decimal: no sum is too large."""
    return F.sum(micro.cast("decimal(20,0)") * n.cast("decimal(17,0)"))


def total(micro: Column) -> Column:
    """The sum of microseconds, in seconds and rest, so that no sum of spans is too large for a bigint."""
    rest = F.pmod(micro, F.lit(1_000_000))
    whole = F.sum(((micro - rest) / 1_000_000).cast("bigint")).cast("decimal(20,0)")
    return whole * F.lit(1_000_000).cast("decimal(7,0)") + F.sum(rest).cast("decimal(20,0)")


def seconds(micro: Column) -> Column:
    """Exact microseconds, a sum or a single span, as seconds."""
    return micro.cast("double") / F.lit(1e6)


def quantile_seconds(micro: Column) -> Column:
    """An interpolated quantile of microseconds as seconds; to eight decimals, which no interpolation of them needs more of."""
    return F.round(micro / F.lit(1e6), 8)
