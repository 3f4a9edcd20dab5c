"""Exact quantiles of whole numbers per group, without a group's values in one task's memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket(value: Column) -> Column:
    """A coarse place of a value: never falls as values grow, and a thousandth of a value wide at most."""
    return (F.signum(value) * F.floor(F.log1p(F.abs(value).cast("double")) * 1024)).cast("bigint")


def with_quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """keys and _q, the quantiles of a bigint column at the shares, interpolated linearly; nulls are passed by.

    Equal values are counted first. The counts of coarse buckets say which buckets hold the wanted ranks, and only
    the values of those are put in order, each bucket on its own. Groups are few (pairs of activities at most), so what
    is broadcast, some ranks a group, is small. Without keys there is one row, with nulls for nothing.
    """
    return quantiles_of(rows.groupBy(*keys, value).agg(F.count("*").alias("_n")), keys, value, "_n", shares)


def quantiles_of(counts: DataFrame, keys: list[str], value: str, n: str, shares: list[float]) -> DataFrame:
    """The same over distinct values with their counts."""
    counted = counts.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), F.col(n).alias("_n")).withColumn("_b", bucket(F.col("_v")))
    buckets = counted.groupBy(*keys, "_b").agg(F.sum("_n").alias("_m"))
    upto = F.sum("_m").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    places = buckets.withColumn("_upto", upto).withColumn("_total", F.sum("_m").over(Window.partitionBy(*keys)))
    at = lambda s: (F.col("_total") - 1) * F.lit(float(s))
    ranks = F.array_distinct(F.array(*[f(at(s)).cast("bigint") for s in shares for f in (F.floor, F.ceil)]))
    held = F.filter(ranks, lambda r: (r >= F.col("_upto") - F.col("_m")) & (r < F.col("_upto")))
    wanted = places.select(*keys, "_b", (F.col("_upto") - F.col("_m")).alias("_before"), "_total", held.alias("_ranks")).where(F.size("_ranks") > 0)
    within = counted.join(F.broadcast(wanted), [*keys, "_b"])
    last = F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    found = within.withColumn("_last", last).select(*keys, "_total", "_v", F.explode(F.filter("_ranks", lambda r: (r >= F.col("_last") - F.col("_n")) & (r < F.col("_last")))).alias("_r"))
    picked = found.groupBy(*keys).agg(F.first("_total").alias("_total"), F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_of"))

    def one(s: float) -> Column:
        low = F.floor(at(s)).cast("bigint")
        a, b = F.try_element_at("_of", low).cast("double"), F.try_element_at("_of", F.ceil(at(s)).cast("bigint")).cast("double")
        return a + (b - a) * (at(s) - low)

    return picked.select(*keys, F.array(*map(one, shares)).alias("_q"))
