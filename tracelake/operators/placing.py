"""Where the nodes of a process map stand: layers, order within them, crossings of edges. All of it as tables.

A map has as many rows as there are activities, so a layer or an order is worked out on arrays of names in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH, HEIGHT, SWEEPS = 210, 64, 4

def graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: names, starts and edges (without those from an activity to itself) as arrays."""
    names = nodes.agg(F.array_sort(F.collect_list("activity")).alias("names"), F.array_sort(F.collect_list(F.when(F.col("starts") > 0, F.col("activity")))).alias("starts"))
    lines = edges.where("source <> target").agg(F.array_sort(F.collect_set(F.struct("source", "target"))).alias("edges"))
    return names.join(lines)  # one row each


def waves(names: Column, starts: Column, edges: Column) -> Column:
    """Names by fewest steps from a start: an array of arrays, one for each wave, empty ones at the end."""

    def step(s: Column, _: Column) -> Column:
        last = F.element_at(s["waves"], -1)
        reached = F.transform(F.filter(edges, lambda e: F.array_contains(last, e["source"])), lambda e: e["target"])
        ahead = F.array_except(F.array_intersect(names, reached), s["seen"])
        return F.struct(F.concat(s["waves"], F.array(ahead)).alias("waves"), F.concat(s["seen"], ahead).alias("seen"))

    return F.aggregate(F.sequence(F.lit(0), F.size(names)), F.struct(F.array(starts).alias("waves"), starts.alias("seen")), step)["waves"]


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """activity, layer: fewest steps from an activity that starts a case; what none reaches stands in one last layer.

    nodes: activity, starts (cases that it starts).
    """
    found = graph(nodes, edges).select("names", waves(F.col("names"), F.col("starts"), F.col("edges")).alias("waves"))
    rest = F.array_except("names", F.flatten("waves"))
    full = F.filter(F.concat("waves", F.array(rest)), lambda w: F.size(w) > 0)
    return found.select(F.posexplode(full).alias("layer", "wave")).select(F.explode("wave").alias("activity"), "layer")


def swept(rows: Column, beside: Column, size: Column) -> Column:
    """rows (names by layer) after SWEEPS sweeps, on and back by turns. In each, a name moves to the mean place of its
    neighbours in the layer before, or behind on the way back; without any it wishes to stay where it is, and equal
    wishes keep their order."""

    def step(s: Column, k: Column) -> Column:
        back = F.pmod(F.floor(k / size), F.lit(2)) == 1
        n = F.when(back, size - 1 - F.pmod(k, size)).otherwise(F.pmod(k, size)).cast("int")
        fixed = F.coalesce(F.when(back, F.get(s, n + 1)).otherwise(F.get(s, n - 1)), F.array().cast("array<string>"))

        def wish(name: Column, i: Column) -> Column:
            places = F.array_compact(F.transform(fixed, lambda b, p: F.when(F.array_contains(F.try_element_at(beside, name), b), p)))
            mean = F.aggregate(places, F.lit(0.0), lambda x, p: x + p) / F.nullif(F.size(places), F.lit(0))
            return F.struct(F.coalesce(mean, i.cast("double")).alias("wish"), i.alias("i"), name.alias("name"))

        moved = F.transform(F.array_sort(F.transform(F.get(s, n), wish)), lambda x: x["name"])
        return F.transform(s, lambda row, j: F.when(j == n, moved).otherwise(row))

    return F.aggregate(F.sequence(F.lit(0), size * SWEEPS - 1), rows, step)


def places(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """activity, layer, order, x, y: layers side by side, each around the middle. An empty map has no rows."""
    rows = layers(nodes, edges).groupBy("layer").agg(F.array_sort(F.collect_list("activity")).alias("row"))
    table = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("layer", "row"))), lambda x: x["row"]).alias("rows")).where(F.size("rows") > 0)
    both = edges.where("source <> target").select("source", "target").union(edges.where("source <> target").select("target", "source"))
    lists = both.groupBy("source").agg(F.collect_set("target").alias("others")).agg(F.map_from_entries(F.collect_list(F.struct("source", "others"))).alias("beside"))
    found = table.join(lists).select(swept(F.col("rows"), F.col("beside"), F.size("rows")).alias("rows"))  # one row each
    one = found.select(F.posexplode("rows").alias("layer", "row")).select("layer", F.size("row").alias("n"), F.posexplode("row").alias("order", "activity"))
    return one.select("activity", "layer", "order", (F.col("layer") * F.lit(float(WIDTH))).alias("x"), ((F.col("order") - (F.col("n") - 1) / F.lit(2.0)) * F.lit(HEIGHT)).alias("y"))


def crossings(placed: DataFrame, edges: DataFrame) -> DataFrame:
    """One row, crossings: pairs of edges from one layer to the next whose ends stand in opposite order. Edges with an end
    that has no place are passed by."""
    end = lambda c: placed.select(F.col("activity").alias(c), F.col("layer").alias(f"{c}_layer"), F.col("order").alias(f"{c}_at"))
    lines = edges.select("source", "target").distinct().join(end("source"), "source").join(end("target"), "target").where("target_layer = source_layer + 1")
    one, other = lines.select("source_layer", "source_at", "target_at"), lines.toDF(*[f"{c}_" for c in lines.columns])
    met = one.join(other, (F.col("source_layer") == F.col("source_layer_")) & (F.col("source_at") < F.col("source_at_")) & (F.col("target_at") > F.col("target_at_")))
    return met.agg(F.count("*").alias("crossings"))
