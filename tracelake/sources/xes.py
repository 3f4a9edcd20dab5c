"""XES event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("string", "date", "int", "float", "boolean", "id")
_ATTRIBUTE = "ARRAY<STRUCT<_key: STRING, _value: STRING>>"
_ATTRIBUTES = ", ".join(f"{k}: {_ATTRIBUTE}" for k in KINDS)
SCHEMA = f"{_ATTRIBUTES.replace(': ' + _ATTRIBUTE, ' ' + _ATTRIBUTE)}, event ARRAY<STRUCT<{_ATTRIBUTES}>>"
COLUMNS = {"activity": "concept:name", "lifecycle": "lifecycle:transition", "timestamp": "time:timestamp", "resource": "org:resource"}


def _value(owner, key: str) -> Column:
    """The last value that an element's own attributes give for a key."""
    of = lambda kind: F.filter(F.coalesce(owner(kind), F.array().cast("array<struct<_key:string,_value:string>>")), lambda x: x["_key"] == key)
    return F.get(F.reverse(F.concat(*[of(k) for k in KINDS])), F.lit(0))["_value"]


def read_xes(spark: SparkSession, path: str) -> DataFrame:
    """case_id, event_index, activity, lifecycle, timestamp, resource: raw strings, one row per event.

    Only attributes right under the trace or event count; the case's name may follow its events. Compressed files are
    read by their ending. Of a key given twice in one element the last of the same type counts.
    """
    traces = spark.read.format("xml").option("rowTag", "trace").option("ignoreNamespace", True).option("inferSchema", False).schema(SCHEMA).load(path)
    named = traces.select(_value(F.col, "concept:name").alias("case_id"), F.posexplode("event").alias("event_index", "e"))
    of_event = lambda kind: F.col(f"e.{kind}")
    return named.select("case_id", F.col("event_index").cast("bigint").alias("event_index"), *[_value(of_event, key).alias(c) for c, key in COLUMNS.items()])


def count_raw_events(spark: SparkSession, path: str) -> int:
    """Event elements counted in the text itself, line by line and apart from the parser above; a tag may go on in the
    next line."""
    return spark.read.text(path).agg(F.sum(F.regexp_count("value", F.lit(r"<event(?:[\s>/]|$)")))).head()[0] or 0


def _escaped(text: Column) -> Column:
    for sign, by in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(by))
    return text


def write_xes(raw: DataFrame, path: str, compression: str = "none", parts: int = 16) -> None:
    """Raw events as XES: `parts` documents, one trace a line; nulls are left out."""

    def attribute(name: str, kind: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f'<{kind} key="{name}" value="'), _escaped(value), F.lit('"/>')), F.lit(""))

    fields = [attribute(key, "date" if c == "timestamp" else "string", F.col(c)) for c, key in COLUMNS.items()]
    event = F.struct("event_index", F.concat(F.lit("<event>"), *fields, F.lit("</event>")).alias("xml"))
    traces = raw.groupBy("case_id").agg(F.array_sort(F.collect_list(event)).alias("events"))
    body = F.concat(F.lit("<trace>"), attribute("concept:name", "string", F.col("case_id")), F.array_join(F.transform("events", lambda e: e["xml"]), ""), F.lit("</trace>"))
    lines = traces.select(F.pmod(F.xxhash64("case_id"), F.lit(parts)).alias("part"), F.lit(1).alias("at"), body.alias("value"))
    edges = raw.sparkSession.range(parts).select(F.col("id").alias("part"), F.explode(F.array(F.struct(F.lit(0).alias("at"), F.lit("<log>").alias("value")), F.struct(F.lit(2).alias("at"), F.lit("</log>").alias("value")))).alias("x")).select("part", "x.at", "x.value")
    lines.unionByName(edges).repartition(parts, "part").sortWithinPartitions("part", "at").drop("at").write.mode("overwrite").partitionBy("part").text(path, compression=compression)
