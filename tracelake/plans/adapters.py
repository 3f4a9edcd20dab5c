"""Tables of the test data as event logs: case_id, event_index, activity, timestamp, resource, cost, outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators.normalize import normalized_events

#: Terminal activities of the logs and what they mean.
FULFILMENT_OUTCOMES = {"Status F": "finished", "Status O": "open", "Status P": "partial"}
USER_OUTCOMES = {"purchase": "converted", "error": "failed"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


USER_DAY = """
SELECT CAST(user_id AS STRING) || '-' || CAST(CAST(ts AS DATE) AS STRING) AS case_id, event_id AS event_index, event_type AS activity,
  element_at(array('schedule', 'start', 'complete'), CAST(1 + CAST(get_json_object(props, '$.k') AS BIGINT) % 3 AS INT)) AS lifecycle,
  ts AS timestamp, 'res_' || CAST(CAST(get_json_object(props, '$.k') AS BIGINT) % 7 AS STRING) AS resource
FROM {events}
"""

MESSY = """
SELECT CASE WHEN k % 19 = 0 THEN NULL WHEN k % 19 = 1 THEN '  ' ELSE ' u' || CAST(user_id % 97 AS STRING) || chr(9) END AS case_id,
  CASE WHEN k % 23 = 5 THEN event_id - event_id % 7 ELSE event_id END AS event_index,
  CASE WHEN k % 17 = 0 THEN chr(10) || ' ' WHEN k % 17 = 1 THEN NULL ELSE '\u2003' || event_type || ' ' END AS activity,
  CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN ' START ' WHEN 2 THEN 'schedule' WHEN 3 THEN '' ELSE 'Complete' END AS lifecycle,
  CASE WHEN k % 13 = 0 THEN 'yesterday' WHEN k % 13 = 1 THEN NULL WHEN k % 13 = 2 THEN ' ' WHEN k % 13 = 3 THEN '20240101T101010'
    ELSE date_format(ts, "yyyy-MM-dd'T'HH:mm:ss") || CASE k % 3 WHEN 0 THEN 'Z' WHEN 1 THEN '+02:00' ELSE '' END END AS timestamp,
  CASE WHEN k % 4 = 0 THEN ' ' ELSE ' r' || CAST(k % 7 AS STRING) END AS resource
FROM (SELECT *, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM {events})
"""

FULFILMENT = """
SELECT CAST(o_orderkey AS STRING) AS case_id, 0 AS stage, 'Placed' AS activity, o_orderdate AS timestamp, 0 AS l, 0 AS p, 0 AS s, CAST(NULL AS STRING) AS resource FROM {orders}
UNION ALL
SELECT CAST(l_orderkey AS STRING), 1, 'Ship ' || l_returnflag, l_shipdate, l_linenumber, l_partkey, l_suppkey, CAST(l_suppkey AS STRING) FROM {lineitem}
UNION ALL
SELECT CAST(o_orderkey AS STRING), 2, 'Status ' || o_orderstatus, o_orderdate, 0, 0, 0, NULL FROM {orders}
"""


def user_day_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(USER_DAY, events=table(spark, sf_dir, "events"))


def messy_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as dirty text: blanks around values, lost cases, activities and times, unreadable times, repeated places."""
    return spark.sql(MESSY, events=table(spark, sf_dir, "events"))


def user_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case per user and day; the log as it is."""
    return user_day_raw(spark, sf_dir).drop("lifecycle")


def user_day_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with outcomes."""
    return normalized_events(user_day_raw(spark, sf_dir), "all", USER_OUTCOMES)


def fulfilment_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case per order: placed, lines shipped, status. The status stands at the last shipping's time, seen in the same
    order of the case that numbers its events, so there is one shuffle."""
    rows = spark.sql(FULFILMENT, orders=table(spark, sf_dir, "orders"), lineitem=table(spark, sf_dir, "lineitem"))
    order = "OVER (PARTITION BY case_id ORDER BY stage, timestamp, l, p, s)"
    seen = rows.selectExpr("*", f"row_number() {order} - 1L AS event_index", f"max(CASE WHEN stage = 1 THEN timestamp END) {order[:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_ship")
    return seen.selectExpr(
        "case_id",
        "event_index",
        "activity",
        "CAST(NULL AS STRING) AS lifecycle",
        "CASE WHEN stage = 2 AND case_id IS NOT NULL THEN coalesce(last_ship, timestamp) ELSE timestamp END AS timestamp",
        "resource",
    )


def fulfilment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log, cleaned, with outcomes."""
    return normalized_events(fulfilment_raw(spark, sf_dir), "start_else_complete", FULFILMENT_OUTCOMES, tidy=("case_id", "resource"))


def order_lines_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case per order, indexed by line number, which repeats within orders."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "CAST(l_orderkey AS STRING) AS case_id", "CAST(l_linenumber AS BIGINT) AS event_index", "l_returnflag || l_linestatus AS activity",
        "CAST(NULL AS STRING) AS lifecycle", "l_shipdate AS timestamp", "CAST(l_suppkey AS STRING) AS resource",
    )


def dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case per conversation; one minute between turns."""
    return table(spark, sf_dir, "conversations").selectExpr(
        "CAST(conv_id AS STRING) AS case_id", "turn AS event_index", "role AS activity",
        "timestampadd(MINUTE, CAST(turn AS INT), timestampadd(HOUR, CAST(conv_id AS INT), TIMESTAMP_NTZ '2024-01-01 00:00:00')) AS timestamp", "CAST(NULL AS STRING) AS resource",
    )
