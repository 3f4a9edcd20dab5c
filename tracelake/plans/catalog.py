"""Queries over the test tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators import conformance, dfg, miner, normalize, timing, variants
from tracelake.plans import adapters as a
from tracelake.plans import opportunities, reports, views
from tracelake.sources import store, xes
from tracelake.streaming import running

VIEW_TO_BUY = ["view", "click", "purchase"]

#: Logs in SQL. ud: user_day; udo: with outcomes; raw and ful: fulfilment before and after cleaning; ol: order lines; dlg: dialogue.
LOGS = r"""
WITH ud AS (
  SELECT CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS case_id, event_id AS event_index, event_type AS activity, ts AS timestamp,
    'res_' || CAST(CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) % 7 AS VARCHAR) AS resource,
    CASE CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) % 3 WHEN 0 THEN 'schedule' WHEN 1 THEN 'start' ELSE 'complete' END AS lifecycle
  FROM events),
udo AS (
  SELECT *, arg_max(CASE activity WHEN 'purchase' THEN 'converted' WHEN 'error' THEN 'failed' END, event_index) FILTER (activity IN ('purchase', 'error')) OVER (PARTITION BY case_id) AS outcome FROM ud),
staged AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS case_id, 0 AS stage, 'Placed' AS activity, o_orderdate AS timestamp, 0 AS l, 0 AS p, 0 AS s, CAST(NULL AS VARCHAR) AS resource FROM orders
  UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 1, 'Ship ' || l_returnflag, l_shipdate, l_linenumber, l_partkey, l_suppkey, CAST(l_suppkey AS VARCHAR) FROM lineitem
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 2, 'Status ' || o_orderstatus, coalesce(x.t, o_orderdate), 0, 0, 0, NULL FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS t FROM lineitem GROUP BY l_orderkey) x ON o_orderkey = l_orderkey),
raw AS (SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY stage, timestamp, l, p, s) - 1 AS event_index, activity, timestamp, resource FROM staged),
late AS (SELECT *, coalesce(timestamp < max(timestamp) OVER (PARTITION BY case_id ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS is_late FROM raw),
ful AS (
  SELECT case_id, event_index, activity, timestamp, resource,
    arg_max(CASE activity WHEN 'Status F' THEN 'finished' WHEN 'Status O' THEN 'open' ELSE 'partial' END, event_index) FILTER (activity LIKE 'Status _') OVER (PARTITION BY case_id) AS outcome
  FROM late WHERE NOT is_late),
lines AS (SELECT CAST(l_orderkey AS VARCHAR) AS case_id, CAST(l_linenumber AS BIGINT) AS event_index, l_returnflag || l_linestatus AS activity, l_shipdate AS timestamp, CAST(l_suppkey AS VARCHAR) AS resource FROM lineitem),
dup AS (SELECT *, max(n) OVER (PARTITION BY case_id) AS m FROM (SELECT *, count(*) OVER (PARTITION BY case_id, event_index) AS n FROM lines)),
ol AS (
  SELECT *, CASE WHEN m > 1 THEN 'duplicate_case_id' WHEN timestamp < max(CASE WHEN m = 1 THEN timestamp END) OVER (PARTITION BY case_id ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'out_of_order' END AS reason FROM dup),
dlg AS (SELECT CAST(conv_id AS VARCHAR) AS case_id, turn AS event_index, role AS activity, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(conv_id AS INTEGER)) + to_minutes(CAST(turn AS INTEGER)) AS timestamp FROM conversations)
"""

STEPS = """, steps AS (SELECT case_id, activity AS source, lead(activity) OVER w AS target, lead(activity, 2) OVER w AS third, date_diff('microsecond', timestamp, lead(timestamp) OVER w) AS micro FROM {log} WINDOW w AS (PARTITION BY case_id ORDER BY event_index)),
pairs AS (SELECT source, target, count(*) AS frequency FROM steps WHERE target IS NOT NULL GROUP BY ALL),
both_ways AS (SELECT p.*, coalesce(r.frequency, 0) AS reverse, CAST(p.frequency - coalesce(r.frequency, 0) AS DOUBLE) / (CAST(p.frequency + coalesce(r.frequency, 0) AS DOUBLE) + 1.0) AS dependency FROM pairs p LEFT JOIN pairs r ON p.source = r.target AND p.target = r.source)
"""

SEQS = """, seqs AS (SELECT case_id, string_agg(activity, ' > ' ORDER BY event_index) AS variant, count(*) AS length, min(timestamp) AS start_time, max(timestamp) AS end_time{extra} FROM {log} GROUP BY case_id),
counted AS (SELECT variant, length, count(*) AS case_count, min(case_id) AS first_case FROM seqs GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (ORDER BY case_count DESC, variant, first_case) AS variant_rank, sum(case_count) OVER () AS total FROM counted),
upto AS (SELECT *, sum(case_count) OVER (ORDER BY variant_rank) AS upto FROM ranked),
stats AS (SELECT s.*, r.variant_rank, date_diff('microsecond', start_time, end_time) AS micro FROM seqs s JOIN ranked r ON s.variant = r.variant AND s.length = r.length)
"""

TWO_LOOPS = """, aba AS (SELECT source AS a, target AS b, count(*) AS n FROM steps WHERE third = source AND target <> source GROUP BY ALL),
l2 AS (SELECT coalesce(x.a, y.b) AS a, coalesce(x.b, y.a) AS b, CAST(coalesce(x.n, 0) + coalesce(y.n, 0) AS DOUBLE) AS n FROM aba x FULL JOIN aba y ON x.a = y.b AND x.b = y.a),
loops2 AS (SELECT a AS source, b AS target, n / (n + 1.0) AS dependency, coalesce(frequency, 0) AS frequency FROM l2 LEFT JOIN pairs ON a = source AND b = target WHERE n / (n + 1.0) >= 0.9)
"""

WAITS = """, waits AS (
  SELECT source, target, count(*) AS occurrences, count(DISTINCT case_id) AS cases, CAST(sum(micro) AS DOUBLE) AS s, max(micro) AS m, quantile_cont(micro, [0.25, 0.5, 0.75, 0.9, 0.99]) AS q FROM steps WHERE target IS NOT NULL GROUP BY source, target),
table_of AS (
  SELECT source, target, occurrences, cases, s, s / 1e6 AS total_seconds, s / occurrences / 1e6 AS mean_seconds, round(q[1] / 1e6, 8) AS q1_seconds, round(q[2] / 1e6, 8) AS p50_seconds, round(q[3] / 1e6, 8) AS q3_seconds,
    round(q[4] / 1e6, 8) AS p90_seconds, round(q[5] / 1e6, 8) AS p99_seconds, CAST(m AS DOUBLE) / 1e6 AS max_seconds FROM waits),
slow AS (SELECT round(coalesce(quantile_cont(CASE WHEN occurrences >= 30 THEN p50_seconds END, 0.75), quantile_cont(p50_seconds, 0.75)), 8) AS slow_threshold_seconds FROM table_of),
marked AS (SELECT *, CASE WHEN q1_seconds = 0 AND q3_seconds = 0 THEN 0.0 ELSE (q3_seconds - q1_seconds) / (q3_seconds + q1_seconds) END AS dispersion, coalesce(s / nullif(sum(s) OVER (), 0.0), 0.0) AS share_of_total_time FROM table_of, slow),
bottled AS (SELECT *, CASE WHEN occurrences < 30 THEN 'insufficient_data' WHEN p50_seconds >= slow_threshold_seconds AND p50_seconds > 0 AND dispersion > 0.5 THEN 'slow_and_variable'
  WHEN p50_seconds >= slow_threshold_seconds AND p50_seconds > 0 THEN 'uniformly_slow' WHEN dispersion > 0.5 THEN 'high_variance' ELSE 'not_flagged' END AS kind FROM marked)
"""
BOTTLED = "source, target, occurrences, cases, total_seconds, share_of_total_time, mean_seconds, q1_seconds, p50_seconds, q3_seconds, p90_seconds, p99_seconds, max_seconds, dispersion, kind"

REWORK = """, reps AS (SELECT case_id, activity, count(*) AS n, min(timestamp) AS first, max(timestamp) AS last FROM {log} GROUP BY case_id, activity HAVING count(*) > 1),
parts AS (SELECT *, max(last) OVER (PARTITION BY case_id ORDER BY first, last, activity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM reps),
unions AS (SELECT case_id, sum(n - 1) AS e, count(*) AS k, sum(greatest(date_diff('microsecond', greatest(first, coalesce(reached, first)), last), 0)) AS r FROM parts GROUP BY case_id),
cyc AS (SELECT case_id, date_diff('microsecond', min(timestamp), max(timestamp)) AS c FROM {log} GROUP BY case_id),
rw AS (SELECT case_id, CAST(coalesce(e, 0) AS BIGINT) AS rework_events, coalesce(k, 0) AS repeated_activities, CAST(coalesce(r, 0) AS DOUBLE) AS r, CAST(c AS DOUBLE) AS c FROM cyc LEFT JOIN unions USING (case_id))
"""

REPLAY = """, numbered AS (SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY event_index) AS k, {place} AS i FROM {log}),
moves AS (SELECT case_id, i AS place, 2 * k AS pos, -1 AS delta FROM numbered WHERE i IS NOT NULL UNION ALL SELECT case_id, i + 1, 2 * k + 1, 1 FROM numbered WHERE i IS NOT NULL
  UNION ALL SELECT case_id, 0, 0, 1 FROM numbered WHERE k = 1 UNION ALL SELECT case_id, {n}, 1152921504606846976, -1 FROM numbered WHERE k = 1),
runs AS (SELECT *, sum(delta) OVER (PARTITION BY case_id, place ORDER BY pos) AS run FROM moves),
places AS (SELECT case_id, place, greatest(0, -min(run)) AS missing, sum(delta) AS rest FROM runs GROUP BY ALL),
tokens AS (SELECT case_id, sum(missing) AS missing, sum(rest + missing) AS remaining FROM places GROUP BY case_id),
lens AS (SELECT case_id, count(*) AS n, count(*) FILTER (i IS NULL) AS u FROM numbered GROUP BY case_id),
counts AS (SELECT case_id, n + 1 AS produced, n + 1 AS consumed, CAST(missing + u AS BIGINT) AS missing, CAST(remaining + u AS BIGINT) AS remaining, u AS unknown_activities FROM tokens JOIN lens USING (case_id)),
replayed AS (SELECT *, 0.5 * (1.0 - CAST(missing AS DOUBLE) / consumed) + 0.5 * (1.0 - CAST(remaining AS DOUBLE) / produced) AS fitness, missing = 0 AND remaining = 0 AS fits FROM counts)
"""
BUY = REPLAY.format(log="udo", n=3, place="CASE activity WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 END")
MODAL = """, modal AS (SELECT variant FROM ranked WHERE variant_rank = 1)""" + REPLAY.replace("{log}", "ful").replace("{place}", "nullif(list_position((SELECT string_split(variant, ' > ') FROM modal), activity), 0) - 1").replace("{n}", "(SELECT len(string_split(variant, ' > ')) FROM modal)")

#: The net with connections: activities by name, first their way in, then their way out, each seeing what was admitted before.
CONNECT = """, acts AS (SELECT activity, row_number() OVER (ORDER BY activity) AS n FROM (SELECT DISTINCT activity FROM {log})),
turns AS (SELECT 2 * n - 1 AS j, activity, true AS inward, activity IN (SELECT arg_min(activity, event_index) FROM {log} GROUP BY case_id) AS exempt FROM acts
  UNION ALL SELECT 2 * n, activity, false, activity IN (SELECT arg_max(activity, event_index) FROM {log} GROUP BY case_id) FROM acts),
best AS (SELECT j, source, target FROM (SELECT t.j, b.source, b.target, row_number() OVER (PARTITION BY t.j ORDER BY b.dependency DESC, b.frequency DESC, b.source, b.target) AS r
  FROM turns t JOIN both_ways b ON b.source <> b.target AND t.activity = CASE WHEN inward THEN b.target ELSE b.source END) WHERE r = 1),
walk(j, held) AS (SELECT CAST(0 AS BIGINT), coalesce((SELECT list({{'s': source, 't': target}}) FROM model), [])
  UNION ALL SELECT t.j, CASE WHEN t.exempt OR b.source IS NULL OR len(list_filter(w.held, lambda x: x.s <> x.t AND t.activity = CASE WHEN t.inward THEN x.t ELSE x.s END)) > 0 THEN w.held ELSE list_append(w.held, {{'s': b.source, 't': b.target}}) END
  FROM walk w JOIN turns t ON t.j = w.j + 1 LEFT JOIN best b ON b.j = t.j),
net AS (SELECT x.s AS source, x.t AS target FROM (SELECT unnest(held) AS x FROM walk WHERE j = (SELECT max(j) FROM walk))),
connected AS (SELECT n.source, n.target, coalesce(m.kind, 'best_connection') AS kind, coalesce(m.dependency, b.dependency) AS dependency, coalesce(m.frequency, b.frequency) AS frequency
  FROM net n LEFT JOIN model m USING (source, target) LEFT JOIN both_ways b ON b.source = n.source AND b.target = n.target)
"""

#: Token replay of each variant on the line of the first variant's activities, event by event.
FOLD = """, line AS (SELECT string_split(variant, ' > ') AS net, length AS n FROM ranked WHERE variant_rank = 1),
fold(variant, ev, k, mk, m, u) AS (SELECT variant, string_split(variant, ' > '), CAST(1 AS BIGINT), list_transform(range(0, n + 1), lambda j: CASE WHEN j = 0 THEN 1 ELSE 0 END), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM counted, line
  UNION ALL SELECT variant, ev, k + 1,
    CASE WHEN i IS NULL THEN mk ELSE list_transform(range(1, n + 2), lambda j: CASE WHEN j = i THEN greatest(mk[j] - 1, 0) WHEN j = i + 1 THEN mk[j] + 1 ELSE mk[j] END) END,
    m + CASE WHEN i IS NULL OR mk[i] < 1 THEN 1 ELSE 0 END, u + CASE WHEN i IS NULL THEN 1 ELSE 0 END
  FROM (SELECT *, coalesce(list_min(list_filter(range(1, n + 1), lambda i: net[i] = ev[k] AND mk[i] >= 1)), list_min(list_filter(range(1, n + 1), lambda i: net[i] = ev[k]))) AS i FROM fold, line WHERE k <= len(ev))),
ended AS (SELECT variant, len(ev) AS length, m + CASE WHEN mk[n + 1] < 1 THEN 1 ELSE 0 END AS missing, list_sum(mk) - least(mk[n + 1], 1) + u AS remaining, u AS unknown_activities FROM fold, line WHERE k = len(ev) + 1),
folded AS (SELECT s.case_id, s.length + 1 AS produced, s.length + 1 AS consumed, e.missing, CAST(e.remaining AS BIGINT) AS remaining, e.unknown_activities,
  0.5 * (1.0 - CAST(e.missing AS DOUBLE) / (s.length + 1)) + 0.5 * (1.0 - CAST(e.remaining AS DOUBLE) / (s.length + 1)) AS fitness, e.missing = 0 AND e.remaining = 0 AS fits FROM seqs s JOIN ended e ON s.variant = e.variant AND s.length = e.length)
"""

#: The messy events after cleaning, told from the numbers that the dirt was made from; the parser has no part in it.
DIRTY = """, given AS (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k FROM events),
cleaned AS (SELECT CASE WHEN k % 19 > 1 THEN 'u' || CAST(user_id % 97 AS VARCHAR) END AS case_id, CASE WHEN k % 23 = 5 THEN event_id - event_id % 7 ELSE event_id END AS event_index, CASE WHEN k % 17 > 1 THEN event_type END AS activity,
  CASE k % 5 WHEN 1 THEN 'start' WHEN 2 THEN 'schedule' ELSE 'complete' END AS lifecycle, k % 13 AS t, epoch_us(date_trunc('second', ts)) - CASE WHEN k % 3 = 1 THEN 7200000000 ELSE 0 END AS us, CASE WHEN k % 4 > 0 THEN 'r' || CAST(k % 7 AS VARCHAR) END AS resource FROM given),
placed AS (SELECT *, max(n) OVER (PARTITION BY case_id) AS most FROM (SELECT *, count(*) OVER (PARTITION BY case_id, event_index) AS n FROM cleaned)),
first_reason AS (SELECT *, CASE WHEN case_id IS NULL THEN 'missing_case_id' WHEN most > 1 THEN 'duplicate_case_id' WHEN activity IS NULL THEN 'missing_activity' WHEN t IN (1, 2) THEN 'missing_timestamp' WHEN t IN (0, 3) THEN 'unparseable_timestamp' END AS bad,
  CASE WHEN activity IN (SELECT activity FROM cleaned WHERE lifecycle = 'start') THEN lifecycle = 'start' ELSE lifecycle = 'complete' END AS wanted FROM placed),
dirty AS (SELECT case_id, event_index, activity, lifecycle, CASE WHEN t > 3 THEN us END AS us, resource, coalesce(bad, CASE WHEN wanted AND us < reached THEN 'out_of_order' END) AS reason,
  CASE WHEN bad IS NOT NULL OR (wanted AND coalesce(us < reached, false)) THEN 'excluded' WHEN wanted THEN 'normalized' ELSE 'filtered' END AS status
  FROM (SELECT *, CASE WHEN case_id IS NOT NULL THEN max(CASE WHEN bad IS NULL AND wanted THEN us END) OVER (PARTITION BY case_id ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS reached FROM first_reason))
"""


def sql(body: str, *more: str) -> str:
    return LOGS.replace("WITH", "WITH RECURSIVE", 1) + "".join(more) + body


def steps(log: str) -> str:
    return STEPS.format(log=log)


def seqs(log: str, extra: str = "") -> str:
    return SEQS.format(log=log, extra=extra)


OUTCOME = ", any_value(outcome) AS outcome"
Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, tuple[Query, str | None]] = {}


def add(name: str, query: Query, oracle: str | None = None) -> None:
    _FOUND[name] = (query, oracle)


# graphs
add("dfg_edges", lambda s, d: dfg.edges(a.user_day(s, d)), sql("SELECT source, target, count(*) AS frequency, count(DISTINCT case_id) AS case_frequency, CAST(sum(micro) AS DOUBLE) / count(*) / 1e6 AS mean_duration_seconds, round(quantile_cont(micro, 0.5) / 1e6, 8) AS median_duration_seconds FROM steps WHERE target IS NOT NULL GROUP BY ALL", steps("ud")))
add("dfg_start_activities", lambda s, d: dfg.end_counts(a.user_day(s, d), True), sql("SELECT activity, count(*) AS cases FROM (SELECT arg_min(activity, event_index) AS activity FROM ud GROUP BY case_id) GROUP BY activity"))
add("dfg_end_activities", lambda s, d: dfg.end_counts(a.user_day(s, d), False), sql("SELECT activity, count(*) AS cases FROM (SELECT arg_max(activity, event_index) AS activity FROM ud GROUP BY case_id) GROUP BY activity"))
add("activity_counts", lambda s, d: dfg.activity_counts(a.user_day(s, d)), sql("SELECT activity, count(*) AS events FROM ud GROUP BY activity"))
add("dfg_totals", lambda s, d: dfg.totals(a.order_lines_raw(s, d)), sql("SELECT count(*) AS events, count(DISTINCT case_id) AS cases, count(*) - count(DISTINCT case_id) AS transitions FROM lines"))
add("transition_occurrences", lambda s, d: dfg.occurrences(a.dialogue(s, d)).selectExpr("source", "target", "case_id", "CAST(micro AS DOUBLE) / 1e6D AS duration_seconds"), sql("SELECT source, target, case_id, CAST(micro AS DOUBLE) / 1e6 AS duration_seconds FROM steps WHERE target IS NOT NULL", steps("dlg")))
add("handoff_edges", lambda s, d: dfg.handoffs(a.user_day(s, d)), sql("SELECT giver, taker, count(*) AS handoffs, count(DISTINCT case_id) AS cases FROM (SELECT case_id, resource AS giver, lead(resource) OVER (PARTITION BY case_id ORDER BY event_index) AS taker FROM ud) WHERE giver <> taker GROUP BY ALL"))
add("bus_factor", lambda s, d: dfg.bus_factor(a.user_day(s, d)), sql(", c AS (SELECT activity, resource, count(*) AS n FROM ud GROUP BY ALL) SELECT activity, resource, n AS events, round(CAST(n AS DOUBLE) / total, 9) AS share FROM (SELECT *, sum(n) OVER (PARTITION BY activity) AS total, row_number() OVER (PARTITION BY activity ORDER BY n DESC, resource) AS r FROM c) WHERE r = 1"))

# cleaning
LIFE = "SELECT case_id, event_index, activity, timestamp, resource FROM ud{} WHERE {}"
PLAIN = ["case_id", "event_index", "activity", "timestamp", "resource"]
add("norm_event_log_all", lambda s, d: normalize.normalized_events(a.user_day_raw(s, d), "all").select(*PLAIN), sql(LIFE.format("", "true")))
add("norm_event_log_complete", lambda s, d: normalize.normalized_events(a.user_day_raw(s, d), "complete").select(*PLAIN), sql(LIFE.format("", "lifecycle = 'complete'")))
add("norm_event_log_start_else_complete", lambda s, d: normalize.normalized_events(a.user_day_raw(s, d)).select(*PLAIN), sql(LIFE.format("", "CASE WHEN activity IN (SELECT activity FROM ud WHERE lifecycle = 'start') THEN lifecycle = 'start' ELSE lifecycle = 'complete' END")))
add("norm_fulfilment", lambda s, d: a.fulfilment(s, d).select(*PLAIN, "outcome"), sql("SELECT case_id, event_index, activity, timestamp, resource, outcome FROM ful"))
add("norm_exclusion_counts", lambda s, d: normalize.exclusion_counts(normalize.classified(a.order_lines_raw(s, d))).select("reason", "events"), sql("SELECT t.reason, count(ol.reason) AS events FROM unnest(['missing_case_id', 'duplicate_case_id', 'missing_activity', 'missing_timestamp', 'unparseable_timestamp', 'out_of_order']) t(reason) LEFT JOIN ol ON ol.reason = t.reason GROUP BY ALL"))
add("norm_lifecycle_counts", lambda s, d: normalize.lifecycle_counts(normalize.classified(a.user_day_raw(s, d))), sql("SELECT lifecycle, count(*) AS events FROM ud GROUP BY ALL"))
add("norm_report", lambda s, d: normalize.report(normalize.classified(a.order_lines_raw(s, d))), sql("SELECT count(*) AS parsed_events, count(*) FILTER (reason IS NULL) AS normalized_events, count(reason) AS excluded_events, CAST(0 AS BIGINT) AS filtered_events, count(DISTINCT case_id) AS parsed_cases, count(DISTINCT CASE WHEN reason IS NULL THEN case_id END) AS normalized_cases, count(*) FILTER (reason IS NULL AND resource IS NULL) AS missing_resource FROM ol"))
for _reason, _name in (("duplicate_case_id", "norm_duplicate_cases"), ("out_of_order", "norm_out_of_order")):
    add(_name, lambda s, d, r=_reason: normalize.classified(a.order_lines_raw(s, d)).where(F.col("reason") == r).select("case_id", "event_index", "activity", "resource"), sql(f"SELECT case_id, event_index, activity, resource FROM ol WHERE reason = '{_reason}'"))
add("case_outcomes", lambda s, d: conformance.case_outcomes(a.user_day_outcomes(s, d)), sql("SELECT case_id, any_value(outcome) AS outcome FROM udo GROUP BY case_id"))
add("outcome_counts", lambda s, d: normalize.outcome_counts(a.user_day_outcomes(s, d)), sql("SELECT coalesce(o, 'no_terminal_state') AS outcome, count(*) AS cases FROM (SELECT any_value(outcome) AS o FROM udo GROUP BY case_id) GROUP BY ALL"))

# model
GRID = ", names AS (SELECT DISTINCT activity FROM {log}), grid AS (SELECT x.activity AS a, y.activity AS b, coalesce(f.frequency, 0) AS ab, coalesce(r.frequency, 0) AS ba FROM names x JOIN names y ON x.activity <> y.activity LEFT JOIN pairs f ON f.source = x.activity AND f.target = y.activity LEFT JOIN pairs r ON r.source = y.activity AND r.target = x.activity), dep AS (SELECT *, CAST(ab - ba AS DOUBLE) / (CAST(ab + ba AS DOUBLE) + 1.0) AS dependency FROM grid)"
RELATION = "SELECT a, b, ab, ba, dependency, CASE WHEN ab = 0 AND ba = 0 THEN '#' WHEN dependency >= {t} THEN '->' WHEN dependency <= -{t} THEN '<-' WHEN ab > 0 AND ba > 0 THEN '||' ELSE '~' END AS relation FROM dep"
add("dependency_pairs", lambda s, d: miner.pairs(a.fulfilment(s, d)).select("a", "b", "dependency"), sql("SELECT a, b, dependency FROM dep", steps("ful"), GRID.format(log="ful")))
add("footprint_pairs", lambda s, d: miner.pairs(a.fulfilment(s, d)), sql(RELATION.format(t="0.9::DOUBLE"), steps("ful"), GRID.format(log="ful")))
add("footprint_low_threshold", lambda s, d: miner.pairs(a.user_day(s, d), 0.05), sql(RELATION.format(t="0.05::DOUBLE"), steps("ud"), GRID.format(log="ud")))
CAUSAL = "SELECT source, target, dependency, frequency FROM both_ways WHERE source <> target AND dependency >= 0.9::DOUBLE"
SELF = "SELECT source, target, frequency::DOUBLE / (frequency + 1.0::DOUBLE) AS dependency, frequency FROM pairs WHERE source = target AND frequency::DOUBLE / (frequency + 1.0::DOUBLE) >= 0.9::DOUBLE"
add("causal_edges", lambda s, d: miner.causal_edges(a.fulfilment(s, d)), sql(CAUSAL, steps("ful")))
add("l1_loops", lambda s, d: miner.self_loops(a.fulfilment(s, d)), sql(SELF, steps("ful")))
add("l2_patterns", lambda s, d: miner.aba_patterns(a.dialogue(s, d)), sql("SELECT a, b, n AS occurrences FROM aba", steps("dlg"), TWO_LOOPS))
add("l2_loops", lambda s, d: miner.two_loops(a.fulfilment(s, d)), sql("SELECT * FROM loops2", steps("ful"), TWO_LOOPS))
for _log, _sql in (("user_day", "ud"), ("fulfilment", "ful"), ("dialogue", "dlg")):
    _edges = f", every AS (SELECT *, 'causal' AS kind, 0 AS r FROM ({CAUSAL}) UNION ALL SELECT *, 'length_one_loop', 1 FROM ({SELF}) UNION ALL SELECT *, 'length_two_loop', 2 FROM loops2), model AS (SELECT source, target, kind, dependency, frequency FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY r) AS k FROM every) WHERE k = 1)"
    add(f"model_edges_no_connect_{_log}", lambda s, d, f=getattr(a, _log): miner.model_edges(f(s, d)), sql("SELECT * FROM model", steps(_sql), TWO_LOOPS, _edges))
    add(f"model_edges_{_log}", lambda s, d, f=getattr(a, _log): miner.connected(f(s, d)), sql("SELECT * FROM connected", steps(_sql), TWO_LOOPS, _edges, CONNECT.format(log=_sql)))
    add(f"orphan_activities_{_log}", lambda s, d, f=getattr(a, _log): miner.orphans_of(f(s, d)), sql(f"SELECT DISTINCT activity FROM {_sql} WHERE activity NOT IN (SELECT source FROM model WHERE source <> target UNION ALL SELECT target FROM model WHERE source <> target)", steps(_sql), TWO_LOOPS, _edges))
add("model_edges_sorted", lambda s, d: miner.connected(a.fulfilment(s, d)).orderBy("source", "target").limit(7), sql("SELECT * FROM connected ORDER BY source, target LIMIT 7", steps("ful"), TWO_LOOPS, _edges.replace("dlg", "ful"), CONNECT.format(log="ful")))

# variants and cases
VARIANT = "SELECT variant_rank, variant, length, case_count, CAST(case_count AS DOUBLE) / total AS case_share, CAST(upto AS DOUBLE) / total AS cumulative_share FROM upto"
add("variants_table", lambda s, d: variants.variants(a.user_day(s, d)), sql(VARIANT, seqs("ud")))
add("variants_dialogue", lambda s, d: variants.variants(a.dialogue(s, d)), sql(VARIANT, seqs("dlg")))
add("variants_top_k", lambda s, d: variants.top(a.fulfilment(s, d), 25).drop("seq", "_total"), sql(VARIANT + " ORDER BY variant_rank LIMIT 25", seqs("ful")))
add("variant_coverage", lambda s, d: variants.coverage(a.user_day(s, d)), sql("SELECT count(*) FILTER (upto - case_count < ceil(round(CAST(0.8 AS DOUBLE) * total, 9))) AS variants_needed, count(*) AS variants, count(*) FILTER (case_count = 1) AS singletons FROM upto", seqs("ud")))
STAT = "SELECT case_id, start_time, end_time, CAST(micro AS DOUBLE) / 1e6 AS cycle_time_seconds, length AS activity_count, variant_rank, variant_rank = 1 AS is_happy_path, outcome FROM stats"
add("case_statistics", lambda s, d: variants.case_statistics(a.user_day_outcomes(s, d)), sql(STAT, seqs("udo", OUTCOME)))
SUMMARY = "count(*) AS count, CAST(sum(micro) AS DOUBLE) / count(*) / 1e6 AS mean, CAST(min(micro) AS DOUBLE) / 1e6 AS min, round(quantile_cont(micro, 0.5) / 1e6, 8) AS p50, round(quantile_cont(micro, 0.9) / 1e6, 8) AS p90, round(quantile_cont(micro, 0.99) / 1e6, 8) AS p99, CAST(max(micro) AS DOUBLE) / 1e6 AS max FROM stats"
add("cycle_time_summary", lambda s, d: variants.distribution(variants.case_statistics(a.user_day(s, d)), "cycle_time_seconds"), sql("SELECT " + SUMMARY, seqs("ud")))
add("cycle_time_by_happy_path", lambda s, d: variants.distribution(variants.case_statistics(a.user_day(s, d)), "cycle_time_seconds", ["is_happy_path"]), sql("SELECT variant_rank = 1 AS is_happy_path, " + SUMMARY + " GROUP BY 1", seqs("ud")))
add("cycle_time_histogram", lambda s, d: variants.histogram(variants.case_spans(a.fulfilment(s, d))), sql(
    ", days AS (SELECT CAST(micro AS DOUBLE) / 1e6 / 86400 AS days, variant_rank = 1 AS happy FROM stats), u AS (SELECT greatest(1, CAST(ceil(round(quantile_cont(days, 0.99), 6)) AS BIGINT)) AS upper FROM days), w AS (SELECT greatest(1, CAST(ceil(upper / 30.0) AS BIGINT)) AS width, upper FROM u), b AS (SELECT width, CAST(ceil(CAST(upper AS DOUBLE) / width) AS BIGINT) AS bins FROM w), every AS (SELECT unnest(range(0, bins + 1)) AS bin, width, bins FROM b), binned AS (SELECT least(CAST(floor(days / width) AS BIGINT), bins) AS bin, happy FROM days, b) "
    "SELECT e.bin, CAST(e.bin * width AS BIGINT) AS from_days, e.bin = bins AS overflow, count(*) FILTER (happy) AS happy, count(*) FILTER (NOT happy) AS other FROM every e LEFT JOIN binned USING (bin) GROUP BY e.bin, width, bins", seqs("ful")))  # fmt: skip
VO = ", vo AS (SELECT variant_rank, coalesce(outcome, 'no_terminal_state') AS outcome, count(*) AS cases FROM stats GROUP BY ALL)"
add("variant_outcomes", lambda s, d: variants.variant_outcomes(variants.case_statistics(a.user_day_outcomes(s, d))), sql("SELECT * FROM vo", seqs("udo", OUTCOME), VO))
add("top_variant_by_outcome", lambda s, d: variants.top_variant_by_outcome(variants.case_statistics(a.user_day_outcomes(s, d))), sql("SELECT variant_rank, outcome, cases FROM (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY cases DESC, variant_rank) AS k FROM vo) WHERE k = 1", seqs("udo", OUTCOME), VO))
add("outcome_mix", lambda s, d: variants.outcome_mix(variants.case_statistics(a.user_day_outcomes(s, d))), sql("SELECT outcome, CAST(sum(cases) AS BIGINT) AS cases, CAST(sum(cases) AS DOUBLE) / sum(sum(cases)) OVER () AS share FROM vo GROUP BY outcome", seqs("udo", OUTCOME), VO))

# conformance
def reference_row(s: SparkSession, log: DataFrame, strategy: str, outcome: str | None = None) -> DataFrame:
    r = conformance.reference(log, strategy, outcome)
    return s.range(1).select(F.lit(" > ".join(r["activities"])).alias("activities"), F.lit(r["supporting_cases"]).cast("bigint").alias("supporting_cases"), F.lit(r["eligible_cases"]).cast("bigint").alias("eligible_cases"))


REFERENCE = "SELECT variant AS activities, case_count AS supporting_cases, CAST(total AS BIGINT) AS eligible_cases FROM ranked WHERE variant_rank = 1"
add("reference_most_frequent", lambda s, d: reference_row(s, a.fulfilment(s, d), "most_frequent_variant"), sql(REFERENCE, seqs("ful")))
add("reference_for_outcome", lambda s, d: reference_row(s, a.fulfilment(s, d), "most_frequent_variant_for_outcome", "finished"), sql(REFERENCE, ", fin AS (SELECT * FROM ful WHERE outcome = 'finished')", seqs("fin")))
REPLAYED = "SELECT case_id, produced, consumed, missing, remaining, unknown_activities, fitness, fits FROM replayed"
add("replay_documented", lambda s, d: conformance.replay_sequence(a.user_day_outcomes(s, d), VIEW_TO_BUY), sql(REPLAYED, BUY))
add("replay_fold", lambda s, d: conformance.replay(a.user_day_outcomes(s, d), conformance.sequence_net(VIEW_TO_BUY)), sql(REPLAYED, BUY))


FOLDED = "SELECT case_id, produced, consumed, missing, remaining, unknown_activities, fitness, fits FROM folded"
add("replay_repeated_labels", lambda s, d: conformance.replay_most_frequent(a.dialogue(s, d)), sql(FOLDED, seqs("dlg"), FOLD))
add("replay_modal", lambda s, d: conformance.replay_most_frequent(a.fulfilment(s, d)), sql(FOLDED, seqs("ful"), FOLD))
add("replay_summary", lambda s, d: conformance.summary(conformance.replay_sequence(a.user_day_outcomes(s, d), VIEW_TO_BUY)), sql("SELECT count(*) AS cases, count(*) FILTER (fits) AS fitting_cases, 1 - CAST(count(*) FILTER (fits) AS DOUBLE) / count(*) AS deviating_share, 0.5 * (1.0 - CAST(sum(missing) AS DOUBLE) / sum(consumed)) + 0.5 * (1.0 - CAST(sum(remaining) AS DOUBLE) / sum(produced)) AS log_fitness, round(avg(fitness), 9) AS mean, round(quantile_cont(fitness, 0.1), 9) AS p10, round(quantile_cont(fitness, 0.5), 9) AS p50, round(quantile_cont(fitness, 0.9), 9) AS p90 FROM replayed", BUY))
BY_OUTCOME = ", co AS (SELECT case_id, any_value(outcome) AS outcome FROM udo GROUP BY case_id)"
add("fitness_by_outcome", lambda s, d: conformance.fitness_by_outcome(conformance.replay_sequence(log := a.user_day_outcomes(s, d), VIEW_TO_BUY), log), sql("SELECT coalesce(outcome, 'no terminal state') AS outcome, round(avg(fitness), 9) AS mean_fitness, count(*) AS cases, count(*) FILTER (fits) AS fitting_cases FROM replayed LEFT JOIN co USING (case_id) GROUP BY 1", BUY, BY_OUTCOME))

# time
for _log, _sql in (("user_day", "ud"), ("fulfilment", "ful")):
    _f = getattr(a, _log)
    _tail = "" if _log == "fulfilment" else "_user_day"
    add(f"bottlenecks{_tail}", lambda s, d, f=_f: timing.bottlenecks(f(s, d)), sql(f"SELECT {BOTTLED} FROM bottled", steps(_sql), WAITS))
    add(f"bottleneck_most_costly{_tail}", lambda s, d, f=_f: timing.bottlenecks(f(s, d)).orderBy(F.desc("total_seconds"), "source", "target").limit(1), sql(f"SELECT {BOTTLED} FROM bottled ORDER BY total_seconds DESC, source, target LIMIT 1", steps(_sql), WAITS))
    add(f"slow_threshold{_tail}", lambda s, d, f=_f: timing.slow_threshold(timing.waits(f(s, d))), sql("SELECT * FROM slow", steps(_sql), WAITS))
    add(f"bottleneck_kinds{_tail}", lambda s, d, f=_f: timing.kind_counts(timing.bottlenecks(f(s, d))), sql("SELECT t.kind, count(b.kind) AS transitions FROM unnest(['uniformly_slow', 'slow_and_variable', 'high_variance', 'not_flagged', 'insufficient_data']) t(kind) LEFT JOIN bottled b ON b.kind = t.kind GROUP BY t.kind", steps(_sql), WAITS))
    add(f"bottlenecks_flagged{_tail}", lambda s, d, f=_f: timing.of_kind(timing.bottlenecks(f(s, d)), "high_variance"), sql(f"SELECT {BOTTLED} FROM bottled WHERE kind = 'high_variance'", steps(_sql), WAITS))
    add(f"rework_cases{_tail}", lambda s, d, f=_f: timing.rework_cases(f(s, d)), sql("SELECT case_id, rework_events, repeated_activities, r / 1e6 AS rework_seconds, c / 1e6 AS cycle_time_seconds, CASE WHEN c = 0 THEN 0.0 ELSE r / c END AS rework_share_of_cycle_time FROM rw", REWORK.format(log=_sql)))
    add(f"rework_activities{_tail}", lambda s, d, f=_f: timing.rework_activities(f(s, d)), sql("SELECT activity, count(*) AS cases_with_rework, CAST(sum(n - 1) AS BIGINT) AS repeat_occurrences, CAST(sum(date_diff('microsecond', first, last)) AS DOUBLE) / 1e6 AS total_span_seconds, round(quantile_cont(date_diff('microsecond', first, last), 0.5) / 1e6, 8) AS median_span_seconds FROM reps GROUP BY activity", REWORK.format(log=_sql)))
    add(f"rework_totals{_tail}", lambda s, d, f=_f: timing.rework_totals(timing.rework_cases(f(s, d))), sql("SELECT count(*) AS cases, count(*) FILTER (rework_events > 0) AS cases_with_rework, CAST(sum(rework_events) AS BIGINT) AS rework_events, sum(r) / 1e6 AS rework_seconds, sum(c) / 1e6 AS cycle_time_seconds, coalesce(sum(r) / nullif(sum(c), 0.0), 0.0) AS time_share, CAST(count(*) FILTER (rework_events > 0) AS DOUBLE) / count(*) AS case_share, coalesce(round(quantile_cont(r, 0.5) FILTER (rework_events > 0) / 1e6, 8), 0.0) AS p50, coalesce(round(quantile_cont(r, 0.9) FILTER (rework_events > 0) / 1e6, 8), 0.0) AS p90, coalesce(round(quantile_cont(r, 0.99) FILTER (rework_events > 0) / 1e6, 8), 0.0) AS p99, coalesce(sum(r) / 1e6 / nullif(count(*) FILTER (rework_events > 0), 0), 0.0) AS mean FROM rw", REWORK.format(log=_sql)))


# map
add("process_map_edges", lambda s, d: miner.model_edges(log := a.fulfilment(s, d)).join(dfg.edges(log).drop("frequency"), ["source", "target"], "left"), sql("SELECT m.*, x.case_frequency, x.mean_duration_seconds, x.median_duration_seconds FROM model m LEFT JOIN (SELECT source, target, count(DISTINCT case_id) AS case_frequency, CAST(sum(micro) AS DOUBLE) / count(*) / 1e6 AS mean_duration_seconds, round(quantile_cont(micro, 0.5) / 1e6, 8) AS median_duration_seconds FROM steps WHERE target IS NOT NULL GROUP BY ALL) x USING (source, target)", steps("ful"), TWO_LOOPS, _edges.replace("dlg", "ful")))
add("variant_model_gap", lambda s, d: views.variant_model_gap(log := a.fulfilment(s, d), miner.model_edges(log)), sql(", parts AS (SELECT variant_rank, string_split(variant, ' > ') AS p FROM ranked), hops AS (SELECT variant_rank, unnest(p[:-2]) AS source, unnest(p[2:]) AS target FROM parts) SELECT r.variant_rank, count(h.source) FILTER (m.source IS NULL) AS missing_steps FROM ranked r LEFT JOIN hops h USING (variant_rank) LEFT JOIN model m ON m.source = h.source AND m.target = h.target GROUP BY 1", steps("ful"), TWO_LOOPS, _edges, seqs("ful")))

NODES = ", nodes AS (SELECT activity, count(*) AS events, coalesce(any_value(s.n), 0) AS starts, coalesce(any_value(e.n), 0) AS ends FROM {log} LEFT JOIN (SELECT activity, count(*) AS n FROM (SELECT arg_min(activity, event_index) AS activity FROM {log} GROUP BY case_id) GROUP BY 1) s USING (activity) LEFT JOIN (SELECT activity, count(*) AS n FROM (SELECT arg_max(activity, event_index) AS activity FROM {log} GROUP BY case_id) GROUP BY 1) e USING (activity) GROUP BY activity)"
add("map_nodes", lambda s, d: views.map_nodes(a.fulfilment(s, d)), sql("SELECT * FROM nodes", NODES.format(log="ful")))
add("map_text", lambda s, d: views.mermaid_lines(a.user_day(s, d), 12), sql(
    ", shown AS (SELECT *, row_number() OVER (ORDER BY frequency DESC, source, target) AS r FROM pairs QUALIFY r <= 12), ids AS (SELECT activity, 'n' || CAST(row_number() OVER (ORDER BY activity) - 1 AS VARCHAR) AS id FROM (SELECT source AS activity FROM shown UNION SELECT target FROM shown)), sizes AS (SELECT activity, count(*) AS n FROM ud GROUP BY 1), "
    "lines_of AS (SELECT 0 AS part, 0 AS r, 'flowchart LR' AS text UNION ALL SELECT 1, row_number() OVER (ORDER BY activity), '    ' || id || '[\"' || activity || '<br/>' || format('{:,}', n) || '\"]' FROM ids JOIN sizes USING (activity) "
    "UNION ALL SELECT 2, r, '    ' || x.id || ' -->|\"' || format('{:,}', frequency) || '\"| ' || y.id FROM shown JOIN ids x ON x.activity = source JOIN ids y ON y.activity = target UNION ALL SELECT 3, r, '    linkStyle ' || CAST(r - 1 AS VARCHAR) || ' stroke-width:' || CAST(round(1 + 7 * sqrt(CAST(frequency AS DOUBLE) / (SELECT max(frequency) FROM shown)), 1) AS VARCHAR) || 'px' FROM shown) "
    "SELECT row_number() OVER (ORDER BY part, r) - 1 AS line, text FROM lines_of", steps("ud")))  # fmt: skip
add("overview", lambda s, d: views.overview_row(a.user_day(s, d)), sql("SELECT (SELECT count(*) FROM ud) AS events, (SELECT count(*) FROM seqs) AS cases, (SELECT count(*) FROM ud) - (SELECT count(*) FROM seqs) AS transitions, (SELECT count(DISTINCT activity) FROM ud) AS activities, count(*) FILTER (upto - case_count < ceil(round(CAST(0.8 AS DOUBLE) * total, 9))) AS variants_needed, count(*) AS variants, count(*) FILTER (case_count = 1) AS singletons, max(CAST(case_count AS DOUBLE) / total) AS top_share FROM upto", seqs("ud")))
add("top_variants_outcomes", lambda s, d: variants.outcomes_by_count(variants.case_statistics(a.user_day_outcomes(s, d))).where("variant_rank <= 25").select("variant_rank", F.posexplode("outcomes").alias("position", "o")).select("variant_rank", F.col("position").cast("bigint").alias("position"), "o.outcome", "o.cases"), sql("SELECT variant_rank, row_number() OVER (PARTITION BY variant_rank ORDER BY cases DESC, outcome) - 1 AS position, outcome, cases FROM vo WHERE variant_rank <= 25", seqs("udo", OUTCOME), VO))
add("cycle_time_days", lambda s, d: variants.days_of(variants.spans(a.fulfilment(s, d))), sql("SELECT p50 / 86400 AS p50_days, p90 / 86400 AS p90_days, p99 / 86400 AS p99_days FROM (SELECT " + SUMMARY + ")", seqs("ful")))
add("variant_sequence", lambda s, d: s.createDataFrame([(" > ".join(variants.sequence(a.fulfilment(s, d), 3)),)], "variant string"), sql("SELECT variant FROM ranked WHERE variant_rank = 3", seqs("ful")))
add("dfg_top_edges", lambda s, d: dfg.by_frequency(dfg.edges(a.user_day(s, d))).limit(10).select("source", "target", "frequency"), sql("SELECT source, target, frequency FROM pairs ORDER BY frequency DESC, source, target LIMIT 10", steps("ud")))
add("edge_frequency", lambda s, d: s.createDataFrame([(x, y, dfg.frequency(a.user_day(s, d), x, y)) for x, y in (("view", "click"), ("click", "gone"))], "source string, target string, frequency bigint"), sql("SELECT x AS source, y AS target, coalesce(frequency, 0) AS frequency FROM (VALUES ('view', 'click'), ('click', 'gone')) v(x, y) LEFT JOIN pairs ON source = x AND target = y", steps("ud")))

def connected_sql(log: str) -> list[str]:
    return [steps(log), TWO_LOOPS, _edges, CONNECT.format(log=log)]


opportunities.register(add, sql, steps, seqs, NODES, connected_sql)

# dirty text
add("messy_rows", lambda s, d: normalize.classified(a.messy_raw(s, d)).selectExpr("case_id", "event_index", "activity", "lifecycle", "unix_micros(ts) AS us", "resource", "reason", "status"), sql("SELECT * FROM dirty", DIRTY))
add("messy_exclusions", lambda s, d: normalize.exclusion_counts(normalize.classified(a.messy_raw(s, d))).select("reason", "events"), sql("SELECT t.reason, count(x.reason) AS events FROM unnest(['missing_case_id', 'duplicate_case_id', 'missing_activity', 'missing_timestamp', 'unparseable_timestamp', 'out_of_order']) t(reason) LEFT JOIN dirty x ON x.reason = t.reason GROUP BY ALL", DIRTY))
add("messy_report", lambda s, d: normalize.report(normalize.classified(a.messy_raw(s, d))), sql("SELECT count(*) AS parsed_events, count(*) FILTER (status = 'normalized') AS normalized_events, count(*) FILTER (status = 'excluded') AS excluded_events, count(*) FILTER (status = 'filtered') AS filtered_events, count(DISTINCT case_id) AS parsed_cases, count(DISTINCT CASE WHEN status = 'normalized' THEN case_id END) AS normalized_cases, count(*) FILTER (status = 'normalized' AND resource IS NULL) AS missing_resource FROM dirty", DIRTY))
add("messy_log", lambda s, d: normalize.normalized_events(a.messy_raw(s, d)).select("case_id", "event_index", "activity", F.unix_micros("timestamp").alias("us"), "resource"), sql("SELECT case_id, event_index, activity, us, resource FROM dirty WHERE status = 'normalized'", DIRTY))


# files: what is written is read again
def raw_text(s: SparkSession, d: str) -> DataFrame:
    return a.user_day_raw(s, d).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def xes_again(s: SparkSession, d: str) -> DataFrame:
    at = f"{store.scratch(s)}/log.xes"
    xes.write_xes(raw_text(s, d), at)
    return xes.read_xes(s, at)


def xes_counts(s: SparkSession, d: str) -> DataFrame:
    at = f"{store.scratch(s)}/log.xes.gz"
    xes.write_xes(raw_text(s, d), at, "gzip")
    return s.createDataFrame([(xes.count_raw_events(s, at), xes.read_xes(s, at).count())], "counted bigint, parsed bigint")


def csv_again(s: SparkSession, d: str) -> DataFrame:
    at = f"{store.scratch(s)}/log.csv"
    store.write_log_csv(a.fulfilment(s, d), at)
    return store.read_log_csv(s, at)


def stored_again(s: SparkSession, d: str) -> DataFrame:
    folder = store.scratch(s)
    at, log = f"{folder}/log", store.staged(a.fulfilment(s, d), f"{folder}/given")
    store.replace_log(log.where("activity = 'Placed'"), at)
    store.replace_log(log, at, {"policy": "start_else_complete"})
    return store.read_log(s, at, ordered=True)


def running_edges(s: SparkSession, d: str) -> DataFrame:
    """The log in four batches by place in the case, then the edges that were kept up to date."""
    folder = store.scratch(s)
    log, at = store.staged(a.fulfilment(s, d).select(*dfg.NEEDED), f"{folder}/given"), f"{folder}/counts"
    for k, part in enumerate(("event_index < 2", "event_index BETWEEN 2 AND 3", "event_index BETWEEN 4 AND 6", "event_index > 6")):
        running.update(log.where(part), k, at)
    return running.edges(s, at)


def report_again(s: SparkSession, d: str) -> DataFrame:
    at = f"{store.scratch(s)}/ingestion_report.json"
    reports.write_ingestion_report(normalize.classified(a.messy_raw(s, d)), at, {"table": "events"})
    found = s.read.json(at, multiLine=True)
    return found.select(F.lit(reports.recorded_policy(s, at)).alias("policy"), "normalization.parsed_events", "normalization.normalized_events", "normalization.excluded_by_reason.out_of_order", "normalization.lifecycle_transitions.start")


def outputs(s: SparkSession, written: list[str]) -> DataFrame:
    """name and rows of the tables among written outputs, name and 1 of the texts."""
    rows = [(at.rsplit("/", 1)[1], s.read.option("header", True).csv(at).count() if at.endswith(".csv") else int(bool(store.read_text(s, at)))) for at in written]
    return s.createDataFrame(rows, "name string, rows bigint")


def file_again(s: SparkSession, found: DataFrame) -> DataFrame:
    """A table written as one CSV file, read back with its types."""
    at = f"{store.scratch(s)}/table.csv"
    store.write_one_csv(found, at)
    times = {"timestampFormat": store.TIMES, "timestampNTZFormat": store.TIMES}
    return s.read.schema(found.schema).options(header=True, enforceSchema=False, escape='"', **times).csv(at)


TIMED = ["case_id", "event_index", "activity", "date_format(timestamp, 'yyyy-MM-dd HH:mm:ss') AS at", "resource", "outcome"]
KEPT = sql("SELECT case_id, event_index, activity, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS at, resource, outcome FROM ful")
add("xes_round_trip", xes_again, sql("SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY event_index) - 1 AS event_index, activity, lifecycle, strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, resource FROM ud"))
add("xes_event_counts", xes_counts, sql("SELECT count(*) AS counted, count(*) AS parsed FROM ud"))
add("csv_round_trip", lambda s, d: csv_again(s, d).selectExpr(*TIMED), KEPT)
add("stored_log", lambda s, d: stored_again(s, d).selectExpr(*TIMED), KEPT)
add("running_edges", running_edges, sql("SELECT source, target, count(*) AS frequency, CAST(sum(micro) AS DOUBLE) / count(*) / 1e6 AS mean_duration_seconds, round(quantile_cont(micro, 0.5) / 1e6, 8) AS median_duration_seconds FROM steps WHERE target IS NOT NULL GROUP BY ALL", steps("ful")))
add("ingestion_report_file", report_again, sql("SELECT 'start_else_complete' AS policy, count(*) AS parsed_events, count(*) FILTER (status = 'normalized') AS normalized_events, count(*) FILTER (reason = 'out_of_order') AS out_of_order, count(*) FILTER (lifecycle = 'start') AS start FROM dirty", DIRTY))
add("discovery_outputs", lambda s, d: outputs(s, reports.write_discovery(a.user_day_outcomes(s, d), store.scratch(s))), sql("SELECT 'dfg_edges.csv' AS name, count(*) AS rows FROM pairs UNION ALL SELECT 'variants.csv', count(*) FROM ranked UNION ALL SELECT 'case_statistics.csv', count(*) FROM seqs UNION ALL SELECT unnest(['dfg.mmd', 'heuristic_net.json', 'discovery_summary.md']), 1", steps("ud"), seqs("ud")))
add("diagnosis_outputs", lambda s, d: outputs(s, reports.write_diagnosis(a.fulfilment(s, d), None, store.scratch(s))), sql("SELECT 'conformance_cases.csv' AS name, count(*) AS rows FROM cyc UNION ALL SELECT 'rework_cases.csv', count(*) FROM cyc UNION ALL SELECT 'rework_activities.csv', count(DISTINCT activity) FROM reps UNION ALL SELECT 'bottlenecks.csv', count(*) FROM pairs UNION ALL SELECT unnest(['conformance_summary.json', 'diagnostic_report.md']), 1", steps("ful"), REWORK.format(log="ful")))
for _file, _same in (("dfg_edges", "dfg_edges"), ("variants", "variants_table"), ("case_statistics", "case_statistics")):
    add(f"file_{_file}", lambda s, d, f=_file: file_again(s, reports.DISCOVERY[f"{f}.csv"](a.user_day_outcomes(s, d))), _FOUND[_same][1])
for _file, _same in (("conformance_cases", "replay_modal"), ("bottlenecks", "bottlenecks"), ("rework_cases", "rework_cases"), ("rework_activities", "rework_activities")):
    add(f"file_{_file}", lambda s, d, f=_file: file_again(s, reports.DIAGNOSIS[f"{f}.csv"](a.fulfilment(s, d))), _FOUND[_same][1])


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in _FOUND.items() if text}
