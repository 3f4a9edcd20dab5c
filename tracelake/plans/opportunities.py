"""Queries on automation, its worth, the network of resources and the map's places, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from tracelake.operators import automation, dfg, network
from tracelake.plans import adapters as a
from tracelake.plans import views

ADOPTION, GROWTH, COST = [0.3, 0.6, 0.9], [-0.05, 0.0, 0.1], [20_000.0, 60_000.0]
STRONG = 1.7  # times the mean of handoffs

#: An event is in a loop if an activity that its case repeats spans it; everything else follows from counts.
SCORES = """, spans AS (SELECT case_id, min(event_index) AS lo, max(event_index) AS hi FROM {log} GROUP BY case_id, activity HAVING count(*) > 1),
looped AS (SELECT DISTINCT e.case_id, e.event_index FROM {log} e JOIN spans s ON s.case_id = e.case_id AND e.event_index BETWEEN lo AND hi),
ctx AS (SELECT case_id, event_index, activity, lag(activity) OVER w AS before, lead(activity) OVER w AS after, CAST(date_diff('microsecond', timestamp, lead(timestamp) OVER w) AS DOUBLE) / 1e6 AS sec FROM {log} WINDOW w AS (PARTITION BY case_id ORDER BY event_index)),
told AS (SELECT c.*, l.case_id IS NOT NULL AS in_loop, s.variant_rank <> 1 AS off_path FROM ctx c LEFT JOIN looped l USING (case_id, event_index) JOIN stats s USING (case_id)),
hb AS (SELECT activity, abs(sum(p * log2(p))) AS h FROM (SELECT activity, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY activity) AS p FROM ctx GROUP BY activity, before) GROUP BY activity),
ha AS (SELECT activity, abs(sum(p * log2(p))) AS h FROM (SELECT activity, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY activity) AS p FROM ctx GROUP BY activity, after) GROUP BY activity),
dims AS (SELECT activity, count(*) AS events, any_value(hb.h) AS hb, any_value(ha.h) AS ha, avg(sec) AS mean, coalesce(stddev_pop(sec) / nullif(avg(sec), 0), 0) AS cv,
  avg(CAST(in_loop AS INTEGER)) AS lr, avg(CAST(off_path AS INTEGER)) AS orr, avg(CAST(in_loop OR off_path AS INTEGER)) AS er, log2(count(*) OVER () + 1) AS even, max(count(*)) OVER () AS most FROM told JOIN hb USING (activity) JOIN ha USING (activity) GROUP BY activity),
parts AS (SELECT *, ln(1 + events) / ln(1 + most) AS volume, 1 - hb / even AS rep, 0.5 * (1 - ha / even) + 0.5 / (1 + cv) AS clear, 1 - er AS reg FROM dims),
scored AS (SELECT *, round(0.3 * volume + 0.25 * rep + 0.25 * clear + 0.2 * reg, 6) AS score FROM parts),
scores AS (SELECT *, row_number() OVER (ORDER BY score DESC, activity) AS rank FROM scored)
"""
SCORE_COLUMNS = "activity, events, round(mean, 3) AS mean_seconds, round(hb, 6) AS context_entropy, round(ha, 6) AS next_entropy, round(cv, 6) AS variation, round(lr, 6) AS loop_rate, round(orr, 6) AS off_path_rate, round(er, 6) AS exception_rate, round(volume, 6) AS volume, round(rep, 6) AS repetitiveness, round(clear, 6) AS rule_clarity, round(reg, 6) AS regularity, score, CAST(rank AS INTEGER) AS rank"

BUSINESS = f""", span AS (SELECT greatest(date_diff('microsecond', min(timestamp), max(timestamp)) / (86400e6 * 365.25 / 12), 1.0) AS months FROM {{log}}),
cands AS (SELECT activity, rank, events / months * coalesce(round(mean, 3), 0) * 0.02 / 3600 * 45.0 AS monthly FROM scores, span WHERE rank <= 3),
grid AS (SELECT * FROM (SELECT CAST(unnest({ADOPTION}) AS DOUBLE) AS adoption), (SELECT CAST(unnest({GROWTH}) AS DOUBLE) AS growth), (SELECT CAST(unnest({COST}) AS DOUBLE) AS cost)),
flows AS (SELECT *, monthly * adoption * pow(1 + growth, m / 12.0::DOUBLE) AS saved FROM cands, grid, (SELECT unnest(range(1, 37)) AS m)),
sums AS (SELECT *, sum(saved) OVER (PARTITION BY activity, adoption, growth, cost ORDER BY m) AS upto FROM flows),
business AS (SELECT activity, CAST(rank AS INTEGER) AS rank, adoption, growth, cost, round(any_value(monthly), 2) AS monthly_savings, CAST(min(m) FILTER (upto >= cost) AS INTEGER) AS payback_months, round(sum(saved / pow(1.08::DOUBLE, m / 12.0::DOUBLE)) - cost, 2) AS net_present_value FROM sums GROUP BY activity, rank, adoption, growth, cost)
"""

#: Betweenness from distances and numbers of shortest paths between all pairs.
BETWEEN = """, hand AS (SELECT giver, taker, count(*) AS n FROM (SELECT resource AS giver, lead(resource) OVER (PARTITION BY case_id ORDER BY event_index) AS taker FROM ful) WHERE giver <> taker GROUP BY ALL),
e AS (SELECT giver AS u, taker AS v FROM hand WHERE n >= {least}), nodes_of AS (SELECT u AS node FROM e UNION SELECT v FROM e),
walk(s, v, d, ways) USING KEY (s, v) AS (SELECT node, node, 0, CAST(1 AS DOUBLE) FROM nodes_of
  UNION SELECT w.s, e.v, w.d + 1, sum(w.ways) FROM walk w JOIN e ON e.u = w.v LEFT JOIN recurring.walk r ON r.s = w.s AND r.v = e.v WHERE r.s IS NULL GROUP BY w.s, e.v, w.d),
through AS (SELECT x.v AS node, sum(x.ways * y.ways / z.ways) AS b FROM walk x JOIN walk y ON y.s = x.v JOIN walk z ON z.s = x.s AND z.v = y.v WHERE x.d + y.d = z.d AND x.s <> x.v AND y.s <> y.v GROUP BY x.v)
SELECT node AS resource, round(coalesce(b, 0), 6) AS betweenness, coalesce(round(coalesce(b, 0) / nullif((count(*) OVER () - 1) * (count(*) OVER () - 2), 0), 9), 0) AS share FROM nodes_of LEFT JOIN through USING (node)
"""

SPARSE = """, met AS (SELECT source, target, least(x, y) AS a, greatest(x, y) AS b, count(*) AS n FROM (SELECT activity AS source, lead(activity) OVER w AS target, resource AS x, lead(resource) OVER w AS y FROM ful WINDOW w AS (PARTITION BY case_id ORDER BY event_index)) WHERE x <> y GROUP BY ALL),
whole AS (SELECT CAST(sum(n) AS BIGINT) AS t FROM met),
often AS (SELECT source, target, CAST(sum(n) AS BIGINT) AS here, count(*) AS pairs FROM met, whole GROUP BY source, target, t HAVING sum(n) >= 0.01::DOUBLE * t),
ends AS (SELECT source, target, a AS r, n FROM met UNION ALL SELECT source, target, b, n FROM met),
outs AS (SELECT source, target, r, CAST(sum(sum(n)) OVER (PARTITION BY r) - sum(n) AS BIGINT) AS o FROM ends GROUP BY source, target, r),
sparse AS (SELECT m.source, m.target, m.a, m.b, m.n AS meetings, round(CAST(x.o * y.o AS DOUBLE) / nullif(2 * (t - here), 0), 9) AS expected_elsewhere
  FROM met m JOIN often USING (source, target) JOIN outs x ON x.source = m.source AND x.target = m.target AND x.r = m.a JOIN outs y ON y.source = m.source AND y.target = m.target AND y.r = m.b, whole
  WHERE CAST(x.o * y.o AS DOUBLE) / nullif(2 * (t - here), 0) >= 1.0 AND NOT EXISTS (SELECT 1 FROM met z WHERE z.a = m.a AND z.b = m.b AND (z.source <> m.source OR z.target <> m.target)))
"""

#: Places on the map, wave by wave and sweep by sweep; edges_of: source, target.
PLACES = """, waves(layer, wave, seen) AS (SELECT 0, s, s FROM (SELECT coalesce(list(activity), []) AS s FROM nodes WHERE starts > 0)
  UNION ALL SELECT layer + 1, ahead, list_concat(seen, ahead) FROM (SELECT w.layer, w.seen, list_distinct(list_transform(list_filter((SELECT list({{'s': source, 't': target}}) FROM edges_of), lambda x: list_contains(w.wave, x.s) AND NOT list_contains(w.seen, x.t)), lambda x: x.t)) AS ahead FROM waves w) WHERE len(ahead) > 0),
reached AS (SELECT unnest(wave) AS activity, layer FROM waves),
layer_of AS (SELECT activity, coalesce(layer, (SELECT coalesce(max(layer), -1) + 1 FROM reached)) AS layer FROM nodes LEFT JOIN reached USING (activity)),
first_rows AS (SELECT list(r ORDER BY layer) AS rows, count(*) AS n FROM (SELECT layer, list(activity ORDER BY activity) AS r FROM layer_of GROUP BY layer)),
beside AS (SELECT coalesce(list(DISTINCT {{'a': x, 'b': y}}), []) AS near FROM (SELECT source AS x, target AS y FROM edges_of WHERE source <> target UNION SELECT target, source FROM edges_of WHERE source <> target)),
sweep(k, rows) AS (SELECT CAST(0 AS BIGINT), rows FROM first_rows
  UNION ALL SELECT k + 1, list_transform(range(1, n + 1), lambda j: CASE WHEN j = spot THEN list_transform(list_sort(list_transform(range(1, len(here) + 1), lambda i: {{'w': coalesce(list_avg(list_transform(list_filter(range(1, len(fixed) + 1), lambda p: list_contains(near, {{'a': here[i], 'b': fixed[p]}})), lambda p: p - 1)), CAST(i - 1 AS DOUBLE)), 'i': i, 'name': here[i]}})), lambda x: x.name) ELSE rows[j] END)
  FROM (SELECT k, rows, n, near, spot, rows[spot] AS here, CASE WHEN back AND spot < n THEN rows[spot + 1] WHEN NOT back AND spot > 1 THEN rows[spot - 1] ELSE [] END AS fixed
    FROM (SELECT s.k, s.rows, f.n, b.near, (s.k // f.n) % 2 = 1 AS back, CASE WHEN (s.k // f.n) % 2 = 1 THEN f.n - s.k % f.n ELSE s.k % f.n + 1 END AS spot FROM sweep s, first_rows f, beside b WHERE s.k < 4 * f.n))),
layer_rows AS (SELECT unnest(rows) AS here, unnest(range(0, len(rows))) AS layer FROM sweep WHERE k = (SELECT max(k) FROM sweep)),
placed AS (SELECT unnest(here) AS activity, CAST(layer AS INTEGER) AS layer, CAST(unnest(range(0, len(here))) AS INTEGER) AS spot, len(here) AS size FROM layer_rows)
"""
PLACED = "SELECT n.activity, events, starts, ends, layer, spot AS \"order\", layer * 210.0::DOUBLE AS x, (spot - (size - 1) / 2.0::DOUBLE) * 64 AS y FROM nodes n JOIN placed USING (activity)"
CROSSED = ", lines_of AS (SELECT DISTINCT p.layer, p.spot AS f, q.spot AS t FROM edges_of e JOIN placed p ON p.activity = e.source JOIN placed q ON q.activity = e.target WHERE q.layer = p.layer + 1) SELECT count(*) AS crossings FROM lines_of x JOIN lines_of y ON x.layer = y.layer AND x.f < y.f AND x.t > y.t"


def register(add: Callable, sql: Callable, steps: Callable, seqs: Callable, nodes: str, connected: Callable[[str], list[str]]) -> None:
    """Add the queries. nodes: SQL of a log's map nodes; connected: SQL parts of a log's connected model."""
    for log, name, tail in ((a.user_day, "ud", "_user_day"), (a.fulfilment, "ful", "")):
        scored = seqs(name), SCORES.format(log=name)
        add(f"automation_scores{tail}", lambda s, d, f=log: automation.scores(f(s, d)), sql(f"SELECT {SCORE_COLUMNS} FROM scores", *scored))
        add(f"business_case{tail}", lambda s, d, f=log: automation.business_case(f(s, d), ADOPTION, GROWTH, COST), sql("SELECT * FROM business", *scored, BUSINESS.format(log=name)))
    add("business_sensitivity", lambda s, d: automation.sensitivity(automation.business_case(a.user_day(s, d), ADOPTION, GROWTH, COST)), sql("SELECT activity, count(*) AS scenarios, count(payback_months) AS paying, min(payback_months) AS shortest_payback, max(payback_months) AS longest_payback, min(net_present_value) AS least_value, max(net_present_value) AS most_value FROM business GROUP BY activity", seqs("ud"), SCORES.format(log="ud"), BUSINESS.format(log="ud")))

    strong = lambda h: h.join(h.agg((F.avg("handoffs") * STRONG).alias("least"))).where("handoffs >= least")  # noqa: E731  one row
    add("handoff_betweenness", lambda s, d: network.betweenness(dfg.handoffs(a.fulfilment(s, d))), sql("", BETWEEN.format(least=0)))
    add("handoff_betweenness_strong", lambda s, d: network.betweenness(strong(dfg.handoffs(a.fulfilment(s, d)))), sql("", BETWEEN.format(least=f"(SELECT {STRONG} * avg(n) FROM hand)")))
    add("sparse_teams", lambda s, d: network.sparse_teams(a.fulfilment(s, d)), sql("SELECT * FROM sparse", SPARSE))
    add("team_sparsity", lambda s, d: network.team_sparsity(a.fulfilment(s, d)), sql("SELECT source, target, pairs, coalesce(s, 0) AS sparse, round(CAST(coalesce(s, 0) AS DOUBLE) / pairs, 9) AS sparsity FROM often LEFT JOIN (SELECT source, target, count(*) AS s FROM sparse GROUP BY ALL) USING (source, target)", SPARSE))

    for log, name, tail in ((a.user_day, "ud", "_user_day"), (a.fulfilment, "ful", "")):
        of_model = nodes.format(log=name), *connected(name), ", edges_of AS (SELECT source, target FROM connected)", PLACES.format()
        add(f"process_map_placed{tail}", lambda s, d, f=log: views.placed_nodes(f(s, d)), sql(PLACED, *of_model))
        of_graph = steps(name), nodes.format(log=name), ", edges_of AS (SELECT source, target FROM pairs)", PLACES.format()
        add(f"graph_placed{tail}", lambda s, d, f=log: views.graph_nodes(f(s, d)), sql(PLACED, *of_graph))
        add(f"map_crossings{tail}", lambda s, d, f=log: views.map_crossings(f(s, d)), sql(CROSSED, *of_model))
        add(f"graph_crossings{tail}", lambda s, d, f=log: views.graph_crossings(f(s, d)), sql(CROSSED, *of_graph))
