"""Oracles of statements by their definitions: counts of what came before instead of windows, lists and sets instead of
flags. Where a statement's text runs in both engines, these say that it is the right one."""

from __future__ import annotations

from . import analytics, reports, vectors  # noqa: F401  their statements must be there
from .registry import apart

_A = "a AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS it FROM events)"
#: The last gain up to an attempt, and tries without gain since then, failed calls aside.
_STREAK = f"""{_A}, g AS (SELECT x.*, coalesce((SELECT max(z.it) FROM a z WHERE z.user_id = x.user_id AND z.it <= x.it AND z.event_type = 'purchase'), 0) AS gain_at FROM a x WHERE x.event_type <> 'error'),
 s AS (SELECT g.*, (SELECT count(*) FROM a y WHERE y.user_id = g.user_id AND y.it <= g.it AND y.it > g.gain_at AND y.event_type NOT IN ('error', 'purchase')) AS streak FROM g)"""
apart("plateau", f"WITH {_STREAK} SELECT user_id, it, streak, streak >= 3 AS stopped FROM s")
apart("first_plateau", f"WITH {_STREAK} SELECT user_id, min(it) AS first_it FROM s WHERE streak >= 3 GROUP BY user_id")
apart("stop_reason", f"""WITH {_STREAK}, l AS (SELECT user_id, list(event_type ORDER BY it) AS said, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS gains FROM a GROUP BY user_id), e AS (SELECT user_id, arg_max(streak, it) AS streak FROM s GROUP BY user_id)
SELECT l.user_id, CASE WHEN gains = n THEN 'zero_survivors' WHEN coalesce(e.streak, 0) >= 3 THEN 'plateau' WHEN len(said) >= 2 AND said[-1] = 'error' AND said[-2] = 'error' THEN 'consecutive_infrastructure_errors' ELSE 'budget_exhausted' END AS reason FROM l LEFT JOIN e USING (user_id)""")
apart("two_errors", f"WITH {_A} SELECT x.user_id, min(x.it) AS stop_it FROM a x JOIN a y ON y.user_id = x.user_id AND y.it = x.it - 1 WHERE x.event_type = 'error' AND y.event_type = 'error' GROUP BY x.user_id")
apart("cum_kills", f"WITH {_A} SELECT x.user_id, x.it, (SELECT count(*) FROM a y WHERE y.user_id = x.user_id AND y.it <= x.it AND y.event_type = 'purchase') AS kills, round((SELECT sum(y.value) FROM a y WHERE y.user_id = x.user_id AND y.it <= x.it), 4) AS tokens, round((SELECT count(*) FILTER (y.event_type = 'purchase' AND y.it <= x.it) / count(*)::DOUBLE FROM a y WHERE y.user_id = x.user_id), 6) AS score FROM a x")
apart("first_final", f"WITH {_A} SELECT user_id, count(*) FILTER (event_type = 'purchase') AS final, coalesce(max(it) FILTER (event_type = 'purchase'), 1) AS first_it FROM a GROUP BY user_id")
apart("last_n_attempts", f"WITH {_A} SELECT user_id, event_id, it FROM a x WHERE (SELECT count(*) FROM a y WHERE y.user_id = x.user_id AND y.it > x.it) < 3")

# killed lines of two raters as sets of row numbers
_SETS = """k AS (SELECT l_orderkey AS task, row_number() OVER () AS m, l_quantity, l_discount FROM lineitem), s AS (SELECT task, list(m) AS every, coalesce(list(m) FILTER (l_quantity > 20), []) AS ours, coalesce(list(m) FILTER (l_discount >= 0.05::DOUBLE), []) AS theirs FROM k GROUP BY task),
 n AS (SELECT task, len(every) AS total, len(list_intersect(ours, theirs)) AS tp, len(ours) AS p, len(theirs) AS t FROM s), c AS (SELECT task, tp, p - tp AS fp, t - tp AS fn, total - p - t + tp AS tn FROM n)"""
apart("confusion", f"""WITH {_SETS} SELECT task, tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 4) AS accuracy, coalesce(round(tp / nullif(tp + fp, 0)::DOUBLE, 4), 0) AS prec, coalesce(round(tp / nullif(tp + fn, 0)::DOUBLE, 4), 0) AS recall, coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 4), 0) AS f1 FROM c""")
apart("agreement", f"WITH {_SETS} SELECT round(avg((tp + tn) / (tp + fp + fn + tn)::DOUBLE), 6) AS accuracy, round(avg(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0)), 6) AS prec, count(*) AS n FROM c")

# distances dimension by dimension, means over all other members
_D = """u AS (SELECT vec_id // 20 AS task, vec_id AS id, label, unnest(embedding::DOUBLE[]) AS v, unnest(range(len(embedding))) AS dim FROM embeddings WHERE embedding IS NOT NULL),
 d AS (SELECT a.task, a.id AS a, b.id AS b, a.label AS la, b.label AS lb, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS dist FROM u a JOIN u b ON b.task = a.task AND b.dim = a.dim AND b.id <> a.id GROUP BY ALL)"""
apart("pairwise_l2", f"WITH {_D} SELECT task, a, b, round(dist, 4) AS dist FROM d WHERE a < b")
_C = f"""{_D}, p AS (SELECT DISTINCT task, id, label FROM u), w AS (SELECT p.task, p.label, p.id, coalesce((SELECT avg(dist) FROM d WHERE d.a = p.id AND d.la = d.lb), 0) AS mean FROM p),
 c AS (SELECT *, (SELECT count(*) FROM w o WHERE o.task = w.task AND o.label = w.label) AS n, (SELECT max(mean) FROM w o WHERE o.task = w.task AND o.label = w.label) AS most FROM w), t AS (SELECT task, label, id, n, CASE WHEN n = 1 THEN 1.0 ELSE round(1 - mean / greatest(most, 1e-9), 6) END AS centrality FROM c)"""
apart("centrality", f"WITH {_C} SELECT task, label, id, round(centrality, 4) AS centrality FROM t")
apart("central_shortlist", f"WITH {_C}, r AS (SELECT t.*, 1 + (SELECT count(*) FROM t o WHERE o.task = t.task AND o.label = t.label AND (o.centrality > t.centrality OR o.centrality = t.centrality AND o.id < t.id)) AS place FROM t) SELECT task, label, id, place FROM r WHERE place <= greatest(1, ceil(n * 0.4::DOUBLE))")
apart("diff_rate", "SELECT user_id, len(list(event_type)) AS probes, round(len(list_filter(list(event_type), lambda x: x IN ('purchase', 'click'))) / len(list(event_type))::DOUBLE, 4) AS diff_rate FROM events GROUP BY user_id")
_U = "u AS (SELECT user_id, round(sum(CASE event_type WHEN 'purchase' THEN value WHEN 'click' THEN -value ELSE 0 END), 6) AS d, count(*) AS w FROM events GROUP BY user_id)"
apart("sign_counts", f"WITH {_U}, l AS (SELECT list(CASE WHEN abs(d) <= 1e-12 THEN 0 ELSE sign(d) END) AS s FROM u) SELECT len(list_filter(s, lambda x: x = 1)) AS wins, len(list_filter(s, lambda x: x = -1)) AS losses, len(list_filter(s, lambda x: x = 0)) AS ties FROM l")
