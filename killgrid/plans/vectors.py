"""Vector, cluster and suite analytics.

Mutants are grouped by task and a task holds a few dozen of them at most, so distances are
taken within a task only: here 20 consecutive vectors are one task and `label` is the cluster.
The work grows with the number of tasks, never with the square of the table.
"""

from __future__ import annotations

from .registry import query

_POINTS = """p AS (SELECT cast(floor(vec_id / 20) AS bigint) AS task, vec_id AS id, label, cast(embedding AS @vector) AS x FROM {embeddings} WHERE embedding IS NOT NULL)"""
_DIST = f"""{_POINTS}, d AS (SELECT a.task, a.id AS a, b.id AS b, a.label AS la, b.label AS lb, @distance(a.x; b.x) AS dist FROM p a JOIN p b ON a.task = b.task AND a.id <> b.id)"""
_CENTRAL = f"""{_DIST}, w AS (SELECT task, la AS label, a AS id, avg(dist) AS mean FROM d WHERE la = lb GROUP BY task, la, a),
 g AS (SELECT p.task, p.label, p.id, p.x, coalesce(w.mean, cast(0 AS double)) AS mean FROM p LEFT JOIN w ON w.task = p.task AND w.id = p.id),
 c AS (SELECT task, label, id, x, cast(1 AS double) - mean / greatest(max(mean) OVER (PARTITION BY task, label), cast(1e-9 AS double)) AS centrality, count(*) OVER (PARTITION BY task, label) AS n FROM g),
 t AS (SELECT task, label, id, x, n, CASE WHEN n = 1 THEN cast(1 AS double) ELSE round(centrality, 6) END AS centrality FROM c),
 r AS (SELECT *, row_number() OVER (PARTITION BY task, label ORDER BY centrality DESC, id) AS place FROM t)"""

query("pairwise_l2", f"WITH {_DIST} SELECT task, a, b, round(dist, 4) AS dist FROM d WHERE a < b")
query("silhouette", f"""WITH {_DIST}, m AS (SELECT task, a, la, lb, avg(dist) AS mean FROM d GROUP BY task, a, la, lb),
 s AS (SELECT task, a, max(CASE WHEN la = lb THEN mean END) AS own, min(CASE WHEN la <> lb THEN mean END) AS other FROM m GROUP BY task, a)
SELECT task, count(*) AS n, round(avg(CASE WHEN own IS NULL OR greatest(own, other) = 0 THEN cast(0 AS double) ELSE (other - own) / greatest(own, other) END), 4) AS silhouette FROM s WHERE other IS NOT NULL GROUP BY task""")
query("centrality", f"WITH {_CENTRAL} SELECT task, label, id, round(centrality, 4) AS centrality FROM r")
query("central_shortlist", f"WITH {_CENTRAL} SELECT task, label, id, place FROM r WHERE place <= greatest(1, cast(ceil(n * cast(0.4 AS double)) AS bigint))")
query("nearest_rep", f"""WITH {_CENTRAL}, reps AS (SELECT task, label, id, x FROM r WHERE place = 1),
 e AS (SELECT p.task, p.id, reps.id AS rep, round(@distance(p.x; reps.x), 6) AS dist FROM p JOIN reps ON reps.task = p.task),
 o AS (SELECT *, row_number() OVER (PARTITION BY task, id ORDER BY dist, rep) AS o FROM e)
SELECT task, id, rep, round(dist, 4) AS dist FROM o WHERE o = 1""")
query("handoff_summary", f"""WITH {_CENTRAL}, live AS (SELECT *, row_number() OVER (PARTITION BY task, label ORDER BY centrality DESC, id) AS k, count(*) OVER (PARTITION BY task, label) AS survivors FROM (SELECT task, label, id, centrality FROM r WHERE x[@first] > 0 AND place > 1) q)
SELECT task, label, id, survivors FROM live WHERE k = 1""")

query("cluster_context", """SELECT p_brand AS cluster, count(*) AS size, count_if(p_size > 25) AS live, min(p_partkey) AS first_id FROM {part} GROUP BY p_brand HAVING count(CASE WHEN p_size > 25 THEN 1 END) > 0""")
query("diff_rate", """SELECT user_id, count(*) AS probes, round(cast(count_if(event_type = 'purchase' OR event_type = 'click') AS double) / count(*), 4) AS diff_rate FROM {events} GROUP BY user_id""")
query(
    "stable_bucket",
    "SELECT p_partkey, aggregate(transform(filter(split(p_name, ''), x -> x <> ''), x -> cast(ascii(x) AS bigint)), cast(0 AS bigint), (s, x) -> s + x) % 17 / cast(16 AS double) AS bucket FROM {part}",
    "SELECT p_partkey, coalesce(list_sum(list_transform(string_split(p_name, ''), lambda x: unicode(x))), 0) % 17 / cast(16 AS double) AS bucket FROM {part}",
)
query(
    "suite_concat",
    "SELECT l_orderkey AS task, concat_ws('\n\n', transform(array_sort(collect_list(struct(l_linenumber, l_returnflag))), x -> x.l_returnflag)) AS suite FROM {lineitem} GROUP BY l_orderkey",
    "SELECT l_orderkey AS task, string_agg(l_returnflag, '\n\n' ORDER BY l_linenumber, l_returnflag) AS suite FROM {lineitem} GROUP BY l_orderkey",
)
# probes from lineitem: of each line number the greatest quantity and discount up to bounds around the predicate's
_PROBES = """probes AS (SELECT l_linenumber - 1 AS ix, max(CASE WHEN l_quantity <= 23 + l_linenumber % 3 THEN l_quantity END) AS q, max(CASE WHEN round(l_discount * 100) <= 4 + l_linenumber % 4 THEN l_discount END) AS d FROM {lineitem} GROUP BY l_linenumber),
 seen AS (SELECT ix, q < 25 AND d >= cast(0.05 AS double) AS want, q <= 25 AND d >= cast(0.05 AS double) AS boundary, q < 25 AND d > cast(0.05 AS double) AS strict, q >= 25 AND d >= cast(0.05 AS double) AS flip, q < 25 OR d >= cast(0.05 AS double) AS bool_flip, q < 24 AND d >= cast(0.05 AS double) AS const FROM probes),
 m AS (SELECT 'BOUNDARY_SHIFT' AS operator, ix, boundary <> want AS diff FROM seen UNION ALL SELECT 'BOUNDARY_STRICT', ix, strict <> want FROM seen UNION ALL SELECT 'COMPARISON_FLIP', ix, flip <> want FROM seen
 UNION ALL SELECT 'BOOLEAN_FLIP', ix, bool_flip <> want FROM seen UNION ALL SELECT 'CONSTANT_CHANGE', ix, const <> want FROM seen)"""
query("behaviour_signature", f"WITH {_PROBES} SELECT operator, count(*) AS probes, cast(sum(CASE WHEN diff THEN power(2, ix) ELSE 0 END) AS bigint) AS code, count_if(diff) AS killing, max(CASE WHEN diff THEN 1 ELSE 0 END) AS killed FROM m GROUP BY operator")
query("layer_escalation", """WITH k AS (SELECT l_orderkey AS task, count(*) AS total, count_if(l_returnflag = 'R') AS l1, count_if(l_returnflag = 'A') AS l2 FROM {lineitem} GROUP BY l_orderkey)
SELECT task, total, CASE WHEN total = l1 THEN 'skipped: no survivors' ELSE 'run' END AS layer2, CASE WHEN total = l1 + l2 THEN 'skipped: no survivors' ELSE 'run' END AS layer3, total - l1 - l2 AS survivors FROM k""")
query("fairness_views", """WITH a AS (SELECT l_orderkey AS task, sum(l_quantity) AS tokens, sum(CASE WHEN l_returnflag <> 'N' THEN l_quantity ELSE 0 END) AS paid, count(*) AS calls FROM {lineitem} GROUP BY l_orderkey)
SELECT count(*) AS n, round(sum(tokens), 2) AS tokens, round(sum(paid), 2) AS paid, cast(sum(calls) AS bigint) AS calls, round(avg(tokens), 4) AS mean_tokens, round(avg(paid), 4) AS mean_paid, round(CASE WHEN sum(tokens) = 0 THEN 0 ELSE sum(paid) / sum(tokens) END, 6) AS paid_share FROM a""")
query("runtime_stages", """SELECT stage, round(sum(sec), 2) AS sec, count(*) AS n FROM (SELECT 'mutation' AS stage, l_tax AS sec FROM {lineitem} UNION ALL SELECT 'probe', l_discount FROM {lineitem} UNION ALL SELECT concat('layer ', l_returnflag), l_quantity FROM {lineitem}) t GROUP BY stage""")
