"""Report tables and the frames behind the plots, over the driver's tables (see analytics.py for what stands for what).

Each is one aggregate or one window within keys; intervals are drawn over clusters' sums, so that resampling costs
the same at every size.
"""

from __future__ import annotations

from .analytics import _CUM, _FACTS, _IX, _KILL, _PLATEAU, _REP, _REP_O, _SEQ
from .registry import query

_RATIO = "CASE WHEN {1} <> 0 THEN round(cast({0} AS double) / {1}, {2}) ELSE 0 END".format
# --- roll-ups -------------------------------------------------------------------
query("run_summary", """WITH t AS (SELECT l_returnflag AS layer, sum(l_extendedprice) AS tokens, cast(count(*) AS double) AS calls, sum(l_discount) AS cost FROM {lineitem} GROUP BY l_returnflag),
 u AS (SELECT layer, 'tokens' AS metric, tokens AS amount FROM t UNION ALL SELECT layer, 'calls', calls FROM t UNION ALL SELECT layer, 'cost', cost FROM t),
 s AS (SELECT metric, sum(CASE WHEN layer = 'A' THEN amount ELSE 0 END) AS layer1, sum(CASE WHEN layer = 'R' THEN amount ELSE 0 END) AS layer2, sum(CASE WHEN layer = 'N' THEN amount ELSE 0 END) AS baseline FROM u GROUP BY metric)
SELECT metric, round(layer1, 2) AS layer1, round(layer2, 2) AS layer2, round(layer1 + layer2, 2) AS proposed, round(baseline, 2) AS baseline, CASE WHEN baseline > 0 THEN round((baseline - layer1 - layer2) / baseline * 100, 2) ELSE 0 END AS saved_percent FROM s""")
_EFFECT = f"""WITH {_FACTS}, e AS (SELECT c.c_nationkey AS k, m.method, f.total, f.total - f.equiv AS adjusted, CASE m.method WHEN 'proposed' THEN f.killed ELSE f.official END AS killed
  FROM facts f JOIN {{orders}} o ON o.o_orderkey = f.task JOIN {{customer}} c ON c.c_custkey = o.o_custkey CROSS JOIN (VALUES ('proposed'), ('official')) m(method)),
 p AS (SELECT k, method, avg(cast(killed AS double) / total) AS macro, cast(sum(killed) AS double) AS num, cast(sum(total) AS double) AS den,
  avg(CASE WHEN adjusted > 0 THEN cast(least(killed, adjusted) AS double) / adjusted ELSE 0 END) AS adjusted_macro, cast(sum(least(killed, adjusted)) AS double) AS adjusted_num, cast(sum(adjusted) AS double) AS adjusted_den FROM e GROUP BY k, method),
 x AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY method) AS n FROM p),
 r AS (SELECT method, b, {_IX.replace("%%", "%")} AS ix FROM x CROSS JOIN @rep t),
 m AS (SELECT x.method, r.b, avg(macro) AS macro, sum(num) / sum(den) AS micro, avg(adjusted_macro) AS adjusted_macro, CASE WHEN sum(adjusted_den) > 0 THEN sum(adjusted_num) / sum(adjusted_den) ELSE 0 END AS adjusted_micro FROM r JOIN x ON x.method = r.method AND x.i = r.ix GROUP BY x.method, r.b),
 l AS ({" UNION ALL ".join(f"SELECT method, '{c}' AS score, {c} AS v FROM m" for c in ("macro", "micro", "adjusted_macro", "adjusted_micro"))}),
 q AS (SELECT method, avg(macro) AS macro, sum(num) / sum(den) AS micro, avg(adjusted_macro) AS adjusted_macro, CASE WHEN sum(adjusted_den) > 0 THEN sum(adjusted_num) / sum(adjusted_den) ELSE 0 END AS adjusted_micro FROM p GROUP BY method),
 o AS ({" UNION ALL ".join(f"SELECT method, '{c}' AS score, {c} AS point FROM q" for c in ("macro", "micro", "adjusted_macro", "adjusted_micro"))})
SELECT o.method, o.score, round(o.point, 6) AS point, round(@quantile(l.v, cast(0.025 AS double)), 5) AS lo, round(@quantile(l.v, cast(0.975 AS double)), 5) AS hi FROM o JOIN l ON l.method = o.method AND l.score = o.score GROUP BY o.method, o.score, o.point"""
query("effectiveness_summary", _EFFECT.replace("@rep", _REP), _EFFECT.replace("@rep", _REP_O))
_CONF = f"WITH {_KILL}, n AS (SELECT task, count(*) AS total, count_if(ours) AS own, count_if(theirs) AS official, count_if(ours AND theirs) AS tp, count_if(ours AND NOT theirs) AS fp, count_if(theirs AND NOT ours) AS fn FROM k GROUP BY task)"
query("agreement_metrics", f"""{_CONF}, s AS (SELECT cast(total - fp - fn AS double) / total AS accuracy, CASE WHEN tp + fp > 0 THEN cast(tp AS double) / (tp + fp) ELSE 0 END AS prec, CASE WHEN tp + fn > 0 THEN cast(tp AS double) / (tp + fn) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN cast(2 * tp AS double) / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM n)
{" UNION ALL ".join(f"SELECT '{c}' AS metric, round(avg({c}), 6) AS mean, count(*) AS n FROM s" for c in ("accuracy", "prec", "recall", "f1"))}""")
query("official_comparison", f"""WITH {_FACTS} SELECT task, round(cast(killed AS double) / total, 4) AS score, round(cast(official AS double) / total, 4) AS official_score,
 {_RATIO("least(killed, total - equiv)", "(total - equiv)", 4)} AS adjusted_score, {_RATIO("least(official, total - equiv)", "(total - equiv)", 4)} AS adjusted_official, killed >= official AS wins FROM facts""")
query("benchmark_summary", f"""{_CONF} SELECT count(*) AS tasks, round(avg(cast(own AS double) / total), 4) AS mean_score, round(avg(cast(official AS double) / total), 4) AS mean_official, round(avg(CASE WHEN own >= official THEN cast(1 AS double) ELSE 0 END), 4) AS win_rate, round(avg(CASE WHEN tp > 0 THEN cast(1 AS double) ELSE 0 END), 4) AS sanity_rate FROM n""")
query("comparison_rows", """WITH c AS (SELECT l_orderkey AS task, count(*) AS calls, sum(l_extendedprice) AS tokens, count_if(l_returnflag <> 'N') AS kills, count(DISTINCT l_suppkey) AS reps, max(cast(regexp_extract(concat('Layer', cast(l_linenumber AS @text)), '([0-9]+)', 1) AS int)) AS max_layer FROM {lineitem} GROUP BY l_orderkey),
 b AS (SELECT o_orderkey AS task, o_totalprice AS tokens, CASE WHEN o_orderstatus = 'F' THEN 4 ELSE 2 END AS kills FROM {orders})
SELECT c.task, c.max_layer, c.kills - b.kills AS kill_delta, round(c.tokens - b.tokens, 2) + cast(0 AS double) AS token_delta, CASE WHEN b.tokens > 0 THEN round((b.tokens - c.tokens) / b.tokens, 4) + cast(0 AS double) ELSE 0 END AS saved, round(cast(c.calls AS double) / c.reps, 4) AS compression,
 CASE WHEN c.kills > b.kills THEN 'proposed' WHEN c.kills < b.kills THEN 'baseline' ELSE 'tie' END AS winner FROM c JOIN b ON b.task = c.task""")
_TRACK = "SELECT user_id, count(*) AS calls, round(sum(value), 4) AS tokens, {0} AS statuses, {1} AS last_status, count(*) < 3 AS short FROM {{events}} GROUP BY user_id".format
query("tracker_summary", _TRACK("array_join(array_sort(collect_set(event_type)), ';')", "max_by(event_type, struct(ts, event_id))"), _TRACK("array_to_string(list_sort(list(DISTINCT event_type)), ';')", "max_by(event_type, (ts, event_id))"))
query("shard_merge", """WITH s AS (SELECT o_orderkey % 3 AS shard, o_orderpriority AS subset, count(*) AS n, max(o_orderdate) AS latest FROM {orders} GROUP BY o_orderkey % 3, o_orderpriority)
SELECT subset, count(*) AS shards, cast(sum(n) AS bigint) AS tasks, max(latest) AS latest FROM s GROUP BY subset""")
# --- stopping views: all attempts, up to the plateau, up to the last gain, within a budget ------
query("stopping_views", f"""{_PLATEAU}, {_CUM}, f AS (SELECT user_id, min(CASE WHEN streak >= 3 THEN it END) AS flat FROM s GROUP BY user_id), z AS (SELECT user_id, max(CASE WHEN gain = 1 THEN it END) AS last_gain FROM a GROUP BY user_id),
 v AS (SELECT w.view, c.user_id, c.value, c.gain, c.n FROM c LEFT JOIN f ON f.user_id = c.user_id JOIN z ON z.user_id = c.user_id CROSS JOIN (VALUES ('all'), ('plateau'), ('last_gain'), ('budget')) w(view)
  WHERE w.view = 'all' OR (w.view = 'plateau' AND c.it <= coalesce(f.flat, c.it)) OR (w.view = 'last_gain' AND c.it <= coalesce(z.last_gain, 0)) OR (w.view = 'budget' AND c.tokens <= 500)),
 u AS (SELECT view, user_id, sum(value) AS tokens, cast(sum(gain) AS double) / max(n) AS score FROM v GROUP BY view, user_id)
SELECT view, round(sum(tokens), 2) AS tokens, round(sum(score) / (SELECT count(DISTINCT user_id) FROM a), 6) AS macro_score FROM u GROUP BY view""")
# --- filters --------------------------------------------------------------------------
query("skip_filter", "WITH x AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'True' WHEN 1 THEN 'YES' WHEN 2 THEN '1' WHEN 3 THEN 'no' END AS skipped FROM {events}) SELECT event_id FROM x WHERE lower(trim(coalesce(skipped, ''))) NOT IN ('true', '1', 'yes')")
query("finite_filter", "WITH x AS (SELECT event_type, CASE WHEN event_id % 7 = 0 THEN cast('NaN' AS double) WHEN event_id % 11 = 0 THEN cast('Infinity' AS double) WHEN event_id % 13 = 0 THEN cast('-Infinity' AS double) WHEN event_id % 17 = 0 THEN NULL ELSE value END AS v FROM {events}) SELECT event_type, count(*) AS n, round(avg(v), 4) AS mean FROM x WHERE v IS NOT NULL AND NOT isnan(v) AND abs(v) < cast('Infinity' AS double) GROUP BY event_type")
query("all_equivalent", "SELECT l_orderkey AS task, count(*) AS mutants, count_if(l_returnflag = 'N') = count(*) AS all_probable FROM {lineitem} GROUP BY l_orderkey")
query("numeric_or_default", "SELECT user_id, event_id, coalesce(try_cast(CASE WHEN event_id % 3 = 0 THEN 'n/a' WHEN event_id % 3 = 1 THEN NULL ELSE cast(value AS @text) END AS double), cast(0 AS double)) AS v FROM {events}")
# --- top of each cluster ------------------------------------------------------------------
query("failure_context", "SELECT cluster, id, survivors, place FROM (SELECT p_brand AS cluster, p_partkey AS id, count(*) OVER (PARTITION BY p_brand) AS survivors, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM {part} WHERE p_size > 25) t WHERE place <= 10")
query("fallback_targets", "SELECT task, mutant, place FROM (SELECT l_orderkey AS task, l_linenumber AS mutant, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_discount DESC, l_linenumber) AS place FROM {lineitem} WHERE l_returnflag <> 'R') t WHERE place <= 5")
query("compact_mutants", "SELECT l_orderkey AS task, concat('m', lpad(cast(l_linenumber AS @text), 3, '0')) AS mutant, round(l_discount / 3, 4) AS centrality, round(l_tax / 7, 4) AS information FROM {lineitem}")
# --- texts ------------------------------------------------------------------------------------
_EVIDENCE = "WITH x AS (SELECT user_id, CASE event_type WHEN 'purchase' THEN 'different' WHEN 'error' THEN 'timeout' ELSE 'same' END AS label, event_id FROM {{events}}) SELECT user_id, CASE WHEN count_if(label <> 'same') = 0 THEN 'no probe differs' ELSE {0} END AS evidence FROM x GROUP BY user_id".format
query("probe_evidence", _EVIDENCE("array_join(transform(array_sort(collect_list(struct(event_id, label))), s -> s.label), ',')"), _EVIDENCE("string_agg(label, ',' ORDER BY event_id)"))
query("numbered_rules", "SELECT r_regionkey AS id, concat('R', cast(row_number() OVER (ORDER BY r_regionkey) AS @text), '. ', r_name) AS line FROM {region}")
query("renamed_checks", "SELECT p_partkey, regexp_replace(concat('def check(candidate): # ', p_name), '^def check\\\\(candidate\\\\):', concat('def baseline_check_', cast(p_partkey AS @text), '(candidate):')) AS test FROM {part}", "SELECT p_partkey, regexp_replace(concat('def check(candidate): # ', p_name), '^def check\\(candidate\\):', concat('def baseline_check_', cast(p_partkey AS varchar), '(candidate):')) AS test FROM part")
_DELAY = "SELECT event_id, least(cast(60 AS double), greatest(cast(1 AS double), coalesce(try_cast(nullif(regexp_extract(m, 'retry in ([0-9]+[.]?[0-9]*)(ms|s)', 1), '') AS double), cast(5 AS double)) / CASE WHEN regexp_extract(m, 'retry in ([0-9]+[.]?[0-9]*)(ms|s)', 2) = 'ms' THEN 1000 ELSE 1 END)) AS seconds"
query("retry_delay", f"{_DELAY} FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat('quota: retry in ', cast(event_id AS @text), 's') WHEN 1 THEN concat('retry in ', cast(event_id AS @text), '.5ms') WHEN 2 THEN 'later' ELSE '' END AS m FROM {{events}}) t")
# --- frames behind the plots ------------------------------------------------------------------------
query("plot_score_tokens", f"WITH {_FACTS} SELECT task, round(cast(killed AS double) / total, 6) AS score, round(o_totalprice, 2) AS tokens FROM facts JOIN {{orders}} ON o_orderkey = task")
query("plot_layer_kills", f"SELECT l_linestatus AS layer, round(cast(count_if(l_returnflag = 'R') AS double) / count(DISTINCT l_orderkey), 6) AS mean_new_kills, {_RATIO('sum(l_extendedprice)', 'count_if(l_returnflag = {0})', 4).replace('{0}', chr(39) + 'R' + chr(39))} AS tokens_per_kill FROM {{lineitem}} GROUP BY l_linestatus")
query("plot_runtime", "WITH t AS (SELECT event_type, sum(value) AS v, sum(value * 2) AS w FROM {events} GROUP BY event_type) SELECT concat('layer_', event_type) AS stage, round(v, 3) AS seconds FROM t UNION ALL SELECT 'probing', round(sum(w), 3) FROM t UNION ALL SELECT 'total', round(sum(v + w), 3) FROM t")
query("plot_prompt_chars", "SELECT event_type AS layer, count(*) AS calls, round(avg(length(props)), 4) AS mean_chars, max(cast(length(props) AS bigint)) AS most_chars FROM {events} GROUP BY event_type")
query("plot_subset_scores", f"WITH {_FACTS} SELECT coalesce(nullif(o_orderpriority, ''), 'unknown') AS subset, round(avg(cast(killed AS double) / total), 6) AS proposed, round(avg(cast(official AS double) / total), 6) AS official, {_RATIO('sum(o_totalprice)', 'sum(killed)', 4)} AS tokens_per_kill FROM facts JOIN {{orders}} ON o_orderkey = task GROUP BY coalesce(nullif(o_orderpriority, ''), 'unknown')")
query("plot_operator_rates", "SELECT p_type AS operator, kill_rate, total, row_number() OVER (ORDER BY kill_rate, total DESC, p_type) AS place FROM (SELECT p_type, round(cast(count_if(l_returnflag = 'R') AS double) / count(*), 6) AS kill_rate, count(*) AS total FROM {lineitem} JOIN {part} ON p_partkey = l_partkey GROUP BY p_type) t")
