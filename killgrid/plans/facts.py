"""The driver's tables as facts of two methods, and the report tables over them as queries.

Orders are tasks, as far as events reach them: eight events in a row are the calls of a task, four of the proposed
method and four of the baseline. Lines are mutants. A call that didn't fail or get rejected kills the mutants whose
number, user and event add up to a multiple of three. The derivation of facts is the same text in both engines; what
is computed from them is written apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import report_tables, resampling
from ..operators.comparison import Facts, compare
from ..sources import shared
from .registry import DIALECT, dataframe_query

_METHOD = "CASE WHEN event_id % 8 < 4 THEN 'proposed' ELSE 'baseline' END AS method"
_ATTEMPT = "cast(event_id % 4 + 1 AS bigint) AS attempt"
_CALLS = f"""SELECT event_id, user_id, {_METHOD}, concat('T/', cast(event_id @div 8 AS @text)) AS problem_id,
  CASE WHEN event_id % 8 < 2 THEN 'Layer1' WHEN event_id % 8 < 4 THEN concat('Layer', cast(event_id % 8 AS @text)) ELSE 'Baseline' END AS layer, {_ATTEMPT},
  CASE event_type WHEN 'view' THEN 'hf' WHEN 'click' THEN 'gemini' WHEN 'purchase' THEN 'openai' END AS provider, CASE WHEN user_id % 3 > 0 THEN concat('model-', cast(user_id % 3 AS @text)) END AS model, event_type,
  cast(user_id % 4 AS bigint) AS target_count, cast(round(value * 100) AS bigint) AS total_tokens, cast(round(value * 100) AS bigint) @div 3 AS prompt_tokens, cast(round(value * 100) AS bigint) - cast(round(value * 100) AS bigint) @div 3 AS completion_tokens,
  cast(length(props) AS bigint) AS prompt_chars, cast(length(event_type) AS bigint) AS response_chars, round(value, 2) / 7 AS latency_sec, round(value, 2) / 1000 AS estimated_cost_usd, CASE event_type WHEN 'view' THEN 'syntax error' ELSE '' END AS validation_reason
  FROM {{events}}"""
_MUTANTS = """SELECT concat('T/', cast(l_orderkey AS @text)) AS problem_id, cast(l_linenumber AS bigint) AS mutant, min(p_type) AS operator, CASE WHEN max(l_tax) >= cast(0.08 AS double) THEN 'STATIC_EQUIVALENT' ELSE 'UNKNOWN' END AS equivalence_status, max(l_extendedprice) > 40000 AS official
  FROM {lineitem} JOIN {part} ON p_partkey = l_partkey GROUP BY l_orderkey, l_linenumber"""
_TASKS = """SELECT concat('T/', cast(o_orderkey AS @text)) AS problem_id, 'orders' AS dataset_name, CASE WHEN o_orderpriority NOT LIKE '5%' THEN o_orderpriority END AS dataset_subset, '' AS source_task_id, CASE WHEN o_custkey % 7 = 0 THEN '' ELSE concat('P/', cast(o_custkey % 40 AS @text)) END AS parent_task_id, o_totalprice AS price
  FROM {orders} WHERE o_orderkey IN (SELECT event_id @div 8 FROM {events})"""
_CLUSTERS = "SELECT concat('T/', cast(l_orderkey AS @text)) AS problem_id, count(DISTINCT l_suppkey % 3) AS num_clusters, count(DISTINCT l_suppkey % 5) AS representatives FROM {lineitem} GROUP BY l_orderkey"
_HIT = "event_type IN ('purchase', 'click') AND (mutant + user_id + event_id) % 3 = 0"
#: Calls a Spark task has on average.
CALLS = 200_000
#: Replicas of the registered tables' intervals: what the published study draws.
REPLICAS = 5000
_SHARES = {"mutant_generation_sec": 100, "behavior_signature_sec": 50, "clustering_sec": 10, "total_problem_sec": 200}


def _text(sql: str, spark: bool) -> str:
    for mark, words in ({"@div": ("div", "//")} | DIALECT).items():
        sql = sql.replace(mark, words[0 if spark else 1])
    return sql if spark else sql.replace("{", "").replace("}", "")


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read again by all that need it."""
    path = shared.scratch(df.sparkSession, f"report-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def facts(spark: SparkSession, sf_dir: str, keep: Callable[[DataFrame, str], DataFrame] = kept) -> Facts:
    """All facts are dealt by task into the same number of parts, so that what is keyed by task meets without another
    shuffle. `keep` writes the mutants, which nearly every table reads several times."""
    views = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "lineitem", "part", "orders")}
    # rows of orders that no event can reach count nowhere: they go while they are read, before any shuffle
    for t, key in (("lineitem", "l_orderkey"), ("orders", "o_orderkey")):
        reached = f"SELECT * FROM {{rows}} WHERE {key} BETWEEN (SELECT min(event_id div 8) FROM {{events}}) AND (SELECT max(event_id div 8) FROM {{events}})"
        views[t] = spark.sql(reached, rows=views[t], events=views["events"])
    sql = lambda s: spark.sql(_text(s, True), **{t: v for t, v in views.items() if f"{{{t}}}" in s})
    # keys of text are packed small, so that Spark, which joins partitions by bytes, gives a task more rows than it can hold
    parts = max(spark.sparkContext.defaultParallelism, -(-views["events"].count() // CALLS))
    dealt = lambda df: df.repartition(parts, "problem_id")
    calls, tasks, mutants = sql(_CALLS), dealt(sql(_TASKS)), keep(sql(_MUTANTS), "mutants")
    numbers = dealt(mutants.where("mutant IS NOT NULL").select("problem_id", "mutant"))
    tries = dealt(calls.select("problem_id", "event_id", "user_id", "event_type"))
    kills = tries.join(numbers, "problem_id").where(_HIT).selectExpr(_METHOD, "problem_id", _ATTEMPT, "mutant")
    # a call's status needs to know whether its attempt killed at all: whether the task has a mutant of the remainder that it hits
    remainders = numbers.groupBy("problem_id").agg(F.expr("bit_or(shiftleft(1, cast(pmod(mutant, 3) AS int)))").alias("remainders"))
    hit = F.expr("event_type IN ('purchase', 'click') AND remainders & shiftleft(1, cast(pmod(-pmod(user_id, 3) - pmod(event_id, 3), 3) AS int)) <> 0")
    found = dealt(calls).join(remainders, "problem_id", "left").withColumn("hit", F.bool_or(hit).over(Window.partitionBy("problem_id", "method", "attempt")))
    status = "CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'view' THEN 'REJECTED' WHEN hit THEN 'PRODUCTIVE' ELSE 'VALID_ZERO_KILL' END AS status"
    scored = found.selectExpr("*", status).drop("hit", "remainders", "event_type", "event_id", "user_id")
    stages = ", ".join(f"'{s}', price / {n}0000" for s, n in _SHARES.items())
    timings = tasks.selectExpr("problem_id", f"stack({len(_SHARES)}, {stages}) AS (stage, seconds)")
    # distinct remainders as bits: a remainder has its dividend's sign
    distinct = lambda n: F.coalesce(F.bit_count(F.bit_or(F.expr(f"shiftleft(1, cast(l_suppkey % {n} AS int) + {n})"))), F.lit(0)).cast("long")
    clusters = dealt(views["lineitem"].selectExpr("concat('T/', cast(l_orderkey AS string)) AS problem_id", "l_suppkey"))
    clusters = clusters.groupBy("problem_id").agg(distinct(3).alias("num_clusters"), distinct(5).alias("representatives"))
    every = dealt(mutants)
    return Facts(tasks.drop("price"), every.drop("official"), kills, every.where("official").select("problem_id", "mutant"), scored, clusters, timings, parts)


# --- the oracle: mutants and their first kills as rows, no bits, no as-of join ------------------------
_Z = "CASE WHEN {1} <> 0 THEN round({0} / ({1})::DOUBLE, {2}) ELSE 0 END".format
_BASE = f"""
WITH calls0 AS ({_CALLS}), m0 AS ({_MUTANTS}), tasks AS ({_TASKS}), cl AS ({_CLUSTERS}),
m AS (SELECT * FROM m0 WHERE problem_id IN (SELECT problem_id FROM tasks)),
hit AS (SELECT DISTINCT method, problem_id, attempt, mutant FROM calls0 JOIN m USING (problem_id) WHERE {_HIT}),
firsts AS (SELECT method, problem_id, mutant, min(attempt) AS first FROM hit GROUP BY ALL),
c1 AS (SELECT c.*, (SELECT count(*) FROM hit h WHERE h.method = c.method AND h.problem_id = c.problem_id AND h.attempt = c.attempt) AS killed_mutants,
  (SELECT count(*) FROM firsts f WHERE f.method = c.method AND f.problem_id = c.problem_id AND f.first = c.attempt) AS new_kills,
  (SELECT count(*) FROM firsts f WHERE f.method = c.method AND f.problem_id = c.problem_id AND f.first <= c.attempt) AS cumulative_kills, (SELECT count(*) FROM m WHERE m.problem_id = c.problem_id) AS total
  FROM calls0 c JOIN tasks USING (problem_id)),
calls AS (SELECT *, CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'view' THEN 'REJECTED' WHEN killed_mutants > 0 THEN 'PRODUCTIVE' ELSE 'VALID_ZERO_KILL' END AS status, {_Z("cumulative_kills", "total", 6)} AS cumulative_score, coalesce(provider, '') NOT IN ('', 'hf', 'mock', 'local') AS paid FROM c1),
hist0 AS (SELECT problem_id, attempt AS iteration, status, new_kills, cumulative_kills, cumulative_score, CAST(sum(total_tokens) OVER w AS BIGINT) AS cumulative_tokens, CAST(sum(CASE WHEN paid THEN total_tokens ELSE 0 END) OVER w AS BIGINT) AS cumulative_paid_tokens, max(cumulative_kills) OVER (PARTITION BY problem_id) AS final
  FROM calls WHERE method = 'baseline' WINDOW w AS (PARTITION BY problem_id ORDER BY attempt ROWS UNBOUNDED PRECEDING)),
hist AS (SELECT h.*, (SELECT count(*) FROM hist0 x WHERE x.problem_id = h.problem_id AND x.iteration <= h.iteration AND x.new_kills = 0 AND x.status <> 'ERROR' AND x.iteration > coalesce((SELECT max(y.iteration) FROM hist0 y WHERE y.problem_id = h.problem_id AND y.iteration <= h.iteration AND y.new_kills > 0), 0)) AS streak FROM hist0 h),
k AS (SELECT m.problem_id, m.mutant, m.equivalence_status = 'STATIC_EQUIVALENT' AS eq, m.official AS o, p.first IS NOT NULL AS p, b.first IS NOT NULL AS b FROM m LEFT JOIN firsts p ON p.problem_id = m.problem_id AND p.mutant = m.mutant AND p.method = 'proposed' LEFT JOIN firsts b ON b.problem_id = m.problem_id AND b.mutant = m.mutant AND b.method = 'baseline'),
kt AS (SELECT problem_id, count(*) AS total_mutants, count(*) FILTER (p) AS proposed_killed, count(*) FILTER (b) AS baseline_killed, count(*) FILTER (o) AS official_killed, count(*) FILTER (eq) AS equivalent_mutants, count(*) FILTER (p = o) AS pa, count(*) FILTER (b = o) AS ba, count(*) FILTER (p AND o) AS both_killed FROM k GROUP BY problem_id),
s AS (SELECT problem_id, {", ".join(f"coalesce(sum(total_tokens) FILTER (method = '{m}'), 0)::BIGINT AS {m}_total_tokens, count(*) FILTER (method = '{m}') AS {m}_llm_calls, coalesce(sum(total_tokens) FILTER (method = '{m}' AND paid), 0)::BIGINT AS {m}_paid_tokens, round(coalesce(sum(estimated_cost_usd) FILTER (method = '{m}'), 0), 8) AS {m}_estimated_cost_usd, round(coalesce(sum(estimated_cost_usd) FILTER (method = '{m}' AND paid), 0), 8) AS {m}_paid_cost_usd, round(coalesce(sum(latency_sec) FILTER (method = '{m}'), 0), 4) AS {m}_runtime_sec, count(*) FILTER (method = '{m}' AND status = 'PRODUCTIVE') AS {m}_generated_tests, coalesce(string_agg(DISTINCT provider, ',' ORDER BY provider) FILTER (method = '{m}'), '') AS {m}_providers, coalesce(string_agg(DISTINCT model, ',' ORDER BY model) FILTER (method = '{m}'), '') AS {m}_models" for m in ("proposed", "baseline"))},
  {", ".join(f"coalesce(sum(new_kills) FILTER (layer = 'Layer{i}'), 0)::BIGINT AS layer{i}_new_kills, count(*) FILTER (layer = 'Layer{i}') AS layer{i}_iterations, coalesce(max(cumulative_kills) FILTER (layer = 'Layer{i}'), 0) AS layer{i}_killed_mutants" for i in (1, 2, 3))}, coalesce(max(CAST(nullif(regexp_extract(layer, '^Layer([0-9]+)$', 1), '') AS INTEGER)), 0) AS final_layer_used FROM calls GROUP BY problem_id),
x AS (SELECT problem_id, min(iteration) FILTER (cumulative_kills = final) AS fi, min(iteration) FILTER (streak >= 1) AS pi FROM hist GROUP BY problem_id),
z AS (SELECT t.problem_id, t.dataset_name, t.dataset_subset AS raw_subset, t.parent_task_id, t.price, coalesce(kt.total_mutants, 0) AS total_mutants, coalesce(kt.proposed_killed, 0) AS proposed_killed, coalesce(kt.baseline_killed, 0) AS baseline_killed, coalesce(kt.official_killed, 0) AS official_killed, coalesce(kt.equivalent_mutants, 0) AS equivalent_mutants, coalesce(kt.pa, 0) AS pa, coalesce(kt.ba, 0) AS ba, coalesce(kt.both_killed, 0) AS both_killed, s.* EXCLUDE (problem_id), coalesce(cl.num_clusters, 0) AS num_clusters, coalesce(cl.representatives, 0) AS representatives, x.fi, x.pi
  FROM tasks t LEFT JOIN kt USING (problem_id) LEFT JOIN s USING (problem_id) LEFT JOIN cl USING (problem_id) LEFT JOIN x USING (problem_id)),
rows AS (SELECT z.*, greatest(0, total_mutants - equivalent_mutants) AS adjusted, {", ".join(f"{_Z(f'{m}_killed', 'total_mutants', 6)} AS {m}_score, {_Z(f'least({m}_killed, greatest(0, total_mutants - equivalent_mutants))', 'greatest(0, total_mutants - equivalent_mutants)', 6)} AS {m}_equivalent_adjusted_score" for m in ("proposed", "baseline", "official"))},
  {_Z("pa", "total_mutants", 4)} AS accuracy, {_Z("both_killed", "proposed_killed", 4)} AS kill_precision, {_Z("both_killed", "official_killed", 4)} AS kill_recall,
  coalesce((SELECT h.cumulative_tokens FROM hist h WHERE h.problem_id = z.problem_id AND h.iteration = z.fi), 0) AS ft, coalesce((SELECT h.cumulative_tokens FROM hist h WHERE h.problem_id = z.problem_id AND h.iteration = z.pi), 0) AS pt,
  coalesce((SELECT max(h.cumulative_score) FROM hist h WHERE h.problem_id = z.problem_id AND h.cumulative_tokens <= z.proposed_total_tokens), 0) AS ms, coalesce((SELECT max(h.cumulative_score) FROM hist h WHERE h.problem_id = z.problem_id AND h.cumulative_paid_tokens <= z.proposed_paid_tokens), 0) AS mp FROM z),
d AS (SELECT *, round(proposed_score - baseline_score, 6) + 0.0 AS delta, coalesce(raw_subset, 'unknown') AS subset FROM rows)
"""
_COMPARISON = f"""SELECT problem_id, dataset_name, coalesce(raw_subset, '') AS dataset_subset, problem_id AS source_task_id, parent_task_id, total_mutants, proposed_killed, baseline_killed, official_killed, proposed_score, baseline_score, official_score, equivalent_mutants,
 proposed_equivalent_adjusted_score, baseline_equivalent_adjusted_score, official_equivalent_adjusted_score, delta AS score_delta_proposed_minus_baseline, proposed_total_tokens, baseline_total_tokens, proposed_llm_calls, baseline_llm_calls, proposed_paid_tokens, baseline_paid_tokens, proposed_total_tokens - baseline_total_tokens AS token_delta_proposed_minus_baseline,
 proposed_estimated_cost_usd, baseline_estimated_cost_usd, proposed_paid_cost_usd, baseline_paid_cost_usd, proposed_runtime_sec, baseline_runtime_sec, proposed_generated_tests, baseline_generated_tests, accuracy AS proposed_kill_agreement_accuracy, {_Z("ba", "total_mutants", 4)} AS baseline_kill_agreement_accuracy,
 num_clusters AS layer1_num_clusters, representatives AS layer1_representatives, {_Z("total_mutants", "representatives", 4)} AS cluster_compression_ratio, final_layer_used, layer1_killed_mutants, layer1_new_kills, layer2_new_kills, layer3_new_kills, layer2_iterations > 0 AS layer2_used, layer3_iterations > 0 AS layer3_used, layer1_iterations, baseline_llm_calls AS baseline_iterations,
 coalesce(fi, 0) AS baseline_first_final_score_iteration, ft AS baseline_tokens_at_first_final_score, coalesce(pi, 0) AS baseline_first_plateau_iteration, pt AS baseline_tokens_at_plateau, ms AS baseline_score_at_matched_proposed_tokens, mp AS baseline_score_at_matched_proposed_paid_tokens, proposed_providers, proposed_models, baseline_providers, baseline_models, kill_precision, kill_recall FROM d"""
_M3 = "(VALUES ('proposed'), ('baseline'), ('official')) v(method)"
_PICK = lambda c, names=("proposed", "baseline", "official"): "CASE method " + " ".join(f"WHEN '{m}' THEN {m}_{c}" for m in names) + " END"
_SPENT = lambda c: f"CASE method WHEN 'proposed' THEN proposed_{c} WHEN 'baseline' THEN baseline_{c} ELSE 0 END"
_LONG = f"y AS (SELECT d.*, method, {_PICK('score')} AS score, {_PICK('killed')} AS killed, {_PICK('equivalent_adjusted_score')} AS adj FROM d, {_M3})"
# each test by counting and by ranks over all differences of a key
_PAIRED = """r AS (SELECT key, delta, rank() OVER (PARTITION BY key ORDER BY abs(delta)) + (count(*) OVER (PARTITION BY key, abs(delta)) - 1) / 2.0::DOUBLE AS rk FROM e WHERE abs(delta) > 1e-12),
rb AS (SELECT key, round(sum(CASE WHEN delta > 0 THEN rk ELSE -rk END) / sum(rk), 6) AS v FROM r GROUP BY key),
n AS (SELECT key, count(*) AS n_tasks, round(avg(delta), 6) AS mean_score_delta, count(*) FILTER (delta > 1e-12) AS wins, count(*) FILTER (abs(delta) <= 1e-12) AS ties, count(*) FILTER (delta < -1e-12) AS losses, CASE WHEN stddev_samp(delta) > 1e-12 THEN round(avg(delta) / stddev_samp(delta), 6) END AS cohen_dz, coalesce(stddev_samp(delta), 0) <= 1e-12 AS cohen_dz_undefined_zero_variance FROM e GROUP BY key),
t AS (SELECT n.*, wins + losses AS n_non_ties, round(least(1.0::DOUBLE, 2 * list_sum([exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) + (wins + losses) * ln(0.5::DOUBLE)) FOR i IN range(0, least(wins, losses) + 1)])), 9) AS p_value, coalesce(rb.v, 0) AS rank_biserial FROM n LEFT JOIN rb USING (key))"""
_TESTS = "wins, ties, losses, n_non_ties, p_value, cohen_dz, cohen_dz_undefined_zero_variance, rank_biserial"


def _mixed(src: str, keep: str = "") -> str:
    """The rows of src (keep, h below 2^32) with h mixed."""
    turn = "(xor(h, h >> 16) * 73244475) & 4294967295 AS h"
    return f"SELECT {keep} xor(h, h >> 16) AS h FROM (SELECT {keep} {turn} FROM (SELECT {keep} {turn} FROM ({src})))"


def _drawn(units: str, statistics: dict[str, str]) -> str:
    """CTE `ends`: {name}_low and {name}_high of the statistics, expressions over the units (unit, ...) that a replica
    draws. A replica's n draws choose blocks of numbered units first, then each draw of a block chooses a unit there."""
    size = resampling.NUMBERED
    dealt = _mixed(f"SELECT b, n, xor(i.h, k.h) AS h FROM ({_mixed('SELECT unnest(range(n)) AS h FROM bn')}) i, ({_mixed('SELECT b, h FROM br', 'b,')}) k, bn", "b, n,")
    blocks = f"SELECT b, n, (h * n) >> 32 AS spot FROM ({dealt})"
    keyed = _mixed("SELECT b, block, m, n, xor(h, block + 1) AS h FROM bm JOIN br USING (b), bn", "b, block, m, n,")
    inside = _mixed(f"SELECT b, block, n, k, unnest(range(m)) AS h FROM (SELECT b, block, m, n, h AS k FROM ({keyed}))", "b, block, n, k,")
    places = _mixed(f"SELECT b, block, n, xor(h, k) AS h FROM ({inside})", "b, block, n,")
    return f"""bu AS (SELECT *, row_number() OVER (ORDER BY substr(md5(unit), 1, 13), unit) - 1 AS place FROM ({units})), bn AS (SELECT count(*) AS n FROM bu), br AS ({_mixed(f"SELECT b, {resampling.SEED} + b AS h FROM range({REPLICAS}) r(b)", "b,")}),
bm AS (SELECT b, spot // {size} AS block, count(*) AS m FROM ({blocks}) GROUP BY b, block),
bs AS (SELECT b, {", ".join(f"{c} AS {name}" for name, c in statistics.items())} FROM (SELECT b, block * {size} + ((h * least({size}, n - block * {size})) >> 32) AS place FROM ({places})) JOIN bu USING (place) GROUP BY b),
ends AS (SELECT {", ".join(f"round(quantile_cont({c}, {q}::DOUBLE), 6) AS {c}_{end}" for c in statistics for end, q in (("low", 0.025), ("high", 0.975)))} FROM bs)"""


_RATIO = "CASE WHEN sum({1}) <> 0 THEN sum({0}) / sum({1})::DOUBLE ELSE 0 END".format
_EFFECTS = {f"{m}_{name}": c for m in ("proposed", "official") for name, c in (("macro_raw", f"avg({m}_score)"), ("micro_raw", _RATIO(f"{m}_killed", "total_mutants")), ("macro_adjusted", f"avg({m}_equivalent_adjusted_score)"), ("micro_adjusted", _RATIO(f"{m}_equivalent_adjusted_score * adjusted", "adjusted")))}
_F1 = "CASE WHEN kill_precision + kill_recall <> 0 THEN round(2 * kill_precision * kill_recall / (kill_precision + kill_recall), 4) ELSE 0 END"
_AGREE = {"kill_agreement_accuracy": "accuracy", "kill_precision": "kill_precision", "kill_recall": "kill_recall", "kill_f1": _F1}
_BETWEEN = lambda low: ", ".join(f"CASE method WHEN 'proposed' THEN proposed_{low}_{end} ELSE official_{low}_{end} END AS {low}_ci95_{end}" for end in ("low", "high"))
_ORACLES = {
    "effectiveness_summary": f"""{_BASE}, {_LONG}, g AS (SELECT CASE method WHEN 'official' THEN 'official_reference' ELSE method END AS method, count(*) AS n_tasks, round(avg(score), 6) AS a, round(sum(killed) / sum(total_mutants)::DOUBLE, 6) AS b, round(avg(adj), 6) AS c, round(sum(adj * adjusted) / sum(adjusted)::DOUBLE, 6) AS e FROM y WHERE method <> 'baseline' GROUP BY method), {_drawn("SELECT d.*, problem_id AS unit FROM d", _EFFECTS)}
SELECT method, n_tasks, a AS macro_raw, {_BETWEEN("macro_raw")}, b AS micro_raw, {_BETWEEN("micro_raw")}, c AS macro_equivalent_adjusted, {_BETWEEN("macro_adjusted")}, e AS micro_equivalent_adjusted, {_BETWEEN("micro_adjusted")} FROM g, ends""",
    "official_agreement_summary": f"""{_BASE}, g AS ({" UNION ALL ".join(f"SELECT '{n}' AS metric, avg({c}) AS v FROM d" for n, c in _AGREE.items())}), {_drawn("SELECT d.*, problem_id AS unit FROM d", {f"x_{n}": f"avg({c})" for n, c in _AGREE.items()})}
SELECT metric, round(v, 6) AS mean, {", ".join(f"CASE metric {' '.join(f'WHEN {chr(39)}{n}{chr(39)} THEN x_{n}_{end}' for n in _AGREE)} END AS ci95_{end}" for end in ("low", "high"))} FROM g, ends""",
    "paired_comparison_summary": f"""{_BASE}, e AS (SELECT 1 AS key, delta, total_mutants, parent_task_id, problem_id FROM d), {_PAIRED}, u AS (SELECT CASE WHEN parent_task_id = '' THEN concat('row ', problem_id) ELSE concat('cluster ', parent_task_id) END AS unit, avg(delta) AS v FROM e GROUP BY 1), q AS (SELECT count(*) AS k, round(avg(v), 6) AS v FROM u),
ei AS (WITH {_drawn("SELECT delta, problem_id AS unit FROM e", {"delta": "avg(delta)"})} SELECT * FROM ends), qi AS (WITH {_drawn("SELECT unit, v FROM u", {"parent": "avg(v)"})} SELECT * FROM ends)
SELECT n_tasks, (SELECT round(sum(delta * total_mutants) / sum(total_mutants), 6) FROM e) AS mutant_weighted_score_delta, mean_score_delta, delta_low AS score_delta_ci95_low, delta_high AS score_delta_ci95_high, {_TESTS}, q.k AS parent_clustered_n, q.v AS parent_clustered_mean_delta, parent_low AS parent_clustered_ci95_low, parent_high AS parent_clustered_ci95_high FROM t, q, ei, qi""",
    "efficiency_summary": f"""{_BASE}, y AS (SELECT method, {_SPENT("total_tokens")} AS tokens, {_SPENT("paid_tokens")} AS paid, {_SPENT("runtime_sec")} AS runtime, {_SPENT("estimated_cost_usd")} AS cost, {_SPENT("killed")} AS killed, {_SPENT("llm_calls")} AS calls FROM d, {_M3} WHERE method <> 'official'),
g AS (SELECT method, count(*) AS n, sum(tokens)::BIGINT AS tokens, sum(paid)::BIGINT AS paid, sum(runtime) AS runtime, sum(cost) AS cost, sum(killed)::BIGINT AS killed, sum(calls)::BIGINT AS calls FROM y GROUP BY method)
SELECT method, tokens AS total_tokens, paid AS total_paid_tokens, calls AS total_llm_calls, round(runtime, 4) AS total_runtime_sec, round(cost, 8) AS total_estimated_cost_usd, killed AS total_killed_mutants, {_Z("tokens", "killed", 4)} AS tokens_per_killed_mutant, {_Z("paid", "killed", 4)} AS paid_tokens_per_killed_mutant, {_Z("runtime", "killed", 6)} AS runtime_sec_per_killed_mutant, {_Z("cost", "killed", 8)} AS cost_usd_per_killed_mutant, {_Z("calls", "n", 4)} AS calls_per_task FROM g""",
    "baseline_fairness_per_task": f"{_BASE} SELECT problem_id, proposed_score, baseline_score, proposed_total_tokens, baseline_total_tokens, coalesce(fi, 0) AS baseline_first_final_score_iteration, ft AS baseline_tokens_at_first_final_score, coalesce(pi, 0) AS baseline_first_plateau_iteration, pt AS baseline_tokens_at_plateau, ms AS baseline_score_at_matched_proposed_tokens, mp AS baseline_score_at_matched_proposed_paid_tokens FROM d",
    "aggregate_score_conventions": f"{_BASE}, {_LONG} SELECT upper(method[1]) || method[2:] AS method, round(avg(score), 6) AS macro_raw, round(sum(killed) / sum(total_mutants)::DOUBLE, 6) AS micro_raw, round(avg(adj), 6) AS macro_equivalent_adjusted, {_Z('sum(adj * adjusted)', 'greatest(0, sum(total_mutants) - sum(equivalent_mutants))', 6)} AS micro_equivalent_adjusted FROM y GROUP BY method",
    "evoeval_subset_summary": f"""{_BASE}, {_LONG}, g AS (SELECT subset, method, count(*) AS n, sum(total_mutants)::BIGINT AS total, sum(killed)::BIGINT AS killed, avg(score) AS score, sum({_SPENT("total_tokens")})::BIGINT AS tokens, sum({_SPENT("paid_tokens")})::BIGINT AS paid, sum({_SPENT("estimated_cost_usd")}) AS cost, sum({_SPENT("runtime_sec")}) AS runtime FROM y GROUP BY subset, method)
SELECT subset AS dataset_subset, CASE method WHEN 'official' THEN 'official_reference' ELSE method END AS method, n AS n_tasks, total AS total_mutants, killed AS killed_mutants, round(score, 6) AS macro_mutation_score, {_Z("killed", "total", 6)} AS micro_mutation_score, tokens AS total_tokens, paid AS total_paid_tokens, round(cost, 8) AS total_cost_usd, round(runtime, 4) AS total_runtime_sec, {_Z("tokens", "killed", 4)} AS tokens_per_killed_mutant FROM g""",
    "evoeval_subset_paired_comparison": f"{_BASE}, e AS (SELECT subset AS key, delta FROM d), {_PAIRED} SELECT key AS dataset_subset, n_tasks, mean_score_delta, mean_score_delta AS ci95_low, mean_score_delta AS ci95_high, {_TESTS} FROM t",
    "layer_contribution_summary": f"""{_BASE}, l AS (SELECT problem_id, layer, sum(new_kills) AS new, max(cumulative_score) AS score FROM calls WHERE method = 'proposed' GROUP BY ALL), lm AS (SELECT layer, count(*) AS n_tasks, round(avg(new), 6) AS mean_new_kills, round(avg(score), 6) AS mean_cumulative_score FROM l GROUP BY layer),
g AS (SELECT layer, sum(new_kills)::BIGINT AS total_new_kills, sum(total_tokens)::BIGINT AS total_tokens, round(sum(latency_sec), 4) AS total_runtime_sec, round(sum(estimated_cost_usd), 8) AS total_cost_usd, count(*) AS total_llm_calls, count(*) FILTER (status = 'PRODUCTIVE') AS productive_calls, count(*) FILTER (status = 'REJECTED') AS invalid_calls, count(*) FILTER (status = 'VALID_ZERO_KILL') AS zero_kill_calls, sum(prompt_chars)::BIGINT AS total_prompt_chars, sum(target_count)::BIGINT AS total_targets FROM calls WHERE method = 'proposed' GROUP BY layer)
SELECT *, {_Z("total_tokens", "total_new_kills", 4)} AS tokens_per_new_kill, {_Z("total_runtime_sec", "total_new_kills", 4)} AS runtime_sec_per_new_kill, {_Z("total_prompt_chars", "total_llm_calls", 4)} AS mean_prompt_chars_per_call, {_Z("total_targets", "total_llm_calls", 4)} AS targets_per_call, {_Z("productive_calls", "total_llm_calls", 6)} AS productive_call_rate FROM lm JOIN g USING (layer)""",
    "runtime_breakdown_per_task": f"{_BASE} SELECT problem_id, {', '.join(f'round(price / {_SHARES[s]}0000, 4) AS {s}' if s in _SHARES else f'0::DOUBLE AS {s}' for s in report_tables._STAGES)} FROM tasks",
    "cluster_compression_per_task": f"{_BASE} SELECT problem_id, total_mutants, num_clusters, representatives, {_Z('total_mutants', 'representatives', 6)} AS compression_ratio_mutants_per_representative, {_Z('total_mutants', 'num_clusters', 6)} AS mean_cluster_size, layer1_iterations AS layer1_actual_calls, layer2_iterations AS layer2_actual_calls, layer3_iterations AS layer3_actual_calls FROM d",
    "operator_difficulty_summary": f"{_BASE} SELECT m.operator, count(*) AS total_mutants, count(*) FILTER (k.p) AS killed_mutants, count(*) FILTER (NOT k.p) AS surviving_mutants, round(count(*) FILTER (k.p) / count(*)::DOUBLE, 6) AS kill_rate FROM m JOIN k USING (problem_id, mutant) GROUP BY m.operator",
    "conservative_equivalent_mutants": f"{_BASE} SELECT problem_id, mutant, operator, CAST(k.p AS BIGINT) AS killed, CASE WHEN k.p THEN 'KILLED' ELSE 'SURVIVED' END AS status, equivalence_status FROM m JOIN k USING (problem_id, mutant) WHERE eq",
    "llm_usage_summary": f"""{_BASE}, g AS (SELECT method, coalesce(provider, 'unknown') AS provider, coalesce(model, 'unknown') AS model, count(*) AS calls, count(*) FILTER (new_kills > 0) AS productive_calls, sum(total_tokens)::BIGINT AS total_tokens, sum(prompt_tokens)::BIGINT AS total_prompt_tokens, sum(completion_tokens)::BIGINT AS total_completion_tokens, round(sum(estimated_cost_usd), 8) AS total_cost_usd, round(sum(latency_sec), 4) AS total_latency_sec, sum(new_kills)::BIGINT AS total_new_kills, sum(prompt_chars)::BIGINT AS total_prompt_chars FROM calls GROUP BY ALL)
SELECT *, round(productive_calls / calls::DOUBLE, 6) AS productive_call_rate, {_Z("total_tokens", "total_new_kills", 4)} AS tokens_per_new_kill FROM g""",
    "call_validation_outcomes": f"{_BASE} SELECT method, status AS outcome, count(*) AS calls FROM calls GROUP BY method, status",
    "llm_call_level_metrics": f"{_BASE} SELECT method, problem_id, layer, attempt, coalesce(provider, 'unknown') AS provider, coalesce(model, 'unknown') AS model, status, target_count, new_kills, cumulative_score, prompt_tokens, completion_tokens, total_tokens, prompt_chars, response_chars, latency_sec, estimated_cost_usd, validation_reason FROM calls",
    "baseline_iteration_history": f"{_BASE} SELECT * EXCLUDE (final) FROM hist",
}


#: Tables that read comparison rows several times, and tables that read no mutants.
_SEVERAL = ("effectiveness_summary", "paired_comparison_summary", "evoeval_subset_paired_comparison", "official_agreement_summary")
_NO_MUTANTS = ("runtime_breakdown_per_task",)
#: Tables whose intervals are drawn; the other one's ends are the estimate, in its oracle as well.
_DRAWN = ("effectiveness_summary", "official_agreement_summary", "paired_comparison_summary")


def _report(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        plain = lambda df, name: df
        found = facts(spark, sf_dir, plain if name in _NO_MUTANTS else kept)
        return report_tables.tables(found, REPLICAS if name in _DRAWN else 0, kept if name in _SEVERAL else plain, alone=True)[name]()

    return run


_BARS = " UNION ALL ".join(f"SELECT method, '{c}' AS convention, {c} AS score FROM sc" for c in report_tables._CONVENTIONS)
_FRAMES = {
    "aggregate_bars": _ORACLES["aggregate_score_conventions"].replace(" SELECT upper(method", ", sc AS (SELECT upper(method", 1) + f") {_BARS}",
    "stopping_totals": f"""{_BASE} SELECT 'baseline_fixed' AS view, sum(baseline_total_tokens)::BIGINT AS tokens FROM d UNION ALL SELECT 'baseline_first_final', sum(ft)::BIGINT FROM d
UNION ALL SELECT 'baseline_plateau', sum(CASE WHEN pt > 0 THEN pt ELSE baseline_total_tokens END)::BIGINT FROM d UNION ALL SELECT 'proposed', sum(proposed_total_tokens)::BIGINT FROM d""",
    "matched_means": f"{_BASE} {' UNION ALL '.join(f'SELECT {chr(39)}{v}{chr(39)} AS view, round(avg({c}), 6) AS score FROM d' for v, c in (('baseline_fixed', 'baseline_score'), ('baseline_matched_tokens', 'ms'), ('baseline_matched_paid_tokens', 'mp'), ('proposed', 'proposed_score')))}",
    "compression_histogram": f"""{_BASE}, v AS (SELECT {_Z("total_mutants", "representatives", 4)} AS x FROM d), e AS (SELECT min(x) AS lo, max(x) AS hi, least(12, greatest(3, floor(sqrt(count(*)))))::INTEGER AS bins FROM v), b AS (SELECT unnest(range(bins))::INTEGER AS bin, lo, hi, bins FROM e)
SELECT bin, round(lo + (hi - lo) * bin / bins, 6) AS low, round(lo + (hi - lo) * (bin + 1) / bins, 6) AS high, (SELECT count(*) FROM v WHERE least(bins - 1, floor((x - lo) / (hi - lo) * bins)) = bin) AS n FROM b""",
    "usage_bars": f"{_BASE} SELECT method || ' / ' || coalesce(provider, 'unknown') || ' / ' || coalesce(model, 'unknown') AS label, sum(total_tokens)::BIGINT AS tokens, round(count(*) FILTER (new_kills > 0) / count(*)::DOUBLE, 6) AS productive_call_rate FROM calls GROUP BY label",
    "outcome_pivot": f"{_BASE} SELECT method, {', '.join(f'count(*) FILTER (status = {chr(39)}{s}{chr(39)}) AS {s.lower()}' for s in ('PRODUCTIVE', 'VALID_ZERO_KILL', 'REJECTED', 'ERROR'))}, 0::BIGINT AS others FROM calls GROUP BY method",
}


def _frame(name: str):
    return lambda spark, sf_dir: report_tables.frames(facts(spark, sf_dir))[name]()


for _name, _sql in _FRAMES.items():
    dataframe_query(f"frame_{_name}", _frame(_name), _text(_sql, False))
dataframe_query("comparison_full", lambda spark, sf_dir: compare(facts(spark, sf_dir)), _text(f"{_BASE} {_COMPARISON}", False))
for _name, _sql in _ORACLES.items():
    dataframe_query(f"report_{_name}", _report(_name), _text(_sql, False))
