"""Queries on clusters of mutants. Vectors are mutants: twenty in a row are a task, the label modulo 3 the cluster; the
first dimension says whether a mutant is alive, the next eight are its signature."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import comparison, stacks
from . import facts
from .registry import dataframe_query

_CODE = "CASE WHEN v > 0.1 THEN 2 WHEN v < -0.1 THEN 1 ELSE 0 END"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mutants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").selectExpr(
        "vec_id div 20 AS task", "cast(label % 3 AS int) AS cluster", "vec_id AS id", "cast(embedding AS array<double>) AS features", f"transform(slice(cast(embedding AS array<double>), 2, 8), v -> {_CODE}) AS signature",
        "concat('OP', cast(label AS string)) AS operator", "embedding[0] > 0 AS active", "concat('change ', cast(vec_id AS string)) AS change", "CASE WHEN vec_id % 9 = 0 THEN 'STATIC_EQUIVALENT' END AS equivalence_status",
    )


def _stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stacks.representatives(stacks.centralities(_mutants(spark, sf_dir)))


def representative_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stacks(spark, sf_dir).select("task", "cluster", "id", F.round("centrality", 4).alias("centrality"), F.round("information", 4).alias("information"), "place", "representative")


def live_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stacks.targets(_stacks(spark, sf_dir))


def cluster_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stacks.contexts(_stacks(spark, sf_dir))


def handoff_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The handoff of each task with survivors; its even clusters' targets are shown already, events are its attempts."""
    own = _stacks(spark, sf_dir)
    chosen = stacks.targets(own).where("cluster % 2 = 0")
    calls = _table(spark, sf_dir, "events").where("event_id < 100000").selectExpr("event_id div 7 AS task", "event_id % 7 + 1 AS attempt", "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'PRODUCTIVE' WHEN 'click' THEN 'VALID_ZERO_KILL' ELSE 'REJECTED' END AS status", "user_id % 3 AS new_kills", "CASE WHEN user_id % 4 > 0 THEN array_repeat(concat('f(', cast(user_id AS string), ')'), cast(user_id % 4 + 1 AS int)) END AS calls", "concat('quota of ', cast(user_id AS string)) AS error")
    tried = calls.groupBy("task").agg(F.array_sort(F.collect_list(F.struct("attempt", "status", "new_kills", "calls", "error"))).alias("attempts"))
    rows = stacks.handoff(own, chosen).join(tried, "task", "left").withColumns({"attempts": F.coalesce("attempts", F.array().cast(tried.schema["attempts"].dataType)), "stop_reason": F.when(F.col("task") % 2 == 0, "plateau"), "previous_layer": F.when(F.col("task") % 3 == 0, "Layer1"), "previous_attempts": F.col("task") % 5, "previous_survivors": F.when(F.col("task") % 6 == 0, F.col("surviving"))})
    return stacks.handoff_text(rows).select("task", "surviving", F.array_join(F.transform("clusters", lambda c: c.cast("string")), ",").alias("clusters"), "text")


def one_hot_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand as a task's mutants, their types as the vocabulary."""
    parts = _table(spark, sf_dir, "part")
    words = parts.groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("vocabulary"))
    rows = parts.join(words, "p_brand").select("p_partkey", stacks.one_hot(F.col("p_type"), F.col("vocabulary")).alias("flags"))
    return rows.select("p_partkey", F.array_join(F.transform("flags", lambda x: x.cast("int").cast("string")), "").alias("flags"))


_HINTS = (("ring", "List[str]"), ("widget", "Dict[str, int]"), ("bolt", "float"), ("gear", "int"), ("gizmo", "Tuple[int, ...]"), ("plate", "Sequence [float]"), ("anvil", "bool"), ("rod", "list"), ("cold", "str"), ("hot", "Iterable"))


def _hint(quote: str = "'") -> str:
    text = "p_name"
    for word, hint in _HINTS:
        text = f"replace({text}, '{word}', '{hint}')"
    return text


def type_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names as type hints, nouns taken for types."""
    rows = _table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_hint()} AS hint")
    return rows.select("p_partkey", F.array_join(stacks.values_for_type(F.col("hint")), " | ").alias("val"))


def layer_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("task")).agg(F.count_if(F.col("l_returnflag") != "R").alias("after1"), F.count_if(F.col("l_returnflag") == "N").alias("after2"))
    return stacks.layer_rules(lines.withColumn("max_layers", F.col("task") % 3 + 1))


def layer_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of the facts' tasks."""
    f = facts.facts(spark, sf_dir)
    calls = comparison.scored_calls(f).where("method = 'proposed'")
    totals = f.mutants.groupBy("problem_id").agg(F.count(F.lit(1)).alias("total_mutants"))
    layers = calls.groupBy("problem_id", "layer").agg(F.max("cumulative_kills").alias("killed_mutants"), F.sum("new_kills").alias("new_kills"), F.round(F.sum("estimated_cost_usd"), 8).alias("estimated_cost_usd"), F.round(F.sum("latency_sec"), 6).alias("total_time_sec"), F.sum("total_tokens").alias("total_tokens"))
    rows = layers.join(totals, "problem_id", "left").na.fill(0, ["total_mutants"])
    return stacks.layer_metrics(rows)


def compact_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stacks.compact_summaries(stacks.centralities(_mutants(spark, sf_dir)))


def attempt_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as attempts; every seventh purchase's provider failed although a reply came."""
    rows = _table(spark, sf_dir, "events").selectExpr("user_id AS task", "event_id AS attempt", "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'PRODUCTIVE' WHEN 'click' THEN 'REJECTED' END AS status", "CASE WHEN event_type = 'purchase' AND event_id % 7 = 0 THEN 'LLM_API_ERROR' END AS failure_category", "CASE WHEN event_id % 3 > 0 THEN repeat(props, 40) END AS error")
    return stacks.attempt_histories(rows, "task")


# --- oracles -------------------------------------------------------------------------------------------
_STACKS = """WITH m AS (SELECT vec_id // 20 AS task, CAST(label % 3 AS INTEGER) AS cluster, vec_id AS id, embedding::DOUBLE[] AS x, [CASE WHEN v > 0.1 THEN 2 WHEN v < -0.1 THEN 1 ELSE 0 END FOR v IN (embedding::DOUBLE[])[2:9]] AS sig, 'OP' || label AS operator, embedding[1] > 0 AS active, 'change ' || vec_id AS change, CASE WHEN vec_id % 9 = 0 THEN 'STATIC_EQUIVALENT' ELSE 'UNKNOWN' END AS eq FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT task, cluster, id, unnest(x) AS v, unnest(range(len(x))) AS dim FROM m), sd AS (SELECT task, cluster, dim, CASE WHEN stddev_pop(v) > 0 THEN stddev_pop(v) ELSE 1 END AS s FROM u GROUP BY ALL),
d2 AS (SELECT a.task, a.cluster, a.id AS a, b.id AS b, sqrt(sum(pow((a.v - b.v) / s, 2))) AS dist FROM u a JOIN u b ON a.task = b.task AND a.cluster = b.cluster AND a.dim = b.dim JOIN sd ON sd.task = a.task AND sd.cluster = a.cluster AND sd.dim = a.dim GROUP BY ALL),
mean AS (SELECT task, cluster, a AS id, avg(dist) AS mean, count(*) AS n FROM d2 GROUP BY ALL), cen AS (SELECT task, cluster, id, CASE WHEN n = 1 THEN 1.0 ELSE round(1 - mean / greatest(max(mean) OVER (PARTITION BY task, cluster), 1e-9), 6) + 0.0 END AS centrality, n FROM mean),
inf AS (SELECT m.*, cen.centrality, cen.n, len(list_filter(sig, lambda v: v <> 0)) AS differing, round(0.7::DOUBLE * (-(coalesce(list_sum([CASE WHEN q > 0 THEN q * log2(q) ELSE 0 END FOR q IN [len(list_filter(sig, lambda v: v = 0)) / len(sig)::DOUBLE, len(list_filter(sig, lambda v: v = 1)) / len(sig)::DOUBLE, len(list_filter(sig, lambda v: v = 2)) / len(sig)::DOUBLE]]), 0)) / log2(3)) + 0.3::DOUBLE * len(list_filter(sig, lambda v: v <> 0)) / len(sig), 6) AS information FROM m JOIN cen USING (task, cluster, id)),
sh AS (SELECT *, row_number() OVER (PARTITION BY task, cluster ORDER BY centrality DESC, id) <= greatest(1, ceil(n * 0.4::DOUBLE)) AS short FROM inf),
st AS (SELECT *, CASE WHEN short THEN row_number() OVER (PARTITION BY task, cluster, short ORDER BY information DESC, centrality DESC, differing DESC, id) END AS place FROM sh),
tg AS (SELECT * FROM (SELECT task, cluster, id, place, row_number() OVER (PARTITION BY task, cluster ORDER BY CASE WHEN place = 1 THEN 0 ELSE 1 END, information DESC, centrality DESC, differing DESC, id) AS k FROM st WHERE active) t WHERE k = 1)"""
dataframe_query("representative_stacks", representative_stacks, f"{_STACKS} SELECT task, cluster, id, round(centrality, 4) AS centrality, round(information, 4) AS information, CAST(place AS INTEGER) AS place, coalesce(place = 1, false) AS representative FROM st")
dataframe_query("live_targets", live_targets, f"{_STACKS} SELECT task, cluster, id, CASE WHEN place = 1 THEN 'representative' ELSE 'fallback' END AS why FROM tg")
dataframe_query("compact_summaries", compact_summaries, f"{_STACKS} SELECT task, id, cluster, operator, change, array_to_string(sig, '') AS signature, round(centrality, 4) AS centrality, round(information, 4) AS information, CASE WHEN active THEN 'SURVIVED' ELSE 'KILLED' END AS status, eq AS equivalence_status FROM st")
dataframe_query("attempt_histories", attempt_histories, """WITH a AS (SELECT user_id AS task, event_id, event_type, event_type = 'error' OR event_type = 'purchase' AND event_id % 7 = 0 AS failed, CASE WHEN event_id % 3 > 0 THEN repeat(props, 40) ELSE 'unknown error' END AS said FROM events)
SELECT task, count(*) FILTER (NOT failed) AS attempt_count, count(*) FILTER (NOT failed AND event_type = 'purchase') AS productive_attempts, count(*) FILTER (failed) AS infrastructure_errors, (list(said[1:300] ORDER BY event_id) FILTER (failed))[1] AS first_error FROM a GROUP BY task""")
dataframe_query("cluster_contexts", cluster_contexts, f"""{_STACKS}, oc AS (SELECT task, cluster, string_agg(operator || ':' || n, ',' ORDER BY operator) AS operators FROM (SELECT task, cluster, operator, count(*) AS n FROM st WHERE active GROUP BY ALL) o GROUP BY ALL)
SELECT st.task, st.cluster, count(*) AS size, count(*) FILTER (active) AS surviving, coalesce(string_agg(CAST(id AS VARCHAR), ',') FILTER (place = 1), '') AS representative_ids, coalesce(any_value(oc.operators), '') AS operators, count(DISTINCT sig) FILTER (active) AS distinct_signatures FROM st LEFT JOIN oc ON oc.task = st.task AND oc.cluster = st.cluster GROUP BY st.task, st.cluster""")
dataframe_query("handoff_texts", handoff_texts, f"""{_STACKS}, lv AS (SELECT st.*, row_number() OVER (PARTITION BY st.task, st.cluster ORDER BY centrality DESC, st.id) AS k FROM st WHERE active),
sample AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY centrality DESC, id) AS r FROM lv WHERE k = 1 AND cluster % 2 <> 0),
live AS (SELECT task, count(*) AS surviving, string_agg(DISTINCT CAST(cluster AS VARCHAR), ',' ORDER BY CAST(cluster AS VARCHAR)) AS clusters FROM lv GROUP BY task),
ops AS (SELECT task, string_agg(operator || ':' || n, ', ' ORDER BY operator) AS operators FROM (SELECT task, operator, count(*) AS n FROM lv GROUP BY ALL) o GROUP BY task),
ev AS (SELECT event_id // 7 AS task, event_id % 7 + 1 AS attempt, event_type, user_id, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'PRODUCTIVE' WHEN 'click' THEN 'VALID_ZERO_KILL' ELSE 'REJECTED' END AS status FROM events WHERE event_id < 100000),
te AS (SELECT *, row_number() OVER (PARTITION BY task, status = 'ERROR' ORDER BY attempt DESC) AS back, row_number() OVER (PARTITION BY task, status = 'ERROR' ORDER BY attempt) AS forth, count(*) OVER (PARTITION BY task, status = 'ERROR') AS same FROM ev),
sums AS (SELECT task, count(*) AS n, count(*) FILTER (status = 'PRODUCTIVE') AS good FROM ev GROUP BY task),
lines AS (
  SELECT l.task, 0 AS part, 0 AS place, coalesce(s.n, 0) || ' attempt(s) so far, ' || coalesce(s.good, 0) || ' productive, stopped: ' || CASE WHEN l.task % 2 = 0 THEN 'plateau' ELSE 'n/a' END || '.' AS line FROM live l LEFT JOIN sums s USING (task)
  UNION ALL SELECT task, 1, 0, same || ' attempt(s) failed from an infrastructure error, not a rejected strategy -- no test was actually evaluated in those: quota of ' || user_id FROM te WHERE status = 'ERROR' AND forth = 1
  UNION ALL SELECT task, 2, attempt, '- attempt ' || attempt || ' [' || status || ', +' || user_id % 3 || ' new kills]: ' || CASE user_id % 4 WHEN 0 THEN '(no candidate calls recorded)' WHEN 1 THEN 'f(' || user_id || '); f(' || user_id || ')' ELSE 'f(' || user_id || '); f(' || user_id || '); f(' || user_id || ')' END FROM te WHERE status <> 'ERROR' AND back <= 3
  UNION ALL SELECT task, 3, 0, surviving || ' mutant(s) still surviving overall (' || operators || ').' FROM live JOIN ops USING (task)
  UNION ALL SELECT DISTINCT task, 4, 0, 'Other still-live clusters not in this round''s targets:' FROM sample
  UNION ALL SELECT task, 5, r, '  - ' || id || ' [' || operator || '] ' || change || ' (equiv=' || eq || ')' FROM sample WHERE r <= 6
  UNION ALL SELECT task, 6, 0, 'Before this: Layer1 ran ' || task % 5 || ' attempt(s), ' || CASE WHEN task % 6 = 0 THEN CAST(surviving AS VARCHAR) ELSE '?' END || ' survivor(s) handed forward.' FROM live WHERE task % 3 = 0)
SELECT l.task, l.surviving, l.clusters, string_agg(x.line, chr(10) ORDER BY x.part, x.place) AS text FROM live l JOIN lines x USING (task) GROUP BY l.task, l.surviving, l.clusters""")
dataframe_query("one_hot_types", one_hot_types, "SELECT p_partkey, (SELECT string_agg(CASE WHEN t = p.p_type THEN '1' ELSE '0' END, '' ORDER BY t) FROM (SELECT DISTINCT p_type AS t FROM part q WHERE q.p_brand = p.p_brand) v) AS flags FROM part p")
_ESC = lambda values: "'" + " | ".join(values) + "'"
dataframe_query("type_values", type_values, f"""WITH h AS (SELECT p_partkey, lower(replace({_hint()}, ' ', '')) AS t FROM part)
SELECT p_partkey, CASE WHEN t LIKE '%list%' OR t LIKE 'sequence%' OR t LIKE 'iterable%' THEN CASE WHEN t LIKE '%str%' THEN {_ESC(stacks.VALUES[0][1][0][1])} WHEN t LIKE '%float%' THEN {_ESC(stacks.VALUES[0][1][1][1])} ELSE {_ESC(stacks.VALUES[0][1][2][1])} END
 WHEN t LIKE '%tuple%' THEN {_ESC(stacks.VALUES[1][1][0][1])} WHEN t LIKE '%dict%' THEN {_ESC(stacks.VALUES[2][1][0][1])} WHEN t LIKE '%str%' THEN {_ESC(stacks.VALUES[3][1][0][1])} WHEN t LIKE '%bool%' THEN {_ESC(stacks.VALUES[4][1][0][1])} WHEN t LIKE '%float%' THEN {_ESC(stacks.VALUES[5][1][0][1])} WHEN t LIKE '%int%' THEN {_ESC(stacks.VALUES[6][1][0][1])} ELSE {_ESC(stacks.OTHER_VALUES)} END AS val FROM h""")
dataframe_query("layer_skips", layer_skips, """WITH k AS (SELECT l_orderkey AS task, count(*) FILTER (l_returnflag <> 'R') AS after1, count(*) FILTER (l_returnflag = 'N') AS after2, l_orderkey % 3 + 1 AS max_layers FROM lineitem GROUP BY l_orderkey)
SELECT *, CASE WHEN after1 = 0 THEN 'all_mutants_killed_by_layer1' WHEN max_layers = 1 THEN 'max_layers_below_2' ELSE 'run' END AS layer2,
 CASE WHEN after1 = 0 THEN 'all_mutants_killed_by_layer1' WHEN max_layers > 1 AND after2 = 0 THEN 'all_mutants_killed_before_layer3' WHEN max_layers < 3 THEN 'max_layers_below_3' ELSE 'run' END AS layer3 FROM k""")
dataframe_query("layer_ratios", layer_ratios, facts._text(f"""{facts._BASE}, g AS (SELECT problem_id, layer, max(cumulative_kills) AS killed_mutants, sum(new_kills)::BIGINT AS new_kills, round(sum(estimated_cost_usd), 8) AS estimated_cost_usd, round(sum(latency_sec), 6) AS total_time_sec, sum(total_tokens)::BIGINT AS total_tokens, max(total) AS total_mutants FROM calls WHERE method = 'proposed' GROUP BY problem_id, layer)
SELECT *, {facts._Z("killed_mutants", "total_mutants", 6)} AS mutation_score, greatest(0, total_mutants - killed_mutants) AS surviving_mutants, {facts._Z("estimated_cost_usd", "killed_mutants", 8)} AS cost_per_killed_mutant, {facts._Z("estimated_cost_usd", "new_kills", 8)} AS cost_per_new_kill, {facts._Z("total_time_sec", "killed_mutants", 4)} AS time_per_killed_mutant, {facts._Z("total_time_sec", "new_kills", 4)} AS time_per_new_kill, {facts._Z("total_tokens", "new_kills", 4)} AS tokens_per_new_kill FROM g""", False))
