"""Queries that go through a store: task folders, documents as VARIANT, the call log, merged shards, published tables.

What a query writes lies in the shared folder and goes when the driver ends. The oracles compute the same from the
tables, without the store.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import comparison, report_tables, shards
from ..sources import call_log, documents, loading, publish, shared, task_folder
from . import facts
from .registry import dataframe_query


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- orders as task shards, one folder a market segment ------------------------------------------------
def folder_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of two subsets, read from a sharded copy through the data source and loaded with checks."""
    orders, customers = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    rows = orders.join(customers, orders.o_custkey == customers.c_custkey).selectExpr("concat('EvoEval/', o_orderkey) AS task_id", "concat('def f', o_custkey, '(x):') AS prompt", "o_totalprice AS price", "c_mktsegment AS subset")
    folder = shared.scratch(spark, "tasks")
    rows.write.partitionBy("subset").json(folder)
    read = task_folder.tasks(spark, folder, columns="task_id string, prompt string, price double")
    picked = read.where(F.col("subset").isin("BUILDING", "MACHINERY")).selectExpr("task_id", "prompt", "subset AS evoeval_subset", "shard")
    tasks = loading.load(picked, shared.scratch(spark, "loaded"))
    return tasks.select("task_id", "source_task_id", "parent_task_id", "dataset_name", "dataset_subset", "entry_point")


dataframe_query("folder_tasks", folder_tasks, """SELECT concat('EvoEval_', lower(c_mktsegment), '/', o_orderkey) AS task_id, concat('EvoEval/', o_orderkey) AS source_task_id, concat('HumanEval/', o_orderkey) AS parent_task_id,
 'evoeval' AS dataset_name, lower(c_mktsegment) AS dataset_subset, concat('f', o_custkey) AS entry_point FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""")


# --- documents of several shapes ---------------------------------------------------------------------------
_SHAPES = "CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN concat('{\"k\": \"', user_id, '\", \"more\": ', props, '}') WHEN 2 THEN NULL WHEN 3 THEN substr(props, 1, length(props) - 1) WHEN 4 THEN concat('[', props, ', ', user_id, ']') ELSE concat('{\"k\": ', cast(round(value * 100) AS bigint), '.5, \"more\": {\"k\": \"x\"}}') END"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").selectExpr("event_id", "event_type", f"{_SHAPES} AS body")
    return documents.parsed(rows, "body")


def document_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents.fields(_documents(spark, sf_dir), "doc", {"k": "string"})
    rows = rows.withColumns({"number": F.try_variant_get("doc", "$.k", "double"), "inner": F.try_variant_get("doc", "$.more.k", "string"), "first": F.try_variant_get("doc", "$[0].k", "string")})
    return rows.select("event_id", F.col("doc").isNotNull().alias("valid"), "k", F.round("number", 2).alias("number"), "inner", "first")


_OBJECT = "CASE WHEN json_type(ok) = 'OBJECT' THEN {} END".format
_ARRAY = "CASE WHEN json_type(ok) = 'ARRAY' THEN {} END".format
dataframe_query("document_fields", document_fields, f"""WITH d AS (SELECT event_id, {_SHAPES} AS body FROM events), v AS (SELECT event_id, CASE WHEN json_valid(body) THEN body END AS ok FROM d)
SELECT event_id, ok IS NOT NULL AS valid, {_OBJECT("json_extract_string(ok, '$.k')")} AS k, round({_OBJECT("try_cast(json_extract_string(ok, '$.k') AS DOUBLE)")}, 2) AS number,
 {_OBJECT("json_extract_string(ok, '$.more.k')")} AS inner, {_ARRAY("json_extract_string(ok, '$[0].k')")} AS first FROM v""")


def document_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents of each type parse, and the schema that all which do fit."""
    rows = _documents(spark, sf_dir).where("event_id % 6 IN (0, 2, 3)")
    counts = rows.groupBy("event_type").agg(F.count("body").alias("bodies"), F.count("doc").alias("parsed"))
    return counts.join(documents.merged_schema(rows, "doc", "event_type"), "event_type", "left")


dataframe_query("document_counts", document_counts, f"""WITH d AS (SELECT event_type, {_SHAPES} AS body FROM events WHERE event_id % 6 IN (0, 2, 3))
SELECT event_type, count(body) AS bodies, count(*) FILTER (json_valid(body)) AS parsed, CASE WHEN count(*) FILTER (json_valid(body)) > 0 THEN 'OBJECT<k: BIGINT>' END AS schema FROM d GROUP BY event_type""")


# --- a task's nested documents, written and read again -----------------------------------------------------------
def tracker_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers and timings of the proposed method as the documents have them, which were made from the facts."""
    f = facts.facts(spark, sf_dir)
    calls = comparison.scored_calls(f).where("method = 'proposed'")
    totals = f.mutants.groupBy("problem_id").agg(F.count(F.lit(1)).alias("total_mutants"))
    folder = shared.scratch(spark, "documents")
    documents.write_documents(documents.tracker_documents(f.tasks, calls, f.timings, f.clusters, totals), folder)
    docs = documents.read_documents(spark, folder)
    spent = documents.timings(docs).groupBy("problem_id").agg(F.count(F.lit(1)).alias("stages"))
    tried = documents.items(docs, "$.llm_calls", documents.CALL, "problem_id").groupBy("problem_id", "layer").agg(F.max("attempt").alias("last_attempt"))
    return documents.layers(docs).drop("total_time_sec", "estimated_cost_usd").join(spent, "problem_id").join(tried, ["problem_id", "layer"])


dataframe_query("tracker_layers", tracker_layers, facts._text(f"""{facts._BASE} SELECT problem_id, CAST(row_number() OVER (PARTITION BY problem_id ORDER BY min(attempt)) - 1 AS INTEGER) AS place, layer, max(total) AS total_mutants, max(cumulative_kills) AS killed_mutants, sum(new_kills)::BIGINT AS new_kills, count(*) AS llm_calls, sum(total_tokens)::BIGINT AS total_tokens, max(cumulative_score) AS mutation_score, 4::BIGINT AS stages, max(attempt) AS last_attempt FROM calls WHERE method = 'proposed' GROUP BY problem_id, layer""", False))


# --- the log, with a batch that comes twice ----------------------------------------------------------------
def replayed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls appended in three batches, the second of them again: totals by batch and provider."""
    events = _table(spark, sf_dir, "events")
    known = {"problem_id": "concat('T/', event_id div 8)", "attempt": "event_id % 8 + 1", "model": "CASE event_type WHEN 'view' THEN 'gpt-5' WHEN 'click' THEN 'Gemini-2' WHEN 'purchase' THEN 'org/model' END", "status": "event_type", "total_tokens": "cast(round(value * 100) AS bigint)", "prompt": "props"}
    calls = events.selectExpr("event_id", *(f"cast({known.get(n, 'NULL')} AS {t}) AS {n}" for n, t in (c.split(" ") for c in call_log.CALL.split(", "))))
    folder = shared.scratch(spark, "log")
    for batch in (0, 1, 2, 1):
        call_log.append(calls.where(F.col("event_id") % 3 == batch).drop("event_id"), batch, folder)
    texts = call_log.artefacts(spark, folder).groupBy("batch").agg(F.sum(F.length("body")).alias("chars"), F.count_if(F.col("body").startswith("problem_id: T/")).alias("texts"))
    rows = call_log.read(spark, folder).groupBy("batch", "provider").agg(F.count(F.lit(1)).alias("calls"), F.sum("total_tokens").alias("tokens"))
    return rows.join(texts.select("batch", "texts"), "batch")


dataframe_query("replayed_log", replayed_log, """WITH c AS (SELECT event_id % 3 AS batch, CASE event_type WHEN 'view' THEN 'openai' WHEN 'click' THEN 'gemini' ELSE 'hf' END AS provider, CAST(round(value * 100) AS BIGINT) AS tokens FROM events)
SELECT batch, provider, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, (SELECT count(*) FROM c x WHERE x.batch = c.batch) AS texts FROM c GROUP BY batch, provider""")


# --- seven shards of orders, one of them run twice ------------------------------------------------------------
def merged_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of seven shards, the third also from an attempt that was given up, merged in whatever order."""
    orders = _table(spark, sf_dir, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    what = {"sums": {"subset_counts": ("o_orderpriority", "*"), "cents": ("o_orderstatus", "cents")}, "sets": {"dates": "o_orderdate"}, "settings": {"latest": ("o_orderstatus", "o_orderpriority", "o_orderdate")}, "sketches": {"price": "o_totalprice"}}
    runs = F.array(F.struct((F.col("o_orderkey") % 7).alias("shard"), F.lit(2).alias("attempt")), F.when(F.expr("o_orderkey % 7 = 2 AND o_orderkey % 3 = 0"), F.struct(F.lit(2).cast("long").alias("shard"), F.lit(1).alias("attempt"))))
    rows = orders.withColumn("run", F.explode(F.filter(runs, lambda x: x.isNotNull())))
    states = shards.states(rows, F.concat(F.lit("shard-"), F.col("run.shard").cast("string")), F.col("run.attempt"), **what)
    merged = shards.merge(facts.kept(states, "states"))
    return merged.where("kind <> 'set'").select("kind", "name", "key", "amount", "value").unionByName(merged.where("kind = 'set'").groupBy("kind", "name").agg(F.lit("members").alias("key"), F.count(F.lit(1)).alias("amount"), F.max("key").alias("value")).select("kind", "name", "key", "amount", "value"))


dataframe_query("merged_shards", merged_shards, f"""SELECT 'sum' AS kind, 'subset_counts' AS name, o_orderpriority AS key, count(*) AS amount, NULL AS value FROM orders GROUP BY o_orderpriority
UNION ALL SELECT 'sum', 'cents', o_orderstatus, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT), NULL FROM orders GROUP BY o_orderstatus
UNION ALL SELECT 'set', 'dates', 'members', count(DISTINCT o_orderdate), strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') FROM orders
UNION ALL SELECT 'setting', 'latest', o_orderstatus, NULL, max_by(o_orderpriority, (o_orderdate, o_orderpriority)) FROM orders GROUP BY o_orderstatus
UNION ALL SELECT 'sketch', 'price', CASE WHEN o_totalprice > 0 THEN 'b' || CAST(ceil(ln(o_totalprice) / ln({shards.GROWTH}::DOUBLE)) AS BIGINT) ELSE 'zero' END AS k, count(*), NULL FROM orders GROUP BY k""")


# --- the report set -----------------------------------------------------------------------------------------------
def publish_reports(spark: SparkSession, sf_dir: str, folder: str, replicas: int) -> str:
    """The 17 report tables over the driver's tables, published as one set; what several share is written once."""
    tables = report_tables.tables(facts.facts(spark, sf_dir), replicas, facts.kept)
    return publish.publish(spark, tables, folder, {"replicas": replicas})


def published_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published set as readers see it: each table's rows by the manifest, and as read back."""
    folder = shared.scratch(spark, "reports")
    publish_reports(spark, sf_dir, folder, replicas=0)
    manifest = publish.current(spark, folder)
    read = [publish.read(spark, folder, t, manifest).agg(F.count(F.lit(1)).alias("read_back")).select(F.lit(t).alias("name"), F.lit(x["rows"]).cast("long").alias("counted"), "read_back", F.lit(len(x["schema"]["fields"])).alias("columns")) for t, x in manifest["tables"].items()]
    return reduce(DataFrame.unionByName, read)


def _counts() -> str:
    """Rows and columns of each report by its own oracle."""
    parts = [f"SELECT '{n}' AS name, count(*) AS counted, count(*) AS read_back FROM ({facts._text(sql, False)}) t" for n, sql in facts._ORACLES.items()]
    return " UNION ALL ".join(parts)


_COLUMNS = {"effectiveness_summary": 14, "official_agreement_summary": 4, "paired_comparison_summary": 17, "efficiency_summary": 12, "baseline_fairness_per_task": 11, "aggregate_score_conventions": 5, "evoeval_subset_summary": 12, "evoeval_subset_paired_comparison": 13, "layer_contribution_summary": 19, "runtime_breakdown_per_task": 7, "cluster_compression_per_task": 9, "operator_difficulty_summary": 5, "conservative_equivalent_mutants": 6, "llm_usage_summary": 14, "call_validation_outcomes": 3, "llm_call_level_metrics": 18, "baseline_iteration_history": 9}
dataframe_query("published_reports", published_reports, f"SELECT r.*, c.columns FROM ({_counts()}) r JOIN (VALUES {', '.join(f'({chr(39)}{n}{chr(39)}, {c})' for n, c in _COLUMNS.items())}) c(name, columns) ON c.name = r.name")
