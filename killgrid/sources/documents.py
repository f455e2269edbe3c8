"""Metric documents as VARIANT: JSON of any shape in one column, its merged schema by aggregation, fields by try-casts.

A document that doesn't parse is null and counted as such; a field that is missing or of another type is null, so
documents of different shape and age stand side by side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAYER = {"layer": "string", "total_mutants": "bigint", "killed_mutants": "bigint", "new_kills": "bigint", "llm_calls": "bigint", "total_tokens": "bigint", "total_time_sec": "double", "estimated_cost_usd": "double", "mutation_score": "double"}
CALL = {"layer": "string", "attempt": "bigint", "provider": "string", "model": "string", "status": "string", "target_count": "bigint", "new_kills": "bigint", "cumulative_score": "double", "prompt_tokens": "bigint", "completion_tokens": "bigint", "total_tokens": "bigint", "prompt_chars": "bigint", "response_chars": "bigint", "latency_sec": "double", "estimated_cost_usd": "double", "validation_reason": "string"}
ITERATION = {"iteration": "bigint", "cumulative_tokens": "bigint", "cumulative_paid_tokens": "bigint", "cumulative_score": "double", "status": "string"}
CLUSTER = {"cluster_id": "bigint", "size": "bigint"}


def parsed(rows: DataFrame, column: str, into: str = "doc") -> DataFrame:
    """rows with the JSON text of a column as VARIANT; null where it isn't JSON."""
    return rows.withColumn(into, F.try_parse_json(column))


def fields(rows: DataFrame, doc: str, wanted: dict[str, str], path: str = "$") -> DataFrame:
    """rows with a column for each wanted field (name: type) at path.name of a VARIANT column."""
    return rows.withColumns({n: F.try_variant_get(doc, f"{path}.{n}", kind) for n, kind in wanted.items()})


def merged_schema(rows: DataFrame, doc: str, *keys: str) -> DataFrame:
    """The one schema that all documents of a group fit, as text; groups add up in any order."""
    return rows.where(F.col(doc).isNotNull()).groupBy(*keys).agg(F.schema_of_variant_agg(doc).alias("schema"))


def metric_documents(spark: SparkSession, folder: str, deep: bool = False) -> DataFrame:
    """path, problem_id, doc of the *_metrics.json in a folder; doc is null where a file isn't JSON."""
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter="*_metrics.json", recursiveFileLookup=deep)
    rows = parsed(rows.select(F.col("_metadata.file_path").alias("path"), "value"), "value").drop("value")
    return rows.select("path", F.try_variant_get("doc", "$.problem_id", "string").alias("problem_id"), "doc")


def items(docs: DataFrame, path: str, wanted: dict[str, str], *keys: str) -> DataFrame:
    """One row an element of the array at path, in order: keys, place, the wanted fields. Documents without the array,
    or with something else there, have none."""
    array = F.try_variant_get("doc", path, "array<variant>")
    rows = docs.select(*keys, F.posexplode(array).alias("place", "item"))
    return fields(rows, "item", wanted).drop("item")


def layers(docs: DataFrame) -> DataFrame:
    return items(docs, "$.layers", LAYER, "problem_id")


def calls(proposed: DataFrame, baseline: DataFrame) -> DataFrame:
    parts = [items(d, "$.llm_calls", CALL, "problem_id").withColumn("method", F.lit(m)) for m, d in (("proposed", proposed), ("baseline", baseline))]
    return parts[0].unionByName(parts[1])


def history(docs: DataFrame) -> DataFrame:
    return items(docs, "$.metadata.iteration_history", ITERATION, "problem_id")


def timings(docs: DataFrame) -> DataFrame:
    """problem_id, stage, seconds of every number in `timing`, whatever its stages are called."""
    timing = F.try_variant_get("doc", "$.timing", "map<string, variant>")
    return docs.select("problem_id", F.explode(timing).alias("stage", "value")).select("problem_id", "stage", F.try_variant_get("value", "$", "double").alias("seconds"))


def clusters(docs: DataFrame) -> DataFrame:
    """A task's mutants, clusters, representatives and how many mutants one stands for; 0 where nothing can be
    divided by."""
    own = F.coalesce(F.try_variant_get("doc", "$.metadata.layer1_clusters", "array<variant>"), F.array().cast("array<variant>"))
    sizes = F.transform(own, lambda c: F.coalesce(F.size(F.try_variant_get(c, "$.representative_ids", "array<variant>")), F.lit(0)))
    number = lambda n: F.coalesce(F.try_variant_get("doc", f"$.metadata.{n}", "bigint"), F.lit(0))
    rows = docs.where("doc IS NOT NULL").select("problem_id", number("mutant_count").alias("total_mutants"), F.size(own).cast("long").alias("num_clusters"), F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x).alias("representatives"), number("layer1_iterations").alias("layer1_actual_calls"))
    share = lambda a, b: F.when(F.col(b) != 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return rows.withColumns({"compression_ratio_mutants_per_representative": share("total_mutants", "representatives"), "mean_cluster_size": share("total_mutants", "num_clusters")})


def summaries(docs: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """path and the wanted fields of each document's `summary`; documents without one are left out."""
    return fields(docs.where(F.try_variant_get("doc", "$.summary", "variant").isNotNull()), "doc", wanted, "$.summary").drop("doc")


# --- documents from facts ---------------------------------------------------------------------------------------
def tracker_documents(tasks: DataFrame, calls: DataFrame, timings: DataFrame, clusters: DataFrame, totals: DataFrame) -> DataFrame:
    """problem_id and body, a task's nested document as JSON text: metadata, timing, layers, llm_calls and a summary.

    calls are one method's scored calls (comparison.scored_calls); layers are their sums in the order the layers were
    first called. A task without calls has empty lists. The lists of a task are gathered in one row: its calls are few.
    """
    order = F.struct("attempt", "layer")
    call = F.struct(*(F.col(c).cast(t).alias(c) for c, t in CALL.items()))
    listed = calls.groupBy("problem_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), call.alias("c")))), lambda x: x["c"]).alias("llm_calls"), F.sum("total_tokens").alias("tokens"), F.max("cumulative_kills").alias("kills"), F.sum(F.when(F.col("paid"), F.col("total_tokens")).otherwise(0)).alias("paid_tokens"))
    sums = calls.groupBy("problem_id", "layer").agg(F.min("attempt").alias("first"), F.max("cumulative_kills").alias("killed_mutants"), F.sum("new_kills").alias("new_kills"), F.count(F.lit(1)).alias("llm_calls"), F.sum("total_tokens").alias("total_tokens"), F.round(F.sum("latency_sec"), 6).alias("total_time_sec"), F.round(F.sum("estimated_cost_usd"), 8).alias("estimated_cost_usd"), F.max("cumulative_score").alias("mutation_score"))
    sums = sums.join(totals, "problem_id", "left").withColumn("total_mutants", F.coalesce("total_mutants", F.lit(0)))
    layer = F.struct(*(F.col(c).cast(t).alias(c) for c, t in LAYER.items()))
    stacked = sums.groupBy("problem_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", layer.alias("l")))), lambda x: x["l"]).alias("layers"))
    spent = timings.groupBy("problem_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "seconds")))).alias("timing"))
    rows = tasks.join(listed, "problem_id", "left").join(stacked, "problem_id", "left").join(spent, "problem_id", "left").join(clusters, "problem_id", "left").join(totals, "problem_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    empty = lambda c, of: F.coalesce(c, F.array().cast(of.schema[c].dataType)).alias(c)
    about = F.struct(zero("total_mutants").alias("mutant_count"), F.struct("dataset_subset", "parent_task_id").alias("dataset_metadata"), zero("num_clusters").alias("num_clusters"), zero("representatives").alias("representatives"))
    summary = F.struct("problem_id", zero("total_mutants").alias("total_mutants"), zero("kills").alias("killed_mutants"), zero("tokens").alias("total_tokens"), F.when(F.col("total_mutants") > 0, F.round(zero("kills") / F.col("total_mutants"), 6)).otherwise(0.0).alias("final_score"))
    whole = F.struct("problem_id", about.alias("metadata"), F.col("timing"), empty("layers", stacked), empty("llm_calls", listed), zero("paid_tokens").alias("paid_api_tokens"), summary.alias("summary"))
    return rows.select("problem_id", F.to_json(whole).alias("body"))


def write_documents(docs: DataFrame, folder: str) -> None:
    """The documents (problem_id, body) as JSON lines below folder, which `read_documents` reads; not a file a task."""
    docs.select(F.col("body").alias("value")).write.text(folder)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """path, problem_id, doc of what write_documents wrote; doc is null for a line that isn't JSON."""
    rows = parsed(spark.read.text(folder).select(F.col("_metadata.file_path").alias("path"), "value"), "value").drop("value")
    return rows.select("path", F.try_variant_get("doc", "$.problem_id", "string").alias("problem_id"), "doc")
