"""Result folders of earlier runs: metric documents, mutants, shards, and their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MUTANT = "mutant_id string, problem_id string, operator string, status string, line int, cluster_id int"


def metric_documents(spark: SparkSession, folder: str, deep: bool = False) -> DataFrame:
    """(path, body) of *_metrics.json; documents that don't parse are left out."""
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter="*_metrics.json", recursiveFileLookup=deep)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
    return rows.where(F.get_json_object("body", "$").isNotNull())


def summaries(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The `summary` of each metric document below a folder, with columns as schema has them."""
    found = metric_documents(spark, folder, deep=True).withColumn("summary", F.get_json_object("body", "$.summary"))
    return found.where("summary IS NOT NULL").select("path", F.from_json("summary", schema).alias("s")).select("path", "s.*")


def final_mutants(spark: SparkSession, folder: str) -> DataFrame:
    """Mutants of every final_mutants.json below a folder, one row each; killed is 1 or 0.

    A blank task is named after its folder, a blank operator is UNKNOWN.
    """
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter="final_mutants.json", recursiveFileLookup=True)
    rows = rows.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("task"), F.explode(F.from_json("value", f"array<struct<{', '.join(x.replace(' ', ': ') for x in MUTANT.split(', '))}>>")).alias("m"))
    named = lambda c, other: F.coalesce(F.nullif(F.trim(c), F.lit("")), other).alias(c.split(".")[1])
    return rows.select("m.mutant_id", named("m.problem_id", F.col("task")), named("m.operator", F.lit("UNKNOWN")), "m.line", "m.cluster_id", F.coalesce(F.upper("m.status") == "KILLED", F.lit(False)).cast("int").alias("killed"))


def merge_shards(shards: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of shards; of rows with equal keys those of the first shard stay. Columns a shard lacks are null."""
    whole = shards[0].withColumn("_kg_shard", F.lit(0))
    for i, shard in enumerate(shards[1:], 1):
        whole = whole.unionByName(shard.withColumn("_kg_shard", F.lit(i)), allowMissingColumns=True)
    first = whole.groupBy(*keys).agg(F.min("_kg_shard").alias("_kg_first"))
    same = [whole[k].eqNullSafe(first[k]) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return whole.join(first, on & (whole["_kg_shard"] == first["_kg_first"]), "left_semi").drop("_kg_shard")


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.json(path, mode="overwrite", ignoreNullFields=False)


def write_log(calls: DataFrame, path: str) -> None:
    """Append calls to a log, one folder per method and layer."""
    calls.write.partitionBy("method", "layer").json(path, mode="append")


def write_suites(suites: DataFrame, path: str) -> None:
    """One text file of checks per task (problem_id, suite), in a folder named after the task."""
    safe = F.regexp_replace("problem_id", r"[^A-Za-z0-9_.-]+", "_")
    suites.select(F.coalesce(F.nullif(safe, F.lit("")), F.lit("task")).alias("task"), F.col("suite").alias("value")).write.partitionBy("task").text(path)


def report_markdown(tables: dict[str, DataFrame], most: int = 20) -> str:
    """A short report of summary tables: the first rows of each."""
    parts = ["# Report"]
    for name, df in tables.items():
        rows = df.limit(most).collect()
        parts += [f"## {name}", " | ".join(df.columns), " | ".join("-" for _ in df.columns), *[" | ".join("" if v is None else str(v) for v in r) for r in rows]]
    return "\n".join(parts) + "\n"


CLUSTER = "problem_id string, cluster_id int, members array<string>, representative_ids array<string>, strategy string"


def save_mutants(mutants: DataFrame, path: str) -> None:
    """Mutants as JSON lines, dealt to folders by a hash of the task, not to a folder each: a task's are in one."""
    mutants.withColumn("part", F.pmod(F.hash("problem_id"), F.lit(64))).write.partitionBy("part").json(path, ignoreNullFields=False)


def load_mutants(spark: SparkSession, path: str, schema: str = MUTANT) -> DataFrame:
    return spark.read.schema(f"{schema}, part int").json(path).drop("part")


def save_clusters(stacks: DataFrame, path: str) -> None:
    """One row a task and cluster (stacks.representatives): its members and representatives in order, as JSON lines."""
    order = F.struct(F.coalesce("place", F.lit(1 << 30)), "id")
    ids = lambda where: F.transform(F.array_sort(F.collect_list(F.when(where, F.struct(order.alias("o"), F.col("id").cast("string").alias("id"))))), lambda x: x["id"])
    rows = stacks.groupBy(F.col("task").cast("string").alias("problem_id"), F.col("cluster").cast("int").alias("cluster_id"))
    rows.agg(ids(F.lit(True)).alias("members"), ids(F.col("representative")).alias("representative_ids"), F.lit("UBIG-RS").alias("strategy")).write.json(path, ignoreNullFields=False)


def load_clusters(spark: SparkSession, path: str) -> DataFrame:
    """problem_id, cluster_id, members, representative_ids, strategy; an empty frame where nothing was saved."""
    return spark.read.schema(CLUSTER).json(path)
