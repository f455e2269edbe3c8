"""Queries whose operators are Python maps: no SQL twin, held against brute force in tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code
from ..operators import mutation, probes, rounds


def tasks_from(rows: DataFrame) -> DataFrame:
    """Programming tasks from rows (key, kind from 0 to 3, n): problem_id, entry, source, test, prompt.

    The row's key names the function and n is a constant of it; the prompts hold a doctest, literal examples,
    annotations only, and nothing to probe by.
    """
    own = rows.selectExpr("concat('T/', key) AS problem_id", "concat('f', key) AS entry", "cast(kind AS int) AS kind", "cast(n AS bigint) AS n", "n % 3 + 1 AS k")
    check = "def check(candidate):\\n    assert candidate("
    source = ["concat('def ', entry, '(a, b):\\n    if a > b and b != ', n, ':\\n        return a + b * 2\\n    return a - b\\n')", "concat('def ', entry, '(xs):\\n    s = ', n, '\\n    for i in range(0, len(xs)):\\n        s += xs[i]\\n    return s\\n')", "concat('def ', entry, '(xs, n=', k, '):\\n    return xs[0:n] if xs is not None else []\\n')", "concat('def ', entry, '(a, b):\\n    return max(a, b) + pow(a, b) + ', n, '\\n')"]
    test = [f"concat('{check}', n + 9, ', ', n + 1, ') == ', 3 * n + 11, '\\n    assert candidate(0, ', n + 2, ') == ', -(n + 2), '\\n')", f"concat('{check}[1, 2, 3]) == ', n + 6, '\\n    assert candidate([]) == ', n, '\\n')", f"concat('{check}[1, 2, 3, 4]) == [', array_join(transform(sequence(1, cast(k AS int)), x -> cast(x AS string)), ', '), ']\\n')", f"concat('{check}2, 3) == ', n + 11, '\\n')"]
    prompt = ["concat('def ', entry, '(a, b):\\n    >>> ', entry, '(', n + 9, ', ', n + 1, ') == ', 3 * n + 11, '\\n    True\\n    For example ', entry, '(0, ', n + 2, ') is ', -(n + 2), '.\\n')", "concat('Sum a list: ', entry, '([1, 2, 3]) gives ', n + 6, ', ', entry, '([]) gives ', n, '.\\n')", "concat('def ', entry, '(xs: list[int], n: int = ', k, ') -> list[int]:\\n')", "'The larger one and a power.'"]
    pick = lambda name, texts: f"CASE kind {' '.join(f'WHEN {i} THEN {t}' for i, t in enumerate(texts))} END AS {name}"
    return own.selectExpr("problem_id", "entry", pick("source", source), pick("test", test), pick("prompt", prompt))


#: Suppliers a Spark task has, and Spark tasks at most.
SUPPLIERS, MOST_DEALT = 500, 10_000


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows over as many Spark tasks as their number asks for. A row of some bytes is milliseconds of work on source
    code, and Spark cuts files, and joins its partitions, by bytes: all rows would be the work of one."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // SUPPLIERS))
    return rows.repartition(min(MOST_DEALT, parts), key)


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task for each supplier."""
    rows = _dealt(spark.read.parquet(f"{sf_dir}/supplier.parquet"), "s_suppkey")
    return tasks_from(rows.selectExpr("cast(s_suppkey AS string) AS key", "s_nationkey % 4 AS kind", "s_suppkey AS n"))


def _shared_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task for each nation that suppliers have, with how many suppliers share it: what runs code in processes of its
    own runs a source once, however many rows have it."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("rows"))
    return tasks_from(rows.selectExpr("cast(s_nationkey AS string) AS key", "s_nationkey % 4 AS kind", "s_nationkey AS n")).join(rows.select(F.concat(F.lit("T/"), F.col("s_nationkey").cast("string")).alias("problem_id"), "rows"), "problem_id")


def ast_mutants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutation.mutants(_tasks(spark, sf_dir))


def sandbox_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mutant of the suppliers' tasks, whether its check kills it, and how many suppliers' rows have it."""
    tasks = _shared_tasks(spark, sf_dir)
    rows = mutation.mutants(tasks).join(tasks.select("problem_id", "entry", "test", "rows"), "problem_id")
    found = mutation.kill_matrix(mutation.evaluate(rows.select(F.col("mutant_id").alias("id"), F.col("mutated_source").alias("source"), "entry", F.array("test").alias("checks"))))
    return found.join(rows.select(F.col("mutant_id").alias("id"), "rows"), "id")


def contract_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of suppliers' tasks; of every fifth the check's name is spoilt, of every seventh its end is cut."""
    key = F.regexp_extract("problem_id", "([0-9]+)$", 1).cast("long")
    text = F.when(key % 5 == 0, F.replace("test", F.lit("check"), F.lit("chick"))).when(key % 7 == 0, F.expr("substr(test, 1, length(test) - 12)")).otherwise(F.col("test"))
    return mutation.validate_checks(_tasks(spark, sf_dir).select(F.col("problem_id").alias("id"), text.alias("text")))


def ward_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part, clustered within groups of 20 neighbouring keys: Ward is cubic in a group, so groups stay small at every size."""
    own = spark.read.parquet(f"{sf_dir}/part.parquet")
    group = F.floor((F.col("p_partkey") - 1) / 20).cast("string")
    rows = own.select(F.concat(F.lit("g"), group).alias("problem_id"), F.col("p_partkey").cast("string").alias("id"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice").cast("double")).alias("features"))
    return mutation.ward_groups(rows)


def mock_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of three layers and of a baseline, without network: a task for each region that suppliers have."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    regions = spark.read.parquet(f"{sf_dir}/supplier.parquet").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("n_regionkey").distinct()
    tasks = tasks_from(regions.selectExpr("cast(n_regionkey AS string) AS key", "n_regionkey % 3 AS kind", "n_regionkey AS n")).select("problem_id", F.lit("").alias("prompt"), "source", "entry")
    layers = [rounds.Layer(f"Layer{i + 1}", "mock", attempts=n) for i, n in enumerate((3, 2, 1))]
    return rounds.run_layers(tasks, [*layers, rounds.Layer("Baseline", "mock", attempts=10, method="baseline")])


def extract_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies = _tasks(spark, sf_dir).select("problem_id", F.concat(F.lit("Here it is:\n```python\n"), "test", F.lit("```\nDone.")).alias("reply"))
    found = code.column(code.extract_check)
    return replies.select("problem_id", found("reply").alias("check_text"), code.column(code.digest)(found("reply")).alias("digest"))


def mutant_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change each mutant makes, and the first mutant of each change."""
    pairs = mutation.mutants(_tasks(spark, sf_dir), with_source=True)
    diff = F.pandas_udf(lambda a, b: a.combine(b, code.source_diff), "string")
    rows = pairs.select("problem_id", "mutant_id", "operator", diff("source", "mutated_source").alias("diff"))
    return rows.groupBy("problem_id", "diff").agg(F.min_by("operator", "mutant_id").alias("operator"), F.min("mutant_id").alias("mutant_id"))


def probe_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probes.build_probes(_tasks(spark, sf_dir))


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each mutant does on its task's probes."""
    tasks = _shared_tasks(spark, sf_dir)
    return probes.signatures(tasks, mutation.mutants(tasks))


def mutant_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real mutants all the way: probes, signatures, features, Ward clusters, representatives."""
    tasks = _shared_tasks(spark, sf_dir)
    made = mutation.mutants(tasks)
    return probes.representatives(probes.features(made.join(probes.signatures(tasks, made), ["problem_id", "mutant_id"])))


def static_equivalents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probes.mark_equivalents(mutation.mutants(_tasks(spark, sf_dir), with_source=True))


def queries() -> dict:
    return {"probe_build": probe_build, "signatures": signatures, "mutant_clusters": mutant_clusters, "static_equivalents": static_equivalents, "ast_mutants": ast_mutants, "sandbox_eval": sandbox_eval, "contract_check": contract_check, "ward_clusters": ward_clusters, "mock_round": mock_round, "extract_check": extract_check, "mutant_diffs": mutant_diffs}
