"""One statement, two engines: each query is SQL that Spark plans and an oracle can run on the same tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
#: Where the dialects differ: (Spark, oracle).
DIALECT = {
    "@quantile(": ("percentile(", "quantile_cont("),
    "@replace_all(": ("regexp_replace(", "regexp_replace_all("),
    "@list(": ("collect_list(", "list("),
    "@json(": ("get_json_object(", "json_extract_string("),
    "@md5(": ("md5(", "md5("),
    "@double": ("double", "double"),
    "@text": ("string", "varchar"),
    "@vector": ("array<double>", "double[]"),
    "@first": ("0", "1"),
}
#: @distance(x; y): Euclidean distance of two vectors.
_DISTANCE = re.compile(r"@distance\(([^;]+); ([^)]+)\)")
_DISTANCES = (r"sqrt(aggregate(zip_with(\1, \2, (u, v) -> (u - v) * (u - v)), cast(0 AS double), (s, u) -> s + u))", r"list_distance(\1, \2)")
_statements: dict[str, tuple[str, str]] = {}
_apart: set[str] = set()
_built: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _closing(sql: str, at: int) -> int:
    """Where the parenthesis that opens at `at` closes."""
    depth = 0
    for i in range(at, len(sql)):
        depth += (sql[i] == "(") - (sql[i] == ")")
        if not depth:
            return i
    raise ValueError("unbalanced parentheses")


def _long_counts(sql: str) -> str:
    """Counts and row numbers are long in both engines: one has wider conditional counts, the other int ranks."""
    while (a := sql.find("count_if(")) >= 0:
        b = _closing(sql, a + 8)
        sql = f"{sql[:a]}count(CASE WHEN {sql[a + 9 : b]} THEN 1 END){sql[b + 1 :]}"
    at = 0
    while (a := sql.find("row_number() OVER (", at)) >= 0:
        b = _closing(sql, a + 18)
        inner = f"cast({sql[a : b + 1]} AS bigint)"
        sql = sql[:a] + inner + sql[b + 1 :]
        at = a + len("cast(row_number() OVER (")
    return sql


def query(name: str, sql: str, oracle: str | None = None) -> None:
    """Register a statement; oracle only where the engines need different wording."""
    spark, twin = _long_counts(sql), _long_counts(oracle or sql)
    spark, twin = _DISTANCE.sub(_DISTANCES[0], spark), _DISTANCE.sub(_DISTANCES[1], twin)
    for mark, (s, o) in DIALECT.items():
        spark, twin = spark.replace(mark, s), twin.replace(mark, o)
    _statements[name] = spark, twin.replace("regexp_replace_all(", "regexp_replace(")


def dataframe_query(name: str, run: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
    """Register a query that is built with DataFrame functions, with an oracle written apart from it where SQL has one."""
    _built[name] = run, oracle


def _runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        statement = _statements[name][0]
        views = {}
        for t in TABLES:
            if f"{{{t}}}" in statement:
                views[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        return spark.sql(statement, **views) if views else spark.sql(statement)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _runner(name) for name in _statements} | {name: run for name, (run, _) in _built.items()}


def oracle_sql() -> dict[str, str]:
    return {name: twin if name in _apart else twin.replace("{", "").replace("}", "") for name, (_, twin) in _statements.items()} | {name: sql for name, (_, sql) in _built.items() if sql}


def apart(name: str, oracle: str) -> None:
    """Give a statement an oracle of its own wording, in the oracle's dialect: by the definition, not by the same plan."""
    _statements[name] = _statements[name][0], oracle
    _apart.add(name)
