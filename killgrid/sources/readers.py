"""Task tables from Parquet, CSV, JSON lines and JSON documents, with one row shape."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings of each column, the first non-blank one counts.
ALIASES = {
    "task_id": ("task_id", "id", "problem_id"),
    "entry_point": ("entry_point", "function_name", "target"),
    "prompt": ("prompt", "complete_prompt", "code_prompt"),
    "solution": ("canonical_solution", "solution", "reference_solution"),
    "test": ("test", "tests", "official_test"),
    "instruction": ("instruct_prompt", "instruction", "description"),
    "subset": ("evoeval_subset", "dataset_subset", "subset"),
}

_MARK = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]]', re.S)


def _documents(text: str) -> Iterator[str]:
    """The documents of a file, one after the other; what follows the last one is one more, for the parser to refuse."""
    at = depth = 0
    for mark in _MARK.finditer(text):
        depth += (mark[0] in "{[") - (mark[0] in "}]")
        if depth == 0 and mark[0] in "}]":
            yield text[at : mark.end()]
            at = mark.end()
    if text[at:].strip():
        yield text[at:]


def _json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Rows of files of JSON documents, any number a file. Spark's multiLine reads the first of a file only."""
    files = spark.read.text(path, wholetext=True)
    return spark.read.json(files.rdd.flatMap(lambda r: _documents(r.value)), mode="FAILFAST")


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    end = path.rsplit(".", 1)[-1].lower()
    if end in ("parquet", "pq"):
        return spark.read.parquet(path)
    if end == "csv":
        return spark.read.csv(path, header=True, inferSchema=True, multiLine=True, escape='"')
    if end in ("jsonl", "ndjson"):
        return spark.read.json(path, mode="FAILFAST")
    if end == "json":
        rows = _json_documents(spark, path)
        inner = [c for c in ("data", "tasks", "problems") if c in rows.columns]
        if not inner:
            return rows
        # a row's first wrapper that isn't null counts; a document may hold another than its neighbour
        parts = [rows.where(" and ".join([f"{x} is null" for x in inner[:i]] + [f"{c} is not null"])).select(F.explode(c).alias("row")).select("row.*") for i, c in enumerate(inner)]
        bare = rows.where(" and ".join(f"{c} is null" for c in inner)).drop(*inner)
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*parts, bare] if bare.columns else parts)
    raise ValueError(f"no reader for {path}")


def normalised(rows: DataFrame) -> DataFrame:
    """The columns of ALIASES as text, '' where no spelling has a value; a missing entry point is the first def."""
    first = lambda names: F.coalesce(*(F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in rows.columns), F.lit(""))
    out = rows.select(*(first(names).alias(c) for c, names in ALIASES.items()))
    found = F.regexp_extract(F.concat_ws("\n", "prompt", "solution"), r"def\s+(\w+)\s*\(", 1)
    return out.withColumn("entry_point", F.coalesce(F.nullif("entry_point", F.lit("")), found))


def repeated_ids(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("task_id").count().where("count > 1")


def write_union_csv(frames: list[DataFrame], path: str, one_file: bool = False) -> None:
    """CSV files whose header is the sorted union of all columns; one file, written by one task, only on request."""
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f, allowMissingColumns=True)
    rows = whole.select(*sorted(whole.columns))
    (rows.coalesce(1) if one_file else rows).write.csv(path, header=True, mode="overwrite")
