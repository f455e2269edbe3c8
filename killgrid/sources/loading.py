"""Task rows of any spelling as one normalised table, checked in the pass that writes it."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .readers import read_rows
from .shared import Files

#: Spellings of each column, the first that isn't blank counts.
SPELLINGS = {
    "raw_id": ("task_id", "id", "problem_id"),
    "entry_point": ("entry_point", "function_name", "target"),
    "complete_prompt": ("complete_prompt",),
    "code_prompt": ("code_prompt",),
    "prompt": ("prompt",),
    "canonical_solution": ("canonical_solution", "solution", "reference_solution"),
    "official_test": ("test", "tests", "official_test"),
    "instruction_prompt": ("instruct_prompt", "instruction", "description"),
    "subset": ("evoeval_subset", "dataset_subset", "subset"),
    "source_id": ("source_task_id",),
    "parent_id": ("parent_task_id",),
    "doc_struct": ("doc_struct",),
    "libs": ("libs",),
}
#: Other names of a subset.
_SUBSETS = {"tooluse": "tool_use", "tool": "tool_use"}


def cleaned(rows: DataFrame, *names: str) -> Column:
    """The first of the columns that holds something as text; a NaN and blanks are nothing, '' where none does."""
    kinds = dict(rows.dtypes)

    def text(name: str) -> Column:
        c = F.col(f"`{name}`")
        if kinds[name] in ("double", "float"):
            c = F.when(~F.isnan(c), c)
        c = F.to_json(c) if kinds[name].startswith(("struct", "array", "map")) else c.cast("string")
        return F.when(c.rlike(r"\S"), c)

    return F.coalesce(*(text(n) for n in names if n in kinds), F.lit(""))


def subset_name(subset: Column) -> Column:
    """Lower case with underscores, without the family's prefix, by its usual name."""
    plain = F.regexp_replace(F.translate(F.lower(F.trim(subset)), "- ", "__"), "^evoeval_", "")
    return F.coalesce(F.create_map(*(F.lit(x) for pair in _SUBSETS.items() for x in pair))[plain], plain)


def unique_task_id(source: Column, subset: Column) -> Column:
    named = F.coalesce(F.nullif(subset_name(subset), F.lit("")), F.lit("unknown"))
    whole = F.coalesce(F.nullif(F.trim(source), F.lit("")), F.lit("EvoEval/unknown"))
    rest = F.when(F.instr(whole, "/") > 0, F.regexp_extract(whole, "(?s)^[^/]*/(.*)$", 1)).otherwise(whole)
    return F.concat(F.lit("EvoEval_"), named, F.lit("/"), rest)


def parent_task_id(task: Column) -> Column:
    number = F.regexp_extract(task, "/([0-9]+)$", 1)
    return F.when(number != "", F.concat(F.lit("HumanEval/"), number)).otherwise(F.lit(""))


def dataset_name(columns: list[str], task: Column, requested: str = "auto") -> Column:
    """The family of a task by the table's columns and the id's beginning; a requested name counts first."""
    if requested and requested != "auto":
        return F.lit(requested)
    low = F.lower(task)
    evolved = F.lit("evoeval_subset" in columns) | low.startswith("evoeval/") | low.startswith("evoeval_")
    big = F.lit(bool({"complete_prompt", "instruct_prompt"} & set(columns))) | low.startswith("bigcodebench/")
    human = low.startswith("humaneval/") | F.lit("prompt" in columns)
    return F.when(evolved, "evoeval").when(big, "bigcodebench").when(human, "humaneval").otherwise("generic")


def tasks_of(rows: DataFrame, dataset: str = "auto") -> DataFrame:
    """One normalised task a row, with `fault`: why a row is no task, or null."""
    found = rows.select(*(cleaned(rows, *names).alias(c) for c, names in SPELLINGS.items()))
    found = found.withColumn("source_prompt", F.coalesce(*(F.nullif(c, F.lit("")) for c in ("prompt", "complete_prompt", "code_prompt")), F.lit("")))
    text = F.when(F.col("source_prompt") != "", F.col("source_prompt")).otherwise(F.col("canonical_solution"))
    found = found.withColumn("entry_point", F.coalesce(F.nullif("entry_point", F.lit("")), F.regexp_extract(text, r"\bdef\s+([A-Za-z_]\w*)\s*\(", 1)))
    found = found.withColumn("dataset_name", dataset_name(rows.columns, F.col("raw_id"), dataset))
    evolved, raw = F.col("dataset_name") == "evoeval", F.col("raw_id")
    own = subset_name(F.col("subset"))
    named = F.coalesce(F.nullif(subset_name(F.regexp_extract(raw, "(?i)^EvoEval_([^/]+)/", 1)), F.lit("")), F.lit("unknown"))
    found = found.withColumn("dataset_subset", F.when(evolved & (own == ""), named).otherwise(own))
    found = found.withColumn("source_task_id", F.coalesce(F.nullif("source_id", F.lit("")), raw))
    found = found.withColumn("task_id", F.when(evolved & F.lower(raw).startswith("evoeval/"), unique_task_id(raw, F.col("dataset_subset"))).otherwise(raw))
    found = found.withColumn("parent_task_id", F.when(evolved & (F.col("parent_id") == ""), parent_task_id(F.col("source_task_id"))).otherwise(F.col("parent_id")))
    nothing = (F.col("source_prompt") == "") & (F.col("canonical_solution") == "")
    fault = F.when(raw == "", "no id").when(F.col("entry_point") == "", "no entry point").when(nothing, "neither prompt nor solution")
    libs = F.coalesce(F.from_json("libs", "array<string>"), F.array().cast("array<string>"))
    return found.select("task_id", "source_task_id", "parent_task_id", "dataset_name", "dataset_subset", "entry_point", "source_prompt", "canonical_solution", "official_test", "instruction_prompt", "code_prompt", "complete_prompt", "doc_struct", libs.alias("libs"), fault.alias("fault"))


def metadata(tasks: DataFrame) -> DataFrame:
    """task_id and a struct of what a task has."""
    has = lambda c: F.col(c) != ""
    shape = F.coalesce(F.try_parse_json("doc_struct"), F.parse_json(F.lit("{}")))
    return tasks.select("task_id", F.struct("dataset_name", "dataset_subset", "source_task_id", "parent_task_id", has("instruction_prompt").alias("has_instruction_prompt"), has("code_prompt").alias("has_code_prompt"), (~F.to_json(shape).isin("{}", "[]", "null", '""', "0", "false")).alias("has_doc_struct"), F.col("libs").alias("libraries")).alias("metadata"))


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a file or folder with this schema; an empty frame of it where there is no file or no byte."""
    empty = spark.createDataFrame([], schema)
    if not Files(spark, path).size(path):
        return empty
    try:
        rows = read_rows(spark, path)
    except AnalysisException:  # files without a readable schema
        return empty
    kinds = dict(rows.dtypes)
    return rows.select(*((F.col(f"`{f.name}`") if f.name in kinds else F.lit(None)).try_cast(f.dataType).alias(f.name) for f in empty.schema))


class Refused(ValueError):
    """A load that found faults; `counts` has how many of each."""

    def __init__(self, counts: dict, some: list[str]):
        super().__init__(f"refused: {counts}, among them {some}")
        self.counts = counts


def load(rows: DataFrame, folder: str, dataset: str = "auto") -> DataFrame:
    """Normalise rows, write them and publish them at `folder`, or raise Refused and leave what was there.

    One job reads, checks and writes: rows and faults are counted by observe() on the way, repeated ids after the
    aggregation that keeps one row an id. The written table is moved to `folder` only if all counts are 0; its
    reader's schema holds for an empty table, too. A table that is there already stays: loads are published once.
    """
    spark = rows.sparkSession
    files, staging = Files(spark, folder), f"{folder.rstrip('/')}.{uuid.uuid4().hex}.staging"
    if files.exists(folder):
        raise FileExistsError(folder)
    tasks = tasks_of(rows, dataset)
    seen, kept = Observation(f"rows {uuid.uuid4().hex}"), Observation(f"ids {uuid.uuid4().hex}")
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    observed = tasks.observe(seen, F.count(F.lit(1)).alias("rows"), *(count(F.col("fault") == f).alias(f.replace(" ", "_")) for f in ("no id", "no entry point", "neither prompt nor solution")))
    # rows without an id would meet in one group, and are counted already
    named = observed.where("fault IS NULL OR fault <> 'no id'")
    each = named.groupBy("task_id").agg(F.first(F.struct(*(c for c in tasks.columns if c != "task_id"))).alias("t"), F.count(F.lit(1)).alias("times"))
    each = each.observe(kept, F.count(F.lit(1)).alias("ids"), count(F.col("times") > 1).alias("repeated"))
    each.select("task_id", "t.*", "times").write.parquet(staging)
    faults = {k: v for k, v in {**seen.get, "repeated": kept.get["repeated"]}.items() if k != "rows" and v}
    if faults:
        some = [r.task_id for r in spark.read.schema(each.select("task_id", "t.*", "times").schema).parquet(staging).where("times > 1 OR fault IS NOT NULL").select("task_id").limit(5).collect()]
        files.delete(staging)
        raise Refused(faults, some)
    if not files._fs.rename(files._path(staging), files._path(folder)):
        raise OSError(f"can't publish {folder}")
    return spark.read.schema(tasks.drop("fault").schema).parquet(folder)


def load_file(spark: SparkSession, path: str, folder: str, dataset: str = "auto") -> DataFrame:
    """load() of a Parquet, CSV, JSON lines or JSON file; a missing one is an error."""
    if not Files(spark, path).exists(path):
        raise FileNotFoundError(path)
    return load(read_rows(spark, path), folder, dataset)
