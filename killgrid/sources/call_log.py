"""An append-only log of calls that a stream writes exactly once.

A batch is written under its number and then committed by one small file that names it; the log is what commits
name. A batch that is replayed after a crash finds its commit and adds nothing; data without a commit is never read,
and `sweep` removes it. Beside the rows, each call's text artefact goes to a table of its own in the same commit.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .shared import Files

CALL = "problem_id string, layer string, attempt long, provider string, model string, status string, prompt_tokens long, completion_tokens long, thoughts_tokens long, total_tokens long, latency_sec double, estimated_cost_usd double, target_count long, new_kills long, cumulative_kills long, cumulative_score double, validation_reason string, prompt string, response string, extracted_test string, passed_on_original boolean, killed_mutants long, surviving_mutants long, error string"
KEPT = f"{CALL}, batch long"
ARTEFACT = "batch long, problem_id string, name string, body string"


def safe(c: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), r"[^A-Za-z0-9_.-]+", "_")


def provider_of(model: Column, provider: Column) -> Column:
    """The provider, where it is blank by the model's name."""
    low = F.lower(F.coalesce(model, F.lit("")))
    by_name = F.when(low.startswith("gemini"), "gemini").when(low.rlike("^(gpt|o1|o3|o4)"), "openai").otherwise("hf")
    return F.when(F.coalesce(provider, F.lit("")) != "", provider).otherwise(by_name)


def _body() -> Column:
    """A call as text: what it was, the prompt, the reply, the check found in it and how it did."""
    line = lambda n, v=None: F.concat(F.lit(f"{n}: "), F.coalesce(v if v is not None else F.col(n).cast("string"), F.lit("")))
    text = lambda n: F.coalesce(F.col(n), F.lit(""))
    tokens = F.concat(*(x for n in ("prompt", "completion", "thoughts", "total") for x in (F.lit(f"{', ' if n != 'prompt' else ''}{n}="), F.coalesce(F.col(f"{n}_tokens"), F.lit(0)).cast("string"))))
    head = [line(n) for n in ("problem_id", "layer", "provider", "model", "status")] + [line("tokens", tokens)] + [line(n) for n in ("latency_sec", "estimated_cost_usd", "attempt", "target_count", "new_kills", "cumulative_kills", "cumulative_score")]
    head += [line("prompt_chars", F.length(text("prompt")).cast("string")), line("response_chars", F.length(text("response")).cast("string")), line("validation_reason")]
    parts = [F.lit(""), F.lit("===== PROMPT ====="), text("prompt"), F.lit(""), F.lit("===== RAW LLM RESPONSE ====="), text("response"), F.lit(""), F.lit("===== EXTRACTED TEST ====="), text("extracted_test"), F.lit(""), F.lit("===== EVALUATION =====")]
    return F.concat_ws("\n", *head, *parts, *(line(n) for n in ("passed_on_original", "killed_mutants", "surviving_mutants", "error")))


def append(calls: DataFrame, batch: int, folder: str, before_commit=None) -> bool:
    """Add calls to the log as batch number `batch`; False, and nothing added, if the log has that number.

    before_commit is called between the data and its commit; what it raises leaves the log as it was.
    """
    spark = calls.sparkSession
    files, commit = Files(spark, folder), f"{folder}/commits/{batch:012d}"
    if files.exists(commit):
        return False
    name = f"{batch:012d}-{uuid.uuid4().hex}"
    rows = calls.withColumns({"provider": provider_of(F.col("model"), F.col("provider")), "batch": F.lit(batch).cast("long")})
    rows.write.json(f"{folder}/calls/{name}", ignoreNullFields=False)
    # the written rows are read, so that artefacts are those of what is kept
    kept = spark.read.schema(KEPT).json(f"{folder}/calls/{name}")
    title = F.concat(F.format_string("%03d", F.coalesce("attempt", F.lit(0))), *(x for c in ("layer", "provider", "model") for x in (F.lit("_"), safe(c))), F.lit(".txt"))
    kept.select("batch", "problem_id", F.concat_ws("/", safe("problem_id"), title).alias("name"), _body().alias("body")).write.parquet(f"{folder}/artefacts/{name}")
    if before_commit:
        before_commit(batch)
    files.replace(commit, name)
    return True


def _committed(spark: SparkSession, folder: str) -> list[str]:
    names = [f"{folder}/commits/{n}" for n in Files(spark, folder).names(f"{folder}/commits") if n.isdigit()]
    return sorted(r.value for r in spark.read.text(names).collect()) if names else []


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All calls of the log, with their batch."""
    paths = [f"{folder}/calls/{n}" for n in _committed(spark, folder)]
    return spark.read.schema(KEPT).json(paths) if paths else spark.createDataFrame([], KEPT)


def artefacts(spark: SparkSession, folder: str) -> DataFrame:
    """batch, problem_id, name (a path below the task's folder), body of each call."""
    paths = [f"{folder}/artefacts/{n}" for n in _committed(spark, folder)]
    return spark.read.schema(ARTEFACT).parquet(*paths) if paths else spark.createDataFrame([], ARTEFACT)


def sweep(spark: SparkSession, folder: str) -> int:
    """Remove data that no commit names; no stream may be writing. How many batches' folders went."""
    files, known = Files(spark, folder), set(_committed(spark, folder))
    gone = [f"{folder}/{kind}/{n}" for kind in ("calls", "artefacts") for n in files.names(f"{folder}/{kind}") if n not in known]
    for path in gone:
        files.delete(path)
    return len(gone)


def follow(calls: DataFrame, folder: str, checkpoint: str, before_commit=None, available_now: bool = False) -> StreamingQuery:
    """Write a stream of calls to the log; started again with the same checkpoint it goes on where it was."""
    writer = calls.writeStream.foreachBatch(lambda batch, number: append(batch, number, folder, before_commit) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
