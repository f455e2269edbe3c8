"""Mixing sources to target weights by temperature.

A source of T tokens gets a weight in proportion to T**a; the exponent a is
found by sectioning the range 0 to 1 until the weights' entropy meets the
target (a share of the largest possible), no source being repeated more often
than the repetition limit. Weights are turned into epochs per source: with a
budget in tokens, as many as fill it; the default budget is the least at which
the largest source is used once, so that no document is lost.

Epochs are realised as block permutations: a hash deals each source's rows to
BLOCKS blocks; every epoch has its own order of blocks, a fractional epoch
takes blocks in that order while its quota lasts, and in the block where the
quota ends, rows in hash order. Sums by block are grouped before anything is
ordered, so that a source with a third of all rows is BLOCKS rows to order.
The rows then leave in the order of epoch, permuted block and row, dealt to
tasks by ranges of that order; `mixture` says each row's position in it.

Defined results: tokens are runs of non-white characters; a null text has none;
a null source counts as the source ''; rows without tokens follow the whole
epochs of their source, and one epoch at least where no budget is set; rows
equal in id and text share a hash, so a quota takes all of them or none and
they stand together; an empty table gives no rows; `mixed` carries all
columns, whatever their names, through and returns a row once per repetition.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import files_for, persist, table

BLOCKS, SEED = 1024, 17
TARGET_ENTROPY, MOST_REPEATS = 0.9, 2.0
#: Rows of the block plan (sources times BLOCKS) up to which it is broadcast; above that it is joined by shuffle.
BROADCAST_ROWS = 200_000


#: A row's place in the mixture: epoch, then the permuted blocks, then rows in a block.
_ORDER = ("epoch", "block_order", "row_order")


def _keyed(docs: DataFrame, *columns) -> DataFrame:
    """source, hash and block of each row, beside the columns asked for."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(*columns, F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source"), F.xxhash64(F.col("doc_id"), text).alias("hash"))
    return own.withColumn("block", F.pmod(F.col("hash"), F.lit(BLOCKS)).cast("int"))


def _epochs(tokens, most: float, exponent: float, repeats: float):
    return F.least(F.lit(repeats), F.pow(F.lit(most) / tokens, F.lit(1.0 - exponent)))


def temperature(totals: DataFrame, target: float = TARGET_ENTROPY, repeats: float = MOST_REPEATS) -> tuple[float, float]:
    """The largest exponent whose capped weights reach the target entropy (0 if none does), and the largest source.

    totals: one row per source with `tokens`. Each pass sums entropies for a row of exponents, so that
    four jobs over the sources bisect 24 times, however many sources there are.
    """
    n, most = totals.where("tokens > 0").agg(F.count(F.lit(1)), F.max("tokens")).first()
    if not n or n < 2:
        return 1.0, float(most or 0)
    lo, hi, steps = 0.0, 1.0, 64
    for _ in range(4):
        grid = [lo + (hi - lo) * i / steps for i in range(steps + 1)]
        sums = []
        for i, a in enumerate(grid):
            w = F.col("tokens") * _epochs(F.col("tokens"), most, a, repeats)
            sums += [F.sum(w).alias(f"w{i}"), F.sum(w * F.log(w)).alias(f"l{i}")]
        row = totals.where("tokens > 0").agg(*sums).first()
        good = [i for i in range(len(grid)) if math.log(row[f"w{i}"]) - row[f"l{i}"] / row[f"w{i}"] >= target * math.log(n)]
        if not good:
            return 0.0, float(most)
        k = max(good)
        lo, hi = grid[k], grid[min(k + 1, steps)]
    return round(lo, 7), float(most)


def block_plan(docs: DataFrame, target: float = TARGET_ENTROPY, repeats: float = MOST_REPEATS, budget: int | None = None) -> DataFrame:
    """One row per source and block: whole epochs, whether the fractional epoch takes the block (part: 0 no,
    1 rows up to hash `upto`, 2 all), the source's weight and epochs."""
    rows = persist(_keyed(docs, F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"\S+")).cast("long").alias("tokens")), "mix-rows")
    files = files_for(docs.sparkSession, rows.count())
    blocks = persist(rows.groupBy("_source", "block").agg(F.sum("tokens").alias("tokens")), "mix-blocks", files)
    totals = persist(blocks.groupBy("_source").agg(F.sum("tokens").cast("double").alias("tokens")), "mix-sources", files)
    exponent, most = temperature(totals, target, repeats)
    epochs = F.when(F.col("tokens") > 0, _epochs(F.col("tokens"), max(most, 1.0), exponent, repeats)).otherwise(1.0)
    named = totals.withColumn("epochs", epochs)
    drawn = named.agg(F.sum(F.col("tokens") * F.col("epochs"))).first()[0] or 1.0
    named = named.withColumn("weight", F.col("tokens") * F.col("epochs") / F.lit(max(drawn, 1.0)))
    if budget is not None:
        named = named.withColumn("epochs", F.col("epochs") * F.lit(budget / max(drawn, 1.0)))
    named = named.select("_source", F.round("epochs", 9).alias("epochs"), F.round("weight", 9).alias("weight"), F.col("tokens").alias("total"))
    named = named.withColumn("whole", F.floor("epochs").cast("int")).withColumn("quota", F.floor((F.col("epochs") - F.col("whole")) * F.col("total")))
    order = Window.partitionBy("_source").orderBy(F.xxhash64("_source", "block", "whole", F.lit(SEED)), "block")
    ranked = blocks.join(named, "_source").withColumn("left", F.col("quota") - F.sum("tokens").over(order) + F.col("tokens"))
    part = F.when(F.col("left") >= F.col("tokens"), 2).when(F.col("left") > 0, 1).otherwise(0)
    ranked = persist(ranked.withColumn("part", F.when(F.col("quota") > 0, part).otherwise(0)), "mix-ranked", files)
    # the one block of each source where its quota ends
    ends = rows.join(ranked.where("part = 1").select("_source", "block", "left"), ["_source", "block"])
    upto = Window.partitionBy("_source", "block").orderBy("hash").rangeBetween(Window.unboundedPreceding, 0)
    taken = ends.withColumn("sum", F.sum("tokens").over(upto)).where(F.col("sum") <= F.col("left")).groupBy("_source", "block").agg(F.max("hash").alias("upto"))
    return ranked.join(taken, ["_source", "block"], "left").select("_source", "block", "whole", "part", "upto", "weight", "epochs")


def _repeated(docs: DataFrame, plan: DataFrame, *columns) -> DataFrame:
    """The columns asked for with the plan's and _ORDER, once per repetition, dealt and sorted by _ORDER."""
    plan = persist(plan, "mix-plan")
    side = F.broadcast(plan) if plan.count() <= BROADCAST_ROWS else plan
    joined = _keyed(docs, *columns).join(side, ["_source", "block"])
    extra = F.when(F.col("part") == 2, 1).when((F.col("part") == 1) & (F.col("hash") <= F.col("upto")), 1).otherwise(0)
    times = F.col("whole") + extra
    rows = joined.where(times > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), times - 1)))
    rows = rows.withColumns({"block_order": F.xxhash64("_source", "block", "epoch", F.lit(SEED)), "row_order": F.xxhash64("hash", "epoch", F.lit(SEED))})
    return rows.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER, "hash")


def mixture(docs: DataFrame, target: float = TARGET_ENTROPY, repeats: float = MOST_REPEATS, budget: int | None = None) -> DataFrame:
    """The mixture by id: doc_id, source, weight and epochs of the source, epoch, block, and position (from 0)
    in the mixture."""
    plan = block_plan(docs, target, repeats, budget)
    rows = _repeated(docs, plan, F.col("doc_id").cast("long").alias("doc_id")).select("doc_id", F.col("_source").alias("source"), "weight", "epochs", "epoch", "block", F.monotonically_increasing_id().alias("at"))
    rows = persist(rows, "mix-order")
    # `at` counts within a write task (lower 33 bits); tasks hold ranges of the order, so each is shifted by those before
    task, local = F.shiftright("at", 33).alias("task"), F.col("at").bitwiseAND((1 << 33) - 1)
    before = F.coalesce(F.sum("rows").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = rows.groupBy(task).agg(F.count(F.lit(1)).alias("rows")).select("task", before.alias("shift"))  # a row a task
    return rows.join(F.broadcast(shifts), task == shifts["task"]).select("doc_id", "source", "weight", "epochs", "epoch", "block", (local + F.col("shift")).alias("position"))


def mixed(docs: DataFrame, target: float = TARGET_ENTROPY, repeats: float = MOST_REPEATS, budget: int | None = None) -> DataFrame:
    """docs, all columns, each row as often as its source's weight asks for, in the order of the mixture."""
    plan = block_plan(docs, target, repeats, budget)
    # the caller's columns are one struct: no name of theirs can meet one of ours
    return _repeated(docs, plan, F.struct("*").alias("_row")).select("_row.*")


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))
