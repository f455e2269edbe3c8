"""Shards of a run merged from partial states, in any order, each shard once.

A shard's state is a table of one row an entry: sums by name, members of sets, settings with the time they were set,
and counts of a value's logarithmic buckets. Merging adds sums and buckets up, unites members and lets the latest
setting win, all by one grouped aggregation, so that states of states are states. A shard that is merged twice counts
once: entries carry the shard and the attempt that wrote them, and only a shard's last attempt is taken.

Buckets are powers of GROWTH; a quantile read from them is within 1 per cent of a value of that rank.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROWTH = 1.02
ENTRY = "shard string, attempt long, kind string, name string, key string, amount long, at timestamp, value string"


def _bucket(value: Column) -> Column:
    """0 for values of 0 or less, else the bucket's number."""
    return F.when(value > 0, F.concat(F.lit("b"), F.ceil(F.log(value) / math.log(GROWTH)).cast("string"))).otherwise("zero")


def states(rows: DataFrame, shard: Column, attempt: Column, sums: dict[str, tuple[str, str]] | None = None, sets: dict[str, str] | None = None, settings: dict[str, tuple[str, str, str]] | None = None, sketches: dict[str, str] | None = None) -> DataFrame:
    """The states of the shards and attempts that rows are of. sums: name to (key column, column to add up, '*' to
    count); sets: name to column; settings: name to (key, value, time columns); sketches: name to number column. Null
    keys, members, values and times are left out, null amounts count 0.

    All sums, sets and sketches of all shards are one aggregation, settings another one; both hold numbers only, so
    that Spark hashes them and sorts no row."""
    none = F.lit(None).cast("long")
    entry = lambda kind, name, key, amount=none: F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), key.cast("string").alias("key"), amount.cast("long").alias("amount"))
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    counted = [entry("sum", n, F.col(k), F.lit(1) if c == "*" else F.coalesce(F.col(c).cast("long"), F.lit(0))) for n, (k, c) in (sums or {}).items()]
    counted += [entry("set", n, F.col(c)) for n, c in (sets or {}).items()]
    counted += [entry("sketch", n, F.when(number(c).isNotNull(), _bucket(number(c))), F.lit(1)) for n, c in (sketches or {}).items()]
    dated = [F.struct(F.lit("setting").alias("kind"), F.lit(n).alias("name"), F.col(k).cast("string").alias("key"), F.col(at).cast("timestamp").alias("at"), F.col(v).cast("string").alias("value")) for n, (k, v, at) in (settings or {}).items()]
    of, place = (shard.cast("string").alias("shard"), attempt.cast("long").alias("attempt")), ["shard", "attempt", "kind", "name", "key"]
    each = lambda entries: rows.select(*of, F.inline(F.array(*entries))).where("key IS NOT NULL")
    parts = []
    if counted:
        parts.append(each(counted).groupBy(*place).agg(F.sum("amount").alias("amount")).select(*place, "amount", F.lit(None).cast("timestamp").alias("at"), F.lit(None).cast("string").alias("value")))
    if dated:
        known = each(dated).where("at IS NOT NULL AND value IS NOT NULL").distinct()
        last = known.groupBy(*place).agg(F.max("at").alias("at"))
        same = reduce(lambda a, b: a & b, [F.col(f"k.{c}").eqNullSafe(F.col(f"l.{c}")) for c in (*place, "at")])
        found = known.alias("k").join(last.alias("l"), same, "left_semi").groupBy(*place, "at").agg(F.max("value").alias("value"))
        parts.append(found.select(*place, none.alias("amount"), "at", "value"))
    whole = reduce(DataFrame.unionByName, parts)
    return whole.select("shard", "attempt", "kind", "name", "key", "amount", "at", "value")


def state(rows: DataFrame, shard: str, attempt: int, **what: dict) -> DataFrame:
    """The state of one shard's rows: see states."""
    return states(rows, F.lit(shard), F.lit(attempt), **what)


def merge(states: DataFrame) -> DataFrame:
    """One state (kind, name, key, amount, at, value) from the entries of any number of shards. Of a shard only the
    entries of its last attempt count, repeated ones once; ties in time go to the greater value."""
    last = Window.partitionBy("shard")
    attempts = states.groupBy("shard", "attempt").agg(F.count(F.lit(1)).alias("n"))  # a row a shard and attempt
    taken = attempts.withColumn("last", F.max("attempt").over(last)).where("attempt = last").select(F.col("shard").alias("_s"), F.col("attempt").alias("_a"))
    same = states["shard"].eqNullSafe(taken["_s"]) & (states["attempt"] == taken["_a"])
    # a state read twice has every entry twice
    once = states.join(taken, same, "left_semi").groupBy("shard", "kind", "name", "key").agg(F.max("amount").alias("amount"), F.max(F.struct("at", "value")).alias("x"))
    merged = once.groupBy("kind", "name", "key").agg(F.sum("amount").alias("amount"), F.max("x").alias("x"))
    return merged.select("kind", "name", "key", "amount", F.col("x.at").alias("at"), F.col("x.value").alias("value"))


def quantiles(merged: DataFrame, name: str, shares: list[float]) -> DataFrame:
    """share, value: the middle of the bucket in which that share of the values ends (0 for the lowest one)."""
    number = F.regexp_extract("key", "^b(-?[0-9]+)$", 1)
    rows = merged.where((F.col("kind") == "sketch") & (F.col("name") == name)).select(F.when(F.col("key") != "zero", number.cast("int")).alias("b"), "amount")
    order = Window.orderBy(F.col("b").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)  # some thousand buckets at most
    placed = rows.withColumns({"upto": F.sum("amount").over(order), "total": F.sum("amount").over(Window.partitionBy())})
    value = F.coalesce(2 * F.pow(F.lit(GROWTH), F.col("b")) / (GROWTH + 1), F.lit(0.0))
    wanted = [placed.where(F.col("upto") >= F.ceil(F.greatest(F.lit(s) * F.col("total"), F.lit(1.0)))).agg(F.lit(s).alias("share"), F.min(value).alias("value")) for s in shares]
    return reduce(DataFrame.unionByName, wanted)
