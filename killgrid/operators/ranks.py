"""Row numbers and prefix sums over a whole table without one task that sorts it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows a range has on average; ranges at least, and at most (a task holds a pair of numbers for each).
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 200_000, 8, 1024


def range_bounds(rows: DataFrame, by: str, range_rows: int = RANGE_ROWS) -> list[float]:
    """Values of `by` that cut the rows into ranges of about range_rows, by approximate quantiles of one pass."""
    shares = [i / MOST_RANGES for i in range(1, MOST_RANGES)]
    count, cuts = rows.agg(F.count(F.lit(1)), F.percentile_approx(F.col(by).cast("double"), shares, 10 * MOST_RANGES)).first()
    parts = min(MOST_RANGES, max(LEAST_RANGES, -(-count // range_rows)))
    return sorted({float(cuts[i * MOST_RANGES // parts - 1]) for i in range(1, parts)}) if cuts else []


def range_of(by: Column, bounds: list[float]) -> Column:
    """Number of the range a value is in; nulls are range -1."""
    inside = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x < by.cast("double"))) if bounds else F.lit(0)
    return F.when(by.isNull(), -1).otherwise(inside)


def _shifted(dealt: DataFrame, amount: Column) -> DataFrame:
    """dealt (range, ...) with `shift`, the sum of `amount` in the ranges before, and `total`: each task is sent one
    array of a pair a range."""
    sums = dealt.groupBy("range").agg(F.sum(amount).alias("sum")).agg(F.collect_list(F.struct("range", "sum")).alias("sums"))
    added = lambda sums: F.aggregate(sums, F.lit(0).cast("long"), lambda a, x: a + x["sum"].cast("long"))
    with_sums = dealt.crossJoin(F.broadcast(sums))
    return with_sums.withColumns({"shift": added(F.filter("sums", lambda x: x["range"] < F.col("range"))), "total": added(F.col("sums"))}).drop("sums")


def numbered(rows: DataFrame, by: str, *ties: str, name: str = "i", total: str | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """rows with `name`, their place from 0 in the order of `by` (a number, nulls first) and then `ties`; `total` names a column of the row count.

    Rows are dealt to ranges of `by` between quantiles that one pass estimates (any bounds give the same places),
    placed within their range, and shifted by the rows of the ranges before. Rows that share `by` are one range; an
    empty table gives no rows. The caller's columns are nested meanwhile, so that their names are free.
    """
    bounds = range_bounds(rows, by, range_rows)
    dealt = rows.select(range_of(F.col(by), bounds).alias("range"), F.struct("*").alias("row"))
    order = Window.partitionBy("range").orderBy(*(F.col("row")[c] for c in (by, *ties)))
    found = _shifted(dealt, F.lit(1)).withColumn("place", (F.row_number().over(order) - 1 + F.col("shift")).cast("long"))
    return found.select("row.*", F.col("place").alias(name), *([F.col("total").cast("long").alias(total)] if total else []))


def tied_ranks(values: DataFrame, by: str, times: str, range_rows: int = RANGE_ROWS, keys: list[str] | None = None) -> DataFrame:
    """values (one row a distinct `by` of its keys, `times` rows of it each) with `mean_rank`, the average rank from 1
    within the keys that its rows share. Ties are one row whatever their number, so no range holds more than
    distinct values; a null key is a key."""
    bounds = range_bounds(values, by, range_rows)
    n = F.col("row")[times]
    key = F.struct(*keys) if keys else F.lit(0)
    dealt = values.select(key.alias("key"), range_of(F.col(by), bounds).alias("range"), F.struct("*").alias("row"))
    if keys:
        earlier = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
        sums = dealt.groupBy("key", "range").agg(F.sum(n).alias("sum"))
        found = dealt.join(sums.select("key", "range", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("shift")), ["key", "range"])
    else:
        found = _shifted(dealt, n)
    upto = Window.partitionBy("key", "range").orderBy(F.col("row")[by]).rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("last", F.sum(n).over(upto) + F.col("shift"))
    return found.select("row.*", (F.col("last") - (n - 1) / 2).alias("mean_rank"))
