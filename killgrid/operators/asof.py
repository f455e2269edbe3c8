"""As-of join: of each left row, the last right row of its keys at or before it.

No inequality join: both sides are one table, ordered within keys, and the last right row that isn't null is
carried on. Long orders are cut into ranges of the ordering column, so that a key with many rows is not one task's:
within a range the window carries on, and what a range ends with reaches the ranges after it by one row a range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import range_bounds, range_of

#: Rows a range has on average.
RANGE_ROWS = 500_000


def asof(left: DataFrame, right: DataFrame, keys: list[str], on: str, values: list[str], best: str | None = None, range_rows: int | None = RANGE_ROWS) -> DataFrame:
    """left's columns with `values` of the last right row of the same keys whose `on` is at most the left row's.

    Nulls: a left row whose `on` is null finds nothing, right rows without `on` are left out, a null key meets a null
    key. Among right rows of one `on` the greatest values count. With `best`, one of the values, the right row with
    the greatest of it so far counts instead of the last. Left rows that find none have nulls; all are kept, repeated
    ones too. `on` must be a number or a time in both. range_rows None leaves out the ranges, and the job that finds
    them, where each key's rows are few.
    """
    value = F.struct(F.col(best), *(F.col(v) for v in values if v != best)) if best else F.struct(*values)
    kind = right.select(value.alias("v")).schema["v"].dataType
    place = lambda c: F.struct(*(F.col(k) for k in keys)).alias(c)
    probes = left.select(place("key"), F.col(on).cast("double").alias("at"), F.lit(1).alias("side"), F.lit(None).cast(kind).alias("value"), F.struct("*").alias("row"))
    known = right.where(F.col(on).isNotNull()).select(place("key"), F.col(on).cast("double").alias("at"), F.lit(0).alias("side"), value.alias("value"), F.lit(None).cast(probes.schema["row"].dataType).alias("row"))
    rows = probes.unionByName(known)
    dealt = rows.withColumn("range", F.lit(0) if range_rows is None else range_of(F.col("at"), range_bounds(rows, "at", range_rows)))
    order = Window.partitionBy("key", "range").orderBy("at", "side", "value").rowsBetween(Window.unboundedPreceding, 0)
    here = F.max("value").over(order) if best else F.last("value", ignorenulls=True).over(order)
    if range_rows is None:
        got = dealt.withColumn("whole", here).where("side = 1").select("row", F.when(F.col("at").isNotNull(), F.col("whole")).alias("value"))
        return got.select("row.*", *(F.col("value")[v].alias(v) for v in values))
    # what each range hands on: its best or last right row; a window over at most a row a range
    ends = dealt.where("side = 0").groupBy("key", "range").agg((F.max("value") if best else F.max(F.struct("at", "value"))["value"]).alias("value"))
    before = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.unionByName(dealt.where("side = 1").groupBy("key", "range").agg(F.lit(None).cast(kind).alias("value")))
    carried = carried.groupBy("key", "range").agg(F.max("value").alias("value")).withColumn("carry", F.max("value").over(before) if best else F.last("value", ignorenulls=True).over(before))
    found = dealt.withColumn("here", here).where("side = 1").join(carried.select("key", "range", "carry"), ["key", "range"])
    whole = F.greatest("here", "carry") if best else F.coalesce("here", "carry")
    got = found.select("row", F.when(F.col("at").isNotNull(), whole).alias("value"))
    return got.select("row.*", *(F.col("value")[v].alias(v) for v in values))
