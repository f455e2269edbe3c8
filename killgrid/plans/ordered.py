"""Queries over a table's whole order, by ranks.numbered; the oracles use one window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranks import numbered, range_bounds, range_of
from .registry import dataframe_query

_PLACES = "SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"), "c_custkey", total="n")


def selected(rows: DataFrame, by: str, indices: list[int] | None = None, percent: float | None = None, limit: int | None = None) -> DataFrame:
    """Rows chosen by their place in the order of `by`: indices before percent (at least one row), percent before
    limit; without any, all."""
    placed = numbered(rows, by, name="place", total="rows")
    if indices is not None:
        return placed.where(F.col("place").isin(indices)).drop("place", "rows")
    if percent is not None:
        return placed.where(F.col("place") < F.greatest(F.lit(1), F.ceil(F.col("rows") * min(percent, 1.0)))).drop("place", "rows")
    return placed.where(F.lit(True) if limit is None else F.col("place") < limit).drop("place", "rows")


def index_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).where("i >= 10 and i < 60").select("c_custkey")


def percent_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selected(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"), "c_custkey", percent=0.1, limit=3)


def select_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selected(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"), "c_custkey", indices=[7, 0, 99, 10**9], percent=0.5)


def even_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.floor(F.ceil(F.col("i") * 25 / F.col("n").cast("double")) * F.col("n") / 25)
    return _customers(spark, sf_dir).where((F.col("n") <= 25) | (F.col("i") == step)).select("c_custkey")


def selected_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).select("c_custkey", (F.col("i") + 1).alias("selection_index"))


def sorted_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority", "o_totalprice")
    means = orders.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("mean"))
    deltas = orders.join(F.broadcast(means), "o_orderpriority").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") - F.col("mean")).alias("delta"))
    return numbered(deltas, "delta", "id").select("id", F.round("delta", 2).alias("delta"), (F.col("i") + 1).alias("rank"))


def box_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles from counts of distinct values, so that no group is held whole."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_returnflag").alias("method"), F.col("l_extendedprice").cast("double").alias("x"))
    values = lines.where("x is not null").groupBy("method", "x").agg(F.count(F.lit(1)).alias("k"))
    # ranges of values with their counts, then places within ranges: no window spans a group
    dealt = values.withColumn("part", range_of(F.col("x"), range_bounds(values, "x")))
    parts = dealt.groupBy("method", "part").agg(F.sum("k").alias("rows"))
    ranges = Window.partitionBy("method").orderBy("part")  # at most ranks.MOST_RANGES rows a method
    shifts = parts.select("method", "part", (F.sum("rows").over(ranges) - F.col("rows")).alias("shift"), F.sum("rows").over(Window.partitionBy("method")).alias("n"))
    upto = F.sum("k").over(Window.partitionBy("method", "part").orderBy("x"))
    placed = dealt.join(F.broadcast(shifts), ["method", "part"]).withColumn("last", F.col("shift") + upto - 1)
    rows = placed.withColumn("first", F.col("last") - F.col("k") + 1)
    at = lambda i: F.max(F.when((F.col("first") <= i) & (i <= F.col("last")), F.col("x")))
    def quartile(q: float):
        place = F.lit(q) * (F.col("n") - 1)
        a, b = at(F.floor(place)), at(F.ceil(place))
        return F.round(a + (b - a) * F.max(place - F.floor(place)), 4)
    quartiles = rows.groupBy("method").agg(*(quartile(q).alias(f"q{i}") for i, q in enumerate((0.25, 0.5, 0.75), 1)))
    means = lines.groupBy("method").agg(F.round(F.avg("x"), 4).alias("mean"))
    return means.join(quartiles, "method").select("method", "q1", "q2", "q3", "mean")


dataframe_query("index_range", index_range, f"SELECT c_custkey FROM ({_PLACES}) t WHERE i >= 10 AND i < 60")
dataframe_query("percent_sample", percent_sample, f"SELECT c_custkey FROM ({_PLACES}) t WHERE i + 1 <= greatest(1, ceil(n * CAST(0.1 AS DOUBLE)))")
dataframe_query("select_indices", select_indices, f"SELECT c_custkey FROM ({_PLACES}) t WHERE i IN (0, 7, 99, 1000000000)")
dataframe_query("even_downsample", even_downsample, f"SELECT c_custkey FROM ({_PLACES}) t WHERE n <= 25 OR i = floor(ceil(i * 25 / CAST(n AS DOUBLE)) * n / 25)")
dataframe_query("selected_index", selected_index, f"SELECT c_custkey, CAST(i + 1 AS BIGINT) AS selection_index FROM ({_PLACES}) t")
dataframe_query("sorted_delta", sorted_delta, "SELECT o_orderkey AS id, round(delta, 2) AS delta, row_number() OVER (ORDER BY delta, o_orderkey) AS rank FROM (SELECT o_orderkey, o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS delta FROM orders) t")
dataframe_query("box_stats", box_stats, "SELECT l_returnflag AS method, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.5), 4) AS q2, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3, round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY l_returnflag")
