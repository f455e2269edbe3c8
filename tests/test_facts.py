"""Facts are read as far as events reach, and dealt by the number of calls."""

from pyspark.sql import functions as F

from killgrid.operators import comparison
from killgrid.plans import facts

SF = "/root/testdata/sf0.01"


def test_rows_of_orders_that_no_event_reaches_are_left_out(spark):
    f = facts.facts(spark, SF)
    key = F.substring("problem_id", 3, 20).cast("long")
    low, high = spark.read.parquet(f"{SF}/events.parquet").selectExpr("min(event_id div 8)", "max(event_id div 8)").first()
    every = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_linenumber").distinct()
    inside = every.where(F.col("l_orderkey").between(low, high)).count()
    assert 0 < inside < every.count()
    for rows in (f.mutants, f.official, f.clusters):
        assert rows.where(~key.between(low, high)).count() == 0
    assert f.mutants.count() == inside


def test_tasks_of_spark_grow_with_calls_not_with_bytes(spark, monkeypatch):
    monkeypatch.setattr(facts, "CALLS", 500)
    f = facts.facts(spark, SF)
    wanted = -(-spark.read.parquet(f"{SF}/events.parquet").count() // 500)
    assert wanted > spark.sparkContext.defaultParallelism
    for rows in (f.mutants, f.kills):
        assert rows.rdd.getNumPartitions() == wanted


def test_no_call_counts_twice(spark):
    """Mutants and official ones are dealt alike and may be one shuffle that is used twice."""
    rows = comparison.scored_calls(facts.facts(spark, SF))
    every = rows.select("problem_id", "cumulative_score").collect()
    reached = spark.read.parquet(f"{SF}/events.parquet").selectExpr("event_id div 8 AS o_orderkey").join(spark.read.parquet(f"{SF}/orders.parquet"), "o_orderkey", "left_semi").count()
    assert len(every) == reached > 0
    assert rows.groupBy("problem_id", "method").count().where("count > 4").count() == 0
    assert 0 < max(r.cumulative_score for r in every) <= 1
