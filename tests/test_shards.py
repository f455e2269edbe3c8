"""States of all shards at once are the states of each, and no row is sorted for them."""

import re

from pyspark.sql import functions as F

from killgrid.operators import shards
from killgrid.plans import stores

WHAT = {"sums": {"n": ("k", "*"), "v": ("k", "v")}, "sets": {"ks": "k"}, "settings": {"s": ("k", "t", "at")}, "sketches": {"d": "d"}}


def test_all_shards_at_once(spark):
    rows = spark.createDataFrame([(i, None if i % 11 == 0 else f"k{i % 3}", None if i % 7 == 0 else i, str(i % 5), i // 20, float("nan") if i % 13 == 0 else i / 3 - 4) for i in range(200)], "i int, k string, v int, t string, n int, d double").withColumn("at", F.when(F.col("i") % 9 > 0, F.timestamp_seconds("n")))
    got = shards.states(rows, F.concat(F.lit("s"), F.col("i") % 4), F.col("i") % 2, **WHAT)
    want = [r for j in range(4) for r in shards.state(rows.where(F.col("i") % 4 == j), f"s{j}", j % 2, **WHAT).collect()]
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want))
    last = {r.key: r.value for r in got.where("kind = 'setting' AND shard = 's1'").collect()}
    own = [r for r in rows.collect() if r.i % 4 == 1 and r.k and r["at"]]
    assert last == {k: max((r["at"], r.t) for r in own if r.k == k)[1] for k in {r.k for r in own}}


def test_states_sort_no_rows_and_read_the_table_a_fixed_number_of_times(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(stores.facts, "kept", lambda df, name: seen.append(df) or df)
    stores.merged_shards(spark, "/root/testdata/sf0.01")
    plan = seen[0]._jdf.queryExecution().sparkPlan().toString()
    assert len(re.findall("FileScan", plan)) == 3
    # the greatest value among the entries of the last time is text, and sorts those alone
    assert plan.count("SortAggregate") == 2
