"""Places over a whole table: ties, nulls, one value only, empty tables."""

import random

import duckdb
import pytest

from killgrid import catalogue
from killgrid.operators.ranks import numbered
from killgrid.plans.ordered import selected


@pytest.mark.parametrize("values", [[], [5.0] * 40, [None, None, 1.0], [random.Random(1).choice([None, 1.5, -2.0, 7.0, 1e9]) for _ in range(300)], list(range(500))])
def test_numbered(spark, values):
    rows = [(i, None if v is None else float(v)) for i, v in enumerate(values)]
    random.Random(2).shuffle(rows)
    got = numbered(spark.createDataFrame(rows, "id long, v double").repartition(7), "v", "id", total="n", range_rows=40).collect()
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0.0, r[0]))
    assert [(r.id, r.v) for r in sorted(got, key=lambda r: r.i)] == want and [r.i for r in sorted(got, key=lambda r: r.i)] == list(range(len(rows)))
    assert all(r.n == len(rows) for r in got)


def test_selection_precedence(spark):
    rows = spark.range(10).repartition(3)
    ids = lambda **how: sorted(r.id for r in selected(rows, "id", **how).collect())
    assert ids(indices=[8, 1], percent=0.5, limit=1) == [1, 8] and ids(percent=0.01, limit=5) == [0] and ids(percent=7.0) == list(range(10))
    assert ids(limit=4) == [0, 1, 2, 3] and ids() == list(range(10)) and ids(percent=0.25) == [0, 1, 2]


@pytest.mark.parametrize("name", ["index_range", "percent_sample", "select_indices", "even_downsample", "selected_index", "sorted_delta", "box_stats"])
def test_whole_tables(spark, name):
    duck = duckdb.connect()
    for t in ("customer", "orders", "lineitem"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    got = catalogue.queries()[name](spark, "/root/testdata/sf0.01")
    want = duck.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(want.fetchall())
