"""Intervals by numbered draws, and the registered tables that have them."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from killgrid import catalogue
from killgrid.operators import comparison, resampling
from killgrid.plans import facts

SF = "/root/testdata/sf0.01"


def mix(x):
    for _ in range(2):
        x = ((x ^ (x >> 16)) * 0x45D9F3B) % 2**32
    return x ^ (x >> 16)


def draw(b, block, number, size):
    return mix(mix(number) ^ mix(mix(42 + b) ^ block)) * size >> 32


@pytest.fixture(scope="module")
def units():
    r = random.Random(8)
    return [(f"T/{i}", r.gauss(10, 3), float(r.randrange(5))) for i in range(40)]


def test_every_replica_draws_n_by_number(spark, units):
    placed = sorted(units, key=lambda u: (hashlib.md5(u[0].encode()).hexdigest()[:13], u[0]))
    want = {}
    for b in range(30):
        rows = []
        dealt = [draw(b, 0, i, 40) // 7 for i in range(40)]
        for block in range(6):
            own = placed[block * 7 : block * 7 + 7]
            rows += [own[draw(b, block + 1, j, len(own))] for j in range(dealt.count(block))]
        want[b] = (40, sum(x[1] for x in rows), sum(x[2] for x in rows))
    frame = spark.createDataFrame(units, "unit string, x double, y double")
    for parts in (1, 5):
        got = {r.replica: (r.draws, r.x, r.y) for r in resampling.numbered_sums(frame.repartition(parts), "unit", ["x", "y"], 30, block=7).collect()}
        assert got.keys() == want.keys() and all(got[b] == pytest.approx(want[b]) for b in want)


def test_numbered_draws_agree_with_drawing_indices(spark):
    r = random.Random(4)
    rows = [(f"T/{i}", r.gauss(10, 3), r.randrange(1, 5)) for i in range(400)]
    x, y = np.array([q[1] for q in rows]), np.array([q[2] for q in rows])
    index = np.random.default_rng(5).integers(0, 400, (4000, 400))
    drawn = {"mean": x[index].mean(1), "ratio": x[index].sum(1) / y[index].sum(1)}
    statistics = {"mean": (F.col("v"), None), "ratio": (F.col("v"), F.col("w"))}
    frame = spark.createDataFrame(rows, "unit string, v double, w int")
    for block in (30, 1000):
        found = resampling.together(frame, "unit", statistics, 4000, block=block).first()
        assert found.n == 400
        for name, point in (("mean", x.mean()), ("ratio", x.sum() / y.sum())):
            low, high = np.percentile(drawn[name], [2.5, 97.5])
            near = (high - low) * 0.06  # Monte Carlo error of the ends of 4000 replicas
            assert found[name].estimate == pytest.approx(point) and abs(found[name].low - low) < near and abs(found[name].high - high) < near
    flat = resampling.together(frame, "unit", statistics, 0).first()
    assert all(flat[s].low == flat[s].high == flat[s].estimate for s in statistics)
    assert resampling.together(frame.where("false"), "unit", statistics, 20).first().n == 0


def test_rows_without_finite_values_count_nothing(spark):
    rows = [("a", 1.0, 2), ("b", float("nan"), 2), ("c", None, 2), ("d", 5.0, -1), ("e", 1.0, None)]
    frame = spark.createDataFrame(rows, "unit string, v double, w int")
    found = resampling.together(frame, "unit", {"mean": (F.col("v"), None), "ratio": (F.col("v"), F.col("w"))}, 50).first()
    assert found.mean.estimate == pytest.approx(7 / 3) and found.ratio.estimate == 0.5 == found.ratio.high
    one = resampling.together(frame.where("unit = 'a'"), "unit", {"mean": (F.col("v"), None)}, 50).first()
    assert one.mean.low == one.mean.high == one.mean.estimate == 1.0


def test_the_oracle_follows_blocks(spark, units, monkeypatch):
    monkeypatch.setattr(resampling, "NUMBERED", 7)
    monkeypatch.setattr(facts, "REPLICAS", 60)
    values = ", ".join(map(str, units))
    low, high = duckdb.execute(f"WITH {facts._drawn(f'SELECT * FROM (VALUES {values}) v(unit, x, y)', {'x': 'sum(x) / sum(y)'})} SELECT x_low, x_high FROM ends").fetchone()
    frame = spark.createDataFrame(units, "unit string, x double, y double")
    found = resampling.together(frame, "unit", {"x": (F.col("x"), F.col("y"))}, 60, block=7).first().x
    assert (round(found.low, 6), round(found.high, 6)) == (low, high) and low < found.estimate < high


@pytest.fixture(scope="module")
def scores(spark):
    return comparison.scores(facts.facts(spark, SF)).toPandas()


def _drawn(low, estimate, high, values):
    """An interval that is drawn: as wide as the mean's by its standard error, and around it."""
    wide = 2 * 1.96 * np.std(values) / len(values) ** 0.5
    assert low < estimate < high and high - low == pytest.approx(wide, rel=0.1)


def test_effectiveness_is_drawn(spark, scores):
    """ends were the estimate."""
    for r in catalogue.queries()["report_effectiveness_summary"](spark, SF).collect():
        m = r.method.removesuffix("_reference")
        _drawn(r.macro_raw_ci95_low, r.macro_raw, r.macro_raw_ci95_high, scores[f"{m}_score"])
        _drawn(r.macro_adjusted_ci95_low, r.macro_equivalent_adjusted, r.macro_adjusted_ci95_high, scores[f"{m}_equivalent_adjusted_score"])
        total = scores["total_mutants"]
        _drawn(r.micro_raw_ci95_low, r.micro_raw, r.micro_raw_ci95_high, (scores[f"{m}_killed"] - r.micro_raw * total) / total.mean())
        left = (total - scores["equivalent_mutants"]).clip(0)
        _drawn(r.micro_adjusted_ci95_low, r.micro_equivalent_adjusted, r.micro_adjusted_ci95_high, (scores[f"{m}_equivalent_adjusted_score"] - r.micro_equivalent_adjusted) * left / left.mean())


def test_agreement_is_drawn(spark, scores):
    """ends were the estimate."""
    columns = {"kill_agreement_accuracy": "proposed_kill_agreement_accuracy", "kill_precision": "kill_precision", "kill_recall": "kill_recall"}
    rows = {r.metric: r for r in catalogue.queries()["report_official_agreement_summary"](spark, SF).collect()}
    assert rows.keys() == {*columns, "kill_f1"} and rows["kill_f1"].ci95_low < rows["kill_f1"].mean < rows["kill_f1"].ci95_high
    for metric, column in columns.items():
        _drawn(rows[metric].ci95_low, rows[metric].mean, rows[metric].ci95_high, scores[column])


def test_paired_comparison_is_drawn(spark, scores):
    """ends were the estimate."""
    (r,) = catalogue.queries()["report_paired_comparison_summary"](spark, SF).collect()
    delta = scores["score_delta_proposed_minus_baseline"]
    _drawn(r.score_delta_ci95_low, r.mean_score_delta, r.score_delta_ci95_high, delta)
    parents = scores["parent_task_id"].where(scores["parent_task_id"] != "", scores["problem_id"])
    means = delta.groupby(parents).mean()
    assert r.parent_clustered_n == len(means)
    _drawn(r.parent_clustered_ci95_low, r.parent_clustered_mean_delta, r.parent_clustered_ci95_high, means)
