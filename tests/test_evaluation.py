"""Kill sets, as-of joins, sign tests, ranks and intervals against plain Python; hard keys included."""

import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from killgrid.functions.binomial import two_sided_sign_test
from killgrid.operators import asof, kill_sets, ranks, resampling
from killgrid.plans import evaluation


def rows_of(df):
    return [tuple(r) for r in df.collect()]


KEYS = "task string, mutant long"


def some_kills(r, n, tasks=("a", "b", None, "hot")):
    number = lambda: r.choice([None, 0, 1, 63, 64, 65, -1, 10**12, r.randrange(200)])
    return [(r.choice(tasks), number()) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_meeting(spark, seed):
    r = random.Random(seed)
    ours, theirs, mutants = some_kills(r, 120), some_kills(r, 80 if seed else 0, ("a", None, "only theirs")), some_kills(r, 300, ("a", "b", "quiet", None))
    frames = [spark.createDataFrame(x, KEYS) for x in (ours, theirs, mutants)]
    sets = [defaultdict(set) for _ in range(3)]
    for s, rows in zip(sets, (ours, theirs, mutants), strict=True):
        for task, m in rows:
            if m is not None:
                s[task].add(m)
    want = set()
    for task in {t for s in sets for t in s}:
        a, b, every = (s[task] for s in sets)
        whole = a | b | every
        want.add((task, len(whole), len(a & b), len(a - b), len(b - a), len(whole - a - b)))
    assert set(rows_of(kill_sets.meeting(*frames, ["task"]))) == want


@pytest.mark.parametrize("seed", range(3))
def test_progress(spark, seed):
    r = random.Random(seed)
    kills = [(t, m, r.choice([1, 2, 3, 7])) for t, m in some_kills(r, 300)]
    official, mutants = some_kills(r, 100), some_kills(r, 200)
    attempts = [(t, a) for t in ("a", "b", None, "none") for a in (1, 2, 3, 4)] + [("a", 1)]
    got = kill_sets.progress(spark.createDataFrame(attempts, "task string, attempt int"), spark.createDataFrame(kills, KEYS + ", attempt int"), spark.createDataFrame(official, KEYS), spark.createDataFrame(mutants, KEYS), ["task"], "attempt")
    want = set()
    for task, attempt in set(attempts):
        of = lambda rows: {x[1] for x in rows if x[0] == task and x[1] is not None}
        now = {m for t, m, a in kills if t == task and a == attempt and m is not None}
        before = {m for t, m, a in kills if t == task and a < attempt and m is not None}
        goal = of(official)
        total = of(mutants) | goal
        want.add((task, attempt, len(now), len(now - before), len(now & before), len(now | before), len(now & goal), len(goal - now - before), len(total) - len(now | before)))
    assert set(rows_of(got)) == want


def test_labels(spark):
    mutants = spark.createDataFrame([("a", 1, None, None), ("a", 2, ["x"], "KILLED"), ("a", 64, ["L1"], None), (None, 1, [], "SURVIVED"), ("b", None, None, None)], KEYS + ", kill_tests array<string>, status string")
    kills = spark.createDataFrame([("a", 64), ("a", 64), (None, 1), ("b", None), ("c", 1)], KEYS)
    got = {(r.task, r.mutant): (r.kill_tests, r.status) for r in kill_sets.labelled(mutants, kills, ["task"], "L1").collect()}
    assert got == {("a", 1): ([], "SURVIVED"), ("a", 2): (["x"], "KILLED"), ("a", 64): (["L1"], "KILLED"), (None, 1): (["L1"], "KILLED"), ("b", None): ([], "SURVIVED")}


@pytest.mark.parametrize("seed,best", [(0, None), (1, None), (2, "v"), (3, "v")])
def test_asof(spark, seed, best):
    r = random.Random(seed)
    time = lambda: r.choice([None, float(r.randrange(40))])
    keys = ["k", None, *["hot"] * 8]
    right = [(r.choice(keys), time(), r.randrange(9), r.choice("ab")) for _ in range(400)]
    left = [(r.choice([*keys, "lonely"]), time(), i) for i in range(300)]
    left += left[:10]
    want = []
    for k, t, i in left:
        seen = [(a, v, w) for q, a, v, w in right if q == k and a is not None and t is not None and a <= t]
        row = max(((v, w) for _, v, w in seen) if best else seen, default=None)
        want.append((k, t, i, *((row if best else row[1:]) if row else (None, None))))
    for size in (7, 10**6, None):
        got = asof.asof(spark.createDataFrame(left, "k string, t double, range long"), spark.createDataFrame(right, "k string, t double, v long, w string"), ["k"], "t", ["v", "w"], best, range_rows=size)
        key = lambda x: tuple(map(repr, x))
        assert sorted(rows_of(got), key=key) == sorted(want, key=key)
    assert asof.asof(spark.createDataFrame([], "k string, t double"), spark.createDataFrame(right, "k string, t double, v long, w string"), ["k"], "t", ["v"]).count() == 0


def exact_p(w, losses):
    n, k = w + losses, min(w, losses)
    tail = sum(math.comb(n, i) for i in range(k + 1))
    return 1.0 if 2 * tail >= 2**n else 2 * tail / 2**n  # whole numbers, divided once


def test_sign_test(spark):
    r = random.Random(1)
    pairs = [(w, n - w) for n in range(0, 60) for w in range(n + 1)] + [(w, n - w) for n in (100, 333, 999, 1500, 2000) for w in [n // 2, n // 2 - 1, *(r.randrange(n + 1) for _ in range(20))]]
    big = [(10**9 // 2 - 40_000, 10**9 // 2 + 40_000), (499_999_999, 500_000_001), (5 * 10**8, 5 * 10**8), (0, 10**9)]
    got = spark.createDataFrame(pairs + big, "w long, l long").select("w", "l", two_sided_sign_test(F.col("w"), F.col("l")).alias("p")).collect()
    for x in got[: len(pairs)]:
        want = exact_p(x.w, x.l)
        assert x.p == pytest.approx(want, rel=1e-9, abs=1e-300), (x.w, x.l)
    # for 10^9, the normal limit with a correction for continuity
    for x in got[len(pairs) : len(pairs) + 2]:
        z = (abs(x.w - x.l) - 1) / math.sqrt(x.w + x.l)
        assert x.p == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-5)
    assert [x.p for x in got[len(pairs) + 2 :]] == [1.0, 0.0]


@pytest.mark.parametrize("seed", range(2))
def test_tied_ranks_and_effect(spark, seed):
    r = random.Random(seed)
    d = [0.5 if i % 2 else r.choice([0.0, -0.5, 1e-13, r.uniform(-3, 3), round(r.uniform(-1, 1), 1)]) for i in range(600)]
    sizes = sorted(abs(x) for x in d if abs(x) > 1e-12)
    rank = {v: sizes.index(v) + 1 + (sizes.count(v) - 1) / 2 for v in set(sizes)}
    values = spark.createDataFrame([(v, sizes.count(v)) for v in rank], "size double, times long")
    for ranges in (5, 10**6):
        assert {x["size"]: x["mean_rank"] for x in ranks.tied_ranks(values, "size", "times", ranges).collect()} == rank
    got = evaluation.effect_sizes_of(spark.createDataFrame([(x,) for x in d] + [(None,)], "d double")).first()
    up, down = sum(rank[abs(x)] for x in d if x > 1e-12), sum(rank[abs(x)] for x in d if x < -1e-12)
    assert got.rank_biserial == round((up - down) / (up + down), 6)
    assert got.dz == pytest.approx(np.mean(d) / np.std(d, ddof=1), abs=1e-6)
    assert tuple(evaluation.effect_sizes_of(spark.createDataFrame([(0.0,)], "d double")).first()) == (None, None)


def test_no_window_in_one_task(spark):
    plan = evaluation.effect_sizes_of(spark.range(100).selectExpr("cast(id - 50 AS double) AS d"))._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.splitlines() if " Window [" in x]
    # functions, partition, order
    assert windows and all(re.search(r"\], \[.+\], \[.+\]$", x.rstrip()) for x in windows)


def test_every_replica_draws_n(spark):
    r = random.Random(3)
    values = [("a", float(r.randrange(30)), 1.0) for _ in range(900)] + [("b", r.random(), 2.0) for _ in range(300)] + [("one", 4.0, 1.0)]
    units = spark.createDataFrame(values, "group string, num double, den double")
    first = {(x.group, x.replica): (x.num, x.den, x.draws) for x in resampling.replica_sums(units.repartition(7), 50, block_size=20).collect()}
    size = {"a": 900, "b": 300, "one": 1}
    assert len(first) == 150 and all(x[2] == size[g] for (g, _), x in first.items())
    assert all(x[1] == pytest.approx(2.0 * 300) for (g, _), x in first.items() if g == "b")
    again = {(x.group, x.replica): (x.num, x.den, x.draws) for x in resampling.replica_sums(units.repartition(2), 50, block_size=20).collect()}
    assert all(again[k] == pytest.approx(v) for k, v in first.items())


def test_intervals_agree_with_drawing_indices(spark):
    r = random.Random(4)
    rng = np.random.default_rng(5)
    v = [r.gauss(10, 3) for _ in range(400)]
    w = [r.randrange(1, 5) for _ in range(400)]
    rows = spark.createDataFrame([("s", a, b, "" if i % 40 == 0 else f"c{i % 37}") for i, (a, b) in enumerate(zip(v, w, strict=True))] + [("s", float("nan"), 1, "c1"), ("s", None, 1, "c1"), (None, 2.0, 1, None)], "g string, v double, w int, c string")
    x, y = np.array(v), np.array(w)
    index = rng.integers(0, 400, (4000, 400))
    units = [np.mean([v[i] for i in range(400) if i % 40 and i % 37 == c]) for c in range(37)] + [v[i] for i in range(0, 400, 40)]
    drawn = {"mean": x[index].mean(1), "ratio": x[index].sum(1) / y[index].sum(1), "clustered": np.array(units)[rng.integers(0, len(units), (4000, len(units)))].mean(1)}
    point = {"mean": x.mean(), "ratio": x.sum() / y.sum(), "clustered": np.mean(units)}
    for way, how in {"mean": {}, "ratio": {"den": "w"}, "clustered": {"cluster": "c"}}.items():
        got = {q.g: q for q in resampling.intervals(rows, ["g"], "v", replicas=4000, block_size=30, **how).collect()}
        low, high = np.percentile(drawn[way], [2.5, 97.5])
        near = (high - low) * 0.06  # Monte Carlo error of the ends of 4000 replicas
        assert got["s"].estimate == pytest.approx(point[way]) and abs(got["s"].low - low) < near and abs(got["s"].high - high) < near
        assert got["s"].n == (len(units) if way == "clustered" else 400)
        assert got[None].low == got[None].high == got[None].estimate == 2.0
    flat = resampling.intervals(rows, ["g"], "v", replicas=0).where("g = 's'").first()
    assert flat.low == flat.high == flat.estimate
    assert resampling.intervals(rows.where("false"), ["g"], "v").count() == 0
