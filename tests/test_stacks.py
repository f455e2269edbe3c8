"""Representatives, targets, contexts and handoffs on hard clusters, against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from killgrid.operators import stacks

SHAPE = "task long, cluster int, id long, features array<double>, signature array<int>, operator string, active boolean, change string, equivalence_status string"


def made(seed):
    r = random.Random(seed)
    rows = []
    for i in range(90):
        cluster = r.choice([None, 0, 0, 0, 1, 2, 40 + i])
        features = [r.choice([0.0, 1.0, r.random()]), 3.0, r.uniform(-5, 5)]
        rows.append((i % 3, cluster, i, features, r.choice([[], None, [0, 0, 1], [r.randrange(3) for _ in range(5)]]), r.choice(["A", "B", None]), r.random() < 0.5, f"c{i}", r.choice([None, "STATIC_EQUIVALENT"])))
    return rows


def entropy(sig):
    if not sig:
        return 0.0
    shares = [sig.count(x) / len(sig) for x in set(sig)]
    return round(0.7 * -sum(p * math.log2(p) for p in shares) / math.log2(3) + 0.3 * sum(x != 0 for x in sig) / len(sig), 6) + 0.0


def plain(rows):
    """(task, cluster) -> its members with centrality, information and place."""
    groups = {}
    for x in rows:
        groups.setdefault((x[0], x[1]), []).append(x)
    out = {}
    for key, own in groups.items():
        if key[1] is None:
            continue
        z = np.array([x[3] for x in own])
        sd = z.std(0)
        z = z / np.where(sd > 0, sd, 1)
        mean = np.sqrt(((z[:, None] - z) ** 2).sum(2)).mean(1)
        central = [1.0] if len(own) == 1 else [round(1 - m / max(mean.max(), 1e-9), 6) + 0.0 for m in mean]
        members = [(x, c, entropy(x[4])) for x, c in zip(own, central, strict=True)]
        short = sorted(members, key=lambda m: (-m[1], m[0][2]))[: max(1, math.ceil(len(own) * 0.4))]
        rate = lambda x: sum(v != 0 for v in x[4]) / len(x[4]) if x[4] else 0.0
        out[key] = members, [m[0][2] for m in sorted(short, key=lambda m: (-m[2], -m[1], -rate(m[0]), m[0][2]))]
    return out


@pytest.mark.parametrize("seed", range(2))
def test_stacks(spark, seed):
    rows = made(seed)
    own = stacks.representatives(stacks.centralities(spark.createDataFrame(rows, SHAPE).repartition(4)))
    got = {r.id: r for r in own.collect()}
    want = plain(rows)
    assert len(got) == len(rows)
    for x in rows:
        r = got[x[2]]
        if x[1] is None:
            assert (r.centrality, r.place, r.representative) == (None, None, False)
            continue
        members, places = want[x[0], x[1]]
        c, i = next((c, i) for m, c, i in members if m[2] == x[2])
        assert r.centrality == pytest.approx(c, abs=2e-6) and r.information == pytest.approx(i, abs=1e-6)
        assert r.place == (places.index(x[2]) + 1 if x[2] in places else None) and r.representative == (places[0] == x[2])

    live = {(r.task, r.cluster): (r.id, r.why) for r in stacks.targets(own).collect()}
    for key, (members, places) in want.items():
        active = [m for m in members if m[0][6]]
        if not active:
            assert key not in live
        elif any(m[0][2] == places[0] for m in active):
            assert live[key] == (places[0], "representative")
        else:
            best = min(active, key=lambda m: (-m[2], -m[1], -sum(v != 0 for v in m[0][4] or []), m[0][2]))
            assert live[key] == (best[0][2], "fallback")

    told = {(r.task, r.cluster): r for r in stacks.contexts(own).collect()}
    for key in {(x[0], x[1]) for x in rows}:
        mine = [x for x in rows if (x[0], x[1]) == key]
        alive = [x for x in mine if x[6]]
        names = sorted({x[5] or "" for x in alive})
        r = told[key]
        assert (r.size, r.surviving, r.distinct_signatures) == (len(mine), len(alive), len({tuple(x[4] or []) for x in alive}))
        assert r.operators == ",".join(f"{n}:{sum((x[5] or '') == n for x in alive)}" for n in names)

    chosen = stacks.targets(own).where("cluster = 0")
    hand = {r.task: r for r in stacks.handoff(own, chosen).collect()}
    for task in {x[0] for x in rows if x[6]}:
        r = hand[task]
        assert r.surviving == sum(x[6] for x in rows if x[0] == task) and r.clusters == sorted({x[1] for x in rows if x[0] == task and x[6] and x[1] is not None})
        assert len(r.sample) == len({x[1] for x in rows if x[0] == task and x[6] and x[1] != 0})
        kinds = {tuple(s.signature or []) for s in r.sample}
        assert len(kinds) > 1 or all(s.signature is None for s in r.sample)


def test_empty(spark):
    none = spark.createDataFrame([], SHAPE)
    own = stacks.representatives(stacks.centralities(none))
    assert own.count() == stacks.targets(own).count() == stacks.contexts(own).count() == stacks.handoff(own, stacks.targets(own)).count() == 0


def test_rules_and_values(spark):
    rows = spark.createDataFrame([(0, 5, 3), (4, 0, 3), (4, 0, 2), (4, 1, 2), (4, 1, 1), (4, 4, 3)], "after1 long, after2 long, max_layers int")
    assert [(r.layer2, r.layer3) for r in stacks.layer_rules(rows).collect()] == [("all_mutants_killed_by_layer1",) * 2, ("run", "all_mutants_killed_before_layer3"), ("run", "all_mutants_killed_before_layer3"), ("run", "max_layers_below_3"), ("max_layers_below_2", "max_layers_below_3"), ("run", "run")]
    hints = [("List[ str ]", '[]|["a"]|["a", "b"]'), ("Iterable[float]", "[]|[0.0]|[0.0, 1.0, -1.0]"), ("Optional[Tuple]", "()|(0,)|(0, 1)"), ("DICT", '{}|{"a": 1}|{0: 0, 1: 1}'), ("bool", "False|True"), ("x", '0|1|"a"|[0, 1]'), (None, '0|1|"a"|[0, 1]'), ("point", "0|1|-1|2")]
    got = spark.createDataFrame([(h,) for h, _ in hints], "h string").select(F.array_join(stacks.values_for_type(F.col("h")), "|").alias("v")).collect()
    assert [r.v for r in got] == [v for _, v in hints]
    flags = spark.createDataFrame([("b", ["a", "b", None]), (None, ["a", None]), ("z", ["a"]), ("a", [])], "v string, w array<string>").select(stacks.one_hot(F.col("v"), F.col("w")).alias("x")).collect()
    assert [r.x for r in flags] == [[0.0, 1.0, 0.0], [0.0, 1.0], [0.0], []]
