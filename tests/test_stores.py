"""Published sets, merged shards, and the queries that go through a store at a larger size."""

import json
import random
from datetime import datetime
from functools import reduce

import duckdb
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from killgrid import catalogue
from killgrid.operators import shards
from killgrid.plans import stores
from killgrid.sources import documents, publish, results

SF = "/root/testdata/sf0.001"


def test_a_set_is_seen_whole_or_not(spark, tmp_path):
    folder = str(tmp_path)
    rows = spark.createDataFrame([(1, 0.1, None, datetime(2024, 1, 1, 0, 0, 0, 123456), True), (2, float("nan"), "", None, None), (3, 1e300, 'a "quoted", line\nand another', datetime(1999, 12, 31), False)], "i long, d double, s string, t timestamp, b boolean")
    assert publish.current(spark, folder) is None
    first = publish.publish(spark, {"one": lambda: rows, "none": lambda: rows.where("false")}, folder)
    back = publish.read(spark, folder, "one")
    assert back.dtypes == rows.dtypes and sorted(map(repr, back.collect())) == sorted(map(repr, rows.collect()))
    assert publish.read(spark, folder, "none").count() == 0

    def killed():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        publish.publish(spark, {"one": lambda: rows.where("i = 1"), "none": killed}, folder)
    assert publish.current(spark, folder)["set"] == first and publish.read(spark, folder, "one").count() == 3
    held = publish.current(spark, folder)
    second = publish.publish(spark, {"one": lambda: rows.where("i = 1")}, folder, {"why": "again"})
    now = publish.current(spark, folder)
    assert now["set"] == second and now["about"] == {"why": "again"} and now["tables"]["one"]["rows"] == 1
    assert publish.read(spark, folder, "one").count() == 1 and publish.read(spark, folder, "one", held).count() == 3
    with pytest.raises(FileNotFoundError):
        publish.read(spark, folder, "none")
    assert len(publish.sweep(spark, folder)) == 2 and publish.read(spark, folder, "one").count() == 1
    assert "`one` (1 rows): i, d, s, t, b" in (tmp_path / second / "index.md").read_text()


def test_published_reports_equal_their_queries(spark, tmp_path):
    """All 17 tables of one set, with intervals drawn."""
    stores.publish_reports(spark, SF, str(tmp_path), replicas=20)
    manifest = publish.current(spark, str(tmp_path))
    assert len(manifest["tables"]) == 17 and manifest["about"] == {"replicas": 20}
    for name in ("baseline_iteration_history", "llm_usage_summary", "conservative_equivalent_mutants", "evoeval_subset_summary"):
        got = sorted(map(repr, publish.read(spark, str(tmp_path), name).collect()))
        assert got == sorted(map(repr, catalogue.queries()[f"report_{name}"](spark, SF).collect()))
    ends = publish.read(spark, str(tmp_path), "effectiveness_summary").collect()
    assert all(r.macro_raw_ci95_low < r.macro_raw < r.macro_raw_ci95_high for r in ends)


@pytest.mark.parametrize("n", [1, 3, 7])
def test_shards_in_any_order_and_once(spark, n):
    r = random.Random(n)
    rows = [(i, r.choice(["a", "b", None]), r.choice([None, 1, 5, -2]), r.choice(["x", "y", None]), datetime(2024, 1, r.randrange(1, 5)), r.choice([None, 0.0, -1.0, r.lognormvariate(3, 2)])) for i in range(400)]
    frame = spark.createDataFrame(rows, "i long, k string, n long, v string, t timestamp, d double")
    what = {"sums": {"rows": ("k", "*"), "n": ("k", "n")}, "sets": {"v": "v"}, "settings": {"s": ("k", "v", "t")}, "sketches": {"d": "d"}}
    states = [shards.state(frame.where(F.col("i") % n == j), f"s{j}", 1, **what) for j in range(n)]
    whole = sorted(map(tuple, shards.merge(states[0] if n == 1 else shards.state(frame, "all", 1, **what)).collect()), key=repr)
    for _ in range(2):
        r.shuffle(states)
        # one shard again, and an attempt that was given up before
        more = [*states, states[0], shards.state(frame.where("i < 50"), "s0", 0, **what)]
        merged = shards.merge(reduce(DataFrame.unionByName, more))
        assert sorted(map(tuple, merged.collect()), key=repr) == whole
    values = sorted(x[5] for x in rows if x[5] is not None)
    got = {x.share: x.value for x in shards.quantiles(merged, "d", [0.0, 0.5, 0.9, 1.0]).collect()}
    for share, value in got.items():
        true = values[max(0, -int(-share * len(values) // 1) - 1)]
        assert value == pytest.approx(true, rel=0.0101) or true <= 0 and value == 0


@pytest.mark.parametrize("name", ["folder_tasks", "document_fields", "document_counts", "replayed_log"])
def test_larger_tables(spark, name):
    duck = duckdb.connect()
    for t in ("customer", "orders", "events"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    want = duck.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = catalogue.queries()[name](spark, "/root/testdata/sf0.01")
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_mutants_and_clusters_are_read_again(spark, tmp_path):
    mutants = spark.createDataFrame([("m1", "a/1", "OP", "KILLED", 3, 0), ("m2", None, None, None, None, None)], results.MUTANT)
    results.save_mutants(mutants, f"{tmp_path}/mutants")
    assert sorted(map(repr, results.load_mutants(spark, f"{tmp_path}/mutants").collect())) == sorted(map(repr, mutants.collect()))
    stacks = spark.createDataFrame([("t", 0, 5, 2, False), ("t", 0, 9, 1, True), ("t", 0, 1, None, False), ("t", 1, 2, 1, True), (None, None, 3, None, False)], "task string, cluster int, id long, place int, representative boolean")
    results.save_clusters(stacks, f"{tmp_path}/clusters")
    got = {(r.problem_id, r.cluster_id): (r.members, r.representative_ids, r.strategy) for r in results.load_clusters(spark, f"{tmp_path}/clusters").collect()}
    assert got == {("t", 0): (["9", "5", "1"], ["9"], "UBIG-RS"), ("t", 1): (["2"], ["2"], "UBIG-RS"), (None, None): (["3"], [], "UBIG-RS")}


def test_documents_of_tasks_without_calls(spark):
    """Every task has a document, with empty lists where a fact lacks it."""
    tasks = spark.createDataFrame([("A", "d", None, "", ""), ("B", "d", "s", "", "p")], "problem_id string, dataset_name string, dataset_subset string, source_task_id string, parent_task_id string")
    calls = spark.createDataFrame([("A", 1, "Layer1", 5, True, 2)], "problem_id string, attempt long, layer string, total_tokens long, paid boolean, cumulative_kills long").selectExpr("*", *(f"cast(null as {t}) AS {c}" for c, t in documents.CALL.items() if c not in ("attempt", "layer", "total_tokens")))
    none = lambda shape: spark.createDataFrame([], shape)
    docs = documents.tracker_documents(tasks, calls, none("problem_id string, stage string, seconds double"), none("problem_id string, num_clusters long, representatives long"), spark.createDataFrame([("A", 4)], "problem_id string, total_mutants long"))
    got = {r.problem_id: json.loads(r.body) for r in docs.collect()}
    assert got["B"]["layers"] == got["B"]["llm_calls"] == [] and got["B"]["summary"]["final_score"] == 0.0
    assert got["A"]["summary"] == {"problem_id": "A", "total_mutants": 4, "killed_mutants": 2, "total_tokens": 5, "final_score": 0.5} and got["A"]["layers"][0]["layer"] == "Layer1" and got["A"]["paid_api_tokens"] == 5
