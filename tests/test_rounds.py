"""Functions on code, generation rounds, result folders and the attempts stream."""

import json

from pyspark.sql import functions as F

from killgrid import catalogue
from killgrid.functions import code
from killgrid.operators import rounds
from killgrid.sources import results
from killgrid.streaming import plateau

CHECK = "def check(candidate):\n    assert candidate(3, 1) == 5\n    assert candidate(1, 2) == -1"
SOURCE = "def add(a, b):\n    if a > b and b != 0:\n        return a + b * 2\n    return a - b\n"


def test_checks_are_found_in_replies():
    assert code.extract_check(f"Sure.\n```python\n{CHECK}\n```\nBye") == CHECK
    assert code.extract_check(f"{CHECK}\nThat is all.") == CHECK
    assert code.extract_check(f"{CHECK}\n    broken (") == CHECK
    assert code.extract_check("") == code.extract_check(None) == code.extract_check("no check") == ""


def test_calls_and_arguments():
    assert code.call_texts(CHECK) == ["candidate(3, 1)", "candidate(1, 2)"]
    assert code.split_arguments("1, (2, 3), 'a,b', {4: 5, 6: 7}") == ["1", "(2, 3)", "'a,b'", "{4: 5, 6: 7}"]
    assert code.entry_calls("x = add(1, (2)) + add(')', 3)\ndef add(a, b): pass", "add") == ["1, (2)", "')', 3"]
    assert code.to_candidate("assert add(1) == add(2)", "add") == "assert candidate(1) == add(2)"
    assert code.argument_key("f(1,  [2,3])") == "(1, [2, 3])" and code.argument_key("f(x)") == ""
    assert code.parameters("def f(a: int, b): pass", "f") == [("a", "int"), ("b", "")]
    assert code.literal('{"a": 1}') == {"a": 1} and code.literal("(1, 2)") == (1, 2) and code.literal(" ", 0) == 0


def test_sources():
    assert code.compact_source('def f():\n    """Doc."""\n    return 1  # one') == "def f():\n    return 1"
    assert code.changed_lines("def f():\n    return 1", "def f():\n    return 2") == ("return 1", "return 2")
    assert code.compose_source("def f(x):", "return x", "f") == "def f(x):\n    return x\n"
    assert code.compose_source("def f(x):", "def f(x): return x", "f") == "def f(x): return x"
    assert code.task_text("", 'def f():\n    """What."""', "f") == "What."
    assert code.retry_seconds("please retry in 250ms") == 0.25 and code.retry_seconds("wait 5m") == 60 and code.retry_seconds("") == 5
    assert code.missing_libraries(["os", "no_such_library_x"]) == ["no_such_library_x"]
    space = {}
    exec(code.join_suite([CHECK, CHECK]), space)
    space["check"](lambda a, b: 5 if a == 3 else -1)
    space = {}
    exec(code.adapt_test("class T(unittest.TestCase):\n    def test(self):\n        self.assertEqual(candidate(), 1)\n"), space)
    space["check"](lambda: 1)
    try:
        space["check"](lambda: 2)
    except AssertionError:
        return
    raise AssertionError("a failing suite must fail the check")


def test_layers_stop_where_they_should(spark):
    rounds.register_provider("scripted", rounds.scripted(["nothing", CHECK]))
    tasks = spark.createDataFrame([("add", None, SOURCE, "add"), ("bad", "", "def (", "bad")], "problem_id string, prompt string, source string, entry string")
    layers = [rounds.Layer("Layer1", "scripted", attempts=3, patience=2), rounds.Layer("Layer2", "mock", attempts=2), rounds.Layer("Baseline", "mock", attempts=10, patience=3, method="baseline")]
    rows = rounds.run_layers(tasks, layers).collect()
    assert {r["problem_id"] for r in rows} == {"add"}
    first = [r["status"] for r in rows if r["layer"] == "Layer1"]
    assert first == ["REJECTED", "PRODUCTIVE", "REJECTED"]
    kills = [r["cumulative_kills"] for r in rows if r["method"] == "proposed"]
    assert kills == sorted(kills) and 0 < kills[-1] <= rows[0]["total"]
    assert [r["status"] for r in rows if r["layer"] == "Baseline"] == ["ZERO_GAIN"] * 3 or len([r for r in rows if r["layer"] == "Baseline"]) == 3
    assert rounds.run_layers(tasks.limit(0), layers).count() == 0


def test_failed_calls_end_a_layer_after_two(spark):
    def failing():
        def call(prompt, model, attempt):
            raise OSError("no route")

        return call

    rounds.register_provider("failing", failing)
    tasks = spark.createDataFrame([("add", "", SOURCE, "add")], "problem_id string, prompt string, source string, entry string")
    rows = rounds.run_layers(tasks, [rounds.Layer("Layer1", "failing", attempts=5)]).collect()
    assert [r["status"] for r in rows] == ["ERROR", "ERROR"] and rows[0]["reason"] == "no route"


def test_custom_queries_run(spark):
    for name in ("mock_round", "extract_check", "mutant_diffs"):
        assert catalogue.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_result_folders(spark, tmp_path):
    (tmp_path / "t1").mkdir()
    (tmp_path / "t1" / "final_mutants.json").write_text(json.dumps([{"mutant_id": "a", "status": "killed", "operator": ""}, {"mutant_id": "b", "problem_id": "p", "operator": "X"}]))
    (tmp_path / "a_metrics.json").write_text(json.dumps({"summary": {"score": 0.5}}))
    (tmp_path / "b_metrics.json").write_text("{broken")
    rows = {r["mutant_id"]: r for r in results.final_mutants(spark, str(tmp_path)).collect()}
    assert (rows["a"]["problem_id"], rows["a"]["operator"], rows["a"]["killed"]) == ("t1", "UNKNOWN", 1)
    assert (rows["b"]["problem_id"], rows["b"]["operator"], rows["b"]["killed"]) == ("p", "X", 0)
    assert [r["score"] for r in results.summaries(spark, str(tmp_path), "score double").collect()] == [0.5]
    a, b = spark.createDataFrame([(1, "x"), (None, "n")], "id int, v string"), spark.createDataFrame([(1, "y"), (2, "z"), (None, "m")], "id int, v string")
    assert sorted(r["v"] for r in results.merge_shards([a, b], ["id"]).collect()) == ["n", "x", "z"]
    results.write_json(a, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    assert "| " in results.report_markdown({"a": a})


def test_plateau_stream(spark, tmp_path):
    folder, state = tmp_path / "in", tmp_path / "state"
    folder.mkdir()
    def add(name, rows):
        (folder / name).write_text("\n".join(json.dumps(dict(zip(("problem_id", "attempt", "status", "new_kills"), r, strict=True))) for r in rows))
    def run():
        stream = plateau.plateaus(plateau.read_attempts(spark, str(folder))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(state)).trigger(availableNow=True).start()
        stream.awaitTermination(120)
        return sorted(tuple(r) for r in spark.read.schema(plateau.PLATEAU).parquet(str(tmp_path / "out")).where(F.col("problem_id") == "p").collect())

    add("1.json", [("p", 1, "ZERO_GAIN", 0), ("p", 0, "PRODUCTIVE", 3), (None, 0, "ZERO_GAIN", 0)])
    assert run() == [("p", 0, 3, 0, False), ("p", 1, 3, 1, False)]
    add("2.json", [("p", 2, "ERROR", None), ("p", 3, "ZERO_GAIN", 0)])
    assert run()[2:] == [("p", 2, 3, 1, False), ("p", 3, 3, 2, True)]
