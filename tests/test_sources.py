"""Data source, loading with checks, documents of any shape, the exactly-once log."""

import json
import os

import pytest
from pyspark.sql import functions as F

from killgrid.sources import call_log, documents, loading, readers, task_folder
from killgrid.sources.shared import Files


# --- task folders -----------------------------------------------------------------------
@pytest.fixture
def shards(tmp_path):
    """Two subsets; the second's shards would end any FAILFAST read."""
    want = []
    for subset, n in (("easy set", 3), ("hard", 2)):
        os.makedirs(tmp_path / f"subset={subset}")
        for shard in range(n):
            with open(tmp_path / f"subset={subset}" / f"part-{shard}.json", "wb") as f:
                for i in range(50):
                    at = f.tell()
                    row = {"task_id": f"{subset}/{shard}/{i}", "prompt": "é" * (i % 7) + "x", "n": i if i % 5 else "many", "extra": [i], "canonical_solution": {"a": i} if i == 3 else None}
                    if subset == "hard" and i == 9:
                        f.write(b"{broken\r\n\n")
                        want.append((subset, f"part-{shard}.json", at, "{broken", None))
                        at = f.tell()
                    f.write(json.dumps(row, ensure_ascii=bool(i % 2)).encode() + (b"" if i == 49 else b"\n"))
                    want.append((subset, f"part-{shard}.json", at, None, row["task_id"]))
    (tmp_path / "_SUCCESS").write_text("")
    return str(tmp_path), want


@pytest.mark.parametrize("split", [1, 37, 1000, 1 << 20])
def test_ranges_read_each_line_once(spark, shards, split):
    folder, want = shards
    task_folder.register(spark)
    rows = spark.read.format("killgrid-tasks").option("splitBytes", split).load(folder)
    got = [(r.subset, r.shard, r.offset, r.fault, r.task_id) for r in rows.collect()] if split > 1 else [(r.subset, r.shard, r.offset, r.fault, r.task_id) for r in rows.where("shard = 'part-0.json' AND subset = 'hard'").collect()]
    key = lambda x: tuple(map(repr, x))
    assert sorted(got, key=key) == sorted(want if split > 1 else [w for w in want if w[:2] == ("hard", "part-0.json")], key=key)


def test_other_subsets_are_not_opened(spark, shards):
    folder, want = shards
    task_folder.register(spark)
    rows = task_folder.tasks(spark, f"file:{folder}", mode="FAILFAST")
    easy = rows.where("subset = 'easy set' AND task_id IS NOT NULL")
    assert easy.rdd.getNumPartitions() == 3 and easy.count() == 150
    assert rows.where(F.col("subset").isin("easy set", "none")).count() == 150
    assert spark.read.format("killgrid-tasks").option("subsets", "easy set").load(folder).rdd.getNumPartitions() == 3
    assert rows.where("subset = 'none'").count() == 0
    for _ in range(2):  # neither filter is left behind
        with pytest.raises(Exception, match="not a JSON object"):
            rows.count()
    assert easy.count() == 150


def test_types(spark, shards):
    folder, _ = shards
    task_folder.register(spark)
    rows = spark.read.format("killgrid-tasks").option("columns", "task_id string, n int, extra string, canonical_solution string, missing double").load(folder).where("subset = 'hard' AND shard = 'part-1.json'")
    got = {r.task_id: r for r in rows.collect()}
    assert got["hard/1/5"].n is None and got["hard/1/6"].n == 6 and got["hard/1/6"].extra == "[6]" and got["hard/1/3"].canonical_solution == '{"a": 3}' and got["hard/1/3"].missing is None


# --- loading ------------------------------------------------------------------------------
ROWS = "task_id string, prompt string, solution string, evoeval_subset string, libs string, doc_struct string, target string"
GOOD = [
    ("EvoEval/1", "def f(x):", "", "EvoEval-Tool Use", '["os", "re"]', '{"a": 1}', None),
    ("EvoEval/1", "def f(x):", "", "tool", None, "{}", None),
    ("EvoEval_creative/7", "", "  def g (y): pass", "  ", "bad", None, " "),
    ("x", "text", "", "Combine", "", "nothing", "h"),
]


def test_normalised(spark):
    rows = spark.createDataFrame([*GOOD, (" ", "p", "", "", "", "", "e"), ("a/2", "no function", None, None, None, None, "\t "), (None, None, None, None, None, None, None), ("z", " ", " ", "", "", "", "e")], ROWS)
    got = loading.tasks_of(rows).collect()
    assert [(r.task_id, r.source_task_id, r.parent_task_id, r.dataset_subset, r.entry_point, r.libs, r.fault) for r in got] == [
        ("EvoEval_tool_use/1", "EvoEval/1", "HumanEval/1", "tool_use", "f", ["os", "re"], None),
        ("EvoEval_tool_use/1", "EvoEval/1", "HumanEval/1", "tool_use", "f", [], None),
        ("EvoEval_creative/7", "EvoEval_creative/7", "HumanEval/7", "creative", "g", [], None),
        ("x", "x", "", "combine", "h", [], None),
        ("", "", "", "unknown", "e", [], "no id"),
        ("a/2", "a/2", "HumanEval/2", "unknown", "", [], "no entry point"),
        ("", "", "", "unknown", "", [], "no id"),
        ("z", "z", "", "unknown", "e", [], "neither prompt nor solution"),
    ]
    assert {r.dataset_name for r in got} == {"evoeval"} and {r.dataset_name for r in loading.tasks_of(rows, "mine").collect()} == {"mine"}
    meta = [r.metadata for r in loading.metadata(loading.tasks_of(rows)).collect()]
    assert [m.has_doc_struct for m in meta[:4]] == [True, False, False, False] and meta[0].libraries == ["os", "re"]


def test_dataset_names(spark):
    name = lambda columns, i: spark.range(1).select(loading.dataset_name(columns, F.lit(i)).alias("n")).first().n
    assert [name(["prompt"], "EvoEval/1"), name(["instruct_prompt"], "a"), name([], "BigCodeBench/1"), name([], "HumanEval/2"), name(["prompt"], "a"), name([], "a"), name(["evoeval_subset"], "a")] == ["evoeval", "bigcodebench", "bigcodebench", "humaneval", "humaneval", "generic", "evoeval"]


def test_load_publishes_or_refuses(spark, tmp_path):
    rows = spark.createDataFrame([GOOD[0], *GOOD[2:]], ROWS)
    loaded = loading.load(rows, f"{tmp_path}/tasks")
    assert sorted(r.task_id for r in loaded.collect()) == ["EvoEval_creative/7", "EvoEval_tool_use/1", "x"] and "fault" not in loaded.columns
    with pytest.raises(FileExistsError):
        loading.load(rows, f"{tmp_path}/tasks")
    bad = spark.createDataFrame([*GOOD, (None, "p", "", "", "", "", "e"), ("a/2", "no function", None, None, None, None, None)], ROWS)
    with pytest.raises(loading.Refused) as e:
        loading.load(bad, f"{tmp_path}/bad")
    assert e.value.counts == {"repeated": 1, "no_id": 1, "no_entry_point": 1} and "EvoEval_tool_use/1" in str(e.value)
    assert os.listdir(tmp_path) == ["tasks"]  # no table, no staging folder
    assert loading.load(rows.where("false"), f"{tmp_path}/none").count() == 0


def test_load_scans_once(spark, tmp_path):
    spark.createDataFrame([GOOD[0], *GOOD[2:]], ROWS).repartition(3).write.parquet(f"{tmp_path}/in")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.read.parquet(f"{tmp_path}/in")
    loading.load(rows.mapInArrow(counted, rows.schema), f"{tmp_path}/out")
    assert seen.value == 3


def test_missing_and_empty_files(spark, tmp_path):
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "some.csv").write_text("a,b,c\n1,x,7\nno,y,8\n")
    os.makedirs(tmp_path / "empty.parquet")
    shape = "a long, b string, d double"
    for name in ("gone.csv", "none.csv", "empty.parquet", "gone.json"):
        found = loading.read_or_empty(spark, f"{tmp_path}/{name}", shape)
        assert found.count() == 0 and found.dtypes == [("a", "bigint"), ("b", "string"), ("d", "double")]
    assert sorted(map(tuple, loading.read_or_empty(spark, f"{tmp_path}/some.csv", shape).collect()), key=repr) == [(1, "x", None), (None, "y", None)]
    with pytest.raises(FileNotFoundError):
        loading.load_file(spark, f"{tmp_path}/gone.csv", f"{tmp_path}/t")


# --- documents ----------------------------------------------------------------------------------
def test_documents_of_any_shape(spark, tmp_path):
    docs = {
        "a": {"problem_id": "A/1", "layers": [{"layer": "Layer1", "new_kills": 3, "total_tokens": "12"}, {"layer": "Layer2", "new_kills": "x", "mutation_score": 1}], "llm_calls": [{"attempt": 1, "model": "m"}], "timing": {"probing": 1.5, "note": "n/a"}, "metadata": {"mutant_count": 6, "layer1_clusters": [{"representative_ids": [1, 2]}, {"representative_ids": [3]}, {}], "iteration_history": [{"iteration": 1, "cumulative_score": 0.5}]}, "summary": {"final_score": 0.5}},
        "b": {"problem_id": 7, "layers": "none", "llm_calls": [3, {"attempt": 2.0}], "timing": [1], "metadata": None},
        "c": [1, 2],
    }
    for name, doc in docs.items():
        (tmp_path / f"{name}_metrics.json").write_text(json.dumps(doc))
    (tmp_path / "d_metrics.json").write_text('{"problem_id": "D", ')
    (tmp_path / "other.json").write_text("{}")
    found = documents.metric_documents(spark, str(tmp_path))
    assert sorted((r.problem_id or "", r.ok) for r in found.selectExpr("problem_id", "doc IS NOT NULL AS ok").collect()) == [("", False), ("", True), ("7", True), ("A/1", True)]
    assert [(r.problem_id, r.place, r.layer, r.new_kills, r.total_tokens, r.mutation_score) for r in documents.layers(found).orderBy("place").collect()] == [("A/1", 0, "Layer1", 3, 12, None), ("A/1", 1, "Layer2", None, None, 1.0)]
    assert sorted((r.method, r.problem_id, r.place, r.attempt) for r in documents.calls(found, found.where("problem_id = '7'")).collect() if r.attempt) == [("baseline", "7", 1, 2), ("proposed", "7", 1, 2), ("proposed", "A/1", 0, 1)]
    assert sorted((r.problem_id, r.stage, r.seconds) for r in documents.timings(found).collect()) == [("A/1", "note", None), ("A/1", "probing", 1.5)]
    assert [(r.iteration, r.cumulative_score) for r in documents.history(found).collect()] == [(1, 0.5)]
    clusters = {r.problem_id: r for r in documents.clusters(found).collect()}
    assert (clusters["A/1"].num_clusters, clusters["A/1"].representatives, clusters["A/1"].compression_ratio_mutants_per_representative) == (3, 3, 2.0) and clusters["7"].mean_cluster_size == 0.0
    assert [r.final_score for r in documents.summaries(found, {"final_score": "double"}).collect()] == [0.5]
    shape = documents.merged_schema(documents.parsed(spark.createDataFrame([('{"a": 1}',), ('{"a": 2.5, "b": "x"}',), ("{",), (None,)], "t string"), "t"), "doc").first().schema
    assert "a: DECIMAL" in shape and "b: STRING" in shape


# --- the log -----------------------------------------------------------------------------------------
def test_log_has_every_call_once(spark, tmp_path):
    folder, source = f"{tmp_path}/log", tmp_path / "in"
    os.makedirs(source)
    for i in range(4):
        (source / f"{i}.json").write_text("\n".join(json.dumps({"problem_id": f"p/{j % 3}", "layer": "Layer1", "attempt": 10 * i + j, "model": ["gpt-5", "gemini-x", "org/m"][j % 3], "provider": "" if j else "own", "prompt": "é\nx", "response": "r", "prompt_tokens": j}) for j in range(5)))
    stream = lambda: spark.readStream.schema(call_log.CALL).option("maxFilesPerTrigger", 1).json(str(source))
    failed = []

    def crash(batch):
        if batch == 2 and not failed:
            failed.append(batch)
            raise RuntimeError("between data and commit")

    with pytest.raises(Exception, match="between data and commit"):
        call_log.follow(stream(), folder, f"{tmp_path}/state", crash, True).awaitTermination()
    assert failed and call_log.read(spark, folder).count() == 10
    call_log.follow(stream(), folder, f"{tmp_path}/state", crash, True).awaitTermination()
    rows = call_log.read(spark, folder).collect()
    assert sorted(r.attempt for r in rows) == sorted(10 * i + j for i in range(4) for j in range(5)) and {r.batch for r in rows} == {0, 1, 2, 3}
    assert {(r.model, r.provider) for r in rows} == {("gpt-5", "own"), ("gpt-5", "openai"), ("gemini-x", "gemini"), ("org/m", "hf")}
    again = spark.createDataFrame([("p", 1)], "problem_id string, attempt long")
    whole = again.select(*(F.col(n) if n in again.columns else F.lit(None).cast(t).alias(n) for n, t in (c.split(" ") for c in call_log.CALL.split(", "))))
    assert call_log.append(whole, 3, folder) is False and call_log.read(spark, folder).count() == 20
    texts = {r.name: r.body for r in call_log.artefacts(spark, folder).collect()}
    assert len(texts) == 20 and texts["p_1/011_Layer1_gemini_gemini-x.txt"].splitlines()[:6] == ["problem_id: p/1", "layer: Layer1", "provider: gemini", "model: gemini-x", "status: ", "tokens: prompt=1, completion=0, thoughts=0, total=0"]
    assert "===== PROMPT =====\né\nx\n\n===== RAW LLM RESPONSE =====\nr\n" in texts["p_1/011_Layer1_gemini_gemini-x.txt"]
    assert call_log.sweep(spark, folder) == 2 and call_log.read(spark, folder).count() == 20
    assert call_log.read(spark, f"{tmp_path}/none").count() == 0 and call_log.artefacts(spark, f"{tmp_path}/none").count() == 0


def test_files_are_replaced_whole(spark, tmp_path):
    files = Files(spark, str(tmp_path))
    files.replace(f"{tmp_path}/x", "one")
    files.replace(f"{tmp_path}/x", "two")
    assert (tmp_path / "x").read_text() == "two" and not [n for n in os.listdir(tmp_path) if n.endswith(".new")]


def test_a_file_of_several_json_documents_is_read_whole(spark, tmp_path):
    folder = tmp_path / "rows.json"
    folder.mkdir()
    docs = [{"tasks": [{"task_id": f"T/{i}", "text": 'a } "{[ \\'} for i in range(n, n + 3)]} for n in (0, 3, 6)]
    (folder / "a").write_text("\n".join(json.dumps(d) for d in docs[:2]) + "\n")
    (folder / "b").write_text(json.dumps(docs[2], indent=1) + json.dumps([{"task_id": "T/9"}, {"task_id": "T/10"}]))
    got = readers.read_rows(spark, str(folder))
    assert sorted(r.task_id for r in got.collect()) == sorted(f"T/{i}" for i in range(11))
    assert {r.text for r in got.where("text is not null").collect()} == {'a } "{[ \\'}
    (folder / "b").write_text('{"tasks": []}, {"task_id": "T/9"}')
    with pytest.raises(Exception):  # noqa: B017  what is between documents is no document
        readers.read_rows(spark, str(folder)).collect()
