"""Comparison rows and report tables where facts are missing, null, repeated or empty."""

import random
from dataclasses import replace

import pytest

from killgrid.operators import comparison, kill_sets, report_tables

SHAPES = {
    "tasks": "problem_id string, dataset_name string, dataset_subset string, source_task_id string, parent_task_id string",
    "mutants": "problem_id string, mutant long, operator string, equivalence_status string",
    "kills": "method string, problem_id string, attempt long, mutant long",
    "official": "problem_id string, mutant long",
    "calls": "method string, problem_id string, layer string, attempt long, provider string, model string, status string, target_count long, prompt_tokens long, completion_tokens long, total_tokens long, prompt_chars long, response_chars long, latency_sec double, estimated_cost_usd double, validation_reason string",
    "clusters": "problem_id string, num_clusters long, representatives long",
    "timings": "problem_id string, stage string, seconds double",
}


def call(method, task, layer, attempt, provider, status, tokens):
    return (method, task, layer, attempt, provider, "m" if attempt % 2 else None, status, 1, 1, tokens - 1, tokens, 10, 5, 0.5, tokens / 1000, "")


@pytest.fixture(scope="module")
def facts(spark):
    rows = {
        "tasks": [("A", "d", "easy", "", "P"), ("B", "d", None, "src", ""), ("C", "d", "easy", None, "P")],
        "mutants": [("A", i, "OP" if i else None, "STATIC_EQUIVALENT" if i == 3 else None) for i in range(4)] + [("B", 0, "X", "UNKNOWN"), ("Z", 9, "X", "UNKNOWN"), ("A", 1, "OP", None)],
        "kills": [("proposed", "A", 1, 0), ("proposed", "A", 2, 0), ("proposed", "A", 2, 1), ("baseline", "A", 2, 2), ("baseline", "Z", 1, 9), ("proposed", "A", None, 2), ("baseline", "A", 2, None)],
        "official": [("A", 0), ("A", 3), ("Z", 9)],
        "calls": [call("proposed", "A", "Layer1", 1, "openai", "PRODUCTIVE", 10), call("proposed", "A", "Layer2", 2, None, "PRODUCTIVE", 20), call("baseline", "A", "Baseline", 1, "hf", "REJECTED", 15), call("baseline", "A", "Baseline", 2, "openai", "PRODUCTIVE", 10), call("baseline", "A", "Baseline", 3, "openai", "ERROR", 100), call("baseline", "Z", "Baseline", 1, "openai", "PRODUCTIVE", 5)],
        "clusters": [("A", 2, 2)],
        "timings": [("A", "clustering_sec", 1.5), ("A", "other", None), ("Z", "clustering_sec", 9.0)],
    }
    return comparison.Facts(**{n: spark.createDataFrame(rows[n], s) for n, s in SHAPES.items()})


def test_rows(facts):
    got = {r.problem_id: r for r in comparison.compare(facts).collect()}
    assert sorted(got) == ["A", "B", "C"] and len(comparison.compare(facts).columns) == 58
    a, b = got["A"], got["B"]
    assert (a.total_mutants, a.proposed_killed, a.baseline_killed, a.official_killed, a.equivalent_mutants) == (4, 3, 1, 2, 1)
    assert (a.proposed_score, a.baseline_score, a.proposed_equivalent_adjusted_score, a.score_delta_proposed_minus_baseline) == (0.75, 0.25, 1.0, 0.5)
    assert (a.proposed_total_tokens, a.baseline_total_tokens, a.proposed_paid_tokens, a.baseline_paid_tokens) == (30, 125, 10, 110)
    # at 30 tokens the baseline has made two calls; of paid tokens, 10 are spent by the second one
    assert (a.baseline_score_at_matched_proposed_tokens, a.baseline_score_at_matched_proposed_paid_tokens) == (0.25, 0.25)
    assert (a.baseline_first_final_score_iteration, a.baseline_tokens_at_first_final_score, a.baseline_first_plateau_iteration, a.baseline_tokens_at_plateau) == (2, 25, 1, 15)
    assert (a.final_layer_used, a.layer2_used, a.layer3_used, a.layer1_new_kills, a.layer2_new_kills, a.proposed_providers, a.proposed_models) == (2, True, False, 1, 1, "openai", "m")
    assert (a.source_task_id, a.cluster_compression_ratio, a.proposed_kill_agreement_accuracy) == ("A", 2.0, 0.25)
    assert (b.total_mutants, b.proposed_score, b.proposed_llm_calls, b.final_layer_used, b.dataset_subset, b.source_task_id, b.baseline_score_at_matched_proposed_tokens) == (1, 0.0, 0, 0, "", "src", 0.0)
    assert got["C"].total_mutants == 0 and got["C"].source_task_id == "C"


def test_tables(facts):
    made = {n: build().collect() for n, build in report_tables.tables(facts, 5).items()}
    assert len(made) == 17
    (pair,) = made["paired_comparison_summary"]
    assert (pair.n_tasks, pair.wins, pair.ties, pair.losses, pair.p_value, pair.parent_clustered_n) == (3, 1, 2, 0, 1.0, 2)
    assert {r.dataset_subset: r.n_tasks for r in made["evoeval_subset_paired_comparison"]} == {"easy": 2, "unknown": 1}
    assert {r.operator: (r.total_mutants, r.killed_mutants) for r in made["operator_difficulty_summary"]}["UNKNOWN"] == (1, 1)
    assert [(r.problem_id, r.clustering_sec, r.probe_generation_sec) for r in made["runtime_breakdown_per_task"]] == [("A", 1.5, 0.0)]
    assert {(r.method, r.provider) for r in made["llm_usage_summary"]} == {("proposed", "openai"), ("proposed", "unknown"), ("baseline", "hf"), ("baseline", "openai")}
    assert [(r.iteration, r.streak) for r in sorted(made["baseline_iteration_history"], key=lambda r: r.iteration)] == [(1, 1), (2, 0), (3, 0)]
    for r in made["effectiveness_summary"]:
        assert r.macro_raw_ci95_low <= r.macro_raw <= r.macro_raw_ci95_high


def test_no_facts(spark):
    none = comparison.Facts(**{n: spark.createDataFrame([], s) for n, s in SHAPES.items()})
    made = {n: build().count() for n, build in (report_tables.tables(none, 5) | report_tables.frames(none)).items()}
    assert sum(made.values()) <= 2, made  # at most a row of an aggregate over nothing


def test_calls_are_read_once(facts, spark, tmp_path):
    """Each reading of the calls is a shuffle of all of them."""
    facts.calls.write.parquet(f"{tmp_path}/calls_table")
    stored = replace(facts, calls=spark.read.parquet(f"{tmp_path}/calls_table"))
    plan = comparison.compare(stored)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("validation_reason") == plan.count("Relation [method") == 1
    key = lambda rows: sorted(map(str, rows.collect()))
    assert key(comparison.compare(stored)) == key(comparison.compare(facts))


def test_tables_of_scores_read_no_calls(facts):
    """What kills alone decide is the same without a single call at hand."""
    whole, alone = report_tables.tables(facts, 0), report_tables.tables(replace(facts, calls=None), 0, alone=True)
    for name in ("effectiveness_summary", "official_agreement_summary", "paired_comparison_summary", "evoeval_subset_paired_comparison", "aggregate_score_conventions"):
        assert sorted(map(str, whole[name]().collect())) == sorted(map(str, alone[name]().collect())), name


def test_calls_meet_their_kills(spark):
    """Against kill_sets.progress, with repeated and missing attempts, kills of calls that aren't listed, and tables dealt alike."""
    rng = random.Random(3)
    pick = lambda *values: rng.choice(values)
    tasks = [f"T{i}" for i in range(40)]
    rows = {
        "tasks": [(t, "d", None, "", "") for t in tasks[:35]],
        "mutants": [(t, m, "X", None) for t in tasks for m in rng.sample(range(-80, 200), 20)],
        "kills": [(pick("proposed", "baseline"), pick(*tasks), pick(None, 1, 2, 3, 4, 5), rng.randrange(-80, 200)) for _ in range(900)],
        "official": [(t, rng.randrange(-80, 200)) for t in tasks for _ in range(3)],
        "calls": [call(m, t, "Layer1", pick(1, 2, 3, 5), "hf", "PRODUCTIVE", 10) for t in tasks for m in comparison.METHODS for _ in range(4)],
        "clusters": [], "timings": [],
    }
    made = {n: spark.createDataFrame(rows[n], s) for n, s in SHAPES.items()}
    dealt = {n: df.repartition(7, "problem_id") for n, df in made.items()}
    got = comparison.scored_calls(comparison.Facts(**dealt, parts=7))
    two = spark.createDataFrame([(m,) for m in comparison.METHODS], "method string")
    keys = ["method", "problem_id", "attempt"]
    steps = kill_sets.progress(made["calls"], made["kills"], made["official"].crossJoin(two), made["mutants"].crossJoin(two), keys[:2], "attempt").selectExpr(*keys, "kills", "new", "cumulative", "round(cumulative / (cumulative + left), 6) AS score")
    want = made["calls"].join(steps, keys).join(made["tasks"].select("problem_id"), "problem_id", "left_semi")
    names = ["killed_mutants", "new_kills", "cumulative_kills", "cumulative_score"]
    assert sorted(map(tuple, got.select(*keys, *names).collect())) == sorted(map(tuple, want.select(*keys, "kills", "new", "cumulative", "score").collect()))
    assert got.count() == 35 * 8
