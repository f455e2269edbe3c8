"""The 17 report tables, each from the facts or from comparison rows (comparison.py), under the names they are
published by. Intervals are bootstrapped (resampling.py); with replicas 0 their ends are the estimate."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binomial import two_sided_sign_test
from . import ranks, resampling
from .comparison import METHODS, Facts, baseline_history, compare, scored_calls, scores, share

_STAGES = ("mutant_generation_sec", "probe_generation_sec", "behavior_signature_sec", "clustering_sec", "representative_selection_sec", "total_problem_sec")


def _stacked(rows: DataFrame, name: str, parts: dict[str, dict[str, Column]], *keys: str) -> DataFrame:
    """A row for each row and part: keys, `name`, and the part's columns."""
    stack = F.explode(F.array(*(F.struct(F.lit(p).alias(name), *(c.alias(n) for n, c in columns.items())) for p, columns in parts.items())))
    return rows.select(*keys, stack.alias("_p")).select(*keys, "_p.*")


def _joined(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, keys), parts)


def _interval(of: str, prefix: str, low: str) -> list[Column]:
    """Estimate and interval of a statistic of resampling.together."""
    return [F.round(f"{of}.estimate", 6).alias(prefix), F.round(f"{of}.low", 6).alias(f"{low}_ci95_low"), F.round(f"{of}.high", 6).alias(f"{low}_ci95_high")]


def effectiveness(rows: DataFrame, replicas: int) -> DataFrame:
    total, adjusted = F.col("total_mutants"), F.greatest(F.lit(0), F.col("total_mutants") - F.col("equivalent_mutants")).cast("double")
    score = lambda m: F.col(f"{m}_equivalent_adjusted_score")
    statistics = lambda m: {"macro_raw": (F.col(f"{m}_score"), None), "micro_raw": (F.col(f"{m}_killed"), total), "macro_equivalent_adjusted": (score(m), None), "micro_equivalent_adjusted": (score(m) * adjusted, adjusted)}
    methods = {"proposed": "proposed", "official_reference": "official"}
    found = resampling.together(rows, "problem_id", {f"{m}_{s}": c for m in methods.values() for s, c in statistics(m).items()}, replicas).where("n > 0")
    parts = {name: {"n_tasks": F.col("n")} | {s: F.col(f"{m}_{s}") for s in statistics(m)} for name, m in methods.items()}
    x = _stacked(found, "method", parts)
    return x.select("method", "n_tasks", *(c for s in statistics("official") for c in _interval(s, s, s.replace("equivalent_adjusted", "adjusted"))))


def official_agreement(rows: DataFrame, replicas: int) -> DataFrame:
    prec, recall = F.col("kill_precision"), F.col("kill_recall")
    parts = {"kill_agreement_accuracy": F.col("proposed_kill_agreement_accuracy"), "kill_precision": prec, "kill_recall": recall, "kill_f1": share(2 * prec * recall, prec + recall, 4)}
    found = resampling.together(rows, "problem_id", {k: (c, None) for k, c in parts.items()}, replicas).where("n > 0")
    x = _stacked(found, "metric", {k: {"v": F.col(k)} for k in parts})
    return x.select("metric", F.round("v.estimate", 6).alias("mean"), F.round("v.low", 6).alias("ci95_low"), F.round("v.high", 6).alias("ci95_high"))


def paired_tests(rows: DataFrame, keys: list[str], d: str) -> DataFrame:
    """keys, wins, ties, losses, n_non_ties, p_value, cohen_dz (null without spread), cohen_dz_undefined_zero_variance,
    rank_biserial of paired differences."""
    x, near = F.col(d), F.lit(1e-12)
    sd = F.coalesce(F.stddev_samp(x), F.lit(0.0))
    counts = rows.where(x.isNotNull()).groupBy(*keys).agg(F.count_if(x > near).alias("wins"), F.count_if(F.abs(x) <= near).alias("ties"), F.count_if(x < -near).alias("losses"), F.when(sd > near, F.round(F.avg(x) / sd, 6)).alias("cohen_dz"), (sd <= near).alias("cohen_dz_undefined_zero_variance"))
    sizes = rows.where(F.abs(x) > near).groupBy(*keys, F.abs(x).alias("_size")).agg(F.count(F.lit(1)).alias("_times"), F.count_if(x > 0).alias("_up"))
    ranked = ranks.tied_ranks(sizes, "_size", "_times", keys=keys)
    rank = F.col("mean_rank")
    signed = ranked.groupBy(*keys).agg(F.round(F.sum((2 * F.col("_up") - F.col("_times")) * rank) / F.sum(F.col("_times") * rank), 6).alias("rank_biserial"))
    both = counts.join(signed, keys, "left") if keys else counts.crossJoin(F.broadcast(signed))  # one row each
    tests = {"n_non_ties": F.col("wins") + F.col("losses"), "p_value": F.round(two_sided_sign_test(F.col("wins"), F.col("losses")), 9), "rank_biserial": F.coalesce("rank_biserial", F.lit(0.0))}
    return both.withColumns(tests)


def paired_comparison(rows: DataFrame, replicas: int) -> DataFrame:
    one = rows.withColumns({"_one": F.lit(1), "d": F.col("score_delta_proposed_minus_baseline")})
    key = ["_one"]
    weighted = one.groupBy("_one").agg(F.count(F.lit(1)).alias("n_tasks"), F.round(share(F.sum(F.col("d") * F.col("total_mutants")), F.sum("total_mutants")), 6).alias("mutant_weighted_score_delta"))
    deltas = resampling.together(one, "problem_id", {"all": (F.col("d"), None)}, replicas).select(F.lit(1).alias("_one"), *_interval("all", "mean_score_delta", "score_delta"))
    parents = resampling.together(resampling.cluster_means(one, "problem_id", "d", "parent_task_id"), "unit", {"all": (F.col("num"), None)}, replicas)
    parents = parents.select(F.lit(1).alias("_one"), F.col("n").alias("parent_clustered_n"), *_interval("all", "parent_clustered_mean_delta", "parent_clustered"))
    return _joined([weighted, deltas, paired_tests(one, key, "d"), parents], key).drop("_one")


def efficiency(rows: DataFrame) -> DataFrame:
    columns = lambda m: {"tokens": F.col(f"{m}_total_tokens"), "paid": F.col(f"{m}_paid_tokens"), "runtime": F.col(f"{m}_runtime_sec"), "cost": F.col(f"{m}_estimated_cost_usd"), "killed": F.col(f"{m}_killed"), "calls": F.col(f"{m}_llm_calls")}
    x = _stacked(rows, "method", {m: columns(m) for m in METHODS}).groupBy("method").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in ("tokens", "paid", "runtime", "cost", "killed", "calls")))
    totals = [F.col("tokens").alias("total_tokens"), F.col("paid").alias("total_paid_tokens"), F.col("calls").alias("total_llm_calls"), F.round("runtime", 4).alias("total_runtime_sec"), F.round("cost", 8).alias("total_estimated_cost_usd"), F.col("killed").alias("total_killed_mutants")]
    rates = [share("tokens", "killed", 4).alias("tokens_per_killed_mutant"), share("paid", "killed", 4).alias("paid_tokens_per_killed_mutant"), share("runtime", "killed", 6).alias("runtime_sec_per_killed_mutant"), share("cost", "killed", 8).alias("cost_usd_per_killed_mutant"), share("calls", "n", 4).alias("calls_per_task")]
    return x.select("method", *totals, *rates)


def baseline_fairness(rows: DataFrame) -> DataFrame:
    at = ("first_final_score_iteration", "tokens_at_first_final_score", "first_plateau_iteration", "tokens_at_plateau", "score_at_matched_proposed_tokens", "score_at_matched_proposed_paid_tokens")
    return rows.select("problem_id", "proposed_score", "baseline_score", "proposed_total_tokens", "baseline_total_tokens", *(f"baseline_{c}" for c in at))


def score_conventions(rows: DataFrame) -> DataFrame:
    adjusted = F.greatest(F.lit(0), F.col("total_mutants") - F.col("equivalent_mutants"))
    columns = lambda m: {"raw": F.col(f"{m}_score"), "killed": F.col(f"{m}_killed"), "adjusted": F.col(f"{m}_equivalent_adjusted_score"), "adjusted_killed": F.col(f"{m}_equivalent_adjusted_score") * adjusted, "total": F.col("total_mutants"), "equivalent": F.col("equivalent_mutants")}
    x = _stacked(rows, "method", {m.capitalize(): columns(m) for m in (*METHODS, "official")})
    left = F.greatest(F.lit(0), F.sum("total") - F.sum("equivalent"))
    return x.groupBy("method").agg(F.round(F.avg("raw"), 6).alias("macro_raw"), share(F.sum("killed"), F.sum("total"), 6).alias("micro_raw"), F.round(F.avg("adjusted"), 6).alias("macro_equivalent_adjusted"), share(F.sum("adjusted_killed"), left, 6).alias("micro_equivalent_adjusted"))


def _subset() -> Column:
    return F.coalesce(F.nullif("dataset_subset", F.lit("")), F.lit("unknown")).alias("dataset_subset")


def subset_summary(rows: DataFrame) -> DataFrame:
    none, nothing = F.lit(0).cast("long"), F.lit(0.0)
    spent = lambda m: {"tokens": F.col(f"{m}_total_tokens"), "paid": F.col(f"{m}_paid_tokens"), "cost": F.col(f"{m}_estimated_cost_usd"), "runtime": F.col(f"{m}_runtime_sec")} if m in METHODS else {"tokens": none, "paid": none, "cost": nothing, "runtime": nothing}
    parts = {("official_reference" if m == "official" else m): {"score": F.col(f"{m}_score"), "killed": F.col(f"{m}_killed"), "total": F.col("total_mutants"), **spent(m)} for m in (*METHODS, "official")}
    x = _stacked(rows.withColumn("dataset_subset", _subset()), "method", parts, "dataset_subset")
    add = lambda c: F.sum(c)
    return x.groupBy("dataset_subset", "method").agg(F.count(F.lit(1)).alias("n_tasks"), add("total").alias("total_mutants"), add("killed").alias("killed_mutants"), F.round(F.avg("score"), 6).alias("macro_mutation_score"), share(add("killed"), add("total"), 6).alias("micro_mutation_score"), add("tokens").alias("total_tokens"), add("paid").alias("total_paid_tokens"), F.round(add("cost"), 8).alias("total_cost_usd"), F.round(add("runtime"), 4).alias("total_runtime_sec"), share(add("tokens"), add("killed"), 4).alias("tokens_per_killed_mutant"))


def subset_paired(rows: DataFrame, replicas: int) -> DataFrame:
    x = rows.select(_subset(), F.col("score_delta_proposed_minus_baseline").alias("d"))
    key = ["dataset_subset"]
    found = resampling.intervals(x, key, "d", replicas=replicas).select(*key, F.col("n").alias("n_tasks"), F.round("estimate", 6).alias("mean_score_delta"), F.round("low", 6).alias("ci95_low"), F.round("high", 6).alias("ci95_high"))
    return found.join(paired_tests(x, key, "d"), key)


def layer_contribution(calls: DataFrame) -> DataFrame:
    """Of the proposed method's layers: a layer's row a task first, then means and sums over tasks."""
    x = calls.where("method = 'proposed'").groupBy("problem_id", "layer").agg(F.sum("new_kills").alias("new"), F.max("cumulative_score").alias("score"), F.sum("total_tokens").alias("tokens"), F.sum("latency_sec").alias("runtime"), F.sum("estimated_cost_usd").alias("cost"), F.count(F.lit(1)).alias("calls"), *(F.count_if(F.col("status") == s).alias(n) for s, n in (("PRODUCTIVE", "productive"), ("REJECTED", "invalid"), ("VALID_ZERO_KILL", "zero"))), F.sum("prompt_chars").alias("chars"), F.sum("target_count").alias("targets"))
    y = x.groupBy("layer").agg(F.count(F.lit(1)).alias("n_tasks"), F.round(F.avg("new"), 6).alias("mean_new_kills"), F.sum("new").alias("total_new_kills"), F.round(F.avg("score"), 6).alias("mean_cumulative_score"), F.sum("tokens").alias("total_tokens"), F.round(F.sum("runtime"), 4).alias("total_runtime_sec"), F.round(F.sum("cost"), 8).alias("total_cost_usd"), F.sum("calls").alias("total_llm_calls"), F.sum("productive").alias("productive_calls"), F.sum("invalid").alias("invalid_calls"), F.sum("zero").alias("zero_kill_calls"), F.sum("chars").alias("total_prompt_chars"), F.sum("targets").alias("total_targets"))
    return y.withColumns({"tokens_per_new_kill": share("total_tokens", "total_new_kills", 4), "runtime_sec_per_new_kill": share("total_runtime_sec", "total_new_kills", 4), "mean_prompt_chars_per_call": share("total_prompt_chars", "total_llm_calls", 4), "targets_per_call": share("total_targets", "total_llm_calls", 4), "productive_call_rate": share("productive_calls", "total_llm_calls", 6)})


def runtime_breakdown(timings: DataFrame) -> DataFrame:
    return timings.groupBy("problem_id").agg(*(F.round(F.coalesce(F.sum(F.when(F.col("stage") == s, F.col("seconds"))), F.lit(0.0)), 4).alias(s) for s in _STAGES))


def cluster_compression(rows: DataFrame, calls: DataFrame) -> DataFrame:
    ours = calls.where("method = 'proposed'").groupBy("problem_id").agg(*(F.count_if(F.col("layer") == f"Layer{i}").alias(f"layer{i}_actual_calls") for i in (1, 2, 3)))
    x = rows.select("problem_id", "total_mutants", F.col("layer1_num_clusters").alias("num_clusters"), F.col("layer1_representatives").alias("representatives"))
    x = x.withColumns({"compression_ratio_mutants_per_representative": share("total_mutants", "representatives", 6), "mean_cluster_size": share("total_mutants", "num_clusters", 6)})
    return x.join(ours, "problem_id", "left").na.fill(0)


def mutant_rows(f: Facts) -> DataFrame:
    """mutants of the tasks with killed, by the proposed method."""
    dead = f.kills.where("method = 'proposed'").select("problem_id", "mutant").distinct().withColumn("_dead", F.lit(1))
    x = f.mutants.join(f.tasks.select("problem_id"), "problem_id", "left_semi").join(dead, ["problem_id", "mutant"], "left")
    return x.withColumns({"killed": F.coalesce("_dead", F.lit(0)).cast("long"), "operator": F.coalesce(F.nullif("operator", F.lit("")), F.lit("UNKNOWN"))}).drop("_dead")


def operator_difficulty(mutants: DataFrame) -> DataFrame:
    x = mutants.groupBy("operator").agg(F.count(F.lit(1)).alias("total_mutants"), F.sum("killed").alias("killed_mutants"))
    return x.withColumns({"surviving_mutants": F.col("total_mutants") - F.col("killed_mutants"), "kill_rate": share("killed_mutants", "total_mutants", 6)})


def equivalent_mutants(mutants: DataFrame) -> DataFrame:
    status = F.when(F.col("killed") == 1, "KILLED").otherwise("SURVIVED")
    return mutants.where("equivalence_status = 'STATIC_EQUIVALENT'").select("problem_id", "mutant", "operator", "killed", status.alias("status"), "equivalence_status")


def usage(calls: DataFrame) -> DataFrame:
    named = lambda c: F.coalesce(c, F.lit("unknown")).alias(c)
    x = calls.select("method", named("provider"), named("model"), "new_kills", "total_tokens", "prompt_tokens", "completion_tokens", "estimated_cost_usd", "latency_sec", "prompt_chars")
    y = x.groupBy("method", "provider", "model").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("new_kills") > 0).alias("productive_calls"), F.sum("total_tokens").alias("total_tokens"), F.sum("prompt_tokens").alias("total_prompt_tokens"), F.sum("completion_tokens").alias("total_completion_tokens"), F.round(F.sum("estimated_cost_usd"), 8).alias("total_cost_usd"), F.round(F.sum("latency_sec"), 4).alias("total_latency_sec"), F.sum("new_kills").alias("total_new_kills"), F.sum("prompt_chars").alias("total_prompt_chars"))
    return y.withColumns({"productive_call_rate": share("productive_calls", "calls", 6), "tokens_per_new_kill": share("total_tokens", "total_new_kills", 4)})


def outcomes(calls: DataFrame) -> DataFrame:
    return calls.groupBy("method", F.coalesce("status", F.lit("UNKNOWN")).alias("outcome")).agg(F.count(F.lit(1)).alias("calls"))


def call_metrics(calls: DataFrame) -> DataFrame:
    named = {"provider": "unknown", "model": "unknown", "status": "UNKNOWN"}
    return calls.na.fill(named).select("method", "problem_id", "layer", "attempt", "provider", "model", "status", "target_count", "new_kills", "cumulative_score", "prompt_tokens", "completion_tokens", "total_tokens", "prompt_chars", "response_chars", "latency_sec", "estimated_cost_usd", "validation_reason")


def tables(f: Facts, replicas: int = resampling.REPLICAS, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df, alone: bool = False) -> dict[str, Callable[[], DataFrame]]:
    """Every report table by its published name; each is built when it is called. `keep` may write what many tables
    share (scored calls, comparison rows) and read it again; a table that is made alone has the scores only, if
    kills alone decide it."""
    calls = cache(lambda: keep(scored_calls(f), "calls"))
    rows = cache(lambda: keep(compare(f, calls()), "comparison"))
    scored = cache(lambda: keep(scores(f), "scores")) if alone else rows
    mutants = cache(lambda: mutant_rows(f))
    return {
        "effectiveness_summary": lambda: effectiveness(scored(), replicas),
        "official_agreement_summary": lambda: official_agreement(scored(), replicas),
        "paired_comparison_summary": lambda: paired_comparison(scored(), replicas),
        "efficiency_summary": lambda: efficiency(rows()),
        "baseline_fairness_per_task": lambda: baseline_fairness(rows()),
        "aggregate_score_conventions": lambda: score_conventions(scored()),
        "evoeval_subset_summary": lambda: subset_summary(rows()),
        "evoeval_subset_paired_comparison": lambda: subset_paired(scored(), replicas),
        "layer_contribution_summary": lambda: layer_contribution(calls()),
        "runtime_breakdown_per_task": lambda: runtime_breakdown(f.timings.join(f.tasks.select("problem_id"), "problem_id", "left_semi")),
        "cluster_compression_per_task": lambda: cluster_compression(rows(), calls()),
        "operator_difficulty_summary": lambda: operator_difficulty(mutants()),
        "conservative_equivalent_mutants": lambda: equivalent_mutants(mutants()),
        "llm_usage_summary": lambda: usage(calls()),
        "call_validation_outcomes": lambda: outcomes(calls()),
        "llm_call_level_metrics": lambda: call_metrics(calls()),
        "baseline_iteration_history": lambda: baseline_history(calls()).drop("final"),
    }


# --- frames behind the plots -----------------------------------------------------------------------------------
_CONVENTIONS = ("macro_raw", "micro_raw", "macro_equivalent_adjusted", "micro_equivalent_adjusted")


def aggregate_bars(rows: DataFrame) -> DataFrame:
    """method, convention, score."""
    return _stacked(score_conventions(rows), "convention", {c: {"score": F.col(c)} for c in _CONVENTIONS}, "method")


def stopping_totals(rows: DataFrame) -> DataFrame:
    """view, tokens: the baseline's tokens in all, at its last gain, at its plateau (all where there is none), and the
    other method's."""
    flat = F.when(F.col("baseline_tokens_at_plateau") > 0, F.col("baseline_tokens_at_plateau")).otherwise(F.col("baseline_total_tokens"))
    views = {"baseline_fixed": F.col("baseline_total_tokens"), "baseline_first_final": F.col("baseline_tokens_at_first_final_score"), "baseline_plateau": flat, "proposed": F.col("proposed_total_tokens")}
    return _stacked(rows, "view", {v: {"tokens": c} for v, c in views.items()}).groupBy("view").agg(F.sum("tokens").alias("tokens"))


def matched_means(rows: DataFrame) -> DataFrame:
    """view, score: the baseline's mean score in all and at the other method's tokens and paid tokens, and its."""
    views = {"baseline_fixed": "baseline_score", "baseline_matched_tokens": "baseline_score_at_matched_proposed_tokens", "baseline_matched_paid_tokens": "baseline_score_at_matched_proposed_paid_tokens", "proposed": "proposed_score"}
    return _stacked(rows, "view", {v: {"score": F.col(c)} for v, c in views.items()}).groupBy("view").agg(F.round(F.avg("score"), 6).alias("score"))


def histogram(rows: DataFrame, column: str) -> DataFrame:
    """bin, low, high, n of a column in min(12, max(3, floor(sqrt(rows)))) bins of equal width; the greatest value
    falls in the last one, a single value in a width of 1 around it. Nulls are left out, empty bins are kept."""
    x = F.col(column).cast("double")
    known = rows.where(x.isNotNull() & ~F.isnan(x))
    ends = known.agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).where("n > 0")
    ends = ends.select(F.least(F.lit(12), F.greatest(F.lit(3), F.floor(F.sqrt("n")))).cast("int").alias("bins"), F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    place = F.least(F.col("bins") - 1, F.floor((x - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("bins"))).cast("int")
    counts = known.crossJoin(F.broadcast(ends)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # one row
    every = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    edge = lambda i: F.round(F.col("lo") + (F.col("hi") - F.col("lo")) * i / F.col("bins"), 6)
    return every.join(counts, "bin", "left").select("bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def usage_bars(calls: DataFrame) -> DataFrame:
    """label (method, provider and model), tokens, productive_call_rate."""
    label = F.concat_ws(" / ", "method", "provider", "model").alias("label")
    return usage(calls).select(label, F.col("total_tokens").alias("tokens"), "productive_call_rate")


def outcome_pivot(calls: DataFrame) -> DataFrame:
    """method and a column of calls for each known outcome, and for all others."""
    known = ("PRODUCTIVE", "VALID_ZERO_KILL", "REJECTED", "ERROR")
    status = F.coalesce("status", F.lit(""))
    return calls.groupBy("method").agg(*(F.count_if(status == s).alias(s.lower()) for s in known), F.count_if(~status.isin(*known)).alias("others"))


def frames(f: Facts) -> dict[str, Callable[[], DataFrame]]:
    """The frames that plots of the tables need, by name."""
    calls = cache(lambda: scored_calls(f))
    rows = cache(lambda: compare(f, calls()))
    return {
        "aggregate_bars": lambda: aggregate_bars(rows()),
        "stopping_totals": lambda: stopping_totals(rows()),
        "matched_means": lambda: matched_means(rows()),
        "compression_histogram": lambda: histogram(rows(), "cluster_compression_ratio"),
        "usage_bars": lambda: usage_bars(calls()),
        "outcome_pivot": lambda: outcome_pivot(calls()),
    }
