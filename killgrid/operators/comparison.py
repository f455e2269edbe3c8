"""From the facts of two methods to one comparison row a task.

Facts are tables: tasks (problem_id, dataset_name, dataset_subset, source_task_id, parent_task_id), mutants
(problem_id, mutant, operator, equivalence_status), kills (method, problem_id, attempt, mutant), official (problem_id,
mutant), calls (method, problem_id, layer, attempt, provider, model, status, target_count, prompt_tokens,
completion_tokens, total_tokens, prompt_chars, response_chars, latency_sec, estimated_cost_usd, validation_reason),
clusters (problem_id, num_clusters, representatives), timings (problem_id, stage, seconds). Methods are `proposed`,
with layers Layer1 to Layer3, and `baseline`.

Everything is keyed by task: kills become words of bits, calls sums, the baseline's history is cut at a budget; the calls of one task, which are few, are ordered together. A task that a fact lacks has zeros there; rows of tasks that `tasks` lacks count nowhere.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kill_sets

#: Providers that cost nothing.
UNPAID = ("", "hf", "mock", "local")
METHODS = ("proposed", "baseline")


@dataclass(frozen=True)
class Facts:
    tasks: DataFrame
    mutants: DataFrame
    kills: DataFrame
    official: DataFrame
    calls: DataFrame
    clusters: DataFrame
    timings: DataFrame
    #: Spark tasks that the facts are dealt to by problem_id; None if they aren't.
    parts: int | None = None


def share(a: Column | str, b: Column | str, places: int | None = None) -> Column:
    """a / b, 0 where b is 0."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    found = F.when(b != 0, a / b).otherwise(F.lit(0.0))
    return found if places is None else F.round(found, places)


def _size(words: Column) -> Column:
    return F.sum(F.bit_count(words).cast("long"))


def scored_calls(f: Facts) -> DataFrame:
    """calls with killed_mutants, new_kills, cumulative_kills, cumulative_score (of all mutants), paid. Calls and kills
    are one table, in which each call finds the kills of its attempt and of those before."""
    keys = ["method", "problem_id", "attempt"]
    known = f.calls.join(f.tasks.select("problem_id"), "problem_id", "left_semi").dropna(subset=keys)
    rest = [c for c in known.columns if c not in keys]
    none = F.lit(0).cast("long")
    found = kill_sets.gains(f.kills, ["method", "problem_id"], "attempt").select(*keys, *(F.lit(None).cast(known.schema[c].dataType).alias(c) for c in rest), F.col("kills").alias("_kills"), F.col("new").alias("_new"), F.lit(False).alias("_listed"))
    met = known.select(*keys, *rest, none.alias("_kills"), none.alias("_new"), F.lit(True).alias("_listed")).unionByName(found)
    # a union of tables that are dealt alike isn't always dealt so (kill_sets.marked): it is dealt to one part more
    parts = (f.parts or int(f.calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1
    met = met.repartition(parts, "problem_id")
    own = Window.partitionBy("problem_id", "method", "attempt")
    so_far = Window.partitionBy("problem_id", "method").orderBy("attempt").rangeBetween(Window.unboundedPreceding, 0)  # all rows of an attempt
    rows = met.withColumns({"cumulative_kills": F.sum("_new").over(so_far), "killed_mutants": F.sum("_kills").over(own), "new_kills": F.sum("_new").over(own)}).where("_listed")
    every = kill_sets.marked([(f.mutants, {"_all": F.lit(True)}), (f.official, {"_there": F.lit(True)})], ["problem_id"])
    totals = every.groupBy("problem_id").agg(_size(F.col("_all").bitwiseOR(F.col("_there"))).alias("_total")).repartition(parts, "problem_id")
    provider, total = F.coalesce("provider", F.lit("")), F.coalesce("_total", none)
    rows = rows.join(totals, "problem_id", "left").withColumns({"cumulative_score": share(F.col("cumulative_kills"), total, 6), "paid": ~provider.isin(*UNPAID)})
    return rows.select(*keys, *rest, "killed_mutants", "new_kills", "cumulative_kills", "cumulative_score", "paid")


def _histories(calls: DataFrame) -> DataFrame:
    """calls with cumulative_tokens, cumulative_paid_tokens, streak (tries without gain, errors aside) and final (kills
    in the end) of their method."""
    order = Window.partitionBy("problem_id", "method").orderBy("attempt").rowsBetween(Window.unboundedPreceding, 0)
    rows = calls.withColumns({
        "cumulative_tokens": F.sum("total_tokens").over(order),
        "cumulative_paid_tokens": F.sum(F.when(F.col("paid"), F.col("total_tokens")).otherwise(0)).over(order),
        "_idle": F.sum(F.when((F.col("status") != "ERROR") & (F.col("new_kills") == 0), 1).otherwise(0)).over(order),
        "final": F.max("cumulative_kills").over(Window.partitionBy("problem_id", "method")),
    })
    at_gain = F.max(F.when(F.col("new_kills") > 0, F.col("_idle"))).over(order)
    return rows.withColumn("streak", (F.col("_idle") - F.coalesce(at_gain, F.lit(0))).cast("long")).drop("_idle")


def baseline_history(calls: DataFrame, patience: int = 1) -> DataFrame:
    """problem_id, iteration, status, new_kills, cumulative_kills, cumulative_score, cumulative_tokens,
    cumulative_paid_tokens, streak, final of the baseline."""
    return _histories(calls.where("method = 'baseline'")).select("problem_id", F.col("attempt").alias("iteration"), "status", "new_kills", "cumulative_kills", "cumulative_score", "cumulative_tokens", "cumulative_paid_tokens", "streak", "final")


def _sums(calls: DataFrame) -> DataFrame:
    """One row a task: sums of both methods' calls, and where the baseline was at its last gain, its plateau and the
    other method's budgets. The calls are read once."""
    method, layer, new = F.col("method"), F.col("layer"), F.col("new_kills")
    zero = lambda c, kind="long": F.coalesce(c, F.lit(0)).cast(kind)
    out = []
    for m in METHODS:
        own = method == m
        add = lambda c, where=own, kind="long": zero(F.sum(F.when(where, F.col(c))), kind)
        names = lambda c, where=own: F.array_join(F.array_sort(F.collect_set(F.when(where & (F.col(c) != ""), F.col(c)))), ",")
        out += [
            add("total_tokens").alias(f"{m}_total_tokens"),
            zero(F.sum(F.when(own, 1))).alias(f"{m}_llm_calls"),
            add("total_tokens", own & F.col("paid")).alias(f"{m}_paid_tokens"),
            F.round(add("estimated_cost_usd", own, "double"), 8).alias(f"{m}_estimated_cost_usd"),
            F.round(add("estimated_cost_usd", own & F.col("paid"), "double"), 8).alias(f"{m}_paid_cost_usd"),
            F.round(add("latency_sec", own, "double"), 4).alias(f"{m}_runtime_sec"),
            zero(F.sum(F.when(own & (F.col("status") == "PRODUCTIVE"), 1))).alias(f"{m}_generated_tests"),
            names("provider").alias(f"{m}_providers"),
            names("model").alias(f"{m}_models"),
        ]
    ours = method == "proposed"
    for i in (1, 2, 3):
        at = ours & (layer == f"Layer{i}")
        out += [zero(F.sum(F.when(at, new))).alias(f"layer{i}_new_kills"), F.coalesce(F.bool_or(at), F.lit(False)).alias(f"layer{i}_used"), zero(F.sum(F.when(at, 1))).alias(f"layer{i}_iterations"), zero(F.max(F.when(at, F.col("cumulative_kills")))).alias(f"layer{i}_killed_mutants")]
    number = F.nullif(F.regexp_extract(layer, "^Layer([0-9]+)$", 1), F.lit("")).cast("int")
    task, theirs, point = Window.partitionBy("problem_id"), method == "baseline", F.struct(F.col("attempt").alias("iteration"), "cumulative_tokens")
    budget = lambda where: zero(F.sum(F.when(where, F.col("total_tokens"))).over(task))
    reached = lambda spent, limit: F.max(F.when(theirs & (F.col(spent) <= F.col(limit)), F.col("cumulative_score")))
    out += [
        F.min(F.when(theirs & (F.col("cumulative_kills") == F.col("final")), point)).alias("_final"), F.min(F.when(theirs & (F.col("streak") >= 1), point)).alias("_flat"),
        reached("cumulative_tokens", "_budget").alias("_matched"), reached("cumulative_paid_tokens", "_paid_budget").alias("_matched_paid"),
    ]
    rows = _histories(calls).withColumns({"_budget": budget(ours), "_paid_budget": budget(ours & F.col("paid"))})
    return rows.groupBy("problem_id").agg(*out, zero(F.max(F.when(ours, number)), "int").alias("final_layer_used"))


def _kills(f: Facts) -> DataFrame:
    yes = F.lit(True)
    sets = kill_sets.marked([(f.kills, {"_p": F.col("method") == "proposed", "_b": F.col("method") == "baseline"}), (f.official, {"_o": yes}), (f.mutants, {"_all": yes, "_eq": F.col("equivalence_status") == "STATIC_EQUIVALENT"})], ["problem_id"])
    p, b, o, every, eq = (F.col(c) for c in ("_p", "_b", "_o", "_all", "_eq"))
    same = lambda x, y: every.bitwiseAND(F.bitwise_not(x.bitwiseXOR(y)))
    sizes = {"total_mutants": every, "proposed_killed": p, "baseline_killed": b, "official_killed": o, "equivalent_mutants": eq, "_p_agrees": same(p, o), "_b_agrees": same(b, o), "_both": p.bitwiseAND(o)}
    return sets.groupBy("problem_id").agg(*(_size(w).alias(n) for n, w in sizes.items()))


def _filled(rows: DataFrame, *done: str) -> DataFrame:
    """rows with 0, '' and False for what a task lacks, but in the columns that are done."""
    numbers = [n for n, t in rows.dtypes if t in ("bigint", "int", "double") and n not in done]
    texts = [n for n, t in rows.dtypes if t == "string" and n not in done]
    return rows.na.fill(0, numbers).na.fill("", texts).na.fill(False)


def scores(f: Facts) -> DataFrame:
    """One row a task: those columns of compare() that kills alone decide, so that no call is scored for them."""
    rows = _filled(f.tasks.join(_kills(f), "problem_id", "left"), "problem_id")
    total, eq = F.col("total_mutants"), F.col("equivalent_mutants")
    adjusted = F.greatest(F.lit(0), total - eq)
    score = {m: share(f"{m}_killed", total, 6) for m in (*METHODS, "official")}
    return rows.select(
        "problem_id", "dataset_name", "dataset_subset", F.when(F.col("source_task_id") != "", F.col("source_task_id")).otherwise(F.col("problem_id")).alias("source_task_id"), "parent_task_id",
        "total_mutants", "proposed_killed", "baseline_killed", "official_killed", *(s.alias(f"{m}_score") for m, s in score.items()), "equivalent_mutants",
        *(share(F.least(F.col(f"{m}_killed"), adjusted), adjusted, 6).alias(f"{m}_equivalent_adjusted_score") for m in score),
        (F.round(score["proposed"] - score["baseline"], 6) + 0.0).alias("score_delta_proposed_minus_baseline"),
        share("_p_agrees", total, 4).alias("proposed_kill_agreement_accuracy"), share("_b_agrees", total, 4).alias("baseline_kill_agreement_accuracy"),
        share("_both", "proposed_killed", 4).alias("kill_precision"), share("_both", "official_killed", 4).alias("kill_recall"),
    )


def compare(f: Facts, calls: DataFrame | None = None) -> DataFrame:
    """One row a task, 56 columns (and the proposed kills' precision and recall against the official ones)."""
    calls = scored_calls(f) if calls is None else calls
    scored = scores(f)
    rows = _filled(scored.join(_sums(calls), "problem_id", "left").join(f.clusters, "problem_id", "left"), *scored.columns)
    return rows.select(
        "problem_id", "dataset_name", "dataset_subset", "source_task_id", "parent_task_id",
        "total_mutants", "proposed_killed", "baseline_killed", "official_killed", *(f"{m}_score" for m in (*METHODS, "official")), "equivalent_mutants",
        *(f"{m}_equivalent_adjusted_score" for m in (*METHODS, "official")), "score_delta_proposed_minus_baseline",
        "proposed_total_tokens", "baseline_total_tokens", "proposed_llm_calls", "baseline_llm_calls", "proposed_paid_tokens", "baseline_paid_tokens",
        (F.col("proposed_total_tokens") - F.col("baseline_total_tokens")).alias("token_delta_proposed_minus_baseline"),
        *(f"{m}_{c}" for c in ("estimated_cost_usd", "paid_cost_usd", "runtime_sec", "generated_tests") for m in METHODS),
        "proposed_kill_agreement_accuracy", "baseline_kill_agreement_accuracy",
        F.col("num_clusters").alias("layer1_num_clusters"), F.col("representatives").alias("layer1_representatives"), share("total_mutants", "representatives", 4).alias("cluster_compression_ratio"),
        "final_layer_used", "layer1_killed_mutants", "layer1_new_kills", "layer2_new_kills", "layer3_new_kills", "layer2_used", "layer3_used", "layer1_iterations",
        F.col("baseline_llm_calls").alias("baseline_iterations"),
        F.coalesce("_final.iteration", F.lit(0)).cast("long").alias("baseline_first_final_score_iteration"), F.coalesce("_final.cumulative_tokens", F.lit(0)).cast("long").alias("baseline_tokens_at_first_final_score"),
        F.coalesce("_flat.iteration", F.lit(0)).cast("long").alias("baseline_first_plateau_iteration"), F.coalesce("_flat.cumulative_tokens", F.lit(0)).cast("long").alias("baseline_tokens_at_plateau"),
        F.col("_matched").alias("baseline_score_at_matched_proposed_tokens"), F.col("_matched_paid").alias("baseline_score_at_matched_proposed_paid_tokens"),
        "proposed_providers", "proposed_models", "baseline_providers", "baseline_models", "kill_precision", "kill_recall",
    )
