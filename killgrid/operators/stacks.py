"""Clusters of mutants: representatives, live targets, contexts and the handoff to the next layer.

mutants: task, cluster, id, features (array of double), signature (array of int, 0 same, 1 different, 2 timed out),
operator, active (boolean), change, equivalence_status. A task holds a few dozen mutants, so distances are taken
between the members of a cluster and never beyond; all else is grouping and windows by task. Null clusters are a
cluster of their own in `context`, and have neither representative nor target. Ties go to the smaller id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .comparison import share

#: Share of a cluster that may represent it, by centrality.
QUANTILE = 0.4


def difference_rate(signature: Column) -> Column:
    """Share of probes that tell the mutant from the original; 0 without any."""
    return F.coalesce(share(F.size(F.filter(signature, lambda x: x != 0)), F.size(signature)), F.lit(0.0))


def information(signature: Column) -> Column:
    """0.7 of the signature's entropy over three states and 0.3 of its difference rate, to six places."""
    size = F.size(signature)

    def term(state: int) -> Column:
        p = F.size(F.filter(signature, lambda x: x == state)) / F.greatest(size, F.lit(1))
        return F.when(p > 0, -p * F.log2(p)).otherwise(0.0)

    entropy = (term(0) + term(1) + term(2)) / math.log2(3)
    return F.coalesce(F.when(size > 0, F.round(0.7 * entropy + 0.3 * difference_rate(signature), 6)), F.lit(0.0))


def one_hot(value: Column, vocabulary: Column) -> Column:
    """1.0 at the value's place in the vocabulary, 0.0 elsewhere."""
    return F.transform(vocabulary, lambda item: F.when(item.eqNullSafe(value), 1.0).otherwise(0.0))


def centralities(mutants: DataFrame) -> DataFrame:
    """mutants with centrality, 1 less a member's mean distance (its own 0 included) over the cluster's greatest, and
    information. Features are scaled by their spread within the cluster; a cluster's only member has centrality 1."""
    key = ["task", "cluster"]
    known = mutants.where("cluster IS NOT NULL")
    spread = known.select(*key, F.posexplode("features").alias("dim", "x")).groupBy(*key, "dim").agg(F.stddev_pop("x").alias("s"))
    scale = spread.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "s"))), lambda x: F.when(x["s"] > 0, x["s"]).otherwise(1.0)).alias("scale"))
    points = known.join(scale, key, "left").select(*key, "id", F.zip_with("features", "scale", lambda x, s: x / s).alias("z"))
    other = points.select(*key, F.col("id").alias("id_b"), F.col("z").alias("z_b"))
    squares = F.aggregate(F.zip_with("z", "z_b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
    means = points.join(other, key).groupBy(*key, "id").agg(F.avg(F.sqrt(squares)).alias("_mean"), F.count(F.lit(1)).alias("_n"))
    most = F.greatest(F.max("_mean").over(Window.partitionBy(*key)), F.lit(1e-9))
    central = means.withColumn("centrality", F.when(F.col("_n") == 1, 1.0).otherwise(F.round(1 - F.col("_mean") / most, 6) + 0.0)).select(*key, "id", "centrality")
    return mutants.join(central, [*key, "id"], "left").withColumn("information", information(F.col("signature")))


def representatives(scored: DataFrame, each: int = 1, quantile: float = QUANTILE) -> DataFrame:
    """scored (centralities) with place (in the cluster's shortlist by information, centrality and difference rate;
    null outside it) and representative (the first `each` places)."""
    each, quantile = max(1, each), min(max(quantile, 0.05), 1.0)
    group = Window.partitionBy("task", "cluster")
    size = F.count(F.lit(1)).over(group)
    short = F.row_number().over(group.orderBy(F.desc("centrality"), "id")) <= F.greatest(F.lit(each), F.ceil(size * quantile))
    rows = scored.withColumn("_short", short & F.col("cluster").isNotNull())
    place = F.row_number().over(Window.partitionBy("task", "cluster", "_short").orderBy(F.desc("information"), F.desc("centrality"), F.desc(difference_rate(F.col("signature"))), "id"))
    rows = rows.withColumn("place", F.when(F.col("_short"), place))
    return rows.withColumn("representative", F.coalesce(F.col("place") <= each, F.lit(False))).drop("_short")


def targets(stacks: DataFrame) -> DataFrame:
    """One live mutant a cluster: its first representative that is active, else the active member with the greatest
    information, centrality and number of differing probes. Clusters without a live member have none."""
    differing = F.size(F.filter("signature", lambda x: x != 0))
    live = stacks.where("active AND cluster IS NOT NULL")
    order = Window.partitionBy("task", "cluster").orderBy(F.desc("representative"), F.when(F.col("representative"), F.col("place")), F.desc("information"), F.desc("centrality"), F.desc(differing), "id")
    return live.withColumn("_k", F.row_number().over(order)).where("_k = 1").select("task", "cluster", "id", F.when(F.col("representative"), "representative").otherwise("fallback").alias("why"))


def contexts(stacks: DataFrame) -> DataFrame:
    """task, cluster, size, surviving, representative_ids (in order), operators of the live members ('name:count',
    sorted), and how many distinct signatures they have."""
    rows = stacks.withColumn("operator", F.coalesce("operator", F.lit("")))
    live = rows.where("active")
    counts = live.groupBy("task", "cluster", "operator").agg(F.count(F.lit(1)).alias("n"))
    named = counts.groupBy("task", "cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("operator", "n"))), lambda x: F.concat(x["operator"], F.lit(":"), x["n"].cast("string"))), ",").alias("operators"))
    kinds = live.groupBy("task", "cluster").agg(F.count_distinct(F.coalesce("signature", F.array().cast("array<int>"))).alias("distinct_signatures"))
    whole = rows.groupBy("task", "cluster").agg(F.count(F.lit(1)).alias("size"), F.count_if("active").alias("surviving"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("representative"), F.struct("place", "id")))), lambda x: x["id"].cast("string")), ",").alias("representative_ids"))
    out = whole
    for part in (named, kinds):
        part = part.withColumnsRenamed({"task": "_t", "cluster": "_c"})
        out = out.join(part, F.col("task").eqNullSafe(F.col("_t")) & F.col("cluster").eqNullSafe(F.col("_c")), "left").drop("_t", "_c")
    return out.withColumns({"operators": F.coalesce("operators", F.lit("")), "distinct_signatures": F.coalesce("distinct_signatures", F.lit(0))})


def handoff(stacks: DataFrame, chosen: DataFrame) -> DataFrame:
    """A row a task with survivors: how many, the clusters they are in, their operators, and a sample for the next
    layer, the most central survivor of each cluster that has no target among `chosen` (task, id), most central
    first; signatures are in the sample only if they differ."""
    live = stacks.where("active").withColumn("operator", F.coalesce("operator", F.lit("")))
    shown = chosen.select(F.col("task").alias("_t"), F.col("id").alias("_i"), F.lit(True).alias("_target"))
    rows = live.join(shown, (F.col("task") == F.col("_t")) & (F.col("id") == F.col("_i")), "left")
    group = Window.partitionBy("task", "cluster")
    rows = rows.withColumns({"_shown": F.coalesce(F.bool_or("_target").over(group), F.lit(False)), "_k": F.row_number().over(group.orderBy(F.desc_nulls_last("centrality"), "id"))})
    entry = F.struct((-F.coalesce("centrality", F.lit(0.0))).alias("order"), "id", "operator", "change", "equivalence_status", "signature")
    each = rows.groupBy("task").agg(
        F.count(F.lit(1)).alias("surviving"),
        F.array_sort(F.collect_set("cluster")).alias("clusters"),
        F.array_sort(F.collect_list(F.when((F.col("_k") == 1) & ~F.col("_shown"), entry))).alias("_sample"),
    )
    counts = rows.groupBy("task", "operator").agg(F.count(F.lit(1)).alias("n")).groupBy("task").agg(F.transform(F.array_sort(F.collect_list(F.struct("operator", "n"))), lambda x: F.concat(x["operator"], F.lit(":"), x["n"].cast("string"))).alias("operators"))
    told = F.size(F.array_distinct(F.transform("_sample", lambda s: F.coalesce(s["signature"], F.array().cast("array<int>"))))) > 1
    sample = F.transform("_sample", lambda s: F.struct(s["id"].alias("id"), s["operator"].alias("operator"), s["change"].alias("change"), F.coalesce(s["equivalence_status"], F.lit("UNKNOWN")).alias("equivalence_status"), F.when(told, s["signature"]).alias("signature")))
    return each.join(counts, "task").select("task", "surviving", "clusters", "operators", sample.alias("sample"))


def handoff_text(rows: DataFrame, attempts_shown: int = 3, sample_shown: int = 6, calls_shown: int = 3) -> DataFrame:
    """rows (handoff with attempts: array of attempt, status, new_kills, calls, error, in order; stop_reason;
    previous_layer, previous_attempts, previous_survivors) as text for a prompt, in the column `text`."""
    failed = F.filter("attempts", lambda a: a["status"] == "ERROR")
    tried = F.filter("attempts", lambda a: a["status"].isin("PRODUCTIVE", "VALID_ZERO_KILL", "REJECTED"))
    productive = F.size(F.filter("attempts", lambda a: a["status"] == "PRODUCTIVE"))
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("?")) for p in parts))
    shown = F.slice(tried, F.greatest(F.lit(1), F.size(tried) - attempts_shown + 1), F.lit(attempts_shown))
    calls = lambda a: F.when(F.size(F.coalesce(a["calls"], F.array().cast("array<string>"))) > 0, F.array_join(F.slice(a["calls"], 1, calls_shown), "; ")).otherwise("(no candidate calls recorded)")
    lines = [
        F.array(text(F.size(F.coalesce("attempts", F.array().cast(rows.schema["attempts"].dataType))), " attempt(s) so far, ", productive, " productive, stopped: ", F.coalesce("stop_reason", F.lit("n/a")), ".")),
        F.when(F.size(failed) > 0, F.array(text(F.size(failed), " attempt(s) failed from an infrastructure error, not a rejected strategy -- no test was actually evaluated in those: ", F.substring(F.coalesce(F.get(failed, F.lit(0))["error"], F.lit("")), 1, 140)))),
        F.transform(shown, lambda a: text("- attempt ", a["attempt"], " [", a["status"], ", +", F.coalesce(a["new_kills"], F.lit(0)), " new kills]: ", calls(a))),
        F.array(text(F.col("surviving"), " mutant(s) still surviving overall (", F.when(F.size("operators") > 0, F.array_join("operators", ", ")).otherwise("none"), ").")),
        F.when(F.size("sample") > 0, F.array(F.lit("Other still-live clusters not in this round's targets:"))),
        F.transform(F.slice("sample", 1, sample_shown), lambda s: text("  - ", s["id"], " [", s["operator"], "] ", F.coalesce(s["change"], F.lit("")), " (equiv=", s["equivalence_status"], ")")),
        F.when(F.col("previous_layer").isNotNull(), F.array(text("Before this: ", F.col("previous_layer"), " ran ", F.coalesce("previous_attempts", F.lit(0)), " attempt(s), ", F.col("previous_survivors"), " survivor(s) handed forward."))),
    ]
    none = F.array().cast("array<string>")
    return rows.withColumn("text", F.array_join(F.concat(*(F.coalesce(x, none) for x in lines)), "\n"))


def layer_rules(rows: DataFrame) -> DataFrame:
    """rows (survivors after layers 1 and 2 as after1 and after2, max_layers) with layer2 and layer3: run, or why not."""
    second = F.when(F.col("after1") == 0, "all_mutants_killed_by_layer1").when(F.col("max_layers") < 2, "max_layers_below_2").otherwise("run")
    # without a second layer its survivors are those of the first
    left = F.when(F.col("max_layers") < 2, F.col("after1")).otherwise(F.col("after2"))
    third = F.when(F.col("after1") == 0, "all_mutants_killed_by_layer1").when(left == 0, "all_mutants_killed_before_layer3").when(F.col("max_layers") < 3, "max_layers_below_3").otherwise("run")
    return rows.withColumns({"layer2": second, "layer3": third})


def layer_metrics(layers: DataFrame) -> DataFrame:
    """layers (total_mutants, killed_mutants, new_kills, estimated_cost_usd, total_time_sec, total_tokens) with score,
    survivors and the guarded ratios."""
    return layers.withColumns({
        "mutation_score": share("killed_mutants", "total_mutants", 6),
        "surviving_mutants": F.greatest(F.lit(0), F.col("total_mutants") - F.col("killed_mutants")),
        "cost_per_killed_mutant": share("estimated_cost_usd", "killed_mutants", 8),
        "cost_per_new_kill": share("estimated_cost_usd", "new_kills", 8),
        "time_per_killed_mutant": share("total_time_sec", "killed_mutants", 4),
        "time_per_new_kill": share("total_time_sec", "new_kills", 4),
        "tokens_per_new_kill": share("total_tokens", "new_kills", 4),
    })


#: Probe values by type hint; of each group the first hint that is in it counts.
VALUES = (
    (("list", "^sequence", "^iterable"), (("str", ("[]", '["a"]', '["a", "b"]')), ("float", ("[]", "[0.0]", "[0.0, 1.0, -1.0]")), ("", ("[]", "[0]", "[0, 1, -1]", "[1, 2, 3]")))),
    (("tuple",), (("", ("()", "(0,)", "(0, 1)")),)),
    (("dict",), (("", ("{}", '{"a": 1}', "{0: 0, 1: 1}")),)),
    (("str",), (("", ('""', '"a"', '"abc"', '"aba"')),)),
    (("bool",), (("", ("False", "True")),)),
    (("float",), (("", ("0.0", "1.0", "-1.0", "0.5")),)),
    (("int",), (("", ("0", "1", "-1", "2")),)),
)
OTHER_VALUES = ("0", "1", '"a"', "[0, 1]")


def values_for_type(hint: Column) -> Column:
    """Probe values for a parameter's type hint."""
    plain = F.lower(F.replace(F.coalesce(hint, F.lit("")), F.lit(" "), F.lit("")))
    has = lambda word: plain.startswith(word[1:]) if word.startswith("^") else F.contains(plain, F.lit(word))
    literal = lambda values: F.array(*map(F.lit, values))
    found = F.lit(None).cast("array<string>")
    for words, kinds in VALUES:
        any_of = has(words[0])
        for w in words[1:]:
            any_of = any_of | has(w)
        for inside, values in kinds:
            found = F.coalesce(found, F.when(any_of & (has(inside) if inside else F.lit(True)), literal(values)))
    return F.coalesce(found, literal(OTHER_VALUES))


def attempt_histories(attempts: DataFrame, *keys: str) -> DataFrame:
    """keys, attempt_count, productive_attempts, infrastructure_errors, first_error of attempts (keys, attempt, status,
    failure_category, error).

    Failures of the infrastructure (status ERROR, or category LLM_API_ERROR) are no attempts of a strategy: they are
    counted apart, with the first one's message, 300 characters of it at most, 'unknown error' where it has none.
    """
    failed = (F.coalesce("status", F.lit("")) == "ERROR") | (F.coalesce("failure_category", F.lit("")) == "LLM_API_ERROR")
    first = F.min_by(F.when(failed, F.coalesce("error", F.lit("unknown error"))), F.when(failed, F.col("attempt")))
    return attempts.groupBy(*keys).agg(F.count_if(~failed).alias("attempt_count"), F.count_if(~failed & (F.col("status") == "PRODUCTIVE")).alias("productive_attempts"), F.count_if(failed).alias("infrastructure_errors"), F.substring(first, 1, 300).alias("first_error"))


def compact_summaries(scored: DataFrame) -> DataFrame:
    """What a prompt is told of a mutant: ids, operator, change, signature as text, centrality and information to four
    places (0 where there are none), status and equivalence."""
    four = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 4).alias(c)
    codes = F.array_join(F.transform(F.coalesce("signature", F.array().cast("array<int>")), lambda x: x.cast("string")), "")
    return scored.select("task", "id", "cluster", "operator", "change", codes.alias("signature"), four("centrality"), four("information"), F.when(F.col("active"), "SURVIVED").otherwise("KILLED").alias("status"), F.coalesce("equivalence_status", F.lit("UNKNOWN")).alias("equivalence_status"))
