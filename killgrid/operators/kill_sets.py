"""Sets of killed mutants as bits: 64 mutants a word, one row for each word that has any.

Union, difference and intersection of sets are `|`, `& ~` and `&` of words, their sizes `bit_count`. Words are
made by `bit_or`, an aggregate that Spark adds up before it shuffles; sparse sets have few words, where a bitmap of
fixed width would have 4 KB a key. Mutants are numbers within their task (any long); rows without a number are no
kills. Keys may be null: nulls are one task. A set that lacks a task is empty there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BEFORE = (Window.unboundedPreceding, -1)
_ALL = (Window.unboundedPreceding, Window.unboundedFollowing)


def _word(number: str) -> Column:
    return F.shiftright(F.col(number).cast("long"), 6)


def _bit(number: str) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col(number).cast("long"), F.lit(64)).cast("int"))


def _size(words: Column) -> Column:
    return F.bit_count(words).cast("long")


def words(kills: DataFrame, keys: list[str], number: str = "mutant") -> DataFrame:
    """keys, word, bits of the set that kills (keys, number) are for each combination of keys."""
    return kills.where(F.col(number).isNotNull()).groupBy(*keys, _word(number).alias("word")).agg(F.bit_or(_bit(number)).alias("bits"))


def together(sets: dict[str, DataFrame], keys: list[str], number: str = "mutant") -> DataFrame:
    """keys, word and a column of bits for each named set: a full outer meeting, as one union and aggregation, so
    that no task's rows meet unaggregated and a null key meets a null key."""
    zero = F.lit(0).cast("long")
    parts = [words(s, keys, number).select(*keys, "word", *((F.col("bits") if n == name else zero).alias(n) for n in sets)) for name, s in sets.items()]
    whole = reduce(DataFrame.unionByName, parts)
    return whole.groupBy(*keys, "word").agg(*(F.bit_or(n).alias(n) for n in sets))


def marked(tables: list[tuple[DataFrame, dict[str, Column]]], keys: list[str], number: str = "mutant") -> DataFrame:
    """keys, word and a column of bits for each named set, which is the numbers whose row meets its condition: as
    together(), but a table that holds several sets is read once."""
    zero = F.lit(0).cast("long")
    names = [n for _, sets in tables for n in sets]
    parts = []
    for rows, sets in tables:
        own = rows.where(F.col(number).isNotNull()).groupBy(*keys, _word(number).alias("word")).agg(*(F.bit_or(F.when(c, _bit(number)).otherwise(zero)).alias(n) for n, c in sets.items()))
        parts.append(own.select(*keys, "word", *(F.col(n) if n in sets else zero.alias(n) for n in names)))
    # Spark 4.1 plans a union of tables that are dealt alike as dealt so, but puts them one behind the other if it reuses
    # the shuffle of one: a key would be in two tasks. So the union is dealt again, otherwise than any of them
    return reduce(DataFrame.unionByName, parts).repartition("word", *keys).groupBy(*keys, "word").agg(*(F.bit_or(n).alias(n) for n in names))


def gains(kills: DataFrame, keys: list[str], attempt: str, number: str = "mutant") -> DataFrame:
    """One row per (keys, attempt) that has kills: kills, and new, those not killed by an attempt before (nulls first).
    A window holds a task's rows of one word."""
    before = F.coalesce(F.bit_or("bits").over(Window.partitionBy(*keys, "word").orderBy(attempt).rowsBetween(*_BEFORE)), F.lit(0).cast("long"))
    met = words(kills, [*keys, attempt], number).withColumn("_new", F.col("bits").bitwiseAND(F.bitwise_not(before)))
    return met.groupBy(*keys, attempt).agg(F.sum(_size(F.col("bits"))).alias("kills"), F.sum(_size(F.col("_new"))).alias("new"))


def meeting(ours: DataFrame, theirs: DataFrame, mutants: DataFrame, keys: list[str], number: str = "mutant") -> DataFrame:
    """keys, total, both, ours_only, theirs_only, neither of two raters, each a table of its own, over all mutants.

    A task that only `mutants` has counts as one that neither rater killed; kills of what isn't among the mutants
    count with them.
    """
    met = together({"_ours": ours, "_theirs": theirs, "_all": mutants}, keys, number)
    a, b, every = F.col("_ours"), F.col("_theirs"), F.col("_all").bitwiseOR(F.col("_ours")).bitwiseOR(F.col("_theirs"))
    neither = every.bitwiseAND(F.bitwise_not(a.bitwiseOR(b)))
    sizes = {"total": every, "both": a.bitwiseAND(b), "ours_only": a.bitwiseAND(F.bitwise_not(b)), "theirs_only": b.bitwiseAND(F.bitwise_not(a)), "neither": neither}
    return met.groupBy(*keys).agg(*(F.sum(_size(w)).alias(n) for n, w in sizes.items()))


def agreement(met: DataFrame) -> DataFrame:
    """meeting() with accuracy, prec, recall and f1, to four places, 0 where nothing can be divided by."""
    share = lambda a, b: F.when(b > 0, F.round(a / b, 4)).otherwise(F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("both", "ours_only", "theirs_only", "neither"))
    return met.withColumns({"accuracy": share(tp + tn, F.col("total")), "prec": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn)})


def progress(attempts: DataFrame, kills: DataFrame, official: DataFrame, mutants: DataFrame, keys: list[str], attempt: str, number: str = "mutant") -> DataFrame:
    """One row per distinct (keys, attempt) of attempts, in the order of `attempt` (nulls first) within a task:

    kills; new (not killed by an attempt before); known (killed before, too); cumulative (killed by now); shared
    (kills that the official set has); missed (the official set's mutants that no attempt has killed by now); left
    (all mutants not killed by now). Attempts without kills count 0; kills of attempts that aren't listed count in
    what was killed before. A window holds a task's rows of one word, or one row an attempt.
    """
    zero, long = F.lit(0).cast("long"), "long"
    own = words(kills, [*keys, attempt], number).withColumns({"_side": F.lit(1), "_official": zero})
    theirs = words(official, keys, number).select(*keys, F.lit(None).cast(own.schema[attempt].dataType).alias(attempt), "word", zero.alias("bits"), F.lit(0).alias("_side"), F.col("bits").alias("_official"))
    word = Window.partitionBy(*keys, "word")
    met = own.unionByName(theirs).withColumns({"_before": F.coalesce(F.bit_or("bits").over(word.orderBy("_side", attempt).rowsBetween(*_BEFORE)), zero), "_theirs": F.bit_or("_official").over(word.rowsBetween(*_ALL))})
    bits, before, other = F.col("bits"), F.col("_before"), F.col("_theirs")
    new = bits.bitwiseAND(F.bitwise_not(before))
    sizes = {"kills": bits, "new": new, "known": bits.bitwiseAND(before), "shared": bits.bitwiseAND(other), "_met": new.bitwiseAND(other)}
    gains = met.where("_side = 1").select(*keys, attempt, *(_size(w).alias(n) for n, w in sizes.items()))
    none = {n: zero for n in sizes}
    nobody = F.lit(None).cast(gains.schema[attempt].dataType).alias(attempt)
    totals = together({"_all": mutants, "_there": official}, keys, number).select(*keys, _size(F.col("_all").bitwiseOR(F.col("_there"))).alias("_total"), _size(F.col("_there")).alias("_wanted"))
    rows = [
        gains.withColumns({"_total": zero, "_wanted": zero, "_kind": F.lit(1), "_listed": F.lit(False)}),
        attempts.select(*keys, attempt).distinct().withColumns(none | {"_total": zero, "_wanted": zero, "_kind": F.lit(1), "_listed": F.lit(True)}),
        totals.select(*keys, nobody, "_total", "_wanted").withColumns(none | {"_kind": F.lit(0), "_listed": F.lit(False)}),
    ]
    added = [F.sum(n).cast(long).alias(n) for n in (*sizes, "_total", "_wanted")]
    each = reduce(DataFrame.unionByName, rows).groupBy(*keys, "_kind", attempt).agg(*added, F.bool_or("_listed").alias("_listed"))
    task = Window.partitionBy(*keys)
    so_far = task.orderBy("_kind", attempt).rowsBetween(Window.unboundedPreceding, 0)
    whole = lambda n: F.sum(n).over(task.rowsBetween(*_ALL))
    found = each.withColumns({"cumulative": F.sum("new").over(so_far), "missed": whole("_wanted") - F.sum("_met").over(so_far), "left": whole("_total") - F.sum("new").over(so_far)})
    return found.where("_kind = 1 and _listed").select(*keys, attempt, "kills", "new", "known", "cumulative", "shared", "missed", "left")


def labelled(mutants: DataFrame, kills: DataFrame, keys: list[str], label: str, number: str = "mutant", labels: str = "kill_tests") -> DataFrame:
    """mutants with status KILLED or SURVIVED by the cumulative set `kills`, and the label appended once to the
    array `labels` of those that are killed; a mutant that was killed before stays killed."""
    known = words(kills, keys, number).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("word").alias("_w"), F.col("bits").alias("_bits"))
    same = reduce(lambda a, b: a & b, [mutants[k].eqNullSafe(known[f"_k{i}"]) for i, k in enumerate(keys)], _word(number) == known["_w"])
    hit = F.coalesce(F.col("_bits").bitwiseAND(_bit(number)) != 0, F.lit(False))
    had = F.coalesce(F.col(labels), F.array().cast("array<string>"))
    dead = hit | F.coalesce(F.col("status") == "KILLED", F.lit(False)) if "status" in mutants.columns else hit
    rows = mutants.join(known, same, "left").withColumns({labels: F.when(hit & ~F.array_contains(had, label), F.array_append(had, label)).otherwise(had), "status": F.when(dead, "KILLED").otherwise("SURVIVED")})
    return rows.drop(*(f"_k{i}" for i in range(len(keys))), "_w", "_bits")
