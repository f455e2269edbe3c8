"""Queries over kill sets, matched budgets and paired differences; the oracles are written apart, by the definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binomial import two_sided_sign_test
from ..operators import asof, kill_sets, ranks, resampling
from .analytics import _DIFF, _PLATEAU, _SEQ
from .registry import dataframe_query


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- kill sets: orders are tasks, lines mutants; an order has one to three attempts ------------------
_RULES = ("l_quantity > 30", "l_discount >= 0.05D", "l_tax < 0.03D")


def kill_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS task", "l_linenumber AS mutant", "l_extendedprice", "filter(array(%s), a -> a <= task %% 3 + 1) AS hits" % ", ".join(f"CASE WHEN {r} THEN {i} END" for i, r in enumerate(_RULES, 1)))
    attempts = _table(spark, sf_dir, "orders").selectExpr("o_orderkey AS task", "explode(sequence(1, cast(o_orderkey % 3 AS int) + 1)) AS attempt")
    kills = lines.selectExpr("task", "mutant", "explode(hits) AS attempt")
    return kill_sets.progress(attempts, kills, lines.where("l_extendedprice > 50000"), lines, ["task"], "attempt")


def rater_meeting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as tasks, every tenth without a name; orders as mutants; two raters with rows of their own."""
    rows = _table(spark, sf_dir, "lineitem").selectExpr("CASE WHEN l_suppkey % 10 <> 0 THEN l_suppkey END AS task", "l_orderkey AS mutant", "l_quantity", "l_discount")
    return kill_sets.agreement(kill_sets.meeting(rows.where("l_quantity > 45"), rows.where("l_discount >= 0.09D"), rows, ["task"]))


# the line numbers of an order may repeat: a mutant is killed if any of its lines is
_FIRST = ", ".join(f"min(CASE WHEN {r.replace('D', '')} AND {i} <= l_orderkey % 3 + 1 THEN {i} END) AS k{i}" for i, r in enumerate(_RULES, 1))
dataframe_query("kill_bitmaps", kill_bitmaps, f"""
WITH m AS (SELECT l_orderkey AS task, l_linenumber AS mutant, max(l_extendedprice) > 50000 AS wanted, {_FIRST} FROM lineitem GROUP BY l_orderkey, l_linenumber),
f AS (SELECT *, coalesce(k1, k2, k3) AS first FROM m),
a AS (SELECT o_orderkey AS task, unnest(range(1, o_orderkey % 3 + 2)) AS attempt FROM orders),
x AS (SELECT a.task, a.attempt, f.wanted, f.first, f.mutant, (f.k1 = a.attempt OR f.k2 = a.attempt OR f.k3 = a.attempt) AS hit FROM a LEFT JOIN f ON f.task = a.task)
SELECT task, CAST(attempt AS INTEGER) AS attempt, count(*) FILTER (hit) AS kills, count(*) FILTER (hit AND first = attempt) AS new, count(*) FILTER (hit AND first < attempt) AS known,
 count(*) FILTER (first <= attempt) AS cumulative, count(*) FILTER (hit AND wanted) AS shared, count(*) FILTER (wanted AND coalesce(first, 9) > attempt) AS missed, count(*) FILTER (mutant IS NOT NULL AND coalesce(first, 9) > attempt) AS "left"
FROM x GROUP BY task, attempt""".replace("l_discount >= 0.05", "l_discount >= 0.05::DOUBLE").replace("l_tax < 0.03", "l_tax < 0.03::DOUBLE"))
dataframe_query("rater_meeting", rater_meeting, """
WITH m AS (SELECT CASE WHEN l_suppkey % 10 <> 0 THEN l_suppkey END AS task, l_orderkey, bool_or(l_quantity > 45) AS a, bool_or(l_discount >= 0.09::DOUBLE) AS b FROM lineitem GROUP BY ALL),
n AS (SELECT task, count(*) AS total, count(*) FILTER (a AND b) AS "both", count(*) FILTER (a AND NOT b) AS ours_only, count(*) FILTER (b AND NOT a) AS theirs_only, count(*) FILTER (NOT a AND NOT b) AS neither FROM m GROUP BY task)
SELECT *, round(("both" + neither) / total::DOUBLE, 4) AS accuracy, CASE WHEN "both" + ours_only > 0 THEN round("both" / ("both" + ours_only)::DOUBLE, 4) ELSE 0 END AS prec, CASE WHEN "both" + theirs_only > 0 THEN round("both" / ("both" + theirs_only)::DOUBLE, 4) ELSE 0 END AS recall,
 CASE WHEN 2 * "both" + ours_only + theirs_only > 0 THEN round(2 * "both" / (2 * "both" + ours_only + theirs_only)::DOUBLE, 4) ELSE 0 END AS f1 FROM n""")


# --- a baseline's score at the tokens another method spent: users' events are attempts, orders the other method ------
_HISTORY = """SELECT user_id, it, tokens, round(cast(kills AS double) / n, 6) AS score FROM (SELECT user_id, it,
  cast(sum(cast(round(value * 100) AS bigint)) OVER w AS bigint) AS tokens, sum(gain) OVER w AS kills, count(*) OVER (PARTITION BY user_id) AS n FROM a WINDOW w AS (PARTITION BY user_id ORDER BY it ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) h"""
_SPENT = """SELECT o_custkey AS user_id, cast(sum(cast(round(o_totalprice * 100) AS bigint)) AS bigint) AS budget, cast(coalesce(sum(CASE WHEN o_orderstatus <> 'O' THEN cast(round(o_totalprice * 100) AS bigint) END), 0) AS bigint) AS paid_budget FROM {orders} GROUP BY o_custkey"""


def matched_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: _table(spark, sf_dir, t) for t in ("events", "orders")}
    history = spark.sql(f"WITH {_SEQ} {_HISTORY}", **tables)
    flat = spark.sql(f"{_PLATEAU} SELECT user_id, cast(min(it) AS bigint) AS it FROM s WHERE streak >= 3 GROUP BY user_id", **tables)
    spent = spark.sql(f"SELECT u.user_id, coalesce(s.budget, 0) div 5000 AS budget, coalesce(s.paid_budget, 0) div 5000 AS paid_budget FROM (SELECT DISTINCT user_id FROM {{events}}) u LEFT JOIN ({_SPENT}) s ON s.user_id = u.user_id", **tables)
    tasks = spent.join(flat.withColumnRenamed("it", "plateau_it"), "user_id", "left")

    def at(left: DataFrame, on: str, known: DataFrame, by: str, names: dict[str, str]) -> DataFrame:
        found = asof.asof(left.withColumn("_at", F.col(on)), known.withColumn("_at", F.col(by)), ["user_id"], "_at", list(names))
        return found.drop("_at").withColumnsRenamed(names)

    out = at(tasks, "budget", history, "tokens", {"score": "score_at_budget", "tokens": "tokens_at_budget"})
    out = at(out, "paid_budget", history, "tokens", {"score": "score_at_paid_budget"})
    out = at(out, "plateau_it", history, "it", {"score": "score_at_plateau", "tokens": "tokens_at_plateau"})
    return out.na.fill(0, ["score_at_budget", "tokens_at_budget", "score_at_paid_budget", "score_at_plateau", "tokens_at_plateau", "plateau_it"])


_SEQ_O = _SEQ.replace("{events}", "events")
dataframe_query("matched_budget", matched_budget, f"""
{_PLATEAU.replace("{events}", "events")}, h AS ({_HISTORY}), spent AS ({_SPENT.replace("{orders}", "orders")}),
t AS (SELECT u.user_id, coalesce(s.budget, 0) // 5000 AS budget, coalesce(s.paid_budget, 0) // 5000 AS paid_budget, p.it AS plateau_it
  FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN spent s ON s.user_id = u.user_id LEFT JOIN (SELECT user_id, min(it) AS it FROM s WHERE streak >= 3 GROUP BY user_id) p ON p.user_id = u.user_id)
SELECT t.user_id, t.budget, t.paid_budget, coalesce(t.plateau_it, 0) AS plateau_it, coalesce(x.score, 0) AS score_at_budget, coalesce(x.tokens, 0) AS tokens_at_budget, coalesce(y.score, 0) AS score_at_paid_budget,
  coalesce(z.score, 0) AS score_at_plateau, coalesce(z.tokens, 0) AS tokens_at_plateau
FROM t ASOF LEFT JOIN h x ON x.user_id = t.user_id AND t.budget >= x.tokens ASOF LEFT JOIN h y ON y.user_id = t.user_id AND t.paid_budget >= y.tokens LEFT JOIN h z ON z.user_id = t.user_id AND z.it = t.plateau_it""")


# --- paired differences -----------------------------------------------------------------------------------
def _differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"WITH {_DIFF} SELECT d FROM d", events=_table(spark, sf_dir, "events"))


def effect_sizes_of(differences: DataFrame, column: str = "d") -> DataFrame:
    """dz and rank_biserial of a column of paired differences; ties share their average rank, differences within
    1e-12 of 0 have none. dz is null below two rows or without spread, rank_biserial null without differences."""
    d = F.col(column)
    spread = differences.agg(F.when((F.count(d) >= 2) & (F.stddev_samp(d) > 1e-12), F.round(F.avg(d) / F.stddev_samp(d), 6)).alias("dz"))
    sizes = differences.where(F.abs(d) > 1e-12).groupBy(F.abs(d).alias("size")).agg(F.count(F.lit(1)).alias("times"), F.count_if(d > 0).alias("up"))
    ranked = ranks.tied_ranks(sizes, "size", "times")
    rank = F.col("mean_rank")
    signed = ranked.agg(F.round(F.sum((2 * F.col("up") - F.col("times")) * rank) / F.sum(F.col("times") * rank), 6).alias("rank_biserial"))
    return spread.crossJoin(signed)


def sign_test_of(differences: DataFrame, column: str = "d") -> DataFrame:
    """wins, losses and the exact two-sided p of a column of paired differences."""
    d = F.col(column)
    counts = differences.agg(F.count_if(d > 1e-12).alias("wins"), F.count_if(d < -1e-12).alias("losses"))
    return counts.select("wins", "losses", F.round(two_sided_sign_test(F.col("wins"), F.col("losses")), 6).alias("p"))


_DIFF_O = _DIFF.replace("{events}", "events")
dataframe_query("effect_sizes", lambda spark, sf_dir: effect_sizes_of(_differences(spark, sf_dir)), f"""WITH {_DIFF_O}, r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / cast(2 AS double) AS rk FROM d WHERE abs(d) > cast(1e-12 AS double))
SELECT (SELECT CASE WHEN count(*) >= 2 AND stddev_samp(d) > cast(1e-12 AS double) THEN round(avg(d) / stddev_samp(d), 6) END FROM d) AS dz, round(sum(CASE WHEN d > 0 THEN rk ELSE -rk END) / sum(rk), 6) AS rank_biserial FROM r""")
dataframe_query("paired_sign_test", lambda spark, sf_dir: sign_test_of(_differences(spark, sf_dir)), f"""WITH {_DIFF_O}, c AS (SELECT count(*) FILTER (d > 1e-12) AS w, count(*) FILTER (d < -1e-12) AS l FROM d)
SELECT w AS wins, l AS losses, round(least(1.0::double, 2 * sum(exp(lgamma(w + l + 1) - lgamma(i + 1) - lgamma(w + l - i + 1) + (w + l) * ln(0.5::double)))), 6) AS p FROM c, range(0, least(w, l) + 1) t(i) GROUP BY w, l""")


def subset_sign_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines against the mean quantity, a test for each supplier."""
    lines = _table(spark, sf_dir, "lineitem")
    counts = lines.groupBy(F.col("l_suppkey").alias("subset")).agg(F.count_if(F.col("l_quantity") > 25).alias("wins"), F.count_if(F.col("l_quantity") < 25).alias("losses"))
    return counts.select("subset", "wins", "losses", F.round(two_sided_sign_test(F.col("wins"), F.col("losses")), 6).alias("p"))


dataframe_query("subset_sign_tests", subset_sign_tests, """WITH c AS (SELECT l_suppkey AS subset, count(*) FILTER (l_quantity > 25) AS wins, count(*) FILTER (l_quantity < 25) AS losses FROM lineitem GROUP BY l_suppkey)
SELECT subset, wins, losses, round(least(1.0::double, 2 * list_sum([exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) + (wins + losses) * ln(0.5::double)) FOR i IN range(0, least(wins, losses) + 1)])), 6) AS p FROM c""")


def resampled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of a segment's mean balance, of the mean of its nations' means, and of balance for each nation key."""
    rows = _table(spark, sf_dir, "customer").selectExpr("c_mktsegment AS subset", "c_acctbal AS num", "c_nationkey + 1 AS den", "CASE WHEN c_custkey % 50 = 0 THEN ' ' ELSE cast(c_nationkey AS string) END AS cluster")
    ways = {"mean": {}, "ratio": {"den": "den"}, "clustered": {"cluster": "cluster"}}
    parts = [resampling.intervals(rows, ["subset"], "num", **how).withColumn("way", F.lit(way)) for way, how in ways.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


dataframe_query("resampled_scores", resampled_scores)
