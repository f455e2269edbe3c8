"""Queries on tables larger than what they were once cut to, against brute force."""

import collections
import statistics

import duckdb
import pytest

from killgrid import catalogue


def quantile(values, q):
    values = sorted(values)
    at = q * (len(values) - 1)
    low = int(at)
    return values[low] + (at - low) * (values[min(low + 1, len(values) - 1)] - values[low])


@pytest.mark.parametrize("name", ["bootstrap_mean_ci", "bootstrap_ratio_ci"])
def test_bootstrap_takes_every_customer(spark, tmp_path, name):
    rows = [(k, "AB"[k % 3 == 0], float(k * 7919 % 1000) + (5000 if k > 2000 else 0)) for k in range(1, 2401)]
    spark.createDataFrame(rows, "c_custkey long, c_mktsegment string, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    want = {}
    for g in "AB":
        own = [v for _, segment, v in rows if segment == g]
        n, means = len(own), []
        for b in range(200):
            at = [(b * 1103515245 + i * 12345 + 42) * 48271 % 2147483647 % n for i in range(n)]
            means.append(sum(own[i] for i in at) / (n if name == "bootstrap_mean_ci" else sum(i + 1 for i in at)))
        want[g] = statistics.fmean(means), quantile(means, 0.025), quantile(means, 0.975)
    got = {r["subset"]: (r["mean"], r["lo"], r["hi"]) for r in catalogue.queries()[name](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys()
    for g in want:
        assert got[g] == pytest.approx(want[g], abs=1e-3)


def test_ward_clusters_every_part(spark):
    sf = "/root/testdata/sf0.01"
    parts = {str(r["p_partkey"]) for r in spark.read.parquet(f"{sf}/part.parquet").select("p_partkey").collect()}
    rows = catalogue.queries()["ward_clusters"](spark, sf).collect()
    assert len(parts) > 200 and sorted(r["id"] for r in rows) == sorted(parts)
    assert max(collections.Counter(r["problem_id"] for r in rows).values()) <= 20
    assert all(0 <= r["cluster"] < 5 for r in rows)


@pytest.mark.parametrize("wins, losses", [(2600, 2500), (4100, 4150), (0, 0)])
def test_sign_test_of_many_users(spark, tmp_path, wins, losses):
    rows = [(u, "purchase" if u < wins else "click", 1.0) for u in range(wins + losses)] + [(-1, "view", 1.0)]
    spark.createDataFrame(rows, "user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    n = wins + losses
    term, tail = 1, 0  # binomials n over i, as whole numbers
    for i in range(min(wins, losses) + 1):
        tail += term
        term = term * (n - i) // (i + 1)
    p = min(1.0, 2 * tail * 10**9 // 2**n / 1e9)
    (got,) = catalogue.queries()["paired_sign_test"](spark, str(tmp_path)).collect()
    assert (got["wins"], got["losses"]) == (wins, losses) and got["p"] == pytest.approx(p, abs=2e-6)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert duck.execute(catalogue.oracle_sql()["paired_sign_test"]).fetchall() == [(wins, losses, got["p"])]
