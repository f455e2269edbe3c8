"""Posteriors worked out by hand from the evidence; hard rows; many sites."""

import collections
import math

import numpy as np
import pytest

from killgrid.llm import quality


def strength(groups, toward):
    """Moments over groups (n, p), each with the prior it is shrunk toward."""
    total, square = sum(n for n, _ in groups), sum(n * n for n, _ in groups)
    if len(groups) < 2:
        return 1e6
    variance = sum(n * t * (1 - t) for (n, _), t in zip(groups, toward, strict=True)) / total
    between = sum(n * (p / n - t) ** 2 for (n, p), t in zip(groups, toward, strict=True))
    spread = (between - len(groups) * variance) / max(1e-9, total - square / total)
    return min(1e6, max(1.0, variance / spread - 1)) if spread > 1e-12 else 1e6


@pytest.mark.parametrize("broadcast", [True, False])
def test_posteriors_by_hand(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(quality, "BROADCAST_SITES", 0)
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.rate_documents(docs, labels).collect()
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(r.doc_id for r in docs.select("doc_id").collect())
    sums = collections.defaultdict(lambda: [0, 0.0])
    for r in rows:
        own = sums[r.host, r.path]
        own[0] += 1
        own[1] += 1 / (1 + math.exp(-r.evidence))
    hosts = collections.defaultdict(lambda: [0, 0.0])
    for (h, _), (n, p) in sums.items():
        hosts[h][0] += n
        hosts[h][1] += p
    rate = (sum(p for _, p in sums.values()) + 1) / (len(rows) + 2)
    k = strength(list(hosts.values()), [rate] * len(hosts))
    host_rate = {h: (p + k * rate) / (n + k) for h, (n, p) in hosts.items()}
    k = strength(list(sums.values()), [host_rate[h] for h, _ in sums])
    logit = lambda x: math.log(x / (1 - x))
    for r in rows:
        n, p = sums[r.host, r.path]
        path_rate = (p + k * host_rate[r.host]) / (n + k)
        assert abs(r.host_rate - host_rate[r.host]) < 2e-5 and abs(r.path_rate - path_rate) < 2e-5
        posterior = 1 / (1 + math.exp(-(r.evidence + logit(path_rate) - logit(rate))))
        assert abs(r.quality - posterior) < 1e-4 and (r.kept == (posterior >= quality.THRESHOLD) or abs(posterior - quality.THRESHOLD) < 1e-4)


def test_features_are_those_of_the_text():
    import pyarrow as pa

    texts = [None, "", "one two two three.\nFOUR!", "é" * 5]
    x = quality.features(pa.array(texts))
    for row, text in zip(x, texts, strict=True):
        data, words = (text or "").encode(), (text or "").split() or [""]
        want = np.sqrt(np.bincount(np.frombuffer(data, np.uint8), minlength=256) / max(1, len(data)))
        assert np.allclose(row[:256], want)
        n = max(1, len(words))
        assert np.isclose(row[256], sum(a == b for a, b in zip(words, words[1:], strict=False)) / n) and np.isclose(row[257], 1 - len(set(words)) / n)


def test_sparse_sites_stay_near_their_prior(spark):
    rows = [("a", f"a/{i % 2}", 3.0 if i % 2 else -3.0) for i in range(400)] + [("a", "a/new", 3.0), ("b", "b/x", -3.0)]
    evidence = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, host string, path string, logit double")
    rates, rate = quality.site_rates(evidence)
    got = {r.path: (r.host_rate, r.path_rate) for r in rates.collect()}
    assert abs(got["a/new"][1] - got["a/0"][0]) < abs(got["a/1"][1] - got["a/1"][0])
    assert got["a/0"][1] < 0.1 and got["a/1"][1] > 0.9 and abs(rate - 0.5) < 0.01


def test_hard_rows_and_clashing_names(spark):
    rows = [(1, "Aa bb", "en", "s", 1, "p"), (1, "Aa bb", "en", "s", 1, "p"), (None, None, None, None, 2, None), (3, "", "en", "t", 3, "q"), (4, "x " * 50_000, "de", "t", 4, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _kg_host int, Row string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 1), (None, 1), (3, None)], "doc_id long, quality int")
    got = quality.rate_documents(docs, labels).collect()
    assert len(got) == 5 and len({r.quality for r in got if r.doc_id == 1}) == 1
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and set(kept.collect()) <= set(docs.collect())
    one_kind = quality.keep_good(docs, labels.where("quality = 1"))
    assert collections.Counter(one_kind.collect()) == collections.Counter(docs.collect())
    assert quality.keep_good(docs.limit(0), labels).count() == 0 and quality.rate_documents(docs, labels.limit(0)).count() == 5
