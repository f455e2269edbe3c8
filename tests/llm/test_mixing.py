"""Mixing against a plain walk over blocks and rows, on a skewed table."""

import collections
import math

import pytest
from pyspark.sql import functions as F

from killgrid.llm import mixing

SHAPE = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def skewed(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs.select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, "big").when(F.col("doc_id") % 50 == 1, None).otherwise(F.col("source")).alias("source")).persist()


def entropy(weights):
    total = sum(weights)
    return -sum(w / total * math.log(w / total) for w in weights)


def walked(spark, docs, target, repeats, budget):
    """(doc_id, epoch) in the order of the mixture. Hashes are Spark's; all else is done row by row."""
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("hash")).collect()
    tokens = collections.Counter()
    for r in rows:
        tokens[r.source] += len(r.text.split())
    most, lo, hi = max(tokens.values()), 0.0, 1.0
    at = lambda a: {s: min(repeats, (most / t) ** (1 - a)) for s, t in tokens.items()}
    for _ in range(60):  # bisection
        mid = (lo + hi) / 2
        if entropy([tokens[s] * e for s, e in at(mid).items()]) >= target * math.log(len(tokens)):
            lo = mid
        else:
            hi = mid
    epochs = at(lo)
    if budget:
        scale = budget / sum(tokens[s] * e for s, e in epochs.items())
        epochs = {s: e * scale for s, e in epochs.items()}
    keys = [(s, b, e) for s in tokens for b in range(mixing.BLOCKS) for e in range(3)]
    order = {(r.s, r.b, r.e): r.h for r in spark.createDataFrame(keys, "s string, b int, e int").withColumn("h", F.xxhash64("s", "b", "e", F.lit(mixing.SEED))).collect()}
    own = {(r.h, r.e): r.o for r in spark.createDataFrame([(r.hash, e) for r in rows for e in range(3)], "h long, e int").withColumn("o", F.xxhash64("h", "e", F.lit(mixing.SEED))).collect()}
    out, quotas = [], {}
    for s in tokens:
        blocks = collections.defaultdict(list)
        for r in rows:
            if r.source == s:
                blocks[r.hash % mixing.BLOCKS].append(r)
        whole = int(round(epochs[s], 6))
        left = quotas[s] = (epochs[s] - whole) * tokens[s]
        for e in range(whole):
            out += [(e, order[s, b, e], own[r.hash, e], r.doc_id) for b, members in blocks.items() for r in members]
        for b in sorted(blocks, key=lambda b: order[s, b, whole]):
            for r in sorted(blocks[b], key=lambda r: r.hash):
                if len(r.text.split()) > left:
                    left = -1
                    break
                left -= len(r.text.split())
                out.append((whole, order[s, b, whole], own[r.hash, whole], r.doc_id))
            if left < 0:
                break
    return [(d, e) for e, _, _, d in sorted(out)], epochs


@pytest.mark.parametrize("share", [None, 0.6])
def test_mixture_is_the_walk(spark, skewed, share):
    total = sum(len((r.text or "").split()) for r in skewed.collect())
    budget = share and int(total * share)
    got = sorted((r.position, r.doc_id, r.epoch, r.source, r.epochs) for r in mixing.mixture(skewed, budget=budget).collect())
    want, epochs = walked(spark, skewed, mixing.TARGET_ENTROPY, mixing.MOST_REPEATS, budget)
    assert [g[0] for g in got] == list(range(len(got)))
    # quotas are cut at whole tokens: a row at the quota's end may differ by rounding, no other
    mine = [(d, e) for _, d, e, _, _ in got]
    assert len(set(mine) ^ set(want)) <= 2 * len(epochs)
    both = set(mine) & set(want)
    assert [x for x in mine if x in both] == [x for x in want if x in both]
    assert all(abs(epochs[s] - e) < 1e-5 for _, _, _, s, e in got)
    assert max(e for _, _, e, _, _ in got) >= (0 if share else 1) and len({round(e, 6) for *_, e in got}) > 1


def test_rows_leave_in_the_order_of_the_mixture(spark, skewed, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files, small as they are
    mixing.mixed(skewed).write.parquet(str(tmp_path / "mixed"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "mixed").glob("part-*.parquet"))
    own = [r.doc_id for f in files for r in spark.read.parquet(str(f)).collect()]
    want = [r.doc_id for r in mixing.mixture(skewed).orderBy("position").collect()]
    assert len(files) > 1 and own == want


def test_hard_rows(spark):
    rows = [(1, "a b", "s", 1, "p"), (1, "a b", "s", 1, "p"), (None, None, None, 2, None), (3, "", "t", 3, "q"), (4, "x " * 9000, "t", 4, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, Part int, `Hash` string")
    got = mixing.mixed(docs)
    assert got.columns == docs.columns and set(got.collect()) == set(docs.collect())
    assert mixing.mixed(spark.createDataFrame([], SHAPE)).count() == 0
    assert mixing.mixture(docs.limit(0)).count() == 0
