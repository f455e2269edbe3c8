"""The pipeline's stages, each against brute force on its own input, with hard rows among the documents."""

import collections
import re

import corpus_pipeline as cp
import pytest

from killgrid.llm import mixing, quality

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(None, None, None, None, None), (None, "", "en", "s", 0), (9001, None, None, None, None), (9002, "word " * 20_000, "en", "s", 1), (9003, "a b c d e f", "en", "s", 1), (9003, "a b c d e f", "en", "s", 1)]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    return real.select(columns).unionByName(spark.createDataFrame(odd, real.select(columns).schema)).selectExpr("*", "1 as id", "2 as _KG_Row", "3 as `row`").persist()


def test_quality_keeps_what_its_decisions_say(spark, docs):
    decided = quality.rate_documents(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("kept")
    kept = cp.keep_good(spark, docs, SF)
    assert kept.columns == docs.columns
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter(r.doc_id for r in decided.collect())


def test_exact_copies(spark, docs):
    rows = docs.collect()
    want = {}
    for r in rows:
        key = (r.text or "").translate(LOWER)
        want[key] = max(want.get(key, -1), -1 if r.doc_id is None else r.doc_id)
    got = cp.drop_copies(spark, docs, SF)
    assert got.columns == docs.columns
    kept = [((r.text or "").translate(LOWER), -1 if r.doc_id is None else r.doc_id) for r in got.collect()]
    assert collections.Counter(kept) == collections.Counter(want.items())


def test_near_copies(spark, docs):
    rows = [r for r in docs.collect()]
    sets = [shingle_set(r.text) for r in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    best = {}
    for i, r in enumerate(rows):
        order = -1 if r.doc_id is None else r.doc_id
        best[top(i)] = min(best.get(top(i), (order, r.doc_id)), (order, r.doc_id), key=lambda x: x[0])
    got = cp.drop_near_copies(spark, docs, SF)
    assert got.columns == docs.columns
    assert collections.Counter(r.doc_id for r in got.collect()) == collections.Counter(x for _, x in best.values())


def test_mixing_and_packing(spark, docs):
    mixed = cp.mix_sources(spark, docs, SF)
    assert mixed.columns == docs.columns
    assert collections.Counter(r.doc_id for r in mixed.collect()) == collections.Counter(r.doc_id for r in mixing.mixture(docs).collect())
    assert set(mixed.collect()) == set(docs.collect())
    packed = cp.pack_sequences(spark, mixed, SF).collect()
    assert collections.Counter(r.doc_id for r in packed if r.piece == 0) == collections.Counter(r.doc_id for r in mixed.collect())


def test_empty_tables_go_through(spark, docs):
    rows = docs.limit(0)
    for _, stage in cp.STAGES[:-1]:
        rows = stage(spark, rows, SF)
        assert rows.columns == docs.columns and rows.count() == 0
    assert cp.STAGES[-1][1](spark, rows, SF).count() == 0


def test_the_whole_run(spark):
    rows = cp.run(spark, SF).collect()
    places = collections.defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= 4096
