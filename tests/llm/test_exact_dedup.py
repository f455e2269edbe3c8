"""Exact dedup: batches against the index, hard rows, clashing names."""

import collections
import random

from killgrid.llm import exact_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for i, t in rows:
        own = groups[(t or "").translate(LOWER)]
        keep = max((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), i == keep))
    return collections.Counter(out)


def test_batches_give_what_one_look_gives(spark):
    random.seed(2)
    rows = [(random.choice([None, *range(60)]), random.choice(["", None, "É x", "é x", "A b", "a B", "c", "x" * 5000, "y"])) for _ in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for batches in (1, 4):
        got = collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.find_copies(docs, batches=batches).collect())
        assert got == brute(rows)
        assert exact_dedup.drop_copies(docs, batches=batches).count() == len({(t or "").translate(LOWER) for _, t in rows})


def test_later_documents_meet_the_index(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    shape = "doc_id long, text string"
    first = spark.createDataFrame([(1, "x"), (2, "y"), (3, "Y")], shape)
    exact_dedup.find_copies(first, index)
    files = set(index.read().inputFiles())
    later = spark.createDataFrame([(9, "X"), (8, "z"), (7, "x")], shape)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.find_copies(later, index).collect()}
    assert got == {9: (1, 3, False), 7: (1, 3, False), 8: (8, 1, True)}
    # what was there stays as it was, only what is new is appended
    assert files < set(index.read().inputFiles()) and index.read().count() == 3
    assert "SortMergeJoin" in index.read().join(first.select(exact_dedup.digest().alias("digest")).hint("merge"), "digest", "left_anti")._jdf.queryExecution().toString()
    index.drop()
    assert not index.exists()


def test_an_index_of_our_own_leaves_nothing_behind(spark):
    before = {t.name for t in spark.catalog.listTables()}
    assert exact_dedup.find_copies(spark.createDataFrame([(1, "x"), (2, "X")], "doc_id long, text string")).count() == 2
    assert {t.name for t in spark.catalog.listTables()} == before


def test_clashing_names(spark):
    rows = [(1, "a", "p", 1, 5), (2, "A", "q", 2, 6), (2, "A", "q", 2, 6), (None, None, None, 3, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Key string, digest int, `row` int")
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and sorted(kept.collect(), key=str) == sorted([r for i, r in enumerate(docs.collect()) if i in (1, 3)], key=str)


def test_buckets_follow_the_rows(spark, monkeypatch):
    """An index takes its number of buckets from its first batch and keeps it when it is opened again."""
    monkeypatch.setattr(exact_dedup, "BUCKET_ROWS", 10)
    docs = spark.range(200).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    index = exact_dedup.DigestIndex(spark)
    first = exact_dedup.find_copies(docs.where("doc_id < 100"), index, batches=1)
    assert first.where("kept").count() == 100 and index.buckets() == 10
    again = exact_dedup.DigestIndex(spark, index.name, index.path)
    second = exact_dedup.find_copies(docs, again, batches=2)
    assert again.buckets() == 10 and second.where("kept").count() == 200
    assert spark.sql(f"DESCRIBE EXTENDED {index.name}").where("col_name = 'Num Buckets'").first()["data_type"] == "10"
    index.drop()
