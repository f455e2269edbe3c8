"""Inputs at which operators once did less than the whole job."""

import collections
import random

from killgrid.llm import near_dedup, packing


def test_thousands_of_tiny_pieces_fill_sequences():
    for h in ({1: 20_000}, {4: 3000, 3: 3000, 2: 3000, 1: 9000}, {4000: 7, 700: 10, 1: 30_000}):
        plan = packing.complete_bins(h, 4096)
        left = collections.Counter()
        for times, need in plan:
            assert sum(x * k for x, k in need.items()) <= 4096
            for x, k in need.items():
                left[x] += times * k
        assert left == h
        assert sum(times for times, _ in plan) == -(-sum(x * n for x, n in h.items()) // 4096)


def test_a_search_cut_short_is_settled_by_sums():
    counts = [0, 50, 0, 0, 0, 0, 3, 3]
    found = packing.best_filling(0b11000010, counts + [0] * 60, 60, steps=2)
    assert sum(x * k for x, k in found.items()) == 60


def test_thousands_of_empty_texts(spark):
    rows = [(i, None if i % 2 else "") for i in range(6000)] + [(9000, "some words of a text")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    total = sum(r.length for r in got)
    assert len({r.sequence_id for r in got}) == -(-total // 4096)
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got) == 6001


def test_rows_without_a_doc_id_are_no_copies_of_each_other(spark):
    random.seed(6)
    text = lambda: " ".join(f"w{random.randint(0, 10**6)}" for _ in range(80))
    near = lambda t: t + " tail"
    a, b, c, d, e = (text() for _ in range(5))
    lone = [text() for _ in range(5)]
    rows = [(None, t) for t in lone] + [(None, near(a)), (5, a), (None, near(b)), (9, b), (9, text()), (7, c), (7, d), (8, near(d))]
    rows += [(None, e), (None, near(e)), (4, near(e)), (None, e), (None, ""), (None, None), (7, " ")]
    gone = collections.Counter([(5, a), (9, b), (8, near(d)), (4, near(e)), (None, e)])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = collections.Counter(tuple(r) for r in near_dedup.keep_one_each(docs).collect())
    # one of the null-id rows e, near(e) stays, whichever
    if kept[None, e]:
        gone[None, near(e)] += 1
    else:
        gone[None, e] += 1
    assert kept == collections.Counter(rows) - gone
    got = collections.Counter((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, 80, 5).collect())
    assert got[5, None, False] == got[9, None, False] == got[9, 9, True] == got[4, None, False] == got[8, 7, False] == 1
    assert got[7, 7, True] == 3 and got[None, None, False] >= 1 and sum(got.values()) == len(rows)
