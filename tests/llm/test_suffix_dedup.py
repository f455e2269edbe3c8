"""Suffix dedup against every window of whole tables, with passages planted on both sides of the length."""

import collections
import hashlib
import random

import pytest

from killgrid.llm import suffix_dedup

LENGTH = 400


def brute(texts, length=LENGTH):
    digest = lambda t, i: hash(t[i : i + length])
    count = collections.Counter(digest(t, i) for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[digest(t, i)] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
    return out


@pytest.fixture(scope="module")
def planted(spark):
    """Rows of documents with passages of 380 to 420 bytes put into two of them each, and what removal must give."""
    random.seed(9)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    plants, into = {}, iter(random.sample(range(400), 82))
    for n in range(380, 421):
        passage = "".join(random.choices("abcdefghijklmnop ", k=n))
        for i in (next(into), next(into)):
            at = random.randint(0, len(rows[i][1] or ""))
            rows[i] = (rows[i][0], f"{(rows[i][1] or '')[:at]}{passage}{(rows[i][1] or '')[at:]}")
        plants[n] = passage
    # a passage in many documents, each time with other bytes around it; periodic texts; a repeated row
    common = "".join(random.choices("qrstuvwxyz", k=390))
    rows += [(10_000 + i, f"{i:05d} {''.join(random.choices('abc', k=30))}{common}{random.choice('xy')}{''.join(random.choices('abc', k=20))}") for i in range(60)]
    rows += [(20_000, "ab" * 900), (20_001, "z" * 1500), (20_002, "é" * 199 + "a"), (20_003, rows[5][1]), (20_003, rows[5][1]), (None, None)]
    return rows, brute([(t or "").encode() for _, t in rows]), plants


@pytest.mark.parametrize("options", [{}, {"large": 3}, {"broadcast_bytes": 0}, {"large": 1, "broadcast_bytes": 0}])
def test_whole_table(spark, planted, options):
    rows, want, _ = planted
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.text) for r in suffix_dedup.remove_repeats(docs, **options).collect())
    assert got == collections.Counter((i, *w) for (i, _), w in zip(rows, want, strict=True))


def test_passages_on_both_sides_of_the_length(planted):
    rows, want, plants = planted
    for n, passage in plants.items():
        for (_, before), after in zip(rows, want, strict=True):
            if passage in (before or ""):
                # shorter ones may be part of a longer match with equal neighbours
                assert passage not in after[4] if n >= LENGTH else passage in after[4] or n > 392, n


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "x" * 500, 1, "a"), (2, "y", 2, "b")], "doc_id long, text string, `Hash` int, items string")
    got = {r.doc_id: (r.n_removed, r.text) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == {1: (500, ""), 2: (0, "y")}


def test_the_longest_texts_runs_are_few(spark):
    docs = spark.createDataFrame([(1, "ab" * 150_000), (2, "c" * 300_000)], "doc_id long, text string")
    spans = suffix_dedup.repeated_spans(suffix_dedup._Texts(docs, 1 << 26)).collect()
    assert len(spans) < 2000
    assert [(r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(docs).orderBy("doc_id").collect()] == [(300_000, 1), (300_000, 1)]


def test_groups_are_sorted_in_parts(monkeypatch):
    import pyarrow as pa

    random.seed(10)
    monkeypatch.setattr(suffix_dedup, "SORTED_BYTES", 3000)
    w = lambda n: "".join(random.choices("ab", k=n)).encode()
    shared = [w(420) for _ in range(5)]
    rows = [(g, i, 7, 100 * i, w(50) + shared[g] + w(random.randint(0, 60))) for g in range(5) for i in range(g * 20, g * 20 + random.choice([2, 9, 17]))]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[a : a + 7], strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["gram", "id", "hash", "start", "bytes"]) for a in range(0, len(rows), 7)]
    got = sorted((i, a, b) for batch in suffix_dedup._sort_groups(400)(iter(batches)) for i, _, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    count = collections.Counter((r[0], r[4][k : k + 400]) for r in rows for k in range(len(r[4]) - 399))
    want = []
    for g, i, _, start, text in rows:
        at = [k for k in range(len(text) - 399) if count[g, text[k : k + 400]] > 1]
        want.append((i, start + at[0], start + at[-1] + 400))
    assert got == want
