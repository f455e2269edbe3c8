"""Runs against the definition, worked out period by period; the query against it on a whole table."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from killgrid.llm import periodic_runs as pr


def plain_runs(words, least=24, times=3):
    """Each period, each stretch that agrees with itself a period later, longest first of those that meet."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j - i + q
            if length >= max(least, times * q) and not any(all(words[k] == words[k + p] for k in range(start, start + length - p)) for p in range(1, q)):
                found[start, length, q] = True
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def rewritten(doc_id, words):
    if doc_id is None or not words or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def answer(doc_id, text):
    words = rewritten(doc_id, split(text))
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def made(r, n):
    """Words with repeats of many kinds, nested ones among them."""
    words = []
    while len(words) < n:
        kind = r.random()
        root = [r.choice("ab" if kind < 0.5 else "abcdefgh") for _ in range(r.choice([1, 2, 3, 5, 8, 13]))]
        if r.random() < 0.3:
            root = root * 2 + root[:1]
        words += root * r.choice([1, 1, 3, 4, 9, 30]) + root[: r.randrange(len(root) + 1)]
        words += [r.choice("abxyz") for _ in range(r.choice([0, 1, 6]))]
    return words[:n]


@pytest.mark.parametrize("seed", range(12))
def test_runs_of_texts_together(seed):
    r = random.Random(seed)
    texts = [made(r, r.choice([0, 1, 5, 23, 24, 25, 60, 150])) for _ in range(12)] + [["a"] * 300, list("ab") * 90, ["x"] * 23, ["x"] * 24]
    least, times = r.choice([(24, 3), (24, 3), (1, 2), (6, 2), (10, 4), (24, 2)])
    got = pr.runs_of([[w.encode() for w in t] for t in texts], least, times)
    for i, t in enumerate(texts):
        assert [tuple(map(int, x)) for x in got.get(i, [])] == plain_runs(t, least, times), (least, times, t)


@pytest.mark.parametrize("seed", range(4))
def test_tree_parts(seed):
    r = random.Random(seed)
    s = np.array([r.randrange(3) for _ in range(200)] + [99])
    order = pr.suffix_array(s)
    rest = [tuple(s[i:]) for i in order]
    assert rest == sorted(rest)
    same = lambda a, b: next(k for k in range(len(s)) if k >= len(a) or k >= len(b) or a[k] != b[k])
    assert pr.shared_lengths(s, order).tolist() == [0] + [same(a, b) for a, b in zip(rest, rest[1:])]
    squares = {(i, q) for q in range(1, 101) for i in range(201 - 2 * q) if (s[i : i + q] == s[i + q : i + 2 * q]).all() and s[i + q] != s[i + 2 * q]}
    start, period = pr.branching_repeats(s)
    assert set(zip(start.tolist(), period.tolist())) == squares and len(start) == len(squares)


def test_whole_table(spark):
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    want = sorted(answer(i, t) for i, t in rows)
    got = pr.op12_periodic_runs(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect())) == want
    assert sum(x[1] > 0 for x in want) > 5


def test_hard_rows(spark, tmp_path):
    r = random.Random(7)
    texts = [None, "", " \t\n\v\f\r ", "a " * 23, "a " * 24, "    ".join(["é", "日本"] * 20), "x\x1cx " * 30, "b\u0085 " * 24, " ".join(made(r, 400))]
    rows = [(i, t, 1, 2, "c") for i, t in enumerate(texts * 12)] + [(None, t, 0, 0, None) for t in texts] + [(3, "a " * 24, 1, 1, "")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs long, row long, collapsed string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda x: tuple(map(repr, x))
    assert sorted(map(tuple, pr.op12_periodic_runs(spark, str(tmp_path)).collect()), key=key) == sorted((answer(r[0], r[1]) for r in rows), key=key)
    found = pr.with_runs(docs).select("row.*", "row.runs", "collapsed")
    assert found.count() == len(rows)
    assert pr.with_runs(docs.where("false")).count() == 0


def test_very_long_texts():
    r = random.Random(5)
    plain = [str(r.randrange(3000)).encode() for _ in range(120_000)]
    stretch = [str(i).encode() for i in range(20_000)]
    got = pr.runs_of([plain, [b"a"] * 200_000, stretch * 4 + stretch[:7], plain + [b"q"] + plain])
    assert {k: v.tolist() for k, v in got.items()} == {1: [[0, 200_000, 1]], 2: [[0, 80_007, 20_000]]}
