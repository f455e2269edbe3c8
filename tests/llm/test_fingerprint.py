"""Fingerprints against a digest worked out window by window."""

import collections
import hashlib
import math
import random

from killgrid.llm import fingerprint as fp

MASK = (1 << 64) - 1


def mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def plain_digest(text):
    """The filters of a text, as sets of bits."""
    data, short = text.encode(), len(text.encode()) < fp.SHORT
    w, run, popular, typical, least = (fp.SHORT_WINDOW, fp.SHORT_RUN, fp.SHORT_POPULAR, fp.SHORT_TYPICAL, fp.SHORT_LEAST) if short else (fp.WINDOW, fp.RUN, fp.POPULAR, fp.TYPICAL, fp.LEAST)
    if not data:
        return []
    own = bytes(fp.SHORT_WINDOW - 1) + data if short else data
    fix, full = fp._FIX, int(math.log2(w) * w * fp._FIX)
    rank = []
    for i in range(len(own) - w + 1):
        s = sum(round(c * math.log2(c) * fix) for c in collections.Counter(own[i : i + w]).values())
        rank.append(1 if full - s < int(least * w * fix) else -abs(full - s - int(typical * w * fix)) >> 8)
    wins = collections.Counter()
    for a in range(len(rank) - run + 1):
        best = min(range(a, a + run), key=lambda i: (rank[i], i))
        if rank[best] <= 0:
            wins[best] += 1
    features = []
    for i in sorted(i for i, n in wins.items() if n >= popular):
        h = 0
        for k in range(w // 8):
            h = mix((h * 0x9E3779B97F4A7C15 + int.from_bytes(own[i + 8 * k : i + 8 * k + 8], "little") + k + 1) & MASK)
        if h not in features:
            features.append(h)
    features = features or [int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")]
    return [{h >> 11 * i & (fp.FILTER_BITS - 1) for h in features[a : a + fp.PER_FILTER] for i in range(fp.HASHES)} for a in range(0, len(features), fp.PER_FILTER)]


def plain_likeness(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    total = 0.0
    for x in a:
        total += max(0.0, max((len(x & y) - len(x) * len(y) / fp.FILTER_BITS) / (min(len(x), len(y)) - len(x) * len(y) / fp.FILTER_BITS) for y in b))
    return min(1.0, total / len(a))


def as_sets(hexed):
    raw = bytes.fromhex(hexed)
    n = fp.FILTER_BITS // 8
    return [{8 * i + j for i, byte in enumerate(raw[a : a + n]) for j in range(8) if byte >> j & 1} for a in range(0, len(raw), n)]


def test_every_row_against_the_plain_digest(spark):
    random.seed(7)
    long = "".join(random.choices("abcdefgh ,.\n", k=30_000))  # several filters
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("doc_id < 40").unionByName(
        spark.createDataFrame([(1001, ""), (1002, "a"), (1003, "That it."), (1004, "That it."), (1005, None), (1006, long), (1007, "x" * 600), (1008, "é" * 127), (1009, "ab" * 128), (None, "That it")], "doc_id long, text string"))
    rows = sorted(((r.doc_id if r.doc_id is not None else -math.inf), r.text or "") for r in docs.collect())
    got = {r.doc_id: r for r in fp.compare_with_next(docs, ranges=5).collect()}
    plain = [plain_digest(t) for _, t in rows]
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        new = text[: len(text) - len(text) // 4] + following[: len(text) // 4]
        r = got[None if i == -math.inf else i]
        edited = plain_digest(new)
        assert as_sets(r.fingerprint) == plain[k] and as_sets(r.edited_fingerprint) == edited, i
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert abs(r.near_edited - plain_likeness(plain[k], edited)) < 1e-9 and abs(r.near_next - plain_likeness(plain[k], plain[(k + 1) % len(rows)])) < 1e-9
    assert got[1003].fingerprint == got[1004].fingerprint and got[1003].near_next == 1


def test_edits_are_told_from_other_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = fp.compare_with_next(docs).where("n_chars >= 4 and near_next < 1").collect()
    assert sum(r.near_edited > max(0.3, r.near_next) for r in rows) >= 0.99 * len(rows)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 3, "k"), (1, "a b", 3, "k")], "doc_id long, text string, `Key` int, bucket string")
    assert fp.compare_with_next(docs).count() == 2
