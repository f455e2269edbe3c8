"""Improbable-feature digests: likeness of texts from rare byte windows.

Every 64-byte window has a Shannon entropy; its rank is how far that lies from
what text usually has. In each run of 64 windows the leftmost one of the rarest
is counted; windows that win 16 runs or more are the text's features. Features
are hashed into a chain of Bloom filters (2048 bits, five bits a feature, 160
features a filter). Two digests are compared by the overlap of each filter of
the shorter chain with its best partner in the other, normalised between what
chance gives and what is possible.

For "the next document" rows are dealt to ranges of ids, sorted within them;
the first document of each range is sent to the range before as well, so that
no ordering ever passes through one task.

Texts below SHORT bytes have too few such runs to choose from. Theirs are 8-byte
windows, ranked by entropy in the same way in runs of 3, and one win is enough;
seven zero bytes stand before such a text, so that its first bytes count as much
as others; texts without such a run are one feature as a whole.

Defined results: null text is empty and has the empty fingerprint; equal fingerprints have
likeness 1, an empty one and any other 0; equal texts have equal fingerprints
wherever they stand; a null doc_id comes before all others, rows that share an
id are ordered by text; a table of one row has itself as next; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_slices, table

WINDOW, RUN, POPULAR = 64, 64, 16
FILTER_BITS, PER_FILTER, HASHES = 2048, 160, 5
#: Below SHORT bytes: window, run and wins of features.
SHORT, SHORT_WINDOW, SHORT_RUN, SHORT_POPULAR = 256, 8, 3, 1
#: Bits of entropy a 64-byte window of prose usually has, and the least that a feature may have.
TYPICAL, LEAST = 3.9, 0.5
#: The same for the windows of short texts: there, all kinds count.
SHORT_TYPICAL, SHORT_LEAST = 2.6, 0.0
_FIX = 1 << 16
_BLOCK = 1 << 16
_FIRST = -(1 << 63)


def _terms(window: int) -> np.ndarray:
    return np.array([0, *(round(c * np.log2(c) * _FIX) for c in range(1, window + 1))], np.int64)


def entropies(data: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Fixed-point sum of c*log2(c) over the byte counts of each window, by the window's start."""
    n, term = len(data) - window + 1, _terms(window)
    step = np.diff(term)
    before, after = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for a in range(0, len(data), _BLOCK):  # blocks stay in the cache
        b = min(len(data), a + _BLOCK)
        lo = max(0, a - window + 1)
        part = data[lo:b]
        for lag in range(1, min(window, len(part))):
            s = max(a, lo + lag)
            if s >= b:
                break
            same = (data[s:b] == data[s - lag : b - lag]).view(np.uint8)
            before[s:b] += same
            after[s - lag : b - lag] += same
    sums = np.empty(n, np.int64)
    sums[0] = term[np.bincount(data[:window], minlength=256)].sum()
    if n > 1:
        sums[1:] = sums[0] + np.cumsum(step[before[window:]] - step[after[: n - 1]])
    return sums


def _sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.int64).max)
    padded[:n] = keys
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _features(data: np.ndarray, owner: np.ndarray, window: int, run: int, popular: int, typical: float, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of the windows that win at least `popular` runs of their text. owner: each byte's text.

    A window's rank is how far its entropy lies from `typical` bits; those below `least` never win.
    """
    if len(data) < window + run - 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums, full = entropies(data, window), int(np.log2(window) * window * _FIX)
    rarity = -np.abs(full - sums - int(typical * window * _FIX)) >> 8
    rarity[full - sums < int(least * window * _FIX)] = 1
    # windows over a text's end never win: mark them with the largest rank
    rarity[owner[: len(sums)] != owner[window - 1 :]] = 2
    best = _sliding_min((rarity << 32) + np.arange(len(rarity)), run)
    won = best[owner[: len(best)] == owner[window + run - 2 :]]
    won = won[won >> 32 <= 0] & 0xFFFFFFFF
    at = np.flatnonzero(np.bincount(won, minlength=1) >= popular)
    words = np.lib.stride_tricks.sliding_window_view(data, window)[at].copy().view(np.uint64)
    hashes = np.zeros(len(at), np.uint64)
    for k in range(window // 8):
        hashes = _mix(hashes * np.uint64(0x9E3779B97F4A7C15) + words[:, k] + np.uint64(k + 1))
    return owner[at], hashes


def digests(texts: list[bytes]) -> list[np.ndarray]:
    """For each text its chain of filters: rows of FILTER_BITS / 64 words."""
    sizes = np.array([len(t) for t in texts], np.int64)
    parts = []
    for short, scale in ((False, (WINDOW, RUN, POPULAR, TYPICAL, LEAST)), (True, (SHORT_WINDOW, SHORT_RUN, SHORT_POPULAR, SHORT_TYPICAL, SHORT_LEAST))):
        own = [i for i in range(len(texts)) if (sizes[i] < SHORT) == short]
        ahead = bytes(SHORT_WINDOW - 1) if short else b""  # before short texts, so that windows reach back over their first bytes
        parts.append(_features(np.frombuffer(b"".join(ahead + texts[i] for i in own if sizes[i]), np.uint8), np.repeat(np.array(own, np.int64), np.where(sizes[own] > 0, sizes[own] + len(ahead), 0)), *scale))
    doc, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
    # texts without features: all their bytes are one
    found = np.bincount(doc, minlength=len(texts))
    alone = [i for i in range(len(texts)) if sizes[i] and not found[i]]
    if alone:
        own = [int.from_bytes(hashlib.blake2b(texts[i], digest_size=8).digest(), "little") for i in alone]
        doc, hashes = np.concatenate([doc, alone]), np.concatenate([hashes, np.array(own, np.uint64)])
    # the first of equal features of a text, in the order of the text
    order = np.lexsort((np.arange(len(doc)), hashes, doc))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (doc[order][1:] != doc[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    use = np.sort(order[fresh])
    use = use[np.argsort(doc[use], kind="stable")]
    doc, hashes = doc[use], hashes[use]
    counts = np.bincount(doc, minlength=len(texts))
    chains = -(-counts // PER_FILTER)
    first = np.cumsum(chains) - chains
    place = first[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)) // PER_FILTER
    bits = np.zeros((int(chains.sum()), FILTER_BITS), np.uint8)
    for i in range(HASHES):
        bits[place, (hashes >> np.uint64(11 * i) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = 1
    packed = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    return [packed[a : a + n] for a, n in zip(first.tolist(), chains.tolist(), strict=True)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; 1 for equal digests."""
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    ones_a, ones_b = np.bitwise_count(a).sum(1, dtype=np.int64), np.bitwise_count(b).sum(1, dtype=np.int64)
    total = 0.0
    for row, ones in zip(a, ones_a.tolist(), strict=True):
        common = np.bitwise_count(b & row).sum(1, dtype=np.int64)
        chance, most = ones * ones_b / FILTER_BITS, np.minimum(ones, ones_b)
        total += max(0.0, float(((common - chance) / (most - chance)).max()))
    return min(1.0, total / len(a))


def edited(text: str, following: str) -> str:
    """text with its last quarter replaced by as much of the beginning of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _dealer(bounds: np.ndarray, least: int):
    """Rows of (key, text) with their range; the first rows of a range also go to the range before, marked."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(bounds) + 1
        for batch in batches:
            key = batch.column(0).to_numpy()
            bucket = np.searchsorted(bounds, key, side="right")
            heads = np.flatnonzero(np.isin(key, bounds) | (key == least))
            back = np.where(key[heads] == least, n - 1, bucket[heads] - 1)
            for rows, where, mark in ((slice(None), bucket, 0), (heads, back, 1)):
                if len(where):
                    kept = batch if mark == 0 else batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int32)), pa.array(np.full(len(where), mark, np.int32)), kept.column(0), kept.column(1)], names=["bucket", "mark", "key", "text"])

    return deal


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    held = None  # the last row waits for the next one

    def rows(work: list[tuple[int, str, str]]):
        changed = [edited(t, n) for _, t, n in work]
        # texts in a row mostly are each other's next: one digest for each distinct text
        all_texts = list(dict.fromkeys([*(t for _, t, _ in work), *(n for _, _, n in work), *changed]))
        of = dict(zip(all_texts, digests([t.encode() for t in all_texts]), strict=True))
        own, new, nxt = [of[t] for _, t, _ in work], [of[t] for t in changed], [of[n] for _, _, n in work]
        return pa.RecordBatch.from_arrays([
            pa.array([None if k == _FIRST else k for k, _, _ in work], pa.int64()),
            pa.array([len(t) for _, t, _ in work], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
            pa.array([x.tobytes().hex() for x in own]),
            pa.array([x.tobytes().hex() for x in new]),
            pa.array([likeness(a, b) for a, b in zip(own, new, strict=True)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(own, nxt, strict=True)], pa.float64()),
        ], names=names)

    for batch in arrow_slices(batches, "text", 1 << 20):
        work = []
        for bucket, mark, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0] == bucket:
                work.append((held[1], held[2], text))
                held = None
            if not mark:
                held = (bucket, key, text)
        if work:
            yield rows(work)
    if held:
        raise ValueError("a range has no following document")


def compare_with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    spark = docs.sparkSession
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # percentile_approx gives ids that occur, so each range begins with one of its bounds
    found = own.agg(F.min("key"), F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], 20 * n)).first()
    least, cuts = found
    bounds = np.array(sorted({x for x in cuts or [] if x > least}), np.int64)
    dealt = own.mapInArrow(_dealer(bounds, least if least is not None else 0), "bucket int, mark int, key long, text string")
    # the ranges hashed to one task follow each other there, row by row
    sorted_rows = dealt.repartition("bucket").sortWithinPartitions("bucket", "mark", "key", "text")
    return sorted_rows.mapInArrow(_compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))
