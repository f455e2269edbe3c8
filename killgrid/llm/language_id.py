"""Language identification with hyperdimensional profiles.

Every letter has a random bipolar vector; an n-gram is the product of its
letters' vectors, each rotated by its place; a text is the sum (bundle) of its
n-grams. A language's prototype is the bundle of its training texts' unit
vectors, and a text goes to the prototype with the largest cosine.

Training reads a sample of about TRAIN_DOCS labelled rows (chosen by a hash of
the id; the bound is a parameter, more rows hardly move a prototype);
prediction reads every text whole. Prototypes are summed as integers, so the
model doesn't depend on the order of tasks.

Defined results: a text that is null or has no letter is `und` with score 0;
so is every text where nothing can be learned; ties go to the language first
in the alphabet; rows with a null id are predicted but not learned from; rows
are independent, so repeated rows give repeated results; an empty table gives
no rows; other columns are ignored. score is the cosine, at least 0.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_slices, table

DIMENSIONS, GRAM, TRAIN_DOCS, SEED = 1024, 3, 40_000, 7
#: Entries of a table of texts by n-grams that cost as much as one n-gram's vector added by itself. Where the table
#: would be emptier (scripts of many letters) vectors are added; both ways give the same sums.
SPARSE = 16
#: Languages that training may yield; more is taken as an error in the labels.
MOST_LANGUAGES = 5000
SCALE = 1 << 20
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """By code point: the lower-case letter's code point, or 0 for what is no letter."""
    return np.array([ord(chr(i).lower()[0]) if chr(i).isalpha() else 0 for i in range(sys.maxunicode + 1)], np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def letter_vectors(codes: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """A row of random 1 and -1 for each letter: the bits of hashes of seed, letter and place."""
    words = np.arange(-(-dimensions // 64), dtype=np.uint64) + np.uint64(seed << 32)
    bits = _mix(_mix(codes.astype(np.uint64))[:, None] + _mix(words * np.uint64(0x9E3779B97F4A7C15)))
    rows = np.unpackbits(bits.view(np.uint8), axis=1)[:, :dimensions].astype(np.int8)
    return 2 * rows - 1


def gram_vectors(keys: np.ndarray, dimensions: int, n: int, seed: int) -> np.ndarray:
    """Rows of the n-grams whose letters are packed into keys, 21 bits each."""
    codes = [keys >> 21 * (n - 1 - i) & 0x1FFFFF for i in range(n)]
    known, place = np.unique(np.concatenate(codes), return_inverse=True)
    letters = letter_vectors(known, dimensions, seed)
    rows = np.ones((len(keys), dimensions), np.int8)
    for i, own in enumerate(np.split(place, n)):
        rows *= np.roll(letters, n - 1 - i, axis=1)[own]
    return rows


def profiles(texts: list[str | None], dimensions: int = DIMENSIONS, n: int = GRAM, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """A bundle for each text (float32 rows), and whether it has a letter."""
    sizes = np.array([len(t or "") + 2 for t in texts], np.int64)
    joined = "".join(f" {t or ''} " for t in texts)
    codes = _letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    row = np.repeat(np.arange(len(texts)), sizes)
    lettered = np.bincount(row[codes > 0], minlength=len(texts)) > 0
    keep = (codes > 0) | (np.concatenate([[1], codes[:-1]]) > 0)
    keep[np.cumsum(sizes) - sizes] = True  # a blank before each text
    codes, row = codes[keep], row[keep]
    if len(codes) < n:
        return np.zeros((len(texts), dimensions), np.float32), lettered
    keys = np.zeros(len(codes) - n + 1, np.int64)
    for i in range(n):
        keys = keys << 21 | codes[i : len(codes) - n + 1 + i]
    # an n-gram belongs to the text of its first letter; those over a text's end hold its last blank only
    inside = row[: len(keys)] == row[n - 1 :]
    keys, row = keys[inside], row[: len(keys)][inside]
    kinds, which = _coded(keys)
    if len(keys) * SPARSE < len(texts) * len(kinds):
        return _summed(keys, row, len(texts), dimensions, n, seed), lettered
    out = np.zeros((len(texts), dimensions), np.float32)
    step = 8192
    order = None
    if len(kinds) > step:
        order = np.argsort(which, kind="stable")
        which, row = which[order], row[order]
    for a in range(0, len(kinds), step):
        b = min(a + step, len(kinds))
        lo, hi = (0, len(which)) if order is None else np.searchsorted(which, [a, b])
        counts = np.bincount(row[lo:hi] * (b - a) + which[lo:hi] - a, minlength=len(texts) * (b - a)).reshape(len(texts), b - a)
        out += counts.astype(np.float32) @ gram_vectors(kinds[a:b], dimensions, n, seed).astype(np.float32)
    return out, lettered


def _summed(keys: np.ndarray, row: np.ndarray, texts: int, dimensions: int, n: int, seed: int, step: int = 2048) -> np.ndarray:
    """The bundles by adding up each occurrence's vector: work in proportion to the letters of the texts."""
    out = np.zeros((texts, dimensions), np.float32)
    for a in range(0, len(keys), step):
        own = row[a : a + step]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        out[own[first]] += np.add.reduceat(gram_vectors(keys[a : a + step], dimensions, n, seed), first, axis=0, dtype=np.int32)
    return out


def _coded(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and each key's number among them; by table where the letters are few, else by sorting."""
    letters = np.unique(np.concatenate([keys & 0x1FFFFF, keys >> 42 & 0x1FFFFF])) if len(keys) else keys
    k = len(letters)
    if 0 < k <= 160 and not keys.min() < 0 and keys.max() < 1 << 63:
        number = np.zeros(int(letters.max()) + 1, np.int64)
        middle = keys >> 21 & 0x1FFFFF
        if middle.max() < len(number):
            number[letters] = np.arange(k)
            small = (number[keys >> 42] * k + number[middle]) * k + number[keys & 0x1FFFFF]
            seen = np.flatnonzero(np.bincount(small, minlength=k**3))
            if np.isin(middle, letters).all():
                where = np.zeros(k**3, np.int64)
                where[seen] = np.arange(len(seen))
                return letters[seen // k // k] << 42 | letters[seen // k % k] << 21 | letters[seen % k], where[small]
    return np.unique(keys, return_inverse=True)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    for batch in arrow_slices(batches, "text", 1 << 20):
        yield batch, batch.column(column).to_pylist()


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


def learn(labelled: DataFrame, sample: int = TRAIN_DOCS) -> dict[str, np.ndarray]:
    """A unit prototype for each lang of labelled (doc_id, text, lang)."""
    rows = labelled.where("lang is not null and doc_id is not null").selectExpr("cast(doc_id as long) as doc_id", "cast(lang as string) as lang", "cast(text as string) as text")
    if (n := rows.count()) > sample:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_000)) < int(1_000_000 * sample / n))

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch, texts in _texts(batches, 1):
            unit = np.rint(_unit(profiles(texts)[0]) * SCALE).astype(np.int64)
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in set(langs.tolist()):
                sums[lang] = sums.get(lang, 0) + unit[langs == lang].sum(0)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))], names=["lang", "bundle"])

    parts = rows.select("lang", "text").mapInArrow(bundles, "lang string, bundle array<long>")
    summed = parts.select("lang", F.posexplode("bundle")).groupBy("lang", "pos").agg(F.sum("col").alias("v")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("v"))
    found = summed.select("lang", F.col("v.v").alias("v")).limit(MOST_LANGUAGES + 1).collect()  # a row for each language
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"lang has more than {MOST_LANGUAGES} values")
    return {r["lang"]: _unit(np.array([r["v"]], np.float64))[0] for r in sorted(found)}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    names = sorted(prototypes)
    model = docs.sparkSession.sparkContext.broadcast(np.array([prototypes[x] for x in names], np.float32).reshape(len(names), DIMENSIONS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.array([*names, UNKNOWN], object)
        for batch, texts in _texts(batches, 2):
            rows, lettered = profiles(texts)
            best, score = np.full(len(texts), len(names)), np.zeros(len(texts))
            if names:
                cosines = _unit(rows) @ model.value.T
                best, score = np.where(lettered, cosines.argmax(1), len(names)), np.where(lettered, cosines.max(1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(known[best], pa.string()), pa.array(np.clip(score, 0, 1).astype(np.float64))], names=["doc_id", "held_out", "lang_pred", "score"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, learn(docs.where(~held_out())))
