"""Maximal periodic runs of words, by the branching tandem repeats of a suffix tree.

For the texts of a slice together, words become numbers that differ between
texts, and one suffix tree is built: a suffix array by prefix doubling, the
lengths its neighbours share, and the tree's nodes as intervals of the array.
At a node of depth q, every leaf i outside the node's largest child is asked
whether i + q and i - q are leaves of the node too, which takes n log n
questions for all nodes. Where they are and the words after both differ, the 2q
words at the smaller of the two are a branching tandem repeat. A maximal run has
just one for its period, at its end; rotating it to the left, a word at a time
as far as words q apart agree, gives the run. Repeats of a repeated word
sequence are those whose end belongs to a shorter period already.

A run of at least `least` words and `times` periods has two places that share
least (1 - 1 / times) words or more, so texts where no stretch of so many words
occurs twice have no run, and their part of the tree is not built.

All steps work on whole arrays, each text stays within its row, nothing is
shuffled. Slices are bounded in bytes, so a task's memory is bounded by the
longest text.

Defined results
* words are what stands between spaces, tabs and line ends (bytes 9 to 13, 32);
  null and empty texts have no words, no runs and an empty collapsed text;
* ties between runs are by start, then period; repeated rows and ids are rows
  of their own; an empty table gives no rows;
* other columns, whatever their names, are carried in a struct.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_slices, table, text_or_empty

#: Words and periods a run has at least.
LEAST_WORDS, LEAST_TIMES = 24, 3
#: Bytes of text that share a tree.
SLICE = 1 << 20
RUNS = "array<struct<start: long, length: long, period: long>>"


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each span, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths - starts, lengths)


def _agreeing(s: np.ndarray, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """How many words agree from a and b on (step 1), or backwards from a - 1 and b - 1 (step -1).

    Windows double as long as they agree; a < b, and what ends a text agrees with nothing.
    """
    found = np.zeros(len(a), np.int64)
    open_, width = np.arange(len(a)), 4
    while len(open_):
        lengths = np.full(len(open_), width)
        if step > 0:
            lengths = np.minimum(lengths, len(s) - (b[open_] + found[open_]))
            x = _spans(a[open_] + found[open_], lengths)
            y = _spans(b[open_] + found[open_], lengths)
        else:
            lengths = np.minimum(lengths, a[open_] - found[open_])
            x = a[open_].repeat(lengths) - found[open_].repeat(lengths) - 1 - _spans(np.zeros_like(lengths), lengths)
            y = b[open_].repeat(lengths) - found[open_].repeat(lengths) - 1 - _spans(np.zeros_like(lengths), lengths)
        differ = np.flatnonzero(s[x] != s[y])
        row = np.repeat(np.arange(len(open_)), lengths)[differ]
        begins = np.cumsum(lengths) - lengths
        same = lengths.copy()
        row, first = np.unique(row, return_index=True)
        same[row] = differ[first] - begins[row]
        found[open_] += same
        open_ = open_[(same == lengths) & (lengths == width)]
        width *= 2
    return found


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of s in order, by prefix doubling over what is not yet told apart.

    Each text in s ends with a number no other place has, so that suffixes differ before they run out.
    """
    n = len(s)
    order = np.argsort(s, kind="stable")
    rank = np.empty(n, np.int64)
    head = np.flatnonzero(np.r_[True, s[order][1:] != s[order][:-1]])
    rank[order] = np.repeat(head, np.diff(np.r_[head, n]))
    slots = np.flatnonzero(np.repeat(np.diff(np.r_[head, n]) > 1, np.diff(np.r_[head, n])))
    k = 1
    while len(slots):
        at = order[slots]
        key = (rank[at] << 32) | rank[at + k]
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[slots] = at
        first = np.r_[True, key[1:] != key[:-1]]
        begin = np.flatnonzero(first)
        sizes = np.diff(np.r_[begin, len(slots)])
        rank[at] = np.repeat(slots[begin], sizes)
        slots = slots[np.repeat(sizes > 1, sizes)]
        k *= 2
    return order


def shared_lengths(s: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of each place in the suffix array, the words its suffix shares with the one before it.

    Where the words before both suffixes are equal, the length is that of the place before in the text, less one;
    only the others are compared word by word, n log n words in all.
    """
    n = len(s)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    i = np.arange(n)
    own = (i == 0) | (before <= 0)
    rest = ~own
    own[rest] = s[i[rest] - 1] != s[before[rest] - 1]
    own[order[0]] = True
    start = np.flatnonzero(own)
    met = start[before[start] >= 0]
    length = np.zeros(n, np.int64)
    a, b = np.minimum(met, before[met]), np.maximum(met, before[met])
    length[met] = _agreeing(s, a, b, 1)
    last = np.maximum.accumulate(np.where(own, i, 0))
    length = length[last] - (i - last)
    return length[order]


def _bounds(shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each place, how far to the left and right (inclusive, exclusive) the lengths are at least its own."""
    n = len(shared)
    tables = [shared]
    while 1 << len(tables) <= n:
        half = 1 << (len(tables) - 1)
        tables.append(np.minimum(tables[-1][:-half], tables[-1][half:]))
    left, right = np.arange(n), np.arange(n) + 1
    for level in range(len(tables) - 1, -1, -1):
        t, step = tables[level], 1 << level
        ok = np.flatnonzero(right + step <= n)
        ok = ok[t[right[ok]] >= shared[ok]]
        right[ok] += step
        ok = np.flatnonzero(left - step >= 0)
        ok = ok[t[left[ok] - step] >= shared[ok]]
        left[ok] -= step
    return left, right


def branching_repeats(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of the branching tandem repeats of s, each once."""
    n = len(s)
    none = np.zeros(0, np.int64)
    order = suffix_array(s)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    shared = shared_lengths(s, order)
    inner = np.flatnonzero(shared > 0)
    if not len(inner):
        return none, none
    left, right = _bounds(shared)
    # a node: suffixes left - 1 to right - 1 (inclusive), which share as many words as its depth; places of equal
    # length within it are where one child ends and the next begins
    node, split = np.unique(left[inner] * (n + 1) + right[inner], return_inverse=True)
    by = np.argsort(split, kind="stable")
    inner, split = inner[by], split[by]
    first = np.flatnonzero(np.r_[True, split[1:] != split[:-1]])
    count = np.diff(np.r_[first, len(split)])
    low, high = left[inner[first]] - 1, right[inner[first]]
    depth = shared[inner[first]]
    # children one after another: from the node's begin or a split to the next split or the node's end
    begins = np.empty(len(inner) + len(first), np.int64)
    lead = first + np.arange(len(first))
    begins[lead] = low
    rest = np.ones(len(begins), bool)
    rest[lead] = False
    begins[rest] = inner
    owner = np.repeat(np.arange(len(first)), count + 1)
    ends = np.r_[begins[1:], 0]
    ends[np.r_[lead[1:] - 1, len(begins) - 1]] = high
    sizes = ends - begins
    # all children but the largest
    largest = np.maximum.reduceat(sizes, lead)
    biggest = np.flatnonzero(sizes == largest[owner])
    _, keep = np.unique(owner[biggest], return_index=True)
    small = np.ones(len(begins), bool)
    small[biggest[keep]] = False
    leaf = order[_spans(begins[small], sizes[small])]
    of = np.repeat(owner[small], sizes[small])
    q = depth[of]
    starts, periods = [], []
    for other, start in ((leaf + q, leaf), (leaf - q, leaf - q)):
        inside = (other >= 0) & (other < n)
        x = rank[np.where(inside, other, 0)]
        ok = np.flatnonzero(inside & (x >= low[of]) & (x < high[of]))
        begin, p = start[ok], q[ok]
        # both share q words, so begin + 2q is inside the text or its end; branching: the words after differ
        ok = s[begin + p] != s[begin + 2 * p]
        starts.append(begin[ok])
        periods.append(p[ok])
    pair = np.unique(np.concatenate(starts) * (n + 1) + np.concatenate(periods))
    return pair // (n + 1), pair % (n + 1)


def maximal_runs(s: np.ndarray, least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> np.ndarray:
    """Rows (start, length, period) of s, by start and period. Each text in s ends with a number of its own."""
    start, period = branching_repeats(s)
    found = []
    end = start + 2 * period
    by = np.lexsort((period, end))
    start, period, end = start[by], period[by], end[by]
    while len(start):
        # the shortest period of each end is primitive; what it covers with multiples of it is no period of its own
        first = np.r_[True, end[1:] != end[:-1]]
        group = np.cumsum(first) - 1
        a, p, e = start[first], period[first], end[first]
        begin = a - _agreeing(s, a, a + p, -1)
        found.append(np.stack([begin, e - begin, p], 1))
        covered = (period % p[group] == 0) & (start >= begin[group])
        stay = ~first & ~covered
        start, period, end = start[stay], period[stay], end[stay]
    runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    runs = runs[(runs[:, 1] >= least) & (runs[:, 1] >= times * runs[:, 2])]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _repeating(ids: np.ndarray, text: np.ndarray, ends: np.ndarray, stretch: int) -> np.ndarray:
    """Texts in which some stretch of so many words occurs twice, by hashes of the greatest power of two of words that
    fits: others may be among them, none is missing."""
    key, factor, size = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95), 1
    while 2 * size <= stretch and len(key) > size:
        key = key[:-size] * factor + key[size:]
        factor, size = factor * factor, 2 * size
    at = np.arange(len(key))
    at = at[at + size <= ends[text[at]]]
    by = np.lexsort((key[at], text[at]))
    key, owner = key[at][by], text[at][by]
    return np.unique(owner[1:][(key[1:] == key[:-1]) & (owner[1:] == owner[:-1])])


def runs_of(words: list[list[bytes]], least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> dict[int, np.ndarray]:
    """Of the texts that have runs, by their place: rows (start, length, period)."""
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for own in words for w in own], np.int64)
    lengths = np.array([len(own) for own in words], np.int64)
    ends = np.cumsum(lengths)
    with np.errstate(over="ignore"):
        chosen = _repeating(ids, np.repeat(np.arange(len(words)), lengths), ends, -(-least * (times - 1) // times))
    if not len(chosen):
        return {}
    # numbers differ between texts, and each text ends with one that no other place has
    begins = np.cumsum(lengths[chosen] + 1) - lengths[chosen] - 1
    s = np.empty(int(np.sum(lengths[chosen] + 1)), np.int64)
    s[_spans(begins, lengths[chosen])] = ids[_spans(ends[chosen] - lengths[chosen], lengths[chosen])] + np.repeat(np.arange(len(chosen)) * len(known), lengths[chosen])
    s[begins + lengths[chosen]] = len(chosen) * len(known) + np.arange(len(chosen))
    runs = maximal_runs(s, least, times)
    of = np.searchsorted(begins, runs[:, 0], side="right") - 1
    runs[:, 0] -= begins[of]
    cuts = np.flatnonzero(np.diff(of)) + 1
    return {int(chosen[of[i]]): own for i, own in zip(np.r_[0, cuts], np.split(runs, cuts), strict=True)} if len(runs) else {}


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words but those that any run holds after its first period, joined by one space."""
    stay = np.ones(len(words), bool)
    for start, length, period in runs:
        stay[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(stay)])


def with_runs(docs: DataFrame, column: str = "text", carry: list[str] | None = None, least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> DataFrame:
    """row (the columns to carry, all by default), runs (array of start, length, period, by start and period) and
    collapsed (the words outside repeated periods) of each row. A run has `times` >= 2 periods at least."""
    if times < 2 or least < 1:
        raise ValueError("a run has two periods and a word at least")
    rows = docs.select(F.struct(*carry) if carry else F.struct("*"), text_or_empty(column)).toDF("row", "text")
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_slices(batches, "text", SLICE):
            # bytes.split() splits at bytes 9 to 13 and 32
            words = [t.as_py().split() for t in batch.column(1).cast(pa.binary())]
            runs = runs_of(words, least, times)
            own = [runs.get(i) for i in range(len(words))]
            lists = [[] if r is None else [dict(zip(("start", "length", "period"), map(int, x), strict=True)) for x in r] for r in own]
            texts = [b" ".join(w) if r is None else collapsed(w, r) for w, r in zip(words, own, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, kind), pa.array(texts, pa.binary()).cast(pa.string())], ["row", "runs", "collapsed"])

    return rows.mapInArrow(found, f"row {rows.schema['row'].dataType.simpleString()}, runs {RUNS}, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, exactly; ties by start, then period."""
    first = lambda a, b: F.when(a < b, -1).when(a > b, 1)
    order = lambda x, y: F.coalesce(first(y["length"] * x["period"], x["length"] * y["period"]), first(x["start"], y["start"]), first(x["period"], y["period"]), F.lit(0))
    return F.get(F.array_sort(runs, order), F.lit(0))


def _rewritten(docs: DataFrame) -> DataFrame:
    """doc_id, text: where crc32 of the id is a multiple of 10, the words from one on repeat a stretch that the id sets."""
    h = F.crc32(F.col("doc_id").cast("string"))
    some = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.array_remove(F.split(text_or_empty(), r"[\x20\x09-\x0D]+"), "")).alias("words"))
    some = some.select("doc_id", "text", "g", "words", (F.col("g") % F.greatest(F.size("words"), F.lit(1))).alias("a"))
    some = some.select("doc_id", "text", "words", "a", (F.floor((F.size("words") - F.col("a")) / (F.col("g") % 8 + 3)) + 1).alias("p"))
    again = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return some.select("doc_id", F.when(F.size("words") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id has no crc32: its words stay as they are."""
    found = with_runs(_rewritten(table(spark, sf_dir, "documents")), carry=["doc_id"])
    found = found.select("row.doc_id", "runs", "collapsed", strongest(F.col("runs")).alias("best"))
    written = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    milli = F.call_function("div", F.col("best.length") * 1000, F.col("best.period"))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli.alias("exponent_milli"), F.sha2(written, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
