"""Best-fit packing of token sequences by bin completion with branch and bound.

Documents are tokenised, closed with an end id and cut into pieces of at most
`capacity` tokens. Pieces of one length are interchangeable, so the search
runs over a histogram of lengths (at most `capacity` rows, whatever the input
is): around the largest length left, undominated fillings of the rest of a
sequence are enumerated depth-first, pruned by bounds on the waste, with the
best-fit filling as the first incumbent. Using the filling of least waste as
often as the counts allow, again and again, gives the first packing. If that
takes more sequences than a lower bound, the search branches: other
undominated fillings, other numbers of uses, down to where the waste so far
rules out a better packing. It goes on until the bound is met, all is searched,
or EFFORT steps are made; the best packing found is used, and it holds all
pieces in any case. The plan says for every length which range of ranks goes
where; each piece finds its place from its rank among the pieces of its
length. Ranks are counted within write tasks and shifted by each task's
predecessors, so no length, however common, is gathered in one task.

Defined results: null text is empty; an empty text is the end id alone; only
documents longer than `capacity` are cut; repeated rows are packed as often as
they come; a null doc_id stays null; an empty table gives no rows; other
columns are ignored. The order of rows in sequences carries no meaning.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import arrow_slices, persist, table

CAPACITY, END_ID = 4096, 1
#: Steps of the depth-first search for one filling before it is settled by a table of reachable sums.
STEPS = 3000
#: Steps that branching over sequences may take beyond the first packing. It bounds time, not what is packed.
EFFORT = 300_000
#: What one try of a filling counts as, in steps of the enumeration of fillings.
TRY = 100
#: Word forms whose ids a worker keeps; when full, it starts again.
CACHE = 1_000_000
#: Word forms encoded at once: the tokenizer's answers are many times as large as the ids in them.
ENCODED = 8192

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long"


class WordIds:
    """Token ids of texts through a table of word forms. The tokenizer drops white space and never joins
    across it, so the ids of a text are the ids of its white-space separated chunks, one after another."""

    MARK = "0"  # a digit is always a word of its own: chunks without it can be encoded together, parted by it

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        (self.mark,) = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        upper, normal, pre = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.lowers = normal is not None and normal.normalize_str(upper) == upper.lower()
        alone = {m: self.tokenizer.encode(m, add_special_tokens=False).ids for m in ".,;:!?" if pre and all([w for w, _ in pre.pre_tokenize_str(c + m)] == [c, m] for c in "az09")}
        self.tails = {m: ids[0] for m, ids in alone.items() if len(ids) == 1}
        self.clear()

    def clear(self) -> None:
        # forms are known by a hash and by _ends (128 bits), in the order of the hash: some 40 bytes a form
        self.keys, self.checks = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids, self.used = np.zeros(4096, np.uint32), 0

    def _add(self, forms: pa.Array, keys: np.ndarray, checks: np.ndarray) -> None:
        """Learn word forms that aren't known, with their hashes: first their bodies, then what differs from its body."""
        bodies, tails = self._bodies(forms)
        other = ~pc.equal(bodies, forms).to_numpy(zero_copy_only=False)
        bodies = bodies.dictionary_encode()
        chunks = bodies.dictionary.to_pylist()
        body_keys, body_checks = np.fromiter(map(hash, chunks), np.int64, len(chunks)), self._ends(bodies.dictionary)
        missing = np.flatnonzero(self._places(body_keys, body_checks) < 0)
        if len(missing):
            self._encode([chunks[i] for i in missing.tolist()], body_keys[missing], body_checks[missing])
        places = self._places(body_keys, body_checks)[bodies.indices.to_numpy()[other]]
        keys, checks, tails = keys[other], checks[other], tails[other]
        starts, lengths, closed = self.starts[places].astype(np.int64), self.lengths[places].astype(np.int64), tails >= 0
        # a form that ends in a mark has the ids of its body and the mark's, once more; the others share their body's
        size = lengths[closed]
        ends = np.cumsum(size)
        flat = self.ids[np.repeat(starts[closed] - ends + size, size) + np.arange(int(size.sum()))]
        lengths[closed] += 1
        starts[closed] = self._append(np.insert(flat, ends, tails[closed].astype(np.uint32))) + ends - size + np.arange(len(ends))
        self._insert(keys, checks, starts, lengths)

    def _append(self, flat: np.ndarray) -> int:
        """Where the ids begin among all ids kept."""
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        return self.used - len(flat)

    def _insert(self, keys: np.ndarray, checks: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        at = np.searchsorted(self.keys, keys[order])
        self.keys, self.checks = np.insert(self.keys, at, keys[order]), np.insert(self.checks, at, checks[order])
        self.starts, self.lengths = np.insert(self.starts, at, starts[order]), np.insert(self.lengths, at, lengths[order])

    def _encode(self, chunks: list[str], keys: np.ndarray, checks: np.ndarray) -> None:
        """Learn word forms by the tokenizer."""
        coded = [self._coded(chunks[a : a + ENCODED]) for a in range(0, len(chunks), ENCODED)]
        own = np.concatenate([order + k * ENCODED for k, (order, _, _) in enumerate(coded)])
        new, flat = np.concatenate([x for _, x, _ in coded]), np.concatenate([x for _, _, x in coded])
        self._insert(keys[own], checks[own], self._append(flat) + np.cumsum(new) - new, new)

    def _coded(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places of the chunks in the order of their ids, how many ids each has, and the ids."""
        joined = [i for i, c in enumerate(chunks) if self.MARK not in c]
        single = [i for i, c in enumerate(chunks) if self.MARK in c]
        found: list[np.ndarray] = []
        if joined:
            (e,) = self.tokenizer.encode_batch_fast([f" {self.MARK} ".join([chunks[i] for i in joined])], add_special_tokens=False)
            ids = np.array(e.ids, np.uint32)
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) == len(joined) - 1:
                lengths = np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1
                found.append(ids[ids != self.mark])
            else:  # some other character became the mark: encode one by one
                single, joined = joined + single, []
        parts = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([chunks[i] for i in single], add_special_tokens=False)] if single else []
        new = np.concatenate([lengths if joined else np.zeros(0, np.int64), np.array([len(p) for p in parts], np.int64)])
        flat = np.concatenate([*found, *parts]) if found or parts else np.zeros(0, np.uint32)
        return np.array(joined + single, np.int64), new, flat

    def _bodies(self, forms: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """What has to be encoded of each form, and the id of the mark cut from its end or -1: forms that differ
        in case or in a closing mark only share a body. Others than ASCII are left as they are, as are special tokens."""
        plain = pc.and_(pc.string_is_ascii(forms), pc.invert(pc.match_substring(forms, "<|")))
        if self.lowers:
            forms = pc.if_else(plain, pc.ascii_lower(forms), forms)
        tails = np.full(len(forms), -1, np.int64)
        for mark, own in self.tails.items():
            closed = pc.and_(plain, pc.match_substring_regex(forms, f"[A-Za-z0-9][{mark}]$"))
            tails[closed.to_numpy(zero_copy_only=False)] = own
        return pc.if_else(pa.array(tails >= 0), pc.utf8_slice_codeunits(forms, 0, -1), forms), tails

    @staticmethod
    def _ends(forms: pa.Array) -> np.ndarray:
        """64 bits of each form's first and last eight bytes and its length."""
        if not len(forms):
            return np.zeros(0, np.int64)
        offsets = np.frombuffer(forms.buffers()[1], np.int32)[forms.offset : forms.offset + len(forms) + 1].astype(np.int64)
        data = np.zeros(int(offsets[-1]) + 8, np.uint8)
        if raw := forms.buffers()[2]:
            data[: int(offsets[-1])] = np.frombuffer(raw, np.uint8)[: int(offsets[-1])]
        size = np.diff(offsets)
        eights = np.lib.stride_tricks.sliding_window_view(data, 8)
        mask = np.where(size > 0, (~np.uint64(0)) >> ((8 - np.clip(size, 1, 8)).astype(np.uint64) * np.uint64(8)), np.uint64(0))
        read = lambda at: np.ascontiguousarray(eights[at]).view(np.uint64).ravel() & mask
        first, last = read(offsets[:-1]), read(np.maximum(offsets[:-1], offsets[1:] - 8))
        mixed = (first ^ (first >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (last ^ (last >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return ((mixed ^ (mixed >> np.uint64(30))) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)

    def _places(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Where each form is among those known, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        order = np.argsort(keys, kind="stable")
        at = np.empty(len(keys), np.int64)
        at[order] = np.searchsorted(self.keys, keys[order])
        at = np.minimum(at, len(self.keys) - 1)
        for _ in range(4):  # forms that share the first hash stand side by side
            right = (self.keys[at] == keys) & (self.checks[at] != checks) & (at + 1 < len(self.keys))
            if not right.any():
                break
            at[right] += 1
        return np.where((self.keys[at] == keys) & (self.checks[at] == checks), at, -1)

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each closed with `end`, and where each text's ids begin (and the last end)."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        bounds = words.offsets.to_numpy().astype(np.int64)
        coded = words.flatten().dictionary_encode()
        forms = coded.dictionary.to_pylist()
        if len(self.keys) + len(forms) > CACHE:
            self.clear()
        keys, checks = np.fromiter(map(hash, forms), np.int64, len(forms)), self._ends(coded.dictionary)
        places = self._places(keys, checks)
        missing = np.flatnonzero(places < 0)
        if len(missing):
            self._add(coded.dictionary.take(pa.array(missing)), keys[missing], checks[missing])
            places = self._places(keys, checks)
            if (places < 0).any():
                raise ValueError("more word forms than can be told apart share a hash")
        slot = places[coded.indices.to_numpy()] if forms else np.zeros(0, np.int64)
        bounds -= bounds[0]
        lengths = self.lengths[slot].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        total = int(ends[-1])
        ids = self.ids[np.repeat(self.starts[slot] - ends[:-1], lengths) + np.arange(total)] if total else np.zeros(0, np.uint32)
        at = ends[bounds]
        out = np.insert(ids, at[1:], np.uint32(end))
        return out, at + np.arange(len(at))


_words: dict[str, WordIds] = {}


def _known(path: str) -> WordIds:
    """This worker's word forms. Named by the function a task gets, not its variable, which would be copied with it:
    what one task has learnt serves the next."""
    if path not in _words:
        _words[path] = WordIds(path)
    return _words[path]


def _cutter(path: str, capacity: int, end: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _known(path)
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in arrow_slices(batches, "text"):
            ids, bounds = words.encode(batch.column(1).cast(pa.string()), end)
            view = memoryview(ids.astype("<u4", copy=False)).cast("B")
            sizes = np.diff(bounds)
            pieces = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(sizes[row] - start, capacity)
            begin = bounds[row] + start
            crc = [zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(begin.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            ranks, kinds, counts = np.empty(len(row), np.int64), *np.unique(length, return_counts=True)
            ranks[order] = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(seen[kinds], counts)
            seen[kinds] += counts
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(row), part, np.int32)), pa.array(ranks)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank"])

    return cut


def best_filling(available: int, counts: list[int], room: int, steps: int = STEPS) -> dict[int, int]:
    """{length: pieces} that fill `room` with the least waste, largest first. available has a bit for each length in counts.

    Depth-first over lengths in falling order; all pieces of one length are taken in one step, as many as there
    are and fit, and fewer in turn on the way back, so a filling is as deep as it has different lengths. The
    first leaf is the best-fit filling; a branch is left when even all it may still take can't beat the
    incumbent's waste, and the search ends when the incumbent wastes nothing. Where that takes more than `steps`,
    the sums that can be reached at all settle it.
    """
    below = np.cumsum(np.array(counts[: room + 1], dtype=np.int64) * np.arange(room + 1)).tolist()

    def largest(limit: int) -> int:
        return (available & ((2 << limit) - 1)).bit_length() - 1

    best, waste = dict[int, int](), room
    taken: list[list[int]] = []  # [length, pieces]
    rest = limit = room
    while waste and steps > 0:
        x = largest(min(rest, limit))
        # waste bound: even all pieces of at most x together wouldn't beat the incumbent
        if x > 0 and below[x] > rest - waste:
            steps -= 1
            k = min(counts[x], rest // x)
            taken.append([x, k])
            rest, limit = rest - k * x, x - 1
            if rest < waste:
                best, waste = dict(taken), rest
            continue
        # one piece less of the last length; where that can't help, fewer of it can't either
        while taken:
            x = taken[-1][0]
            taken[-1][1] -= 1
            rest, limit = rest + x, x - 1
            if below[limit] > rest - waste:
                break
            rest += taken.pop()[1] * x
        else:
            break
        if not taken[-1][1]:
            taken.pop()
    else:
        if waste:
            best = _fullest(available, counts, room)
    return best


def _fullest(available: int, counts: list[int], room: int) -> dict[int, int]:
    """The filling of least waste, by the sums that lengths reach together (a bit for each sum)."""
    reached, full = [(0, 1)], (2 << room) - 1
    lengths = [x for x in range(1, room + 1) if available >> x & 1]
    for x in lengths:  # the smallest first: on the way back the longest are taken first
        sums, left, step = reached[-1][1], min(counts[x], room // x), 1
        while left > 0:
            k = min(step, left)
            sums |= sums << k * x & full
            left, step = left - k, 2 * step
        reached.append((x, sums))
    goal, out = reached[-1][1].bit_length() - 1, dict[int, int]()
    for (x, _), (_, before) in zip(reversed(reached[1:]), reversed(reached[:-1]), strict=True):
        k = min(counts[x], goal // x)
        while not before >> (goal - k * x) & 1:
            k -= 1
        if k:
            out[x] = k
            goal -= k * x
    return out


def undominated(available: int, counts: list[int], room: int, waste: int, steps: list[int]):
    """All fillings of `room` that waste at most `waste` and are not plainly dominated: no piece left over fits
    what they waste, nor does one fit in place of a shorter piece of theirs. Longest pieces first. steps[0] is
    counted down; at 0 the enumeration ends."""
    lengths = [x for x in range(min(room, len(counts) - 1), 0, -1) if available >> x & 1]
    suffix = [0] * (len(lengths) + 1)
    for i in range(len(lengths) - 1, -1, -1):
        suffix[i] = suffix[i + 1] + lengths[i] * counts[lengths[i]]
    path: list[tuple[int, int]] = []  # (place among lengths, pieces)
    i, rest = 0, room
    while steps[0] > 0:
        steps[0] -= 1
        if i < len(lengths) and rest and suffix[i] >= rest - waste:
            path.append((i, min(counts[lengths[i]], rest // lengths[i])))
            rest -= lengths[i] * path[-1][1]
            i += 1
            continue
        if rest <= waste:
            filling = {lengths[j]: k for j, k in path if k}
            spare = [x for x in lengths if counts[x] > filling.get(x, 0)]
            if not any(x <= rest or any(y < x <= y + rest for y in filling) for x in spare):
                yield filling
        while path and not path[-1][1]:
            path.pop()
        if not path:
            return
        j, k = path.pop()
        rest = room - sum(lengths[a] * b for a, b in path) - lengths[j] * (k - 1)
        path.append((j, k - 1))
        i = j + 1


def lower_bound(counts: list[int], capacity: int) -> int:
    """Sequences that any packing needs: pieces above half are alone with others of at most what they leave."""
    n = np.array(counts, np.int64)
    pieces, tokens = (np.concatenate([[0], np.cumsum(x)]) for x in (n, n * np.arange(len(n))))  # of lengths below the index
    half = capacity // 2 + 1
    k = np.flatnonzero(n[:half])
    k = k[k > 0]
    alone = pieces[-1] - pieces[capacity - k + 1]
    paired = pieces[capacity - k + 1] - pieces[half]
    room = paired * capacity - (tokens[capacity - k + 1] - tokens[half])
    more = np.maximum(0, -((room - (tokens[half] - tokens[k])) // capacity))
    return int(max(-(-tokens[-1] // capacity), pieces[-1] - pieces[half], (alone + paired + more).max(initial=0)))


def _take(counts: list[int], available: int, times: int, need: dict[int, int]) -> int:
    """counts without the pieces of `times` sequences (negative: with them again); the new available."""
    for x, k in need.items():
        counts[x] -= times * k
        available = available | 1 << x if counts[x] else available & ~(1 << x)
    return available


def _least_waste(counts: list[int], available: int, capacity: int) -> dict[int, int]:
    """The filling of least waste around the largest piece."""
    top = available.bit_length() - 1
    one = _take(counts, available, 1, {top: 1})
    need = {top: 1}
    for x, k in best_filling(one, counts, capacity - top).items():
        need[x] = need.get(x, 0) + k
    _take(counts, one, -1, {top: 1})
    return need


def _completed(counts: list[int], available: int, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Sequences until nothing is left, each filling used as often as it can be. counts is used up.

    Every step empties one of its lengths, or leaves fewer of it than the filling takes (at most capacity /
    length): the plan's size is bounded by the capacity, not the input.
    """
    plan = []
    while available:
        need = _least_waste(counts, available, capacity)
        times = min(counts[x] // k for x, k in need.items())
        available = _take(counts, available, times, need)
        plan.append((times, need))
    return plan


def complete_bins(histogram: dict[int, int], capacity: int = CAPACITY, effort: int = EFFORT) -> list[tuple[int, dict[int, int]]]:
    """(how many sequences, {length: pieces in each}) until all pieces of the histogram are placed.

    The first packing is that of _completed. Where it isn't at the lower bound, other fillings of a sequence and
    other numbers of uses are tried, depth-first, fillings of least waste first. A branch is left when the waste
    up to it leaves no packing with fewer sequences than the incumbent.
    """
    counts = [0] * (capacity + 1)
    for length, n in histogram.items():
        counts[length] = n
    available = sum(1 << x for x in range(1, capacity + 1) if counts[x])
    best = _completed(list(counts), available, capacity)
    bound, size = lower_bound(counts, capacity), sum(times for times, _ in best)
    if size <= bound:
        return best
    # waste that a packing of one sequence less may have in all
    slack = (size - 1) * capacity - sum(x * n for x, n in enumerate(counts))
    plan: list[tuple[int, dict[int, int]]] = []
    used, steps = 0, [effort]

    def choices(slack: int):
        """(times, filling) around the largest piece, the filling of least waste first; each as often as it can be, then, for a search that leaves nothing out, once."""
        top = available.bit_length() - 1
        first = _least_waste(counts, available, capacity)
        counts[top] -= 1
        own, room = list(counts), capacity - top
        counts[top] += 1
        one = available if own[top] else available & ~(1 << top)
        once = []
        yield from _uses(first, slack, once)
        for found in undominated(one, own, room, min(room, slack), steps):
            need = {top: 1}
            for x, k in found.items():
                need[x] = need.get(x, 0) + k
            if need != first:
                yield from _uses(need, slack, once)
        yield from once

    def _uses(need: dict[int, int], slack: int, once: list):
        waste, most = capacity - sum(x * k for x, k in need.items()), min(counts[x] // k for x, k in need.items())
        if waste > slack:
            return
        if waste:
            most = min(most, slack // waste)
        yield most, need
        if most > 1:
            once.append((1, need))

    stack = [choices(slack)]
    spent = [0]  # waste of each plan entry's prefix
    while stack and steps[0] > 0 and size > bound:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if plan:
                times, need = plan.pop()
                used -= times
                available = _take(counts, available, -times, need)
                spent.pop()
            continue
        steps[0] -= TRY
        times, need = step
        waste = times * (capacity - sum(x * k for x, k in need.items()))
        available = _take(counts, available, times, need)
        plan.append(step)
        used += times
        spent.append(spent[-1] + waste)
        if not available and used < size:
            best, size = list(plan), used
            slack = (size - 1) * capacity - sum(x * n for x, n in histogram.items())
        if available and spent[-1] <= slack and used + lower_bound(counts, capacity) < size:
            stack.append(choices(slack - spent[-1]))
        else:
            plan.pop()
            used -= times
            available = _take(counts, available, -times, need)
            spent.pop()
    return best


def _placed(plan: list[tuple[int, dict[int, int]]], capacity: int):
    """Arrays by (length, first rank): pieces in each sequence, first sequence, first offset."""
    rows, first, base = [], dict[int, int](), 0
    for times, need in plan:
        offset = 0
        for x, k in need.items():
            rows.append((x, first.get(x, 0), k, base, offset))
            first[x] = first.get(x, 0) + times * k
            offset += x * k
        base += times
    rows.sort()
    return np.array(rows, np.int64).reshape(-1, 5).T


def _placer(tables):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, each, base, offset = tables.value
        for batch in batches:
            if not batch.num_rows:
                continue
            own = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            n, rank = own["length"].to_numpy(), own["rank"].to_numpy()
            # two keys in one search: ranks are below 2**50
            k = np.searchsorted((length << 50) + first, (n << 50) + rank, side="right") - 1
            o = rank - first[k]
            yield pa.RecordBatch.from_arrays([own["doc_id"], own["piece"], own["start"], own["length"], own["ids_crc32"], pa.array(base[k] + o // each[k]), pa.array(offset[k] + o % each[k] * n)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return place


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    own = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    pieces = persist(own.mapInArrow(_cutter(path, capacity, end_id), _PIECES), "pieces")
    by_task = pieces.groupBy("length", "part").count()
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # capacity rows at most
    tables = spark.sparkContext.broadcast(_placed(complete_bins(histogram, capacity), capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = by_task.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    ranked = pieces.join(shifts, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("local_rank") + F.col("shift")).alias("rank"))
    return ranked.mapInArrow(_placer(tables), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
