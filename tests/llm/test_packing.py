"""Packing: the tokenizer's own ids, the exact optimum of small instances, hard rows."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from killgrid.llm import packing


def checked(h, capacity, effort=packing.EFFORT):
    plan = packing.complete_bins(h, capacity, effort)
    left = collections.Counter()
    for times, need in plan:
        assert times > 0 and sum(x * k for x, k in need.items()) <= capacity
        for x, k in need.items():
            left[x] += times * k
    assert left == h
    return sum(t for t, _ in plan)


def optimum(pieces, capacity):
    """Fewest sequences, by trying every sequence for every piece."""
    pieces, best = sorted(pieces, reverse=True), [len(pieces)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(pieces):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + pieces[i] <= capacity and bins[j] not in bins[:j]:
                bins[j] += pieces[i]
                go(i + 1, bins)
                bins[j] -= pieces[i]
        bins.append(pieces[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]


@pytest.mark.parametrize("pieces, capacity, want", [((9, 9, 7, 7, 7, 7, 5, 5), 20, 3), ((16, 15, 14, 14, 13, 12, 10, 10, 8, 5, 3), 30, 4)])
def test_other_fillings_are_tried(pieces, capacity, want):
    assert checked(collections.Counter(pieces), capacity) == want
    assert checked(collections.Counter(pieces), capacity, effort=0) > want


def test_small_instances_are_solved():
    random.seed(5)
    for _ in range(400):
        pieces = [random.randint(1, 20) for _ in range(random.randint(1, 11))]
        assert checked(collections.Counter(pieces), 20, 10**9) == optimum(pieces, 20)


def test_sums_give_the_filling_of_least_waste():
    random.seed(6)
    for _ in range(300):
        counts, room = [0] * 61, random.randint(1, 60)
        for _ in range(random.randint(1, 5)):
            counts[random.randint(1, 60)] += random.randint(1, 4)
        available = sum(1 << x for x in range(61) if counts[x])
        filled = lambda f: sum(x * k for x, k in f.items())
        a, b = packing.best_filling(available, counts, room, 10**9), packing._fullest(available, counts, room)
        assert filled(a) == filled(b) <= room and all(k <= counts[x] for x, k in b.items())
        wastes = [room - filled(f) for f in packing.undominated(available, counts, room, room, [10**9])]
        assert min(wastes) == room - filled(a) and len({tuple(f.items()) for f in packing.undominated(available, counts, room, room, [10**9])}) == len(wastes)


def test_pieces_are_the_tokenizers(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = [(-1, None), (-2, ""), (-3, "a b c 0 00 ½ 0x"), (-3, "a b c 0 00 ½ 0x"), (None, "x y" * 9000), (-4, "<s> </s>￾‍ 😀")]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        for k, a in enumerate(range(0, len(ids), 4096)):
            own = ids[a : a + 4096]
            want[r.doc_id, k, a, len(own), zlib.crc32(own.tobytes())] += 1
    rows = packing.pack(docs).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = collections.defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= 4096
    total = sum(r.length for r in rows)
    assert len(places) == -(-total // 4096)


def test_hostile_strings_tokenise_as_the_tokenizer_does():
    """Marks, cases, white space of every kind, special tokens and letters whose cases compose differently, slice after slice."""
    random.seed(3)
    parts = ["a", "B", "z", "0", "9", ".", ",", ";", "'s", "'S", "!", "?", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", " ", "  ", "\t", "\n", "\u00c9", "e\u0301", "H\u0331", "\u212a", "\u0130", "\u00df", "\u03a3", "\u4e2d", "\u00a0", "\u0085", "\x1c", "-", "don't", "WE'LL", "A.", "b!?", "x.:", ":", "\u200d", "\U0001f600", ""]
    path = public_tokenizers.path("word_bpe_49k.json")
    words, tokenizer = packing.WordIds(path), Tokenizer.from_file(path)
    for _ in range(20):
        texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 14))) for _ in range(300)] + [None]
        ids, bounds = words.encode(pa.array(texts), 1)
        for i, text in enumerate(texts):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_other_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "x", 2), (None, None, 6, "y", 3)], "doc_id long, text string, Length int, Rank string, part int")
    assert {(r.doc_id, r.length) for r in packing.pack(docs, capacity=16).collect()} == {(1, 3), (None, 1)}
    assert packing.pack(docs.limit(0)).count() == 0
