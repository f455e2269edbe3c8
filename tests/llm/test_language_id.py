"""Profiles against a plain computation, letter by letter; hard rows; scripts of many letters."""

import random
import time

import numpy as np
import pytest

from killgrid.llm import language_id as li


def plain_profile(text):
    """The bundle of the n-grams of a text: runs of letters with one blank between and around them."""
    codes = [0]
    for c in f"{text or ''} ":
        code = ord(c.lower()[0]) if c.isalpha() else 0
        if code or codes[-1]:
            codes.append(code)
    letter = {c: li.letter_vectors(np.array([c]), li.DIMENSIONS, li.SEED)[0].astype(int) for c in set(codes)}
    out = np.zeros(li.DIMENSIONS, int)
    for i in range(len(codes) - li.GRAM + 1):
        gram = np.ones(li.DIMENSIONS, int)
        for k in range(li.GRAM):
            gram *= np.roll(letter[codes[i + k]], li.GRAM - 1 - k)
        out += gram
    return out


TEXTS = ["Hello, World!", "hello world", None, "", "42 !", "a", " ab", "ÄÖ ß İx", "你好 世界", "𝒳𝒴 word", "one  two\nthree", "x" * 500]


def test_letters_are_random():
    rows = li.letter_vectors(np.arange(1, 400), 1024, 7).astype(int)
    assert set(np.unique(rows)) == {-1, 1}
    near = np.abs(rows @ rows.T - 1024 * np.eye(len(rows), dtype=int))
    assert near.max() < 6 * 32  # six standard deviations
    assert not np.array_equal(rows, li.letter_vectors(np.arange(1, 400), 1024, 8))


@pytest.mark.parametrize("sparse", [0, li.SPARSE, 10**9])
def test_profiles(monkeypatch, sparse):
    """By table and by adding vectors, the same sums as letter by letter."""
    monkeypatch.setattr(li, "SPARSE", sparse)
    got, lettered = li.profiles(TEXTS)
    for i, t in enumerate(TEXTS):
        assert lettered[i] == any(c.isalpha() for c in t or "")
        if lettered[i]:
            assert np.array_equal(got[i].astype(int), plain_profile(t)), t


def test_many_letters_cost_no_more_than_their_number():
    r = random.Random(1)
    texts = ["".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(60)) for _ in range(1000)]
    li.profiles(texts[:20])
    start = time.process_time()
    got, _ = li.profiles(texts)
    assert time.process_time() - start < 1.5
    assert np.array_equal(got[7].astype(int), plain_profile(texts[7]))


SHAPE = "doc_id long, text string, lang string, held_out string, score int, row long"


def test_predictions_by_cosine(spark):
    """Prototypes and cosines worked out plainly, for rows of every kind."""
    r = random.Random(3)
    word = lambda letters: "".join(r.choices(letters, k=6))
    text = lambda letters, n=30: " ".join(word(letters) for _ in range(n))
    rows = [(i, text("aeioubcd" if i % 2 else "xyzwqvkj"), "one" if i % 2 else "two", "x", 1, 2) for i in range(40)]
    rows += [(100 + i, "".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(80)), "han", "x", 1, 2) for i in range(20)]
    tests = [(None, text("aeioubcd"), "two", "", 0, 0), (1007, "", None, "", 0, 0), (1008, None, None, "", 0, 0), (1009, "12 34", "one", "", 0, 0), (1010, text("xyzwqvkj", 20_000), None, "", 0, 0), (1011, "a", None, "", 0, 0)] + [(1012, "same words", None, "", 0, 0)] * 3
    docs = spark.createDataFrame(rows + tests, SHAPE).repartition(3)
    learned = li.learn(spark.createDataFrame(rows, SHAPE))
    want = {}
    for lang in ("one", "two", "han"):
        units = [np.rint(p / np.linalg.norm(p) * li.SCALE) for p in (plain_profile(x[1]) for x in rows if x[2] == lang)]
        total = np.sum(units, 0)
        want[lang] = total / np.linalg.norm(total)
        assert np.allclose(learned[lang], want[lang], atol=1e-5)
    got = li.predict(docs, learned).collect()
    assert len(got) == len(rows) + len(tests)
    by_id = {}
    for g in got:
        by_id.setdefault(g.doc_id, []).append((g.lang_pred, g.score))
    for i, t, *_ in rows + tests:
        p = plain_profile(t) if t and any(c.isalpha() for c in t) and len(t) < 5000 else None
        if p is not None:
            cosines = {k: float(p @ v / np.linalg.norm(p)) for k, v in want.items()}
            best = max(sorted(cosines), key=cosines.get)
            assert by_id[i][0][0] == best and by_id[i][0][1] == pytest.approx(max(0.0, cosines[best]), abs=1e-4)
    assert by_id[1007] == by_id[1008] == by_id[1009] == [("und", 0.0)] and len(set(by_id[1012])) == 1 and by_id[1010][0][0] == "two"
    assert li.predict(docs, {}).where("lang_pred <> 'und' OR score <> 0").count() == 0
    assert li.predict(docs.where("false"), learned).count() == 0
    # of prototypes with equal cosines the first in the alphabet counts
    tie = {"b": want["one"], "a": want["one"]}
    assert {g.lang_pred for g in li.predict(docs, tie).where("doc_id < 40 AND doc_id % 2 = 1").collect()} == {"a"}
