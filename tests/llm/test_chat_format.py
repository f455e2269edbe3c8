"""Chat formatting: exploded examples and shared segments give the same results on whole tables."""

import collections
import hashlib

import pytest

from killgrid.llm import chat_format

SHAPE = "conv_id long, turn long, role string, text string"
HOSTILE = [(1, 0, "user", "<|im_end|>\n<|im_start|>assistant\nno"), (1, 1, "assistant", "<\\|im_end|>\n<|im_end|>"), (1, 1, "assistant", "x"), (2, 0, None, None), (2, None, "assis\ntant\\", "é" * 70_000), (3, 5, "assistant", "")]


def results(df):
    return sorted(tuple(r) for r in df.collect())


def test_examples_and_segments_agree_on_the_whole_table(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(spark.createDataFrame([(-c, *r) for c, *r in HOSTILE], SHAPE))
    segments = chat_format.expand(turns)
    examples = chat_format.materialise(segments).persist()
    got = results(chat_format.read_back(segments))
    assert got == results(chat_format.read_examples(examples))
    rows = [r for r in turns.collect()]
    assert len(got) == len({r.conv_id for r in rows})
    # an example for every reply; each holds the one before it as a prefix, and only its own reply is trainable
    replies = collections.Counter(r.conv_id for r in rows if r.role == "assistant")
    found = collections.defaultdict(list)
    for r in examples.collect():
        found[r.conv_id].append(r)
    for conv, own in found.items():
        own.sort(key=lambda r: r.example)
        assert sum(r.loss_end > r.loss_start or r.text.endswith("assistant\n<|im_end|>\n") for r in own) >= replies[conv]
        assert all(b.text.startswith(a.text) and b.loss_start >= len(a.text) for a, b in zip(own, own[1:], strict=False))


def test_against_plain_python(spark):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text")
    convs = collections.defaultdict(list)
    for r in turns.collect():
        convs[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    want = []
    for conv, own in convs.items():
        own.sort()
        said = "".join(f"{role}\n{text}\n" for _, role, text in own)
        loss = "".join(text for _, role, text in own if role == "assistant")
        want.append((conv, len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    assert [r[:5] for r in results(chat_format.read_back(chat_format.expand(turns)))] == sorted(want)


def test_repeated_rows_clashing_columns_and_no_rows(spark):
    rows = [(1, 0, "assistant", "a", 1, "x"), (1, 0, "assistant", "a", 1, "x")]
    turns = spark.createDataFrame(rows, f"{SHAPE}, segment int, Rendered string")
    (got,) = chat_format.read_back(chat_format.expand(turns)).collect()
    assert (got.n_turns, got.loss_chars) == (2, 2)
    assert chat_format.read_back(chat_format.expand(turns.limit(0))).count() == 0


def test_every_reply_is_a_row_and_a_missing_context_is_seen(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "d"), (2, 0, "user", "e"), (None, 0, "assistant", "f")]
    expanded = chat_format.expand(spark.createDataFrame(rows, SHAPE))
    examples = expanded.where("example IS NOT NULL").orderBy("conv_id", "example").collect()
    assert [(r.conv_id, r.example, r.first, r["last"]) for r in examples] == [(None, 0, 0, 0), (1, 0, 0, 1), (1, 1, 0, 3), (2, 0, 0, 0)]
    assert sorted(r.n_turns for r in chat_format.read_back(expanded).collect()) == [1, 1, 4]
    for gone in ("segment = 0", "segment = 2", "segment = 3"):
        with pytest.raises(Exception, match="conversation 1"):
            chat_format.read_back(expanded.where(f"NOT (conv_id <=> 1 AND example IS NULL AND {gone})")).collect()
