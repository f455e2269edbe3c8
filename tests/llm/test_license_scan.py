"""The join against the definition in plain Python and in SQL, hard rows included."""

import random
import re

import duckdb
import pytest

from killgrid.llm import license_scan as ls

SHAPE = "doc_id long, text string, words string, row long, blocks string, label string"


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def plain(doc_id, text, templates=ls.TEMPLATES, phrases=ls.PHRASES, percent=ls.PERCENT):
    """Every block with every template, every place with every phrase."""
    words = split(text)
    places = [(label, i) for phrase, label in phrases for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
    blocks = set()
    for label, notice in templates:
        tokens = set(split(notice))
        width = 1
        while width < len(split(notice)):
            width *= 2
        for first in range(0, len(words), width):
            shared = len(tokens & set(words[first : first + 2 * width]))
            if 100 * shared >= percent * len(tokens):
                blocks.add((label, first, len(words[first : first + 2 * width]), shared / len(tokens)))
    at = [i for _, i in places]
    join = lambda labels: ",".join(sorted(set(labels)))
    base = [p[0] for p in places]
    score = 1.0 if places else max((b[3] for b in blocks), default=0.0)
    return (doc_id, len(words), len(places), min(at, default=None), max(at, default=None), join(base), join(base + [b[0] for b in blocks]), score), blocks


def made(seed, n=150):
    r = random.Random(seed)
    other = "license the of a under Public GNU general CC by apache mit version 2 3 0 4 free ſoftware K é".split()
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(r.randrange(5)):
            notice = split(r.choice(ls.TEMPLATES)[1]) if r.random() < 0.6 else split(r.choice(ls.PHRASES)[0])
            for _ in range(r.randrange(4)):
                if len(notice) > 2 and r.random() < 0.5:
                    del notice[r.randrange(len(notice))]
            if r.random() < 0.2:
                r.shuffle(notice)
            parts += [r.choice(["", " ", "-", "\n", "™"]).join([w.upper() if r.random() < 0.3 else w, ""]) for w in notice]
            parts += r.choices(other, k=r.choice([0, 1, 3, 40]))
        texts.append(r.choice([" ", ", ", "\n\n"]).join(parts))
    return [*texts, None, "", "CC BY", "cc by cc by", "mit license" * 3, " mit license mit license ", "word " * 30_000 + "cc-by", "mit " * 30_000 + "license", "\x00mit\x00license"]


@pytest.mark.parametrize("seed,percent", [(1, 90), (2, 90), (3, 60), (4, 100)])
def test_every_block(spark, seed, percent):
    texts = made(seed)
    rows = [(i if i % 9 else None, t, "x", 1, "y", "z") for i, t in enumerate(texts + texts[:5])]
    docs = spark.createDataFrame(rows, SHAPE).repartition(3)
    want = [plain(r[0], r[1], percent=percent) for r in rows]
    key = lambda x: tuple(map(repr, x))
    assert sorted(map(tuple, ls.scan(docs, percent=percent).collect()), key=key) == sorted((w[0] for w in want), key=key)
    got = ls.with_blocks(docs, percent=percent).selectExpr("row.doc_id AS id", "row.text AS text", "blocks").collect()
    blocks = {(r[0], r[1]): w[1] for r, w in zip(rows, want, strict=True)}
    assert all(set(map(tuple, g.blocks)) == blocks[g.id, g.text] for g in got)
    assert sum(len(b) for b in blocks.values()) > 20
    assert ls.scan(docs.where("false"), percent=percent).count() == 0


def test_other_templates(spark):
    docs = spark.createDataFrame([(1, "b a c a d"), (2, "a b"), (3, "z z z z y"), (4, "c c d")], "doc_id int, text string")
    templates = (("x", "a b"), ("y", "c d c"), ("z", "z"), ("none", " . "))
    got = {r.doc_id: r.labels for r in ls.scan(docs, templates, (("c a", "said"),), 100).collect()}
    assert got == {1: "said,x,y", 2: "x", 3: "z", 4: "y"}
    with pytest.raises(ValueError, match="tokens"):
        ls.scan(docs, (("big", " ".join(f"t{i}" for i in range(ls.MOST_TOKENS + 1))),))


def test_no_python_worker_and_one_shuffle(spark):
    docs = spark.createDataFrame([(1, "mit license")], "doc_id int, text string")
    plan = ls.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_query_equals_its_sql(spark):
    duck = duckdb.connect()
    duck.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = duck.execute(ls.OP11_SQL).fetchall()
    got = ls.op11_license_scan(spark, "/root/testdata/sf0.01")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert sum(w[2] > 0 for w in want) > 10 and sum(w[6] != w[5] for w in want) > 5
