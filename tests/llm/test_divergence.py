"""The audit against its SQL and against a dense count in plain Python, hard rows included."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from killgrid.llm import divergence

SHAPE = "doc_id long, text string, lang string, source string, n long, value long, part string"


def dense(rows, least=3, top=200):
    """Each term against each pair, by the definition."""
    docs = [(r[2] or "", r[3] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in r[1] or ""))) for r in rows]
    found = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        spread = Counter(t for d in own for t in set(d[2]))
        kept = {t for t, n in spread.items() if n >= least}
        count = defaultdict(Counter)
        for _, source, words in own:
            count[source].update(t for t in words if t in kept)
            count[None].update(t for t in words if t in kept)
        share = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept} for s, c in count.items()}
        f = lambda p, q: (p - q) ** 2 // q
        for s in share.keys() - {None}:
            pairs = sorted(((-sum(f(share[s][t], share[o][t]) for t in kept), o.encode(), o) for o in share.keys() - {None, s}))
            terms = sorted((-f(share[s][t], share[None][t]), t.encode(), t) for t in kept if count[s][t] and share[s][t] > share[None][t])[:top]
            found |= {(lang, s, part, item, -v, i) for part, x in (("pair", pairs), ("term", terms)) for i, (v, _, item) in enumerate(x, 1)}
    return found


def told(df):
    got = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got))
    return set(got)


def made(seed, n=200):
    r = random.Random(seed)
    words = ["the", "The", "café", "CAFÉ", "naïve", "x9y", "_", "日本", "a", "b", "İx"] + [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    rows = []
    for i in range(n):
        lang = r.choice(["en", "en", "de", None, ""])
        source = r.choice(["s1", "s2", "s3", None, f"rare{i}"]) if i % 3 else "hot"
        text = None if i % 17 == 0 else "" if i % 19 == 0 else " ".join(r.choices(words, k=r.randint(1, 40)))
        rows.append((i if i % 7 else None, text, lang, source, 1, 2, "pair"))
    return rows + rows[:20] + [(None, "word " * 30_000 + "only", "xx", "one", 0, 0, "")]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_the_dense_count(spark, seed):
    rows = made(seed)
    docs = spark.createDataFrame(rows, SHAPE).repartition(5)
    assert told(divergence.audit(docs)) == dense(rows)
    assert told(divergence.audit(docs, least_docs=1, top_terms=3)) == dense(rows, 1, 3)


def test_slices_and_handing_on_change_nothing(spark, monkeypatch):
    import pyarrow as pa

    rows = made(3)
    batch = pa.RecordBatch.from_pydict({"lang": [r[2] or "" for r in rows], "source": [r[3] or "" for r in rows], "text": [r[1] or "" for r in rows]})

    def added():
        sums = Counter()
        for b in divergence._partial_counts(iter([batch])):
            for x in b.to_pylist():
                sums[x["lang"], x["source"], x["term"], "n"] += x["n"]
                sums[x["lang"], x["source"], x["term"], "d"] += x["d"]
        return sums

    want = added()
    monkeypatch.setattr(divergence, "HELD", 3)
    assert added() == want


def test_no_kept_term_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "aa bb", "en", "s", 0, 0, ""), (2, "cc", "en", "t", 0, 0, "")], SHAPE)
    assert told(divergence.audit(docs)) == {("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)}
    assert divergence.audit(docs.where("false")).count() == 0


def test_counts_beyond_long(spark):
    """SCALE times a count of 10^12 passes 64 bits."""
    row = spark.range(1).selectExpr("1000000000000L AS c", "3000000000000L AS n", "1000L AS v").select(divergence._share("c", "n", "v").alias("p")).first()
    assert row.p == 1 + 10**9 * (10**12 + 1) // (3 * 10**12 + 1000)


def test_query_equals_its_sql(spark):
    duck = duckdb.connect()
    duck.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = duck.execute(divergence.OP13_SQL).fetchall()
    assert told(divergence.op13_divergence(spark, "/root/testdata/sf0.001")) == set(want) and len(want) > 1000
