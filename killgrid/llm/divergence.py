"""Which sources of a language use its words unlike the others, in exact integers.

The table of counts (terms x sources, a table a language) has many equal
columns: terms that occur equally often in each source. Terms are grouped by
their sparse vector of (source, count), every pair of sources is worked out
once a distinct vector and multiplied by the number of terms that share it.
Of a pair only the sources a vector has are visited: with f(a, b) for counts a
and b of a term in both sources,

  sum f(a, b) = V f(0, 0) + sum (f(a, 0) - f(0, 0)) + sum (f(0, b) - f(0, 0))
                + sum (f(a, b) - f(a, 0) - f(0, b) + f(0, 0))

where the last sum runs over terms that both have, the two before it over the
counts one source has, and V is the number of terms. Terms themselves are
ranked one by one.

Words are counted in Python workers, a slice of texts at a time; partial counts
of (lang, source, term) are added up by Spark.

Defined results
* null text, lang and source count as ''; '' is a language and a source like
  others; repeated rows are documents of their own;
* a term's share is p = 1 + floor(SCALE (count + 1) / (N + V)), N the counts of
  all kept terms; a divergence is floor((p - q)^2 / q);
* a source without kept terms has p of count 0 for each; a language without
  kept terms has divergence 0 between all its sources and no term rows;
* ties are ranked by the item's UTF-8 bytes; an empty table gives no rows;
* other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_slices, free_unused, join_skewed, persist, table, text_or_empty

SCALE = 10**9
#: Documents a term must be in, and terms reported a source.
LEAST_DOCS, TOP_TERMS = 3, 200
#: Partial counts a worker holds before it hands them on.
HELD = 500_000
#: Letters of any script: what isn't ASCII, or a-z after lower-casing.
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_PARTIAL = "lang string, source string, term string, n long, d long"


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, occurrences, documents) of slices of (lang, source, text)."""
    held: dict[tuple, dict[bytes, int]] = defaultdict(lambda: defaultdict(int))  # occurrences << 32 | documents
    size = 0

    def handed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in held.items():
            terms = pa.array(list(counts), pa.binary()).cast(pa.string())
            same = [pa.array([x] * len(terms), pa.string()) for x in (lang, source)]
            n, d = [v >> 32 for v in counts.values()], [v & 0xFFFFFFFF for v in counts.values()]
            yield pa.RecordBatch.from_arrays([*same, terms, pa.array(n, pa.int64()), pa.array(d, pa.int64())], ["lang", "source", "term", "n", "d"])
        held.clear()

    for batch in arrow_slices(batches, "text"):
        texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
            counts = held[lang, source]
            before = len(counts)
            # bytes.lower() changes A-Z only
            for term, n in Counter(_TERM.findall(text.as_py().lower())).items():
                counts[term] += n << 32 | 1
            size += len(counts) - before
            if size >= HELD:
                yield from handed_on()
                size = 0
    yield from handed_on()
    free_unused()


def term_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Kept terms: lang, term, total (occurrences in the language), vector (sorted array of source and n)."""
    rows = docs.select(text_or_empty("lang").alias("lang"), text_or_empty("source").alias("source"), text_or_empty().alias("text"))
    # dealt once, by what both sums need: workers have added up already, another sum before the shuffle finds no pairs
    counts = rows.mapInArrow(_partial_counts, _PARTIAL).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    # a vector has a place for each source of the language at most
    terms = counts.groupBy("lang", "term").agg(F.sum("d").alias("docs"), F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vector"))
    return terms.where(F.col("docs") >= least_docs).drop("docs")


def _share(count: Column | str, total: str, terms: str) -> Column:
    """p of a count; decimals, as SCALE times a count may pass 64 bits."""
    long = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")
    whole = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (long(count) + 1), F.greatest(long(total) + long(terms), F.lit(1)))
    return (whole + 1).cast("long")


def _divergence(p: Column, q: Column) -> Column:
    """p and q are at most SCALE + 1, so that the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), q).cast("decimal(38,0)")


def _pairs(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (lang, source, other, n_source, n_other, v) with value: each distinct vector counts as often as terms share it."""
    zero = F.lit(0)
    p = lambda c: _share(c, "n_source", "v")
    q = lambda c: _share(c, "n_other", "v")
    f = lambda a, b: _divergence(p(a), q(b))
    rows = vectors.select("lang", "times", "vector", F.explode("vector").alias("x"))
    one = rows.groupBy("lang", F.col("x.source").alias("at"), F.col("x.n").alias("n")).agg(F.sum("times").alias("times"))
    # each pair of sources once; read from both sides after equal counts are added up
    later = F.filter("vector", lambda y: y["source"] > F.col("x.source"))
    half = rows.select("lang", "times", "x", F.explode(later).alias("y")).groupBy("lang", "x", "y").agg(F.sum("times").alias("times"))
    told = lambda x, y: half.select("lang", F.col(f"{x}.source").alias("source"), F.col(f"{y}.source").alias("other"), F.col(f"{x}.n").alias("a"), F.col(f"{y}.n").alias("b"), "times")
    both = told("x", "y").unionByName(told("y", "x"))
    mine = one.withColumnRenamed("at", "source").join(pairs, ["lang", "source"])
    theirs = one.withColumnRenamed("at", "other").join(pairs, ["lang", "other"])
    n = F.col("n")
    key = ["lang", "source", "other"]
    parts = [
        pairs.select(*key, (F.col("v") * f(zero, zero)).cast("decimal(38,0)").alias("part")),
        mine.select(*key, (F.col("times") * (f(n, zero) - f(zero, zero))).cast("decimal(38,0)").alias("part")),
        theirs.select(*key, (F.col("times") * (f(zero, n) - f(zero, zero))).cast("decimal(38,0)").alias("part")),
        both.join(pairs, key).select(*key, (F.col("times") * (f(F.col("a"), F.col("b")) - f(F.col("a"), zero) - f(zero, F.col("b")) + f(zero, zero))).cast("decimal(38,0)").alias("part")),
    ]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return whole.groupBy(*key).agg(F.sum("part").cast("long").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item (the other source, or a term), value, rank."""
    terms = persist(term_counts(docs, least_docs), "terms")
    vectors = terms.groupBy("lang", "vector").agg(F.count(F.lit(1)).alias("times"))
    rows = terms.select("lang", "term", "total", F.explode("vector").alias("x")).select("lang", "term", "total", "x.source", "x.n")

    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("n_lang"))
    used = rows.groupBy("lang", "source").agg(F.sum("n").alias("n_source"), F.count(F.lit(1)).alias("size"))
    groups = docs.select(text_or_empty("lang").alias("lang"), text_or_empty("source").alias("source")).distinct()
    groups = groups.join(used, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    groups = persist(groups, "groups")

    others = groups.select("lang", F.col("source").alias("other"), F.col("n_source").alias("n_other"))
    pairs = groups.select("lang", "source", "n_source", "v").join(others, "lang").where("source <> other")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    near = ranked(_pairs(vectors, pairs).withColumnRenamed("other", "item"))

    p, q = _share("n", "n_source", "v"), _share("total", "n_lang", "v")
    told = join_skewed(rows, groups.where("size > 0"), ["lang", "source"], "size").withColumns({"p": p, "q": q}).where("p > q")
    words = ranked(told.select("lang", "source", F.col("term").alias("item"), _divergence(F.col("p"), F.col("q")).cast("long").alias("value"))).where(F.col("rank") <= top_terms)
    return near.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").unionByName(words.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


#: Worked out densely, each term of a language against each pair of its sources.
OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), w AS (SELECT k, lang, source, unnest(words) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 3),
size AS (SELECT lang, count(*) AS v, sum(total) AS n_lang FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term),
cell AS (
  SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS n_source, s.v, s.n_lang
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN size s ON s.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), share AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (n_source + v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (total + 1)) // (n_lang + v)::HUGEINT AS q FROM cell
), pair AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::HUGEINT AS value
  FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), near AS (
  SELECT g.lang, g.source, o.source AS item, coalesce(p.value, 0) AS value
  FROM groups g JOIN groups o ON o.lang = g.lang AND o.source <> g.source LEFT JOIN pair p ON p.lang = g.lang AND p.source = g.source AND p.item = o.source
), word AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM share WHERE n > 0 AND p > q),
whole AS (SELECT *, 'pair' AS part FROM near UNION ALL SELECT *, 'term' AS part FROM word)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM whole) r WHERE part = 'pair' OR rank <= 200
"""
