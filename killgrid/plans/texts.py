"""Queries on texts of tasks, made from parts' names, and tables read in several formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import texts
from ..sources import readers, shared
from .registry import dataframe_query

_ENTRY = "concat('f_', replace(p_name, ' ', '_'))"
_PROMPT = f"CASE p_partkey % 5 WHEN 0 THEN concat('def ', {_ENTRY}, '(x):\n') WHEN 1 THEN concat('def ', {_ENTRY}, ' (x, y):\n    # ', p_type) WHEN 2 THEN '' WHEN 3 THEN p_name ELSE concat('import re\n\ndef ', {_ENTRY}, '(x):\n  \n') END"
_SOLUTION = f"CASE p_size % 6 WHEN 0 THEN 'return x' WHEN 1 THEN '    return x\n\n  ' WHEN 2 THEN concat('def ', {_ENTRY}, '(x): return 1') WHEN 3 THEN '' WHEN 4 THEN '\n\nif x:\n    return 2\n\nreturn 3' ELSE '\treturn 4' END"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet")


def composed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir).selectExpr("p_partkey", f"{_ENTRY} AS entry", f"{_PROMPT} AS prompt", f"{_SOLUTION} AS solution")
    return rows.select("p_partkey", texts.composed_source(F.col("prompt"), F.col("solution"), F.col("entry")).alias("source"))


def absent_libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a part's name and its type as libraries; words of six letters or more are installed."""
    rows = _parts(spark, sf_dir)
    known = rows.select(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.filter(F.split("p_name", " "), lambda w: F.length(w) >= 6))))).alias("known"))  # a row of words
    libs = F.concat(F.split("p_name", " "), F.array(F.concat("p_name", F.lit(".sub")), F.lit(" "), F.lower("p_type"), F.lit(None).cast("string")))
    return rows.crossJoin(F.broadcast(known)).select("p_partkey", F.array_join(texts.missing_libraries(libs, F.col("known")), ",").alias("missing"))


def candidate_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = f"concat('assert ', {_ENTRY}, ' (', p_size, ') == ', {_ENTRY}, '(', CASE WHEN p_size % 2 = 0 THEN concat('x', {_ENTRY}, '(1)') ELSE '2' END, ')')"
    rows = _parts(spark, sf_dir).selectExpr("p_partkey", f"{_ENTRY} AS entry", f"CASE p_partkey % 3 WHEN 0 THEN {text} WHEN 1 THEN replace({text}, 'assert ', 'assert x') ELSE p_name END AS text")
    return rows.select("p_partkey", texts.entry_as_candidate(F.col("text"), F.col("entry")).alias("text"))


def table_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers written as Parquet, CSV, JSON lines and JSON documents with a wrapper, and read again."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    folder = shared.scratch(spark, "formats")
    rows.write.parquet(f"{folder}/a.parquet")
    readers.write_union_csv([rows.drop("s_acctbal"), rows.where("s_suppkey < 0")], f"{folder}/a.csv")
    rows.write.json(f"{folder}/a.jsonl")
    # documents of a hundred rows each
    documents = rows.groupBy(F.floor(F.col("s_suppkey") / 100)).agg(F.collect_list(F.struct(*rows.columns)).alias("tasks"))
    documents.select(F.to_json(F.struct("tasks")).alias("value")).repartition("value").write.text(f"{folder}/a.json", lineSep="\n")
    parts = []
    for end in ("parquet", "csv", "jsonl", "json"):
        read = readers.read_rows(spark, f"{folder}/a.{end}")
        balance = F.round(F.sum(F.col("s_acctbal").cast("double")), 2)
        parts.append(read.agg(F.lit(end).alias("format"), F.count(F.lit(1)).alias("rows"), F.sum(F.col("s_suppkey").cast("long")).alias("keys"), F.max("s_name").alias("last"), balance.alias("balance")))
    return reduce(DataFrame.unionByName, parts)


_S = f"SELECT p_partkey, {_ENTRY} AS entry, {_PROMPT} AS prompt, {_SOLUTION} AS solution FROM part"
_DEF = r"regexp_matches({0}, '\bdef\s+' || entry || '\s*\(')"
_RSTRIP = r"regexp_replace({0}, '\s+$', '') || chr(10)"
dataframe_query("composed_sources", composed_sources, rf"""WITH s AS ({_S}), b AS (SELECT *, {_DEF.format("prompt")} AS head, {_DEF.format("solution")} AS alone, list_filter(string_split(solution, chr(10)), lambda l: trim(l, ' ' || chr(9)) <> '') AS filled FROM s),
i AS (SELECT *, CASE WHEN head AND len(filled) > 0 AND substr(filled[1], 1, 1) NOT IN (' ', chr(9)) THEN array_to_string([CASE WHEN trim(l, ' ' || chr(9)) <> '' THEN '    ' || l ELSE l END FOR l IN string_split(solution, chr(10))], chr(10)) ELSE solution END AS body FROM b)
SELECT p_partkey, CASE WHEN alone OR prompt = '' THEN {_RSTRIP.format("solution")} WHEN solution = '' THEN {_RSTRIP.format("prompt")} ELSE {_RSTRIP.format("prompt || CASE WHEN ends_with(prompt, chr(10)) THEN '' ELSE chr(10) END || body")} END AS source FROM i""")
dataframe_query("absent_libraries", absent_libraries, """WITH known AS (SELECT DISTINCT w FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) x WHERE length(w) >= 6),
l AS (SELECT p_partkey, unnest(string_split(p_name, ' ') || [p_name || '.sub', lower(p_type)]) AS lib FROM part)
SELECT p.p_partkey, coalesce(m.missing, '') AS missing FROM part p LEFT JOIN (SELECT p_partkey, string_agg(DISTINCT lib, ',' ORDER BY lib) AS missing FROM l WHERE string_split(lib, '.')[1] NOT IN (SELECT w FROM known) GROUP BY p_partkey) m ON m.p_partkey = p.p_partkey""")
_CALL = f"concat('assert ', {_ENTRY}, ' (', p_size, ') == ', {_ENTRY}, '(', CASE WHEN p_size % 2 = 0 THEN concat('x', {_ENTRY}, '(1)') ELSE '2' END, ')')"
dataframe_query("candidate_calls", candidate_calls, rf"""SELECT p_partkey, regexp_replace(text, '\b' || entry || '\s*\(', 'candidate(') AS text FROM (SELECT p_partkey, {_ENTRY} AS entry, CASE p_partkey % 3 WHEN 0 THEN {_CALL} WHEN 1 THEN replace({_CALL}, 'assert ', 'assert x') ELSE p_name END AS text FROM part) t""")
_F = "SELECT '{0}' AS format, count(*) AS rows, CAST(sum(s_suppkey) AS BIGINT) AS keys, max(s_name) AS last, {1} AS balance FROM supplier".format
dataframe_query("table_formats", table_formats, " UNION ALL ".join(_F(end, "CAST(NULL AS DOUBLE)" if end == "csv" else "round(sum(s_acctbal), 2)") for end in ("parquet", "csv", "jsonl", "json")))
