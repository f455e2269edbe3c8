"""From raw documents to packed training sequences.

Quality classifier, exact dedup, MinHash near-dedup, mixing of sources, best-fit
packing. Each stage reads the Parquet table its predecessor wrote; all but the
last return the columns of documents.

Defined results: a null or empty text is kept or dropped by its evidence like any
other, all of them are one text to the exact dedup and linked with nothing by the
near dedup; a null doc_id is smaller than any other; of rows that tie (one id and
text) one stays; a null source is the source ''; columns beside those of
documents, whatever their names, are carried up to the last stage; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from killgrid.llm import exact_dedup, mixing, near_dedup, packing, quality
from killgrid.llm.common import persist, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior of being good is high enough (operator 2)."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text (operator 10)."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, a similarity of 0.8 or more (operator 7)."""
    return near_dedup.keep_one_each(docs, percent=80, width=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks for (operator 3)."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens (operator 4)."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mix sources", mix_sources),
    ("pack", pack_sequences),
]

#: Tokenising, MinHash and bin completion are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = persist(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
