"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. Documents come in
batches of falling doc_id ranges. A batch is reduced to one row per digest,
compared with the index by a sort-merge anti-join (the index side is read in
bucket order, without a shuffle), and what is new is appended; how often a
batch repeats what the index has goes to a second table of the same buckets.
An index that is given stays as it is left, for the next documents; one made
here is dropped once the result is written. The number of buckets follows from
the first batch's digests and stays with the table. Only DataFrame functions run
here.

Defined results
* null text counts as the empty text; texts are equal after lower-casing A-Z;
* of equal texts the largest doc_id stays, a null id being smaller than any
  other; a text that the index had before keeps the id it had there, and
  group_size counts all rows the index has ever been shown;
* rows that repeat a doc_id and its text are one group; `drop_copies` leaves
  exactly one row of it;
* an empty table gives an empty result; other columns, whatever their names,
  are carried through `drop_copies` and are ignored elsewhere.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, files_for, new_path, persist, release, table, text_or_empty

#: Groups of at least 1/HOT_SHARE of a batch are joined by broadcast; there are HOT_SHARE of them at most.
HOT_SHARE = 200
HOT_LEAST = 1000
#: Digests a bucket holds on average when its table is made.
BUCKET_ROWS, BATCHES = 1_000_000, 2


def normalised(column: str = "text"):
    return F.translate(text_or_empty(column), string.ascii_uppercase, string.ascii_lowercase)


def digest(column: str = "text"):
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(normalised(column), 256))


class DigestIndex:
    """Digests seen so far, with the id that stands for each: a table bucketed and sorted by digest, and one
    beside it for the rows that later batches had of them."""

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.path = path or new_path(spark, "digest-index")
        self._buckets = buckets

    def buckets(self, rows: int = 0) -> int:
        """Those of the table where there is one, else enough for these rows."""
        if self._buckets is None and self.exists():
            described = self.spark.sql(f"DESCRIBE EXTENDED {self.name}").where("col_name = 'Num Buckets'").first()
            self._buckets = int(described["data_type"])
        if self._buckets is None:
            self._buckets = files_for(self.spark, rows, BUCKET_ROWS)
        return self._buckets

    def exists(self, which: str = "") -> bool:
        return self.spark.catalog.tableExists(self.name + which)

    def read(self) -> DataFrame:
        """digest, keep (the id that stays), size (rows of the batch that brought it)."""
        return self._read("", "digest binary, keep long, size long")

    def _read(self, which: str, shape: str) -> DataFrame:
        return self.spark.table(self.name + which) if self.exists(which) else self.spark.createDataFrame([], shape)

    def _append(self, rows: DataFrame, which: str) -> None:
        # dealt by bucket number, so that each bucket is one sorted file of this batch whatever the number of tasks
        n = self.buckets()
        writer = rows.repartition(4 * n, F.pmod(F.hash("digest"), F.lit(n))).write.bucketBy(n, "digest").sortBy("digest")
        writer.format("parquet").mode("append").option("path", f"{self.path}/{which or 'digests'}").saveAsTable(self.name + which)

    def add(self, batch: DataFrame, files: int | None = None) -> None:
        """Append the digests of (doc_id, digest) that the index lacks. files: as in persist."""
        own = persist(batch.groupBy("digest").agg(F.max("doc_id").alias("keep"), F.count(F.lit(1)).alias("size")), "batch", files)
        self.buckets(own.count())
        known = self.read().select("digest").hint("merge")
        if self.exists():
            self._append(own.join(known, "digest", "left_semi").select("digest", "size"), "_repeats")
        self._append(own.join(known, "digest", "left_anti"), "")
        release(own)

    def sizes(self) -> DataFrame:
        """digest, keep, size (rows of all batches): both tables are read in bucket order."""
        later = self._read("_repeats", "digest binary, size long").groupBy("digest").agg(F.sum("size").alias("later"))
        return self.read().join(later.hint("merge"), "digest", "left").select("digest", "keep", (F.col("size") + F.coalesce("later", F.lit(0))).alias("size"))

    def look_up(self, batch: DataFrame) -> DataFrame:
        """batch with keep and size of its digests. Hot digests, at most HOT_SHARE, go by broadcast."""
        index = self.sizes()
        total = index.agg(F.sum("size")).first()[0] or 0
        hot = F.broadcast(index.where(F.col("size") >= max(HOT_LEAST, total // HOT_SHARE + 1)))
        warm = batch.join(hot, "digest")
        cold = batch.join(hot.select("digest"), "digest", "left_anti").join(index.hint("merge"), "digest")
        return warm.unionByName(cold)

    def drop(self) -> None:
        for which in ("", "_repeats"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}{which}")
        delete(self.spark, self.path)


def _batches(digests: DataFrame, batches: int) -> list[DataFrame]:
    """digests in ranges of doc_id, the largest ids first and null ids last."""
    cuts = digests.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)] or [0.5], 10_000)).first()[0] if batches > 1 else None
    if not cuts:
        return [digests]
    cuts, out, above = sorted(set(cuts), reverse=True), [], None
    for cut in cuts:
        out.append(digests.where(F.col("doc_id") >= cut if above is None else (F.col("doc_id") >= cut) & (F.col("doc_id") < above)))
        above = cut
    return [*out, digests.where((F.col("doc_id") < above) | F.col("doc_id").isNull())]


def _decided(docs: DataFrame, index: DigestIndex, batches: int) -> DataFrame:
    """doc_id, digest, keep, size, kept of every row, once all batches are in the index."""
    digests = persist(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest().alias("digest")), "digests")
    files = files_for(docs.sparkSession, digests.count())
    for batch in _batches(digests, batches):
        index.add(batch, files)
    found = persist(index.look_up(digests).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep"))), "decided", files)
    release(digests)
    return found


def find_copies(docs: DataFrame, index: DigestIndex | None = None, batches: int = BATCHES) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    own = index or DigestIndex(docs.sparkSession)
    found = _decided(docs, own, batches)
    if index is None:
        own.drop()
    return found.select("doc_id", F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, index: DigestIndex | None = None, batches: int = BATCHES) -> DataFrame:
    """docs, all columns, with one row per text. The rows that go, being the fewer, are the side that joins,
    by (id, digest), which no group of copies makes hot; Spark broadcasts them while they are small."""
    own = index or DigestIndex(docs.sparkSession)
    found = _decided(docs, own, batches)
    if index is None:
        own.drop()
    # (id, digest) as one binary key: a null id has a key of its own and stays an equi-join
    key = lambda d: F.concat(F.coalesce(F.encode(F.col("doc_id").cast("long").cast("string"), "utf-8"), F.lit(b"-")), d).alias("key")
    keyed = persist(found.select(key(F.col("digest")), "kept").groupBy("key").agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("rows")).where("not kept or rows > 1"), "copies", files_for(docs.sparkSession, found.count()))
    release(found)
    # the caller's columns are one struct: no name of theirs can meet one of ours
    stay = docs.select(key(digest()), F.struct("*").alias("row")).join(keyed.where("not kept").select("key"), "key", "left_anti")
    repeated = keyed.where("kept").select("key")
    if repeated.take(1):
        stay = stay.join(repeated, "key", "left_anti").unionByName(stay.join(repeated, "key", "left_semi").dropDuplicates(["key"]))
    return stay.select("row.*")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_copies(table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
  FROM documents
), g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256
FROM d JOIN g USING (h)
"""
