"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_SHARED = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset a local master, which has one
    machine only, gets a default (tests); on a cluster its absence is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder all executors share")
    return found or DEFAULT_SHARED


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is still there when the driver ends goes with it."""
    path = f"{shared_dir(spark).rstrip('/')}/killgrid-{name}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def files_for(spark: SparkSession, rows: int, each: int = 500_000) -> int:
    """Files for a table of at most `rows` short rows: one a core of the cluster, or enough for `each` rows a file."""
    return max(spark.sparkContext.defaultParallelism, rows // each)


def persist(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage, survives lost executors. With
    `files`, the tasks that write are no more than that; nothing is shuffled for it."""
    path = new_path(df.sparkSession, name)
    (df.coalesce(files) if files else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(*frames: DataFrame) -> None:
    """Delete the files behind frames made by persist(); they must not be read again."""
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete(df.sparkSession, path)


def end_round(spark: SparkSession) -> None:
    """Let the driver collect what finished rounds have left: broadcasts and shuffle files go with the objects that hold them."""
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def free_unused() -> None:
    """Give memory that nothing uses back to the system: Python workers outlive their tasks and share an executor."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def arrow_slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that one slice holds at most max_bytes of the column (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = pc.cumulative_sum(pc.cast(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0), pa.int64())).to_numpy()
        start = 0
        base = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(ends.searchsorted(base + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            base = int(ends[stop - 1])
            start = stop
    free_unused()


#: Keys with at least 1/HOT_SHARE of all rows are joined by broadcast; there are HOT_SHARE of them at most.
HOT_SHARE, HOT_LEAST = 200, 1000


def join_skewed(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Inner join of rows with groups, one row per key, whose column `size` has the rows of each key.

    Keys that hold a large share of all rows would meet in one task; as there are at most HOT_SHARE of them,
    they are broadcast, and only the others are shuffled.
    """
    total, most = groups.agg(F.sum(size), F.max(size)).first()
    least = max(HOT_LEAST, (total or 0) // HOT_SHARE + 1)
    if (most or 0) < least:
        return rows.join(groups, keys)
    hot = groups.where(F.col(size) >= least)
    warm = rows.join(F.broadcast(hot), keys)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(groups.where(F.col(size) < least), keys)
    return warm.unionByName(cold)
