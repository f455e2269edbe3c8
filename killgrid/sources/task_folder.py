"""A folder of task shards as a Python data source: `spark.read.format("killgrid-tasks")`.

The folder stands for the remote end of a dataset: one folder a subset (`subset=NAME`), JSON lines inside, in any
store pyarrow opens (a path, file:, hdfs:, s3:, gs:). Partitions are byte ranges of shards, so that a large shard is
read by many tasks; a filter on `subset` (=, IN) is pushed down, and shards of other subsets aren't listed (see `tasks`). Rows come
as Arrow batches with lineage: `subset`, `shard`, `offset` (where the line begins) and `fault` (the line, where it
isn't a JSON object; its other columns are null).

Options: `subsets` (names, separated by commas; all by default), `columns` (names and types of the rows, DDL),
`splitBytes`, `mode` (PERMISSIVE, FAILFAST: a fault ends the read). A field of another type than its column is null,
but text columns take any value: objects and lists as JSON.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

COLUMNS = "task_id string, entry_point string, prompt string, canonical_solution string, test string"
LINEAGE = "subset string, shard string, offset long, fault string"
SPLIT_BYTES, BATCH_ROWS = 32 << 20, 5000


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if "://" not in path and path.startswith("file:"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def lines(file: io.BufferedReader, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in [start, stop)."""
    at = start
    if start:
        file.seek(start - 1)
        at = start - 1 + len(file.readline())
    while at < stop and (line := file.readline()):
        yield at, line
        at += len(line)


def _value(x, kind: pa.DataType):
    """x as a column of this type takes it, or None."""
    if x is None:
        return None
    if pa.types.is_string(kind):
        return x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)
    if pa.types.is_boolean(kind):
        return x if isinstance(x, bool) else None
    if isinstance(x, bool):
        return None
    if pa.types.is_integer(kind):
        return x if isinstance(x, int) and -(2 ** (kind.bit_width - 1)) <= x < 2 ** (kind.bit_width - 1) else None
    if pa.types.is_floating(kind):
        return float(x) if isinstance(x, int | float) else None
    return None


@dataclass
class ShardRange(InputPartition):
    subset: str
    path: str
    start: int
    stop: int


class TaskReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.kinds = to_arrow_schema(schema)
        self.path = options["path"]
        self.mode = options.get("mode", "PERMISSIVE").upper()
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        named = options.get("subsets")
        self.named: set | None = {x.strip() for x in named.split(",")} if named else None
        self.wanted = self.named

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        self.wanted = self.named  # of this plan's filters only
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("subset",):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = names if self.wanted is None else self.wanted & names
            else:
                yield f

    def partitions(self) -> list[ShardRange]:
        store, root = open_store(self.path)
        found = []
        for folder in store.get_file_info(fs.FileSelector(root)):
            key, _, subset = folder.base_name.partition("=")
            subset = unquote(subset)
            if folder.type != fs.FileType.Directory or key != "subset" or self.wanted is not None and subset not in self.wanted:
                continue
            for shard in store.get_file_info(fs.FileSelector(folder.path)):
                if shard.type == fs.FileType.File and not shard.base_name.startswith(("_", ".")):
                    found += [ShardRange(subset, shard.path, at, min(shard.size, at + self.split)) for at in range(0, shard.size, self.split)]
        return sorted(found, key=lambda p: (p.path, p.start)) or [ShardRange("", "", 0, 0)]

    def read(self, partition: ShardRange) -> Iterator[pa.RecordBatch]:
        if not partition.stop:
            return
        store, _ = open_store(self.path)
        shard, rows = partition.path.rsplit("/", 1)[-1], []
        with io.BufferedReader(store.open_input_file(partition.path)) as file:
            for offset, line in lines(file, partition.start, partition.stop):
                if not line.strip():
                    continue
                try:
                    row = json.loads(line)
                except ValueError:
                    row = None
                fault = None if isinstance(row, dict) else line.decode(errors="replace").rstrip("\r\n")
                if fault is not None and self.mode == "FAILFAST":
                    raise ValueError(f"{partition.path}, byte {offset}: not a JSON object")
                rows.append({**(row if fault is None else {}), "subset": partition.subset, "shard": shard, "offset": offset, "fault": fault})
                if len(rows) == BATCH_ROWS:
                    yield self._batch(rows)
                    rows = []
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        columns = [pa.array([_value(r.get(f.name), f.type) for r in rows], f.type) for f in self.kinds]
        return pa.RecordBatch.from_arrays(columns, schema=self.kinds)


class TaskFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return "killgrid-tasks"

    def schema(self) -> str:
        return f"{self.options.get('columns', COLUMNS)}, {LINEAGE}"

    def reader(self, schema: StructType) -> TaskReader:
        return TaskReader(schema, {k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed down.

    Spark keeps what a frame's filters pushed with the frame's source, and asks again only when there is a filter:
    `tasks` always has one, and so may be filtered in several ways. With the bare format, load once a query.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TaskFolder)


def tasks(spark: SparkSession, folder: str, **options) -> DataFrame:
    """The rows of a task folder; subsets that later filters leave out are not read."""
    register(spark)
    return spark.read.format(TaskFolder.name()).options(**options).load(folder).where("offset >= 0")
