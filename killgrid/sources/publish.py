"""Tables published as one set: readers see the whole of the old set or the whole of the new one.

A set is written to a folder of its own, its manifest (row counts, schemas, what wrote it) beside the tables, and
then one small file, CURRENT, is replaced by one that names it. A job that dies before that leaves CURRENT as it was;
`sweep` removes what no set names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import Files

_CSV = {"header": "true", "escape": '"', "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
#: On reading, nothing between commas is null, but "" is an empty text: the name of null is one that no text has.
_READ = _CSV | {"nullValue": "\x01null", "emptyValue": "", "multiLine": "true"}


def publish(spark: SparkSession, tables: dict[str, Callable[[], DataFrame]], folder: str, about: dict | None = None) -> str:
    """Write every table as CSV and make them the current set, all at once; the set's name. A table is counted while
    it is written. What a table's builder raises leaves the current set as it was."""
    files, name = Files(spark, folder), f"set-{uuid.uuid4().hex}"
    manifest: dict = {"set": name, "about": about or {}, "tables": {}}
    for table, build in tables.items():
        rows = build()
        counted = Observation(f"{table} {name}")
        rows.observe(counted, F.count(F.lit(1)).alias("rows")).write.options(**_CSV).csv(f"{folder}/{name}/{table}")
        manifest["tables"][table] = {"rows": counted.get["rows"], "schema": json.loads(rows.schema.json())}
    files.replace(f"{folder}/{name}/manifest.json", json.dumps(manifest, indent=1))
    files.replace(f"{folder}/{name}/index.md", index(manifest))
    files.replace(f"{folder}/CURRENT", name)
    return name


def index(manifest: dict) -> str:
    """A list of the set's tables for people."""
    rows = [f"* `{t}` ({x['rows']} rows): {', '.join(f['name'] for f in x['schema']['fields'])}" for t, x in sorted(manifest["tables"].items())]
    return "\n".join(["# Report tables", "", *rows, ""])


def current(spark: SparkSession, folder: str) -> dict | None:
    """The manifest of the current set, with its path; None before the first."""
    if not Files(spark, folder).exists(f"{folder}/CURRENT"):
        return None
    name = spark.read.text(f"{folder}/CURRENT", wholetext=True).first().value
    text = spark.read.text(f"{folder}/{name}/manifest.json", wholetext=True).first().value
    return {**json.loads(text), "path": f"{folder}/{name}"}


def read(spark: SparkSession, folder: str, table: str, manifest: dict | None = None) -> DataFrame:
    """A table of the current set, or of the set whose manifest is given, so that several tables come from one set."""
    manifest = manifest or current(spark, folder)
    if manifest is None or table not in manifest["tables"]:
        raise FileNotFoundError(f"{folder}: no table {table}")
    schema = StructType.fromJson(manifest["tables"][table]["schema"])
    return spark.read.schema(schema).options(**_READ).csv(f"{manifest['path']}/{table}")


def sweep(spark: SparkSession, folder: str, keep: int = 1) -> list[str]:
    """Remove sets that are neither current nor, by manifest, among the `keep` complete ones; no job may be publishing."""
    files = Files(spark, folder)
    known = current(spark, folder)
    names = [n for n in files.names(folder) if n.startswith("set-") and (known is None or n != known["set"])]
    complete = [n for n in names if files.exists(f"{folder}/{n}/manifest.json")]
    gone = [n for n in names if n not in complete[: max(0, keep - 1)]]
    for n in gone:
        files.delete(f"{folder}/{n}")
    return gone
