"""Bootstrap intervals of means and ratios without drawing row numbers.

A replica draws n of n rows with replacement. How often each row is drawn is multinomial, and a multinomial splits:
first the draws are dealt to blocks of rows, then within each block to its values, both by multinomial counts, so
that every replica has exactly n draws. Equal (numerator, denominator) pairs are one value with a weight. A block's
result is one array of sums a replica, and arrays add up in any order.

Draws depend on the seed, the group and the block's values, not on partitions or the order of rows.

`together` draws rows by number instead, by whole numbers that any engine can work out again: n draws a replica are
dealt to blocks of numbered rows, then each draw of a block takes one of its rows. No draw is shuffled, and all
statistics are of the same rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranks

#: Replicas, and distinct values a block has on average.
REPLICAS, SEED, BLOCK = 200, 42, 20_000
#: Numbered rows of a block, draws that are worked out at once, and Spark tasks a core.
NUMBERED, DRAWS, SLICES = 16_384, 1 << 16, 4
_BLOCK = "group string, block long"


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def _generator(seed: int, group: str, block: int) -> np.random.Generator:
    return np.random.default_rng([seed & 0xFFFFFFFF, zlib.crc32(group.encode()), block + 1])


def replica_sums(units: DataFrame, replicas: int = REPLICAS, seed: int = SEED, block_size: int = BLOCK) -> DataFrame:
    """group, replica, num, den, draws from units (group string, num, den, both finite)."""
    values = units.groupBy("group", "num", "den").agg(F.count(F.lit(1)).alias("times"))
    sizes = values.groupBy("group").agg(F.count(F.lit(1)).alias("distinct"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("distinct") / block_size))
    dealt = values.join(sizes, "group").select("group", F.pmod(F.xxhash64("num", "den"), blocks).alias("block"), "num", "den", "times")
    shares = dealt.groupBy("group", "block").agg(F.sum("times").alias("rows"))

    def deal(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        own = frame.sort_values("block")
        rows = own["rows"].to_numpy()
        draws = _generator(seed, key[0], -1).multinomial(int(rows.sum()), rows / rows.sum(), size=replicas)
        return pd.DataFrame({"group": key[0], "block": own["block"].to_numpy(), "draws": list(draws.T)})

    def draw(key: tuple, frame: pd.DataFrame, dealt: pd.DataFrame) -> pd.DataFrame:
        own = frame.sort_values(["num", "den"])
        times = own["times"].to_numpy()
        counts = _generator(seed, key[0], int(key[1])).multinomial(np.asarray(dealt["draws"].iloc[0], np.int64), times / times.sum())
        return pd.DataFrame({"group": key[0], "replica": range(replicas), "num": counts @ own["num"].to_numpy(), "den": counts @ own["den"].to_numpy(), "draws": counts.sum(1)})

    told = shares.groupBy("group").applyInPandas(deal, f"{_BLOCK}, draws array<long>")
    shape = "group string, replica int, num double, den double, draws long"
    parts = dealt.groupBy("group", "block").cogroup(told.groupBy("group", "block")).applyInPandas(draw, shape)
    return parts.groupBy("group", "replica").agg(F.sum("num").alias("num"), F.sum("den").alias("den"), F.sum("draws").alias("draws"))


def intervals(rows: DataFrame, keys: list[str], num: str, den: str | None = None, cluster: str | None = None, replicas: int = REPLICAS, seed: int = SEED, level: float = 0.95, block_size: int = BLOCK) -> DataFrame:
    """keys, n, estimate, low, high: percentile intervals of the mean of num, or of sum(num) / sum(den).

    With a cluster, units are clusters' means; a blank or null cluster's row is a unit of its own. Rows whose num (or
    den) isn't finite are left out, as are negative denominators; a ratio over 0 is 0; with replicas 0, or one unit,
    both ends are the estimate. Null keys are one group; keys without any finite row have no row.
    """
    names = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("{}")
    x, y = F.col(num).cast("double"), (F.col(den).cast("double") if den else F.lit(1.0))
    kept = rows.where(_finite(x) & _finite(y) & (y >= 0))
    if cluster:
        name = F.trim(F.coalesce(F.col(cluster).cast("string"), F.lit("")))
        named = kept.where(name != "").groupBy(*keys, name.alias("_cluster")).agg(F.avg(x).alias("num")).select(*keys, "num", F.lit(1.0).alias("den"))
        units = named.unionByName(kept.where(name == "").select(*keys, x.alias("num"), F.lit(1.0).alias("den")))
    else:
        units = kept.select(*keys, x.alias("num"), y.alias("den"))
    units = units.withColumn("group", names)
    ratio = lambda a, b: F.when(b != 0, a / b).otherwise(F.lit(0.0))
    found = units.groupBy(*keys, "group").agg(F.count(F.lit(1)).alias("n"), ratio(F.sum("num"), F.sum("den")).alias("estimate"))
    if replicas < 1:
        return found.select(*keys, "n", "estimate", F.col("estimate").alias("low"), F.col("estimate").alias("high"))
    drawn = replica_sums(units.select("group", "num", "den"), replicas, seed, block_size).withColumn("value", ratio(F.col("num"), F.col("den")))
    ends = drawn.groupBy("group").agg(F.expr(f"percentile(value, array({(1 - level) / 2}, {(1 + level) / 2}))").alias("ends"))
    return found.join(ends, "group").select(*keys, "n", "estimate", F.col("ends")[0].alias("low"), F.col("ends")[1].alias("high"))


# --- draws by number ------------------------------------------------------------------------------------------
def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers below 2^32, mixed one to one."""
    x = x.astype(np.uint32)
    for _ in range(2):
        x = (x ^ (x >> np.uint32(16))) * np.uint32(0x45D9F3B)
    return x ^ (x >> np.uint32(16))


def _key(seed: int, replica: np.ndarray, block: int) -> np.ndarray:
    """What the draws of each replica are mixed with: 0 for dealing to blocks, its number from 1 within a block."""
    return mixed(mixed(seed + replica) ^ np.uint32(block))


def _places(draws: np.ndarray, key: np.uint32, size: int) -> np.ndarray:
    """A number below size for each draw, whose own number is mixed already."""
    return ((mixed(draws ^ key).astype(np.uint64) * np.uint64(size)) >> np.uint64(32)).astype(np.int64)


def _dealer(seed: int, block: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            replicas = frame["replica"].to_numpy()
            for n in frame["n"].unique().tolist():  # one
                counts = np.zeros((len(replicas), -(-n // block)), np.int64)
                if counts.shape[1] == 1:
                    counts[:] = n
                else:
                    keys = _key(seed, replicas, 0)
                    for start in range(0, n, DRAWS):
                        draws = mixed(np.arange(start, min(n, start + DRAWS)))
                        for i, key in enumerate(keys):
                            counts[i] += np.bincount(_places(draws, key, n) // block, minlength=counts.shape[1])
                for b in range(counts.shape[1]):
                    yield pd.DataFrame({"block": b, "replica": replicas, "draws": counts[:, b]})

    return deal


def _drawer(columns: list[str], seed: int) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def draw(key: tuple, frame: pd.DataFrame, dealt: pd.DataFrame) -> pd.DataFrame:
        values = frame.sort_values("place")[columns].to_numpy(np.float64)
        replicas, times = dealt["replica"].to_numpy(), dealt["draws"].to_numpy()
        draws = mixed(np.arange(times.max()))
        sums = np.empty((len(replicas), len(columns)))
        for i, own in enumerate(_key(seed, replicas, int(key[0]) + 1)):
            sums[i] = np.bincount(_places(draws[: times[i]], own, len(values)), minlength=len(values)) @ values
        return pd.DataFrame({"replica": replicas, "draws": times, **dict(zip(columns, sums.T, strict=True))})

    return draw


def numbered_sums(units: DataFrame, unit: str, columns: list[str], replicas: int, seed: int = SEED, block: int = NUMBERED) -> DataFrame:
    """replica, draws, and the sum of each column (double, without nulls) over the replica's n draws of n units. Units
    are numbered in the order of the first 13 digits of their name's md5, then of the name."""
    spark = units.sparkSession
    digits = F.conv(F.substring(F.md5(F.col(unit)), 1, 13), 16, 10).cast("long")  # a double holds it
    placed = ranks.numbered(units.select(F.col(unit).alias("unit"), digits.alias("digits"), *columns), "digits", "unit", name="place", total="n")
    tasks = SLICES * spark.sparkContext.defaultParallelism
    size = placed.agg(F.max("n").alias("n")).where("n > 0")
    wanted = spark.range(0, replicas, 1, min(replicas, tasks)).select(F.col("id").alias("replica")).crossJoin(F.broadcast(size))  # one row
    told = wanted.mapInPandas(_dealer(seed, block), "block long, replica long, draws long")
    blocks = placed.select(F.expr(f"place div {block}").alias("block"), "place", *columns)
    shape = ", ".join(["replica long, draws long", *(f"{c} double" for c in columns)])
    # dealt to a fixed number: Spark joins partitions by bytes, and a block's are few for its work
    pairs = blocks.repartition(tasks, "block").groupBy("block").cogroup(told.repartition(tasks, "block").groupBy("block"))
    return pairs.applyInPandas(_drawer(columns, seed), shape).groupBy("replica").agg(*(F.sum(c).alias(c) for c in ("draws", *columns)))


def together(rows: DataFrame, unit: str, statistics: dict[str, tuple[Column, Column | None]], replicas: int, seed: int = SEED, level: float = 0.95, block: int = NUMBERED) -> DataFrame:
    """One row: n, and for each statistic a struct (estimate, low, high) of the mean of its first column, or of the
    ratio of sums of its two; percentiles over replicas that draw rows by the text `unit`, all statistics the same.

    A row counts 0 in a statistic whose columns aren't finite there, or whose second is negative. A ratio over 0 is 0;
    with replicas 0 both ends are the estimate.
    """
    columns = {}
    for i, (num, den) in enumerate(statistics.values()):
        x, y = num.cast("double"), F.lit(1.0) if den is None else den.cast("double")
        known = _finite(x) & _finite(y) & (y >= 0)
        columns |= {f"x{i}": F.when(known, x).otherwise(0.0), f"y{i}": F.when(known, y).otherwise(0.0)}
    units = rows.select(F.col(unit).alias("unit"), *(c.alias(n) for n, c in columns.items()))
    share = lambda x, y: F.when(y != 0, x / y).otherwise(0.0)
    every = range(len(statistics))
    found = units.agg(F.count(F.lit(1)).alias("n"), *(share(F.sum(f"x{i}"), F.sum(f"y{i}")).alias(f"e{i}") for i in every))
    if replicas < 1:
        ends = lambda i: (F.col(f"e{i}"), F.col(f"e{i}"))
    else:
        drawn = numbered_sums(units, "unit", list(columns), replicas, seed, block)
        at = F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))
        found = found.crossJoin(F.broadcast(drawn.agg(*(F.percentile(share(F.col(f"x{i}"), F.col(f"y{i}")), at).alias(f"p{i}") for i in every))))  # one row each
        ends = lambda i: (F.col(f"p{i}")[0], F.col(f"p{i}")[1])
    return found.select("n", *(F.struct(F.col(f"e{i}").alias("estimate"), ends(i)[0].alias("low"), ends(i)[1].alias("high")).alias(name) for i, name in enumerate(statistics)))


def cluster_means(rows: DataFrame, unit: str, num: str, cluster: str) -> DataFrame:
    """unit, num: the mean of a named cluster's finite rows, and each finite row of a blank or null cluster."""
    name, x = F.trim(F.coalesce(F.col(cluster).cast("string"), F.lit(""))), F.col(num).cast("double")
    own = F.when(name != "", F.concat(F.lit("cluster "), name)).otherwise(F.concat(F.lit("row "), F.col(unit)))
    return rows.where(_finite(x)).groupBy(own.alias("unit")).agg(F.avg(x).alias("num"))
