"""Removal of repeated byte strings, by suffix sorting with bucket-pointer refinement.

A byte goes if a string of `length` bytes around it also starts anywhere else.

Windows of `length` bytes are first brought together by content: each window
is owned by the q-gram in it whose hash is smallest (leftmost among equals), so
equal windows have equal owners at equal places. Consecutive windows with one
owner are a context (at most length - q + 1 of them), each window being in
exactly one. Contexts that occur twice as a whole are repeated as a whole. What
is left in a bucket of equal q-grams is suffix-sorted: positions start in
buckets of equal 8-byte strings and are refined by sorting on the bucket
pointers of later offsets (8, 16, ... bytes on), refined pointers serving at
once as keys of the next refinement; positions alone in their bucket leave, and
so does what points to them. Positions that share a bucket at depth `length`
start repeated windows. Buckets of at most LARGE contexts are sorted so in a
task; the same refinement runs over the contexts of all larger ones as grouped
counts and joins, from q bytes by doubling (a bucket's pointer is a digest
there), so no bucket can overload a task.

Texts meet what is known about them by (id, hash): by broadcast while that is
below BROADCAST_BYTES (its real width counted first); above, texts are dealt
once to a bucketed table in the shared folder, and both joins read it in place.

Defined results: null text is empty; texts shorter than `length` bytes stay;
overlapping repeats count; strings are judged on the input, so copies of a text
all lose what they share; repeated rows are copies; rows that share an id are
told apart by their text; a null doc_id stays null; an empty table gives no
rows; other columns are ignored. `text` is what remains, read as UTF-8 with
U+FFFD for characters that a cut has split; `kept_sha256` is of the exact bytes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_slices, join_skewed, new_path, persist, release, table

LENGTH, GRAM, START_GRAM = 400, 100, 8
LARGE = 4000
BROADCAST_BYTES = 64 << 20
#: Bytes of text in one bucket of the table that texts are dealt to.
BUCKET_BYTES = 64 << 20
#: Bytes of contexts sorted together (or one group).
SORTED_BYTES = 2 << 20
_BLOCK = 1 << 19
_FIRST = -(1 << 63)
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = _BLOCK + 4096
    forward, back = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    forward[0] = back[0] = 1
    return np.multiply.accumulate(forward), np.multiply.accumulate(back)


_POW: tuple[np.ndarray, np.ndarray] | None = None


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q bytes at each place; len(data) is at most _BLOCK + 4096."""
    global _POW
    if _POW is None:
        _POW = _powers()
    forward, back = _POW
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * forward[: len(data)], out=sums[1:])
    return _mix((sums[q:] - sums[:-q]) * back[: len(data) - q + 1])


def _sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def contexts(text: bytes, length: int = LENGTH, q: int = GRAM) -> Iterator[tuple[int, int, int, int]]:
    """(q-gram hash, context hash, first window, windows) of each context of a text of at least length bytes."""
    whole = np.frombuffer(text, np.uint8)
    for a in range(0, len(whole) - length + 1, _BLOCK):
        data = whole[a : a + _BLOCK + length - 1]
        grams = gram_hashes(data, q)
        place = np.uint64((1 << 20) - 1)
        owner = _sliding_min(grams & ~place | np.arange(len(grams), dtype=np.uint64), length - q + 1) & place
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        widths = np.diff(np.append(first, len(owner)))
        at = owner[first].astype(np.int64)
        for g, f, w, rel in zip(grams[at].view(np.int64).tolist(), (first + a).tolist(), widths.tolist(), (at - first).tolist(), strict=True):
            yield g, xxhash.xxh3_64_intdigest(text[f : f + w + length - 1], seed=rel) - (1 << 63), f, w


def repeated_starts(data: np.ndarray, sizes: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """The places in data (pieces of these sizes, one after another) where a window of `depth` bytes of one piece
    starts that equals another one."""
    ends = np.repeat(np.cumsum(sizes), sizes)  # where each position's piece ends
    n = len(data)
    pointer = np.full(n + depth, -1, np.int64)  # bucket of each position at the depth reached; -1: alone, or too near the end
    h = min(START_GRAM, depth)
    places = np.flatnonzero(np.arange(n) + h <= ends)
    keys = np.zeros(len(places), np.uint64)
    for i in range(h):
        keys = keys << np.uint64(8) | data[places + i]

    def refine(places: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Sort places by key; those that share a key get its bucket, the others leave."""
        order = np.argsort(keys, kind="stable")
        places, keys = places[order], keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        bucket = np.cumsum(new) - 1
        shared = np.bincount(bucket, minlength=1)[bucket] > 1 if len(bucket) else new
        pointer[places] = np.where(shared, bucket, -1)
        return places[shared]

    places = refine(places, keys)
    while h < depth and len(places):
        step = min(h, depth - h)
        later = pointer[places + step]
        # what follows must be in the same piece, and not alone; else this position is alone, too
        good = (later >= 0) & (places + step + h <= ends[places])
        pointer[places[~good]] = -1
        own = pointer[places[good]]
        places, keys = places[good], own * (n + 1) + later[good]
        places = refine(places, keys)
        h += step
    return np.sort(places)


def _texts(docs: DataFrame) -> DataFrame:
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return own.withColumn("hash", F.xxhash64("text"))


def _find(length: int):
    schema = pa.schema([("gram", pa.int64()), ("context", pa.int64()), ("id", pa.int64()), ("hash", pa.int64()), ("starts", pa.list_(pa.int32())), ("windows", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_slices(batches, "text"):
            out = []
            for i, text, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if len(text) >= length:
                    same: dict[tuple[int, int, int], list[int]] = {}
                    for g, c, f, w in contexts(text, length):
                        same.setdefault((g, c, w), []).append(f)
                    out += [(g, c, i, t, s, w) for (g, c, w), s in same.items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), schema.types, strict=True)], names=schema.names)

    return run


def _cut(length: int):
    """Bytes of the wanted contexts of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_slices(batches, "text"):
            out = [(w["gram"], w["many"], i, t, w["start"], text[w["start"] : w["start"] + w["windows"] + length - 1]) for i, t, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True) for w in wanted]
            if out:
                types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), types, strict=True)], names=["gram", "many", "id", "hash", "start", "bytes"])

    return run


_SPANS = "id long, hash long, start int, stop int"


def _as_spans(ids, hashes, starts: np.ndarray, stops: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(hashes), pa.array(starts.astype(np.int32)), pa.array(stops.astype(np.int32))], names=["id", "hash", "start", "stop"])


def _sort_groups(length: int):
    """Repeated runs of windows in rows (gram, id, hash, start, bytes) that come group by group."""
    def resolved(rows: pa.Table) -> pa.RecordBatch | None:
        pieces = rows.column(4).combine_chunks()
        offsets = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1].astype(np.int64)
        data = np.frombuffer(pieces.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        first = offsets[:-1] - offsets[0]
        at = repeated_starts(data, np.diff(offsets), length)
        if not len(at):
            return None
        piece = np.searchsorted(first, at, side="right") - 1
        cut = np.flatnonzero((np.diff(at) > length) | (np.diff(piece) > 0))
        a, b = np.append(0, cut + 1), np.append(cut, len(at) - 1)
        own = piece[a]
        begin = rows.column(3).to_numpy()[own] - first[own]
        return _as_spans(rows.column(1).to_numpy()[own], rows.column(2).to_numpy()[own], begin + at[a], begin + at[b] + length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            size += batch.column(4).nbytes
            if size < SORTED_BYTES:
                continue
            rows = pa.Table.from_batches(waiting)
            grams = rows.column(0).to_numpy()
            new = np.flatnonzero(grams[1:] != grams[:-1]) + 1
            ends = pc.binary_length(rows.column(4)).to_numpy().astype(np.int64).cumsum()
            done = 0
            for k in new.tolist():  # as many groups together as make SORTED_BYTES
                if ends[k - 1] - (ends[done - 1] if done else 0) >= SORTED_BYTES:
                    if found := resolved(rows.slice(done, k - done)):
                        yield found
                    done = k
            waiting = rows.slice(done).to_batches()
            size = sum(w.column(4).nbytes for w in waiting) if done else 0  # one long group: look again when as much has come
        if waiting and (found := resolved(pa.Table.from_batches(waiting))):
            yield found

    return run


def _positions(length: int, q: int):
    """(id, hash, context, place, bucket): the digest of the q bytes at each place of a context."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_slices(batches, "bytes", 1 << 18):
            texts = batch.column(3).to_pylist()
            sizes = np.array([len(t) - q + 1 for t in texts], np.int64)
            row = np.repeat(np.arange(len(texts)), sizes)
            place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            buckets = [xxhash.xxh3_128_digest(t[k : k + q]) for t in texts for k in range(len(t) - q + 1)]
            own = [batch.column(i).take(pa.array(row)) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(place.astype(np.int32)), pa.array(buckets, pa.binary())], names=["id", "hash", "context", "place", "bucket"])

    return run


def _refined(parts: DataFrame, length: int, q: int = GRAM) -> DataFrame:
    """Spans of repeated windows in contexts (id, hash, start, bytes) of any number: bucket pointers refined by
    joins. A place's bucket at depth h + step is its bucket at h with that of the place step bytes on; places
    alone in their bucket leave before that."""
    q = min(q, length)
    keys = persist(parts.select("id", "hash", "start", "bytes").mapInArrow(_positions(length, q), "id long, hash long, context int, place int, bucket binary"), "places")
    at = ["id", "hash", "context", "place"]
    while True:
        twice = persist(keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "buckets")
        shared = join_skewed(keys, twice, ["bucket"], "rows").select(*at, "bucket")
        if q == length:
            return shared.selectExpr("id", "hash", "context + place as start", f"context + place + {length} as stop")
        step = min(q, length - q)
        shared = persist(shared, "shared-places")
        later = shared.select("id", "hash", "context", (F.col("place") - step).alias("place"), F.col("bucket").alias("later"))
        finer = persist(shared.join(later, at).select(*at, F.unhex(F.md5(F.concat("bucket", "later"))).alias("bucket")), "places")
        release(keys, twice, shared)
        keys, q = finer, q + step


def _merged(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes in spans; those that touch are one."""
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    new = np.flatnonzero(starts[1:] > stops[:-1]) + 1
    return starts[np.append(0, new)], stops[np.append(new - 1, len(stops) - 1)]


def _whole_spans(length: int):
    """Runs of bytes of contexts (id, hash, starts, windows) that repeat as a whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists, windows = batch.column(2), batch.column(3).to_numpy().astype(np.int64)
            sizes = lists.value_lengths().to_numpy()
            row, starts = np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy().astype(np.int64)
            width = windows[row] + length - 1
            # starts ascend within a row: those whose bytes meet are one run
            new = np.flatnonzero((np.diff(row) > 0) | (np.diff(starts) > width[:-1])) + 1
            a, b = np.append(0, new), np.append(new - 1, len(starts) - 1)
            yield _as_spans(batch.column(0).take(pa.array(row[a])), batch.column(1).take(pa.array(row[a])), starts[a], starts[b] + width[b])

    return run


def _merge_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, hash, items) with the items, structs of start and stop, merged."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column(2)
        flat, ends = lists.flatten(), np.cumsum(lists.value_lengths().to_numpy())
        starts, stops = (flat.field(i).to_numpy().astype(np.int64) for i in (0, 1))
        runs = [_merged(starts[a:b], stops[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(a) for a, _ in runs])]).astype(np.int32))
        items = pa.StructArray.from_arrays([pa.array(np.concatenate([r[i] for r in runs]).astype(np.int32)) for i in (0, 1)], ["start", "stop"])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, items)], names=["id", "hash", "items"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in arrow_slices(batches, "text"):
        out = []
        for i, text, covered in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
            kept, at = [], 0
            for span in covered or ():
                kept.append(text[at : span["start"]])
                at = span["stop"]
            kept.append(text[at:])
            rest = b"".join(kept)
            out.append((None if i == _FIRST else i, len(text), len(text) - len(rest), len(covered or ()), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "replace")))
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])


class _Texts:
    """The texts of docs by (id, hash), and joins to them in which nothing large moves if the other side is small."""

    def __init__(self, docs: DataFrame, broadcast_bytes: int):
        own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        self.rows = own.withColumn("hash", F.xxhash64("text")).select("id", "hash", "text")
        self.broadcast_bytes, self.name = broadcast_bytes, None

    def join(self, other: DataFrame, item_bytes: int, how: str) -> DataFrame:
        """id, hash, text, items; other has a row of items for each (id, hash) it has, of item_bytes each as Spark holds them."""
        held = other.agg(F.sum(F.size("items") * item_bytes + 96)).first()[0] or 0
        if held <= self.broadcast_bytes:
            return self.rows.join(F.broadcast(other), ["id", "hash"], how).select("id", "hash", "text", "items")
        # the other side is narrow: it is hashed, so the texts needn't be sorted
        return self._dealt().join(other.hint("shuffle_hash"), ["id", "hash"], how).select("id", "hash", "text", "items")

    def _dealt(self) -> DataFrame:
        spark = self.rows.sparkSession
        if not self.name:
            size = self.rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
            buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
            self.name, path = f"texts_{uuid.uuid4().hex}", new_path(spark, "texts")
            self.rows.repartition(buckets, "id", "hash").write.bucketBy(buckets, "id", "hash").format("parquet").option("path", path).saveAsTable(self.name)
        return spark.table(self.name)


def repeated_spans(texts: _Texts, length: int = LENGTH, large: int = LARGE) -> DataFrame:
    """(id, hash, start, stop): byte ranges, possibly overlapping, whose bytes are in repeated strings."""
    found = persist(texts.rows.select("id", "text", "hash").mapInArrow(_find(length), "gram long, context long, id long, hash long, starts array<int>, windows int"), "contexts")
    grams = persist(found.groupBy("gram").agg(F.sum(F.size("starts")).alias("rows")).where("rows > 1"), "grams")
    again = persist(join_skewed(found, grams, ["gram"], "rows").drop("rows"), "repeated")
    release(found, grams)
    classes = persist(again.groupBy("gram", "context").agg(F.sum(F.size("starts")).alias("n"), F.count(F.lit(1)).alias("rows"), F.min(F.struct("id", "hash", F.element_at("starts", 1).alias("start"), "windows")).alias("one")), "context-classes")
    whole = join_skewed(again, classes.where("n > 1").select("gram", "context", "rows"), ["gram", "context"], "rows")
    whole = persist(whole.select("id", "hash", "starts", "windows").mapInArrow(_whole_spans(length), _SPANS), "whole-spans")
    release(again)
    groups = classes.groupBy("gram").agg(F.count(F.lit(1)).alias("size"), F.max((F.col("n") == 1).cast("int")).alias("single")).where("size > 1 and single = 1").select("gram", "size")
    mixed = join_skewed(classes, persist(groups, "mixed-groups"), ["gram"], "size")
    wanted = mixed.select("one.*", F.struct("gram", (F.col("size") > large).alias("many"), "one.start", "one.windows").alias("item")).groupBy("id", "hash").agg(F.collect_list("item").alias("items"))
    wanted = persist(wanted, "wanted")
    # repeated rows share id and hash, and so their contexts are whole repeats: any one row's bytes will do
    cut = texts.join(wanted, 48, "inner")
    parts = persist(cut.mapInArrow(_cut(length), "gram long, many boolean, id long, hash long, start int, bytes binary").dropDuplicates(["gram", "id", "hash", "start"]), "parts")
    release(classes, wanted)
    sorted_parts = parts.where("not many").select("gram", "id", "hash", "start", "bytes").repartition("gram").sortWithinPartitions("gram")
    spans = whole.unionByName(sorted_parts.mapInArrow(_sort_groups(length), _SPANS))
    if parts.where("many").take(1):
        spans = spans.unionByName(_refined(parts.where("many"), length))
    return spans


def remove_repeats(docs: DataFrame, length: int = LENGTH, large: int = LARGE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and text (what remains) of every row."""
    texts = _Texts(docs, broadcast_bytes)
    spans = repeated_spans(texts, length, large).groupBy("id", "hash").agg(F.collect_list(F.struct("start", "stop")).alias("items"))
    covered = persist(spans.mapInArrow(_merge_spans, "id long, hash long, items array<struct<start: int, stop: int>>"), "covered")
    return texts.join(covered, 32, "left").select("id", "text", "items").mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


#: By the definition, on bytes as pairs of hexadecimal digits: every 400-byte string by its digest.
OP8_SQL = """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
f AS (SELECT k, i, md5(substr(h, 2 * i + 1, 800)) AS m FROM (SELECT k, h, unnest(range(0, length(h) // 2 - 399)) AS i FROM d) p),
c AS (SELECT k, i, coalesce(i - lag(i) OVER (PARTITION BY k ORDER BY i) > 400, true) AS fresh FROM f WHERE m IN (SELECT m FROM f GROUP BY m HAVING count(*) > 1)),
n AS (SELECT k, i, sum(fresh::INTEGER) OVER (PARTITION BY k ORDER BY i) AS run FROM c),
s AS (SELECT k, run, min(i) AS a, max(i) + 400 AS b FROM n GROUP BY k, run),
t AS (SELECT s.*, coalesce(lag(b) OVER (PARTITION BY k ORDER BY a), 0) AS before FROM s),
u AS (SELECT t.k, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(d.h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM t JOIN d ON d.k = t.k GROUP BY t.k),
z AS (SELECT d.doc_id, length(d.h) // 2 AS n, u.n_removed, u.n_spans, unhex(coalesce(u.kept, '') || substr(d.h, 2 * coalesce(u.last, 0) + 1)) AS rest FROM d LEFT JOIN u ON u.k = d.k)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(rest) AS kept_sha256, decode(rest) AS text FROM z
"""
