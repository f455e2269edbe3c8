"""Near-duplicate detection: MinHash bands, odd sketches, exact confirmation.

A document is the set of its distinct word shingles. Rows with equal sets are
one class; the rest runs over classes. 128 MinHash samples in 32 bands of 4
bring classes together: at a similarity of 0.85 a pair is missed with a chance
of 5e-11, at 0.8 of 5e-8. The samples are also folded into a 512-bit parity
bitmap (odd sketch), whose XOR population count estimates high similarities
closely; candidates more than six standard deviations below the threshold are
left out (of the samples; with the sketch's own spread it is 5.3 at 0.85). A
second odd sketch holds the parities of the whole set, in about as many bits as
the set has members (folded by XOR to the smaller of two sizes): its XOR
population count can't exceed the number of shingles that only one of two sets
has, so it rules out pairs without error. All others are confirmed on the full
shingle sets (64-bit hashes of shingles).

Links are needed only as far as they join components, and are kept as a
spanning forest: (node, label) rows, to which a round adds pairs of different
labels only. First each set is compared with one hub, of the smallest members of its
band buckets the one it shares most buckets with; then, across components, with
the other hubs. Only buckets that still hold several components go on: small
ones are compared pair by pair between different components, large ones with
further members in turn, each of which then leaves its bucket. Before that
each set's shingles that no other member of these buckets has are counted: what two sets have
in common can't exceed what is left, which rules out most of the heavily edited
copies without a comparison. So a bucket of n near copies costs about n
comparisons, not n squared, and no link that matters is lost. Hot buckets and
hot classes are joined by broadcast of at most HOT_SHARE keys; joins of narrow
rows on a hub or a label are left to the adaptive split of skewed partitions.

Defined results: null text is empty; a text without words has n_shingles 0 and
is linked with nothing; a text of fewer words than a shingle has is one
shingle; a null doc_id orders before all others; rows that share a doc_id, or
have none, are linked by their texts only, as all others: the search runs over
an id of each row's own, a 64-bit hash of doc_id and text, and doc_id only says
which row of a component stays; repeated rows are one class and, in
`near_duplicates`, are kept or not together; an empty table gives no rows;
`keep_one_each` carries all columns through and, of rows that tie on the
smallest doc_id, keeps one.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_slices, end_round, files_for, free_unused, join_skewed, persist, release, table, text_or_empty
from .components import connected_components

BANDS, ROWS, SKETCH_BITS, SEED = 32, 4, 512, 5
#: Buckets of at most SMALL members are compared between all their components; larger ones with CENTRES members a round.
SMALL, CENTRES = 24, 64
#: Standard deviations of the MinHash estimate that the sketch's estimate may lie below the threshold.
SIGMAS = 6.0
WORD_CACHE = 400_000

_words: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles. Words: runs without blank, tab, LF, VT, FF, CR; A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_words) > WORD_CACHE:
        _words.clear()
    for w in words:
        if w not in _words:
            _words[w] = xxhash.xxh3_64_intdigest(w)
    codes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(width, len(codes))
    out = np.full(len(codes) - n + 1, n, np.uint64)
    for i in range(n):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + codes[i : len(codes) - n + 1 + i])
    return np.unique(out)


_rng = np.random.default_rng(SEED)
_A = _rng.integers(0, 1 << 32, BANDS * ROWS, np.uint64) << np.uint64(1) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def signature(values: np.ndarray) -> np.ndarray:
    """128 MinHash samples (32 bits each) of a set of 64-bit hashes: the upper halves of a*x+b."""
    best = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(values), 512):  # blocks stay in the cache
        block = (values[i : i + 512, None] * _A + _B) >> np.uint64(32)
        best = np.minimum(best, block.min(0).astype(np.uint32))
    return best


def band_keys(samples: np.ndarray) -> np.ndarray:
    rows = samples.reshape(BANDS, ROWS).astype(np.uint64)
    out = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for i in range(ROWS):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return out.view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples with their places, SKETCH_BITS / 64 words."""
    at = _mix(samples.astype(np.uint64) + (np.arange(len(samples), dtype=np.uint64) << np.uint64(32))) & np.uint64(SKETCH_BITS - 1)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1, bitorder="little").view(np.int64)


def whole_sketch(values: np.ndarray) -> np.ndarray:
    """Parity bitmap of all the values of a set: a power of two of bits, SKETCH_BITS or twice as many as there are values."""
    bits = max(SKETCH_BITS, 2 << max(0, len(values) - 1).bit_length())
    return np.packbits(np.bincount((values >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").view(np.int64)


#: Words of the samples' sketch; then comes the set's size, then the whole set's sketch.
_WORDS = SKETCH_BITS // 64


def _differing(a: str, b: str) -> Column:
    ones = [F.bit_count(F.get(F.col(a), F.lit(i)).bitwiseXOR(F.get(F.col(b), F.lit(i)))) for i in range(_WORDS)]
    return sum(ones[1:], ones[0])


def _whole_differing(a: str, b: str) -> Column:
    """Differing bits of two whole sets' sketches, the larger one folded to the smaller one's size."""
    head = _WORDS + 1
    words = f"(least(size({a}), size({b})) - {head})"
    fold = lambda x: f"aggregate(sequence({head} + i, size({x}) - 1, {words}), 0L, (s, k) -> s ^ {x}[k])"
    return F.expr(f"aggregate(sequence(0, {words} - 1), 0, (d, i) -> d + bit_count({fold(a)} ^ {fold(b)}))")


def sketches_alike(a: str, b: str, percent: int) -> Column:
    """Whether two sketch columns (samples' odd sketch, set size, whole set's odd sketch) allow for a similarity of percent.

    Sets of S shingles together, of which D are in one only, are linked if (100 + percent) D <= (100 - percent) S;
    D is at least the differing bits of the whole sets' sketches. With c differing bits of n in the samples'
    sketches, a share -n/4 ln(1 - 2c/n) / samples of the samples differs; the bound on that is taken as one on c.
    """
    wanted = percent / 100
    low = wanted - SIGMAS * (wanted * (1 - wanted) / (BANDS * ROWS)) ** 0.5
    most = SKETCH_BITS / 2 * (1 - np.exp((low - 1) * 4 * BANDS * ROWS / SKETCH_BITS))
    na, nb = F.get(F.col(a), F.lit(_WORDS)), F.get(F.col(b), F.lit(_WORDS))
    sizes = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
    return sizes & (_differing(a, b) <= float(most)) & ((100 + percent) * _whole_differing(a, b) <= (100 - percent) * (na + nb))


def _let_go() -> None:
    """Workers outlive their tasks: what one has cached isn't held against the memory of what runs next."""
    _words.clear()
    free_unused()


def _features(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_slices(batches, "text"):
            n, same, keys, sketches = [], [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                values = shingles(text, width)
                n.append(len(values))
                if len(values):
                    samples = signature(values)
                    same.append(xxhash.xxh3_128_digest(values.tobytes()))
                    keys.append(band_keys(samples))
                    sketches.append(np.concatenate([odd_sketch(samples), [len(values)], whole_sketch(values)]))
                else:
                    same.append(None)
                    keys.append(None)
                    sketches.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))], names=["id", "doc_id", "n", "same", "keys", "sketch"])
        _let_go()

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t, width).tobytes() for t in batch.column(1).cast(pa.binary()).to_pylist()], pa.binary())], names=["id", "shingles"])
        _let_go()

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                small, large = sorted((len(x), len(y)))
                if 100 * small < percent * large:
                    linked.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])
        _let_go()

    return run


def _possible(na: str, fa: str, nb: str, fb: str, percent: int) -> str:
    """SQL: whether sets of na and nb shingles, of which fa and fb occur in some other set, can be linked."""
    return f"100 * least({fa}, {fb}) >= {percent} * ({na} + {nb} - least({fa}, {fb}))"


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, values in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = np.frombuffer(values.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(np.full(len(x), i))], names=["shingle", "id"])


def _shared(sets: DataFrame) -> DataFrame:
    """(id, n, f): set size, and how many of its shingles some other candidate has. No link can have more in common."""
    unique = sets.mapInArrow(_flat, "shingle long, id long").groupBy("shingle").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id")).where("c = 1").groupBy("id").agg(F.count(F.lit(1)).alias("u"))
    sizes = sets.select("id", (F.octet_length("shingles") / 8).cast("long").alias("n")).groupBy("id").agg(F.min("n").alias("n"), F.max("n").alias("most"), F.count(F.lit(1)).alias("rows"))
    # repeated rows bring their set more than once: nothing is ruled out for them
    return sizes.join(unique, "id", "left").select("id", "n", F.when(F.col("rows") > 1, F.col("most")).otherwise(F.col("n") - F.coalesce("u", F.lit(0))).alias("f"))


def _mixed(members: DataFrame, what: str, used: list[DataFrame], few: int, files: int) -> DataFrame:
    """The members of buckets that hold several components, with the bucket's size and least n. used: gets the frames written."""
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("least_n")).where("lo <> hi").select("key", "size", "least_n")
    sizes = persist(sizes, f"{what}-sizes", few)
    live = persist(join_skewed(members, sizes, ["key"], "size"), what, files)
    used += [sizes, live]
    return live


def _with_components(rest: DataFrame, labels: DataFrame) -> DataFrame:
    return rest.join(labels.select(F.col("node").alias("id"), "label"), "id", "left").select("key", "id", F.coalesce("label", "id").alias("comp"))


def _own_id() -> Column:
    """An id of the row's own: rows have the same one only if they share doc_id (or lack it) and text."""
    number = F.col("doc_id").cast("long")
    return F.xxhash64(number.isNull(), F.coalesce(number, F.lit(0)), text_or_empty())


def _sets_of(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, shingles) of the rows with these ids."""
    own = docs.select(_own_id().alias("id"), text_or_empty().alias("text"))
    # by shuffle at every size: the ids are a share of all rows
    return persist(own.join(ids.distinct().hint("merge"), "id", "left_semi").mapInArrow(_sets(width), "id long, shingles binary"), "sets")


def _with_keys(rows: DataFrame) -> DataFrame:
    """rows with `keys`, the buckets among them that the id is in (BANDS at most), in order."""
    return rows.withColumn("keys", F.sort_array(F.collect_list("key").over(Window.partitionBy("id"))))


def _pairs(members: DataFrame, percent: int, used: list[DataFrame], few: int, files: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs of this round among members (key, id, comp, n, f, sketch), and the members that stay in their buckets."""
    live = _mixed(members, "mixed", used, few, files)
    # members that can't be linked with any set as large as the bucket's smallest leave it
    live = live.where(f"100 * f >= {percent} * (n + greatest(least_n, f) - f)").drop("least_n")
    small = live.where(F.col("size") <= SMALL)
    side = lambda df, x: df.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("id", "comp", "n", "f", "sketch", "keys")))
    # in the join itself, so that pairs ruled out are never made, and a pair only in the first bucket both are in
    once = F.get(F.array_intersect("keys_a", "keys_b"), F.lit(0)) == F.col("key")
    possible = F.expr(_possible("n_a", "f_a", "n_b", "f_b", percent)) & once & sketches_alike("sketch_a", "sketch_b", percent)
    small = _with_keys(small)
    a, b = side(small, "a"), side(small, "b").withColumnRenamed("key", "key_b")
    pairs = a.join(b, (F.col("key") == F.col("key_b")) & (F.col("id_a") < F.col("id_b")) & (F.col("comp_a") != F.col("comp_b")) & possible)
    pairs = pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    large = live.where(F.col("size") > SMALL).drop("size")
    # CENTRES members of each large bucket, those of its smallest components first: once they have met all
    # others, mostly one component is left. Gathered with bounded state.
    own = persist(large.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("mates")), "mates", few)
    large = persist(join_skewed(large, own, ["key", "comp"], "mates"), "large", files)
    spread = large.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)))
    top = spread.withColumn("r", F.row_number().over(Window.partitionBy("key", "part").orderBy("mates", "id"))).where(F.col("r") <= CENTRES)
    top = persist(top.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("mates", "id"))).where(F.col("r") <= CENTRES).drop("r", "part"), "centres", files)
    b = side(_with_keys(large), "b").withColumnRenamed("key", "key_b")
    met = side(_with_keys(top), "a").join(b, (F.col("key") == F.col("key_b")) & (F.col("comp_a") != F.col("comp_b")) & possible)
    met = met.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))
    used += [own, large, top]
    rest = large.join(top.select("key", "id"), ["key", "id"], "left_anti").select("key", "id")
    return pairs.unionByName(met), rest


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) of pairs (a, b), by their full sets."""
    filled = pairs.select("a", "b").join(sets.withColumnsRenamed({"id": "b", "shingles": "y"}), "b").join(sets.withColumnsRenamed({"id": "a", "shingles": "x"}), "a").select("a", "b", "x", "y")
    return persist(filled.mapInArrow(_confirm(percent), "a long, b long, linked boolean"), "confirmed")


def _across(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """pairs (a, b) with la and lb, the labels of their components, where these differ."""
    if labels is None:
        return pairs.withColumns({"la": F.col("a"), "lb": F.col("b")})
    for x in "ab":
        pairs = pairs.join(labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")), x, "left").withColumn(f"l{x}", F.coalesce(f"l{x}", x))
    return pairs.where("la <> lb")


def _joined(labels: DataFrame | None, links: DataFrame, few: int) -> DataFrame | None:
    """labels (node, label) once links (a, b) are added: only pairs of different labels are looked at."""
    pairs = persist(_across(links, labels).select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "label-pairs", few)
    if not pairs.take(1):
        release(pairs)
        return labels
    moves = connected_components(pairs, few)
    release(pairs)
    if labels is None:
        return moves
    moved = labels.join(moves.select(F.col("node").alias("label"), F.col("label").alias("m")), "label", "left").select("node", F.coalesce("m", "label").alias("label"))
    new = persist(moved.unionByName(moves.join(labels, "node", "left_anti")), "labels", few)
    release(moves, labels)
    return new


def _components(docs: DataFrame, classes: DataFrame, percent: int, width: int) -> DataFrame:
    """(node, label) of all classes that are linked with another one."""
    # tables of numbers, and of numbers with sketches, have a row a class and band at most
    rows = BANDS * classes.count()
    few, files = files_for(docs.sparkSession, rows), files_for(docs.sparkSession, rows, 50_000)
    members = classes.select("id", F.explode("keys").alias("key"))
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("a")).where("size > 1")
    sizes = persist(sizes, "bucket-sizes", few)
    active = persist(join_skewed(members, sizes, ["key"], "size").select("key", "id", "a").where("id <> a"), "buckets", few)
    sketches = classes.select("id", "sketch")
    hubs = active.groupBy(F.col("id").alias("b"), "a").agg(F.count(F.lit(1)).alias("shared"))
    hubs = hubs.join(sketches.withColumnsRenamed({"id": "b", "sketch": "sb"}), "b").join(sketches.withColumnsRenamed({"id": "a", "sketch": "sa"}), "a")
    hubs = persist(hubs.where(sketches_alike("sa", "sb", percent)).select("a", "b", "shared"), "hubs", few)
    sets = _sets_of(docs, hubs.select(F.explode(F.array("a", "b")).alias("id")), width)
    best = hubs.groupBy("b").agg(F.min_by("a", F.struct(-F.col("shared"), F.col("a"))).alias("a"))
    checked = _confirmed(best, sets, percent)
    labels = _joined(None, checked.where("linked").select("a", "b"), few)
    others = persist(_across(hubs.join(best, ["a", "b"], "left_anti").select("a", "b"), labels).select("a", "b"), "others", few)
    if others.take(1):
        done = _confirmed(others, sets, percent)
        checked = checked.unionByName(done)
        labels = _joined(labels, done.where("linked").select("a", "b"), few)
    release(hubs, sets, others)
    found = labels is not None
    if not found:
        labels = docs.sparkSession.createDataFrame([], "node long, label long")
    used: list[DataFrame] = [sizes, active]
    live = _mixed(_with_components(active.select("key", "id"), labels).withColumn("n", F.lit(0)), "open", used, few, few)
    rest = live.select("key", "id")
    if not rest.take(1):
        release(*used)
        return labels
    sets = _sets_of(docs, rest.select("id"), width)
    shared = persist(_shared(sets).join(sketches, "id"), "shared", files)
    end_round(docs.sparkSession)
    while True:
        named = persist(_with_components(rest, labels).join(shared.where(f"100 * f >= {percent} * n"), "id"), "members", files)
        used.append(named)
        candidates, rest = _pairs(named, percent, used, few, files)
        rest = persist(rest, "rest", few)
        near = persist(candidates.distinct().join(checked.select("a", "b"), ["a", "b"], "left_anti"), "near", files)
        release(*used)
        used = [rest]
        if near.take(1):
            done = _confirmed(near, sets, percent)
            checked = checked.unionByName(done)
            joined = _joined(labels if found else None, done.where("linked").select("a", "b"), few)
            found = joined is not None
            labels = joined if found else labels
        release(near)
        if not rest.take(1):
            release(rest, sets, shared)
            return labels
        end_round(docs.sparkSession)


def _classified(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """(id, doc_id, n, component_id, kept) of every row. id is the row's own; component_id is the component's smallest doc_id."""
    own = docs.select(_own_id().alias("id"), text_or_empty().alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    rows = persist(own.mapInArrow(_features(width), "id long, doc_id long, n long, same binary, keys array<long>, sketch array<long>"), "shingled")
    # first: the row that stays, if only this class is looked at
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "id")).alias("first")
    groups = persist(rows.where("n > 0").groupBy("same").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"), first), "classes")
    # the row of the smallest id brings the class's bands; repeated rows bring them once
    classes = persist(rows.where("n > 0").join(groups.select("same", F.col("rep").alias("id")), ["same", "id"], "left_semi").select("id", "same", "keys", "sketch").dropDuplicates(["id", "same"]), "bands")
    labels = _components(docs, classes, percent, width)
    release(classes)
    linked = labels.withColumnRenamed("node", "rep")
    heads = persist(linked.join(groups.select("rep", "first"), "rep").groupBy("label").agg(F.min("first").alias("head"), F.count(F.lit(1)).alias("mates")), "heads")
    linked = join_skewed(linked, heads, ["label"], "mates").select("rep", "head")
    reps = persist(groups.join(linked, "rep", "left").select("same", F.coalesce("head", "first").alias("head"), "size"), "class-heads")
    release(groups, labels, heads)
    found = join_skewed(rows.where("n > 0").select("id", "doc_id", "n", "same"), reps, ["same"], "size").select("id", "doc_id", "n", F.col("head.doc_id").alias("component_id"), (F.col("id") == F.col("head.id")).alias("kept"))
    return found.unionByName(rows.where("n = 0").select("id", "doc_id", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))


def near_duplicates(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; linked at 100 * intersection >= percent * union."""
    return _classified(docs, percent, width).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "kept")


def keep_one_each(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """docs, all columns: of each group of near duplicates the row with the smallest doc_id. Rows that go are
    fewer than rows that stay, so they are the side that joins; Spark broadcasts them while they are small."""
    found = persist(_classified(docs, percent, width).groupBy("id").agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("rows"), F.max("n").alias("n")).where("not kept or rows > 1 and n > 0"), "found")
    # the caller's columns are one struct: no name of theirs can meet one of ours
    rows = docs.select(_own_id().alias("id"), F.struct("*").alias("row"))
    stay = rows.join(found.where("not kept").select("id"), "id", "left_anti")
    tied = found.where("kept").select("id")
    if not tied.take(1):
        return stay.select("row.*")
    # rows alike in doc_id and text: one with words stays for the group, all without words do
    one = stay.join(tied, "id", "left_semi").dropDuplicates(["id"])
    return stay.join(tied, "id", "left_anti").unionByName(one).select("row.*")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 85, 3)


#: By the definition: shingles that two texts share are counted by a join on the shingle, components by what can be reached.
OP7_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT k, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS sh FROM d
), x AS (SELECT k, unnest(sh) AS t FROM s),
c AS (SELECT a.k AS a, b.k AS b, count(*) AS n FROM x a JOIN x b ON a.t = b.t AND a.k < b.k GROUP BY ALL),
l AS (SELECT c.a, c.b FROM c JOIN s p ON p.k = c.a JOIN s q ON q.k = c.b WHERE 100 * c.n >= 85 * (len(p.sh) + len(q.sh) - c.n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT k, k AS m FROM d UNION SELECT r.k, e.b FROM r JOIN e ON e.a = r.m),
g AS (SELECT r.k, min(d.doc_id) AS component_id FROM r JOIN d ON d.k = r.m GROUP BY r.k)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, g.component_id, s.doc_id = g.component_id AS kept FROM s JOIN g ON g.k = s.k
"""
