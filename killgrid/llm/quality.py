"""Quality classification by hierarchical empirical Bayes.

A logistic model over whole texts (byte frequencies, repetition, word and line
shape) gives each document's evidence. Evidence is summed by host and by path
in grouped aggregations; a host's rate is shrunk toward the global rate, a
path's rate toward its host's, each with a strength estimated by the method of
moments, so sparse sites stay near their prior. A document's posterior is its
evidence moved from the global prior to its path's.

The model is fitted on at most TRAIN_DOCS labelled rows, chosen by a hash of
the id; all other sums are over all documents. Site rates go to the documents
by broadcast while there are at most BROADCAST_SITES of them; above that, those
of sites with a large share of all documents do, and the others by a shuffle.

Defined results: a null text is empty; null host or path is a site of its own;
labels are combined per id by their smallest quality, null labels are left
out; without labels of both kinds the evidence is 0 and everything is kept;
rows are independent given the rates, so repeated rows give repeated results;
documents of equal text on one path tie, and stay or go together; an empty
table gives no rows; `keep_good` carries all columns, whatever their names,
through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_slices, join_skewed, persist, release, table

TRAIN_DOCS, BROADCAST_SITES, SEED = 8_000, 20_000, 11
#: A document is rejected if the posterior of its being good is below this.
THRESHOLD = 0.4
CLAMP = 12.0
N_FEATURES = 256 + 7


def features(texts: pa.Array) -> np.ndarray:
    """One row per text: square roots of byte frequencies, then shape and repetition."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    out = np.zeros((len(texts), N_FEATURES), np.float64)
    words = pc.ascii_split_whitespace(texts)
    bounds = words.offsets.to_numpy().astype(np.int64)
    flat = words.flatten()
    codes = flat.dictionary_encode().indices.to_numpy()
    bounds -= bounds[0]
    n_words = np.diff(bounds)
    doc = np.repeat(np.arange(len(texts)), n_words)
    again = np.zeros(len(codes), bool)
    again[1:] = (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])
    kinds = np.bincount(np.unique(doc * (int(codes.max(initial=0)) + 1) + codes) // (int(codes.max(initial=0)) + 1), minlength=len(texts))
    ascii_end = pc.match_substring_regex(flat, r"[^\p{L}\p{N}\s.,;:]$").to_numpy(zero_copy_only=False)
    upper = pc.match_substring_regex(flat, r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$").to_numpy(zero_copy_only=False)
    n = np.maximum(n_words, 1)
    per = lambda x: np.bincount(doc, x, minlength=len(texts)) / n
    data = texts.buffers()[2]
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    for i in range(len(texts)):
        if offsets[i + 1] > offsets[i]:
            out[i, :256] = np.bincount(raw[offsets[i] : offsets[i + 1]], minlength=256)
    size = np.maximum(out[:, :256].sum(1), 1)
    lines = out[:, 10].copy()
    out[:, :256] = np.sqrt(out[:, :256] / size[:, None])
    for k, x in enumerate((per(again), 1 - kinds / n, per(ascii_end), per(upper), np.log1p(n_words) / 10, lines / n, np.log1p(size / n) / 3)):
        out[:, 256 + k] = x
    return out


def _evidence(texts: pa.Array, model: np.ndarray) -> np.ndarray:
    return np.clip(features(texts) @ model[1:] + model[0], -CLAMP, CLAMP)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 25) -> np.ndarray:
    """Intercept and weights by Newton steps with a ridge penalty on the weights."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = TRAIN_DOCS) -> np.ndarray:
    """Weights of the document model, from a bounded sample of labelled rows."""
    rated = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").cast("double").alias("good"))
    n = rated.count()
    chosen = rated.where(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1_000_000)) < int(1_000_000 * min(1, sample / max(1, n)))).limit(2 * sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_slices(batches, "text"):
            x = features(batch.column(1)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "good", "x"])

    found = sorted((r[0], r[1], bytes(r[2])) for r in rows.select("id", "text", "good").mapInArrow(run, "id long, good double, x binary").collect())
    y = np.array([q for _, q, _ in found])
    if not len(y) or y.min() == y.max():
        return np.zeros(N_FEATURES + 1)
    return fit_logistic(np.array([np.frombuffer(x, np.float32) for _, _, x in found], np.float64), (y > 0).astype(float))


def with_evidence(docs: DataFrame, model: np.ndarray, host: Column, path: Column, whole: bool) -> DataFrame:
    """id, host, path and logit of each row, and with `whole` the row itself, as a struct: no column of the caller's can clash."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [F.col("doc_id").cast("long").alias("id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), *([F.struct("*").alias("row")] if whole else []), F.col("text").cast("string").alias("text")]
    own = docs.select(*columns)
    shape = own.drop("text").schema.add("logit", "double")
    names = shape.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(_evidence(batch.columns[-1], shared.value))], names=names)

    return own.mapInArrow(run, shape)


def _strength(sums: DataFrame, n: str, p: str, toward: Column) -> float:
    """How many documents a prior counts for: from the spread of group rates around their prior."""
    total, square, within, between, groups = sums.agg(F.sum(n), F.sum(F.col(n) * F.col(n)), F.sum(F.col(n) * toward * (1 - toward)), F.sum(F.col(n) * F.pow(F.col(p) / F.col(n) - toward, 2)), F.count(F.lit(1))).first()
    if not total or groups < 2:
        return 1e6
    variance = within / total
    spread = (between - groups * variance) / max(1e-9, total - square / total)
    return float(min(1e6, max(1.0, variance / spread - 1))) if spread > 1e-12 else 1e6


def site_rates(evidence: DataFrame) -> tuple[DataFrame, float]:
    """host, path, n, and the posterior rates of both, one row for each path; and the global rate."""
    sums = persist(evidence.groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.round(1 / (1 + F.exp(-F.col("logit"))), 9)).alias("p")), "site-sums")
    hosts = sums.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("p").alias("hp"))
    total, good = sums.agg(F.sum("n"), F.sum("p")).first()
    if not total:
        return sums.select("host", "path", "n", F.lit(0.5).alias("host_rate"), F.lit(0.5).alias("path_rate")), 0.5
    rate = (good + 1) / (total + 2)
    k = _strength(hosts, "hn", "hp", F.lit(rate))
    hosts = hosts.withColumn("host_rate", (F.col("hp") + k * rate) / (F.col("hn") + k))
    both = persist(sums.join(hosts.select("host", "host_rate"), "host"), "site-rates")
    release(sums)
    k = _strength(both, "n", "p", F.col("host_rate"))
    return both.select("host", "path", "n", "host_rate", ((F.col("p") + k * F.col("host_rate")) / (F.col("n") + k)).alias("path_rate")), rate


def with_posterior(evidence: DataFrame, rates: DataFrame, rate: float) -> DataFrame:
    """evidence with host_rate, path_rate and good, the posterior of being good."""
    keys = ["host", "path"]
    joined = evidence.join(F.broadcast(rates), keys) if rates.count() <= BROADCAST_SITES else join_skewed(evidence, rates, keys, "n")
    logit = lambda x: F.log(x / (1 - x))
    return joined.withColumn("good", 1 / (1 + F.exp(-(F.col("logit") + logit(F.col("path_rate")) - logit(F.lit(rate))))))


def _sites() -> tuple[Column, Column]:
    """documents have no URL: the source is the host, its part in one language the path."""
    return F.col("source"), F.concat_ws("/", F.col("source"), F.col("lang"))


def rate_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, evidence (logit), host, path, their posterior rates, quality (posterior) and kept."""
    model = fit(docs, labels)
    evidence = persist(with_evidence(docs, model, *_sites(), whole=False), "evidence")
    rates, rate = site_rates(evidence)
    return with_posterior(evidence, rates, rate).select(
        F.col("id").alias("doc_id"),
        F.round("logit", 6).alias("evidence"),
        "host",
        "path",
        F.round("host_rate", 6).alias("host_rate"),
        F.round("path_rate", 6).alias("path_rate"),
        F.round("good", 6).alias("quality"),
        (F.col("good") >= THRESHOLD).alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, all columns, without the documents whose posterior is below THRESHOLD. Texts are read again
    for the decision, as that moves nothing, whereas joining decisions to texts would shuffle them."""
    model = fit(docs, labels)
    rates, rate = site_rates(with_evidence(docs, model, *_sites(), whole=False))
    return with_posterior(with_evidence(docs, model, *_sites(), whole=True), rates, rate).where(F.col("good") >= THRESHOLD).select("row.*")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
