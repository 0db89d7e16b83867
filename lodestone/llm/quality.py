"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

A text's features are counts of its byte trigrams hashed to `BUCKETS`, damped by log(1 + count), weighted by inverse document
frequency and scaled to length 1, and three shares of repeated words; their projection on the leading right singular vectors of the sample's features is its
latent-semantic vector. The sample is bounded: the `SAMPLE` labelled rows of each label outside the held-out fifth that a
hash of doc_id puts first. Its vectors and labels (about 2 MB at the defaults, however many documents there are) are
broadcast; every document's cosine with all of them is computed by blocks of matrix products, and its `NEIGHBOURS` nearest
vote with their cosine to the power `SHARPNESS` as weight. As the sample holds equally many rows of either label, a vote also
counts by how many labelled rows its sample row stands for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, text_of
from .hashing import blocks, buffers, shingles, words

BUCKETS = 4096
SAMPLE = 1024
DIMENSIONS = 64
NEIGHBOURS = 15
SHARPNESS = 16
THRESHOLD = 0.3
STYLE = 3


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0


def features(raw: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """A row per text: log(1 + count) of hashed byte trigrams, then `STYLE` shares of repeated words.

    The shares are words equal to the word before, words of shingles of four that occurred before in the text, and words
    that occurred before; each is scaled to weigh about as much as all trigrams together.
    """
    n = len(offsets) - 1
    counts = np.zeros(n * buckets)
    if len(raw) >= 3:
        b = raw.astype(np.uint32)
        h = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
        h = (h >> np.uint32(8)) % np.uint32(buckets)
        row = np.repeat(np.arange(n), np.diff(offsets))
        inside = row[:-2] == row[2:]
        counts = np.bincount((row[:-2] * buckets + h)[inside], minlength=n * buckets)
    w, text = words(raw, offsets)
    total = np.bincount(text, minlength=n)
    beside = np.bincount(text[1:][(w[1:] == w[:-1]) & (text[1:] == text[:-1])], minlength=n) if len(w) else np.zeros(n)
    distinct4 = np.bincount(shingles(w, text, n, 4)[1], minlength=n)
    distinct1 = np.bincount(shingles(w, text, n, 1)[1], minlength=n)
    share = lambda part, whole: np.where(whole > 0, part / np.maximum(whole, 1), 0)
    style = np.stack([share(beside, total), 1 - share(distinct4 + 3 * (total > 3), np.maximum(total, 1)), 0.3 * (1 - share(distinct1, total))], axis=1)
    return np.concatenate([np.log1p(counts).reshape(n, buckets), np.clip(style, 0, 1)], axis=1).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Model:
    """What is broadcast: inverse document frequencies, projection, the sample's vectors, labels and vote weights."""

    def __init__(self, x: np.ndarray, y: np.ndarray, stands_for: np.ndarray, dimensions: int = DIMENSIONS):
        self.y, self.stands_for = y.astype(np.float64), stands_for.astype(np.float64)
        total = self.stands_for.sum()
        self.prior = float((self.y * self.stands_for).sum() / total) if total else 0.5
        # by blocks, and by subspace iteration rather than a full decomposition: the driver holds one dense copy of the sample
        held = np.zeros(x.shape[1] - STYLE, dtype=np.int64)
        for a in range(0, len(x), 256):
            held += (x[a : a + 256, :-STYLE] > 0).sum(axis=0)
        self.idf = np.log((1 + len(x)) / (1 + held)).astype(np.float32) + np.float32(1)
        z = np.empty(x.shape, dtype=np.float32)
        for a in range(0, len(x), 256):
            z[a : a + 256] = self.terms(x[a : a + 256].astype(np.float32))
        q = np.random.default_rng(7).standard_normal((len(x), min(len(x), dimensions + 16))).astype(np.float32)
        for _ in range(6 if len(x) else 0):
            q = np.linalg.qr(z @ (z.T @ q))[0]
        small = q.T @ z
        values, vectors = np.linalg.eigh((small @ small.T).astype(np.float64)) if len(x) else (np.zeros(0), np.zeros((0, 0)))
        top = [i for i in np.argsort(values)[::-1][:dimensions] if values[i] > 1e-9]
        self.project = (small.T @ (vectors[:, top] / np.sqrt(values[top]))).astype(np.float32) if top else np.zeros((x.shape[1], 0), np.float32)
        self.vectors = _unit(z @ self.project)

    def terms(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([_unit(x[:, :-STYLE] * self.idf), x[:, -STYLE:]], axis=1)

    def score(self, x: np.ndarray, neighbours: int = NEIGHBOURS, sharpness: int = SHARPNESS) -> np.ndarray:
        """Weighted share of label 1 among the nearest sample rows; the prior where no cosine is positive."""
        if not len(self.y):
            return np.full(len(x), self.prior)
        cosine = (_unit(self.terms(x) @ self.project) @ self.vectors.T).astype(np.float64)
        k = min(neighbours, cosine.shape[1])
        near = np.argpartition(cosine, cosine.shape[1] - k, axis=1)[:, -k:]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0) ** sharpness * self.stands_for[near]
        total = weight.sum(axis=1)
        return np.clip(np.where(total > 0, (weight * self.y[near]).sum(axis=1) / np.where(total > 0, total, 1), self.prior), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of the labelled rows outside the held-out fifth. Rows with several labels count by the lowest, null labels
    and labels of absent documents do not count. Only the bounded sample's features reach the driver."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where(~held_out())
    sizes = {r["quality"]: r["count"] for r in known.where("quality in (0, 1)").groupBy("quality").count().collect()}
    parts = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for q in (0, 1)]
    chosen = parts[0].unionByName(parts[1])  # 2 * sample rows at most
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")

    def take(batches):
        for batch in batches:
            raw, offsets = buffers(batch.column(2))
            for a, b in blocks(offsets):
                x = features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b].cast(pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "quality", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = rows.mapInArrow(take, f"doc_id {kind}, quality int, x binary").dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id")
    x = np.frombuffer(b"".join(got["x"]), np.float16).reshape(-1, BUCKETS + STYLE)
    y = got["quality"].to_numpy(np.int64) if len(got) else np.zeros(0, np.int64)
    del got
    held = {q: max(1, int((y == q).sum())) for q in (0, 1)}
    return Model(x, y, np.array([sizes.get(int(q), 0) / held[int(q)] for q in y]))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs with `quality_score` added: 0 to 1, higher where label 1 is likelier. Only text is an input.

    Null and empty texts, and texts under three bytes, get the share of label 1 among the labelled rows (0.5 if there are
    none). Repeated rows stay; a column named quality_score is replaced; an empty table stays empty.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs, labels, sample))
    kept = docs.drop("quality_score")
    names = [*kept.columns, "quality_score"]
    text = names.index("text")

    def run(batches):
        for batch in batches:
            column = batch.column(text).cast(pa.large_string()).fill_null("")
            raw, offsets = buffers(column)
            out = [model.value.score(features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) for a, b in blocks(offsets)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())], names=names)

    from pyspark.sql import types as T

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("quality_score", T.DoubleType())]))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, load(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), F.when(F.col("quality_score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
