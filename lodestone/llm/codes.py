"""Product codes of integer vectors, their nearest entries found by equal-average search.

Vectors are cut into equal parts, each part position has a codebook, and a part's code is the index of its nearest entry. Entries
are sorted by the sum of their components. The squared gap between two sums, divided by the dimension, is never above the squared
distance; so a search starts at the part's own sum, goes outward on both sides and ends on a side once that bound strictly exceeds
the best distance. All vectors of a block take their steps together.

A round is one pass over the written vectors with the codebooks in the tasks (256 entries): each task adds up its parts per entry,
Spark adds up the tasks' sums, and the driver takes the new entries, whose number does not depend on the vectors'.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Spread, load, settle

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components whose integer is not below this have no code: sums of squares must fit 64 bits.
MOST = 1 << 26
BLOCK = 1024


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest entry, ties to the lower index."""
    n, d = x.shape
    k = len(entries)
    order = np.argsort(entries.sum(axis=1), kind="stable")
    sorted_, sums, own = entries[order], entries.sum(axis=1)[order], x.sum(axis=1)
    best, who = np.full(n, (1 << 62) // max(d, 1), dtype=np.int64), np.full(n, k, dtype=np.int64)
    start = np.searchsorted(sums, own)
    sides = [(1, np.flatnonzero(start < k), start[start < k]), (-1, np.flatnonzero(start > 0), start[start > 0] - 1)]
    while any(len(rows) for _, rows, _ in sides):
        for i, (step, rows, at) in enumerate(sides):
            gap = sums[at] - own[rows]
            go = gap * gap <= best[rows] * d
            rows, at = rows[go], at[go]
            diff = x[rows] - sorted_[at]
            dist, index = np.einsum("ij,ij->i", diff, diff), order[at]
            better = (dist < best[rows]) | ((dist == best[rows]) & (index < who[rows]))
            best[rows[better]], who[rows[better]] = dist[better], index[better]
            at = at + step
            inside = (at >= 0) & (at < k)
            sides[i] = (step, rows[inside], at[inside])
    return who, best


def _blocks(batches, column: int, d: int):
    """(batch, vectors) in blocks of BLOCK rows."""
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            some = batch.slice(a, BLOCK)
            yield some, np.asarray(some.column(column).flatten(), dtype=np.int64).reshape(some.num_rows, d)


def _sums(books: list[np.ndarray], d: int):
    """A task's parts added up: part, entry, n, sums."""

    def run(batches):
        w = d // len(books)
        n, sums = np.zeros((len(books), len(books[0])), np.int64), np.zeros((len(books), len(books[0]), w), np.int64)
        for _, x in _blocks(batches, 0, d):
            for p, book in enumerate(books):
                part = x[:, p * w : (p + 1) * w]
                who, _ = nearest(part, book)
                np.add.at(n[p], who, 1)
                np.add.at(sums[p], who, part)
        at = np.argwhere(n > 0)
        flat = [sums[p, e] for p, e in at]
        yield pa.RecordBatch.from_arrays(
            [pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array(n[n > 0], pa.int64()), pa.array([f.tolist() for f in flat], pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"]
        )

    return run


def _coded(books: list[np.ndarray], d: int, others: list[str]):
    def run(batches):
        w = d // len(books)
        for some, x in _blocks(batches, len(others), d):
            found = [nearest(x[:, p * w : (p + 1) * w], book) for p, book in enumerate(books)]
            who = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
            error = sum(f[1] for f in found)
            yield pa.RecordBatch.from_arrays([*some.columns[: len(others)], pa.array([bytes(r).hex() for r in who]), pa.array(error, pa.int64())], names=[*others, "code", "error"])

    return run


def integers(vectors: DataFrame, others: list[str], vector: str = "embedding") -> DataFrame:
    """The rows whose vector is not null and holds only finite components, with `v`, the floor of SCALE times each (null where one
    reaches MOST)."""
    x = F.transform(F.col(vector), lambda e: e.cast("double"))
    whole = vectors.select(*others, x.alias("__x")).where(F.col("__x").isNotNull() & F.forall("__x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))
    small = F.forall("__x", lambda e: (F.floor(e * SCALE) < MOST) & (F.floor(e * SCALE) > -MOST))
    return whole.select(*others, F.when(small, F.transform("__x", lambda e: F.floor(e * SCALE).cast("long"))).alias("v"))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, key: str = "vec_id", label: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """(rows, codebooks): key, label, code, error of the vectors (see `integers`), and an array of entries for each part.

    The codebooks start as the parts of the `entries` smallest keys (null keys last, equal ones by their vectors); fewer vectors
    make smaller ones. Only vectors of the commonest length (of equally common ones the largest), if that is a multiple of `parts`,
    without components of MOST and more, have a code; the others have null code and error. Repeated rows count as often as they
    occur; an empty table has no rows and no codebooks; other columns are not read. At most 256 entries, so that an index is a byte.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries must be 1 to 256")
    rows = settle(integers(vectors, [key, label]).withColumn("d", F.size("v")), "integer-vectors")
    lengths = rows.where("v IS NOT NULL").groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    d = lengths["d"] if lengths else -1
    if d < 0 or d % parts:
        return rows.select(key, label, F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")), []
    own = rows.where((F.col("d") == d) & F.col("v").isNotNull())
    w = d // parts
    first = np.array([r["v"] for r in own.orderBy(F.col(key).asc_nulls_last(), "v").select("v").limit(entries).collect()], dtype=np.int64).reshape(-1, d)
    books = [first[:, p * w : (p + 1) * w].copy() for p in range(parts)]
    for _ in range(rounds):
        found = own.select("v").mapInArrow(_sums(books, d), "part int, entry int, n long, sums array<bigint>")
        total = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(w)))
        for r in total.collect():  # a row for each part and entry at most
            books[r["part"]][r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(w)]
    kind = rows.select(key, label).schema
    coded = own.select(key, label, "v").mapInArrow(_coded(books, d, [key, label]), kind.add("code", "string").add("error", "long"))
    rest = rows.where((F.col("d") != d) | F.col("v").isNull())
    return coded.unionByName(rest.select(key, label, F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))), books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components as decimals by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings with the errors of equal labels (nulls together) added up; nulls, odd lengths, ties, repeated rows and
    empty tables as in `compress`. A label may hold any share of the rows: sums are joined back with salted keys."""
    rows, books = compress(load(spark, sf_dir, "embeddings"))
    rows = settle(rows, "vector-codes").withColumn("key", F.when(F.col("label").isNull(), "").otherwise(F.concat(F.lit("="), F.col("label").cast("string"))))
    sums = settle(rows.groupBy("key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("held")), "label-errors")
    out = Spread(sums, "vec_id").join(rows, sums.drop("held"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    w = "ep"
    out = [
        "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"{w} AS (SELECT vec_id, label, p, v[(p * len(v) // 4 + 1):((p + 1) * len(v) // 4)] AS x FROM v, range(4) AS r(p))",
        "b0 AS (SELECT p, e, x AS c FROM (SELECT p, x, vec_id, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM ep) WHERE e < 256)",
    ]
    for i in range(5):
        out.append(f"a{i} AS MATERIALIZED (SELECT vec_id, label, p, any_value(x) AS x, min((CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), e)) AS best FROM ep JOIN b{i} USING (p) GROUP BY vec_id, label, p)")
        if i < 4:
            out.append(f"s{i} AS (SELECT p, e, list(CAST(floor(t / n) AS BIGINT) ORDER BY k) AS c FROM (SELECT p, best[2] AS e, k, sum(x[k + 1]) AS t, count(*) AS n FROM a{i}, range(64) AS r(k) WHERE k < len(x) GROUP BY ALL) GROUP BY p, e)")
            out.append(f"b{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(s.c, b.c) AS c FROM b{i} b LEFT JOIN s{i} s USING (p, e))")
    out.append("r AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM a4 GROUP BY vec_id)")
    out.append("h AS (SELECT sha256(string_agg(CAST(u AS VARCHAR), ',' ORDER BY p, e, k)) AS codebooks_sha256 FROM (SELECT p, e, unnest(c) AS u, generate_subscripts(c, 1) AS k FROM b4))")
    return "WITH " + ",\n".join(out) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r, h"


OP12_SQL = _sql()
