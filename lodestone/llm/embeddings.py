"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors are rotated by a fixed random orthogonal matrix and cut into `SUBSPACES` blocks of coordinates. Cosine >= c means a
squared distance of at most 2 - 2c, so in some block the squared distance is at most that block's share (in proportion to its
coordinates) of it: each block is range-joined under its share, and the union of the candidates is verified exactly.

Vectors are dealt to parts of bounded size, and each pair of parts meets in one task, for all blocks. The pairs take turns, so
what is dealt at one time is at most two copies of the vectors (or `DEALT` rows, if that is more) and disk grows with them.

The range join of a block: pivots, sampled from the data and bounded in number, cut the block into cells; a vector lives in the
cell of its nearest pivot and visits each cell that it may reach within the radius, by the distance to the plane between the two
pivots. Residents of one part and visitors of the other are compared by matrix products. A candidate counts in the first block
that finds it, so sums of partial counts are exact link counts and no pair is written: a task writes a count for each vector and
a forest of its links. Equal vectors are one class with a size and are never compared with each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, load, release, settle
from .neardup import _groups

BOUND = 0.9
SUBSPACES = 4
SEED = 20
#: Residents a pivot, bounds on pivots of a block, and rows of a part.
PER_PIVOT, MOST_PIVOTS, PART = 16_384, 512, 32_768
#: Parts that there are at least, so that few vectors are compared by more than a few tasks, and rows dealt in a turn.
LEAST_PARTS, DEALT = 6, 1 << 19
#: Rows and columns of a product, small enough for a processor's cache, and candidates of a task in memory at once.
TILE, CANDIDATES = (256, 2048), 1 << 16
#: Added to squared radii and taken from the cosine bound for candidates: far above rounding, far below anything that counts.
SLACK = 1e-5


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def cuts(dim: int, subspaces: int = SUBSPACES) -> list[tuple[int, int]]:
    edges = np.linspace(0, dim, min(subspaces, dim) + 1).astype(int)
    return list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten(), dtype=np.float64)
    x = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
    return x / np.abs(x).max(axis=1, keepdims=True) if len(column) else x  # no overflow of squares


def turns(parts: int, n: int) -> list[list[int]]:
    """For each turn the signed offsets at which a vector's part meets others: 0 is the part itself, half of an even number has one sign."""
    out, most = [[0]], max(2, DEALT // max(n, 1))
    for offset in range(1, parts // 2 + 1):
        both = [offset] if 2 * offset == parts else [offset, -offset]
        if len(out[-1]) + len(both) > most:
            out.append([])
        out[-1] += both
    return out


def _dealt(classes: DataFrame, parts: int, offsets: list[int]) -> DataFrame:
    """A row for each pair of parts (low, high) that a vector takes part in."""
    part = F.pmod("cls", F.lit(parts)).cast("int")
    rows = classes.select("cls", "size", part.alias("part"), "v", F.explode(F.array(*map(F.lit, offsets))).alias("offset"))
    other = F.pmod(F.col("part") + F.col("offset"), F.lit(parts))
    return rows.select(F.least("part", other).alias("low"), F.greatest("part", other).alias("high"), "cls", "size", "part", "v")


def _cells(y: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(home, visits): the cell of each row, and whether it may reach each cell within the radius."""
    home, visits = np.zeros(len(y), dtype=np.int64), np.ones((len(y), len(pivots)), dtype=bool)
    if len(pivots) < 2:
        return home, visits
    gap = np.linalg.norm(pivots[:, None] - pivots[None], axis=2)
    for s in range(0, len(y), 4096):
        e = slice(s, s + 4096)
        d = (y[e] ** 2).sum(1)[:, None] - 2 * y[e] @ pivots.T + (pivots**2).sum(1)[None]
        home[e] = h = d.argmin(1)
        visits[e] = (d - d[np.arange(len(d)), h][:, None] <= 2 * radius * gap[h]) | (gap[h] < 1e-6)
    return home, visits


def _join(dim: int, subspaces: int, bound: float, pivots: list[np.ndarray] | None = None, keys: int = 4):
    """Partial link counts (cls, None, links) and links of a forest (cls, other, 0) of each pair of parts, whose rows have equal
    first `keys` columns. Where there is a column `block`, that block finds candidates, else each of them does in turn."""
    total, turn, ranges = 2 - 2 * bound, rotation(dim), cuts(dim, subspaces)
    limits = [total * (b - a) / dim + SLACK for a, b in ranges]
    margins = [5e-7 * (b - a + 8) for a, b in ranges]  # a bound on the error of a squared distance in single precision
    pivots = pivots or [np.zeros((1, b - a)) for a, b in ranges]

    def candidates(y, k, left, right):
        """(i, j) within the block's limit, some of them beyond it by the margin; in both orders where left is right."""
        a, b = ranges[k]
        home, visits = _cells(y[:, a:b], pivots[k], (limits[k] + SLACK) ** 0.5)  # beyond the limit, whatever the rounding
        half = ((y[:, a:b] ** 2).sum(1) / -2)[:, None]
        ones = np.ones_like(half)
        # minus half the squared distance as one product, in single precision: a first test, the second is in double
        rows_of, columns_of = (np.concatenate([y[:, a:b], *x], axis=1).astype(np.float32) for x in ((half, ones), (ones, half)))
        least, room = np.float32(-(limits[k] + margins[k]) / 2), TILE[0] * TILE[1]
        products, fits = np.empty(room, dtype=np.float32), np.zeros(room + 7, dtype=bool)  # used again and again
        found, held = [], 0
        for cell in np.unique(home[left]):
            ids, columns = left[home[left] == cell], right[visits[right, cell]]
            for t in range(0, len(columns), TILE[1]):
                some = columns[t : t + TILE[1]]
                against = np.ascontiguousarray(columns_of[some].T)
                for s in range(0, len(ids), TILE[0]):
                    rows = ids[s : s + TILE[0]]
                    n = len(rows) * len(some)
                    np.matmul(rows_of[rows], against, out=products[:n].reshape(len(rows), len(some)))
                    np.greater_equal(products[:n], least, out=fits[:n])
                    fits[n : n + 7] = False
                    eights = fits[: (n + 7) // 8 * 8].reshape(-1, 8)
                    eight = np.flatnonzero(eights.view(np.uint64))  # few hold a candidate
                    at, place = np.nonzero(eights[eight])
                    at = eight[at] * 8 + place
                    for c in range(0, len(at), CANDIDATES):
                        i, j = np.divmod(at[c : c + CANDIDATES], len(some))
                        found.append((rows[i], some[j]))
                        held += len(i)
                        if held >= CANDIDATES:
                            yield tuple(np.concatenate(x) for x in zip(*found, strict=True))
                            found, held = [], 0
        if found:
            yield tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def run(batches):
        for group in _groups(batches, keys):
            low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
            cls, size, part = (np.asarray(group.column(c)) for c in ("cls", "size", "part"))
            raw = _matrix(group.column("v"))
            y = (raw / np.linalg.norm(raw, axis=1, keepdims=True)) @ turn
            links, edges = np.zeros(len(cls), dtype=np.int64), (np.zeros(0, np.int64),) * 2
            left, right = np.flatnonzero(part == low), np.flatnonzero(part == high)
            for k in [group.column("block")[0].as_py()] if "block" in group.column_names else range(len(ranges)):
                for i, j in candidates(y, k, left, right):
                    if low == high:  # two of a part meet twice
                        i, j = i[i < j], j[i < j]
                    for c in range(k + 1):  # within this block's limit and no earlier one's: found there, it is counted there
                        a2, b2 = ranges[c]
                        within = ((y[i, a2:b2] - y[j, a2:b2]) ** 2).sum(1) <= limits[c]
                        i, j = i[within == (c == k)], j[within == (c == k)]
                    cosine = np.einsum("nd,nd->n", raw[i], raw[j]) / (np.linalg.norm(raw[i], axis=1) * np.linalg.norm(raw[j], axis=1))
                    i, j = i[cosine >= bound], j[cosine >= bound]
                    np.add.at(links, i, size[j])
                    np.add.at(links, j, size[i])
                    edges = np.concatenate([edges[0], i]), np.concatenate([edges[1], j])
                    if len(edges[0]) > len(cls) + 4 * CANDIDATES:  # only a forest of what came before stays in memory
                        edges = _forest(*edges, len(cls))
            out_a, out_b = _forest(*edges, len(cls))
            out_a, out_b = cls[out_a], cls[out_b]
            held = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([cls[held], out_a]), pa.int64()), pa.array([None] * len(held) + out_b.tolist(), pa.int64()),
                pa.array(np.concatenate([links[held], np.zeros(len(out_a), np.int64)]), pa.int64()),
            ], names=["a", "b", "links"])

    return run


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, root): links that connect what (i, j) connect, one at most for each of the n."""
    label = np.arange(n)
    while True:
        before = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if (before == label).all():
            break
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def near_vectors(vectors: DataFrame, bound: float = BOUND, subspaces: int = SUBSPACES) -> DataFrame:
    """One row per row of vectors (vec_id, embedding): vec_id, n_links, component_id, kept.

    Cosines are taken in double precision. A vector that is null, empty, zero, or holds null or non-finite components is linked
    with nothing, nor are vectors of different lengths. A row without a vec_id takes part; a component without any has a null
    component_id and its rows are kept. Repeated rows are linked with each other and stay; other columns are
    not read; an empty table gives an empty result.
    """
    v = F.col("embedding") if dict(vectors.dtypes)["embedding"] == "array<float>" else F.col("embedding").cast("array<double>")
    good = F.expr("size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) AND exists(v, x -> x <> 0)")
    rows = vectors.select("vec_id", v.alias("v")).withColumn("ok", F.coalesce(good, F.lit(False)))
    rows = rows.withColumn("most", F.when(F.col("ok"), F.expr("array_max(transform(v, y -> abs(cast(y AS double))))")))
    rows = rows.withColumn("cls", F.expr("transform(v, x -> cast(x AS double) / most)")).drop("most")
    same = F.when(F.col("ok"), F.xxhash64("cls")).alias("h"), F.when(F.col("ok"), F.xxhash64(F.lit(1), "cls")).alias("g")  # 128 bits
    whole = settle(rows.select("vec_id", "v", "ok", *same, F.size("v").alias("dim")), "vectors")
    classes = settle(whole.where("ok").groupBy("h", "g").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("v").alias("v"), F.first("dim").alias("dim")).withColumn("cls", F.monotonically_increasing_id()), "vector-classes")
    rows = settle(whole.select("vec_id", "ok", "h", "g"), "vector-ids")
    release(whole)
    found = []
    for r in classes.groupBy("dim").count().where("count > 1").collect():  # a row for each length of vector
        found += _compare(classes.where(F.col("dim") == r["dim"]), r["dim"], r["count"], bound, min(subspaces, r["dim"]))
    if not found:
        named = classes.select("h", "g", "size", F.col("rep").alias("component_id"), F.lit(0).cast("long").alias("links"))
    else:
        every = found[0]
        for table in found[1:]:
            every = every.unionByName(table)
        counts, label = every.where("b is null").groupBy("a").agg(F.sum("links").alias("links")), components(every.where("b is not null").select("a", "b"))
        named = classes.join(label, F.col("cls") == F.col("id"), "left").withColumn("component", F.coalesce("component", "cls")).select("h", "g", "cls", "rep", "size", "component")
        least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
        named = named.join(least, "component").join(counts, F.col("cls") == F.col("a"), "left").select("h", "g", "size", "component_id", F.coalesce("links", F.lit(0)).alias("links"))
    named = settle(named, "vector-components")
    release(classes, *found)
    out = rows.join(named, ["h", "g"], "left")
    component = F.when(F.col("ok"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce(F.col("links") + F.col("size") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _compare(classes: DataFrame, dim: int, n: int, bound: float, subspaces: int) -> list[DataFrame]:
    """What `_join` finds, a written table for each turn."""
    spark, turn, ranges = classes.sparkSession, rotation(dim), cuts(dim, subspaces)
    n_pivots = int(min(MOST_PIVOTS, max(1, n // PER_PIVOT)))
    sample = np.array([r["v"] for r in classes.orderBy("cls").limit(n_pivots).collect()], dtype=np.float64)
    sample = (sample / np.linalg.norm(sample, axis=1, keepdims=True)) @ turn
    join = _join(dim, subspaces, bound, [sample[:, a:b] for a, b in ranges], 2)
    parts, out = max(LEAST_PARTS, -(-n // PART)), []
    for offsets in turns(parts, n):
        wide = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(2 * parts * len(offsets), 20_000))
        dealt = _dealt(classes, parts, offsets).repartition(wide, "low", "high").sortWithinPartitions("low", "high")
        out.append(settle(dealt.mapInArrow(join, "a long, b long, links long"), "vector-links"))
    return out


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of embeddings at cosine 0.9; nulls, zero vectors and repeated rows as in `near_vectors`."""
    return near_vectors(load(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id, vec_id AS o FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.o = l.a),
c AS (SELECT vec_id, min(o) AS component_id FROM r GROUP BY vec_id)
SELECT c.vec_id, count(l.b) AS n_links, any_value(component_id) AS component_id, c.vec_id = any_value(component_id) AS kept
FROM c LEFT JOIN l ON l.a = c.vec_id GROUP BY c.vec_id
"""
