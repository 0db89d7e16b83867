"""MinHash near-dedup with sequential Bayesian verification.

A document's set holds its distinct word shingles. Documents with equal sets are one class, and only classes are compared.
Signatures of `BANDS * ROWS` minima are cut into bands; classes with an equal band are candidates. Candidates are compared
batch by batch of their signatures: a pair is dropped once the posterior probability that its similarity reaches the bound
(uniform prior, so a binomial tail) is below `MISS`. Every pair that is left is verified on the full sets.

Buckets are never expanded into all pairs at once. Star rounds compare each member with one of its buckets' pivots, which
another hash chooses each round, and merge what verifies; the second also tests the pair of every bucket of two. Buckets that still hold members of several components then go through
blocks of bounded size. In a block the pairs across components are pruned in place, members with a likely partner are sent
again with their sets, and their pairs are verified in place: what is written is a forest of links, never the pairs, and no
link that the bands and the posterior let through is lost to the components.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Spread, components, load, release, settle
from .hashing import blocks, buffers, scramble, shingles, words

WORDS = 5
BOUND = 80  # per cent
BANDS, ROWS = 26, 5
BATCH = 10
MISS = 1e-6
BLOCK = 1000
STARS = 2
_U = np.uint64


@lru_cache(maxsize=1)
def _multipliers() -> np.ndarray:
    return scramble(np.arange(1, 2 * BANDS * ROWS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)).reshape(2, -1) | _U(1)


def signatures(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """n x (BANDS * ROWS) minima of 32-bit hashes of each row's shingles; h sorted by row. Rows without shingles: all ones."""
    out = np.full((n, BANDS * ROWS), 0xFFFFFFFF, dtype=np.uint32)
    if len(h):
        start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        held = row[start]
        a, b = _multipliers()
        t = np.empty_like(h)
        for i in range(BANDS * ROWS):
            np.multiply(h, a[i], out=t)
            np.add(t, b[i], out=t)
            out[held, i] = np.minimum.reduceat(t, start) >> _U(32)
    return out


def set_keys(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit key of each row's set of hashes, whatever their order; 0 for none."""
    out = np.zeros(n, dtype=_U)
    if len(h):
        start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        size = np.diff(np.append(start, len(h))).astype(_U)
        out[row[start]] = scramble(np.add.reduceat(scramble(h ^ _U(0x5851F42D4C957F2D)), start) ^ scramble(np.bitwise_xor.reduceat(h, start) + size))
    return out


def _sketch(k: int):
    def run(batches):
        for batch in batches:
            raw, offsets = buffers(batch.column(1))
            for a, b in blocks(offsets):
                n = b - a
                h, row = shingles(*words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), n, k)
                size, keys, sig = np.bincount(row, minlength=n), set_keys(h, row, n).view(np.int64), signatures(h, row, n)
                bands = np.zeros((n, BANDS), dtype=_U)
                for r in range(ROWS):
                    bands = scramble(bands ^ sig[:, r::ROWS].astype(_U) + np.arange(BANDS, dtype=_U)[None, :] * _U(0x9E3779B97F4A7C15))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(bands.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(2)[a:b], pa.array(size), pa.array(keys), pa.array([s.tobytes() for s in sig], pa.binary()), lists], names=["doc_id", "digest", "n", "cls", "sig", "bands"])

    return run


@lru_cache(maxsize=4)
def least_matches(bound: int) -> np.ndarray:
    """For 1, 2, ... batches: matches below which similarity >= bound per cent has a posterior under MISS."""
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        t, total, m = bound / 100, 0.0, 0
        while (total := total + comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)) < MISS:  # P(Beta(m + 1, n - m + 1) >= t)
            m += 1
        out.append(m)
    return np.array(out)


def likely(a: np.ndarray, b: np.ndarray, bound: int) -> np.ndarray:
    """Which of the pairs of signature rows stay after every batch."""
    alive, matched = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
    for i, least in enumerate(least_matches(bound)):
        at = slice(i * BATCH, (i + 1) * BATCH)
        matched = matched + (a[alive, at] == b[alive, at]).sum(axis=1)
        stays = matched >= least
        alive, matched = alive[stays], matched[stays]
    out = np.zeros(len(a), dtype=bool)
    out[alive] = True
    return out


def _signature_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, BANDS * ROWS)


def _keep_likely(bound: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                stays = pa.array(likely(_signature_rows(batch.column(2)), _signature_rows(batch.column(3)), bound))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(stays), batch.column(1).filter(stays)], names=["a", "b"])

    return run


def _sets(k: int):
    def run(batches):
        for batch in batches:
            raw, offsets = buffers(batch.column(1))
            for a, b in blocks(offsets):
                n = b - a
                h, row = shingles(*words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), n, k)
                same = set_keys(h, row, n).view(np.int64) == np.asarray(batch.column(0)[a:b])  # another text of the same doc_id
                cut = np.searchsorted(row, np.arange(n + 1))
                held = np.flatnonzero(same)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b].take(pa.array(held)), pa.array([h[cut[i] : cut[i + 1]].tobytes() for i in held], pa.binary())], names=["cls", "hashes"])

    return run


def _verify(bound: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                u, v = np.frombuffer(x.as_py(), _U), np.frombuffer(y.as_py(), _U)
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(100 * both >= bound * (len(u) + len(v) - both))
            stays = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(stays), batch.column(1).filter(stays)], names=["a", "b"])

    return run


def _groups(batches, keys: int):
    """Tables of rows with equal first `keys` columns, from batches sorted by them."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        ids = [np.asarray(table.column(i)) for i in range(keys)]
        new = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in ids])) + 1
        cuts = [0, *new.tolist()]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield table.slice(a, b - a)
        rest = table.slice(cuts[-1])
    if rest is not None:
        yield rest


def _others(i: int, part: np.ndarray, low: int, high: int) -> np.ndarray:
    """Rows that row i of a block still has to meet: later ones of its part, or the other part's."""
    if low == high:
        return np.arange(i + 1, len(part))
    return np.flatnonzero(part != low) if part[i] == low else np.zeros(0, np.int64)


def _partners(bound: int):
    """(key, cls) of a block's members that have a likely partner with another label."""

    def run(batches):
        for group in _groups(batches, 3):
            low, high = group.column(1)[0].as_py(), group.column(2)[0].as_py()
            label, part = np.asarray(group.column(4)), np.asarray(group.column(5))
            sig, found = _signature_rows(group.column(6).combine_chunks()), np.zeros(len(label), dtype=bool)
            for i in range(len(label)):
                other = _others(i, part, low, high)
                other = other[(label[other] != label[i]) & ~(found[i] & found[other])]
                if len(other):
                    near = other[likely(np.broadcast_to(sig[i], (len(other), sig.shape[1])), sig[other], bound)]
                    found[near] = True
                    found[i] |= len(near) > 0
            if found.any():
                mask = pa.array(found)
                yield pa.RecordBatch.from_arrays([group.column(0).combine_chunks().filter(mask), group.column(3).combine_chunks().filter(mask)], names=["key", "cls"])

    return run


def _linked(bound: int):
    """A forest of the links across labels in each block, verified on full sets."""

    def run(batches):
        for group in _groups(batches, 3):
            low, high = group.column(1)[0].as_py(), group.column(2)[0].as_py()
            cls, label, part = (np.asarray(group.column(i)) for i in (3, 4, 5))
            each = [np.frombuffer(x.as_py(), _U) for x in group.column(6).combine_chunks()]
            size = np.array([len(x) for x in each])
            start = np.cumsum(size) - size
            _, ids = np.unique(np.concatenate(each), return_inverse=True)
            held, (_, now) = np.zeros(ids.max() + 1, dtype=bool), np.unique(label, return_inverse=True)
            out = []
            for i in range(len(cls)):
                other = _others(i, part, low, high)
                other = other[(now[other] != now[i]) & (100 * np.minimum(size[other], size[i]) >= bound * np.maximum(size[other], size[i]))]
                if not len(other):
                    continue
                mine = ids[start[i] : start[i] + size[i]]
                held[mine] = True
                if 4 * size[other].sum() > len(ids):
                    both = np.add.reduceat(held[ids], start, dtype=np.int64)[other]
                else:
                    both = np.array([np.count_nonzero(held[ids[start[j] : start[j] + size[j]]]) for j in other.tolist()])
                held[mine] = False
                for j in other[100 * both >= bound * (size[i] + size[other] - both)].tolist():
                    if now[i] != now[j]:
                        out.append((int(cls[i]), int(cls[j])))
                        now[now == now[j]] = now[i]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    return run


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


class _Search:
    def __init__(self, docs: DataFrame, k: int, bound: int):
        self.k, self.bound = k, bound
        narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
        self.docs = narrow
        narrow = narrow.withColumn("digest", F.unhex(F.md5("text")))
        kind = narrow.schema["doc_id"].dataType.simpleString()
        self.rows = settle(narrow.mapInArrow(_sketch(k), f"doc_id {kind}, digest binary, n long, cls long, sig binary, bands array<bigint>"), "sketch")
        sized = self.rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.when(F.min("doc_id").isNull(), F.min("digest")).alias("rep_digest"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
        self.classes = settle(sized, "classes")
        keyed = self.classes.select("cls", "n", F.posexplode("bands").alias("band", "h")).select(F.xxhash64("band", "h").alias("key"), "cls", "n")
        shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("held"), F.sum("n").alias("weight")).where("held > 1")
        shared = settle(shared, "shared")
        self.spread = Spread(shared, "cls")
        self.members = settle(self.spread.join(keyed, shared), "buckets")  # key, cls, n, held, weight
        release(shared)
        self.links: DataFrame | None = None
        self.labels: DataFrame | None = None

    def unresolved(self, least: int) -> DataFrame:
        """Members, with label, of buckets of `least` members or more that hold several components."""
        marked = self.members.join(self.labels, F.col("cls") == F.col("id"), "left").select("key", "cls", "n", "held", "weight", F.coalesce("component", "cls").alias("label"))
        open_ = marked.where(f"held >= {least}").groupBy("key").agg(F.min("label").alias("p"), F.max("label").alias("q")).where("p <> q").select("key")
        return self.spread.join(marked, open_, "left_semi")

    def star(self, members: DataFrame, turn: int) -> DataFrame:
        """Pairs of buckets' pivots with members of other components whose sizes allow the bound: one a member, whatever its
        buckets, and from turn 1 on the pair of every bucket of two."""
        near = F.struct(F.xxhash64(F.lit(turn), "cls").alias("o"), F.col("cls").alias("pivot"), F.col("n").alias("pn"), F.col("label").alias("pl"))
        pivots = members.groupBy("key").agg(F.min(near).alias("p")).select("key", "p.*")
        pairs = self.spread.join(members, pivots).where(f"label <> pl and 100 * least(n, pn) >= {self.bound} * greatest(n, pn)")
        alone = F.when(F.col("held") == 2, F.col("key")) if turn else F.lit(None).cast("long")
        pairs = pairs.groupBy("cls", alone.alias("alone")).agg(F.min(F.struct("o", "pivot")).alias("p"))
        pairs = _ordered(pairs.select(F.col("p.pivot").alias("a"), F.col("cls").alias("b")))
        sig = self.classes.select("cls", "sig")
        both = pairs.join(sig.select(F.col("cls").alias("b"), F.col("sig").alias("t")), "b").join(sig.select(F.col("cls").alias("a"), F.col("sig").alias("s")), "a")
        return both.select("a", "b", "s", "t").mapInArrow(_keep_likely(self.bound), "a long, b long")

    def blocks(self, members: DataFrame) -> DataFrame:
        """Links across components in the buckets of `members`, all of them that matter to the components."""
        parts = F.expr(f"cast(ceil(greatest(held / {BLOCK}D, weight / {BLOCK * 500}D)) AS int)")
        dealt = members.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("cls"), "parts").cast("int"))

        def blocked(rows: DataFrame, payload: str) -> DataFrame:
            rows = rows.withColumn("d", F.explode(F.expr("sequence(0, parts - 1)")))
            rows = rows.select("key", F.least("part", "d").alias("lo"), F.greatest("part", "d").alias("hi"), "cls", "label", "part", payload)
            return rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

        likely_ = blocked(dealt.join(self.classes.select("cls", "sig"), "cls"), "sig").mapInArrow(_partners(self.bound), "key long, cls long")
        likely_ = settle(likely_.distinct(), "partners")
        sets = self.sets(likely_.select("cls").distinct())
        rows = dealt.join(likely_, ["key", "cls"]).join(sets, "cls")
        return _ordered(blocked(rows, "hashes").mapInArrow(_linked(self.bound), "a long, b long"))

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(cls, hashes) of the wanted classes, from the text of their least doc_id; rows without ids are known by their texts' digests."""
        wanted = wanted.join(self.classes.select("cls", "rep", "rep_digest"), "cls")
        own = self.docs.withColumn("own_digest", F.when(F.col("doc_id").isNull(), F.unhex(F.md5("text"))))
        sets = own.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")) & F.col("own_digest").eqNullSafe(F.col("rep_digest"))).select("cls", "text").mapInArrow(_sets(self.k), "cls long, hashes binary").dropDuplicates(["cls"])
        return settle(sets, "sets")

    def verified(self, pairs: DataFrame) -> DataFrame:
        pairs = settle(pairs, "pairs")
        sets = self.sets(pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct())
        both = pairs.join(sets.select(F.col("cls").alias("b"), F.col("hashes").alias("y")), "b").join(sets.select(F.col("cls").alias("a"), F.col("hashes").alias("x")), "a")
        return both.select("a", "b", "x", "y").mapInArrow(_verify(self.bound), "a long, b long")

    def add(self, found: DataFrame) -> None:
        spent = [self.links, self.labels]
        self.links = settle(found if self.links is None else self.links.unionByName(found), "links")
        self.labels = components(self.links)
        release(*spent)

    def run(self) -> DataFrame:
        """(id, component) of linked classes."""
        self.add(self.verified(self.star(self.members.withColumn("label", F.col("cls")), 0)))
        least = 2
        for step in [*range(1, STARS), "blocks"]:
            left = settle(self.unresolved(least), "unresolved")
            if left.isEmpty():
                break
            self.add(self.blocks(left) if step == "blocks" else self.verified(self.star(left, step)))
            release(left)
            least = 3  # the pairs of all buckets of two are tested
        return self.labels


def near_duplicates(docs: DataFrame, k: int = WORDS, bound: int = BOUND) -> DataFrame:
    """A row per row of docs: doc_id, n_shingles, component_id, kept.

    Words are runs of characters other than ASCII white space, A-Z lower-cased; a text of fewer than k words is one shingle, a
    null or wordless one has none and is linked with nothing. A row without a doc_id takes part; a component without any has a
    null component_id and its rows are kept. Documents are linked when 100 * intersection >= bound * union of
    their sets; component_id is the smallest doc_id reachable, kept tells whether it is the document's own. Repeated rows are
    linked with each other and stay; an empty table gives an empty result; columns besides doc_id and text are not read.
    """
    out = _found(docs, k, bound)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _found(docs: DataFrame, k: int, bound: int) -> DataFrame:
    """A row per row of docs: doc_id, digest (of the text), n, component (null without words) and component_id."""
    search = _Search(docs, k, bound)
    labels = search.run()
    named = search.classes.select("cls", "rep").join(labels, F.col("cls") == F.col("id"), "left").select("cls", "rep", F.coalesce("component", "cls").alias("component"))
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(smallest, "component").select("cls", "component", "component_id")
    out = search.rows.select("doc_id", "digest", "n", F.when(F.col("n") > 0, F.col("cls")).alias("cls")).join(named, "cls", "left")
    return out.select("doc_id", "digest", "n", "component", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def dedup(docs: DataFrame, k: int = WORDS, bound: int = BOUND) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the smallest doc_id, of equal ids that of the smallest text
    digest; a group without ids keeps its smallest digest. Of equal rows (by doc_id and text) of a group one stays, whichever.
    Rows without words are linked with nothing and all stay; an empty table stays empty; other columns are handed through.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first")
    found = _found(docs, k, bound).where("component is not null").groupBy("component").agg(first)
    kept = settle(found.select(F.col("first.doc_id").alias("__id"), F.col("first.digest").alias("__digest")).distinct(), "near-duplicates")
    marked = docs.withColumn("__digest_of", F.unhex(F.md5(F.col("text").cast("string"))))
    worded = F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    out = marked.where(worded).join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__digest_of") == F.col("__digest")), "left_semi")
    twice = out.groupBy("doc_id", "__digest_of").count().where("count > 1")
    if not twice.isEmpty():
        out = out.dropDuplicates(["doc_id", "__digest_of"])
    return out.unionByName(marked.where(~worded)).select(*docs.columns)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word shingles at 80 per cent."""
    return near_duplicates(load(spark, sf_dir, "documents"), 4)


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS inter FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * inter >= 80 * (na + nb - inter)),
r AS (SELECT doc_id, doc_id AS o FROM s UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.o = l.a),
c AS (SELECT doc_id, min(o) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""
