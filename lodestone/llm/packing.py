"""Packing tokenised documents into fixed-length sequences by cutting-stock column generation.

A document's ids are cut into full pieces of the sequence length and one shorter rest, so pieces follow from the document
alone and only (doc_id, start, length, checksum) rows travel. The histogram of piece lengths, in classes of `unit` tokens
rounded up (256 classes at most for the defaults), goes to the driver, which solves the cutting-stock linear program: a
revised simplex over patterns of class counts, whose entering pattern is priced by a knapsack dynamic program over the dual
values. The patterns' counts are rounded down and what is left over is packed best-fit decreasing. Each class's pieces are
ranked, each pattern owns an interval of each class's ranks, and a piece finds its sequence from its rank by arithmetic.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from functools import lru_cache
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import load, numbered, settle, text_of

SEQUENCE = 2048
UNIT = 8
END_ID = 1
#: Where the tokenizer cuts whatever stands around: before a space or line end between characters that are no white space, and
#: inside what lies between those, where a letter meets ASCII punctuation (an apostrophe may belong to the letters after it).
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_LETTER = "[A-Za-zÀ-ÖØ-öø-ÿ]"
_ATOMS = [rf"({_LETTER})([!-/:-@\[-`{{-~])", rf"([!-&(-/:-@\[-`{{-~])({_LETTER})"]
#: Atoms that a worker remembers at least before it stops taking more, the longest that is remembered, those given to the
#: tokenizer in a run, and the bytes of text (one document at least) whose ids are held at once.
CHUNKS, LONGEST, RUN, AT_ONCE = 800_000, 40, 4096, 1 << 23


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _spread(flat: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs that lie in `flat` one behind the other, in the order `at`, and the length of each."""
    n = lengths[at]
    return flat[np.arange(n.sum()) + np.repeat((np.cumsum(lengths) - lengths)[at] - (np.cumsum(n) - n), n)], n


@lru_cache(maxsize=4)
def batch_encoder(path: str):
    """texts (an Arrow array without nulls) -> the ids of each, those of the tokenizer in the file without special tokens added.

    Texts are cut into chunks before single spaces and line ends and chunks into atoms where letters meet punctuation.
    Byte-level pre-tokenizing cuts there too, so the ids of the atoms are those of the text. Each distinct chunk and atom of a
    call is handled once, and each worker remembers atoms up to LONGEST characters, the first CHUNKS or so. Texts that hold
    the marks used here or an added token's name are given whole to the tokenizer, and so are all if it does not cut so.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    with open(path) as f:
        how = json.load(f)
    pre, added = how["pre_tokenizer"] or {}, how["added_tokens"]
    cuts = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not how["normalizer"]
    cuts = cuts and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
    begins, mark = "\0", "\1"
    names = [begins, mark, *(t["content"] for t in added)]
    known: dict[str, bytes] = {}

    def run(given: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, dtype="<u4") for e in tokenizer.encode_batch_fast(given, add_special_tokens=False)]

    def atom_ids(atoms: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out = list(map(known.get, atoms))
        fresh = [a for a, x in zip(atoms, out, strict=True) if x is None]
        if fresh:
            given = {}
            for i in range(0, len(fresh), RUN):  # what the tokenizer returns of an atom is far larger than its ids
                got = [e.ids for e in tokenizer.encode_batch_fast(fresh[i : i + RUN], add_special_tokens=False)]
                data, ends = np.fromiter(chain.from_iterable(got), "<u4").tobytes(), [0, *accumulate(4 * len(g) for g in got)]
                given.update(zip(fresh[i : i + RUN], [data[a:b] for a, b in pairwise(ends)], strict=True))
            out = [given[a] if x is None else x for a, x in zip(atoms, out, strict=True)]
            if len(known) < CHUNKS:
                known.update((a, x) for a, x in given.items() if len(a) < LONGEST)
        return np.frombuffer(b"".join(out), "<u4"), np.fromiter(map(len, out), np.int64, len(out)) // 4

    def text_ids(chunks: pa.Array, at: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
        """Of texts whose chunks are those `at`, a text's from its `begin`."""
        for pattern in _ATOMS:
            chunks = pc.replace_substring_regex(chunks, pattern, rf"\1{mark}\2")
        lists = pc.split_pattern(chunks, mark)
        coded = lists.flatten().dictionary_encode()
        flat, n = _spread(*atom_ids(coded.dictionary.to_pylist()), coded.indices.to_numpy())
        flat, n = _spread(flat, np.add.reduceat(n, lists.offsets.to_numpy()[:-1]), at)
        return np.split(flat, np.cumsum(np.add.reduceat(n, begin))[:-1])

    def plain(texts: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
        """Whether white space stands beside each text's cuts, where it may belong to either side; the ids of those without."""
        lists = pc.split_pattern(pc.binary_join_element_wise("", pc.replace_substring(texts, "\n", " \n"), begins), " ")
        coded, begin = lists.flatten().dictionary_encode(), lists.offsets.to_numpy()[:-1]
        at, split = coded.indices.to_numpy(), coded.dictionary
        first = pc.starts_with(split, begins)
        chunks = pc.if_else(first, pc.replace_substring(split, begins, ""), pc.if_else(pc.starts_with(split, "\n"), split, pc.binary_join_element_wise("", split, " ")))
        space = lambda *of: pc.utf8_is_space(pc.utf8_slice_codeunits(chunks, *of))
        odd = pc.or_(pc.or_(pc.equal(chunks, ""), space(-1)), pc.or_(space(1, 2), pc.and_(first, space(0, 1))))
        beside = np.logical_or.reduceat(odd.to_numpy(zero_copy_only=False)[at], begin)
        n = np.diff(np.append(begin, len(at)))
        if beside.all():
            return beside, []
        at, n = at[np.repeat(~beside, n)], n[~beside]
        used = np.zeros(len(chunks), dtype=bool)
        used[at] = True
        return beside, text_ids(chunks.filter(pa.array(used)), (np.cumsum(used) - 1)[at], np.cumsum(n) - n)

    def encode(texts: pa.Array) -> list[np.ndarray]:
        if not cuts:
            return run(texts.to_pylist())
        out: list[np.ndarray] = [np.empty(0, "<u4")] * len(texts)

        def put(places: np.ndarray, ids: list[np.ndarray]) -> None:
            for i, x in zip(places.tolist(), ids, strict=True):
                out[i] = x

        whole = np.logical_or.reduce([pc.match_substring(texts, x).to_numpy(zero_copy_only=False) for x in names])
        put(np.flatnonzero(whole), run(texts.filter(pa.array(whole)).to_pylist()))
        rest = np.flatnonzero(~whole)
        if len(rest):
            texts = texts.take(pa.array(rest))
            beside, ids = plain(texts)
            put(rest[~beside], ids)
            if beside.any():
                lists = pa.array([_CUT.split(t) for t in texts.filter(pa.array(beside)).to_pylist()], pa.list_(pa.string()))
                coded = lists.flatten().dictionary_encode()
                put(rest[beside], text_ids(coded.dictionary, coded.indices.to_numpy(), lists.offsets.to_numpy()[:-1]))
        return out

    return encode


@lru_cache(maxsize=4)
def encoder(path: str):
    """text -> its ids as little-endian bytes, by `batch_encoder`."""
    encode = batch_encoder.__wrapped__(path)
    return lambda text: encode(pa.array([text], pa.string()))[0].tobytes()


def _slices(batch: pa.RecordBatch):
    """Runs of rows whose texts have AT_ONCE bytes or a little more, a longer text in a run of its own or at the end of one."""
    sizes, begin, held = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False), 0, 0
    for i, size in enumerate(sizes.tolist()):
        held += size
        if held >= AT_ONCE:
            yield batch.slice(begin, i + 1 - begin)
            begin, held = i + 1, 0
    if begin < len(sizes):
        yield batch.slice(begin)


def pieces(docs: DataFrame, path: str, sequence: int = SEQUENCE) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: a row for each piece of each document."""

    def cut(batches):
        encode, end = batch_encoder(path), np.array([END_ID], dtype="<u4")
        for batch in batches:
            for some in _slices(batch):
                out = ([], [], [], [], [])
                for doc_id, ids in zip(some.column(0).to_pylist(), encode(some.column(1)), strict=True):
                    tokens = np.append(ids, end)
                    for at in range(0, len(tokens), sequence):
                        part = tokens[at : at + sequence]
                        for to, value in zip(out, (doc_id, at, len(part), zlib.crc32(part.tobytes()), len(tokens)), strict=True):
                            to.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return narrow.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def knapsack(values: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most value of items of sizes 1, 2, ... (any number of each) in `room`, and the count of each item."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    n = len(values)
    for c in range(1, room + 1):
        k = min(c, n)
        options = values[:k] + best[c - 1 :: -1][:k]  # item i leaves room c - 1 - i
        i = int(options.argmax())
        if options[i] > best[c - 1]:
            best[c], pick[c] = options[i], i
        else:
            best[c] = best[c - 1]
    counts, c = np.zeros(n, dtype=np.int64), room
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            counts[pick[c]] += 1
            c -= pick[c] + 1
    return float(best[room]), counts


def column_generation(demand: np.ndarray, room: int, most_rounds: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, amounts) of a linear program's solution that meets demand[i] items of size i + 1 in bins of `room`.

    Starts from one pattern for each size. A round prices patterns by a knapsack over the duals and pivots the best one in;
    it ends when none is worth more than one bin, or after most_rounds (the solution then is feasible but not optimal).
    """
    sizes = np.flatnonzero(demand > 0)
    m = len(sizes)
    basis = np.diag(room // (sizes + 1)).astype(float)  # a column for each basic pattern
    inverse = np.diag(1.0 / np.diag(basis))
    amounts = inverse @ demand[sizes]
    values = np.zeros(len(demand))
    for turn in range(most_rounds):
        values[:] = 0
        values[sizes] = inverse.sum(axis=0)
        worth, counts = knapsack(values, room)
        if worth <= 1 + 1e-7:
            break
        entering = counts[sizes].astype(float)
        step = inverse @ entering
        able = step > 1e-9
        if not able.any():
            break
        ratio = np.where(able, amounts / np.where(able, step, 1), np.inf)
        out = int(ratio.argmin())
        amounts = amounts - ratio[out] * step
        amounts[out] = ratio[out]
        basis[:, out] = entering
        inverse[out] /= step[out]
        others = step.copy()
        others[out] = 0
        inverse -= np.outer(others, inverse[out])
        if turn % 200 == 199:  # rounding errors
            inverse = np.linalg.inv(basis)
            amounts = inverse @ demand[sizes]
    patterns = np.zeros((m, len(demand)), dtype=np.int64)
    patterns[:, sizes] = np.rint(basis.T).astype(np.int64)
    return patterns, np.maximum(amounts, 0)


def plan(demand: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """(pattern, times): whole patterns of class counts that hold exactly the demand."""
    left, out = demand.astype(np.int64).copy(), []
    if not left.any():
        return out
    for pattern, amount in zip(*column_generation(left, room), strict=True):
        times = int(amount + 1e-6)
        used = np.flatnonzero(pattern)
        times = min([times, *(left[used] // pattern[used])]) if len(used) else 0
        if times > 0:
            out.append((pattern, int(times)))
            left -= pattern * times
    while left.any():  # what rounding leaves: best-fit decreasing, run by run of equal bins
        pattern, space = np.zeros_like(left), room
        for i in np.flatnonzero(left)[::-1]:
            n = min(int(left[i]), space // (int(i) + 1))
            pattern[i] += n
            space -= n * (int(i) + 1)
        used = np.flatnonzero(pattern)
        times = int(min(left[used] // pattern[used]))
        out.append((pattern, times))
        left -= pattern * times
    return out


def intervals(patterns: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int]]:
    """(class, first rank, rank after the last, first sequence, pieces of the class in a sequence)."""
    out, sequence = [], 0
    taken: dict[int, int] = {}
    for pattern, times in patterns:
        for i in np.flatnonzero(pattern).tolist():
            n = int(pattern[i])
            first = taken.get(i, 0)
            out.append((i + 1, first, first + n * times, sequence, n))
            taken[i] = first + n * times
        sequence += times
    return out


def pack(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, unit: int = UNIT) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the closing id alone. Repeated rows are packed as often as they occur; an empty table gives an
    empty result. Only doc_id and text are read. Equal lengths are told apart by a hash of doc_id, start and checksum.
    """
    cut = settle(pieces(docs, path or default_path(), sequence), "pieces")
    cut = cut.withColumn("class", F.ceil(F.col("length") / unit).cast("int"))
    room = sequence // unit
    demand = np.zeros(room, dtype=np.int64)
    for r in cut.groupBy("class").count().collect():  # room rows at most
        demand[r["class"] - 1] = r["count"]
    rows = intervals(plan(demand, room))
    schema = T.StructType([T.StructField(n, T.IntegerType() if n in ("class", "per") else T.LongType()) for n in ("class", "low", "high", "base", "per")])
    where = docs.sparkSession.createDataFrame(rows, schema)
    ranked = numbered(cut, ["class"], [F.col("doc_id"), F.col("start"), F.col("ids_crc32")], int(demand.sum()), "rank")
    placed = ranked.join(F.broadcast(where), "class").where("rank >= low and rank < high")  # a bounded number of patterns' intervals
    placed = placed.withColumn("sequence_id", F.expr("base + (rank - low) div per"))
    before = W.partitionBy("sequence_id").orderBy(F.desc("class"), "rank").rowsBetween(W.unboundedPreceding, -1)
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"),
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, sequences of 2048 tokens; nulls, empty and long texts, ties and repeated rows as in `pack`."""
    return pack(load(spark, sf_dir, "documents"))
