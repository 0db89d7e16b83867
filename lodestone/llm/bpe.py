"""BPE encoding and decoding with a vocabulary file of the tokenizers library.

A text is cut at added tokens, then into pieces by the byte-level pattern. A piece's bytes are its first symbols. The leaves of
a segment tree hold, for each pair of adjacent symbols, the pair's merge rank and its place, so the root is the leftmost pair of
the lowest rank. A merge changes three leaves, each in logarithmic time, and merges go on until the root holds none: a piece of
n bytes takes n log n steps whatever it holds. Short pieces of a run of texts, each distinct one once, go through their trees
together, a row of an array for each tree; each worker remembers their ids.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache, partial
from itertools import compress, count, islice
from operator import is_

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load

#: Letters and digits (first and last code points) that the `regex` module knows but the tokenizers library does not,
#: which stand among "other" characters there.
YOUNG = (
    "558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7ce-a7cf a7d2-a7d2 a7d4-a7d4 a7dd-a7dd a7e2-a7e2 a7f1-a7f1 "
    "ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a-11b0a 11db0-11ddb 11de0-11de9 11df1-11df1 1246f-1246f "
    "12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 "
    "191a0-191d2 1b123-1b128 1b168-1b168 1d6a6-1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 "
    "1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e-2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
)
_NONE = 1 << 40
_ASTRAL = re.compile("[\U00010000-\U0010ffff]")
#: Pieces that a worker remembers, bytes up to which pieces share an array of trees, and the
#: pieces of a text, and unknown ones of a run of texts, that are held at once.
KNOWN, SHARED, AT_ONCE = 500_000, 64, 1 << 17


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_marks() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


@lru_cache(maxsize=1)
def _patterns() -> tuple[re.Pattern, regex.Pattern]:
    """Patterns of the pieces of byte-level pre-tokenizing, with YOUNG left out of the letters and digits: for texts of the basic plane
    and for all. The first names the classes by their ranges, for which the quicker of the two modules has a table."""
    young = [tuple(int(x, 16) for x in r.split("-")) for r in YOUNG.split()]
    text = "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in young)
    wide = {p: rf"[{p}--[{text}]]" for p in (r"\p{L}", r"\p{N}")}
    basic = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))

    def ranges(pattern: str) -> str:
        points = np.array([ord(c) for c in regex.findall(pattern, basic, regex.V1)])
        cuts = np.flatnonzero(np.diff(points) > 1)
        return "".join(rf"\u{a:04x}-\u{b:04x}" for a, b in zip(points[[0, *(cuts + 1)]].tolist(), points[[*cuts, -1]].tolist(), strict=True))

    def written(letters: str, digits: str, space: str, other: str) -> str:
        return rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letters}+| ?{digits}+| ?{other}+|{space}+(?!{other}|{letters}|{digits})|{space}+"

    letters, digits, space = (ranges(p) for p in (*wide.values(), r"\s"))
    quick = re.compile(written(f"[{letters}]", f"[{digits}]", f"[{space}]", f"[^{space}{letters}{digits}]"))
    return quick, regex.compile(written(*wide.values(), r"\s", rf"[^\s{wide[r'\p{L}']}{wide[r'\p{N}']}]"), regex.V1)


class SegmentTree:
    """The least of n values and its place, with point updates. Values are non-negative integers or None, ties go left."""

    def __init__(self, values: list[int | None]):
        n = self.n = max(1, len(values))
        self.size = size = 1 << (n - 1).bit_length()
        self.none = none = 1 << 62
        self.tree = tree = [none] * (2 * size)
        for i, v in enumerate(values):
            if v is not None:
                tree[size + i] = v * n + i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b

    def least(self) -> tuple[int, int] | None:
        """(value, place)."""
        top = self.tree[1]
        return None if top == self.none else divmod(top, self.n)

    def put(self, *changes: tuple[int, int | None]) -> None:
        """Sets the values of places, each in logarithmic time."""
        tree, size, n = self.tree, self.size, self.n
        for i, value in changes:
            at = size + i
            tree[at] = self.none if value is None else value * n + i
            at >>= 1
            while at:
                a, b = tree[2 * at], tree[2 * at + 1]
                if b < a:
                    a = b
                if tree[at] == a:
                    break
                tree[at] = a
                at >>= 1


class Codec:
    """Ids of texts and back, from the tokenizers library's file of a byte-level BPE."""

    def __init__(self, path: str):
        with open(path) as f:
            how = json.load(f)
        model, pre = how["model"], how["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not how["normalizer"]
        if not plain or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError("not a plain byte-level BPE")
        added = how["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens that take white space or words along are not known here")
        vocab = model["vocab"]
        marks = byte_marks()
        self.byte_ids = [vocab.get(m, -1) for m in marks]
        self.width = width = max([*vocab.values(), *(t["id"] for t in added)]) + 1
        pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
        self.merged = [vocab[a + b] for a, b in pairs]
        self.rank = {vocab[a] * width + vocab[b]: r for r, (a, b) in reversed(list(enumerate(pairs)))}
        byte_of = {m: b for b, m in enumerate(marks)}
        self.bytes_of = [b""] * width
        for token, i in [*vocab.items(), *((t["content"], t["id"]) for t in added)]:
            self.bytes_of[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.added = {t["content"]: t["id"] for t in added}
        self.cut = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if added else None
        keys = np.array(list(self.rank), dtype=np.int64)
        order = np.argsort(keys)
        self.sorted_keys, self.sorted_ranks = keys[order], np.array(list(self.rank.values()), dtype=np.int64)[order]
        self.merged_ids, self.first_ids = np.array(self.merged, dtype=np.int64), np.array(self.byte_ids, dtype=np.int64)
        self.pieces, self.wide = _patterns()
        self.whole = min(self.byte_ids) >= 0

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece. A byte that the vocabulary lacks has none."""
        ids = self.byte_ids
        sym = [s for b in piece if (s := ids[b]) >= 0]
        n = len(sym)
        if n < 2:
            return sym
        rank, width, merged = self.rank.get, self.width, self.merged
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = SegmentTree([rank(a * width + b) for a, b in zip(sym, sym[1:])])  # noqa: B905
        while (top := tree.least()) is not None:
            r, i = top
            j = after[i]
            k = after[i] = after[j]
            sym[i], sym[j] = merged[r], -1
            changes = [(i, rank(sym[i] * width + sym[k]) if k < n else None)]
            if k < n:
                before[k] = i
                changes.append((j, None))
            if (p := before[i]) >= 0:
                changes.append((p, rank(sym[p] * width + sym[i])))
            tree.put(*changes)
        return [s for s in sym if s >= 0]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, _NONE for those that are not merged."""
        keys = left * self.width + right
        at = np.minimum(np.searchsorted(self.sorted_keys, keys), len(self.sorted_keys) - 1)
        return np.where(self.sorted_keys[at] == keys, self.sorted_ranks[at], _NONE)

    def merge_together(self, pieces: list[bytes], leaves: int) -> list[bytes]:
        """The ids, as little-endian bytes, of pieces of 2 to leaves + 1 bytes, by trees of `leaves` leaves (a power of two, 64 at
        most) that take their steps together."""
        n, rows = np.fromiter(map(len, pieces), np.int64, len(pieces)), len(pieces)
        sym = np.full((rows, leaves + 2), -1, dtype=np.int64)
        sym[np.arange(leaves + 2) < n[:, None]] = self.first_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        places = np.arange(leaves + 2)
        after, before = np.tile(places + 1, (rows, 1)), np.tile(places - 1, (rows, 1))
        tree = np.full((rows, 2 * leaves), _NONE * 64, dtype=np.int64)
        tree[:, leaves:] = np.where(sym[:, 1 : leaves + 1] >= 0, self.ranks(sym[:, :leaves], sym[:, 1 : leaves + 1]), _NONE) * 64 + places[:leaves]
        for i in range(leaves - 1, 0, -1):
            np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1], out=tree[:, i])
        live = np.arange(rows)
        while len(live := live[tree[live, 1] < _NONE * 64]):
            r, i = tree[live, 1] >> 6, tree[live, 1] & 63
            j = after[live, i]
            k = after[live, j]
            made = self.merged_ids[r]
            sym[live, i], sym[live, j], after[live, i] = made, -1, k
            more, p = k < n[live], before[live, i]
            left = p >= 0
            before[live[more], k[more]] = i[more]
            follows = np.full(len(live), _NONE, dtype=np.int64)
            follows[more] = self.ranks(made[more], sym[live[more], k[more]])
            at = np.concatenate([live, live[more], live[left]])
            leaf = np.concatenate([i, j[more], p[left]])
            value = np.concatenate([follows, np.full(more.sum(), _NONE, dtype=np.int64), self.ranks(sym[live[left], p[left]], made[left])])
            node = leaf + leaves
            tree[at, node] = value * 64 + leaf
            while (node := node >> 1)[0]:
                tree[at, node] = np.minimum(tree[at, 2 * node], tree[at, 2 * node + 1])
        stays = sym >= 0
        data, ends = sym[stays].astype("<u4").tobytes(), np.concatenate([[0], 4 * np.cumsum(stays.sum(axis=1))]).tolist()
        return [data[a:b] for a, b in zip(ends, ends[1:])]  # noqa: B905

    def ids(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of each piece as little-endian bytes."""
        out, together = {}, {}
        for piece in pieces:
            raw = piece.encode()
            if 1 < len(raw) <= SHARED and self.whole:
                together.setdefault(max(1, 1 << (len(raw) - 2).bit_length()), []).append((piece, raw))
            else:
                out[piece] = np.array(self.merge(raw), dtype="<u4").tobytes()
        for leaves, some in together.items():
            out.update(zip((p for p, _ in some), self.merge_together([r for _, r in some], leaves), strict=True))
        return out

    def parts(self, text: str):
        """Lists of a text's pieces, AT_ONCE of them at most, and the ids of added tokens between them."""
        at = 0
        for m in [*(self.cut.finditer(text) if self.cut else ()), None]:
            own = text[at : m.start() if m else None] if at or m else text
            find = self.pieces if own.isascii() or not _ASTRAL.search(own) else self.wide
            if len(own) <= AT_ONCE:
                yield find.findall(own)
            else:
                found = (x.group() for x in find.finditer(own))
                while some := list(islice(found, AT_ONCE)):
                    yield some
            if m:
                yield self.added[m.group()]
                at = m.end()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


@lru_cache(maxsize=2)
def encoder(path: str):
    """texts -> the ids of each as little-endian unsigned 32-bit integers in bytes."""
    own, known = codec(path), {}

    def encode(texts: list[str]) -> list[bytes]:
        out: list[list[bytes | None]] = [[] for _ in texts]
        lacking: list[tuple[list, int, str]] = []  # where an id is still to be put
        fresh: set[str] = set()
        if len(known) > KNOWN:
            known.clear()

        def turn_in() -> None:
            known.update(own.ids(list(fresh)))
            for ids, k, piece in lacking:
                ids[k] = known[piece]
            lacking.clear()
            fresh.clear()

        for ids, text in zip(out, texts, strict=True):
            for part in own.parts(text):
                if not isinstance(part, list):
                    ids.append(part.to_bytes(4, "little"))
                    continue
                begin = len(ids)
                ids += map(known.get, part)
                for k in compress(count(begin), map(partial(is_, None), islice(ids, begin, None))):
                    lacking.append((ids, k, part[k - begin]))
                    fresh.add(part[k - begin])
                if len(lacking) >= AT_ONCE:
                    turn_in()
        turn_in()
        return [b"".join(x) for x in out]

    return encode


def decoder(path: str):
    """ids in bytes -> text; bytes that are no UTF-8 become U+FFFD, ids that the vocabulary lacks are passed over."""
    own = codec(path)
    of, width = own.bytes_of.__getitem__, own.width

    def decode(ids: bytes) -> str:
        some = np.frombuffer(ids, dtype="<u4")
        return b"".join(map(of, some[some < width].tolist())).decode("utf-8", "replace")

    return decode


def encode(docs: DataFrame, path: str | None = None, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with `out`, the ids of each whole text as little-endian unsigned 32-bit integers (binary), in place of `text`.

    A null text is an empty one and has no ids; bytes that are no UTF-8 are read as U+FFFD. Names of added tokens in a text are
    those tokens. Other columns, null or not, are handed through, but one called `out` is replaced; repeated rows stay; an
    empty table stays empty.
    """
    path = path or default_path()
    others = [c for c in docs.columns if c not in (text, out)]

    def run(batches):
        of = encoder(path)
        for batch in batches:
            for a in range(0, max(1, batch.num_rows), 1024):
                some = batch.slice(a, 1024)
                ids = of([t.decode("utf-8", "replace") if t else "" for t in some.column(len(others)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(ids, pa.large_binary())], names=[*others, out])

    given = docs.select(*(F.col(f"`{c}`") for c in others), F.col(text).cast("string").cast("binary").alias(text))
    kept = docs.select(*(F.col(f"`{c}`") for c in others)).withColumn(out, F.lit(None).cast("binary"))
    return given.mapInArrow(run, kept.schema)


def decode(rows: DataFrame, path: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with `out`, the text of `ids` (binary as `encode` gives it; null: empty), added tokens by their names, and all columns
    but one called `out`. Ids unknown to the vocabulary are passed over."""
    path = path or default_path()
    others = [c for c in rows.columns if c not in (ids, out)]

    def run(batches):
        of = decoder(path)
        for batch in batches:
            for a in range(0, max(1, batch.num_rows), 256):
                some = batch.slice(a, 256)
                texts = [of(x) if x else "" for x in some.column(len(others)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(texts, pa.large_string())], names=[*others, ids, out])

    given = rows.select(*(F.col(f"`{c}`") for c in [*others, ids]))
    return given.mapInArrow(run, given.withColumn(out, F.lit(None).cast("string")).schema)


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document's ids and the text they decode to, as a count and digests. A null or empty text has no tokens;
    repeated rows have a row each, an empty table none; only doc_id and text are read."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    out = decode(encode(docs))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
