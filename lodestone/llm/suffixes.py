"""Suffix-array dedup: removes every byte covered by a string of `LENGTH` bytes that occurs more than once in the corpus.

Which strings meet. Every window of LENGTH bytes is assigned to an anchor: the place of the least hash among its substrings of
`GRAM` bytes, the leftmost of equals. Equal windows have anchors of equal content at equal offsets. Consecutive windows with the
same anchor are one segment, on average one for some 65 bytes of text, and travel as hashes of anchor and segment, text
key and position. A segment that occurs twice is removed whole. Different segments of one anchor may still share windows.

Suffix sorting. Their bytes are fetched, the suffixes that start at the anchors (and, reversed, the prefixes that end there)
are sorted deep-shallow: a multikey quicksort, eight bytes a character and all groups of a level at once, to `SHALLOW` bytes,
then a blind trie for each group of longer common prefix. The longest common prefixes of neighbours in both orders give, for
each offset, the classes of equal left and equal right parts; a window occurs twice if another has both its classes.

Skew. Equal segments within a batch are counted in place and sent once. An anchor with many different segments (a short
passage that many documents share) is split: its segments are cut into runs of `STEP` windows, grouped by the bytes that all
windows of the run hold; runs that still meet too many others are cut into single windows, which need no comparison.

Texts are known by a 64-bit hash of their bytes, as are anchors and segments; equal hashes count as equal content.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, release, settle, text_of
from .hashing import BASES, Ranges, blocks, buffers, scramble

LENGTH = 200
GRAM = 48
STEP = 10
SHALLOW = 64
#: Rows of a key above which it is split. Keys are known by their last 20 bits there, so 2**20 numbers are broadcast at most; a
#: key that shares these bits with a large one is split along with it, which changes no result.
MANY, SPLIT_BITS = 2048, (1 << 20) - 1
_U = np.uint64
_ROWS = "key long, s long, tk long, pos long, n int, kind int"


def _window_minimum(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def _segments(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int, level: int, hot: list[np.ndarray]):
    """(key, s, row, pos) of a level's segments; pos holds first window (48 bits), anchor - first, windows - 1 (8 bits each)."""
    none = (np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64))
    if len(raw) < length:
        return none
    ranges, starts = Ranges(raw), np.arange(len(raw) - gram + 1)
    h = ranges.of(starts, starts + gram)
    least = _window_minimum((h >> _U(32) << _U(32)) | starts.astype(_U), length - gram + 1)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    s = np.flatnonzero(row[: len(raw) - length + 1] == row[length - 1 :])
    if not len(s):
        return none
    anchor = (least[s] & _U(0xFFFFFFFF)).astype(np.int64)
    if level:
        kept = np.isin(h[anchor] & _U(SPLIT_BITS), hot[0])
        s, anchor = s[kept], anchor[kept]
    step = (anchor - s) // (STEP if level == 1 else 1 if level == 2 else length)
    if level == 2 and len(s):
        core = (anchor - s) // STEP * STEP
        kept = np.isin(_core_key(ranges, h, anchor, core, length) & _U(SPLIT_BITS), hot[1])
        s, anchor, step = s[kept], anchor[kept], step[kept]
    if not len(s):
        return none
    new = np.ones(len(s), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (s[1:] != s[:-1] + 1) | (step[1:] != step[:-1])
    first, last, at = s[new], np.append(s[np.flatnonzero(new)[1:] - 1], s[-1]), anchor[new]
    content = Ranges(raw, BASES[1]).of(first, last + length)
    key = h[at] if level == 0 else _core_key(ranges, h, at, (at - first) // STEP * STEP, length) if level == 1 else content
    pos = (first - offsets[row[first]]) << 16 | (at - first) << 8 | (last - first)
    return key, content, row[first], pos


def _core_key(ranges: Ranges, h: np.ndarray, anchor: np.ndarray, low: np.ndarray, length: int) -> np.ndarray:
    """Of the bytes that the windows low to low + STEP - 1 before the anchor all hold, with the anchor's hash and low."""
    core = ranges.of(anchor - low, anchor - low - STEP + 1 + length)
    return scramble(core ^ scramble(h[anchor] + low.astype(_U)))


def _text_keys(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(raw[a:b].tobytes(), digest_size=8).digest(), "little", signed=True) for a, b in zip(offsets, offsets[1:], strict=False)], dtype=np.int64)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """True at the first row of each run of equal rows."""
    new = np.ones(len(columns[0]), dtype=bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _scan(length: int, gram: int, level: int, hot):
    """Segments of texts, those of a batch with equal content sent once; kind 0: sent, kind 1: known to occur twice."""

    def run(batches):
        sets = [] if hot is None else hot.value
        for batch in batches:
            raw, offsets = buffers(batch.column(0))
            parts = []
            for a, b in blocks(offsets, 4096, 1 << 20):
                part, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                key, s, row, pos = _segments(part, at, length, gram, level, sets)
                if len(key):
                    tk = _text_keys(part, at)
                    parts.append((key.view(np.int64), s.view(np.int64), tk[row], pos))
            if not parts:
                continue
            key, s, tk, pos = (np.concatenate([p[i] for p in parts]) for i in range(4))
            order = np.lexsort((s, key))
            key, s, tk, pos = key[order], s[order], tk[order], pos[order]
            new = _runs(key, s)
            start = np.flatnonzero(new)
            count = np.diff(np.append(start, len(key)))
            twice = ~new & True
            out = [np.concatenate([x[start], x[twice]]) for x in (key, s, tk, pos)]
            n = np.concatenate([np.minimum(count, 2), np.full(twice.sum(), 2)]).astype(np.int32)
            kind = np.concatenate([np.zeros(len(start)), np.ones(twice.sum())]).astype(np.int32)
            if twice.any():  # of copies within the batch one row is enough
                dup = np.flatnonzero(kind == 1)
                dup = dup[np.lexsort((out[3][dup], out[2][dup]))]
                keep = np.concatenate([np.flatnonzero(kind == 0), dup[_runs(out[2][dup], out[3][dup])]])
                out, n, kind = [x[keep] for x in out], n[keep], kind[keep]
            for a in range(0, len(n), 50_000):
                c = slice(a, a + 50_000)
                yield pa.RecordBatch.from_arrays([*[pa.array(x[c]) for x in out], pa.array(n[c]), pa.array(kind[c])], names=["key", "s", "tk", "pos", "n", "kind"])

    return run


def _judge(batches):
    """From rows sorted by key and s: kind 1 for every segment that occurs twice, kind 2 for one of each of the different
    segments of a key, if one of them occurs once."""

    def judged(cols):
        key, s, tk, pos, n = cols
        run = _runs(key, s)
        start = np.flatnonzero(run)
        which = np.cumsum(run) - 1
        twice = np.add.reduceat(n, start) >= 2
        group = np.cumsum(_runs(key[start])) - 1
        different = np.bincount(group)[group] > 1
        once = np.bincount(group, weights=~twice)[group] > 0
        removed, sent = np.flatnonzero(twice[which]), start[different & once]
        rows = np.concatenate([removed, sent])
        kind = np.concatenate([np.ones(len(removed)), np.full(len(sent), 2)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array(s[rows]), pa.array(tk[rows]), pa.array(pos[rows]), pa.array(n[rows].astype(np.int32)), pa.array(kind)], names=["key", "s", "tk", "pos", "n", "kind"])

    held = None
    for batch in batches:
        cols = [np.asarray(batch.column(i)) for i in range(5)]
        held = cols if held is None else [np.concatenate([a, b]) for a, b in zip(held, cols, strict=True)]
        if not len(held[0]):
            continue
        cut = int(np.searchsorted(held[0], held[0][-1], "left"))
        if cut:
            yield judged([c[:cut] for c in held])
            held = [c[cut:] for c in held]
    if held is not None and len(held[0]):
        yield judged(held)


def _cut(length: int):
    """The bytes of segments, from rows (text, their keys and positions)."""

    def run(batches):
        for batch in batches:
            out, seen = ([], [], [], []), set()
            for tk, text, segs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                if tk in seen:
                    continue
                seen.add(tk)
                data = (text.as_py() or "").encode()
                for seg in segs:
                    first, n = seg["pos"] >> 16, seg["pos"] & 255
                    for to, value in zip(out, (seg["key"], tk, seg["pos"], data[first : first + n + length]), strict=True):
                        to.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], names=["key", "tk", "pos", "data"])

    return run


class BlindTrie:
    """Orders strings by inserting them one by one: inner nodes hold only the depth where their children differ and the byte
    that leads to each child; a descent compares nothing else, and one comparison with the leaf reached finds the place."""

    def __init__(self, strings: list[bytes], depth: int):
        self.strings, self.depth = strings, depth  # all share `depth` bytes
        self.root: list | int | None = None  # inner node: [depth, {byte: child}]; -1: the string ends there

    def _byte(self, i: int, at: int) -> int:
        s = self.strings[i]
        return s[at] if at < len(s) else -1

    def insert(self, i: int) -> None:
        if self.root is None:
            self.root = i
            return
        node = self.root
        while not isinstance(node, int):
            node = node[1].get(self._byte(i, node[0])) if self._byte(i, node[0]) in node[1] else next(iter(node[1].values()))
        s, t = self.strings[i], self.strings[node]
        lcp = _common(s, t, self.depth)
        parent, edge, node = None, None, self.root
        while not isinstance(node, int) and node[0] < lcp:
            parent, edge = node, self._byte(i, node[0])
            node = node[1][edge]
        if not isinstance(node, int) and node[0] == lcp:
            byte = self._byte(i, lcp)
            if byte not in node[1]:
                node[1][byte] = i
                return
            parent, edge, node = node, byte, node[1][byte]  # equal strings end at one place
        other = self.strings[self._leaf(node)]
        b = self._byte(i, lcp)
        c = other[lcp] if lcp < len(other) else -1
        fresh = [lcp, {b: i, c: node}] if b != c else [len(s), {-1: node, -2: i}]
        if parent is None:
            self.root = fresh
        else:
            parent[1][edge] = fresh

    def _leaf(self, node):
        while not isinstance(node, int):
            node = next(iter(node[1].values()))
        return node

    def ordered(self) -> tuple[list[int], list[int]]:
        """(order, longest common prefix of each with the one before it; the first has -1)."""
        order, lcps, todo = [], [], [(self.root, -1)]
        while todo:
            node, lcp = todo.pop()
            if isinstance(node, int):
                order.append(node)
                lcps.append(lcp)
            else:
                children = [node[1][b] for b in sorted(node[1])]
                todo.extend((c, node[0]) for c in reversed(children[1:]))
                todo.append((children[0], lcp))
        return order, lcps


def _common(s: bytes, t: bytes, at: int) -> int:
    end = min(len(s), len(t))
    if s[at:end] == t[at:end]:
        return end
    low, high = at, end  # equal up to low, not up to high
    while high - low > 1:
        middle = (low + high) // 2
        if s[low:middle] == t[low:middle]:
            low = middle
        else:
            high = middle
    return low


def deep_shallow(strings: list[bytes], groups: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp with the one before): strings sorted by group, then bytes; lcp is -1 at a group's first.

    A string that is a prefix of another comes first. Equal strings stay beside each other in any order.
    """
    n = len(strings)
    width = -(-shallow // 8) * 8
    head = np.frombuffer(b"".join(s[:width].ljust(width, b"\0") for s in strings), dtype=">u8").reshape(n, -1).astype(_U) if n else np.zeros((0, width // 8), _U)
    size = np.array([len(s) for s in strings], dtype=np.int64)
    order = np.argsort(groups, kind="stable")
    part = np.cumsum(_runs(groups[order])) - 1  # the group of equal prefixes of each place
    lcp = np.where(_runs(part), -1, 0)
    places, depth = np.arange(n), 0
    while depth < shallow and len(places):
        word, end = head[order[places], depth // 8], np.minimum(size[order[places]] - depth, 8)
        by = np.lexsort((end, word, part[places]))
        moved, word, end, of = order[places][by], word[by], end[by], part[places][by]
        order[places] = moved
        split = _runs(of, word, end)
        inner = split & ~_runs(of)
        at = np.flatnonzero(inner)
        differ = word[at] ^ word[at - 1]
        same = np.full(len(at), 8)
        held = differ > 0
        same[held] = (63 - np.floor(np.log2(differ[held].astype(np.float64))).astype(np.int64)) // 8
        lcp[places[at]] = depth + np.minimum(same, np.minimum(end[at], end[at - 1]))
        which = np.cumsum(split) - 1
        part[places] = which + (part.max() + 1)
        longer = (np.bincount(which)[which] > 1) & (end == 8)  # alone or ended: sorted
        ended = ~longer & ~split
        lcp[places[ended]] = size[moved[ended]]
        places, depth = places[longer], depth + 8
    if len(places):
        cuts = np.append(np.flatnonzero(_runs(part[places])), len(places))
        for a, b in zip(cuts, cuts[1:], strict=False):
            ids = order[places[a:b]].tolist()
            trie = BlindTrie([strings[i] for i in ids], depth)
            for i in range(len(ids)):
                trie.insert(i)
            sorted_, lcps = trie.ordered()
            order[places[a:b]] = [ids[i] for i in sorted_]
            lcp[places[a + 1 : b]] = lcps[1:]
    return order, lcp


def shared_windows(data: list[bytes], keys: np.ndarray, pos: np.ndarray, length: int) -> list[np.ndarray]:
    """For each segment, which of its windows another segment with the same key holds (segments of a key being different)."""
    off, last = (pos >> 8) & 255, pos & 255
    order_r, lcp_r = deep_shallow([d[o:] for d, o in zip(data, off.tolist(), strict=True)], keys)
    order_l, lcp_l = deep_shallow([d[:o][::-1] for d, o in zip(data, off.tolist(), strict=True)], keys)
    out = [np.zeros(n + 1, dtype=bool) for n in last.tolist()]
    rank_r, rank_l = np.empty(len(data), np.int64), np.empty(len(data), np.int64)
    rank_r[order_r], rank_l[order_l] = np.arange(len(data)), np.arange(len(data))
    for d in range(int(off.max(initial=-1)) + 1):
        held = np.flatnonzero((off - last <= d) & (d <= off))
        if len(held) < 2:
            continue
        left, right = np.cumsum(lcp_l < d)[rank_l[held]], np.cumsum(lcp_r < length - d)[rank_r[held]]
        _, inverse, count = np.unique(left * (len(data) + 1) + right, return_inverse=True, return_counts=True)
        for i in held[count[inverse] > 1].tolist():
            out[i][off[i] - d] = True
    return out


def _compare(length: int):
    """Ranges (tk, start, end) of the bytes that shared windows cover, from rows sorted by key."""

    def ranges(cols):
        key, tk, pos, data = cols
        order = np.lexsort((pos, tk, key))
        order = order[_runs(key[order], tk[order], pos[order])]
        key, tk, pos = key[order], tk[order], pos[order]
        out = ([], [], [])
        for t, p, shared in zip(tk.tolist(), (pos >> 16).tolist(), shared_windows([data[i] for i in order.tolist()], key, pos, length), strict=True):
            if shared.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], shared.astype(np.int8), [0]])))
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    for to, value in zip(out, (t, p + a, p + b - 1 + length), strict=True):
                        to.append(value)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["tk", "first", "last"])

    def run(batches):
        held, rows = None, 0
        for batch in batches:
            cols = [np.asarray(batch.column(i)) for i in range(3)] + [batch.column(3).to_pylist()]
            held = cols if held is None else [np.concatenate([a, b]) if i < 3 else a + b for i, (a, b) in enumerate(zip(held, cols, strict=True))]
            rows = len(held[0])
            if rows < 8192:
                continue
            cut = int(np.searchsorted(held[0], held[0][-1], "left"))
            if cut:
                yield ranges([c[:cut] for c in held])
                held = [c[cut:] for c in held]
        if held is not None and len(held[0]):
            yield ranges(held)

    return run


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _measure(batches):
    for batch in batches:
        out = ([], [], [], [])
        for text, ranges in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            data, at, kept, removed = (text.as_py() or "").encode(), 0, hashlib.sha256(), 0
            spans = merged([(r["first"], r["last"]) for r in ranges or []])
            for a, b in spans:
                kept.update(data[at:a])
                removed += b - a
                at = b
            kept.update(data[at:])
            for to, value in zip(out, (len(data), removed, len(spans), kept.hexdigest()), strict=True):
                to.append(value)
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in out[:3]], pa.array(out[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _keyed(batches):
    for batch in batches:
        raw, offsets = buffers(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_text_keys(raw, offsets))], names=["doc_id", "text", "tk"])


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, many: int = MANY) -> tuple[DataFrame, DataFrame]:
    """(docs as doc_id, text, tk; tk and an array of ranges (first, last) to be removed, which may overlap)."""
    if not gram <= length <= gram + 255:
        raise ValueError(f"length must be {gram} to {gram + 255}: places of anchors in windows have eight bits")
    spark = docs.sparkSession
    narrow = docs.select("doc_id", text_of().alias("text"))
    texts = narrow.select("text")
    kept, written, hot, hot_sets = [], [], None, []
    for level in range(3):
        rows = settle(texts.mapInArrow(_scan(length, gram, level, hot), _ROWS), "segments")
        kept.append(rows)
        written.append(rows)
        if level == 2:
            break
        sizes = rows.where("kind = 0").groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
        low = F.col("key").bitwiseAND(F.lit(SPLIT_BITS)).alias("low")
        split = sizes.where(F.col("rows") > many).select(low).distinct().collect()  # 2**20 at most
        if not split:
            break
        keys = [r["low"] for r in split]
        large = spark.createDataFrame([(k,) for k in keys], "low long")
        kept[-1] = rows.withColumn("low", low).join(F.broadcast(large), "low", "left_anti").select(*rows.columns)
        hot_sets.append(np.sort(np.array(keys, dtype=np.int64).view(_U)))
        hot = spark.sparkContext.broadcast(list(hot_sets))
    sent, known = None, None
    for rows in kept:
        a, b = rows.where("kind = 0"), rows.where("kind = 1").select("tk", "pos")
        sent, known = (a, b) if sent is None else (sent.unionByName(a), known.unionByName(b))
    ordered = sent.repartition("key").sortWithinPartitions("key", "s")
    judged = settle(ordered.mapInArrow(_judge, _ROWS), "judged")
    twice = settle(judged.where("kind = 1").select("tk", "pos").unionByName(known), "twice")
    release(*written)
    keyed = narrow.mapInArrow(_keyed, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, text string, tk long")
    wanted = settle(judged.where("kind = 2").groupBy("tk").agg(F.collect_list(F.struct("key", "pos")).alias("segs")), "wanted")
    cut = keyed.join(wanted, "tk").select("tk", "text", "segs").mapInArrow(_cut(length), "key long, tk long, pos long, data binary")
    near = cut.repartition("key").sortWithinPartitions("key").mapInArrow(_compare(length), "tk long, first long, last long")
    near = settle(near, "near-ranges")
    release(judged, wanted)
    whole = twice.select("tk", F.shiftright("pos", 16).alias("first"), (F.shiftright("pos", 16) + F.expr("pos & 255") + length).alias("last"))
    ranges = whole.unionByName(near).distinct().groupBy("tk").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    ranges = settle(ranges, "ranges")
    release(twice, near)
    return keyed, ranges


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, many: int = MANY) -> DataFrame:
    """A row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are UTF-8 bytes, null as empty. A byte goes if a string of `length` bytes over it starts anywhere else in the corpus,
    its own document included; repeated rows are documents of their own, so repeats of length bytes or more go whole. Texts
    shorter than that keep all bytes. An empty table gives an empty result; columns besides doc_id and text are not read.
    """
    keyed, ranges = repeated_ranges(docs, length, gram, many)
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = keyed.join(ranges, "tk", "left").select("doc_id", "text", "ranges")
    return out.mapInArrow(_measure, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, strings of 200 bytes; nulls, empty, long and repeated texts as in `remove_repeats`."""
    return remove_repeats(load(spark, sf_dir, "documents"))
