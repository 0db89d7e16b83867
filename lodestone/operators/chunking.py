"""Chunking: semantic blocks, recursive splits with overlap, page bounds, protected spans, fixed windows, parents."""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.batches import AT_ONCE, slices

#: Separators from coarse to fine.
SEPARATORS = ["\n\n", "\n", ". ", " ", ""]
#: Characters a token stands for, room left beside them, and how much longer than allowed a chunk may be before it is cut
#: anew between sentences.
PER_TOKEN, ROOM, OVERLONG = 1.6, 1.05, 1.2
_SENTENCE = re.compile(r"(?<=[。！？；.!?;])\s*|(?<=\n)\s*")
_CHUNK = [("chunk_index", pa.int32()), ("text", pa.string()), ("kind", pa.string()), ("section_path", pa.list_(pa.string())), *((n, pa.int32()) for n in ("char_start", "char_end", "line_start", "line_end", "page"))]
_HEADING, _FENCE = re.compile(r"^(#{1,6})\s+(.*\S)\s*$"), re.compile(r"^\s*(```|~~~)")


def blocks(text: str) -> list[tuple[int, int, str, str, tuple[str, ...]]]:
    """(start, end, kind, heading, section path): headings, fenced code, tables, lists, formulas, figures and paragraphs."""
    out, path, at, run, kind, fence = [], [], 0, None, None, None

    def close(end):
        nonlocal run
        if run is not None and text[run:end].strip():
            out.append((run, end, kind, path[-1][1] if path else "", tuple(t for _, t in path)))
        run = None

    for line in text.splitlines(keepends=True):
        bare = line.strip()
        if fence:
            if bare.startswith(fence):
                fence = None
                at += len(line)
                close(at)
                continue
        elif _FENCE.match(line):
            close(at)
            run, kind, fence = at, "code", _FENCE.match(line)[1]
        elif m := _HEADING.match(line.rstrip("\n")):
            close(at)
            level = len(m[1])
            path = [p for p in path if p[0] < level] + [(level, m[2])]
            run, kind = at, "heading"
            at += len(line)
            close(at)
            continue
        else:
            now = "table" if bare.startswith("|") and bare.endswith("|") and len(bare) > 1 else "list" if re.match(r"([-*+]|\d+[.)])\s", bare) else "formula" if bare.startswith("$$") else "figure" if bare.startswith("![") else "paragraph"
            if not bare:
                close(at)
            elif run is None or now != kind:
                close(at)
                run, kind = at, now
        at += len(line)
    close(at)
    return out


class Spans:
    """A sorted set of disjoint spans; touching and overlapping ones are one."""

    def __init__(self, spans):
        self.begins, self.ends = [], []
        for a, b in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            elif a < b:
                self.begins.append(a)
                self.ends.append(b)

    def cut_by(self, at: int) -> bool:
        """Whether a cut at this place falls within a span."""
        i = bisect_right(self.begins, at) - 1
        return i >= 0 and self.begins[i] < at < self.ends[i]


def protected(text: str) -> Spans:
    """The spans of fenced code and of tables, neither of which may be cut."""
    return Spans((a, b) for a, b, kind, _, _ in blocks(text) if kind in ("code", "table"))


def budget(size: int, token_aware: bool = True) -> int:
    """Characters for a size in tokens."""
    return max(1, int(size * PER_TOKEN * ROOM)) if token_aware else size


def smoothed(text: str, most: int) -> list[str]:
    """A chunk that is far too long, cut anew between its sentences; others as they are."""
    sentences = [s for p in re.split(r"\n\s*\n", text) for x in _SENTENCE.split(p) if (s := x.strip())]
    if len(text) <= most * OVERLONG or len(sentences) < 2:
        return [text]
    out, held = [], ""
    for s in sentences:
        if held and len(held) + len(s) + 1 > most:
            out.append(held)
            held = s
        else:
            held = f"{held}\n{s}" if held else s
    return [*out, held]


def _joined(parts: list[str], sep: str, size: int, overlap: int) -> list[str]:
    """Parts joined up to `size`; a new piece starts with the last parts of the one before, up to `overlap`."""
    out: list[str] = []
    held: list[str] = []
    length = lambda xs: sum(map(len, xs)) + len(sep) * max(0, len(xs) - 1)
    for part in parts:
        if held and length([*held, part]) > size:
            if piece := sep.join(held).strip():
                out.append(piece)
            while held and (length(held) > overlap or length([*held, part]) > size):
                held = held[1:]
        held.append(part)
    if piece := sep.join(held).strip():
        out.append(piece)
    return out


def split(text: str, size: int, overlap: int, separators: list[str] = SEPARATORS) -> list[str]:
    """Pieces of at most `size` characters where the separators allow it, finer ones being tried on what is too long."""
    if not text.strip():
        return []
    if len(text) <= size:
        return [text.strip()]
    sep, finer = separators[0], separators[1:]
    if not sep:
        return [p for i in range(0, len(text), size - overlap) if (p := text[i : i + size]).strip()]
    parts: list[str] = []
    for p in text.split(sep):
        if p.strip():
            parts += split(p, size, overlap, finer) if len(p) > size and finer else [p]
    return _joined(parts, sep, size, overlap)


def _chunks_of_page(text: str, least: int, most: int, overlap: int) -> list[dict]:
    """Chunks in order with their place in the text (-1 if not found), section path and kind; tables and code stay whole."""
    out: list[dict] = []
    held: list[tuple[str, tuple[str, ...]]] = []

    def add(piece: str, path: tuple[str, ...], kind: str):
        if piece.strip():
            out.append({"text": piece.strip(), "section_path": list(path), "kind": kind})

    def flush():
        if held:
            for piece in smoothed("\n\n".join(t for t, _ in held), most):
                add(piece, next((p for _, p in held if p), ()), "text")
            held.clear()

    for start, end, kind, _, path in blocks(text):
        body = text[start:end].strip()
        if kind in ("table", "code") and len(body) <= most:
            flush()
            add(body, path, kind)
        elif len(body) > most:
            flush()
            for piece in split(body, most, overlap):
                add(piece, path, "text")
        else:
            if held and sum(len(t) + 2 for t, _ in held) + len(body) > most:
                flush()
            held.append((body, path))
            if sum(len(t) for t, _ in held) + 2 * (len(held) - 1) >= least:
                flush()
    flush()
    at = 0
    for c in out:
        found = text.find(c["text"], at)
        found = found if found >= 0 else text.find(c["text"])
        if found < 0:  # white space, or marks between empty sentences, went in the splitting
            spaced, worded = r"\s+".join(map(re.escape, c["text"].split())), r"\W+".join(re.findall(r"\w+", c["text"]))
            m = re.search(spaced, text[at:])
            if not m and worded and (m := re.search(worded, text[at:])) and len(m[0]) > most:
                m = None
            if m:
                found, c["text"] = at + m.start(), m[0]
        c["char_start"], c["char_end"] = (found, found + len(c["text"])) if found >= 0 else (-1, -1)
        at = max(at, found + 1)
    return out


def chunks(text: str, least: int = 200, most: int = 1000, overlap: int = 100, breaks=(), token_aware: bool = False) -> list[dict]:
    """Chunks in order with their place in the text (-1 if not found), page (from 0), section path and kind.

    No chunk crosses a break (a place where a page begins), but where a break would cut a table or fenced code: that one does not
    count. With token_aware the sizes are in tokens.
    """
    if overlap >= most:
        raise ValueError("the overlap must be smaller than the largest chunk")
    if token_aware:
        least, most, overlap = budget(least), budget(most), budget(overlap) if overlap else 0
    whole = protected(text) if breaks else Spans(())
    places = sorted({b for b in breaks if 0 < b < len(text) and not whole.cut_by(b)})
    out: list[dict] = []
    for a, b in zip([0, *places], [*places, len(text)], strict=True):
        page = bisect_right(sorted(breaks), a)
        for c in _chunks_of_page(text[a:b], least, most, overlap):
            if c["char_start"] >= 0:
                c["char_start"], c["char_end"] = c["char_start"] + a, c["char_end"] + a
            out.append(c | {"page": page})
    return out


def chunk_documents(docs: DataFrame, least: int = 200, most: int = 1000, overlap: int = 100, key: str = "doc_id", breaks: str | None = None, token_aware: bool = False) -> DataFrame:
    """key, chunk_index, text, kind, section_path, char_start, char_end, line_start, line_end, page of each document's chunks. `breaks`
    names a column of places where pages begin."""

    def run(batches):
        for batch in slices(batches):
            of, rows = [], []
            for n, (text, at) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for i, c in enumerate(chunks(text or "", least, most, overlap, at or (), token_aware)):
                    a, b = c["char_start"], c["char_end"]
                    lines = (text.count("\n", 0, a) + 1, text.count("\n", 0, b) + 1) if a >= 0 else (None, None)
                    of.append(n)
                    rows.append((i, c["text"], c["kind"], c["section_path"], a, b, *lines, c["page"]))
            columns = [pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(_CHUNK)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *columns], names=[key, *(name for name, _ in _CHUNK)])

    kind = dict(docs.dtypes)[key]
    places = F.col(breaks).cast("array<int>") if breaks else F.lit(None).cast("array<int>")
    return docs.select(key, "text", places.alias("__breaks")).mapInArrow(run, f"{key} {kind}, chunk_index int, text string, kind string, section_path array<string>, char_start int, char_end int, line_start int, line_end int, page int")


def image_chunks(images: DataFrame, chunked: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, chunk_index, text, kind of images (key, at, text, content_type) after their document's own chunks: images without a text have
    none and take no index; kind is the content type, image if there is none."""
    last = chunked.groupBy(key).agg(F.max("chunk_index").alias("last"))
    shown = images.withColumn("text", F.btrim("text", F.lit(" \t\n\r\x0b\x0c\u3000\xa0"))).where("text <> ''").join(last, key, "left")
    n = F.row_number().over(W.partitionBy(key).orderBy("at"))
    return shown.select(key, (F.coalesce("last", F.lit(-1)) + n).alias("chunk_index"), "text", F.coalesce("content_type", F.lit("image")).alias("kind"))


def windows(docs: DataFrame, most: int = 1000, overlap: int = 100, multiple: float = 2.5, key: str = "doc_id") -> DataFrame:
    """key, window, char_start, char_end, text: fixed parent windows of max(most + 1, most * multiple) characters."""
    size = max(most + 1, int(most * multiple))
    step = max(1, size - overlap)
    n = F.length("text")
    count = F.when(n <= size, F.lit(1)).otherwise((F.ceil((n - size) / step) + 1).cast("int"))
    rows = docs.where("text IS NOT NULL").select(key, "text", n.alias("n"), F.explode(F.sequence(F.lit(0), count - 1)).alias("window"))
    start = F.col("window") * step
    return rows.select(key, "window", start.alias("char_start"), F.least(start + size, F.col("n")).alias("char_end"), F.substr("text", start + 1, F.lit(size)).alias("text"))


def _parents_of(key, chunked: list[tuple], least: int, most: int) -> list[tuple]:
    """The rows of `parents` of one document's chunks (chunk_index, section path, text), which are in order."""
    groups: list[list] = []
    size = 0
    for r in chunked:
        same = bool(groups) and groups[-1][0][1][:1] == r[1][:1]
        if groups and size + len(r[2]) <= most and (same or size < least):
            groups[-1].append(r)
            size += len(r[2])
        else:
            groups.append([r])
            size = len(r[2])
    rows = [(key, f"{key}:p{i}", "parent", i, list(g[0][1]), [x[0] for x in g], "\n\n".join(x[2] for x in g)) for i, g in enumerate(groups)]
    sections: dict[tuple, list] = {}
    for row in rows:
        sections.setdefault(tuple(row[4][:1]), []).append(row)
    for i, (path, held) in enumerate(x for x in sections.items() if x[0] and len(x[1]) > 1):
        rows.append((key, f"{key}:s{i}", "section", i, list(path), [c for r in held for c in r[5]], "\n\n".join(r[6] for r in held)))
    return rows


def parents(chunked: DataFrame, least: int = 1200, most: int = 5000, key: str = "doc_id") -> DataFrame:
    """key, parent_id, level, idx, section_path, child_indexes, text: a document's chunks gathered by section up to `most`
    characters, short groups joined with the one before; sections of two parents or more get a row of their own.

    Documents are dealt whole and sorted, and a task passes over its chunks once, holding those of one document."""

    def run(batches):
        out, chars, held, kind = [], 0, [], pa.null()
        for batch in slices(batches, 3):
            kind = batch.schema.field(0).type
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    out += _parents_of(held[0][0], [r[1:] for r in held], least, most)
                    held = []
                held.append(row)
                chars += len(row[3])
            if chars >= AT_ONCE:
                yield _parent_batch(key, kind, out)
                out, chars = [], 0
        if held:
            out += _parents_of(held[0][0], [r[1:] for r in held], least, most)
        if out:
            yield _parent_batch(key, kind, out)

    kind = dict(chunked.dtypes)[key]
    dealt = chunked.select(key, "chunk_index", "section_path", "text").repartition(key).sortWithinPartitions(key, "chunk_index")
    return dealt.mapInArrow(run, f"{key} {kind}, parent_id string, level string, idx int, section_path array<string>, child_indexes array<int>, text string")


def _parent_batch(key: str, kind: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
    kinds = [kind, pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.string()]
    names = [key, "parent_id", "level", "idx", "section_path", "child_indexes", "text"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)
