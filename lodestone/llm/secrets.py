"""Secret scans: pattern spans, and windows of high entropy in runs of key-like characters.

Everything is Column expressions. A pattern's spans come from `split` and `regexp_extract_all` on the same pattern: the
pieces between matches and the matches alternate, so running sums of their lengths are the positions (code points).

Entropy: candidates are maximal runs of a character class, taken apart into pieces of `CHUNK` windows. A fold over a piece's
characters slides a window over it and holds the count of each character, five bits each in `WORDS` integers, and the sum of
c * log2 c over the counts; a step changes two counts and that sum. The Shannon entropy of the window is log2(width) - sum /
width. Overlapping windows at or above the class's bound (less 1e-9, for rounding) make one span.

Allow list: a run that is digits only, a UUID or a slug of lower-case words has no entropy spans, nor has a window that touches
a stretch between slashes (and other characters of no key) that holds a placeholder. Entropy spans inside a pattern's span are
left out; pattern spans are never suppressed.

Texts of any length and number of matches take linear time: running sums go by blocks (`_prefix`), no pattern makes the
regular expression engine recurse or try a place twice, and no span is sought in all others.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, text_of

#: Kind, pattern, shortest length of what counts, and the group it is counted in.
PATTERNS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    ("access", r"AKIA[A-Z0-9]+", 20, 0),
    ("hex", r"[0-9a-f]{24,}", 24, 0),  # a maximal run of 24 or more is what [0-9a-f]+ leaves after short ones are dropped
]
#: Entropy kinds: name, class, and least bits a character in a window of WIDTH.
WIDTH = 24
CLASSES = [("entropy_hex", r"[0-9A-Fa-f]{24,}", 3.0), ("entropy_base64", r"[A-Za-z0-9+/_=-]{24,}", 4.1)]
#: Runs without entropy spans. The possessive group keeps Java's engine from recursing once for each word of a slug.
ALLOWED = [r"^[0-9]+$", r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$", r"^[A-Z]?[a-z]+(?:[-_/+=][A-Z]?[a-z]+)*+$"]
#: Placeholders, and the stretch around one: lazy up to the first, from a stretch's first character only.
PLACEHOLDER = r"(?i:example|placeholder|x{8}|0{8}|0123456789|abcdefghij)"
STRETCH = rf"(?<![A-Za-z0-9+_=-])[A-Za-z0-9+_=-]*?{PLACEHOLDER}[A-Za-z0-9+_=-]*"
KINDS = [k for k, *_ in PATTERNS] + [k for k, *_ in CLASSES]
MASK = "[SECRET]"
CHUNK, BLOCK = 1024, 64
#: Counts of five bits, twelve to an integer, for the 80 characters from + (43) to z (122).
WORDS = 7


def _sql(s: str) -> str:
    return "r'" + s + "'" if "'" not in s else "r\"" + s + "\"" if '"' not in s else "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _prefix(values: str, fold: Callable[[str, str], str]) -> str:
    """SQL: for each element of an array of integers the fold, from 0, of those before it. An array grows by
    copying, so blocks of BLOCK are folded on their own, each from the fold of the blocks before it."""
    grow = f"(acc, x) -> named_struct('s', {fold('acc.s', 'x')}, 'out', array_append(acc.out, acc.s))"
    empty = "cast(array() AS array<int>)"
    sums = f"aggregate(__b, named_struct('s', 0, 'out', {empty}), (acc, y) -> named_struct('s', {fold('acc.s', f"aggregate(y, 0, (s, x) -> {fold('s', 'x')})")}, 'out', array_append(acc.out, acc.s)), acc -> acc.out)"
    each = f"zip_with(__b, {sums}, (y, f) -> aggregate(y, named_struct('s', f, 'out', {empty}), {grow}, acc -> acc.out))"
    return _let("__v", values, _let("__b", f"transform(sequence(0, cast((size(__v) - 1) div {BLOCK} AS int)), k -> slice(__v, k * {BLOCK} + 1, {BLOCK}))", f"flatten({each})"))


def _sum(s: str, x: str) -> str:
    return f"{s} + {x}"


def _most(s: str, x: str) -> str:
    return f"greatest({s}, {x})"


def _matches(text: str, pattern: str, group: int) -> str:
    """SQL: array of (start, end, found, part) of the pattern's matches in a text."""
    p = _sql(pattern)
    part = "__f" if not group else f"regexp_extract_all({text}, {p}, {group})"
    out = "transform(__f, (x, i) -> named_struct('start', get(__s, i) + length(get(__g, i)), 'end', get(__s, i) + length(get(__g, i)) + length(x), 'found', x, 'part', get(__p, i)))"
    out = _let("__s", _prefix("transform(__f, (x, i) -> length(get(__g, i)) + length(x))", _sum), out)
    return _let("__f", f"regexp_extract_all({text}, {p}, 0)", _let("__g", f"split({text}, {p}, -1)", _let("__p", part, out)))


def _windows(chars: str, least: float, width: int = WIDTH) -> str:
    """SQL: spans (a, b) of the array `chars` that windows of at least `least` bits cover, by one incremental fold."""
    weight = "array(" + ", ".join(f"{c * math.log2(c) if c else 0.0!r}D" for c in range(width + 1)) + ")"
    into, gone = f"ascii({chars}[i]) - 43", f"if(i >= {width}, ascii({chars}[i - {width}]) - 43, -1)"
    count = lambda x: f"cast(shiftright(get(acc.n, {x} div 12), 5 * ({x} % 12)) & 31 AS int)"
    moved = "transform(acc.n, (v, k) -> v + if(k = m.x div 12, shiftleft(1L, 5 * (m.x % 12)), 0L) - if(m.y >= 0 AND k = m.y div 12, shiftleft(1L, 5 * (m.y % 12)), 0L))"
    total = f"acc.s + {weight}[m.cx + 1] - {weight}[m.cx] + if(m.y < 0, 0D, {weight}[m.cy - 1] - {weight}[m.cy])"
    hot = f"i >= {width - 1} AND {math.log2(width)!r}D - q / {width} >= {least - 1e-9!r}D"
    first = f"i - {width - 1}"
    step = f"""named_struct('n', if(m.x = m.y, acc.n, {moved}), 's', q,
        'a', if({hot} AND (acc.a < 0 OR acc.b < {first}), {first}, acc.a), 'b', if({hot}, i + 1, acc.b),
        'out', if({hot} AND acc.a >= 0 AND acc.b < {first}, array_append(acc.out, named_struct('a', acc.a, 'b', acc.b)), acc.out))"""
    step = _let("q", f"if(m.x = m.y, acc.s, {total})", step)
    step = _let("m", f"named_struct('x', w.x, 'y', w.y, 'cx', {count('w.x')}, 'cy', if(w.y < 0, 0, {count('greatest(w.y, 0)')}))", step)
    step = _let("w", f"named_struct('x', {into}, 'y', {gone})", step)
    return f"""aggregate(sequence(0, size({chars}) - 1),
        named_struct('n', array_repeat(0L, {WORDS}), 's', 0D, 'a', -1, 'b', -1, 'out', cast(array() AS array<struct<a: int, b: int>>)),
        (acc, i) -> {step}, acc -> if(acc.a < 0, acc.out, array_append(acc.out, named_struct('a', acc.a, 'b', acc.b))))"""


def _run_spans(found: str, least: float) -> str:
    """SQL: spans (a, b) of a run. Its windows are taken CHUNK at a time; spans of neighbouring chunks that meet are one."""
    chunk = f"regexp_extract_all(cast(substring(__r, k * {CHUNK} + 1, {CHUNK + WIDTH - 1}) AS string), '.', 0)"
    moved = f"transform({_let('c', chunk, _windows('c', least))}, x -> named_struct('a', x.a + k * {CHUNK}, 'b', x.b + k * {CHUNK}))"
    parts = f"flatten(transform(sequence(0, cast((length(__r) - {WIDTH}) div {CHUNK} AS int)), k -> {moved}))"
    firsts = "filter(__w, (x, i) -> i = 0 OR get(__w, i - 1).b < x.a)"
    lasts = "filter(__w, (x, i) -> i = size(__w) - 1 OR x.b < get(__w, i + 1).a)"
    joined = f"zip_with({firsts}, {lasts}, (x, y) -> named_struct('a', x.a, 'b', y.b))"
    return _let("__r", f"cast({found} AS binary)", _let("__w", parts, joined))


def _kind_spans(kind: str, pattern: str, least: int, group: int) -> Column:
    spans = f"transform(filter({_matches('text', pattern, group)}, x -> length(x.part) >= {least}), x -> named_struct('start', x.start, 'ord', {KINDS.index(kind)}, 'end', x.end))"
    return F.expr(f"if(text RLIKE {_sql(pattern)}, {spans}, cast(array() AS array<struct<start: int, ord: int, end: int>>))")


def _entropy_spans(kind: str, pattern: str, least: float) -> Column:
    allowed = " OR ".join(f"x.found RLIKE {_sql(p)}" for p in ALLOWED)
    spans = f"flatten(transform(filter({_matches('__masked', pattern, 0)}, x -> NOT ({allowed})), x -> transform({_run_spans('x.found', least)}, w -> named_struct('start', x.start + w.a, 'ord', {KINDS.index(kind)}, 'end', x.start + w.b))))"
    return F.expr(f"if(__masked RLIKE {_sql(pattern)}, {spans}, cast(array() AS array<struct<start: int, ord: int, end: int>>))")


def _masked() -> Column:
    """The text with spaces for the stretches that hold a placeholder."""
    p, runs = _sql(STRETCH), _sql(CLASSES[1][1])
    blank = f"array_join(flatten(transform(__g, (x, i) -> array(x, coalesce(repeat(' ', length(get(__f, i))), '')))), '')"
    return F.expr(f"if(text RLIKE {_sql(PLACEHOLDER)} AND text RLIKE {runs}, {_let('__f', f'regexp_extract_all(text, {p}, 0)', _let('__g', f'split(text, {p}, -1)', blank))}, text)")


def scan(docs: DataFrame) -> DataFrame:
    """docs with `secret_base` and `secret_spans`: arrays of (start, ord, end) by start, then kind (ord indexes KINDS).

    Positions count code points, ends are exclusive. A null or empty text has empty arrays. Rows are judged one by one:
    repeated rows stay, an empty table stays empty, and columns of these two names are replaced.
    """
    return _scan(docs, "secret_base", "secret_spans")


def _scan(docs: DataFrame, base_as: str, spans_as: str) -> DataFrame:
    kept = docs.drop(base_as, spans_as)
    narrow = kept.withColumn("__original", F.col("text")).withColumn("text", text_of()).withColumn("__masked", _masked())
    base = F.array_sort(F.concat(*[_kind_spans(*p) for p in PATTERNS]))
    entropy = F.concat(*[_entropy_spans(*c) for c in CLASSES])
    narrow = narrow.withColumn("__base", base).withColumn("__entropy", entropy)
    # sorted by start, an entropy span is inside a pattern's span if one of those before it ends as late or later
    ends = _prefix(f"transform(__all, x -> if(x.ord < {len(PATTERNS)}, x.end, 0))", _most)
    apart = _let("__all", "array_sort(concat(__base, __entropy))", _let("__m", ends, f"filter(__all, (x, i) -> x.ord < {len(PATTERNS)} OR get(__m, i) < x.end)"))
    narrow = narrow.withColumn("__spans", F.expr(f"if(size(__entropy) = 0, __base, if(size(__base) = 0, array_sort(__entropy), {apart}))"))
    names = {c: F.col("__original").alias(c) if c == "text" else F.col(c) for c in kept.columns}
    return narrow.select(*names.values(), F.col("__base").alias(base_as), F.col("__spans").alias(spans_as))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each secret's span in text replaced by MASK (overlapping spans by one); n_chars, where present, follows.

    A text without a span stays as it is, null and empty ones with it; a text that is all secret becomes MASK. Repeated rows
    are masked alike and stay, an empty table stays empty, and columns of any other name are handed through.
    """
    found = _scan(docs, "__found_base", "__found").withColumn("__t", text_of())
    # groups of overlapping spans: one starts where no earlier span reaches; it ends at the most that is reached before the next
    reach = _prefix("transform(__found, x -> x.end)", _most)
    groups = "filter(transform(__found, (x, i) -> named_struct('start', x.start, 'before', get(__m, i))), x -> x.start >= x.before)"
    cut = f"""if(__b <= __a, '', substring(array_join(slice(__c, cast(__a div {CHUNK} AS int) + 1, cast((__b - 1) div {CHUNK} - __a div {CHUNK} AS int) + 1), ''), __a % {CHUNK} + 1, __b - __a))"""
    piece = _let("__a", "if(i = 0, 0, x.before)", _let("__b", "x.start", cut))
    text = f"concat(array_join(transform(__n, (x, i) -> concat({piece}, '{MASK}')), ''), {_let('__a', 'array_max(transform(__found, x -> x.end))', _let('__b', 'length(__t)', cut))})"
    text = _let("__m", reach, _let("__n", groups, _let("__c", f"regexp_extract_all(__t, '(?s).{{1,{CHUNK}}}', 0)", text)))
    hit = F.size("__found") > 0
    found = found.withColumn("text", F.when(hit, F.expr(text)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def _listed(spans: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', {names}[x.ord], x.start, x.end)), ',')")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy: a row for each row of docs.

    A null or empty text has counts of 0, the digest of no span and empty spans; repeated rows stay, ties in start go by kind,
    an empty table gives an empty result, and columns other than doc_id and text are not read.
    """
    found = scan(docs.select("doc_id", "text"))
    count = lambda k: F.expr(f"cast(size(filter(secret_base, x -> x.ord = {KINDS.index(k)})) AS long)").alias(f"n_{k}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(_listed("secret_base"), 256).alias("base_sha256"),
        _listed("secret_spans").alias("spans"), (F.size("secret_spans") - F.size("secret_base")).cast("long").alias("n_entropy"),
    )


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents; nulls, empty and repeated rows as in `digest`."""
    return digest(load(spark, sf_dir, "documents"))


_KEY = r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_PARTS = [("assign", 0, _KEY, 2, 6), ("access", 1, "AKIA[A-Z0-9]+", 0, 20), ("hex", 2, "[0-9a-f]+", 0, 24)]
_RUNS = [(CLASSES[0][1], 3, CLASSES[0][2]), (CLASSES[1][1], 4, CLASSES[1][2])]
_PLACES = "list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0)"


def _found(pattern: str, ord_: int, group: int, table: str = "d") -> str:
    cut = f"SELECT doc_id, {ord_} AS ord, string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}') AS f, regexp_extract_all(t, '{pattern}', {group}) AS p FROM {table}"
    return f"SELECT doc_id, ord, {_PLACES} AS s, f[i] AS m, p[i] AS part FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM ({cut}))"


OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
masks AS (SELECT doc_id, string_split_regex(t, '[^A-Za-z0-9+_=-]') AS g, regexp_extract_all(t, '[^A-Za-z0-9+_=-]') AS f FROM d),
masked AS (SELECT doc_id, array_to_string(flatten(list_transform(g, lambda x, i: [CASE WHEN regexp_matches(x, '{PLACEHOLDER}') THEN repeat(' ', length(x)) ELSE x END, coalesce(f[i], '')])), '') AS t FROM masks),
base AS ({" UNION ALL ".join(f"SELECT doc_id, ord, s, s + length(m) AS e FROM ({_found(p, o, g)}) WHERE length(part) >= {n}" for _, o, p, g, n in _PARTS)}),
cand AS ({" UNION ALL ".join(f"SELECT *, {least} AS least FROM ({_found(p, o, 0, 'masked')})" for p, o, least in _RUNS)}),
win AS (SELECT doc_id, ord, s, least, m, unnest(range(0, length(m) - {WIDTH} + 1)) AS k FROM cand WHERE NOT ({" OR ".join(f"regexp_matches(m, '{a.replace("*+", "*")}')" for a in ALLOWED)})),
hot AS (SELECT doc_id, ord, s, k FROM win WHERE log2({WIDTH}) - list_sum(list_transform(map_values(list_aggregate(string_split(substr(m, (k + 1)::INT, {WIDTH}), ''), 'histogram')), lambda c: c * log2(c))) / {WIDTH} >= least - 1e-9),
isl AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, ord, s ORDER BY k) AS n FROM (SELECT *, CASE WHEN k - lag(k) OVER (PARTITION BY doc_id, ord, s ORDER BY k) <= {WIDTH} THEN 0 ELSE 1 END AS fresh FROM hot)),
ent AS (SELECT doc_id, ord, s + min(k) AS s, s + max(k) + {WIDTH} AS e FROM isl GROUP BY doc_id, ord, s, n),
extra AS (SELECT * FROM ent x WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = x.doc_id AND b.s <= x.s AND x.e <= b.e)),
names AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{k}')" for i, k in enumerate(KINDS))}) AS v(ord, kind)),
b AS (SELECT doc_id, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS base FROM base JOIN names USING (ord) GROUP BY doc_id),
a AS (SELECT doc_id, count(*) FILTER (ord > 2) AS n_entropy, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM extra) JOIN names USING (ord) GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_entropy, 0) AS n_entropy
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)
"""
