"""Spelling variants: words of a corpus that differ by one edit, and the commoner form each of them may stand for.

Candidates come from asymmetric q-chunks. One word is cut into two disjoint chunks; an edit lies in one of them and leaves the other
whole, at its place or shifted by one in the other word, which contributes its grams at the places a chunk may have moved to. The
rule is applied again to the half that holds the edit: of its two chunks one is whole too. So a word has a row for each *window*
that may hold the edit, keyed by all that stands outside; the other word has a row for each window and each of the three length
differences. Windows are halved once more wherever a key would bring too many words together, until a window is one code point
wide; no group of a key is ever expanded beyond that bound, and every pair is verified by edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, release, settle

RUN, LEAST_LENGTH, LEAST_COUNT, DROP = r"[A-Za-zÀ-ÿ]", 5, 3, 97
#: Windows a word starts with, and words that a key may bring together before its windows are halved.
WINDOWS, TOGETHER = 4, 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(word: Column) -> Column:
    """A-Z lower-cased only; words without capital letters above them take the quick way."""
    return F.when(word.rlike("[À-Þ]"), F.translate(word, _UPPER, _LOWER)).otherwise(F.lower(word))


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, drop: int | None = DROP) -> DataFrame:
    """word, n of docs' runs of letters with at least `least_length` code points and `least_count` occurrences.

    With `drop`, a run whose CRC-32 with its doc_id is a multiple of it loses one code point first, chosen by the CRC. A null text
    has no words; in a row without doc_id no run is changed. Occurrences are counted before they are shuffled.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(f"{RUN}{{{least_length},}}"), F.lit(0))).alias("run"))
    runs = runs.select("doc_id", lowered(F.col("run")).alias("word"))
    if drop:
        h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("word")).cast("binary"))
        at = (F.col("h") % F.length("word")).cast("int")
        less = F.concat(F.substr("word", F.lit(1), at), F.substr(F.col("word"), at + 2))
        runs = runs.withColumn("h", h).select(F.when(F.col("h") % drop == 0, less).otherwise(F.col("word")).alias("word")).where(F.length("word") >= least_length)
    return runs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _rows(words: DataFrame, windows: Column | int, other: bool) -> DataFrame:
    """words (word, n, size, d) with a row for each window: key, of what stands outside, and `at` and `of`, the window's number and
    how many there are. `size` is the length of the word that gives the chunks, d how much longer this one is."""
    w = words.withColumn("low", F.expr("cast(bigint(at) * size div of AS int)")).withColumn("high", F.expr("cast((bigint(at) + 1) * size div of AS int)")).where("low < high")
    return w.withColumn("key", F.xxhash64("size", "low", "high", F.expr("substr(word, 1, low)"), F.expr("substr(word, high + d + 1)")))


def _dealt(words: DataFrame, other: bool) -> DataFrame:
    shift = "explode(array(-1, 0, 1))" if other else "0"
    dealt = words.selectExpr("word", "n", f"{shift} AS d").selectExpr("word", "n", "length(word) - d AS size", "d", f"explode(sequence(0, {WINDOWS - 1})) AS at", f"{WINDOWS} AS of")
    return _rows(dealt, WINDOWS, other)


def _halved(rows: DataFrame) -> DataFrame:
    return _rows(rows.selectExpr("word", "n", "size", "d", "explode(array(2 * at, 2 * at + 1)) AS at", "2 * of AS of"), 0, False)


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b, n of b: all ordered pairs of `words` (word, n; distinct) at an edit distance of one."""
    chunks, grams = _dealt(words, False), _dealt(words, True)
    out, spent = None, []
    while True:
        held = chunks.groupBy("key").agg(F.count(F.lit(1)).alias("held"), F.max(F.col("high") - F.col("low")).alias("wide"))
        hot = settle(held.where((F.col("held") > TOGETHER) & (F.col("wide") > 1)).select("key"), "hot-chunks")
        some = not hot.isEmpty()
        cold = chunks.join(hot, "key", "left_anti") if some else chunks
        pairs = cold.select("key", F.col("word").alias("a")).join(grams.select("key", F.col("word").alias("b"), "n"), "key")
        pairs = settle(pairs.where("a <> b AND levenshtein(a, b, 1) = 1").select("a", "b", "n").distinct(), "near-words")
        out = pairs if out is None else out.unionByName(pairs)
        if some:
            chunks = settle(_halved(chunks.join(hot, "key", "left_semi")), "chunks")
            grams = settle(_halved(grams.join(hot, "key", "left_semi")), "grams")
        release(hot, *spent)  # not before what is halved has been read
        if not some:
            return out
        spent = [chunks, grams]


def roots(forms: DataFrame) -> DataFrame:
    """word, root of forms (word, form): the last of the forms that follow, by doubling the reach of each round. Forms are commoner
    than what they stand for, so none comes back to itself."""
    reach = settle(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        out = settle(reach.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        release(reach)
        reach = out.select("word", "root")
        vars(reach)["_settled_at"] = vars(out)["_settled_at"]
        if out.where("moved").isEmpty():
            return reach


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, drop: int | None = None, times: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n: see `vocabulary`. A word's form is its near word of largest n, ties to the first in
    code-point order, if that n is at least `times` (2 or more) the word's; root is where the forms that follow end.

    Null and empty texts have no words, long ones are read whole, repeated rows count again, an empty table has no words; columns
    besides doc_id and text are not read.
    """
    words = settle(vocabulary(docs, least_length, least_count, drop), "words")
    near = near_pairs(words).groupBy("a", "b").agg(F.first("n").alias("n")).groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "b")).alias("best"))
    found = words.join(near.withColumnRenamed("a", "word"), "word", "left").withColumn("best_n", -F.col("best.less"))
    fits = F.col("best_n") >= times * F.col("n")
    found = settle(found.select("word", F.when(fits, F.col("best.b")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best_n")).alias("form_n")), "forms")
    last = roots(found.where("form IS NOT NULL"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all whole documents, one in 97 runs with a code point less; nulls, ties and the rest as in `variants`."""
    return variants(load(spark, sf_dir, "documents"), drop=DROP)


OP11_SQL = r"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
e AS (SELECT doc_id, run, count(*) AS n, hex(encode(doc_id || ':' || run)) AS x FROM d GROUP BY doc_id, run),
f AS (SELECT run, n, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(x) // 2), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS h FROM e, crc),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM f) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
v AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS less FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
p AS (SELECT a.word AS a, b.word AS b, b.n FROM v a JOIN v b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM v a JOIN w b ON a.less = b.word UNION SELECT b.word, a.word, a.n FROM v a JOIN w b ON a.less = b.word),
g AS (SELECT a, count(*) AS n_near, max(n) AS most FROM p GROUP BY a),
q AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * w.n THEN most END AS form_n, CASE WHEN most >= 2 * w.n THEN (SELECT min(b) FROM p WHERE p.a = w.word AND p.n = most) END AS form FROM w LEFT JOIN g ON g.a = w.word),
r AS (SELECT word, word AS root FROM q UNION ALL SELECT r.word, q.form FROM r JOIN q ON r.root = q.word WHERE q.form IS NOT NULL),
l AS (SELECT r.word, r.root FROM r JOIN q ON r.root = q.word WHERE q.form IS NULL)
SELECT q.word, q.form, l.root, q.n, q.n_near, q.form_n FROM q JOIN l USING (word)
"""
