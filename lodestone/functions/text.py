"""Text functions as Columns: tokens, cleaning, coverage, language, metadata patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"[\x{4e00}-\x{9fff}]"

#: Characters that cleaning removes, and those it turns into a space.
INVISIBLE = (
    r"[\x{0}-\x{8}\x{b}-\x{1f}\x{7f}-\x{9f}\x{ad}\x{61c}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180e}\x{200b}-\x{200f}\x{202a}-\x{202e}"
    r"\x{2060}-\x{206f}\x{3164}\x{fe00}-\x{fe0f}\x{feff}\x{ffa0}\x{e0001}\x{e0020}-\x{e007f}\x{e0100}-\x{e01ef}]"
)
SPACE_LIKE = r"[\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"
#: Fixed value: what tells most characters that are in neither class at once, before a class of many ranges is tried.
ODD = r"(?![ -~\n\x{c0}-\x{2ff}\x{3400}-\x{9fff}])"
#: Han characters that carry no content.
STOP_CHARS = (
    "的了是在和与及或也不很都就还而之其所以因为但如果虽然这那们个把被让使"
    "可将会能要且并则若此该我你他她它有无没太更最又再只才已正吗呢吧啊着过"
    "很一些什么怎样如何为何多少"
)
#: Fixed value: the start of a refusal.
REFUSAL = "抱歉，我在当前知识库中没有找到与这个问题足够相关的信息"


def tokens(text: Column) -> Column:
    """Runs of a-z0-9 of the lower-cased text, then Han runs as overlapping pairs (a single character alone)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    pairs = F.transform(
        F.regexp_extract_all(low, F.lit(CJK + "+"), F.lit(0)),
        lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))),
    )
    return F.concat(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0)), F.flatten(pairs))


def index_terms(text: Column, limit: int = 4000) -> Column:
    """Distinct tokens of the first `limit` characters in order: what the term index stores."""
    return F.array_distinct(tokens(F.substring(text, 1, limit)))


def query_terms(query: Column, limit: int = 64) -> Column:
    return F.slice(F.array_distinct(tokens(query)), 1, limit)


def content_terms(text: Column) -> Column:
    """Distinct a-z0-9 runs and Han characters other than STOP_CHARS."""
    t = F.coalesce(text, F.lit(""))
    chars = F.filter(F.regexp_extract_all(t, F.lit(CJK), F.lit(0)), lambda c: F.instr(F.lit(STOP_CHARS), c) == 0)
    return F.array_distinct(F.concat(F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9]+"), F.lit(0)), chars))


def share(part: Column, whole: Column, empty_whole: float, empty_part: float | None = 0.0) -> Column:
    """Share of `whole`'s entries in `part`; both hold distinct entries."""
    hit = F.size(F.array_intersect(whole, part)) / F.size(whole)
    return F.when(F.size(whole) == 0, F.lit(empty_whole)).otherwise(hit)


def coverage(query: Column, evidence: Column) -> Column:
    """Share of the query's content terms found in the evidence; 1 for a query without terms, 0 for evidence without."""
    return share(content_terms(evidence), content_terms(query), 1.0)


def support(sentence: Column, source: Column) -> Column:
    """Share of the sentence's tokens, each as often as it occurs, that the source holds; 0 for no tokens."""
    words, held = tokens(sentence), F.array_distinct(tokens(source))
    return F.when(F.size(words) == 0, F.lit(0.0)).otherwise(F.size(F.filter(words, lambda w: F.array_contains(held, w))) / F.size(words))


def clean(text: Column) -> Column:
    """Line ends to \\n, invisible characters dropped, space-like ones to a space, spaces and tabs before line ends dropped,
    white space at both ends dropped. Applying it again changes nothing."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    t = F.regexp_replace(t, ODD + INVISIBLE, "")
    t = F.regexp_replace(t, ODD + SPACE_LIKE, " ")
    # a run is tried from its begin only and never given back, so that long ones take linear time
    t = F.regexp_replace(t, r"(?=[ \t])(?<![ \t])[ \t]++(?=\n)", "")
    return F.btrim(t, F.lit(" \t\n\x0b\x0c\r\x85\u2028\u2029"))


def language(text: Column) -> Column:
    """zh, en or mixed by the share of Han characters among them and Latin words of three or more, over 4000 characters."""
    head = F.substring(text, 1, 4000)
    han, latin = F.regexp_count(head, F.lit(CJK)), F.regexp_count(head, F.lit(r"[A-Za-z][A-Za-z0-9\-_.]{2,}"))
    ratio = han / (han + latin)
    return F.when((F.trim(F.coalesce(head, F.lit(""))) == "") | (han + latin == 0), "zh").when(ratio >= 0.75, "zh").when(ratio <= 0.15, "en").otherwise("mixed")


def sentences(text: Column) -> Column:
    """Pieces that end after 。！？!?; or a full stop before white space, or at a line end; blank ones dropped."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?<=[。！？!?；;])|(?<=\.)(?=\s)|\n")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def years(text: Column) -> Column:
    """All 20xx years that stand alone among digits, as ints."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?<!\d)(20\d{2})(?!\d)"), F.lit(1)), lambda y: y.cast("int"))


def iso_date(text: Column) -> Column:
    """ISO date of the first full date of the head, else of the first year and month, else of the first lone year."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, 3000)
    ymd = r"(20\d{2})\s*[-/年]\s*(\d{1,2})\s*[-/月]\s*(\d{1,2})\s*日?"
    ym = r"(20\d{2})\s*[-/年]\s*(\d{1,2})\s*月?"
    y = r"(?:^|[^\d])(20\d{2})(?:[^\d]|$)"

    def part(p: str, i: int, most: int) -> Column:
        v = F.regexp_extract(head, p, i).cast("int")
        return F.lpad(F.when((v >= 1) & (v <= most), v).otherwise(1).cast("string"), 2, "0")

    return (
        F.when(head.rlike(ymd), F.concat_ws("-", F.regexp_extract(head, ymd, 1), part(ymd, 2, 12), part(ymd, 3, 31)))
        .when(head.rlike(ym), F.concat_ws("-", F.regexp_extract(head, ym, 1), part(ym, 2, 12), F.lit("01")))
        .when(head.rlike(y), F.concat(F.regexp_extract(head, y, 1), F.lit("-01-01")))
    )


def title(text: Column, stem: Column) -> Column:
    """The first level-1 heading, else the first of 30 lines of 4 to 120 characters that starts no table, fence or list, else
    the file's stem; 200 characters at most."""
    t = F.coalesce(text, F.lit(""))
    h1 = F.trim(F.regexp_extract(t, r"(?m)^#[ \t]+(\S.*?)[ \t]*$", 1))
    lines = F.transform(F.slice(F.split(F.regexp_replace(t, r"^\s+", ""), "\n"), 1, 30), lambda s: F.trim(F.regexp_replace(F.trim(s), r"^#+", "")))
    fit = F.filter(lines, lambda s: F.length(s).between(4, 120) & ~s.rlike(r"^(\||```|-|\*)"))
    return F.substring(F.when(h1 != "", h1).otherwise(F.coalesce(F.get(fit, F.lit(0)), F.when(stem != "", stem), F.lit("未命名文档"))), 1, 200)


def doc_number(text: Column) -> Column:
    found = F.regexp_extract(text, r"[\x{4e00}-\x{9fff}]{1,6}[字发〔\[（(]\s*(20\d{2})\s*[〕\]）)]\s*第?\s*(\d{1,4})\s*号", 0)
    return F.when(found != "", found)


def has_table(text: Column) -> Column:
    """Two or more consecutive lines that start and end with a pipe."""
    return text.rlike(r"(?m)^[ \t]*\|.*\|[ \t]*\n[ \t]*\|.*\|[ \t]*$")


def line_at(text: Column, at: Column) -> Column:
    """1-based line of the character at offset `at`."""
    head = F.substr(text, F.lit(1), at)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def is_refusal(answer: Column) -> Column:
    return F.coalesce(F.instr(F.substring(F.trim(answer), 1, 80), REFUSAL[:20]) > 0, F.lit(False))


def is_identifier(query: Column) -> Column:
    """18 characters at most, letters with digits in one code, six Han characters at most."""
    q = F.trim(query)
    return (F.length(q) <= 18) & q.rlike(r"(?i)(?=[a-z0-9_-]*[a-z])(?=[a-z0-9_-]*\d)[a-z0-9_-]{3,}") & (F.regexp_count(q, F.lit(CJK)) <= 6)


def drift_ok(original: Column, changed: Column, least: float = 0.3) -> Column:
    """Whether a rewritten query keeps enough tokens of the original (over the smaller set) and holds each of its numbers somewhere.
    A blank rewriting fails; an original without tokens passes."""
    a, b = F.array_distinct(tokens(original)), F.array_distinct(tokens(changed))
    both, small = F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))
    numbers = F.regexp_extract_all(original, F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    kept = (small > 0) & (both >= least * small) & F.forall(numbers, lambda n: F.contains(changed, n))
    return F.when(F.trim(F.coalesce(changed, F.lit(""))) == "", False).when(F.size(a) == 0, True).otherwise(F.coalesce(kept, F.lit(False)))


#: Why evidence is doubted.
DOUBTS = {
    "review": "解析期已标记「需人工复核」，内容准确性未确认",
    "quality": "解析质检未通过：",
    "engine": "未记录产出引擎（疑似降级路径或旧索引）",
    "confidence": "解析置信度偏低（%.2f）",
    "ocr": "OCR 行置信度不达标，可能读错数字或字母",
    "short": "正文过短（%d 字），不足以支撑结论",
}


def trust(text: Column, is_image: Column, engine: Column, confidence: Column, review: Column, quality_ok: Column, ocr_ok: Column, quality_reasons: Column | None = None) -> Column:
    """struct(score, reasons): the product of penalties for doubtful evidence, within 0.05 and 1, and what was found wanting. A
    confidence of 0.6 or more lowers the score without a reason; of the failed checks' reasons the first three count."""
    no, conf = F.lit(False), F.coalesce(confidence, F.lit(0.0))
    chars = F.length(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r\x0b\x0c\u3000\xa0")))
    reviewed, failed, image = F.coalesce(review, no), F.coalesce(~quality_ok, no), F.coalesce(is_image, no)
    unnamed, misread = image & (F.coalesce(engine, F.lit("")) == ""), image & F.coalesce(~ocr_ok, no)
    factor = lambda holds, by: F.when(holds, by).otherwise(1.0)
    sure = F.when(image & (conf > 0), 0.5 + 0.5 * F.least(conf, F.lit(1.0))).otherwise(1.0)
    score = factor(reviewed, 0.45) * factor(failed, 0.70) * factor(unnamed, 0.85) * sure * factor(misread, 0.75) * factor(chars < 20, 0.60)
    said = F.lit(None).cast("array<string>") if quality_reasons is None else quality_reasons
    checks = F.transform(F.filter(F.slice(F.coalesce(said, F.array().cast("array<string>")), 1, 3), lambda r: F.trim(r) != ""), lambda r: F.concat(F.lit(DOUBTS["quality"]), r))
    why = F.concat(
        F.array(F.when(reviewed, DOUBTS["review"])), F.when(failed, checks).otherwise(F.array().cast("array<string>")),
        F.array(
            F.when(unnamed, DOUBTS["engine"]), F.when(image & (conf > 0) & (conf < 0.6), F.format_string(DOUBTS["confidence"], conf.cast("double"))),
            F.when(misread, DOUBTS["ocr"]), F.when(chars < 20, F.format_string(DOUBTS["short"], chars)),
        ),
    )
    return F.struct(F.greatest(F.lit(0.05), F.least(F.lit(1.0), score)).alias("score"), F.array_compact(why).alias("reasons"))


def trust_weighted(score: Column, trusted: Column, weight: float = 0.15) -> Column:
    """The score by its trust (a struct of `trust`), lowered only where there is a reason to."""
    w = max(0.0, min(1.0, weight))
    return F.when(F.size(trusted["reasons"]) > 0, score * (1 - w + w * F.greatest(F.lit(0.0), F.least(F.lit(1.0), trusted["score"])))).otherwise(score)
