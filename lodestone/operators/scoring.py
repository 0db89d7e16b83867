"""Scores of answers by rules, and the documents that a request to summarise is about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Words of a refusal, of doubt, what a refusal must not state, what contradicts a conflict, and what withdraws an answer.
REFUSALS, DOUBTS = ["无法", "不足", "未找到", "未检索", "没有相关"], ["无法确定", "无法唯一确定", "不能确定", "无法判断", "需核实", "需要核实", "有待核实"]
STATED = r"(?:\d+(?:\.\d+)?|[一二三四五六七八九十]+)(?:万元|元|瓦|天|年)"
SETTLED, WITHDRAWN = "(?:没有|不存在|未发现|无)冲突|最终(?:预算|金额)(?:为|是)", "(?:无法|不能)(?:确定|判断|确认)|证据不足|没有相关|没有找到|未(?:找到|检索到)|需要核实"
AMOUNT, UNIT_NUMBER = r"\d+(?:\.\d+)?万元", r"\d+(?:\.\d+)?(?:万元|瓦|天|年)"

#: Words that name no document, what may name one, what only points, ordinals, what takes in a whole library.
EMPTY_WORDS = ["知识库", "文档库", "资料库", "库里", "库中", "库内", "帮我", "请", "一下", "一份", "几份", "的", "里", "中", "文档", "文件", "资料", "报告", "材料", "附件"]
QUOTED = r"[《「『“\"']([^》」』”\"'\n]{2,80})[》」』”\"']"
FILE = r"(?iU)([\w\x{4e00}-\x{9fa5}][\w\x{4e00}-\x{9fa5} \-_.·]{0,60}\.(?:pdf|docx?|xlsx?|pptx?|md|txt|csv))"
BEFORE_NOUN = r"([0-9a-z\x{4e00}-\x{9fa5}][0-9a-z\x{4e00}-\x{9fa5} \-_.·]{1,40}?)[ \t]*(?:文档|文件|资料|报告|材料|附件|手册|纪要|方案|合同|简历|笔记)"
AFTER_VERB = r"(?i)(?:总结|概括|概述|综述|摘要|提炼|归纳|梳理)(?:一下|下|一遍)?[：:，,、\s]*([0-9a-z\x{4e00}-\x{9fa5}][0-9a-z\x{4e00}-\x{9fa5} \-_.·、/]{3,60})"
POINTING, ORDINAL = r"^第\s*[0-9一二三四五六七八九十百]+\s*[章节页条部分段图表篇]", r"第\s*([0-9一二三四五六七八九十]{1,3})\s*[份个条篇册]"
WHOLE = "所有|全部|这些|那些|这批|整个|各个|每[一个份]|全库|整库|知识库|文档库|资料库|库[里中内的]|这[份个]|那[份个]|该文档|此文档|本文档"
DIGITS = "零一二三四五六七八九"
#: Coverage from which a name is met, how far below the best others are kept, what a match of the whole query is worth, the least length of
#: a weak hint, and the largest ordinal there is.
MET, BAND, LOOSE, WEAK_LEAST, LAST = 0.6, 0.1, 0.9, 4, 999


def _bare(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")


def _alone(value: Column) -> Column:
    """The pattern of a value that does not go on a number."""
    return F.concat(F.lit(r"(?<!\d)\Q"), value, F.lit("\\E"))


def answer_scores(rows: DataFrame) -> DataFrame:
    """rows (case_id, answer, truth, kind, evidence, done, error) with case_id, numeric_match (null if the truth holds no number with a
    unit) and correct.

    kind: refusal (nothing may be stated), conflict (doubt is said and all amounts of the evidence, an array of texts, are named, two
    at least), else the truth must stand in the answer, not within a longer number, and nothing may withdraw it. White space counts
    for nothing. An answer that is not done or failed is wrong.
    """
    bare, truth = _bare(F.col("answer")), _bare(F.col("truth"))
    any_of = lambda words: F.lit(False) if not words else F.greatest(*[bare.contains(w) for w in words])
    refusal = any_of(REFUSALS) & ~bare.rlike(STATED)
    amounts = F.array_distinct(F.flatten(F.transform(F.coalesce("evidence", F.array().cast("array<string>")), lambda t: F.regexp_extract_all(t, F.lit(AMOUNT), F.lit(0)))))
    conflict = any_of(DOUBTS) & (F.size(amounts) >= 2) & F.forall(amounts, lambda a: F.regexp_like(bare, _alone(a))) & ~bare.rlike(SETTLED)
    pattern = F.concat(F.when(truth.rlike(r"^\d"), r"(?<!\d)").otherwise(""), F.lit("\\Q"), truth, F.lit("\\E"), F.when(truth.rlike(r"\d$"), r"(?!\d)").otherwise(""))
    literal = F.regexp_like(bare, pattern) & ~bare.rlike(WITHDRAWN)
    numbers = F.regexp_extract_all(F.coalesce("truth", F.lit("")), F.lit(UNIT_NUMBER), F.lit(0))
    numeric = F.when(F.size(numbers) > 0, F.forall(numbers, lambda n: F.regexp_like(bare, _alone(n))))
    right = F.when(F.col("kind") == "refusal", refusal).when(F.col("kind") == "conflict", conflict).otherwise(literal)
    right = F.coalesce(right, F.lit(False)) & F.coalesce("done", F.lit(False)) & (F.coalesce("error", F.lit("")) == "") & F.coalesce(numeric, F.lit(True))
    return rows.select("case_id", numeric.alias("numeric_match"), right.alias("correct"))


def plain(text: Column) -> Column:
    """Lower-case ASCII letters, digits and Han characters only."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^0-9a-z\x{4e00}-\x{9fa5}]+", "")


def ordinal(query: Column) -> Column:
    """The number of a query that asks for the n-th document, in digits or Chinese numerals up to 99; null for none."""
    raw = F.regexp_extract(query, ORDINAL, 1)
    digit = lambda c: F.greatest(F.instr(F.lit(DIGITS), c) - 1, F.lit(0))
    tens, ones = F.substring_index(raw, "十", 1), F.substring_index(raw, "十", -1)
    value = (
        F.when(raw.rlike(r"^\d+$"), raw.cast("int")).when(raw.contains("十"), F.when(tens == "", 1).otherwise(digit(F.substring(tens, 1, 1))) * 10 + F.when(ones == "", 0).otherwise(digit(F.substring(ones, 1, 1))))
        .otherwise(digit(raw))
    )
    return F.when((raw != "") & (value > 0), value)


def name_hints(query: Column) -> Column:
    """struct(strong, weak): what may name a document, without marks. Strong: quoted, a file's name, what stands before a word for a
    document; weak: what follows the verb, if it is long enough and does not merely point."""

    def meant(raw: Column) -> Column:
        for w in EMPTY_WORDS:
            raw = F.replace(raw, F.lit(w), F.lit(""))
        return F.btrim(raw, F.lit(" -_.·"))

    found = lambda p: F.regexp_extract_all(query, F.lit(p), F.lit(1))
    filled = lambda a: F.array_distinct(F.filter(F.transform(a, plain), lambda h: h != ""))
    strong = filled(F.concat(found(QUOTED), found(FILE), F.transform(found(BEFORE_NOUN), meant)))
    weak = filled(F.filter(F.transform(found(AFTER_VERB), meant), lambda h: (F.length(h) >= WEAK_LEAST) & ~h.rlike(POINTING)))
    return F.struct(strong.alias("strong"), F.array_except(weak, strong).alias("weak"))


def summary_targets(queries: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(targets, verdicts) of queries (query_id, query), a stated set, over documents (doc_id, filename, at: their order).

    targets: query_id, doc_id, score of the documents a query names: those whose name's parts its hints cover by MET and within BAND of
    the best; if none, the n-th document where it asks for one (score null). verdicts: query_id, targets, missing: something was
    named that there is not. Queries meet documents in place, as a broadcast list; the best score is one maximum a query.
    """
    asked = queries.select("query_id", "query", name_hints(F.col("query")).alias("h"), ordinal(F.col("query")).alias("ordinal"), plain(F.col("query")).alias("all"))
    asked = asked.withColumn("hints", F.concat("h.strong", "h.weak"))
    stem = F.regexp_replace(F.trim("filename"), r"(?i)\.[a-z0-9]{1,6}$", "")
    names = documents.select("doc_id", "at", plain(F.col("filename")).alias("full"), plain(stem).alias("stem"), F.filter(F.regexp_extract_all(F.lower(stem), F.lit(r"[a-z0-9]+|[\x{4e00}-\x{9fa5}]+"), F.lit(0)), lambda t: F.length(t) >= 2).alias("parts"))
    sized = lambda a: F.aggregate(a, F.lit(0), lambda s, t: s + F.length(t))
    names = names.withColumn("letters", sized(F.col("parts")))
    covered = lambda text: F.when(F.col("letters") > 0, sized(F.filter("parts", lambda t: F.contains(text, t))) / F.col("letters")).otherwise(0.0)
    rows = names.join(F.broadcast(asked.where(F.size("hints") > 0)))  # a stated list of queries
    by_hint = F.coalesce(F.array_max(F.transform("hints", covered)), F.lit(0.0))
    exact = (F.col("stem") != "") & (F.contains("all", F.col("stem")) | F.contains("all", F.col("full")))
    best = F.when(exact, 1.0).when(by_hint >= MET, by_hint).otherwise(F.greatest(by_hint, covered(F.col("all")) * LOOSE))
    rows = rows.select("query_id", "doc_id", F.round(best, 9).alias("score")).where(F.col("score") >= MET)
    top = rows.groupBy("query_id").agg(F.max("score").alias("top"))
    named = rows.join(top, "query_id").where(F.col("score") >= F.greatest(F.lit(MET), F.round(F.col("top") - BAND, 9))).drop("top")
    first = documents.select("doc_id", "at").orderBy("at").limit(LAST).withColumn("ordinal", F.row_number().over(W.orderBy("at")))  # LAST rows
    numbered = asked.where("ordinal IS NOT NULL").join(top.select("query_id"), "query_id", "left_anti").join(F.broadcast(first), "ordinal").select("query_id", "doc_id", F.lit(None).cast("double").alias("score"))
    targets = named.unionByName(numbered)
    n = targets.groupBy("query_id").agg(F.count(F.lit(1)).alias("targets"))
    out = asked.join(n, "query_id", "left").withColumn("targets", F.coalesce("targets", F.lit(0)))
    lost = (F.col("targets") == 0) & (F.col("ordinal").isNotNull() | ((F.size("h.strong") > 0) & ~F.col("query").rlike(WHOLE)))
    return targets, out.select("query_id", "targets", lost.alias("missing"))
