"""Cleaning of whole extractions: pages are cleaned one by one and their spans follow the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from . import security as S

#: Characters from which a text must keep a tenth of its length, or cleaning is given up.
LONG, LEAST_SHARE = 256, 0.1


def fold_spaces(text: Column) -> Column:
    """Runs of spaces and tabs as one space, but not within fenced code. Loses indentation, so nothing calls it unasked."""
    mark = "\uffff"  # no character
    parts = F.split(F.regexp_replace(text, r"(?md)^[^\S\n]*(?:```|~~~)[^\n]*$", f"{mark}$0{mark}"), mark)
    # outside, fence, inside, fence, outside and so on
    return F.array_join(F.transform(parts, lambda s, i: F.when(i % 4 == 0, F.regexp_replace(s, r"[ \t]{2,}", " ")).otherwise(s)), "")


def clean_extraction(docs: DataFrame, pages: DataFrame, key: str = "doc_id", settle=lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(documents, pages) after cleaning and masking of commands.

    docs: key, text. pages: key, page, char_start, char_end, text, spans of the document's text. Documents come back with text, masked
    (paragraphs), rules, changed and intact; pages with the spans where their cleaned texts now lie, which are running sums of the
    gaps, kept as they are, and of the cleaned lengths before them. A document is left alone (intact is false) if it has no text or
    no page, if its spans overlap, go back or leave the text, if its pages hold no text though it does, or if a long text would lose
    nine tenths. Nothing but a document's own pages meets in one task, where they meet its text once, however many they are. settle:
    stores what both results are read from, so that pages are cleaned once.
    """
    blank = F.lit(" \t\n\r\x0b\x0c")
    size = F.length("full")
    rows = pages.select(key, "page", "char_start", "char_end", F.coalesce("text", F.lit("")).alias("own")).withColumn("tidy", X.clean(F.col("own")))
    rows = rows.select(key, "page", "char_start", "char_end", (F.btrim("own", blank) != "").alias("filled"), S.masked(F.col("tidy")).alias("m"))
    rows = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("char_start", "page", "char_end", "filled", F.col("m.text").alias("body"), "m.masked", "m.rules"))).alias("ps"))
    whole = docs.select(key, F.coalesce("text", F.lit("")).alias("full")).join(rows, key, "left")
    past = lambda i: F.when(i == 0, 0).otherwise(F.coalesce(F.get("ps", i - 1)["char_end"], F.lit(0)))
    bad = F.exists(F.transform("ps", lambda p, i: (p["char_start"] < past(i)) | (p["char_end"] > size) | (p["char_end"] < p["char_start"])), lambda b: F.coalesce(b, F.lit(True)))
    gap = lambda p, i: F.when(p["char_start"] > past(i), F.substr("full", past(i) + 1, p["char_start"] - past(i))).otherwise("")
    whole = whole.withColumns({"bad": bad, "filled": F.exists("ps", lambda p: p["filled"]), "gaps": F.transform("ps", gap)})
    pieces = F.array_join(F.transform("ps", lambda p, i: F.concat(F.get("gaps", i), p["body"])), "")
    whole = whole.withColumn("made", F.concat(pieces, F.substr("full", F.array_max(F.transform("ps", lambda p: p["char_end"])) + 1)))
    lost = (size >= LONG) & (F.length("made") < size * LEAST_SHARE)
    whole = whole.withColumn("intact", F.coalesce((size > 0) & ~F.col("bad") & (F.col("filled") | (F.btrim("full", blank) == "")) & ~lost, F.lit(False)))
    kept = lambda c, other: F.when(F.col("intact"), c).otherwise(other)
    marks = F.transform("ps", lambda p, i: F.struct(p["page"].alias("page"), p["char_start"].alias("a"), p["char_end"].alias("b"), F.length(F.get("gaps", i)).alias("gap"), F.length(p["body"]).alias("long")))
    whole = settle(whole.select(
        key, kept(F.col("made"), F.col("full")).alias("text"), kept(F.aggregate("ps", F.lit(0), lambda n, p: n + p["masked"]), F.lit(0)).alias("masked"),
        kept(F.array_distinct(F.flatten(F.transform("ps", lambda p: p["rules"]))), F.array().cast("array<string>")).alias("rules"), (F.col("intact") & (F.col("made") != F.col("full"))).alias("changed"), "intact", marks.alias("marks"),
    ))
    held = whole.select(key, "intact", F.posexplode("marks").alias("at", "k")).select(key, "intact", "at", "k.*")
    ended = F.sum(F.col("gap") + F.col("long")).over(W.partitionBy(key).orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    spans = held.withColumn("ended", ended).select(
        key, "page", kept(F.col("ended") - F.col("long"), F.col("a")).cast("int").alias("char_start"), kept(F.col("ended"), F.col("b")).cast("int").alias("char_end"),
    )
    return whole.drop("marks"), spans


def cut(documents: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """documents with cuts, an array of struct(page, char_start, char_end, own): what each span cuts out of the text. Spans meet their
    text once."""
    held = spans.groupBy(key).agg(F.collect_list(F.struct("page", "char_start", "char_end")).alias("spans"))
    own = lambda s: F.substr("text", s["char_start"] + 1, s["char_end"] - s["char_start"])
    rows = documents.join(held, key)
    return rows.withColumn("cuts", F.transform("spans", lambda s: F.struct(s["page"].alias("page"), s["char_start"].alias("char_start"), s["char_end"].alias("char_end"), own(s).alias("own")))).drop("spans")
