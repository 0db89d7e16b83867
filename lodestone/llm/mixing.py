"""Mixing sources to target weights by a temperature on their token shares.

A source's weight is its share of the tokens to the power a, normalised. With a = 1 sources keep their shares, towards
a = 0 they become equal. a is bisected (33 exponents a pass, each pass one aggregation over the table of sources) to meet a
target entropy of the weights, or to be the least that repeats no source more than `most_repeats` times. The weights are then
realised as budgeted blocks: each repeat of a source is one block, a permutation of its documents by a hash, and the last
block is cut where its tokens would exceed what the budget leaves. The cut is a hash value per source, found from token sums
over ranges of the hash, so documents are chosen in a scan and their texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import load, settle, text_of

MOST_REPEATS = 2.0
SEED = "mix"
#: Sources up to this number are broadcast (under 10 MB); a larger table of sources is joined by shuffle.
BROADCAST_SOURCES = 50_000
_WIDTH, _PASSES = 33, 9


def tokens_of(text: Column) -> Column:
    """Runs of characters other than ASCII white space, plus 1 for the closing token."""
    return (F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long")


def key_of(seed: str) -> Column:
    """A document's place in its source's permutation: 60 bits of a hash of the seed and doc_id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def source_of() -> Column:
    """The source, a null one apart from all others."""
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))


def exponent(sources: DataFrame, entropy: float | None, most_repeats: float) -> float:
    """The exponent in [0, 1] for a table of (src, tokens); 1 for an empty one.

    With `entropy` (in nats) the one whose weights have it, or the nearest bound where none does; else the least whose
    largest repeat, relative to the source repeated least, is at most most_repeats.
    """
    stat = sources.agg(F.sum("tokens").alias("total"), F.max("tokens").alias("most"), F.min("tokens").alias("least")).first()
    if not stat["total"]:
        return 1.0
    x = F.ln(F.col("tokens") / F.lit(float(stat["most"])))  # shares relative to the largest: no overflow
    low, high = 0.0, 1.0

    def meets(values: list[float]) -> list[bool]:
        sums = sources.agg(*[F.sum(F.exp(x * a)).alias(f"z{i}") for i, a in enumerate(values)], *[F.sum(F.exp(x * a) * x * a).alias(f"s{i}") for i, a in enumerate(values)], F.min(x).alias("x")).first()
        if entropy is None:  # repeats are (tokens / most) ** (a - 1), largest for the smallest source
            from math import exp

            return [exp(sums["x"] * (a - 1)) <= most_repeats for a in values]
        from math import log

        return [log(sums[f"z{i}"]) - sums[f"s{i}"] / sums[f"z{i}"] <= entropy for i in range(len(values))]

    for _ in range(_PASSES):  # false below the exponent sought, true from it on
        values = [low + (high - low) * i / (_WIDTH - 1) for i in range(_WIDTH)]
        met = meets(values)
        if met[0]:
            return values[0]
        if not met[-1]:
            return values[-1]
        at = met.index(True)
        low, high = values[at - 1], values[at]
        if high - low < 1e-14:
            break
    return high


def weigh(docs: DataFrame, entropy: float | None = None, most_repeats: float = MOST_REPEATS, budget: int | None = None, seed: str = SEED) -> DataFrame:
    """A row per source: src, tokens, weight, repeats, whole (full blocks) and cut (the last block's largest hash, or null).

    budget: tokens of the mix; by default what shows the source repeated least exactly once, so that no document is left out.
    """
    base = settle(docs.select(source_of().alias("src"), tokens_of(text_of()).alias("n"), key_of(seed).alias("key")), "mix-base")
    sources = settle(base.groupBy("src").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("docs")), "mix-sources")
    a = exponent(sources, entropy, most_repeats)
    stat = sources.agg(F.max("tokens").alias("most"), F.sum("docs").alias("docs")).first()
    most = float(stat["most"] or 1)
    relative = F.pow(F.col("tokens") / most, F.lit(a))
    norm = sources.agg(F.sum(relative)).first()[0] or 1.0
    per_weight = most * norm if budget is None else float(budget)  # tokens for a weight of 1
    sources = (
        sources.withColumn("weight", relative / norm).withColumn("repeats", F.round(F.col("weight") * per_weight / F.col("tokens"), 9))
        .withColumn("whole", F.floor("repeats").cast("long")).withColumn("left", F.floor((F.col("repeats") - F.col("whole")) * F.col("tokens")).cast("long"))
    )
    cells = min(65_536, max(1, (stat["docs"] or 0) // 4096))
    width = (1 << 60) // cells + 1
    dealt = base.withColumn("cell", F.expr(f"key div {width}"))
    cut = sources.where("left > 0").select("src", "left")
    sums = dealt.groupBy("src", "cell").agg(F.sum("n").alias("n"), F.max("key").alias("last"))
    upto = F.sum("n").over(W.partitionBy("src").orderBy("cell").rowsBetween(W.unboundedPreceding, 0))
    sums = sums.withColumn("upto", upto).join(cut, "src")
    full = sums.where("upto <= left").groupBy("src").agg(F.max("last").alias("full"))
    edge = sums.where("upto > left and upto - n <= left").select("src", "cell", (F.col("left") - F.col("upto") + F.col("n")).alias("room"))
    within = F.sum("n").over(W.partitionBy("src", "cell").orderBy("key").rangeBetween(W.unboundedPreceding, 0))
    part = dealt.join(edge, ["src", "cell"]).withColumn("upto", within).where("upto <= room").groupBy("src").agg(F.max("key").alias("part"))
    found = sources.join(full, "src", "left").join(part, "src", "left")
    return settle(found.select("src", "tokens", "weight", "repeats", "whole", F.greatest("full", "part").alias("cut")), "mix-weights")


def mix(docs: DataFrame, entropy: float | None = None, most_repeats: float = MOST_REPEATS, budget: int | None = None, seed: str = SEED) -> DataFrame:
    """docs with each row repeated as its source's weight asks, and mix_epoch, mix_weight, mix_key added.

    mix_epoch counts a row's repeats from 0; sorting by mix_key (0 to about 1) interleaves the sources at their weights. Rows with
    the same doc_id and source are taken or left together in the last block. A null source is a source of its own, a null or
    empty text has one token. Columns of docs named like the added ones are replaced; an empty table gives an empty result.
    """
    weights = weigh(docs, entropy, most_repeats, budget, seed)
    weights = weights.select(F.col("src").alias("__src"), F.col("weight").alias("__weight"), F.col("repeats").alias("__repeats"), F.col("whole").alias("__whole"), F.col("cut").alias("__cut"))
    if weights.count() <= BROADCAST_SOURCES:
        weights = F.broadcast(weights)
    kept = docs.drop("mix_epoch", "mix_weight", "mix_key")
    rows = kept.withColumn("__src", source_of()).withColumn("__key", key_of(seed)).join(weights, "__src")
    times = F.col("__whole") + F.when(F.col("__key") <= F.col("__cut"), 1).otherwise(0)
    rows = rows.withColumn("__times", times).where("__times > 0").withColumn("mix_epoch", F.explode(F.expr("sequence(0L, __times - 1)")))
    key = (F.col("mix_epoch") + F.col("__key") / float(1 << 60)) / F.greatest(F.col("__repeats"), F.lit(1e-9))
    return rows.withColumn("mix_weight", F.col("__weight")).withColumn("mix_key", key).drop("__src", "__key", "__weight", "__repeats", "__whole", "__cut", "__times")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document and repeat: doc_id, source, tokens, mix_epoch, mix_weight, mix_key."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = mix(docs)
    return out.select("doc_id", "source", tokens_of(text_of()).alias("tokens"), "mix_epoch", F.round("mix_weight", 9).alias("mix_weight"), F.round("mix_key", 9).alias("mix_key"))


OP10_SQL = r"""
WITH b AS (SELECT doc_id, source, coalesce('=' || source, 'null') AS src, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1 AS tokens,
                  ('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS k FROM documents),
s AS (SELECT src, sum(tokens)::DOUBLE AS t FROM b GROUP BY src),
m AS (SELECT max(t) AS most, min(t) AS least FROM s),
a AS (SELECT most, CASE WHEN most / least <= 2 THEN 0 ELSE 1 - ln(2) / ln(most / least) END AS a FROM m),
w AS (SELECT src, t, pow(t / most, a) / sum(pow(t / most, a)) OVER () AS weight, round(pow(t / most, a - 1), 9) AS repeats FROM s, a),
q AS (SELECT *, floor(repeats) AS whole, floor((repeats - floor(repeats)) * t) AS rest FROM w),
c AS (SELECT b.*, q.weight, q.repeats, q.whole, q.rest, sum(b.tokens) OVER (PARTITION BY b.src ORDER BY b.k RANGE UNBOUNDED PRECEDING) AS upto FROM b JOIN q USING (src)),
n AS (SELECT *, unnest(range(CAST(whole AS BIGINT) + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)) AS mix_epoch FROM c)
SELECT doc_id, source, tokens, mix_epoch, round(weight, 9) AS mix_weight,
       round((mix_epoch + k / 1152921504606846976.0) / greatest(repeats, 1e-9), 9) AS mix_key
FROM n
"""
