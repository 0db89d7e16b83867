"""Evidence spans, and packing of context within budgets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

def evidence_spans(questions: DataFrame, sources: DataFrame, good: float = 0.34, some: float = 0.18, most: int = 3) -> DataFrame:
    """query_id, n, at, ratio, sentence: each source's sentences that support the question by `good`, else its best by `some`; the
    best `most` of a source, in the source's order."""
    rows = sources.select("query_id", "n", F.posexplode(X.sentences(F.col("text"))).alias("at", "sentence")).join(questions.select("query_id", "query"), "query_id")
    rows = rows.withColumn("ratio", F.round(X.support(F.col("query"), F.col("sentence")), 6)).drop("query")
    w = W.partitionBy("query_id", "n").orderBy(F.desc("ratio"), "at")
    rows = rows.withColumn("place", F.row_number().over(w))
    return rows.where(((F.col("ratio") >= good) & (F.col("place") <= most)) | ((F.col("place") == 1) & (F.col("ratio") >= some))).drop("place")


def compress(text: str, query: str, budget: int) -> str:
    """Sentences that share most tokens with the query, as many as fit the budget, in their order."""
    import re

    if len(text) <= budget:
        return text
    words = lambda s: set(re.findall(r"[a-z0-9]+|[一-鿿]", s.lower()))
    parts = [p for p in re.split(r"(?<=[。！？!?；;])|(?<=\.)\s+|\n", text) if p.strip()]
    asked, room, kept = words(query), budget, []
    for i in sorted(range(len(parts)), key=lambda i: (-len(asked & words(parts[i])), i)):
        if len(parts[i]) + 1 <= room:
            kept.append(i)
            room -= len(parts[i]) + 1
    return " ".join(parts[i].strip() for i in sorted(kept)) or text[:budget]


def build_context(hits: DataFrame, per_chunk: int = 1500, total: int = 6000, least: int = 300) -> DataFrame:
    """query_id, context, used of hits (query_id, query, rank, filename, text): numbered sources, each compressed to per_chunk, until
    the total leaves fewer than `least` characters."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, room, used = [], total, 0
        for r in pdf.sort_values("rank").itertuples(index=False):
            head = f"[Source {used + 1}] {r.filename}\n"
            if room - len(head) < least and out:
                break
            body = compress(r.text or "", r.query or "", max(0, min(per_chunk, room - len(head))))
            out.append(head + body)
            used += 1
            room -= len(head) + len(body) + 2
        return pd.DataFrame([(pdf["query_id"].iloc[0], "\n\n".join(out), used)], columns=["query_id", "context", "used"])

    return hits.groupBy("query_id").applyInPandas(run, f"query_id {dict(hits.dtypes)['query_id']}, context string, used int")


def document_digest(chunked: DataFrame, chars: int = 3000, least: int = 120, most: int = 12, key: str = "doc_id") -> DataFrame:
    """key, digest, sampled: evenly spread chunks of each document, each clipped to max(chars / number, least), joined and clipped."""
    from .analytics import spread

    rows = spread(chunked, key, "chunk_index", most).withColumn("n", F.count(F.lit(1)).over(W.partitionBy(key)))
    each = F.greatest((F.lit(chars) / F.col("n")).cast("int"), F.lit(least))
    rows = rows.withColumn("part", F.substr("text", F.lit(1), each))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "part"))), lambda s: s["part"]), "\n")
    return rows.groupBy(key).agg(F.substring(joined, 1, chars).alias("digest"), F.count(F.lit(1)).alias("sampled"))
