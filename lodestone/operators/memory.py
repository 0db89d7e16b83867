"""What users ask to be remembered: found in their words, kept in a versioned table, laid into a context within budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Kinds, the longest memory, how many are laid into a context, and the length within which a request is looked for.
KINDS, DEFAULT, MOST_CHARS, MOST_LAID, HEAD = ["preference", "glossary", "note", "constraint"], "note", 200, 8, 120
#: Requests in the order they are tried and the kind of each; what makes a note a term; where a request ends.
REQUESTS = [
    (r"记住\s*[:：,，]?\s*(.+)", "note"), (r"请记住\s*[:：,，]?\s*(.+)", "note"), (r"(以后(?:都|一律|全部|统一)?\s*(?:用|按|使用|采用|称为|叫|写作)\s*.+)", "preference"),
    (r"(?:请)?(永远(?:不要|别|要|都)\s*.+)", "preference"), (r"(?i)remember\s+(?:that\s+)?(.+)", "note"), (r"(?i)from now on[,，]?\s*(.+)", "preference"),
]
TERM, CLAUSE_END, TRIMMED = "称为|叫做|简称|缩写|术语|叫作", r"[。！!；;\n]", " \t\r\n。；;，,"
#: What is never remembered.
COMMANDS = (
    r"(?i)忽略(?:之前|以上|上述|前面|所有)的?(?:指令|提示|要求|设定)|ignore\s+(?:all\s+)?(?:previous|above|prior)\s+instructions|system\s*prompt|系统提示词?|"
    r"你现在是|你现在扮演|扮演一个|you\s+are\s+now|<\|.*?\|>|BEGIN\s+SYSTEM"
)
SECRETS = r"(?i)sk-[A-Za-z0-9]{16,}|AKIA[0-9A-Z]{12,}|ghp_[A-Za-z0-9]{20,}|password\s*[=:]\s*\S+|passwd\s*[=:]\s*\S+|-----BEGIN [A-Z ]*PRIVATE KEY-----"
#: Heads of the layers, and how speakers are named.
MEMORY_HEAD, DIGEST_HEAD, USER, HELPER = "用户已确认的长期设定（仅影响口径与表达）：", "更早的提问（按时间顺序）：", "用户：", "助手："
DIGEST_TURNS, SNIPPET = 6, 120


def _let(value: Column, then) -> Column:
    """then(value) with the value computed once, however often `then` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def kind_of(kind: Column) -> Column:
    k = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    return F.when(k.isin(KINDS), k).otherwise(DEFAULT)


def sanitized(text: Column) -> Column:
    """The text on one line without control characters, null if it is not fit to be kept: too short or long, a command, a secret."""
    t = F.regexp_replace(F.regexp_replace(text, r"[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{7f}]", ""), r"(?U)\s+", " ")
    return _let(F.btrim(t, F.lit(TRIMMED)), lambda t: F.when(F.length(t).between(2, MOST_CHARS) & ~t.rlike(COMMANDS) & ~t.rlike(SECRETS), t))


def requested(query: Column) -> Column:
    """struct(kind, content) of what a query asks to be remembered, null for nothing. The first pattern found counts, up to the
    end of its clause; a clause that asks something is no request."""

    def found(head: Column) -> Column:
        tries = F.array(*[F.struct(F.lit(kind).alias("kind"), F.get(F.regexp_extract_all(head, F.lit(pattern), F.lit(1)), F.lit(0)).alias("raw")) for pattern, kind in REQUESTS])
        return F.get(F.filter(tries, lambda t: t["raw"].isNotNull()), F.lit(0))

    def kept(first: Column) -> Column:
        content = _let(F.split(first["raw"], CLAUSE_END, 2)[0], lambda clause: F.when(~clause.rlike("[？?]"), sanitized(clause)))
        return _let(content, lambda c: F.when(c.isNotNull(), F.struct(F.when((first["kind"] == "note") & c.rlike(TERM), "glossary").otherwise(first["kind"]).alias("kind"), c.alias("content"))))

    return _let(found(F.substring(query, 1, HEAD)), kept)


def remember(store: DataFrame, said: DataFrame) -> DataFrame:
    """store after a batch of said (tenant_id, user_id, kind, content, at).

    store: tenant_id, user_id, content, kind, version, created_at, updated_at, revoked_at. The same content of one user is one living
    row: saying it again adds to its version, as often as it is said, and moves updated_at; its first kind stays. Batches may come in any
    order of time: the earliest and the latest saying count, whenever they arrive. A revoked row is
    history and is never touched; saying it anew makes a new row. What has no user or is not fit to be kept is passed over.
    """
    fresh = said.where("user_id IS NOT NULL").select(F.coalesce("tenant_id", F.lit("default")).alias("tenant_id"), "user_id", sanitized(F.col("content")).alias("content"), kind_of(F.col("kind")).alias("kind"), "at").where("content IS NOT NULL")
    fresh = fresh.groupBy("tenant_id", "user_id", "content").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("at", "kind")).alias("first"), F.max("at").alias("last"))
    keys = ["tenant_id", "user_id", "content"]
    living = store.where("revoked_at IS NULL").join(fresh, keys, "full")
    merged = living.select(
        *keys, F.when(F.col("first.at") < F.col("created_at"), F.col("first.kind")).otherwise(F.coalesce("kind", "first.kind")).alias("kind"), (F.coalesce("version", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("int").alias("version"),
        F.least("created_at", "first.at").alias("created_at"), F.greatest("last", "updated_at").alias("updated_at"), "revoked_at",
    )
    return merged.unionByName(store.where("revoked_at IS NOT NULL").select(*merged.columns))


def revoke(store: DataFrame, asked: DataFrame) -> DataFrame:
    """store with the living rows of asked (tenant_id, user_id, content, at) ended; whoever does not own a row cannot end it."""
    keys = ["tenant_id", "user_id", "content"]
    ends = asked.where("user_id IS NOT NULL").withColumn("tenant_id", F.coalesce("tenant_id", F.lit("default"))).groupBy(*keys).agg(F.min("at").alias("__ends"))
    rows = store.join(ends, keys, "left")
    return rows.withColumn("revoked_at", F.coalesce("revoked_at", "__ends")).drop("__ends").select(*store.columns)


def recall(store: DataFrame, most: int = MOST_LAID) -> DataFrame:
    """The `most` living rows of each user that were said last, `place` from 1; ties go by content."""
    order = W.partitionBy("tenant_id", "user_id").orderBy(F.desc("updated_at"), "content")
    return store.where("revoked_at IS NULL").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def laid(rows: DataFrame, by: list[str], order: list, cost: Column, budget: int) -> DataFrame:
    """The rows of each group, in order, until the next would go beyond the budget."""
    spent = F.sum(cost).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("__spent", spent).where(F.col("__spent") <= budget).drop("__spent")


def memory_layer(recalled: DataFrame, budget: int = 800) -> DataFrame:
    """tenant_id, user_id, memory, items: the lines of recalled rows that fit, under their head."""
    line = F.concat(F.lit("- ["), "kind", F.lit("] "), "content")
    rows = laid(recalled.withColumn("line", line), ["tenant_id", "user_id"], [F.col("place")], F.length("line") + 1, budget)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda s: s["line"])
    return rows.groupBy("tenant_id", "user_id").agg(F.concat(F.lit(MEMORY_HEAD + "\n"), F.array_join(lines, "\n")).alias("memory"), F.count(F.lit(1)).alias("items"))


def turn_layers(turns: DataFrame, pairs: int = 3, recent: int = 2400, digest: int = 600) -> DataFrame:
    """conv_id, older, digest, recent, kept of turns (conv_id, turn, role, text).

    recent: the turns from the `pairs`-th last of the user on, in full if they fit the budget, else the latest that do. digest: of the
    user's turns before, the last DIGEST_TURNS, clipped, of which the earliest go where the budget is short. older and kept: how many
    turns lie before, and are shown as recent. Blank turns count for nothing.
    """
    back = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    to_here, before = back.rowsBetween(W.unboundedPreceding, 0), back.rowsBetween(W.unboundedPreceding, -1)
    blank = F.lit(" \t\n\r\x0b\x0c\u3000\xa0")
    said = turns.withColumn("text", F.btrim("text", blank)).where("text <> ''").withColumn("user", ~F.lower("role").isin("ai", "assistant"))
    said = said.withColumn("asked", F.count_if("user").over(to_here))
    said = said.withColumn("old", F.coalesce(F.count_if(F.col("user") & (F.col("asked") == pairs)).over(before), F.lit(0)) > 0)
    said = said.withColumn("line", F.concat(F.when(F.col("user"), USER).otherwise(HELPER), "text"))
    whole = F.sum(F.when(~F.col("old"), F.length("line") + 1).otherwise(0)).over(W.partitionBy("conv_id")) - 1
    spent = F.sum(F.when(~F.col("old"), F.length("text") + 8).otherwise(0)).over(to_here)
    flat = F.replace("text", F.lit("\n"), F.lit(" "))
    clipped = F.when(F.length(flat) <= SNIPPET, flat).otherwise(F.concat(F.substring(flat, 1, SNIPPET - 1), F.lit("…")))
    said = said.withColumn("fits", ~F.col("old") & ((whole <= recent) | (spent <= recent)))
    said = said.withColumn("snippet", F.when(F.col("old") & F.col("user") & (F.col("asked") <= pairs + DIGEST_TURNS), clipped))
    told = F.sum(F.length("snippet") + 1).over(to_here) - 1 + len(DIGEST_HEAD)
    said = said.withColumn("snippet", F.when(told <= digest, F.col("snippet")))
    ordered = lambda c, when: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("turn", c)))), lambda s: s[c])
    out = said.groupBy("conv_id").agg(F.count_if("old").alias("older"), ordered("snippet", F.col("snippet").isNotNull()).alias("told"), F.array_join(ordered("line", F.col("fits")), "\n").alias("recent"), F.count_if("fits").alias("kept"))
    return out.select("conv_id", "older", F.when(F.size("told") > 0, F.concat(F.lit(DIGEST_HEAD), F.array_join("told", "；"))).otherwise("").alias("digest"), "recent", "kept")
