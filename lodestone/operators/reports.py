"""Reports over runs and stores: cleaning, labels out of reach, leaks, legacy rows, refused objects, failures to look into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import acl as A
from ..functions import text as X
from . import security as S

#: Characters that count as noise, the length of a window and the step to the next, the states of a failure.
NOISE, WINDOW, STEP, STATES = "\ufeff\u200b\u00ad\u3000\u00a0\x07\r", 2000, 1800, ("open", "triaged", "resolved", "wontfix")
#: White space that counts as one blank where a fact is looked for.
BLANKS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def noise(text: Column) -> Column:
    """How many characters of noise a text holds; most others are told by one range, before the class is tried."""
    return F.regexp_count(text, F.lit(f"(?![ -~\n])[{NOISE}]"))


def _rate(part: Column, whole: Column, places: int) -> Column:
    return F.when(whole > 0, F.round(part / whole, places)).otherwise(0.0)


def clean_windows(text: Column) -> Column:
    """struct(n, clean): windows of a text that overlap by a tenth, and how many hold no noise. A window is a step and the head of the
    next one, so a text is cut into steps once, in linear time."""
    steps = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STEP}}}"), F.lit(0))
    marks = F.transform(steps, lambda s: F.struct((noise(s) == 0).alias("all"), (noise(F.substring(s, 1, WINDOW - STEP)) == 0).alias("head")))
    good = lambda m: F.size(F.filter(m, lambda w, i: w["all"] & F.coalesce(F.get(m, i + 1)["head"], F.lit(True))))
    return F.transform(F.array(marks), lambda m: F.struct(F.size(m).alias("n"), good(m).alias("clean")))[0]


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "(?![!-~])" + BLANKS, " "))


def cleaning_report(cases: DataFrame) -> DataFrame:
    """cases with chars_before, chars_after, noise_before, noise_after, retention, retention_ok, facts_kept, preserved_kept,
    chunks_before, chunks_after, clean_before, clean_after (shares of windows without noise), masking_ok, leaked and passed.

    cases: before and after (texts), facts (kept if they stand in the text, blanks apart), preserved (kept letter by letter), forbidden
    (strings that must be gone; single noise characters do not count), masked, expect_masked, least (share to keep; null: 0.8),
    pagemap_ok. Null texts are empty, null lists too, null elements of lists are passed over; an empty text keeps all of itself.
    """
    none = F.array().cast("array<string>")
    t = cases.withColumns({c: F.coalesce(c, F.lit("")) for c in ("before", "after")} | {c: F.array_compact(F.coalesce(c, none)) for c in ("facts", "preserved", "forbidden")})
    t = t.withColumns({"__b": clean_windows(F.col("before")), "__a": clean_windows(F.col("after")), "__p": _plain(F.col("after"))})
    before, after = F.length("before"), F.length("after")
    held = lambda c: F.size(F.filter(c, lambda s: F.contains(F.col("after"), s)))
    facts = F.size(F.filter("facts", lambda s: F.contains(F.col("after"), s) | F.contains(F.col("__p"), _plain(s))))
    ratio = F.when(before > 0, after / before).otherwise(1.0)
    wanted = F.coalesce("expect_masked", F.lit(0))
    t = t.withColumns({
        "chars_before": before, "chars_after": after, "noise_before": _rate(noise(F.col("before")), before, 5), "noise_after": _rate(noise(F.col("after")), after, 5), "retention": F.round(ratio, 4),
        "retention_ok": ratio >= F.coalesce("least", F.lit(0.8)), "facts_kept": facts, "preserved_kept": held("preserved"), "chunks_before": F.col("__b.n"), "chunks_after": F.col("__a.n"),
        "clean_before": _rate(F.col("__b.clean"), F.col("__b.n"), 4), "clean_after": _rate(F.col("__a.clean"), F.col("__a.n"), 4),
        "masking_ok": (F.coalesce("masked", F.lit(0)) == wanted) & ((wanted == 0) | F.contains(F.col("after"), F.lit(S.PLACEHOLDER))),
        "leaked": F.exists("forbidden", lambda s: F.contains(F.col("after"), s) & ~F.contains(F.lit(NOISE), s)),
    })
    sound = F.coalesce("pagemap_ok", F.lit(False)) & F.col("retention_ok") & F.col("masking_ok") & ~F.col("leaked") & (F.col("noise_after") == 0)
    return t.withColumn("passed", sound & (F.col("facts_kept") == F.size("facts")) & (F.col("preserved_kept") == F.size("preserved"))).drop("__a", "__b", "__p")


def page_maps(whole: DataFrame, spans: DataFrame, pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, pagemap_ok: whether a cleaned text is intact and each span cuts the cleaned text of its page out of it.

    whole: key, text, intact. spans: key, page, char_start, char_end. pages: key, page, text before cleaning. A page without a span
    fails its text.
    """
    own = pages.select(key, "page", X.clean(F.coalesce("text", F.lit(""))).alias("__tidy")).select(key, "page", S.masked(F.col("__tidy"))["text"].alias("__own"))
    rows = own.join(spans, [key, "page"], "left").groupBy(key).agg(F.collect_list(F.struct("char_start", "char_end", "__own")).alias("__maps"))
    cut = lambda m: F.substr("text", m["char_start"] + 1, m["char_end"] - m["char_start"])
    fits = F.forall("__maps", lambda m: F.coalesce(cut(m) == m["__own"], F.lit(False)))
    return rows.join(whole.select(key, "text", "intact"), key).select(key, (F.col("intact") & fits).alias("pagemap_ok"))


def reachable_names(documents: DataFrame, views: DataFrame, scope: A.Scope) -> DataFrame:
    """filename, gate, reason: of the first document of that name, by id, which the scope refuses; both null where it sees all.

    documents: document_id, filename. views: document_id and the object columns; a document without a view is refused.
    """
    rows = documents.select("document_id", "filename").join(views, "document_id", "left").withColumns({"__gate": A.gate(scope), "__reason": A.reason(scope)})
    refused = F.min(F.when(F.col("__gate") != "ok", F.struct("document_id", "__gate", "__reason")))
    return rows.groupBy("filename").agg(refused.alias("r")).select("filename", F.col("r.__gate").alias("gate"), F.col("r.__reason").alias("reason"))


def resolve_labels(gold: DataFrame, names: DataFrame) -> DataFrame:
    """gold (query_id, filename, chunk_index) with status, gate, reason and scored.

    names: rows of reachable_names. status: problem (no such document), unattainable (one of that name is out of reach: counting it
    would be taken for a miss of retrieval) or ok. scored is false for every label of a query that has documents, none of which is
    within reach: the query goes, where one whose names are all unknown stays.
    """
    rows = gold.join(names.withColumn("__known", F.lit(True)), "filename", "left")
    rows = rows.withColumn("status", F.when(F.col("__known").isNull(), "problem").when(F.col("gate").isNotNull(), "unattainable").otherwise("ok")).drop("__known")
    per = rows.groupBy("query_id").agg((~F.max(F.col("status") != "problem") | F.max(F.col("status") == "ok")).alias("scored"))
    return rows.join(per, "query_id")


def leaks(probes: DataFrame, found: DataFrame, documents: DataFrame) -> DataFrame:
    """probe_id, returned, leaked_docs (names, in order, comma-joined), ok of each probe.

    probes: probe_id, filename of a document that must not be found (null: none). found: probe_id, document_id of what was. documents:
    document_id, filename; all documents of a name are meant. The lists hold no more than what one probe found.
    """
    found_n = found.groupBy("probe_id").agg(F.count(F.lit(1)).alias("returned"))
    named = found.select("probe_id", "document_id").distinct().join(documents.select("document_id", "filename"), "document_id")
    met = named.join(probes.select("probe_id", "filename").distinct(), ["probe_id", "filename"]).groupBy("probe_id").agg(F.array_join(F.array_sort(F.collect_set("filename")), ",").alias("leaked"))
    rows = probes.select("probe_id").distinct().join(found_n, "probe_id", "left").join(met, "probe_id", "left")
    return rows.select("probe_id", F.coalesce("returned", F.lit(0)).alias("returned"), F.coalesce("leaked", F.lit("")).alias("leaked_docs"), F.col("leaked").isNull().alias("ok"))


def assign_owner(rows: DataFrame, users: DataFrame) -> DataFrame:
    """rows whose null owner_id is that of the first active admin (users: user_id, role, active, created_at; ties by id); unchanged
    without one. One row of users is broadcast. Applying it again changes nothing."""
    first = users.where("role = 'admin' AND active").agg(F.min(F.struct("created_at", "user_id"))["user_id"].alias("__first"))
    out = rows.withColumn("__one", F.lit(1)).join(F.broadcast(first.withColumn("__one", F.lit(1))), "__one", "left")
    return out.withColumn("owner_id", F.coalesce("owner_id", "__first")).drop("__one", "__first")


def acl_drops(rows: DataFrame, scope: A.Scope, stage: str, fingerprint: str | None = None) -> DataFrame:
    """An audit row (action, user_id, resource_type, resource_id, detail) for each object that the scope refuses at a stage.

    rows: object_id, document_id, acl_sync_state and the object columns. The id is the object's, or else the document's, cut to 64
    characters; detail leaves out what is null or empty.
    """
    told = lambda label, c: F.concat(F.lit(f"{label}="), F.nullif(c.cast("string"), F.lit("")))
    parts = [F.lit(f"stage={stage}"), told("document_id", F.col("document_id")), told("gate", F.col("__gate")), told("reason", F.col("__reason")), told("scope_fingerprint", F.lit(fingerprint).cast("string")), told("acl_sync_state", F.col("acl_sync_state"))]
    ids = F.coalesce(F.nullif(F.col("object_id").cast("string"), F.lit("")), F.nullif(F.col("document_id").cast("string"), F.lit("")))
    kept = rows.withColumns({"__gate": A.gate(scope), "__reason": A.reason(scope)}).where("__gate <> 'ok'")
    return kept.select(
        F.lit(f"acl.drop.{stage}").alias("action"), F.lit(scope.user).cast("string").alias("user_id"), F.lit("document_object").alias("resource_type"), F.substring(ids, 1, 64).alias("resource_id"), F.concat_ws(" ", *parts).alias("detail")
    )


#: How much of each column of a failure is kept.
KEPT = {"reason": 32, "severity": 16, "intent": 64, "question": 8000, "answer": 20000, "username": 64, "detail": 8000, "sources": 20000}


def captured(signals: DataFrame) -> DataFrame:
    """signals (case_id and the columns of KEPT) as stored: cut, empty intents and names null, medium where no severity is given, open."""
    cut = {c: F.substring(F.coalesce(c, F.lit({"severity": "medium", "detail": "{}", "sources": "[]"}.get(c, ""))), 1, n) for c, n in KEPT.items()}
    empty = {c: F.nullif(cut[c], F.lit("")) for c in ("intent", "username")}
    return signals.withColumns(cut | empty | {"status": F.lit("open")})


def triaged(cases: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cases after updates, updates refused). updates: case_id, seq, status, resolution, tags; a null leaves a column as it is, the last
    value of each counts, tags are cut to 256. Refused: unknown_status, or missing where there is no such case. cases: case_id
    (unique), status, resolution, tags. Updates are merged per case before they meet the cases."""
    bad = F.col("status").isNotNull() & ~F.coalesce(F.col("status").isin(*STATES), F.lit(False))
    good = updates.where(~bad)
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("seq", c)))[c].alias(f"__{c}")
    merged = good.groupBy("case_id").agg(*map(last, ("status", "resolution", "tags")))
    new = {"status": F.coalesce("__status", "status"), "resolution": F.coalesce("__resolution", "resolution"), "tags": F.coalesce(F.substring("__tags", 1, 256), "tags")}
    out = cases.join(merged, "case_id", "left").withColumns(new).drop("__status", "__resolution", "__tags")
    missing = good.join(cases.select("case_id"), "case_id", "left_anti").select("case_id", "seq", F.lit("missing").alias("why"))
    return out, updates.where(bad).select("case_id", "seq", F.lit("unknown_status").alias("why")).unionByName(missing)
