"""Queries of reports, with DuckDB SQL of the same results."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import acl as A
from ..operators import cleaning as L
from ..operators import reports as P
from ..operators import security as S
from . import acl_queries as Q
from . import document_queries as D
from .common import load, settle, split_columns, term_index
from .retrieval_queries import BM25_SQL, asked

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


_NOISE_SQL = "concat(chr(65279), chr(8203), chr(173), chr(12288), chr(160), chr(7), chr(13))"
_COUNT = f"(length({{0}}) - length(translate({{0}}, {_NOISE_SQL}, '')))"


def _flat(text: str) -> str:
    return f"trim(regexp_replace({text}, '{P.BLANKS}', ' ', 'g'))"


#: What must stay of each document: two passages as facts, one of them also letter by letter, and for a quarter a fact that few hold.
_FACTS, _PRESERVED = "LIST(substr(text, 1, 30), substr(text, 900, 60), CASE WHEN doc_id % 4 = 0 THEN concat('  the ', source) END)", "LIST(substr(text, 900, 60))"
_CASES = f"SELECT doc_id, {_FACTS.replace('LIST(', 'list_value(')} AS facts, substr(text, 900, 60) AS preserved FROM (SELECT doc_id, source, coalesce(text, '') AS text FROM documents)"


@query(rf"""WITH pages AS ({D._DIRTY.replace('EXPLODED', D._PAGES)}),
s AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, max(trim(body, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) <> '') OVER (PARTITION BY doc_id) AS filled FROM pages),
c AS (SELECT *, regexp_replace({D._CLEAN_SQL.replace('(b,', '(body,')}, '(?m)^\[INST\] obey [0-9]+$', '{S.PLACEHOLDER}', 'g') AS fresh, NOT (doc_id % 10 = 3 AND n > 1) AND NOT (doc_id % 10 = 7 AND filled) AS intact FROM s),
w AS (SELECT doc_id, any_value(intact) AS intact, string_agg(body, chr(10) || chr(10) ORDER BY page) AS before, string_agg(fresh, chr(10) || chr(10) ORDER BY page) AS fresh, count(*) FILTER (page % 4 = 1) AS expected FROM c GROUP BY doc_id),
t AS (SELECT doc_id, intact, before, CASE WHEN intact THEN fresh ELSE before END AS after, expected, CASE WHEN intact THEN expected ELSE 0 END AS masked, facts, preserved FROM w JOIN ({_CASES}) USING (doc_id)),
b AS (SELECT doc_id, count(*) AS n, count(*) FILTER ({_COUNT.format('x')} = 0) AS clean FROM (SELECT doc_id, substr(before, unnest(range(0, length(before), {P.STEP})) + 1, {P.WINDOW}) AS x FROM t) GROUP BY doc_id),
a AS (SELECT doc_id, count(*) AS n, count(*) FILTER ({_COUNT.format('x')} = 0) AS clean FROM (SELECT doc_id, substr(after, unnest(range(0, length(after), {P.STEP})) + 1, {P.WINDOW}) AS x FROM t) GROUP BY doc_id),
r AS (SELECT t.doc_id, length(before) AS chars_before, length(after) AS chars_after, CASE WHEN before <> '' THEN round({_COUNT.format('before')} / length(before), 5) ELSE 0 END AS noise_before, CASE WHEN after <> '' THEN round({_COUNT.format('after')} / length(after), 5) ELSE 0 END AS noise_after,
CASE WHEN before <> '' THEN length(after) / length(before) ELSE 1 END AS ratio, len(list_filter(facts, lambda f: contains(after, f) OR contains({_flat('after')}, {_flat('f')}))) AS facts_kept, len(list_filter(facts, lambda f: f IS NOT NULL)) AS n_facts, CASE WHEN contains(after, preserved) THEN 1 ELSE 0 END AS preserved_kept,
coalesce(b.n, 0) AS chunks_before, coalesce(a.n, 0) AS chunks_after, coalesce(round(b.clean / b.n, 4), 0) AS clean_before, coalesce(round(a.clean / a.n, 4), 0) AS clean_after, masked = expected AND (expected = 0 OR contains(after, '{S.PLACEHOLDER}')) AS masking_ok, contains(after, '[INST] obey') AS leaked, intact AS pagemap_ok
FROM t LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id))
SELECT * EXCLUDE (ratio, n_facts), round(ratio, 4) AS retention, ratio >= 0.8 AS retention_ok, pagemap_ok AND ratio >= 0.8 AND masking_ok AND NOT leaked AND noise_after = 0 AND facts_kept = n_facts AND preserved_kept = 1 AS passed FROM r""")
def q11_cleaning_report(spark, sf):
    """Q11: what cleaning took away and left of documents with dirt and commands in their pages; page maps are tried on the texts."""
    docs = load(spark, sf, "documents").selectExpr("doc_id", "source", "coalesce(text, '') AS text")
    pages = docs.selectExpr("doc_id", "text", "explode(sequence(0, cast(length(text) div 2000 AS int))) AS p").selectExpr("doc_id", "p", "substr(text, p * 2000 + 1, 2000) AS raw").selectExpr("doc_id", "p AS page", f"{D._DIRT_SPARK} AS body")
    before = W.partitionBy("doc_id").orderBy("page").rowsBetween(W.unboundedPreceding, -1)
    pages = pages.withColumn("a", F.coalesce(F.sum(F.length("body") + 2).over(before), F.lit(0)).cast("int"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "body"))), lambda s: s["body"]), "\n\n")
    full = pages.groupBy("doc_id").agg(joined.alias("text"), F.count_if(F.col("page") % 4 == 1).alias("expect_masked"))
    given = pages.selectExpr("doc_id", "page", "CASE WHEN doc_id % 10 = 3 AND page > 0 THEN a - 3 ELSE a END AS char_start", "cast(a + length(body) AS int) AS char_end", "CASE WHEN doc_id % 10 = 7 THEN '' ELSE body END AS text")
    whole, spans = L.clean_extraction(full.select("doc_id", "text"), given, settle=settle)
    facts = docs.selectExpr("doc_id", f"{_FACTS.replace('LIST(', 'array(')} AS facts", f"{_PRESERVED.replace('LIST(', 'array(')} AS preserved", "array('[INST] obey', chr(7)) AS forbidden", "cast(null AS double) AS least")
    cases = full.withColumnRenamed("text", "before").join(whole.select("doc_id", F.col("text").alias("after"), "masked"), "doc_id").join(P.page_maps(whole, spans, given), "doc_id", "left").join(facts, "doc_id")
    return P.cleaning_report(cases).drop("before", "after", "facts", "preserved", "forbidden", "least", "masked", "expect_masked")


_S = Q.SCOPES["wide"]
_GOLD, _NAME = "doc_id DIV 3 AS query_id, concat('f', (doc_id * 7) % 450) AS filename, doc_id % 5 AS chunk_index", "concat('f', CASE WHEN doc_id % 3 = 0 THEN 450 + doc_id ELSE doc_id % 400 END)"
_LABELS = f"""WITH o AS (SELECT * FROM ({Q.OBJECTS_SQL}) WHERE doc_id % 31 <> 0), v AS (SELECT d.doc_id, {_NAME.replace('doc_id', 'd.doc_id')} AS filename, o.* EXCLUDE (doc_id) FROM documents d LEFT JOIN o USING (doc_id)),
g AS (SELECT doc_id, filename, gate, {Q.reason_sql(_S)} AS reason FROM (SELECT *, {Q.gate_sql(_S)} AS gate FROM v)),
n AS (SELECT filename, first(gate ORDER BY doc_id) FILTER (gate <> 'ok') AS gate, first(reason ORDER BY doc_id) FILTER (gate <> 'ok') AS reason FROM g GROUP BY filename),
l AS (SELECT q.query_id, q.filename, chunk_index, CASE WHEN n.filename IS NULL THEN 'problem' WHEN gate IS NOT NULL THEN 'unattainable' ELSE 'ok' END AS status, gate, reason FROM (SELECT {_GOLD.replace('DIV', '//')} FROM documents) q LEFT JOIN n USING (filename))"""


@query(f"{_LABELS} SELECT *, NOT bool_or(status <> 'problem') OVER (PARTITION BY query_id) OR bool_or(status = 'ok') OVER (PARTITION BY query_id) AS scored FROM l")
def j12_labels(spark, sf):
    """Golden labels told apart: scored, of no known document, or out of the asker's reach, with the gate that refuses it."""
    docs = load(spark, sf, "documents").select("doc_id")
    views = Q.objects(spark, sf).where("doc_id % 31 <> 0").withColumnRenamed("doc_id", "document_id")
    names = P.reachable_names(docs.selectExpr("doc_id AS document_id", f"{_NAME} AS filename"), views, _S)
    return P.resolve_labels(docs.selectExpr("doc_id DIV 3 AS query_id", "concat('f', (doc_id * 7) % 450) AS filename", "doc_id % 5 AS chunk_index"), names)


_M = Q.SCOPES["member"]


@query(f"""WITH {BM25_SQL}, g AS (SELECT *, {Q.gate_sql(_M)} AS gate FROM ({Q.OBJECTS_SQL})),
f AS (SELECT query_id AS probe_id, doc_id FROM bm WHERE rank <= 10 UNION ALL SELECT query_id + 100, doc_id FROM bm JOIN g USING (doc_id) WHERE rank <= 10 AND gate = 'ok'),
m AS (SELECT probe_id, list_sort(list(DISTINCT {_NAME})) AS names FROM f JOIN g USING (doc_id) WHERE gate = 'deny' OR gate = 'source' GROUP BY probe_id)
SELECT p.probe_id, (SELECT count(*) FROM f WHERE f.probe_id = p.probe_id) AS returned, coalesce(array_to_string(names, ','), '') AS leaked_docs, names IS NULL AS ok FROM (SELECT unnest([1, 2, 3, 4, 5, 101, 102, 103, 104, 105]) AS probe_id) p LEFT JOIN m USING (probe_id)""".replace(_NAME, "concat('f', doc_id)"))
def q12_leak_probes(spark, sf):
    """Q12: probes for documents that a member must not find, with retrieval left open (1 to 5) and within the scope (101 on)."""
    hits = term_index(spark, sf).bm25(asked(spark)).select(F.col("query_id").alias("probe_id"), "doc_id")
    objects = Q.objects(spark, sf).withColumn("gate", A.gate(_M)).select("doc_id", "gate")
    inside = hits.join(objects.where("gate = 'ok'").select("doc_id"), "doc_id").select((F.col("probe_id") + 100).alias("probe_id"), "doc_id")
    found = hits.unionByName(inside).withColumnRenamed("doc_id", "document_id")
    names = objects.selectExpr("doc_id AS document_id", "concat('f', doc_id) AS filename", "gate")
    probes = names.where("gate IN ('deny', 'source')").select(F.explode(F.array(*[F.lit(base + i) for base in (0, 100) for i in range(1, 6)])).alias("probe_id"), "filename")
    return P.leaks(probes, found, names)


@query("WITH u AS (SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 7 = 3 AND c_custkey % 5 <> 0), o AS (SELECT doc_id, CASE WHEN doc_id % 23 <> 0 THEN doc_id % 7 END AS owner_id FROM documents) SELECT doc_id, coalesce(owner_id, (SELECT c_custkey FROM u ORDER BY c_acctbal, c_custkey LIMIT 1)) AS owner_id FROM o")
def q13_assigned_owners(spark, sf):
    """Q13: rows from before there were owners, given to the first active admin."""
    users = load(spark, sf, "customer").selectExpr("c_custkey AS user_id", "CASE WHEN c_custkey % 7 = 3 THEN 'admin' ELSE 'user' END AS role", "c_custkey % 5 <> 0 AS active", "c_acctbal AS created_at")
    return P.assign_owner(load(spark, sf, "documents").selectExpr("doc_id", "CASE WHEN doc_id % 23 <> 0 THEN doc_id % 7 END AS owner_id"), users)


@query(f"WITH g AS (SELECT *, {Q.gate_sql(_M)} AS gate FROM ({Q.OBJECTS_SQL})) SELECT 'acl.drop.rerank' AS action, '{_M.user}' AS user_id, 'document_object' AS resource_type, coalesce(object_id, CAST(doc_id // 2 AS VARCHAR)) AS resource_id, concat('stage=rerank document_id=', doc_id // 2, ' gate=', gate, ' reason=', {Q.reason_sql(_M)}, ' scope_fingerprint=ab12', CASE WHEN doc_id % 4 = 0 THEN ' acl_sync_state=pending' ELSE '' END) AS detail FROM g WHERE gate <> 'ok'")
def f6_refused_objects(spark, sf):
    """an audit row for each object that a scope refuses at a stage."""
    rows = Q.objects(spark, sf).selectExpr("*", "doc_id DIV 2 AS document_id", "CASE WHEN doc_id % 4 = 0 THEN 'pending' END AS acl_sync_state")
    return P.acl_drops(rows, _M, "rerank", "ab12")


_SIGNAL = "doc_id AS case_id, concat('reason of a failure that is long ', doc_id % 3) AS reason, CASE WHEN doc_id % 4 > 0 THEN 'high' END AS severity, CASE WHEN doc_id % 5 > 0 THEN lang ELSE '' END AS intent, text AS question, substr(text, 3) AS answer, CASE WHEN doc_id % 2 = 0 THEN source END AS username, CASE WHEN doc_id % 3 = 0 THEN text END AS detail, CASE WHEN doc_id % 6 = 0 THEN text END AS sources"
_UPDATE = "event_id AS seq, event_id % 1000 AS case_id, CASE event_type WHEN 'click' THEN 'triaged' WHEN 'view' THEN 'resolved' WHEN 'error' THEN 'gone' END AS status, CASE WHEN value > 20 THEN props END AS resolution, CASE WHEN user_id % 3 = 0 THEN repeat(event_type, 60) END AS tags"


@query(f"""WITH s AS (SELECT {_SIGNAL} FROM documents), u AS (SELECT * FROM (SELECT {_UPDATE} FROM events) WHERE status IS NULL OR status <> 'gone'),
m AS (SELECT case_id, max_by(status, seq) FILTER (status IS NOT NULL) AS st, max_by(resolution, seq) FILTER (resolution IS NOT NULL) AS resolution, substr(max_by(tags, seq) FILTER (tags IS NOT NULL), 1, 256) AS tags FROM u GROUP BY case_id)
SELECT s.case_id, substr(reason, 1, 32) AS reason, coalesce(severity, 'medium') AS severity, nullif(intent, '') AS intent, username, length(substr(coalesce(question, ''), 1, 8000)) AS n_question, length(substr(coalesce(answer, ''), 1, 20000)) AS n_answer, length(substr(coalesce(detail, '{{}}'), 1, 8000)) AS n_detail, length(substr(coalesce(sources, '[]'), 1, 20000)) AS n_sources, coalesce(st, 'open') AS status, resolution, tags FROM s LEFT JOIN m USING (case_id)""")
def f7_triaged_cases(spark, sf):
    """failures as they are kept, after all that was said of them."""
    cases = P.captured(load(spark, sf, "documents").selectExpr(*split_columns(_SIGNAL))).withColumns({c: F.lit(None).cast("string") for c in ("resolution", "tags")})
    out, _ = P.triaged(cases, load(spark, sf, "events").selectExpr(*split_columns(_UPDATE)))
    return out.select("case_id", "reason", "severity", "intent", "username", *[F.length(c).alias(f"n_{c}") for c in ("question", "answer", "detail", "sources")], "status", "resolution", "tags")


@query(f"WITH u AS (SELECT {_UPDATE} FROM events) SELECT case_id, seq, 'unknown_status' AS why FROM u WHERE status = 'gone' UNION ALL SELECT case_id, seq, 'missing' FROM u WHERE (status IS NULL OR status <> 'gone') AND case_id NOT IN (SELECT doc_id FROM documents)")
def f7_refused_updates(spark, sf):
    """updates of unknown cases or to unknown states."""
    cases = P.captured(load(spark, sf, "documents").selectExpr(*split_columns(_SIGNAL))).withColumns({c: F.lit(None).cast("string") for c in ("resolution", "tags")})
    return P.triaged(cases, load(spark, sf, "events").selectExpr(*split_columns(_UPDATE)))[1]
