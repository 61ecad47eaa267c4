"""The item bank and its documents (GT-03, GT-04, CR-01 to CR-05, CR-10, STR-22) over events, documents, lines and orders."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators import bank as B
from millrace.operators import tables as T
from millrace.operators.roles import KIND_ROLES
from millrace.plans import Catalog
from millrace.plans.roles import quoted

catalog = Catalog()
query = catalog.query

c = F.col
# --- verdicts ----------------------------------------------------------------------------------------

ACTIONS = {"click": "verdict", "view": "verdict", "purchase": "override", "signup": "requeue", "error": "quarantine"}
DECIDED = ("published", "published", "failed", "needs_review", "maybe")
EVENTS = f"""(SELECT user_id AS item, event_id AS place, event_id * 10 AS moment, CASE WHEN event_id % 11 = 0 THEN 'demote' ELSE CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in ACTIONS.items())} END END AS action, {list(DECIDED)!r}[event_id % {len(DECIDED)} + 1] AS decision,
CASE WHEN event_id % 7 > 0 THEN round(value / 100, 6) END AS score, CASE event_id % 3 WHEN 0 THEN ['r' || event_id % 4, 'b'] WHEN 1 THEN [] END AS reasons FROM events)"""


def _events(t):
    e = c("event_id")
    kinds = F.create_map(*[F.lit(x) for p in ACTIONS.items() for x in p])
    reasons = F.when(e % 3 == 0, F.array(F.concat(F.lit("r"), (e % 4).cast("string")), F.lit("b"))).when(e % 3 == 1, F.array().cast("array<string>"))
    decision = F.get(F.array(*map(F.lit, DECIDED)), (e % len(DECIDED)).cast("int"))
    return t.events.select(c("user_id").alias("item"), e.alias("place"), (e * 10).alias("at"), F.when(e % 11 == 0, "demote").otherwise(F.element_at(kinds, c("event_type"))).alias("action"), decision.alias("decision"), F.when(e % 7 > 0, F.round(c("value") / 100, 6)).alias("score"), reasons.alias("reasons"))


VALID = "decision IN ('published', 'failed', 'needs_review')"


@query("gt_04", f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY place) AS turn FROM {EVENTS}), s AS (SELECT item, 0::BIGINT AS turn, 'draft' AS status, NULL::DOUBLE AS score, []::VARCHAR[] AS reasons, 0 AS reviews, NULL::BIGINT AS published_at FROM (SELECT DISTINCT item FROM e)
UNION ALL SELECT item, turn, CASE act WHEN 'verdict' THEN decision WHEN 'override' THEN decision WHEN 'demote' THEN 'needs_review' WHEN 'quarantine' THEN 'needs_review' WHEN 'requeue' THEN 'draft' ELSE status END, CASE act WHEN 'verdict' THEN new_score WHEN 'requeue' THEN NULL ELSE score END,
 CASE act WHEN 'verdict' THEN coalesce(new_reasons, []) WHEN 'demote' THEN ['{B.LEGACY}'] WHEN 'quarantine' THEN [coalesce(new_reasons[1], '{B.CHANGED}')] WHEN 'requeue' THEN [] ELSE reasons END, reviews + (act = 'verdict')::INT,
 CASE WHEN act IN ('verdict', 'override') THEN CASE WHEN decision = 'published' THEN moment END WHEN act = '' THEN published_at END
FROM (SELECT s.item, e.turn, s.status, s.score, s.reasons, s.reviews, s.published_at, e.decision, e.moment, e.score AS new_score, e.reasons AS new_reasons,
 CASE WHEN action = 'verdict' AND {VALID} THEN 'verdict' WHEN action = 'demote' AND s.status = 'published' AND s.item % 2 = 0 THEN 'demote' WHEN action = 'quarantine' THEN 'quarantine' WHEN action = 'override' AND decision IN ('published', 'failed') THEN 'override' WHEN action = 'requeue' THEN 'requeue' ELSE '' END AS act
 FROM s JOIN e ON e.item = s.item AND e.turn = s.turn + 1))
SELECT item, status, score, array_to_string(reasons, ',') AS reasons, reviews, published_at FROM s QUALIFY row_number() OVER (PARTITION BY item ORDER BY turn DESC) = 1""")
def item_states(t):
    """Items after all their verdicts, demotions, quarantines, overrides and requeues; every other item was generated."""
    events = _events(t)
    items = events.select("item").distinct().withColumn("origin", F.when(c("item") % 2 == 0, "generation").otherwise("extraction"))
    return B.item_states(items, events).withColumn("reasons", F.array_join("reasons", ","))


AUDIT = f"""(SELECT item, place, CASE action WHEN 'verdict' THEN 'eval' WHEN 'override' THEN 'hitl' ELSE 'revalidation' END AS stage, CASE WHEN action = 'quarantine' THEN 'quarantined' ELSE decision END AS decision, CASE WHEN action = 'verdict' THEN coalesce(score, 0) WHEN action = 'override' AND decision = 'published' THEN 1 ELSE 0 END::DOUBLE AS score,
CASE action WHEN 'quarantine' THEN [coalesce(reasons[1], '{B.CHANGED}')] WHEN 'verdict' THEN coalesce(reasons, []) ELSE [] END AS reasons FROM {EVENTS} WHERE (action = 'verdict' AND {VALID}) OR (action = 'override' AND decision IN ('published', 'failed')) OR action = 'quarantine')"""


@query("gt_03_audit", f"SELECT item, place, stage, decision, score, array_to_string(reasons, ',') AS reasons FROM {AUDIT}")
def audit_rows(t):
    return B.audit_rows(_events(t)).withColumn("reasons", F.array_join("reasons", ","))


@query("gt_03", f"SELECT decision, coalesce(reasons[1], '') AS reason, count(*) AS n FROM {AUDIT} WHERE stage = 'eval' GROUP BY 1, 2")
def verdict_metrics(t):
    return B.verdict_metrics(_events(t))


# --- documents ---------------------------------------------------------------------------------------


@query("cr_01", """WITH r AS (SELECT doc_id AS request, CASE WHEN doc_id % 4 > 0 THEN sha256(text) END AS artifact, CASE WHEN doc_id % 9 > 0 THEN source ELSE ' ' END AS exam FROM documents), s AS (SELECT * FROM r WHERE trim(coalesce(exam, '')) <> '')
SELECT request, CASE WHEN artifact IS NULL THEN request ELSE min(request) OVER (PARTITION BY artifact) END AS document, artifact IS NULL OR min(request) OVER (PARTITION BY artifact) = request AS created FROM s""")
def registrations(t):
    d = c("doc_id")
    return B.registrations(t.documents.select(d.alias("request"), F.when(d % 4 > 0, F.sha2("text", 256)).alias("artifact"), F.when(d % 9 > 0, c("source")).otherwise(" ").alias("exam")))


@query("cr_01_listed", """SELECT source AS exam, lang AS kind, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 AS place FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) <= 20""")
def listed_documents(t):
    """The twenty oldest documents of each exam and kind."""
    rows = t.documents.select(c("source").alias("exam"), c("lang").alias("kind"), "doc_id")
    return T.first_by(rows, ["exam", "kind"], [c("doc_id")], 20).withColumn("place", F.row_number().over(W.partitionBy("exam", "kind").orderBy("doc_id")) - 1)


KINDS = ("edital", "prova", "gabarito", "programa", "other")
_NEW = ("evidence", None, "knowledge", "nenhum", "mixed")
_CHANGE = f"(SELECT doc_id AS doc, {list(_NEW)!r}[doc_id % 5 + 1] AS new_role, CASE doc_id % 6 WHEN 0 THEN 'prova' WHEN 1 THEN 'folheto' END AS new_kind, CASE doc_id % 7 WHEN 0 THEN false WHEN 1 THEN true END AS reprocess FROM documents WHERE doc_id % 3 = 0)".replace("None", "NULL")


@query("cr_02", f"""WITH d AS (SELECT doc_id AS doc, CASE WHEN doc_id % 2 = 0 THEN 'knowledge' ELSE 'unknown' END AS role, 0.6::DOUBLE AS confidence, 'rules' AS method, 'other' AS kind, 'done' AS status, 2 AS attempts, CASE WHEN doc_id % 4 = 0 THEN doc_id - 1 END AS twin_of FROM documents),
f AS (SELECT d.*, new_role, new_kind, reprocess, x.doc IS NOT NULL AS asked, CASE WHEN x.doc IS NULL THEN NULL WHEN new_role NOT IN ('specification', 'evidence', 'knowledge', 'administrative', 'mixed', 'unknown') THEN 'invalid role' WHEN new_kind NOT IN {KINDS!r} THEN 'invalid kind' WHEN new_role IS NULL AND new_kind IS NULL AND NOT coalesce(reprocess, false) THEN 'nothing to change' END AS fault FROM d LEFT JOIN {_CHANGE} x USING (doc)),
g AS (SELECT *, asked AND fault IS NULL AS done, asked AND fault IS NULL AND coalesce(reprocess, true) AS again FROM f)
SELECT doc, CASE WHEN done AND new_role IS NOT NULL THEN new_role ELSE role END AS role, CASE WHEN done AND new_role IS NOT NULL THEN 1 ELSE confidence END::DOUBLE AS confidence, CASE WHEN done AND new_role IS NOT NULL THEN 'admin_override' ELSE method END AS method, CASE WHEN done AND new_kind IS NOT NULL THEN new_kind ELSE kind END AS kind,
CASE WHEN again THEN 'pending' ELSE status END AS status, CASE WHEN again THEN 0 ELSE attempts END AS attempts, CASE WHEN NOT again THEN twin_of END AS twin_of, fault FROM g""")
def relabelled(t):
    d = c("doc_id")
    docs = t.documents.select(d.alias("doc"), F.when(d % 2 == 0, "knowledge").otherwise("unknown").alias("role"), F.lit(0.6).alias("confidence"), F.lit("rules").alias("method"), F.lit("other").alias("kind"), F.lit("done").alias("status"), F.lit(2).alias("attempts"), F.when(d % 4 == 0, d - 1).alias("twin_of"))
    role = F.get(F.array(*map(F.lit, _NEW)), (d % 5).cast("int"))
    changes = t.documents.where("doc_id % 3 = 0").select(d.alias("doc"), role.alias("new_role"), F.when(d % 6 == 0, "prova").when(d % 6 == 1, "folheto").alias("new_kind"), F.when(d % 7 == 0, False).when(d % 7 == 1, True).alias("reprocess"))
    return B.relabelled(docs, changes, KINDS)


@query("cr_03", """WITH u AS (SELECT l_orderkey AS unit, l_orderkey % 50 AS doc, list({'n': l_linenumber, 's': l_suppkey} ORDER BY l_linenumber, l_suppkey) AS e FROM lineitem WHERE l_orderkey % 6 > 0 GROUP BY 1, 2), p AS (SELECT unit, doc, unnest(e) AS e, generate_subscripts(e, 1) AS place FROM u),
k AS (SELECT s_suppkey % 50 AS doc, s_suppkey % 9 AS ordinal, min(s_suppkey) AS chunk FROM supplier GROUP BY 1, 2)
SELECT unit, count(*) AS evidence, string_agg(coalesce(CASE WHEN e.n % 3 = 0 THEN 'c' || e.s END, 'k' || chunk, '-'), ',' ORDER BY place) AS chunks FROM p LEFT JOIN k ON k.doc = p.doc AND k.ordinal = e.s % 9 AND e.n % 3 <> 0 GROUP BY 1""")
def resolved_units(t):
    """Orders as units of fifty documents, their lines as evidence: every third names its chunk, the others an ordinal. Blank statements and leaves are skipped."""
    k = c("l_orderkey")
    lines = t.lineitem.groupBy(k.alias("unit")).agg(F.array_sort(F.collect_list(F.struct(c("l_linenumber").alias("n"), c("l_suppkey").alias("s")))).alias("lines"))
    evidence = F.transform("lines", lambda e: F.struct(F.when(e.n % 3 == 0, F.concat(F.lit("c"), e.s.cast("string"))).alias("chunk"), (e.s % 9).alias("ordinal")))
    units = lines.select("unit", (c("unit") % 50).alias("doc"), F.when(c("unit") % 6 == 0, " ").otherwise("folha").alias("leaf"), F.lit("texto").alias("statement"), evidence.alias("evidence"))
    chunks = t.supplier.select((c("s_suppkey") % 50).alias("doc"), (c("s_suppkey") % 9).alias("ordinal"), c("s_suppkey").alias("chunk_id"), F.lit("s").alias("section"))
    chunks = chunks.groupBy("doc", "ordinal").agg(F.concat(F.lit("k"), F.min("chunk_id").cast("string")).alias("chunk"), F.first("section").alias("section"))
    found = B.resolved_units(units, chunks)
    return found.select("unit", F.size("evidence").cast("long").alias("evidence"), F.array_join(F.transform("evidence", lambda e: F.coalesce(e.chunk, F.lit("-"))), ",").alias("chunks"))


@query("cr_04", """WITH w AS (SELECT s_suppkey AS unit FROM supplier WHERE s_acctbal < 3000 ORDER BY s_acctbal, s_suppkey LIMIT 50)
SELECT s_suppkey AS unit, CASE WHEN s_suppkey % 5 > 0 AND s_suppkey IN (SELECT unit FROM w) THEN 'ku_suspect' WHEN s_suppkey % 5 > 0 THEN 'active' ELSE 'retired' END AS status FROM supplier""")
def flagged(t):
    units = t.supplier.select(c("s_suppkey").alias("unit"), F.when(c("s_suppkey") % 5 > 0, "active").otherwise("retired").alias("status"))
    wanted = t.supplier.where("s_acctbal < 3000").orderBy("s_acctbal", "s_suppkey").limit(200).withColumn("place", F.row_number().over(W.orderBy("s_acctbal", "s_suppkey")))
    return B.flagged(units, wanted.select("place", c("s_suppkey").alias("unit")))


_PATCH = "(SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '2025' WHEN 1 THEN '' END AS edition, CASE WHEN o_orderkey % 3 = 0 THEN DATE '2025-01-01' END AS ends, CASE WHEN o_orderkey % 5 = 0 THEN 'date' END AS source, CASE WHEN o_orderkey % 10 = 2 THEN 'oab' END AS kind FROM orders WHERE o_orderkey % 2 = 0)"


@query("cr_05", f"""SELECT o.o_orderkey, coalesce(nullif(p.edition, ''), o.o_orderpriority) AS edition, coalesce(p.ends, o.o_orderdate::DATE) AS ends, coalesce(nullif(p.source, ''), o.o_orderstatus) AS source, coalesce(nullif(p.kind, ''), 'concurso') AS kind FROM orders o LEFT JOIN {_PATCH} p ON p.o_orderkey = o.o_orderkey""")
def patched(t):
    """Every other exam is patched in some of its fields; empty ones stay."""
    k = c("o_orderkey")
    rows = t.orders.select("o_orderkey", c("o_orderpriority").alias("edition"), F.to_date("o_orderdate").alias("ends"), c("o_orderstatus").alias("source"), F.lit("concurso").alias("kind"))
    patches = t.orders.where("o_orderkey % 2 = 0").select("o_orderkey", F.when(k % 4 == 0, "2025").when(k % 4 == 1, "").alias("edition"), F.when(k % 3 == 0, F.to_date(F.lit("2025-01-01"))).alias("ends"), F.when(k % 5 == 0, "date").alias("source"), F.when(k % 10 == 2, "oab").alias("kind"))
    return B.patched(rows, patches, "o_orderkey", ["edition", "ends", "source", "kind"])


_HINTS = (None, "unknown", "knowledge", None)
_KIND_HINTS = ("edital", "gabarito", "lei", "unknown", None, "listing", "nenhum")
_ROLE_OF = "CASE kind_hint " + " ".join(f"WHEN {quoted(k)} THEN {quoted(r)}" for k, r in KIND_ROLES.items()) + " END"


@query("cr_10", f"""WITH a AS (SELECT page_id AS artifact, CASE WHEN page_id % 8 > 0 THEN 'exame' ELSE '' END AS exam, {list(_HINTS)!r}[page_id % 4 + 1] AS role_hint, {list(_KIND_HINTS)!r}[page_id % 7 + 1] AS kind_hint FROM pages)
SELECT artifact, CASE WHEN exam <> '' THEN coalesce(nullif(role_hint, 'unknown'), {_ROLE_OF}, 'unknown') END AS role, exam <> '' AND artifact % 5 > 0 AS imported, true AS completed FROM a""".replace("None", "NULL"))
def imported(t):
    """Pages as artifacts that are claimed for import; every fifth has its document already."""
    k = c("page_id")
    pick = lambda values: F.get(F.array(*[F.lit(v).cast("string") for v in values]), (k % len(values)).cast("int"))
    artifacts = t.pages.select(k.alias("artifact"), F.when(k % 8 > 0, "exame").otherwise("").alias("exam"), pick(_HINTS).alias("role_hint"), pick(_KIND_HINTS).alias("kind_hint"))
    return B.imported(artifacts, t.pages.where("page_id % 5 = 0").select(k.alias("artifact")))


# --- results -----------------------------------------------------------------------------------------

_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'CORRECTED' WHEN 'P' THEN 'IN_CORRECTION' ELSE 'PENDING' END"


def _status():
    return F.when(c("o_orderstatus") == "F", "CORRECTED").when(c("o_orderstatus") == "P", "IN_CORRECTION").otherwise("PENDING")


@query("str_22", f"""SELECT o_orderkey AS attempt, l_linenumber AS question, {_STATUS} AS status, CASE WHEN o_orderstatus = 'F' THEN o_custkey % 10 END AS score, CASE WHEN o_orderstatus = 'F' THEN l_suppkey % 2 END AS grade FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def shown_results(t):
    attempts = t.orders.select(c("o_orderkey").alias("attempt"), _status().alias("status"), (c("o_custkey") % 10).alias("score"))
    return B.shown_results(attempts, t.lineitem.select(c("l_orderkey").alias("attempt"), c("l_linenumber").alias("question"), (c("l_suppkey") % 2).alias("grade")))


@query("str_22_released", f"SELECT o_orderkey AS attempt, CASE WHEN o_orderkey % 3 = 0 AND o_orderstatus = 'P' THEN 'PENDING' ELSE {_STATUS} END AS status, CASE WHEN o_orderkey % 3 = 0 AND o_orderstatus <> 'P' THEN 'not_in_correction' END AS fault FROM orders")
def released(t):
    attempts = t.orders.select(c("o_orderkey").alias("attempt"), _status().alias("status"))
    return B.released(attempts, t.orders.where("o_orderkey % 3 = 0").select(c("o_orderkey").alias("attempt")))
