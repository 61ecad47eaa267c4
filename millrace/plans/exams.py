"""Exam papers, programme spans, reading order, generated items, verdicts, proposals, accounting, frames, JSON documents (EV-03, 04, SY-02, SRC-05, 23, GN-02, GT-05, EX-07, WN-25, STR-23, WN-N/A, CR-12)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import host_of
from millrace.operators import exams as E
from millrace.operators import items as I
from millrace.plans import Catalog
from millrace.plans.roles import has, quoted
from millrace.plans.rules import HAY, SITES, TIDY, UNDER, _sites
from millrace.plans.web import HOST
from millrace.sources import pages as P
from millrace.workspace import shared_dir

catalog = Catalog()
query = catalog.query

#: Papers of up to fifty questions made of parts: their texts are written out, and read back by the parser.
PAPERS = """(SELECT p_brand || '-' || (rn - 1) // 50 AS paper, ((rn - 1) % 50 + 1)::INT AS number, p_name AS prompt, p_partkey, p_size,
list_concat([p_type, 'tamanho ' || p_size, CASE WHEN p_size % 5 = 0 THEN 'TAMANHO ' || p_size ELSE 'marca ' || p_brand END, 'preço ' || p_partkey], CASE WHEN p_size % 3 = 0 THEN ['nenhuma'] ELSE [] END) AS options
FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part))"""


def _papers(t):
    rn = F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey")) - 1
    c = F.col
    size = c("p_size").cast("string")
    options = F.concat(
        F.array("p_type", F.concat(F.lit("tamanho "), size), F.when(c("p_size") % 5 == 0, F.concat(F.lit("TAMANHO "), size)).otherwise(F.concat(F.lit("marca "), c("p_brand"))), F.concat(F.lit("preço "), c("p_partkey").cast("string"))),
        F.when(c("p_size") % 3 == 0, F.array(F.lit("nenhuma"))).otherwise(F.array().cast("array<string>")),
    )
    rows = t.part.withColumn("rn", rn).select(F.concat_ws("-", "p_brand", F.floor(c("rn") / 50).cast("string")).alias("paper"), (c("rn") % 50 + 1).cast("int").alias("number"), "p_name", "p_partkey", options.alias("options"))
    marks = F.array(*[F.lit(x) for x in ("\n(A) ", "\n B) ", " (C) ", "\nd. ", "\n(E)  ")])
    choices = F.array_join(F.transform("options", lambda o, i: F.concat(F.get(marks, i), o)), "")
    head = F.when(c("number") % 3 == 0, "Questão ").otherwise("")
    rows = rows.withColumn("block", F.concat(head, c("number").cast("string"), F.when(c("number") % 2 == 0, ") ").otherwise(" - "), "p_name", choices))
    letter = F.element_at(F.array(*[F.lit(x) for x in "ABCDE"]), (c("p_partkey") % 5 + 1).cast("int"))
    rows = rows.withColumn("answer", F.when(c("p_partkey") % 11 == 0, None).when(c("p_partkey") % 7 == 0, F.concat(c("number").cast("string"), F.lit(" anulada"))).otherwise(F.concat(c("number").cast("string"), F.lit(" - "), letter)))
    joined = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", x))), lambda r: r[x]), "\n")
    return rows.groupBy("paper").agg(joined("block").alias("text"), joined("answer").alias("key"))  # fifty questions at most


@query("ev_03", f"SELECT paper, number, prompt, array_to_string(options, '|') AS options FROM {PAPERS}")
def question_blocks(t):
    return E.question_blocks(_papers(t), "paper", "text").select("paper", "number", "prompt", F.array_join("options", "|").alias("options"))


@query("ev_04", f"""SELECT paper, number, CASE WHEN p_partkey % 7 <> 0 THEN (p_partkey % 5)::INT END AS correct_index, CASE WHEN p_partkey % 7 = 0 THEN 'annulled' ELSE 'ok' END AS status FROM {PAPERS}
WHERE len(list_distinct(list_transform(options, lambda o: lower(o)))) = len(options) AND p_partkey % 11 <> 0 AND (p_partkey % 7 = 0 OR p_partkey % 5 < len(options))""")
def keyed_questions(t):
    papers = _papers(t)
    keys = papers.select("paper", F.explode(I.answer_key(F.col("key"))).alias("k")).select("paper", "k.number", "k.answer")
    return E.keyed_questions(E.question_blocks(papers, "paper", "text"), keys, "paper").select("paper", "number", "correct_index", "status")


#: doc_id, heading, text of literal sections, in order.
SECTIONS = [
    (1, "Edital", "conteúdos programáticos especificados no Anexo II"), (1, "ANEXO II - CONTEÚDOS PROGRAMÁTICOS", "a"), (1, None, "Português"), (1, "Direito", "anexo ii continua"), (1, "Anexo III", "cronograma"), (1, "x", "y"),
    (2, "Abertura", "nada"), (2, "Notas", "programa de prova: temas"), (2, "Tema", "texto\nanexo I na segunda linha"), (2, "Cronograma", "datas"), (2, "z", "w"),
    (3, "Programas das provas e temas:", "a"), (3, "Modelo de requerimento", "b"),
    (4, "Sem nada", "texto"),
    (5, "Cada cargo", "conteúdo programático"), (5, None, "o conteúdo programático segue"), (5, "Programa das provas", "aqui"), (5, "Requerimento do programa das provas", "fica"), (5, None, "ANEXO 4 fim"),
    (6, "Anexo I – Programa da prova", "a"), (6, None, "anexo i\nsegue"), (6, "Laudo médico", "fim"),
]
ORDERED = [(d, sum(x[0] == d for x in SECTIONS[:i]), h, x) for i, (d, h, x) in enumerate(SECTIONS)]
SECTION_ROWS = f"""(SELECT * FROM (VALUES {', '.join(f'({-d}, {o}, {quoted(h)}, {quoted(x)})' for d, o, h, x in ORDERED)}) v(doc_id, ordinal, heading, text)
UNION ALL SELECT doc_id, pos - 1, line, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents))"""
ANNEX_SQL = lambda x: f"nullif(lower(regexp_extract({x}, '(?i){E.ANNEX}', 1)), '')"
H = "coalesce(heading, '')"
OPENING = f"{TIDY(H)} || chr(10) || substr(text, 1, 240)"


@query("sy_02", f"""WITH s AS (SELECT *, {has(TIDY(H), E.PROGRAMME_HEADING)} AS strong, {has(OPENING, E.PROGRAMME_START)} AND NOT {has(OPENING, E.PROGRAMME_REFERENCE)} AS weak, coalesce({ANNEX_SQL(H)}, {ANNEX_SQL("split_part(text, chr(10), 1)")}) AS annex, {ANNEX_SQL(H)} AS own,
{has(H, E.PROGRAMME_STOP)} AND NOT {has(H, E.PROGRAMME_START)} AS stops FROM {SECTION_ROWS}), b AS (SELECT doc_id, coalesce(min(ordinal) FILTER (strong), min(ordinal) FILTER (weak)) AS start FROM s GROUP BY 1),
a AS (SELECT doc_id, start, own AS start_annex FROM b JOIN s USING (doc_id) WHERE ordinal = start), e AS (SELECT doc_id, min(ordinal) AS stop FROM s JOIN a USING (doc_id) WHERE ordinal > start AND (coalesce(annex <> coalesce(start_annex, ''), false) OR stops) GROUP BY 1)
SELECT doc_id, ordinal, heading FROM s JOIN a USING (doc_id) LEFT JOIN e USING (doc_id) WHERE ordinal >= start AND (stop IS NULL OR ordinal < stop)""")
def programme_spans(t):
    literal = t.spark.createDataFrame([(-d, o, h, x) for d, o, h, x in ORDERED], "doc_id long, ordinal long, heading string, text string")
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "line")).select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.col("line").alias("heading"), F.col("line").alias("text"))
    return E.programme_span(literal.unionByName(lines))


BOXES = """(SELECT p_partkey // 8 AS doc, p_partkey, 1 + (p_partkey % 8) // 5 AS page, x0, x0 + CASE WHEN (p_partkey // 8) % 3 = 0 THEN 300 ELSE 200 END AS x1, p_retailprice AS y0 FROM
(SELECT *, (CASE WHEN (p_partkey // 8) % 3 = 0 THEN 40 + p_size * 3 ELSE (CASE WHEN p_partkey % 2 = 0 THEN 40 ELSE 330 END) + p_size % 20 * 4 END)::DOUBLE AS x0 FROM part))"""


@query("src_05", f"""WITH b AS (SELECT *, (x0 + x1) / 2 AS c FROM {BOXES}), m AS (SELECT doc, avg(c) FILTER (c < 290) AS l, avg(c) FILTER (c > 310) AS r, count(*) AS n FROM b GROUP BY 1),
k AS (SELECT doc, count(*) FILTER (abs(c - l) < 40 OR abs(c - r) < 40) AS near FROM b JOIN m USING (doc) GROUP BY 1),
s AS (SELECT b.*, CASE WHEN n >= 4 AND l IS NOT NULL AND r IS NOT NULL AND near >= 0.7 * n AND abs(l - 300) >= 30 AND abs(r - 300) >= 30 AND abs(c - l) > abs(c - r) THEN 1 ELSE 0 END AS side FROM b JOIN m USING (doc) JOIN k USING (doc))
SELECT doc, p_partkey, side, row_number() OVER (PARTITION BY doc ORDER BY side, page, y0, x0, p_partkey)::INT AS place FROM s""")
def reading_order(t):
    """Blocks of pages 600 wide, in one column or two."""
    doc = F.floor(F.col("p_partkey") / 8)
    one = doc % 3 == 0
    x0 = F.when(one, 40 + F.col("p_size") * 3).otherwise(F.when(F.col("p_partkey") % 2 == 0, 40).otherwise(330) + F.col("p_size") % 20 * 4).cast("double")
    boxes = t.part.select(doc.alias("doc"), "p_partkey", (1 + F.floor(F.col("p_partkey") % 8 / 5)).alias("page"), x0.alias("x0"), (x0 + F.when(one, 300).otherwise(200)).alias("x1"), F.col("p_retailprice").alias("y0"))
    return E.reading_order(boxes, "doc", "p_partkey", 600.0)


ALLOWED = "list_transform(generate_series(1, (turn % 5)::BIGINT), lambda i: 'u' || i)"


@query("gn_02", f"""SELECT conv_id, turn, (turn % 6 - 1)::INT AS correct_index, array_to_string(CASE WHEN conv_id % 3 = 0 AND turn % 5 >= 2 THEN ['u2'] ELSE {ALLOWED}[1:3] END, ',') AS units
FROM conversations WHERE turn % 6 - 1 BETWEEN 0 AND 3 AND turn % 5 > 0 AND conv_id % 4 <> 0 AND conv_id % 9 <> 5""")
def generated_items(t):
    """Replies written as JSON, some broken, some with too few reasons or an index out of range."""
    c, turn = F.col("conv_id"), F.col("turn")
    text = lambda *x: F.array(*[F.lit(v) for v in x])
    item = F.struct(F.concat(F.lit(" "), F.col("text")).alias("prompt"), text("a", "b", "c", "d").alias("options"), (turn % 6 - 1).cast("int").alias("correctIndex"), F.when(c % 3 == 0, text(" u2 ", "zz")).otherwise(text("zz")).alias("knowledgeUnitIds"), F.when(c % 4 == 0, text("x", "y")).otherwise(text("x", "y", "z")).alias("distractorRationale"))
    raw = F.when(c % 9 == 5, F.lit("no json")).otherwise(F.to_json(F.array(item)))
    allowed = F.transform(F.slice(F.array(*[F.lit(i) for i in range(1, 5)]), 1, (turn % 5).cast("int")), lambda i: F.concat(F.lit("u"), i.cast("string")))
    rows = t.conversations.select("conv_id", "turn", F.explode(E.generated_items(raw, allowed)).alias("q"))
    return rows.select("conv_id", "turn", "q.correct_index", F.array_join("q.units", ",").alias("units"))


LEVELS = {"overall": "greatest(0, least(1, round(value, 0) / 100))", "relevance": "greatest(0, least(1, round(value, 0) / 50 - 1))", "durability": "(event_id % 10) / 10.0", "grounding": "CASE WHEN event_id % 4 = 0 THEN 0 ELSE (user_id % 5) / 4.0 END"}


@query("gt_05", f"""SELECT event_id, array_to_string(list_filter(['jev_scored', {', '.join(f"CASE WHEN {v} < 0.5 THEN 'jev_low_{k}' END" for k, v in LEVELS.items())}, CASE WHEN event_id % 4 <> user_id % 4 THEN 'jev_answer_disagrees' END], lambda x: x IS NOT NULL), ',') AS reasons,
{" || ', ' || ".join(f"'{'score' if k == 'overall' else k} ' || printf('%.2f', ({v})::DOUBLE)" for k, v in LEVELS.items())} || ', answer ' || event_id % 4 AS notes FROM events""")
def judge_verdicts(t):
    e, u, v = F.col("event_id"), F.col("user_id"), F.round("value", 0)
    grounding = F.when(e % 4 == 0, F.lit("none")).otherwise((u % 5 / 4.0).cast("string"))  # what is no number counts 0
    verdict = E.judge_verdict(v / 100, v / 50 - 1, e % 10 / 10.0, grounding, e % 4, u % 4)
    return t.events.select("event_id", verdict.alias("j")).select("event_id", F.array_join("j.reasons", ",").alias("reasons"), "j.notes")


@query("ex_07", f"SELECT page_id, host AS domain, CASE WHEN host = '' THEN 'skipped_no_domain' WHEN host IN ({', '.join(map(quoted, P.SOCIAL_HOSTS))}) THEN 'skipped_social_host' ELSE 'scout_candidate' END AS action FROM (SELECT *, {HOST} AS host FROM {SITES})")
def handoffs(t):
    host = host_of(F.col("url"))
    return _sites(t).select("page_id", host.alias("domain"), F.when(host == "", "skipped_no_domain").when(host.isin(*P.SOCIAL_HOSTS), "skipped_social_host").otherwise("scout_candidate").alias("action"))


KNOWN = ["wikipedia.org", "scribd.com"]


@query("wn_25", f"""WITH s AS (SELECT *, {HOST} AS host FROM {SITES}), d AS (SELECT *, host = ANY({KNOWN!r}) AS known, host IN ({', '.join(map(quoted, P.SOCIAL_HOSTS))}) OR {UNDER('host', P.COMMERCIAL_HOSTS)} OR {has('host', P.LOGIN_HOST)} OR {has(HAY, P.SOCIAL_WORDS)} OR {has(HAY, P.STOREFRONT_WORDS)} OR {has(HAY, P.UNRELATED_WORDS)} AS denied FROM s),
o AS (SELECT page_id, host, denied, min(page_id) OVER (PARTITION BY host) AS first FROM d WHERE host <> '' AND NOT known)
SELECT page_id, host, CASE WHEN host = '' THEN 'rejected' WHEN known THEN 'existing_source' END AS decision, NULL::BIGINT AS open_proposal FROM d WHERE host = '' OR known
UNION ALL SELECT page_id, host, CASE WHEN page_id <> first THEN 'dedupe' WHEN denied THEN 'blocked' ELSE 'proposed' END, CASE WHEN page_id <> first THEN first END FROM o""")
def proposals(t):
    """Proposes a host unless a source or an open proposal (the first page that named it) has it; denied hosts are recorded as blocked."""
    rows = _sites(t).select("page_id", host_of(F.col("url")).alias("host"), P.hard_deny(F.col("title"), F.col("url")).alias("deny"))
    first = rows.where("host <> ''").groupBy("host").agg(F.min("page_id").alias("first"))
    known = F.col("host").isin(*KNOWN)
    later = ~known & (F.col("page_id") != F.col("first"))
    decision = F.when(F.col("host") == "", "rejected").when(known, "existing_source").when(later, "dedupe").when(F.col("deny").isNotNull(), "blocked").otherwise("proposed")
    return rows.join(first, "host", "left").select("page_id", "host", decision.alias("decision"), F.when(later, F.col("first")).alias("open_proposal"))


@query("str_23", """WITH r AS (SELECT *, coalesce(sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM events)
SELECT user_id, count(*) AS found, count(*) FILTER (event_type IN ('purchase', 'view')) AS stored, greatest(0, 3 - count(*) FILTER (event_type = 'purchase')) AS remaining FROM r WHERE spent < 3 GROUP BY 1""")
def pass_accounting(t):
    """Candidates of each user in order until three downloads are spent; what is stored without a download costs nothing."""
    before = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    got = F.col("event_type") == "purchase"
    rows = t.events.withColumn("spent", F.coalesce(F.sum(got.cast("int")).over(before), F.lit(0))).where("spent < 3")
    return rows.groupBy("user_id").agg(F.count("*").alias("found"), F.count_if(F.col("event_type").isin("purchase", "view")).alias("stored"), F.greatest(F.lit(0).cast("long"), 3 - F.count_if(got)).alias("remaining"))


@query("wn_frames", """SELECT event_id, lag(value) OVER w AS before, lead(value, 2) OVER w AS after, ntile(4) OVER w AS quarter, round(percent_rank() OVER w, 9) AS rank, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS last_three,
nth_value(event_type, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def frames(t):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    c = F.col("value")
    return t.events.select(
        "event_id", F.lag("value").over(w).alias("before"), F.lead("value", 2).over(w).alias("after"), F.ntile(4).over(w).cast("long").alias("quarter"), F.round(F.percent_rank().over(w), 9).alias("rank"),
        F.round(F.sum(c).over(w.rowsBetween(-2, 0)), 6).alias("last_three"), F.nth_value("event_type", 2).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("second"),
    )


@query("src_23", "SELECT doc_id, sha256(text) AS content_hash, 'v1' AS version, n_chars, sha256(text) AS digest FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1")
def json_documents(t):
    """Documents written as JSON, one for each content hash and version, and loaded again."""
    hashed = t.documents.select("doc_id", F.sha2("text", 256).alias("content_hash"), F.lit("v1").alias("version"), "n_chars", "text")
    first = hashed.groupBy("content_hash", "version").agg(F.min_by(F.struct("doc_id", "n_chars", "text"), "doc_id").alias("d")).select("content_hash", "version", "d.*")
    path = f"{shared_dir(t.spark)}/millrace/json-{uuid.uuid4().hex}"
    first.write.partitionBy("version").mode("error").json(path)
    back = t.spark.read.schema("content_hash string, doc_id long, n_chars long, text string, version string").json(path)
    return back.select("doc_id", "content_hash", "version", "n_chars", F.sha2("text", 256).alias("digest"))


@query("cr_12", r"SELECT conv_id, turn, CASE WHEN k BETWEEN 1 AND 4 THEN k END AS booklet, round(0.5 * (turn % 7) / 6.0 + 0.5 * (conv_id % 5) / 4.0, 6)::DOUBLE AS combined FROM (SELECT *, nullif(regexp_extract(substr(text, 1, 4000), '(?i)\btipo\s*([0-9])\b', 1), '')::INT AS k FROM (SELECT conv_id, turn, text || ' TIPO' || CASE WHEN turn % 2 = 0 THEN ' ' ELSE '' END || conv_id % 7 || ' – BRANCA' AS text FROM conversations))")
def booklets(t):
    """Booklet type of a cover, and the even mean of two scores."""
    text = F.concat("text", F.lit(" TIPO"), F.when(F.col("turn") % 2 == 0, " ").otherwise(""), (F.col("conv_id") % 7).cast("string"), F.lit(" – BRANCA"))
    k = F.regexp_extract(F.substring(text, 1, 4000), r"(?i)(?<![a-z0-9_])tipo\s*([0-9])(?![a-z0-9_])", 1).try_cast("int")
    return t.conversations.select("conv_id", "turn", F.when(k.between(1, 4), k).alias("booklet"), F.round(0.5 * (F.col("turn") % 7) / 6.0 + 0.5 * (F.col("conv_id") % 5) / 4.0, 6).alias("combined"))
