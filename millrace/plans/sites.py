"""Exam sites: kinds, inventory years, registration windows, source scores, authority, capabilities of roles (FLT-04, FLT-21, LC-06, CF-08, CF-09, RK-01, RK-02, EX-06)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import host_of
from millrace.operators.roles import has as like
from millrace.plans import Catalog
from millrace.plans.roles import SPACES, has, quoted
from millrace.plans.web import HOST, TITLE
from millrace.sources import pages as P
from millrace.sources.detail import NO_EXAM, OAB, PUBLIC, UNTIL, WINDOWS, exam_kind, registration_window

catalog = Catalog()
query = catalog.query

# Who may do what, exam kinds, identities of sources, authority of kinds.
ROLES = ("specification", "evidence", "knowledge", "administrative", "mixed", "unknown")
ALLOWED = {
    "syllabus_extraction": ("specification", "mixed"),
    "previous_question_parse": ("evidence", "mixed"),
    "knowledge_index_embed": ("knowledge", "mixed"),
    "generation_retrieval": ("knowledge", "mixed"),
    "style_profile": ("evidence", "mixed"),
    "catalog_metadata": ("specification", "administrative", "mixed"),
}
OFFICIAL = r"\.(gov|jus|leg|edu|mil)\.br$"
BANCA = (
    r"(vunesp|fundação\s+carlos\s+chagas|fundacao\s+carlos\s+chagas|\bfcc\b|fgv|cebraspe|cespe|cesgranrio|consulplan|ibfc|quadrix|idecan|fundetec|fundatec|aocp|instituto\s+aocp|iades|bamsp|ibam)"
)
EXAM_WORDS = r"\b(concursos?|editais?|edital|oab|provas?|gabarito|inscri[cç]([aã]o|[oõ]es)|inscricoes|banca|cargos?|vestibular)\b"
KIND_BASE = {
    "legislation": 0.95, "standards_body": 0.9, "banca_portal": 0.9, "official_gazette": 0.85, "gov": 0.85, "edu": 0.75, "educational_site": 0.5, "aggregator": 0.3, "unknown": 0.2,
}
#: page_id, url, title, text, kind, score of literal sites.
CASES = [
    ("https://www.fgv.br/concurso/x-2026", "Concurso Transpetro 2026", "MESTRADO E PÓS", "banca_portal", None),
    ("https://trt.jus.br/edital/programa", "Vestibular e concurso", "concurso público", "gov", None),
    ("https://camara.leg.br/resposta", "Vestibular 2024", "", "legislation", None),
    ("https://ufmg.edu.br/prova-quest", "Certificação CFP", "x", "edu", None),
    ("https://ong.org.br/caderno", "Certificação", "concurso  público aberto", "educational_site", 1.7),
    ("https://x.gov.br.evil.com/", "Exame de Ordem XL", "", None, None),
    ("https://oab.org.br/gabarito", "OAB", "<b>mestrado</b>", "nenhum", -0.2),
    ("https://quadrix.com/", "Instituto AOCP e fundação  Carlos Chagas", "2025", "aggregator", None),
    ("nada", "Prova 1999 e 2031", "", "unknown", 0.4),
    ("https://a.b/20240", "sem ano 20255 x2024 2024-2019", "", "official_gazette", None),
]
SITES = f"(SELECT page_id, url, {TITLE} AS title, '' AS text, NULL::VARCHAR AS kind, NULL::DOUBLE AS score FROM pages UNION ALL SELECT * FROM (VALUES {', '.join(f'({-1 - i}, {quoted(u)}, {quoted(h)}, {quoted(x)}, {quoted(k)}, {'NULL' if s is None else s})' for i, (u, h, x, k, s) in enumerate(CASES))}) v(page_id, url, title, text, kind, score))"


def _sites(t):
    literal = t.spark.createDataFrame([(-1 - i, *c) for i, c in enumerate(CASES)], "page_id long, url string, title string, text string, kind string, score double")
    own = t.pages.select("page_id", "url", P.title_of(F.col("html")).alias("title"), F.lit("").alias("text"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("double").alias("score"))
    return own.unionByName(literal)


@query("flt_04", "SELECT capability, role, list_contains(allowed, role) AS allowed, (SELECT count(*) FROM (SELECT CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(ROLES)) + " END AS own FROM documents) WHERE own = role AND list_contains(allowed, role)) AS documents FROM (VALUES " + ", ".join(f"('{c}', {list(a)!r})" for c, a in ALLOWED.items()) + f") v(capability, allowed), (SELECT unnest({list(ROLES)!r}) AS role)")
def capabilities(t):
    """The whole matrix of capabilities and roles, and how many documents each cell lets pass."""
    cells = t.spark.createDataFrame([(c, r, r in a) for c, a in ALLOWED.items() for r in ROLES], "capability string, role string, allowed boolean")
    own = t.documents.select(F.element_at(F.array(*[F.lit(r) for r in ROLES]), (F.col("doc_id") % 6 + 1).cast("int")).alias("role")).groupBy("role").agg(F.count("*").alias("n"))
    return cells.join(own, "role", "left").select("capability", "role", "allowed", F.when(F.col("allowed"), F.coalesce("n", F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long")).alias("documents"))


BLOB = "regexp_replace(concat_ws(' ', title, text), '<[^>]+>', ' ', 'g')"


@query("cf_08", f"""SELECT page_id, CASE WHEN {has(BLOB, OAB)} THEN 'oab' WHEN {has('title', r'\bconcurso\b')} AND NOT {has('title', NO_EXAM)} AND NOT {has('title', r'\bvestibular\b')} THEN 'concurso'
WHEN {has(BLOB, r'\bvestibular\b')} AND NOT {has(BLOB, PUBLIC)} THEN 'vestibular' WHEN {has(BLOB, NO_EXAM)} AND NOT {has(BLOB, PUBLIC)} THEN 'other' ELSE 'concurso' END AS kind FROM {SITES}""")
def exam_kinds(t):
    return _sites(t).select("page_id", exam_kind(F.col("title"), F.col("text")).alias("kind"))


AS_OF = 2024


@query("flt_21", rf"SELECT page_id, year, coalesce(year >= {AS_OF}, true) AS kept FROM (SELECT page_id, nullif(regexp_extract(concat_ws(' ', title, url, text), '\b(20[0-9]{{2}})\b', 1), '')::INT AS year FROM {SITES})")
def inventory_year(t):
    """The first year 20xx of any field against the year of the run; an unknown one stays."""
    year = F.regexp_extract(F.concat_ws(" ", "title", "url", "text"), r"(?<![A-Za-z0-9_])(20[0-9]{2})(?![A-Za-z0-9_])", 1).try_cast("int")
    return _sites(t).select("page_id", year.alias("year")).withColumn("kept", F.coalesce(F.col("year") >= AS_OF, F.lit(True)))


@query("cf_09", f"""SELECT page_id, round(score + 1e-9, 6)::DOUBLE AS score, CASE WHEN official = 1 THEN 'official' WHEN banca = 1 THEN 'banca' ELSE 'unknown' END AS classification,
CASE WHEN score >= 0.85 - 1e-9 AND (official = 1 OR banca = 1) THEN 'auto_activate' WHEN score >= 0.6 - 1e-9 THEN 'quarantine' ELSE 'observe' END AS decision FROM (SELECT *, least(1.0, official * 0.6 + banca * 0.55 + words * 0.1 + robots * 0.1 + yield * 0.15 + observed * 0.05)::DOUBLE AS score FROM
(SELECT page_id, {has(HOST, OFFICIAL)}::INT AS official, {has("coalesce(title, '')", BANCA)}::INT AS banca, {has("coalesce(title, '')", EXAM_WORDS)}::INT AS words, (abs(page_id) % 2) AS robots, (abs(page_id) % 11) / 10.0 AS yield, least(1, abs(page_id) % 3) AS observed FROM {SITES}))""")
def source_scores(t):
    """Identity of host and name, wording, robots, yield and earlier sources; the bands that follow."""
    flag, k = lambda c: c.cast("int"), F.abs("page_id")
    rows = _sites(t).select("page_id", flag(like(host_of(F.col("url")), OFFICIAL)).alias("official"), flag(like(F.col("title"), BANCA)).alias("banca"), flag(like(F.col("title"), EXAM_WORDS)).alias("words"))
    score = F.least(F.lit(1.0), F.col("official") * 0.6 + F.col("banca") * 0.55 + F.col("words") * 0.1 + k % 2 * 0.1 + k % 11 / 10.0 * 0.15 + F.least(F.lit(1), k % 3) * 0.05)
    known = F.when(F.col("official") == 1, "official").when(F.col("banca") == 1, "banca").otherwise("unknown")
    rows = rows.select("page_id", score.alias("s"), known.alias("classification"))
    decision = F.when((F.col("s") >= 0.85 - 1e-9) & (F.col("classification") != "unknown"), "auto_activate").when(F.col("s") >= 0.6 - 1e-9, "quarantine").otherwise("observe")
    return rows.select("page_id", F.round(F.col("s") + 1e-9, 6).alias("score"), "classification", decision.alias("decision"))


def authority(kind: Column, host: Column, score: Column, bonus: Column, penalty: Column) -> Column:
    """An explicit score, else the kind's base with what the domain's ending, history and spam add and take."""
    base = F.lit(KIND_BASE["unknown"])
    for name, value in KIND_BASE.items():
        base = F.when(kind == name, value).otherwise(base)
    ending = F.when(host.contains(".gov.br") | host.endswith(".leg.br"), 0.15).when(host.endswith(".edu.br"), 0.1).when(host.endswith(".org.br"), 0.05).otherwise(0.0)
    return P.clamp01(F.coalesce(score, base + ending + bonus - penalty))


AUTHORITY = f"greatest(0.0, least(1.0, coalesce(score, CASE {' '.join(f'WHEN kind = {quoted(k)} THEN {v}' for k, v in KIND_BASE.items())} ELSE 0.2 END + CASE WHEN contains({HOST}, '.gov.br') OR {HOST} LIKE '%.leg.br' THEN 0.15 WHEN {HOST} LIKE '%.edu.br' THEN 0.1 WHEN {HOST} LIKE '%.org.br' THEN 0.05 ELSE 0 END + abs(page_id) % 3 * 0.05 - abs(page_id) % 5 * 0.05)))::DOUBLE"


def _authority():
    k = F.abs("page_id")
    return authority(F.col("kind"), host_of(F.col("url")), F.col("score"), k % 3 * 0.05, k % 5 * 0.05)


@query("rk_01", f"SELECT page_id, round({AUTHORITY} + 1e-9, 6)::DOUBLE AS authority FROM {SITES}")
def authorities(t):
    return _sites(t).select("page_id", F.round(_authority() + 1e-9, 6).alias("authority"))


@query("rk_02", f"SELECT page_id, round(greatest(0, least(1, 0.35 * {AUTHORITY} + 0.25 * (abs(page_id) % 10) / 10.0 + 0.2 * (abs(page_id) % 7) / 7.0 + 0.1 * (abs(page_id) % 5) / 5.0 + 0.1)) + 1e-9, 5)::DOUBLE AS rank FROM {SITES}")
def page_ranks(t):
    k = F.abs("page_id")
    return _sites(t).select("page_id", F.round(P.page_rank(_authority(), k % 10 / 10.0, k % 7 / 7.0, k % 5 / 5.0, F.lit(1.0)) + 1e-9, 5).alias("rank"))


@query("ex_06", f"SELECT page_id, CASE WHEN regexp_matches(lower(url), 'edital|programa') THEN 'edital' WHEN regexp_matches(lower(url), 'gabarito|resposta') THEN 'gabarito' WHEN regexp_matches(lower(url), 'prova|caderno|quest') THEN 'prova' ELSE 'unknown' END AS kind, CASE WHEN kind IN ('gov', 'official_gazette') THEN 'specification' ELSE 'knowledge' END AS role FROM {SITES}")
def direct_kinds(t):
    """Kind by address; the role is knowledge where the source allows it or allows nothing known, else the first it allows."""
    u = F.lower("url")
    known = F.filter(F.when(F.col("kind").isin("gov", "official_gazette"), F.array(F.lit("nenhum"), F.lit("specification"), F.lit("evidence"))).when(F.col("kind") == "edu", F.array(F.lit("evidence"), F.lit("knowledge"))).otherwise(F.array().cast("array<string>")), lambda r: r.isin(*ROLES))
    role = F.when(F.array_contains(known, "knowledge"), "knowledge").otherwise(F.coalesce(F.get(known, F.lit(0)), F.lit("knowledge")))
    kind = F.when(F.regexp_like(u, F.lit("edital|programa")), "edital").when(F.regexp_like(u, F.lit("gabarito|resposta")), "gabarito").when(F.regexp_like(u, F.lit("prova|caderno|quest")), "prova").otherwise("unknown")
    return _sites(t).select("page_id", kind.alias("kind"), role.alias("role"))


REGISTRATION = ["Inscrições: de 12/08 a 21/09/2026", "INSCRIÇÃO 1/2/24 até 31/02/24", "Período de inscrições:\n01/03/2025 a\t15/03/2025", "inscrições abertas 5/5/2025 a 6/6/2025", "Inscrições abertas até 9/9/25", "inscrição até 40/13/2025", "inscrições 40/01/2025 a 02/02/2025, inscrições até 03/02/2025", "nada", ""]
DATE_SQL = lambda x: f"CASE WHEN regexp_full_match({x}, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}') AND split_part({x}, '/', 2)::INT BETWEEN 1 AND 12 AND split_part({x}, '/', 1)::INT BETWEEN 1 AND 31 THEN make_date(CASE WHEN split_part({x}, '/', 3)::INT < 100 THEN split_part({x}, '/', 3)::INT + 2000 ELSE split_part({x}, '/', 3)::INT END, split_part({x}, '/', 2)::INT, 1) + (split_part({x}, '/', 1)::INT - 1) END"
RANGES = ", ".join(f"regexp_extract(x, '(?i){p}', 1) AS f{i}, regexp_extract(x, '(?i){p}', 2) AS e{i}" for i, p in enumerate(WINDOWS))
STARTS = ", ".join(f"CASE WHEN regexp_matches(f{i}, '/.*/') THEN f{i} ELSE f{i} || '/' || split_part(e{i}, '/', 3) END AS s{i}" for i in range(3))
GOOD = [f"{DATE_SQL(f's{i}')} IS NOT NULL AND {DATE_SQL(f'e{i}')} IS NOT NULL" for i in range(3)]
PICK = lambda k: "CASE " + " ".join(f"WHEN {g} THEN {DATE_SQL(f'{k}{i}')}" for i, g in enumerate(GOOD)) + f" ELSE {DATE_SQL('u')} END"
TEXTS = f"(SELECT o_orderkey, 'Inscrições de ' || strftime(o_orderdate, '%d/%m') || ' a ' || strftime(o_orderdate, '%d/%m/%Y') AS text FROM orders UNION ALL SELECT * FROM (VALUES {', '.join(f'({-1 - i}, {quoted(x)})' for i, x in enumerate(REGISTRATION))}) v(o_orderkey, text))"


@query("lc_06", f"SELECT o_orderkey, {PICK('s')} AS start_day, {PICK('e')} AS end_day FROM (SELECT *, {STARTS} FROM (SELECT o_orderkey, {RANGES}, regexp_extract(x, '(?i){UNTIL}', 1) AS u FROM (SELECT o_orderkey, regexp_replace(text, '{SPACES}+', ' ', 'g') AS x FROM {TEXTS})))")
def registration_windows(t):
    own = t.orders.select("o_orderkey", F.concat(F.lit("Inscrições de "), F.date_format("o_orderdate", "dd/MM"), F.lit(" a "), F.date_format("o_orderdate", "dd/MM/yyyy")).alias("text"))
    rows = own.unionByName(t.spark.createDataFrame([(-1 - i, x) for i, x in enumerate(REGISTRATION)], "o_orderkey long, text string"))
    return rows.select("o_orderkey", registration_window(F.col("text")).alias("w")).select("o_orderkey", F.col("w.start").alias("start_day"), F.col("w.end").alias("end_day"))
