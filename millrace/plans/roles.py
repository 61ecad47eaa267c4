"""Document and section roles (CF-01..04, AG-18) over all documents, each as one section, and over literal boundary cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import curation as C
from millrace.operators import roles as R
from millrace.plans import Catalog

catalog = Catalog()
query = catalog.query

PROSE = "Texto corrido sobre o assunto com frases longas e sem listas, que segue adiante sem parar para que o parágrafo passe do tamanho. " * 3
#: Boundary cases: heading, text.
CASES = [
    ("Edital nº 3", "Edital de abertura nº 3\n\nDas inscrições. Das vagas. Da remuneração. Cronograma."),
    (None, "edital n\nº 3 sem número na linha"),
    ("Anexo II", "anexo com o programa da prova discursiva e o caderno azul"),
    ("Gabarito", " ".join(f"{i} - {'ABCDE'[i % 5]}" for i in range(1, 11))),
    ("Gabarito oficial", " ".join(f"{i}.A" for i in range(1, 10))),
    (None, " ".join(f"Questão {i}" for i in range(1, 11))),
    (None, " ".join(f"questao {i}, questão {i}" for i in range(1, 10))),
    ("Capítulo 2", "art. 1 art. 2 Art. 3 art.4 art. 5"),
    (None, "art. 1 art. 2 art. 3 art. 4"),
    ("Resumo", f"{PROSE}\n\n{PROSE}\n\nTÍTULO\n\n{PROSE}\n\n{PROSE}\n\n{PROSE}"),
    (None, "\n\n".join([PROSE] * 9 + ["Exemplo: um. exemplo: dois. EXEMPLO: três."])),
    ("Notícias", "http://a.b\n\nhttp://c.d\n\nhref= x"),
    ("Resultado final", "Edital de resultado final. Relação de candidatos inscritos."),
    ("Convocação", "convocação para a prova, conteúdos programáticos no anexo"),
    ("Conteúdo Programático", "Direito. Português."),
    ("Programa", "tópicos"),
    ("Programador de sistemas", "texto simples"),
    ("Quadro", "cargo | vagas | requisitos\nAnalista | 3 | superior"),
    ("Datas", "01/02/2024 a 03-04-24 e 5.6.2025"),
    ("Datas", "01/02/2024 a 03-04-24"),
    ("Inscrição", "aqui"),
    (None, "paga a taxa em CPF"),
    ("Das provas", "nada"),
    (None, "peso dois"),
    ("Das disposições", "nada"),
    (None, "o candidato deve chegar cedo e deverá sair tarde"),
    (None, "A) um\nB) dois\n C) três\nD) quatro"),
    (None, "A) um\nB) dois\nC) três"),
    ("Leia também", "A) um\nB) dois\nC) três\nD) quatro"),
    ("Menu", "x"),
    (None, ""),
    (None, "apostila | boleto | caderno"),
    (None, "Apostila de exercícios.\n\nBoleto bancário."),
]
HINTS = [None, "unknown", "edital", "prova", "apostila", "listing", "artigo", "nenhum"]


def quoted(value) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


VALUES = ", ".join(f"({-1 - i}, {quoted(h)}, {quoted(x)}, {quoted(HINTS[i % len(HINTS)])}, {quoted('evidence' if i % 11 == 5 else None)})" for i, (h, x) in enumerate(CASES))
ROWS = f"(SELECT doc_id, NULL::VARCHAR AS heading, text, NULL::VARCHAR AS kind_hint, NULL::VARCHAR AS role_hint FROM documents UNION ALL SELECT * FROM (VALUES {VALUES}) v(doc_id, heading, text, kind_hint, role_hint))"


def _rows(t):
    cases = [(-1 - i, h, x, HINTS[i % len(HINTS)], "evidence" if i % 11 == 5 else None) for i, (h, x) in enumerate(CASES)]
    literal = t.spark.createDataFrame(cases, "doc_id long, heading string, text string, kind_hint string, role_hint string")
    none = F.lit(None).cast("string")
    return t.documents.select("doc_id", none.alias("heading"), "text", none.alias("kind_hint"), none.alias("role_hint")).unionByName(literal)


def has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '{C.sql_regex(pattern)}')"


def times(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{C.sql_regex(pattern)}'))"


def plain(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def either(text: str, patterns) -> str:
    return "(" + " OR ".join(has(text, p) if isinstance(p, str) else f"{times(text, p[0])} >= {p[1]}" for p in patterns) + ")"


SPACES = "[\\s\\x0b\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"
DENSITY = "CASE WHEN len(list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')) = 0 THEN 0.0 ELSE least(1.0, len(regexp_extract_all({x}, '(?i)" + C.LINK + "')) / greatest(len(list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')) / 20, 1.0)) END::DOUBLE"
PARAGRAPHS = "list_filter(string_split_regex(%s, '\\n{2,}'), lambda p: NOT regexp_full_match(p, '" + SPACES + "*'))"
INPUT = f"""(SELECT *, coalesce(heading, '') || '\n' || substr(text, 1, 600) AS block, substr(text, 1, 8000) AS sample, coalesce(heading, '') || '\n' || text AS whole FROM {ROWS})"""
WHOLE = f"""(SELECT *, coalesce(heading, '') || '\n' || text AS block, text AS sample FROM {ROWS})"""


def _votes(rows: str) -> str:
    """Votes on rows that have a block (heading and text) and a sample."""
    measured = f"(SELECT *, {DENSITY.format(x='sample')} AS density, {PARAGRAPHS % 'sample'} AS ps FROM {rows})"
    counted = "(SELECT *, len(ps) AS n, coalesce(list_sum(list_transform(ps, lambda p: length(p))), 0) AS total, len(list_filter(ps, lambda p: length(p) >= 300)) AS long_ps, len(list_filter(ps, lambda p: length(p) < 80 AND regexp_matches(p, '(?i)href|http'))) AS links FROM " + measured + ")"
    return f"""(SELECT *, (CASE WHEN {either('block', R.SPECIFICATION)} OR {either('sample', R.SPECIFICATION)} THEN 0.5 ELSE 0 END)::DOUBLE + (CASE WHEN {' + '.join(f'{has("sample", p)}::INT' for p in R.SPECIFICATION_BODY)} >= 3 THEN 0.3 ELSE 0 END)::DOUBLE AS specification,
CASE WHEN {either('sample', R.EVIDENCE)} THEN 0.5 END::DOUBLE AS evidence,
(CASE WHEN {either('sample', R.KNOWLEDGE)} THEN 0.5 ELSE 0 END)::DOUBLE + (CASE WHEN n > 0 AND long_ps >= 0.6 * n AND {plain('sample', R.HEADING)} / n BETWEEN 0.02 AND 0.2 AND density < 0.1 AND total >= 300 * n THEN 0.3 ELSE 0 END)::DOUBLE AS knowledge,
(CASE WHEN {either('block', R.ADMINISTRATIVE)} OR {either('sample', R.ADMINISTRATIVE)} THEN 0.5 ELSE 0 END)::DOUBLE + (CASE WHEN n > 0 AND (density > 0.3 OR total < 120 * n OR links >= 0.4 * n) THEN 0.3 ELSE 0 END)::DOUBLE AS administrative FROM {counted})"""


VOTES = _votes(INPUT)
RANKED = f"""(SELECT doc_id, first(role ORDER BY w DESC, i) AS top, max(w) AS w1, coalesce(list(w ORDER BY w DESC, i)[2], 0) AS w2 FROM (
{' UNION ALL '.join(f"SELECT doc_id, {i} AS i, '{r}' AS role, {r} AS w FROM votes WHERE {r} IS NOT NULL" for i, r in enumerate(R.ROLES))}) GROUP BY 1)"""
MIXED = "w1 >= 0.5 AND top IN ('specification', 'evidence') AND w2 >= 0.5"
DECIDED = f"(SELECT doc_id, CASE WHEN {MIXED} THEN 'mixed' ELSE top END AS role, CASE WHEN {MIXED} THEN least(0.9, w1) WHEN w1 - w2 >= 0.3 THEN least(0.95, w1 + 0.2) ELSE greatest(0.4, w1) END::DOUBLE AS confidence FROM {RANKED})"
KIND = "CASE " + " ".join(f"WHEN kind_hint = '{k}' THEN '{r}'" for k, r in R.KIND_ROLES.items()) + " ELSE 'unknown' END"
HINT = f"CASE WHEN coalesce(role_hint, 'unknown') <> 'unknown' THEN role_hint WHEN coalesce(kind_hint, 'unknown') <> 'unknown' THEN {KIND} END"
WEIGHT = "CASE WHEN coalesce(role_hint, 'unknown') <> 'unknown' THEN 0.95 WHEN coalesce(kind_hint, 'unknown') <> 'unknown' THEN 0.9 END::DOUBLE"


def _with_blocks(t):
    heading = F.coalesce("heading", F.lit(""))
    rows = _rows(t).withColumns({"block": F.concat(heading, F.lit("\n"), F.substring("text", 1, 600)), "sample": F.substring("text", 1, 8000), "whole": F.concat(heading, F.lit("\n"), F.col("text"))})
    return rows.withColumns({"density": C.link_density(F.col("sample")), "hint": R.hint_vote(F.col("role_hint"), F.col("kind_hint"))})


@query("cf_01", f"SELECT doc_id, {HINT} AS role, {WEIGHT} AS confidence FROM {ROWS}")
def role_by_hint(t):
    return _with_blocks(t).select("doc_id", F.col("hint.role").alias("role"), F.col("hint.weight").alias("confidence"))


@query("cf_02", f"SELECT doc_id, specification, evidence, knowledge, administrative FROM {VOTES}")
def lexical_votes(t):
    return _with_blocks(t).select("doc_id", R.lexical_votes(F.col("block"), F.col("sample"), F.col("density")).alias("v")).select("doc_id", "v.*")


@query("ag_18", f"WITH votes AS (SELECT doc_id, specification, evidence, knowledge, administrative FROM {_votes(WHOLE)}) SELECT doc_id, role, round(confidence, 6) AS confidence FROM {DECIDED}")
def role_votes(t):
    """A margin raises confidence; two strong roles make a mixed document. Whole texts vote."""
    whole = F.concat(F.coalesce("heading", F.lit("")), F.lit("\n"), F.col("text"))
    votes = R.lexical_votes(whole, F.col("text"), C.link_density(F.col("text")))
    return _rows(t).select("doc_id", R.decide(votes).alias("d")).select("doc_id", "d.role", F.round("d.confidence", 6).alias("confidence"))


@query("cf_03", f"""WITH votes AS MATERIALIZED (SELECT doc_id, specification, evidence, knowledge, administrative, {HINT} AS hint, {WEIGHT} AS weight, {has('block', R.NOTICE)} AND NOT {has('whole', R.PROGRAMME)} AS notice FROM {VOTES})
SELECT doc_id, CASE WHEN notice AND coalesce(hint NOT IN ('evidence', 'knowledge'), true) THEN 'administrative' WHEN coalesce(hint, 'unknown') <> 'unknown' THEN hint ELSE d.role END AS role,
round(CASE WHEN notice AND coalesce(hint NOT IN ('evidence', 'knowledge'), true) THEN 0.85::DOUBLE WHEN coalesce(hint, 'unknown') <> 'unknown' THEN weight ELSE d.confidence END, 6) AS confidence,
CASE WHEN notice AND coalesce(hint NOT IN ('evidence', 'knowledge'), true) THEN 'tier1_admin_override' WHEN coalesce(hint, 'unknown') <> 'unknown' THEN 'tier0_provenance' ELSE 'tier1_lexical' END AS method
FROM votes JOIN {DECIDED} d USING (doc_id)""")
def document_roles(t):
    role = R.document_role(*map(F.col, ("block", "sample", "block", "whole", "hint", "density")))
    return _with_blocks(t).select("doc_id", role.alias("r")).select("doc_id", "r.role", F.round("r.confidence", 6).alias("confidence"), "r.method")


H = "coalesce(heading, '')"
OPTIONS, KEYS = f"len(regexp_extract_all(text, '{R.OPTION}')) >= 4", f"len(regexp_extract_all(text, '{R.KEY}')) >= 10"
LINKED = DENSITY.format(x="text") + " > 0.5"
STUDY = f"CASE WHEN {has(H, R.NAVIGATION_HEADING)} OR {LINKED} THEN 'nav' WHEN {OPTIONS} THEN 'question_block' WHEN {has(H, 'gabarito')} AND {KEYS} THEN 'answer_key' WHEN legal THEN 'legal_article' ELSE 'content' END"
LADDER = f"""CASE WHEN {has(H, R.SYLLABUS_HEADING)} OR ({has(H, R.PROGRAMME_HEADING)} AND NOT {has(H, R.PROGRAMMER)}) THEN 'syllabus' WHEN {has(H + " || chr(10) || text", R.VACANCIES)} AND contains(text, '|') THEN 'vacancies'
WHEN {has(H, 'cronograma')} OR len(regexp_extract_all(text, '{R.DATE}')) >= 3 THEN 'schedule' WHEN {has(H, 'inscri')} OR {has('text', R.REGISTRATION)} THEN 'registration' WHEN {has(H, 'das provas')} OR {has('text', R.EXAM)} THEN 'exam_structure'
WHEN {has(H, R.DISPOSITIONS)} THEN 'legal_disposition' WHEN {times('text', R.DUTY)} / greatest(len(string_split_regex(text, '[\\s\\x0b]+')), 1) > 0.015 THEN 'instructional' WHEN {OPTIONS} THEN 'question_block'
WHEN {has(H, 'gabarito')} OR {KEYS} THEN 'answer_key' WHEN {LINKED} THEN 'nav' WHEN legal THEN 'legal_article' ELSE 'content' END"""


@query("cf_04", f"SELECT doc_id, {LADDER} AS role, {STUDY} AS study_role FROM (SELECT *, regexp_matches(text, '^Art\\. ') AS legal FROM {ROWS})")
def section_roles(t):
    rows = _rows(t).withColumn("legal", F.regexp_like("text", F.lit(r"^Art\. ")))
    role = lambda kind: R.section_role(F.col("heading"), F.col("text"), F.lit(0.0), F.col("legal"), F.lit(kind))
    return rows.select("doc_id", role("specification").alias("role"), role("knowledge").alias("study_role"))
