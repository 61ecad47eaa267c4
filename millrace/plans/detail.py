"""Detail pages of exams (EX-01, EX-02) over all pages and literal ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import curation as C
from millrace.operators import items as I
from millrace.plans import Catalog
from millrace.plans.roles import has, quoted
from millrace.plans.rules import TIDY
from millrace.plans.sites import PICK, RANGES, STARTS
from millrace.plans.syllabus import EACH, LET, ONLY, SLUG, SQUEEZE
from millrace.plans.web import ANCHORED, LISTED, _sql_decoded
from millrace.sources import detail as D
from millrace.sources import listings as L
from millrace.sources import pages as P

catalog = Catalog()
query = catalog.query

TODAY = "2026-09-01"
CHROME = "<title>Concursos | Portal</title><h1>Menu</h1>"
#: url, html of literal pages.
CASES = [
    ("https://b.org/concurso/transpetro-2026/", "<title>Concurso Transpetro 2026</title><h1>Transpetro</h1><p>Banca: Cesgranrio. Inscrições de 12/08 a 21/09/2026. Cargo: Engenheiro Civil. Vagas: Técnico de Enfermagem</p><a href='/e/edital-1.pdf'>Edital nº 1</a><a href='/e/x.pdf'>Anexo</a><a href='/sobre'>Sobre nós e outros temas</a>"),
    ("https://b.org/concursos/PM_AL_26", CHROME + "<h2>Menu</h2><h2>Polícia Militar <b>de Alagoas</b></h2><p>Edital de abertura nº 12/2025-A. Inscrições abertas.</p><a href='https://b.org/d.pdf'>Documento</a>"),
    ("https://b.org/concursos/TJ_CE_25_NOTARIOS/", CHROME + "<p>nada</p>"),
    ("https://b.org/concursos/1", CHROME + "<p>nada</p>"),
    ("https://b.org/concursos/em-andamento", "<title>x</title><p>Vestibular e mestrado</p>"),
    ("https://b.org/x", "<title>Concursos Públicos no Estado</title><p>SANTOS - CONCURSO PÚBLICO - 74/2026 SEPLA-RH Aberto</p><script>var edital = 'edital nº 9';</script>"),
    ("https://b.org/y", "<h1>Prefeitura de Recife &amp; região 2027</h1><p>Período de inscrições: 01/01/2026 a 02/02/2026</p><a href='/edital/todos'>Programa completo</a>"),
    ("https://b.org/z?c=/concursos/nao", "<h1>${titulo}</h1><p>OAB: exame de ordem, direito, DIREITO, engenharia naval, TI e medicina, contabilidade, enfermagem, administração</p>"),
]
DETAILED = "(SELECT page_id, url, html FROM pages UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-1 - i}, {quoted(u)}, {quoted(x)})" for i, (u, x) in enumerate(CASES)) + ") v(page_id, url, html))"
LISTED_AS = "CASE WHEN page_id % 3 = 0 THEN 'Concursos' ELSE 'Listagem ' || page_id END"


def _pages(t):
    rows = t.pages.select("page_id", "url", "html").unionByName(t.spark.createDataFrame([(-1 - i, u, x) for i, (u, x) in enumerate(CASES)], "page_id long, url string, html string"))
    return rows.withColumn("listed", F.when(F.col("page_id") % 3 == 0, "Concursos").otherwise(F.concat(F.lit("Listagem "), F.col("page_id").cast("string"))))


def TEXT(x: str) -> str:
    return _sql_decoded(SQUEEZE(f"regexp_replace(regexp_replace(regexp_replace({x}, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')"))


FIRST = lambda x, p, k=0: f"nullif(regexp_extract({x}, '{C.sql_regex(p)}', {k}), '')"
JUNK = lambda x: f"(length({TIDY(x)}) < 4 OR regexp_matches({TIDY(x)}, '{P.TEMPLATE_LEFT.replace(chr(39), chr(39) * 2)}') OR regexp_matches({TIDY(x)}, '{C.sql_regex(P.CHROME_TITLE)}'))"
TAG = lambda name: TEXT(f"regexp_extract(html, '(?is)<{name}[^>]*>(.*?)</{name}>', 1)")
RAW = f"trim(regexp_replace(coalesce(url_decode(regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '(?i){D.PATH}', 1)), ''), '[-_]+', ' ', 'g'))"
NAVIGATION = "list_aggregate(list_transform(list_filter(string_split({0}, '-'), lambda w: w <> ''), lambda w: list_contains(" + repr(P.NAV_WORDS) + ", w)), 'bool_and')"
PATH_SLUG = LET(SLUG(RAW), lambda s: f"CASE WHEN {RAW} <> '' AND length({s}) >= 4 AND regexp_matches({s}, '[a-z]') AND NOT {NAVIGATION.format(s)} THEN {s} END")
SECOND = ONLY(EACH("regexp_extract_all(html, '(?is)<h2[^>]*>(.*?)</h2>', 1)", TEXT), lambda t: f"length({t}) BETWEEN 5 AND 120 AND NOT {JUNK(t)}") + "[1]"
DOCS = f"""(SELECT *, CASE {' '.join(f"WHEN regexp_matches(title || ' ' || href, '{C.sql_regex(p)}') THEN '{k}'" for k, _, p in I.HINTS)} ELSE 'unknown' END AS kind FROM (SELECT page_id, href, min(pos) AS pos, arg_min(title, pos) AS title FROM {ANCHORED.replace(LISTED, DETAILED)}
WHERE href IS NOT NULL AND length(title) >= 3 AND NOT regexp_matches(title, '{C.sql_regex(L.SKIPPED)}') AND NOT regexp_matches(href, '{C.sql_regex(L.SKIPPED)}') AND (regexp_matches(href, '{C.sql_regex(L.PDF)}') OR regexp_matches(title, '{C.sql_regex(L.DOCUMENT_LABEL)}')) GROUP BY page_id, href))"""
FIRSTS = lambda xs, most: LET(xs, lambda l: f"list_filter({l}, lambda y, i: list_position({l}, y) = i)[1:{most}]")
POSTS = EACH(f"regexp_extract_all(text, '{C.sql_regex(D.POST)}', 1)", SQUEEZE)
SUBJECTS = EACH(f"regexp_extract_all(title || ' ' || text, '{C.sql_regex(D.EMPHASIS)}')", SQUEEZE)
BLOB = "regexp_replace(title || ' ' || head, '<[^>]+>', ' ', 'g')"
DETAIL = f"""t1 AS (SELECT *, {TEXT('html')} AS text, {PATH_SLUG} AS path_slug, {SECOND} AS second, {TAG('h1')} AS h1, {TAG('title')} AS tag FROM {DETAILED}), t2 AS (SELECT *, CASE WHEN length(h1) >= 8 THEN h1 WHEN length(tag) >= 8 THEN tag ELSE '' END AS own, regexp_extract(text, '{D.HEADLINE.replace(chr(39), chr(39) * 2)}', 1) AS headline, {LISTED_AS} AS listed FROM t1),
t3 AS (SELECT *, CASE WHEN headline <> '' THEN {SQUEEZE('headline')} WHEN own <> '' AND NOT {JUNK('own')} THEN own ELSE coalesce(second, upper(replace(path_slug, '-', ' ')), CASE WHEN {JUNK('listed')} THEN CASE WHEN own <> '' THEN own ELSE listed END ELSE listed END) END AS title, substr(text, 1, {D.BLOCK_CHARS}) AS head FROM t2),
t4 AS (SELECT *, title || ' ' || head AS block, {SQUEEZE('text')} AS x FROM t3), t5 AS (SELECT *, {RANGES}, regexp_extract(x, '(?i){D.UNTIL}', 1) AS u FROM t4), t6 AS (SELECT *, {STARTS} FROM t5), t7 AS (SELECT *, {PICK('s')} AS start_day, {PICK('e')} AS end_day FROM t6),
t8 AS (SELECT *, coalesce({FIRST('title', D.HOLDER)}, {FIRST('block', D.HOLDER)}) AS org, coalesce({FIRST('title', D.SETTER)}, {FIRST('block', D.SETTER)}, {FIRST('text', D.SETTER)}) AS banca,
 coalesce({FIRST('text', D.NOTICE_NUMBER, 1)}, nullif(regexp_extract(path_slug, '(20\\d{{2}})', 1), ''), '20' || nullif(regexp_extract(path_slug, '(?:^|-)(2\\d)(?:-|$)', 1), ''), nullif(regexp_extract(title, '\\b(20\\d{{2}})\\b', 1), '')) AS edition,
 {has('text', P.OPEN_HINT)} OR {has('title', P.OPEN_HINT)} AS hint FROM t7),
d AS (SELECT page_id, count(*) AS n, arg_min(href, (CASE WHEN kind IN ('edital', 'retificacao') THEN 0 WHEN {has('href', 'edital')} THEN 1 END, pos)) FILTER (kind IN ('edital', 'retificacao') OR {has('href', 'edital')}) AS notice, bool_or(kind IN {tuple(D.SPECIFYING)!r}) AS specified FROM {DOCS} GROUP BY 1),
detail AS (SELECT page_id, title, org, banca, edition, CASE WHEN org IS NOT NULL AND edition IS NOT NULL THEN {SLUG('org')} || '-' || edition END AS slug,
CASE WHEN {has(BLOB, D.OAB)} THEN 'oab' WHEN {has('title', r'\bconcurso\b')} AND NOT {has('title', D.NO_EXAM)} AND NOT {has('title', r'\bvestibular\b')} THEN 'concurso' WHEN {has(BLOB, r'\bvestibular\b')} AND NOT {has(BLOB, D.PUBLIC)} THEN 'vestibular' WHEN {has(BLOB, D.NO_EXAM)} AND NOT {has(BLOB, D.PUBLIC)} THEN 'other' ELSE 'concurso' END AS kind,
start_day, end_day, CASE WHEN CASE WHEN start_day IS NOT NULL THEN DATE '{TODAY}' BETWEEN start_day AND end_day ELSE hint END THEN 'open' ELSE 'unknown' END AS status, CASE WHEN start_day IS NOT NULL THEN 'date' WHEN hint THEN 'regex' END AS source,
{FIRSTS(f"list_filter({POSTS}, lambda p: length(p) >= 4)", D.MOST_POSTS)} AS positions, {FIRSTS(SUBJECTS, D.MOST_EMPHASIS)} AS emphasis,
coalesce(n, 0) AS n_documents, notice, (edition IS NOT NULL OR start_day IS NOT NULL OR coalesce(specified, false)) AND NOT {JUNK('title')} AS identified FROM t8 LEFT JOIN d USING (page_id))"""


def _details(t):
    return D.detail_pages(_pages(t), F.to_date(F.lit(TODAY)))


@query("ex_01", f"WITH {DETAIL} SELECT * REPLACE (array_to_string(positions, '|') AS positions, array_to_string(emphasis, '|') AS emphasis) FROM detail")
def detail_pages(t):
    return _details(t).withColumns({c: F.array_join(c, "|") for c in ("positions", "emphasis")})


@query("ex_02", f"""WITH {DETAIL}, docs AS (SELECT page_id, href FROM {DOCS}), l AS (SELECT DISTINCT page_id, href FROM {ANCHORED.replace(LISTED, DETAILED)} WHERE href IS NOT NULL AND length(title) >= 8 AND NOT regexp_matches(title, '{C.sql_regex(L.JUNK_TITLE)}') AND NOT regexp_matches(href, '{C.sql_regex(L.JUNK_URL)}')),
s AS (SELECT l.page_id, count(*) AS links, count(*) FILTER (regexp_matches(l.href, '(?i)\\.pdf(\\?|#|$)') OR d.href IS NOT NULL) AS held FROM l LEFT JOIN docs d ON d.page_id = l.page_id AND d.href = l.href GROUP BY 1)
SELECT page_id, end_day IS NOT NULL AND n_documents > 0 AND coalesce(held / links >= {D.SELF_SHARE}, true) AS own, identified FROM detail LEFT JOIN s USING (page_id)""")
def self_details(t):
    pages, details = _pages(t), _details(t)
    own = D.self_details(details, L.listing_links(pages, []), L.document_links(pages))
    return own.join(details.select("page_id", "identified"), "page_id")
