"""Documents laid out on pages as spans, read back as paragraphs, blocks and sections (SRC-04, SRC-06, ST-01, ST-02)."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import layout as L
from millrace.operators import sections as S
from millrace.plans import Catalog
from millrace.plans.roles import quoted
from millrace.plans.rules import TIDY

catalog = Catalog()
query = catalog.query

WIDTH = 600.0
#: Lines of documents as two spans each; sizes, gaps and fonts by the length of the line; thirty lines a page, in two columns on every other page of a third of the documents.
_LINES = """(SELECT *, length(line) AS n, 1 + pos // 30 AS page, pos % 30 AS k FROM (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents))"""
SPANS = f"""(SELECT doc, page, pos AS line, CASE WHEN n % 11 = 0 THEN upper(replace(line, 'ß', 'ss')) WHEN n % 6 = 1 THEN line || '-' ELSE line END AS text, CASE WHEN n % 13 = 0 THEN NULL WHEN n % 17 = 0 THEN 18.0 WHEN n % 19 = 0 THEN 13.0 WHEN n % 23 = 0 THEN 15.0 ELSE 10.0 END AS size, n % 29 = 0 AS bold,
CASE WHEN doc % 3 = 0 AND k % 2 = 1 THEN 330.0 ELSE 40.0 END + n % 8 AS x0, CASE WHEN doc % 3 = 0 THEN CASE WHEN k % 2 = 1 THEN 560.0 ELSE 260.0 END ELSE 500.0 END AS x1,
CASE WHEN doc % 3 = 0 THEN k // 2 ELSE k END * 20.0 + CASE WHEN n % 7 = 0 THEN 9 ELSE 0 END AS y0 FROM {_LINES})"""


def _spans(t):
    c = F.col
    text = t.documents.select(c("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    n, k = c("n"), c("k")
    rows = text.withColumns({"n": F.char_length("raw"), "page": F.floor(c("pos") / 30) + 1, "k": c("pos") % 30})
    whole = F.when(n % 11 == 0, F.upper("raw")).when(n % 6 == 1, F.concat("raw", F.lit("-"))).otherwise(c("raw"))
    size = F.when(n % 13 == 0, None).when(n % 17 == 0, 18.0).when(n % 19 == 0, 13.0).when(n % 23 == 0, 15.0).otherwise(10.0)
    two = c("doc") % 3 == 0
    box = {
        "x0": F.when(two & (k % 2 == 1), 330.0).otherwise(40.0) + n % 8,
        "x1": F.when(two, F.when(k % 2 == 1, 560.0).otherwise(260.0)).otherwise(500.0),
        "y0": F.when(two, F.floor(k / 2)).otherwise(k) * 20.0 + F.when(n % 7 == 0, 9).otherwise(0),
    }
    rows = rows.withColumns({"whole": whole, "size": size, **box}).withColumn("y1", c("y0") + 12)
    cut = F.floor(F.char_length("whole") / 2).cast("int")
    pieces = F.array(F.struct(F.lit(0).alias("span"), F.substring(c("whole"), F.lit(1), cut).alias("text"), c("size").alias("size"), F.when(n % 29 == 0, "Arial-Bold").otherwise("Arial").alias("font")), F.struct(F.lit(1).alias("span"), F.substring(c("whole"), cut + 1, F.char_length("whole")).alias("text"), F.when(c("size").isNotNull(), 9.0).alias("size"), F.lit(None).cast("string").alias("font")))
    return rows.select("doc", "page", c("pos").alias("line"), "x0", "y0", "x1", "y1", F.explode(pieces).alias("s")).select("doc", "page", "line", "x0", "y0", "x1", "y1", "s.*")


def _heading(x: str, body: str) -> str:
    letters, capitals = f"length(regexp_replace({x}.text, '\\P{{L}}', '', 'g'))", f"length(regexp_replace({x}.text, '[^\\p{{Lu}}]', '', 'g'))"
    return f"({x}.text <> '' AND length({x}.text) <= {L.LONGEST_LINE} AND (({letters} >= 3 AND {capitals} >= 0.9 * {letters}) OR (coalesce({x}.size >= {body} * {L.LARGE}, false) AND length({x}.text) <= {L.LONGEST_LARGE}) OR ({x}.bold AND length({x}.text) <= {L.LONGEST_BOLD})))"


def _step(s: str, x: str) -> str:
    """s and x are lists of paragraphs; x holds the line at hand, with the page's body and height."""
    a, b = f"{s}[-1]", f"{x}[1]"
    first = f"substr({b}.text, 1, 1)"
    hyphen = f"({a}.text LIKE '%-' AND {first} = lower({first}) AND {first} <> upper({first}))"
    text = f"CASE WHEN {hyphen} THEN substr({a}.text, 1, length({a}.text) - 1) || {b}.text ELSE {a}.text || ' ' || {b}.text END"
    more = f"{{'text': {text}, 'y1': {b}.y1, 'y0': {a}.y0, 'size': coalesce({a}.size, {b}.size), 'bold': {a}.bold OR {b}.bold, 'body': {a}.body, 'height': {a}.height}}"
    goes_on = f"{b}.y0 - {a}.y1 >= 0 AND {b}.y0 - {a}.y1 < {L.GAP} * {b}.height AND NOT {_heading(a, f'{a}.body')} AND NOT {_heading(b, f'{b}.body')}"
    return f"CASE WHEN {goes_on} THEN list_append({s}[1:-2], {more}) ELSE list_concat({s}, {x}) END"


PARAGRAPHS = f"""WITH l AS (SELECT doc, page, line, {TIDY('text')} AS text, size, bold, x0, x1, y0, y0 + 12 AS y1, (x0 + x1) / 2 AS c FROM {SPANS} WHERE {TIDY('text')} <> ''),
m AS (SELECT doc, page, avg(c) FILTER (c < 290) AS a, avg(c) FILTER (c > 310) AS b, count(*) AS n, list_sort(list(size) FILTER (size IS NOT NULL)) AS sizes FROM l GROUP BY 1, 2),
near AS (SELECT doc, page, count(*) FILTER (abs(c - a) < 40 OR abs(c - b) < 40) AS near FROM l JOIN m USING (doc, page) GROUP BY 1, 2),
o AS (SELECT l.*, sizes[len(sizes) // 2 + 1] AS body, CASE WHEN n >= 4 AND a IS NOT NULL AND b IS NOT NULL AND near >= 0.7 * n AND abs(a - 300) >= 30 AND abs(b - 300) >= 30 AND abs(c - a) > abs(c - b) THEN 1 ELSE 0 END AS side FROM l JOIN m USING (doc, page) JOIN near USING (doc, page)),
f AS (SELECT doc, page, list_reduce(list([{{'text': text, 'y1': y1, 'y0': y0, 'size': size::DOUBLE, 'bold': bold, 'body': body::DOUBLE, 'height': 12.0::DOUBLE}}] ORDER BY side, y0, x0, line), lambda s, x: {_step('s', 'x')}) AS ps FROM o GROUP BY 1, 2),
p AS (SELECT doc, page, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS place FROM f)"""


def _paragraphs(t):
    """Paragraphs of all pages."""
    return L.paragraphs(L.lines_of_spans(_spans(t), most_pages=None), WIDTH)


@query("src_06", f"{PARAGRAPHS} SELECT doc, page, place, p.text AS text, p.size AS size, p.bold AS bold FROM p")
def page_paragraphs(t):
    return _paragraphs(t).select("doc", "page", "place", "text", "size", "bold")


BLOCKS = f"""{PARAGRAPHS}, d AS (SELECT doc, list_sort(list(p.size) FILTER (p.size IS NOT NULL)) AS sizes FROM p GROUP BY 1), b AS (SELECT *, coalesce(sizes[len(sizes) // 2 + 1], 12) AS body FROM p JOIN d USING (doc)),
h AS (SELECT *, coalesce(p.size >= body * {L.LARGE}, false) AND length(p.text) <= {L.LONGEST_HEADING} AS heading FROM b),
blocks AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY page, place) AS place, page, CASE WHEN heading THEN 'heading' ELSE 'paragraph' END AS kind, CASE WHEN heading THEN CASE WHEN p.size >= body * 1.5 THEN 1 WHEN p.size >= body * 1.3 THEN 2 ELSE 3 END END AS level, p.text AS text FROM h)"""


def _blocks(t):
    return L.blocks(_paragraphs(t))


@query("src_04", f"{BLOCKS} SELECT * FROM blocks")
def page_blocks(t):
    return _blocks(t)


#: doc, place, page, kind, level, text of literal blocks; doc, table, markdown of literal tables.
LITERAL = [
    (-1, 1, 1, "paragraph", None, "antes de tudo"), (-1, 2, 1, "heading", 2, "Capítulo"), (-1, 3, 1, "paragraph", None, "a) um\n• dois\n  livre\nII – três\n1. quatro\n(b) cinco"), (-1, 4, 2, "page_artifact", None, "Página 2"), (-1, 5, 2, "paragraph", None, "  "), (-1, 6, 2, "paragraph", None, "1.2. Subtópico numerado"), (-1, 7, 2, "paragraph", None, "texto - sem marca"),
    (-1, 8, 3, "paragraph", None, "Art. 5º Todos são iguais"), (-1, 9, 3, "paragraph", None, "§ 1º parágrafo"), (-1, 10, 3, "paragraph", None, "artigo 12 da lei"), (-1, 11, None, "paragraph", None, "IV) Romano"), (-1, 12, None, "paragraph", None, "B - Letra"), (-1, 13, None, "paragraph", None, "DAS PROVAS, DAS VAGAS"), (-1, 14, None, "paragraph", None, "PALAVRA"), (-1, 15, None, "heading", 0, "Título sem nível"),
    (-2, 1, 1, "paragraph", None, "só texto"), (-2, 2, 1, "page_artifact", None, "rodapé"), (-2, 3, 2, "paragraph", None, "a) fica assim"), (-3, 1, None, "page_artifact", None, "SÓ RODAPÉ AQUI"), (-4, 1, 1, "paragraph", None, None),
]
LITERAL_TABLES = [(-1, 1, "| b |"), (-1, 0, "| a |\n| - x |"), (-1, 2, ""), (-2, 0, "| c |")]
_values = lambda rows: ", ".join("(" + ", ".join("NULL" if v is None else quoted(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
OPENS = f"(kind = 'heading' OR regexp_matches(x, '(?i){S.ARTICLE}') OR regexp_matches(x, '{S.OUTLINE}') OR (regexp_matches(x, '{S.CAPITALS}') AND regexp_matches(x, '\\S\\s+\\S')))"
MARKER = f"regexp_extract(x, '{S.OUTLINE}', 1)"
PLAIN = lambda text: f"array_to_string(list_transform(string_split({text}, chr(10)), lambda y: CASE WHEN regexp_matches({TIDY('y')}, '(?i){S.LIST_MARKER}') THEN regexp_replace({TIDY('y')}, '(?i){S.LIST_MARKER}', '') ELSE y END), chr(10))"


SECTIONS = f"""{BLOCKS}, every AS (SELECT doc, place, page, kind, level, text FROM blocks UNION ALL SELECT * FROM (VALUES {_values(LITERAL)}) v(doc, place, page, kind, level, text)),
tabs AS (SELECT doc, string_agg(markdown, chr(10) || chr(10) ORDER BY tab) AS tables FROM (SELECT * FROM (VALUES {_values(LITERAL_TABLES)}) v(doc, tab, markdown) UNION ALL SELECT doc_id, 0, '| ' || lang || ' |' FROM documents WHERE doc_id % 4 = 0) WHERE markdown <> '' GROUP BY 1),
x AS (SELECT *, {TIDY("coalesce(text, '')")} AS x FROM every), marked AS (SELECT *, {OPENS} AS opens, row_number() OVER (PARTITION BY doc ORDER BY place) - 1 AS pos FROM x),
r AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc ORDER BY place) AS part, bool_or(opens) OVER (PARTITION BY doc) AS headed FROM marked),
g AS (SELECT doc, part, headed, max(x) FILTER (opens) AS heading, max(CASE WHEN coalesce(level, 0) <> 0 THEN level WHEN regexp_matches({MARKER}, '^[0-9]') THEN length({MARKER}) - length(replace({MARKER}, '.', '')) + 1 WHEN regexp_matches({MARKER}, '^[IVXLC]+$') THEN 1 WHEN {MARKER} <> '' THEN 2 WHEN regexp_matches(x, '{S.CAPITALS}') THEN 1 ELSE 2 END) FILTER (opens) AS level,
 coalesce(string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY pos) FILTER (CASE WHEN headed THEN NOT opens AND kind NOT IN ('page_artifact', 'heading') AND x <> '' ELSE kind <> 'page_artifact' END), '') AS body, min(pos) AS first_block, max(pos) AS last_block, min(page) AS first_page, max(page) AS last_page FROM r WHERE part > 0 OR NOT headed GROUP BY ALL),
n AS (SELECT g.*, {PLAIN("concat_ws(chr(10) || chr(10), nullif(body, ''), tables)")} AS whole, row_number() OVER (PARTITION BY doc ORDER BY part) - 1 AS ordinal FROM g LEFT JOIN tabs USING (doc)),
up AS (SELECT a.doc, a.ordinal, list(b.heading ORDER BY b.ordinal) AS path FROM n a JOIN n b ON a.doc = b.doc AND b.ordinal < a.ordinal AND b.level < a.level AND NOT EXISTS (SELECT 1 FROM n c WHERE c.doc = a.doc AND c.ordinal > b.ordinal AND c.ordinal < a.ordinal AND c.level <= b.level) GROUP BY 1, 2)
SELECT doc, ordinal, heading, coalesce(level, 0) AS level, CASE WHEN headed THEN CASE WHEN whole <> '' THEN {TIDY("heading || chr(10) || chr(10) || whole")} ELSE heading END ELSE body END AS text, first_block, last_block, first_page, last_page,
coalesce(regexp_matches(heading, '(?i){S.ARTICLE}'), false) AS legal, coalesce(array_to_string((SELECT path FROM up WHERE up.doc = n.doc AND up.ordinal = n.ordinal), ' > '), '') AS path FROM n"""


def _sections(t):
    """Sections of the blocks that documents' pages are read as, of literal blocks, and with tables."""
    blocks = _blocks(t).unionByName(t.spark.createDataFrame(LITERAL, "doc long, place int, page long, kind string, level int, text string"))
    tables = t.spark.createDataFrame(LITERAL_TABLES, "doc long, table int, markdown string")
    tables = tables.unionByName(t.documents.where("doc_id % 4 = 0").select(F.col("doc_id").alias("doc"), F.lit(0).alias("table"), F.concat(F.lit("| "), "lang", F.lit(" |")).alias("markdown")))
    return S.sections(blocks, tables).withColumn("path", F.array_join("path", " > "))


@query("st_01", SECTIONS)
def sections(t):
    return _sections(t)


@query("st_02", f"SELECT doc, ordinal, heading, level, path FROM ({SECTIONS}) WHERE heading IS NOT NULL")
def heading_paths(t):
    """Each heading with the open headings above it."""
    return _sections(t).where("heading IS NOT NULL").select("doc", "ordinal", "heading", "level", "path")
