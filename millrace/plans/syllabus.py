"""Syllabi (SY-01, SY-03, SY-04) over literal notices, notices written of parts, and all documents, each as one section."""

from __future__ import annotations

import itertools

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import ACCENTED, UNACCENTED
from millrace.operators import exams as E
from millrace.operators import syllabus as S
from millrace.plans import Catalog
from millrace.plans.curation import BAG, _ratio
from millrace.plans.roles import has, quoted
from millrace.plans.rules import SPACES, TIDY

catalog = Catalog()
query = catalog.query

TEN = "1. Crase; 2. Sintaxe; 3. Regência verbal; 4. Pontuação"


def _numbered(n: int) -> str:
    return "\n".join(f"{k}. Tópico número {k}" for k in range(1, n + 1))


#: doc, ordinal, role, heading, text.
NOTICES = [
    ("full", 0, "content", "Edital nº 1", "Concurso para o cargo de Analista Judiciário; nível superior"),
    ("full", 1, "vacancies", "Das vagas", "Quadro"),
    ("full", 2, "syllabus", "ANEXO II - CONTEÚDO PROGRAMÁTICO", "1. Habilitação: quadro\nConhecimentos Básicos\nLÍNGUA PORTUGUESA: Crase; Sintaxe; Regência verbal; Pontuação.\nTribunal de Exemplo\nMATEMÁTICA: Juros, Funções, Geometria plana, Razão.\n12\nPágina 3 de 40"),
    ("full", 3, "syllabus", None, "Tribunal de Exemplo\nConhecimentos Específicos\nDIREITO CIVIL E PROCESSO:\nObrigações. Contratos\nem geral. Família. 7\nLÍNGUA PORTUGUESA:\nCrase; Ortografia; Morfologia; a"),
    ("full", 4, "syllabus", None, "Tribunal de Exemplo\nNOME DO DIRETOR\nConhecimentos específicos — Técnico Administrativo: área\nINFORMÁTICA: 1. Redes locais 2. Internet 3. Pacote Office; 4.1. Segurança vagas 5) Sistemas operacionais. ÊNFASE 1: ADMINISTRAÇÃO: Planejamento; Processos; Vagas abertas"),
    ("full", 5, "schedule", "ANEXO III", "CRONOGRAMA: Datas; Prazos; Locais"),
    ("outline", 0, "content", "Apresentação", "Vários temas\nconhecimentos específicos - Engenheiro  Civil"),
    ("outline", 1, "syllabus", "Conhecimentos Gerais", "Noções de Informática:\n1) Redes\n2) Internet; e mais\na) Segurança da informação\nb) vagas\nPORTUGUÊS\nCrase; Sintaxe da oração; xyz\nDireito Penal Militar\nCONHECIMENTOS ESPECÍFICOS\nControle Externo\nContabilidade:\n• Balanço patrimonial"),
    ("outline", 2, "syllabus", "Controle Externo", "• Tribunais de contas\n- Julgamento das contas\n\nabc\nInscrição aqui"),
    ("outline", 3, "syllabus", "Dos recursos", "DIREITO ADMINISTRATIVO, LICITAÇÕES:\n1.1. Atos administrativos.\n1.2. Licitações;\n3) Contratos"),
    ("outline", 4, "syllabus", "Conhecimentos básicos e conhecimentos específicos", "solto"),
    ("outline", 5, "content", "Atualidades", "1. Política\n2. Economia"),
    ("bare", 0, "syllabus", None, "nada aqui"), ("bare", 1, "content", "Direito Tributário:", "CTN; Impostos; Taxas; Contribuições"), ("bare", 2, "nav", "Menu lateral", "Crase\nSintaxe"),
    ("empty_wrapper", 0, "syllabus", "Cronograma e vagas", ""), ("empty_wrapper", 1, "content", "Matemática", f"{TEN}"), ("empty_wrapper", 2, "nav", "Menu lateral", "Crase\nSintaxe"),
    ("plain", 0, "content", None, "Texto sem matéria alguma; só prosa."), ("nothing", 0, None, None, None),
    ("nine", 0, "syllabus", "Matemática", _numbered(9)), ("ten", 0, "syllabus", "Matemática", _numbered(10)), ("most", 0, "syllabus", "Matemática", _numbered(600)), ("over", 0, "syllabus", "Matemática", _numbered(601)),
    ("span_most", 0, "syllabus", "Programa das provas", "MATEMÁTICA:\n" + "; ".join(f"Tópico número {k}" for k in range(900))),
    ("span_over", 0, "syllabus", "Programa das provas", "MATEMÁTICA:\n" + "; ".join(f"Tópico número {k}" for k in range(901))),
]
#: doc, table, rows of cells.
TABLES = [
    ("full", 0, [["Código", "Cargo", "Vagas"], ["1", " Analista  Judiciário ", "3"], ["2", "Técnico", ""], ["3", "", "9"], ["4", "Judiciário analista", "x"], ["5"]]),
    ("full", 1, [["Cidade", "Vagas"], ["Recife", "2"]]),
    ("outline", 0, [["CARGO"], ["Engenheiro Civil"], ["Médico"]]),
    ("bare", 0, []),
]

_ROWS = f"(VALUES {', '.join('(' + ', '.join(quoted(v) if not isinstance(v, int) else str(v) for v in r) + ')' for r in NOTICES)}) v(doc, ordinal, role, heading, text)"
SECTIONS = f"""(SELECT doc, ordinal::BIGINT AS ordinal, role, heading, text FROM {_ROWS}
UNION ALL SELECT 'd' || doc_id, 0, 'content', NULL, text FROM documents
UNION ALL SELECT 'p' || p_brand || '-' || paper, 0, 'syllabus', CASE WHEN paper % 2 = 0 THEN 'Programa das provas' END, string_agg(CASE n % 10 WHEN 0 THEN 'Conhecimentos Específicos' || chr(10) WHEN 5 THEN 'Conhecimentos básicos' || chr(10) ELSE '' END || CASE paper % 2
  WHEN 0 THEN p_type || ' ' || p_size % 5 || ': Tema ' || p_name || '; Parte ' || p_partkey || '; Preço do lote ' || p_size || '.' ELSE p_type || ' ' || p_size % 5 || chr(10) || '1. tema ' || p_name || chr(10) || 'a) parte ' || p_partkey || '; resto' END, chr(10) ORDER BY n)
FROM (SELECT *, n // 50 AS paper FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS n FROM part)) GROUP BY p_brand, paper)"""


def _sections(t):
    literal = t.spark.createDataFrame(NOTICES, "doc string, ordinal long, role string, heading string, text string")
    zero, none = F.lit(0).cast("long").alias("ordinal"), F.lit(None).cast("string").alias("heading")
    documents = t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc"), zero, F.lit("content").alias("role"), none, "text")
    c, n = F.col, F.col("n")
    parts = t.part.withColumn("n", F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey")) - 1).withColumn("paper", F.floor(n / 50))
    label = F.concat_ws(" ", "p_type", (c("p_size") % 5).cast("string"))
    key = c("p_partkey").cast("string")
    programme = F.concat(label, F.lit(": Tema "), c("p_name"), F.lit("; Parte "), key, F.lit("; Preço do lote "), c("p_size").cast("string"), F.lit("."))
    outline = F.concat(label, F.lit("\n1. tema "), c("p_name"), F.lit("\na) parte "), key, F.lit("; resto"))
    scope = F.when(n % 10 == 0, "Conhecimentos Específicos\n").when(n % 10 == 5, "Conhecimentos básicos\n").otherwise("")
    even = c("paper") % 2 == 0
    rows = parts.withColumn("line", F.concat(scope, F.when(even, programme).otherwise(outline)))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda r: r.line), "\n")  # fifty at most
    rows = rows.groupBy("p_brand", "paper").agg(lines.alias("text"))
    papers = rows.select(F.concat(F.lit("p"), c("p_brand"), F.lit("-"), c("paper").cast("string")).alias("doc"), zero, F.lit("syllabus").alias("role"), F.when(even, "Programa das provas").alias("heading"), "text")
    return literal.unionByName(documents).unionByName(papers)


def _tables(t):
    return t.spark.createDataFrame(TABLES, "doc string, table int, rows array<array<string>>")


# --- the same rules as SQL -------------------------------------------------------------------------

_names = (f"v{k}" for k in itertools.count())


def LET(x: str, use) -> str:
    v = next(_names)
    return f"list_transform([{x}], lambda {v}: {use(v)})[1]"


def EACH(xs: str, use) -> str:
    v = next(_names)
    return f"list_transform({xs}, lambda {v}: {use(v)})"


def ONLY(xs: str, use) -> str:
    v = next(_names)
    return f"list_filter({xs}, lambda {v}: {use(v)})"


def _list(values) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


FOLD = lambda x: f"lower(translate({x}, '{ACCENTED}', '{UNACCENTED}'))"
SQUEEZE = lambda x: TIDY(f"regexp_replace({x}, '{SPACES}+', ' ', 'g')")
SPACED = lambda x: SQUEEZE(FOLD(x))
LETTERED = lambda x: f"trim(regexp_replace({FOLD(x)}, '[^a-z0-9]+', ' ', 'g'))"
NAMED = lambda x, p: f"regexp_matches({x}, '{p}')"
KEYS, KEY_IDS, IDS = _list(S.KEYS), _list(s[0] for s in S.KEYS.values()), _list(s[0] for s in S.SUBJECTS)


def ITEM(x: str) -> str:
    return LET(f"regexp_replace({SQUEEZE(x)}, '(?:[.;,]|{SPACES})+$', '')", lambda t: f"upper(replace(substr({t}, 1, 1), 'ß', 'ss')) || substr({t}, 2)")


def USABLE(xs: str, least: int) -> str:
    return ONLY(xs, lambda t: f"length({t}) BETWEEN {least} AND {S.LONGEST_ITEM} AND NOT {has(t, S.ADMIN)}")


def SLUG(x: str) -> str:
    return LET(f"substr(regexp_replace(regexp_replace({FOLD(x)}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 64)", lambda s: f"CASE WHEN {s} = '' THEN 'unknown' ELSE {s} END")


def SUBJECT_ID(x: str) -> str:
    key = f"trim(regexp_replace(regexp_replace({FOLD(x)}, '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '{SPACES}+', ' ', 'g'))"
    return LET(key, lambda k: f"CASE WHEN {k} <> '' THEN {KEY_IDS}[list_position({KEYS}, coalesce(CASE WHEN list_contains({KEYS}, {k}) THEN {k} END, {ONLY(KEYS, lambda a: f'contains({k}, {a}) OR contains({a}, {k})')}[1]))] END")


TITLE = lambda id_: f"{_list(s[1] for s in S.SUBJECTS)}[list_position({IDS}, {id_})]"


def EXACT(x: str, sql_norm, norm, more: int) -> str:
    titles, aliases = _list(norm(s[1]) for s in S.SUBJECTS), "[" + ", ".join(_list(map(norm, s[2])) for s in S.SUBJECTS) + "]"

    def agrees(id_: str) -> str:
        at = f"list_position({IDS}, {id_})"
        return LET(sql_norm(x), lambda t: f"CASE WHEN {t} = {titles}[{at}] OR list_contains({aliases}[{at}], {t}) OR (contains({t}, {titles}[{at}]) AND length({t}) <= length({titles}[{at}]) + {more}) THEN {id_} END")

    return LET(SUBJECT_ID(x), agrees)


def OUTLINE_ITEMS(body: str) -> str:
    listed = ONLY(EACH(f"regexp_extract_all({body}, '(?i){S.ITEM}', 1)", ITEM), lambda t: f"length({t}) BETWEEN 1 AND {S.LONGEST_ITEM} AND NOT {has(t, S.ADMIN)}")
    lines = USABLE(EACH(f"regexp_split_to_array({body}, '\\n+')", lambda p: ITEM(f"regexp_replace({p}, '^[•\\-*–—]\\s*', '')")), 4)
    parts = USABLE(EACH(f"regexp_split_to_array({body}, ';\\s+')", ITEM), 4)
    by_line = LET(lines, lambda found: f"CASE WHEN contains({body}, chr(10)) AND len({found}) > 0 THEN {found} ELSE {parts} END")
    return LET(listed, lambda found: f"CASE WHEN len({found}) > 0 THEN {found} ELSE {by_line} END")


def TOPICS(body: str) -> str:
    """Look-ahead is done by marks (chr(1)) set before what may follow."""

    def split(text: str) -> str:
        numbered = EACH(ONLY(f"string_split(regexp_replace({text}, '(?:^|\\s)\\d+(?:\\.\\d+)*[.)]\\s', chr(1), 'g'), chr(1))[2:]", lambda x: f"{x} <> '' AND NOT contains({x}, ';')"), ITEM)
        cut = lambda p: f"string_split(regexp_replace({text}, '{p}\\s+([A-ZÁÉÍÓÚ])', chr(1) || '\\1', 'g'), chr(1))"
        raw = LET(f"regexp_split_to_array({text}, ';\\s*')", lambda a: LET(cut("\\."), lambda b: LET(cut(","), lambda c: f"CASE WHEN len({a}) >= 3 THEN {a} WHEN len({b}) >= 3 THEN {b} WHEN len({c}) >= 3 THEN {c} ELSE {b} END")))
        return LET(USABLE(numbered, 4), lambda n: f"CASE WHEN len({n}) >= 3 THEN {n} ELSE {USABLE(EACH(raw, ITEM), 4)} END")

    return LET(SQUEEZE(body), split)


def SUBJECT_LINE(line: str) -> str:
    def judged(t: str) -> str:
        letters = f"length(regexp_replace({t}, '[^A-Za-z{S.UPPER[3:]}áéíóúâêôàãõç]', '', 'g'))"
        upper = f"length(regexp_replace({t}, '[^{S.UPPER}]', '', 'g'))"
        shape = f"length({t}) BETWEEN 4 AND 90 AND NOT {has(t, E.ANNEX)} AND NOT {has(t, S.ADMIN)} AND NOT {NAMED(t, '^[0-9]')} AND {NAMED(t, f'[{S.UPPER}]{{3}}')}"
        return f"{shape} AND (({letters} >= 4 AND {upper} >= 0.9 * {letters}) OR {SUBJECT_ID(t)} IS NOT NULL)"

    return LET(f"regexp_replace({TIDY(line)}, ':$', '')", judged)


def SUBJECT(line: str) -> str:
    """struct(title, id) of an outline's line."""
    made = lambda title, id_: f"{{'title': coalesce({TITLE(id_)}, {title}), 'id': {id_}}}"

    def of(x: str) -> str:
        bare = TIDY(f"regexp_replace({x}, ':$', '')")
        capitals = LET(ITEM(f"regexp_extract({x}, '{S.SUBJECT_LINE}', 1)"), lambda t: LET(SUBJECT_ID(t), lambda i: made(t, i)))
        known = LET(bare, lambda b: LET(f"CASE WHEN length({b}) BETWEEN 4 AND 80 AND ({x} LIKE '%:' OR {NAMED(b, '^[A-ZÁÉÍÓÚÃÕÇ]')}) THEN {EXACT(b, SPACED, S.spaced, 24)} END", lambda i: f"CASE WHEN {i} IS NOT NULL THEN {made('NULL', i)} END"))
        return f"CASE WHEN {NAMED(x, S.SUBJECT_LINE)} THEN {capitals} ELSE {known} END"

    return LET(TIDY(line), of)


def HEADING(x: str) -> str:
    bare = TIDY(f"regexp_replace({x}, ':$', '')")
    free = LET(bare, lambda b: f"CASE WHEN length({b}) BETWEEN 4 AND 80 AND NOT {has(b, S.BASIC)} AND NOT {has(b, S.SPECIFIC)} AND NOT {has(b, S.ADMIN)} AND NOT {has(b, S.OF_THE)} AND NOT {has(b, S.NO_SUBJECT)} THEN {{'title': {ITEM(b)}, 'id': NULL::VARCHAR}} END")
    return f"CASE WHEN {x} <> '' THEN coalesce({SUBJECT(x)}, {free}) END"


SCOPE = lambda x, a, b: f"CASE WHEN {has(x, getattr(S, a))} THEN '{a.lower()}' WHEN {has(x, getattr(S, b))} THEN '{b.lower()}' END"
ANNEX_OF = lambda x: f"nullif(lower(regexp_extract({x}, '(?i){E.ANNEX}', 1)), '')"
H = "coalesce(heading, '')"
OPENING = f"{TIDY(H)} || chr(10) || substr(text, 1, 240)"
SPAN = f"""(WITH s AS (SELECT *, {has(TIDY(H), E.PROGRAMME_HEADING)} AS strong, {has(OPENING, E.PROGRAMME_START)} AND NOT {has(OPENING, E.PROGRAMME_REFERENCE)} AS weak, coalesce({ANNEX_OF(H)}, {ANNEX_OF("split_part(text, chr(10), 1)")}) AS annex, {ANNEX_OF(H)} AS own,
{has(H, E.PROGRAMME_STOP)} AND NOT {has(H, E.PROGRAMME_START)} AS stops FROM sections), b AS (SELECT doc, coalesce(min(ordinal) FILTER (strong), min(ordinal) FILTER (weak)) AS start FROM s GROUP BY 1),
a AS (SELECT doc, start, own AS start_annex FROM b JOIN s USING (doc) WHERE ordinal = start), e AS (SELECT doc, min(ordinal) AS stop FROM s JOIN a USING (doc) WHERE ordinal > start AND (coalesce(annex <> coalesce(start_annex, ''), false) OR stops) GROUP BY 1)
SELECT doc, ordinal, heading, text FROM s JOIN a USING (doc) LEFT JOIN e USING (doc) WHERE ordinal >= start AND (stop IS NULL OR ordinal < stop))"""
LINES = "unnest({0}) AS line, generate_subscripts({0}, 1) AS place".format
WHOLE = f"{H} || chr(10) || coalesce(text, '')"
MARKED = f"regexp_replace({WHOLE}, ':(\\s+[A-ZÁÉÍÓÚ0-9(])', ':' || chr(1) || '\\1', 'g')"
HOISTED = f"replace(regexp_replace({MARKED}, '(?m)(?:^|([.;])\\s+)([{S.UPPER}][{S.UPPER}0-9 ,/\\-–()]{{3,90}}?):\\x01\\s+', '\\1' || chr(10) || '\\2:' || chr(10), 'g'), chr(1), '')"
SLUGS = "coalesce((SELECT slugs FROM named n WHERE n.doc = {0}.doc), ['geral'])".format

PROGRAMME = f"""raw AS (SELECT doc, section, place, {TIDY('line')} AS line FROM (SELECT doc, ordinal AS section, {LINES(f"regexp_split_to_array({HOISTED}, '\\n+')")} FROM {{span}})),
seen AS (SELECT *, count(*) OVER (PARTITION BY doc, line) AS seen FROM raw WHERE line <> ''),
kept AS (SELECT *, CASE WHEN length(line) < 60 THEN {SCOPE('line', 'BASIC', 'SPECIFIC')} END AS turn FROM seen WHERE NOT (length(line) >= 4 AND seen >= 3) AND NOT {has('line', S.PAGE)} AND NOT {NAMED('line', '^[0-9]{1,3}$')}),
labelled AS (SELECT *, CASE WHEN turn IS NULL AND {SUBJECT_LINE('line')} AND NOT {has('line', E.PROGRAMME_START)} AND NOT {has('line', S.QUALIFICATION)} THEN {ITEM("regexp_replace(line, ':$', '')")} END AS label FROM kept),
known AS (SELECT *, CASE WHEN label IS NOT NULL THEN {EXACT('label', LETTERED, S.lettered, 12)} END AS subject_id FROM labelled),
headed AS (SELECT *, CASE WHEN label IS NOT NULL THEN coalesce({TITLE('subject_id')}, label) END AS subject, (turn IS NOT NULL OR label IS NOT NULL)::INT AS border FROM known),
held AS (SELECT *, sum(border) OVER w AS part, coalesce(last_value(turn IGNORE NULLS) OVER w, 'basic') AS scope, last_value(subject IGNORE NULLS) OVER w AS current FROM headed WINDOW w AS (PARTITION BY doc ORDER BY section, place)),
parts AS (SELECT doc, part, scope, current, max(subject) AS own, max(subject_id) FILTER (label IS NOT NULL) AS subject_id, coalesce(string_agg(line, ' ' ORDER BY section, place) FILTER (border = 0), '') AS body FROM held WHERE current IS NOT NULL GROUP BY 1, 2, 3, 4),
leafy AS (SELECT *, CASE WHEN body <> '' THEN {TOPICS('body')} ELSE [] END AS leaves FROM parts),
listed AS (SELECT doc, part, 0 AS place, scope, own AS title, subject_id, 0 AS depth, {SLUG('current')} AS root, {SLUG('current')} AS path FROM leafy WHERE own IS NOT NULL
UNION ALL SELECT doc, part, place, scope, title, NULL, 1, root, root || '/' || {SLUG('title')} FROM (SELECT doc, part, scope, {SLUG('current')} AS root, unnest(leaves) AS title, generate_subscripts(leaves, 1) AS place FROM leafy)),
merged AS (SELECT * FROM (SELECT *, sum(depth) OVER (PARTITION BY doc, root) AS leaves FROM listed) WHERE leaves > 0 QUALIFY row_number() OVER (PARTITION BY doc, path ORDER BY part, place) = 1),
programme AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY part, place) - 1 AS ordinal, depth, title, path, CASE WHEN depth = 1 THEN root END AS parent, subject_id, scope, CASE WHEN scope = 'basic' THEN {SLUGS('merged')} ELSE {SLUGS('merged')}[1:1] END AS slugs, CASE WHEN depth = 1 THEN 0.8 WHEN subject_id IS NOT NULL THEN 0.9 ELSE 0.75 END::DOUBLE AS confidence FROM merged)"""

OUTLINE = f"""based AS (SELECT doc, ordinal AS section, role, coalesce(text, '') AS text, {HEADING('heading')} AS subject, {SCOPE('coalesce(heading, text)', 'SPECIFIC', 'BASIC')} AS turn FROM {{rest}}),
owned AS (SELECT *, {OUTLINE_ITEMS('text')} AS items, {ONLY(EACH("regexp_split_to_array(text, '\\n+')", TIDY), lambda x: f"{x} <> ''")} AS lines FROM based),
entries AS (SELECT doc, section, role, subject, turn, items, 0 AS place, '' AS line FROM owned UNION ALL SELECT doc, section, role, {SUBJECT('line')} AS subject, NULL, NULL, place, line FROM (SELECT doc, section, role, {LINES('lines')} FROM owned WHERE subject IS NULL)),
turned AS (SELECT * REPLACE (CASE WHEN place = 0 OR {SCOPE('line', 'BASIC', 'SPECIFIC')} IS NULL THEN subject END AS subject, CASE WHEN place = 0 THEN turn ELSE {SCOPE('line', 'BASIC', 'SPECIFIC')} END AS turn) FROM entries),
facts AS (SELECT doc, bool_or(coalesce(role = 'syllabus', false)) AS has_syllabus, bool_or(place = 0 AND coalesce(role = 'syllabus', false) AND (len(items) > 0 OR subject IS NOT NULL)) AS has_outline, bool_or(coalesce(role = 'syllabus', false) AND subject IS NOT NULL) AS own_named, bool_or(subject IS NOT NULL) AS any_named FROM turned GROUP BY 1),
chosen AS (SELECT t.* FROM turned t JOIN facts USING (doc) WHERE CASE WHEN has_syllabus AND NOT CASE WHEN has_outline THEN own_named ELSE any_named END THEN coalesce(role IN ('syllabus', 'content'), false) WHEN has_syllabus AND has_outline THEN coalesce(role = 'syllabus', false) ELSE true END),
run AS (SELECT *, coalesce(last_value(turn IGNORE NULLS) OVER (PARTITION BY doc ORDER BY section, place), 'basic') AS scope, last_value(subject IGNORE NULLS) OVER (PARTITION BY doc, section ORDER BY place) AS current FROM chosen),
given AS (SELECT *, CASE WHEN place = 0 AND subject IS NOT NULL THEN items WHEN place > 0 AND turn IS NULL AND subject IS NULL AND current IS NOT NULL THEN {OUTLINE_ITEMS('line')} ELSE [] END AS leaves FROM run),
flat AS (SELECT doc, section, place, scope, 0 AS turn, subject.title AS title, 0 AS depth, {SLUG('subject.title')} AS path, NULL AS parent, subject.id AS subject_id, CASE WHEN subject.id IS NOT NULL THEN 0.9 WHEN place = 0 THEN 0.75 ELSE 0.7 END AS confidence FROM given WHERE subject IS NOT NULL
UNION ALL SELECT doc, section, place, scope, turn, title, 1, parent || '/' || {SLUG('title')}, parent, NULL, 0.75 FROM (SELECT doc, section, place, scope, {SLUG('current.title')} AS parent, unnest(leaves) AS title, generate_subscripts(leaves, 1) AS turn FROM given)),
outline AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY section, place, turn) - 1 AS ordinal, depth, title, path, parent, subject_id, scope, CASE WHEN scope = 'basic' THEN {SLUGS('flat')} ELSE {SLUGS('flat')}[1:1] END AS slugs, confidence::DOUBLE AS confidence FROM flat)"""

RATIO = lambda a, b: LET(BAG(a), lambda x: LET(BAG(b), lambda y: LET(ONLY(x, lambda w: f"list_contains({y}, {w})"), lambda i: LET(f"array_to_string({i}, ' ')", lambda s: LET(f"array_to_string(list_concat({i}, {ONLY(x, lambda w: f'NOT list_contains({y}, {w})')}), ' ')", lambda p: LET(f"array_to_string(list_concat({i}, {ONLY(y, lambda w: f'NOT list_contains({x}, {w})')}), ' ')", lambda q: f"greatest({_ratio(s, p)}, {_ratio(s, q)}, {_ratio(p, q)})"))))))
TABLE_ROWS = f"(VALUES {', '.join(f'({quoted(d)}, {n}, {[list(r) for r in rows]!r}::VARCHAR[][])' for d, n, rows in TABLES)}) v(doc, tab, rows)"
POSITIONS = f"""tables AS (SELECT *, list_position({EACH('rows[1]', lambda h: f"contains(lower({h}), 'cargo')")}, true) AS title_at, list_position({EACH('rows[1]', lambda h: f"contains(lower({h}), 'vaga')")}, true) AS count_at FROM {TABLE_ROWS}),
cells AS (SELECT doc, tab, title_at, count_at, unnest(rows[2:]) AS cells, generate_subscripts(rows[2:], 1) AS n FROM tables WHERE title_at IS NOT NULL),
titles AS (SELECT doc, 0 AS kind, tab AS a, n AS b, {SQUEEZE('cells[title_at]')} AS title, CASE WHEN count_at IS NOT NULL THEN CASE WHEN trim(cells[count_at]) = '' THEN 0 ELSE TRY_CAST(trim(cells[count_at]) AS DOUBLE) END END AS vacancies FROM cells WHERE {SQUEEZE('cells[title_at]')} <> ''
UNION ALL SELECT doc, 1, ordinal, n, {SQUEEZE('raw')}, NULL FROM (SELECT doc, ordinal, unnest(found) AS raw, generate_subscripts(found, 1) AS n FROM (SELECT doc, ordinal, regexp_extract_all({WHOLE}, '(?i){S.POSITION}', 1) AS found FROM sections)) WHERE length({SQUEEZE('raw')}) >= 3
UNION ALL SELECT doc, 2, 0, 0, title, NULL FROM (SELECT doc, {SQUEEZE(f"regexp_extract(substr(coalesce(text, ''), 1, 800), '(?i){S.FOR_POSITION}', 1)")} AS title FROM sections QUALIFY row_number() OVER (PARTITION BY doc ORDER BY ordinal) = 1) WHERE title <> ''),
folded AS (SELECT doc, list_reduce(list_transform(list({{'kind': kind, 'title': title, 'vacancies': vacancies}} ORDER BY kind, a, b), lambda p: [p]), lambda kept, p: CASE WHEN len(list_filter(kept, lambda k: {RATIO('k.title', 'p[1].title')} >= {S.NEAR_TITLE})) > 0 THEN kept ELSE list_concat(kept, p) END) AS kept FROM titles GROUP BY doc),
positions AS (SELECT doc, unnest(kept) AS p, generate_subscripts(kept, 1) - 1 AS place FROM folded),
named AS (SELECT doc, list({SLUG('p.title')} ORDER BY place) AS slugs FROM positions GROUP BY doc)"""
HEAD = f"WITH sections AS MATERIALIZED (SELECT * FROM {SECTIONS}), {POSITIONS}"
OUT = "doc, ordinal, depth, title, path, parent, subject_id, scope, array_to_string(slugs, ',') AS slugs, confidence"


@query("sy_01", f"""{HEAD} SELECT doc, place, p.title AS title, {SLUG('p.title')} AS slug, p.vacancies AS vacancies, false AS implicit FROM positions
UNION ALL SELECT doc, 0, 'geral', 'geral', NULL, true FROM (SELECT DISTINCT doc FROM sections) WHERE doc NOT IN (SELECT doc FROM named)""")
def positions(t):
    return S.positions(_sections(t), _tables(t))


def _named(t, sections):
    return S.position_slugs(S.positions(sections, _tables(t)))


def _shown(nodes):
    return nodes.withColumn("slugs", F.array_join("slugs", ","))


@query("sy_03", f"{HEAD}, {PROGRAMME.replace('{span}', SPAN)} SELECT {OUT} FROM programme")
def programmes(t):
    sections = _sections(t)
    span = E.programme_span(sections, "doc").select("doc", "ordinal").join(sections, ["doc", "ordinal"])
    return _shown(S.programme_nodes(span, _named(t, sections)))


#: Upper case of sharp s is two letters on the one side only.
OPENED = "(SELECT doc_id AS doc, 0 AS ordinal, NULL AS heading, upper(replace(left(text, 40), 'ß', 'ss')) || chr(10) || text AS text FROM documents)"


@query("sy_03_documents", f"WITH named AS (SELECT NULL AS doc, ['x'] AS slugs), {PROGRAMME.replace('{span}', OPENED)} SELECT {OUT} FROM programme")
def document_programmes(t):
    """Each document as a programme whose opening stands in capitals."""
    text = F.concat(F.upper(F.substring("text", 1, 40)), F.lit("\n"), "text")
    return _shown(S.programme_nodes(t.documents.select(F.col("doc_id").alias("doc"), F.lit(0).alias("ordinal"), F.lit(None).cast("string").alias("heading"), text.alias("text"))))


@query("sy_04", f"{HEAD}, {OUTLINE.replace('{rest}', 'sections')} SELECT {OUT} FROM outline")
def outlines(t):
    sections = _sections(t)
    return _shown(S.outline_nodes(sections, _named(t, sections)))


@query("sy_04_status", f"""{HEAD}, {PROGRAMME.replace('{span}', SPAN)}, ready AS (SELECT doc, sum(depth) AS leaves FROM programme GROUP BY 1 HAVING sum(depth) >= {S.SPAN_LEAVES[0]}),
{OUTLINE.replace('{rest}', '(SELECT * FROM sections WHERE doc NOT IN (SELECT doc FROM ready))')},
counted AS (SELECT doc, 'programme' AS method, depth FROM programme WHERE doc IN (SELECT doc FROM ready) UNION ALL SELECT doc, 'outline', depth FROM outline),
summed AS (SELECT doc, method, sum(depth) AS leaves, count(*) FILTER (depth = 0) AS subjects FROM counted GROUP BY 1, 2)
SELECT doc, coalesce(method, 'outline') AS method, coalesce(leaves, 0)::BIGINT AS leaves, coalesce(subjects, 0) AS subjects, CASE WHEN leaves >= 10 AND (method = 'programme' AND leaves <= 900 OR method = 'outline' AND leaves <= 600 AND subjects > 0) THEN 'active' ELSE 'needs_review' END AS status
FROM (SELECT DISTINCT doc FROM sections) LEFT JOIN summed USING (doc)""")
def statuses(t):
    sections = _sections(t)
    span = E.programme_span(sections, "doc").select("doc", "ordinal").join(sections, ["doc", "ordinal"])
    return S.parsed_syllabi(sections, span)[1]


# --- corrections and alike titles --------------------------------------------------------------------

LOT = "p_brand || '-' || p_partkey // 100"
NAMES = f"SELECT {LOT} AS lot, p_partkey AS place, p_name || CASE WHEN p_partkey % 3 = 0 THEN ' ' || lower(p_type) ELSE '' END || CASE WHEN p_size % 4 = 0 THEN ' ' || p_size ELSE '' END AS title FROM part"


def _lots(t):
    c = F.col
    lot = F.concat_ws("-", "p_brand", F.floor(c("p_partkey") / 100).cast("string"))
    title = F.concat("p_name", F.when(c("p_partkey") % 3 == 0, F.concat(F.lit(" "), F.lower("p_type"))).otherwise(""), F.when(c("p_size") % 4 == 0, F.concat(F.lit(" "), c("p_size").cast("string"))).otherwise(""))
    return t.part.withColumns({"lot": lot, "title": title})


@query("dd_10", f"""WITH n AS ({NAMES}), k AS (SELECT lot, list_reduce(list_transform(list(title ORDER BY place), lambda x: [x]), lambda kept, x: CASE WHEN len(list_filter(kept, lambda k: {RATIO('k', 'x[1]')} >= {S.NEAR_TITLE})) > 0 THEN kept ELSE list_concat(kept, x) END) AS kept FROM n GROUP BY 1)
SELECT lot, unnest(kept) AS title, generate_subscripts(kept, 1) - 1 AS place FROM k""")
def distinct_titles(t):
    """Titles of a lot that are like none kept before (ratio under 90 to each)."""
    listed = _lots(t).groupBy("lot").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "title"))), lambda x: x.title).alias("titles"))  # a hundred parts at most
    return listed.select("lot", F.posexplode(S.distinct_titles(F.col("titles"))).alias("place", "title"))


LEAVES = f"""SELECT {LOT} AS exam, p_partkey AS node, p_size AS place, p_partkey % 2 = 1 AS corrects, p_name || ' ' || p_size % 6 AS title,
lower(p_type) || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' geral' WHEN 2 THEN 's' ELSE '-aplicada' END || '/' || p_name AS path FROM part"""
SUBJECT_KEY = lambda x: f"list_filter(list_transform(regexp_split_to_array(lower({x}), '[/\\-▸>]'), lambda y: trim(y)), lambda y: y <> '')[1]"
MATCHED = f"""WITH RECURSIVE l AS ({LEAVES}), k AS (SELECT *, {SUBJECT_KEY('path')} AS subject FROM l), n AS (SELECT *, row_number() OVER (PARTITION BY exam ORDER BY place, node) AS turn FROM k WHERE corrects),
s AS (SELECT a.exam, a.node AS new, a.turn, b.node AS old, b.place, {RATIO('a.title', 'b.title')} AS score FROM n a JOIN k b ON a.exam = b.exam AND NOT b.corrects AND (a.subject = b.subject OR contains(a.subject, b.subject) OR contains(b.subject, a.subject) OR {RATIO('a.subject', 'b.subject')} >= {S.NEAR_SUBJECT})),
q AS (SELECT exam, new, turn, list(old ORDER BY score DESC, place, old) AS likes FROM s WHERE score >= {S.REPLACES} GROUP BY ALL),
e AS (SELECT exam, max(turn) AS most FROM n GROUP BY 1),
r AS (SELECT exam, 0::BIGINT AS turn, []::BIGINT[] AS taken, NULL::BIGINT AS new, NULL::BIGINT AS old FROM e
UNION ALL SELECT exam, turn + 1, CASE WHEN f IS NULL THEN taken ELSE list_append(taken, f) END, new, f FROM (SELECT r.exam, r.turn, r.taken, q.new, list_filter(coalesce(q.likes, []), lambda o: NOT list_contains(r.taken, o))[1] AS f FROM r JOIN e USING (exam) LEFT JOIN q ON q.exam = r.exam AND q.turn = r.turn + 1 WHERE r.turn < most)),
m AS (SELECT exam, new, old FROM r WHERE old IS NOT NULL)"""


def _leaves(t):
    c = F.col
    path = F.concat(F.lower("p_type"), F.element_at(F.array(F.lit(""), F.lit(" geral"), F.lit("s"), F.lit("-aplicada")), (c("p_partkey") % 4 + 1).cast("int")), F.lit("/"), "p_name")
    rows = _lots(t).select(c("lot").alias("exam"), c("p_partkey").alias("node"), c("p_size").alias("place"), F.concat("p_name", F.lit(" "), (c("p_size") % 6).cast("string")).alias("title"), path.alias("path"))
    return rows.where("node % 2 = 0"), rows.where("node % 2 = 1")


@query("jn_12", f"{MATCHED} SELECT n.exam, node, old AS replaces FROM n LEFT JOIN m ON m.exam = n.exam AND m.new = n.node")
def replacements(t):
    """Each leaf of a correction with the one it replaces, one to one, in the correction's order."""
    return S.replacements(*_leaves(t))


@query("jn_12_merged", f"""{MATCHED}, c AS (SELECT n.exam, node, CASE WHEN old IS NULL THEN 'new' ELSE 'replaced' END AS origin, place, title, path FROM n LEFT JOIN m ON m.exam = n.exam AND m.new = n.node
UNION ALL SELECT exam, node, 'kept', place, title, path FROM k WHERE NOT corrects AND (exam, node) NOT IN (SELECT exam, old FROM m))
SELECT exam, node, origin, row_number() OVER (PARTITION BY exam ORDER BY (origin = 'kept')::INT, place, node) - 1 AS place, title, path FROM c""")
def merged_leaves(t):
    return S.merged_leaves(*_leaves(t))
