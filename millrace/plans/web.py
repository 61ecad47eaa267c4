"""Pages: text, links, URL screens, candidate scores (SRC-*, FLT-09.., RK-*, CF-09, EX-*)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import host_of
from millrace.operators import curation as C
from millrace.operators import items as I
from millrace.operators import tables as T
from millrace.plans import Catalog
from millrace.sources import listings as L
from millrace.sources import pages as P
from millrace.sources.soup import read_blocks

catalog = Catalog()
query = catalog.query

HOST_OF = lambda u: rf"regexp_replace(lower(regexp_extract(lower({u}), '^[a-z]+://([^/:?#]+)', 1)), '^www\.', '')"
HOST = "regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\\.', '')"
TITLE = r"trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g'))"
TEXT = "html"
for _p, _to in ((r"(?is)<script.*?</script>", " "), (r"(?is)<style.*?</style>", " "), (r"(?is)<noscript.*?</noscript>", " "), (r"(?s)<!--.*?-->", " "), (r"(?i)</(p|div|h[1-6]|li|tr|br|hr)[^>]*>", "\n"), (r"(?i)<br\s*/?>", "\n"), (r"<[^>]+>", " "), ("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&quot;", '"'), (r"\s+\n", "\n"), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " "), (r"^\s+|\s+$", "")):
    TEXT = f"regexp_replace({TEXT}, '{_p}', '{_to}', 'g')"
ROUGH = r"trim(regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))"
ANCHORS = r"coalesce(list_sum(list_transform(regexp_extract_all(html, '(?is)<a\b[^>]*>.*?</a>'), lambda x: length(x))), 0) / length(html)"


@query("src_01", "SELECT page_id, url FROM pages WHERE page_id >= 10 AND url LIKE 'https%' ORDER BY page_id LIMIT 50")
def scan(t):
    return t.pages.where((F.col("page_id") >= 10) & F.col("url").startswith("https")).orderBy("page_id").limit(50).select("page_id", "url")


@query("src_02", r"SELECT page_id, CASE WHEN html LIKE '\%PDF%' ESCAPE '\' THEN 'pdf' WHEN regexp_matches(lower(substr(html, 1, 8192)), '<html|<!doctype html|<body') THEN 'html' WHEN len(regexp_extract_all(substr(html, 1, 4096), '[\x20-\x7E\s]')) >= 0.85 * length(substr(html, 1, 4096)) THEN 'plain' ELSE 'unknown' END AS format FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN html WHEN page_id % 3 = 1 THEN '%PDF-1.7 ' || html ELSE regexp_replace(html, '<[^>]*>', '', 'g') END AS html FROM pages)")
def detect_format(t):
    three = F.col("page_id") % 3
    html = F.when(three == 0, F.col("html")).when(three == 1, F.concat(F.lit("%PDF-1.7 "), "html")).otherwise(F.regexp_replace("html", "<[^>]*>", ""))
    head = F.substring("html", 1, 4096)
    printable = F.regexp_count(head, F.lit(r"[\x20-\x7E\s]")) >= 0.85 * F.char_length(head)
    kind = F.when(F.col("html").startswith("%PDF"), "pdf").when(F.regexp_like(F.lower(F.substring("html", 1, 8192)), F.lit("<html|<!doctype html|<body")), "html").when(printable, "plain").otherwise("unknown")
    return t.pages.select("page_id", html.alias("html")).select("page_id", kind.alias("format"))


@query("src_12", f"SELECT page_id, round(least(1.0, {ANCHORS}), 6)::DOUBLE AS density FROM pages")
def link_density(t):
    return t.pages.select("page_id", F.round(F.least(F.lit(1.0), P.anchor_share(F.col("html"))), 6).alias("density"))


@query("src_13", f"SELECT page_id, sha256({TEXT}) AS digest FROM pages")
def plain_text(t):
    return t.pages.select("page_id", F.sha2(P.html_to_text(F.col("html")), 256).alias("digest"))


@query("src_14", r"""WITH p AS (SELECT page_id, string_split(regexp_replace(html, '(?i)<h[1-3][^>]*>', chr(1), 'g'), chr(1)) AS parts FROM pages), s AS (SELECT page_id, unnest(parts[2:]) AS part, generate_subscripts(parts[2:], 1) AS section FROM p)
SELECT page_id, section, trim(regexp_extract(part, '(?s)^(.*?)</[hH][1-3]>', 1)) AS heading FROM s WHERE length(trim(regexp_replace(regexp_replace(part, '(?s)^.*?</[hH][1-3]>', ''), '<[^>]+>', '', 'g'))) >= 20""")
def html_sections(t):
    parts = F.split(F.regexp_replace("html", "(?i)<h[1-3][^>]*>", "\x01"), "\x01")
    cut = t.pages.select("page_id", F.posexplode(F.slice(parts, 2, 1 << 20)).alias("pos", "part"))
    body = F.trim(F.regexp_replace(F.regexp_replace("part", r"(?s)^.*?</[hH][1-3]>", ""), "<[^>]+>", ""))
    return cut.where(F.char_length(body) >= 20).select("page_id", (F.col("pos") + 1).cast("long").alias("section"), F.trim(F.regexp_extract("part", r"(?s)^(.*?)</[hH][1-3]>", 1)).alias("heading"))


@query("src_15", f"SELECT page_id, sha256({ROUGH}) AS digest FROM pages")
def rough_text(t):
    return t.pages.select("page_id", F.sha2(P.rough_text(F.col("html")), 256).alias("digest"))


@query("src_16", r"""SELECT doc_id, pos, CASE WHEN regexp_matches(line, '^#{1,6}\s') THEN 'markdown' WHEN length(line) <= 120 AND regexp_matches(line, '^(\d+(\.\d+)*\.|[IVXLC]+\.|[a-zA-Z]\))\s') THEN 'outline'
WHEN length(line) BETWEEN 4 AND 120 AND line = upper(line) AND regexp_matches(line, '\p{L}') THEN 'capitals' ELSE 'paragraph' END AS kind FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)""")
def plain_blocks(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    size, like = F.char_length("line"), lambda p: F.regexp_like("line", F.lit(p))
    kind = F.when(like(r"^#{1,6}\s"), "markdown").when((size <= 120) & like(r"^(\d+(\.\d+)*\.|[IVXLC]+\.|[a-zA-Z]\))\s"), "outline").when(size.between(4, 120) & (F.col("line") == F.upper("line")) & like(r"\p{L}"), "capitals").otherwise("paragraph")
    return lines.select("doc_id", F.col("pos").cast("long").alias("pos"), kind.alias("kind"))


#: Literal pages: address, html.
LISTINGS = [
    ("https://Banca.org.br/concursos/lista.html?x=1", """<a href="edital-1.pdf">Edital nº 1 de abertura</a><a class='b' href='/provas/p1?a=1&amp;b=2#z'>Prova objetiva <b>azul</b></a><a href="../gab/./g.pdf#p">Gabarito   preliminar</a><a href="//cdn.org/apostila.PDF?v=2">Apostila</a>
<a href="?pagina=2">Página dois da lista</a><a href="#topo">voltar ao topo agora</a><a href="javascript:x()">abrir a janela</a><a href="https://WWW.Outra.org">Retificação do edital</a><a href="https://outra.org?b=1">Programa das provas</a><a href="edital-1.pdf">Edital repetido aqui</a>"""),
    ("https://banca.org.br", """<a href="x/y/../../z.pdf">Conteúdo em PDF</a><a href="a/..">Cima da pasta</a><a href="/noticias/1">Notícias do edital</a><a href="/n">Saiba mais</a><a href="/c">Leia  mais</a><a href="/curto">curto</a><a href="/boleto.pdf">Segunda via</a><a href="/i.pdf">Inscrição online</a><a href="mailto:a@b.c">Escreva para nós</a>"""),
    ("sem endereço", """<a href="/edital.pdf">Edital sem base</a><a href="https://a.org/e.pdf">Edital com base</a><a href="https://a.org/f.pdf"></a><a href=''>Vazio edital</a>"""),
]
LISTED = "(SELECT page_id, url, html FROM pages UNION ALL SELECT * FROM (VALUES " + ", ".join("(%d, '%s', '%s')" % (-1 - i, u, x.replace("'", "''")) for i, (u, x) in enumerate(LISTINGS)) + ") v(page_id, url, html))"


def _listed(t):
    return t.pages.select("page_id", "url", "html").unionByName(t.spark.createDataFrame([(-1 - i, u, x) for i, (u, x) in enumerate(LISTINGS)], "page_id long, url string, html string"))


def _sql_decoded(x: str) -> str:
    for entity, char in L.DECODED:
        x = "regexp_replace(%s, '%s', '%s', 'gi')" % (x, entity, char.replace("'", "''"))
    return x


ANCHOR_SQL = L.ANCHOR.replace("'", "''")


def _sql_undotted(x: str) -> str:
    """Enough for the paths at hand: . and .. taken away three times."""
    for _ in range(3):
        x = r"regexp_replace(regexp_replace(%s, '/\.(/|$)', '/'), '/[^/]+/\.\.(/|$)', '/')" % x
    return x


ORIGIN = "lower(regexp_extract(url, '(?i)^(https?://[^/?#]+)', 1))"
FOLDER = "coalesce(nullif(regexp_extract(url, '(?i)^https?://[^/?#]+(/(?:[^?#]*/)?)?', 1), ''), '/')"
RAW_PATH, RAW_TAIL = "regexp_extract(raw, '^([^?#]*)', 1)", "regexp_extract(raw, '([?#].*)$', 1)"
HREF = f"""CASE WHEN regexp_matches(raw, '(?i)^https?://[^/?#]+') THEN lower(regexp_extract(raw, '(?i)^(https?://[^/?#]+)', 1)) || CASE WHEN regexp_matches(raw, '(?i)^https?://[^/?#]+([?#]|$)') THEN '/' ELSE '' END || regexp_extract(raw, '(?i)^https?://[^/?#]+(.*)$', 1)
WHEN regexp_matches(raw, '(?i)^[a-z][a-z0-9+.-]*:') THEN raw WHEN {ORIGIN} = '' THEN NULL WHEN raw LIKE '//%' THEN regexp_extract({ORIGIN}, '^([a-z]+:)', 1) || raw WHEN raw LIKE '/%' THEN {ORIGIN} || {_sql_undotted(RAW_PATH)} || {RAW_TAIL}
WHEN {RAW_PATH} = '' THEN {ORIGIN} || coalesce(nullif(regexp_extract(url, '(?i)^https?://[^/?#]+([^?#]*)', 1), ''), '/') || {RAW_TAIL} ELSE {ORIGIN} || {_sql_undotted(f"({FOLDER} || {RAW_PATH})")} || {RAW_TAIL} END"""
ANCHORED = f"""(SELECT page_id, pos, title, {HREF} AS href FROM (SELECT page_id, url, pos, {_sql_decoded("trim(h)")} AS raw, {_sql_decoded("trim(regexp_replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '[[:space:]]+', ' ', 'g'))")} AS title FROM
(SELECT page_id, url, unnest(regexp_extract_all(html, '{ANCHOR_SQL}', 1)) AS h, unnest(regexp_extract_all(html, '{ANCHOR_SQL}', 2)) AS x, generate_subscripts(regexp_extract_all(html, '{ANCHOR_SQL}', 1), 1) - 1 AS pos FROM {LISTED})) WHERE raw <> '' AND raw NOT LIKE '#%' AND raw NOT LIKE 'javascript:%')"""
PATTERNS = ["edital|prova", "/concursos/", "en", "(nenhum"]


@query("src_17", f"""SELECT page_id, href, min(pos) AS pos, arg_min(title, pos) AS title FROM {ANCHORED} WHERE href IS NOT NULL AND length(title) >= 8 AND NOT regexp_matches(title, '{C.sql_regex(L.JUNK_TITLE)}') AND NOT regexp_matches(href, '{C.sql_regex(L.JUNK_URL)}')
AND (regexp_matches(title || ' ' || href, '(?i){"|".join(PATTERNS[:3])}') OR contains(lower(title || ' ' || href), '(nenhum')) GROUP BY page_id, href""")
def listing_links(t):
    return L.listing_links(_listed(t), PATTERNS)


@query("src_18", f"""SELECT *, CASE {' '.join(f"WHEN regexp_matches(title || ' ' || href, '{C.sql_regex(p)}') THEN '{k}'" for k, _, p in I.HINTS)} ELSE 'unknown' END AS kind FROM (SELECT page_id, href, min(pos) AS pos, arg_min(title, pos) AS title FROM {ANCHORED}
WHERE href IS NOT NULL AND length(title) >= 3 AND NOT regexp_matches(title, '{C.sql_regex(L.SKIPPED)}') AND NOT regexp_matches(href, '{C.sql_regex(L.SKIPPED)}') AND (regexp_matches(href, '{C.sql_regex(L.PDF)}') OR regexp_matches(title, '{C.sql_regex(L.DOCUMENT_LABEL)}')) GROUP BY page_id, href)""")
def document_links(t):
    return L.document_links(_listed(t))


@query("src_11", r"""WITH r AS (SELECT doc_id, pos, list_transform(string_split(line, ' | '), lambda c: trim(c)) AS cells FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE contains(line, ' | ')),
w AS (SELECT doc_id, max(len(cells)) AS width, min(pos) AS head FROM r GROUP BY 1)
SELECT doc_id, string_agg('| ' || array_to_string(list_concat(cells, list_transform(generate_series(1, (width - len(cells))::BIGINT), lambda i: '')), ' | ') || ' |' || CASE WHEN pos = head THEN chr(10) || '| ' || array_to_string(list_transform(generate_series(1, width::BIGINT), lambda i: '---'), ' | ') || ' |' ELSE '' END, chr(10) ORDER BY pos) AS markdown FROM r JOIN w USING (doc_id) GROUP BY 1""")
def page_tables(t):
    """Rows with bars, written as the table of a page and read back by the parser: ragged rows padded, a rule under the head."""
    escaped = F.replace(F.replace(F.col("line"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    rows = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.col("line").contains(" | "))
    cells = F.array_join(F.transform(F.split(escaped, r" \| "), lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))), "")
    tables = rows.groupBy(F.col("doc_id").alias("page_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat(F.lit("<tr>"), cells, F.lit("</tr>")).alias("row")))), lambda r: r.row), "").alias("rows"))
    html = F.concat(F.lit("<body><table>"), "rows", F.lit("</table></body>"))
    return read_blocks(tables.select("page_id", html.alias("html"))).where("kind = 'table'").select(F.col("page_id").alias("doc_id"), F.col("text").alias("markdown"))


DENY = ", ".join(f"'{d}'" for d in [*P.DENIED_DOMAINS, "ththon.example.com"])
REASON = f"""CASE WHEN {HOST} = '' THEN 'bad_url' WHEN len(list_filter(generate_series(1, len(string_split({HOST}, '.'))), lambda i: array_to_string(string_split({HOST}, '.')[i:], '.') IN ({DENY}))) > 0 THEN 'denylist_domain'
WHEN regexp_matches({HOST}, '(?i){P.DENIED_TLD}') THEN 'denylist_tld' WHEN regexp_matches(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '(?i){P.DENIED_FILE}') THEN 'deny_file_type'
WHEN regexp_matches(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '(?i){P.DENIED_PATH}') THEN 'deny_path' WHEN regexp_matches(url, '(?i){P.PAGINATION}') THEN 'deny_pagination'
WHEN len(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> '')) >= 3 THEN 'too_many_params'
WHEN len(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: lower(split_part(p, '=', 1)) IN ({', '.join(repr(k) for k in P.TRACKING)}))) > 0 THEN 'tracking_param' WHEN regexp_matches({TITLE}, '(?i){P.TITLE_SPAM}') THEN 'title_spam' END"""


@query("flt_09", f"SELECT page_id, {REASON} AS reason FROM pages")
def candidate_screen(t):
    reason = P.reject_reason(F.col("url"), P.title_of(F.col("html")), [*P.DENIED_DOMAINS, "ththon.example.com"])
    return t.pages.select("page_id", reason.alias("reason"))


SEARCHED = f"(SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'https://www.' || {P.KNOWLEDGE_DOMAINS!r}[page_id % {len(P.KNOWLEDGE_DOMAINS)} + 1] || '/p' || page_id ELSE url END AS url, html FROM pages)"


@query("flt_10", f"""SELECT url, min(page_id) AS page_id FROM (SELECT page_id, url, {HOST} AS host, {REASON} AS reason, row_number() OVER (PARTITION BY page_id % 40 ORDER BY page_id) AS rank FROM {SEARCHED}) WHERE reason IS NULL AND host <> '' AND (rank <= {P.LAST_RANK} OR host = ANY({P.KNOWLEDGE_DOMAINS!r}) OR len(list_filter({P.KNOWLEDGE_DOMAINS!r}, lambda d: host LIKE '%.' || d)) > 0) GROUP BY url""")
def candidates(t):
    """Results of forty searches, each ranked; every seventh is of a domain that is known."""
    known = F.concat(F.lit("https://www."), F.get(F.array(*map(F.lit, P.KNOWLEDGE_DOMAINS)), (F.col("page_id") % len(P.KNOWLEDGE_DOMAINS)).cast("int")), F.lit("/p"), F.col("page_id").cast("string"))
    rows = t.pages.select("page_id", F.when(F.col("page_id") % 7 == 0, known).otherwise(F.col("url")).alias("url"), P.title_of(F.col("html")).alias("title"))
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy(F.col("page_id") % 40).orderBy("page_id")))
    host = host_of(F.col("url"))
    reason = P.reject_reason(F.col("url"), F.col("title"), [*P.DENIED_DOMAINS, "ththon.example.com"])
    kept = rows.where(reason.isNull() & (host != "") & ((F.col("rank") <= P.LAST_RANK) | P.within(host, P.KNOWLEDGE_DOMAINS)))
    return kept.groupBy("url").agg(F.min("page_id").alias("page_id"))


#: Pages as they are, and some with calls to act or Portuguese in front.
_FRONT = "CASE page_id % 5 WHEN 1 THEN 'Assine agora o plano premium hoje. ' || 'Compre com desconto e cupom já. ' WHEN 2 THEN 'Texto com a lei. ' ELSE '' END"
_SENTENCES = "list_filter(string_split(regexp_replace(x, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda b: length(trim(b)) > 20)"


@query("flt_11", f"""SELECT page_id, CASE WHEN length(x) < {P.LEAST_TEXT} THEN 'too_short' WHEN anchors > {P.MOST_LINKS} THEN 'link_density' WHEN len(list_filter({_SENTENCES}, lambda b: regexp_matches(b, '(?i){P.CALLS_TO_ACT}'))) / greatest(len({_SENTENCES}), 1) > {P.MOST_CALLS} THEN 'cta_ratio'
WHEN NOT regexp_matches(substr(x, 1, {P.HINT_CHARS}), '(?i){P.PORTUGUESE}') THEN 'language' END AS reason FROM (SELECT page_id, {_FRONT} || {ROUGH} AS x, {ANCHORS} AS anchors FROM pages)""")
def after_fetch(t):
    front = F.when(F.col("page_id") % 5 == 1, "Assine agora o plano premium hoje. Compre com desconto e cupom já. ").when(F.col("page_id") % 5 == 2, "Texto com a lei. ").otherwise("")
    return t.pages.select("page_id", P.after_fetch(F.concat(front, P.rough_text(F.col("html"))), F.col("html")).alias("reason"))


@query("flt_18", f"SELECT page_id, CASE {' '.join(f'''WHEN regexp_matches(html, '(?i){p}') THEN '{i}' ''' for i, p in P.OUTPUT_POLICIES)} END AS policy FROM (SELECT page_id, html || CASE WHEN page_id % 4 = 0 THEN url || ' utm_x ' ELSE '' END AS html FROM pages)")
def output_policies(t):
    text = F.concat("html", F.when(F.col("page_id") % 4 == 0, F.concat("url", F.lit(" utm_x "))).otherwise(""))
    return t.pages.select("page_id", P.blocked_by(text).alias("policy"))


@query("rk_03", r"""SELECT doc_id, round(CASE WHEN regexp_matches(text, '(?m)^#{1,3}\s|^\d+(\.\d+)*\s') THEN 0.35 ELSE 0 END + CASE WHEN regexp_matches(text, '(?i)por exemplo|exemplo:') THEN 0.25 ELSE 0 END
+ CASE WHEN regexp_matches(text, '(^|\n)\s*[-*•]\s|(^|\n)\s*\d+[.)]\s') THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(text, '(?i)art\.\s*\d+') THEN 0.2 ELSE 0 END, 6)::DOUBLE AS structure FROM documents""")
def structure(t):
    return t.documents.select("doc_id", F.round(P.structure_score(F.col("text")), 6).alias("structure"))


@query("ex_03", r"""SELECT page_id, regexp_matches(html, '(?i)id="(root|app)"') OR length(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) < 2000 AS shell FROM pages""")
def spa_shell(t):
    visible = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]+>", " "), r"\s+", " "))
    return t.pages.select("page_id", (F.regexp_like("html", F.lit('(?i)id="(root|app)"')) | (F.char_length(visible) < 2000)).alias("shell"))


@query("wn_24", "SELECT min(page_id) AS page_id, url FROM pages GROUP BY url")
def artifact_insert(t):
    return T.first_by(t.pages, ["url"], [F.col("page_id")]).select("page_id", "url")


@query("fn_url", f"SELECT page_id, {HOST} AS host, rtrim(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])(ref|utm_[a-z]+)=[^&]*', '\\1', 'g'), '?&') AS canonical FROM pages")
def canonical_url(t):
    plain = F.regexp_replace(F.regexp_replace("url", "#.*$", ""), "([?&])(ref|utm_[a-z]+)=[^&]*", "$1")
    return t.pages.select("page_id", host_of(F.col("url")).alias("host"), F.rtrim(plain, F.lit("?&")).alias("canonical"))


@query("fn_slug", f"SELECT page_id, regexp_replace(substr(regexp_replace(regexp_replace(strip_accents(lower({TITLE})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 64), '-+$', '') AS slug FROM pages")
def slugs(t):
    from millrace.functions.text import slug

    return t.pages.select("page_id", slug(P.title_of(F.col("html"))).alias("slug"))
