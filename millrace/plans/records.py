"""Passages, versions, listings, hints, units, profiles, keyed answers, editions (EV-02, SY-05, WN-11, MP-05, WN-21, WN-22, VA-05, GT-02, EX-05, EX-08)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import host_of
from millrace.operators import booklets as B
from millrace.operators import curation as C
from millrace.operators import exams as E
from millrace.operators import items as I
from millrace.operators import syllabus as S
from millrace.operators import tables as T
from millrace.operators.sinks import KeptTable
from millrace.plans import Catalog
from millrace.plans.detail import FIRST, FIRSTS
from millrace.plans.exams import PAPERS, _papers
from millrace.plans.roles import has, quoted
from millrace.plans.sites import PICK, RANGES, STARTS
from millrace.plans.syllabus import EACH, OUTLINE, SECTIONS, SLUG, SQUEEZE, _sections
from millrace.plans.web import ANCHORED, HOST, _listed
from millrace.sources import detail as D
from millrace.sources import listings as L
from millrace.sources import pages as P
from millrace.workspace import materialize

catalog = Catalog()
query = catalog.query

# --- passages ----------------------------------------------------------------------------------------


@query("ev_02", f"""WITH m AS (SELECT paper, number AS first, CASE WHEN number % 30 = 21 THEN number - 5 WHEN number % 20 = 1 THEN number + 14 ELSE number + 3 END AS last, 'Leia ' || prompt || ' com atenção.' AS passage FROM {PAPERS} WHERE number % 10 = 1)
SELECT paper, n AS number, passage FROM (SELECT *, unnest(generate_series(first, last)) AS n FROM m WHERE last >= first) QUALIFY row_number() OVER (PARTITION BY paper, n ORDER BY first DESC) = 1""")
def passages(t):
    """Papers with an announced passage before every tenth question; some ranges overlap, some run backwards."""
    papers = _papers(t)
    blocks = E.question_blocks(papers, "paper", "text")  # the papers' own questions, in their numbers
    c, n = F.col, F.col("number")
    own = t.part.withColumn("rn", F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey")) - 1)
    own = own.select(F.concat_ws("-", "p_brand", F.floor(c("rn") / 50).cast("string")).alias("paper"), (c("rn") % 50 + 1).cast("int").alias("number"), "p_name")
    rows = own.join(blocks.select("paper", "number", "prompt"), ["paper", "number"], "left")
    last = F.when(n % 30 == 21, n - 5).when(n % 20 == 1, n + 14).otherwise(n + 3)
    passage = F.when(n % 10 == 1, F.concat(F.lit("\nTexto  para as questões "), n.cast("string"), F.lit(" a "), last.cast("string"), F.lit(": Leia\n"), "p_name", F.lit(" com  atenção.\n"))).otherwise("")
    text = F.concat(passage, n.cast("string"), F.lit(") "), F.coalesce("prompt", "p_name"), F.lit("\n"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", text.alias("text")))), lambda r: r.text), "\n")  # fifty at most
    return E.passages(rows.groupBy("paper").agg(joined.alias("text")), "paper", "text")


# --- versions ----------------------------------------------------------------------------------------


@query("sy_05", f"""WITH sections AS MATERIALIZED (SELECT * FROM {SECTIONS}), named AS (SELECT NULL AS doc, ['x'] AS slugs), {OUTLINE.replace('{rest}', 'sections')},
made AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY depth, ordinal) AS made FROM outline), v AS (SELECT doc, max(length(doc) % 3) AS last FROM sections WHERE length(doc) % 3 > 0 GROUP BY 1)
SELECT m.doc, coalesce(last, 0) + 1 AS version, m.ordinal, m.depth, m.path, (SELECT arg_max(p.ordinal, p.made) FROM made p WHERE p.doc = m.doc AND p.path = m.parent AND p.made < m.made) AS parent_ordinal FROM made m LEFT JOIN v USING (doc)""")
def versions(t):
    sections = _sections(t)
    old = sections.select("doc", (F.char_length("doc") % 3).alias("version")).where("version > 0").distinct()
    return S.next_version(old, materialize(S.outline_nodes(sections), "nodes"), "doc")


# --- listings ----------------------------------------------------------------------------------------

OPEN, YEAR = ["abert", "edital"], 2024
_TEXT = "title || ' ' || href"
SCORE = "CASE WHEN regexp_matches(title, '(?i)" + L.DATED[0] + "') OR regexp_matches(href, '(?i)" + L.DATED[1] + "') THEN 5 ELSE 0 END" + "".join(f" + CASE WHEN regexp_matches({'href' if f == 'href' else _TEXT}, '(?i){p}') THEN {n} ELSE 0 END" for f, p, n in L.LIKENESS)


@query("wn_11", f"""WITH l AS (SELECT page_id, href, min(pos) AS pos, arg_min(title, pos) AS title FROM {ANCHORED} WHERE href IS NOT NULL AND length(title) >= 8 AND NOT regexp_matches(title, '{C.sql_regex(L.JUNK_TITLE)}') AND NOT regexp_matches(href, '{C.sql_regex(L.JUNK_URL)}') GROUP BY page_id, href),
s AS (SELECT *, {SCORE} AS score, regexp_matches({_TEXT}, '(?i){"|".join(OPEN)}') AS open, nullif(regexp_extract({_TEXT}, '\\b(20[0-9]{{2}})\\b', 1), '')::INT AS year FROM l),
k AS (SELECT *, bool_or(open) OVER (PARTITION BY page_id) AS opened FROM s WHERE coalesce(year >= {YEAR}, true))
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN opened THEN 0 ELSE -score END, pos, href) - 1 AS place, href, score FROM k WHERE open OR NOT opened""")
def open_listings(t):
    return L.open_listings(L.listing_links(_listed(t), []), OPEN, YEAR)


#: Links of the listing fields: given pages, each with the title of its own, and literal ones.
LINKS = [
    ("Concurso Transpetro 2026 - Cesgranrio", "https://b.org/concurso/transpetro-2026/", "Inscrições de 12/08 a 21/09/2026"),
    ("Prefeitura de  Santos inscrições abertas 2025", "https://b.org/edital.pdf", ""),
    ("Direito, engenharia civil e TI: TI", "https://petrobras.example/concursos/PM_AL_27", None),
    ("Vestibular aberto", "https://b.org/concursos/xyz2030", "período de inscrições: 01/01/2020 a 02/02/2020"),
    ("Edital de abertura", "https://b.org/z", None),
    ("Edital publicado OAB", "https://b.org/concursos/todos", "x"),
]
TODAY = "2026-09-01"
_LINKS = f"(SELECT page_id, coalesce(nullif(regexp_replace(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '\\s+', ' ', 'g'), ''), 'sem título') AS title, url AS href, {HOST} AS domain, NULL AS text FROM pages UNION ALL SELECT i, title, href, regexp_extract(href, '^[a-z]+://([^/]+)', 1), text FROM (VALUES {', '.join(f'({-1 - i}, {quoted(a)}, {quoted(h)}, {quoted(x)})' for i, (a, h, x) in enumerate(LINKS))}) v(i, title, href, text))"
_RAW = f"trim(regexp_replace(coalesce(url_decode(regexp_extract(regexp_extract(href, '^[a-z]+://[^/?#]+([^?#]*)', 1), '(?i){D.PATH}', 1)), ''), '[-_]+', ' ', 'g'))"
_NAV = "list_aggregate(list_transform(list_filter(string_split(s, '-'), lambda w: w <> ''), lambda w: list_contains(" + repr(P.NAV_WORDS) + ", w)), 'bool_and')"


@query("ex_05", f"""WITH a AS (SELECT page_id, {SQUEEZE('title')} AS title, href, domain, text, {_RAW} AS raw, {SLUG(_RAW)} AS s FROM {_LINKS}), b AS (SELECT *, CASE WHEN raw <> '' AND length(s) >= 4 AND regexp_matches(s, '[a-z]') AND NOT {_NAV} THEN s END AS path, {SQUEEZE("concat_ws(' ', nullif(text, ''), title)")} AS x FROM a),
c AS (SELECT *, coalesce({FIRST('title', D.HOLDER)}, {FIRST('domain', D.HOLDER)}) AS org, {FIRST('title', D.SETTER)} AS banca, coalesce(nullif(regexp_extract(path, '(20\\d{{2}})', 1), ''), '20' || nullif(regexp_extract(path, '(?:^|-)(2\\d)(?:-|$)', 1), ''), nullif(regexp_extract(title, '\\b(20\\d{{2}})\\b', 1), '')) AS edition,
 {RANGES}, regexp_extract(x, '(?i){D.UNTIL}', 1) AS u FROM b), d AS (SELECT *, {STARTS} FROM c), e AS (SELECT *, {PICK('s')} AS start_day, {PICK('e')} AS end_day FROM d),
f AS (SELECT *, coalesce(path, CASE WHEN org IS NOT NULL AND edition IS NOT NULL THEN {SLUG('org')} || '-' || edition END, {SLUG('substr(title, 1, 80)')}) AS slug FROM e),
g AS (SELECT *, coalesce(nullif(regexp_extract(concat_ws(' ', edition, slug, title, href, end_day::VARCHAR), '\\b(20\\d{{2}})\\b', 1), '')::INT >= 2026, true) AS now, {' OR '.join(f"coalesce(nullif(regexp_extract(href, '(?i){p}', 1), '')::INT >= 2026, false)" for p in D.YEARLY)} AS addressed FROM f)
SELECT page_id, title, org, banca, edition, slug, CASE WHEN {has("title || ' ' || coalesce(text, '')", D.OAB)} THEN 'oab' WHEN {has('title', r'\bconcurso\b')} AND NOT {has('title', D.NO_EXAM)} AND NOT {has('title', r'\bvestibular\b')} THEN 'concurso' WHEN {has("title || ' ' || coalesce(text, '')", r'\bvestibular\b')} AND NOT {has("title || ' ' || coalesce(text, '')", D.PUBLIC)} THEN 'vestibular'
WHEN {has("title || ' ' || coalesce(text, '')", D.NO_EXAM)} AND NOT {has("title || ' ' || coalesce(text, '')", D.PUBLIC)} THEN 'other' ELSE 'concurso' END AS kind, array_to_string({FIRSTS(EACH(f"regexp_extract_all(title, '{C.sql_regex(D.EMPHASIS)}')", SQUEEZE), D.MOST_EMPHASIS)}, '|') AS emphasis, CASE WHEN regexp_matches(href, '(?i)edital|pdf') THEN href END AS edital,
CASE WHEN CASE WHEN start_day IS NOT NULL THEN now AND DATE '{TODAY}' BETWEEN start_day AND end_day ELSE now AND ({has('title', P.OPEN_HINT)} OR addressed) END THEN 'open' ELSE 'unknown' END AS status, CASE WHEN start_day IS NOT NULL THEN 'date' WHEN now AND ({has('title', P.OPEN_HINT)} OR addressed) THEN 'regex' END AS source FROM g""")
def listed_exams(t):
    title = P.title_of(F.col("html"))
    own = t.pages.select("page_id", F.when(title == "", "sem título").otherwise(title).alias("title"), F.col("url").alias("href"), host_of(F.col("url")).alias("domain"), F.lit(None).cast("string").alias("text"))
    literal = t.spark.createDataFrame([(-1 - i, a, h, h.split("/")[2], x) for i, (a, h, x) in enumerate(LINKS)], "page_id long, title string, href string, domain string, text string")
    rows = D.listed_exams(own.unionByName(literal), F.to_date(F.lit(TODAY)))
    return rows.select("page_id", "title", "org", "banca", "edition", "slug", "kind", F.array_join("emphasis", "|").alias("emphasis"), "edital", "status", "source")


# --- hints and units ---------------------------------------------------------------------------------

#: Leaves looked at, and what a hint counts.
MOST_LEAVES, HINT = 120, 0.85
_HINTED = "SELECT l_orderkey, max(p_partkey) AS leaf, max(p_brand) AS subject FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber = 1 AND l_orderkey % 3 = 0 GROUP BY 1"


@query("mp_05", f"""WITH h AS ({_HINTED}), leaves AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS own, row_number() OVER (ORDER BY p_partkey) AS whole FROM part),
lexical AS (SELECT l_orderkey, l_linenumber, l_partkey AS leaf, round(l_discount * 10, 4)::DOUBLE AS score FROM lineitem), m AS (SELECT x.*, 'lexical' AS method FROM lexical x JOIN leaves v ON v.p_partkey = x.leaf LEFT JOIN h USING (l_orderkey)
 WHERE CASE WHEN h.leaf IS NULL THEN whole <= {MOST_LEAVES} ELSE x.leaf = h.leaf OR (v.p_brand = h.subject AND own <= {MOST_LEAVES}) END UNION ALL SELECT l_orderkey, l_linenumber, h.leaf, {HINT}::DOUBLE, 'topic_hint' FROM lexical JOIN h USING (l_orderkey))
SELECT l_orderkey, l_linenumber, leaf, max(score) AS score, arg_max(method, (score, method)) AS method FROM m GROUP BY 1, 2, 3""")
def topic_hints(t):
    """Lines of an order as chunks of a document, with a first guess each; every third order was fetched for a leaf, which narrows the leaves to its subject and is a guess for every chunk."""
    line = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("leaf"), F.round(F.col("l_discount") * 10, 4).cast("double").alias("score"))
    leaves = t.part.select(F.col("p_partkey").alias("leaf"), F.col("p_brand").alias("subject"))
    first = leaves.orderBy("leaf").limit(MOST_LEAVES).select("leaf", F.lit(True).alias("early"))
    leaves = T.first_by(leaves, ["subject"], [F.col("leaf")], MOST_LEAVES).withColumn("near", F.lit(True)).join(leaves, ["leaf", "subject"], "right").join(first, "leaf", "left")
    hints = line.where("l_linenumber = 1 AND l_orderkey % 3 = 0").join(leaves.select("leaf", "subject"), "leaf").groupBy("l_orderkey").agg(F.max("leaf").alias("hint"), F.max("subject").alias("hinted"))
    guesses = line.join(leaves, "leaf").join(hints, "l_orderkey", "left")
    allowed = F.when(F.col("hint").isNull(), F.col("early")).otherwise((F.col("leaf") == F.col("hint")) | ((F.col("subject") == F.col("hinted")) & F.col("near")))
    guesses = guesses.where(F.coalesce(allowed, F.lit(False))).select("l_orderkey", "l_linenumber", "leaf", "score", F.lit("lexical").alias("method"))
    hinted = line.join(hints, "l_orderkey").select("l_orderkey", "l_linenumber", F.col("hint").alias("leaf"), F.lit(HINT).alias("score"), F.lit("topic_hint").alias("method"))
    return guesses.unionByName(hinted).groupBy("l_orderkey", "l_linenumber", "leaf").agg(F.max("score").alias("score"), F.max_by("method", F.struct("score", "method")).alias("method"))


@query("wn_21", f"""SELECT * FROM (SELECT page_id, host AS leaf, row_number() OVER (PARTITION BY host ORDER BY page_id DESC) - 1 AS place, CASE page_id % 3 WHEN 0 THEN nullif(host, '') WHEN 1 THEN 'b.org' END AS domain FROM (SELECT *, {HOST} AS host FROM pages)) WHERE place < 24""")
def newest_units(t):
    """The newest 24 units of every leaf with the domain of their first evidence that has an address."""
    url = F.col("url")
    evidence = F.when(F.col("page_id") % 3 == 0, F.array(F.lit(""), F.lit("sem endereço"), url, F.lit("https://z.org/"))).when(F.col("page_id") % 3 == 1, F.array(F.lit("https://www.b.org/x"), url)).otherwise(F.array(F.lit("nada")))
    rows = t.pages.select("page_id", host_of(url).alias("leaf"), I.primary_domain(evidence).alias("domain"))
    newest = T.first_by(rows, ["leaf"], [F.desc("page_id")], 24)
    return newest.withColumn("place", F.row_number().over(W.partitionBy("leaf").orderBy(F.desc("page_id"))) - 1)


_PROFILES = "(SELECT o_orderpriority AS banca, o_orderstatus AS subject, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN 'saúde' ELSE 'ti' END AS family, o_orderkey AS updated, o_custkey AS sample FROM orders)"


@query("wn_22", f"""WITH p AS (SELECT * FROM {_PROFILES} QUALIFY row_number() OVER (PARTITION BY banca, subject, family ORDER BY updated DESC) = 1)
SELECT banca, subject, arg_max(family, updated) AS family, max(updated) AS updated, arg_max(sample, updated) AS sample FROM p GROUP BY GROUPING SETS ((banca, subject), (banca), (subject))""")
def latest_profiles(t):
    """Profiles put in by setter, subject and family (none is the empty one) in three batches; the latest of each setter, subject and pair."""
    k = F.col("o_orderkey") % 4
    family = F.when(k == 0, F.lit(None).cast("string")).when(k == 1, "  ").when(k == 2, " saúde ").otherwise("ti")
    rows = t.orders.select(F.col("o_orderpriority").alias("banca"), F.col("o_orderstatus").alias("subject"), F.trim(F.coalesce(family, F.lit(""))).alias("family"), F.col("o_orderkey").alias("updated"), F.col("o_custkey").alias("sample"))
    keys = ["banca", "subject", "family"]
    kept = KeptTable(rows, keys)
    third = rows.agg(F.percentile_approx("updated", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q")).first().q or [0, 0]
    for low, high in ((None, third[0]), (third[0], third[1]), (third[1], None)):
        batch = rows.where((F.lit(low is None) | (F.col("updated") > (low or 0))) & (F.lit(high is None) | (F.col("updated") <= (high or 0))))
        kept.upsert(T.first_by(batch, keys, [F.desc("updated")]))
    latest = F.max(F.struct("updated", "family", "sample")).alias("l")
    out = kept.rows().groupingSets([["banca", "subject"], ["banca"], ["subject"]], "banca", "subject").agg(latest)
    return out.select("banca", "subject", "l.family", "l.updated", "l.sample")


# --- answers and editions ----------------------------------------------------------------------------

FLOOR = 0.55
ANSWERS = "(SELECT event_id, user_id, CASE WHEN event_id % 13 = 0 THEN 'OPEN' ELSE 'MULTIPLE_CHOICE' END AS kind, event_id % 5 AS options, CASE WHEN event_id % 11 > 0 THEN event_id % 4 END AS correct, CASE WHEN user_id % 9 > 0 THEN (user_id + event_id) % 4 END AS selected, CASE WHEN event_id % 6 > 0 THEN event_id % 2 = 0 END AS judged, round(value / 100, 6) AS confidence, CASE WHEN event_id % 7 > 1 THEN event_id % 7 > 3 END AS second FROM events)"
_KEYED = "kind = 'MULTIPLE_CHOICE' AND options >= 2 AND correct IS NOT NULL AND correct < options AND selected IS NOT NULL"


@query("va_05", f"""WITH a AS (SELECT *, selected = correct AS same FROM {ANSWERS} WHERE {_KEYED}), g AS (SELECT *, coalesce(judged, same) AS graded FROM a)
SELECT user_id, count(*) AS answers, count(*) FILTER (graded) AS right_, count(*) FILTER (judged IS NOT NULL AND confidence < {FLOOR}) AS unsure, count(*) FILTER (judged = coalesce(second, same)) AS agree FROM g GROUP BY 1""")
def keyed_answers(t):
    """Keyed answers of each user: how many are right by the first grader (else by the key), graded with little confidence, and graded alike by the second grader (else the key)."""
    e, u = F.col("event_id"), F.col("user_id")
    rows = t.events.select(
        "user_id", F.when(e % 13 == 0, "OPEN").otherwise("MULTIPLE_CHOICE").alias("kind"), (e % 5).alias("options"), F.when(e % 11 > 0, e % 4).alias("correct"), F.when(u % 9 > 0, (u + e) % 4).alias("selected"),
        F.when(e % 6 > 0, e % 2 == 0).alias("judged"), F.round(F.col("value") / 100, 6).alias("confidence"), F.when(e % 7 > 1, e % 7 > 3).alias("second"),
    ).where(I.is_keyed(F.col("kind"), F.col("options"), F.col("correct"), F.col("selected")))
    same = F.col("selected") == F.col("correct")
    return rows.groupBy("user_id").agg(
        F.count("*").alias("answers"), F.count_if(F.coalesce("judged", same)).alias("right_"), F.count_if(F.col("judged").isNotNull() & (F.col("confidence") < FLOOR)).alias("unsure"),
        F.count_if(F.col("judged") == F.coalesce("second", same)).alias("agree"),
    )


TAILS = (" hoje em dia", " conforme a lei n. 9", " vigente segundo o art. 5", " no ano 2024", "", " neste ano")
_STEM = f"text || {list(TAILS)!r}[(conv_id + turn) % {len(TAILS)} + 1]"


@query("gt_02", f"""WITH s AS (SELECT conv_id, turn, role, {_STEM} AS stem FROM conversations), f AS (SELECT *, {has('stem', I.TEMPORAL)} AND NOT {has('stem', I.LEGAL)} AS flagged FROM s)
SELECT conv_id, turn, CASE WHEN role <> 'user' THEN 'failed' WHEN flagged THEN 'needs_review' ELSE 'published' END AS decision, CASE WHEN role = 'user' AND flagged THEN 'ok,temporally_dependent' ELSE 'ok' END AS reasons FROM f""")
def soft_downgrade(t):
    """What would be published goes to review if it depends on the present without citing a law."""
    stem = F.concat("text", F.get(F.array(*map(F.lit, TAILS)), ((F.col("conv_id") + F.col("turn")) % len(TAILS)).cast("int")))
    decision = F.when(F.col("role") == "user", "published").otherwise("failed")
    return t.conversations.select("conv_id", "turn", I.downgraded(decision, F.array(F.lit("ok")), stem).alias("d")).select("conv_id", "turn", "d.decision", F.array_join("d.reasons", ",").alias("reasons"))


_EDITIONS = "[" + ", ".join(f"{{'n': {n}, 'l': {quoted(B.edition_label(n))}}}" for n in B.EDITIONS) + "]"


@query("ex_08", f"""WITH e AS (SELECT unnest({_EDITIONS}) AS e), k AS (SELECT DISTINCT p_size FROM part)
SELECT e.n AS number, phase, CASE WHEN e.n >= {max(B.EDITIONS)} THEN 'open' ELSE 'closed' END AS status, 'oab-' || {SLUG('e.l')} || CASE phase WHEN 'objective' THEN '-1-fase' ELSE '-2-fase' END AS slug, e.l || ' Exame de Ordem Unificado — ' || CASE phase WHEN 'objective' THEN '1ª fase (prova objetiva)' ELSE '2ª fase (prático-profissional)' END AS title
FROM e JOIN k ON k.p_size = e.n, (SELECT unnest(['objective', 'practical']) AS phase)""")
def edition_rows(t):
    """Catalogue rows of the editions that the parts' sizes name, one for each phase."""
    return B.catalogue(t.part.select(F.col("p_size").alias("number")).distinct())
