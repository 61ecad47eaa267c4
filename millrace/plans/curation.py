"""Text curation over documents, labels, benchmark and embeddings: cleaning, chunks, scores, likeness, gate."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import dedup_normalised, fnv1a32, trim
from millrace.operators import curation as C
from millrace.operators import tables as T
from millrace.plans import Catalog
from millrace.workspace import materialize

catalog = Catalog()
query = catalog.query

LINES = "(SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"


def n(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{C.sql_regex(pattern)}'))"


def t_(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


@query("flt_05", rf"""SELECT doc_id, count(*) AS lines, count(*) FILTER (bad) AS boilerplate FROM (SELECT doc_id, regexp_matches(line, '(?i){C.NAVIGATION}')
 OR (length(line) BETWEEN 1 AND 199 AND coalesce(list_sum(list_transform(regexp_extract_all(line, '(?i)https?://\S+|www\.\S+'), lambda x: length(x))), 0) / greatest(length(line), 1) > 0.5)
 OR (len(regexp_extract_all(line, 'https?://')) + len(regexp_extract_all(line, 'www\.')) >= 2 AND length(line) < 160)
 OR (length(line) BETWEEN 1 AND 199 AND length(regexp_replace(line, '\P{{L}}', '', 'g')) / greatest(length(line), 1) < 0.4) AS bad FROM {LINES}) GROUP BY 1""")
def boilerplate(t):
    return C.lines_of(t.documents).groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(C.is_boilerplate(F.col("line"))).alias("boilerplate"))


@query("flt_06", rf"""SELECT doc_id, pos FROM (SELECT *, regexp_replace(line, '\s', '', 'g') AS s, regexp_extract_all(line, '[A-Za-zÀ-ÿ]{{2,}}') AS w FROM {LINES} WHERE length(line) >= 8)
WHERE length(s) = 0 OR length(regexp_replace(line, '\P{{L}}', '', 'g')) / length(s) < 0.6 OR len(w) = 0 OR list_sum(list_transform(w, lambda x: length(x))) / len(w) > 14""")
def garbage(t):
    return C.lines_of(t.documents).where(C.is_garbage(F.col("line"))).select("doc_id", F.col("pos").cast("long").alias("pos"))


@query("flt_07", rf"SELECT doc_id, count(*) FILTER (regexp_matches(line, '(?i)^\s*(P[aá]gina\s+)?\d+(\s*/\s*\d+)?\s*$')) AS page_numbers FROM (SELECT doc_id, unnest(string_split(text || chr(10) || doc_id, chr(10))) AS line FROM documents) GROUP BY 1")
def page_numbers(t):
    numbered = t.documents.withColumn("text", F.concat_ws("\n", "text", F.col("doc_id").cast("string")))
    return C.lines_of(numbered).groupBy("doc_id").agg(F.count_if(C.is_page_number(F.col("line"))).alias("page_numbers"))


@query("flt_08", f"SELECT doc_id, sum(length({t_('line')}))::BIGINT AS chars FROM {LINES} GROUP BY 1 HAVING sum(length({t_('line')})) >= 400")
def minimum_content(t):
    return C.lines_of(t.documents).groupBy("doc_id").agg(F.sum(F.char_length(trim(F.col("line")))).alias("chars")).where("chars >= 400")


@query("flt_01", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_totalprice >= 1000 AND (o_orderpriority LIKE '1%' OR lower(o_orderpriority) LIKE '%low%') AND NOT (o_custkey % 11 = 0) AND o_orderdate IS NOT NULL")
def conditional_filters(t):
    """Only the filters that are set take part."""
    wanted = {"status": ["O", "P"], "least": 1000, "prefix": "1", "within": "LOW", "before": None}
    c, conditions = F.col, [F.col("o_orderdate").isNotNull(), ~(F.col("o_custkey") % 11 == 0)]
    if wanted["status"]:
        conditions.append(c("o_orderstatus").isin(wanted["status"]))
    if wanted["least"] is not None:
        conditions.append(c("o_totalprice") >= wanted["least"])
    if wanted["before"] is not None:
        conditions.append(c("o_orderdate") < F.lit(wanted["before"]))
    either = [c("o_orderpriority").startswith(wanted["prefix"]), F.lower("o_orderpriority").contains(wanted["within"].lower())]
    out = t.orders.where(either[0] | either[1])
    for condition in conditions:
        out = out.where(condition)
    return out.select("o_orderkey")


@query("flt_02", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE (quality IS NULL OR quality = 0) AND coalesce(toxic, 0) = 0 AND n_chars > 0 AND source NOT LIKE 'src1%' ORDER BY doc_id LIMIT 100")
def uncertain_documents(t):
    d = t.documents.select("doc_id", "n_chars", "source").join(t.labels, "doc_id", "left")
    unsure = (F.col("quality").isNull() | (F.col("quality") == 0)) & (F.coalesce("toxic", F.lit(0)) == 0)
    return d.where(unsure & (F.col("n_chars") > 0) & ~F.col("source").startswith("src1")).orderBy("doc_id").limit(100).select("doc_id")


ROLE_SQL = "CASE WHEN doc_id % 5 = 0 THEN 'specification' WHEN doc_id % 5 = 1 THEN 'evidence' WHEN doc_id % 5 = 2 THEN 'mixed' ELSE 'knowledge' END"


def _role():
    five = F.col("doc_id") % 5
    return F.when(five == 0, "specification").when(five == 1, "evidence").when(five == 2, "mixed").otherwise("knowledge")


@query("flt_03", f"SELECT doc_id FROM (SELECT doc_id, quality, {ROLE_SQL} AS role, doc_id % 3 AS s FROM documents JOIN labels USING (doc_id)) WHERE quality = 1 AND role IN ('knowledge', 'mixed') AND s IN (0, 1)")
def knowledge_guard(t):
    d = t.documents.select("doc_id", _role().alias("role"), (F.col("doc_id") % 3).alias("s")).join(t.labels, "doc_id")
    return d.where((F.col("quality") == 1) & F.col("role").isin("knowledge", "mixed") & F.col("s").isin(0, 1)).select("doc_id")


@query("flt_25", """SELECT user_id FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 3
GROUP BY 1 HAVING count(*) = 3 AND bool_and(event_type IN ('error', 'view'))""")
def poisoned(t):
    last = T.first_by(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")], 3)
    return last.groupBy("user_id").agg(F.count("*").alias("n"), F.bool_and(F.col("event_type").isin("error", "view")).alias("bad")).where("n = 3 AND bad").select("user_id")


@query("cl_01", "SELECT doc_id, sha256(replace(replace(translate(translate(nfc_normalize(text || chr(160) || '“x” ‘y’ – — e' || chr(769) || 'o' || chr(771) || chr(8203) || 'ﬁ'), chr(160) || '“”‘’–—', ' \"\"''''--'), chr(8203) || chr(65279), ''), 'ﬁ', 'fi'), 'ﬂ', 'fl')) AS digest FROM documents")
def encoding(t):
    return t.documents.select("doc_id", F.sha2(C.clean_encoding(F.concat("text", F.lit("\u00a0“x” ‘y’ – — e\u0301o\u0303\u200b\ufb01"))), 256).alias("digest"))


@query("cl_02", r"SELECT doc_id, sha256(regexp_replace(text || chr(57344) || chr(57345) || 'x' || chr(57344), '[\x{E000}-\x{F8FF}]{2,}', ' ', 'g')) AS digest FROM documents")
def ligatures(t):
    return t.documents.select("doc_id", F.sha2(C.drop_private_use(F.concat("text", F.lit("\ue000\ue001x\ue000"))), 256).alias("digest"))


@query("cl_03", r"SELECT doc_id, sha256(regexp_replace(regexp_replace(replace(text, 'an ', 'an- '), '(\p{L})-[ \t]*\n[ \t]*(\p{Ll})', '\1\2', 'g'), '(\p{L})- (\p{Ll})', '\1\2', 'g')) AS digest FROM documents")
def hyphenation(t):
    return t.documents.select("doc_id", F.sha2(C.join_hyphens(F.replace("text", F.lit("an "), F.lit("an- "))), 256).alias("digest"))


#: Lines as blocks: thirty to a page; a heading has capitals and no lower-case letter, a table row has bars; two lines stand on every page.
BLOCKS = f"""(SELECT doc_id, source, pos, pos // 30 AS page, line, CASE WHEN regexp_matches(line, '^[^a-z]*[A-Z][^a-z]*$') THEN 'heading' WHEN contains(line, ' | ') THEN 'table' ELSE 'paragraph' END AS kind FROM {LINES}
UNION ALL SELECT doc_id, source, -1 - k - 2 * page, page, CASE WHEN k = 0 THEN 'Página ' || (page + 1) ELSE ' Folha de rosto da prova ' END, 'paragraph' FROM (SELECT DISTINCT doc_id, source, pos // 30 AS page FROM {LINES}), (SELECT unnest([0, 1]) AS k))"""


def _blocks(t):
    line, pos = F.col("line"), F.col("pos")
    lines = T.dealt(t.documents, ["doc_id", "source"], F.split("text", "\n"), "pos", "line")
    kind = F.when(F.regexp_like(line, F.lit("^[^a-z]*[A-Z][^a-z]*$")), "heading").when(line.contains(" | "), "table").otherwise("paragraph")
    own = lines.select("doc_id", "source", pos.cast("long").alias("pos"), F.floor(pos / 30).alias("page"), "line", kind.alias("kind"))
    # pages are counted by line ends, without the lines
    ends = F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit("")))
    pages = T.dealt(t.documents, ["doc_id", "source"], F.sequence(F.lit(0).cast("long"), F.floor(ends / 30)), "at", "page").drop("at").distinct()
    pages = pages.select("doc_id", "source", "page", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    foot = F.when(F.col("k") == 0, F.concat(F.lit("Página "), (F.col("page") + 1).cast("string"))).otherwise(" Folha de rosto da prova ")
    return own.unionByName(pages.select("doc_id", "source", (-1 - F.col("k") - 2 * F.col("page")).alias("pos"), "page", foot.alias("line"), F.lit("paragraph").alias("kind")))


MARKED = f"""(SELECT x.* EXCLUDE (kind), CASE WHEN n_pages >= 3 AND times >= greatest(2, floor(0.6 * n_pages)) AND num <> 'heading' THEN 'page_artifact' ELSE num END AS kind FROM
(SELECT *, CASE WHEN regexp_matches(line, '(?i)^\\s*(P[aá]gina\\s+)?\\d+(\\s*/\\s*\\d+)?\\s*$') THEN 'page_artifact' ELSE kind END AS num, CASE WHEN length({t_('line')}) < 80 THEN count(*) OVER (PARTITION BY doc_id, lower({t_('line')})) ELSE 0 END AS times FROM %s) x JOIN (SELECT doc_id, count(DISTINCT page) AS n_pages FROM %s GROUP BY 1) USING (doc_id))"""


@query("cl_04", f"SELECT doc_id, kind, count(*) AS n, sum(pos)::BIGINT AS positions FROM {MARKED.replace('%s', BLOCKS)} GROUP BY ALL")
def page_artifacts(t):
    return C.mark_page_artifacts(_blocks(t)).groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.sum("pos").alias("positions"))


def _flag_sql(kind):
    return n("substr(text, 1, 2000)", C.FLAG_WORDS[kind])


@query("cl_05", f"SELECT doc_id, {_flag_sql('es')} > {_flag_sql('pt')} + 2 AND {_flag_sql('es')} > {_flag_sql('en')} + 2 AS foreign_text FROM documents")
def language_flag(t):
    return t.documents.select("doc_id", C.foreign_flag(F.col("text")).alias("foreign_text"))


KEY = rf"lower(regexp_replace({t_('line')}, '\s+', ' ', 'g'))"
RANKED = f"(SELECT *, CASE WHEN key IS NOT NULL THEN dense_rank() OVER (PARTITION BY source, key ORDER BY doc_id) ELSE 0 END AS rank FROM (SELECT *, CASE WHEN length({KEY}) >= 40 AND kind NOT IN ('heading', 'table') THEN {KEY} END AS key FROM %s))"


@query("cl_06", f"SELECT doc_id, count(*) AS kept, sum(pos)::BIGINT AS positions FROM {RANKED % BLOCKS} WHERE rank <= 3 GROUP BY 1")
def repeated_lines(t):
    key = C.line_key(F.col("line"), exempt=F.col("kind").isin("heading", "table"))
    keyed = materialize(_blocks(t).select("doc_id", "source", "pos", key.alias("key")), "keyed")
    return C.drop_repeated_lines(keyed, "source", key="key").groupBy("doc_id").agg(F.count("*").alias("kept"), F.sum("pos").alias("positions"))


@query("cl_07", rf"""SELECT doc_id, sha256(coalesce((SELECT string_agg(x, chr(10) ORDER BY i) FROM (SELECT unnest(a) AS x, generate_subscripts(a, 1) AS i FROM (SELECT list_transform(string_split(regexp_replace(text, '[ \t]+', ' ', 'g'), chr(10)), lambda s: {t_('s')}) AS a)) WHERE x <> ''), '')) AS digest FROM documents""")
def whitespace(t):
    return t.documents.select("doc_id", F.sha2(C.clean_whitespace(F.col("text")), 256).alias("digest"))


@query("cl_08", f"SELECT doc_id, CASE WHEN {t_('substr(text, 1, 4000)')} = '' THEN 'unknown' WHEN {n('substr(text, 1, 4000)', C.LANGUAGE_WORDS['pt'])} >= {n('substr(text, 1, 4000)', C.LANGUAGE_WORDS['en'])} THEN 'pt' ELSE 'en' END AS language FROM documents")
def language_guess(t):
    return t.documents.select("doc_id", C.guess_language(F.col("text")).alias("language"))


@query("cl_09", f"SELECT source, count(*) AS blocks, sum(length(line))::BIGINT AS chars, count(*) FILTER (regexp_matches(line, '^[^a-z]*[A-Z][^a-z]*$')) AS headings FROM {LINES} GROUP BY 1")
def statistics(t):
    lines = t.documents.select("source", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("source").agg(F.count("*").alias("blocks"), F.sum(F.char_length("line")).alias("chars"), F.count_if(F.regexp_like("line", F.lit(r"^[^a-z]*[A-Z][^a-z]*$"))).alias("headings"))


@query("cl_00", f"""WITH e AS MATERIALIZED (SELECT * REPLACE (regexp_replace(replace(replace(translate(translate(nfc_normalize(line), chr(160) || '“”‘’–—', ' ""''''--'), chr(8203) || chr(65279), ''), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '[\\x{{E000}}-\\x{{F8FF}}]{{2,}}', ' ', 'g') AS line) FROM {BLOCKS} WHERE {t_('line')} <> ''),
h AS (SELECT * REPLACE (regexp_replace(line, '(\\p{{L}}|\\d|_)-\\s+(\\p{{Ll}})', '\\1\\2', 'g') AS line) FROM e), x AS (SELECT *, {t_('line')} AS s FROM h),
a AS MATERIALIZED (SELECT * FROM x WHERE NOT regexp_matches(s, '(?i){C.NAVIGATION}') AND NOT (length(s) BETWEEN 1 AND 199 AND length(regexp_replace(s, '\\P{{L}}', '', 'g')) / length(s) < 0.4)
 AND NOT (length(s) BETWEEN 1 AND 199 AND coalesce(list_sum(list_transform(regexp_extract_all(s, '(?i)https?://\\S+|www\\.\\S+'), lambda x: length(x))), 0) / length(s) > 0.5)
 AND NOT (len(regexp_extract_all(s, 'https?://')) + len(regexp_extract_all(s, 'www\\.')) >= 2 AND length(s) < 160)),
m AS {MARKED.replace('%s', 'a')},
g AS (SELECT * FROM m WHERE NOT (length(s) >= 8 AND (length(regexp_replace(s, '\\P{{L}}', '', 'g')) / length(regexp_replace(s, '\\s', '', 'g')) < 0.6 OR len(regexp_extract_all(s, '[A-Za-zÀ-ÿ]{{2,}}')) = 0
 OR list_sum(list_transform(regexp_extract_all(s, '[A-Za-zÀ-ÿ]{{2,}}'), lambda x: length(x))) / len(regexp_extract_all(s, '[A-Za-zÀ-ÿ]{{2,}}')) > 14))),
k AS (SELECT doc_id, kind, regexp_replace(s, '[ \\t]+', ' ', 'g') AS line, {n("substr(line, 1, 2000)", C.FLAG_WORDS["es"])} > {n("substr(line, 1, 2000)", C.FLAG_WORDS["pt"])} + 2 AND {n("substr(line, 1, 2000)", C.FLAG_WORDS["es"])} > {n("substr(line, 1, 2000)", C.FLAG_WORDS["en"])} + 2 AS es FROM {RANKED % 'g'} WHERE rank <= 3)
SELECT doc_id, count(*) AS lines, sum(length(line))::BIGINT AS chars, count(*) FILTER (kind = 'page_artifact') AS artifacts, count(*) FILTER (es) AS flagged FROM k WHERE line <> '' GROUP BY 1 HAVING sum(length(line)) >= 400""")
def cleaning_pipeline(t):
    """All steps in their fixed order."""
    lines = C.clean_blocks(_blocks(t), "source")
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.char_length("line")).alias("chars"), F.count_if(F.col("kind") == "page_artifact").alias("artifacts"), F.count_if("foreign_text").alias("flagged"))


CHUNKS = f"""WITH RECURSIVE p AS (SELECT doc_id, source, lang, {t_('line')} AS line, pos FROM (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE {t_('line')} <> ''),
c AS (SELECT doc_id, source, lang, pos, i, substr(line, CAST(i * 3000 + 1 AS BIGINT), 3000) AS piece FROM p, LATERAL (SELECT unnest(generate_series(0, (length(line) - 1) // 3000)) AS i)),
k AS (SELECT *, length(piece) AS size, row_number() OVER (PARTITION BY doc_id ORDER BY pos, i) AS idx FROM c),
f AS (SELECT doc_id, idx, 1 AS part, size FROM k WHERE idx = 1 UNION ALL
 SELECT k.doc_id, k.idx, CASE WHEN f.size + 2 + k.size <= 3000 THEN part ELSE part + 1 END, CASE WHEN f.size + 2 + k.size <= 3000 THEN f.size + 2 + k.size ELSE k.size END FROM f JOIN k ON k.doc_id = f.doc_id AND k.idx = f.idx + 1),
g AS (SELECT doc_id, any_value(source) AS source, any_value(lang) AS lang, part, string_agg(piece, chr(10) || chr(10) ORDER BY idx) AS chunk FROM f JOIN k USING (doc_id, idx) GROUP BY doc_id, part),
chunks AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS ordinal, chunk FROM g WHERE length(chunk) >= 300)
"""


@query("ck_01", CHUNKS + "SELECT doc_id, ordinal, greatest(1, CAST(ceil(length(chunk) / 4) AS INT)) AS token_count, sha256(chunk) AS content_hash FROM chunks")
def chunks(t):
    out = C.chunk_documents(t.documents.select("doc_id", "text"), "\n")
    return out.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "token_count", "content_hash")


@query("ck_02", f"SELECT doc_id, pos, length({t_('line')}) AS chars FROM {LINES} WHERE length({t_('line')}) >= 40")
def legacy_chunks(t):
    lines = C.lines_of(t.documents).withColumn("chars", F.char_length(trim(F.col("line"))).cast("long"))
    return lines.where("chars >= 40").select("doc_id", F.col("pos").cast("long").alias("pos"), "chars")


# Scores in SQL, over a column called x.
WORDS_SQL = r"len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> ''))"
LD = f"CASE WHEN {WORDS_SQL} = 0 THEN 0.0 ELSE least(1.0, {n('x', C.LINK)} / greatest({WORDS_SQL} / 20, 1.0)) END"
PARS = f"list_filter(list_transform(string_split(x, chr(10)), lambda p: {t_('p')}), lambda p: p <> '')"
CD = f"(1 - ({LD})) * CASE WHEN len({PARS}) = 0 THEN 0 ELSE len(list_filter({PARS}, lambda p: length(p) >= 80)) / len({PARS}) END * least(1.0, CASE WHEN len({PARS}) = 0 THEN 0 ELSE coalesce(list_sum(list_transform({PARS}, lambda p: length(p))), 0) / len({PARS}) END / 250)"
ED = f"least(1.0, ({n('x', C.DEFINITION)} + {n('x', C.EXAMPLE)} + {n('x', C.RULE)}) * 200 / greatest(length(x), 1))"
SENT = f"list_filter(regexp_split_to_array(x, '[.!?]+'), lambda s: length({t_('s')}) > 20)"
TE = f"CASE WHEN len({SENT}) = 0 THEN 0 ELSE len(list_filter({SENT}, lambda s: NOT regexp_matches(s, '{C.sql_regex(C.HEDGE)}') AND regexp_matches(s, '{C.sql_regex(C.CLAIM)}'))) / len({SENT}) END"
NO = "least(1.0, len(regexp_extract_all(x, '{}')) / greatest(length(x), 1))".format(C.NOISE.replace("'", "''"))
TRIMMED = rf"list_filter(list_transform(regexp_split_to_array(x, '\n+'), lambda p: {t_('p')}), lambda p: p <> '')"


def _meta_sql() -> str:
    of = {k: n("x", p) for k, p in C.META_PATTERNS.items()}
    per = lambda k: f"(CASE WHEN length(x) > 0 THEN {of[k]} * 500 / length(x) ELSE 0 END)"
    flag = lambda c: f"(CASE WHEN {c} THEN 1 ELSE 0 END)"
    shape = f"{of['option']} < 3 AND len({TRIMMED}) >= 5 AND len(list_filter({TRIMMED}, lambda p: length(p) >= 80)) = 0"
    feature = {
        "date": per("date"), "currency": f"(CASE WHEN {of['currency']} > 0 AND ({of['vacancy']} > 0 OR {of['fee']} > 0) THEN {per('currency')} ELSE 0 END)",
        "vacancy": flag(f"{of['vacancy']} > 0"), "imperative": flag(f"{of['imperative']} > 0"), "org": per("org"), "edital": flag(f"{of['edital']} > 0"), "contact": per("contact"),
        "list_shape": flag(shape), "legal": per("legal"), "explain": per("explain"), "question": flag(f"{of['option']} >= 3"),
    }
    return f"1 / (1 + exp(-({C.META_BIAS} + " + " + ".join(f"({w}) * {feature[k]}" for k, w in C.META_WEIGHTS.items()) + ")))"


ME = _meta_sql()
PLANTED = (
    "A regra deve valer sempre. Por exemplo: define-se o caso pela lei 8112 de 1990. Geralmente a norma de 2001 pode ser revista em tese. "
    "O decreto fixa 30% do valor total! Esta frase longa nada afirma sobre o tema? O conceito é o termo que consiste em muito, ou seja, art. 5."
)
TEXTS = f"(SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN ' http://a.b/c edital n 3 taxa R$ 5 vagas em 01/02/2024, o candidato deve' WHEN doc_id % 3 = 1 THEN ' {PLANTED}' ELSE '' END AS x FROM documents)"


def _texts(t):
    extra = F.when(F.col("doc_id") % 3 == 0, " http://a.b/c edital n 3 taxa R$ 5 vagas em 01/02/2024, o candidato deve").when(F.col("doc_id") % 3 == 1, " " + PLANTED).otherwise("")
    return t.documents.select("doc_id", F.concat("text", extra).alias("x"))


SCORES = {
    "sc_01": (LD, C.link_density), "sc_02": (CD, lambda x: C.content_density(x, "\n")), "sc_03": (ED, C.educational_signal), "sc_04": (TE, C.testability),
    "sc_05": (NO, C.noise), "sc_07": (ME, C.metadata_probability),
}
for _name, (_sql, _function) in SCORES.items():
    query(_name, f"SELECT doc_id, round({_sql} + 1e-9, 6)::DOUBLE AS score FROM {TEXTS}")(
        lambda t, f=_function: _texts(t).select("doc_id", F.round(f(F.col("x")).cast("double") + 1e-9, 6).alias("score"))
    )

QUALITY = "CASE WHEN meta > 0.6 THEN 0 ELSE 0.3 * density + 0.3 * edu + 0.2 * test + 0.2 * (1 - noisy) END"


@query("sc_06", f"SELECT doc_id, round({QUALITY} + 1e-9, 6)::DOUBLE AS quality FROM (SELECT doc_id, {CD} AS density, {ED} AS edu, {TE} AS test, {NO} AS noisy, {ME} AS meta FROM {TEXTS})")
def quality(t):
    x = F.col("x")
    scored = _texts(t).select("doc_id", C.content_density(x, "\n").alias("d"), C.educational_signal(x).alias("e"), C.testability(x).alias("t"), C.noise(x).alias("n"), C.metadata_probability(x).alias("m"))
    return scored.select("doc_id", F.round(C.section_quality(*(F.col(c) for c in "detnm")) + 1e-9, 6).alias("quality"))


@query("chunk_eligibility_by_source", CHUNKS + f""", s AS (SELECT doc_id, source, lang, ordinal, chunk AS x, chunk FROM chunks),
v AS (SELECT doc_id, source, lang, length(chunk) AS size, row_number() OVER (PARTITION BY sha256(chunk) ORDER BY doc_id, ordinal) > 1 AS dup, {CD} AS density, {ED} AS edu, {TE} AS test, {NO} AS noisy, {ME} AS meta FROM s),
q AS (SELECT *, {QUALITY} AS quality FROM v),
d AS (SELECT source, CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'language' WHEN noisy > 0.3 THEN 'noise' WHEN meta > 0.35 THEN 'metadata' WHEN quality < 0.45 THEN 'low_quality' WHEN size < 300 OR size > 4000 THEN 'size' WHEN dup THEN 'duplicate' ELSE 'ok' END AS reason FROM q)
SELECT source, CASE WHEN reason = 'ok' THEN 'eligible' ELSE 'ineligible' END AS status, reason, count(*) AS chunks FROM d GROUP BY ALL""")
def chunk_eligibility_by_source(t):
    """Flagship: documents to chunks, scores, exact duplicates, eligibility, counts by source."""
    x = F.col("chunk")
    chunks_ = C.chunk_documents(t.documents.select("doc_id", "source", "lang", "text"), "\n")
    scored = chunks_.select(
        "doc_id", "source", "lang", "ordinal", "content_hash", F.char_length(x).alias("size"), C.content_density(x, "\n").alias("d"), C.educational_signal(x).alias("e"),
        C.testability(x).alias("t"), C.noise(x).alias("n"), C.metadata_probability(x).alias("m"),
    )
    # one narrow row for each chunk, written once and read for the first of equals and for the verdicts
    scored = materialize(scored.withColumn("quality", C.section_quality(*(F.col(c) for c in "detnm"))), "chunks")
    first = scored.groupBy("content_hash").agg(F.min(F.struct("doc_id", "ordinal")).alias("first"))
    scored = scored.join(first, "content_hash")
    duplicate = (F.col("first.doc_id") != F.col("doc_id")) | (F.col("first.ordinal") != F.col("ordinal"))
    verdict = C.eligibility(F.lit("knowledge"), F.lit("content"), F.col("lang"), F.col("n"), F.col("m"), F.col("quality"), F.col("size"), duplicate, None, ("en", "de", "fr"))
    return scored.select("source", verdict.alias("v")).groupBy("source", "v.status", "v.reason").agg(F.count("*").alias("chunks"))


@query("flt_12", f"""SELECT doc_id, CASE WHEN r = 'ok' THEN 'eligible' WHEN r = 'unmapped' THEN 'parked' ELSE 'ineligible' END AS status, r AS reason FROM (
SELECT doc_id, CASE WHEN {ROLE_SQL} NOT IN ('knowledge', 'mixed') THEN 'role' WHEN doc_id % 7 = 0 THEN 'section_role' WHEN lang NOT IN ('en', 'de') THEN 'language' WHEN {NO} > 0.3 THEN 'noise' WHEN doc_id % 17 / 40.0 > 0.35 THEN 'metadata' WHEN (doc_id + 5) % 19 / 20.0 < 0.45 THEN 'low_quality' WHEN n_chars < 300 OR n_chars > 4000 THEN 'size' WHEN first < doc_id THEN 'duplicate'
WHEN doc_id % 13 < 2 OR doc_id % 13 / 13.0 < 0.62 THEN 'unmapped' ELSE 'ok' END AS r FROM (SELECT *, text AS x, min(doc_id) OVER (PARTITION BY text) AS first FROM documents))""")
def eligibility_ladder(t):
    """Every rung of the ladder; duplicates are texts that an earlier document has, and every thirteenth document but one has no mapping or a weak one."""
    k = F.col("doc_id")
    firsts = t.documents.groupBy(F.xxhash64("text").alias("text_key")).agg(F.min("doc_id").alias("first"))
    rows = t.documents.withColumn("text_key", F.xxhash64("text")).join(firsts, "text_key")
    verdict = C.eligibility(
        _role(), F.when(k % 7 == 0, "nav").otherwise("content"), F.col("lang"), C.noise(F.col("text")), k % 17 / 40.0, (k + 5) % 19 / 20.0, F.col("n_chars"),
        F.col("first") < k, F.when(k % 13 >= 2, k % 13 / 13.0), ("en", "de"),
    )
    return rows.select("doc_id", verdict.alias("v")).select("doc_id", "v.status", "v.reason")


NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\p{{N}}', '0', 'g'), '\s+', ' ', 'g'))".format


@query("dd_01", f"SELECT doc_id, sha256({NORM('nfc_normalize(text || chr(101) || chr(769))')}) AS digest FROM documents")
def normalised(t):
    return t.documents.select("doc_id", F.sha2(dedup_normalised(C.nfc(F.concat("text", F.lit("e\u0301")))), 256).alias("digest"))


@query("dd_02", f"""WITH s AS (SELECT item_id, replace({NORM('text')}, ' ', '') AS x FROM benchmark)
SELECT item_id, CASE WHEN length(x) <= 5 THEN 1 ELSE length(x) - 4 END AS shingles, CASE WHEN length(x) <= 5 THEN 1 ELSE len(list_distinct(list_transform(generate_series(1, length(x) - 4), lambda i: substr(x, i, 5)))) END AS distinct_shingles FROM s""")
def shingles(t):
    x = F.replace(dedup_normalised(F.col("text")), F.lit(" "), F.lit(""))
    s = t.benchmark.select("item_id", x.alias("x"))
    grams = F.when(F.char_length("x") <= 5, F.array("x")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length("x") - 4, F.lit(1))), lambda i: F.substring("x", i, F.lit(5))))
    return s.select("item_id", F.size(grams).cast("long").alias("shingles"), F.size(F.array_distinct(grams)).cast("long").alias("distinct_shingles"))


@query("dd_03", """SELECT item_id, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(regexp_replace(text, '[^a-zA-Z ]', '', 'g'), ''), lambda c: ascii(c)::BIGINT)),
lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS fnv FROM benchmark""")
def hashes(t):
    return t.benchmark.select("item_id", fnv1a32(F.regexp_replace("text", "[^a-zA-Z ]", "")).alias("fnv"))


@query("dd_07", "SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS original FROM documents QUALIFY doc_id <> original")
def exact_duplicates(t):
    first = t.documents.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("original"))
    return t.documents.select("doc_id", F.sha2("text", 256).alias("h")).join(first, "h").where("doc_id <> original").select("doc_id", "original")


@query("dd_08", f"SELECT conv_id, turn, substr(sha256(coalesce(role, '') || '|' || {NORM('text')}), 1, 32) AS fingerprint FROM conversations")
def fingerprints(t):
    return t.conversations.select("conv_id", "turn", F.substring(F.sha2(F.concat_ws("|", "role", dedup_normalised(F.col("text"))), 256), 1, 32).alias("fingerprint"))


BAG = r"list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(strip_accents(lower({0})), '[^\x00-\x7F]', 'z', 'g'), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+'), lambda w: w <> '')))".format


def _ratio(p, q):
    return f"CASE WHEN {p} = {q} THEN 100 WHEN length({p}) = 0 OR length({q}) = 0 THEN 0 ELSE CAST(floor((greatest(length({p}), length({q})) - levenshtein({p}, {q})) / greatest(length({p}), length({q})) * 100 + 0.5) AS INT) END"


@query("dd_09", f"""WITH w AS (SELECT item_id, {BAG('text')} AS w FROM benchmark), p AS (SELECT a.item_id, list_filter(a.w, lambda x: list_contains(b.w, x)) AS i, list_filter(a.w, lambda x: NOT list_contains(b.w, x)) AS x, list_filter(b.w, lambda y: NOT list_contains(a.w, y)) AS y FROM w a JOIN w b ON b.item_id = a.item_id + 1),
s AS (SELECT item_id, array_to_string(i, ' ') AS i, array_to_string(list_concat(i, x), ' ') AS x, array_to_string(list_concat(i, y), ' ') AS y FROM p) SELECT item_id, greatest({_ratio('i', 'x')}, {_ratio('i', 'y')}, {_ratio('x', 'y')}) AS ratio FROM s""")
def token_set_ratio(t):
    from millrace.functions.text import fold

    # distances here are of ASCII texts: the SQL side counts bytes
    plain = F.regexp_replace(fold(F.col("text")), r"[^\x00-\x7F]", "z")
    own = t.benchmark.select("item_id", plain.alias("a"))
    after = t.benchmark.select((F.col("item_id") - 1).alias("item_id"), plain.alias("b"))
    return own.join(after, "item_id").select("item_id", C.token_set_ratio(F.col("a"), F.col("b")).alias("ratio"))


@query("jn_13", """WITH q AS (SELECT vec_id AS qid, embedding AS e FROM embeddings WHERE vec_id < 5), s AS (SELECT qid, vec_id, list_cosine_similarity(e::DOUBLE[], embedding::DOUBLE[]) AS c FROM q, embeddings WHERE label <> 3)
SELECT qid, vec_id, round(c, 5) AS cosine FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(c, 9) DESC, vec_id) <= 10""")
def nearest(t):
    """Exact top ten for a fixed list of five queries, which is broadcast; two-step ranks keep partitions even."""
    queries = F.broadcast(t.embeddings.where("vec_id < 5").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("e")))
    scored = t.embeddings.where("label <> 3").crossJoin(queries).select("qid", "vec_id", C.cosine(F.col("e"), F.col("embedding")).alias("c"))
    local = scored.withColumn("part", F.pmod("vec_id", F.lit(64)))
    order = [F.desc(F.round("c", 9)), F.col("vec_id")]
    top = T.first_by(T.first_by(local, ["qid", "part"], order, 10), ["qid"], order, 10)
    return top.select("qid", "vec_id", F.round("c", 5).alias("cosine"))


@query("jn_14", "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)), 5) AS cosine FROM embeddings WHERE vec_id % 6 = 0 AND vec_id < 480")
def score_given_ids(t):
    one = F.broadcast(t.embeddings.where("vec_id = 7").select(F.col("embedding").alias("e")))
    return t.embeddings.where("vec_id % 6 = 0 AND vec_id < 480").crossJoin(one).select("vec_id", F.round(C.cosine(F.col("embedding"), F.col("e")), 5).alias("cosine"))


@query("mp_01", rf"""SELECT word, CASE WHEN length(p) < 4 THEN p ELSE regexp_replace(p, '^(.{{3,}}?)(?:{"|".join(C.SUFFIXES)})$', '\1') END AS stem FROM (SELECT DISTINCT word, regexp_replace(strip_accents(lower(word)), '[^a-z0-9]', '', 'g') AS p FROM (
SELECT unnest(string_split(text, ' ')) AS word FROM documents))""")
def stems(t):
    words = t.documents.select(F.explode(F.split("text", " ")).alias("word")).distinct()
    return words.select("word", C.stem(F.col("word")).alias("stem"))


STEM_SQL = rf"list_filter(list_transform(regexp_split_to_array({{0}}, '\s+'), lambda w: CASE WHEN length(regexp_replace(strip_accents(lower(w)), '[^a-z0-9]', '', 'g')) < 4 THEN regexp_replace(strip_accents(lower(w)), '[^a-z0-9]', '', 'g') ELSE regexp_replace(regexp_replace(strip_accents(lower(w)), '[^a-z0-9]', '', 'g'), '^(.{{{{3,}}}}?)(?:{'|'.join(C.SUFFIXES)})$', '\1') END), lambda x: length(x) > 2 AND x NOT IN ({', '.join(repr(s) for s in C.STOPWORDS)}))".format
LEXICAL = f"""WITH l AS (SELECT item_id, list_distinct({STEM_SQL('text')}) AS terms FROM benchmark), lt AS (SELECT item_id, len(terms) AS n, unnest(terms) AS term FROM l),
c AS (SELECT doc_id, term, least(2, count(*)) AS points FROM (SELECT doc_id, unnest({STEM_SQL('text')}) AS term FROM documents) GROUP BY ALL),
s AS (SELECT doc_id, item_id, sum(points) / n AS score FROM c JOIN lt USING (term) GROUP BY doc_id, item_id, n)
"""


def _lexical(t):
    return C.lexical_scores(t.documents, "doc_id", "text", t.benchmark.withColumnRenamed("text", "leaf"), "item_id", "leaf")


@query("mp_02", LEXICAL + "SELECT doc_id, item_id, round(score, 6) AS score FROM s")
def lexical_score(t):
    return _lexical(t).select("doc_id", "item_id", F.round("score", 6).alias("score"))


@query("wn_05", LEXICAL + "SELECT doc_id, item_id, round(score, 6) AS score FROM s WHERE score >= 0.5 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) <= 5")
def top_five(t):
    return T.first_by(_lexical(t).where("score >= 0.5"), ["doc_id"], [F.desc("score"), F.col("item_id")], 5).select("doc_id", "item_id", F.round("score", 6).alias("score"))


SIMS = """WITH m AS (SELECT label, list(m ORDER BY pos) AS e FROM (SELECT label, pos, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL) GROUP BY 1),
s AS (SELECT vec_id, m.label AS node, round(list_cosine_similarity(embedding::DOUBLE[], m.e), 6) AS score FROM embeddings, m)
"""


def _similarities(t):
    """Cosine of each vector with the centroid of every label; labels are few and fixed."""
    points = t.embeddings.select("label", F.posexplode("embedding").alias("pos", "x"))
    means = points.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    vectors = means.groupBy(F.col("label").alias("node")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s.m).alias("e"))
    return t.embeddings.select("vec_id", "embedding").crossJoin(F.broadcast(vectors)).select("vec_id", "node", F.round(C.cosine(F.col("embedding"), F.col("e")), 6).alias("score"))


@query("wn_04", SIMS + """, h AS (SELECT vec_id, node, round(score / 2 + 0.5, 6) AS score FROM s), r AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS second, first_value(score) OVER w AS top FROM h WINDOW w AS (PARTITION BY vec_id ORDER BY score DESC, node)),
x AS (SELECT vec_id, max(score) FILTER (rn = 1) AS top, max(score) FILTER (rn = 2) AS second FROM r GROUP BY 1)
SELECT r.vec_id, node, score FROM r JOIN x USING (vec_id) WHERE x.top >= 0.62 AND ((x.top - coalesce(x.second, 0) >= 0.05 AND rn = 1) OR (x.second >= 0.62 AND rn <= 2))""")
def margin_accept(t):
    """The first place if clear by a margin, both if the second passes too; scores are put on a scale from 0 to 1."""
    least, margin = 0.62, 0.05
    w = W.partitionBy("vec_id").orderBy(F.desc("score"), "node")
    scores = _similarities(t).withColumn("score", F.round(F.col("score") / 2 + 0.5, 6))
    ranked = scores.withColumns({"rn": F.row_number().over(w), "top": F.first("score").over(w), "next": F.lead("score").over(w)})
    second = F.max(F.when(F.col("rn") == 2, F.col("score"))).over(W.partitionBy("vec_id"))
    ranked = ranked.withColumn("second", second).where(F.col("top") >= least)
    clear = (F.col("top") - F.coalesce("second", F.lit(0.0)) >= margin) & (F.col("rn") == 1)
    return ranked.where(clear | ((F.col("second") >= least) & (F.col("rn") <= 2))).select("vec_id", "node", "score")


@query("wn_06", SIMS + """, u AS (SELECT vec_id, node, score, 'embedding' AS method FROM s WHERE score >= 0.2 UNION ALL SELECT vec_id, node, score / 2 + 0.5, 'lexical' FROM s WHERE node % 2 = 0 UNION ALL SELECT vec_id, node, 0.6, 'llm' FROM s WHERE vec_id % 10 = 1 AND node = 1)
SELECT vec_id, node, method FROM u QUALIFY row_number() OVER (PARTITION BY vec_id, node ORDER BY CASE method WHEN 'llm' THEN 3 WHEN 'embedding' THEN 2 ELSE 1 END DESC, score DESC) = 1""")
def best_method(t):
    s = _similarities(t)
    parts = s.where("score >= 0.2").withColumn("method", F.lit("embedding"))
    parts = parts.unionByName(s.where("node % 2 = 0").withColumn("score", F.col("score") / 2 + 0.5).withColumn("method", F.lit("lexical")))
    parts = parts.unionByName(s.where("vec_id % 10 = 1 AND node = 1").withColumn("score", F.lit(0.6)).withColumn("method", F.lit("llm")))
    rank = F.when(F.col("method") == "llm", 3).when(F.col("method") == "embedding", 2).otherwise(1)
    return T.first_by(parts, ["vec_id", "node"], [rank.desc(), F.desc("score")]).select("vec_id", "node", "method")


@query("mp_03", SIMS + "SELECT vec_id, node, (0.5 * score + 0.5 * (node % 3) / 2)::DOUBLE AS combined FROM s WHERE 0.5 * score + 0.5 * (node % 3) / 2 >= 0.45")
def combined_map(t):
    both = 0.5 * F.col("score") + 0.5 * (F.col("node") % 3) / 2
    return _similarities(t).withColumn("combined", both).where("combined >= 0.45").select("vec_id", "node", "combined")


@query("mp_06", SIMS + "SELECT vec_id, node FROM s WHERE score >= 0.1 AND score < 0.5 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, node) <= 8")
def ambiguous_band(t):
    return T.first_by(_similarities(t).where("score >= 0.1 AND score < 0.5"), ["vec_id"], [F.desc("score"), F.col("node")], 8).select("vec_id", "node")


@query("cf_05", SIMS + """, r AS (SELECT vec_id, max(score) AS top, arg_max(node, (score, -node)) AS node, list_sort(list(score), 'DESC')[2] AS second FROM s GROUP BY 1)
SELECT vec_id, node, round(least(0.85, 0.55 + top - second), 6) AS confidence FROM r WHERE top - second >= 0.08""")
def nearest_centroid(t):
    w = W.partitionBy("vec_id").orderBy(F.desc("score"), "node")
    top = _similarities(t).withColumns({"rn": F.row_number().over(w), "second": F.lead("score").over(w)}).where("rn = 1")
    margin = F.col("score") - F.col("second")
    return top.where(margin >= 0.08).select("vec_id", "node", F.round(F.least(F.lit(0.85), 0.55 + margin), 6).alias("confidence"))


@query("mp_04", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine(t):
    after = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e"))
    return t.embeddings.select("vec_id", "embedding").join(after, "vec_id").select("vec_id", F.round(C.cosine(F.col("embedding"), F.col("e")), 5).alias("cosine"))


@query("mp_07", "SELECT p_partkey, p_brand || ' — ' || coalesce(nullif(split_part(p_type, ' ', 2), ''), p_name) || ' — ' || p_name AS text FROM part")
def leaf_text(t):
    parts = F.split("p_type", " ")
    middle = F.coalesce(F.when(F.size(parts) > 1, F.get(parts, F.lit(1))), F.col("p_name"))
    return t.part.select("p_partkey", F.concat_ws(" — ", "p_brand", middle, "p_name").alias("text"))


@query("em_01", "SELECT vec_id FROM embeddings WHERE label IN (0, 1, 2) AND vec_id % 4 <> 0 ORDER BY vec_id LIMIT 200")
def embedding_queue(t):
    return t.embeddings.where(F.col("label").isin(0, 1, 2) & (F.col("vec_id") % 4 != 0)).orderBy("vec_id").limit(200).select("vec_id")


@query("em_02", "SELECT vec_id, len(embedding) AS dims FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0 AND label <> 4")
def guarded_vectors(t):
    finite = F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return t.embeddings.where((F.size("embedding") == 64) & finite & (F.col("label") != 4)).select("vec_id", F.size("embedding").cast("long").alias("dims"))


GATE_INPUT = "(SELECT doc_id, doc_id % 17 <> 0 AS structural, doc_id % 13 <> 0 AS relevant, doc_id % 19 <> 0 AS grounded, CASE WHEN doc_id % 10 > 0 THEN round((doc_id % 97) / 96.0, 4) END AS judge, doc_id % 4 AS answer, CASE WHEN doc_id % 23 = 0 THEN 1 ELSE doc_id % 4 END AS keyed, (doc_id % 7 + 2) / 8.0 AS durability, quality / 1.0 + 0.5 * toxic AS relevance, (doc_id % 5 + 2) / 6.0 AS grounding, CASE WHEN doc_id % 20 = 0 THEN 'extraction' ELSE 'generated' END AS origin FROM labels)"


@query("gt_01", f"""SELECT doc_id, CASE WHEN NOT structural OR NOT relevant OR NOT grounded THEN 'failed' WHEN judge IS NULL AND origin = 'extraction' THEN 'published' WHEN judge IS NULL THEN 'needs_review' WHEN answer <> keyed OR durability < 0.5 OR relevance < 0.5 THEN 'failed'
WHEN grounding < 0.5 THEN 'needs_review' WHEN judge >= 0.8 THEN 'published' WHEN judge < 0.5 THEN 'failed' ELSE 'needs_review' END AS decision,
CASE WHEN NOT structural THEN 'structural' WHEN NOT relevant THEN 'relevance' WHEN NOT grounded THEN 'grounding' WHEN judge IS NULL AND origin = 'extraction' THEN 'extraction_without_judge' WHEN judge IS NULL THEN 'judge_unavailable' WHEN answer <> keyed THEN 'judge_answer_mismatch'
WHEN durability < 0.5 THEN 'judge_low_durability' WHEN relevance < 0.5 THEN 'judge_low_relevance' WHEN grounding < 0.5 THEN 'judge_low_grounding' WHEN judge >= 0.8 THEN 'ok' WHEN judge < 0.5 THEN 'judge_score_below_floor' ELSE 'judge_score_borderline' END AS reason FROM {GATE_INPUT}""")
def gate(t):
    k = F.col("doc_id")
    judge = F.when(k % 10 > 0, F.round((k % 97) / 96.0, 4))
    verdict = C.publish_gate(
        k % 17 != 0, k % 13 != 0, k % 19 != 0, judge, k % 4, F.when(k % 23 == 0, 1).otherwise(k % 4), (k % 7 + 2) / 8.0, F.col("quality") + 0.5 * F.col("toxic"),
        (k % 5 + 2) / 6.0, F.when(k % 20 == 0, "extraction").otherwise("generated"),
    )
    return t.labels.select("doc_id", verdict.alias("v")).select("doc_id", "v.decision", "v.reason")


@query("pr_01", """SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN 'administrative' WHEN regexp_matches(text, '!!') THEN 'terminal_failure' WHEN n_chars < 200 THEN 'no_usable_content' END AS reason FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1) AND reason IS NOT NULL""")
def prune(t):
    reason = F.when(F.col("source").isin("src1", "src2"), "administrative").when(F.col("text").contains("!!"), "terminal_failure").when(F.col("n_chars") < 200, "no_usable_content")
    return t.documents.select("doc_id", reason.alias("reason")).where("reason IS NOT NULL").join(t.labels.where("quality = 1"), "doc_id", "left_anti")


@query("pr_02", "SELECT sha256(text) AS key FROM documents LEFT JOIN labels USING (doc_id) GROUP BY text HAVING bool_and(coalesce(quality, 0) = 0) AND max(doc_id) < 900")
def purge(t):
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("key")).join(t.labels, "doc_id", "left")
    out = d.groupBy("key").agg(F.bool_and(F.coalesce("quality", F.lit(0)) == 0).alias("free"), F.max("doc_id").alias("last"))
    return out.where("free AND last < 900").select("key")


@query("st_03", rf"SELECT doc_id, pos, regexp_replace(regexp_replace('- ' || line, '^\s*(?:[-*•]|\d+[.)]|[a-zA-Z][)])\s+', ''), '\s+$', '') AS line FROM {LINES}")
def list_markers(t):
    marked = C.lines_of(t.documents)
    plain = F.regexp_replace(F.regexp_replace(F.concat(F.lit("- "), "line"), r"^\s*(?:[-*•]|\d+[.)]|[a-zA-Z][)])\s+", ""), r"\s+$", "")
    return marked.select("doc_id", F.col("pos").cast("long").alias("pos"), plain.alias("line"))
