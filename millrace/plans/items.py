"""Items, keys, hints, fingerprints, leaders and nested reads (FLT-13.., EV-*, CF-*, DD-*, WN-*, CR-*)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators import curation as C
from millrace.operators import items as I
from millrace.operators import likeness as L
from millrace.plans import Catalog
from millrace.plans.curation import LINES, NORM
from millrace.workspace import materialize

catalog = Catalog()
query = catalog.query

BLOB = "text || CASE doc_id % 9 WHEN 0 THEN ' retificação' WHEN 1 THEN ' edital 3' WHEN 2 THEN ' conteúdo programático' WHEN 3 THEN ' gabarito' WHEN 4 THEN ' padrão de respostas' WHEN 5 THEN ' prova azul' WHEN 6 THEN ' apostila' WHEN 7 THEN ' lei 8' ELSE '' END"


def _blob(t):
    words = F.array(*[F.lit(x) for x in (" retificação", " edital 3", " conteúdo programático", " gabarito", " padrão de respostas", " prova azul", " apostila", " lei 8", "")])
    return t.documents.select("doc_id", F.concat("text", F.element_at(words, (F.col("doc_id") % 9 + 1).cast("int"))).alias("blob"))


@query("cf_07", f"SELECT doc_id, CASE {' '.join(f'''WHEN regexp_matches(blob, '{C.sql_regex(p)}') THEN '{k}' ''' for k, _, p in I.HINTS)} ELSE 'unknown' END AS kind FROM (SELECT doc_id, {BLOB} AS blob FROM documents)")
def hints(t):
    return _blob(t).select("doc_id", I.document_hint(F.col("blob"))[0].alias("kind"))


KEY_TEXT = "'1 - A; 2) ' || chr(CAST(65 + doc_id % 5 AS INT)) || ', 3 anulada 4. c 1 b, 5 (D) ' || doc_id % 50 || ' E'"


@query("ev_01", f"""WITH x AS (SELECT doc_id, {KEY_TEXT} AS t FROM documents), m AS (SELECT doc_id, unnest(regexp_extract_all(t, '(?i)(?:^|[\\n;,\\s])(\\d{{1,3}})\\s*[-.):]?\\s*(?:\\*|anulad\\w*)', 1)) AS num, 'annulled' AS answer, 0 AS part, 0 AS pos FROM x
UNION ALL SELECT doc_id, unnest(regexp_extract_all(replace(t, ' ', '  '), '(?:^|[\\n;,\\s])(\\d{{1,3}})\\s*[-.):]?\\s*\\(?([A-Ea-e])\\)?(?:[\\s,;]|$)', 1)), unnest(list_transform(regexp_extract_all(replace(t, ' ', '  '), '(?:^|[\\n;,\\s])(\\d{{1,3}})\\s*[-.):]?\\s*\\(?([A-Ea-e])\\)?(?:[\\s,;]|$)', 2), lambda s: lower(s))), 1, unnest(generate_series(1, len(regexp_extract_all(replace(t, ' ', '  '), '(?:^|[\\n;,\\s])(\\d{{1,3}})\\s*[-.):]?\\s*\\(?([A-Ea-e])\\)?(?:[\\s,;]|$)', 1)))) FROM x)
SELECT doc_id, num::INT AS number, answer FROM m WHERE num::INT >= 1 QUALIFY row_number() OVER (PARTITION BY doc_id, num::INT ORDER BY part, pos) = 1""")
def answer_keys(t):
    text = F.concat(F.lit("1 - A; 2) "), F.char((F.lit(65) + F.col("doc_id") % 5).cast("int")), F.lit(", 3 anulada 4. c 1 b, 5 (D) "), (F.col("doc_id") % 50).cast("string"), F.lit(" E"))
    return t.documents.select("doc_id", text.alias("t")).select("doc_id", F.inline(I.answer_key(F.col("t"))))


@query("va_02", "SELECT vec_id, abs(a + b + c - 1) <= 1e-3 AND a BETWEEN 0 AND 1 AND b BETWEEN 0 AND 1 AND c BETWEEN 0 AND 1 AS ok FROM (SELECT vec_id, (vec_id % 7) / 10.0 AS a, (vec_id % 5) / 10.0 AS b, CASE WHEN vec_id % 3 = 0 THEN 0.5 ELSE 1 - (vec_id % 7) / 10.0 - (vec_id % 5) / 10.0 END AS c FROM embeddings)")
def distributions(t):
    k = F.col("vec_id")
    a, b = (k % 7) / 10.0, (k % 5) / 10.0
    c = F.when(k % 3 == 0, 0.5).otherwise(1 - (k % 7) / 10.0 - (k % 5) / 10.0)
    return t.embeddings.select("vec_id", I.distribution_ok(F.create_map(F.lit("a"), a, F.lit("b"), b, F.lit("c"), F.round(c, 9)), ["a", "b", "c"]).alias("ok"))


@query("va_03", r"SELECT event_id, json_extract_string(j, '$.k') AS k FROM (SELECT event_id, regexp_extract('noise ' || props || ' tail', '(?s)\{.*\}') AS j FROM events)")
def json_in_text(t):
    body = F.regexp_extract(F.concat(F.lit("noise "), "props", F.lit(" tail")), r"(?s)\{.*\}", 0)
    return t.events.select("event_id", F.get_json_object(body, "$.k").alias("k"))


@query("gd_03", "SELECT m AS minutes, CASE m WHEN 15 THEN 4 WHEN 20 THEN 5 WHEN 30 THEN 8 WHEN 45 THEN 10 WHEN 60 THEN 12 WHEN 90 THEN 15 ELSE 3 END AS least, CASE m WHEN 15 THEN 8 WHEN 20 THEN 10 WHEN 30 THEN 12 WHEN 45 THEN 16 WHEN 60 THEN 20 WHEN 90 THEN 25 ELSE 6 END AS most FROM (SELECT DISTINCT p_size * 5 AS m FROM part)")
def session_budgets(t):
    minutes = t.part.select((F.col("p_size") * 5).alias("minutes")).distinct()
    return minutes.select("minutes", I.session_budget(F.col("minutes")).alias("b")).select("minutes", "b.least", "b.most")


@query("dd_04", f"""WITH s AS (SELECT item_id, replace({NORM('text')}, ' ', '') AS x FROM benchmark), g AS (SELECT item_id, unnest(CASE WHEN length(x) <= 5 THEN [x] ELSE list_transform(generate_series(1, length(x) - 4), lambda i: substr(x, i, 5)) END) AS g FROM s),
d AS (SELECT DISTINCT g FROM g), h AS (SELECT g, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(g, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS lo,
 list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(':' || g || ':', ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS hi FROM d),
v AS (SELECT item_id, b, sum(CASE WHEN ((CASE WHEN b < 32 THEN lo ELSE hi END) >> (b % 32)) & 1 = 1 THEN 1 ELSE -1 END) AS v FROM g JOIN h USING (g), (SELECT unnest(generate_series(0, 63)) AS b) GROUP BY ALL)
SELECT item_id, count(*) FILTER (v > 0) AS bits, string_agg(CASE WHEN v > 0 THEN '1' ELSE '0' END, '' ORDER BY b DESC) AS simhash FROM v GROUP BY 1""")
def simhashes(t):
    prints = L.simhash64(t.benchmark, "item_id", "text")
    return prints.select("item_id", F.bit_count("simhash").cast("long").alias("bits"), F.lpad(F.bin("simhash"), 64, "0").alias("simhash"))


BIT_SUMS = ", ".join(f"sum(CASE WHEN ({'lo' if b < 32 else 'hi'} >> {b % 32}) & 1 = 1 THEN 1 ELSE -1 END) AS b{b}" for b in range(64))
PRINT = " | ".join(f"CASE WHEN b{b} > 0 THEN {1 << b}::UBIGINT ELSE 0::UBIGINT END" for b in range(64))


@query("dd_04_pairs", f"""WITH s AS (SELECT doc_id, replace({NORM('text')}, ' ', '') AS x FROM documents), g AS (SELECT doc_id, unnest(CASE WHEN x = '' THEN [] WHEN length(x) <= 5 THEN [x] ELSE list_transform(generate_series(1, length(x) - 4), lambda i: substr(x, i, 5)) END) AS g FROM s),
d AS (SELECT DISTINCT g FROM g), h AS (SELECT g, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(g, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS lo,
 list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(':' || g || ':', ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS hi FROM d),
v AS (SELECT doc_id, {BIT_SUMS} FROM g JOIN h USING (g) GROUP BY 1), p AS (SELECT doc_id, coalesce({PRINT}, 0::UBIGINT) AS p FROM s LEFT JOIN v USING (doc_id)), f AS (SELECT p, min(doc_id) AS doc_id FROM p GROUP BY 1)
SELECT a.doc_id, b.doc_id AS other, bit_count(xor(a.p, b.p))::INT AS bits FROM f a, f b WHERE a.doc_id < b.doc_id AND bit_count(xor(a.p, b.p)) <= 3
UNION ALL SELECT f.doc_id, p.doc_id, 0 FROM p JOIN f USING (p) WHERE p.doc_id <> f.doc_id""")
def simhash_near(t):
    """All documents within three bits of each other: first documents of each print in pairs, and every other with the first of its print."""
    return L.simhash_pairs(materialize(L.simhash64(t.documents, "doc_id", "text"), "prints"), "doc_id")


@query("jn_15")
def minhash_near(t):
    """All documents of a likeness of 0.85 and more by 128 minhashes: first documents of each signature in pairs, and every other with the first of its signature. Tested against all pairs."""
    return L.near_texts(t.documents, "doc_id", "text")


@query("dd_05", f"""WITH w AS (SELECT item_id, list_distinct(list_filter(string_split({NORM('text')}, ' '), lambda x: x <> '')) AS w FROM benchmark), s AS (SELECT unnest(generate_series(0, 127)) AS seed),
h AS (SELECT item_id, seed, min(list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(seed || ':' || x, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)) AS h FROM (SELECT item_id, unnest(w) AS x FROM w), s GROUP BY ALL)
SELECT a.item_id, b.item_id AS other, count(*) FILTER (a.h = b.h) / 128 AS likeness FROM h a JOIN h b ON b.seed = a.seed AND b.item_id = a.item_id + 1 GROUP BY ALL""")
def minhash_estimates(t):
    """Estimated likeness of each benchmark item to the next, from 128 minhashes of words."""
    plain = t.benchmark.select("item_id", L.dedup_normalised(F.col("text")).alias("norm"))
    signs = L.minhash_signatures(plain, "item_id", "norm")
    other = signs.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("other"), F.col("signature").alias("theirs"))
    return signs.join(other, "item_id").select("item_id", "other", L.minhash_likeness(F.col("signature"), F.col("theirs")).alias("likeness"))


@query("dd_06")
def chunk_leaders(t):
    return L.greedy_leaders(C.chunk_documents(t.documents.select("doc_id", "text"), "\n", 800, 100))


@query("wn_19", f"""WITH k AS (SELECT doc_id, pos, line FROM {LINES} WHERE length(line) > 20), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM k) SELECT doc_id, count(*) AS sections, substr(string_agg(line, ' ' ORDER BY pos) FILTER (rn <= 2), 1, 600) AS preview FROM r WHERE rn <= 200 GROUP BY 1""")
def document_detail(t):
    lines = C.lines_of(t.documents).where(F.char_length("line") > 20)
    ranked = lines.withColumn("rn", F.row_number().over(W.partitionBy("doc_id").orderBy("pos"))).where("rn <= 200")
    head = F.transform(F.sort_array(F.collect_list(F.when(F.col("rn") <= 2, F.struct("pos", "line")))), lambda x: x.line)
    return ranked.groupBy("doc_id").agg(F.count("*").alias("sections"), F.substring(F.array_join(head, " "), 1, 600).alias("preview"))


@query("wn_12", "WITH o AS (SELECT o_orderkey, o_totalprice, o_orderstatus = 'P' AS open, count(*) FILTER (o_orderstatus = 'P') OVER () AS n FROM orders) SELECT o_orderkey FROM o WHERE open OR n = 0 ORDER BY o_totalprice DESC, o_orderkey LIMIT 30")
def open_window_fallback(t):
    """The open ones if there are any, else all: one count, broadcast."""
    rows = t.orders
    n = rows.agg(F.count_if(F.col("o_orderstatus") == "P").alias("n"))
    both = rows.crossJoin(F.broadcast(n)).where((F.col("o_orderstatus") == "P") | (F.col("n") == 0))
    return both.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(30).select("o_orderkey")


@query("flt_26", "WITH d AS (SELECT doc_id, list_distinct(list_transform(list_filter(string_split(lower(text), ' '), lambda w: length(w) >= 5), lambda w: substr(w, 1, 6))) AS p FROM documents), b AS (SELECT item_id, list_distinct(list_transform(list_filter(string_split(lower(text), ' '), lambda w: length(w) >= 5), lambda w: substr(w, 1, 6))) AS p FROM benchmark) SELECT doc_id, item_id FROM d, b WHERE list_has_any(d.p, b.p)")
def mentions(t):
    """Shared beginnings of words, by an equi join on them."""
    parts = lambda df, k: df.select(k, F.explode(F.array_distinct(F.transform(F.filter(F.split(F.lower("text"), " "), lambda w: F.char_length(w) >= 5), lambda w: F.substring(w, 1, 6)))).alias("p"))
    return parts(t.documents, "doc_id").join(parts(t.benchmark, "item_id"), "p").select("doc_id", "item_id").distinct()


@query("sy_07", "SELECT n_nationkey, n_name, coalesce(s, 0) AS units FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey WHERE n_nationkey NOT IN (SELECT n_regionkey FROM nation)")
def active_leaves(t):
    units = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("units"))
    leaves = t.nation.join(t.nation.select(F.col("n_regionkey").alias("n_nationkey")).distinct(), "n_nationkey", "left_anti")
    return leaves.select("n_nationkey", "n_name").join(units, "n_nationkey", "left").na.fill(0)


@query("sy_08", "SELECT p_brand AS key, arg_min(p_name, p_partkey) AS title FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_partkey < 3) GROUP BY 1")
def canonical_backfill(t):
    known = t.part.where("p_partkey < 3").select("p_brand").distinct()
    return t.part.join(known, "p_brand", "left_anti").groupBy(F.col("p_brand").alias("key")).agg(F.min_by("p_name", "p_partkey").alias("title"))


@query("str_16", "SELECT user_id, least(n, 3) AS attempts, last < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 24 HOUR AND n < 3 AS again FROM (SELECT user_id, count(*) FILTER (event_type = 'error') AS n, max(ts) AS last FROM events GROUP BY 1)")
def triage(t):
    e = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("n"), F.max("ts").alias("last"))
    due = F.col("last") < F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00' - INTERVAL 24 HOUR")
    return e.select("user_id", F.least(F.col("n"), F.lit(3)).alias("attempts"), (due & (F.col("n") < 3)).alias("again"))
