"""Searches for thin leaves over several passes, and study focus (STR-11, AG-11)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators import planning as P
from millrace.plans import Catalog
from millrace.plans.syllabus import SLUG
from millrace.workspace import materialize

catalog = Catalog()
query = catalog.query

#: Days of the passes; a search is over a day after its pass, unless it goes on for good.
PASSES = (0, 3, 8, 30)
START = "2024-01-01 00:00:00"
LEAVES = """SELECT p_partkey AS leaf, p_brand AS syllabus, substr(p_brand, 7)::INT AS rank, p_size % 15 AS units, CASE WHEN p_partkey % 7 > 0 THEN p_partkey % 7 END AS questions, p_size % 4 / 2.0 AS weight, p_partkey % 3 + 1 AS depth, p_partkey AS ordinal,
[lower(p_type) || '-geral', p_name, CASE WHEN p_partkey % 2 = 0 THEN 'parte-' || p_partkey ELSE '' END] AS path, p_name AS title FROM part"""


def _leaves(t):
    c = F.col
    path = F.array(F.concat(F.lower("p_type"), F.lit("-geral")), c("p_name"), F.when(c("p_partkey") % 2 == 0, F.concat(F.lit("parte-"), c("p_partkey").cast("string"))).otherwise(""))
    return t.part.select(
        c("p_partkey").alias("leaf"), c("p_brand").alias("syllabus"), F.substring("p_brand", 7, 9).cast("int").alias("syllabus_rank"), (c("p_size") % 15).alias("units"), F.when(c("p_partkey") % 7 > 0, c("p_partkey") % 7).alias("questions"),
        (c("p_size") % 4 / 2.0).alias("weight"), (c("p_partkey") % 3 + 1).alias("depth"), c("p_partkey").alias("ordinal"), path.alias("path"), c("p_name").alias("title"),
    )


def _pass_sql(k: int) -> str:
    """Leaves of pass k, after what the passes before it started."""
    before = " UNION ALL ".join(f"SELECT leaf, {d} AS day, {i} AS attempts FROM pass{i}" for i, d in enumerate(PASSES[:k])) or "SELECT NULL::BIGINT AS leaf, 0 AS day, 0 AS attempts WHERE false"
    day = PASSES[k]
    # a search of the same day or one that goes on is under way; else the last one that is over counts
    return f"""state{k} AS (SELECT leaf, bool_or(leaf % 5 = 0 OR day + 1 > {day}) AS busy, arg_max(attempts, day) FILTER (leaf % 5 <> 0 AND day + 1 <= {day}) AS attempts, max(day + 1) FILTER (leaf % 5 <> 0 AND day + 1 <= {day}) AS ended FROM ({before}) GROUP BY 1),
pass{k} AS (SELECT g.* FROM gaps g LEFT JOIN state{k} s USING (leaf) WHERE NOT coalesce(busy OR (leaf % 3 = 0 AND ended IS NOT NULL AND {day} < ended + [7, 14, 28, 56][attempts + 1]), false) ORDER BY turn, rank LIMIT {P.MOST_SEARCHES})"""


_TEXTS = "list_transform([s || ' ' || t || ' explicação', u || ' regra norma-padrão', s || ' ' || t || ' lei artigo'], lambda x: x)"


@query("str_11", f"""WITH leaves AS ({LEAVES}), g AS (SELECT *, row_number() OVER (PARTITION BY syllabus ORDER BY units, coalesce(questions, 1) * weight DESC, depth DESC, ordinal) AS turn FROM leaves WHERE units < {P.TARGET_UNITS}),
gaps AS (SELECT * FROM g ORDER BY turn, rank LIMIT {P.CANDIDATES}), {', '.join(map(_pass_sql, range(len(PASSES))))},
started AS ({' UNION ALL '.join(f'SELECT {k} AS pass, leaf, path, title FROM pass{k}' for k in range(len(PASSES)))}),
named AS (SELECT *, replace(path[1], '-', ' ') AS s, path[2] AS t, CASE WHEN path[3] <> '' THEN replace(path[3], '-', ' ') ELSE path[2] END AS u FROM started)
SELECT pass, leaf, array_to_string({_TEXTS}, '|') AS texts FROM named""")
def planner_passes(t):
    """Four passes; each sees the searches of those before it. Every third leaf's searches find nothing, every fifth's never end."""
    gaps = materialize(P.knowledge_gaps(_leaves(t)).select("leaf", "turn", "syllabus_rank", "path", "title"), "gaps")
    searches = t.spark.createDataFrame([], "leaf long, status string, stored int, finished timestamp_ntz, attempts int, started int")
    out = None
    for k, day in enumerate(PASSES):
        now = F.to_timestamp_ntz(F.lit(START)) + F.make_dt_interval(F.lit(day))
        goes_on = (F.col("leaf") % 5 == 0) | (F.col("started") + 1 > day)
        ended = F.to_timestamp_ntz(F.lit(START)) + F.make_dt_interval(F.col("started") + 1)
        seen = searches.withColumn("status", F.when(goes_on, "running").otherwise("done")).withColumn("finished", F.when(~goes_on, ended))
        new = materialize(P.planner_pass(gaps, seen, now), "pass")
        found = new.select("leaf", F.lit("queued").alias("status"), (F.col("leaf") % 3).cast("int").alias("stored"), F.lit(None).cast("timestamp_ntz").alias("finished"), F.lit(k).alias("attempts"), F.lit(day).alias("started"))
        searches = searches.unionByName(found)
        told = new.select(F.lit(k).alias("pass"), "leaf", F.array_join("texts", "|").alias("texts"))
        out = told if out is None else out.unionByName(told)
    return out


#: Exams are brands: subjects by type (every other exam names posts in capitals), topics by part, two positions, items by size.
TYPE_TITLE = "CASE WHEN e % 2 = 0 AND p_type IN ('SMALL', 'LARGE') THEN 'ANALISTA ' || p_type WHEN p_type = 'PROMO' THEN 'Promo e outros temas' WHEN p_type = 'ECONOMY' THEN 'geral' ELSE 'Estudo ' || lower(p_type) END"
FOCUS = f"""heads AS (SELECT DISTINCT p_brand AS exam, 'h-' || p_type AS node, NULL::VARCHAR AS parent, 0 AS depth, {TYPE_TITLE} AS title, CASE WHEN p_type IN ('SMALL', 'MEDIUM') THEN ['one'] ELSE [] END AS positions, p_type AS place FROM (SELECT *, substr(p_brand, 7)::INT AS e FROM part)),
topics AS (SELECT p_brand AS exam, 't-' || p_partkey AS node, CASE WHEN p_partkey % 4 = 0 THEN 't-' || (SELECT min(q.p_partkey) FROM part q WHERE q.p_brand = part.p_brand AND q.p_type = part.p_type AND q.p_partkey % 4 <> 0) ELSE 'h-' || p_type END AS parent, CASE WHEN p_partkey % 4 = 0 THEN 2 ELSE 1 END AS depth, p_name AS title, CASE WHEN p_partkey % 5 = 0 THEN ['one', 'two'] WHEN p_partkey % 5 = 1 THEN ['two'] ELSE [] END AS positions, lpad(p_partkey::VARCHAR, 12, '0') AS place FROM part),
nodes AS (SELECT * FROM heads UNION ALL SELECT * FROM topics), by_node AS (SELECT p_brand AS exam, 't-' || p_partkey AS node, p_size % 3 AS n FROM part WHERE p_size % 2 = 0),
positions AS (SELECT DISTINCT p_brand AS exam, unnest(['one', 'two']) AS position, substr(p_brand, 7)::INT % 3 = 0 AS implicit FROM part), named_positions AS (SELECT *, 'Cargo ' || position AS title, 'cargo-' || position AS slug FROM positions),
by_position AS (SELECT p_brand AS exam, 'one' AS position, count(*) AS n FROM part WHERE substr(p_brand, 7)::INT % 4 = 1 AND p_size > 40 GROUP BY 1),
by_subject AS (SELECT p_brand AS exam, CASE WHEN p_size % 2 = 0 THEN 'estudo-' || lower(p_type) ELSE CASE p_size % 5 WHEN 0 THEN 'cargo-one' WHEN 1 THEN ' tema-' || p_size || ' ' WHEN 2 THEN 'geral' WHEN 3 THEN 'analista-' || lower(p_type) ELSE 'promo-e-outros-temas' END END AS slug, CASE p_size % 7 WHEN 0 THEN 'TEMA ÚNICO' WHEN 1 THEN 'tema-' || p_size WHEN 2 THEN '' ELSE 'Tema ' || p_size END AS subject, p_size % 6 + 1 AS n, p_partkey AS place FROM part)"""
POST = lambda x: f"(length(regexp_replace({x}, '[^A-Za-zÀ-ÿ]', '', 'g')) >= 6 AND length(regexp_replace(regexp_replace({x}, '[^A-Za-zÀ-ÿ]', '', 'g'), '[^A-ZÀ-Ý]', '', 'g')) >= 0.85 * length(regexp_replace({x}, '[^A-Za-zÀ-ÿ]', '', 'g')))"
SUBJECT_SLUG = lambda x: f"replace({SLUG(x)}, 'unknown', 'geral')"


def _focus(t):
    c = F.col
    parts = t.part.withColumn("e", F.substring("p_brand", 7, 9).cast("int"))
    key, lower = c("p_partkey").cast("string"), F.lower("p_type")
    text = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    title = F.when((c("e") % 2 == 0) & c("p_type").isin("SMALL", "LARGE"), F.concat(F.lit("ANALISTA "), "p_type")).when(c("p_type") == "PROMO", "Promo e outros temas").when(c("p_type") == "ECONOMY", "geral").otherwise(F.concat(F.lit("Estudo "), lower))
    heads = parts.select(c("p_brand").alias("exam"), F.concat(F.lit("h-"), "p_type").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), title.alias("title"), F.when(c("p_type").isin("SMALL", "MEDIUM"), text("one")).otherwise(text()).alias("positions"), c("p_type").alias("place")).distinct()
    firsts = parts.where("p_partkey % 4 <> 0").groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("first"))
    under = F.when(c("p_partkey") % 4 == 0, F.concat(F.lit("t-"), c("first").cast("string"))).otherwise(F.concat(F.lit("h-"), "p_type"))
    applies = F.when(c("p_partkey") % 5 == 0, text("one", "two")).when(c("p_partkey") % 5 == 1, text("two")).otherwise(text())
    topics = parts.join(firsts, ["p_brand", "p_type"], "left").select(c("p_brand").alias("exam"), F.concat(F.lit("t-"), key).alias("node"), under.alias("parent"), F.when(c("p_partkey") % 4 == 0, 2).otherwise(1).alias("depth"), c("p_name").alias("title"), applies.alias("positions"), F.lpad(key, 12, "0").alias("place"))
    # places of heads and topics are only compared among each other
    nodes = heads.unionByName(topics).withColumn("place", F.rank().over(W.partitionBy("exam").orderBy("place")))
    by_node = parts.where("p_size % 2 = 0").select(c("p_brand").alias("exam"), F.concat(F.lit("t-"), key).alias("node"), (c("p_size") % 3).alias("n"))
    positions = parts.select(c("p_brand").alias("exam"), (c("e") % 3 == 0).alias("implicit")).distinct().withColumn("position", F.explode(text("one", "two"))).withColumns({"title": F.concat(F.lit("Cargo "), "position"), "slug": F.concat(F.lit("cargo-"), "position")})
    by_position = parts.where("e % 4 = 1 AND p_size > 40").groupBy(c("p_brand").alias("exam")).agg(F.count("*").alias("n")).withColumn("position", F.lit("one"))
    five, size = c("p_size") % 5, c("p_size").cast("string")
    odd = F.when(five == 0, "cargo-one").when(five == 1, F.concat(F.lit(" tema-"), size, F.lit(" "))).when(five == 2, "geral").when(five == 3, F.concat(F.lit("analista-"), lower)).otherwise("promo-e-outros-temas")
    seven = c("p_size") % 7
    subject = F.when(seven == 0, "TEMA ÚNICO").when(seven == 1, F.concat(F.lit("tema-"), size)).when(seven == 2, "").otherwise(F.concat(F.lit("Tema "), size))
    by_subject = parts.select(c("p_brand").alias("exam"), F.when(c("p_size") % 2 == 0, F.concat(F.lit("estudo-"), lower)).otherwise(odd).alias("slug"), subject.alias("subject"), (c("p_size") % 6 + 1).alias("n"), c("p_partkey").alias("place"))
    return positions, nodes, by_node, by_subject, by_position


@query("ag_11_areas", f"""WITH RECURSIVE {FOCUS}, applied AS (SELECT p.exam, p.position, sum(b.n) AS n FROM named_positions p JOIN nodes x ON x.exam = p.exam AND (len(x.positions) = 0 OR list_contains(x.positions, p.position)) JOIN by_node b ON b.exam = x.exam AND b.node = x.node GROUP BY 1, 2),
found AS (SELECT * FROM (SELECT p.exam, p.position AS area, p.title, CASE WHEN coalesce(o.n, 0) <> 0 THEN o.n ELSE coalesce(a.n, 0) END AS n FROM named_positions p LEFT JOIN by_position o USING (exam, position) LEFT JOIN applied a USING (exam, position) WHERE NOT implicit) WHERE n > 0),
tree AS (SELECT exam, node AS top, node FROM nodes WHERE depth = 0 UNION ALL SELECT t.exam, t.top, n.node FROM tree t JOIN nodes n ON n.exam = t.exam AND n.parent = t.node), below AS (SELECT exam, top AS node, sum(n) AS below FROM tree JOIN by_node USING (exam, node) GROUP BY 1, 2),
bank AS (SELECT exam, slug AS area, arg_max(n, place) AS bank FROM by_subject GROUP BY 1, 2),
posts AS (SELECT *, {SUBJECT_SLUG('title')} AS area FROM heads WHERE {POST('title')} AND exam NOT IN (SELECT exam FROM found)),
named AS (SELECT p.exam, p.area, p.title, coalesce(bank, below, 0) AS n, p.place FROM posts p LEFT JOIN bank USING (exam, area) LEFT JOIN below USING (exam, node))
SELECT exam, area, title, n::BIGINT AS n FROM found UNION ALL SELECT exam, area, title, n::BIGINT FROM named WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY exam, area ORDER BY place) = 1""")
def study_areas(t):
    return P.focus_areas(*_focus(t))


@query("ag_11_subjects", f"""WITH {FOCUS}, h AS (SELECT *, {SUBJECT_SLUG('title')} AS slug, {POST('title')} AS post FROM heads), known AS (SELECT * FROM h WHERE NOT post AND slug NOT IN ('', 'geral')),
titles AS (SELECT exam, slug, title AS syllabus_title FROM known QUALIFY row_number() OVER (PARTITION BY exam, slug ORDER BY length(title) DESC, place) = 1), areas AS (SELECT exam, slug, list_sort(list_distinct(flatten(list(positions)))) AS areas FROM known GROUP BY 1, 2),
rows_ AS (SELECT exam, trim(slug) AS slug, trim(subject) AS subject, n, place FROM by_subject WHERE trim(slug) NOT IN ('', 'geral')),
kept AS (SELECT r.*, coalesce(syllabus_title, CASE WHEN subject <> '' AND subject <> slug AND NOT {POST('subject')} THEN subject ELSE array_to_string(list_transform(list_filter(string_split(slug, '-'), lambda p: p <> ''), lambda p: upper(substr(p, 1, 1)) || substr(p, 2)), ' ') END) AS title FROM rows_ r LEFT JOIN titles USING (exam, slug)
 WHERE (r.exam, r.slug) NOT IN (SELECT exam, slug FROM named_positions UNION SELECT exam, slug FROM h WHERE post))
SELECT exam, slug, arg_min(title, place) AS title, sum(n)::BIGINT AS n, coalesce((SELECT array_to_string(areas, ',') FROM areas a WHERE a.exam = k.exam AND a.slug = k.slug), '') AS areas FROM kept k WHERE NOT {POST('title')} GROUP BY exam, slug""")
def study_subjects(t):
    positions, nodes, _, by_subject, _ = _focus(t)
    return P.focus_subjects(positions, nodes, by_subject).withColumn("areas", F.array_join("areas", ","))
