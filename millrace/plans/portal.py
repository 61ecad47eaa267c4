"""A portal's payloads written of parts and read back (EX-04), and the catalogue of open exams (FLT-22).

The SQL side of the payloads knows the parts they were written of.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.plans import Catalog
from millrace.sources import portal as P

catalog = Catalog()
query = catalog.query

BASE = "https://portal.example.org"
#: Three rows a section; every third section corrects, every fifth is of another kind.
ROWS = "(SELECT *, (n - 1) // 3 AS section, (n - 1) % 3 AS row, p_size % 7 AS number FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part))"
LABEL = "'EDITAL Nº 0' || number || CASE WHEN p_partkey % 9 = 0 THEN ' CONVOCAÇÃO' ELSE '' END || ' - PSP/' || CASE WHEN p_size % 2 = 0 THEN 'TERRA/NÍVEL SUPERIOR' ELSE 'MAR/NÍVEL MÉDIO' END || ' - 202' || p_size % 5 || CASE WHEN p_size % 3 > 0 THEN '.' || p_size % 3 ELSE '' END"


def _payloads(t):
    c = F.col
    text = lambda x: x.cast("string")
    rows = t.part.withColumn("n", F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey")) - 1).withColumns({"section": F.floor(c("n") / 3), "number": c("p_size") % 7})
    corrects, other = c("section") % 3 == 2, c("section") % 5 == 4
    level = F.when(c("p_size") % 2 == 0, "TERRA/NÍVEL SUPERIOR").otherwise("MAR/NÍVEL <b>MÉDIO</b>")
    notice = F.concat(F.lit("EDITAL Nº 0"), text(c("number")), F.when(c("p_partkey") % 9 == 0, " CONVOCAÇÃO").otherwise(""), F.lit("&nbsp;- PSP/"), level, F.lit("  - 202"), text(c("p_size") % 5), F.when(c("p_size") % 3 > 0, F.concat(F.lit("."), text(c("p_size") % 3))).otherwise(""))
    correction = F.concat(F.lit("Retificação do edital nº "), text(c("number")))
    ending = F.when(c("p_partkey") % 8 == 0, ".html").otherwise(".pdf")
    cell = F.concat(F.lit('<tr class="r"><td><a target="_blank" href="/docs/'), text(c("p_partkey")), ending, F.lit('">'), F.when(corrects, correction).otherwise(notice), F.lit('</a></td><td><a href="/cronograma.pdf">Cronograma do edital</a></td></tr>'))
    rows = rows.withColumn("cell", cell)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "cell"))), lambda r: r.cell), "\n")  # three at most
    title = F.when(other, "Locais de prova").when(corrects, "RETIFICAÇÕES").otherwise("ACESSO AOS EDITAIS")
    parts = rows.groupBy("p_brand", "section").agg(F.first(title).alias("titulo"), F.concat(F.lit("<style>tr{<tr><td>EDITAL Nº 1</td></tr>}</style><table>"), joined, F.lit("</table>")).alias("texto"))
    listed = parts.groupBy(c("p_brand").alias("event")).agg(F.transform(F.array_sort(F.collect_list(F.struct("section", "titulo", "texto"))), lambda s: F.struct(s.titulo.alias("titulo"), s.texto.alias("texto"))).alias("data"))
    even = F.substring("event", 7, 9).cast("int") % 2 == 0
    return listed.select("event", F.when(even, F.to_json(F.struct("data"))).otherwise(F.to_json("data")).alias("payload"))


@query("ex_04", f"""WITH r AS (SELECT p_brand AS event, *, section % 3 = 2 AS corrects FROM {ROWS} WHERE section % 5 <> 4 AND p_partkey % 8 <> 0), own AS (SELECT * FROM r WHERE NOT corrects AND p_partkey % 9 <> 0),
last AS (SELECT event, number, max(n) AS last FROM own GROUP BY 1, 2),
every AS (SELECT event, number, n, 'edital' AS kind, p_partkey, {LABEL} AS label, p_size FROM own JOIN last USING (event, number) WHERE n = last UNION ALL SELECT event, number, n, 'retificacao', p_partkey, 'Retificação do edital nº ' || number, NULL FROM r JOIN last USING (event, number) WHERE corrects AND n > last),
size_ AS (SELECT event, number, max(p_size) AS p_size, max(label) FILTER (kind = 'edital') AS label FROM every GROUP BY 1, 2)
SELECT event, number, s.label, '202' || s.p_size % 5 || CASE WHEN s.p_size % 3 > 0 THEN '.' || s.p_size % 3 ELSE '' END AS edition, CASE WHEN s.p_size % 2 = 0 THEN 'Terra,Nível superior' ELSE 'Mar,Nível médio' END AS categories,
row_number() OVER (PARTITION BY event, number ORDER BY n) - 1 AS place, kind, '{BASE}/docs/' || p_partkey || '.pdf' AS href, e.label AS link_label FROM every e JOIN size_ s USING (event, number)""")
def notices(t):
    rows = P.notices(_payloads(t), BASE).select("event", "number", "label", "edition", F.array_join("categories", ",").alias("categories"), F.explode("links").alias("l"))
    return rows.select("event", "number", "label", "edition", "categories", "l.place", "l.kind", "l.href", F.col("l.label").alias("link_label"))


# Kinds that the catalogue shows, phases that end an exam, days that a closed registration is still shown, exams shown.
KINDS, ENDED, GRACE_DAYS, SHOWN = ("concurso", "oab"), ("past_due", "archived", "cancelled"), 90, 200
AS_OF = "1996-01-01"
EXAMS = """(SELECT o_orderkey, ['concurso', 'oab', 'vestibular', 'concurso', 'other'][substr(o_orderpriority, 1, 1)::INT] AS kind, ['announced', 'registration_open', 'exam_done', 'past_due', 'archived', 'cancelled', 'registration_closed'][o_orderkey % 7 + 1] AS phase,
CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'unknown' WHEN 'F' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'open' ELSE 'closed' END END AS status, CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate END AS registration_end, 'Concurso ' || CASE WHEN o_orderkey % 4 > 0 THEN (1996 + o_orderkey % 3)::VARCHAR ELSE 'novo' END AS title, o_totalprice AS seen FROM orders)"""


@query("flt_22", f"""SELECT o_orderkey FROM (SELECT * FROM {EXAMS} WHERE kind IN {KINDS} AND phase NOT IN {ENDED} AND ((status = 'open' AND registration_end IS NULL) OR (status IN ('open', 'unknown') AND registration_end >= TIMESTAMP '{AS_OF}' - INTERVAL {GRACE_DAYS} DAY)) ORDER BY seen DESC, o_orderkey LIMIT {SHOWN})
WHERE coalesce(nullif(regexp_extract(title, '\\b((?:19|20)[0-9]{{2}})\\b', 1), '')::INT >= 1997, true)""")
def open_catalogue(t):
    """Exams that can be studied for: of a shown kind, not over, open or unknown with a registration that ended at most 90 days ago; then without those of past years."""
    c = F.col
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    kind = pick(("concurso", "oab", "vestibular", "concurso", "other"), F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    phase = pick(("announced", "registration_open", "exam_done", "past_due", "archived", "cancelled", "registration_closed"), c("o_orderkey") % 7)
    status = F.when(c("o_orderstatus") == "O", "open").when(c("o_orderstatus") == "P", "unknown").when(c("o_orderkey") % 3 == 0, "open").otherwise("closed")
    title = F.concat(F.lit("Concurso "), F.when(c("o_orderkey") % 4 > 0, (1996 + c("o_orderkey") % 3).cast("string")).otherwise("novo"))
    exams = t.orders.select("o_orderkey", kind.alias("kind"), phase.alias("phase"), status.alias("status"), F.when(c("o_orderkey") % 5 > 0, c("o_orderdate")).alias("registration_end"), title.alias("title"), c("o_totalprice").alias("seen"))
    since = F.expr(f"TIMESTAMP_NTZ '{AS_OF} 00:00:00' - INTERVAL {GRACE_DAYS} DAY")
    live = ((c("status") == "open") & c("registration_end").isNull()) | (c("status").isin("open", "unknown") & (c("registration_end") >= since))
    shown = exams.where(c("kind").isin(*KINDS) & ~c("phase").isin(*ENDED) & live).orderBy(F.desc("seen"), "o_orderkey").limit(SHOWN)
    year = F.regexp_extract("title", r"(?<![A-Za-z0-9_])((?:19|20)[0-9]{2})(?![A-Za-z0-9_])", 1).try_cast("int")
    return shown.where(F.coalesce(year >= 1997, F.lit(True))).select("o_orderkey")
