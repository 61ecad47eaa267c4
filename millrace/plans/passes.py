"""Evidence and generation passes, attempts, topics, calendar rules (VA-09, VA-10, GD-02, CR-06, CR-08, LC-04)."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.text import host_of
from millrace.operators import passes as P
from millrace.plans import Catalog
from millrace.plans.web import HOST

catalog = Catalog()
query = catalog.query

c = F.col
PROMPT = "'Sobre ' || p_name || ' número ' || p_partkey % 400"
QUESTIONS = f"(SELECT p_brand AS exam, p_brand || '-' || p_size % 4 AS doc, {PROMPT} AS prompt, CASE WHEN p_partkey % 6 = 0 THEN 'annulled' ELSE 'ok' END AS status, p_partkey FROM part WHERE p_size % 3 > 0)"


def _questions(t):
    prompt = F.concat(F.lit("Sobre "), "p_name", F.lit(" número "), (c("p_partkey") % 400).cast("string"))
    doc = F.concat_ws("-", "p_brand", (c("p_size") % 4).cast("string"))
    rows = t.part.where("p_size % 3 > 0")
    return rows.select(c("p_brand").alias("exam"), doc.alias("doc"), c("p_partkey").alias("number"), prompt.alias("prompt"), F.when(c("p_partkey") % 6 == 0, "annulled").otherwise("ok").alias("status"))


ITEMS = """(SELECT exam, doc, p_partkey AS number, prompt, status, substr(sha256(exam || '|' || doc || '|' || p_partkey || '|' || substr(prompt, 1, 120)), 1, 32) AS fingerprint, CASE WHEN score >= 0.5 THEN leaf END AS leaf, CASE WHEN score >= 0.5 THEN 'materia' || leaf % 3 || ':' || leaf END AS canonical, CASE WHEN score >= 0.5 THEN score END AS score
FROM (SELECT q.*, b.leaf, b.score FROM """ + QUESTIONS + """ q LEFT JOIN (SELECT l_partkey AS p_partkey, arg_max(l_suppkey, (l_discount * 8, -l_suppkey)) AS leaf, max(round(l_discount * 8, 4)) AS score FROM lineitem GROUP BY 1) b USING (p_partkey)))"""


def _items(t):
    maps = t.lineitem.select(c("l_partkey").alias("number"), c("l_suppkey").alias("leaf"), F.concat(F.lit("materia"), (c("l_suppkey") % 3).cast("string"), F.lit(":"), c("l_suppkey").cast("string")).alias("canonical"), F.round(c("l_discount") * 8, 4).alias("score"))
    questions = _questions(t)
    return P.evidence_items(questions, questions.select("exam", "doc", "number").join(maps, "number"))


@query("va_09_items", f"SELECT exam, doc, number, status, fingerprint, leaf, canonical, score FROM {ITEMS}")
def evidence_items(t):
    return _items(t).drop("prompt")


@query("va_09", f"""WITH i AS {ITEMS}, n AS (SELECT doc, count(*) AS created FROM i WHERE number % 2 = 1 GROUP BY 1), g AS (SELECT exam, doc, count(*) AS questions, count(*) FILTER (status = 'ok') AS sound, arg_min(canonical, number) FILTER (canonical IS NOT NULL) AS key FROM i GROUP BY 1, 2)
SELECT exam, doc, questions, coalesce(created, 0) AS created, sound, (coalesce(created, 0) >= 5 AND sound >= 5)::INT AS profiles, CASE WHEN coalesce(created, 0) >= 5 AND sound >= 5 THEN coalesce(split_part(key, ':', 1), 'geral') END AS subject FROM g LEFT JOIN n USING (doc)""")
def evidence_pass(t):
    """Every other question is known already."""
    items = _items(t)
    return P.evidence_pass(items, items.where("number % 2 = 0"))


_QUEUE = """(SELECT p_partkey AS place, CASE WHEN p_partkey % 17 > 0 THEN p_partkey END AS leaf, CASE p_partkey % 9 WHEN 0 THEN ' Geral ' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE p_name END AS subject, p_size % 7 - 1 AS deficit, p_size % 5 AS units, p_partkey % 3 AS first, p_size % 4 AS second, p_size % 3 AS created,
CASE WHEN p_partkey % 13 = 5 THEN 'error' WHEN p_partkey % 1000 = 166 THEN 'deferred' END AS failed FROM part)"""


@query("va_10", f"""WITH r AS (SELECT *, least(4, deficit) AS requested FROM {_QUEUE} WHERE least(4, deficit) > 0 AND leaf IS NOT NULL AND lower(trim(coalesce(subject, ''))) NOT IN ('', 'geral')), e AS (SELECT min(place) AS ends FROM r WHERE failed = 'deferred' AND units > 0),
g AS (SELECT r.*, CASE WHEN units > 0 AND failed IS NULL THEN CASE WHEN first > 0 THEN 'mid' WHEN second > 0 THEN 'strong' END END AS tier FROM r, e WHERE ends IS NULL OR place <= ends)
SELECT place, leaf, requested, tier, CASE WHEN tier IS NOT NULL THEN created ELSE 0 END AS drafted, CASE WHEN units > 0 AND failed IS NULL AND tier IS NULL THEN units ELSE 0 END AS suspects, CASE WHEN units > 0 AND failed IS NOT NULL THEN 'failed' WHEN tier IS NOT NULL AND created > 0 THEN 'ok' ELSE 'partial' END AS status FROM g""")
def generation_runs(t):
    k, size = c("p_partkey"), c("p_size")
    nine = k % 9
    queue = t.part.select(
        k.alias("place"), F.when(k % 17 > 0, k).alias("leaf"), F.when(nine == 0, " Geral ").when(nine == 1, "").when(nine == 2, F.lit(None)).otherwise(c("p_name")).alias("subject"), (size % 7 - 1).alias("deficit"), (size % 5).alias("units"),
        (k % 3).alias("first"), (size % 4).alias("second"), (size % 3).alias("created"), F.when(k % 13 == 5, "error").when(k % 1000 == 166, "deferred").alias("failed"),
    )
    return P.generation_runs(queue, 4)


#: One line of each number of an order.
LINES = "(SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2)"
ATTEMPT = "CASE o_orderstatus WHEN 'F' THEN 'IN_CORRECTION' WHEN 'P' THEN 'PENDING' ELSE 'IN_PROGRESS' END"
ASKED = f"(SELECT l_orderkey AS attempt, l_linenumber AS question, CASE WHEN l_linenumber % 3 = 0 THEN 'OPEN' ELSE 'MULTIPLE_CHOICE' END AS kind, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber END AS options, l_partkey % 4 AS correct FROM {LINES})"
GIVEN = f"(SELECT l_orderkey AS attempt, -l_linenumber AS place, CASE WHEN l_suppkey % 19 = 0 THEN 99 ELSE l_linenumber END AS question, CASE WHEN l_linenumber % 3 > 0 AND l_suppkey % 11 > 0 THEN l_suppkey % 5 - CASE WHEN l_suppkey % 23 = 0 THEN 9 ELSE 0 END END AS selected, CASE WHEN l_linenumber % 3 = 0 AND l_suppkey % 7 > 0 THEN ' texto ' ELSE ' ' END AS text, l_quantity FROM {LINES} WHERE l_suppkey % 29 > 0)"


def _attempts(t):
    """Orders as attempts, their lines as questions and answers."""
    n, s = c("l_linenumber"), c("l_suppkey")
    status = F.when(c("o_orderstatus") == "F", "IN_CORRECTION").when(c("o_orderstatus") == "P", "PENDING").otherwise("IN_PROGRESS")
    attempts = t.orders.select(c("o_orderkey").alias("attempt"), status.alias("status"))
    kind = F.when(n % 3 == 0, "OPEN").otherwise("MULTIPLE_CHOICE")
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(*[F.max(x).alias(x) for x in ("l_partkey", "l_suppkey", "l_quantity")])
    asked = lines.select(c("l_orderkey").alias("attempt"), n.alias("question"), kind.alias("kind"), F.when(n % 2 == 0, n).alias("options"), (c("l_partkey") % 4).alias("correct"))
    selected = F.when((n % 3 > 0) & (s % 11 > 0), s % 5 - F.when(s % 23 == 0, 9).otherwise(0))
    given = lines.where("l_suppkey % 29 > 0").select(c("l_orderkey").alias("attempt"), (-n).alias("place"), F.when(s % 19 == 0, 99).otherwise(n).alias("question"), selected.alias("selected"), F.when((n % 3 == 0) & (s % 7 > 0), " texto ").otherwise(" ").alias("text"), "l_quantity")
    return attempts, asked, given


@query("gd_02_submissions", f"""WITH a AS (SELECT o_orderkey AS attempt, {ATTEMPT} AS status FROM orders), q AS (SELECT attempt, count(DISTINCT question) AS asked FROM {ASKED} GROUP BY 1), g AS (SELECT attempt, count(*) AS given FROM {GIVEN} GROUP BY 1),
j AS (SELECT g.attempt, g.place, CASE WHEN q.kind IS NULL THEN 'invalid_question' WHEN q.kind = 'MULTIPLE_CHOICE' AND (selected IS NULL OR selected < 0 OR selected >= greatest(coalesce(options, 4), 1)) THEN 'invalid_index' WHEN q.kind <> 'MULTIPLE_CHOICE' AND trim(text) = '' THEN 'missing_text' END AS fault FROM {GIVEN} g LEFT JOIN {ASKED} q ON q.attempt = g.attempt AND q.question = g.question),
w AS (SELECT attempt, arg_min(fault, place) AS fault FROM j WHERE fault IS NOT NULL GROUP BY 1)
SELECT a.attempt, CASE WHEN status <> 'IN_PROGRESS' THEN 'already_submitted' WHEN coalesce(given, 0) <> coalesce(asked, 0) THEN 'unanswered_questions' ELSE w.fault END AS fault FROM a LEFT JOIN q USING (attempt) LEFT JOIN g USING (attempt) LEFT JOIN w USING (attempt)""")
def submissions(t):
    return P.submission_faults(*_attempts(t))


@query("gd_02", f"""WITH a AS (SELECT o_orderkey AS attempt, {ATTEMPT} AS status FROM orders), x AS (SELECT q.attempt, q.question, q.kind, q.correct, g.selected, g.l_quantity FROM {ASKED} q LEFT JOIN {GIVEN} g ON g.attempt = q.attempt AND g.question = q.question),
s AS (SELECT attempt, sum(CASE WHEN kind = 'MULTIPLE_CHOICE' THEN (selected IS NOT DISTINCT FROM correct)::INT ELSE coalesce(l_quantity % 3 >= 1, false)::INT END) AS total, bool_and(l_quantity IS NOT NULL) AS whole FROM x GROUP BY 1),
f AS (SELECT a.*, total, CASE WHEN status <> 'IN_CORRECTION' THEN 'not_in_correction' WHEN NOT coalesce(whole, true) THEN 'missing_correction' END AS fault FROM a LEFT JOIN s USING (attempt))
SELECT attempt, CASE WHEN fault IS NULL THEN 'CORRECTED' ELSE status END AS status, CASE WHEN fault IS NULL THEN coalesce(total, 0) END::BIGINT AS score, fault FROM f""")
def corrected(t):
    attempts, asked, given = _attempts(t)
    answers = asked.join(given.select("attempt", "question", "selected"), ["attempt", "question"], "left")
    return P.corrected_attempts(attempts, answers, given.select("attempt", "question", (c("l_quantity") % 3).alias("grade")))


@query("cr_06", """SELECT p_partkey, CASE WHEN kind = 'MULTIPLE_CHOICE' AND options IS NOT NULL AND options <> 4 THEN 'four_options' WHEN kind = 'MULTIPLE_CHOICE' AND sets AND (index IS NULL OR index NOT BETWEEN 0 AND 3) THEN 'index_range' END AS fault
FROM (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'OPEN' ELSE 'MULTIPLE_CHOICE' END AS kind, CASE WHEN p_size % 3 > 0 THEN p_size % 6 END AS options, p_size % 2 = 0 AS sets, CASE WHEN p_size % 5 > 0 THEN p_size % 7 - 1 END AS index FROM part)""")
def question_updates(t):
    size = c("p_size")
    options = F.when(size % 3 > 0, F.slice(F.array(*[F.lit(x) for x in "abcdef"]), F.lit(1), (size % 6).cast("int")))
    kind = F.when(c("p_partkey") % 4 == 0, "OPEN").otherwise("MULTIPLE_CHOICE")
    return t.part.select("p_partkey", P.question_update_fault(kind, options, size % 2 == 0, F.when(size % 5 > 0, size % 7 - 1)).alias("fault"))


MARKER = "exam-slug:"


@query("cr_06_topics", f"""WITH r AS (SELECT DISTINCT o_custkey AS "user", 'exame-' || o_orderkey % 12 AS exam FROM orders), t AS (SELECT o_custkey AS "user", o_orderkey AS topic, o_orderdate AS updated, CASE WHEN o_orderkey % 5 = 0 THEN 'livre' ELSE 'open_exam' END AS preset, 'Estudo.' || chr(10) || '{MARKER} exame-' || o_orderkey % 15 || chr(10) || 'fim' AS guidelines FROM orders WHERE o_orderkey % 2 = 0)
SELECT r."user", r.exam, arg_max(topic, (updated, topic)) AS topic, count(topic) = 0 AS created FROM r LEFT JOIN t ON t."user" = r."user" AND preset = 'open_exam' AND contains(guidelines, '{MARKER} ' || exam) GROUP BY 1, 2""")
def prepared_topics(t):
    k = c("o_orderkey")
    requests = t.orders.select(c("o_custkey").alias("user"), F.concat(F.lit("exame-"), (k % 12).cast("string")).alias("exam")).distinct()
    guidelines = F.concat(F.lit(f"Estudo.\n{MARKER} exame-"), (k % 15).cast("string"), F.lit("\nfim"))
    topics = t.orders.where("o_orderkey % 2 = 0").select(c("o_custkey").alias("user"), k.alias("topic"), c("o_orderdate").alias("updated"), F.when(k % 5 == 0, "livre").otherwise("open_exam").alias("preset"), guidelines.alias("guidelines"))
    return P.prepared_topics(requests, topics, MARKER)


@query("cr_08", f"""WITH d AS (SELECT host AS domain, count(*) AS stored, max(page_id) AS fetched FROM (SELECT page_id, {HOST} AS host FROM pages) GROUP BY 1)
SELECT page_id, domain, row_number() OVER (ORDER BY checked, page_id) - 1 AS place, stored, CASE WHEN fetched % 2 = 0 THEN '/privado,/tmp' END AS disallow FROM (SELECT page_id, {HOST} AS domain, page_id * 37 % 101 AS checked FROM pages ORDER BY checked, page_id LIMIT 40) LEFT JOIN d USING (domain)""")
def watch_reads(t):
    """The forty watches that were looked at longest ago, with what is known of their domains and what their robots files bar."""
    host = host_of(c("url"))
    stats = t.pages.groupBy(host.alias("domain")).agg(F.count("*").alias("stored"), F.max("page_id").alias("fetched"))
    robots = stats.where("fetched % 2 = 0").select("domain", F.array(F.lit("/privado"), F.lit("/tmp")).alias("disallow"))
    oldest = t.pages.select("page_id", host.alias("domain"), (c("page_id") * 37 % 101).alias("checked")).orderBy("checked", "page_id").limit(40)
    places = oldest.agg(F.array_sort(F.collect_list(F.struct("checked", "page_id", "domain"))).alias("w")).select(F.posexplode("w").alias("place", "w"))  # forty rows
    return places.select("place", "w.page_id", "w.domain").join(stats.drop("fetched"), "domain", "left").join(robots, "domain", "left").select("page_id", "domain", "place", "stored", F.array_join("disallow", ",").alias("disallow"))


_TEXT_YEAR = lambda x: f"nullif(regexp_extract({x}, '\\b(20[0-9]{{2}})\\b', 1), '')::INT"
_SIGNALS = {"examDate": "CASE WHEN o_orderkey % 3 = 0 THEN year(o_orderdate) + 8 END", "editionKey": f"coalesce(nullif(regexp_extract(edition, '^(20[0-9]{{2}})(?:[.\\-_].*)?$', 1), '')::INT, {_TEXT_YEAR('edition')})", "title": _TEXT_YEAR("title"), "listingUrl": _TEXT_YEAR("url"), "registrationEnd": "CASE WHEN o_orderkey % 4 = 1 THEN year(o_orderdate) + 8 END"}
_EXAMS = """(SELECT *, CASE o_orderkey % 5 WHEN 0 THEN (year(o_orderdate) + 8) || '.' || o_orderkey % 3 WHEN 1 THEN 'ed ' || (year(o_orderdate) + 8) || '/1' WHEN 2 THEN 'x' END AS edition, 'Concurso ' || CASE WHEN o_orderkey % 7 = 0 THEN (year(o_orderdate) + 9)::VARCHAR ELSE 'novo' END AS title, 'https://a.b/' || CASE WHEN o_orderkey % 11 = 0 THEN (year(o_orderdate) + 8)::VARCHAR ELSE 'c' END AS url FROM orders)"""
_LIST = "[" + ", ".join(f"{{'y': {v}, 's': '{k}'}}" for k, v in _SIGNALS.items()) + "]"


@query("lc_04", f"""WITH s AS (SELECT o_orderkey, o_orderstatus, list_filter({_LIST}, lambda z: z.y BETWEEN 2000 AND 2100) AS each FROM {_EXAMS}), y AS (SELECT *, list_sort(list_distinct(list_transform(each, lambda z: z.y))) AS years FROM s),
p AS (SELECT l_orderkey AS o_orderkey, count(*) FILTER ((l_returnflag = 'R' OR l_linenumber % 5 = 1 OR l_linenumber % 5 = 3) AND l_suppkey % 3 > 0 AND l_suppkey % 5 > 0 AND l_suppkey % 2 = 1) AS pending FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN len(years) = 1 THEN years[1] END AS year, array_to_string(flatten(list_transform(years, lambda v: list_transform(list_filter(each, lambda z: z.y = v), lambda z: z.s))), ',') AS sources, coalesce(pending, 0) AS pending,
CASE WHEN len(years) = 0 THEN 'gc_year_missing' WHEN len(years) > 1 THEN 'gc_year_conflict' WHEN years[1] >= 2003 THEN 'gc_retain_product_year' WHEN coalesce(pending, 0) > 0 THEN 'gc_hold_pending_knowledge' WHEN o_orderstatus <> 'F' THEN 'gc_past_year_soft_archive' ELSE 'gc_past_year_hard_delete' END AS reason,
CASE WHEN len(years) <> 1 OR years[1] >= 2003 OR coalesce(pending, 0) > 0 THEN 'none' WHEN o_orderstatus <> 'F' THEN 'soft_archive' ELSE 'hard_delete_discovery' END AS action FROM y LEFT JOIN p USING (o_orderkey)""")
def calendar(t):
    """Orders as exams (their years moved on by eight), their lines as artifacts; the year of the run is 2003."""
    k, year = c("o_orderkey"), F.year("o_orderdate") + 8
    text = year.cast("string")
    edition = F.when(k % 5 == 0, F.concat_ws(".", text, (k % 3).cast("string"))).when(k % 5 == 1, F.concat(F.lit("ed "), text, F.lit("/1"))).when(k % 5 == 2, "x")
    title = F.concat(F.lit("Concurso "), F.when(k % 7 == 0, (year + 1).cast("string")).otherwise("novo"))
    url = F.concat(F.lit("https://a.b/"), F.when(k % 11 == 0, text).otherwise("c"))
    signals = {"examDate": F.when(k % 3 == 0, year), "editionKey": P.year_of_edition(edition), "title": P.year_of_text(title), "listingUrl": P.year_of_text(url), "registrationEnd": F.when(k % 4 == 1, year)}
    n, s = c("l_linenumber"), c("l_suppkey")
    role = F.when(c("l_returnflag") == "R", "evidence").otherwise("administrative")
    needed = P.awaits_extraction(role, F.when(n % 5 == 1, "prova").otherwise("outro"), F.when(n % 5 == 3, "lei"), s % 3 == 0, F.when(s % 5 == 0, F.lit("2001-01-01")), F.when(s % 2 == 1, "chave").otherwise(""))
    pending = t.lineitem.groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.count_if(needed).alias("pending"))
    rows = t.orders.select("o_orderkey", F.when(c("o_orderstatus") == "F", "archived").otherwise("past_due").alias("phase"), P.exam_years(signals).alias("y")).join(pending, "o_orderkey", "left").withColumn("pending", F.coalesce("pending", F.lit(0)))
    done = P.calendar_action(c("y"), c("phase"), c("pending"), F.lit(2003))
    return rows.withColumn("done", done).select("o_orderkey", "y.year", F.array_join("y.sources", ",").alias("sources"), "pending", "done.reason", "done.action")
