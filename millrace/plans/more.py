"""Posts, replies, circuits, deferrals, content addresses, snapshots, blocks (FLT-23, VA-01, STR-12, STR-15, STR-19, SRC-22, CR-07, SRC-09)."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import items as I
from millrace.operators import states as S
from millrace.plans import Catalog
from millrace.plans.roles import has
from millrace.plans.web import HOST_OF
from millrace.sources import pages as P
from millrace.sources.soup import read_blocks
from millrace.streaming import jobs

catalog = Catalog()
query = catalog.query

# Classes of errors by their messages, in the order of trial.
ERROR_CLASSES = (
    ("authentication", r"\b(401|403)\b|unauthori[sz]ed|invalid api key|api key not valid|permission denied"),
    ("billing", r"billing|credit|insufficient|quota project|exceeded your current quota|plan|purchase"),
    ("rate_limit", r"\b429\b|rate limit|resource.?has.?been.?exhausted|high demand|overloaded"),
    ("transient", r"\b(500|502|503|504)\b|timeout|network|fetch failed|ECONNREFUSED|ENOTFOUND"),
    ("budget", r"budget_exceeded"),
    ("policy", r"guardrail|policy"),
)
#: Addresses that posts get, by turn.
LINKS = ("veja https://a.b/edital.pdf.", "https://www.instagram.com/p/edital.pdf", "(http://docs.google.com/d/1)", "https://x.y/prova/1 https://x.y/prova/1!", "https://m.facebook.com/prova.pdf", "https://x.y/simples", "nada", "https://a.b/c.docx?x=1, o concurso https://z.w/q", "inscrições abertas", "programa em HTTPS://K.L/m")
POST = f"(SELECT conv_id, turn, text || ' ' || {list(LINKS)!r}[(conv_id + turn) % {len(LINKS)} + 1] AS text FROM conversations)"


@query("flt_23", rf"""WITH p AS (SELECT *, {has('text', P.EXAM_TALK)} OR {has('text', P.OPEN_HINT)} AS talk, list_distinct(list_transform(regexp_extract_all(text, '(?i){P.POST_URL.replace("'", "''")}'), lambda u: regexp_replace(u, '[.,;:!?)\]}}>]+$', ''))) AS urls FROM {POST}),
f AS (SELECT *, list_sort(list_filter(urls, lambda u: {HOST_OF('u')} <> '' AND NOT (list_contains({P.POST_SOCIAL!r}, {HOST_OF('u')}) OR len(list_filter({P.POST_SOCIAL!r}, lambda d: {HOST_OF('u')} LIKE '%.' || d)) > 0) AND ({has('u', P.FILE_URL)} OR {has('u', P.FILE_PATH)} OR {has('u', P.FILE_HOST)} OR {has("text || ' ' || u", P.FILE_WORD)}))) AS files FROM p)
SELECT conv_id, turn, talk OR len(files) > 0 AS relevant, CASE WHEN talk AND len(files) > 0 THEN 'exam talk + file link(s)' WHEN talk THEN 'exam talk only' WHEN len(files) > 0 THEN 'outbound exam-like file link without exam keywords' ELSE 'no exam talk or file links' END AS reason, array_to_string(files, ' ') AS files FROM f""")
def posts(t):
    link = F.get(F.array(*map(F.lit, LINKS)), ((F.col("conv_id") + F.col("turn")) % len(LINKS)).cast("int"))
    rows = t.conversations.select("conv_id", "turn", P.post_signal(F.concat("text", F.lit(" "), link)).alias("s"))
    return rows.select("conv_id", "turn", "s.relevant", "s.reason", F.array_join(F.array_sort("s.files"), " ").alias("files"))


@query("va_01", "SELECT event_id, greatest(0.0, least(1.0, round(value / 100, 6)))::DOUBLE AS score, CASE WHEN event_id % 3 = 0 THEN NULL ELSE greatest(0.0, least(1.0, round(value / 50 - 1, 6))) END::DOUBLE AS relevance FROM events")
def judge_reply(t):
    reply = F.to_json(F.struct(F.round(F.col("value") / 100, 6).alias("score"), F.when(F.col("event_id") % 3 != 0, F.round(F.col("value") / 50 - 1, 6)).alias("relevance")))
    read = t.events.select("event_id", F.from_json(reply, "score string, relevance string").alias("j"))
    return read.select("event_id", I.unit(F.col("j.score")).alias("score"), F.when(F.col("j.relevance").isNotNull(), I.unit(F.col("j.relevance"))).alias("relevance"))


#: Messages of failed calls; what class of failure each is of.
MESSAGES = ("HTTP 401", "insufficient credit", "429 slow down", "503 later", "socket timeout", "budget_exceeded", "guardrail hit", "bad json", "model overloaded")
_CLASS = "CASE " + " ".join(f"WHEN regexp_matches(m, '(?i){p}') THEN '{c}'" for c, p in ERROR_CLASSES) + " ELSE 'invalid_response' END"
_CALLS = f"""calls AS (SELECT user_id AS capability, event_id AS call, epoch(ts) AS sec, CASE WHEN event_type = 'error' OR event_id % 3 = 0 THEN {_CLASS} END AS failure, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM (SELECT *, {list(MESSAGES)!r}[event_id % {len(MESSAGES)} + 1] AS m FROM events))"""


def _calls(events):
    message = F.get(F.array(*map(F.lit, MESSAGES)), (F.col("event_id") % len(MESSAGES)).cast("int"))
    failure = F.when((F.col("event_type") == "error") | (F.col("event_id") % 3 == 0), I.first_match(message, ERROR_CLASSES, "invalid_response"))
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return events.select(F.col("user_id").alias("capability"), F.col("event_id").alias("call"), at.alias("at"), failure.alias("failure"))


@query("str_12", f"""WITH RECURSIVE {_CALLS}, steps AS (SELECT capability, 0::BIGINT AS turn, NULL::BIGINT AS call, true AS admitted, 'healthy' AS state, 0.0::DOUBLE AS until, 0 AS attempt FROM (SELECT DISTINCT capability FROM calls)
UNION ALL SELECT capability, turn, call, NOT shut, CASE WHEN shut OR failure IN ('budget', 'policy', 'invalid_response') THEN before WHEN failure IS NULL THEN 'healthy' ELSE 'open' END,
 CASE WHEN shut THEN until WHEN failure IS NULL THEN 0 WHEN failure IN ('budget', 'policy', 'invalid_response') THEN CASE WHEN state = 'open' THEN 0 ELSE until END WHEN failure IN ('authentication', 'billing') THEN sec + 21600 ELSE sec + least(30 * 2 ** next, 3600) END,
 CASE WHEN shut OR failure IN ('budget', 'policy', 'invalid_response') THEN attempt WHEN failure IS NULL THEN 0 ELSE next END
FROM (SELECT c.capability, c.turn, c.call, c.sec, c.failure, s.state, s.until, s.attempt, s.state <> 'healthy' AND s.until > c.sec AS shut, CASE WHEN s.state = 'open' AND s.until <= c.sec THEN 'half_open' ELSE s.state END AS before, CASE WHEN s.state = 'healthy' THEN 0 ELSE s.attempt + 1 END AS next
 FROM steps s JOIN calls c ON c.capability = s.capability AND c.turn = s.turn + 1))
SELECT capability, call, admitted, state, round(until, 3) AS open_until, attempt FROM steps WHERE call IS NOT NULL""")
def circuits(t):
    """Calls of each user under a circuit that errors open; kept across micro-batches."""
    out = jobs.run_available(jobs.circuits(_calls(jobs.table_stream(t.spark, t.sf_dir, "events"))), "append")
    return out.withColumn("open_until", F.round("open_until", 3))


@query("str_12_class", f"SELECT event_id, {_CLASS} AS class FROM (SELECT event_id, {list(MESSAGES)!r}[event_id % {len(MESSAGES)} + 1] AS m FROM events WHERE event_type = 'error')")
def error_classes(t):
    return _calls(t.events.where("event_type = 'error'")).select(F.col("call").alias("event_id"), F.col("failure").alias("class"))


@query("str_15", """WITH r AS (SELECT *, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events), n AS (SELECT user_id, ts, event_id, event_type, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS n FROM r),
l AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1), u AS (SELECT user_id, n, CASE WHEN event_type = 'error' THEN ts + to_seconds(least(1800, 60 * 2 ** least(6, n))) END AS until FROM l)
SELECT user_id, n AS failures, until, coalesce(until > (SELECT max(ts) FROM events), false) AS excluded FROM u""")
def deferral(t):
    """Until when each user's item is put off: a minute doubled with each failure in a row, half an hour at most; those not over yet are left out of the next pass."""
    rows = S.failure_runs(t.events, "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    last = rows.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type", "failures")).alias("l"))
    until = F.when(F.col("l.event_type") == "error", F.col("l.ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), S.deferral_seconds(F.col("l.failures")).cast("decimal(18,6)")))
    now = t.events.agg(F.max("ts").alias("now"))  # one row
    return last.select("user_id", F.col("l.failures").alias("failures"), until.alias("until")).crossJoin(F.broadcast(now)).select("user_id", "failures", "until", F.coalesce(F.col("until") > F.col("now"), F.lit(False)).alias("excluded"))


_FAILED = """(SELECT event_id AS job, event_type AS kind, ts, event_id % 7 + 1 AS attempts, event_id * 7919 % 1000 / 1000.0 AS jitter FROM events)"""


def _failed(t):
    e = F.col("event_id")
    rows = t.events.select(e.alias("job"), F.col("event_type").alias("kind"), S.failed_job(e % 7 + 1, F.lit(5), F.col("ts"), e * 7919 % 1000 / 1000.0).alias("f"))
    return rows.select("job", "kind", "f.*")


@query("str_19", f"SELECT kind, row_number() OVER w - 1 AS place, job, ts AS finished_at FROM {_FAILED} WHERE attempts >= 5 WINDOW w AS (PARTITION BY kind ORDER BY ts DESC, job DESC) QUALIFY row_number() OVER w <= 50")
def dead_jobs(t):
    """The dead jobs of each kind that ended last."""
    return S.dead_jobs(_failed(t))


@query("str_19_failed", f"SELECT job, CASE WHEN attempts >= 5 THEN 'dead' ELSE 'queued' END AS status, CASE WHEN attempts < 5 THEN ts + to_milliseconds(floor(jitter * least(3600, 30 * 2 ** (attempts - 1)) * 1000)::BIGINT) END AS available_at FROM {_FAILED}")
def failed_jobs(t):
    """Every event as a failed attempt: queued again after a drawn wait, or dead after the fifth."""
    return _failed(t).select("job", "status", "available_at")


@query("src_22", "SELECT page_id, 'artifacts/' || sha256(html) AS key FROM pages")
def content_address(t):
    return t.pages.select("page_id", F.concat(F.lit("artifacts/"), F.sha2("html", 256)).alias("key"))


@query("cr_07", "SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) - 1 AS place FROM documents ORDER BY doc_id DESC LIMIT 10")
def snapshot(t):
    listed = t.documents.orderBy(F.desc("doc_id")).limit(10).agg(F.sort_array(F.collect_list("doc_id"), asc=False).alias("ids"))
    return listed.select(F.posexplode("ids").alias("place", "doc_id")).select("doc_id", F.col("place").cast("long").alias("place"))


@query("src_09")
def soup_blocks(t):
    """Headings first, then text blocks. Tested on literal pages."""
    return read_blocks(t.pages)
