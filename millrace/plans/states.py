"""Lifecycles, queues, change detection and streams over orders and events (LC-*, STR-*, GD-*)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators import states as S
from millrace.operators import tables as T
from millrace.plans import Catalog
from millrace.streaming import jobs

catalog = Catalog()
query = catalog.query

AS_OF = "TIMESTAMP '1998-01-01 00:00:00'"
PHASES = list(S.EDGES)
PHASE_SQL = "CASE o_orderkey % 8 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PHASES)) + " END"
SNAP = f"(SELECT o_orderkey, {PHASE_SQL} AS phase, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' ELSE 'unknown' END AS status, o_orderdate AS reg_end, o_orderdate + INTERVAL 60 DAY AS exam, CASE WHEN o_custkey % 3 > 0 THEN o_orderdate + INTERVAL 90 DAY END AS purge_at, CASE WHEN o_custkey % 4 > 0 THEN o_orderdate + INTERVAL 100 DAY END AS archived FROM orders)"


def _snapshot(t):
    phase = F.element_at(F.array(*[F.lit(p) for p in PHASES]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    status = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "closed").otherwise("unknown")
    d, days = F.col("o_orderdate"), lambda n: F.expr(f"INTERVAL {n} DAY")
    return t.orders.select(
        "o_orderkey", phase.alias("phase"), status.alias("status"), d.alias("reg_end"), (d + days(60)).alias("exam"),
        F.when(F.col("o_custkey") % 3 > 0, d + days(90)).alias("purge_at"), F.when(F.col("o_custkey") % 4 > 0, d + days(100)).alias("archived"),
    )


def _as_of():
    return F.expr("TIMESTAMP_NTZ '1998-01-01 00:00:00'")


@query("lc_01", f"""SELECT o_orderkey, CASE WHEN phase IN ('archived', 'cancelled') THEN phase WHEN status = 'open' AND phase = 'announced' THEN 'registration_open' WHEN reg_end < {AS_OF} AND phase = 'registration_open' THEN 'registration_closed'
WHEN reg_end < {AS_OF} AND phase = 'announced' THEN NULL WHEN status = 'closed' AND phase = 'registration_open' THEN 'registration_closed' WHEN exam < {AS_OF} AND phase IN ('exam_scheduled', 'registration_closed') THEN 'exam_done' WHEN exam < {AS_OF} AND phase = 'exam_done' THEN 'past_due'
WHEN phase = 'past_due' AND purge_at <= {AS_OF} THEN 'archived' ELSE phase END AS next FROM {SNAP}""")
def lifecycle(t):
    """An announced entry may not close without opening: that edge is illegal and gives null."""
    s = _snapshot(t)
    move = S.next_phase(F.col("phase"), F.col("status"), F.col("reg_end"), F.col("exam"), F.col("purge_at"), _as_of())
    return s.select("o_orderkey", move.phase.alias("next"))


@query("lc_03", f"""SELECT o_orderkey, CASE WHEN phase = 'archived' THEN CASE WHEN archived IS NULL OR {AS_OF} < archived + INTERVAL 90 DAY THEN 'none' ELSE 'hard_delete' END WHEN phase = 'past_due' THEN CASE WHEN {AS_OF} < coalesce(purge_at, exam + INTERVAL 30 DAY) THEN 'none' ELSE 'soft_archive' END
WHEN exam < {AS_OF} AND phase IN ('exam_done', 'exam_scheduled', 'registration_closed') THEN 'mark_past_due' ELSE 'none' END AS action FROM {SNAP}""")
def purge(t):
    s = _snapshot(t)
    return s.select("o_orderkey", S.purge_action(F.col("phase"), F.col("archived"), F.col("purge_at"), F.col("exam"), _as_of()).action.alias("action"))


@query("lc_02", f"SELECT o_orderkey, CASE WHEN o_orderdate > {AS_OF} THEN 'upcoming' WHEN o_orderdate + INTERVAL 30 DAY >= {AS_OF} THEN 'open' WHEN o_orderstatus = 'P' THEN 'unknown' ELSE 'closed' END AS status FROM orders")
def registration(t):
    """The date window first, then what the crawler saw."""
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", F.when(d > _as_of(), "upcoming").when(d + F.expr("INTERVAL 30 DAY") >= _as_of(), "open").when(F.col("o_orderstatus") == "P", "unknown").otherwise("closed").alias("status"))


@query("lc_05", "SELECT c_custkey, CASE WHEN old = 'F' THEN 'F' WHEN old = 'O' AND new = 'P' THEN 'O' ELSE coalesce(new, old) END AS status FROM (SELECT o_custkey AS c_custkey, arg_min(o_orderstatus, (o_orderdate, o_orderkey)) AS old, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS new FROM orders GROUP BY 1)")
def sticky_status(t):
    at = F.struct("o_orderdate", "o_orderkey")
    both = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min_by("o_orderstatus", at).alias("old"), F.max_by("o_orderstatus", at).alias("new"))
    return both.select("c_custkey", F.when(F.col("old") == "F", "F").when((F.col("old") == "O") & (F.col("new") == "P"), "O").otherwise(F.coalesce("new", "old")).alias("status"))


@query("str_01", "SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def hourly_stream(t):
    return jobs.run_available(jobs.hourly_counts(jobs.events_stream(t.spark, t.sf_dir)), "complete")


@query("str_01_batch", "SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def hourly_batch(t):
    return jobs.hourly_counts(t.events.withColumn("at", F.col("ts").cast("timestamp")))


@query("str_17_sliding", "SELECT start, count(*) AS n FROM (SELECT date_trunc('hour', ts)::TIMESTAMP AS start FROM events UNION ALL SELECT date_trunc('hour', ts)::TIMESTAMP - INTERVAL 1 HOUR FROM events) GROUP BY 1")
def sliding_stream(t):
    return jobs.run_available(jobs.sliding_counts(jobs.events_stream(t.spark, t.sf_dir)), "complete")


@query("str_17_session", """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def sessions(t):
    e = t.events.withColumn("at", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("at", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("str_02", "SELECT user_id, count(*) FILTER (before IS NULL OR before <> event_type) AS fetched FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) GROUP BY 1")
def unchanged_skip(t):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    before = t.events.select("user_id", "event_type", F.lag("event_type").over(w).alias("before"))
    return before.groupBy("user_id").agg(F.count_if(F.col("before").isNull() | (F.col("before") != F.col("event_type"))).alias("fetched"))


@query("str_03", """SELECT user_id, count(*) FILTER (before IS NOT NULL AND before <> event_type) AS changes, max(ts) FILTER (before IS NOT NULL AND before <> event_type) AS last_changed FROM (SELECT user_id, event_type, ts, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) GROUP BY 1""")
def freshness(t):
    marked = S.changes(t.events, "user_id", ["ts", "event_id"], "event_type")
    return marked.groupBy("user_id").agg(F.count_if("changed").alias("changes"), F.max(F.when(F.col("changed"), F.col("ts"))).alias("last_changed"))


ALERTS = """WITH e AS (SELECT *, event_type = 'error' AS bad, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
f AS (SELECT *, sum(bad::INT) OVER (PARTITION BY user_id, run ORDER BY ts, event_id)::BIGINT AS failures, coalesce(lag(bad) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS was FROM e)
SELECT user_id, event_id, CASE WHEN was AND NOT bad THEN 'recovered' WHEN bad AND NOT was THEN 'failing' ELSE 'still unhealthy' END AS alert, failures FROM f WHERE was <> bad OR (bad AND failures > 3 AND failures % 3 = 0)"""


@query("str_04", ALERTS)
def watchdog(t):
    found = S.alerts(t.events, "user_id", ["ts", "event_id"], F.col("event_type") == "error", 3)
    return found.select("user_id", "event_id", "alert", "failures")


@query("str_04_stream", ALERTS)
def watchdog_stream(t):
    return jobs.run_available(jobs.watchdog(jobs.events_stream(t.spark, t.sf_dir)), "append")


@query("str_06", """WITH e AS (SELECT *, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events), f AS (SELECT user_id, ts, event_id, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id, run ORDER BY ts, event_id)::BIGINT AS failures FROM e)
SELECT user_id, arg_max(failures, (ts, event_id)) AS failures, arg_max(failures, (ts, event_id)) > 0 AS broken FROM f GROUP BY 1""")
def source_health(t):
    runs = S.failure_runs(t.events, "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    last = runs.groupBy("user_id").agg(F.max_by("failures", F.struct("ts", "event_id")).alias("failures"))
    return last.select("user_id", "failures", (F.col("failures") > 0).alias("broken"))


JOBS = "(SELECT event_id AS job_id, event_type AS kind, CASE WHEN event_id % 3 = 0 THEN 'running' WHEN event_id % 3 = 1 THEN 'queued' ELSE 'done' END AS status, user_id % 5 AS priority, ts AS available_at, ts + INTERVAL 15 MINUTE AS lease_until FROM events)"


def _jobs(t):
    status = F.when(F.col("event_id") % 3 == 0, "running").when(F.col("event_id") % 3 == 1, "queued").otherwise("done")
    return t.events.select(
        F.col("event_id").alias("job_id"), F.col("event_type").alias("kind"), status.alias("status"), (F.col("user_id") % 5).alias("priority"),
        F.col("ts").alias("available_at"), (F.col("ts") + F.expr("INTERVAL 15 MINUTE")).alias("lease_until"),
    )


NOON = "TIMESTAMP '2024-01-01 12:00:00'"


@query("str_07", f"SELECT job_id, kind, priority FROM {JOBS} WHERE (status = 'queued' AND available_at <= {NOON}) OR (status = 'running' AND lease_until < {NOON}) ORDER BY priority DESC, available_at, job_id LIMIT 25")
def claim(t):
    return S.claimable(_jobs(t), F.expr("TIMESTAMP_NTZ '2024-01-01 12:00:00'"), 25).select("job_id", "kind", "priority")


@query("str_08", f"SELECT kind, count(*) AS stale FROM {JOBS} WHERE status = 'running' AND lease_until < {NOON} GROUP BY 1")
def lease_reclaim(t):
    return _jobs(t).where((F.col("status") == "running") & (F.col("lease_until") < F.expr("TIMESTAMP_NTZ '2024-01-01 12:00:00'"))).groupBy("kind").agg(F.count("*").alias("stale"))


@query("str_09", "SELECT a.event_id FROM events a WHERE event_type = 'view' AND EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND b.ts < a.ts AND b.ts >= a.ts - INTERVAL 1 HOUR)")
def recent_duplicate(t):
    """Whether a purchase came within the hour before: a range frame, so no pairs are formed."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp"))
    w = W.partitionBy("user_id").orderBy("us").rangeBetween(-3_600_000_000, -1)
    marked = t.events.where("event_type IN ('view', 'purchase')").withColumn("us", seconds)
    near = F.max(F.when(F.col("event_type") == "purchase", 1)).over(w)
    return marked.withColumn("near", near).where("event_type = 'view' AND near = 1").select("event_id")


@query("str_10", "SELECT user_id, CASE least(n, 4) WHEN 1 THEN 7 WHEN 2 THEN 14 WHEN 3 THEN 28 WHEN 4 THEN 56 ELSE 0 END AS days FROM (SELECT user_id, count(*) FILTER (event_type = 'error') AS n FROM events GROUP BY 1)")
def empty_backoff(t):
    n = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("n"))
    ladder = F.array(*[F.lit(x) for x in (7, 14, 28, 56)])
    return n.select("user_id", F.when(F.col("n") > 0, F.element_at(ladder, F.least(F.lit(4), "n").cast("int"))).otherwise(0).alias("days"))


@query("str_13", """WITH l AS (SELECT user_id, list([{'id': event_id, 'n': event_id % 4 + 1, 'used': event_id % 4 + 1, 'ok': true}] ORDER BY ts, event_id) AS l FROM events GROUP BY user_id, ts::DATE),
f AS (SELECT user_id, unnest(list_reduce(l, lambda acc, x: list_append(acc, {'id': x[1].id, 'n': x[1].n, 'used': CASE WHEN acc[-1].used + x[1].n <= 10 THEN acc[-1].used + x[1].n ELSE acc[-1].used END, 'ok': acc[-1].used + x[1].n <= 10}))) AS x FROM l)
SELECT user_id, x.id AS event_id, x.ok AS ok FROM f""")
def budgets(t):
    """Requests of each user in order under a cap of 10 a day; what is rejected uses nothing up."""
    n = (F.col("event_id") % 4 + 1).cast("long").alias("n")
    lists = t.events.select("user_id", F.to_date("ts").alias("day"), "ts", "event_id", n).groupBy("user_id", "day").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "n"))).alias("r"))
    judged = lists.select("user_id", F.arrays_zip("r", S.admitted(F.col("r"), 10).alias("ok")).alias("x"))
    return judged.select("user_id", F.explode("x").alias("x")).select("user_id", "x.r.event_id", "x.ok")


@query("str_14", "SELECT event_id FROM events WHERE least(abs(hour(ts) * 60 + minute(ts) - 1430), 1440 - abs(hour(ts) * 60 + minute(ts) - 1430)) <= 30")
def schedule_windows(t):
    apart = F.abs(F.hour("ts") * 60 + F.minute("ts") - 1430)
    return t.events.where(F.least(apart, 1440 - apart) <= 30).select("event_id")


@query("str_18", "SELECT event_id FROM events WHERE event_type = 'signup' ORDER BY ts DESC, event_id DESC LIMIT 32")
def flag_queue(t):
    return t.events.where("event_type = 'signup'").orderBy(F.desc("ts"), F.desc("event_id")).limit(32).select("event_id")


@query("str_20", f"SELECT o_orderkey, CASE {PHASE_SQL} " + " ".join(f"WHEN '{a}' THEN {{0}} IN ({', '.join(repr(x) for x in (a, *e))})" for a, e in S.EDGES.items()).format("CASE o_custkey % 8 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PHASES)) + " END") + " END AS allowed FROM orders")
def transition_guard(t):
    names = F.array(*[F.lit(p) for p in PHASES])
    at = lambda c: F.element_at(names, (F.col(c) % 8 + 1).cast("int"))
    return t.orders.select("o_orderkey", S.may_move(at("o_orderkey"), at("o_custkey")).alias("allowed"))


@query("str_21", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM (SELECT c_custkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING coalesce(max(o_orderdate), TIMESTAMP '1970-01-01') < TIMESTAMP '1998-03-01') ORDER BY 1 LIMIT 50))")
def cascade(t):
    """What goes with the 50 oldest stale owners, down two levels."""
    last = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
    stale = t.customer.select("c_custkey").join(last, "c_custkey", "left").where("coalesce(last, TIMESTAMP_NTZ '1970-01-01 00:00:00') < TIMESTAMP_NTZ '1998-03-01 00:00:00'").orderBy("c_custkey").limit(50)
    orders = t.orders.join(F.broadcast(stale), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return t.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_orderkey", "l_linenumber")


@query("wn_09", "SELECT user_id, broken * 1 + stale * 2 AS rank FROM (SELECT user_id, (arg_max(event_type, (ts, event_id)) = 'error')::INT AS broken, (max(ts) < TIMESTAMP '2024-01-20 00:00:00')::INT AS stale FROM events GROUP BY 1)")
def broken_or_stale(t):
    last = t.events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"), F.max("ts").alias("ts"))
    stale = (F.col("ts") < F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'")).cast("int")
    return last.select("user_id", ((F.col("kind") == "error").cast("int") + stale * 2).alias("rank"))


@query("sy_06", "WITH RECURSIVE n(node, parent) AS (SELECT k, CASE WHEN k > 0 THEN (k - 1) // 2 END FROM (SELECT n_nationkey AS k FROM nation)), w AS (SELECT node, parent AS ancestor, 1 AS depth FROM n WHERE parent IS NOT NULL UNION ALL SELECT w.node, n.parent, depth + 1 FROM w JOIN n ON n.node = w.ancestor WHERE n.parent IS NOT NULL AND depth < 12) SELECT node, ancestor, depth FROM w")
def ancestors(t):
    k = F.col("n_nationkey")
    nodes = t.nation.select(k.alias("node"), F.when(k > 0, F.floor((k - 1) / 2)).cast("int").alias("parent"))
    return T.cursor_walk(nodes, "node", "parent", 12)


@query("gd_01", """WITH a AS (SELECT conv_id, turn - 1 AS turn, list_filter(string_split(lower(text), ' '), lambda w: length(w) > 4)[1:5] AS words FROM conversations WHERE role = 'assistant')
SELECT c.conv_id, c.turn, len(list_filter(words, lambda w: contains(lower(text), w))) >= ceil(0.4 * len(words)) AS passed FROM conversations c JOIN a ON a.conv_id = c.conv_id AND a.turn = c.turn WHERE c.role = 'user'""")
def open_grading(t):
    """An answer passes with two fifths of the reference's first five words of over four letters."""
    long_ = F.slice(F.filter(F.split(F.lower("text"), " "), lambda w: F.char_length(w) > 4), 1, 5)
    key = t.conversations.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), long_.alias("words"))
    asked = t.conversations.where("role = 'user'").select("conv_id", "turn", F.lower("text").alias("x"))
    held = F.size(F.filter("words", lambda w: F.col("x").contains(w)))
    return asked.join(key, ["conv_id", "turn"]).select("conv_id", "turn", (held >= F.ceil(0.4 * F.size("words"))).alias("passed"))


@query("va_06", "SELECT conv_id, turn, chr(CAST(65 + turn % 4 AS INT)) || ') ' || text AS shown FROM conversations")
def rendering(t):
    return t.conversations.select("conv_id", "turn", F.concat(F.char((F.lit(65) + F.col("turn") % 4).cast("int")), F.lit(") "), F.col("text")).alias("shown"))
