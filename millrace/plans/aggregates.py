"""Aggregations (AG-*), windows, ranking and samples (WN-*)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators import tables as T
from millrace.plans import Catalog

catalog = Catalog()
query = catalog.query
money = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
MONEY = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DOUBLE)".format


@query("ag_01", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY ALL")
def group_count(t):
    return t.orders.where("o_totalprice > 1000").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("ag_02", """SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'F') AS final,
count(*) FILTER (o_orderstatus = 'P') AS pending, count(*) AS total FROM orders GROUP BY 1""")
def status_pivot(t):
    of = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return t.orders.groupBy("o_custkey").agg(of("O").alias("open"), of("F").alias("final"), of("P").alias("pending"), F.count("*").alias("total"))


@query("ag_03", f"""WITH c AS (SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1),
o AS (SELECT c_nationkey AS k, count(*) AS orders, {MONEY('o_totalprice')} AS total FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1),
m AS (SELECT c_nationkey AS k, string_agg(c_mktsegment || '=' || n, ',' ORDER BY c_mktsegment) AS segments FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) GROUP BY 1)
SELECT n_name, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers, coalesce(orders, 0) AS orders, coalesce(total, 0) AS total, coalesce(segments, '') AS segments
FROM nation LEFT JOIN c ON c.k = n_nationkey LEFT JOIN s ON s.k = n_nationkey LEFT JOIN o ON o.k = n_nationkey LEFT JOIN m ON m.k = n_nationkey""")
def funnel(t):
    key = lambda c: F.col(c).alias("n_nationkey")
    customers = t.customer.groupBy(key("c_nationkey")).agg(F.count("*").alias("customers"))
    suppliers = t.supplier.groupBy(key("s_nationkey")).agg(F.count("*").alias("suppliers"))
    orders = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).groupBy(key("c_nationkey")).agg(F.count("*").alias("orders"), money("o_totalprice").alias("total"))
    per = t.customer.groupBy(key("c_nationkey"), "c_mktsegment").agg(F.count("*").alias("n"))
    entry = F.transform(F.sort_array(F.collect_list(F.struct("c_mktsegment", "n"))), lambda x: F.concat(x.c_mktsegment, F.lit("="), x.n.cast("string")))
    segments = per.groupBy("n_nationkey").agg(F.array_join(entry, ",").alias("segments"))
    out = t.nation.select("n_nationkey", "n_name")
    for part in (customers, suppliers, orders, segments):
        out = out.join(part, "n_nationkey", "left")
    return out.na.fill(0).na.fill("").drop("n_nationkey")


@query("ag_04", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC")
def latest_per_key(t):
    last = F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("last")
    return t.orders.groupBy("o_custkey").agg(last).select("o_custkey", "last.o_orderkey", "last.o_totalprice")


@query("ag_05", """WITH d AS (SELECT source, quality, toxic, n_chars FROM documents JOIN labels USING (doc_id))
SELECT source, count(*) AS n, round(count(*) FILTER (quality = 1) / count(*), 6) AS good, round(CASE WHEN count(*) FILTER (quality = 0) > 0 THEN count(*) FILTER (quality = 0 AND toxic = 1) / count(*) FILTER (quality = 0) END, 6) AS toxic_of_bad,
round(CASE WHEN count(*) FILTER (quality = 1) > 0 THEN sum(n_chars) / 4.0 / count(*) FILTER (quality = 1) END, 4) AS tokens_each FROM d GROUP BY 1""")
def metrics_snapshot(t):
    d = t.documents.select("doc_id", "source", "n_chars").join(t.labels, "doc_id")
    good, bad = F.count_if(F.col("quality") == 1), F.count_if(F.col("quality") == 0)
    return d.groupBy("source").agg(
        F.count("*").alias("n"), F.round(F.try_divide(good, F.count("*")), 6).alias("good"),
        F.round(F.try_divide(F.count_if((F.col("quality") == 0) & (F.col("toxic") == 1)), bad), 6).alias("toxic_of_bad"),
        F.round(F.try_divide(F.sum("n_chars").cast("double") / 4.0, good), 4).alias("tokens_each"),
    )


def hourly_cube(events):
    """(hour, stage, reason) with count and cents; blank stages are left out, reasons cut to 120 characters."""
    reason = F.substring(F.coalesce(F.get_json_object("props", "$.k"), F.lit("")), 1, 120)
    cents = F.greatest(F.lit(0), F.sum(F.greatest(F.lit(0), F.round("value", 2).cast("decimal(18,2)"))) * 100)
    return events.where(F.trim("event_type") != "").groupBy(F.date_trunc("hour", "ts").alias("hour"), F.col("event_type").alias("stage"), reason.alias("reason")).agg(
        F.greatest(F.lit(1), F.count("*")).alias("count"), cents.cast("long").alias("cents")
    )


CUBE_SQL = """SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, event_type AS stage, substr(coalesce(json_extract_string(props, '$.k'), ''), 1, 120) AS reason, greatest(1, count(*)) AS count,
CAST(greatest(0, sum(greatest(0, CAST(round(value, 2) AS DECIMAL(18,2)))) * 100) AS BIGINT) AS cents FROM events WHERE trim(event_type) <> '' GROUP BY ALL"""


@query("ag_06", CUBE_SQL)
def hourly(t):
    return hourly_cube(t.events).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("ag_07", f"SELECT * FROM ({CUBE_SQL}) WHERE hour >= (SELECT max(date_trunc('hour', ts)) FROM events) - INTERVAL 24 HOUR AND stage <> 'error' ORDER BY hour DESC, stage, reason LIMIT 100")
def hourly_window(t):
    last = t.events.agg(F.max(F.date_trunc("hour", "ts")).cast("timestamp_ntz").alias("last"))
    cube = hourly(t).where("stage <> 'error'").join(F.broadcast(last), F.col("hour") >= F.col("last") - F.expr("INTERVAL 24 HOUR")).drop("last")
    return cube.orderBy(F.desc("hour"), "stage", "reason").limit(100)


@query("ag_08", """WITH x AS (SELECT role, conv_id, turn, length(text) AS n, string_split(lower(text), ' ') AS w FROM conversations),
q AS (SELECT role, list(n ORDER BY n) AS ns FROM x GROUP BY 1),
o AS (SELECT role, opener, row_number() OVER (PARTITION BY role ORDER BY c DESC, first) AS rn FROM (SELECT role, w[1] || ' ' || w[2] AS opener, count(*) AS c, min(conv_id * 1000 + turn) AS first FROM x WHERE len(w) >= 2 GROUP BY ALL))
SELECT role, ns[1 + least(len(ns) - 1, CAST(floor(0.5 * len(ns)) AS INT))] AS p50, ns[1 + least(len(ns) - 1, CAST(floor(0.9 * len(ns)) AS INT))] AS p90,
(SELECT string_agg(opener, '|' ORDER BY rn) FROM o WHERE o.role = q.role AND rn <= 5) AS openers FROM q""")
def style_profile(t):
    """Order statistics by position: exact for any size by ranking, without collecting a group."""
    x = t.conversations.select("role", "conv_id", "turn", F.char_length("text").alias("n"), F.split(F.lower("text"), " ").alias("w"))
    sizes = x.groupBy("role", "n").agg(F.count("*").alias("c"))
    upto = sizes.withColumns({"upto": F.sum("c").over(W.partitionBy("role").orderBy("n")), "all": F.sum("c").over(W.partitionBy("role"))})
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.col("all") - 1, F.floor(F.lit(p) * F.col("all"))), F.col("n")))
    quantiles = upto.groupBy("role").agg(at(0.5).cast("long").alias("p50"), at(0.9).cast("long").alias("p90"))
    openers = x.where(F.size("w") >= 2).groupBy("role", F.concat_ws(" ", F.col("w")[0], F.col("w")[1]).alias("opener")).agg(F.count("*").alias("c"), F.min(F.col("conv_id") * 1000 + F.col("turn")).alias("first"))
    top = openers.withColumn("rn", F.row_number().over(W.partitionBy("role").orderBy(F.desc("c"), "first"))).where("rn <= 5")
    names = top.groupBy("role").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "opener"))), lambda s: s.opener), "|").alias("openers"))
    return quantiles.join(names, "role", "left")


HOST = "regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\\.', '')"
STATS = f"""SELECT {HOST} AS domain, count(*) AS fetched, count(*) FILTER (length(html) > 4000) AS knowledge, count(*) FILTER (length(html) < 2000) AS low,
round(arg_max(length(html) / 10000.0, page_id), 6) AS density FROM pages GROUP BY 1"""


def _domain_stats(t):
    from millrace.functions.text import host_of

    size = F.char_length("html")
    return t.pages.groupBy(host_of(F.col("url")).alias("domain")).agg(
        F.count("*").alias("fetched"), F.count_if(size > 4000).alias("knowledge"), F.count_if(size < 2000).alias("low"), F.round(F.max_by(size / 10000.0, "page_id"), 6).alias("density")
    )


@query("ag_09", STATS)
def domain_stats(t):
    return _domain_stats(t)


@query("ag_10", f"SELECT domain, round((CASE WHEN knowledge >= 5 AND density >= 0.3 THEN 0.1 ELSE 0 END) + (CASE WHEN low / fetched >= 0.3 THEN -0.3 ELSE 0 END), 6)::DOUBLE AS bonus FROM ({STATS})")
def domain_bonus(t):
    bonus = F.when((F.col("knowledge") >= 5) & (F.col("density") >= 0.3), 0.1).otherwise(0.0) + F.when(F.col("low") / F.col("fetched") >= 0.3, -0.3).otherwise(0.0)
    return _domain_stats(t).select("domain", F.round(bonus, 6).alias("bonus"))


@query("ag_12", """SELECT o_custkey, count(*) AS attempts, max(o_totalprice) AS best, arg_max(o_totalprice, (o_orderdate, o_orderkey)) FILTER (o_orderstatus <> 'P') AS last FROM orders GROUP BY 1""")
def progress(t):
    graded = F.when(F.col("o_orderstatus") != "P", F.struct("o_orderdate", "o_orderkey", "o_totalprice"))
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("attempts"), F.max("o_totalprice").alias("best"), F.max(graded).alias("l")).select("o_custkey", "attempts", "best", F.col("l.o_totalprice").alias("last"))


@query("ag_13", "SELECT source, count(quality) AS graded, count(*) FILTER (quality = 1) AS correct, round(count(*) FILTER (quality = 1) / count(quality), 6) AS rate, round(avg(toxic), 6) AS grade FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def question_performance(t):
    d = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left")
    right = F.count_if(F.col("quality") == 1)
    return d.groupBy("source").agg(F.count("quality").alias("graded"), right.alias("correct"), F.round(F.try_divide(right, F.count("quality")), 6).alias("rate"), F.round(F.avg("toxic"), 6).alias("grade"))


@query("ag_14", """SELECT p_partkey, p_name, coalesce(n, 0) AS units, coalesce(r, 0) AS returned, coalesce(p, 0) AS pending FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r,
count(*) FILTER (l_linestatus = 'O') AS p FROM lineitem GROUP BY 1) ON l_partkey = p_partkey WHERE p_size >= 10 ORDER BY p_partkey LIMIT 80""")
def coverage(t):
    sums = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("units"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_linestatus") == "O").alias("pending"))
    leaves = t.part.where("p_size >= 10").orderBy("p_partkey").limit(80).select("p_partkey", "p_name")
    return leaves.join(sums, "p_partkey", "left").na.fill(0)


@query("ag_15", "SELECT count(*) AS orders, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_totalprice > 200000) AS large, count(DISTINCT o_custkey) AS customers, count(*) FILTER (o_orderpriority LIKE '1%') AS urgent FROM orders")
def health(t):
    return t.orders.agg(
        F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count_if(F.col("o_totalprice") > 200000).alias("large"),
        F.count_distinct("o_custkey").alias("customers"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("urgent"),
    )


@query("ag_16", """WITH l AS (SELECT p_partkey, p_brand, p_size AS previous, coalesce(n, 0) AS published, coalesce(q, 0) AS pending FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, count(*) FILTER (l_linestatus = 'O') AS q FROM lineitem GROUP BY 1) ON l_partkey = p_partkey),
s AS (SELECT *, previous / greatest(1, sum(previous) OVER (PARTITION BY p_brand)) AS share FROM l),
g AS (SELECT *, greatest(4, least(40, CASE WHEN floor(share * 80 * 4 + 0.5) = 0 THEN 12 ELSE floor(share * 80 * 4 + 0.5) END)) AS target FROM s)
SELECT p_partkey, CAST(target AS BIGINT) AS target, CAST(greatest(0, target - published - pending) AS BIGINT) AS deficit FROM g""")
def targets(t):
    sums = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("published"), F.count_if(F.col("l_linestatus") == "O").alias("pending"))
    subject = t.part.groupBy("p_brand").agg(F.sum("p_size").alias("total"))
    rows = t.part.select("p_partkey", "p_brand", "p_size").join(sums, "p_partkey", "left").na.fill(0).join(subject, "p_brand")
    wanted = F.floor(F.col("p_size") / F.greatest(F.lit(1), "total") * 80 * 4 + 0.5)
    target = F.greatest(F.lit(4), F.least(F.lit(40), F.when(wanted == 0, 12).otherwise(wanted))).cast("long")
    return rows.select("p_partkey", target.alias("target"), F.greatest(F.lit(0), target - F.col("published") - F.col("pending")).alias("deficit"))


LINES = "SELECT doc_id, trim(line, ' ') AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)"


@query("ag_17", f"SELECT doc_id, line, count(*) AS times FROM ({LINES}) WHERE length(line) >= 4 GROUP BY ALL HAVING count(*) >= 3")
def running_headers(t):
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.trim("line").alias("line"))
    return lines.where(F.char_length("line") >= 4).groupBy("doc_id", "line").agg(F.count("*").alias("times")).where("times >= 3")


@query("ag_19", "SELECT label, pos, round(avg(x), 5) AS mean FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos")
def centroids(t):
    return t.embeddings.select("label", F.posexplode("embedding").alias("p", "x")).groupBy("label", (F.col("p") + 1).cast("long").alias("pos")).agg(F.round(F.avg("x"), 5).alias("mean"))


@query("ag_20", """SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'error') = 0 THEN 'ok' WHEN count(*) FILTER (event_type <> 'error') = 0 THEN 'failed' ELSE 'partial' END AS status FROM events GROUP BY 1""")
def run_status(t):
    bad = F.count_if(F.col("event_type") == "error")
    return t.events.groupBy("user_id").agg(F.when(bad == 0, "ok").when(bad == F.count("*"), "failed").otherwise("partial").alias("status"))


@query("ag_21", "SELECT count(*) AS documents, count(*) FILTER (n_chars < 300) AS short, count(DISTINCT source) AS sources, count(*) FILTER (quality IS NULL) AS unlabelled FROM documents LEFT JOIN labels USING (doc_id)")
def retention_counters(t):
    d = t.documents.select("doc_id", "n_chars", "source").join(t.labels, "doc_id", "left")
    return d.agg(F.count("*").alias("documents"), F.count_if(F.col("n_chars") < 300).alias("short"), F.count_distinct("source").alias("sources"), F.count_if(F.col("quality").isNull()).alias("unlabelled"))


@query("ag_22", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer ORDER BY c_custkey DESC LIMIT 50")
def newest_users(t):
    return t.customer.orderBy(F.desc("c_custkey")).limit(50).select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("ag_23", """WITH e AS (SELECT user_id, min(ts) FILTER (event_type = 'signup') AS signup, min(ts) FILTER (event_type = 'view') AS viewed, min(ts) FILTER (event_type = 'purchase') AS bought FROM events GROUP BY 1)
SELECT user_id, 1 AS step, 'signup' AS what, signup AS at FROM e WHERE signup IS NOT NULL UNION ALL SELECT user_id, 2, 'viewed', viewed FROM e WHERE viewed IS NOT NULL UNION ALL SELECT user_id, 3, 'bought', bought FROM e WHERE bought IS NOT NULL AND viewed IS NOT NULL""")
def activity_timeline(t):
    first = lambda kind: F.min(F.when(F.col("event_type") == kind, F.col("ts")))
    e = t.events.groupBy("user_id").agg(first("signup").alias("signup"), first("view").alias("viewed"), first("purchase").alias("bought"))
    step = lambda n, what, at, ok: F.when(ok, F.struct(F.lit(n).alias("step"), F.lit(what).alias("what"), F.col(at).alias("at")))
    has = lambda c: F.col(c).isNotNull()
    steps = F.array_compact(F.array(step(1, "signup", "signup", has("signup")), step(2, "viewed", "viewed", has("viewed")), step(3, "bought", "bought", has("bought") & has("viewed"))))
    return e.select("user_id", F.inline(steps))


@query("ag_rollup", f"SELECT c_mktsegment, o_orderstatus, count(*) AS n, {MONEY('o_totalprice')} AS total FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ROLLUP (c_mktsegment, o_orderstatus)")
def rollup(t):
    return t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).rollup("c_mktsegment", "o_orderstatus").agg(F.count("*").alias("n"), money("o_totalprice").alias("total"))


@query("ag_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(t):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("wn_01", """WITH g AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS turn FROM part)
SELECT p_brand, p_partkey, turn FROM g ORDER BY turn, p_brand LIMIT 60""")
def round_robin(t):
    order = [F.desc("p_retailprice"), F.col("p_partkey")]
    return T.round_robin(t.part, "p_brand", order, F.col("p_brand").asc(), 60).select("p_brand", "p_partkey", F.col("turn").cast("long").alias("turn"))


@query("wn_02", "SELECT n_name, coalesce(CASE n_name WHEN 'CHINA' THEN 0 WHEN 'FRANCE' THEN 1 WHEN 'BRAZIL' THEN 2 END, 99) AS place FROM nation")
def caller_order(t):
    wanted = F.array(F.lit("CHINA"), F.lit("FRANCE"), F.lit("BRAZIL"))
    at = F.array_position(wanted, F.col("n_name"))
    return t.nation.select("n_name", F.when(at > 0, at - 1).otherwise(99).cast("int").alias("place"))


@query("wn_03", """SELECT p_partkey, row_number() OVER (ORDER BY coalesce(n, 0), p_size * p_retailprice DESC, p_partkey) AS place FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey ORDER BY place LIMIT 100""")
def computed_order(t):
    n = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    order = [F.coalesce("n", F.lit(0)), (F.col("p_size") * F.col("p_retailprice")).desc(), F.col("p_partkey")]
    top = t.part.join(n, "p_partkey", "left").orderBy(*order).limit(100)
    return top.select("p_partkey", F.row_number().over(W.orderBy(*order)).cast("long").alias("place"))


@query("wn_08", """WITH r AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS rn FROM supplier WHERE s_suppkey % 5 <> 0)
SELECT s_suppkey, 'topic' AS kind FROM supplier WHERE s_suppkey % 5 = 0 UNION ALL SELECT s_suppkey, 'rest' FROM r WHERE rn <= 10""")
def source_slice(t):
    rest = t.supplier.where("s_suppkey % 5 <> 0").orderBy(F.col("s_acctbal").asc_nulls_first(), "s_suppkey").limit(10)
    return t.supplier.where("s_suppkey % 5 = 0").select("s_suppkey", F.lit("topic").alias("kind")).unionByName(rest.select("s_suppkey", F.lit("rest").alias("kind")))


@query("wn_10", "SELECT n_nationkey, CAST(((row_number() OVER (ORDER BY n_nationkey) - 1 - 20) % 25 + 25) % 25 AS BIGINT) AS turn FROM nation QUALIFY turn < 8")
def cursor_batch(t):
    return T.modular_batch(t.nation.select("n_nationkey"), [F.col("n_nationkey")], 20, 8).withColumn("turn", F.col("turn").cast("long"))


@query("wn_15", "SELECT o_custkey, min(o_orderdate) FILTER (o_orderstatus = 'O') AS deadline FROM orders GROUP BY 1 ORDER BY deadline NULLS LAST, o_custkey LIMIT 100")
def by_deadline(t):
    d = t.orders.groupBy("o_custkey").agg(F.min(F.when(F.col("o_orderstatus") == "O", F.col("o_orderdate"))).alias("deadline"))
    return d.orderBy(F.col("deadline").asc_nulls_last(), "o_custkey").limit(100)


@query("wn_16", """SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1 AND o_orderstatus <> 'F'""")
def latest_version(t):
    rank = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    return T.first_by(t.orders, ["o_custkey"], [rank, F.desc("o_orderkey")]).where("o_orderstatus <> 'F'").select("o_custkey", "o_orderkey")


@query("wn_17", """WITH c AS (SELECT p_brand, p_partkey, coalesce(n, 0) AS n, p_size = 7 AS hinted FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY hinted DESC, n DESC, p_partkey) AS rn FROM c WHERE n < 40) SELECT p_brand, p_partkey, n FROM r WHERE rn <= 3""")
def leaves_to_distil(t):
    n = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    c = t.part.select("p_brand", "p_partkey", (F.col("p_size") == 7).alias("hinted")).join(n, "p_partkey", "left").na.fill(0).where("n < 40")
    return T.first_by(c, ["p_brand"], [F.desc("hinted"), F.desc("n"), F.col("p_partkey")], 3).select("p_brand", "p_partkey", "n")


@query("wn_18", """WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
SELECT c_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY rn) AS reviews FROM customer LEFT JOIN r ON o_custkey = c_custkey AND rn <= 3 WHERE c_acctbal < 0 GROUP BY 1""")
def queue_with_latest(t):
    latest = T.first_by(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3)
    listed = latest.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey")), asc=False), lambda x: x.o_orderkey.cast("string")), ",").alias("reviews"))
    return t.customer.where("c_acctbal < 0").select("c_custkey").join(listed, "c_custkey", "left")


@query("wn_20", """SELECT o_orderkey, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey) AS place FROM orders ORDER BY place LIMIT 50""")
def by_enum_order(t):
    order = [F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2), F.desc("o_orderdate"), F.col("o_orderkey")]
    return t.orders.orderBy(*order).limit(50).select("o_orderkey", F.row_number().over(W.orderBy(*order)).cast("long").alias("place"))


@query("wn_23", """SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def prefer_definitive(t):
    return T.first_by(t.orders, ["o_custkey"], [F.desc(F.col("o_orderstatus") == "F"), F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("wn_07", """WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn, min(doc_id) OVER (PARTITION BY source) AS first FROM documents)
SELECT source, doc_id FROM r WHERE rn <= greatest(1, CAST(floor(0.6 * 12) AS INT)) ORDER BY rn, first LIMIT 12""")
def diversified(t):
    first = t.documents.groupBy("source").agg(F.min("doc_id").alias("first"))
    own = T.first_by(t.documents.select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), F.col("doc_id")], 7)
    turned = own.withColumn("rn", F.row_number().over(W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))).join(F.broadcast(first), "source")
    return turned.orderBy("rn", "first").limit(12).select("source", "doc_id")


@query("wn_13")
def seeded_sample(t):
    """The newest 200 documents in an order drawn by a seed, 20 of them."""
    newest = t.documents.select("doc_id", "source").orderBy(F.desc("doc_id")).limit(200)
    return newest.orderBy(F.xxhash64("doc_id", F.lit(42)), "doc_id").limit(20)


@query("wn_14", """WITH s AS (SELECT doc_id, CASE WHEN source = 'src3' THEN 0 WHEN lang = 'fr' THEN 1 ELSE 2 END AS stage FROM documents)
SELECT doc_id, stage FROM s ORDER BY stage, doc_id LIMIT 60""")
def staged_fill(t):
    d = t.documents.select("doc_id", "source", "lang")
    parts = [d.where("source = 'src3'"), d.where("lang = 'fr'"), d]
    filled = T.union_first_wins([p.select("doc_id") for p in parts], ["doc_id"], [F.col("doc_id")])
    return filled.orderBy("priority", "doc_id").limit(60).select("doc_id", F.col("priority").alias("stage"))


@query("flt_28", """WITH r AS (SELECT doc_id, lang = 'de' AS capped, row_number() OVER (PARTITION BY lang = 'de' ORDER BY doc_id) AS rn FROM documents)
SELECT doc_id FROM (SELECT * FROM r WHERE NOT capped AND rn <= 50 UNION ALL SELECT * FROM r WHERE capped AND rn <= floor(0.3 * 50)) ORDER BY capped, rn LIMIT 50""")
def transcription_cap(t):
    d = t.documents.select("doc_id", (F.col("lang") == "de").alias("capped"))
    free, capped = d.where("NOT capped").orderBy("doc_id").limit(50), d.where("capped").orderBy("doc_id").limit(15)
    return free.unionByName(capped).orderBy("capped", "doc_id").limit(50).select("doc_id")
