"""Joins and set operations (JN-*, SO-*), sinks as relational operators (SNK-*)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators import tables as T
from millrace.operators.sinks import KeptTable
from millrace.plans import Catalog

catalog = Catalog()
query = catalog.query
money = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")  # noqa: E731  exact sums


@query("jn_01", """SELECT n_name, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' GROUP BY n_name""")
def inner_join_count(t):
    joined = t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.where("r_name <> 'ASIA'").groupBy("n_name").agg(F.count("*").alias("suppliers"))


@query("jn_02", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F'")
def left_outer_join(t):
    final = t.orders.where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey")
    return t.customer.join(final, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "o_orderkey")


@query("jn_03", """SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey
WHERE o_custkey = c_custkey AND o_orderstatus = 'O' AND l_returnflag = 'R')""")
def semi_join(t):
    wanted = t.orders.where("o_orderstatus = 'O'").join(t.lineitem.where("l_returnflag = 'R'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return t.customer.join(wanted, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@query("jn_04", """SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id + 1 AND l.toxic = 1)""")
def anti_joins(t):
    toxic = t.labels.where("toxic = 1").select((F.col("doc_id") - 1).alias("doc_id"))
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left_anti").join(toxic, "doc_id", "left_anti")


@query("jn_05", """SELECT p_partkey, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS lines,
(SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R') AS returned,
(SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_partkey = p_partkey) AS suppliers,
(SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey OR l_suppkey = p_partkey) AS either FROM part""")
def counts_for_each_row(t):
    lines = t.lineitem
    own = lines.groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.count("*").alias("lines"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_distinct("l_suppkey").alias("suppliers")
    )
    # an OR of keys: the two counts less what both count
    by_supplier = lines.groupBy(F.col("l_suppkey").alias("p_partkey")).agg(F.count("*").alias("__b"), F.count_if(F.col("l_partkey") == F.col("l_suppkey")).alias("__both"))
    out = t.part.select("p_partkey").join(own, "p_partkey", "left").join(by_supplier, "p_partkey", "left").na.fill(0)
    return out.select("p_partkey", "lines", "returned", "suppliers", (F.col("lines") + F.col("__b") - F.col("__both")).alias("either"))


@query("jn_06", "SELECT r_regionkey AS node FROM region r WHERE NOT EXISTS (SELECT 1 FROM nation n WHERE n.n_regionkey = r.r_regionkey AND n.n_nationkey % 2 = 1 AND n.n_nationkey > 20)")
def leaf_nodes(t):
    children = t.nation.where("n_nationkey % 2 = 1 AND n_nationkey > 20")
    return t.region.join(children, F.col("n_regionkey") == F.col("r_regionkey"), "left_anti").select(F.col("r_regionkey").alias("node"))


@query("jn_07", """SELECT event_type, key, count(*) AS n, sum(CAST(val AS BIGINT))::BIGINT AS total FROM (
SELECT event_type, unnest(json_keys(props)) AS key, props FROM events), LATERAL (SELECT json_extract_string(props, '$.' || key) AS val) GROUP BY ALL""")
def json_unnest(t):
    pairs = t.events.select("event_type", F.explode(F.from_json("props", "map<string,string>")).alias("key", "val"))
    return pairs.groupBy("event_type", "key").agg(F.count("*").alias("n"), F.sum(F.col("val").cast("long")).alias("total"))


@query("jn_08", """SELECT c_custkey, coalesce(n, 0) AS orders, coalesce(total, 0.0) AS total FROM customer LEFT JOIN (
SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def lookup_with_default(t):
    sums = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), money("o_totalprice").alias("total"))
    return t.customer.select("c_custkey").join(sums, "c_custkey", "left").na.fill({"orders": 0, "total": 0.0})


#: Aliases of nations, by their keys: names of things and things alone.
ALIASES = ("small ring", "ring", "red", "blue bolt", "gear", "hot gizmo ltd", "gizmo", "old anvil", "anvil", "new", "cold plate", "plate", "rod of iron", "widget")


@query("jn_09", f"""WITH alias AS (SELECT n_name AS canonical, {list(ALIASES)!r}[n_nationkey % {len(ALIASES)} + 1] AS alias, n_nationkey AS pos FROM nation),
keys AS (SELECT p_partkey, lower(p_name) AS key FROM part),
m AS (SELECT p_partkey, canonical, row_number() OVER (PARTITION BY p_partkey ORDER BY CASE WHEN key = alias THEN 0 ELSE 1 END, pos) AS rn
 FROM keys JOIN alias ON key = alias OR contains(key, alias) OR contains(alias, key))
SELECT p_partkey, canonical FROM m WHERE rn = 1""")
def dictionary_join(t):
    alias = F.get(F.array(*map(F.lit, ALIASES)), (F.col("n_nationkey") % len(ALIASES)).cast("int"))
    aliases = F.broadcast(t.nation.select(F.col("n_name").alias("canonical"), alias.alias("alias"), F.col("n_nationkey").alias("pos")))
    keys = t.part.select("p_partkey", F.lower("p_name").alias("key"))
    met = keys.join(aliases, F.col("key").contains(F.col("alias")) | F.col("alias").contains(F.col("key")))  # a fixed dictionary: 25 rows
    return T.first_by(met, ["p_partkey"], [F.when(F.col("key") == F.col("alias"), 0).otherwise(1), F.col("pos")]).select("p_partkey", "canonical")


HOST_SQL = "regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\\.', '')"


@query("jn_10", f"""WITH hosts AS (SELECT page_id, {HOST_SQL} AS host FROM pages), src(domain, pos) AS (VALUES ('example.com', 1), ('example.org', 2), ('example.net', 3), ('ththre.example.com', 4))
SELECT page_id, domain FROM (SELECT page_id, domain, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rn FROM hosts JOIN src
 ON host = domain OR suffix(host, '.' || domain) OR suffix(domain, '.' || host) OR contains(host, domain)) WHERE rn = 1""")
def domain_suffix_join(t):
    from millrace.functions.text import host_of

    sources = F.broadcast(t.spark.createDataFrame([("example.com", 1), ("example.org", 2), ("example.net", 3), ("ththre.example.com", 4)], "domain string, pos int"))
    hosts = t.pages.select("page_id", host_of(F.col("url")).alias("host"))
    h, d = F.col("host"), F.col("domain")
    met = hosts.join(sources, (h == d) | h.endswith(F.concat(F.lit("."), d)) | d.endswith(F.concat(F.lit("."), h)) | h.contains(d))
    return T.first_by(met, ["page_id"], [F.col("pos")]).select("page_id", "domain")


@query("jn_11", """WITH s AS (SELECT o_orderkey, l_linenumber, (year(o_orderdate) = year(l_shipdate))::INT * 3 + (l_quantity > 25)::INT * 2 + (l_discount > 0.05)::INT + (l_tax < 0.02)::INT * 2 AS score
FROM orders JOIN lineitem ON l_orderkey = o_orderkey), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY score DESC, l_linenumber) AS rn FROM s)
SELECT o_orderkey, l_linenumber, score FROM r WHERE rn = 1""")
def best_match(t):
    pairs = t.orders.select("o_orderkey", "o_orderdate").join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
    part = lambda c, points: c.cast("int") * points
    score = part(F.year("o_orderdate") == F.year("l_shipdate"), 3) + part(F.col("l_quantity") > 25, 2) + part(F.col("l_discount") > 0.05, 1) + part(F.col("l_tax") < 0.02, 2)
    return T.first_by(pairs.withColumn("score", score), ["o_orderkey"], [F.desc("score"), F.col("l_linenumber")]).select("o_orderkey", "l_linenumber", "score")


@query("jn_16", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def parity_gap(t):
    return t.customer.select("c_custkey").join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left_anti").distinct()


@query("jn_17", """SELECT l_orderkey, l_linenumber, o_custkey, c_name, n_name, r_name, p_name, s_name FROM lineitem
LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey
LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey""")
def provenance(t):
    places = t.nation.join(F.broadcast(t.region), F.col("r_regionkey") == F.col("n_regionkey"), "left").select("n_nationkey", "n_name", "r_name")
    out = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    out = out.join(t.orders.select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    out = out.join(t.customer.select("c_custkey", "c_name", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"), "left")
    out = out.join(F.broadcast(places), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    out = out.join(t.part.select("p_partkey", "p_name"), F.col("p_partkey") == F.col("l_partkey"), "left").join(t.supplier.select("s_suppkey", "s_name"), F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return out.select("l_orderkey", "l_linenumber", "o_custkey", "c_name", "n_name", "r_name", "p_name", "s_name")


@query("jn_18", "SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING bool_and(l_returnflag <> 'R' OR l_quantity < 40)")
def deletable_keys(t):
    return T.all_holders(t.lineitem, ["l_partkey"], (F.col("l_returnflag") != "R") | (F.col("l_quantity") < 40))


@query("jn_19", """WITH a AS (SELECT c_custkey, c_name, c_nationkey FROM customer), b AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 7 = 0),
hit AS (SELECT c_custkey, o_orderkey FROM a JOIN b ON o_custkey = c_custkey), miss AS (SELECT * FROM a WHERE c_custkey NOT IN (SELECT c_custkey FROM hit)),
alt AS (SELECT m.c_custkey, (SELECT max(o_orderkey) FROM b WHERE o_orderkey = m.c_custkey) AS o_orderkey FROM miss m)
SELECT * FROM hit UNION ALL SELECT * FROM alt UNION ALL SELECT NULL, o_orderkey FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM hit) AND o_orderkey NOT IN (SELECT o_orderkey FROM alt WHERE o_orderkey IS NOT NULL)""")
def outer_join_with_fallback_key(t):
    a, b = t.customer.select("c_custkey"), t.orders.where("o_orderkey % 7 = 0").select("o_orderkey", "o_custkey")
    hit = a.join(b, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "o_orderkey")
    by_other = b.groupBy(F.col("o_orderkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("o_orderkey"))
    alt = a.join(hit, "c_custkey", "left_anti").join(by_other, "c_custkey", "left")
    used = hit.select("o_orderkey").unionByName(alt.select("o_orderkey").where("o_orderkey IS NOT NULL"))
    rest = b.join(used, "o_orderkey", "left_anti").select(F.lit(None).cast("long").alias("c_custkey"), "o_orderkey")
    return hit.unionByName(alt).unionByName(rest)


@query("jn_20", """SELECT n_nationkey, n_name, n AS customers, balance FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n,
CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance FROM customer WHERE c_nationkey % 3 <> 0 GROUP BY 1) ON c_nationkey = n_nationkey""")
def catalog_with_summary(t):
    summary = t.customer.where("c_nationkey % 3 <> 0").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"), money("c_acctbal").alias("balance"))
    return t.nation.select("n_nationkey", "n_name").join(summary, "n_nationkey", "left")


@query("jn_21", "SELECT p_partkey, row_number() OVER (ORDER BY (p_size >= 25) DESC, lower(p_name), p_partkey) AS place FROM part WHERE p_size > 10 ORDER BY place LIMIT 200")
def readiness_order(t):
    ordered = t.part.where("p_size > 10").orderBy(F.desc(F.col("p_size") >= 25), F.lower("p_name"), "p_partkey").limit(200)
    return ordered.select("p_partkey", F.row_number().over(W.orderBy(F.desc(F.col("p_size") >= 25), F.lower("p_name"), "p_partkey")).cast("long").alias("place"))


@query("asof_join", """SELECT a.event_id, b.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') a
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY ALL) b ON a.user_id = b.user_id AND a.ts >= b.ts""")
def as_of_join(t):
    """The last view at or before each purchase: one window over the union, no pairing of rows."""
    both = t.events.where("event_type IN ('purchase', 'view')")
    w = W.partitionBy("user_id").orderBy("ts").rangeBetween(W.unboundedPreceding, W.currentRow)
    last = F.max(F.when(F.col("event_type") == "view", F.struct("ts", "event_id"))).over(w)
    return both.withColumn("last", last).where("event_type = 'purchase'").select("event_id", F.col("last.event_id").alias("view_id"))


@query("range_join", """WITH b(lo, hi, name) AS (VALUES (0, 1000, 'low'), (1000, 100000, 'middle'), (100000, 10000000, 'high'))
SELECT name, count(*) AS n FROM orders JOIN b ON o_totalprice >= lo AND o_totalprice < hi GROUP BY name""")
def range_join(t):
    bands = F.broadcast(t.spark.createDataFrame([(0, 1000, "low"), (1000, 100000, "middle"), (100000, 10000000, "high")], "lo int, hi int, name string"))
    return t.orders.join(bands, (F.col("o_totalprice") >= F.col("lo")) & (F.col("o_totalprice") < F.col("hi"))).groupBy("name").agg(F.count("*").alias("n"))


@query("ev_07", """WITH b AS (SELECT n_nationkey + 1 AS subject, n_nationkey * 2 + 1 AS lo, n_nationkey * 2 + 2 AS hi FROM nation WHERE n_nationkey < 3)
SELECT subject, count(*) AS n FROM lineitem JOIN b ON l_linenumber BETWEEN lo AND hi GROUP BY 1""")
def subject_by_range(t):
    k = F.col("n_nationkey")
    blueprint = F.broadcast(t.nation.where("n_nationkey < 3").select((k + 1).alias("subject"), (k * 2 + 1).alias("lo"), (k * 2 + 2).alias("hi")))
    return t.lineitem.join(blueprint, F.col("l_linenumber").between(F.col("lo"), F.col("hi"))).groupBy("subject").agg(F.count("*").alias("n"))


@query("so_01", """WITH u AS (SELECT s_nationkey AS k, s_name AS name, 0 AS priority FROM supplier UNION ALL SELECT c_nationkey, c_name, 1 FROM customer)
SELECT k, name, priority FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY priority, name) AS rn FROM u) WHERE rn = 1""")
def prioritised_union(t):
    lists = [t.supplier.select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("name")), t.customer.select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("name"))]
    return T.union_first_wins(lists, ["k"], [F.col("name")])


@query("so_02", r"""WITH w AS (SELECT item_id, list_distinct(string_split(lower(text), ' ')) AS w FROM benchmark)
SELECT a.item_id, len(list_intersect(a.w, b.w)) AS both, len(list_filter(a.w, lambda x: NOT list_contains(b.w, x))) AS only FROM w a JOIN w b ON b.item_id = a.item_id + 1""")
def token_set_operations(t):
    own = t.benchmark.select("item_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("w"))
    after = own.select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("v"))
    return own.join(after, "item_id").select("item_id", F.size(F.array_intersect("w", "v")).cast("long").alias("both"), F.size(F.array_except("w", "v")).cast("long").alias("only"))


@query("so_03", """SELECT o_orderkey FROM (SELECT l_orderkey AS o_orderkey, list(DISTINCT l_linenumber) AS ids FROM lineitem GROUP BY 1)
WHERE len(list_filter(ids, lambda x: x NOT IN (1, 2, 3))) = 0""")
def subset_of_ids(t):
    ids = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_linenumber").alias("ids"))
    return ids.where(F.size(F.array_except("ids", F.array(F.lit(1), F.lit(2), F.lit(3)))) == 0).select("o_orderkey")


@query("so_04", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 30")
def except_keys(t):
    return t.part.select("p_partkey").exceptAll(t.part.join(t.lineitem.where("l_quantity > 30"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey"))


@query("so_05", """WITH live AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 25),
gc AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate, o_orderkey LIMIT 15),
more AS (SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT * FROM live) AND o_orderkey NOT IN (SELECT * FROM gc) ORDER BY o_orderdate, o_orderkey LIMIT 10)
SELECT o_orderkey, 'live' AS part FROM live UNION ALL SELECT o_orderkey, 'gc' FROM gc UNION ALL SELECT o_orderkey, 'more' FROM more""")
def reserved_batches(t):
    oldest = lambda df, n: df.orderBy("o_orderdate", "o_orderkey").limit(n).select("o_orderkey")
    live, gc = oldest(t.orders.where("o_orderstatus = 'O'"), 25), oldest(t.orders.where("o_orderstatus = 'F'"), 15)
    more = oldest(t.orders.join(F.broadcast(live.unionByName(gc)), "o_orderkey", "left_anti"), 10)
    return live.withColumn("part", F.lit("live")).unionByName(gc.withColumn("part", F.lit("gc"))).unionByName(more.withColumn("part", F.lit("more")))


@query("snk_01", "SELECT text AS key, min(doc_id) AS doc_id FROM documents GROUP BY text")
def insert_or_ignore(t):
    """Two batches, the second written twice: the first writer of a key wins."""
    rows = t.documents.select(F.col("text").alias("key"), "doc_id")
    kept = KeptTable(rows, ["key"])
    for batch in (rows.where("doc_id < 100"), rows.where("doc_id >= 100"), rows.where("doc_id >= 100")):
        kept.insert(batch, [F.col("doc_id")])
    return kept.rows()


@query("snk_02", """SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer
UNION ALL SELECT -c_custkey, 0.0 FROM customer WHERE c_custkey % 100 = 0""")
def upsert(t):
    """All customers, then changed and new ones, written twice."""
    old = t.customer.select("c_custkey", "c_acctbal")
    new = old.where("c_custkey % 10 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1)
    new = new.unionByName(old.where("c_custkey % 100 = 0").select((-F.col("c_custkey")).alias("c_custkey"), F.lit(0.0).alias("c_acctbal")))
    kept = KeptTable(old, ["c_custkey"])
    for batch in (old, new, new):
        kept.upsert(batch)
    return kept.rows()


@query("snk_03", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def upsert_counters(t):
    """Counters of three batches, one of which comes again."""
    counted = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    kept = KeptTable(counted, ["user_id", "event_type"])
    for batch in (0, 1, 1, 2, 0):
        kept.count(t.events.where(F.col("event_id") % 3 == batch).groupBy("user_id", "event_type").agg(F.count("*").alias("n")), ["n"], f"batch-{batch}")
    return kept.rows()


@query("snk_04", "SELECT doc_id, pos, CASE WHEN doc_id % 3 = 0 THEN upper(line) ELSE line END AS line FROM (SELECT doc_id, unnest(string_split(replace(text, 'ß', 'ss'), chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents) WHERE doc_id % 3 > 0 OR pos % 2 = 0")
def replace_children(t):
    """Lines of documents; those of every third document are replaced by fewer of them, twice."""
    lines = t.documents.select("doc_id", F.posexplode(F.split(F.replace(F.col("text"), F.lit("ß"), F.lit("ss")), "\n")).alias("pos", "line"))
    new = lines.where("doc_id % 3 = 0 AND pos % 2 = 0").withColumn("line", F.upper("line"))
    kept = KeptTable(lines, ["doc_id", "pos"])
    for batch in (lines, new, new):
        kept.replace(batch, "doc_id")
    return kept.rows()


@query("snk_05", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id, sha256(line) ORDER BY pos) AS rn FROM l WHERE trim(line) <> '')
SELECT doc_id, count(*) AS kept, sha256(string_agg(line, '' ORDER BY pos)) AS digest FROM k WHERE rn = 1 GROUP BY doc_id""")
def clean_before_write(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split(F.translate("text", "\0", ""), "\n")).alias("pos", "line")).where(F.trim("line") != "")
    kept = T.first_by(lines, ["doc_id", "line"], [F.col("pos")])
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x.line), "")
    return kept.groupBy("doc_id").agg(F.count("*").alias("kept"), F.sha2(joined, 256).alias("digest"))
