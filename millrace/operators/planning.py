"""Planning of searches for thin leaves, and what a student can choose to study."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import squeeze, trim
from millrace.operators import tables as T
from millrace.operators.syllabus import slug_key

# Units a leaf should have, searches a pass may start, leaves it looks at, days to wait after empty results.
TARGET_UNITS, MOST_SEARCHES, CANDIDATES, BACKOFF_DAYS = 12, 20, 100, (7, 14, 28, 56)
BUSY, FINISHED = ("queued", "running"), ("done", "failed", "ok")
#: Texts of searches, in order, and how many a leaf gets.
SEARCHES, SEARCHES_EACH = ("{subject} {topic} explicação", "{subtopic} regra norma-padrão", "{subject} {topic} lei artigo", "apostila {subject} {topic}", "{topic} {subtopic} concurso público"), 3
MOST_HOPS = 3


def knowledge_gaps(leaves: DataFrame, limit: int = CANDIDATES, target: int = TARGET_UNITS) -> DataFrame:
    """Leaves with fewer units than the target, fewest first, then by weight; syllabi take turns. Adds ``turn``.

    ``leaves`` has leaf, syllabus, syllabus_rank, units, questions, weight, depth and ordinal.
    """
    value = F.coalesce("questions", F.lit(1)) * F.coalesce("weight", F.lit(1.0))
    order = [F.col("units").asc(), value.desc(), F.col("depth").desc(), F.col("ordinal").asc()]
    return T.round_robin(leaves.where(F.col("units") < target), "syllabus", order, F.col("syllabus_rank").asc(), limit)


def waiting_leaves(searches: DataFrame, now: Column) -> DataFrame:
    """Leaves that get no new search yet: one is under way, or the last one to finish found nothing and its days are not over.

    ``searches`` has leaf, status, stored, finished (timestamp) and attempts.
    """
    over = F.col("finished").isNotNull() & F.col("status").isin(*FINISHED)
    last = F.max(F.when(over, F.struct("finished", "stored", "attempts")))
    known = searches.groupBy("leaf").agg(F.bool_or(F.col("status").isin(*BUSY)).alias("busy"), last.alias("last"))
    days = F.get(F.array(*map(F.lit, BACKOFF_DAYS)), F.least(F.greatest(F.coalesce("last.attempts", F.lit(0)), F.lit(0)), F.lit(len(BACKOFF_DAYS) - 1)))
    ends = F.col("last.finished") + F.make_dt_interval(days)
    empty = F.col("last").isNotNull() & (F.coalesce("last.stored", F.lit(0)) <= 0)
    return known.where(F.col("busy") | (empty & (now < ends))).select("leaf")


def search_texts(path: Column, title: Column) -> Column:
    """The first three different searches of a leaf, by its titles from the subject down; slugs are read as words."""
    human = lambda c: F.when(c.rlike("^[a-z0-9]+(-[a-z0-9]+)*$"), F.replace(c, F.lit("-"), F.lit(" "))).otherwise(c)
    titles = F.filter(F.transform(path, lambda p: human(trim(p))), lambda p: p != "")
    subject = F.coalesce(F.get(titles, F.lit(0)), human(title))
    topic = F.coalesce(F.get(titles, F.lit(1)), human(title))
    subtopic = F.when(F.size(titles) > 2, F.element_at(titles, -1)).otherwise(topic)
    fill = {"{subject}": subject, "{topic}": topic, "{subtopic}": subtopic}
    texts = []
    for s in SEARCHES:
        parts = F.lit(s)
        for name, value in fill.items():
            parts = F.replace(parts, F.lit(name), value)
        texts.append(squeeze(parts))
    return F.slice(F.array_distinct(F.array(*texts)), 1, SEARCHES_EACH)


def planner_pass(gaps: DataFrame, searches: DataFrame, now: Column, most: int = MOST_SEARCHES) -> DataFrame:
    """The leaves that get a search in this pass, with its texts: the first of the gaps (leaf, turn, syllabus_rank, path, title) that need not wait."""
    ready = gaps.join(waiting_leaves(searches, now), "leaf", "left_anti")
    chosen = ready.orderBy("turn", "syllabus_rank").limit(most)
    return chosen.select("leaf", "turn", search_texts(F.col("path"), F.col("title")).alias("texts"))


# --- study focus -------------------------------------------------------------------------------------


def is_post(title: Column) -> Column:
    """Whether a heading is a post's name taken for a subject: six letters at least, 85 % of them capitals."""
    letters = F.char_length(F.regexp_replace(title, "[^A-Za-zÀ-ÿ]", ""))
    capitals = F.char_length(F.regexp_replace(F.regexp_replace(title, "[^A-Za-zÀ-ÿ]", ""), "[^A-ZÀ-Ý]", ""))
    return (letters >= 6) & (capitals >= 0.85 * letters)


def subject_slug(c: Column) -> Column:
    slug = slug_key(c)
    return F.when(slug == "unknown", "geral").otherwise(slug)


def _of_slug(slug: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(slug, "-"), lambda p: p != ""), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), " ")


def subtree_counts(nodes: DataFrame, counts: DataFrame) -> DataFrame:
    """(exam, node, below) with what the node and all nodes below it have together; a tree has four levels at most."""
    own = nodes.select("exam", "node", "parent").join(counts, ["exam", "node"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = up = own.select("exam", F.col("node").alias("at"), "node", "n")
    links = nodes.select("exam", F.col("node").alias("at"), "parent")
    for _ in range(MOST_HOPS):
        up = up.join(links, ["exam", "at"]).where("parent IS NOT NULL").select("exam", F.col("parent").alias("at"), "node", "n")
        total = total.unionByName(up)
    return total.groupBy("exam", F.col("at").alias("node")).agg(F.sum("n").alias("below"))


def focus_areas(positions: DataFrame, nodes: DataFrame, by_node: DataFrame, by_subject: DataFrame, by_position: DataFrame) -> DataFrame:
    """(exam, area, title, n) of positions that have published items: their own count, or if that is none, that of the nodes that apply to them.

    An exam without such positions takes the posts that its headings name: the count of the subject of that name, else of the heading's whole subtree.
    """
    counted = nodes.join(by_node, ["exam", "node"]).withColumn("n", F.col("n"))
    for_all = counted.where(F.size(F.coalesce("positions", F.array())) == 0).groupBy("exam").agg(F.sum("n").alias("for_all"))
    for_one = counted.select("exam", "n", F.explode(F.array_distinct("positions")).alias("position")).groupBy("exam", "position").agg(F.sum("n").alias("for_one"))
    rows = positions.where("NOT implicit").join(by_position.withColumnRenamed("n", "own"), ["exam", "position"], "left").join(for_all, "exam", "left").join(for_one, ["exam", "position"], "left")
    zero = F.lit(0)
    fallback = F.coalesce("for_all", zero) + F.coalesce("for_one", zero)
    found = rows.select("exam", F.col("position").alias("area"), "title", F.when(F.coalesce("own", zero) != 0, F.col("own")).otherwise(fallback).alias("n")).where("n > 0")
    posts = nodes.where((F.col("depth") == 0) & is_post(F.col("title"))).join(found.select("exam").distinct(), "exam", "left_anti")
    posts = posts.select("exam", "node", "title", "place", subject_slug(F.col("title")).alias("area")).where("area <> ''")
    bank = by_subject.groupBy("exam", F.col("slug").alias("area")).agg(F.max_by("n", "place").alias("bank"))
    posts = posts.join(bank, ["exam", "area"], "left").join(subtree_counts(nodes, by_node), ["exam", "node"], "left")
    posts = posts.withColumn("n", F.coalesce("bank", "below", zero)).where("n > 0")
    posts = posts.groupBy("exam", "area").agg(F.min_by(F.struct("title", "n"), "place").alias("p")).select("exam", "area", "p.title", "p.n")
    return found.select("exam", F.col("area").cast("string").alias("area"), "title", "n").unionByName(posts)


def focus_subjects(positions: DataFrame, nodes: DataFrame, by_subject: DataFrame) -> DataFrame:
    """(exam, slug, title, n, areas) of subjects with published items that are no position or post.

    The longest title among the syllabus's subjects of the slug is taken, else the bank's, else the slug as words; areas are the positions its subjects are for.
    """
    heads = nodes.where("depth = 0").withColumn("slug", subject_slug(F.col("title"))).withColumn("post", is_post(F.col("title")))
    known = heads.where("NOT post AND slug NOT IN ('', 'geral')")
    titles = known.groupBy("exam", "slug").agg(F.max_by("title", F.struct(F.char_length("title"), -F.col("place"))).alias("syllabus_title"))
    areas = known.select("exam", "slug", F.explode("positions").alias("p")).groupBy("exam", "slug").agg(F.array_sort(F.collect_set("p")).alias("areas"))
    barred = positions.select("exam", "slug").unionByName(heads.where("post").select("exam", "slug")).distinct()
    rows = by_subject.withColumn("slug", trim(F.col("slug"))).where("slug NOT IN ('', 'geral')").join(barred, ["exam", "slug"], "left_anti").join(titles, ["exam", "slug"], "left")
    bank = trim(F.col("subject"))
    own = F.when((bank != "") & (bank != F.col("slug")) & ~is_post(bank), bank).otherwise(_of_slug(F.col("slug")))
    rows = rows.withColumn("title", F.coalesce("syllabus_title", own)).where(~is_post(F.col("title")))
    summed = rows.groupBy("exam", "slug").agg(F.min_by("title", "place").alias("title"), F.sum("n").alias("n"))
    return summed.join(areas, ["exam", "slug"], "left").select("exam", "slug", "title", "n", F.coalesce("areas", F.array().cast("array<string>")).alias("areas"))
