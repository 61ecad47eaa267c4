"""Notices of a portal's JSON payloads: rows of tables in sections, each with its documents and the corrections that name it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import squeeze
from millrace.operators.curation import spark_regex
from millrace.sources.listings import PDF, document_links

# Titles of sections, what names a notice, what is none, and categories of labels in their order.
NOTICES, CORRECTIONS = r"EDITAIS", r"RETIFICA"
NUMBER, SUMMONS, EDITION = r"EDITAL\s+N[ºo°.]?\s*0*(\d+)", r"CONVOCA[ÇC][ÃA]O", r"\b(20\d{2}(?:\.\d+)?)\b"
CATEGORIES = ((r"\bMAR\b", "Mar"), (r"\bTERRA\b", "Terra"), (r"N[ÍI]VEL\s+M[ÉE]DIO", "Nível médio"), (r"N[ÍI]VEL\s+T[ÉE]CNICO", "Nível técnico"), (r"N[ÍI]VEL\s+SUPERIOR", "Nível superior"))
ROW, CELL = r"(?is)<tr[^>]*>.*?</tr>", r"(?is)<t[dh][^>]*>.*?</t[dh]>"
_SECTION = "struct<titulo:string,texto:string>"


def _has(c: Column, pattern: str) -> Column:
    return F.regexp_like(c, F.lit(spark_regex(pattern)))


def sections(payloads: DataFrame) -> DataFrame:
    """(event, section, title, html) of payloads (event, payload): a JSON array of sections, or an object that has one as ``data``."""
    found = F.coalesce(F.from_json("payload", f"struct<data:array<{_SECTION}>>").getField("data"), F.from_json("payload", f"array<{_SECTION}>"))
    rows = payloads.select("event", F.posexplode(found).alias("section", "s"))
    return rows.select("event", "section", F.coalesce("s.titulo", F.lit("")).alias("title"), F.col("s.texto").alias("html")).where("html IS NOT NULL")


def label_text(html: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), "(?i)&nbsp;", " "), "(?i)&amp;", "&")
    return squeeze(plain)


def notices(payloads: DataFrame, base: str) -> DataFrame:
    """(event, number, label, edition, categories, links) of every notice; links are struct(place, kind, href, label).

    A row whose first cell names a notice's number and links a PDF is that notice; of rows of one number the last counts, with
    all that belongs to it. A correction belongs to the notice of the number that its link names, if that stands before it.
    """
    kind = F.when(_has(F.col("title"), NOTICES), "edital").when(_has(F.col("title"), CORRECTIONS), "retificacao")
    rows = sections(payloads).withColumn("kind", kind).where("kind IS NOT NULL")
    plain = F.regexp_replace("html", r"(?is)<style.*?</style>", "")
    rows = rows.select("event", "section", "kind", F.posexplode(F.regexp_extract_all(plain, F.lit(ROW), F.lit(0))).alias("row", "tr"))
    rows = rows.withColumn("html", F.regexp_extract("tr", CELL, 0))
    at = F.struct("section", "row")
    key = F.concat_ws("/", F.col("event").cast("string"), F.col("section").cast("string"), F.col("row").cast("string"))
    rows = rows.select("event", "kind", at.alias("at"), key.alias("cell"), "html", label_text(F.col("html")).alias("label"))
    links = document_links(rows.select("cell", "html", F.lit(base).alias("url")), "cell").where(_has(F.col("href"), PDF)).select("cell", "href", "pos", F.col("title").alias("link_label"))
    linked = rows.join(links, "cell")
    number = lambda c: F.regexp_extract(c, spark_regex(NUMBER), 1).try_cast("long")
    own = linked.where("kind = 'edital'").withColumn("number", number(F.col("label"))).where(F.col("number").isNotNull() & ~_has(F.col("label"), SUMMONS))
    last = own.groupBy("event", "number").agg(F.max("at").alias("last"))
    own = own.join(last, ["event", "number"]).where("at = last")
    later = linked.where("kind = 'retificacao'").withColumn("number", number(F.col("link_label"))).join(last, ["event", "number"]).where("at > last")
    of = lambda df, label: df.select("event", "number", "kind", "at", "pos", "href", F.col(label).alias("label"))
    every = of(own, "label").unionByName(of(later, "link_label"))
    listed = F.array_sort(F.collect_list(F.struct("at", "pos", "kind", "href", "label")))
    found = every.groupBy("event", "number").agg(F.max(F.when(F.col("kind") == "edital", F.col("label"))).alias("label"), listed.alias("all"))
    tags = F.array_compact(F.array(*[F.when(_has(F.col("label"), p), F.lit(name)) for p, name in CATEGORIES]))
    edition = F.regexp_extract("label", spark_regex(EDITION), 1)
    return found.select("event", "number", "label", F.when(edition != "", edition).alias("edition"), tags.alias("categories"), F.transform("all", lambda x, i: F.struct(i.alias("place"), x.kind.alias("kind"), x.href.alias("href"), x.label.alias("label"))).alias("links"))
