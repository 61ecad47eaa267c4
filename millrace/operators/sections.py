"""Sections of a document's blocks: headings by kind, article, outline or capitals; levels, paths, list markers, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import B, trim
from millrace.operators import tables as T

# What a heading looks like; markers of list lines.
OUTLINE = r"^(\d+(?:\.\d+)*|[IVXLC]+|[A-Z])[.)\-–]\s+(.+)$"
CAPITALS = r"^[A-ZÁÀÂÃÉÊÍÓÔÕÚÇ0-9 ,\-–—]{4,120}$"
ARTICLE = r"^(?:Art(?:igo)?\.?\s*\d+[ºoª°]?|§\s*\d+[ºoª°]?|Inciso\s+[IVXLC\d]+|Al[ií]nea\s+[a-z]\)?)\b"
LIST_MARKER = r"^(?:(?:\(?[a-z0-9ivxlc]+\)|[a-z0-9ivxlc]+[.)]|[ivxlc]+\s*[–—-]|[•●▪]|[-–—])\s+)"
ARTIFACT, HEADING = "page_artifact", "heading"
_ARTICLE = "(?iu)" + ARTICLE.replace(r"\b", B)


def is_article(text: Column) -> Column:
    return text.rlike(_ARTICLE)


def heads(kind: Column, text: Column) -> Column:
    """Whether a block opens a section: a heading by kind, an article of law, an outline number, or two words and more in capitals."""
    text = trim(text)
    return (kind == HEADING) | is_article(text) | text.rlike(OUTLINE) | (text.rlike(CAPITALS) & text.rlike(r"\S\s+\S"))


def heading_level(level: Column, text: Column) -> Column:
    """The level given, else by the outline's number (its dots, roman 1, a letter 2), capitals 1, else 2."""
    text = trim(text)
    marker = F.regexp_extract(text, OUTLINE, 1)
    dots = F.char_length(marker) - F.char_length(F.replace(marker, F.lit("."), F.lit(""))) + 1
    inferred = F.when(marker.rlike(r"^\d"), dots).when(marker.rlike("^[IVXLC]+$"), 1).when(marker != "", 2).when(text.rlike(CAPITALS), 1).otherwise(2)
    return F.coalesce(F.when(level != 0, level), inferred).cast("int")


def trails(headings: Column) -> Column:
    """For a list of struct(level, text) in order: the open headings above each; a heading closes those of its level and below."""
    kind = "array<struct<level:int,text:string>>"
    start = F.struct(F.array().cast(kind).alias("open"), F.array().cast("array<array<string>>").alias("out"))

    def step(acc: Column, h: Column) -> Column:
        above = F.filter(acc.open, lambda o: o.level < h.level)
        opened = F.array_append(above, F.struct(h.level.cast("int").alias("level"), h.text.alias("text")))
        return F.struct(opened.alias("open"), F.array_append(acc.out, F.transform(above, lambda o: o.text)).alias("out"))

    return F.aggregate(headings, start, step, lambda acc: acc.out)


def plain_lists(text: Column) -> Column:
    """The text with its list markers taken off."""

    def line(x: Column) -> Column:
        bare = trim(x)
        marker = F.regexp_extract(bare, "(?iu)" + LIST_MARKER, 0)
        return F.when(marker != "", F.substring(bare, F.char_length(marker) + 1, F.char_length(bare))).otherwise(x)

    return F.array_join(F.transform(F.split(text, "\n"), line), "\n")


def sections(blocks: DataFrame, tables: DataFrame, key: str = "doc") -> DataFrame:
    """(key, ordinal, heading, level, path, text, first_block, last_block, first_page, last_page, legal) of blocks (key, place, page, kind, level, text).

    A section runs from a heading to the next; blocks before the first are lost, a document without headings is one section. Page artifacts
    and blank blocks are left out of the text, and all tables of a document (key, table, markdown) stand below each of its sections.
    """
    order = W.partitionBy(key).orderBy("place")
    rows = blocks.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("opens", heads(F.col("kind"), F.col("text")).cast("int"))
    rows = rows.withColumns({"part": F.sum("opens").over(order), "any": F.max("opens").over(W.partitionBy(key)), "at": F.row_number().over(order) - 1})
    rows = rows.where("part > 0 OR any = 0")
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("at", "text")))), lambda b: b.text), "\n\n")
    opened = F.col("opens") == 1
    shown = F.when(F.col("any") == 1, ~opened & ~F.col("kind").isin(ARTIFACT, HEADING) & (trim(F.col("text")) != "")).otherwise(F.col("kind") != ARTIFACT)
    parts = rows.groupBy(key, "part", "any").agg(
        F.max(F.when(opened, trim(F.col("text")))).alias("heading"), F.max(F.when(opened, heading_level(F.col("level"), F.col("text")))).alias("level"), joined(shown).alias("body"),
        F.min("at").alias("first_block"), F.max("at").alias("last_block"), F.min("page").alias("first_page"), F.max("page").alias("last_page"),
    )
    below = tables.where("markdown <> ''").groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table", "markdown"))), lambda x: x.markdown), "\n\n").alias("tables"))
    parts = parts.join(below, key, "left")
    body = plain_lists(F.concat_ws("\n\n", F.nullif("body", F.lit("")), "tables"))
    whole = F.when(body != "", trim(F.concat("heading", F.lit("\n\n"), body))).otherwise(F.col("heading"))
    parts = parts.withColumn("text", F.when(F.col("any") == 1, whole).otherwise(F.col("body"))).withColumn("ordinal", F.row_number().over(W.partitionBy(key).orderBy("part")) - 1)
    listed = parts.where("any = 1").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ordinal", "level", F.col("heading").alias("text")))).alias("h"))
    above = T.dealt(listed, [key], trails(F.col("h")), "ordinal", "path")
    out = parts.join(above, [key, "ordinal"], "left")
    legal = F.coalesce(is_article(F.col("heading")), F.lit(False))
    return out.select(key, "ordinal", "heading", F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("path", F.array().cast("array<string>")).alias("path"), "text", "first_block", "last_block", "first_page", "last_page", legal.alias("legal"))
