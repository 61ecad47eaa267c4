"""Links of listing and detail pages: anchors with resolved addresses, junk left out, document links with hints."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import squeeze
from millrace.operators.curation import spark_regex
from millrace.operators.items import document_hint

# The anchor form, and addresses, titles and labels that are no listings or documents.
ANCHOR = r"(?is)<a\s+[^>]*href=[\"']([^\"']+)[\"'][^>]*>(.*?)</a>"
JUNK_URL = r"/noticias(?:/|$|\?)|/contato(?:/|$|\?)|privacidade|cookies?|cmplz|cookiedatabase|#sobre|#historia|#contato|page_category"
JUNK_TITLE = r"^(saiba\s+mais|clique\s+aqui|leia\s+mais|ver\s+mais|cookies?|privacidade|not[ií]cias|quem\s+somos|sobre\s+n[oó]s|entre\s+em\s+contato|gerenciar(\s+op[cç][oõ]es)?)$"
SKIPPED = r"inscri[cç][ãa]o\s+online|boleto|cart[ãa]o\s+de\s+confirma[çc][ãa]o|perguntas\s+frequentes|facebook|instagram|twitter|linkedin|whatsapp|voltar\s+para|vlibras|libras\b"
PDF, DOCUMENT_LABEL = r"\.pdf(\?|#|$)", r"\bedital\b|\bprova\b|\bgabarito\b|\bretifica|\bprograma\b"
DECODED = (("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"))
LEAST_TITLE, LEAST_LABEL = 8, 3
#: What an address or title of an exam shows, and what that counts.
LIKENESS = (("href", r"/concurso/", 12), ("href", r"/provas?/", 8), ("href", r"\.pdf(\?|#|$)", 6), ("blob", r"edital|inscri", 3), ("href", r"page_category|noticias|avaliacao#|em-andamento|concluidos|ucat=", -12))
DATED, DATED_POINTS = (r"\b20\d{2}\b", r"/[^/]*20\d{2}"), 5


def decoded(text: Column) -> Column:
    for entity, char in DECODED:
        text = F.regexp_replace(text, "(?i)" + entity, char)
    return text


def without_dots(path: Column) -> Column:
    """A path without . and .. segments."""
    parts = F.split(path, "/")
    last = F.size(parts) - 1

    def step(done: Column, x: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))
        ended = lambda d: F.when(x.i == last, F.array_append(d, F.lit(""))).otherwise(d)
        return F.when(x.s == "..", ended(up)).when(x.s == ".", ended(done)).otherwise(F.array_append(done, x.s))

    numbered = F.transform(parts, lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    return F.array_join(F.aggregate(numbered, F.array().cast("array<string>"), step), "/")


def resolved(base: Column, href: Column) -> Column:
    """The address that a link means on a page; null without a base where it needs one. Nothing is percent-encoded."""
    origin = F.lower(F.regexp_extract(base, r"(?i)^(https?://[^/?#]+)", 1))
    folder = F.regexp_extract(base, r"(?i)^https?://[^/?#]+(/(?:[^?#]*/)?)?", 1)
    tail, path = F.regexp_extract(href, r"([?#].*)$", 1), F.regexp_extract(href, r"^([^?#]*)", 1)
    page = F.regexp_extract(base, r"(?i)^https?://[^/?#]+([^?#]*)", 1)
    whole = F.concat(F.lower(F.regexp_extract(href, r"(?i)^(https?://[^/?#]+)", 1)), F.regexp_replace(F.regexp_extract(href, r"(?i)^https?://[^/?#]+(.*)$", 1), r"^(?=[?#]|$)", "/"))
    near = F.concat(origin, without_dots(F.concat(F.when(folder == "", "/").otherwise(folder), path)), tail)
    return (
        F.when(F.regexp_like(href, F.lit("(?i)^https?://[^/?#]+")), whole)
        .when(F.regexp_like(href, F.lit("(?i)^[a-z][a-z0-9+.-]*:")), href)
        .when(origin == "", None)
        .when(href.startswith("//"), F.concat(F.regexp_extract(origin, "^([a-z]+:)", 1), href))
        .when(href.startswith("/"), F.concat(origin, without_dots(path), tail))
        .when(path == "", F.concat(origin, F.when(page == "", "/").otherwise(page), tail))
        .otherwise(near)
    )


def anchors(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, pos, href, title) of every anchor that leads somewhere: address resolved, title without markup."""
    parts = F.arrays_zip(*(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(k)).alias(n) for k, n in ((1, "href"), (2, "title"))))
    rows = pages.select(key, "url", F.posexplode(parts).alias("pos", "a"))
    rows = rows.select(key, "pos", decoded(F.trim(F.col("a.href"))).alias("raw"), decoded(squeeze(F.regexp_replace(F.col("a.title"), "<[^>]+>", " "))).alias("title"), "url")
    rows = rows.where((F.col("raw") != "") & ~F.col("raw").startswith("#") & ~F.col("raw").startswith("javascript:"))
    return rows.select(key, "pos", resolved(F.col("url"), F.col("raw")).alias("href"), "title").where(F.col("href").isNotNull())


def _first(rows: DataFrame, key: str) -> DataFrame:
    """One row of each address: the first."""
    return rows.groupBy(key, "href").agg(F.min(F.struct("pos", "title")).alias("first")).select(key, "href", F.col("first.pos").cast("long").alias("pos"), "first.title")


def matches_any(text: Column, patterns: list[str]) -> Column:
    """Whether a pattern occurs; what is no pattern counts as plain text, and without patterns everything matches."""
    out = F.lit(not patterns)
    for p in patterns:
        try:
            re.compile(p)
            out = out | F.regexp_like(text, F.lit(spark_regex(p)))
        except re.error:
            out = out | F.lower(text).contains(p.lower())
    return out


def listing_links(pages: DataFrame, patterns: list[str], key: str = "page_id") -> DataFrame:
    """(key, href, pos, title) of the links of a listing."""
    like = lambda c, p: F.regexp_like(c, F.lit(spark_regex(p)))
    rows = anchors(pages, key).where((F.char_length("title") >= LEAST_TITLE) & ~like(F.col("title"), JUNK_TITLE) & ~like(F.col("href"), JUNK_URL))
    return _first(rows.where(matches_any(F.concat_ws(" ", "title", "href"), patterns)), key)


def document_links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, href, pos, title, kind) of the links to documents."""
    like = lambda c, p: F.regexp_like(c, F.lit(spark_regex(p)))
    title, href = F.col("title"), F.col("href")
    rows = anchors(pages, key).where((F.char_length(title) >= LEAST_LABEL) & ~like(title, SKIPPED) & ~like(href, SKIPPED) & (like(href, PDF) | like(title, DOCUMENT_LABEL)))
    return _first(rows, key).withColumn("kind", document_hint(F.concat_ws(" ", title, href))[0])


def exam_likeness(title: Column, href: Column) -> Column:
    """How much a link looks like an exam's."""
    like = lambda c, p: F.regexp_like(c, F.lit(spark_regex(p)))
    text = {"href": href, "blob": F.concat_ws(" ", title, href)}
    score = F.when(like(title, DATED[0]) | like(href, DATED[1]), DATED_POINTS).otherwise(0)
    for field, pattern, points in LIKENESS:
        score = score + F.when(like(text[field], pattern), points).otherwise(0)
    return score


def open_listings(links: DataFrame, patterns: list[str], year: int, key: str = "page_id") -> DataFrame:
    """(key, place, href, score) of a listing's links of this year or later: those that look open if there are any, in their order; else all, the likest first."""
    told = F.regexp_extract(F.concat_ws(" ", "title", "href"), r"(?<![A-Za-z0-9_])(20[0-9]{2})(?![A-Za-z0-9_])", 1).try_cast("int")
    rows = links.withColumn("score", exam_likeness(F.col("title"), F.col("href"))).where(F.coalesce(told >= year, F.lit(True)))
    rows = rows.withColumn("open", matches_any(F.concat_ws(" ", "title", "href"), patterns) & F.lit(bool(patterns)))
    some = F.max(F.col("open").cast("int")).over(W.partitionBy(key)) == 1
    rows = rows.withColumn("some", some).where(~F.col("some") | F.col("open"))
    order = W.partitionBy(key).orderBy(F.when(F.col("some"), 0).otherwise(-F.col("score")), "pos", "href")
    return rows.select(key, (F.row_number().over(order) - 1).alias("place"), "href", "score")
