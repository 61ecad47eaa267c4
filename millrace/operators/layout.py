"""Text of laid-out pages: spans to lines, lines to paragraphs, paragraphs to headings of three levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import let, trim
from millrace.operators import tables as T
from millrace.operators.exams import reading_order

# Pages that are read unless all are asked for, lines that may be headings, gaps and sizes relative to the median.
MOST_PAGES, LONGEST_HEADING, LONGEST_LINE, LONGEST_LARGE, LONGEST_BOLD = 300, 120, 90, 80, 60
GAP, LARGE, LEVELS, BODY = 1.4, 1.15, ((1.5, 1), (1.3, 2)), 12.0
_LINE = "struct<text:string,x0:double,y0:double,x1:double,y1:double,size:double,bold:boolean>"
_STATE = f"struct<done:array<{_LINE}>,at:{_LINE}>"


def lines_of_spans(spans: DataFrame, most_pages: int | None = MOST_PAGES) -> DataFrame:
    """(doc, page, line, text, x0, y0, x1, y1, size, bold): the spans of a line joined, its largest size, and whether any of its fonts is bold.

    ``spans`` has doc, page, line, span, text, size, font and the line's box. Blank lines are left out, and pages beyond ``most_pages``; None reads all.
    """
    spans = spans if most_pages is None else spans.where(F.col("page") <= most_pages)
    parts = F.array_sort(F.collect_list(F.struct("span", F.coalesce("text", F.lit("")).alias("text"))))
    box = [F.first(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    rows = spans.groupBy("doc", "page", "line").agg(
        trim(F.array_join(F.transform(parts, lambda s: s.text), "")).alias("text"), *box,
        F.max(F.when(F.col("size") != 0, F.col("size").cast("double"))).alias("size"), F.coalesce(F.bool_or(F.lower("font").contains("bold")), F.lit(False)).alias("bold"),
    )
    return rows.where("text <> ''")


def middle(values: Column) -> Column:
    """The upper median of the values that are not null."""
    return let(F.array_sort(F.filter(values, lambda v: v.isNotNull())), lambda s: F.get(s, F.floor(F.size(s) / 2).cast("int")))


def heading_like(line: Column, body: Column) -> Column:
    """Whether a line stands for itself: nine letters in ten capitals, or larger than the page's body, or short and bold."""
    text = trim(line.text)
    letters, capitals = F.char_length(F.regexp_replace(text, r"\P{L}", "")), F.char_length(F.regexp_replace(text, r"[^\p{Lu}]", ""))
    upper = (letters >= 3) & (capitals >= 0.9 * letters)
    large = F.coalesce((body > 0) & (line["size"] > 0) & (line["size"] >= body * LARGE), F.lit(False)) & (F.char_length(text) <= LONGEST_LARGE)
    return (text != "") & (F.char_length(text) <= LONGEST_LINE) & (upper | large | (line.bold & (F.char_length(text) <= LONGEST_BOLD)))


def _joined(state: Column, line: Column, body: Column, height: Column) -> Column:
    at = state.at
    gap = line.y0 - at.y1
    goes_on = (gap >= 0) & (gap < GAP * height) & ~heading_like(at, body) & ~heading_like(line, body)
    before = F.rtrim(at.text)
    first = F.substring(line.text, 1, 1)
    # a hyphen before a small letter parts a word
    hyphen = before.endswith("-") & (first == F.lower(first)) & (first != F.upper(first))
    text = F.when(hyphen, F.concat(F.substring(before, F.lit(1), F.char_length(before) - 1), F.ltrim(line.text))).otherwise(F.concat(before, F.lit(" "), F.ltrim(line.text)))
    more = F.struct(text.alias("text"), F.least(at.x0, line.x0).alias("x0"), at.y0.alias("y0"), F.greatest(at.x1, line.x1).alias("x1"), line.y1.alias("y1"), F.coalesce(at["size"], line["size"]).alias("size"), (at.bold | line.bold).alias("bold"))
    return F.when(at.isNull(), F.struct(state.done.alias("done"), line.alias("at"))).when(goes_on, F.struct(state.done.alias("done"), more.alias("at"))).otherwise(F.struct(F.concat(state.done, F.array(at)).alias("done"), line.alias("at"))).cast(_STATE)


def paragraphs(lines: DataFrame, width: float) -> DataFrame:
    """(doc, page, place, text, x0, y0, x1, y1, size, bold): lines in reading order (two columns are told from one), wrapped ones joined.

    A line goes on the one before it if it begins at most 1.4 median heights below and neither looks like a heading.
    """
    rows = lines.withColumn("id", F.concat_ws("/", F.col("doc").cast("string"), F.col("page").cast("string")))
    order = reading_order(rows, "id", "line", width).select("id", "line", "place")
    fields = F.struct(*[F.col(f.split(":")[0]) for f in _LINE[7:-1].split(",")]).cast(_LINE)
    pages = rows.join(order, ["id", "line"]).groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("place", fields.alias("line")))).alias("all"))
    pages = pages.select("doc", "page", F.transform("all", lambda r: r.line).alias("all"))
    body = middle(F.transform("all", lambda x: F.when(x["size"] != 0, x["size"])))
    height = middle(F.transform("all", lambda x: F.greatest(F.lit(1.0), x.y1 - x.y0)))
    pages = pages.withColumns({"body": body, "height": height})
    start = F.from_json(F.lit('{"done":[]}'), _STATE)
    merged = F.aggregate("all", start, lambda s, x: _joined(s, x, F.col("body"), F.col("height")), lambda s: F.concat(s.done, F.array(s.at)))
    return T.dealt(pages, ["doc", "page"], merged, "place", "p").select("doc", "page", "place", "p.*")


def blocks(found: DataFrame) -> DataFrame:
    """(doc, place, page, kind, level, text): paragraphs whose size is 1.15 times the document's median and more are headings, of level 1 from 1.5 times on, 2 from 1.3, else 3."""
    sizes = found.groupBy("doc").agg(middle(F.collect_list(F.when(F.col("size") > 0, F.col("size")))).alias("body"))
    rows = found.join(sizes, "doc").withColumn("body", F.coalesce("body", F.lit(BODY)))
    heading = F.coalesce((F.col("size") > 0) & (F.col("size") >= F.col("body") * LARGE), F.lit(False)) & (F.char_length("text") <= LONGEST_HEADING)
    level = F.when(~heading, None)
    for least, n in LEVELS:
        level = level.when(F.col("size") >= F.col("body") * least, n)
    place = F.row_number().over(W.partitionBy("doc").orderBy("page", "place"))
    return rows.where(trim(F.col("text")) != "").select("doc", place.alias("place"), "page", F.when(heading, "heading").otherwise("paragraph").alias("kind"), level.otherwise(3).alias("level"), "text")
