"""Exam papers: question blocks with lettered options, programme spans, reading order of page blocks, generated items and verdicts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import trim
from millrace.operators.items import unit
from millrace.operators.roles import has

# How questions and options begin; the fewest options.
QUESTION = re.compile(r"(?:^|\n)\s*(?:quest(?:ão|ao)\s*)?(\d{1,3})\s*[-.)]\s*", re.I)
OPTION = re.compile(r"(?:^|\s)\(([A-Ea-e])\)\s+|(?:^|\s)([A-Ea-e])\)\s+|(?:^|\n)\s*([A-Ea-e])\s*[.)]\s+")
LEAST_OPTIONS = 4
PROGRAMME_START = r"conte[úu]dos?\s+program[áa]ticos?|programas?\s+das?\s+provas?|programa\s+de\s+prova"
PROGRAMME_HEADING = r"^\s*(?:anexo\s+\S+\s*[-–:]\s*)?(?:conte[úu]dos?\s+program[áa]ticos?|programas?\s+das?\s+provas?(?:\s+e\s+\w+)?)\s*:?\s*$"
PROGRAMME_REFERENCE = r"\b(?:no|do|deste|constantes?\s+(?:do|no)|especificad[oa]s?\s+no|previst[oa]s?\s+no)\s+anexo\b|cada\s+cargo|item\s+\d"
PROGRAMME_STOP = r"^\s*anexo\s+([ivx]+|\d+)\b|^\s*(cronograma|modelo\s+de|requerimento|laudo\s+m[ée]dico|rela[çc][ãa]o\s+de\s+exames)"
ANNEX = r"^\s*anexo\s+([ivx]+|\d+)\b"


def _squeezed(text: str) -> str:
    return " ".join(text.split())


def _choices(block: str) -> tuple[str, list[str]] | None:
    """Prompt and options of a block whose markers run a, b, c, d and on; None for prose."""
    marks = [m for n, m in enumerate(OPTION.finditer(block)) if (m[1] or m[2] or m[3]).lower() == "abcde"[n : n + 1]]
    if len(marks) < LEAST_OPTIONS:
        return None
    ends = [m.start() for m in marks[1:]] + [len(block)]
    parts = [_squeezed(block[: marks[0].start()])] + [_squeezed(block[m.end() : e]) for m, e in zip(marks, ends)]
    return (parts[0], parts[1:]) if all(parts) else None


def blocks_of(text: str | None) -> list[tuple[int, str, list[str]]]:
    """(number, prompt, options) of each question; a number counts where it first stands, and a decimal number heads nothing."""
    text = (text or "").replace("\r\n", "\n")
    heads = {}
    for m in QUESTION.finditer(text):
        if int(m[1]) >= 1 and not text[m.end() : m.end() + 1].isdigit():
            heads.setdefault(int(m[1]), m)
    ordered = list(heads.items())
    ends = [m.start() for _, m in ordered[1:]] + [len(text)]
    found = ((number, _choices(text[m.end() : end].strip())) for (number, m), end in zip(ordered, ends))
    return [(number, *choice) for number, choice in found if choice]


def question_blocks(papers: DataFrame, key: str, text: str) -> DataFrame:
    """(key, number, prompt, options) of every question of every paper."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(k, *b) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for b in blocks_of(t)]
            columns = list(zip(*rows)) or [[], [], [], []]
            kinds = (batch.schema.field(0).type, pa.int32(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [key, "number", "prompt", "options"])

    kind = papers.schema[key].dataType.simpleString()
    return papers.select(key, text).mapInArrow(run, f"{key} {kind}, number int, prompt string, options array<string>")


PASSAGE = re.compile(r"Texto\s+para\s+as\s+quest(?:ões|oes)\s+(\d+)\s+a\s+(\d+)\s*[:.\-]?\s*", re.I)
HEADER = re.compile(r"(?:^|\n)\s*(?:quest(?:ão|ao)\s*)?(\d{1,3})\s*[-.)]\s+", re.I)


def passages_of(text: str | None) -> dict[int, str]:
    """The passage that each question shares: what stands between its announcement and the next question. Of two for a question the later counts."""
    text, found = (text or "").replace("\r\n", "\n"), {}
    for m in PASSAGE.finditer(text):
        first, last = int(m[1]), int(m[2])
        after = HEADER.search(text, m.end())
        # a header at the very start of what follows needs the line end before it
        passage = _squeezed(text[m.end() : after.start() if after else len(text)])
        if 1 <= first <= last and passage:
            found |= dict.fromkeys(range(first, last + 1), passage)
    return found


def passages(papers: DataFrame, key: str, text: str) -> DataFrame:
    """(key, number, passage) of every question that shares a passage."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(k, n, p) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for n, p in passages_of(t).items()]
            columns = list(zip(*rows)) or [[], [], []]
            kinds = (batch.schema.field(0).type, pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [key, "number", "passage"])

    return papers.select(key, text).mapInArrow(run, f"{key} {papers.schema[key].dataType.simpleString()}, number int, passage string")


def keyed_questions(blocks: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Questions with distinct options and a known answer: correct_index (null if annulled) and status. ``keys`` has key, number, answer."""
    tidy = F.transform("options", lambda o: F.lower(trim(o)))
    rows = blocks.where(F.size(F.array_distinct(tidy)) == F.size("options")).join(keys, [key, "number"])
    index = F.ascii("answer") - F.lit(ord("a"))
    void = F.col("answer") == "annulled"
    return rows.where(void | (index < F.size("options"))).select(key, "number", "prompt", "options", F.when(~void, index).alias("correct_index"), F.when(void, "annulled").otherwise("ok").alias("status"))


def programme_span(sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """The sections of a document from the programme's start to its stop. ``sections`` has key, ordinal, heading and text.

    A heading that is the programme's title starts it, else the first opening that names it without merely referring to it; another annex
    or a heading of another kind stops it.
    """
    heading = F.coalesce("heading", F.lit(""))
    annex = lambda c: F.nullif(F.lower(F.regexp_extract(c, "(?iu)" + ANNEX.replace(r"\b", r"(?![A-Za-z0-9_])"), 1)), F.lit(""))
    opening = F.concat(trim(heading), F.lit("\n"), F.substring("text", 1, 240))
    rows = sections.withColumns(
        {
            "strong": has(trim(heading), PROGRAMME_HEADING),
            "weak": has(opening, PROGRAMME_START) & ~has(opening, PROGRAMME_REFERENCE),
            "annex": F.coalesce(annex(heading), annex(F.substring_index("text", "\n", 1))),
            "own_annex": annex(heading),
            "stops": has(heading, PROGRAMME_STOP) & ~has(heading, PROGRAMME_START),
        }
    )
    whole = W.partitionBy(key)
    at = lambda c: F.min(F.when(F.col(c), F.col("ordinal"))).over(whole)
    rows = rows.withColumn("start", F.coalesce(at("strong"), at("weak"))).where(F.col("ordinal") >= F.col("start"))
    rows = rows.withColumn("start_annex", F.max(F.when(F.col("ordinal") == F.col("start"), F.col("own_annex"))).over(whole))
    ends = (F.col("ordinal") > F.col("start")) & (F.coalesce(F.col("annex") != F.coalesce("start_annex", F.lit("")), F.lit(False)) | F.col("stops"))
    rows = rows.withColumn("stop", F.min(F.when(ends, F.col("ordinal"))).over(whole))
    return rows.where(F.col("stop").isNull() | (F.col("ordinal") < F.col("stop"))).select(key, "ordinal", "heading")


def reading_order(blocks: DataFrame, key: str, block: str, width: float) -> DataFrame:
    """Place of each block (page, x0, y0, x1) in its document: left column, then right, where the blocks stand in two columns."""
    middle, centre = width / 2, (F.col("x0") + F.col("x1")) / 2
    rows, whole = blocks.withColumn("c", centre), W.partitionBy(key)
    rows = rows.withColumns({"left": F.avg(F.when(F.col("c") < middle - 10, F.col("c"))).over(whole), "right": F.avg(F.when(F.col("c") > middle + 10, F.col("c"))).over(whole), "n": F.count("*").over(whole)})
    close = (F.abs(F.col("c") - F.col("left")) < 40) | (F.abs(F.col("c") - F.col("right")) < 40)
    rows = rows.withColumn("close", F.count_if(close).over(whole))
    two = (F.col("n") >= 4) & F.col("left").isNotNull() & F.col("right").isNotNull() & (F.col("close") >= 0.7 * F.col("n")) & (F.abs(F.col("left") - middle) >= 30) & (F.abs(F.col("right") - middle) >= 30)
    column = F.when(F.coalesce(two, F.lit(False)) & (F.abs(F.col("c") - F.col("left")) > F.abs(F.col("c") - F.col("right"))), 1).otherwise(0)
    return rows.withColumn("side", column).withColumn("place", F.row_number().over(whole.orderBy("side", "page", "y0", "x0", block))).select(key, block, "side", "place")


def generated_items(raw: Column, allowed: Column) -> Column:
    """The usable items of a reply (a JSON array): index in range, a reason for each wrong option, allowed units cited or else the first three."""
    kind = "array<struct<prompt:string,options:array<string>,correctIndex:int,knowledgeUnitIds:array<string>,distractorRationale:array<string>>>"

    def cited(item: Column) -> Column:
        own = F.filter(F.transform(item.knowledgeUnitIds, trim), lambda u: F.array_contains(allowed, u))
        units = F.when(F.size(own) > 0, own).otherwise(F.slice(allowed, 1, 3))
        return F.struct(trim(item.prompt).alias("prompt"), F.transform(item.options, trim).alias("options"), item.correctIndex.alias("correct_index"), units.alias("units"), F.transform(item.distractorRationale, trim).alias("rationale"))

    usable = lambda q: q.prompt.isNotNull() & (q.correct_index >= 0) & (q.correct_index < F.size(q.options)) & (F.size(q.units) > 0) & (F.size(q.rationale) >= F.size(q.options) - 1)
    return F.filter(F.transform(F.coalesce(F.from_json(raw, kind), F.from_json(F.lit("[]"), kind)), cited), lambda q: F.coalesce(usable(q), F.lit(False)))


def judge_verdict(score: Column, relevance: Column, durability: Column, grounding: Column, answer: Column, keyed: Column) -> Column:
    """struct(reasons, notes) of a judge's levels, each held within 0 to 1."""
    levels = {"overall": unit(score), "relevance": unit(relevance), "durability": unit(durability), "grounding": unit(grounding)}
    low = [F.when(v < 0.5, F.lit(f"jev_low_{k}")) for k, v in levels.items()]
    reasons = F.array_compact(F.array(F.lit("jev_scored"), *low, F.when(answer != keyed, F.lit("jev_answer_disagrees"))))
    text = F.concat_ws(", ", *(F.concat(F.lit(f"{'score' if k == 'overall' else k} "), F.format_string("%.2f", v)) for k, v in levels.items()), F.concat(F.lit("answer "), answer.cast("string")))
    return F.struct(reasons.alias("reasons"), text.alias("notes"))
