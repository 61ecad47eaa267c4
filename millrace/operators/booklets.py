"""Exam booklets in several orders: questions of a booklet, grids of answers, the re-keying of all booklets to one order, editions and pass marks.

A document is one row; the order that a reader keeps within it (the next number or letter that is awaited, the grid's booklet) is a fold
over the document's lines. What joins documents (booklet, key, correspondence) is an equi-join on edition, booklet and number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import fold, let, squeeze, trim
from millrace.operators import tables as T
from millrace.operators.roles import has
from millrace.workspace import materialize

# Shape of the paper and marks to pass.
QUESTIONS, LETTERS, TYPES, CANONICAL = 80, "ABCD", (1, 2, 3, 4), 1
PASS_CORRECT, PASS_SCORE = 40, 6
LEAST_PROMPT, COVER = 20, 4000
# What lines of a booklet and a key look like.
FURNITURE = (
    r"^tipo\s+\w+\s*[–-]\s*p[áa]gina\s+\d+"
    r"|^\d{1,3}\s*[ºo°]?\s*exame\s+d[oe]\s+ordem"
    r"|^exame\s+de\s+ordem\s+unificado"
    r"|^ordem\s+dos\s+advogados\s+do\s+brasil"
    r"|^p[áa]gina\s+\d+\s+de\s+\d+"
    r"|^qualquer\s+semelhan[çc]a\s+nominal"
    r"|^tipo\s+\d+\s*[–-]"
)
NUMBER, OPTION = r"^\s*(\d{1,3})\s*$", r"^\s*\(?([A-D])\)\s*(.*)$"
PERCEPTION = r"question[áa]rio\s+de\s+percep[çc][ãa]o"
TYPE, GRID, NEXT_GRID = r"\btipo\s*(\d)\b", r"prova\s+tipo\s*(\d)\b", r"^prova\s+tipo\s*$"
CORRESPONDENCE, DEFINITIVE = r"tabela\s+de\s+correspond[êe]ncia", r"gabaritos?\s+definitivos?"
# Labels of documents, in the order of trial, and areas of the practical paper.
IGNORED = r"resultado|comunicado|locais?\s+de\s+(?:prova|aplica)|remarca|isen[çc][ãa]o|\bpne\b|atendimento\s+especial|relat[óo]rio|recursos?\b|inscri[çc]"
MODEL_ANSWERS, ANSWER_KEY, BOOKLET, NOTICE, FINAL = r"padr[ãa]o\s+de\s+respostas?", r"gabaritos?", r"caderno\s+de\s+provas?", r"\bedital\b", r"definitiv"
AREAS = {
    "B001": "Direito Administrativo",
    "B002": "Direito Civil",
    "B003": "Direito Constitucional",
    "B004": "Direito Empresarial",
    "B005": "Direito Penal",
    "B006": "Direito Tributário",
    "B007": "Direito do Trabalho",
}
LEGACY, ARABIC, ROMAN_EDITION = r"\b(2010)\s*[.\-]\s*([23])\b", r"\b(\d{1,2})\s*[ºo°]?\s*(?:eou\b|exame\b)", r"\b([IVXLC]{1,8})\s+(?:eou\b|exame\b)"
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
#: Editions that exist; those up to the last roman one are labelled in roman numerals, the first two by year.
EDITIONS, LAST_ROMAN = (1, 2, *range(4, 48)), 34


def _regex(pattern: str) -> str:
    from millrace.operators.curation import spark_regex

    return spark_regex(pattern)


def _first(c: Column, pattern: str, group: int = 1) -> Column:
    return let(F.regexp_extract(c, _regex(pattern), group), lambda found: F.when(found != "", found))


def _lines(text: Column) -> Column:
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n", "\n"), r"[\n\f]")


def _chain(candidates: Column, most: int) -> Column:
    """Places of the candidates (v, at) that continue the run 1, 2, 3, ...: each is the first of its value after the one before."""
    start = F.array().cast("array<int>")
    return F.aggregate(candidates, start, lambda found, c: F.when((c.v == F.size(found) + 1) & (F.size(found) < most), F.concat(found, F.array(c.at))).otherwise(found))


def _numbered(lines: Column, value) -> Column:
    """(v, at) of lines that have a value."""
    marked = F.transform(lines, lambda x, i: F.struct(value(x).cast("int").alias("v"), i.alias("at")))
    return F.filter(marked, lambda r: r.v.isNotNull())


def _between(lines: Column, start: Column, stop: Column) -> Column:
    """The lines after ``start`` and before ``stop``."""
    return F.slice(lines, (start + 2).cast("int"), (stop - start - 1).cast("int"))


def booklet_type(text: Column) -> Column:
    """The type printed on a cover, if it is one of the four."""
    found = _first(F.substring(text, 1, COVER), TYPE).cast("int")
    return F.when(found.isin(*TYPES), found)


def without_questionnaire(text: Column) -> Column:
    """The text up to the closing questionnaire: its heading, or if that stands in the first half, the next one in the second."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    place = lambda c: F.regexp_instr(c, F.lit(_regex(PERCEPTION)))
    late = let(place(F.substring(text, half + 1, 1 << 30)), lambda p: F.when(p > 0, F.substring(text, F.lit(1), half + p - 1)).otherwise(text))
    early = place(text)
    return F.when(early == 0, text).when((early - 1) * 2 < F.char_length(text), late).otherwise(F.substring(text, F.lit(1), early - 1))


def booklet_questions(booklets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, booklet, number, prompt, options, ok) of every question that a booklet heads; ok is false for one that does not parse.

    A question's number stands alone on its line, and numbers run 1, 2, 3 without a gap, so that a folio is none. Options are lines that begin A to D in turn.
    """
    lines = F.filter(_lines(without_questionnaire(F.regexp_replace(F.col("text"), "\r\n", "\n"))), lambda x: ~has(x, FURNITURE))
    rows = booklets.select(*keys, booklet_type(F.col("text")).alias("booklet"), lines.alias("lines"))
    heads = _chain(_numbered(F.col("lines"), lambda x: _first(x, NUMBER)), QUESTIONS)
    rows = rows.withColumn("heads", F.concat(heads, F.array(F.size("lines"))))
    # blocks are cut before they are dealt, so that no question carries its whole booklet
    block = lambda at, i: F.filter(_between(F.col("lines"), at, F.element_at("heads", i + 2)), lambda x: trim(x) != "")
    blocks = F.transform(F.slice("heads", F.lit(1), F.size("heads") - 1), block)
    rows = T.dealt(rows, [*keys, "booklet"], blocks, "at", "block").withColumn("number", F.col("at") + 1).drop("at")
    letter = lambda x: F.when(x.rlike(OPTION), F.instr(F.lit(LETTERS), F.regexp_extract(x, OPTION, 1)))
    marks = F.concat(_chain(_numbered(F.col("block"), letter), len(LETTERS)), F.array(F.size("block")))
    rows = rows.withColumn("marks", marks)
    joined = lambda xs: squeeze(F.array_join(xs, " "))

    def option(at: Column, i: Column) -> Column:
        own = F.regexp_extract(F.element_at("block", at + 1), OPTION, 2)
        return joined(F.concat(F.array(own), _between(F.col("block"), at, F.element_at("marks", i + 2))))

    options = F.transform(F.slice("marks", F.lit(1), F.size("marks") - 1), option)
    prompt = joined(F.slice("block", F.lit(1), F.element_at("marks", 1)))
    rows = rows.select(*keys, "booklet", "number", prompt.alias("prompt"), options.alias("options"))
    distinct = F.size(F.array_distinct(F.transform("options", F.lower))) == len(LETTERS)
    ok = (F.size("options") == len(LETTERS)) & (F.char_length("prompt") >= LEAST_PROMPT) & ~F.array_contains("options", "") & distinct
    return rows.withColumn("ok", ok)


_STATE = "struct<booklet:int,order:int,pending:array<int>,found:array<struct<booklet:int,number:int,answer:int>>>"


def _grid_step(state: Column, line: Column) -> Column:
    none = F.array().cast("array<int>")
    line = trim(line)
    known = lambda n: F.when(n.isin(*TYPES), n)
    made = lambda booklet, pending, order=state.order, found=state.found: F.struct(booklet.cast("int").alias("booklet"), order.alias("order"), pending.alias("pending"), found.alias("found"))
    numbers = F.transform(F.split(line, r"\s+"), lambda x: x.try_cast("int"))
    letters = F.transform(F.split(F.upper(line), r"\s+"), lambda x: F.when(F.char_length(x) == 1, F.instr(F.lit(LETTERS), x) - 1))
    fits = line.rlike(r"^(?i)[A-D\s]+$") & (F.size(state.pending) == F.size(letters)) & ~F.exists(letters, lambda x: x.isNull())
    pairs = F.filter(F.zip_with(state.pending, letters, lambda n, a: F.struct(state.booklet.alias("booklet"), n.alias("number"), a.alias("answer"))), lambda p: p.number.between(1, QUESTIONS))
    heading = _first(line, GRID).cast("int")
    return (
        F.when(heading.isNotNull(), made(known(heading), none))
        .when(has(line, NEXT_GRID), made(known(state.order + 1), none, state.order + 1))
        .when(line.rlike("^[1-4]$") & (F.size(state.pending) == 0), made(line.try_cast("int"), none))
        .when(state.booklet.isNull(), state)
        .when(line.rlike(r"^\d[\d\s]*$"), made(state.booklet, numbers))
        .when(fits, made(state.booklet, none, found=F.concat(state.found, pairs)))
        .otherwise(made(state.booklet, none))
    )


def answer_grids(keys_: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, booklet, number, answer, definitive): answer grids, a row of numbers over a row of letters as wide, under their booklet's heading.

    A heading names its booklet, or is the next one; a lone digit with no row of numbers above it names one too. Of a number that stands twice the last counts.
    """
    lines = _lines(F.col("text"))
    cut = F.get(F.filter(F.transform(lines, lambda x, i: F.when(has(x, CORRESPONDENCE), i)), lambda i: i.isNotNull()), F.lit(0))
    lines = let(lines, lambda ls: F.slice(ls, F.lit(1), F.coalesce(cut, F.size(ls))))
    start = F.from_json(F.lit('{"order":0,"pending":[],"found":[]}'), _STATE)
    found = F.aggregate(lines, start, lambda s, x: _grid_step(s, x).cast(_STATE), lambda s: s.found)
    rows = T.dealt(keys_, [*keys, has(F.col("text"), DEFINITIVE).alias("definitive")], found, "place", "a")
    return rows.groupBy(*keys, "a.booklet", "a.number", "definitive").agg(F.max_by("a.answer", "place").alias("answer"))


def correspondences(keys_: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, canonical, booklet, number): rows of four numbers (or several such side by side) below the table's heading; the last of a canonical number counts."""
    rows = keys_.select(*keys, F.posexplode(_lines(F.col("text"))).alias("place", "line"))
    headings = keys_.select(*keys, F.get(F.filter(F.transform(_lines(F.col("text")), lambda x, i: F.when(has(x, CORRESPONDENCE), i)), lambda i: i.isNotNull()), F.lit(0)).alias("from")).where("from IS NOT NULL")
    rows = rows.join(headings, keys).where("place > from").withColumn("line", trim(F.col("line"))).where(F.col("line").rlike(r"^\d[\d\s]*$"))
    numbers = F.transform(F.split("line", r"\s+"), lambda x: x.try_cast("int"))
    rows = rows.select(*keys, "place", numbers.alias("numbers")).where(F.size("numbers") % len(TYPES) == 0)
    entry = F.transform(F.sequence(F.lit(0), (F.size("numbers") / len(TYPES) - 1).cast("int")), lambda i: F.slice("numbers", i * len(TYPES) + 1, F.lit(len(TYPES))))
    rows = rows.select(*keys, "place", F.posexplode(entry).alias("part", "entry")).where(F.forall("entry", lambda n: n.between(1, QUESTIONS)))
    rows = rows.groupBy(*keys, F.get("entry", F.lit(0)).alias("canonical")).agg(F.max_by("entry", F.struct("place", "part")).alias("entry"))
    return rows.select(*keys, "canonical", F.posexplode("entry").alias("i", "number")).select(*keys, "canonical", F.get(F.array(*map(F.lit, TYPES)), F.col("i")).alias("booklet"), "number")


def canonical_numbers(booklets: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, booklet, number, canonical) of rows (keys, booklet, number): the canonical booklet keeps its numbers, others go through the table or have none.

    If the table gives a booklet's number to two canonical ones, the later counts.
    """
    other = table.where(F.col("booklet") != CANONICAL).groupBy(*keys, "booklet", "number").agg(F.max("canonical").alias("canonical"))
    own = booklets.where(F.col("booklet") == CANONICAL).withColumn("canonical", F.col("number"))
    # merge joins here and below: files of such regular numbers take less than a byte a row, so a broadcast planned by their size fills the driver
    return own.unionByName(booklets.where(F.col("booklet") != CANONICAL).join(other.hint("merge"), [*keys, "booklet", "number"], "left"))


def rekeyed_questions(questions: DataFrame, answers: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Parsed questions under their canonical number with correct_index and status: ok, annulled (the key has no answer) or unkeyed (no canonical number).

    A booklet without answers, or one that is not canonical in an edition without a table, gives nothing.
    """
    # each is read several times, and a filter on what reading gives would read again: written once
    answers, table = materialize(answers, "answers"), materialize(table, "correspondence")
    keyed = canonical_numbers(answers.select(*keys, "booklet", "number", "answer"), table, keys).where("canonical IS NOT NULL")
    keyed = keyed.groupBy(*keys, "booklet", "canonical").agg(F.max("answer").alias("correct_index"))
    keyed = materialize(keyed, "keyed")
    usable = keyed.select(*keys, "booklet").distinct()
    questions = materialize(questions, "questions")
    rows = canonical_numbers(questions.where("ok AND booklet IS NOT NULL").join(usable.hint("merge"), [*keys, "booklet"], "left_semi"), table, keys)
    rows = rows.join(keyed.hint("merge"), [*keys, "booklet", "canonical"], "left")
    status = F.when(F.col("canonical").isNull(), "unkeyed").when(F.col("correct_index").isNull(), "annulled").otherwise("ok")
    return rows.withColumn("status", status)


# --- editions ----------------------------------------------------------------------------------------


def roman_number(c: Column) -> Column:
    """The value of a roman numeral; null for other letters."""
    values = F.transform(F.filter(F.split(F.lower(c), ""), lambda x: x != ""), lambda x: F.element_at(F.create_map(*[F.lit(v) for p in ROMAN.items() for v in p]), x))
    total = F.aggregate(F.transform(values, lambda v, i: F.when(v < F.coalesce(F.get(values, i + 1), F.lit(0)), -v).otherwise(v)), F.lit(0), lambda a, v: a + v)
    return F.when(total > 0, total)


def _to_roman(n: int) -> str:
    out = ""
    for value, sign in ((50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        out, n = out + sign * (n // value), n % value
    return out


def edition_label(n: int) -> str:
    return {1: "2010.2", 2: "2010.3"}.get(n) or (_to_roman(n) if n <= LAST_ROMAN else f"{n}º")


def edition(text: Column) -> Column:
    """The number of the edition that a text names: by year, in figures, or in roman numerals as that edition is labelled."""
    exists = lambda n: F.when(n.isin(*EDITIONS), n)

    def of(t: Column) -> Column:
        roman = _first(t, ROMAN_EDITION)
        labels = F.create_map(*[x for n in EDITIONS for x in (F.lit(n), F.lit(edition_label(n)))])
        by_roman = let(exists(roman_number(roman)), lambda n: F.when(F.lower(F.element_at(labels, n)) == F.lower(roman), n))
        legacy = _first(t, LEGACY, 2)
        return F.when(legacy == "2", 1).when(legacy == "3", 2).otherwise(F.coalesce(exists(_first(t, ARABIC).cast("int")), by_roman))

    return let(squeeze(text), of)


def practical_area(text: Column) -> Column:
    """The code of the practical paper's area: printed, else the longest area name that the text holds."""

    def of(t: Column) -> Column:
        printed = _first(t, r"\b(B00[1-7])\b")
        slug = F.regexp_replace(fold(t), "[^a-z0-9]+", "-")
        out = F.when(printed.isNotNull(), F.upper(printed))
        for code, name in sorted(AREAS.items(), key=lambda a: -len(a[1])):
            plain = name.translate(str.maketrans("áç", "ac")).lower().replace(" ", "-")
            out = out.when(slug.contains(plain), code)
        return out

    return let(squeeze(text), of)


def document_class(label: Column, href: Column) -> Column:
    """struct(kind, phase, booklet, area, definitive) of a document by its label and address; null for what is not one of the paper's."""
    text = squeeze(F.concat(label, F.lit(" "), F.coalesce(F.try_url_decode(F.replace(href, F.lit("+"), F.lit("%2B"))), href)))

    def made(kind: str, phase: str | None, booklet: Column | None = None, area: Column | None = None, final: Column | None = None) -> Column:
        none = F.lit(None)
        return F.struct(
            F.lit(kind).alias("kind"),
            F.lit(phase).cast("string").alias("phase"),
            (none if booklet is None else booklet).cast("int").alias("booklet"),
            (none if area is None else area).cast("string").alias("area"),
            (F.lit(False) if final is None else final).alias("definitive"),
        )

    def of(t: Column) -> Column:
        final, type_, area = has(t, FINAL), _first(t, r"tipo\s*(\d)\b"), practical_area(t)
        booklet = F.when(type_.isNotNull(), made("prova", "objective", type_)).when(area.isNotNull(), made("prova", "practical", area=area))
        return (
            F.when((t == "") | has(label, IGNORED), None)
            .when(has(t, MODEL_ANSWERS), made("gabarito", "practical", area=area, final=final))
            .when(has(t, ANSWER_KEY), made("gabarito", "objective", final=final))
            .when(has(t, BOOKLET), booklet)
            .when(has(t, NOTICE), made("edital", None))
        )

    return let(text, of)


def passed(correct: Column, score: Column) -> Column:
    """Whether both papers are passed: 40 of 80, and 6 of 10 without rounding."""
    return (correct >= PASS_CORRECT) & (score >= PASS_SCORE)


#: Phases of an edition, as slugs and titles name them.
PHASES = {"objective": ("1-fase", "1ª fase (prova objetiva)"), "practical": ("2-fase", "2ª fase (prático-profissional)")}


def catalogue(numbers: DataFrame) -> DataFrame:
    """(number, phase, status, slug, title) of the editions (number) that exist; only the newest is open."""
    from millrace.operators.syllabus import slug_key

    labels = F.create_map(*[x for n in EDITIONS for x in (F.lit(n), F.lit(edition_label(n)))])
    rows = numbers.where(F.col("number").isin(*EDITIONS)).withColumn("label", F.element_at(labels, F.col("number").cast("int")))
    phases = F.explode(F.array(*[F.struct(F.lit(p).alias("phase"), F.lit(s).alias("suffix"), F.lit(t).alias("long")) for p, (s, t) in PHASES.items()]))
    rows = rows.select("number", "label", phases.alias("p"))
    status = F.when(F.col("number") >= max(EDITIONS), "open").otherwise("closed")
    return rows.select("number", "p.phase", status.alias("status"), F.concat_ws("-", F.lit("oab"), slug_key(F.col("label")), "p.suffix").alias("slug"), F.concat("label", F.lit(" Exame de Ordem Unificado — "), "p.long").alias("title"))
