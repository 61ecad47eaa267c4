"""Text curation on columns: line cleaning, chunking, scores, classification, eligibility."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import B, ONE_SPACE, SPACES, count, let, share, squeeze, trim
from millrace.operators import tables as T
from millrace.workspace import discard, materialize

# The patterns and weights that define the scores. ``\b`` stands for an ASCII word boundary.
DEFINITION = r"\b(?:é\s+(?:o|a)\s+\w+\s+que|define-se|consiste em|caracteriza-se por)\b"
EXAMPLE = r"\b(?:por exemplo|ex\.:|exemplo:)\b"
RULE = r"\b(?:regra|deve|sempre|nunca|exceção)\b"
CLAIM_WORDS = r"art\.|lei|decreto"
CLAIM = rf"\b(?:{CLAIM_WORDS}|\d+%|\d{{4}})\b"
HEDGE = r"\b(?:pode ser|geralmente|em tese)\b"
LINK = r"https?://\S+|href\s*="
NOISE = r"[^\p{L}\p{N}\s.,;:!?\-—()\"'%$]"
META_PATTERNS = {
    "vacancy": r"\b(vagas?|cadastro de reserva|remunera[cç][aã]o|sal[aá]rio|taxa de inscri[cç][aã]o|isen[cç][aã]o|boleto|cart[aã]o de confirma[cç][aã]o|local de prova|convoca[cç][aã]o|homologa[cç][aã]o|posse)\b",
    "imperative": r"\bo candidato (dever[aá]|deve|n[aã]o poder[aá])\b|\b[eé] vedado\b|\bser[aá] eliminado\b",
    "org": r"\b(tribunal|secretaria|prefeitura|minist[eé]rio|instituto|fundação|autarquia|empresa p[uú]blica|cesgranrio|cebraspe|fgv|vunesp|fcc|cespe)\b",
    "edital": r"\bedital n[ºo°]?\b|\bretifica[cç][aã]o\b|\banexo\s+[IVXLC]+\b",
    "contact": r"\b\d{2}\s*\d{4,5}-?\d{4}\b|\b[\w.+-]+@[\w.-]+\.\w+\b|https?://\S+",
    "legal": r"\bart\.?\s*\d|\b§\s*\d|\binciso\b|\blei n[ºo°]?\b",
    "explain": r"\bpor exemplo\b|\bou seja\b|\bisto [eé]\b|\bdefine-se\b|\bconsiste (em|na|no)\b",
    "date": r"\b\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}\b|\b\d{1,2}\s+de\s+\w+\s+de\s+\d{4}\b",
    "currency": r"R\$\s*\d",
    "fee": r"\btaxa\b|\binscri",
    "option": r"(?m)^\s*[A-E]\)|\(\s*[A-E]\s*\)",
}
#: What a text of lower case holds if a pattern without sure words occurs in it.
META_MARKS = {
    "contact": lambda low: low.contains("@") | low.contains("http") | low.rlike("[0-9]{4}"),
    "legal": lambda low: (low.contains("art") & low.rlike(r"art\.?\s*[0-9]")) | low.contains("§") | low.contains("inciso") | low.contains("lei n"),
    "date": lambda low: low.rlike(r"[0-9][/.\-\s]"),
    "option": lambda low: low.contains(")"),
}
META_BIAS, META_THRESHOLD = -1.2, 0.35
META_WEIGHTS = {
    "date": 1.4, "currency": 1.6, "vacancy": 2.2, "imperative": 1.8, "org": 1.1, "edital": 1.5,
    "contact": 1.3, "list_shape": 1.7, "legal": -1.4, "explain": -1.6, "question": -0.4,
}
NAVIGATION = r"^(home|início|menu|navigation|skip to content)$|^(cookies?|aceitar cookies|política de privacidade)$|^(compartilhar|share on|siga-nos|follow us)$"
LANGUAGE_WORDS = {"pt": r"\b(de|da|do|para|com|não|questão|prova|concurso)\b", "en": r"\b(the|and|for|with|question|exam)\b"}
FLAG_WORDS = {
    "pt": r"\b(de|da|do|para|com|não|questão|prova|concurso|edital|direito|administração)\b",
    "en": r"\b(the|and|for|with|question|exam|which|their)\b",
    "es": r"\b(el|los|las|una|para|concurso|derecho|según)\b",
}


def spark_regex(pattern: str) -> str:
    return "(?iu)" + pattern.replace(r"\b", B)


def sql_regex(pattern: str) -> str:
    return "(?i)" + pattern.replace("'", "''")


def lowered_regex(pattern: str) -> str:
    """The pattern for lower-case text: no case folding, and a plain look-behind where a leading boundary meets ASCII word characters only."""
    lower = re.sub(r"(?<!\\)[A-Z]", lambda m: m[0].lower(), pattern)

    def simple(m: re.Match) -> str:
        rest = lower[m.end() :]
        if rest.startswith("("):
            depth, starts, at = 0, [], 0
            body = rest[3:] if rest.startswith("(?:") else rest[1:]
            starts.append(body[:2])
            for at, c in enumerate(body):
                depth += (c == "(") - (c == ")")
                if depth < 0:
                    break
                if c == "|" and depth == 0:
                    starts.append(body[at + 1 : at + 3])
        else:
            starts = [rest[:2]]
        plain = all(x and (x[0] in "abcdefghijklmnopqrstuvwxyz0123456789_" or x in (r"\d", r"\w")) for x in starts)
        return "(?<![a-z0-9_])" if plain else B

    return re.sub(r"\\b", simple, lower)


def alternatives(pattern: str) -> list[str]:
    """The pattern's outer alternatives, those of one group between word boundaries too. Brackets must be balanced, and none be escaped."""
    inner = re.fullmatch(r"\\b\((?:\?:)?(.*)\)\\b", pattern)
    out, depth = [""], 0
    for c in inner[1] if inner else pattern:
        depth += (c in "([") - (c in ")]")
        if c == "|" and depth == 0:
            out.append("")
        else:
            out[-1] += c
    return out


def sure_words(pattern: str) -> list[list[str]]:
    """For each alternative the runs of small ASCII letters that the folded text of its every match holds; none if some alternative has no such run."""
    if re.search(r"\\[()\[\]|]", pattern):
        return []
    out = []
    for part in alternatives(pattern):
        bare = re.sub(r"\[[^\]]*\]|\\.", " ", part)
        while "(" in bare and bare != (less := re.sub(r"\([^()]*\)", " ", bare)):
            bare = less
        runs = re.findall(r"[a-z]{2,}", re.sub(r".(?:[?*]|\{\d+(?:,\d*)?\})", " ", bare).lower())
        if "|" in bare or not runs:
            return []
        out.append(sorted(set(runs), key=lambda w: (-len(w), w)))
    return out


def folded(text: Column) -> Column:
    """Lower case in which every letter stands as the ASCII one that a pattern takes for the same whatever the case."""
    others = "ſıİ\u212a"
    rare = F.lit(False)
    for c in others:
        rare = rare | text.contains(c)
    return F.lower(F.when(rare, F.translate(text, others, "siik")).otherwise(text))


def may_match(low: Column, pattern: str) -> Column:
    """False only where the pattern cannot occur in a text that comes folded: plain words are sought many times faster than patterns."""
    words = sure_words(pattern)
    out = F.lit(not words)
    for runs in words:
        all_ = low.contains(runs[0])
        for w in runs[1:]:
            all_ = all_ & low.contains(w)
        out = out | all_
    return out


def hits(text: Column, pattern: str) -> Column:
    """How often the pattern occurs, whatever the case."""
    return let(F.lower(text), lambda low: lower_hits(low, pattern))


def lower_hits(low: Column, pattern: str, mark: Callable[[Column], Column] | None = None) -> Column:
    """How often the pattern occurs in a text of lower case; ``mark`` says where it may, of patterns without sure words."""
    found = count(low, lowered_regex(pattern))
    if mark is None and not sure_words(pattern):
        return found
    return F.when(~(mark(low) if mark else may_match(low, pattern)), 0).otherwise(found)


# --- line cleaning ---------------------------------------------------------------------------------


def lines_of(docs: DataFrame, separator: str = "\n") -> DataFrame:
    """doc_id, pos, line."""
    return docs.select("doc_id", F.posexplode(F.split("text", separator)).alias("pos", "line"))


def is_boilerplate(line: Column) -> Column:
    """Navigation words, mostly link characters, several link markers, or hardly any letters."""

    def judged(x: Column) -> Column:
        size = F.char_length(x)
        links = F.aggregate(F.regexp_extract_all(x, F.lit(r"(?i)(https?://\S+|www\.\S+)"), F.lit(1)), F.lit(0), lambda a, y: a + F.char_length(y))
        markers = count(x, r"https?://") + count(x, r"www\.")
        letters = F.char_length(F.regexp_replace(x, r"\P{L}+", ""))
        linked = let(F.lower(x), lambda low: low.contains("http") | low.contains("www."))
        found = linked & (((size > 0) & (links / F.greatest(size, F.lit(1)) > 0.5)) | ((markers >= 2) & (size < 160)))
        found = found | ((size > 0) & (letters / F.greatest(size, F.lit(1)) < 0.4))
        # no rule reaches longer lines, and navigation is a few words
        return F.when(size >= 200, False).otherwise(found | F.when(size > 40, False).otherwise(F.regexp_like(x, F.lit("(?iu)" + NAVIGATION))))

    return let(line, judged)


def is_garbage(line: Column) -> Column:
    """From 8 characters on: few letters among what is not space, no words, or words of a mean over 14."""
    mark = "\u0001"

    def judged(x: Column, rest: Column) -> Column:
        size, words = F.char_length(x), F.char_length(rest) - F.char_length(F.replace(rest, F.lit(mark), F.lit("")))
        # a mark in place of each word settles plain prose: words of a fit length that are three fifths of all characters. Two signs of the word class are no letters.
        odd = x.contains(mark) | x.contains("×") | x.contains("÷")
        plain = let(F.struct(words.alias("n"), (size - F.char_length(rest) + words).alias("chars")), lambda w: (w.n > 0) & (w.chars <= 14 * w.n) & (10 * w.chars >= 6 * size))
        solid = F.char_length(F.regexp_replace(x, r"\s", ""))
        letters = F.char_length(F.regexp_replace(x, r"\P{L}+", ""))
        found = F.regexp_extract_all(x, F.lit("([A-Za-zÀ-ÿ]{2,})"), F.lit(1))
        total = F.aggregate(found, F.lit(0), lambda a, y: a + F.char_length(y))
        bad = (solid == 0) | (letters / F.greatest(solid, F.lit(1)) < 0.6) | (F.size(found) == 0) | (total / F.greatest(F.size(found), F.lit(1)) > 14)
        return F.when(size < 8, False).when(plain & ~odd, False).otherwise(bad)

    return let(line, lambda x: let(F.struct(x.alias("x"), F.regexp_replace(x, "[A-Za-zÀ-ÿ]{2,}", mark).alias("rest")), lambda r: judged(r.x, r.rest)))


def is_page_number(line: Column) -> Column:
    return F.regexp_like(line, F.lit(r"(?iu)^\s*(P[aá]gina\s+)?\d+(\s*/\s*\d+)?\s*$"))


def line_key(line: Column, least_chars: int = 40, exempt: Column | None = None) -> Column:
    """What equal lines share, whatever their case and white space; null for short and ``exempt`` ones."""
    def key(x: Column) -> Column:
        # most lines have single plain spaces only; white space only shrinks
        one = F.when(x.contains("  ") | F.regexp_like(x, F.lit(ONE_SPACE.replace(" ", ""))), squeeze(x)).otherwise(trim(x))
        return F.when(F.char_length(x) >= least_chars, let(F.lower(one), lambda norm: F.when(F.char_length(norm) >= least_chars, F.xxhash64(norm))))

    return let(line, key) if exempt is None else F.when(~exempt, let(line, key))


def drop_repeated_lines(lines: DataFrame, domain: str, most_documents: int = 3, least_chars: int = 40, exempt: Column | None = None, key: str | None = None) -> DataFrame:
    """Drops a line that as many earlier documents of its domain already had; short and ``exempt`` ones stay.

    Documents arrive in doc_id order. A line goes from the first document on that is one too many; of a frequent line each task sends
    on only its first documents. Lines are gone through twice, so a stored table may bring its ``key`` (``line_key``) as a column.
    """
    marked = lines.withColumn("__key", line_key(F.col("line"), least_chars, exempt)) if key is None else lines.withColumnRenamed(key, "__key")
    keyed = marked.where("__key IS NOT NULL")
    rank = F.dense_rank().over(W.partitionBy(domain, "__key").orderBy("doc_id"))
    ranked = keyed.select(domain, "__key", "doc_id").withColumn("__rank", rank).where(F.col("__rank") <= most_documents + 1)
    late = ranked.where(F.col("__rank") == most_documents + 1).groupBy(domain, "__key").agg(F.min("doc_id").alias("__late"))
    early = keyed.join(late, [domain, "__key"], "left").where(F.col("__late").isNull() | (F.col("doc_id") < F.col("__late")))
    columns = [c for c in marked.columns if c != "__key"]
    return early.select(*columns).unionByName(marked.where("__key IS NULL").select(*columns))


def mark_page_artifacts(lines: DataFrame) -> DataFrame:
    """Sets kind to page_artifact on page numbers, and on short lines that stand as often as on three fifths of a document's pages (three at least); headings stay."""
    norm = F.lower(trim(F.col("line")))
    short = let(norm, lambda x: F.when(F.char_length(x) < 80, x))
    marked = lines.withColumns({"kind": F.when(is_page_number(F.col("line")), "page_artifact").otherwise(F.col("kind")), "__norm": short})
    # the lines of a document meet once and stand in the order of both windows
    marked = marked.repartition("doc_id").sortWithinPartitions("doc_id", "__norm")
    pages = F.size(F.collect_set("page").over(W.partitionBy("doc_id")))
    times = F.count("page").over(W.partitionBy("doc_id", "__norm"))
    often = (F.col("__pages") >= 3) & F.col("__norm").isNotNull() & (F.col("__times") >= F.greatest(F.lit(2), F.floor(0.6 * F.col("__pages"))))
    out = marked.withColumn("__pages", pages).withColumn("__times", times)
    return out.withColumn("kind", F.when(often & (F.col("kind") != "heading"), "page_artifact").otherwise(F.col("kind"))).drop("__norm", "__pages", "__times")


def clean_blocks(blocks: DataFrame, domain: str, least: int = 400) -> DataFrame:
    """Blocks (doc_id, pos, page, kind, line) cleaned by all steps in their fixed order; documents left with under ``least`` characters go.

    Encoding, ligatures, hyphens, boilerplate, page numbers, page artifacts, garbage, language (a flag), repeated blocks, white space, minimum.
    """
    line = F.col("line")
    # zero-width spaces go with the encoding, so a line of them is empty before it too
    filled = blocks.where(F.btrim(line, F.lit(SPACES + "\u200b")) != "")
    coded = materialize(filled.withColumn("line", F.when(is_encoded_plainly(line), line).otherwise(drop_private_use(clean_encoding(line)))), "cleaned")
    solid = repair_hyphens(coded).where(~is_boilerplate(trim(line)))
    kept = mark_page_artifacts(solid).where(~is_garbage(trim(line)))
    exempt = F.col("kind").isin("heading", "table")
    # what is asked of a line is written beside it, as its row is read twice
    marked = materialize(kept.withColumns({"foreign_text": foreign_flag(line), "__line": line_key(line, exempt=exempt)}), "cleaned")
    discard(coded)
    once = drop_repeated_lines(marked, domain, key="__line").withColumn("line", clean_whitespace(line)).where("line <> ''")
    chars = F.sum(F.char_length("line")).over(W.partitionBy("doc_id"))
    return once.withColumn("__chars", chars).where(F.col("__chars") >= least).drop("__chars")


def clean_whitespace(text: Column) -> Column:
    def cleaned(x: Column) -> Column:
        one = F.when(x.contains("  ") | x.contains("\t"), F.regexp_replace(x, "[ \t]{2,}|\t", " ")).otherwise(x)
        kept = lambda y: F.array_join(F.filter(F.transform(F.split(y, "\n"), trim), lambda z: z != ""), "\n")
        return let(one, lambda y: F.when(x.contains("\r"), kept(F.regexp_replace(y, "\r\n?", "\n"))).when(x.contains("\n"), kept(y)).otherwise(trim(y)))

    return let(text, cleaned)


#: A character that canonical composition may change or join: none below the combining marks, and no dash, quote or bullet.
COMPOSING = r"[^\x{0}-\x{2FF}\x{2010}-\x{2027}]"
#: One that any step of the encoding may change: these, dashes and quotes, and the space that does not break.
RECODED = r"[^\x{0}-\x{9F}\x{A1}-\x{2FF}]"


def is_encoded_plainly(text: Column) -> Column:
    """Neither ``clean_encoding`` nor ``drop_private_use`` changes the text."""
    return ~F.regexp_like(text, F.lit(RECODED))


def nfc(text: Column) -> Column:
    """Canonical composition. Only texts with a character that it may change take the way through Python, in batches."""

    @F.pandas_udf("string")
    def composed(texts: pd.Series) -> pd.Series:
        import unicodedata

        return texts.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")

    beyond = F.regexp_like(text, F.lit(COMPOSING))
    return F.coalesce(composed(F.when(beyond, text)), text)


def clean_encoding(text: Column) -> Column:
    """Composed characters; NBSP to space, zero-width characters dropped, typographic quotes and dashes to ASCII, two ligatures."""
    plain = F.translate(nfc(text), "\u00a0\u201c\u201d\u2018\u2019\u2013\u2014\u200b\ufeff", " \"\"''--")
    return F.replace(F.replace(plain, F.lit("\ufb01"), F.lit("fi")), F.lit("\ufb02"), F.lit("fl"))


def drop_private_use(text: Column) -> Column:
    """Runs of two private-use characters and more are one space."""
    return F.regexp_replace(text, r"[\x{E000}-\x{F8FF}]{2,}", " ")


# Word parts over a line end, and over white space.
HYPHENS = (r"(\w+)-\s*\n\s*(\w+)", r"(\w+)-\s+(\w+)")


def joined_hyphens(lines: list[str]) -> list[str]:
    """The lines of a document with word parts joined where the second begins in lower case or the document has the joined word."""
    corpus = " ".join(lines).lower()

    def join(m: re.Match) -> str:
        return m[1] + m[2] if m[2][0].islower() or (m[1] + m[2]).lower() in corpus else m[0]

    return [re.sub(HYPHENS[1], join, re.sub(HYPHENS[0], join, x)) for x in lines]


def repair_hyphens(blocks: DataFrame) -> DataFrame:
    """Joins hyphenated words. Documents with a break to judge are taken whole, a document at a time; all others pass by."""
    breaks = blocks.where(F.col("line").contains("-") & F.regexp_like("line", F.lit(r"(?U)\w-\s+\w"))).select("doc_id").distinct()
    if breaks.isEmpty():
        return blocks
    columns, kinds = blocks.columns, ", ".join(f"`{c}` {blocks.schema[c].dataType.simpleString()}" for c in blocks.columns)

    def repair(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        pdf["line"] = joined_hyphens(pdf["line"].tolist())
        return pdf[columns]

    touched = blocks.join(breaks, "doc_id", "left_semi").groupBy("doc_id").applyInPandas(repair, kinds)
    return blocks.join(breaks, "doc_id", "left_anti").select(*columns).unionByName(touched)


def join_hyphens(text: Column) -> Column:
    """The lower-case rule alone, on columns."""
    return F.regexp_replace(F.regexp_replace(text, r"(\p{L})-[ \t]*\n[ \t]*(\p{Ll})", "$1$2"), r"(\p{L})- (\p{Ll})", "$1$2")


def guess_language(text: Column) -> Column:
    sample = F.substring(text, 1, 4000)
    return F.when(trim(sample) == "", "unknown").when(hits(sample, LANGUAGE_WORDS["pt"]) >= hits(sample, LANGUAGE_WORDS["en"]), "pt").otherwise("en")


def foreign_flag(text: Column) -> Column:
    def foreign(low: Column) -> Column:
        # the other languages are counted only where three words and more speak against them
        more = lambda es: F.when(es <= 2, False).otherwise((es > lower_hits(low, FLAG_WORDS["pt"]) + 2) & (es > lower_hits(low, FLAG_WORDS["en"]) + 2))
        return let(lower_hits(low, FLAG_WORDS["es"]), more)

    return let(F.lower(F.substring(text, 1, 2000)), foreign)


# --- chunks ----------------------------------------------------------------------------------------


def pack_chunks(text: Column, separator: str = r"\n{2,}", most: int = 3000, least: int = 300) -> Column:
    """Paragraphs packed greedily up to ``most`` characters, longer ones split; short chunks dropped."""
    paragraphs = F.filter(F.transform(F.split(text, separator), trim), lambda p: p != "")
    cut = lambda p: F.transform(F.sequence(F.lit(0), ((F.char_length(p) - 1) / most).cast("int")), lambda i: F.substring(p, i * most + 1, F.lit(most)))
    pieces = F.flatten(F.transform(paragraphs, cut))
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc: Column, p: Column) -> Column:
        fits = F.char_length(acc.open) + 2 + F.char_length(p) <= most
        return (
            F.when(acc.open == "", F.struct(acc.done.alias("done"), p.alias("open")))
            .when(fits, F.struct(acc.done.alias("done"), F.concat(acc.open, F.lit("\n\n"), p).alias("open")))
            .otherwise(F.struct(F.array_append(acc.done, acc.open).alias("done"), p.alias("open")))
        )

    packed = F.aggregate(pieces, empty, add, lambda acc: F.when(acc.open == "", acc.done).otherwise(F.array_append(acc.done, acc.open)))
    return F.filter(packed, lambda c: F.char_length(c) >= least)


def chunk_documents(docs: DataFrame, separator: str = r"\n{2,}", most: int = 3000, least: int = 300) -> DataFrame:
    """The columns of docs but text, with ordinal, chunk, token_count and content_hash."""
    rest = [c for c in docs.columns if c != "text"]
    exploded = T.dealt(docs, rest, pack_chunks(F.col("text"), separator, most, least), "ordinal", "chunk")
    return exploded.withColumns({"token_count": F.greatest(F.lit(1), F.ceil(F.char_length("chunk") / 4)).cast("int"), "content_hash": F.sha2("chunk", 256)})


# --- scores ----------------------------------------------------------------------------------------


def link_density(text: Column) -> Column:
    # without a link the density is 0 whatever the number of words
    links = let(F.lower(text), lambda low: F.when(~low.contains("http") & ~low.contains("href"), 0).otherwise(count(text, "(?i)" + LINK)))
    found = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return let(links, lambda n: F.when(n == 0, 0.0).otherwise(F.when(found == 0, 0.0).otherwise(F.least(F.lit(1.0), n / F.greatest(found / 20, F.lit(1.0))))))


def content_density(text: Column, separator: str = r"\n{2,}") -> Column:
    paragraphs = F.filter(F.transform(F.split(text, separator), trim), lambda p: p != "")

    def dense(ps: Column) -> Column:
        long_ = F.size(F.filter(ps, lambda p: F.char_length(p) >= 80))
        total = F.aggregate(ps, F.lit(0), lambda a, p: a + F.char_length(p))
        return share(long_, F.size(ps)) * F.least(F.lit(1.0), share(total, F.size(ps)) / 250)

    return (1 - link_density(text)) * let(paragraphs, dense)


def educational_signal(text: Column, patterns: tuple[str, ...] = (DEFINITION, EXAMPLE, RULE)) -> Column:
    found = let(F.lower(text), lambda low: sum((lower_hits(low, p) for p in patterns[1:]), lower_hits(low, patterns[0])))
    return F.least(F.lit(1.0), found * 200 / F.greatest(F.char_length(text), F.lit(1)))


def testability(text: Column, claim: str = CLAIM, hedge: str = HEDGE) -> Column:
    """Share of sentences over 20 characters that claim something without hedging; each judged by itself."""
    sentences = F.filter(F.split(text, r"[.!?]+"), lambda s: F.char_length(trim(s)) > 20)
    claims = lambda s, low: (low.rlike("[0-9]") | may_match(low, CLAIM_WORDS) if claim == CLAIM else F.lit(True)) & F.regexp_like(s, F.lit(spark_regex(claim)))
    hedges = lambda s, low: may_match(low, hedge) & F.regexp_like(s, F.lit(spark_regex(hedge)))
    is_good = lambda s: let(F.struct(s.alias("s"), folded(s).alias("low")), lambda r: claims(r.s, r.low) & ~hedges(r.s, r.low))
    return let(sentences, lambda ss: share(F.size(F.filter(ss, is_good)), F.size(ss)))


def noise(text: Column) -> Column:
    return F.least(F.lit(1.0), count(text, NOISE) / F.greatest(F.char_length(text), F.lit(1)))


def metadata_counts(text: Column) -> Column:
    """struct of the pattern counts, the length, and the numbers of lines and of short ones."""
    lines = F.filter(F.transform(F.split(text, r"\n+"), trim), lambda x: x != "")
    shape = let(lines, lambda ls: F.struct(F.size(ls).alias("all"), F.size(F.filter(ls, lambda x: F.char_length(x) < 80)).alias("short")))
    return let(F.lower(text), lambda low: F.struct(*[lower_hits(low, p, META_MARKS.get(k)).alias(k) for k, p in META_PATTERNS.items()], F.char_length(text).alias("chars"), shape.alias("lines")))


def metadata_features(c: Column) -> dict[str, Column]:
    """The features from the counts: densities for 500 characters, flags, and shapes."""
    per500 = lambda n: F.when(c.chars > 0, n * 500 / c.chars).otherwise(0.0)
    flag = lambda x: x.cast("double")
    question = c.option >= 3
    return {
        "date": per500(c.date),
        "currency": F.when((c.currency > 0) & ((c.vacancy > 0) | (c.fee > 0)), per500(c.currency)).otherwise(0.0),
        "vacancy": flag(c.vacancy > 0),
        "imperative": flag(c.imperative > 0),
        "org": per500(c.org),
        "edital": flag(c.edital > 0),
        "contact": per500(c.contact),
        "list_shape": flag(~question & (c.lines.short == c.lines.all) & (c.lines.all >= 5)),
        "legal": per500(c.legal),
        "explain": per500(c.explain),
        "question": flag(question),
    }


def metadata_probability(text: Column) -> Column:
    def logistic(c: Column) -> Column:
        features = metadata_features(c)
        z = sum((F.lit(w) * features[k] for k, w in META_WEIGHTS.items()), F.lit(META_BIAS))
        return 1 / (1 + F.exp(-z))

    return let(metadata_counts(text), logistic)


def section_quality(density: Column, educational: Column, testable: Column, noisy: Column, metadata: Column) -> Column:
    return F.when(metadata > 0.6, 0.0).otherwise(0.3 * density + 0.3 * educational + 0.2 * testable + 0.2 * (1 - noisy))


def eligibility(role: Column, section_role: Column, language: Column, noisy: Column, metadata: Column, quality: Column, size: Column, duplicate: Column, map_score: Column | None, languages=("pt", "en")) -> Column:
    """struct(status, reason) of the first rule that fails; without map scores the last rule is left out."""
    verdict = lambda status, reason: F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))
    rules = [
        (~role.isin("knowledge", "mixed"), "role"),
        (~section_role.isin("content", "legal_article"), "section_role"),
        (~language.isin(*languages), "language"),
        (noisy > 0.3, "noise"),
        (metadata > 0.35, "metadata"),
        (quality < 0.45, "low_quality"),
        ((size < 300) | (size > 4000), "size"),
        (duplicate, "duplicate"),
    ]
    out = F.when(rules[0][0], verdict("ineligible", rules[0][1]))
    for failed, reason in rules[1:]:
        out = out.when(failed, verdict("ineligible", reason))
    if map_score is not None:
        out = out.when(map_score.isNull() | (map_score < 0.62), verdict("parked", "unmapped"))
    return out.otherwise(verdict("eligible", "ok"))


# --- likeness --------------------------------------------------------------------------------------


def word_bag(c: Column) -> Column:
    """The different words of a text in order."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s]", " "), r"\s+"), lambda w: w != "")))


def bag_ratio(x: Column, y: Column) -> Column:
    """0 to 100: the best Levenshtein ratio among shared words and either side's whole word set. Shared words begin either side, so all edits between are the rest of it."""
    from millrace.functions.text import let

    rounded = lambda part, whole: F.floor(part / whole * 100 + 0.5).cast("int")
    text = lambda words: F.array_join(words, " ")

    def best(shared: Column, left: Column, right: Column) -> Column:
        longest = F.greatest(F.char_length(left), F.char_length(right))
        shortest = F.least(F.char_length(left), F.char_length(right))
        begun = F.when(F.char_length(shared) == 0, 0).otherwise(rounded(F.char_length(shared), shortest))
        # two sides are as many edits apart as one is longer, at least
        return let(begun, lambda n: F.when(n >= rounded(shortest, longest), n).otherwise(F.greatest(n, rounded(longest - F.levenshtein(left, right), longest))))

    whole = lambda both, words: text(F.concat(both, F.array_except(words, both)))
    found = let(F.array_intersect(x, y), lambda both: let(whole(both, x), lambda left: let(whole(both, y), lambda right: best(text(both), left, right))))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 100).when((F.size(x) == 0) | (F.size(y) == 0), 0).otherwise(found)


def token_set_ratio(a: Column, b: Column) -> Column:
    """0 to 100: the best Levenshtein ratio among shared words and either side's whole word set."""
    from millrace.functions.text import let

    return let(word_bag(a), lambda x: let(word_bag(b), lambda y: bag_ratio(x, y)))


def cosine(a: Column, b: Column) -> Column:
    """Over the shorter length; 0 with a vector of no length."""
    add = lambda acc, x: acc + x
    zero = F.lit(0.0)
    pairs = F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), zero))
    square = lambda v: F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), zero, add)
    norm = F.sqrt(square(a)) * F.sqrt(square(b))
    return F.when(norm > 0, F.aggregate(pairs, zero, add) / norm).otherwise(0.0)


# Suffixes of the stemmer in the order of trial, without accents.
SUFFIXES = (
    "amente emente idade idades adora adoras ismo ismos ista istas oso osa osos osas acao acoes coes mente amento imentos "
    "anca ancas ivel avel cao oes aes ais eis ois uis ns es s"
).split()
STOPWORDS = "de da do das dos e em para com no na aos as os um uma".split()


def stem(token: Column) -> Column:
    """Drops the first listed suffix that leaves three letters; short tokens stay."""
    from millrace.functions.text import fold

    # the word is made plain once, most are so already, and every suffix ends in one of five letters
    plain = lambda x: F.when(F.regexp_like(x, F.lit(r"^[a-z0-9]*\z")), x).otherwise(F.regexp_replace(fold(x), "[^a-z0-9]", ""))
    cut = lambda x: F.regexp_replace(x, f"^(.{{3,}}?)(?:{'|'.join(SUFFIXES)})$", "$1")
    ends = lambda x: x.endswith("s") | x.endswith("e") | x.endswith("o") | x.endswith("a") | x.endswith("l")
    return let(token, lambda t: let(plain(t), lambda x: F.when((F.char_length(x) < 4) | ~ends(x), x).otherwise(cut(x))))


def lexical_terms(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\s+"), stem), lambda t: (F.char_length(t) > 2) & ~t.isin(*STOPWORDS))


def lexical_scores(chunks: DataFrame, chunk_id: str, chunk_text: str, leaves: DataFrame, leaf_id: str, leaf_text: str) -> DataFrame:
    """(chunk, leaf, score) where terms meet: two points at most a term, over the leaf's terms. An equi join on terms."""
    terms = leaves.select(leaf_id, F.array_distinct(lexical_terms(F.col(leaf_text))).alias("terms"))
    terms = terms.select(leaf_id, F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))
    counts = T.dealt(chunks, [chunk_id], lexical_terms(F.col(chunk_text)), "place", "term").groupBy(chunk_id, "term").agg(F.least(F.lit(2), F.count("*")).alias("points"))
    return counts.join(terms, "term").groupBy(chunk_id, leaf_id, "n_terms").agg(F.sum("points").alias("points")).select(chunk_id, leaf_id, (F.col("points") / F.col("n_terms")).alias("score"))


def publish_gate(structural: Column, relevant: Column, grounded: Column, judge: Column, answer: Column, keyed: Column, durability: Column, relevance: Column, grounding: Column, origin: Column, publish: float = 0.8, fail: float = 0.5) -> Column:
    """struct(decision, score, reason): the first rung that settles it. ``judge`` is the score, null if none ran."""
    verdict = lambda decision, score, reason: F.struct(F.lit(decision).alias("decision"), score.cast("double").alias("score"), F.lit(reason).alias("reason"))
    zero, one = F.lit(0.0), F.lit(1.0)
    return (
        F.when(~structural, verdict("failed", zero, "structural"))
        .when(~relevant, verdict("failed", zero, "relevance"))
        .when(~grounded, verdict("failed", zero, "grounding"))
        .when(judge.isNull() & origin.isin("extraction", "transcription"), verdict("published", one, "extraction_without_judge"))
        .when(judge.isNull(), verdict("needs_review", zero, "judge_unavailable"))
        .when(answer.isNotNull() & keyed.isNotNull() & (answer != keyed), verdict("failed", judge, "judge_answer_mismatch"))
        .when(durability < 0.5, verdict("failed", judge, "judge_low_durability"))
        .when(relevance < 0.5, verdict("failed", judge, "judge_low_relevance"))
        .when(grounding < 0.5, verdict("needs_review", judge, "judge_low_grounding"))
        .when(judge >= publish, verdict("published", judge, "ok"))
        .when(judge < fail, verdict("failed", judge, "judge_score_below_floor"))
        .otherwise(verdict("needs_review", judge, "judge_score_borderline"))
    )
