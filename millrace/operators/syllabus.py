"""Syllabi of exam notices: positions, programmes and outlines as trees of subjects and topics.

A notice is a table of sections (doc, ordinal, role, heading, text). What stands on a line is told by columns; what a reader would
carry from line to line (subject, scope) is the last value of a window over the document's lines, which are dealt by document once.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import ONE_SPACE, SPACE, SPACES, fold, let, squeeze, trim
from millrace.operators.curation import bag_ratio, folded, token_set_ratio, word_bag
from millrace.operators.exams import ANNEX, PROGRAMME_START
from millrace.operators.roles import has
from millrace.operators.tables import dealt

# Subjects (id, title, aliases) in their order.
SUBJECTS = (
    ("lingua-portuguesa", "Língua Portuguesa", ("português", "lingua portuguesa", "portugues", "lp", "língua portuguesa")),
    ("matematica", "Matemática", ("matemática", "matematica", "matemática financeira", "matematica financeira", "raciocínio matemático", "matematica basica")),
    ("raciocinio-logico", "Raciocínio Lógico", ("raciocínio lógico", "raciocinio logico", "raciocínio lógico-matemático", "raciocinio logico-matematico", "rlm", "lógica")),
    ("direito-administrativo", "Direito Administrativo", ("dir. administrativo", "administrativo", "d. administrativo")),
    ("direito-constitucional", "Direito Constitucional", ("dir. constitucional", "constitucional", "d. constitucional")),
    ("direito-civil", "Direito Civil", ("civil", "dir. civil")),
    ("direito-penal", "Direito Penal", ("penal", "dir. penal", "código penal")),
    ("direito-tributario", "Direito Tributário", ("tributário", "tributario", "dir. tributário")),
    ("informatica", "Informática", ("noções de informática", "nocoes de informatica", "ti", "tecnologia da informação")),
    ("atualidades", "Atualidades", ("conhecimentos gerais", "atualidades e conhecimentos gerais")),
    ("contabilidade", "Contabilidade", ("contabilidade geral", "contabilidade pública", "contabilidade publica")),
    ("administracao-geral", "Administração Geral", ("administração", "administracao", "gestão pública")),
)
# What lines and items look like. Patterns of the second group tell upper case from lower.
BASIC, SPECIFIC = r"conhecimentos?\s+(b[aá]sicos|gerais|comuns)", r"conhecimentos?\s+espec[íi]ficos"
ADMIN = r"\b(vagas?|remunera[cç][ãa]o|sal[aá]rio|taxa|inscri[cç][ãa]o|cronograma|boleto)\b"
#: What every match of the pattern begins with.
ADMIN_STEMS = ("vaga", "remunera", "sal", "taxa", "inscri", "cronograma", "boleto")
NO_SUBJECT = r"conte[úu]do\s+program[áa]tico|cronograma|\banexo\b|inscri|vagas"
OF_THE, QUALIFICATION, PAGE = r"^(das?|dos?)\s+", r"^habilita[çc][ãa]o\b", r"^p[áa]gina\s+\d+"
POSITION, FOR_POSITION = r"conhecimentos espec[íi]ficos\s*[—–-]\s*([^\n:]+)", r"para o cargo de\s+([^\n.;]+)"
ITEM = r"(?:^|\n)\s*(?:\d+(?:\.\d+)*[.)]|[a-z]\))\s+([^\n;]+)"

UPPER = "A-ZÁÉÍÓÚÂÊÔÀÃÕÇ"
SUBJECT_LINE = rf"^([{UPPER}0-9][{UPPER}0-9\s\-–—,/()&]{{2,88}}):?\s*$"
LABEL = rf"(?:^|([.;])\s+)([{UPPER}][{UPPER}0-9 ,/\-–()]{{3,90}}?):"
NUMBERED = r"(?:^|\s)(?:\d+(?:\.\d+)*[.)])\s+([^;]+?)(?=(?:\s\d+(?:\.\d+)*[.)]\s)|$)"
SPAN_LEAVES, OUTLINE_LEAVES = (10, 900), (10, 600)
LONGEST_ITEM, NEAR_TITLE = 200, 90


def _bare(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).lower()


def _key(text: str) -> str:
    return " ".join("".join(c if c.isalnum() or c.isspace() else " " for c in _bare(text)).split())


#: Keys of a subject's title, id and aliases; a key that two subjects share is the later one's.
KEYS = {key: s for s in SUBJECTS for key in (_key(s[1]), s[0].replace("-", " "), *map(_key, s[2]))}


def _map(pairs: dict) -> Column:
    value = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), value(v))])


def item(c: Column) -> Column:
    """An item's title: single spaces, no closing punctuation, a capital first."""
    tidy = F.rtrim(squeeze(c), F.lit(".;," + SPACES))
    return let(tidy, lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 30)))


def administrative(c: Column) -> Column:
    """Whether a text speaks of the contest; the pattern runs only where one of its stems stands."""
    some = lambda low: F.exists(F.array(*map(F.lit, ADMIN_STEMS)), low.contains)
    return let(folded(c), some) & has(c, ADMIN)


def _usable(items: Column, least: int) -> Column:
    return F.filter(items, lambda t: F.char_length(t).between(least, LONGEST_ITEM) & ~administrative(t))


def slug_key(c: Column, longest: int = 64) -> Column:
    made = F.substring(F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, longest)
    return F.regexp_replace(made, "^$", "unknown")


def path(*parts: Column) -> Column:
    return F.concat_ws("/", *(slug_key(p) for p in parts))


def subject_id(c: Column) -> Column:
    """The known subject that a label names: its key, else the first key that holds the label or that the label holds."""
    key = F.btrim(F.regexp_replace(F.regexp_replace(fold(c), r"[^\p{L}\p{N}\s]", " "), f"{ONE_SPACE}+", " "))
    keys = F.array(*map(F.lit, KEYS))

    def found(k: Column) -> Column:
        near = F.get(F.filter(keys, lambda a: k.contains(a) | a.contains(k)), F.lit(0))
        return F.when(k == "", None).otherwise(F.element_at(_map({k: s[0] for k, s in KEYS.items()}), F.when(F.array_contains(keys, k), k).otherwise(near)))

    return let(key, found)


def subject_title(id_: Column) -> Column:
    return F.element_at(_map({s[0]: s[1] for s in SUBJECTS}), id_)


def exact_subject_id(c: Column, norm, more: int) -> Column:
    """The known subject if the label is its title or alias, or holds the title and is at most ``more`` letters longer."""

    def agrees(id_: Column) -> Column:
        title = F.element_at(_map({s[0]: norm(s[1]) for s in SUBJECTS}), id_)
        aliases = F.element_at(_map({s[0]: [norm(a) for a in s[2]] for s in SUBJECTS}), id_)
        held = lambda t: t.contains(title) & (F.char_length(t) <= F.char_length(title) + more)
        return F.when(id_.isNotNull() & let(norm(c), lambda t: (t == title) | F.array_contains(aliases, t) | held(t)), id_)

    return let(subject_id(c), agrees)


def spaced(c):
    """Lower case without accents, with single spaces."""
    return squeeze(fold(c)) if isinstance(c, Column) else " ".join(_bare(c).split())


def lettered(c):
    """Lower case without accents, letters and digits alone."""
    return F.btrim(F.regexp_replace(fold(c), "[^a-z0-9]+", " ")) if isinstance(c, Column) else " ".join("".join(x if x.isascii() and x.isalnum() else " " for x in _bare(c)).split())


def outline_items(body: Column) -> Column:
    """Numbered or lettered items of a text; without any, its lines; without lines, what semicolons part."""
    listed = F.filter(F.transform(F.regexp_extract_all(body, F.lit("(?i)" + ITEM), 1), item), lambda t: F.char_length(t).between(1, LONGEST_ITEM) & ~administrative(t))
    lines = _usable(F.transform(F.split(body, r"\n+"), lambda p: item(F.regexp_replace(p, rf"^[•\-*–—]\s*", ""))), 4)
    parts = _usable(F.transform(F.split(body, r";\s+"), item), 4)
    by_line = let(lines, lambda found: F.when(body.contains("\n") & (F.size(found) > 0), found).otherwise(parts))
    return let(listed, lambda found: F.when(F.size(found) > 0, found).otherwise(by_line))


def topics(body: Column) -> Column:
    """Topics of a programme's running text: three numbered ones, or parts at semicolons, sentences or commas, whichever first gives three."""

    def split(text: Column) -> Column:
        numbered = _usable(F.transform(F.regexp_extract_all(text, F.lit(NUMBERED), 1), item), 4)
        semicolons, sentences, commas = (F.split(text, p) for p in (r";\s*", r"\.\s+(?=[A-ZÁÉÍÓÚ])", r",\s+(?=[A-ZÁÉÍÓÚ])"))
        three = lambda pieces, rest: let(pieces, lambda p: F.when(F.size(p) >= 3, p).otherwise(rest(p)))
        raw = three(semicolons, lambda _: three(sentences, lambda s: three(commas, lambda _: s)))
        return let(numbered, lambda n: F.when(F.size(n) >= 3, n).otherwise(_usable(F.transform(raw, item), 4)))

    return let(squeeze(body), split)


def is_subject_line(line: Column) -> Column:
    """Whether a programme's line is a subject: nine letters in ten upper case, or a known subject."""

    def judged(t: Column) -> Column:
        letters = F.char_length(F.regexp_replace(t, f"[^A-Za-z{UPPER[3:]}áéíóúâêôàãõç]", ""))
        upper = F.char_length(F.regexp_replace(t, f"[^{UPPER}]", ""))
        shape = F.char_length(t).between(4, 90) & ~has(t, ANNEX) & ~administrative(t) & ~t.rlike(r"^\d") & t.rlike(f"[{UPPER}]{{3}}")
        return shape & (((letters >= 4) & (upper >= 0.9 * letters)) | subject_id(t).isNotNull())

    return let(F.regexp_replace(trim(line), ":$", ""), judged)


def subject_of_line(line: Column) -> Column:
    """struct(title, id) of an outline's subject line, or null: a line in capitals, or one that names a known subject."""
    line = trim(line)
    bare = trim(F.regexp_replace(line, ":$", ""))
    subject = lambda title, id_: F.struct(F.coalesce(subject_title(id_), title).alias("title"), id_.alias("id"))
    capitals = item(F.regexp_extract(line, SUBJECT_LINE, 1))
    fits = F.char_length(bare).between(4, 80) & (line.endswith(":") | bare.rlike("^[A-ZÁÉÍÓÚÃÕÇ]"))
    known = let(F.when(fits, exact_subject_id(bare, spaced, 24)), lambda id_: F.when(id_.isNotNull(), subject(F.lit(None).cast("string"), id_)))
    return F.when(line.rlike(SUBJECT_LINE), let(capitals, lambda t: subject(t, subject_id(t)))).otherwise(known)


def subject_of_heading(heading: Column) -> Column:
    """struct(title, id) of a heading: as a line, else the heading itself if it is no scope, notice or annex."""
    bare = trim(F.regexp_replace(heading, ":$", ""))
    free = F.char_length(bare).between(4, 80) & ~has(bare, BASIC) & ~has(bare, SPECIFIC) & ~administrative(bare) & ~has(bare, OF_THE) & ~has(bare, NO_SUBJECT)
    return F.coalesce(subject_of_line(heading), F.when(free, F.struct(item(bare).alias("title"), F.lit(None).cast("string").alias("id"))))


def _with_positions(nodes: DataFrame, positions: DataFrame | None, key: str) -> DataFrame:
    """Nodes with the slugs of the positions they are for: all for basic ones, the first for specific ones."""
    nodes = nodes.withColumn("slugs", F.array(F.lit("geral"))) if positions is None else nodes.join(positions.select(key, "slugs"), key, "left").withColumn("slugs", F.coalesce("slugs", F.array(F.lit("geral"))))
    return nodes.withColumn("slugs", F.when(F.col("scope") == "basic", F.col("slugs")).otherwise(F.slice("slugs", 1, 1)))


NODE = ["ordinal", "depth", "title", "path", "parent", "subject_id", "scope", "slugs", "confidence"]


def programme_nodes(span: DataFrame, positions: DataFrame | None = None, key: str = "doc") -> DataFrame:
    """Subjects and topics of programme spans: labels within a line head lines of their own, running headers go, repeated subjects are one."""
    whole = F.concat(F.coalesce("heading", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    hoisted = F.regexp_replace(whole, rf"(?md){LABEL}\s+(?=[A-ZÁÉÍÓÚ0-9(])", "$1\n$2:\n")
    lines = dealt(span, [key, F.col("ordinal").alias("section")], F.split(hoisted, r"\n+"), "place", "raw")
    lines = lines.select(key, "section", "place", trim(F.col("raw")).alias("line")).where("line <> ''").repartition(key)
    lines = lines.withColumn("seen", F.count("*").over(W.partitionBy(key, "line")))
    running = (F.char_length("line") >= 4) & (F.col("seen") >= 3)
    lines = lines.where(~running & ~has(F.col("line"), PAGE) & ~F.col("line").rlike(r"^\d{1,3}$"))

    short = F.char_length("line") < 60
    turn = F.when(short & has(F.col("line"), BASIC), "basic").when(short & has(F.col("line"), SPECIFIC), "specific")
    heads = is_subject_line(F.col("line")) & ~has(F.col("line"), PROGRAMME_START) & ~has(F.col("line"), QUALIFICATION)
    label = item(F.regexp_replace("line", ":$", ""))
    lines = lines.withColumn("turn", turn).withColumn("label", F.when(F.col("turn").isNull() & heads, label)).withColumn("subject_id", F.when(F.col("label").isNotNull(), exact_subject_id(F.col("label"), lettered, 12)))
    lines = lines.withColumn("subject", F.when(F.col("label").isNotNull(), F.coalesce(subject_title(F.col("subject_id")), "label")))
    order = W.partitionBy(key).orderBy("section", "place")
    border = (F.col("turn").isNotNull() | F.col("label").isNotNull()).cast("int")
    lines = lines.withColumns({"border": border, "part": F.sum(border).over(order), "scope": F.coalesce(F.last("turn", True).over(order), F.lit("basic")), "current": F.last("subject", True).over(order)})
    own = F.max(F.when(F.col("label").isNotNull(), F.struct(F.col("subject").alias("title"), "subject_id")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("border") == 0, F.struct("section", "place", "line")))), lambda r: r.line), " ")
    parts = lines.where("current IS NOT NULL").groupBy(key, "part", "scope", "current").agg(own.alias("own"), body.alias("body"))
    head = F.struct(F.lit(0).alias("depth"), F.col("own.title").alias("title"), F.col("own.subject_id").alias("subject_id"))
    leaf = lambda t: F.struct(F.lit(1).alias("depth"), t.alias("title"), F.lit(None).cast("string").alias("subject_id"))
    kind = "array<struct<depth:int,title:string,subject_id:string>>"
    leaves = F.when(F.col("body") != "", F.transform(topics(F.col("body")), leaf)).otherwise(F.array().cast(kind))
    nodes = dealt(parts, [key, "part", "scope", path(F.col("current")).alias("root")], F.concat(F.when(F.col("own").isNotNull(), F.array(head)).otherwise(F.array().cast(kind)), leaves), "place", "node")
    nodes = nodes.select(key, "part", "place", "scope", "node.*", "root", F.when(F.col("node.depth") == 1, F.concat_ws("/", "root", slug_key(F.col("node.title")))).otherwise(F.col("root")).alias("path"))
    nodes = nodes.withColumn("leaves", F.sum("depth").over(W.partitionBy(key, "root"))).where("leaves > 0")
    nodes = nodes.withColumn("turn", F.row_number().over(W.partitionBy(key, "path").orderBy("part", "place"))).where("turn = 1")
    nodes = nodes.withColumn("ordinal", F.row_number().over(W.partitionBy(key).orderBy("part", "place")) - 1)
    confidence = F.when(F.col("depth") == 1, 0.8).when(F.col("subject_id").isNotNull(), 0.9).otherwise(0.75)
    nodes = nodes.withColumn("parent", F.when(F.col("depth") == 1, F.col("root"))).withColumn("confidence", confidence)
    return _with_positions(nodes, positions, key).select(key, *NODE)


def outline_nodes(sections: DataFrame, positions: DataFrame | None = None, key: str = "doc") -> DataFrame:
    """Subjects and topics of outlines: sections that are a syllabus, or all if those hold no outline, or content too if those name no subject.

    A heading that names a subject takes its section's items; elsewhere a line may head those below it. Scope runs on from section to section.
    """
    scope = lambda c: F.when(has(c, SPECIFIC), "specific").when(has(c, BASIC), "basic")
    line_scope = lambda c: F.when(has(c, BASIC), "basic").when(has(c, SPECIFIC), "specific")
    none = F.array().cast("array<string>")
    rows = sections.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("heading_subject", F.when(F.col("heading") != "", subject_of_heading(F.col("heading"))))
    lines = F.filter(F.transform(F.split("text", r"\n+"), trim), lambda x: x != "")
    rows = rows.select(key, F.col("ordinal").alias("section"), "role", "heading_subject", scope(F.coalesce("heading", "text")).alias("turn"), outline_items(F.col("text")).alias("items"), F.when(F.col("heading_subject").isNull(), lines).otherwise(none).alias("lines"))
    rows = rows.repartition(key)
    # a section's own row has place 0; its lines follow
    rows = dealt(rows, [key, "section", "role", "heading_subject", "turn", "items"], F.concat(F.array(F.lit("")), F.col("lines")), "place", "line")
    rows = rows.withColumn("items", F.when(F.col("place") == 0, F.col("items")))
    own = F.col("place") == 0
    rows = rows.withColumn("turn", F.when(own, F.col("turn")).otherwise(line_scope(F.col("line"))))
    rows = rows.withColumn("subject", F.when(own, F.col("heading_subject")).when(F.col("turn").isNull(), subject_of_line(F.col("line"))))
    outlined = own & (F.col("role") == "syllabus") & ((F.size("items") > 0) | F.col("heading_subject").isNotNull())
    whole = W.partitionBy(key)
    some = lambda c: F.coalesce(F.max(c.cast("int")).over(whole), F.lit(0)) == 1
    syllabus = F.coalesce(F.col("role") == "syllabus", F.lit(False))
    rows = rows.withColumns({"has_syllabus": some(syllabus), "has_outline": some(outlined), "named": some(syllabus & F.col("subject").isNotNull()), "named_anywhere": some(F.col("subject").isNotNull())})
    narrow = F.col("has_syllabus") & F.col("has_outline")
    widened = F.col("has_syllabus") & ~F.when(narrow, F.col("named")).otherwise(F.col("named_anywhere"))
    rows = rows.where(F.when(widened, F.col("role").isin("syllabus", "content")).when(narrow, syllabus).otherwise(True))
    order = whole.orderBy("section", "place")
    rows = rows.withColumns({"scope": F.coalesce(F.last("turn", True).over(order), F.lit("basic")), "current": F.last("subject", True).over(W.partitionBy(key, "section").orderBy("place"))})
    listed = F.when(own & F.col("subject").isNotNull(), F.col("items")).when(~own & F.col("turn").isNull() & F.col("subject").isNull() & F.col("current").isNotNull(), outline_items(F.col("line"))).otherwise(none)
    titles = F.concat(F.when(F.col("subject").isNotNull(), F.array(F.lit(None).cast("string"))).otherwise(none), listed)
    headed = rows.where(F.col("current").isNotNull()).withColumn("root", path(F.col("current.title")))
    nodes = dealt(headed, [key, "section", "place", "scope", "current", "root", own.alias("headed")], titles, "turn", "leaf")
    deep = F.col("leaf").isNotNull()
    nodes = nodes.withColumns({"depth": deep.cast("int"), "title": F.coalesce("leaf", "current.title"), "parent": F.when(deep, F.col("root")), "path": F.when(deep, F.concat_ws("/", "root", slug_key(F.col("leaf")))).otherwise(F.col("root"))})
    nodes = nodes.withColumn("subject_id", F.when(~deep, F.col("current.id"))).withColumn("ordinal", F.row_number().over(whole.orderBy("section", "place", "turn")) - 1)
    confidence = F.when(deep, 0.75).when(F.col("subject_id").isNotNull(), 0.9).when(F.col("headed"), 0.75).otherwise(0.7)
    return _with_positions(nodes.withColumn("confidence", confidence), positions, key).select(key, *NODE)


def parsed_syllabi(sections: DataFrame, span: DataFrame, positions: DataFrame | None = None, key: str = "doc") -> tuple[DataFrame, DataFrame]:
    """Nodes of every document, and its status: the programme's if it has ten topics, else the outline's.

    ``active`` takes 10 to 900 topics of a programme, or 10 to 600 of an outline that names a subject; else ``needs_review``.
    """
    tree = programme_nodes(span, positions, key)
    ready = tree.groupBy(key).agg(F.sum("depth").alias("leaves")).where(F.col("leaves") >= SPAN_LEAVES[0])
    rest = outline_nodes(sections.join(ready.select(key), key, "left_anti"), positions, key)
    nodes = tree.join(ready.select(key), key).withColumn("method", F.lit("programme")).unionByName(rest.withColumn("method", F.lit("outline")))
    counted = nodes.groupBy(key, "method").agg(F.sum("depth").alias("leaves"), F.count_if(F.col("depth") == 0).alias("subjects"))
    found = sections.select(key).distinct().join(counted, key, "left")
    leaves = F.coalesce("leaves", F.lit(0)).cast("long")
    programme = F.col("method") == "programme"
    active = (programme & (leaves <= SPAN_LEAVES[1])) | (leaves.between(*OUTLINE_LEAVES) & (F.col("subjects") > 0))
    status = F.when(F.coalesce(active, F.lit(False)), "active").otherwise("needs_review")
    return nodes, found.select(key, F.coalesce("method", F.lit("outline")).alias("method"), leaves.alias("leaves"), F.coalesce("subjects", F.lit(0)).cast("long").alias("subjects"), status.alias("status"))


def distinct_titles(titles: Column) -> Column:
    """The titles of a list that are like none kept before."""
    near = lambda kept, x: F.exists(kept, lambda k: token_set_ratio(k, x) >= NEAR_TITLE)
    return F.aggregate(titles, F.array().cast("array<string>"), lambda kept, x: F.when(near(kept, x), kept).otherwise(F.array_append(kept, x)))


def positions(sections: DataFrame, tables: DataFrame, key: str = "doc") -> DataFrame:
    """(key, place, title, slug, vacancies, implicit): positions of vacancy tables, then of headings and texts, without those whose titles are alike.

    ``tables`` has key, table and rows (arrays of cells, the header first). A document without any has one called ``geral``.
    """
    header = F.transform(F.get("rows", F.lit(0)), F.lower)
    first = lambda word: F.get(F.filter(F.transform(header, lambda h, i: F.when(h.contains(word), i)), lambda i: i.isNotNull()), F.lit(0))
    rows = tables.withColumns({"title_at": first("cargo"), "count_at": first("vaga")}).where("title_at IS NOT NULL")
    rows = rows.select(key, "table", "title_at", "count_at", F.posexplode(F.slice("rows", 2, 1 << 30)).alias("row", "cells"))
    number = F.trim(F.get("cells", F.col("count_at")))
    count = F.when(F.col("count_at").isNotNull(), F.when(number == "", F.lit(0.0)).otherwise(F.when(number.rlike(r"^[+-]?\d+(\.\d+)?$"), number.try_cast("double"))))
    listed = rows.select(key, F.struct(F.lit(0).alias("kind"), F.col("table").cast("long").alias("a"), F.col("row").cast("long").alias("b"), squeeze(F.get("cells", F.col("title_at"))).alias("title"), count.alias("vacancies")).alias("p"))
    listed = listed.where("p.title <> ''")
    text = F.concat(F.coalesce("heading", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    named = sections.select(key, "ordinal", F.posexplode(F.regexp_extract_all(text, F.lit("(?iu)" + POSITION), 1)).alias("b", "raw"))
    none = F.lit(None).cast("double")
    named = named.select(key, F.struct(F.lit(1).alias("kind"), F.col("ordinal").cast("long").alias("a"), F.col("b").cast("long").alias("b"), squeeze(F.col("raw")).alias("title"), none.alias("vacancies")).alias("p")).where("char_length(p.title) >= 3")
    opening = sections.withColumn("first", F.row_number().over(W.partitionBy(key).orderBy("ordinal"))).where("first = 1")
    stated = squeeze(F.regexp_extract(F.substring(F.coalesce("text", F.lit("")), 1, 800), "(?iu)" + FOR_POSITION, 1))
    stated = opening.select(key, F.struct(F.lit(2).alias("kind"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), stated.alias("title"), none.alias("vacancies")).alias("p")).where("p.title <> ''")
    gathered = listed.unionByName(named).unionByName(stated).groupBy(key).agg(F.array_sort(F.collect_list("p")).alias("all"))
    kind = "array<struct<kind:int,a:bigint,b:bigint,title:string,vacancies:double>>"
    keep = lambda kept, p: F.when(F.exists(kept, lambda k: token_set_ratio(k.title, p.title) >= NEAR_TITLE), kept).otherwise(F.concat(kept, F.array(p)))
    kept = F.aggregate("all", F.array().cast(kind), keep)
    found = sections.select(key).distinct().join(gathered.select(key, kept.alias("kept")), key, "left")
    implicit = F.array(F.struct(F.lit(3).alias("kind"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit("geral").alias("title"), none.alias("vacancies")))
    rows = found.select(key, F.posexplode(F.coalesce("kept", implicit)).alias("place", "p"))
    return rows.select(key, "place", "p.title", slug_key(F.col("p.title")).alias("slug"), F.col("p.vacancies").alias("vacancies"), (F.col("p.kind") == 3).alias("implicit"))


def position_slugs(found: DataFrame, key: str = "doc") -> DataFrame:
    """(key, slugs) of the positions a document names, in order."""
    named = found.where("NOT implicit").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "slug"))), lambda p: p.slug).alias("slugs"))
    return named


# --- corrections -------------------------------------------------------------------------------------

#: Token-set ratios from which titles replace each other, subjects may be one, and subjects share a node.
REPLACES, NEAR_SUBJECT, SAME_SUBJECT = 85, 70, 80


def subject_key(path_: Column) -> Column:
    """The first part of a node's path in lower case."""
    parts = F.filter(F.transform(F.split(F.lower(path_), r"[/\-▸>]"), trim), lambda p: p != "")
    return F.coalesce(F.get(parts, F.lit(0)), F.lower(path_))


def replacements(previous: DataFrame, corrected: DataFrame, key: str = "exam") -> DataFrame:
    """(key, node, replaces) of the leaves of a correction, in order: each takes the leaf before it that is most like it (85 and more), of a like subject, and that none has taken; null for a new leaf.

    ``previous`` and ``corrected`` have key, node, place, path and title; a notice's leaves are a bounded list.
    """
    subject = subject_key(F.col("path"))
    mine = corrected.select(key, F.col("node").alias("new"), F.col("place").alias("at"), word_bag(F.col("title")).alias("title"), subject.alias("subject"), word_bag(subject).alias("subject_words"))
    theirs = previous.select(key, "node", "place", word_bag(F.col("title")).alias("old_title"), subject.alias("old_subject"), word_bag(subject).alias("old_subject_words"))
    a, b = F.col("subject"), F.col("old_subject")
    like = (a == b) | a.contains(b) | b.contains(a) | (bag_ratio(F.col("subject_words"), F.col("old_subject_words")) >= NEAR_SUBJECT)
    score = F.filter(F.array(F.when(like, bag_ratio(F.col("title"), F.col("old_title")))), lambda s: s >= REPLACES)
    pairs = dealt(mine.join(theirs, key), [key, "at", "new", "place", "node"], score, "one", "score")
    pairs = pairs.groupBy(key, "at", "new").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "place", "node"))).alias("likes"))
    # in the order of the correction, each takes the first of its likes that is left
    listed = pairs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "new", "likes"))).alias("all"))
    node = previous.schema["node"].dataType.simpleString()
    start = F.struct(F.array().cast(f"array<{node}>").alias("taken"), F.array().cast(f"array<struct<new:{corrected.schema['node'].dataType.simpleString()},node:{node}>>").alias("out"))

    def take(acc: Column, x: Column) -> Column:
        free = F.get(F.filter(x.likes, lambda o: ~F.array_contains(acc.taken, o.node)), F.lit(0)).node
        taken = F.struct(F.array_append(acc.taken, free).alias("taken"), F.array_append(acc.out, F.struct(x.new.alias("new"), free.alias("node"))).alias("out"))
        return F.when(free.isNull(), acc).otherwise(taken)

    chosen = listed.select(key, F.explode(F.aggregate("all", start, take, lambda acc: acc.out)).alias("m")).select(key, F.col("m.new").alias("node"), F.col("m.node").alias("replaces"))
    return corrected.select(key, "node").join(chosen, [key, "node"], "left")


def merged_leaves(previous: DataFrame, corrected: DataFrame, key: str = "exam") -> DataFrame:
    """(key, node, origin, place, title, path): the leaves of the next version, those of the correction first (replaced or new), then the ones before it that are kept."""
    matched = replacements(previous, corrected, key)
    origin = F.when(F.col("replaces").isNull(), "new").otherwise("replaced")
    mine = corrected.join(matched, [key, "node"]).select(key, "node", origin.alias("origin"), "place", "title", "path")
    gone = matched.where("replaces IS NOT NULL").select(key, F.col("replaces").alias("node"))
    kept = previous.join(gone, [key, "node"], "left_anti").select(key, "node", F.lit("kept").alias("origin"), "place", "title", "path")
    order = W.partitionBy(key).orderBy((F.col("origin") == "kept").cast("int"), "place", "node")
    return mine.unionByName(kept).withColumn("place", F.row_number().over(order) - 1)


def next_version(versions: DataFrame, nodes: DataFrame, key: str = "exam") -> DataFrame:
    """Nodes of the version after the last one of each exam (1 for the first): version, and the ordinal of the parent, which is the last node of the parent's path made before; nodes are made by depth."""
    made = nodes.withColumn("made", F.row_number().over(W.partitionBy(key).orderBy("depth", "ordinal")))
    above = made.select(key, F.col("path").alias("parent"), F.col("made").alias("made_before"), F.col("ordinal").alias("parent_ordinal"))
    found = made.join(above, [key, "parent"]).where("made_before < made").groupBy(key, "made").agg(F.max_by("parent_ordinal", "made_before").alias("parent_ordinal"))
    last = versions.groupBy(key).agg(F.max("version").alias("last"))
    rows = made.join(found, [key, "made"], "left").join(last, key, "left")
    return rows.select(key, (F.coalesce("last", F.lit(0)) + 1).alias("version"), "ordinal", "depth", "path", "parent_ordinal")
