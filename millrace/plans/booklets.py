"""Booklets and keys written of parts and read back (EV-05), editions, document classes and marks (EV-08).

The SQL side knows the parts the papers were written of, so it says what reading them back must give.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import booklets as B
from millrace.plans import Catalog
from millrace.plans.roles import quoted

catalog = Catalog()
query = catalog.query

#: A booklet's number of question q is q times its factor, modulo 81.
FACTORS = (1, 2, 4, 5)
PARTS = "(SELECT *, p_partkey // 80 AS edition, p_partkey % 80 + 1 AS q, count(*) OVER (PARTITION BY p_partkey // 80) AS n FROM part)"


def _joined(order: str, value: str, by: str):
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda r: r[value]), by)  # eighty at most


def _parts(t):
    c = F.col
    edition = F.floor(c("p_partkey") / 80)
    full = t.part.groupBy(edition.alias("edition")).count().where("count = 80").select("edition")
    rows = t.part.withColumn("edition", edition).join(full, "edition").withColumn("q", (c("p_partkey") % 80 + 1).cast("int"))
    return rows.select("*", F.posexplode(F.array(*map(F.lit, FACTORS))).alias("b", "factor")).withColumns({"booklet": c("b") + 1, "number": (c("q") * c("factor") % 81).cast("int")})


def _papers(t):
    """(edition, text) of every booklet."""
    c, text = F.col, lambda x: F.col(x).cast("string")
    prompt = F.concat(F.lit("Sobre o lote "), c("p_name"), F.lit("\nnúmero "), text("p_partkey"), F.lit(" responda:"))
    options = [F.concat(F.lit("marca "), c("p_brand")), F.concat(F.lit("tipo "), c("p_type")), F.concat(F.lit("tamanho\n  de "), text("p_size"))]
    last = F.when(c("p_size") % 9 == 0, F.concat(F.lit("MARCA "), c("p_brand"))).otherwise(F.concat(F.lit("preço "), text("p_partkey")))
    marks = ("\n(A) ", "\n  B) ", "\n(C)", "\n D) ")
    block = F.concat(text("number"), F.lit("\n"), prompt, F.when(c("number") % 7 == 0, "\nTipo 1 – Página 3\n").otherwise(""), *[x for m, o in zip(marks, [*options, last]) for x in (F.lit(m), o)])
    rows = _parts(t).withColumn("block", block).groupBy("edition", "booklet").agg(_joined("number", "block", "\n").alias("body"))
    cover = F.concat(F.lit("EXAME DE ORDEM UNIFICADO\nTIPO "), text("booklet"), F.lit(" – COR\nHá o questionário de percepção sobre a prova com 10 itens\n"))
    end = "\nQUESTIONÁRIO DE PERCEPÇÃO SOBRE A PROVA\n1\nA prova foi fácil ou foi difícil?\n(A) fácil\n(B) difícil\n(C) média\n(D) não sei"
    return rows.select("edition", F.concat(cover, "body", F.lit(end)).alias("text"))


def _keys(t):
    """(edition, text) of every answer key: grids in bands of twenty, then the correspondence, which every third edition lacks."""
    c = F.col
    rows = _parts(t).withColumn("band", F.floor((c("number") - 1) / 20)).where("p_partkey % 11 <> 0")
    letter = F.element_at(F.array(*[F.lit(x) for x in B.LETTERS]), (c("p_partkey") % 4 + 1).cast("int"))
    rows = rows.withColumn("letter", letter).withColumn("figure", c("number").cast("string"))
    bands = rows.groupBy("edition", "booklet", "band").agg(F.concat(_joined("number", "figure", " "), F.lit("\n"), _joined("number", "letter", "  ")).alias("text"))
    heading = F.when(c("edition") % 2 == 0, F.concat(F.lit("PROVA TIPO "), c("booklet").cast("string"))).otherwise("PROVA TIPO")
    grids = bands.groupBy("edition", "booklet").agg(_joined("band", "text", "\n").alias("text")).withColumn("text", F.concat(heading, F.lit("\n"), "text"))
    grids = grids.groupBy("edition").agg(_joined("booklet", "text", "\n\n").alias("grids"))
    entries = _parts(t).groupBy("edition", "q").agg(_joined("booklet", "number", " ").alias("entry"))
    lines = entries.groupBy("edition", F.floor((c("q") - 1) / 2).alias("line")).agg(_joined("q", "entry", "   ").alias("text")).groupBy("edition").agg(_joined("line", "text", "\n").alias("table"))
    table = F.when(c("edition") % 3 == 2, "").otherwise(F.concat(F.lit("\nTABELA DE CORRESPONDÊNCIA\nTIPO 1 TIPO 2 TIPO 3 TIPO 4\n"), "table"))
    return grids.join(lines, "edition").select("edition", F.concat(F.lit("GABARITOS DEFINITIVOS\n"), "grids", table).alias("text"))


PROMPT = "'Sobre o lote ' || p_name || ' número ' || p_partkey || ' responda:'"
BOOKLETS = f"(SELECT b AS booklet, (q * [{', '.join(map(str, FACTORS))}][b]) % 81 AS number, p.* FROM {PARTS} p, range(1, 5) t(b) WHERE n = 80)"


@query("ev_05", f"""SELECT edition, booklet, number, q AS canonical, {PROMPT} AS prompt, array_to_string(['marca ' || p_brand, 'tipo ' || p_type, 'tamanho de ' || p_size, 'preço ' || p_partkey], '|') AS options,
CASE WHEN p_partkey % 11 <> 0 THEN p_partkey % 4 END AS correct_index, CASE WHEN p_partkey % 11 = 0 THEN 'annulled' ELSE 'ok' END AS status FROM {BOOKLETS} WHERE p_size % 9 <> 0 AND (booklet = 1 OR edition % 3 <> 2)""")
def rekeyed_questions(t):
    keys = ["edition"]
    answers = _keys(t)
    rows = B.rekeyed_questions(B.booklet_questions(_papers(t), keys), B.answer_grids(answers, keys), B.correspondences(answers, keys), keys)
    return rows.select("edition", "booklet", "number", "canonical", "prompt", F.array_join("options", "|").alias("options"), "correct_index", "status")


@query("ev_05_keys", f"""SELECT edition, q AS canonical, p_partkey % 4 AS answer, CASE WHEN edition % 3 = 2 THEN 1 ELSE 4 END AS booklets FROM {PARTS} WHERE n = 80 AND p_partkey % 11 <> 0""")
def agreeing_keys(t):
    """The one answer that all booklets of an edition give to a question, and how many give it."""
    answers = _keys(t)
    keyed = B.canonical_numbers(B.answer_grids(answers, ["edition"]), B.correspondences(answers, ["edition"]), ["edition"]).where("canonical IS NOT NULL")
    return keyed.groupBy("edition", "canonical", "answer").agg(F.count("*").alias("booklets"))


ROMANS = "[" + ", ".join(quoted(B._to_roman(n)) for n in range(1, 51)) + "]"
KNOWN = f"[{', '.join(map(str, B.EDITIONS))}]"
#: Labels of documents (with what fits them) and what they are: kind, phase, booklet, area, definitive.
LABELS = [
    ("Caderno de Prova - Tipo 3", "", ("prova", "objective", 3, None, False)),
    ("Caderno de provas 2ª fase", "/files/OAB46%20-%20b002%20(DIREITO).pdf", ("prova", "practical", None, "B002", False)),
    ("Caderno de provas", "/files/outro.pdf", None),
    ("Gabaritos definitivos - 1ª fase", "", ("gabarito", "objective", None, None, True)),
    ("Padrão de respostas", "/x/DIREITO%20TRIBUT%C3%81RIO", ("gabarito", "practical", None, "B006", False)),
    ("Padrão de Resposta definitivo - Direito do Trabalho", "", ("gabarito", "practical", None, "B007", True)),
    ("Edital de abertura", "", ("edital", None, None, None, False)),
    ("Edital de resultado", "", None),
    ("Recursos contra o gabarito", "", None),
    ("Editais antigos", "", None),
    ("", "%zz", None),
]
_LABEL_ROWS = ", ".join(f"({i}, {quoted(x)}, {quoted(h)}, {', '.join('NULL' if v is None else quoted(v) if isinstance(v, str) else str(v).lower() for v in (c or (None,) * 5))})" for i, (x, h, c) in enumerate(LABELS))


@query("ev_08", f"""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CASE WHEN list_contains({KNOWN}, p_size) THEN p_size END WHEN 1 THEN CASE WHEN p_size BETWEEN 4 AND {B.LAST_ROMAN} THEN p_size END WHEN 2 THEN CASE p_size % 4 WHEN 2 THEN 1 WHEN 3 THEN 2 END
WHEN 3 THEN CASE WHEN list_contains({KNOWN}, p_size) THEN p_size END END AS edition, kind, phase, booklet, area, definitive, p_size >= {B.PASS_CORRECT} AND p_retailprice % 12 >= {B.PASS_SCORE} AS passed
FROM part JOIN (VALUES {_LABEL_ROWS}) v(i, label, href, kind, phase, booklet, area, definitive) ON p_partkey % {len(LABELS)} = i""")
def editions(t):
    c, n = F.col, F.col("p_size").cast("string")
    roman = F.get(F.array(*[F.lit(B._to_roman(k)) for k in range(1, 51)]), c("p_size") - 1)
    kind = c("p_partkey") % 5
    text = (
        F.when(kind == 0, F.concat(n, F.lit("º  EXAME DE ORDEM UNIFICADO"))).when(kind == 1, F.concat(F.lit("o "), F.lower(roman), F.lit(" Exame\nCivil - SEGUNDA FASE")))
        .when(kind == 2, F.concat(F.lit("EXAME DE ORDEM UNIFICADO 2010 . "), (c("p_size") % 4).cast("string"))).when(kind == 3, F.concat(n, F.lit("eou definitivo"))).otherwise(c("p_name"))
    )
    at = (c("p_partkey") % len(LABELS)).cast("int")
    label, href = (F.get(F.array(*[F.lit(x[k]) for x in LABELS]), at) for k in (0, 1))
    rows = t.part.select("p_partkey", B.edition(text).alias("edition"), B.document_class(label, href).alias("d"), B.passed(c("p_size"), c("p_retailprice") % 12).alias("passed"))
    return rows.select("p_partkey", "edition", "d.kind", "d.phase", "d.booklet", "d.area", "d.definitive", "passed")
