"""Roles of documents and sections by wording: hints, votes, the administrative override, and the section ladder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import SPACE, count, let
from millrace.operators.curation import folded, link_density, may_match, spark_regex

# Patterns of each vote. ``\b`` stands for an ASCII word boundary; case does not matter.
SPECIFICATION = (
    r"\bedital\b.*\b(abertura|n[ºo°]\s*\d+)",
    r"conte[úu]do\s+program[áa]tico",
    r"\banexo\b.*\b(programa|conte[úu]do)",
    r"\bretifica[çc][ãa]o\b",
)
SPECIFICATION_BODY = (
    r"das\s+inscri[çc][õo]es", r"das\s+vagas", r"da\s+remunera[çc][ãa]o", r"das\s+provas", r"dos\s+recursos", r"das\s+disposi[çc][õo]es\s+finais", r"cronograma",
)
#: (pattern, how often at least)
EVIDENCE = (
    (r"\bcaderno\b", 1),
    (r"\bprova\s+(objetiva|discursiva|tipo|branca|azul)", 1),
    (r"\bgabarito\b", 1),
    (r"padr[ãa]o\s+de\s+respostas?", 1),
    (r"\bquest[ãa]o\s+\d+\b", 10),
)
KNOWLEDGE = (
    (r"\bapostila\b", 1),
    (r"\bcap[íi]tulo\s+\d+", 1),
    (r"\bart\.\s*\d+", 5),
    (r"\bexemplo:", 3),
    (r"\bexerc[íi]cios?\b", 1),
    (r"\bresumo\b", 1),
    (r"\bdefini[çc][ãa]o\b", 1),
)
ADMINISTRATIVE = (
    r"inscri[çc][ãa]o\s+(online|aqui)",
    r"\bboleto\b",
    r"\bcart[ãa]o\s+de\s+confirma[çc][ãa]o",
    r"\bresultado\s+(final|preliminar)",
    r"\bconvoca[çc][ãa]o\b",
    r"\bperguntas\s+frequentes\b",
    r"\bnot[íi]cias?\b",
)
NOTICE = (
    r"edital\s+de\s+(resultado|convoca[çc][ãa]o|homologa[çc][ãa]o)|resultado\s+(final|preliminar|provis[óo]rio|definitivo)|rela[çc][ãa]o\s+(de|dos)\s+candidatos"
    r"|candidatos\s+inscritos|(pedidos?\s+de\s+)?isen[çc][ãa]o\s+(da\s+taxa\s+)?(deferid|indeferid)|convoca[çc][ãa]o\s+(para|dos)|homologa[çc][ãa]o\s+d[oa]"
    r"|recursos?\s+(interpostos|deferidos|indeferidos)|foram\s+(in)?deferidos|gabarito\s+(oficial|preliminar|definitivo)"
)
PROGRAMME = r"conte[úu]dos?\s+program[áa]ticos?|programas?\s+das?\s+provas?|\bdas\s+vagas\b"
NAVIGATION_HEADING = r"\b(categorias?|newsletter|inscreva-se|compartilh|leia\s+tamb[ée]m|veja\s+tamb[ée]m|posts?\s+relacionados|coment[áa]rios|menu|rodap[ée]|navega[çc][ãa]o|busca|tags?)\b"
SYLLABUS_HEADING = r"conte[úu]do\s+program[áa]tico|disciplinas|conhecimentos\s+(b[áa]sicos|gerais|espec[íi]ficos)"
PROGRAMME_HEADING, PROGRAMMER = r"^programa\b", r"programador"
VACANCIES, REGISTRATION = r"cargo|vagas|requisitos|remunera[cç][ãa]o|carga hor[aá]ria", r"taxa|boleto|isen[cç][ãa]o|CPF"
EXAM, DISPOSITIONS = r"quest[oõ]es|peso|pontua[cç][ãa]o|nota m[ií]nima|eliminat[oó]rio", r"disposi[cç][õo]es"
DATE = r"[0-9]{1,2}[/.\-][0-9]{1,2}[/.\-][0-9]{2,4}"
DUTY = r"\bdever[aá]\b|\b[eé] vedado\b|\bo candidato deve\b"
OPTION, KEY = r"(?m)^\s*[A-E]\)", r"[0-9]+\s*[-–.)]\s*[A-E]"
HEADING = r"(?m)^#{1,3}\s|^[A-ZÁÉÍÓÚÃÕÇ][^\n]{0,80}:?\s*$"
#: Roles by kind of hint.
KIND_ROLES = {
    "edital": "specification", "retificacao": "specification", "programa": "specification", "prova": "evidence", "gabarito": "evidence", "padrao_resposta": "evidence",
    "apostila": "knowledge", "lei": "knowledge", "artigo": "knowledge", "manual": "knowledge", "listing": "administrative",
}
ROLES = ("specification", "evidence", "knowledge", "administrative")


def has(text: Column, pattern: str) -> Column:
    return F.regexp_like(text, F.lit(spark_regex(pattern)))


def times(text: Column, pattern: str) -> Column:
    return count(text, spark_regex(pattern))


def _any(text: Column, low: Column, patterns) -> Column:
    """Whether any pattern occurs in a text, which also comes folded; (pattern, n) must occur n times."""
    out = F.lit(False)
    for p in patterns:
        pattern, least = (p, 1) if isinstance(p, str) else p
        out = out | (may_match(low, pattern) & (has(text, pattern) if least == 1 else times(text, pattern) >= least))
    return out


def hint_vote(role_hint: Column, kind_hint: Column) -> Column:
    """struct(role, weight) of provenance: a role hint counts 0.95, a kind hint 0.9; null without any."""
    known = lambda c: c.isNotNull() & (c != "unknown")
    kinds = F.create_map(*[F.lit(x) for pair in KIND_ROLES.items() for x in pair])
    vote = lambda role, weight: F.struct(role.alias("role"), F.lit(weight).alias("weight"))
    return F.when(known(role_hint), vote(role_hint, 0.95)).when(known(kind_hint), vote(F.coalesce(F.element_at(kinds, kind_hint), F.lit("unknown")), 0.9))


def _paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, r"\n{2,}"), lambda p: p.rlike(f"[^{SPACE}]"))


def _knowledge_body(text: Column, density: Column) -> Column:
    headings = count(text, HEADING)

    def judged(ps: Column) -> Column:
        n, long_ = F.size(ps), F.size(F.filter(ps, lambda p: F.char_length(p) >= 300))
        total = F.aggregate(ps, F.lit(0), lambda a, p: a + F.char_length(p))
        return (n > 0) & (long_ >= 0.6 * n) & (headings / n).between(0.02, 0.2) & (density < 0.1) & (total >= 300 * n)

    return let(_paragraphs(text), judged)


def _administrative_body(text: Column, density: Column) -> Column:
    def judged(ps: Column) -> Column:
        n = F.size(ps)
        total = F.aggregate(ps, F.lit(0), lambda a, p: a + F.char_length(p))
        links = F.size(F.filter(ps, lambda p: (F.char_length(p) < 80) & F.regexp_like(p, F.lit("(?i)href|http"))))
        return (n > 0) & ((density > 0.3) | (total < 120 * n) | (links >= 0.4 * n))

    return let(_paragraphs(text), judged)


def lexical_votes(title_block: Column, sample: Column, density: Column) -> Column:
    """struct of a weight for each role: 0.5 for its wording, 0.3 for its build; evidence has no build, and is null without a vote."""
    # all patterns read the same texts, which are cut and folded once
    texts = F.struct(title_block.alias("title"), sample.alias("sample"), folded(title_block).alias("low_title"), folded(sample).alias("low"), density.alias("density"))
    return let(texts, lambda t: _votes(t.title, t.low_title, t["sample"], t.low, t.density))


def _votes(title_block: Column, low_title: Column, sample: Column, low: Column, density: Column) -> Column:
    yes = lambda c, w: F.when(c, w).otherwise(0.0)
    body = sum(((may_match(low, p) & has(sample, p)).cast("int") for p in SPECIFICATION_BODY), F.lit(0)) >= 3
    both = lambda patterns: _any(title_block, low_title, patterns) | _any(sample, low, patterns)
    return F.struct(
        (yes(both(SPECIFICATION), 0.5) + yes(body, 0.3)).alias("specification"),
        F.when(_any(sample, low, EVIDENCE), 0.5).alias("evidence"),
        (yes(_any(sample, low, KNOWLEDGE), 0.5) + yes(_knowledge_body(sample, density), 0.3)).alias("knowledge"),
        (yes(both(ADMINISTRATIVE), 0.5) + yes(_administrative_body(sample, density), 0.3)).alias("administrative"),
    )


def decide(votes: Column) -> Column:
    """struct(role, confidence) from a weight (or null) for each role; of equals the first named leads."""
    weights = lambda v: F.array(*[F.struct((-v[r]).alias("w"), F.lit(i).alias("i"), F.lit(r).alias("role")) for i, r in enumerate(ROLES)])
    cast = F.filter(let(votes, weights), lambda v: v.w.isNotNull())

    def ranked(v: Column) -> Column:
        top, second = -v[0].w, F.coalesce(-F.get(v, F.lit(1)).w, F.lit(0.0))
        mixed = (top >= 0.5) & v[0].role.isin("specification", "evidence") & (second >= 0.5)
        sure = F.when(mixed, F.least(F.lit(0.9), top)).when(top - second >= 0.3, F.least(F.lit(0.95), top + 0.2)).otherwise(F.greatest(F.lit(0.4), top))
        return F.struct(F.when(mixed, "mixed").otherwise(v[0].role).alias("role"), sure.alias("confidence"))

    unknown = F.struct(F.lit("unknown").alias("role"), F.lit(0.0).alias("confidence"))
    return let(F.array_sort(cast), lambda v: F.when(F.size(v) == 0, unknown).otherwise(ranked(v)))


def administrative_notice(title_block: Column, text: Column) -> Column:
    """A notice of results or candidates that holds no programme."""
    return has(title_block, NOTICE) & ~has(text, PROGRAMME)


def document_role(title_block: Column, sample: Column, notice_block: Column, text: Column, hint: Column, density: Column) -> Column:
    """struct(role, confidence, method): the notice overrides all but evidence and knowledge hints; then the hint; then votes."""
    verdict = lambda role, sure, method: F.struct(role.alias("role"), sure.cast("double").alias("confidence"), F.lit(method).alias("method"))
    overridable = ~F.coalesce(hint.role.isin("evidence", "knowledge"), F.lit(False))
    return (
        F.when(administrative_notice(notice_block, text) & overridable, verdict(F.lit("administrative"), F.lit(0.85), "tier1_admin_override"))
        .when(hint.isNotNull() & (hint.role != "unknown"), verdict(hint.role, hint.weight, "tier0_provenance"))
        .otherwise(let(decide(lexical_votes(title_block, sample, density)), lambda d: verdict(d.role, d.confidence, "tier1_lexical")))
    )


def section_role(heading: Column, text: Column, document_density: Column, legal_article: Column, role: Column) -> Column:
    """The first rule that fits a section; knowledge documents have a ladder of their own."""
    heading = F.coalesce(heading, F.lit(""))
    words = F.greatest(F.size(F.split(text, r"[\s\x0b]+")), F.lit(1))
    options, keys = count(text, OPTION) >= 4, count(text, KEY) >= 10
    study = (
        F.when(has(heading, NAVIGATION_HEADING) | (link_density(text) > 0.5), "nav")
        .when(options, "question_block")
        .when(has(heading, "gabarito") & keys, "answer_key")
        .when(legal_article, "legal_article")
        .otherwise("content")
    )
    other = (
        F.when(has(heading, SYLLABUS_HEADING) | (has(heading, PROGRAMME_HEADING) & ~has(heading, PROGRAMMER)), "syllabus")
        .when(has(F.concat(heading, F.lit("\n"), text), VACANCIES) & text.contains("|"), "vacancies")
        .when(has(heading, "cronograma") | (count(text, DATE) >= 3), "schedule")
        .when(has(heading, "inscri") | has(text, REGISTRATION), "registration")
        .when(has(heading, "das provas") | has(text, EXAM), "exam_structure")
        .when(has(heading, DISPOSITIONS), "legal_disposition")
        .when(times(text, DUTY) / words > 0.015, "instructional")
        .when(options, "question_block")
        .when(has(heading, "gabarito") | keys, "answer_key")
        .when((document_density > 0.5) | (link_density(text) > 0.5), "nav")
        .when(legal_article, "legal_article")
        .otherwise("content")
    )
    return F.when(role == "knowledge", study).otherwise(other)
