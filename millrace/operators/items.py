"""Checks of question items, answer keys, judge replies and document hints, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import B, fold, host_of, let, squeeze, trim
from millrace.operators.curation import metadata_probability, spark_regex, token_set_ratio

# Hints by words of a label or address, first match wins: (kind, role, pattern).
HINTS = (
    ("retificacao", "specification", r"\bretifica"),
    ("edital", "specification", r"\bedital\b"),
    ("programa", "specification", r"\bprograma\b|conte[úu]do\s+program"),
    ("gabarito", "evidence", r"\bgabarito\b"),
    ("padrao_resposta", "evidence", r"padr[ãa]o\s+de\s+respostas?"),
    ("prova", "evidence", r"\bprova\b|\bcaderno\b"),
    ("apostila", "knowledge", r"\bapostila\b"),
    ("lei", "knowledge", r"\blei\b|\bart\.\s*\d+"),
)
#: Minutes of a session, and the least and most questions.
BUDGETS = {15: (4, 8), 20: (5, 10), 30: (8, 12), 45: (10, 16), 60: (12, 20), 90: (15, 25)}
DEFAULT_BUDGET = (3, 6)
#: Policies against what untrusted text may say, in the order of trial.
INPUT_POLICIES = (
    ("prompt-injection", r"\b(ignore|disregard|forget|disobey|override)\b.{0,40}\b(previous|prior|earlier|above|system|your|all)\b.{0,30}\b(instructions?|prompts?|rules?|directions?)\b"),
    ("secret-exfil", r"\b(secret|password|api[-_ ]?key|token|credential)s?\b.{0,60}\b(send|post|print|echo|reveal|show|include|expose|leak)\b|\b(send|post|print|output|reveal)\b.{0,60}\b(secret|password|api[-_ ]?key|token|credential)s?\b"),
    ("script-exec", r"<script\b|javascript:|\bon(load|error|click|submit|mouseover)\s*="),
    ("data-exfil", r"\b(webhook\.site|exfiltrat\w*|pastebin\.com|requestbin\w*|ngrok\.(io|dev|app)|pipedream\.net|burpcollaborator\.net)\b|\bcurl\b\s+https?:|\bnc\s+-e\b"),
    ("tracking", r"\btracking\s+pixel\b|\butm_[a-z]+\b|\b(pixel|beacon)\.(gif|png|js)\b"),
    ("safety-bypass", r"\b(bypass|disable|skip|override|turn\s+off|remove)\b.{0,40}\b(safety|guardrail|filter|authentication|auth|validation|rate\s+limit|content\s+policy)s?\b"),
)
#: Characters that readers do not see: zero-width marks, direction marks, word joiners, the byte-order mark and the tag block.
INVISIBLE_CLASS = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{FEFF}\x{E0000}-\x{E007F}]"
FENCE = r"(BEGIN|END)_UNTRUSTED_QUIZ_DATA"
# Limits and patterns of items.
LEAST_PROMPT, MOST_PROMPT, LEAST_OPTIONS, MOST_OPTIONS = 30, 4000, 4, 5
BANNED_OPTION = r"\btodas\s+as\s+(alternativas|anteriores)\b|\bnenhuma\s+das\s+(alternativas|anteriores)\b|\ball\s+of\s+the\s+above\b|\bnone\s+of\s+the\s+above\b"
CONTEXT = r"\bo\s+trecho\s+(acima|abaixo)\b|\bno\s+texto\s+(acima|abaixo)\b|\bconforme\s+o\s+material\s+(acima|fornecido)\b|\bsegundo\s+o\s+trecho\b|\bthe\s+(passage|excerpt)\s+above\b"
LOREM, MARKERS = r"\blorem\s+ipsum\b", r"\bTODO\b|\bXXX+\b|^\s*\.{3,}\s*$"
LISTING = (
    r"\b(?:inscri[cç][oõ]es?\s+abertas|taxa\s+de\s+inscri|cargo\s+(?:de|est[aá]|oferecido|sendo\s+oferecido)|(?:est[aá]\s+sendo\s+oferecido)|vagas?\s+(?:dispon|oferec|s[aã]o\s+oferec)"
    r"|sal[aá]rio(?:\s+base)?|banca\s+organizadora|associa[cç][aã]o\s+(?:oferece|brasileira|que\s+realiza)|exame\s+para\s+certifica|certifica[cç][aã]o\s+[—\-]|portal\s+do\s+candidato"
    r"|est[aá]\s+promovendo|oferecido\s+por\s+qual\s+institui)\b"
)


def first_match(text: Column, rules, otherwise: str | None = None) -> Column:
    """The name of the first (name, pattern) that the text matches."""
    (name, pattern), *rest = rules
    out = F.when(F.regexp_like(text, F.lit(spark_regex(pattern))), name)
    for name, pattern in rest:
        out = out.when(F.regexp_like(text, F.lit(spark_regex(pattern))), name)
    return out.otherwise(F.lit(otherwise))


def document_hint(blob: Column) -> tuple[Column, Column]:
    return first_match(blob, [(k, p) for k, _, p in HINTS], "unknown"), first_match(blob, [(r, p) for _, r, p in HINTS], "unknown")


def structural_reasons(item: Column) -> Column:
    """All reasons against an item, in a fixed order.

    ``item`` has kind, prompt, options, correct, reference, origin, requires_passage, passage, rationale and units.
    """
    like = lambda c, p: F.regexp_like(c, F.lit(spark_regex(p)))
    when = lambda c, name: F.when(c, F.lit(name))
    solid = lambda c: F.coalesce(trim(c), F.lit("")) != ""
    filled = lambda a: F.size(F.filter(F.coalesce(a, F.array().cast("array<string>")), solid))
    prompt = trim(F.coalesce(item.prompt, F.lit("")))
    options = F.transform(F.coalesce(item.options, F.array().cast("array<string>")), lambda o: F.coalesce(o, F.lit("")))
    n, choice, made = F.size(options), item.kind == "MULTIPLE_CHOICE", F.coalesce(item.origin == "generation", F.lit(False))
    some = choice & (n > 0)
    tidy = F.transform(options, lambda o: F.lower(trim(o)))
    marker = F.regexp_like(prompt, F.lit(MARKERS.replace(r"\b", B)))
    return F.array_compact(
        F.array(
            when(F.char_length(prompt) < LEAST_PROMPT, "prompt_too_short"), when(F.char_length(prompt) > MOST_PROMPT, "prompt_too_long"), when(like(prompt, CONTEXT), "prompt_references_context"),
            when(like(prompt, LOREM) | marker, "placeholder_text"), when(like(prompt, LISTING) | F.exists(options, lambda o: like(o, LISTING)), "tests_exam_metadata"),
            when(made & (filled(item.units) == 0), "knowledge_unit_ids_missing"), when(choice & (n == 0), "missing_options"), when(some & (n < LEAST_OPTIONS), "too_few_options"),
            when(some & (n > MOST_OPTIONS), "too_many_options"), when(some & F.exists(options, lambda o: trim(o) == ""), "blank_option"), when(some & (F.size(F.array_distinct(tidy)) < n), "duplicate_options"),
            when(some & F.exists(options, lambda o: like(o, BANNED_OPTION)), "banned_option_phrase"), when(some & length_outlier(options), "option_length_outlier"), when(some & length_ratio_fails(options), "option_length_ratio"),
            when(some & (item.correct.isNull() | (item.correct < 0) | (item.correct >= n)), "correct_index_out_of_range"), when(some & made & (filled(item.rationale) < n - 1), "distractor_rationale_missing"),
            when(~choice & ~solid(item.reference), "missing_reference_answer"), when(F.coalesce(item.requires_passage, F.lit(False)) & ~solid(item.passage), "passage_required"),
        )
    )


def length_outlier(options: Column, ratio: float = 2.5) -> Column:
    """From three options on: the longest against the mean of those of other lengths."""
    sizes = F.transform(options, lambda o: F.char_length(trim(o)))
    longest = F.array_max(sizes)
    rest = F.filter(sizes, lambda s: s != longest)
    total = F.aggregate(rest, F.lit(0), lambda a, s: a + s)
    return (F.size(options) >= 3) & (total > 0) & (longest * F.size(rest) > ratio * total)


def length_ratio_fails(options: Column, ratio: float = 2.0) -> Column:
    """From three options with text on: the longest against the shortest of them."""
    sizes = F.filter(F.transform(options, lambda o: F.char_length(trim(o))), lambda s: s > 0)
    return (F.size(sizes) >= 3) & (F.array_max(sizes) > ratio * F.array_min(sizes))


def neutralised(text: Column) -> Column:
    """Untrusted text without invisible characters, unable to close its own fence."""
    return F.regexp_replace(F.regexp_replace(text, INVISIBLE_CLASS, ""), FENCE, "$1_UNTRUSTED_QUIZ_DATA_NEUTRALIZED")


def answer_key(text: Column) -> Column:
    """array(struct(number, answer)): annulled numbers first, then letters; the first entry of a number stands."""
    annulled = r"(?im)(?:^|[\n;,\s])(\d{1,3})\s*[-.):]?\s*(?:\*|anulad\w*)(?=[\s,;]|$)"
    letter = r"(?m)(?:^|[\n;,\s])(\d{1,3})\s*[-.):]?\s*\(?([A-Ea-e])\)?(?=[\s,;]|$)"
    entry = lambda n, a: F.struct(n.cast("int").alias("number"), a.alias("answer"))
    void = F.transform(F.regexp_extract_all(text, F.lit(annulled), F.lit(1)), lambda n: entry(n, F.lit("annulled")))
    numbers, letters = (F.regexp_extract_all(text, F.lit(letter), F.lit(k)) for k in (1, 2))
    given = F.zip_with(numbers, letters, lambda n, a: entry(n, F.lower(a)))
    both = F.filter(F.concat(void, given), lambda e: e.number >= 1)
    return F.filter(both, lambda e, i: F.size(F.filter(F.slice(both, F.lit(1), i), lambda x: x.number == e.number)) == 0)


def unit(value: Column) -> Column:
    """A number within 0 to 1; 0 for what is none."""
    number = value.try_cast("double")
    return F.when(number.isNull() | F.isnan(number), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))


def distribution_ok(probabilities: Column, allowed: list[str], tolerance: float = 1e-3) -> Column:
    """A map over known options, each within 0 to 1, that adds up to 1."""
    values = F.map_values(probabilities)
    known = F.forall(F.map_keys(probabilities), lambda k: k.isin(*allowed))
    ranged = F.forall(values, lambda v: v.isNotNull() & (v >= 0) & (v <= 1))
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    return probabilities.isNotNull() & (F.size(values) > 0) & known & ranged & (F.abs(total - 1) <= tolerance)


def session_budget(minutes: Column) -> Column:
    least, most = F.lit(DEFAULT_BUDGET[0]), F.lit(DEFAULT_BUDGET[1])
    for m, (a, b) in BUDGETS.items():
        least, most = F.when(minutes == m, a).otherwise(least), F.when(minutes == m, b).otherwise(most)
    return F.struct(least.alias("least"), most.alias("most"), F.when(minutes.isin(*BUDGETS), "timed").otherwise("pill").alias("mode"))


# What counts as a specific value that cited statements must hold.
SPECIFICS = (
    r"\bLei\s+n[ºo°.]?\s*[\d.]+/?\d*", r"\bArt\.?\s*\d+[ºoª°]?", r"\b\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}\b", r"\b\d{4}\b", r"\bR\$\s*[\d.,]+", r"\b\d+[.,]\d+\b",
)
VERBATIM_WORDS, DISTRACTOR_WORDS, TRUE_OVERLAP = 12, 4, 0.8


def specific_values(text: Column) -> Column:
    """Laws, articles, dates, years, amounts and decimals of a text, in lower case."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(spark_regex(p)), F.lit(0)) for p in SPECIFICS]))
    return F.array_distinct(F.transform(found, lambda v: F.lower(squeeze(v))))


def overlap_form(text: Column) -> Column:
    """Letters and digits without accents, in lower case, with single spaces."""
    return squeeze(F.regexp_replace(fold(text), r"[^\p{L}\p{N}\s]", " "))


def word_overlap(a: Column, b: Column) -> Column:
    """Shared words of three letters and more over those of the side that has more; for texts in overlap form."""
    words = lambda x: F.array_distinct(F.filter(F.split(x, " "), lambda w: F.char_length(w) > 2))
    return let(words(a), lambda x: let(words(b), lambda y: F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y)))))


def grounding_reasons(item: Column) -> Column:
    """Reasons against a generated item: citations, specific values, a key taken word for word, a distractor that is true.

    ``item`` has origin, units, allowed, statements, prompt, options and correct (from 0).
    """
    none = F.array().cast("array<string>")
    tidy = lambda a: F.filter(F.transform(F.coalesce(a, none), lambda x: trim(F.coalesce(x, F.lit("")))), lambda x: x != "")
    when = lambda c, name: F.when(c, F.lit(name))
    words = lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))
    cited, allowed, statements = tidy(item.units), tidy(item.allowed), tidy(item.statements)
    prompt, options = F.coalesce(item.prompt, F.lit("")), F.transform(F.coalesce(item.options, none), lambda o: trim(F.coalesce(o, F.lit(""))))
    corpus, lower = F.lower(F.array_join(statements, "\n")), F.lower(prompt)
    bare = lambda v: F.regexp_like(v, F.lit(r"^\d{4}$")) & ~F.regexp_like(lower, F.lit("lei|art"))
    ungrounded = (F.size(cited) == 0) | ((F.size(allowed) > 0) & (F.size(F.array_except(cited, allowed)) > 0))
    unsupported = (F.size(statements) > 0) & let(corpus, lambda c: F.exists(specific_values(prompt), lambda v: ~bare(v) & ~F.contains(c, v)))
    forms = F.transform(statements, overlap_form)
    key = F.get(options, item.correct)
    verbatim = F.coalesce((words(key) > VERBATIM_WORDS) & F.exists(forms, lambda f: F.contains(f, overlap_form(key))), F.lit(False))
    others = F.filter(options, lambda o, i: (i != item.correct) & (words(o) >= DISTRACTOR_WORDS))
    true = F.coalesce(let(forms, lambda fs: F.exists(others, lambda o: F.exists(fs, lambda f: word_overlap(overlap_form(o), f) >= TRUE_OVERLAP))), F.lit(False))
    reasons = F.array_compact(F.array(when(ungrounded, "ungrounded_citation"), when(unsupported, "unsupported_specific"), when(verbatim, "verbatim_answer"), when(true, "distractor_is_true")))
    return F.when(F.coalesce(item.origin == "generation", F.lit(False)), reasons).otherwise(none)


# Stems about the exam itself, about its programme, about the present, and citations of law.
EXAM_STEM = (
    r"\b(inscri[cç][oõ]es|cargo|vagas?|remunera[cç][aã]o|sal[aá]rio|taxa de inscri|edital(?:\s+n|\s+de\s+abertura)|banca|institui[cç][aã]o|associa[cç][aã]o|certifica[cç][aã]o|cronograma|local(?:\s+de)?\s+prova"
    r"|(?:em\s+que\s+)?cidade|aplicad[ao]s?\s+a\s+prova|prova objetiva|homologa[cç][aã]o|escolaridade exigida|documento deve ser apresentado|quantas quest[oõ]es|oferecid[oa]|promovendo|concurso p[uú]blico aberto|exame para certifica)\b"
)
PROGRAMME_STEM = r"\b(constam? no conte[uú]do program[aá]tico|quais assuntos|quais disciplinas|programa do concurso|anexo.*(portugu[eê]s|matem[aá]tica))\b"
TEMPORAL, LEGAL = r"\b(atual(mente)?|hoje|vigente|neste ano|este ano|\d{4})\b", r"\b(lei\s+n|art\.?\s*\d|§\s*\d)"
NEAR_STEM, METADATA_STEM = 85, 0.5


def relevance_verdict(item: Column) -> Column:
    """struct(reasons, review): what fails an item, and what only sends it to review.

    ``item`` has origin, units, leaf, leaf_valid, prompt, options, explanation, previous and stems (of the leaf).
    """
    none = F.array().cast("array<string>")
    like = lambda c, p: F.regexp_like(c, F.lit(spark_regex(p)))
    when = lambda c, name: F.when(c, F.lit(name))
    text = lambda c: F.coalesce(c, F.lit(""))
    prompt, options = trim(text(item.prompt)), F.transform(F.coalesce(item.options, none), text)
    made = F.coalesce(item.origin == "generation", F.lit(False))
    uncited = F.size(F.filter(F.coalesce(item.units, none), lambda u: trim(text(u)) != "")) == 0
    exam = like(prompt, LISTING) | F.exists(options, lambda o: like(o, LISTING)) | like(prompt, EXAM_STEM) | ((prompt != "") & (metadata_probability(prompt) > METADATA_STEM))
    near = lambda stems: F.exists(F.coalesce(stems, none), lambda x: (text(x) != "") & (token_set_ratio(prompt, x) >= NEAR_STEM))
    blob = F.concat_ws("\n", prompt, F.array_join(options, "\n"), text(item.explanation))
    reasons = F.array(
        when(made & uncited, "knowledge_unit_ids_missing"), when(made & ((trim(text(item.leaf)) == "") | ~F.coalesce(item.leaf_valid, F.lit(True))), "off_syllabus"), when(exam, "tests_exam_metadata"),
        when(like(prompt, PROGRAMME_STEM), "tests_syllabus_meta"), when(near(item.previous), "copied_previous_question"), when(near(item.stems), "duplicate_question"),
    )
    return F.struct(F.array_compact(reasons).alias("reasons"), F.array_compact(F.array(when(like(prompt, TEMPORAL) & ~like(blob, LEGAL), "temporally_dependent"))).alias("review"))


def primary_domain(evidence: Column) -> Column:
    """The host of the first address among an evidence's; null without any."""
    hosts = F.transform(F.coalesce(evidence, F.array().cast("array<string>")), lambda u: host_of(u))
    return F.get(F.filter(hosts, lambda h: h != ""), F.lit(0))


def is_keyed(kind: Column, options: Column, correct: Column, selected: Column) -> Column:
    """Whether an answer can be graded by its key: multiple choice of two options at least, a key among them, and a choice made."""
    return F.coalesce((kind == "MULTIPLE_CHOICE") & (options >= 2) & (correct >= 0) & (correct < options) & selected.isNotNull(), F.lit(False))


def downgraded(decision: Column, reasons: Column, stem: Column) -> Column:
    """struct(decision, reasons): what is published goes to review if its stem depends on the present and cites no law."""
    like = lambda p: F.regexp_like(stem, F.lit(spark_regex(p)))
    soft = (decision == "published") & like(TEMPORAL) & ~like(LEGAL)
    return F.struct(F.when(soft, "needs_review").otherwise(decision).alias("decision"), F.when(soft, F.array_append(reasons, F.lit("temporally_dependent"))).otherwise(reasons).alias("reasons"))
