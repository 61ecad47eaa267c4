"""Detail pages of exams: title, who holds and who sets it, edition, registration window, status, documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import let, squeeze, trim
from millrace.operators.curation import spark_regex
from millrace.operators.items import HINTS
from millrace.operators.roles import has as like
from millrace.operators.syllabus import slug_key
from millrace.sources.listings import decoded, document_links
from millrace.sources.pages import OPEN_HINT, is_junk_title, is_navigation_slug, path_of

# Kinds of exams, registration windows.
NO_EXAM = r"\b(CFP|certifica[çc][ãa]o|vestibular|mestrado|resid[êe]ncia m[ée]dica|processo seletivo de faculdade)\b"
OAB, PUBLIC = r"\boab\b|exame\s+de\s+ordem", r"\bconcurso\s+p[uú]blico\b"
WINDOWS = (
    r"inscri[çc][õo]es?\s*:?\s+(?:de\s+)?([0-9]{1,2}/[0-9]{1,2}(?:/[0-9]{2,4})?)\s+(?:a|at[ée])\s+([0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4})",
    r"per[ií]odo\s+de\s+inscri[çc][õo]es?\s*:?\s*(?:de\s+)?([0-9]{1,2}/[0-9]{1,2}(?:/[0-9]{2,4})?)\s+(?:a|at[ée])\s+([0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4})",
    r"inscri[çc][õo]es?\s+abertas?\s+(?:de\s+)?([0-9]{1,2}/[0-9]{1,2}(?:/[0-9]{2,4})?)\s+(?:a|at[ée])\s+([0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4})",
)
UNTIL = r"inscri[çc][õo]es?\s+(?:abertas\s+)?at[ée]\s+([0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4})"
# Headlines, holders, setters, subjects, posts, and where an edition stands.
HEADLINE = r"([A-ZÀ-Ú][A-ZÀ-Ú0-9 .'-]{2,60}?\s*[-–]\s*(?:CONCURSO\s+P[ÚU]BLICO|PROCESSO\s+SELETIVO)\s*[-–]?\s*(?:N[ºo°.]?\s*)?\d{1,4}/20\d{2}(?:\s+[A-ZÀ-Ú][A-ZÀ-Ú-]{1,20})?)"
HOLDER = r"\b(transpetro|petrobras|banco\s+do\s+brasil|bb|caixa(?:\s+econ[oô]mica)?|correios|marinha|inss|receita\s+federal|pol[ií]cia\s+federal|pf|prefeitura|ibamsp|aneel|anatel|anvisa|ibama|mpm|mpu|tcu|tst|trf|trt|prf)\b"
SETTER = r"\b(cesgranrio|fgv|fcc|cebraspe|cespe|vunesp|ibfc|iades|fundatec|fundetec|ibamsp|aocp|quadrix|idecan|consulplan)\b"
EMPHASIS = r"\b(administra[cç][aã]o|engenharia(?:\s+\w+)?|direito|contabilidade|tecnologia\s+da\s+informa[cç][aã]o|TI|enfermagem|medicina)\b"
POST = r"\b(?:cargo(?:s)?|vaga(?:s)?)\s*(?:de|:)?\s*([A-ZÁÉÍÓÚÂÊÔÃÕÇ][\w\s\-/]{3,60})"
NOTICE_NUMBER = r"\bedital\s+(?:de\s+abertura\s+)?n[ºo°.]?\s*(\d[\d./-]*)"
PATH = r"/concursos?/([^/]+)/?$"
#: Kinds of documents that specify an exam.
SPECIFYING = [k for k, role, _ in HINTS if role == "specification"]
LEAST_TITLE, BLOCK_CHARS, MOST_EMPHASIS, MOST_POSTS, SELF_SHARE = 8, 600, 6, 12, 0.6


def exam_kind(title: Column, text: Column) -> Column:
    """oab, concurso, vestibular or other; a title that says concurso settles it."""
    blob = F.regexp_replace(F.concat_ws(" ", title, text), "<[^>]+>", " ")
    settled = like(title, r"\bconcurso\b") & ~like(title, NO_EXAM) & ~like(title, r"\bvestibular\b")
    return F.when(like(blob, OAB), "oab").when(settled, "concurso").when(like(blob, r"\bvestibular\b") & ~like(blob, PUBLIC), "vestibular").when(like(blob, NO_EXAM) & ~like(blob, PUBLIC), "other").otherwise("concurso")


def brazilian_date(text: Column) -> Column:
    """d/m/yy or d/m/yyyy; days over a month's end run on into the next, as long as they are at most 31."""

    def made(p: Column) -> Column:
        day, month, year = (F.get(p, F.lit(k)) for k in range(3))
        return F.when(month.between(1, 12) & day.between(1, 31), F.date_add(F.make_date(F.when(year < 100, year + 2000).otherwise(year), month, F.lit(1)), day - 1))

    return F.when(F.regexp_like(text, F.lit("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}$")), let(F.transform(F.split(text, "/"), lambda x: x.try_cast("int")), made))


def registration_window(text: Column) -> Column:
    """struct(start, end) of the first range form that gives two dates, else of an end alone; a start without a year has the end's."""
    both = lambda w: F.when(w.start.isNotNull() & w.end.isNotNull(), w)

    def window(found: Column) -> Column:
        first, end = F.get(found, F.lit(0)), F.get(found, F.lit(1))
        start = F.when(F.regexp_like(first, F.lit("/.*/")), first).otherwise(F.concat_ws("/", first, F.substring_index(end, "/", -1)))
        return let(F.struct(brazilian_date(start).alias("start"), brazilian_date(end).alias("end")), both)

    def read(plain: Column) -> Column:
        ranges = [let(F.array(*(F.regexp_extract(plain, "(?iu)" + p, k) for k in (1, 2))), window) for p in WINDOWS]
        last = let(brazilian_date(F.regexp_extract(plain, "(?iu)" + UNTIL, 1)), lambda d: F.when(d.isNotNull(), F.struct(d.alias("start"), d.alias("end"))))
        return F.coalesce(*ranges, last)

    return let(squeeze(text), read)


def text_of(html: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, r"(?is)<script.*?</script>", " "), r"(?is)<style.*?</style>", " "), r"<[^>]+>", " ")
    return decoded(squeeze(plain))


def _first(c: Column, pattern: str, group: int = 0) -> Column:
    found = F.regexp_extract(c, spark_regex(pattern), group)
    return F.when(found != "", found)


def path_slug(url: Column) -> Column:
    """The slug that names an exam in an address, in lower case with hyphens; null for numbers and words of navigation."""
    raw = F.regexp_extract(path_of(url), "(?i)" + PATH, 1)
    plain = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), F.lit(""))
    words = trim(F.regexp_replace(plain, "[-_]+", " "))
    return let(slug_key(words), lambda s: F.when((words != "") & (F.char_length(s) >= 4) & s.rlike("[a-z]") & ~is_navigation_slug(s), s))


def detail_title(html: Column, text: Column, url: Column, listed: Column) -> Column:
    """A headline; the first heading or the page's title unless chrome; a second heading that is none; the address; the listing's words."""
    headline = F.regexp_extract(text, HEADLINE, 1)
    tag = lambda name: text_of(F.regexp_extract(html, rf"(?is)<{name}[^>]*>(.*?)</{name}>", 1))
    own = let(tag("h1"), lambda h: F.when(F.char_length(h) >= LEAST_TITLE, h).otherwise(let(tag("title"), lambda t: F.when(F.char_length(t) >= LEAST_TITLE, t).otherwise(""))))
    seconds = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<h2[^>]*>(.*?)</h2>"), 1), text_of)
    second = F.get(F.filter(seconds, lambda t: F.char_length(t).between(5, 120) & ~is_junk_title(t)), F.lit(0))
    in_path = let(path_slug(url), lambda s: F.upper(F.replace(s, F.lit("-"), F.lit(" "))))

    def chosen(t: Column) -> Column:
        last = F.when(is_junk_title(listed), F.when(t != "", t).otherwise(listed)).otherwise(listed)
        return F.when(headline != "", squeeze(headline)).when((t != "") & ~is_junk_title(t), t).otherwise(F.coalesce(second, in_path, last))

    return let(own, chosen)


def edition_key(text: Column, title: Column, url: Column) -> Column:
    """The notice's number, else the year of the address (also as two digits), else that of the title."""
    slug = path_slug(url)
    short = F.regexp_extract(slug, r"(?:^|-)(2\d)(?:-|$)", 1)
    year = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    return F.coalesce(_first(text, NOTICE_NUMBER, 1), year(slug, r"(20\d{2})"), F.when(short != "", F.concat(F.lit("20"), short)), year(title, r"(?<![A-Za-z0-9_])(20\d{2})(?![A-Za-z0-9_])"))


def detail_pages(pages: DataFrame, today: Column, key: str = "page_id") -> DataFrame:
    """What a detail page (key, url, html, listed) tells: title, org, banca, edition, slug, kind, start, end, status, source, positions, emphasis, n_documents, notice, identified.

    Who holds and sets an exam is read off the title, then off the head of the page, which navigation fills with other exams less. ``identified`` is false
    for pages without edition, window or a document that specifies the exam.
    """
    rows = pages.withColumn("text", text_of(F.col("html")))
    rows = rows.withColumn("title", detail_title(F.col("html"), F.col("text"), F.col("url"), F.col("listed")))
    head = F.substring("text", 1, BLOCK_CHARS)
    block = F.concat("title", F.lit(" "), head)
    text, title = F.col("text"), F.col("title")
    rows = rows.withColumns(
        {
            "org": F.coalesce(_first(title, HOLDER), _first(block, HOLDER)),
            "banca": F.coalesce(_first(title, SETTER), _first(block, SETTER), _first(text, SETTER)),
            "edition": edition_key(text, title, F.col("url")),
            "kind": exam_kind(title, head),
            "window": registration_window(text),
            "positions": F.slice(F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(spark_regex(POST)), 1), squeeze), lambda p: F.char_length(p) >= 4)), 1, MOST_POSTS),
            "emphasis": F.slice(F.array_distinct(F.transform(F.regexp_extract_all(F.concat(title, F.lit(" "), text), F.lit(spark_regex(EMPHASIS)), 0), squeeze)), 1, MOST_EMPHASIS),
        }
    )
    hint = like(text, OPEN_HINT) | like(title, OPEN_HINT)
    dated = F.col("window").isNotNull()
    rows = rows.withColumns({"source": F.when(dated, "date").when(hint, "regex"), "status": F.when(F.when(dated, today.between(F.col("window.start"), F.col("window.end"))).otherwise(hint), "open").otherwise("unknown")})
    rows = rows.withColumn("slug", F.when(F.col("org").isNotNull() & F.col("edition").isNotNull(), F.concat(slug_key(F.col("org")), F.lit("-"), "edition")))
    links = document_links(pages.select(key, "url", "html"), key)
    specifies = F.col("kind").isin("edital", "retificacao")
    named = F.when(specifies, F.struct(F.lit(0).alias("rank"), "pos", "href")).when(like(F.col("href"), "edital"), F.struct(F.lit(1).alias("rank"), "pos", "href"))
    counted = links.groupBy(key).agg(F.count("*").alias("n_documents"), F.min(named).alias("notice"), F.bool_or(F.col("kind").isin(*SPECIFYING)).alias("specified"))
    rows = rows.join(counted, key, "left")
    known = F.col("edition").isNotNull() | dated | F.coalesce("specified", F.lit(False))
    return rows.select(
        key, "title", "org", "banca", "edition", "slug", "kind", F.col("window.start").alias("start_day"), F.col("window.end").alias("end_day"), "status", "source", "positions", "emphasis",
        F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.col("notice.href").alias("notice"), (known & ~is_junk_title(title)).alias("identified"),
    )


def self_details(details: DataFrame, listed: DataFrame, documents: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, own) of pages: whether a source's start page is itself an exam's page: it has a window and documents, and six in ten of the links it lists (key, href) are PDFs or its documents."""
    mine = documents.select(key, "href", F.lit(True).alias("own"))
    told = listed.select(key, "href").join(mine, [key, "href"], "left").groupBy(key).agg(F.count("*").alias("links"), F.count_if(like(F.col("href"), r"\.pdf(\?|#|$)") | F.col("own").isNotNull()).alias("held"))
    rows = details.join(told, key, "left")
    mostly = F.coalesce(F.col("held") / F.col("links") >= SELF_SHARE, F.lit(True))
    return rows.select(key, (F.col("end_day").isNotNull() & (F.col("n_documents") > 0) & mostly).alias("own"))


#: Addresses of exams of a year, as the last words of a slug and anywhere in it.
YEARLY = (r"/concursos?/[^/?#]+-(20\d{2})(?:/|$)", r"/concursos?/[^/?#]*?(20\d{2})(?:/|$)")


def listed_exams(links: DataFrame, today: Column) -> DataFrame:
    """What a listing's link (title, href, domain, text) tells of an exam, added to it: org, banca, edition, slug, kind, emphasis, edital, status, source.

    A window decides whether it is open, else wording or an address of this year or later; an edition of a past year is never open.
    """
    title, href, text = squeeze(F.col("title")), F.col("href"), F.coalesce("text", F.lit(""))
    year = lambda c, p: F.regexp_extract(c, "(?i)" + p, 1).try_cast("int")
    rows = links.withColumn("title", title)
    title = F.col("title")
    rows = rows.withColumns({"org": F.coalesce(_first(title, HOLDER), _first(F.col("domain"), HOLDER)), "banca": _first(title, SETTER), "edition": edition_key(F.lit(""), title, href), "window": registration_window(F.concat_ws(" ", F.nullif(text, F.lit("")), title)), "path": path_slug(href)})
    named = F.when(F.col("org").isNotNull() & F.col("edition").isNotNull(), F.concat(slug_key(F.col("org")), F.lit("-"), "edition"))
    rows = rows.withColumn("slug", F.coalesce("path", named, slug_key(F.substring("title", 1, 80))))
    told = F.regexp_extract(F.concat_ws(" ", "edition", "slug", "title", "href", F.col("window.end").cast("string")), r"(?<![A-Za-z0-9_])(20\d{2})(?![A-Za-z0-9_])", 1).try_cast("int")
    this_year = F.coalesce(told >= F.year(today), F.lit(True))
    by_address = F.coalesce(year(href, YEARLY[0]) >= F.year(today), F.lit(False)) | F.coalesce(year(href, YEARLY[1]) >= F.year(today), F.lit(False))
    likely, dated = this_year & (like(title, OPEN_HINT) | by_address), F.col("window").isNotNull()
    is_open = F.when(dated, this_year & today.between(F.col("window.start"), F.col("window.end"))).otherwise(likely)
    emphasis = F.slice(F.array_distinct(F.transform(F.regexp_extract_all(title, F.lit(spark_regex(EMPHASIS)), 0), squeeze)), 1, MOST_EMPHASIS)
    return rows.withColumns(
        {
            "kind": exam_kind(title, text), "emphasis": emphasis, "edital": F.when(like(href, "edital|pdf"), href),
            "status": F.when(is_open, "open").otherwise("unknown"), "source": F.when(dated, "date").when(likely, "regex"),
        }
    ).drop("window", "path")
