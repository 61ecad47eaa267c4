"""Reading web pages: plain text, links, URL screens and ranks, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import host_of, let, squeeze, trim
from millrace.operators.curation import spark_regex

# Domains, endings, path parts and parameters that are never fetched.
DENIED_DOMAINS = (
    "facebook.com instagram.com twitter.com x.com tiktok.com youtube.com youtu.be linkedin.com pinterest.com reddit.com telegram.me t.me whatsapp.com "
    "discord.com vimeo.com twitch.tv spotify.com quora.com medium.com hotmart.com kiwify.com.br eduzz.com amazon.com.br amazon.com mercadolivre.com.br "
    "shopee.com.br aliexpress.com olx.com.br udemy.com apple.com google.com bing.com scribd.com passeidireto.com docsity.com brainly.com.br yumpu.com "
    "issuu.com slideshare.net studocu.com academia.edu researchgate.net 4shared.com mega.nz drive.google.com docs.google.com dropbox.com "
    "onedrive.live.com wattpad.com qconcursos.com tecconcursos.com.br pciconcursos.com.br concursosnobrasil.com.br jusbrasil.com.br g1.globo.com globo.com "
    "folha.uol.com.br uol.com.br estadao.com.br terra.com.br r7.com cnnbrasil.com.br metropoles.com correiobraziliense.com.br gazetadopovo.com.br "
    "veja.abril.com.br band.uol.com.br sbt.com.br"
).split()
DENIED_TLD = r"\.(cn|ru|mo|hk|jp|kr|tw|vn|th|ir|tr|pl|cz|ua|by|kz)$"
DENIED_FILE = r"\.(zip|rar|7z|tar|gz|mp3|mp4|avi|mov|wmv|mkv|jpe?g|png|gif|svg|webp|pptx?|xlsx?|csv|exe|apk|dmg)$"
DENIED_PATH = r"/(login|cadastro|carrinho|checkout|comprar|assinar|plano|premium|paywall|jurisprudencia|diario-?oficial|noticias?|news|tag|tags|categoria|category|author|autor|search|busca|feed|wp-json|comentarios|forum|questoes|simulados?|cursos?|videos?)(/|$)"
PAGINATION = r"/page/\d+|[?&](page|pagina)=\d+"
TRACKING = "utm_source utm_medium utm_campaign utm_term utm_content gclid fbclid mc_cid mc_eid".split()
TITLE_SPAM = r"simulado\s+gr[aá]tis|baixe\s+agora|curso\s+completo|promo[cç][aã]o|gabarito\s+extraoficial|resultado\s+(?:final|preliminar)|convoca[cç][aã]o|inscri[cç][oõ]es\s+abertas|edital\s+publicado"
SOCIAL_HOSTS = (
    "instagram.com facebook.com twitter.com x.com tiktok.com youtube.com youtu.be linkedin.com pinterest.com tumblr.com reddit.com whatsapp.com telegram.me "
    "ebay.com amazon.com mercadolivre.com shopee.com shein.com olx.com olx.com.br"
).split()
COMMERCIAL_HOSTS = (
    "qconcursos.com tecconcursos.com.br pciconcursos.com.br concursosnobrasil.com.br grancursosonline.com.br estrategiaconcursos.com.br passeidireto.com scribd.com"
).split()
LOGIN_HOST = r"^(login|auth|accounts|sso)\."
SOCIAL_WORDS = r"\b(social|navigation|link farm|linkfarm)\b"
STOREFRONT_WORDS = r"\b(loja|shop|store|assine|compre|promo)\b"
UNRELATED_WORDS = r"\b(marketplace|hotel|market|flea|wedding)\b"
NAV_WORDS = (
    "concurso concursos concluido concluidos encerrado encerrados novo novos em andamento inscricoes inscricao abertas aberto abertos premios e "
    "cultural vestibular vestibulares selecoes selecao processos seletivos editais edital provas resultados index home todos proximos lista "
    "publico publicos geral outros mais informacoes"
).split()
TEMPLATE_LEFT = r"\$\(|\+\s*'|\{\{|</?\w+>|\|"
CHROME_TITLE = r"^(?:mais informa|nosso portf|concursos?|em andamento|inscri[cç][oõ]es abertas|conclu[ií]dos|encerrados|cultural|pr[eê]mios e concursos)\s*(?:[-–|].*)?$"
MEDIA_HOSTS = "wikimedia.org wikipedia.org upload.wikimedia.org".split()
OUTPUT_POLICIES = (
    ("script-exec", r"<script\b|javascript:|\bon(load|error|click|submit|mouseover)\s*="),
    ("data-exfil", r"\b(webhook\.site|exfiltrat\w*|pastebin\.com|requestbin\w*|ngrok\.(io|dev|app)|pipedream\.net|burpcollaborator\.net)\b|\bcurl\b\s+https?:|\bnc\s+-e\b"),
    ("tracking", r"\btracking\s+pixel\b|\butm_[a-z]+\b|\b(pixel|beacon)\.(gif|png|js)\b"),
)
#: Domains whose pages are knowledge, whatever their rank; the last rank of others.
KNOWLEDGE_DOMAINS = "planalto.gov.br lexml.gov.br in.gov.br senado.leg.br camara.leg.br stf.jus.br stj.jus.br atos.cnj.jus.br cnj.jus.br portal.mec.gov.br gov.br inep.gov.br".split()
LAST_RANK = 20
#: Wording that asks a reader to act, and words that tell Portuguese.
CALLS_TO_ACT, PORTUGUESE = r"inscreva-se|assine|compre|cupom|desconto|plano\s+premium", r"\b(de|da|do|que|para|com|uma|não|são|artigo|lei|concordância|verbo)\b"
LEAST_TEXT, MOST_LINKS, MOST_CALLS, HINT_CHARS, LEAST_SENTENCE = 1200, 0.25, 0.2, 2000, 20
#: What posts about exams say, their addresses, and those that lead to files.
EXAM_TALK = r"\b(concursos?|editais?|edital|oab|provas?|gabarito|inscri[cç]([aã]o|[oõ]es)|banca|cespe|cebraspe|fcc|fgv|vunesp|cesgranrio|conte[uú]do\s+program)"
OPEN_HINT = r"\b(inscri[cç][oõ]es?\s+abertas?|edital\s+(?:publicado|de\s+abertura)|concurso\s+aberto|aceita\s+inscri|prazo\s+de\s+inscri)"
POST_URL = r"https?://[^\s<>\"'）)\]]+"
POST_SOCIAL = "instagram.com facebook.com twitter.com x.com tiktok.com youtube.com youtu.be linkedin.com pinterest.com tumblr.com reddit.com redd.it whatsapp.com telegram.me t.me telegram.org".split()
FILE_URL, FILE_PATH = r"\.(pdf|docx?|odt|rtf|xlsx?|pptx?)(?:$|[?#])", r"/(edital|prova|gabarito|caderno|retifica)"
FILE_HOST, FILE_WORD = r"drive\.google\.com|docs\.google\.com|dropbox\.com|mediafire\.com", r"\b(edital|prova|gabarito|caderno|retifica|programa)\b"
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://[^/?#]+([^?#]*)", 1)


def query_keys(url: Column) -> Column:
    asked = F.regexp_extract(url, r"\?([^#]*)", 1)
    return F.transform(F.filter(F.split(asked, "&"), lambda p: p != ""), lambda p: F.lower(F.substring_index(p, "=", 1)))


def within(host: Column, domains: list[str]) -> Column:
    """Host equals a domain or lies under it. Each of the host's endings is looked up in a set."""
    parts = F.split(host, r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.arrays_overlap(endings, F.array(*[F.lit(d) for d in domains]))


def reject_reason(url: Column, title: Column, denied: list[str] = DENIED_DOMAINS) -> Column:
    """The first rule that turns a candidate away, or null."""
    host, keys = host_of(url), query_keys(url)
    like = lambda c, p: F.regexp_like(c, F.lit("(?iu)" + p))
    return (
        F.when(host == "", "bad_url")
        .when(within(host, denied), "denylist_domain")
        .when(like(host, DENIED_TLD), "denylist_tld")
        .when(like(path_of(url), DENIED_FILE), "deny_file_type")
        .when(like(path_of(url), DENIED_PATH), "deny_path")
        .when(like(url, PAGINATION), "deny_pagination")
        .when(F.size(keys) >= 3, "too_many_params")
        .when(F.arrays_overlap(keys, F.array(*[F.lit(k) for k in TRACKING])), "tracking_param")
        .when(like(title, TITLE_SPAM), "title_spam")
    )


def html_to_text(html: Column) -> Column:
    """Plain text by ordered replacements; block ends become line ends."""
    out = html
    for pattern, to in (
        (r"(?is)<script.*?</script>", " "), (r"(?is)<style.*?</style>", " "), (r"(?is)<noscript.*?</noscript>", " "), (r"(?s)<!--.*?-->", " "),
        (r"(?i)</(p|div|h[1-6]|li|tr|br|hr)[^>]*>", "\n"), (r"(?i)<br\s*/?>", "\n"), (r"<[^>]+>", " "),
    ):
        out = F.regexp_replace(out, pattern, to)
    for entity, char in ENTITIES:
        out = F.regexp_replace(out, "(?i)" + entity, char)
    for pattern, to in ((r"\s+\n", "\n"), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " ")):
        out = F.regexp_replace(out, pattern, to)
    return trim(out)


def rough_text(html: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, r"(?is)<script.*?</script>", " "), r"(?is)<style.*?</style>", " "), r"<[^>]+>", " ")
    return squeeze(F.replace(F.replace(out, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&")))


def title_of(html: Column) -> Column:
    return squeeze(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def anchor_share(html: Column) -> Column:
    """Share of the markup that lies in anchors."""
    anchors = F.regexp_extract_all(html, F.lit(r"(?is)(<a\b[^>]*>.*?</a>)"), F.lit(1))
    total = F.aggregate(anchors, F.lit(0), lambda a, x: a + F.char_length(x))
    return F.when(F.char_length(html) > 0, total / F.char_length(html)).otherwise(0.0)


def links_of(pages: DataFrame, least_title: int = 1) -> DataFrame:
    """page_id, pos, href, title: the first link of each href."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*href=\"([^\"]*)\"[^>]*>.*?</a>"), F.lit(1))
    titles = F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*href=\"[^\"]*\"[^>]*>(.*?)</a>"), F.lit(1))
    rows = pages.select("page_id", F.posexplode(F.arrays_zip(found.alias("href"), titles.alias("title"))).alias("pos", "a"))
    rows = rows.select("page_id", "pos", F.col("a.href").alias("href"), squeeze(F.regexp_replace(F.col("a.title"), "<[^>]+>", " ")).alias("title")).where(F.char_length("title") >= least_title)
    first = F.min(F.struct("pos", "title")).alias("first")
    return rows.groupBy("page_id", "href").agg(first).select("page_id", "href", "first.pos", "first.title")


def blocked_by(text: Column) -> Column:
    """The first output policy that the text violates, or null."""
    first, *rest = OUTPUT_POLICIES
    out = F.when(F.regexp_like(text, F.lit("(?i)" + first[1])), first[0])
    for name, pattern in rest:
        out = out.when(F.regexp_like(text, F.lit("(?i)" + pattern)), name)
    return out


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def page_rank(authority: Column, density: Column, relevance: Column, structure: Column, freshness: Column) -> Column:
    return clamp01(0.35 * authority + 0.25 * density + 0.2 * relevance + 0.1 * structure + 0.1 * freshness)


def structure_score(text: Column) -> Column:
    like = lambda p, w: F.when(F.regexp_like(text, F.lit(p)), w).otherwise(0.0)
    return clamp01(like(r"(?m)^#{1,3}\s|^\d+(\.\d+)*\s", 0.35) + like(r"(?i)por exemplo|exemplo:", 0.25) + like(r"(^|\n)\s*[-*•]\s|(^|\n)\s*\d+[.)]\s", 0.2) + like(r"(?i)art\.\s*\d+", 0.2))


def hard_deny(name: Column, url: Column) -> Column:
    """Why a source may never be registered, or null."""
    host = host_of(url)
    hay = F.concat_ws(" ", F.coalesce(name, F.lit("")), host)
    like = lambda c, p: F.regexp_like(c, F.lit(spark_regex(p)))
    return (
        F.when(host.isin(*SOCIAL_HOSTS), "social_host")
        .when(within(host, COMMERCIAL_HOSTS), "commercial_bank")
        .when(like(host, LOGIN_HOST), "login_host")
        .when(like(hay, SOCIAL_WORDS), "social_words")
        .when(like(hay, STOREFRONT_WORDS), "storefront_words")
        .when(like(hay, UNRELATED_WORDS), "unrelated_words")
    )


def is_navigation_slug(key: Column) -> Column:
    """Nothing but words of navigation."""
    return F.forall(F.filter(F.split(F.lower(key), "-"), lambda w: w != ""), lambda w: w.isin(*NAV_WORDS))


def is_junk_title(title: Column) -> Column:
    """Too short, left over from a template, or site chrome."""
    t = trim(title)
    return (F.char_length(t) < 4) | F.regexp_like(t, F.lit(TEMPLATE_LEFT)) | F.regexp_like(t, F.lit("(?iu)" + CHROME_TITLE))


def media_allowed(url: Column, hosts: list[str] = MEDIA_HOSTS) -> Column:
    """A relative path, or https to a listed host or one under it, without credentials."""
    href = trim(url)
    host = F.lower(F.regexp_extract(href, r"^https://([^/?#:@]+)(?::\d+)?(?:[/?#]|$)", 1))
    relative = F.regexp_like(href, F.lit(r"^/(?!/)")) & ~href.contains("\\")
    return relative | ((host != "") & within(host, hosts))


def after_fetch(text: Column, html: Column) -> Column:
    """Why a fetched page is no knowledge, or null: too short, too many links, too many sentences that call to act, or not in Portuguese."""
    has = lambda c, p: F.regexp_like(c, F.lit(spark_regex(p)))
    sentences = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda b: F.char_length(trim(b)) > LEAST_SENTENCE)
    calls = F.size(F.filter(sentences, lambda b: has(b, CALLS_TO_ACT))) / F.greatest(F.size(sentences), F.lit(1))
    return (
        F.when(F.char_length(text) < LEAST_TEXT, "too_short")
        .when(anchor_share(html) > MOST_LINKS, "link_density")
        .when(calls > MOST_CALLS, "cta_ratio")
        .when(~has(F.substring(text, 1, HINT_CHARS), PORTUGUESE), "language")
    )


def post_signal(text: Column) -> Column:
    """struct(relevant, reason, files) of a post: whether it talks of exams, and its links to files that are not on social hosts."""
    has = lambda c, p: F.regexp_like(c, F.lit(spark_regex(p)))
    urls = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("(?i)" + POST_URL), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;:!?)\]}>]+$", "")))

    def is_file(u: Column) -> Column:
        host = host_of(F.lower(u))
        return (host != "") & ~within(host, POST_SOCIAL) & (has(u, FILE_URL) | has(u, FILE_PATH) | has(u, FILE_HOST) | has(F.concat(text, F.lit(" "), u), FILE_WORD))

    def told(files: Column) -> Column:
        talk, some = has(text, EXAM_TALK) | has(text, OPEN_HINT), F.size(files) > 0
        reason = F.when(talk & some, "exam talk + file link(s)").when(talk, "exam talk only").when(some, "outbound exam-like file link without exam keywords").otherwise("no exam talk or file links")
        return F.struct((talk | some).alias("relevant"), reason.alias("reason"), files.alias("files"))

    return let(F.filter(urls, is_file), told)
