"""HTML extraction: markup zones, and the suffixes of a host's pages.

Markup is read in one pass into blocks of text in page order. Blocks in menus, headers, footers, sidebars,
notices, adverts, forms and comments are chrome; blocks in an article or main element are main text; all
others are open. Zones say where a text stands; whether it is boilerplate is judged by the whole host:

1. The suffixes of the token streams of all its pages' chrome and open blocks are dealt out by their first ``LONG`` tokens.
   Suffixes that share these lie side by side in the host's suffix array, with common prefixes of ``LONG`` or more; a run is
   repeated if they come from distinct pages (pages of equal html are one page). Every token that a longer
   common substring covers is covered by such runs too, so sorting deeper would add nothing.
2. Main text is looked up among the repeated runs that stand in chrome or beside a declared main text somewhere; those that also stand in the
   main text of one in ``SHARE`` pages of the host (``LEAST_PAGES`` at least) are boilerplate there too.
3. Tokens that repeated runs cover are removed, and the unique runs between them kept: from main blocks by what step 2 found,
   and, on pages that declare no main text, from open blocks by what step 1 found.

A passage that only articles share is no boilerplate: neither chrome nor what stands beside an article holds it. A title, teaser or sentence that
other pages list or quote in their chrome stays too, as it is main text on few pages only.

No task holds a host: runs are counted by grouped aggregation with partial results, so a run on all pages costs one row a
task. Repeated runs are sent to all tasks if they are few (``BROADCAST_RUNS``, counted), else joined by shuffle, with equal results.

Defined results: a null or empty html gives an empty text; a page without a host is judged with the other such pages;
repeated rows are extracted each; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import materialize, slices_by_bytes, table

LONG = 8
#: Repeated runs (of eight bytes each) that are sent to every executor at most.
BROADCAST_RUNS = 1_000_000
SLICE_BYTES = 4 << 20
SHARE, LEAST_PAGES = 3, 5
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?:!|\?)[^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S,
)
#: One attribute after another, from the left: its whole name, then its value if it has one.
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
#: Fixed element names.
RAW = frozenset("script style noscript template textarea title svg iframe object canvas math audio video".split())
FOREIGN = frozenset("svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME_TAGS = frozenset("nav footer aside form button select dialog menu head".split())
MAIN_TAGS = frozenset("article main".split())
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
#: Fixed words that mark chrome as the last word of a class, id or role ("site-footer"), and those that do as the first ("related-posts").
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs footer sidebar aside widget cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended comment comments disqus reply replies respond pagination pager "
    "skip search complementary contentinfo".split()
)
FIRST_WORDS = frozenset(
    "ad ads advert advertisement cookie cookies gdpr consent newsletter share sharing social related recommended comment comments breadcrumb breadcrumbs "
    "nav navbar menu footer sidebar sponsored promo disqus respond pagination".split()
)
#: Fixed words of names that tell of chrome elsewhere: in front ("no-sidebar") and behind ("menu-open").
TELLING = frozenset("no not non with without has have is hide hides show shows".split())
STATES = frozenset("open opened closed enabled disabled active visible free on off left right content page body layout main wrapper container".split())
#: Fixed words that are also used of what an article shows: they mark chrome alone, or behind a word for a part of the site.
SHARED_WORDS = frozenset("menu banner notice alert".split())
SITE_WORDS = frozenset("site main top bottom page side left right header footer nav navigation mobile desktop primary secondary global user account mega dropdown drop sub context ad ads promo cookie cookies consent gdpr privacy hero offcanvas sticky floating".split())
#: Elements whose class tells how something of the article looks.
SHOWING = frozenset("figure figcaption picture img table".split())
WORDS_IN_NAME = re.compile(r"[a-z]+")
CAMEL = re.compile(r"([a-z])([A-Z])")


def names_chrome(name: str) -> bool:
    """Whether one class, id or role names a menu, advert, notice or the like; a name is judged whole, not by any word in it."""
    parts = WORDS_IN_NAME.findall(CAMEL.sub(r"\1 \2", name).lower())
    if not parts or parts[0] in TELLING or (len(parts) > 1 and parts[-1] in STATES):
        return False
    if parts[-1] in SHARED_WORDS and len(parts) > 1:
        return parts[0] in FIRST_WORDS or parts[-2] in SITE_WORDS
    return parts[-1] in CHROME_WORDS or parts[0] in FIRST_WORDS


def _is_chrome(tag: str, attributes: str, in_main: int) -> bool:
    if tag in CHROME_TAGS or (tag == "header" and not in_main):
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name == "hidden" or (name == "aria-hidden" and "true" in value.lower()):
            return True
        if name in ("class", "id", "role") and tag not in SHOWING and any(map(names_chrome, value.strip("\"'").split())):
            return True
    return False


def blocks_of(page: str | None) -> list[tuple[str, str]]:
    """(zone, text) of each block in page order; zones are main, open and chrome."""
    out, pending, at = [], [], 0
    chrome_tag, chrome_depth, main_depth = None, 0, 0
    page = page or ""
    size = len(page)

    def zone() -> str:
        return "chrome" if chrome_tag else "main" if main_depth else "open"

    def flush():
        if pending:
            text = " ".join(entities.unescape("".join(pending)).split())
            if text:
                out.append((zone(), text))
            pending.clear()

    while at < size:
        found = TOKEN.search(page, at)
        if not found:
            pending.append(page[at:])
            break
        if found.start() > at:
            pending.append(page[at : found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            if found[0].startswith("<![CDATA["):
                pending.append(" ")
            continue
        tag, closing = tag.lower(), bool(found[1])
        if tag in RAW and not closing:
            if not (tag in FOREIGN and found[3].endswith("/")):
                close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = close.end() if close else size
            continue
        if tag in BLOCK_TAGS:
            flush()
        elif tag in ("br", "td", "th"):
            pending.append(" ")
        if tag in VOID:
            continue
        if chrome_tag:
            if tag == "main" and not closing and chrome_tag not in CHROME_TAGS:
                chrome_tag, chrome_depth, main_depth = None, 0, 1  # a class of what wraps the main element
            elif tag == chrome_tag:
                if closing:
                    chrome_depth -= 1
                elif tag in ("p", "li"):
                    chrome_depth = 0  # a new one closes the last
                else:
                    chrome_depth += 1
                if chrome_depth == 0:
                    flush()
                    chrome_tag = None
                    if not closing and _is_chrome(tag, found[3], main_depth):
                        chrome_tag, chrome_depth = tag, 1
            elif closing and tag in MAIN_TAGS and chrome_tag not in MAIN_TAGS and main_depth:
                chrome_tag, main_depth = None, main_depth - 1
            continue
        if closing:
            if tag in MAIN_TAGS:
                main_depth = max(0, main_depth - 1)
        elif _is_chrome(tag, found[3], main_depth):
            flush()
            chrome_tag, chrome_depth = tag, 1
        elif tag in MAIN_TAGS:
            main_depth += 1
    flush()
    return out


#: A value for each byte; sums of values times powers of an odd number tell texts apart by 64 bits.
BYTE_VALUES = np.random.default_rng(64).integers(1, 1 << 63, 256, np.uint64)
ODD = 0x9FB21C651E98DF25


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def runs_of(blocks: list[str], hosts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every suffix of every block with LONG tokens or more: the hash of its first LONG, its block, and its place in it. Hosts have hashes of their own."""
    data = np.frombuffer("\n".join(blocks).encode(), np.uint8)
    cuts = np.nonzero((data == 32) | (data == 10))[0]
    starts, ends = np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(data)]])
    block = np.concatenate([[0], np.cumsum(data[cuts] == 10)])
    count = len(starts) - LONG + 1
    if not len(data) or count < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_VALUES[data] * _powers(ODD, len(data)), dtype=np.uint64)])
    at = np.nonzero(block[:count] == block[LONG - 1 :])[0]
    first, last = starts[at], ends[at + LONG - 1]
    own = (sums[last] - sums[first]) * _powers(pow(ODD, -1, 1 << 64), len(data))[first]
    own = (own ^ (own >> np.uint64(31))) + hosts.view(np.uint64)[block[at]]
    own = (own ^ (own >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    begins = np.searchsorted(block, np.arange(len(blocks)))
    return (own ^ (own >> np.uint64(32))).view(np.int64), block[at], at - begins[block[at]]


def _suffixes(zones: frozenset):
    """run, page_key and place (over the blocks of these zones) of every suffix in them, and whether it stands in chrome or beside a declared main text."""

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in slices_by_bytes(whole, "html", SLICE_BYTES):
                texts, marks, pages, before = [], [], [], []
                for n, page in enumerate(batch.column("html").to_pylist()):
                    at, blocks = 0, blocks_of(page)
                    settled = any(z == "main" for z, _ in blocks)
                    for zone, text in blocks:
                        if zone in zones:
                            texts.append(text)
                            marks.append(zone == "chrome" or (zone == "open" and settled))
                            pages.append(n)
                            before.append(at)
                            at += text.count(" ") + 1
                if texts:
                    keys = [batch.column(c).to_numpy()[pages] for c in ("host_key", "page_key")]
                    runs, block, place = runs_of(texts, keys[0])
                    columns = [runs, np.array(marks)[block], keys[0][block], keys[1][block], (np.array(before)[block] + place).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["run", "chrome", "host_key", "page_key", "place"])

    return run


SUFFIXES = "run long, chrome boolean, host_key long, page_key long, place int"


def _distinct_pages(suffixes: DataFrame) -> DataFrame:
    """The runs that two pages hold at least: their least and greatest page differ."""
    pages = suffixes.groupBy("run").agg(F.min("page_key").alias("least"), F.max("page_key").alias("most"), F.max("chrome").alias("chrome"))
    return pages.where("least < most").select("run", "chrome")


def _furniture(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Of runs found in main text, those that a considerable share of their host's pages have there."""
    held = found.groupBy("run", "host_key", "page_key").agg(F.lit(1).alias("one")).groupBy("run", "host_key").agg(F.count("*").alias("n"))
    pages = rows.select("host_key", "page_key").distinct().groupBy("host_key").agg(F.count("*").alias("pages"))
    return held.join(pages, "host_key").where((F.col("n") >= LEAST_PAGES) & (SHARE * F.col("n") >= F.col("pages"))).select("run")


def _cover(length: int, hits: np.ndarray) -> np.ndarray:
    """Which of so many tokens lie in a run that begins at one of the hits."""
    edges = np.zeros(length + 1, np.int64)
    np.add.at(edges, hits, 1)
    np.add.at(edges, np.minimum(hits + LONG, length), -1)
    return np.cumsum(edges)[:length] > 0


def _own_text(page: str | None) -> tuple[str, list[str]]:
    """The zone that is a page's text, main or else open, and its blocks."""
    blocks = blocks_of(page)
    zone = "main" if any(z == "main" for z, _ in blocks) else "open"
    return zone, [t for z, t in blocks if z == zone]


def _without(blocks: list[str], places) -> str:
    """The blocks without the runs that begin at the places."""
    if not len(places):
        return "\n".join(blocks)
    own = [t.split(" ") for t in blocks]
    ends = np.cumsum([len(t) for t in own])
    covered = _cover(int(ends[-1]), np.asarray(places, np.int64))
    kept = [" ".join(t for t, c in zip(tokens, covered[e - len(tokens) : e]) if not c) for tokens, e in zip(own, ends)]
    return "\n".join(filter(None, kept))


def _extract(batches, places_of):
    """Texts of pages; ``places_of(batch, own)`` gives the places to remove from each page, of which own has zone and blocks."""
    import pyarrow as pa

    for whole in batches:
        for batch in slices_by_bytes(whole, "html", SLICE_BYTES):
            own = list(map(_own_text, batch.column("html").to_pylist()))
            texts = [_without(blocks, places) for (_, blocks), places in zip(own, places_of(batch, own))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


EXTRACTED = "page_id long, url string, text string"


def _collected(runs: DataFrame) -> np.ndarray:
    """Sorted runs in the driver; BROADCAST_RUNS bounds them."""
    return np.sort(runs.toArrow().column("run").to_numpy())


def _with_sent_runs(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """Texts when the repeated runs are few: every task has them."""
    context = rows.sparkSession.sparkContext
    sent, chrome = context.broadcast(_collected(repeated)), context.broadcast(_collected(repeated.where("chrome")))

    def main_hits(batches):
        import pyarrow as pa

        for batch in _suffixes(frozenset(["main"]))(batches):
            yield batch.filter(pa.array(np.isin(batch.column("run").to_numpy(), chrome.value)))

    in_main = _furniture(rows.mapInArrow(main_hits, SUFFIXES), rows) if len(chrome.value) else None
    in_main = context.broadcast(chrome.value if in_main is None else _collected(in_main))  # a part of those sent

    def run(batches):
        runs = {"open": sent.value, "main": in_main.value}

        def places_of(batch, own):
            found = [[] for _ in own]
            for zone in ("open", "main"):
                pages = [n for n, (z, blocks) in enumerate(own) if z == zone for _ in blocks]
                if not len(runs[zone]) or not pages:
                    continue
                texts = [t for z, blocks in own if z == zone for t in blocks]
                sizes = np.array([t.count(" ") + 1 for t in texts])
                before, page = np.cumsum(sizes) - sizes, np.array(pages)
                hashes, block, place = runs_of(texts, batch.column("host_key").to_numpy()[page])
                hit = np.isin(hashes, runs[zone])
                first = before[np.searchsorted(page, page)]  # where the page's first block begins
                for n, at in zip(page[block[hit]].tolist(), (before[block[hit]] - first[block[hit]] + place[hit]).tolist()):
                    found[n].append(at)
            return found

        yield from _extract(batches, places_of)

    return rows.mapInArrow(run, EXTRACTED)


def _with_joined_runs(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """Texts when the repeated runs are many: suffixes meet them by shuffle, and pages get the places of theirs."""
    found = materialize(rows.mapInArrow(_suffixes(frozenset(["main"])), SUFFIXES).join(repeated.where("chrome").select("run"), "run"), "main")
    main = found.join(_furniture(found, rows), "run").select("page_key", F.lit("main").alias("zone"), "place")
    open_ = rows.mapInArrow(_suffixes(frozenset(["open"])), SUFFIXES).join(repeated.select("run"), "run").select("page_key", F.lit("open").alias("zone"), "place")
    places = main.unionByName(open_).groupBy("page_key").agg(*(F.collect_set(F.when(F.col("zone") == z, F.col("place"))).alias(z) for z in ("main", "open")))

    def run(batches):
        def places_of(batch, own):
            columns = {z: batch.column(z).to_pylist() for z in ("main", "open")}
            return [columns[zone][n] or () for n, (zone, _) in enumerate(own)]

        yield from _extract(batches, places_of)

    return rows.join(places, "page_key", "left").mapInArrow(run, EXTRACTED)


def extract_main_text(pages: DataFrame, broadcast_runs: int = BROADCAST_RUNS) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?(?:www\.)?([^/:?#]+)", 1)), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", F.xxhash64(host).alias("host_key"), F.xxhash64(host, "html").alias("page_key")
    )
    suffixes = rows.mapInArrow(_suffixes(frozenset(["chrome", "open"])), SUFFIXES)
    repeated = materialize(_distinct_pages(suffixes), "runs")
    few = repeated.limit(broadcast_runs + 1).count() <= broadcast_runs
    out = _with_sent_runs(rows, repeated) if few else _with_joined_runs(rows, repeated)
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


QUERIES = {"op9_html_main_text": op9_html_main_text}
ORACLES: dict[str, str] = {}
