"""Language identification by fusing evidence with Bayes' rule.

Text likelihoods come from smoothed counts of hashed byte trigrams in all documents of each declared
``lang``, reduced to its primary subtag (en-US is en). Every language is modelled; the more there are, the fewer bins each has, so that
the table sent to executors has at most ``CELLS`` cells. For web pages the language that the markup declares and the address's suffix are further
observations, whose likelihoods given the language are counted over all pages; the prior is the host's
language distribution, smoothed to that of its domain, which is smoothed to that of all hosts. For documents the
source stands for the host. All tables of counts come from grouped aggregation of the text-only
posteriors and are as large as languages, suffixes and hosts are many, not as the corpus.

Byte trigrams overlap, so their log likelihood ratio is tempered: it counts as that of one trigram in
``TEMPER``, and at most as ``TEXT_CAP`` nats, which declared evidence alone cannot outweigh on a text of some length.

Defined results: a null or blank text has an even likelihood and gets its language from the other evidence; a null lang, or one that is no
language code of two or three letters (with subtags), trains nothing; of equally likely languages the first by name is given; a null source or url is one host; without any trained language the language is null;
repeated rows are judged each; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import materialize, table
from millrace.llm.quality_rules import bind

BINS = 1 << 16
#: Cells (of four bytes) of the table of all languages.
CELLS = 1 << 24
#: Counts travel in so many pieces for each language, so that no task gathers all of one.
PIECES = 16
#: Posteriors below this add nothing to the sums of a host, suffix or declared language.
NEGLIGIBLE = 1e-9
SMOOTH = 0.5
TEMPER = 6.0
TEXT_CAP = 60.0
HOST_WEIGHT, DOMAIN_WEIGHT = 5.0, 20.0
TAGS = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)


def bins_for(languages: int) -> int:
    """A power of two: ``BINS``, halved as often as ``CELLS`` demands."""
    bins = BINS
    while bins * languages > CELLS:
        bins //= 2
    return bins


def trigram_bins(text: str, bins: int = BINS) -> np.ndarray:
    data = np.frombuffer(text.lower().encode(), np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(0, np.uint32)
    code = data[:-2] | (data[1:-1] << np.uint32(8)) | (data[2:] << np.uint32(16))
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(33 - bins.bit_length())


def plain(page: str | None) -> str:
    return entities.unescape(TAGS.sub(" ", page)) if page else ""


COUNTS = "lang string, piece int, counts binary"


def _pieces(totals: dict):
    import pyarrow as pa

    for (lang, piece), own in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([piece], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["lang", "piece", "counts"])


def _count(bins: int):
    """Rows of trigram counts for each language of a partition, in pieces; few languages are held at a time."""

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        split = lambda: {(k, n): x for k, v in counts.items() for n, x in enumerate(np.split(v, PIECES))}
        for batch in batches:
            for lang, text in zip(batch.column("code").to_pylist(), batch.column("text").to_pylist()):
                if text:
                    if lang not in counts:
                        if (len(counts) + 1) * bins * 8 > 64 << 20:
                            yield from _pieces(split())
                            counts.clear()
                        counts[lang] = np.zeros(bins, np.int64)
                    counts[lang] += np.bincount(trigram_bins(text, bins), minlength=bins)
        yield from _pieces(split())

    return run


def _sum(batches):
    """Sums of the pieces of a stream sorted by language and piece."""
    own, total = None, None
    for batch in batches:
        for lang, piece, data in zip(*(batch.column(c).to_pylist() for c in ("lang", "piece", "counts"))):
            if (lang, piece) != own:
                if own:
                    yield from _pieces({own: total})
                own, total = (lang, piece), 0
            total = total + np.frombuffer(data, np.int64)
    if own:
        yield from _pieces({own: total})


def language_code(lang: Column) -> Column:
    """The primary subtag of a language tag; null for what is none."""
    found = F.regexp_extract(F.lower(F.btrim(lang)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(found != "", found)


def trigram_model(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, and log probabilities of trigram bins (rows) in each."""
    known = docs.select(language_code(F.col("lang")).alias("code"), "text").where("code IS NOT NULL")
    names = sorted(r.code for r in known.select("code").distinct().collect())  # at most 26^2 + 26^3
    if not names:
        return [], np.zeros((BINS, 0), np.float32)
    bins = bins_for(len(names))
    parts = known.mapInArrow(_count(bins), COUNTS).repartition("lang", "piece").sortWithinPartitions("lang", "piece")
    counts = np.full((bins, len(names)), SMOOTH)
    width, column = bins // PIECES, {n: i for i, n in enumerate(names)}
    for r in parts.mapInArrow(_sum, COUNTS).toLocalIterator():  # CELLS bound them
        counts[r.piece * width : (r.piece + 1) * width, column[r.lang]] += np.frombuffer(r.counts, np.int64)
    return names, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def _likelihoods(table_: np.ndarray, markup: bool):
    """Tempered log likelihoods of a text, relative to the best."""

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch, out = whole.slice(at, 1000), []
                for text in batch.column("text").to_pylist():
                    bins = trigram_bins(plain(text) if markup else text or "", len(table_))
                    found = sum((table_[bins[k : k + 65536]].sum(axis=0, dtype=np.float64) for k in range(0, len(bins), 65536)), np.zeros(table_.shape[1]))
                    found = found / TEMPER
                    out.append(np.maximum(found - found.max(), -TEXT_CAP) if len(found) else found)
                names = [n for n in batch.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, pa.list_(pa.float64()))], [*names, "text_log"])

    return run


def _normalised(logs: Column) -> Column:
    """Probabilities from an array of logs."""
    powers = lambda x: bind(F.array_max(x), lambda m: F.transform(x, lambda y: F.exp(y - m)))
    share = lambda p: bind(F.aggregate(p, F.lit(0.0), lambda a, b: a + b), lambda s: F.transform(p, lambda y: y / s))
    return bind(bind(logs, powers), share)


def _sums(rows: DataFrame, keys: list[str], count: int) -> DataFrame:
    """The keys, and the array ``s`` of posteriors summed over their rows for each language."""
    long = rows.select(*keys, F.posexplode("text_p").alias("i", "p")).where(F.col("p") > NEGLIGIBLE)
    long = long.groupBy(*keys, "i").agg(F.sum("p").alias("p"))
    held = long.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("i", "p"))).alias("held"))  # as many as languages
    return held.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.coalesce(F.element_at("held", i), F.lit(0.0))).alias("s"))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def fuse(rows: DataFrame, languages: list[str]) -> DataFrame:
    """Adds lang, confidence and text_lang to rows with text_log, declared, suffix, domain and host."""
    n = len(languages)
    rows = rows.withColumn("text_p", _normalised(F.col("text_log")))
    overall = _sums(rows, [], n).first()
    overall = np.array(overall.s if overall and overall.s else [0.0] * n)
    prior = F.array(*[F.lit(float(x)) for x in (overall + 1.0) / (overall.sum() + n)])

    def likelihood(key: str) -> DataFrame:
        """log P(observed value | language), of known values; the unobserved tell nothing."""
        counts = materialize(_sums(rows.where(F.col(key) != ""), [key], n), key)
        values = counts.count()
        total = counts.select(F.posexplode("s").alias("i", "p")).groupBy("i").agg(F.sum("p").alias("p")).collect()  # one for each language
        sums = dict(total)
        whole = F.array(*[F.lit(float(sums.get(i) or 0.0) + SMOOTH * (values + 1)) for i in range(n)])
        return counts.select(key, F.zip_with("s", whole, lambda c, t: F.log((c + SMOOTH) / t)).alias(f"{key}_log"))

    hosts = materialize(_sums(rows, ["domain", "host"], n), "hosts")
    domains = hosts.select("domain", F.posexplode("s").alias("i", "p")).groupBy("domain", "i").agg(F.sum("p").alias("p"))
    domains = domains.groupBy("domain").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "p"))), lambda x: x.p).alias("d"))  # as many as languages
    smooth = lambda own, above, weight: bind(_total(own), lambda t: F.zip_with(own, above, lambda c, p: (c + weight * p) / (t + weight)))
    domains = domains.select("domain", smooth(F.col("d"), prior, DOMAIN_WEIGHT).alias("d"))
    smoothed = hosts.join(domains, "domain").select("host", F.transform(smooth(F.col("s"), F.col("d"), HOST_WEIGHT), lambda p: F.log(p)).alias("host_log"))
    even = F.array_repeat(F.lit(0.0), n)
    out = rows.join(materialize(smoothed, "hosts"), "host")
    for key in ("declared", "suffix"):
        out = out.join(materialize(likelihood(key), key), key, "left")
    parts = [F.col("text_log"), F.col("host_log"), F.coalesce("declared_log", even), F.coalesce("suffix_log", even)]
    out = out.withColumn("posterior", _normalised(reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), parts)))
    names = F.array(*[F.lit(x) for x in languages])
    best = lambda p: F.element_at(names, F.array_position(p, F.array_max(p)).cast("int"))
    return out.withColumns({"lang": best(F.col("posterior")), "confidence": F.round(F.array_max("posterior"), 6), "text_lang": best(F.col("text_p"))})


def identify(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """kind, doc_id or page_id, lang, confidence and text_lang of every document and page; documents train the text model."""
    languages, model = trigram_model(docs)
    out = ["kind", "doc_id", "page_id"]
    kinds = "kind string, doc_id long, page_id long, declared string, suffix string, domain string, host string, text_log array<double>"
    none = F.lit(None).cast("long")
    text_rows = docs.select(
        F.lit("document").alias("kind"), F.col("doc_id").cast("long").alias("doc_id"), none.alias("page_id"), F.lit("").alias("declared"), F.lit("").alias("suffix"),
        F.lit("source").alias("domain"), F.concat(F.lit("source:"), F.coalesce("source", F.lit(""))).alias("host"), "text",
    )
    url, page = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    declared = F.lower(F.regexp_extract(page, r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    in_path = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]+/([A-Za-z]{2})(?:[-_][A-Za-z]{2})?(?:[/?#]|$)", 1))
    page_rows = pages.select(
        F.lit("page").alias("kind"), none.alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), declared.alias("declared"),
        F.concat_ws("/", F.substring_index(host, ".", -1), in_path).alias("suffix"),
        F.substring_index(host, ".", -2).alias("domain"), host.alias("host"), page.alias("text"),
    )
    rows = text_rows.mapInArrow(_likelihoods(model, False), kinds).unionByName(page_rows.mapInArrow(_likelihoods(model, True), kinds))
    if not languages:
        return rows.select(*out, F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("text_lang"))
    return fuse(materialize(rows, "evidence"), languages).select(*out, "lang", "confidence", "text_lang")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {"op3_language_id": op3_language_id}
ORACLES: dict[str, str] = {}
