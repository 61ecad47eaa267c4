"""Benchmark decontamination (DataFrame functions only).

A window is as many words of a document as a benchmark item has (fewer where shared shingles place the item across the
document's ends), and shares shingles with the item, or has similarity 0. The places of shared shingles are gathered for each document and item, and a
window is laid at every start where it holds enough of them to pass, since their number bounds the similarity from above.
Each window is verified by the exact weighted similarity of its shingles: the sum of the lesser multiplicities over
the sum of the greater ones. Nothing else rejects a pair: the distance of the
64-bit SimHashes of their words is reported and decides among windows of equal similarity.

Words are lower-cased (A-Z) runs outside white space; shingles have five words, and an item with fewer words
is one shingle. Defined results: null and blank texts match nothing; equal items each match;
repeated documents rows give one result per doc_id; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import lower_ascii, materialize, table, words
from millrace.llm.quality_rules import bind

SHINGLE = 5
THRESHOLD = 0.75
#: For lookups by fingerprint blocks; leaks() compares all windows that could pass and needs none.
RADIUS = 14
BLOCKS = 5
#: Index tables are broadcast up to this many rows (of some 24 bytes), and joined by shuffle beyond.
BROADCAST_ROWS = 1_000_000


def simhash(w: Column) -> Column:
    """Bit b is set if it is set in the hashes of more than half of the words."""

    def voted(hashes: Column) -> Column:
        def bit(acc: Column, b: Column) -> Column:
            votes = F.aggregate(hashes, F.lit(0), lambda s, h: s + F.getbit(h, b).cast("int"))
            return F.when(2 * votes > F.size(hashes), acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))).otherwise(acc)

        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), bit)

    return bind(F.transform(w, lambda x: F.xxhash64(x)), voted)


def _blocks() -> list[tuple[int, int]]:
    """(offset, width) of each block of the 64 bits."""
    out, at = [], 0
    for k in range(BLOCKS):
        width = 64 // BLOCKS + (k < 64 % BLOCKS)
        out.append((at, width))
        at += width
    return out


def _block_value(fp: Column, offset: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, offset).bitwiseAND(F.lit((1 << width) - 1))


def own_blocks(fp: Column) -> Column:
    return F.array(*(F.struct(F.lit(k).alias("block"), _block_value(fp, o, w).alias("value")) for k, (o, w) in enumerate(_blocks())))


def near_blocks(fp: Column) -> Column:
    """All values of each block within the bits that the pigeonhole principle leaves to it."""

    def near(k: int, offset: int, width: int) -> Column:
        masks = [sum(1 << b for b in bits) for n in range(RADIUS // BLOCKS + 1) for bits in combinations(range(width), n)]
        own = _block_value(fp, offset, width)
        return F.transform(F.array(*(F.lit(m).cast("long") for m in masks)), lambda m: F.struct(F.lit(k).alias("block"), own.bitwiseXOR(m).alias("value")))

    return F.concat(*(near(k, o, w) for k, (o, w) in enumerate(_blocks())))


def tagged_shingles(w: Column) -> Column:
    """Shingles of which further copies are numbered, so that set operations count multiplicities. Costs no more than sorting where few repeat."""
    n = F.greatest(F.size(w) - SHINGLE + 1, F.lit(1))
    shingles = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(w, i, F.lit(SHINGLE)), " "))
    copies = lambda s: F.filter(s, lambda x, i: x == F.get(s, i - 1))  # noqa: E731  (of a sorted list)

    def numbered(d: Column) -> Column:
        """Each run of equal copies counts from 2; runs are found by where they begin, so no copy is looked for."""
        begins = F.filter(F.transform(d, lambda x, i: F.when(~x.eqNullSafe(F.get(d, i - 1)), i)), lambda i: i.isNotNull())
        runs = lambda b: F.transform(b, lambda first, j: F.transform(F.sequence(F.lit(0), F.coalesce(F.get(b, j + 1), F.size(d)) - first - 1), lambda k: F.concat_ws(" #", F.get(d, first), k + 2)))
        return F.when(F.size(d) > 0, F.flatten(bind(begins, runs))).otherwise(F.array().cast("array<string>"))

    def tagged(s: Column) -> Column:
        return F.when(F.size(F.array_distinct(s)) == F.size(s), s).otherwise(F.concat(F.array_distinct(s), bind(bind(F.sort_array(s), copies), numbered)))

    return bind(shingles, tagged)


def grams_of(w: Column, gram: int) -> Column:
    """Hashes of all runs of ``gram`` words."""
    return bind(w, lambda x: F.when(F.size(x) >= gram, F.transform(F.sequence(F.lit(1), F.size(x) - gram + 1), lambda i: F.xxhash64(F.slice(x, i, F.lit(gram))))))


def _maybe_broadcast(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _starts(p: Column, length: Column, gram: Column, n_text: Column, least: Column, greatest: Column) -> Column:
    """The starts of windows that share enough shingles with the item to pass; ``p`` has the places of shared ones in order.

    ``least`` and ``greatest`` are the starts that shared shingles give the item; only as far as these may windows cross the
    document's ends. To pass a window must hold ``need`` places; each start is met once, at the first place that its window holds.
    """
    n = length - gram + 1
    need = F.ceil(n * THRESHOLD).cast("int")

    # how many places lie before each position up to the last place
    before = F.flatten(F.transform(p, lambda x, i: F.array_repeat(i, x - F.coalesce(F.get(p, i - 1), F.lit(-1)))))

    def passes(s: Column, i: Column, ranks: Column) -> Column:
        held = F.coalesce(F.get(ranks, s + n), F.size(p)) - i
        ours = F.least(s + length, n_text) - F.greatest(s, F.lit(0)) - gram + 1
        within = s.between(F.least(least, F.lit(0)), F.greatest(greatest, n_text - length))
        return within & (held >= THRESHOLD * (n + ours - held))

    def of(x: Column, i: Column, ranks: Column) -> Column:
        first = F.greatest(F.get(p, i + need - 1) - n + 1, F.when(i > 0, F.get(p, i - 1) + 1))
        fits = F.get(p, i + need - 1).isNotNull() & (first <= x)
        return F.when(fits, F.filter(F.sequence(F.least(first, x), x), lambda s: passes(s, i, ranks))).otherwise(F.array().cast("array<int>"))

    return bind(before, lambda ranks: F.flatten(F.transform(p, lambda x, i: of(x, i, ranks))))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start_word (from 0), n_words, hamming, similarity: the best window of each document and item."""
    items = (
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(lower_ascii(F.col("text"))).alias("item_words"))
        .where(F.size("item_words") > 0)
        .withColumn("length", F.size("item_words"))
        .withColumn("gram", F.least(F.lit(SHINGLE), "length"))
        .withColumn("item_key", F.xxhash64("item_words"))
    )
    grams = sorted(r.gram for r in items.select("gram").distinct().collect())  # at most SHINGLE values
    anchors = items.select(
        "item_id", "item_key", "length", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("length") - F.col("gram") + 1), lambda i: F.xxhash64(F.slice("item_words", i, F.col("gram"))))).alias("item_pos", "h"), "gram"
    ).distinct()
    anchors = _maybe_broadcast(anchors)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    texts = keyed.select("doc_id", "text_key", words(lower_ascii(F.col("text"))).alias("w"))
    found = []
    for gram in grams:
        hashed = texts.select("doc_id", "text_key", F.size("w").alias("n_text"), grams_of(F.col("w"), gram).alias("hashes"))
        # the outer form, so that no filter on the array is inferred that would compute it twice
        rows = hashed.select("doc_id", "text_key", "n_text", F.posexplode_outer("hashes").alias("pos", "h"))
        found.append(rows.join(anchors.where(F.col("gram") == gram), "h").drop("h"))
    if not found:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, start_word int, n_words int, hamming int, similarity double")
    pairs = reduce(DataFrame.unionByName, found).groupBy("doc_id", "text_key", "n_text", "item_id", "item_key", "length", "gram").agg(
        F.sort_array(F.collect_set("pos")).alias("places"), F.min(F.col("pos") - F.col("item_pos")).alias("least"), F.max(F.col("pos") - F.col("item_pos")).alias("greatest")
    )
    pairs = pairs.where(F.size("places") >= THRESHOLD * (F.col("length") - F.col("gram") + 1))
    starts = _starts(*map(F.col, ("places", "length", "gram", "n_text", "least", "greatest")))
    pairs = materialize(pairs.select("doc_id", "text_key", "item_id", "item_key", "length", starts.alias("starts")), "pairs").where(F.size("starts") > 0)
    own, one = keyed.alias("own"), _maybe_broadcast(pairs).alias("pair")
    texts = own.join(one, F.col("own.doc_id").eqNullSafe(F.col("pair.doc_id")) & (F.col("own.text_key") == F.col("pair.text_key")))

    def cut(w: Column) -> Column:
        first, last = lambda s: F.greatest(s, F.lit(0)), lambda s: F.least(s + F.col("length"), F.size(w))
        return F.transform("starts", lambda s: F.struct(first(s).alias("start_word"), F.array_join(F.slice(w, first(s) + 1, last(s) - first(s)), " ").alias("window")))

    windows = texts.select("own.doc_id", "item_id", "item_key", F.inline_outer(bind(words(lower_ascii(F.col("text"))), cut)))
    windows = materialize(windows.distinct(), "windows")
    # from here on, equal windows are treated once; tables are written so that no filter repeats the work
    prints = materialize(items.select("item_key", "item_words").dropDuplicates(["item_key"]).select("item_key", simhash(F.col("item_words")).alias("item_fingerprint"), tagged_shingles(F.col("item_words")).alias("theirs")), "items")
    candidates = windows.select("window", "item_key").distinct().select("window", "item_key", F.split("window", " ").alias("window_words"))
    compared = candidates.join(_maybe_broadcast(prints), "item_key").withColumn("ours", tagged_shingles(F.col("window_words")))
    both = F.size(F.array_intersect("ours", "theirs"))
    compared = compared.select("window", "item_key", "item_fingerprint", F.size("window_words").alias("n_words"), both.alias("both"), (F.size("ours") + F.size("theirs")).alias("all"))
    verified = materialize(compared, "windows").withColumn("similarity", F.col("both") / (F.col("all") - F.col("both"))).where(F.col("similarity") >= THRESHOLD)
    hamming = F.bit_count(simhash(F.split("window", " ")).bitwiseXOR(F.col("item_fingerprint")))
    verified = materialize(verified.select("window", "item_key", "n_words", "similarity", hamming.cast("int").alias("hamming")), "windows")
    hits = windows.join(verified, ["window", "item_key"])
    best = F.max(F.struct("similarity", (-F.col("hamming")).alias("h"), (-F.col("start_word")).alias("s"), "n_words")).alias("b")
    return hits.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("b.s")).alias("start_word"), "b.n_words", (-F.col("b.h")).alias("hamming"), "b.similarity")


#: Name of a column that no table of documents has.
TEXT_KEY = "__text_key"


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text holds no benchmark item. Each row is judged by its own text, whether its doc_id is null, repeated or neither; of texts 64-bit hashes are compared."""
    keyed = docs.withColumn(TEXT_KEY, F.xxhash64("text"))
    found = leaks(keyed.select(F.col(TEXT_KEY).alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(TEXT_KEY)).distinct()
    return keyed.join(found, TEXT_KEY, "left_anti").select(*docs.columns)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op2_decontaminate": op2_decontaminate}
ORACLES: dict[str, str] = {}
