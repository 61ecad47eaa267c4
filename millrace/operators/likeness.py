"""Greedy and fingerprint likeness: SimHash and MinHash over words, leaders, fuzzy one-to-one matches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import dedup_normalised

PERMUTATIONS = 128
#: Least share of equal minhashes of near duplicates.
NEAR = 0.85


#: Grams whose bits are counted at a time.
COUNTED_GRAMS = 1 << 16
#: Blocks that a 64-bit print is cut into for pairs within a few bits.
BLOCKS = 6


def _fnv_rows(codes: np.ndarray, start: np.ndarray | int = 2166136261) -> np.ndarray:
    """FNV-1a of each row of code units."""
    h = np.full(len(codes), start, np.uint64)
    for at in range(codes.shape[1]):
        h = ((h ^ codes[:, at]) * np.uint64(16777619)) & np.uint64(0xFFFFFFFF)
    return h


def simhash(plain: str) -> int:
    """The 64-bit SimHash of runs of five code units (a shorter text is one run); 0 for an empty text. A bit is set if more runs have it than not."""
    units = np.frombuffer(plain.encode("utf-16-le", "surrogatepass"), np.uint16).astype(np.uint64)
    if not len(units):
        return 0
    size = min(5, len(units))
    colon = np.uint64(ord(":"))
    votes = np.zeros(64, np.int64)
    total = len(units) - size + 1
    for at in range(0, total, COUNTED_GRAMS):
        grams = np.lib.stride_tricks.sliding_window_view(units[at : at + COUNTED_GRAMS + size - 1], size)
        fence = np.full((len(grams), 1), colon)
        high = _fnv_rows(np.hstack([fence, grams, fence]))
        both = (high << np.uint64(32)) | _fnv_rows(grams)
        votes += np.unpackbits(both.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > total, bitorder="little").tobytes(), "little", signed=True)


def simhash64(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, simhash) of the normalised texts without spaces; every text is read once, a run of its grams at a time."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([simhash(x or "") for x in batch.column(1).to_pylist()], pa.int64())], [key, "simhash"])

    plain = rows.select(key, F.replace(dedup_normalised(F.col(text)), F.lit(" "), F.lit("")).alias("plain"))
    return plain.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, simhash bigint")


def simhash_pairs(prints: DataFrame, key: str, most: int = 3) -> DataFrame:
    """(key, other, bits): the first keys of prints within ``most`` bits of each other, and every further key of a print with its first (0 bits).

    A print is cut into six blocks. Prints that near agree in all but ``most`` blocks at least, so they meet under one choice of the others: with
    three of six, 20 keys of some 32 bits, whose lists stay short however many prints there are.
    """
    from itertools import combinations

    widths = [64 // BLOCKS + (b < 64 % BLOCKS) for b in range(BLOCKS)]
    masks = [((1 << w) - 1) << sum(widths[:b]) for b, w in enumerate(widths)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    chosen = list(combinations(range(BLOCKS), BLOCKS - most))
    choices = [signed(sum(masks[b] for b in c)) for c in chosen]
    # a pair meets under each choice of blocks in which it agrees; it is taken at the first, whose blocks are its first equal ones
    passed_over = F.array(*[F.array(*[F.lit(signed(masks[b])).cast("long") for b in range(c[-1]) if b not in c]).cast("array<bigint>") for c in chosen])
    first = prints.groupBy("simhash").agg(F.min(key).alias("first"))
    # merge joins: an estimate of the prints knows nothing of the twenty keys of each, and a broadcast of them fills the driver
    members = prints.join(first.hint("merge"), "simhash").where(F.col(key) != F.col("first")).select(F.col("first").alias(key), F.col(key).alias("other"), F.lit(0).alias("bits"))
    banded = first.select(F.col("first").alias(key), "simhash", F.posexplode(F.array(*[F.col("simhash").bitwiseAND(F.lit(m).cast("long")) for m in choices])).alias("choice", "value"))
    other = banded.select(F.col(key).alias("other"), F.col("simhash").alias("theirs"), "choice", "value")
    apart = F.col("simhash").bitwiseXOR(F.col("theirs"))
    bits = F.bit_count(apart).cast("int")
    near = banded.join(other.hint("merge"), ["choice", "value"]).where((F.col(key) < F.col("other")) & (bits <= most))
    near = near.where(F.forall(F.get(passed_over, F.col("choice")), lambda m: apart.bitwiseAND(m) != 0))
    return near.select(key, "other", bits.alias("bits")).unionByName(members)


def _fnv(data: str, start: int = 2166136261) -> int:
    for c in data:
        start = ((start ^ ord(c)) * 16777619) & 0xFFFFFFFF
    return start


#: Words whose hashes a worker keeps at a time (half a kilobyte each).
KEPT_WORDS = 1 << 16
_kept: dict[str, np.ndarray] = {}


def _word_hashes(words: list[str]) -> np.ndarray:
    """128 FNV hashes of "seed:word" for each word. All words go a character at a time."""
    order = sorted(range(len(words)), key=lambda i: -len(words[i]))
    own = [words[i] for i in order]
    prefix = np.array([_fnv(f"{i}:") for i in range(PERMUTATIONS)], np.uint64)
    hashes = np.repeat(prefix[None, :], len(own), axis=0)
    sizes = np.array([len(w) for w in own])
    for at in range(sizes[0]):
        many = int((sizes > at).sum())
        codes = np.array([ord(w[at]) for w in own[:many]], np.uint64)
        hashes[:many] = ((hashes[:many] ^ codes[:, None]) * np.uint64(16777619)) & np.uint64(0xFFFFFFFF)
    out = np.empty((len(own), PERMUTATIONS), np.uint32)
    out[order] = hashes
    return out


def minhash_words(words: list[str]) -> np.ndarray:
    """128 least FNV hashes of "seed:word" over the words; all ones without words. A word is hashed once as long as it is kept."""
    own = list(set(words))
    least = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(own), KEPT_WORDS):
        part = own[at : at + KEPT_WORDS]
        new = [w for w in part if w not in _kept]
        if len(_kept) + len(new) > KEPT_WORDS:
            _kept.clear()
            new = part
        if new:
            _kept.update(zip(new, _word_hashes(new)))
        least = np.minimum(least, np.minimum.reduce([_kept[w] for w in part]))
    return least.astype(np.uint64)


def minhash_signatures(rows: DataFrame, key: str, norm: str) -> DataFrame:
    """(key, signature): 128 minhashes of the words of a normalised text."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            signs = [minhash_words((x or "").split()).astype(np.int64) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signs, pa.list_(pa.int64()))], [key, "signature"])

    return rows.select(key, norm).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, signature array<bigint>")


def minhash_likeness(a: Column, b: Column) -> Column:
    """The share of equal minhashes."""
    equal = F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)
    return F.size(equal) / F.lit(float(PERMUTATIONS))


def _leaders(batches):
    """Within each document, whose chunks come in a row: exact duplicates, else the first leader that is near; duplicates never lead."""
    import pyarrow as pa

    document, signs, ordinals, exact = None, np.empty((16, PERMUTATIONS), np.uint32), [], {}
    for batch in batches:
        found = []
        docs, places = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for doc, ordinal, content, norm in zip(docs, places, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if doc != document:
                document, signs, ordinals, exact = doc, signs[:16], [], {}
            if content in exact:
                found.append(exact[content])
                continue
            sign = minhash_words(norm.split()).astype(np.uint32)
            # equal minhashes of all leaders at once
            close = np.flatnonzero((signs[: len(ordinals)] == sign).mean(axis=1) >= NEAR) if ordinals else ()
            near = ordinals[close[0]] if len(close) else None
            found.append(near)
            exact[content] = ordinal
            if near is None:
                if len(ordinals) == len(signs):
                    signs = np.concatenate([signs, np.empty_like(signs)])
                signs[len(ordinals)] = sign
                ordinals.append(ordinal)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], ["doc_id", "ordinal", "duplicate_of"])


def greedy_leaders(chunks: DataFrame) -> DataFrame:
    """(doc_id, ordinal, duplicate_of) of chunks; the chunks of a document stream through one task in order."""
    rows = chunks.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "content_hash", dedup_normalised(F.col("chunk")).alias("norm"))
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "ordinal").mapInArrow(_leaders, "doc_id long, ordinal long, duplicate_of long")


# --- near-duplicate joins ----------------------------------------------------------------------------

#: 20 bands of six minhashes: texts that differ in 19 of 128 (likeness 0.85 and more) or fewer agree in a band.
BANDS, BAND_ROWS = 20, 6
MOST_APART = int(PERMUTATIONS * (1 - NEAR))
#: Texts that may share a band before the band is joined with another one.
MOST_IN_BAND = 1000


def _band_rows(key: str, kind):
    """(key, band, value) of each signature; value is a 64-bit hash of the band's minhashes."""

    def run(batches):
        import pyarrow as pa

        factors = (np.arange(1, BAND_ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        for batch in batches:
            signs = np.array(batch.column(1).to_pylist(), np.uint64).reshape(-1, PERMUTATIONS)[:, : BANDS * BAND_ROWS].reshape(-1, BANDS, BAND_ROWS)
            h = np.zeros(signs.shape[:2], np.uint64)
            for at in range(BAND_ROWS):
                h = (h ^ signs[:, :, at]) * factors[at]
                h ^= h >> np.uint64(29)
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, h.size + 1, BANDS, dtype=np.int32)), pa.array(h.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), values], [key, "bands"])

    return run, f"{key} {kind}, bands array<bigint>"


def minhash_classes(signatures: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(key, rep) of every text, and (rep, signature) of the first text of each signature."""
    sealed = signatures.withColumn("seal", F.sha2(F.array_join("signature", ","), 256))
    firsts = sealed.groupBy("seal").agg(F.min(key).alias("rep"), F.first("signature").alias("signature"))
    return sealed.join(firsts.select("seal", "rep"), "seal").select(key, "rep"), firsts.select("rep", "signature")


def minhash_pairs(reps: DataFrame, key: str = "rep", most: int = MOST_IN_BAND) -> DataFrame:
    """(key, other, likeness) of all texts whose likeness is 0.85 or more, by an equi-join of bands and an exact count of equal minhashes.

    Such texts differ in 19 minhashes at most, so of 20 bands they share one: no pair is missed. A band that over ``most``
    texts share is joined with a further part of the signature: of the 128 - 6 minhashes outside it, cut into 20 parts, they share one too.
    """
    from millrace.workspace import materialize

    run, schema = _band_rows(key, reps.schema[key].dataType.simpleString())
    banded = materialize(reps.select(key, "signature").mapInArrow(run, schema).select(key, F.posexplode("bands").alias("band", "value")), "bands")
    sizes = banded.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1")
    placed = banded.join(materialize(sizes, "sizes"), ["band", "value"])
    plain = placed.where(F.col("n") <= most).select(key, "band", "value", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("more"))
    # the rest of a crowded band's signatures, in 20 parts: a pair differs in 19 places at most, so one part is equal
    crowded = placed.where(F.col("n") > most).select(key, "band", "value").join(reps.select(key, "signature"), key)
    rest = F.filter("signature", lambda _, i: (i < F.col("band") * BAND_ROWS) | (i >= (F.col("band") + 1) * BAND_ROWS))
    borders = [p * (PERMUTATIONS - BAND_ROWS) // (MOST_APART + 1) for p in range(MOST_APART + 2)]
    parts = F.array(*[F.xxhash64(F.array_join(F.slice("rest", a + 1, b - a), ",")) for a, b in zip(borders, borders[1:])])
    crowded = crowded.withColumn("rest", rest).select(key, "band", "value", F.posexplode(parts).alias("part", "more"))
    rows = plain.unionByName(crowded)
    other = rows.withColumnRenamed(key, "other")
    pairs = rows.join(other, ["band", "value", "part", "more"]).where(F.col(key) < F.col("other")).select(key, "other").distinct()
    theirs = reps.select(F.col(key).alias("other"), F.col("signature").alias("theirs"))
    likeness = minhash_likeness(F.col("signature"), F.col("theirs"))
    return pairs.join(reps.select(key, "signature"), key).join(theirs, "other").select(key, "other", likeness.alias("likeness")).where(F.col("likeness") >= NEAR)


def near_texts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, other, likeness): first texts of each signature that are near each other, and every further text with its first (likeness 1)."""
    from millrace.workspace import materialize

    signs = materialize(minhash_signatures(rows.select(key, dedup_normalised(F.col(text)).alias("norm")), key, "norm"), "signatures")
    members, reps = minhash_classes(signs, key)
    reps = materialize(reps, "reps")
    pairs = minhash_pairs(reps).withColumnRenamed("rep", key)
    same = members.where(F.col(key) != F.col("rep")).select(F.col("rep").alias(key), F.col(key).alias("other"), F.lit(1.0).alias("likeness"))
    return pairs.unionByName(same)
