"""Language-model scoring: a bigram model with Katz backoff.

Counts are discounted by Good-Turing up to ``KATZ_K``. The weight of a context spreads exactly the mass
that its discounted followers leave over the unigram mass of all other words, so every context's
probabilities add up to 1. A text's score is the sum of log10 P(word | word before), and a token is
evaluated recursively: its bigram if trained, else the weight of its context times its unigram, the latter
being discounted itself, with the left mass for all words unknown in training.

Running: documents are hashed to chunks of tokens, written once. Chunks send their distinct words to count buckets and
get total counts and ids back; then their distinct bigrams, with the counts of the words, to buckets by context;
these hold the bigram table and answer with its counts and the sums that the weights need. The buckets of
frequent contexts are split by the following word, so what a task holds is bounded by the bucket and chunk
sizes. All counts come from all training documents, and every token is looked up. Words and bigrams are told apart by 64-bit hashes at every size.

Tokens are words (A-Z lower-cased) and one end for each text. Training documents are those whose crc32(doc_id as
text) mod 7 is not 2. Defined results: a null text is empty and scores its end; a null doc_id is held out; repeated rows
count and score each; without training text every token is unknown; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import materialize, partitions, table
from millrace.llm.near_dup import WordHashes, mixed

FOLDS, HELD_OUT = 7, 2
KATZ_K = 5
CHUNK_TOKENS = 1_000_000
BUCKET_TOKENS = 4_000_000
LEAST_BUCKETS = 128
#: A context is split so that no part holds more than this share of a bucket's mean.
SPLIT_SHARE = 0.25
END = np.uint64(0x9AE16A3B2F90404F)


def dump(*arrays: np.ndarray) -> bytes:
    """Arrays by byte planes, compressed."""
    import zstandard

    heads, planes = [struct.pack("<H", len(arrays))], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        heads.append(struct.pack("<3sQ", a.dtype.str[1:].encode().ljust(3), len(a)))
        planes.append(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join([*heads, *planes]))


def load(data: bytes) -> list[np.ndarray]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(data)
    count, kinds = struct.unpack_from("<H", data)[0], []
    at = 2
    for _ in range(count):
        kind, size = struct.unpack_from("<3sQ", data, at)
        kinds.append((np.dtype(kind.decode().strip()), size))
        at += struct.calcsize("<3sQ")
    out = []
    for kind, size in kinds:
        width = kind.itemsize
        planes = np.frombuffer(data, np.uint8, size * width, at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(size))
        at += size * width
    return out


def deltas(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Differences within groups that begin at starts."""
    out = values.copy()
    out[1:] -= values[:-1]
    out[starts] = values[starts]
    return out


def undelta(differences: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.cumsum(differences, dtype=np.uint64)
    held = np.nonzero(sizes)[0]
    starts = (np.cumsum(sizes) - sizes)[held]
    return total - np.repeat(total[starts] - differences[starts], sizes[held])


def good_turing(of: list[int]) -> list[float]:
    """Factors for counts 1 to k from the numbers of things counted 1 to k + 1 times; as long a list as they allow."""
    for k in range(len(of) - 1, 0, -1):
        if min(of[: k + 1]) <= 0:
            continue
        tail = (k + 1) * of[k] / of[0]
        if tail >= 1:
            continue
        found = [((r + 1) * of[r] / (r * of[r - 1]) - tail) / (1 - tail) for r in range(1, k + 1)]
        if all(0 < d < 1 for d in found):
            return found
    return []


class Discounts:
    """Discounted counts of one order."""

    def __init__(self, of: list[int]):
        self.factors = np.ones(KATZ_K + 1)
        found = good_turing(of)
        self.factors[1 : len(found) + 1] = found

    def of(self, counts: np.ndarray) -> np.ndarray:
        return counts * np.where(counts <= KATZ_K, self.factors[np.minimum(counts, KATZ_K).astype(np.int64)], 1.0)


class Unigrams:
    """Probabilities of words by their training counts; count 0 is the one unknown word."""

    def __init__(self, tokens: int, of: list[int]):
        self.tokens, self.discounts = tokens, Discounts(of)
        small = np.arange(1, KATZ_K + 1)
        held = tokens - float(((1 - self.discounts.factors[1:]) * small * np.array(of[:KATZ_K])).sum())
        # nothing left by discounting: leave one count in all to the unknown
        self.scale = 1.0 if tokens and held < tokens * (1 - 1e-9) else tokens / (tokens + 1.0)
        self.unknown = 1.0 - self.scale * held / tokens if tokens else 1.0

    def of(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.discounts.of(counts) * (self.scale / max(self.tokens, 1)), self.unknown)


def context_terms(counts: np.ndarray, classes: np.ndarray, seen_mass: np.ndarray, discounts: Discounts) -> tuple[np.ndarray, np.ndarray]:
    """For contexts of these counts: what to multiply discounted bigram counts by, and the backoff weight.

    ``classes`` has for each context the numbers of followers counted 1 to KATZ_K times, ``seen_mass`` the unigram mass of all followers.
    """
    small = np.arange(1, KATZ_K + 1)
    held = counts - (classes * ((1 - discounts.factors[1:]) * small)).sum(axis=1)
    n = np.maximum(counts, 1)
    scale = np.where(held < n * (1 - 1e-9), 1.0 / n, 1.0 / (n + 1.0))
    weight = np.where(counts > 0, (1.0 - held * scale) / np.maximum(1.0 - seen_mass, 1e-15), 1.0)
    return scale, weight


def _tokenize(batches):
    """Chunks: their documents, sorted distinct word hashes with training counts, and tokens as places in these."""
    import pyarrow as pa
    from pyspark import TaskContext

    known, number = WordHashes(), TaskContext.get().partitionId() << 24
    ids, held, parts, size = [], [], [], 0

    def chunk():
        sizes = np.array([len(p) for p in parts], np.uint32)
        tokens = mixed(np.concatenate(parts))  # spread, so that ranges of hashes are even buckets
        words, local = np.unique(tokens, return_inverse=True)
        trained = np.repeat(np.array(held) == 0, sizes)
        counts = np.bincount(local[trained], minlength=len(words)).astype(np.uint32)
        columns = [
            pa.array([number], pa.int64()),
            pa.array([len(tokens)], pa.int64()),
            pa.array([int((np.array(held) == 0).sum())], pa.int64()),
            pa.array([ids], pa.list_(pa.int64())),
            pa.array([dump(np.array(held, np.uint8), sizes, local.astype(np.uint32))], pa.binary()),
            pa.array([dump(deltas(words, np.zeros(1, np.int64)), counts)], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["chunk", "tokens", "trained", "doc_ids", "body", "words"])

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            ids.append(doc_id)
            held.append(doc_id is None or zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT)
            parts.append(np.append(known.of(text or ""), END))
            size += len(parts[-1])
            if size >= CHUNK_TOKENS:
                yield chunk()
                number += 1
                ids, held, parts, size = [], [], [], 0
    if parts:
        yield chunk()


def bucket_ends(words: np.ndarray, buckets: int) -> np.ndarray:
    """Where in sorted hashes each of equal ranges begins."""
    bucket = ((words >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.searchsorted(bucket, np.arange(buckets + 1))


def _word_requests(buckets: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("words").to_pylist()):
                gaps, counts = load(data)
                words = np.cumsum(gaps, dtype=np.uint64)
                ends = bucket_ends(words, buckets)
                rows = [(b, slice(ends[b], ends[b + 1])) for b in range(buckets) if ends[b + 1] > ends[b]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _ in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int64()), pa.array([dump(deltas(words[o], np.zeros(1, np.int64)), counts[o]) for _, o in rows], pa.binary())],
                    ["bucket", "chunk", "data"],
                )

    return run


def _groups(batches, key):
    """Rows of each key of a stream sorted by it, whatever the batches."""
    own, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row[key] != own:
                if rows:
                    yield own, rows
                own, rows = row[key], []
            rows.append(row)
    if rows:
        yield own, rows


ANSWER = "kind string, bucket int, chunk long, data binary, stats array<long>"


def _answers(bucket: int, table_: bytes, stats: list[int], replies: list[tuple[int, bytes]]):
    import pyarrow as pa

    n = len(replies)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(["table"] + ["reply"] * n),
            pa.array([bucket] * (n + 1), pa.int32()),
            pa.array([None] + [c for c, _ in replies], pa.int64()),
            pa.array([table_] + [d for _, d in replies], pa.binary()),
            pa.array([stats] + [None] * n, pa.list_(pa.int64())),
        ],
        ["kind", "bucket", "chunk", "data", "stats"],
    )


def _counts_of_counts(counts: np.ndarray) -> list[int]:
    return np.bincount(counts[(counts > 0) & (counts <= KATZ_K + 1)].astype(np.int64), minlength=KATZ_K + 2)[1:].tolist()


def _count_words(buckets: int):
    def run(batches):
        for bucket, rows in _groups(batches, "bucket"):
            asked = [load(r["data"]) for r in rows]
            words = [np.cumsum(a[0], dtype=np.uint64) for a in asked]
            every, place = np.unique(np.concatenate(words), return_inverse=True)
            counts = np.bincount(place, np.concatenate([a[1] for a in asked]), len(every)).astype(np.uint64)
            # frequent words get small ids
            rank = np.empty(len(every), np.uint64)
            rank[np.lexsort((every, -counts.astype(np.int64)))] = np.arange(len(every), dtype=np.uint64)
            ids = rank * np.uint64(buckets) + np.uint64(bucket)
            ends = np.cumsum([len(w) for w in words])
            replies = [(r["chunk"], dump(ids[place[e - len(w) : e]], counts[place[e - len(w) : e]])) for r, w, e in zip(rows, words, ends)]
            stats = [int(counts.sum()), int((counts > 0).sum()), *_counts_of_counts(counts)]
            yield _answers(bucket, dump(deltas(every, np.zeros(1, np.int64)), counts), stats, replies)

    return run


class Chunk:
    """A chunk with the ids and counts of its words: its documents' tokens and distinct bigrams, in a fixed order."""

    def __init__(self, rows: list[dict], buckets: int, model: dict):
        body = next(r for r in rows if r["kind"] == "body")
        self.doc_ids = body["doc_ids"]
        held, self.sizes, local = load(body["data"])
        self.held = held.astype(bool)
        # replies by range of hashes, in order, are in the order of the chunk's words
        replies = [load(r["data"]) for r in sorted((r for r in rows if r["kind"] == "word"), key=lambda r: r["bucket"])]
        ids, counts = (np.concatenate([r[k] for r in replies]) for k in (0, 1))
        by_id = np.argsort(ids)
        code = np.empty(len(ids), np.int64)
        code[by_id] = np.arange(len(ids))
        self.ids, self.counts = ids[by_id], counts[by_id]
        self.tokens = code[local]
        self.starts = np.cumsum(self.sizes.astype(np.int64)) - self.sizes
        # contexts: the word before, or the start of a text, which comes after all words
        context = np.empty(len(local), np.int64)
        context[1:] = self.tokens[:-1]
        context[self.starts] = len(ids)
        self.context_ids = np.append(self.ids, np.uint64(1 << 62))
        self.context_counts = np.append(self.counts, np.uint64(model["trained"]))
        key = context * (len(ids) + 1) + self.tokens
        self.pairs, self.pair_of = np.unique(key, return_inverse=True)
        self.context, self.word = np.divmod(self.pairs, len(ids) + 1)
        split = np.ceil(self.context_counts * (buckets / SPLIT_SHARE / max(model["tokens"], 1))).astype(np.int64)
        self.split = np.maximum(split, 1)
        part = (mixed(self.ids[self.word]) % self.split[self.context].astype(np.uint64)).astype(np.int64)
        # every part of every context, followed here or not, and the bucket of each
        used = np.unique(self.context)
        self.part_context = np.repeat(used, self.split[used])
        first = np.zeros(len(ids) + 2, np.int64)
        first[used] = np.cumsum(self.split[used]) - self.split[used]
        self.part_number = np.arange(len(self.part_context)) - first[self.part_context]
        self.part_bucket = (mixed(self.context_ids[self.part_context] * np.uint64(0x9E3779B97F4A7C15) + self.part_number.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        self.pair_part = first[self.context] + part

    def layout(self, buckets: int):
        """Parts and pairs in the order in which the buckets get and answer them."""
        part_order = np.lexsort((self.part_number, self.part_context, self.part_bucket))
        part_ends = np.searchsorted(self.part_bucket[part_order], np.arange(buckets + 1))
        pair_bucket, pair_number = self.part_bucket[self.pair_part], self.part_number[self.pair_part]
        pair_order = np.lexsort((self.word, pair_number, self.context, pair_bucket))
        pair_ends = np.searchsorted(pair_bucket[pair_order], np.arange(buckets + 1))
        return part_order, part_ends, pair_order, pair_ends


def _bigram_requests(buckets: int, model: dict):
    def run(batches):
        import pyarrow as pa

        for chunk, rows in _groups(batches, "chunk"):
            c = Chunk(rows, buckets, model)
            trained = np.repeat(~c.held, c.sizes)
            times = np.bincount(c.pair_of[trained], minlength=len(c.pairs)).astype(np.uint32)
            followers = np.bincount(c.pair_part, minlength=len(c.part_context)).astype(np.uint32)
            part_order, part_ends, pair_order, pair_ends = c.layout(buckets)
            out = []
            for b in range(buckets):
                parts, pairs = part_order[part_ends[b] : part_ends[b + 1]], pair_order[pair_ends[b] : pair_ends[b + 1]]
                if len(parts):
                    sizes = followers[parts]
                    held = sizes > 0
                    starts = (np.cumsum(sizes, dtype=np.int64) - sizes)[held]
                    words = deltas(c.ids[c.word[pairs]], starts) if len(pairs) else np.zeros(0, np.uint64)
                    contexts = deltas(c.context_ids[c.part_context[parts]], np.zeros(1, np.int64))
                    out.append((b, dump(contexts, c.part_number[parts].astype(np.uint32), sizes, words, c.counts[c.word[pairs]], times[pairs])))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([chunk] * len(out), pa.int64()), pa.array([d for _, d in out], pa.binary())], ["bucket", "chunk", "data"])

    return run


def _count_bigrams(model: dict):
    def run(batches):
        unigrams = Unigrams(model["tokens"], model["of"])
        for bucket, rows in _groups(batches, "bucket"):
            asked = []
            for r in rows:
                contexts, numbers, sizes, words, word_counts, times = load(r["data"])
                r["data"] = None
                asked.append((np.cumsum(contexts, dtype=np.uint64), numbers, sizes, undelta(words, sizes.astype(np.int64)), word_counts, times))
            # a part of a context, as one number
            part_key = [mixed(a[0] * np.uint64(0x9E3779B97F4A7C15) + mixed(a[1].astype(np.uint64))) for a in asked]
            parts, part_at = np.unique(np.concatenate(part_key), return_inverse=True)
            pair_part = np.repeat(part_at, np.concatenate([a[2] for a in asked]))
            words = np.concatenate([a[3] for a in asked])
            key = mixed(mixed(pair_part.astype(np.uint64)) + words)
            pairs, first, pair_at = np.unique(key, return_index=True, return_inverse=True)
            times = np.bincount(pair_at, np.concatenate([a[5] for a in asked]), len(pairs)).astype(np.int64)
            own_part, mass = pair_part[first], unigrams.of(np.concatenate([a[4] for a in asked])[first])
            seen = times > 0
            masses = np.bincount(own_part[seen], mass[seen], len(parts))
            classes = np.stack([np.bincount(own_part[times == k], minlength=len(parts)) for k in range(1, KATZ_K + 1)], axis=1).astype(np.uint32)
            replies, pair_from, part_from = [], 0, 0
            for r, a in zip(rows, asked):
                part_to, pair_to = part_from + len(a[0]), pair_from + len(a[3])
                own = part_at[part_from:part_to]
                replies.append((r["chunk"], dump(times[pair_at[pair_from:pair_to]].astype(np.uint32), masses[own], *classes[own].T)))
                part_from, pair_from = part_to, pair_to
            yield _answers(bucket, dump(times[seen].astype(np.uint32)), _counts_of_counts(times), replies)

    return run


def _score(buckets: int, model: dict):
    def run(batches):
        import pyarrow as pa

        unigrams, bigrams = Unigrams(model["tokens"], model["of"]), Discounts(model["of_pairs"])
        for _, rows in _groups(batches, "chunk"):
            c = Chunk(rows, buckets, model)
            part_order, part_ends, pair_order, pair_ends = c.layout(buckets)
            times, mass = np.zeros(len(c.pairs), np.int64), np.zeros(len(c.part_context))
            classes = np.zeros((len(c.part_context), KATZ_K))
            for r in rows:
                if r["kind"] == "pair":
                    b, (own_times, own_mass, *own_classes) = r["bucket"], load(r["data"])
                    times[pair_order[pair_ends[b] : pair_ends[b + 1]]] = own_times
                    parts = part_order[part_ends[b] : part_ends[b + 1]]
                    mass[parts] = own_mass
                    classes[parts] = np.stack(own_classes, axis=1)
            n = len(c.context_ids)
            all_mass = np.bincount(c.part_context, mass, n)
            all_classes = np.stack([np.bincount(c.part_context, classes[:, k], n) for k in range(KATZ_K)], axis=1)
            scale, weight = context_terms(c.context_counts.astype(np.float64), all_classes, all_mass, bigrams)
            # recursion: the bigram if it was trained, else down to the unigram
            below = weight[c.context] * unigrams.of(c.counts)[c.word]
            probability = np.where(times > 0, bigrams.of(times) * scale[c.context], below)
            logs = np.log10(probability)[c.pair_of]
            counts = c.counts[c.tokens]
            base = np.log10((counts + 1.0) / (model["tokens"] + model["words"] + 1.0))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(c.doc_ids, pa.int64()),
                    pa.array(c.held),
                    pa.array(c.sizes.astype(np.int64)),
                    pa.array(np.add.reduceat((counts > 0).astype(np.int64), c.starts)),
                    pa.array(np.add.reduceat(base, c.starts)),
                    pa.array(np.add.reduceat(logs, c.starts)),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
            )

    return run


def _summed(rows: DataFrame, width: int) -> list[int]:
    sums = rows.where("kind = 'table'").agg(*(F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)) for i in range(width))).first()
    return [int(x) for x in sums]


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    chunks = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _tokenize, "chunk long, tokens long, trained long, doc_ids array<long>, body binary, words binary"
    )
    chunks = materialize(chunks, "chunks")
    tokens, trained, count = chunks.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("trained"), F.lit(0)), F.count("*")).first()
    buckets = max(LEAST_BUCKETS, -(-tokens // BUCKET_TOKENS))
    wide = partitions(spark, buckets, 1)
    request = "bucket int, chunk long, data binary"
    asked = chunks.select("chunk", "words").mapInArrow(_word_requests(buckets), request)
    words = materialize(asked.repartition(wide, "bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(_count_words(buckets), ANSWER), "words")
    trained_tokens, known, *of = _summed(words, KATZ_K + 3)
    model = {"tokens": trained_tokens, "words": known, "of": of, "trained": int(trained)}
    bodies = chunks.select("chunk", F.lit("body").alias("kind"), F.lit(-1).alias("bucket"), F.col("body").alias("data"), "doc_ids")
    none = {"doc_ids": F.lit(None).cast("array<long>")}
    replies = words.where("kind = 'reply'").select("chunk", F.lit("word").alias("kind"), "bucket", "data").withColumns(none)
    by_chunk = lambda df: df.repartition(partitions(spark, count, 1), "chunk").sortWithinPartitions("chunk", "bucket", "kind")
    wanted = by_chunk(bodies.unionByName(replies)).mapInArrow(_bigram_requests(buckets, model), request)
    pairs = materialize(wanted.repartition(wide, "bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(_count_bigrams(model), ANSWER), "pairs")
    model = model | {"of_pairs": _summed(pairs, KATZ_K + 1)}
    pair_replies = pairs.where("kind = 'reply'").select("chunk", F.lit("pair").alias("kind"), "bucket", "data").withColumns(none)
    scored = by_chunk(bodies.unionByName(replies).unionByName(pair_replies)).mapInArrow(
        _score(buckets, model), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.withColumn("train_tokens", F.lit(trained_tokens).cast("long"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_texts(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op10_lm_score": op10_lm_score}
ORACLES: dict[str, str] = {}
