"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into overlapping chunks that cover it whole. Every place is embedded as the sum of two learned
vectors: one of its byte, and one of its age, which tells how long ago the ``GRAM`` bytes from here on were last read in the
document (in powers of two; 0 for never), so that repetition is visible to filters of any width. Learned filters slide
over the embedded places; each is max-pooled over its chunk, and the chunks' maxima are pooled over the
document by maximum and mean. A logistic layer combines them into one probability.

Training: stochastic gradient descent (Adam) on at most ``SAMPLE_EACH`` labelled documents of each
class, those with the least hash of doc_id among the rows whose crc32(doc_id as text) mod 5 is not 0 and whose text has at most
``SAMPLE_BYTES`` bytes, so that what the driver gathers is bounded; they train whole, as whole texts of any length are scored.
Every batch has as many of either class, so a score is the probability under even classes.
Nothing but text is an input of a score.

Defined results: a null text is empty and gets a score; without labels of both classes every
score is the share of label 1 (or 1/2); null labels are ignored; a doc_id labelled more than once
counts as its mean, 1 from one half on; of documents that repeat a labelled doc_id the text least in order trains; a null doc_id is not
held out; repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
SAMPLE_EACH = 700
CHUNK, OVERLAP = 512, 64
WIDTH, STRIDE, EMBED, FILTERS = 8, 3, 6, 16
STEPS, BATCH, RATE = 300, 32, 0.01
GRAM, AGES = 6, 16
SAMPLE_BYTES = 1 << 16


def ages_of(data: np.ndarray) -> np.ndarray:
    """For each place: 0 if its GRAM bytes are new, else 1 + the number of binary digits of how far back they stand (AGES - 1 at most)."""
    out = np.zeros(len(data), np.uint16)
    if len(data) <= GRAM:
        return out
    wide = data.astype(np.uint64)
    count = len(data) - GRAM + 1
    grams = np.zeros(count, np.uint64)
    for k in range(GRAM):
        grams = (grams << np.uint64(8)) | wide[k : k + count]
    order = np.argsort(grams, kind="stable")
    seen = grams[order[1:]] == grams[order[:-1]]
    back = (order[1:] - order[:-1])[seen]
    out[order[1:][seen]] = np.minimum(np.frexp(back)[1] + 1, AGES - 1)
    return out


def chunks_of(data: bytes) -> np.ndarray:
    """Rows of CHUNK codes, each a byte plus one and 257 times its age; 0 pads the last."""
    step = CHUNK - OVERLAP
    count = max(1, -(-(len(data) - OVERLAP) // step))
    flat = np.zeros((count - 1) * step + CHUNK, np.uint16)
    read = np.frombuffer(data, np.uint8)
    flat[: len(data)] = read.astype(np.uint16) + 1 + np.uint16(257) * ages_of(read)
    return np.lib.stride_tricks.sliding_window_view(flat, CHUNK)[::step]


class ByteCNN:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.weights = {
            "embed": rng.normal(0, 0.5, (257, EMBED)).astype(np.float32),
            "ages": rng.normal(0, 0.5, (AGES, EMBED)).astype(np.float32),
            "filters": rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "head": rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
            "intercept": np.zeros(1, np.float32),
        }
        self.weights["embed"][0] = self.weights["ages"][0] = 0  # padding says nothing
        self.constant = None

    def _pooled(self, chunks: np.ndarray, places: bool = False):
        """Maxima of each chunk's filters, and where they are."""
        w, best, where = self.weights, [], []
        spots = (CHUNK - WIDTH) // STRIDE + 1
        table_ = (w["ages"][:, None] + w["embed"]).reshape(-1, EMBED)
        for at in range(0, len(chunks), 128):
            flat = table_[chunks[at : at + 128]].reshape(-1, CHUNK * EMBED)
            seen = np.lib.stride_tricks.as_strided(flat, (len(flat), spots, WIDTH * EMBED), (flat.strides[0], STRIDE * EMBED * 4, 4))
            out = (seen.reshape(-1, WIDTH * EMBED) @ w["filters"]).reshape(len(flat), spots, FILTERS)
            if places:
                where.append(out.argmax(axis=1))
            best.append(out.max(axis=1))
        best = np.maximum(np.concatenate(best) + w["bias"], 0)
        return (best, np.concatenate(where)) if places else best

    def _features(self, best: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return np.concatenate([np.maximum.reduceat(best, starts), np.add.reduceat(best, starts) / sizes[:, None]], axis=1)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out, at = np.zeros(len(texts)), 0
        while at < len(texts):  # some documents at a time, by size
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) < 1 << 20):
                size += len(texts[to])
                to += 1
            parts = [chunks_of(t) for t in texts[at:to]]
            sizes = np.array([len(p) for p in parts])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            x = self._features(self._pooled(np.concatenate(parts)), starts, sizes)
            out[at:to] = 1 / (1 + np.exp(-np.clip((x @ self.weights["head"]).astype(np.float64) + self.weights["intercept"][0], -40, 40)))
            at = to
        return out

    def fit(self, texts: list[bytes], labels: np.ndarray, share: float) -> "ByteCNN":
        """``share``: the score of everything if the sample has one class only."""
        if not len(labels) or labels.min() == labels.max():
            self.constant = float(share)
            return self
        parts = [chunks_of(t) for t in texts]
        rng = np.random.default_rng(11)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.weights.items()}
        classes = [np.nonzero(labels == k)[0] for k in (0, 1)]
        queues: list[list[int]] = [[], []]
        for step in range(1, STEPS + 1):
            own = []
            for members, queue in zip(classes, queues):
                while len(queue) < BATCH // 2:
                    queue.extend(rng.permutation(members).tolist())
                own += queue[: BATCH // 2]
                del queue[: BATCH // 2]
            grads = self._gradients([parts[i] for i in own], labels[own])
            rate = RATE * (1 - step / (STEPS + 1)) ** 0.5
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                self.weights[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self

    def _gradients(self, parts: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        chunks, sizes = np.concatenate(parts), np.array([len(p) for p in parts])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        best, where = self._pooled(chunks, places=True)
        x = self._features(best, starts, sizes)
        p = 1 / (1 + np.exp(-np.clip(x @ w["head"] + w["intercept"][0], -30, 30)))
        off = ((p - labels) / len(labels)).astype(np.float32)
        doc = np.repeat(np.arange(len(parts)), sizes)
        top = (best == x[doc, :FILTERS]).astype(np.float32)
        top /= np.add.reduceat(top, starts)[doc]  # chunks that tie share what flows back
        down = off[doc, None] * (w["head"][FILTERS : 2 * FILTERS] / sizes[doc, None] + top * w["head"][:FILTERS]) * (best > 0)
        row, column = np.nonzero(down)
        value = down[row, column]
        spots = where[row, column, None] * STRIDE + np.arange(WIDTH)
        seen = chunks[row[:, None], spots]
        ages, read = np.divmod(seen, 257)
        inputs = (w["embed"][read] + w["ages"][ages]).reshape(len(row), -1)
        filters = np.zeros_like(w["filters"])
        embed, aged = np.zeros_like(w["embed"]), np.zeros_like(w["ages"])
        for f in range(FILTERS):
            own = column == f
            filters[:, f] = value[own] @ inputs[own]
        back = (value[:, None] * w["filters"].T[column]).reshape(len(row), WIDTH, EMBED)
        np.add.at(embed, read.reshape(-1), back.reshape(-1, EMBED))
        np.add.at(aged, ages.reshape(-1), back.reshape(-1, EMBED))
        embed[0] = aged[0] = 0
        return {"embed": embed, "ages": aged, "filters": filters + 1e-4 * w["filters"], "bias": down.sum(axis=0), "head": x.T @ off + 1e-3 * w["head"] / len(labels), "intercept": np.array([off.sum()])}


def fold(doc_id, folds: int):
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def train(docs: DataFrame, labels: DataFrame) -> ByteCNN:
    """Fits the network on a bounded sample of the labelled documents outside the held-out fold."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES)
    known = (
        labels.where(F.col("quality").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
        .join(texts.select("doc_id"), "doc_id", "left_semi")
    )
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5
    if len(counts) < 2:
        return ByteCNN().fit([], np.zeros(0), share)
    picked = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_EACH) for k in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * SAMPLE_EACH rows
    rows = texts.join(sample, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r.doc_id)
    return ByteCNN().fit([r.text.encode() for r in rows], np.array([r.label for r in rows], np.float32), share)


def score_documents(docs: DataFrame, model: ByteCNN) -> DataFrame:
    """doc_id, score and predicted of every row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            scores = model.scores([(t or "").encode() for t in batch.column("text").to_pylist()])
            kept = pa.array((scores >= THRESHOLD).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), kept], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: ByteCNN) -> DataFrame:
    """The rows of docs that the classifier accepts, with all their columns."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array(model.scores([(t or "").encode() for t in batch.column("text").to_pylist()]) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {"op8_quality_classifier": op8_quality_classifier}
ORACLES: dict[str, str] = {}
