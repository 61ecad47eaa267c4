"""Substring dedup: passages of ``length`` words and more that an earlier document (a smaller doc_id) holds are removed.

The reference is the corpus itself, so it is cut into shards that only the documents concerned meet. Of every window of
``length`` words the least hash of its ``GRAM``-word runs is an anchor: equal windows have equal anchors, and about one
word in 22 is one. The words around an anchor, as far as windows that hold it reach, are its context. Anchors that lie in one
document alone are dropped by an aggregate; contexts that are equal are told from each other by a hash, and each but its first
document's is wholly removed. What is left, the different contexts of one anchor, is a reference shard: its contexts, in the
order of doc_id, are streamed through the suffix automaton of those before them, the matching statistics give the
maximal spans of at least ``length`` words, and then each is added to the automaton.

A shard holds at most ``MOST_CONTEXTS`` contexts. An anchor with more surroundings (a passage that a third of the corpus
repeats has them at its edges) has its windows cut into ranges, by how many words they have before the anchor: ranges that
one document alone holds fall out, ranges that an earlier document has wholly are copies, both by aggregates with map-side combination,
and only those between are cut again, down to single windows. Nothing is dropped either way.

Text travels twice at most: whole documents meet their marks once, and only those that hold the first copy of a context
with neighbours are read again. Words, anchors and contexts are told apart by 64-bit hashes (a context beside its
anchor or core, so by 128 bits); the automata compare the words themselves.

Defined results: a null or blank text has no words and its digest is that of the empty string; a row without a doc_id is earlier
or later than none, so it is neither judged nor a reference; rows that repeat a doc_id are judged each, and not against
each other; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import discard, materialize, slices_by_bytes, table
from millrace.llm.near_dup import mixed

LENGTH = 50
GRAM = 8
MOST_CONTEXTS = 512
KNOWN_WORDS = 60_000
SLICE_BYTES = 4 << 20
COPY, MIXED, CROWDED = 0, 1, 2
#: Parts that a range of windows around a crowded anchor is cut into at a time.
CUTS = 4
SPANS = "doc_id long, row long, start int, stop int"
MARKS = "array<struct<pos:int,kind:int,key:bigint,ctx:bigint>>"
RESULT = "n_words long, n_removed long, removed array<struct<start:int,stop:int>>, kept_sha256 string"


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > KNOWN_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # bytes are split at exactly the six white-space characters


def gram_keys(hashes: np.ndarray, gram: int) -> np.ndarray:
    grams = np.zeros(len(hashes) - gram + 1, np.uint64)
    for k in range(gram):
        grams = grams * np.uint64(0x9FB21C651E98DF25) + hashes[k : len(grams) + k]
    return mixed(grams)


def anchors(hashes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and keys of anchors: every window of ``length`` words holds one that has the least key of the window."""
    if len(hashes) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    grams = gram_keys(hashes, gram)
    width = length - gram + 1
    least, reach = grams, 1
    while reach < width:
        step = min(reach, width - reach)
        least, reach = np.minimum(least[: len(least) - step], least[step:]), reach + step
    # of equal least keys the last one of a window is taken and kept for as long as windows hold it
    changes = np.append(np.flatnonzero(least[1:] != least[:-1]) + 1, len(least))
    found, at = [], 0
    while at < len(least):
        last = at + width - 1 - int(np.argmin(grams[at : at + width][::-1]))
        found.append(last)
        at = min(last + 1, int(changes[np.searchsorted(changes, at, side="right")]))
    positions = np.unique(np.array(found, np.int64))
    return positions, grams[positions]


def context(position: int, words: int, length: int, gram: int) -> tuple[int, int]:
    """The words that windows holding the anchor reach."""
    return max(0, position - (length - gram)), min(words, position + length)


def _anchor_rows(batches: Iterator, length: int, gram: int) -> Iterator:
    import pyarrow as pa
    import xxhash

    known = WordHashes()
    for whole in batches:
        for batch in slices_by_bytes(whole, "text", SLICE_BYTES):
            ids, rows, keys, contexts, places = [], [], [], [], []
            for doc_id, row, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text")), strict=True):
                hashes = known.of(words_of(text))
                positions, found = anchors(hashes, length, gram)
                for p in positions.tolist():
                    a, b = context(p, len(hashes), length, gram)
                    contexts.append(xxhash.xxh3_64_intdigest(hashes[a:b].data))
                ids += [doc_id] * len(positions)
                rows += [row] * len(positions)
                keys.append(found)
                places.append(positions)
            contexts = np.array(contexts, np.uint64).view(np.int64)
            columns = [pa.array(np.concatenate(keys).view(np.int64)), pa.array(contexts), pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(np.concatenate(places).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "ctx", "doc_id", "row", "pos"])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal spans of words, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def cut(words: list[bytes], spans: list[tuple[int, int]]) -> tuple[int, str]:
    """How many words the spans (maximal, in order) cover, and the digest of the others."""
    kept, at = [], 0
    for a, b in spans:
        kept += words[at:a]
        at = b
    kept += words[at:]
    return len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def _judged(ids, rows, results) -> object:
    import pyarrow as pa

    spans = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    columns = [pa.array([r and r[0] for r in results], pa.int64()), pa.array([r and r[1] for r in results], pa.int64())]
    columns += [pa.array([r and [{"start": a, "stop": b} for a, b in r[2]] for r in results], spans), pa.array([r and r[3] for r in results], pa.string())]
    return [ids, rows, *columns], ["doc_id", "row", "n_words", "n_removed", "removed", "kept_sha256"]


def _settle(batches: Iterator, length: int, gram: int) -> Iterator:
    """Documents with copies of contexts alone are finished; the others keep text and marks for later."""
    import pyarrow as pa

    for whole in batches:
        for batch in slices_by_bytes(whole, "text", SLICE_BYTES):
            results, texts, left = [], [], []
            for text, marks in zip(batch.column("text").to_pylist(), batch.column("marks").to_pylist(), strict=True):
                if any(m["kind"] != COPY for m in marks or ()):
                    results.append(None), texts.append(text), left.append(marks)
                    continue
                words = words_of(text)
                spans = merged([context(m["pos"], len(words), length, gram) for m in marks or ()])
                results.append((len(words), (c := cut(words, spans))[0], spans, c[1])), texts.append(None), left.append(None)
            columns, names = _judged(batch.column("doc_id"), batch.column("row"), results)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(left, batch.schema.field("marks").type)], [*names, "text", "marks"])


def _contexts(batches: Iterator, length: int, gram: int) -> Iterator:
    import pyarrow as pa

    for whole in batches:
        for batch in slices_by_bytes(whole, "text", SLICE_BYTES):
            out = []
            for doc_id, row, text, marks in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text", "marks")), strict=True):
                words = words_of(text)
                for m in marks:
                    if m["kind"] == MIXED:
                        a, b = context(m["pos"], len(words), length, gram)
                        out.append((m["key"], doc_id, m["ctx"], row, a, b" ".join(words[a:b]).decode()))
            kinds = [("key", pa.int64()), ("doc_id", pa.int64()), ("ctx", pa.int64()), ("row", pa.int64()), ("at", pa.int32()), ("words", pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, (_, kind) in enumerate(kinds)], [n for n, _ in kinds])


def _surroundings(batches: Iterator, length: int, gram: int) -> Iterator:
    """The word hashes around each crowded anchor, and how many of them are before it.

    A window may hold its key several times; it counts to the last of them, so what follows reaches no window that holds a later one.
    """
    import pyarrow as pa

    known = WordHashes()
    most = length - gram
    for whole in batches:
        for batch in slices_by_bytes(whole, "text", SLICE_BYTES // 16):
            out = []
            for doc_id, row, text, marks in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text", "marks")), strict=True):
                hashes = known.of(words_of(text))
                grams = gram_keys(hashes, gram).view(np.int64)
                crowded: dict[int, list[int]] = {}
                for m in marks:
                    if m["kind"] == CROWDED:
                        crowded.setdefault(m["key"], []).append(m["pos"])
                held: dict[int, list[int]] = {}
                for at in np.flatnonzero(np.isin(grams, np.array(list(crowded), np.int64))).tolist():
                    held.setdefault(int(grams[at]), []).append(at)
                for key, places in crowded.items():
                    marked = np.sort(np.array(places))
                    for at, later in zip(held[key], [*held[key][1:], len(hashes) + length]):
                        near = np.searchsorted(marked, at - most)
                        a, b = max(0, at - most), min(len(hashes), at + length, later + gram - 1)
                        if near < len(marked) and marked[near] <= at + most and b - a >= length:
                            out.append((key, doc_id, row, at, at - a, hashes[a:b].view(np.int64)))
            kinds = [("key", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("pos", pa.int32()), ("before", pa.int32()), ("words", pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, (_, kind) in enumerate(kinds)], [n for n, _ in kinds])


class SuffixAutomaton:
    """The words of several passages; every run of words that one of them holds is a path from state 0."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, moves: dict, link: int, length: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, q: int, word) -> int:
        """A state for the words up to q as they are reached from p, taking over q's shorter runs."""
        made = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        self.link[q] = made
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = made
            p = self.link[p]
        return made

    def add(self, passage: list) -> None:
        last = 0
        for word in passage:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
                continue
            made, p = self._state({}, 0, self.length[last] + 1), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = made
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[made] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
            last = made

    def spans(self, passage: list, least: int) -> list[tuple[int, int]]:
        """Maximal spans covered by runs of at least ``least`` words that the automaton holds, by matching statistics."""
        state = matched = 0
        found: list[tuple[int, int]] = []
        for at, word in enumerate(passage, 1):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            state, matched = (self.next[state][word], matched + 1) if word in self.next[state] else (0, 0)
            if matched >= least:
                if found and at - least <= found[-1][1]:
                    found[-1] = found[-1][0], at
                else:
                    found.append((at - least, at))
        return found


def _match(batches: Iterator, length: int) -> Iterator:
    """From contexts sorted by key, doc_id and ctx: spans that a smaller doc_id of the key holds."""
    import pyarrow as pa

    key = doc = automaton = None
    waiting: dict[int, list[str]] = {}  # different contexts of the document at hand
    for batch in batches:
        out = []
        for k, doc_id, ctx, row, at, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key:
                key, doc, automaton, waiting = k, doc_id, SuffixAutomaton(), {}
            elif doc_id != doc:
                for passage in waiting.values():
                    automaton.add(passage)
                doc, waiting = doc_id, {}
            passage = waiting.setdefault(ctx, text.split(" "))
            out += [(doc_id, row, at + a, at + b) for a, b in automaton.spans(passage, length)]
        kinds = [("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, (_, kind) in enumerate(kinds)], [n for n, _ in kinds])


def _finish(batches: Iterator, length: int, gram: int) -> Iterator:
    import pyarrow as pa

    for whole in batches:
        for batch in slices_by_bytes(whole, "text", SLICE_BYTES):
            results = []
            for text, marks, spans in zip(*(batch.column(c).to_pylist() for c in ("text", "marks", "spans")), strict=True):
                words = words_of(text)
                found = merged([context(m["pos"], len(words), length, gram) for m in marks if m["kind"] == COPY] + [(s["start"], s["stop"]) for s in spans or ()])
                results.append((len(words), (c := cut(words, found))[0], found, c[1]))
            columns, names = _judged(batch.column("doc_id"), batch.column("row"), results)
            yield pa.RecordBatch.from_arrays(columns, names)


def crowded_spans(around: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, row, start, stop) of windows around crowded anchors that a smaller doc_id holds.

    ``around`` has key, doc_id, row, pos, before and words. Windows are told by how many words they have before the anchor; a range of
    them is one part. All its windows hold its core; together they reach its words. A part whose core one document alone holds has no
    copies, one whose words an earlier document has is a copy as a whole, and what is left is cut in ``CUTS`` again, down to single windows.
    """
    most = length - gram
    c = F.col
    nodes = around.withColumns({"low": F.lit(0), "high": F.lit(most)})
    found = around.sparkSession.createDataFrame([], SPANS)
    width = most + 1
    while width > 1:
        width = -(-width // CUTS)
        parts = nodes.select("key", "doc_id", "row", "pos", "before", "words", "high", F.explode(F.sequence("low", "high", F.lit(width))).alias("from"))
        parts = parts.withColumn("to", F.least(c("from") + width - 1, "high"))
        # the windows that the document has room for
        parts = parts.withColumns({"a": F.greatest("from", most + gram + c("before") - F.size("words")), "b": F.least("to", "before")}).where("a <= b")
        core = F.xxhash64(F.slice("words", c("before") - c("from") + 1, c("from") + length - c("to")))
        words = F.slice("words", c("before") - c("b") + 1, c("b") + length - c("a"))
        parts = parts.select("key", "from", "to", "doc_id", "row", "pos", "a", "b", core.alias("core"), words.alias("words"))
        parts = parts.withColumn("ctx", F.xxhash64("words", "a", "b"))
        contexts = materialize(parts.groupBy("key", "from", "core", "ctx").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), "contexts")
        cores = contexts.groupBy("key", "from", "core").agg(F.min("first").alias("low"), F.max("last").alias("high"), F.count("*").alias("n")).where("low < high")
        shared = contexts.join(cores, ["key", "from", "core"]).select("key", "from", "core", "ctx", "first", "n")
        told = parts.join(shared, ["key", "from", "core", "ctx"]).withColumn("copy", c("doc_id") > c("first")).where("copy OR n > 1 AND from < to")
        told = materialize(told.select("key", "from", "to", "doc_id", "row", "pos", "a", "b", "copy", F.when(~c("copy"), c("words")).alias("words")), "told")
        discard(contexts)
        found = found.unionByName(told.where("copy").select("doc_id", "row", (c("pos") - c("b")).alias("start"), (c("pos") - c("a") + length).alias("stop")))
        nodes = told.where("NOT copy").select("key", "doc_id", "row", "pos", c("b").alias("before"), "words", c("from").alias("low"), c("to").alias("high"))
        if nodes.isEmpty():
            break
    return found


def repeated_passages(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """doc_id, n_words, n_removed, removed (maximal spans of words) and kept_sha256 (of the other words, joined by one space) of every row."""
    of = partial(partial, length=length, gram=gram)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    rows = texts.where("doc_id IS NOT NULL").mapInArrow(of(_anchor_rows), "key long, ctx long, doc_id long, row long, pos int")
    repeated = rows.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("key")
    held = materialize(rows.join(materialize(repeated, "anchors"), "key"), "occurrences")

    contexts = materialize(held.groupBy("key", "ctx").agg(F.min("doc_id").alias("first")), "contexts")
    crowds = contexts.groupBy("key").agg(F.count("*").alias("n"))
    kinds = contexts.join(crowds.where("n > 1"), "key", "left").select(
        "key", "ctx", "first", F.when(F.col("n") > most_contexts, CROWDED).when(F.col("n") > 1, MIXED).alias("kind")
    )
    kinds = materialize(kinds, "kinds")
    told = held.join(kinds, ["key", "ctx"]).withColumn("kind", F.when(F.col("doc_id") > F.col("first"), F.lit(COPY)).otherwise(F.col("kind")))
    marks = told.where("kind IS NOT NULL").groupBy("doc_id", "row").agg(F.collect_set(F.struct("pos", "kind", "key", "ctx")).cast(MARKS).alias("marks"))
    settled = texts.join(marks, ["doc_id", "row"], "left").select("doc_id", "row", "text", "marks")
    schema = f"doc_id long, row long, {RESULT}"
    settled = materialize(settled.mapInArrow(of(_settle), f"{schema}, text string, marks {MARKS}"), "settled")
    for done in (held, contexts, kinds):
        discard(done)

    open_ = settled.where("marks IS NOT NULL").select("doc_id", "row", "text", "marks")

    def with_kind(kind: int) -> DataFrame:
        return open_.where(F.exists("marks", lambda m: m.kind == kind))

    mixed_ = with_kind(MIXED).mapInArrow(of(_contexts), "key long, doc_id long, ctx long, row long, at int, words string")
    spans = mixed_.repartition("key").sortWithinPartitions("key", "doc_id", "ctx").mapInArrow(partial(_match, length=length), SPANS)
    around = materialize(with_kind(CROWDED).mapInArrow(of(_surroundings), "key long, doc_id long, row long, pos int, before int, words array<bigint>"), "around")
    crowded = crowded_spans(around, length, gram)
    found = spans.unionByName(crowded).groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    finished = open_.join(found, ["doc_id", "row"], "left").mapInArrow(of(_finish), schema)
    columns = ["doc_id", "n_words", "n_removed", "removed", "kept_sha256"]
    return settled.where("marks IS NULL").select(*columns).unionByName(finished.select(*columns))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP11_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), l AS (
  SELECT r, doc_id, list_transform(range(1, len(words) - 48), lambda i: md5(array_to_string(words[i:i + 49], ' '))) AS wins FROM w
), h AS (
  SELECT r, doc_id, unnest(wins) AS win, generate_subscripts(wins, 1) AS i FROM l
), m AS (
  SELECT win, min(doc_id) AS first FROM h GROUP BY win
), hits AS (
  SELECT h.r, h.i FROM h JOIN m ON h.win = m.win WHERE m.first < h.doc_id
), p AS (
  SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w
), c AS (
  SELECT p.r, p.i, p.word, max((hits.i IS NOT NULL)::INT) OVER (PARTITION BY p.r ORDER BY p.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
  FROM p LEFT JOIN hits ON p.r = hits.r AND p.i = hits.i
), g AS (
  SELECT r, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM c GROUP BY r
)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, coalesce(g.n_removed, 0) AS n_removed, sha256(coalesce(g.kept, '')) AS kept_sha256
FROM w LEFT JOIN g ON w.r = g.r
"""

QUERIES = {"op11_substring_dedup": op11_substring_dedup}
ORACLES = {"op11_substring_dedup": OP11_SQL}
