"""Spelling variants: words one edit apart, found by a positional q-gram inverted index with a count filter.

Two words one edit apart, the longer of L letters, share at least L - 3 of their pairs of neighbouring letters (grams), each
at the same place or one further on; and one half of the longer word (its first L / 2 letters, or its last) is whole in both. So words
are dealt by length, half and place: a word stands in two lists of its own length and visits two of words one letter longer. Each list is
worked on by itself: its words are indexed by the grams outside the shared half, a word's postings are merged by a heap
under the limits of length and place, and words that come up often enough for the bound are verified letter by letter. Lists
over ``MOST_WORDS`` words are cut into blocks that all their words visit, so a task never holds more and no pair is lost.

Defined results: a null text has no runs; a null doc_id counts as the empty string; rows count as often as they are repeated;
an empty table gives no rows; other columns of the input are ignored; texts of any length are read in pieces cut between runs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from heapq import merge

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import ASCII_LOWER, discard, materialize, table

RUN, BETWEEN = re.compile("[A-Za-zÀ-ÿ]+"), re.compile("[^A-Za-zÀ-ÿ]")
PIECE = 1 << 20
LEAST_LETTERS, LEAST_COUNT = 5, 3
EDIT_EVERY = 97
#: Distinct words that a task counts before it passes them on.
HELD_WORDS = 150_000
MOST_WORDS = 4000


def pieces(text: str) -> Iterator[list[str]]:
    """The runs of a text, some at a time."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            border = BETWEEN.search(text, end)
            end = border.start() if border else len(text)
        yield RUN.findall(text, at, end)
        at = end


def _tally(batches: Iterator) -> Iterator:
    import pyarrow as pa

    def out():
        return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

    total: Counter = Counter()
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for runs in pieces(text or ""):
                for run, n in Counter(runs).items():
                    word = run if run.islower() and run.isascii() else run.translate(ASCII_LOWER)
                    h = zlib.crc32(word.encode(), start)
                    if h % EDIT_EVERY == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= LEAST_LETTERS:
                        total[word] += n
            if len(total) > HELD_WORDS:
                yield out()
                total.clear()
    yield out()


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n: words of enough letters that occur often enough, with the planted edits made."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = read.mapInArrow(_tally, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= LEAST_COUNT)


def one_edit(short: str, long: str) -> bool:
    """Whether exactly one letter is inserted into, or replaced in, the shorter (or equally long) word."""
    at = next((k for k, (a, b) in enumerate(zip(short, long)) if a != b), len(short))
    if len(short) == len(long):
        return short != long and short[at + 1 :] == long[at + 1 :]
    return short[at:] == long[at + 1 :]


FIRST, LAST = 0, 1


def halves(word: str, length: int) -> tuple[str, str]:
    """The letters that a word of ``length`` one edit away may have whole: those of its first half, and of its second."""
    return word[: length // 2], word[length // 2 - length :]


def _postings(batches: Iterator) -> Iterator:
    """A row for each list a word stands in (own) or visits."""
    import pyarrow as pa

    for batch in batches:
        rows = []
        for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
            for length in (len(word), len(word) + 1):
                rows += [(half, length, side, length == len(word), word, n) for side, half in enumerate(halves(word, length))]
        kinds = [("half", pa.string()), ("length", pa.int32()), ("side", pa.int32()), ("own", pa.bool_()), ("word", pa.string()), ("n", pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)], [name for name, _ in kinds])


class _List:
    """One list (or block of one): its words, indexed by the grams outside the half that all share, and by place."""

    def __init__(self, key: tuple):
        self.key, self.words, self.counts = key, [], []
        self.index: dict[tuple[str, int], list[int]] = {}
        _, length, self.side, _ = key
        self.border = length // 2
        # of the L - 3 grams that near words share, those inside the half are here already
        self.least = length - 2 - self.border if self.side == FIRST else self.border - 2

    def _grams(self, word: str) -> list[tuple[str, int]]:
        """The grams that are not inside the shared half."""
        length = self.key[1]
        places = range(self.border - 1, len(word) - 1) if self.side == FIRST else range(self.border - (length - len(word)))
        return [(word[k : k + 2], k) for k in places]

    def add(self, word: str, n: int) -> None:
        for g in self._grams(word):
            self.index.setdefault(g, []).append(len(self.words))
        self.words.append(word)
        self.counts.append(n)

    def _often(self, asked: str) -> Iterator[int]:
        """Places of words that share grams enough with the one that is asked for."""
        if self.least <= 0:
            yield from range(len(self.words))
            return
        found, index = self._grams(asked), self.index
        if len(asked) < self.key[1]:
            found += [(g, k + 1) for g, k in found]
        postings = [index[g] for g in found if g in index]
        if len(postings) < self.least:
            return
        last, seen = -1, 0
        for place in merge(*postings) if len(postings) > 1 else postings[0]:
            seen = seen + 1 if place == last else 1
            last = place
            if seen == self.least:
                yield place

    def near(self, asked: str) -> Iterator[int]:
        """Places of words one edit from the word that is asked for; a pair that shares both halves counts in the list of the first."""
        for place in self._often(asked):
            word = self.words[place]
            if one_edit(asked, word) and (self.side == FIRST or not word.startswith(asked[: self.border])):
                yield place


def _pairs(batches: Iterator) -> Iterator:
    """From postings sorted by list and block, own words first: pairs one edit apart."""
    import pyarrow as pa

    held = None
    for batch in batches:
        out = []
        for half, length, side, block, own, word, n, home in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            key = (half, length, side, block)
            if held is None or held.key != key:
                held = _List(key)
            # an own word is paired with those before it; one of another block would find each pair twice
            guest = home and not own
            out += [(word, n, held.words[k], held.counts[k]) for k in held.near(word) if not guest or word < held.words[k]]
            if own:
                held.add(word, n)
        kinds = [("a", pa.string()), ("a_n", pa.int64()), ("b", pa.string()), ("b_n", pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, (_, kind) in enumerate(kinds)], [name for name, _ in kinds])


def near_pairs(words: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """a, a_n, b, b_n: every pair of words (word, n) that is one edit apart, once."""
    postings = materialize(words.mapInArrow(_postings, "half string, length int, side int, own boolean, word string, n long"), "postings")
    key = ["half", "length", "side"]
    sizes = postings.where("own").groupBy(*key).count().where(F.col("count") > most_words)
    large = sizes.select(*key, F.ceil(F.col("count") / most_words).cast("int").alias("blocks"))
    dealt = postings.join(materialize(large, "large"), key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    home = F.when(F.col("own"), F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("home", home).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # an own word stands in its home block and visits the others
    dealt = dealt.select(*key, "block", (F.col("own") & (F.col("home") == F.col("block"))).alias("own"), "word", "n", F.col("home").isNotNull().alias("home"))
    order = [*key, "block", F.col("own").desc(), "word"]
    return dealt.repartition(*key, "block").sortWithinPartitions(*order).mapInArrow(_pairs, "a string, a_n long, b string, b_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word and root of words that have a form (word, form). n doubles from word to form, so chains are short; each round doubles the reach."""
    reach = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = reach.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        longer = materialize(reach.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        discard(reach)
        reach = longer.select("word", "root")
        if longer.where("moved").limit(1).count() == 0:
            return reach


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word."""
    words = materialize(word_counts(docs), "words")
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))).alias("p")).select("p.*")
    # strings compare by their UTF-8 bytes, which is the order of code points
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    judged = words.join(near, "word", "left").withColumn("takes", F.coalesce(-F.col("best.minus") >= 2 * F.col("n"), F.lit(False)))
    judged = materialize(
        judged.select(
            "word",
            F.when(F.col("takes"), F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(F.col("takes"), -F.col("best.minus")).alias("form_n"),
        ),
        "judged",
    )
    found = roots(judged.where("form IS NOT NULL"))
    return judged.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


#: CRC-32 by its table, over the UTF-8 bytes of letters up to U+00FF; near words meet under the word without one letter.
OP13_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i, i AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS crc_table FROM bits WHERE k = 8),
r AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents
), u AS (SELECT d, run, count(*) AS k FROM r GROUP BY ALL),
b AS (
  SELECT d, run, k, flatten(list_transform(string_split(d || ':' || run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [192 | (ord(x) >> 6), 128 | (ord(x) & 63)] END)) AS bytes FROM u
), h AS (
  SELECT run, k, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda a, x: xor(a >> 8, crc_table[(xor(a, x) & 255) + 1])), 4294967295) AS h FROM b, crc
), e AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM h
), words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM e WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
), gaps AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)
), pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT w.word, g.word, g.n FROM words w JOIN gaps g ON g.rest = w.word
  UNION SELECT g.word, w.word, w.n FROM words w JOIN gaps g ON g.rest = w.word
), best AS (
  SELECT word, count(*) AS n_near, min_by(near, (-near_n, encode(near))) AS near, max(near_n) AS near_n FROM pairs GROUP BY word
), judged AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 2 * w.n THEN b.near END AS form, CASE WHEN b.near_n >= 2 * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
), chain AS (
  SELECT word, coalesce(form, word) AS root, 1 AS hops FROM judged
  UNION ALL SELECT c.word, j.form, hops + 1 FROM chain c JOIN judged j ON c.root = j.word WHERE j.form IS NOT NULL
)
SELECT j.word, j.form, (SELECT max_by(root, hops) FROM chain c WHERE c.word = j.word) AS root, j.n, j.n_near, j.form_n FROM judged j
"""

QUERIES = {"op13_spelling_variants": op13_spelling_variants}
ORACLES = {"op13_spelling_variants": OP13_SQL}
