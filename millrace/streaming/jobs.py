"""Structured Streaming jobs, run over all input that is there and returned as tables.

State lives in the checkpoint of the stream; every micro-batch replaces or appends to a table in the shared folder,
so a restarted job goes on where it stopped.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.workspace import shared_dir


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    rows = spark.read.parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 8)
    if rows.inputFiles()[0].endswith("/events.parquet"):  # one file: a stream reads folders
        stream = stream.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    else:
        stream = stream.parquet(path)
    return stream.withColumn("at", F.col("ts").cast("timestamp"))


def run_available(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a streaming plan over what is there; complete mode keeps the last table, append mode adds up."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/millrace/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    return out.drop("batch") if mode != "complete" else out


def hourly_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Tumbling hours by event time, with a watermark for late rows."""
    counted = events.withWatermark("at", late).groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


def sliding_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    counted = events.withWatermark("at", late).groupBy(F.window("at", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def watchdog(events: DataFrame, threshold: int = 3) -> DataFrame:
    """Alerts for each user from state kept across micro-batches: (user_id, event_id, alert, failures)."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, batches, state):
        import pandas as pd

        healthy, failures = state.get if state.exists else (True, 0)
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        out = []
        for event_id, kind in zip(rows["event_id"], rows["event_type"]):
            ok = kind != "error"
            failures = 0 if ok else failures + 1
            if ok != healthy:
                out.append((event_id, "recovered" if ok else "failing", failures))
            elif not ok and failures > threshold and failures % threshold == 0:
                out.append((event_id, "still unhealthy", failures))
            healthy = ok
        state.update((bool(healthy), int(failures)))
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["user_id", "event_id", "alert", "failures"])

    rows = events.select("user_id", "event_id", "event_type", "at")
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, alert string, failures long", "healthy boolean, failures long", "append", GroupStateTimeout.NoTimeout)


def distance_within(a: str, b: str, most: int) -> bool:
    """Whether two texts are at most ``most`` edits apart; only cells near the diagonal are computed."""
    if abs(len(a) - len(b)) > most:
        return False
    beyond = most + 1
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        low, high = max(1, i - most), min(len(b), i + most)
        row = [beyond] * (len(b) + 1)
        row[0] = i if i <= most else beyond
        least = row[0]
        for j in range(low, high + 1):
            row[j] = min(last[j - 1] + (x != b[j - 1]), last[j] + 1, row[j - 1] + 1)
            least = min(least, row[j])
        if least > most:
            return False
        last = row
    return last[-1] <= most


def words_alike(ours: list[str], theirs: list[str], least: int) -> bool:
    """Whether the token-set ratio of two sorted word sets (rounded per cent) is at least ``least``: the best Levenshtein ratio among shared words and either side's whole set."""
    if not ours or not theirs:
        return not ours and not theirs
    other = set(theirs)
    shared = [w for w in ours if w in other]
    own = set(shared)
    texts = [" ".join(shared), " ".join(shared + [w for w in ours if w not in own]), " ".join(shared + [w for w in theirs if w not in own])]

    def alike(p: str, q: str) -> bool:
        longest = max(len(p), len(q))
        if p == q:
            return True
        if not p or not q:
            return False
        # floor(100 * (longest - d) / longest + 0.5) >= least
        most = int(longest * (100.5 - least) / 100)
        while most >= 0 and int((longest - most) / longest * 100 + 0.5) < least:
            most -= 1
        return most >= 0 and distance_within(p, q, most)

    return alike(texts[0], texts[1]) or alike(texts[0], texts[2]) or alike(texts[1], texts[2])


class Published:
    """Published stems, as sorted word sets, in the order of their publishing; ``first_alike`` screens all of them at once."""

    BUCKETS = 64

    def __init__(self, least: int):
        self.least, self.items, self.words = least, [], []
        self._sizes, self._bags = np.zeros(16, np.int64), np.zeros((16, self.BUCKETS), np.int32)
        self._holders: dict[str, list[int]] = {}
        self._judged: dict[str, int | None] = {}

    def _bag(self, text: str) -> np.ndarray:
        return np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) % self.BUCKETS, minlength=self.BUCKETS)

    def add(self, item: int, words: list[str]) -> None:
        at, text = len(self.items), " ".join(words)
        if at == len(self._sizes):
            self._sizes = np.concatenate([self._sizes, np.zeros_like(self._sizes)])
            self._bags = np.concatenate([self._bags, np.zeros_like(self._bags)])
        self.items.append(item)
        self.words.append(words)
        self._sizes[at], self._bags[at] = len(text), self._bag(text)
        for w in words:
            self._holders.setdefault(w, []).append(at)
        self._judged.setdefault(text, item)

    def first_alike(self, words: list[str]) -> int | None:
        """The first item that is alike, or None. Equal words have equal answers: what is published later never comes before it."""
        text = " ".join(words)
        if text not in self._judged:
            found = self._search(words, text)
            if found is None:
                return None
            self._judged[text] = found
        return self._judged[text]

    def _search(self, words: list[str], text: str) -> int | None:
        n, mine = len(self.items), len(text)
        sizes = self._sizes[:n]
        if not mine or not n:
            empty = np.flatnonzero(sizes == 0)
            return self.items[empty[0]] if not mine and len(empty) else None
        shared = np.zeros(n, np.int64)
        for w in words:
            if w in self._holders:
                shared[self._holders[w]] += len(w) + 1
        shared = np.maximum(shared - 1, 0)
        rounded = lambda part, whole: (part / np.maximum(whole, 1) * 100 + 0.5).astype(np.int64)
        # the shared words begin either side's text, so they are as many edits away from it as it is longer
        sure = (shared > 0) & ((rounded(shared, mine) >= self.least) | (rounded(shared, sizes) >= self.least))
        # sides are at least as many edits apart as letters that the one has more of than the other
        more = self._bags[:n] - self._bag(text)
        apart = np.maximum(np.maximum(more, 0).sum(axis=1), np.maximum(-more, 0).sum(axis=1))
        longest = np.maximum(sizes, mine)
        may = (sizes > 0) & (rounded(longest - apart, longest) >= self.least)
        for at in np.flatnonzero(sure | may):
            if sure[at] or words_alike(words, self.words[at], self.least):
                return self.items[at]
        return None


def pass_decisions(items: DataFrame, least: int = 85) -> DataFrame:
    """(leaf, item, duplicate_of) of items (leaf, place, item, stem), in the order of place: an item whose stem is like one that
    its leaf has published before, in this micro-batch or any earlier one, is a duplicate of the first such; the others are published and join what later items are compared with.

    State is the published stems of a leaf. Items must not come in a later micro-batch than ones of a later place.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, batches, state):
        import re

        import pandas as pd

        published = Published(least)
        for i, w in zip(*state.get) if state.exists else ():
            published.add(i, w.split(" ") if w else [])
        rows = pd.concat(list(batches)).sort_values(["place", "item"])
        out = []
        for item, stem in zip(rows["item"], rows["stem"]):
            words = sorted(set(re.sub(r"[^\w\s]|_", " ", (stem or "").lower()).split()))
            near = published.first_alike(words)
            if near is None:
                published.add(int(item), words)
            out.append((key[0], item, near))
        state.update((published.items, [" ".join(w) for w in published.words]))
        yield pd.DataFrame(out, columns=["leaf", "item", "duplicate_of"]).astype({"duplicate_of": "Int64"})

    rows = items.select("leaf", "place", "item", "stem")
    return rows.groupBy("leaf").applyInPandasWithState(step, "leaf string, item long, duplicate_of long", "items array<bigint>, stems array<string>", "append", GroupStateTimeout.NoTimeout)


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder as a stream."""
    path = f"{sf_dir}/{name}.parquet"
    rows = spark.read.parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 8)
    if rows.inputFiles()[0].endswith(f"/{name}.parquet"):
        return stream.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return stream.parquet(path)


# Seconds that a circuit stays open after a hard failure, and at first and at most after a passing one.
HARD_SECONDS, FIRST_SECONDS, MOST_SECONDS = 6 * 3600.0, 30.0, 3600.0
HARD, UNCOUNTED = ("authentication", "billing"), ("budget", "policy", "invalid_response")


def circuit_step(state: tuple[str, float, int], now: float, failure: str | None) -> tuple[bool, tuple[str, float, int]]:
    """Whether a call at ``now`` (seconds) is let through, and the circuit's state after it: (state, open until, attempt). ``failure`` is the class of its error, None if it succeeds.

    An open circuit lets nothing through; when its time is over one call probes it (half open). A success closes it; a failure opens it for six hours
    if hard, else for 30 s doubled with every attempt up to an hour; failures that say nothing about the provider change nothing.
    """
    name, until, attempt = state
    if name != "healthy" and until > now:
        return False, state
    if name == "open":
        state = name, until, attempt = "half_open", 0.0, attempt
    if failure is None:
        return True, ("healthy", 0.0, 0)
    if failure in UNCOUNTED:
        return True, state
    attempt = 0 if name == "healthy" else attempt + 1
    wait = HARD_SECONDS if failure in HARD else min(FIRST_SECONDS * 2.0**attempt, MOST_SECONDS)
    return True, ("open", now + wait, attempt)


def circuits(calls: DataFrame) -> DataFrame:
    """(capability, call, admitted, state, open_until, attempt) of calls (capability, call, at in seconds, failure), in order; the circuit of each capability is kept across micro-batches."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, batches, state):
        import pandas as pd

        now = state.get if state.exists else ("healthy", 0.0, 0)
        rows = pd.concat(list(batches)).sort_values(["at", "call"])
        out = []
        for call, at, failure in zip(rows["call"], rows["at"], rows["failure"]):
            ok, now = circuit_step(now, at, failure if isinstance(failure, str) else None)
            out.append((key[0], call, ok, *now))
        state.update(now)
        yield pd.DataFrame(out, columns=["capability", "call", "admitted", "state", "open_until", "attempt"])

    rows = calls.select("capability", "call", "at", "failure")
    out = "capability long, call long, admitted boolean, state string, open_until double, attempt int"
    return rows.groupBy("capability").applyInPandasWithState(step, out, "state string, open_until double, attempt int", "append", GroupStateTimeout.NoTimeout)
