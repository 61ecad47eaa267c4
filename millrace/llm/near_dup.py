"""MinHash near-duplicates with tensored banding.

Two collections of ``M`` half keys, each of two minhashes, give ``M * M`` table keys by combination: 4 * M
minhashes do the work of 4 * M * M. Documents with equal shingle sets form one class, and its least
doc_id stands for it. Each bucket of a table links its members to one leader; all links whose minhashes make the
similarity likely (0.45 and more, so that documents that are similar to each other stay together beside a leader that is less so) join the documents into clusters. Within a cluster all pairs of full shingle sets are
compared exactly: a cluster over ``BLOCK`` documents is cut into blocks that share some members, and
what the blocks leave apart is then compared block by block with the whole cluster. Links have
100 * intersection >= 75 * union; components of links are found by distributed stars.

Two documents at the threshold share a bucket with probability (1 - (1 - 0.75^2)^M)^2, 0.9995 for
M = 10. Sets are sets of 64-bit shingle hashes. No pairs are emitted within a bucket or cluster, and no bucket is ever held by a task.

Defined results: without words (or text) n_shingles is 0 and the document is its own component; under
five words the whole sequence is one shingle; repeated rows are returned each; rows without a doc_id are
linked with nothing, get a null component and are kept; an empty table gives no rows; other
columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import LOWER, UPPER, materialize, settings, table
from millrace.llm.components import connected_components

SHINGLE = 5
M = 10
MINHASHES = 4 * M
#: Least equal minhashes of a bucket link that joins clusters: 0.45, over four deviations below 0.75.
LIKELY = 18
BLOCK = 48
SHARED_MEMBERS = 16
KNOWN_WORDS = 60_000
#: Odd, so that multiplying is a bijection of 64-bit ids; its order picks leaders.
ORDER = 0x9E3779B97F4A7C15
LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word):
        import xxhash

        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, text: str) -> np.ndarray:
        if len(self) > KNOWN_WORDS:
            self.clear()
        found = text.encode().translate(LOWERED).split()  # splits at the same six characters
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads all 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    """The sorted distinct shingle hashes of a word-hash sequence."""
    if not len(hashes):
        return hashes
    width = min(SHINGLE, len(hashes))
    rolled = np.full(len(hashes) - width + 1, width, np.uint64)
    for k in range(width):
        rolled = rolled * np.uint64(0x9FB21C651E98DF25) + hashes[k : len(hashes) - width + 1 + k]
    return np.unique(mixed(rolled))


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(1, 2 * MINHASHES + 1, dtype=np.uint64) * np.uint64(ORDER))
    return seeds[:MINHASHES] | np.uint64(1), seeds[MINHASHES:]


def minhashes(shingles: np.ndarray) -> np.ndarray:
    factor, shift = _coefficients()
    least = np.full(MINHASHES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(shingles), 4096):
        part = factor[:, None] * shingles[None, at : at + 4096] + shift[:, None]
        least = np.minimum(least, part.min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32)


def table_keys(signatures: np.ndarray) -> np.ndarray:
    """All M * M keys of each signature (rows)."""
    halves = signatures.astype(np.uint64).reshape(len(signatures), 2, M, 2)
    codes = mixed((halves[..., 0] << np.uint64(32)) | halves[..., 1])
    tables = mixed(np.arange(1, M * M + 1, dtype=np.uint64) * np.uint64(ORDER)).reshape(M, M)
    return mixed(codes[:, 0, :, None] + np.uint64(3) * codes[:, 1, None, :] + tables).reshape(len(signatures), M * M)


def _sign(batches):
    import pyarrow as pa
    import xxhash

    known = WordHashes()
    for batch in batches:
        sizes, keys, signs = [], [], []
        for text in batch.column("text").to_pylist():
            found = shingle_set(known.of(text or ""))
            sizes.append(len(found))
            keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
            signs.append(minhashes(found).view(np.int32) if len(found) else None)
        columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_key", "signature"])


def _keyed(batches):
    import pandas as pd

    for pdf in batches:
        for at in range(0, len(pdf), 2000):
            part = pdf.iloc[at : at + 2000]
            keys = table_keys(np.stack(part["signature"].to_numpy()).view(np.uint32))
            order = part["rep"].to_numpy().astype(np.uint64) * np.uint64(ORDER)
            yield pd.DataFrame({"key": keys.reshape(-1).view(np.int64), "turn": np.repeat(order, M * M).view(np.int64)})


def _bucket_links(batches):
    """From rows sorted by key and turn: each member of a bucket with the bucket's first."""
    import pandas as pd

    back = np.uint64(pow(ORDER, -1, 1 << 64))
    last_key = last_turn = None
    for pdf in batches:
        key, turn = pdf["key"].to_numpy(), pdf["turn"].to_numpy()
        if not len(key):
            continue
        first = np.concatenate([[last_key is None or key[0] != last_key], key[1:] != key[:-1]])
        at = np.maximum.accumulate(np.where(first, np.arange(len(key)), -1))
        leader = np.where(at >= 0, turn[np.maximum(at, 0)], last_turn if last_turn is not None else 0)
        member = ~first & (leader != turn)
        last_key, last_turn = key[-1], leader[-1]
        as_ids = lambda x: (x.view(np.uint64) * back).view(np.int64)
        yield pd.DataFrame({"member": as_ids(turn[member]), "leader": as_ids(leader[member])})


def _with_sets(batches):
    import pandas as pd

    known = WordHashes()
    for pdf in batches:
        sets = [shingle_set(known.of(text or "")).tobytes() for text in pdf["text"]]
        yield pd.DataFrame({"cluster": pdf["cluster"], "node": pdf["node"], "shingles": sets})


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Exact sizes of all pairwise intersections."""
    count = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, count)
    if count == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[sizes[0], both], [both, sizes[1]]])
    flat, row = np.concatenate(sets), np.repeat(np.arange(count), sizes)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    start = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(start) - 1
    shared = np.bincount(column)[column] > 1
    row, column = row[shared], column[shared]
    out = np.zeros((count, count), np.float64)
    if len(column):
        column = np.unique(column, return_inverse=True)[1]
        for low in range(0, column[-1] + 1, 8192):
            a, b = np.searchsorted(column, (low, low + 8192))
            part = np.zeros((count, 8192), np.float32)
            part[row[a:b], column[a:b] - low] = 1
            out += part @ part.T
    out = out.astype(np.int64)
    np.fill_diagonal(out, sizes)
    return out


def linked(sets: list[np.ndarray]) -> np.ndarray:
    both = intersections(sets)
    size = np.diag(both)
    return 100 * both >= 75 * (size[:, None] + size[None, :] - both)


def _runs(batches, keys):
    """Groups of a sorted stream, as lists of row tuples."""
    group, rows = None, []
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            own = tuple(getattr(row, k) for k in keys)
            if own != group:
                if rows:
                    yield rows
                group, rows = own, []
            rows.append(row)
    if rows:
        yield rows


def _links_inside(batches):
    """Spanning links of the blocks of a stream sorted by cluster and block."""
    import pandas as pd

    out = []
    for rows in _runs(batches, ("cluster", "block")):
        if len(rows) < 2:
            continue
        nodes = [r.node for r in rows]
        near = linked([np.frombuffer(r.shingles, np.uint64) for r in rows])
        left = set(range(len(rows)))
        while left:
            todo = [left.pop()]
            while todo:
                at = todo.pop()
                for other in [x for x in left if near[at, x]]:
                    left.discard(other)
                    todo.append(other)
                    out.append((nodes[at], nodes[other]))
        if len(out) > 20_000:
            yield pd.DataFrame(out, columns=["u", "v"])
            out = []
    yield pd.DataFrame(out, columns=["u", "v"]).astype("int64")


def _links_across(batches):
    """For each row left apart, one link to each component that it is similar to."""
    import pandas as pd

    for rows in _runs(batches, ("cluster", "apart_block", "block")):
        apart, rest = [r for r in rows if r.apart], [r for r in rows if not r.apart]
        if not apart or not rest:
            continue
        near = linked([np.frombuffer(r.shingles, np.uint64) for r in (*apart, *rest)])[: len(apart), len(apart) :]
        out = {(apart[i].node, rest[j].component): rest[j].node for i, j in zip(*np.nonzero(near)) if apart[i].component != rest[j].component}
        if out:
            yield pd.DataFrame([(u, v) for (u, _), v in out.items()], columns=["u", "v"])


def _cluster_links(sets: DataFrame) -> DataFrame:
    """All links needed to connect what is similar within each cluster."""
    sizes = sets.groupBy("cluster").agg(F.count("*").alias("size"))
    rows = sets.join(sizes, "cluster").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    home = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = materialize(rows.withColumn("block", home), "sets")
    shared = rows.where((F.col("blocks") > 1) & (F.pmod(F.xxhash64("node", F.lit(1)), F.col("size")) < SHARED_MEMBERS))
    guests = shared.withColumn("guest", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("guest <> block")
    inside = rows.select("cluster", "block", "node", "shingles").unionByName(guests.select("cluster", F.col("guest").alias("block"), "node", "shingles"))
    links = inside.repartition("cluster", "block").sortWithinPartitions("cluster", "block").mapInPandas(_links_inside, "u long, v long")
    links = materialize(links, "links")
    large = rows.where("blocks > 1")
    if large.limit(1).count() == 0:
        return links
    found = connected_components(links)
    placed = large.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = materialize(placed, "placed")
    parts = placed.groupBy("cluster", "component").agg(F.count("*").alias("n"))
    main = parts.groupBy("cluster").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    main = main.where(F.col("all") > F.col("most")).withColumn("apart_blocks", F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int"))
    open_ = placed.join(main.select("cluster", "main", "apart_blocks"), "cluster")
    keep = ["cluster", "node", "component", "shingles"]
    apart = open_.where("component <> main").select(
        *keep, F.pmod(F.xxhash64("node", F.lit(2)), F.col("apart_blocks")).cast("int").alias("apart_block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("apart")
    )
    rest = open_.select(*keep, F.explode(F.sequence(F.lit(0), F.col("apart_blocks") - 1)).alias("apart_block"), "block", F.lit(False).alias("apart"))
    pairs = apart.unionByName(rest)
    key = ["cluster", "apart_block", "block"]
    more = pairs.repartition(*key).sortWithinPartitions(*key).mapInPandas(_links_across, "u long, v long")
    return links.unionByName(materialize(more, "links"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    signed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sign, "doc_id long, n_shingles long, set_key binary, signature array<int>")
    signed = materialize(signed, "signed")
    known = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialize(known.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "classes")
    reps = known.join(classes, "set_key").where("doc_id = rep").select("rep", "signature")
    keys = reps.mapInPandas(_keyed, "key long, turn long")
    links = keys.repartition("key").sortWithinPartitions("key", "turn").mapInPandas(_bucket_links, "member long, leader long")
    chosen = links.distinct()
    signs = known.select("doc_id", "signature")
    pairs = chosen.join(signs.select(F.col("doc_id").alias("member"), F.col("signature").alias("ours")), "member")
    pairs = pairs.join(signs.select(F.col("doc_id").alias("leader"), F.col("signature").alias("theirs")), "leader")
    equal = F.size(F.filter(F.zip_with("ours", "theirs", lambda a, b: a == b), lambda x: x))
    clusters = connected_components(pairs.where(equal >= LIKELY).select(F.col("member").alias("u"), F.col("leader").alias("v")))
    clusters = clusters.unionByName(clusters.select(F.col("component").alias("node"), "component").distinct()).withColumnRenamed("component", "cluster")
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    # the same plan at every size: a Bloom filter of the clusters' ids thins the texts out before they are shuffled
    clusters = materialize(clusters, "clusters").where("cluster <= node").hint("merge")
    sets = texts.join(clusters, "node").select("cluster", "node", "text").mapInPandas(_with_sets, "cluster long, node long, shingles binary")
    with settings(docs.sparkSession, spark__sql__optimizer__runtime__bloomFilter__enabled="true", spark__sql__optimizer__runtime__bloomFilter__applicationSideScanSizeThreshold="0"):
        sets = materialize(sets, "sets")
    found = connected_components(_cluster_links(sets))
    placed = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    linked_rows = known.join(placed, "set_key").select("doc_id", "n_shingles", "component_id")
    alone = signed.where("NOT (n_shingles > 0 AND doc_id IS NOT NULL)").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked_rows.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op5_near_dup": op5_near_dup}
ORACLES: dict[str, str] = {}
