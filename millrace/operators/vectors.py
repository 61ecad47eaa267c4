"""Merging of vectors by cosine: hyperplane codes bring likely ones together, products of matrices compare them, components group them."""

from __future__ import annotations

import math
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.components import connected_components
from millrace.workspace import materialize

#: Cosine from which vectors are one.
SAME = 0.92
RECALL = 0.995
SEED = 20240901
#: Vectors that share a code on the mean, beyond which codes grow; vectors of a code that one task compares with as many others; least bits of a code.
SHARING, BLOCK, BITS = 4096, 8192, 8


def plan_tables(rows: int, cosine: float = SAME, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a code and tables of codes. Comparing costs little beside dealing, so codes are short, and alike at all sizes up to a million rows;
    then they grow with the logarithm of the rows. Tables are as many as let a pair at the threshold meet with the recall."""
    bits = max(BITS, min(40, math.ceil(math.log2(max(rows, 1) / SHARING))))
    agree = 1 - math.acos(cosine) / math.pi
    return bits, math.ceil(math.log(1 - recall) / math.log1p(-(agree**bits)))


def _codes(batches, key: str, bits: int, tables: int):
    import pyarrow as pa

    planes: dict[int, np.ndarray] = {}
    weights = (1 << np.arange(bits, dtype=np.int64)).astype(np.int64)
    for batch in batches:
        keys, vectors = batch.column(0), batch.column(1).to_pylist()
        at: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            at.setdefault(len(v), []).append(i)
        codes = np.zeros((len(vectors), tables), np.int64)
        for size, places in at.items():
            if size not in planes:
                planes[size] = np.random.default_rng(SEED).standard_normal((size, tables * bits)).astype(np.float32)
            for start in range(0, len(places), 1024):
                some = places[start : start + 1024]
                side = np.array([vectors[i] for i in some], np.float32) @ planes[size] > 0
                codes[some] = side.reshape(len(some), tables, bits) @ weights
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, tables, dtype=np.int32)), pa.array(codes.reshape(-1)))
        yield pa.RecordBatch.from_arrays([keys, batch.column(1), lists], [key, batch.schema.names[1], "codes"])


def vector_classes(rows: DataFrame, key: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """(key, rep) of every row with a vector that has a length, and (rep, vector) of the first row of each vector, scaled to length 1.

    A null vector, one without numbers or with a null among them, and a zero one are in no class.
    """
    double = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(double, F.lit(0.0), lambda a, x: a + x * x))
    usable = rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x)))
    scaled = usable.withColumn("norm", norm).where("norm > 0").select(key, F.transform(double, lambda x: x / F.col("norm")).alias("unit"))
    sealed = scaled.withColumn("seal", F.sha2(F.to_json(F.struct("unit")), 256))
    firsts = sealed.groupBy("seal").agg(F.min(key).alias("rep"), F.min_by("unit", key).alias("unit"))
    return sealed.join(firsts.select("seal", "rep"), "seal").select(key, "rep"), firsts.select("rep", "unit")


def _united(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (the least member of each set) after the sets of every i and j are joined."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j = i[apart], j[apart]
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (label != (nearer := label[label])).any():
            label = nearer


def _product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, added in the order of places."""
    out = np.zeros(len(x))
    for k in range(x.shape[1]):
        out += x[:, k] * y[:, k]
    return out


def _alike(table, cosine: float):
    """(vectors, i, j) by stretches: places of pairs as alike as that of which no earlier code is shared. Two blocks of a code meet across, one meets itself."""
    n, at = table.num_rows, table["at"][0].as_py()
    rows = lambda c: np.asarray(table[c].combine_chunks().flatten()).reshape(n, -1)
    x, codes, block = rows("unit"), rows("codes"), np.asarray(table["block"])
    first, second = table["first"][0].as_py(), table["second"][0].as_py()
    left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
    other = x[right].T
    for start in range(0, len(left), 512):
        some = left[start : start + 512]
        likely = x[some] @ other >= cosine - 1e-9
        if first == second:
            likely &= right[None, :] > some[:, None]
        i, j = np.nonzero(likely)
        i, j = some[i], right[j]
        for k in range(at):
            new = codes[i, k] != codes[j, k]
            i, j = i[new], j[new]
        if len(i):
            sure = _product(x[i], x[j]) >= cosine
            yield x, i[sure], j[sure]


def _pairs(table, cosine: float):
    import pyarrow as pa

    none = np.zeros(0, np.int64)
    found = [(i, j, _product(x[i], x[j])) for x, i, j in _alike(table, cosine)] or [(none, none, np.zeros(0))]
    i, j, product = (np.concatenate(c) for c in zip(*found))
    return pa.table({"u": table["rep"].take(pa.array(i)), "v": table["rep"].take(pa.array(j)), "cosine": product})


def _hooks(table, cosine: float):
    """Each vector with a link, a vector that links connect it with here, and the number of its links."""
    import pyarrow as pa

    label, links = np.arange(table.num_rows), np.zeros(table.num_rows, np.int64)
    for _, i, j in _alike(table, cosine):
        links += np.bincount(i, minlength=len(links)) + np.bincount(j, minlength=len(links))
        label = _united(label, i, j)
    at = np.flatnonzero(links)
    return pa.table({"u": table["rep"].take(pa.array(at)), "v": table["rep"].take(pa.array(label[at])), "links": links[at]})


def _meetings(reps: DataFrame, cosine: float, recall: float):
    """Vectors grouped by the codes they share, with their other codes: a pair counts where it first meets, so none is sent on twice.

    A code of more than ``BLOCK`` vectors is cut into blocks, and each two of them are a group.
    """
    bits, tables = plan_tables(reps.count(), cosine, recall)
    kind = reps.schema["rep"].dataType.simpleString()
    coded = reps.select("rep", "unit").mapInArrow(partial(_codes, key="rep", bits=bits, tables=tables), f"rep {kind}, unit array<double>, codes array<bigint>")
    coded = materialize(coded, "codes")
    code = ["dims", "at", "code"]
    shared = coded.select(F.size("unit").alias("dims"), F.posexplode("codes").alias("at", "code")).groupBy(*code).agg(F.count("*").alias("n")).where("n > 1")
    # written, so that its size is known beforehand and the vectors are dealt once only
    shared = materialize(shared.select(*code, F.ceil(F.col("n") / BLOCK).alias("blocks")), "shared")
    placed = coded.select("rep", "unit", "codes", F.size("unit").alias("dims"), F.posexplode("codes").alias("at", "code")).join(shared, code)
    placed = placed.withColumn("block", F.pmod(F.xxhash64("rep"), "blocks"))
    dealt = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("with"))
    dealt = dealt.withColumns({"first": F.least("block", "with"), "second": F.greatest("block", "with")})
    return dealt.select("rep", "unit", "codes", "block", *code, "first", "second").groupBy(*code, "first", "second"), kind


def vector_links(reps: DataFrame, cosine: float = SAME, recall: float = RECALL) -> DataFrame:
    """(u, v, cosine) of pairs that share a code and whose cosine is as high; vectors of different lengths are never alike."""
    groups, kind = _meetings(reps, cosine, recall)
    found = groups.applyInArrow(lambda table: _pairs(table, cosine), f"u {kind}, v {kind}, cosine double")
    return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "cosine")


def merged_vectors(rows: DataFrame, key: str, vector: str, cosine: float = SAME) -> DataFrame:
    """(key, unit, links): the least key of the vectors that links connect, and how many other vectors link to the row's own; a row without a usable vector stands alone with none."""
    members, reps = vector_classes(rows, key, vector)
    groups, kind = _meetings(materialize(reps, "reps"), cosine, RECALL)
    # links are counted and connected where they are found: pairs of a large group are not written
    hooks = materialize(groups.applyInArrow(lambda table: _hooks(table, cosine), f"u {kind}, v {kind}, links long"), "hooks")
    found = connected_components(hooks.select("u", "v"))
    ends = hooks.groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    placed = members.join(found, F.col("rep") == F.col("node"), "left").join(ends, "rep", "left")
    placed = placed.select(key, F.coalesce("component", "rep").alias("unit"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    return rows.select(key).join(placed, key, "left").select(key, F.coalesce("unit", key).alias("unit"), F.coalesce("links", F.lit(0)).alias("links"))
