"""Operators on keyed tables: upserts, first-wins sets, ranked picks, guarded deletes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Keys = Sequence[str]


def first_by(df: DataFrame, keys: Keys, order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in the given order."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def insert_or_ignore(target: DataFrame, new: DataFrame, keys: Keys, order: Sequence[Column]) -> DataFrame:
    """The rows of ``new`` that a unique key lets in: no target row has their key, and of equals the first comes in."""
    return first_by(new.join(target.select(*keys).distinct(), list(keys), "left_anti"), keys, order)


def upsert(target: DataFrame, new: DataFrame, keys: Keys) -> DataFrame:
    """Target with new rows in place of those of their keys, and the new rows without a match. What a batch holds twice stands twice, however often it is written."""
    return target.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new.select(*target.columns))


def add_counters(target: DataFrame, new: DataFrame, keys: Keys, counters: Sequence[str]) -> DataFrame:
    """Upsert that adds counters up."""
    both = target.select(*keys, *counters).unionByName(new.select(*keys, *counters))
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters])


def union_first_wins(parts: Sequence[DataFrame], keys: Keys, order: Sequence[Column]) -> DataFrame:
    """Union of lists by falling priority; of rows with one key the first stays. Adds ``priority``."""
    tagged = [df.withColumn("priority", F.lit(n)) for n, df in enumerate(parts)]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df)
    return first_by(out, keys, [F.col("priority").asc(), *order])


def round_robin(df: DataFrame, group: str, order: Sequence[Column], group_order: Column, limit: int) -> DataFrame:
    """Rank i of every group before rank i + 1 of any, up to a limit. Adds ``turn``."""
    turned = df.withColumn("turn", F.row_number().over(W.partitionBy(group).orderBy(*order)))
    return turned.orderBy("turn", group_order, *order).limit(limit)


def all_holders(df: DataFrame, keys: Keys, predicate: Column) -> DataFrame:
    """Keys of which every holder meets the predicate."""
    return df.groupBy(*keys).agg(F.bool_and(predicate).alias("__all")).where("__all").drop("__all")


def modular_batch(df: DataFrame, order: Sequence[Column], cursor: int, limit: int) -> DataFrame:
    """``limit`` rows of a fixed list from a cursor on, going round. For lists of a bounded length."""
    w = W.orderBy(*order)
    at = df.withColumns({"__at": F.row_number().over(w) - 1, "__n": F.count("*").over(W.partitionBy())})
    return at.withColumn("turn", F.pmod(F.col("__at") - cursor, F.col("__n"))).where(F.col("turn") < limit).drop("__at", "__n")


def cursor_walk(nodes: DataFrame, child: str, parent: str, hops: int) -> DataFrame:
    """(child, ancestor, depth) along parent links, up to a number of hops."""
    links = nodes.select(F.col(child).alias("node"), F.col(parent).alias("up"))
    out = step = links.where("up IS NOT NULL").select("node", F.col("up").alias("ancestor"), F.lit(1).alias("depth"))
    for depth in range(2, hops + 1):
        step = step.join(links.select(F.col("node").alias("ancestor"), F.col("up")), "ancestor").where("up IS NOT NULL").select("node", F.col("up").alias("ancestor"), F.lit(depth).alias("depth"))
        out = out.unionByName(step)
    return out


def dealt(df: DataFrame, columns: Sequence[str | Column], array: Column, place: str, value: str) -> DataFrame:
    """The columns with each element of an array and its place. A plain explode has the optimiser test the array beforehand, which computes it twice."""
    return df.select(*columns, F.posexplode_outer(array).alias(place, value)).where(F.col(place).isNotNull())
