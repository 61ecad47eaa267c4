"""Order-dependent folds: greedy matches, parsed dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def greedy_keep(values: Column, near) -> Column:
    """The values of a list that are near none kept before."""
    return F.aggregate(values, F.array().cast("array<string>"), lambda kept, v: F.when(F.exists(kept, lambda k: near(k, v)), kept).otherwise(F.array_append(kept, v)))


def match_greedily(pairs: DataFrame, group: str, left: str, right: str, score: str, order: str) -> DataFrame:
    """One to one within a group: each left in order takes its best right not yet taken. A group is a bounded list."""

    def step(pdf):
        taken, out = set(), []
        for _, own in pdf.sort_values([order, left]).groupby(left, sort=False):
            for row in own.sort_values([score, right], ascending=[False, True]).itertuples(index=False):
                if getattr(row, right) not in taken:
                    taken.add(getattr(row, right))
                    out.append(row)
                    break
        import pandas as pd

        return pd.DataFrame(out, columns=pdf.columns)[[group, left, right, score]]

    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in (group, left, right, score))
    return pairs.groupBy(group).applyInPandas(step, kinds)


def local_date(text: Column) -> Column:
    """dd/mm/yyyy as a date; null for what is none."""
    part = lambda k: F.regexp_extract(text, r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b", k).try_cast("int")
    return F.try_to_date(F.concat_ws("-", F.lpad(part(3).cast("string"), 4, "0"), F.lpad(part(2).cast("string"), 2, "0"), F.lpad(part(1).cast("string"), 2, "0")), "yyyy-MM-dd")
