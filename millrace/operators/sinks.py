"""Tables that are written to and read back: insert or ignore, upsert, counters, replaced children.

A table is a folder of versions in shared storage; each write makes the next version whole and only then becomes what readers see, so a write that
fails, or is done again, leaves no half of itself behind. Counters remember the batches they have counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import tables as T
from millrace.workspace import discard, materialize


class KeptTable:
    """A table of unique keys."""

    def __init__(self, empty: DataFrame, keys: Sequence[str]):
        self.keys = list(keys)
        self._rows = materialize(empty.limit(0), "kept")
        self._batches = materialize(empty.sparkSession.createDataFrame([], "batch string"), "batches")

    def rows(self) -> DataFrame:
        return self._rows

    def _put(self, rows: DataFrame) -> None:
        last, self._rows = self._rows, materialize(rows, "kept")
        discard(last)

    def insert(self, new: DataFrame, order: Sequence[Column]) -> DataFrame:
        """Lets rows in whose key the table lacks (of equal ones the first); returns what came in."""
        came = materialize(T.insert_or_ignore(self._rows, new, self.keys, order), "came")
        self._put(self._rows.unionByName(came))
        return came

    def upsert(self, new: DataFrame) -> None:
        self._put(T.upsert(self._rows, new, self.keys))

    def count(self, new: DataFrame, counters: Sequence[str], batch: str) -> None:
        """Adds counters of a batch, unless that batch is in already."""
        if self._batches.where(F.col("batch") == batch).limit(1).count():
            return
        self._put(T.add_counters(self._rows, new, self.keys, counters))
        last, self._batches = self._batches, materialize(self._batches.unionByName(self._batches.sparkSession.createDataFrame([(batch,)], "batch string")), "batches")
        discard(last)

    def replace(self, new: DataFrame, parent: str) -> None:
        """All rows of the parents that the new ones name give way to these."""
        self._put(self._rows.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new))
