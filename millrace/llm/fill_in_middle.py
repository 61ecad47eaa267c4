"""Fill-in-middle examples from whole texts, cut at units found by a sparse event scan.

A unit is a word with the white space before it, or white space that ends the text. One Aho-Corasick automaton of
the six white-space characters and the three sentinels reads a text once; its events are all that is kept. Where two
neighbouring white-space events (or an end of the text) leave a gap, one unit ends, so the number of units is the number of
gaps, and the k-th gap's end is where the k-th unit ends: a cut is looked up by its rank, and no list of units is made.

Draws come from the SHA-256 of seed and doc_id, so an example does not depend on order, partitions or other rows.

Defined results: a null text is empty and stays plain with 0 units; a text that holds a sentinel stays plain; a null
doc_id draws as the empty string; repeated rows are returned each; an empty table gives no rows; other columns of
the input are ignored. Texts of any length are worked on whole (8 bytes an event).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import SPACE_CHARS, slices_by_bytes, table

#: Fixed strings of the format.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINEL_REGEX = "<[PSM]>"
SLICE_BYTES = 4 << 20
OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def automaton():
    """White space has the value 0, sentinels 1."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for c in SPACE_CHARS:
        made.add_word(c, 0)
    for s in (PREFIX, SUFFIX, MIDDLE):
        made.add_word(s, 1)
    made.make_automaton()
    return made


def unit_ends(text: str, scan) -> tuple[np.ndarray, bool]:
    """Where each unit of the text ends (code points), and whether the text holds a sentinel."""
    events = np.fromiter((2 * end + kind for end, kind in scan.iter(text)), np.int64)
    spaces = events[events % 2 == 0] // 2
    marked = len(spaces) < len(events)
    borders = np.concatenate([[-1], spaces, [len(text)]])
    ends = borders[1:][np.diff(borders) > 1]
    if len(spaces) and spaces[-1] == len(text) - 1:
        ends = np.append(ends, len(text))
    return ends, marked


def draws(seed: int, doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[at : at + 8], 16) for at in range(0, 32, 8)]


def example(text: str, doc_id: int | None, scan, seed: int, share: int, spm_share: int) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars and output of one text."""
    ends, marked = unit_ends(text, scan)
    n = len(ends)
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not n or marked or h3 % 100 >= share:
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (int(ends[k - 1]) if k else 0 for k in (first, second))
    head, middle, tail = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_share:
        return n, "spm", len(head), len(middle), SUFFIX + tail + PREFIX + head + MIDDLE + middle
    return n, "psm", len(head), len(middle), PREFIX + head + SUFFIX + tail + MIDDLE + middle


def _examples(batches: Iterator, seed: int, share: int, spm_share: int) -> Iterator:
    import pyarrow as pa

    scan = automaton()
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    for whole in batches:
        for batch in slices_by_bytes(whole, "text", SLICE_BYTES):
            ids = batch.column("doc_id")
            rows = [example(t or "", i, scan, seed, share, spm_share) for i, t in zip(ids.to_pylist(), batch.column("text").to_pylist(), strict=True)]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, seed: int = 42, share: int = 50, spm_share: int = 80) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output of every row.

    ``share`` percent of the documents are cut, ``spm_share`` percent of these with the suffix first.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return read.mapInArrow(partial(_examples, seed=seed, share=share, spm_share=spm_share), OUT)


def restored(output: Column | str = "output", form: Column | str = "form") -> Column:
    """The text that an output was made of."""
    output, form = (F.col(x) if isinstance(x, str) else x for x in (output, form))
    parts = F.split(output, SENTINEL_REGEX, -1)
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .otherwise(F.concat(parts[2], parts[3], parts[1]))
    )


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


OP12_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
    CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM t
), c AS (
  SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n,
    least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM u
), p AS (
  SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS head, array_to_string(units[a + 1:b], '') AS mid, array_to_string(units[b + 1:], '') AS tail
  FROM c
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(head) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || mid
    ELSE '<S>' || tail || '<P>' || head || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""

QUERIES = {"op12_fill_in_middle": op12_fill_in_middle}
ORACLES = {"op12_fill_in_middle": OP12_SQL}
