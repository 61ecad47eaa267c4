"""Chat formatting by prefix-target expansion (DataFrame functions only).

A turn is written as ``<s>role[INST]text[/INST]</s>``. Control strings inside roles and texts are
quoted by one more tilde after their bracket (``</s>`` becomes ``<~/s>``, ``<~/s>`` becomes ``<~~/s>``), which
unquoting takes away again, so every text survives the round trip and none can forge a turn.

Every assistant turn becomes an example of its own: all turns before it as context, and its text alone
under the loss mask. Turns after the last assistant turn make one more example without a target, so
nothing of the conversation is lost.

Defined results: a null text or role is empty; rows of one turn number are ordered by role, then text, and
repeated rows are all kept; null turn numbers come first; a null conv_id is a conversation of its own; other
columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table

#: Fixed strings of the template.
OPEN, MIDDLE, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
QUOTE_PATTERN = r"([<\[])(~*/?(?:s>|INST\]))"
UNQUOTE_PATTERN = r"([<\[])~(~*/?(?:s>|INST\]))"
TRAINED_ROLE = "assistant"


def quote(text: Column) -> Column:
    return F.regexp_replace(text, QUOTE_PATTERN, "$1~$2")


def unquote(text: Column) -> Column:
    return F.regexp_replace(text, UNQUOTE_PATTERN, "$1$2")


def prefix_targets(rows: DataFrame) -> DataFrame:
    """Examples: conv_id, example (number of turns it holds), trained, formatted, loss_start and loss_length in code points."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    written = turns.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct((t.role == TRAINED_ROLE).alias("trained"), quote(t.role).alias("role"), quote(t.text).alias("text"))).alias("turns"),
    )
    size = F.size("turns")
    numbered = written.select(
        "conv_id",
        "turns",
        F.explode(F.filter(F.sequence(F.lit(1), size), lambda i: F.element_at("turns", i).trained | (i == F.size("turns")))).alias("example"),
    )
    held = F.transform(
        F.slice("turns", F.lit(1), F.col("example")),
        lambda t: F.concat(F.lit(OPEN), t.role, F.lit(MIDDLE), t.text, F.lit(CLOSE + END)),
    )
    target = F.element_at("turns", F.col("example"))
    length = F.when(target.trained, F.char_length(target.text)).otherwise(0)
    return numbered.select(
        "conv_id", "example", target.trained.alias("trained"), F.array_join(held, "").alias("formatted"), length.cast("long").alias("loss_length")
    ).withColumn("loss_start", F.when(F.col("trained"), F.char_length("formatted") - len(CLOSE + END) - F.col("loss_length")))


def read_back(examples: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from its formatted examples."""
    loss_text = unquote(F.substring(F.col("formatted"), (F.col("loss_start") + 1).cast("int"), F.col("loss_length").cast("int")))
    whole = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("formatted"),
        F.sum(F.char_length("formatted")).cast("long").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.when(F.col("trained"), F.struct("example", loss_text.alias("text"))))).alias("losses"),
    )
    closed = F.split("formatted", F.lit(END))
    parts = whole.select("conv_id", "formatted_chars", F.slice(closed, 1, F.size(closed) - 1).alias("parts"), F.array_join(F.transform("losses", lambda x: x.text), "").alias("loss"))

    def parsed(part: Column) -> Column:
        role = F.substring_index(F.substring(part, len(OPEN) + 1, 1 << 30), MIDDLE, 1)
        start = F.char_length(role) + len(OPEN + MIDDLE)
        text = F.substring(part, start + 1, F.char_length(part) - start - len(CLOSE))
        return F.concat(unquote(role), F.lit("\n"), unquote(text), F.lit("\n"))

    return parts.select(
        "conv_id",
        F.size("parts").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("parts", parsed), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(
        "SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"
    )
    return read_back(prefix_targets(rows.unionByName(probe)))


OP7_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), lens AS (
  SELECT *, 20
      + length(regexp_replace(role, '([<\[])(~*/?(?:s>|INST\]))', '\1~\2', 'g'))
      + length(regexp_replace(text, '([<\[])(~*/?(?:s>|INST\]))', '\1~\2', 'g')) AS n,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos,
    count(*) OVER (PARTITION BY conv_id) AS turns
  FROM rows_
), run AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY pos) AS upto FROM lens
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (WHERE role = 'assistant' OR pos = turns) AS BIGINT) AS formatted_chars
FROM run GROUP BY conv_id
"""

QUERIES = {"op7_chat_format": op7_chat_format}
ORACLES = {"op7_chat_format": OP7_SQL}
