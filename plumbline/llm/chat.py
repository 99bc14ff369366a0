"""Preference formatting of chosen and rejected conversations.

A conversation is its items: the distinct (role, text) of each turn, in order of turn, role and text. The prompt
is the longest common prefix of the two conversations' turns, rendered once; what follows in each is its
completion. Turns are compared without gathering them: an item that only one side has makes its turn differ,
and the prompt ends before the first such turn. The rendered text comes in pieces, one for each item, with the
place where it starts in its part (running sums over range partitions), so a conversation of any length lies
in many tasks; the pieces of a part, joined in the order of their starts, are its text. A completion's pieces
of the assistant have the span that is to be learnt (code points in the completion, end exclusive): its text
with the end mark. Everything else is masked.

A null role is rendered as `user`, a null text as empty. Repeated rows are one item. Rows with a null
conversation or turn belong nowhere and are left out. Equal conversations have no completions; a table without
rows gives none. Further columns, of any name, are not read. A very long text is one piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import running_total

HEAD, BODY, END = "<|im_start|>", "\n", "<|im_end|>\n"
LEARNT = "assistant"
KEYS = ["conv_id", "turn", "role", "text"]


def items(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of the distinct items of turns with these columns."""
    rows = turns.where("conv_id is not null and turn is not null")
    return rows.select("conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()


def alternatives(chosen: DataFrame) -> DataFrame:
    """For each conversation a rejected one: the items of its last turn with an assistant are replaced by those of the
    first such turn, or by an empty answer where it has but one; conversations without an assistant stay as they are."""
    ends = chosen.where(F.col("role") == LEARNT).groupBy(F.col("conv_id").alias("c")).agg(F.min("turn").alias("first"), F.max("turn").alias("last"))
    joined = chosen.join(ends, chosen.conv_id == F.col("c"), "left")
    stay = joined.where("last is null or turn <> last").select(*KEYS)
    again = joined.where("turn = first and first < last").select("conv_id", F.col("last").alias("turn"), "role", "text")
    blank = ends.where("first = last").select(F.col("c").alias("conv_id"), F.col("last").alias("turn"), F.lit(LEARNT).alias("role"), F.lit("").alias("text"))
    return stay.union(again).union(blank)


def preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Of two tables of items: conv_id, part (prompt, chosen or rejected), turn, role, rendered, start and learnt (start:end)."""
    sides = chosen.select(*KEYS, F.lit(True).alias("c")).union(rejected.select(*KEYS, F.lit(False)))
    every = sides.groupBy(*KEYS).agg(F.bool_or("c").alias("c"), F.bool_or(~F.col("c")).alias("r"))
    cuts = every.where("c <> r").groupBy(F.col("conv_id").alias("cut_id")).agg(F.min("turn").alias("cut"))
    joined = every.join(cuts, every.conv_id == F.col("cut_id"), "left")
    after = F.col("turn") >= F.col("cut")
    parts = F.when(F.coalesce(after, F.lit(False)), F.array_compact(F.array(F.when(F.col("c"), "chosen"), F.when(F.col("r"), "rejected")))).otherwise(F.array(F.lit("prompt")))
    body = F.concat("text", F.lit(END))
    rows = joined.select("conv_id", F.explode(parts).alias("part"), "turn", "role", F.concat(F.lit(HEAD), "role", F.lit(BODY)).alias("head"), body.alias("body"))
    rows = rows.withColumn("size", (F.length("head") + F.length("body")).cast("long"))
    placed = running_total(rows, ["turn", "role", "body"], "size", "start", ["conv_id", "part"])
    learnt = F.when((F.col("part") != "prompt") & (F.col("role") == LEARNT), F.concat_ws(":", F.col("start") + F.length("head"), F.col("start") + F.col("size")))
    return placed.select("conv_id", "part", "turn", "role", F.concat("head", "body").alias("rendered"), "start", learnt.alias("learnt"))


def preferences_sql() -> str:
    """preferences() of the conversations and their alternatives, in DuckDB's SQL."""
    end = "<|im_end|>' || chr(10)"
    return f"""
    WITH items AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
    ends AS (SELECT conv_id, min(turn) AS first, max(turn) AS last FROM items WHERE role = '{LEARNT}' GROUP BY conv_id),
    rejected AS (
        SELECT i.* FROM items i LEFT JOIN ends e USING (conv_id) WHERE e.last IS NULL OR i.turn <> e.last
        UNION ALL SELECT conv_id, last, '{LEARNT}', '' FROM ends WHERE first = last
        UNION ALL SELECT conv_id, e.last, i.role, i.text FROM ends e JOIN items i USING (conv_id) WHERE i.turn = e.first AND e.first < e.last),
    steps AS (SELECT conv_id, turn, list(role || chr(0) || text ORDER BY role, text) FILTER (side = 'c') AS c, list(role || chr(0) || text ORDER BY role, text) FILTER (side = 'r') AS r
        FROM (SELECT 'c' AS side, * FROM items UNION ALL SELECT 'r', * FROM rejected) GROUP BY ALL),
    cuts AS (SELECT conv_id, min(turn) FILTER (c IS DISTINCT FROM r) AS cut FROM steps GROUP BY ALL),
    parts AS (SELECT conv_id, 'prompt' AS part, turn, role, text FROM items JOIN cuts USING (conv_id) WHERE cut IS NULL OR turn < cut
        UNION ALL SELECT conv_id, 'chosen', turn, role, text FROM items JOIN cuts USING (conv_id) WHERE turn >= cut
        UNION ALL SELECT conv_id, 'rejected', turn, role, text FROM rejected JOIN cuts USING (conv_id) WHERE turn >= cut),
    pieces AS (SELECT *, '{HEAD}' || role || chr(10) AS head, text || '{end} AS body FROM parts),
    placed AS (SELECT *, (sum(length(head) + length(body)) OVER (PARTITION BY conv_id, part ORDER BY turn, role, body ROWS UNBOUNDED PRECEDING))::BIGINT AS stop FROM pieces)
    SELECT conv_id, part, turn, role, head || body AS rendered, stop - length(head) - length(body) AS start,
        CASE WHEN part <> 'prompt' AND role = '{LEARNT}' THEN (stop - length(body)) || ':' || stop END AS learnt FROM placed"""
