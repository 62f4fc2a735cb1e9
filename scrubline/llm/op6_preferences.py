"""Preference formatting: chosen and rejected conversations share one prompt.

Of each pair the longest common prefix of turns (same role, same text) is found
and rendered once as the prompt; the rest of either conversation is rendered as
its completion.  A completion's mask says which of its characters train: those
of assistant turns with their end mark, as ``starts`` and ``lengths``; the
prompt is masked whole.  All of it is DataFrame expressions after one shuffle by
pair; a row of the result holds a whole pair, so a pair must fit in a row.

Turns are ordered by number, then role and text; repeats of a turn count once.
A null role or text counts as empty.  A side without turns has an empty
completion.  Other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Fixed values of the rendered format.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), "")


def masks(turns: Column) -> Column:
    """``start, length`` of the trained characters of rendered turns."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    head, tail = len(OPEN + MIDDLE), len(CLOSE)

    def step(state, turn):
        start = state["at"] + F.char_length(turn["role"]) + head
        size = F.char_length(turn["text"]) + tail
        span = F.array(F.struct(start.alias("start"), size.alias("length")))
        return F.struct(
            (start + size).alias("at"),
            F.when(turn["role"] == TRAINED, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, empty, step, lambda s: s["spans"])


def preference_pairs(turns: DataFrame) -> DataFrame:
    """One row for each pair from ``pair_id, chosen (boolean), turn, role, text``."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sides = turns.groupBy("pair_id").agg(*[
        F.array_sort(F.collect_set(F.when(F.col("chosen") == own, turn))).alias(name)
        for name, own in (("c", True), ("r", False))])
    differ = F.array_position(F.zip_with("c", "r", lambda a, b: F.coalesce(
        (a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False))), F.lit(False))
    same = F.when(differ > 0, differ - 1).otherwise(F.size("c")).cast("int")
    cut = sides.withColumn("n", same)

    def after(name):
        return F.slice(name, F.col("n") + 1, F.greatest(F.size(name) - F.col("n"), F.lit(0)))

    return cut.select(
        "pair_id", F.col("n").cast("long").alias("prompt_turns"),
        render(F.slice("c", F.lit(1), F.col("n"))).alias("prompt"),
        after("c").alias("c"), after("r").alias("r")).select(
        "pair_id", "prompt_turns", "prompt",
        render(F.col("c")).alias("chosen"), render(F.col("r")).alias("rejected"),
        masks(F.col("c")).alias("chosen_mask"), masks(F.col("r")).alias("rejected_mask"))


def swapped_answers(conversations: DataFrame) -> DataFrame:
    """Pairs made from plain conversations: each one is chosen as it stands and
    rejected with its last assistant turn answered as its neighbour (the id with
    the lowest bit flipped) ends.  Conversations without an assistant turn, or
    whose neighbour has none, are rejected without that answer."""
    rows = conversations.where("conv_id is not null and turn is not null").select(
        F.col("conv_id").alias("pair_id"), "turn", "role", "text").distinct()
    last = rows.where(F.col("role") == TRAINED).groupBy("pair_id").agg(
        F.max(F.struct("turn", "text")).alias("m")).select("pair_id", F.col("m.turn").alias("last"), F.col("m.text").alias("answer"))
    chosen = rows.select("pair_id", F.lit(True).alias("chosen"), "turn", "role", "text")
    before = rows.join(last.select("pair_id", "last"), "pair_id", "left").where(
        F.col("last").isNull() | (F.col("turn") < F.col("last"))).select(
        "pair_id", F.lit(False).alias("chosen"), "turn", "role", "text")
    other = last.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("answer").alias("text"))
    answers = last.select("pair_id", F.col("last").alias("turn")).join(other, "pair_id").select(
        "pair_id", F.lit(False).alias("chosen"), "turn", F.lit(TRAINED).alias("role"), "text")
    return chosen.unionByName(before).unionByName(answers)


def op6_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    def text(mask):
        return F.array_join(F.transform(mask, lambda m: F.concat_ws(
            ":", m["start"].cast("string"), m["length"].cast("string"))), ",")

    pairs = preference_pairs(swapped_answers(table(spark, sf_dir, "conversations")))
    return pairs.withColumn("chosen_mask", text(F.col("chosen_mask"))).withColumn(
        "rejected_mask", text(F.col("rejected_mask")))


_SHOWN = "'<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10)"
OP6_SQL = f"""
WITH rows AS (SELECT DISTINCT conv_id AS pair_id, turn, role, text FROM conversations
              WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
last AS (SELECT pair_id, max(turn) AS last, arg_max(text, (turn, text)) AS answer FROM rows
         WHERE role = 'assistant' GROUP BY 1),
turns AS (
  SELECT pair_id, true AS c, turn, role, text FROM rows
  UNION ALL SELECT pair_id, false, turn, role, text FROM rows LEFT JOIN last USING (pair_id)
    WHERE last IS NULL OR turn < last
  UNION ALL SELECT a.pair_id, false, a.last, 'assistant', b.answer
    FROM last a JOIN last b ON b.pair_id = xor(a.pair_id, 1)),
placed AS (
  SELECT pair_id, c, row_number() OVER (PARTITION BY pair_id, c ORDER BY turn, role, text) AS k, role, text
  FROM (SELECT DISTINCT pair_id, c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM turns)),
cut AS (
  SELECT pair_id, min(CASE WHEN x.text IS DISTINCT FROM y.text OR x.role IS DISTINCT FROM y.role
                           THEN k - 1 END) AS n, count(*) AS every
  FROM (FROM placed WHERE c) x FULL JOIN (FROM placed WHERE NOT c) y USING (pair_id, k) GROUP BY 1),
shown AS (
  SELECT pair_id, coalesce(n, every) AS n, c, k, role, text, {_SHOWN} AS s,
         coalesce(sum(length({_SHOWN})) FILTER (k > coalesce(n, every)) OVER (
           PARTITION BY pair_id, c ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM placed JOIN cut USING (pair_id))
SELECT pair_id, max(n) AS prompt_turns,
       coalesce(string_agg(s, '' ORDER BY k) FILTER (c AND k <= n), '') AS prompt,
       coalesce(string_agg(s, '' ORDER BY k) FILTER (c AND k > n), '') AS chosen,
       coalesce(string_agg(s, '' ORDER BY k) FILTER (NOT c AND k > n), '') AS rejected,
       coalesce(string_agg((pos + length(role) + 5) || ':' || (length(text) + 8), ',' ORDER BY k)
                FILTER (c AND k > n AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg((pos + length(role) + 5) || ':' || (length(text) + 8), ',' ORDER BY k)
                FILTER (NOT c AND k > n AND role = 'assistant'), '') AS rejected_mask
FROM shown GROUP BY pair_id
"""
