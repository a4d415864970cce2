"""Preference data: a prompt shared by two conversations, rendered once, and their two completions.

Everything is a DataFrame expression.  The longest common prefix of turns ends before the
smallest turn at which the two sides differ, an aggregate.  Both sides meet on pair and turn, and no row gathers
more than 1024 turns, so a conversation may be of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import saved

NO_TURN = (1 << 63) - 1
#: Turns 0 to 1023 of a pair make its first row, the next 1024 its second: few pairs have more than one.
CHUNK_BITS = 10
#: So many pairs of several rows (two longs each) are broadcast; more are shuffled.
BROADCAST_PAIRS = 500_000


def one_per_turn(turns: DataFrame) -> DataFrame:
    """One row for each pair_id and turn: of repeated turns the smallest by role and text, null as empty."""
    said = F.struct(F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    turns = turns.where("pair_id is not null and turn is not null").select(F.col("pair_id").cast("long").alias("pair_id"), F.col("turn").cast("long").alias("turn"), said.alias("said"))
    return turns.groupBy("pair_id", "turn").agg(F.min("said").alias("said"))


def header(said: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), said["role"], F.lit("\n"))


def rendered(said: Column) -> Column:
    """One turn in the usual role-tagged form."""
    return F.concat(header(said), said["text"], F.lit("<|im_end|>\n"))


def loss_spans(turns: Column) -> Column:
    """(first, end) characters of what the assistant says, end marks included, in the rendered turns."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,end:int>>").alias("spans"))

    def add(state: Column, said: Column) -> Column:
        end = state["at"] + F.length(rendered(said))
        span = F.struct((state["at"] + F.length(header(said))).alias("first"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(said["role"] == "assistant", F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, start, add, lambda state: state["spans"])


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row for each preference pair: pair_id, chunk, prompt, chosen, rejected, chosen_mask and rejected_mask.

    Both inputs hold pair_id, turn, role and text; other columns are ignored.  The prompt is the longest common
    prefix of turns, that is, every turn before the first one at which number, role or text of the two sides differ, rendered
    once; what follows on each side is its completion.  A mask lists, as (first, end) in characters of its completion, what a
    model learns from: what the assistant says, with the end mark, but not the role tags.  A part without turns is an empty
    text.  Sides that agree entirely are all prompt; a pair with one side only has no prompt.  Rows without pair_id or turn are
    left out, null roles and texts count as empty, and of repeated turns the smallest by role and text counts.  A pair whose
    turns reach beyond number 1023 continues in further rows (chunk 1, 2, ...), so that a conversation of any number of turns is
    rendered whole; the texts of up to 1,024 turns of both sides share a row, which must be less than 2 GB.  An empty table gives an empty table.
    """
    a, b = one_per_turn(chosen).withColumnRenamed("said", "c"), one_per_turn(rejected).withColumnRenamed("said", "r")
    both = a.join(b, ["pair_id", "turn"], "full_outer").withColumn("d", F.col("c").isNull() | F.col("r").isNull() | (F.col("c") != F.col("r")))
    piece = F.struct("turn", "c", F.when(F.col("d"), F.col("r")).alias("r"), "d")  # where both agree the text travels once
    rows = both.groupBy("pair_id", F.shiftright("turn", CHUNK_BITS).alias("chunk")).agg(F.array_sort(F.collect_list(piece)).alias("turns"), F.min(F.when(F.col("d"), F.col("turn"))).alias("split"))
    rows = saved(rows, "pairs")
    # A pair of one row knows its split; those of several rows share the smallest of theirs.
    several = rows.groupBy("pair_id").agg(F.min("split").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    n = several.count()
    if n:
        rows = rows.join(F.broadcast(several) if n <= BROADCAST_PAIRS else several, "pair_id", "left").withColumn("split", F.coalesce("least", "split"))
    rows = rows.withColumn("split", F.coalesce("split", F.lit(NO_TURN)))
    after = F.filter("turns", lambda x: x["turn"] >= F.col("split"))
    said = {
        "prompt": F.transform(F.filter("turns", lambda x: x["turn"] < F.col("split")), lambda x: x["c"]),
        "chosen": F.filter(F.transform(after, lambda x: x["c"]), lambda x: x.isNotNull()),
        "rejected": F.filter(F.transform(after, lambda x: F.when(x["d"], x["r"]).otherwise(x["c"])), lambda x: x.isNotNull()),
    }
    rows = rows.select("pair_id", "chunk", *[x.alias(side) for side, x in said.items()])
    return rows.select("pair_id", "chunk", *[F.array_join(F.transform(side, rendered), "").alias(side) for side in said], *[loss_spans(F.col(side)).alias(f"{side}_mask") for side in ("chosen", "rejected")])


def other_answers(turns: DataFrame) -> DataFrame:
    """A rejected side for conversations (pair_id, turn, role, text): what the assistant says is exchanged with what it says in
    the neighbour (2k with 2k + 1) at the same turn, where it says something there."""
    own = one_per_turn(turns)
    other = own.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), "turn", F.col("said").alias("other"))
    exchanged = F.when((F.col("said.role") == "assistant") & (F.col("other.role") == "assistant"), F.col("other.text")).otherwise(F.col("said.text"))
    return own.join(other, ["pair_id", "turn"], "left").select("pair_id", "turn", F.col("said.role").alias("role"), exchanged.alias("text"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as chosen side, and with its neighbour's answers as rejected one; pair_id is its conv_id."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumnRenamed("conv_id", "pair_id")
    pairs = preference_pairs(turns, other_answers(turns))
    spans = lambda side: F.array_join(F.transform(side, lambda x: F.concat_ws("-", x["first"].cast("string"), x["end"].cast("string"))), ",").alias(side)
    return pairs.select("pair_id", "chunk", "prompt", "chosen", "rejected", spans("chosen_mask"), spans("rejected_mask"))


OP7_SQL = """
WITH t AS (
  SELECT conv_id AS pair_id, turn, min(struct_pack(r := coalesce(role, ''), t := coalesce(text, ''))) AS s
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL
), p AS (
  SELECT t.pair_id, t.turn, t.s AS c, CASE WHEN t.s.r = 'assistant' AND o.s.r = 'assistant' THEN struct_pack(r := t.s.r, t := o.s.t) ELSE t.s END AS r
  FROM t LEFT JOIN t o ON o.pair_id = xor(t.pair_id, 1) AND o.turn = t.turn
), cut AS (
  SELECT *, coalesce(min(CASE WHEN c <> r THEN turn END) OVER (PARTITION BY pair_id), 9223372036854775807) AS split FROM p
), seg AS (
  SELECT pair_id, turn, turn // 1024 AS chunk, turn < split AS shared, c.r = 'assistant' AS c_loss, r.r = 'assistant' AS r_loss,
    '<|im_start|>' || c.r || chr(10) AS c_head, c.t || '<|im_end|>' || chr(10) AS c_said,
    '<|im_start|>' || r.r || chr(10) AS r_head, r.t || '<|im_end|>' || chr(10) AS r_said FROM cut
), pos AS (
  SELECT *, sum(CASE WHEN shared THEN 0 ELSE length(c_head) + length(c_said) END) OVER (PARTITION BY pair_id, chunk ORDER BY turn) AS c_end,
    sum(CASE WHEN shared THEN 0 ELSE length(r_head) + length(r_said) END) OVER (PARTITION BY pair_id, chunk ORDER BY turn) AS r_end FROM seg
)
SELECT pair_id, chunk,
  coalesce(string_agg(c_head || c_said, '' ORDER BY turn) FILTER (shared), '') AS prompt,
  coalesce(string_agg(c_head || c_said, '' ORDER BY turn) FILTER (NOT shared), '') AS chosen,
  coalesce(string_agg(r_head || r_said, '' ORDER BY turn) FILTER (NOT shared), '') AS rejected,
  coalesce(string_agg((c_end - length(c_said)) || '-' || c_end, ',' ORDER BY turn) FILTER (NOT shared AND c_loss), '') AS chosen_mask,
  coalesce(string_agg((r_end - length(r_said)) || '-' || r_end, ',' ORDER BY turn) FILTER (NOT shared AND r_loss), '') AS rejected_mask
FROM pos GROUP BY pair_id, chunk
"""
