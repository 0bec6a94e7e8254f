"""Chat formatting: logged snapshots that another conversation continues are dropped, the others are rendered.

A turn's rolling prefix hash is the running XOR of two 64-bit hashes of
(position, role, text), so it can be added up from blocks of turns and hashing
needs no whole conversation in a task. Conversations whose full hash is a
proper prefix hash of another are removed by an anti-join. Placed turns and
hashes are written once, as each is read twice. A rendered conversation is one
value, so the task that renders it holds it whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

#: Turn numbers per block; a long conversation is spread over as many tasks as it has blocks.
TURNS = 256


def positions(turns: DataFrame) -> DataFrame:
    """conv_id, block, pos (from 1), role, text. Turns without conv_id are left out; null roles and texts count as empty; null turns come first, ties go by role and text."""
    t = turns.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("block", F.floor(F.col("turn") / TURNS))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = t.groupBy("conv_id", "block").agg(F.count("*").alias("n")).select("conv_id", F.col("block").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    ranked = t.withColumn("rank", F.row_number().over(inside))
    return ranked.join(sizes.withColumnRenamed("conv_id", "c"), (F.col("conv_id") == F.col("c")) & F.col("block").eqNullSafe(F.col("b"))).select("conv_id", "block", (F.col("skip") + F.col("rank")).alias("pos"), "role", "text")


def prefix_hashes(placed: DataFrame) -> DataFrame:
    """conv_id, pos, h1, h2: the hashes of each conversation's turns up to pos."""
    h = placed.select("conv_id", "block", "pos", F.xxhash64("pos", "role", "text").alias("x1"), F.xxhash64(F.lit(7), "text", "role", "pos").alias("x2"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = h.groupBy("conv_id", "block").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    blocks = blocks.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), *[F.coalesce(F.bit_xor(x).over(before), F.lit(0)).alias(f"{x}_before") for x in ("x1", "x2")])
    upto = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    inner = h.select("conv_id", "block", "pos", *[F.bit_xor(x).over(upto).alias(x) for x in ("x1", "x2")])
    return inner.join(blocks, (F.col("conv_id") == F.col("c")) & F.col("block").eqNullSafe(F.col("b"))).select("conv_id", "pos", F.col("x1").bitwiseXOR(F.col("x1_before")).alias("h1"), F.col("x2").bitwiseXOR(F.col("x2_before")).alias("h2"))


def maximal(hashes: DataFrame) -> DataFrame:
    """conv_id, n_turns of conversations that no other one continues; of identical ones the smallest conv_id."""
    whole = hashes.groupBy("conv_id").agg(F.max(F.struct("pos", "h1", "h2")).alias("w"), F.max("pos").alias("n_turns"))
    distinct = whole.groupBy(F.col("w.pos").alias("pos"), F.col("w.h1").alias("h1"), F.col("w.h2").alias("h2")).agg(F.min("conv_id").alias("conv_id"))
    sizes = whole.select("conv_id", "n_turns")
    proper = hashes.join(sizes, "conv_id").where("pos < n_turns").select("pos", "h1", "h2").distinct()
    return distinct.join(proper, ["pos", "h1", "h2"], "left_anti").select("conv_id", F.col("pos").alias("n_turns"))


def _clean(column: str):
    return F.replace(F.col(column), F.lit("<|"), F.lit("< |"))


def render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, rendered of each maximal conversation.

    A turn becomes `<|im_start|>role`, a line break, its text and
    `<|im_end|>`; marks that stand in a role or text are broken by a blank. An
    empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(turns.sparkSession, "chat")
    placed = scratch.save(positions(turns), "placed")
    kept = maximal(scratch.save(prefix_hashes(placed), "hashes"))
    said = F.concat(F.lit("<|im_start|>"), _clean("role"), F.lit("\n"), _clean("text"), F.lit("<|im_end|>")).alias("said")
    lines = placed.join(kept, "conv_id", "left_semi").select("conv_id", "pos", said)
    return lines.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "said"))), lambda x: x["said"]), "\n").alias("rendered"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(table(spark, sf_dir, "conversations"))


SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(31) || text || chr(30), '' ORDER BY pos) AS said,
    string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>', chr(10) ORDER BY pos) AS rendered
  FROM t GROUP BY conv_id
)
SELECT a.conv_id, a.n_turns, a.rendered FROM c a
WHERE NOT EXISTS (
  SELECT 1 FROM c b WHERE (b.n_turns > a.n_turns AND starts_with(b.said, a.said))
    OR (b.n_turns = a.n_turns AND b.said = a.said AND b.conv_id < a.conv_id))
"""
