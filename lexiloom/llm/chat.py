"""Chat formatting: collapse of cumulative snapshots, then rendering.

A logger that writes a conversation after every reply leaves many logged conversations that are
prefixes of longer ones. Every turn gets a rolling hash of the turns up to it (the running XOR of
two position-keyed 64-bit hashes, 128 bits in all). A conversation is superseded when the hash of
its last turn is also a prefix hash of a longer conversation, or is the last hash of an equal one
with a smaller id; an anti-join keeps the rest, which are rendered.

Texts are shuffled twice: once to be hashed in their order, once to be rendered. Between the two
only hashes, written once without texts, are joined and grouped; they are aggregated before they
are shuffled, so a first turn that a third of all conversations share is one row per map task.
A conversation's turns are numbered in blocks of ``BLOCK`` turn numbers and the blocks' totals are
added afterwards, so no task sorts a very long conversation to hash it. (Rendered, it is one row.)

Edge cases: turns are ordered by (turn, role, text) with null turns first, so ties and repeated rows
have a defined place; null roles and texts count as empty; a row with a null conv_id is a
conversation of one turn, equal ones count once, and its id counts as larger than every id; an
empty table gives no rows. Only the four named columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.session import materialize, table

BLOCK = 256
#: A conversation's key: never null, so that joins and windows share one partitioning.
KEY = ("lone", "c", "d")


def keyed_turns(turns: DataFrame) -> DataFrame:
    """KEY, conv_id, turn, role, text; every distinct turn without conversation has a key of its own."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    known = rows.where("conv_id IS NOT NULL").select(F.lit(False).alias("lone"), F.col("conv_id").cast("long").alias("c"), F.lit(0).cast("long").alias("d"), "*")
    lone = rows.where("conv_id IS NULL").groupBy("role", "text").agg(F.min("turn").alias("turn"), F.first("conv_id").alias("conv_id"))
    keys = (F.lit(True).alias("lone"), F.xxhash64("role", "text").alias("c"), F.xxhash64(F.lit("second"), "role", "text").alias("d"))
    return known.unionByName(lone.select(*keys, "conv_id", "turn", "role", "text"))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """KEY, pos (from 1) and the rolling hash (ha, hb) of turns 1 to pos."""
    rows = keyed_turns(turns).withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**62))))
    # Within a block: the running number of turns. Blocks before it add their counts.
    in_block = Window.partitionBy(*KEY, "block").orderBy("turn", "role", "text")
    so_far = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*KEY).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*KEY, "block").agg(F.count(F.lit(1)).alias("size"))
    offsets = sizes.select(*KEY, "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    placed = (
        rows.join(offsets, [*KEY, "block"])
        .withColumn("pos", F.col("offset") + F.row_number().over(in_block))
        .withColumn("a", F.xxhash64("pos", "role", "text"))
        .withColumn("b", F.xxhash64(F.lit("second"), "pos", "role", "text"))
        .select(*KEY, "block", "pos", F.bit_xor("a").over(so_far).alias("ra"), F.bit_xor("b").over(so_far).alias("rb"))
    )
    placed = materialize(placed, "turns")
    totals = placed.groupBy(*KEY, "block").agg(F.max_by("ra", "pos").alias("ta"), F.max_by("rb", "pos").alias("tb"))
    carried = totals.select(*KEY, "block", F.coalesce(F.bit_xor("ta").over(before), F.lit(0)).alias("ca"), F.coalesce(F.bit_xor("tb").over(before), F.lit(0)).alias("cb"))
    return placed.join(carried, [*KEY, "block"]).select(*KEY, "pos", F.col("ra").bitwiseXOR(F.col("ca")).alias("ha"), F.col("rb").bitwiseXOR(F.col("cb")).alias("hb"))


def superseded(prefixes: DataFrame) -> DataFrame:
    """Keys of the conversations that a longer or an equal earlier one contains."""
    lengths = prefixes.groupBy(*KEY).agg(F.max("pos").alias("n_turns"))
    keyed = prefixes.join(lengths, [*KEY])
    is_last, rank = F.col("pos") == F.col("n_turns"), F.struct(*KEY)
    groups = keyed.groupBy("ha", "hb").agg(F.max("n_turns").alias("longest"), F.min(F.when(is_last, rank)).alias("first"))
    ends = keyed.where(is_last)
    return ends.join(groups, ["ha", "hb"]).where((F.col("longest") > F.col("n_turns")) | (F.col("first") < rank)).select(*KEY)


def collapse_and_render(turns: DataFrame) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, n_chars and the rendered text."""
    kept = keyed_turns(turns).join(superseded(prefix_hashes(turns)), [*KEY], "left_anti")
    line = lambda t: F.concat(F.lit("<|"), t.role, F.lit("|>\n"), t.text, F.lit("<|end|>\n"))
    return (
        kept.groupBy(*KEY)
        .agg(F.first("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_turns"), F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
        .select("conv_id", "n_turns", F.array_join(F.transform("turns", line), "").alias("text"))
        .select("conv_id", "n_turns", F.length("text").cast("long").alias("n_chars"), "text")
    )


def op1_chat_collapse(spark, sf_dir):
    return collapse_and_render(table(spark, sf_dir, "conversations"))


ORACLE = """
WITH r AS (
  SELECT conv_id, NULL AS lone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL
  SELECT NULL, row_number() OVER (), min(turn), coalesce(role, ''), coalesce(text, '') FROM conversations WHERE conv_id IS NULL
  GROUP BY coalesce(role, ''), coalesce(text, '')),
t AS (
  SELECT conv_id, lone, row_number() OVER w AS pos, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS line
  FROM r WINDOW w AS (PARTITION BY conv_id, lone ORDER BY turn NULLS FIRST, role, text)),
c AS (SELECT conv_id, lone, count(*) AS n_turns, string_agg(line, '' ORDER BY pos) AS text FROM t GROUP BY conv_id, lone),
p AS (SELECT t.conv_id, t.pos, string_agg(t.line, '') OVER (PARTITION BY t.conv_id, t.lone ORDER BY t.pos) AS head, c.n_turns
      FROM t JOIN c ON t.conv_id IS NOT DISTINCT FROM c.conv_id AND t.lone IS NOT DISTINCT FROM c.lone),
g AS (SELECT sha256(head) AS h, pos, max(n_turns) AS longest, min(CASE WHEN pos = n_turns THEN conv_id END) AS first FROM p GROUP BY 1, 2)
SELECT c.conv_id, c.n_turns, CAST(length(c.text) AS BIGINT) AS n_chars, c.text
FROM c JOIN g ON sha256(c.text) = g.h AND c.n_turns = g.pos
WHERE g.longest = c.n_turns AND g.first IS NOT DISTINCT FROM c.conv_id
"""

QUERIES = {"op1_chat_collapse": (op1_chat_collapse, ORACLE)}
