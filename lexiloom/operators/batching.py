"""Sequential batches of a whole table by jump pointers.

Where a batch ends depends on where it began, so batches look like a fold over all rows. But a row that
begins a batch fixes the row that begins the next one, at most ``rows`` further on: its jump. Rows stand in
segments; a segment turns the place at which it is entered (one of the first ``rows``) into the place
at which the next one is entered. Such maps are small and composed by doubling: after k rounds of a join,
the entries of the first 2 ** k segments are known. Then every segment is cut on its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.session import discard, materialize, table


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """Adds ``at``, the place of each row in the order of ``key`` (nulls first; ties in any order)."""
    keys = (F.asc_nulls_first(key), "salt")
    dealt = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(4096))).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("salt")
    dealt = materialize(dealt.withColumn("seen", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("seen", 33)
    sizes = dealt.groupBy(part.alias("part")).agg(F.min("seen").alias("first"), F.count(F.lit(1)).alias("n"))
    # One row a partition.
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = F.broadcast(sizes.select(F.col("part").alias("s_part"), (before - F.col("first")).alias("shift")))
    return dealt.join(start, part == F.col("s_part")).withColumn("at", F.col("seen") + F.col("shift")).drop("seen", "shift", "s_part")


def _jumps(sizes: np.ndarray, rows: int, size: int) -> np.ndarray:
    """For each row, the row that begins the next batch if it begins one."""
    total, n = np.concatenate(([0], np.cumsum(sizes))), len(sizes)
    fits = np.searchsorted(total, total[:-1] + size, side="right") - 1
    return np.clip(fits, np.arange(n) + 1, np.minimum(np.arange(n) + rows, n))


def sequential_batches(chunks: DataFrame, rows: int = 64, size: int = 192_000, segment: int = 4096) -> DataFrame:
    """(chunk_id, batch) of chunks (chunk_id, bytes) in order: at most ``rows`` of them and ``size`` bytes a batch.

    A batch is named by the place of its first chunk and always takes that chunk, however large. Null ids
    come first, null sizes are zero; of repeated ids either order is right. The result is the same for every
    ``segment``, which must not be below ``rows``.
    """
    if segment < rows:
        raise ValueError("a segment must hold a batch")
    placed = numbered(chunks.select("chunk_id", F.coalesce(F.col("bytes").cast("long"), F.lit(0)).alias("bytes")), "chunk_id")
    place = F.col("at") % segment
    # The first rows of a segment are looked at from the one before it too.
    dealt = placed.select("chunk_id", "bytes", F.expr(f"at div {segment}").alias("segment"), place.alias("place"))
    ahead = dealt.where((F.col("place") < rows) & (F.col("segment") > 0)).select(F.lit(None).cast("long").alias("chunk_id"), "bytes", F.col("segment") - 1, F.col("place") + segment)
    held = dealt.unionByName(ahead.toDF("chunk_id", "bytes", "segment", "place")).groupBy("segment")
    held = materialize(held.agg(F.array_sort(F.collect_list(F.struct("place", "bytes", "chunk_id"))).alias("r")), "segments")  # segment + rows entries

    def maps(batches):
        for batch in batches:
            out = []
            for r in batch["r"]:
                jump = _jumps(r.values.field("bytes").to_numpy(), rows, size)
                leads, n = list(range(len(jump) + 1)), len(jump)
                for i in range(min(segment, n) - 1, -1, -1):
                    leads[i] = leads[jump[i]]
                out.append([leads[e] - segment if e < n and leads[e] >= segment else None for e in range(rows)])
            yield pa.RecordBatch.from_arrays([batch["segment"], pa.array(out, pa.list_(pa.int32()))], ["segment", "to"])

    step = materialize(held.mapInArrow(maps, "segment long, to array<int>"), "maps")
    count = step.count()
    known, reach = held.where("segment = 0").select("segment", F.lit(0).alias("entry")), 1
    while reach < count:
        known = materialize(known, "entries")
        on = known.join(step, "segment").select((F.col("segment") + reach).alias("segment"), F.get("to", F.col("entry")).alias("entry")).where("entry IS NOT NULL")
        further = step.select((F.col("segment") - reach).alias("segment"), F.col("to").alias("then"))
        before = step
        step = materialize(step.join(further, "segment").select("segment", F.transform("to", lambda e: F.get("then", e)).alias("to")), "maps")
        known, reach = materialize(known.unionByName(on), "entries"), reach * 2
        discard(before)

    def cut(batches):
        for batch in batches:
            for s, entry, r in zip(batch["segment"].to_pylist(), batch["entry"].to_pylist(), batch["r"], strict=True):
                jump, n = _jumps(r.values.field("bytes").to_numpy(), rows, size), min(segment, len(r))
                starts, at = [], entry
                while at < n:
                    starts.append(at)
                    at = int(jump[at])
                of = np.searchsorted(starts, np.arange(n), side="right") - 1
                inside = of >= 0
                batch_of = np.array([0, *starts])[of + 1] + s * segment
                # Rows before the entry belong to the batch that the segment before began.
                yield pa.RecordBatch.from_arrays(
                    [r.values.field("chunk_id").slice(0, n), pa.array(batch_of, mask=~inside), pa.array(np.full(n, s)), pa.array([s * segment + starts[-1] if starts else None] * n, pa.int64())],
                    ["chunk_id", "batch", "segment", "last"],
                )

    rows_of = materialize(held.join(known, "segment").mapInArrow(cut, "chunk_id long, batch long, segment long, last long"), "cut")
    last = rows_of.groupBy((F.col("segment") + 1).alias("next")).agg(F.max("last").alias("open"))
    out = rows_of.join(last, F.col("segment") == F.col("next"), "left").select("chunk_id", F.coalesce("batch", "open").alias("batch"))
    for done in (step, held):
        discard(done)
    return out


def q_batches(spark, sf):
    chunks = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.octet_length("text").alias("bytes"))
    return sequential_batches(chunks, 16, 40_000, 128)


QUERIES = {
    "embedding_batches_sequential": (
        q_batches,
        """WITH RECURSIVE t AS (SELECT doc_id, strlen(text) AS b, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents),
        w AS (SELECT doc_id, n, 1 AS k, b AS used, n AS batch FROM t WHERE n = 0 UNION ALL
          SELECT t.doc_id, t.n, CASE WHEN k < 16 AND used + b <= 40000 THEN k + 1 ELSE 1 END, CASE WHEN k < 16 AND used + b <= 40000 THEN used + b ELSE b END, CASE WHEN k < 16 AND used + b <= 40000 THEN batch ELSE t.n END
          FROM w JOIN t ON t.n = w.n + 1) SELECT doc_id AS chunk_id, batch FROM w""",
    ),
}
