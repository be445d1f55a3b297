"""Exact nearest neighbours by cosine distance, with pruning by pivots.

Vectors are scaled to length one, so that cosine order is the order of Euclidean distances, which obey
the triangle inequality. Every vector belongs to the cell of its nearest pivot and keeps its distance to
it. A query is first compared with its own cell; its k-th best distance t there is a bound. A block of a
cell's vectors at distances [low, high] from pivot p holds nothing nearer than t to a query at distance d
from p if d - high > t or low - d > t, so such blocks are skipped for that query; all others are compared
as matrices. Pivots are a bounded sample; they decide how much is skipped and never what is found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.session import materialize

#: Pivots (the vectors with the smallest hash of vec_id), vectors of a block, queries of a block.
PIVOTS, BLOCK, ASKED = 64, 1024, 1024
#: Vectors that are dealt to cells at a time, so that blocks are full, and queries that are compared with a block at a time.
DEALT, SCREENED = 1 << 16, 256
#: More than distances can differ by rounding to six digits.
SLACK = 1e-6
_BLOCKS = "dim int, cell int, ids array<long>, low double, high double, radii binary, vectors binary"
_PAIRS = "query_id long, vec_id long, raw double, looked long"


def _kept(rows: DataFrame) -> DataFrame:
    """Rows (vec_id, embedding) that have a direction: finite, and not all zero."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = rows.where("vec_id IS NOT NULL AND size(embedding) > 0").select("vec_id", v.alias("v"))
    return rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e150)) & F.exists("v", lambda x: F.abs(x) > 1e-150))


def _units(batch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(ids, unit vectors) of a batch, by number of dimensions."""
    lists, ids = batch["v"], batch["vec_id"].to_numpy()
    sizes, out = lists.value_lengths().to_numpy(), {}
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        x = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        out[dim] = ids[at], x / np.sqrt((x * x).sum(axis=1))[:, None]
    return out


def _dealt(batches):
    """(dimensions, ids, unit vectors) of about DEALT vectors at a time, of fewer if they are long, whatever the batches are."""
    waiting: dict[int, list] = {}
    for batch in batches:
        for dim, part in _units(batch).items():
            parts = waiting.setdefault(dim, [])
            parts.append(part)
            if sum(len(ids) for ids, _ in parts) >= DEALT * 64 // max(64, dim):
                del waiting[dim]
                yield dim, *map(np.concatenate, zip(*parts, strict=True))
    for dim, parts in waiting.items():
        yield dim, *map(np.concatenate, zip(*parts, strict=True))


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))


def _blocks(rows: DataFrame, pivots: dict[int, np.ndarray], size: int) -> DataFrame:
    """Blocks of vectors of one cell and of like distance to its pivot, made where the vectors are."""

    def run(batches):
        for dim, ids, x in _dealt(batches):
            apart = _apart(x, pivots[dim]) if dim in pivots else np.zeros((len(x), 1))
            cell = apart.argmin(axis=1)
            radius = apart[np.arange(len(x)), cell]
            order = np.lexsort((radius, cell))
            edges = np.flatnonzero(np.diff(cell[order])) + 1
            for part in np.split(order, edges):
                for at in range(0, len(part), size):
                    some = part[at : at + size]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([dim], pa.int32()), pa.array([cell[some[0]]], pa.int32()), pa.array([ids[some]], pa.list_(pa.int64())), pa.array([radius[some[0]]]), pa.array([radius[some[-1]]]),
                         pa.array([radius[some].tobytes()], pa.binary()), pa.array([x[some].tobytes()], pa.binary())],
                        ["dim", "cell", "ids", "low", "high", "radii", "vectors"],
                    )

    return rows.mapInArrow(run, _BLOCKS)


def _nearest(x: np.ndarray, ids: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int):
    """(places of queries, places of vectors, distances) of the k best vectors of each query within its bound, some queries at a time.

    Short numbers tell which pairs can be meant, by more than they can err; distances come from the long ones.
    """
    short, err = x.astype(np.float32), 2 * SLACK + 2e-7 * (x.shape[1] + 4)
    yield np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for at in range(0, len(q), SCREENED):
        some = q[at : at + SCREENED]
        alike = some.astype(np.float32) @ short.T
        least = (1 - bound[at : at + SCREENED] ** 2 / 2 - err).astype(np.float32)
        least = np.nextafter(least, np.float32(-np.inf))
        meant = alike >= least[:, None]
        full = np.flatnonzero(np.count_nonzero(meant, axis=1) > k)
        if len(full):
            least[full] = np.maximum(least[full], np.partition(alike[full], len(x) - k, axis=1)[:, len(x) - k] - np.float32(2 * err))
            meant[full] = alike[full] >= least[full, None]
        asker, best = np.divmod(np.flatnonzero(meant), len(x))
        found = 1 - np.einsum("ij,ij->i", some[asker], x[best])
        inside = found <= bound[at + asker] ** 2 / 2 + 2 * SLACK
        asker, best, found = asker[inside], best[inside], found[inside]
        # The k best of each query, by rounded distance and id.
        order = np.lexsort((ids[best], np.round(found, 6), asker))
        asker, best, found = asker[order], best[order], found[order]
        first = np.arange(len(asker)) - np.searchsorted(asker, asker) < k
        yield at + asker[first], best[first], found[first]


def _compared(pairs: DataFrame, k: int) -> DataFrame:
    """The k best of every (query, block of vectors), and a row that tells how many were compared.

    Rows hold a block of vectors and queries: q_ids, q_vectors, q_apart (to the cell's pivot), q_bounds.
    """

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch[c][i].as_py() for c in ("dim", "low", "high", "q_vectors", "q_apart", "q_bounds", "vectors")}
                ids, asked = batch["ids"][i].values.to_numpy(), batch["q_ids"][i].values.to_numpy()
                x = np.frombuffer(row["vectors"]).reshape(-1, row["dim"])
                q = np.frombuffer(b"".join(row["q_vectors"])).reshape(-1, row["dim"])
                away, bound = np.array(row["q_apart"]), np.array(row["q_bounds"])
                near = np.flatnonzero((away - row["high"] <= bound) & (row["low"] - away <= bound))
                asker, best, found = (np.concatenate(c) for c in zip(*_nearest(x, ids, q[near], bound[near], k), strict=True))
                n, none = len(asker), np.zeros(len(asker) + 1, bool)
                none[n] = True
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(asked[near[asker]], 0), mask=none), pa.array(np.append(ids[best], 0), mask=none), pa.array(np.append(found, 0.0), mask=none),
                     pa.array(np.append(np.zeros(n, np.int64), len(near) * len(x)), mask=~none)],
                    ["query_id", "vec_id", "raw", "looked"],
                )

    return pairs.mapInArrow(run, _PAIRS)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rows = found.where("query_id IS NOT NULL").select("query_id", "vec_id", (F.round("raw", 6) + 0.0).alias("distance"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def search(corpus: DataFrame, queries: DataFrame, k: int = 10, cutoff: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(query_id, vec_id, distance, rank of the k nearest; one row with the number of distances computed).

    Both tables are (vec_id, embedding). Rows without an id or a direction (null, empty, non-finite or zero
    vectors) take no part; vectors are compared with queries of their own length only.
    """
    corpus, asked = _kept(corpus), _kept(queries)
    sample = corpus.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).select("vec_id", "v").collect()  # PIVOTS vectors
    pivots: dict[int, list] = {}
    for r in sample:
        x = np.array(r.v)
        pivots.setdefault(len(x), []).append(x / np.sqrt((x * x).sum()))
    pivots = {dim: np.array(rows) for dim, rows in pivots.items()}
    blocks = materialize(_blocks(corpus, pivots, BLOCK), "vector-blocks")
    own = _blocks(asked, pivots, ASKED).select("dim", "cell", "ids", "radii", "vectors")
    most = float("inf") if cutoff is None else float(np.sqrt(2 * cutoff + 4 * SLACK)) if cutoff >= 0 else 0.0

    def opened(batches):
        """One row a query: its cell, its distance to every pivot, its vector."""
        for batch in batches:
            for i in range(batch.num_rows):
                dim, cell, ids = batch["dim"][i].as_py(), batch["cell"][i].as_py(), batch["ids"][i].values
                x = np.frombuffer(batch["vectors"][i].as_py()).reshape(-1, dim)
                apart = _apart(x, pivots[dim]) if dim in pivots else np.zeros((len(x), 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dim] * len(x), pa.int32()), pa.array([cell] * len(x), pa.int32()), ids, pa.array(apart.tolist(), pa.list_(pa.float64())), pa.array([v.tobytes() for v in x], pa.binary())],
                    ["dim", "cell", "query_id", "apart", "vector"],
                )

    one = materialize(own.mapInArrow(opened, "dim int, cell int, query_id long, apart array<double>, vector binary"), "asked")

    def grouped(rows: DataFrame) -> DataFrame:
        """Rows (dim, cell, query_id, away, bound, vector) in blocks of about ASKED queries of one cell."""
        count = rows.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("parts"))  # a row a cell
        dealt = rows.join(F.broadcast(count), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")))
        q = dealt.groupBy("dim", "cell", "part").agg(F.collect_list(F.struct("query_id", "away", "bound", "vector")).alias("q"))
        return q.select("dim", "cell", F.col("q.query_id").alias("q_ids"), F.col("q.away").alias("q_apart"), F.col("q.bound").alias("q_bounds"), F.col("q.vector").alias("q_vectors"))

    home = one.select("dim", "cell", "query_id", F.get("apart", F.col("cell")).alias("away"), F.lit(most).alias("bound"), "vector")
    first = materialize(_compared(blocks.join(grouped(home), ["dim", "cell"]), k), "own-cells")
    reach = _ranked(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("r_id"), F.least(F.sqrt(2 * F.greatest("distance", F.lit(0.0)) + 4 * SLACK), F.lit(most)).alias("bound"))
    sizes = blocks.groupBy(F.col("dim").alias("c_dim"), F.col("cell").alias("c_cell")).agg(F.min("low").alias("low"), F.max("high").alias("high"))  # PIVOTS rows a dimension
    other = one.join(reach, F.col("query_id") == F.col("r_id"), "left").select("dim", F.col("cell").alias("own"), "query_id", F.coalesce("bound", F.lit(most)).alias("bound"), "vector", F.posexplode("apart").alias("cell", "away"))
    other = other.where("cell <> own").join(F.broadcast(sizes), (F.col("dim") == F.col("c_dim")) & (F.col("cell") == F.col("c_cell")))
    other = other.where("away - high <= bound AND low - away <= bound").select("dim", "cell", "query_id", "away", "bound", "vector")
    second = materialize(_compared(blocks.join(grouped(other), ["dim", "cell"]), k), "other-cells")
    every = first.unionByName(second)
    looked = every.agg(F.coalesce(F.sum("looked"), F.lit(0)).alias("distances"))
    found = _ranked(every.where(F.round("raw", 6) <= cutoff) if cutoff is not None else every, k)
    return found, looked


def vector_topk(corpus: DataFrame, queries: DataFrame, k: int = 10, cutoff: float | None = None) -> DataFrame:
    """Exact cosine distances, the k least of each query; ties by vec_id."""
    return search(corpus, queries, k, cutoff)[0]
