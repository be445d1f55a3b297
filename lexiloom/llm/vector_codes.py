"""Vector code compression: codebooks of vector parts, fitted through anchors-hierarchy metric trees.

A vector of integers floor(4096 * x) is cut into ``PARTS`` equal parts; each part position has a codebook
of ``ENTRIES`` entries, moved ``ROUNDS`` times to the mean of the parts nearest to them.

Vectors are dealt into chunks where they are read. For every part position a chunk holds a metric tree,
built middle-out: about sqrt(n) anchors take the points nearest to them, each new one being the point
farthest from its anchor; points closer to their anchor than half the way to the new one are not looked
at. Anchors are merged upwards, always the pair in the smallest ball, and split downwards by anchors of
their own. Every ball caches the number and the sum of its points. In a round balls are visited from the
top with the list of entries that may be nearest to some point in them. An entry leaves the list if the
ball lies wholly on the other side of the plane between it and the entry nearest to the centre; children
inherit the list. When one entry is left the ball is wholly owned, and its cached sum and count are
added without a look at its points; points of other smallest balls are compared with the list.

Trees are written once and read by every round; a round sends one row a part, entry and position from
each task to a sum. The driver holds the codebooks and nothing else. Everything that decides is exact:
points are integers, distances are integers below 2**53, and the bound on balls leaves room for rounding.
Components too large for that are computed with Python's integers.

Edge cases: rows whose vector is null or holds null or non-finite components are dropped, and so are
empty ones, those whose length is no multiple of ``PARTS``, and those of another length than the kept
vector of the smallest vec_id. Null ids come after all others among the first entries; rows of one id
order by vector; repeated rows count as often as they occur. With fewer than ``ENTRIES`` rows a codebook
has fewer entries. An error too large for a long is the largest long. An empty table gives no rows. Only
vec_id, embedding and label are read.
"""

from __future__ import annotations

import hashlib
import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.session import materialize, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Points of a smallest ball; vectors and components of a chunk.
LEAF, CHUNK, CHUNK_VALUES = 40, 4096, 1 << 19
#: Bits of the digits in which sums travel, so that adding them never overflows.
DIGIT = 24
#: Labels up to which their sums are broadcast; beyond, only labels of a larger share than 1 / HEAVY are.
FEW, HEAVY = 100_000, 1000
_LARGEST = 2**63 - 1


def limit_of(width: int) -> int:
    """Largest component for which distances to entries that may be nearest are exact in a double."""
    return int(math.sqrt(2**53 / (4 * width)) / (2 * math.sqrt(width) + 2) / 1.01)


def _square_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)[None, :]


def _anchors(x: np.ndarray, most: int) -> np.ndarray:
    """The anchor that owns each point; points that all coincide have one."""
    owner, pivots = np.zeros(len(x), dtype=np.int64), [0]
    away = np.sqrt(((x - x[0]) ** 2).sum(axis=1))
    while len(pivots) < most:
        far = int(away.argmax())
        if away[far] == 0:
            break
        between = np.sqrt(((x[pivots] - x[far]) ** 2).sum(axis=1))
        near = np.flatnonzero(away > between[owner] / 2)
        to_new = np.sqrt(((x[near] - x[far]) ** 2).sum(axis=1))
        moved = to_new < away[near]
        owner[near[moved]], away[near[moved]] = len(pivots), to_new[moved]
        pivots.append(far)
    return owner


class Tree:
    """A metric tree over points; every ball is a range of them in the tree's order."""

    FIELDS = (("order", "<i4"), ("points", "<i4"), ("ranges", "<i4"), ("children", "<i4"), ("centres", "<f8"), ("radii", "<f8"), ("sums", "<f8"))

    def __init__(self, order, points, ranges, children, centres, radii, sums):
        self.order, self.points, self.ranges, self.children = order, points, ranges, children
        self.centres, self.radii, self.sums = centres, radii, sums

    @classmethod
    def build(cls, x: np.ndarray) -> Tree:
        x = x.astype(float)
        members: list[np.ndarray | None] = []  # of smallest balls
        children: list[tuple[int, int]] = []

        def ball(at, pair=(-1, -1)):
            members.append(at)
            children.append(pair)
            return len(children) - 1

        def grow(at):
            """The ball of the points ``at``, from its middle."""
            if len(at) > LEAF:
                owner = _anchors(x[at], math.isqrt(len(at)))
                if owner.any():
                    by = np.argsort(owner, kind="stable")
                    groups = np.split(at[by], np.flatnonzero(np.diff(owner[by])) + 1)
                    return merge([grow(g) for g in groups], groups)
            return ball(at)

        def merge(nodes, groups):
            """Joins balls two by two, the pair in the smallest ball first."""
            count = np.array([len(g) for g in groups], dtype=float)
            centre = np.array([x[g].mean(axis=0) for g in groups])
            radius = np.array([np.sqrt(((x[g] - c) ** 2).sum(axis=1)).max() for g, c in zip(groups, centre, strict=True)])

            def sizes(i):
                """Radius of the ball around ball i and each other one."""
                apart = np.sqrt(((centre - centre[i]) ** 2).sum(axis=1))
                joint = np.maximum(np.maximum(radius, radius[i]), (apart + radius + radius[i]) / 2)
                joint[i] = np.inf
                return np.where(count > 0, joint, np.inf)

            cost = np.array([sizes(i) for i in range(len(nodes))])
            for _ in range(len(nodes) - 1):
                i, j = divmod(int(cost.argmin()), len(nodes))
                wide, total = cost[i, j], count[i] + count[j]
                centre[i] = (centre[i] * count[i] + centre[j] * count[j]) / total
                radius[i], count[i], count[j] = wide, total, 0
                nodes[i] = ball(None, (nodes[i], nodes[j]))
                cost[j, :] = cost[:, j] = np.inf
                cost[i, :] = cost[:, i] = sizes(i)
            return nodes[i]

        root = grow(np.arange(len(x)))
        # Ranges in depth-first order, the root first; a child's number is above its parent's.
        order, number, depth = [], {}, []
        ranges, kids, todo, at = [], [], [(root, 0)], 0
        while todo:
            node, d = todo.pop()
            number[node] = len(ranges)
            own = members[node]
            ranges.append([at, at + len(own) if own is not None else -1])
            depth.append(d)
            kids.append(children[node])
            if own is not None:
                order.append(own)
                at += len(own)
            else:
                todo += [(children[node][1], d + 1), (children[node][0], d + 1)]
        kids = np.array([[number.get(k, -1) for k in pair] for pair in kids], dtype="<i4")
        for node in range(len(ranges) - 1, -1, -1):
            if kids[node, 1] >= 0:
                ranges[node][1] = ranges[kids[node, 1]][1]
        ranges, depth = np.array(ranges, dtype="<i4"), np.array(depth)
        order = np.concatenate(order).astype("<i4")
        points = x[order]
        running = np.concatenate((np.zeros((1, x.shape[1])), np.cumsum(points, axis=0)))
        sums = running[ranges[:, 1]] - running[ranges[:, 0]]
        size = (ranges[:, 1] - ranges[:, 0])[:, None]
        centres, radii = sums / size, np.empty(len(ranges))
        for d in range(depth.max() + 1):
            level = np.flatnonzero(depth == d)
            n = size[level, 0]
            start = np.cumsum(n) - n
            rows = np.arange(n.sum()) + np.repeat(ranges[level, 0] - start, n)
            away = np.sqrt(((points[rows] - np.repeat(centres[level], n, axis=0)) ** 2).sum(axis=1))
            radii[level] = np.maximum.reduceat(away, start)
        return cls(order, points.astype("<i4"), ranges, kids, centres, radii, sums)

    def owners(self, book: np.ndarray):
        """(balls, entries) wholly owned, and (ranges, entries) of the points of all other smallest balls.

        Second part: places in the tree's order and the entry of each.
        """
        width = book.shape[1]
        apart = np.sqrt(np.maximum(_square_distances(book, book), 0))
        slack = 1e-9 * (1 + (book * book).sum(axis=1).max())
        balls, may = np.zeros(1, dtype=np.int64), np.ones((1, len(book)), dtype=bool)
        owned, owner, places, nearest = [], [], [], []
        while len(balls):
            square = np.where(may, _square_distances(self.centres[balls], book), np.inf)
            best = square.argmin(axis=1)
            ahead = square - square[np.arange(len(balls)), best][:, None]
            room = 2 * self.radii[balls][:, None] * apart[best] * (1 + 1e-9) + slack + 1e-9 * (self.centres[balls] ** 2).sum(axis=1)[:, None]
            may &= ahead <= room
            whole = may.sum(axis=1) == 1
            owned.append(balls[whole])
            owner.append(best[whole])
            small = ~whole & (self.children[balls, 0] < 0)
            if small.any():
                r, lists = self.ranges[balls[small]], may[small]
                n = r[:, 1] - r[:, 0]
                at = np.arange(n.sum()) + np.repeat(r[:, 0] - (np.cumsum(n) - n), n)
                exact = _square_distances(self.points[at].reshape(-1, width).astype(float), book)
                places.append(at)
                nearest.append(np.where(np.repeat(lists, n, axis=0), exact, np.inf).argmin(axis=1))
            inner = ~whole & ~small
            balls, may = self.children[balls[inner]].reshape(-1).astype(np.int64), np.repeat(may[inner], 2, axis=0)
        none = np.zeros(0, dtype=np.int64)
        return np.concatenate(owned), np.concatenate(owner), np.concatenate([none, *places]), np.concatenate([none, *nearest])

    def totals(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and sum of the points nearest to each entry."""
        balls, entry, places, nearest = self.owners(book)
        k, size = len(book), (self.ranges[balls, 1] - self.ranges[balls, 0]).astype(float)
        count = np.bincount(entry, weights=size, minlength=k) + np.bincount(nearest, minlength=k)
        total = np.zeros(book.shape)
        np.add.at(total, entry, self.sums[balls])
        np.add.at(total, nearest, self.points[places])
        return count, total

    def codes(self, book: np.ndarray) -> np.ndarray:
        """The nearest entry of every point, in the order the points came in."""
        balls, entry, places, nearest = self.owners(book)
        out = np.empty(len(self.order), dtype=np.int64)
        r = self.ranges[balls]
        n = r[:, 1] - r[:, 0]
        out[self.order[np.arange(n.sum()) + np.repeat(r[:, 0] - (np.cumsum(n) - n), n)]] = np.repeat(entry, n)
        out[self.order[places]] = nearest
        return out

    def packed(self) -> list[bytes]:
        return [np.ascontiguousarray(getattr(self, name), dtype=kind).tobytes() for name, kind in self.FIELDS]

    @classmethod
    def unpacked(cls, row: list[bytes], width: int) -> Tree:
        arrays = {name: np.frombuffer(raw, kind) for (name, kind), raw in zip(cls.FIELDS, row, strict=True)}
        for name in ("points", "centres", "sums"):
            arrays[name] = arrays[name].reshape(-1, width)
        for name in ("ranges", "children"):
            arrays[name] = arrays[name].reshape(-1, 2)
        return cls(**arrays)


def _nearest_of(point: list[int], book: list[list[int]]) -> tuple[int, int]:
    """(square distance, entry) with integers of any size."""
    return min((sum((a - b) ** 2 for a, b in zip(point, entry, strict=True)), k) for k, entry in enumerate(book))


class Codebook:
    """Entries of one part position, and those that points of ordinary size may be nearest to."""

    def __init__(self, entries: list[list[int]]):
        self.entries = entries
        limit = limit_of(len(entries[0]))
        size = [max(map(abs, e)) for e in entries]
        # An entry beyond this is farther from every such point than any entry within the limit is.
        reach = int(limit * (2 * math.sqrt(len(entries[0])) + 1)) + 1
        self.ordinary = any(s <= limit for s in size)
        self.index = np.array([k for k, s in enumerate(size) if s <= reach], dtype=np.int64)
        self.array = np.array([entries[k] for k in self.index], dtype=float) if self.ordinary else None


def _chunk_rows(dim: int) -> int:
    return max(64, min(CHUNK, CHUNK_VALUES // dim))


def _trees(kept: DataFrame, dim: int) -> DataFrame:
    """Chunks of vectors: ids, labels and either a tree a part (packed arrays) or the integers themselves."""
    width, rows, limit = dim // PARTS, _chunk_rows(dim), limit_of(dim // PARTS)
    schema = T.StructType([
        T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(kept.schema["label"].dataType)),
        T.StructField("trees", T.ArrayType(T.ArrayType(T.BinaryType()))), T.StructField("wide", T.StringType()),
    ])

    def chunk(ids, labels, trees, wide):
        return pa.RecordBatch.from_arrays(
            [pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([labels.to_pylist()], pa.list_(labels.type)),
             pa.array([trees], pa.list_(pa.list_(pa.binary()))), pa.array([wide], pa.string())], ["ids", "labels", "trees", "wide"],
        )

    def chunks(held):
        data = pa.Table.from_batches(held).combine_chunks()
        ids, labels = (data[c].combine_chunks() for c in ("vec_id", "label"))
        vectors = data["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        with np.errstate(over="ignore"):
            whole = np.floor(SCALE * vectors)
        fits = (np.abs(whole) <= limit).all(axis=1)
        for at in range(0, len(fits), rows):
            some = at + np.flatnonzero(fits[at : at + rows])
            if len(some):
                x = whole[some].reshape(len(some), PARTS, width)
                yield chunk(ids.take(pa.array(some)), labels.take(pa.array(some)), [Tree.build(x[:, p]).packed() for p in range(PARTS)], None)
            large = at + np.flatnonzero(~fits[at : at + rows])
            if len(large):
                # floor(4096 * x) of a double, without overflow
                exact = [[math.floor(v) * SCALE if abs(v) > 2.0**60 else math.floor(v * SCALE) for v in row] for row in vectors[large].tolist()]
                yield chunk(ids.take(pa.array(large)), labels.take(pa.array(large)), None, json.dumps(exact))

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield from chunks(held)
                held, n = [], 0
        if n:
            yield from chunks(held)

    return kept.select("vec_id", "label", "v").mapInArrow(run, schema)


def _digits(value: int):
    """A signed integer in digits of DIGIT bits, the lowest first; the last one bears the sign."""
    while not -(1 << DIGIT) < value < 1 << DIGIT:
        yield value & ((1 << DIGIT) - 1)
        value >>= DIGIT
    yield value


def _rounded(chunks: DataFrame, books: list[list[list[int]]]) -> list[list[list[int]]]:
    """The codebooks after one round."""
    width = len(books[0][0])

    def run(batches):
        shelf = [Codebook(b) for b in books]
        count, total = {}, {}

        def add(p, k, n, v):
            count[p, k] = count.get((p, k), 0) + n
            total[p, k] = [a + b for a, b in zip(total.get((p, k), [0] * width), v, strict=True)]

        for batch in batches:
            for trees, wide in zip(batch["trees"].to_pylist(), batch["wide"].to_pylist(), strict=True):
                for p, book in enumerate(shelf):
                    if trees is not None and book.ordinary:
                        n, v = Tree.unpacked(trees[p], width).totals(book.array)
                        for i in np.flatnonzero(n).tolist():
                            add(p, int(book.index[i]), int(n[i]), [int(a) for a in v[i].tolist()])
                    else:
                        for point in Tree.unpacked(trees[p], width).points.tolist() if trees is not None else [r[p * width : (p + 1) * width] for r in json.loads(wide)]:
                            add(p, _nearest_of(point, book.entries)[1], 1, point)
        rows = [(p, k, -1, 0, n) for (p, k), n in count.items()]
        rows += [(p, k, at, d, x) for (p, k), v in total.items() for at, value in enumerate(v) for d, x in enumerate(_digits(value))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * 5, ["part", "entry", "at", "digit", "x"])

    sums = chunks.select("trees", "wide").mapInArrow(run, "part long, entry long, at long, digit long, x long")
    # At most PARTS * ENTRIES * (width + 1) rows a digit, whatever the table holds.
    rows = sums.groupBy("part", "entry", "at", "digit").agg(F.sum("x").alias("x")).collect()
    value: dict[tuple[int, int, int], int] = {}
    for r in rows:
        key = (r.part, r.entry, r["at"])
        value[key] = value.get(key, 0) + (r.x << DIGIT * r.digit)
    return [
        [[value.get((p, k, at), 0) // value[p, k, -1] for at in range(width)] if (p, k, -1) in value else entry for k, entry in enumerate(book)]
        for p, book in enumerate(books)
    ]


def _coded(chunks: DataFrame, books: list[list[list[int]]], label: T.DataType) -> DataFrame:
    """vec_id, label, code and error of every vector."""
    width = len(books[0][0])

    def run(batches):
        shelf = [Codebook(b) for b in books]
        for batch in batches:
            for i in range(batch.num_rows):
                trees, wide = batch["trees"][i].as_py(), batch["wide"][i].as_py()
                ids, labels = batch["ids"][i].values, batch["labels"][i].values
                code, error = np.zeros((len(ids), PARTS), dtype=np.int64), [0] * len(ids)
                rows = json.loads(wide) if trees is None else None
                for p, book in enumerate(shelf):
                    if trees is not None and book.ordinary:
                        tree = Tree.unpacked(trees[p], width)
                        found = tree.codes(book.array)
                        points = np.empty((len(ids), width))
                        points[tree.order] = tree.points
                        code[:, p] = book.index[found]
                        own = ((points - book.array[found]) ** 2).sum(axis=1)
                        error = [a + int(b) for a, b in zip(error, own.tolist(), strict=True)]
                    else:
                        if trees is not None:
                            tree = Tree.unpacked(trees[p], width)
                            points = tree.points[np.argsort(tree.order)].tolist()
                        else:
                            points = [r[p * width : (p + 1) * width] for r in rows]
                        for j, point in enumerate(points):
                            own, code[j, p] = _nearest_of(point, book.entries)
                            error[j] += own
                yield pa.RecordBatch.from_arrays(
                    [ids, labels, pa.array(["".join(f"{c:02x}" for c in row) for row in code.tolist()]), pa.array([min(e, _LARGEST) for e in error], pa.int64())],
                    ["vec_id", "label", "code", "error"],
                )

    fields = [T.StructField("vec_id", T.LongType()), T.StructField("label", label), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]
    return chunks.mapInArrow(run, T.StructType(fields))


def _with_label_error(coded: DataFrame) -> DataFrame:
    """Adds the sum of errors over equal labels, nulls together."""
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LARGEST).cast("decimal(38,0)")).cast("long")
    sums = coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"), F.count(F.lit(1)).alias("rows"))
    sums, same = materialize(sums, "label-errors"), F.col("label").eqNullSafe(F.col("of"))
    if sums.count() <= FEW:
        return coded.join(F.broadcast(sums), same).drop("of", "rows")
    # Labels that hold a large share of the rows are at most HEAVY; the others are dealt by label.
    least = sums.agg(F.sum("rows")).first()[0] / HEAVY
    heavy = F.broadcast(sums.where(F.col("rows") > least))
    return coded.join(heavy, same).unionByName(coded.join(heavy, same, "left_anti").join(sums, same)).drop("of", "rows")


def compress(vectors: DataFrame) -> tuple[DataFrame, list[list[list[int]]]]:
    """(vec_id, label, code, error, label_error) of every kept vector, and the codebooks."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    kept = vectors.select("vec_id", "label", "embedding").where("size(embedding) > 0").where(F.size("embedding") % PARTS == 0).where(finite)
    kept = kept.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "v").select(F.size("v").alias("n")).first()
    dim = first.n if first else PARTS
    kept = kept.where(F.size("v") == dim)
    seeds = kept.orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).select("v").collect()  # ENTRIES vectors
    whole = [[math.floor(x) * SCALE if abs(x) > 2.0**60 else math.floor(x * SCALE) for x in s.v] for s in seeds]
    width = dim // PARTS
    books = [[row[p * width : (p + 1) * width] for row in whole] for p in range(PARTS)]
    if not seeds:
        none = kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return none, books
    chunks = materialize(_trees(kept, dim), "trees")
    for _ in range(ROUNDS):
        books = _rounded(chunks, books)
    coded = materialize(_coded(chunks, books, kept.schema["label"].dataType), "codes")
    return _with_label_error(coded), books


def digest_of(books: list[list[list[int]]]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def op11_vector_codes(spark, sf_dir):
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest_of(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds as common table expressions, each over all parts and entries."""
    nearest = """
        SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d
        FROM (SELECT x.vec_id, x.part, b.entry, sum((x.v - b.v) * (x.v - b.v)) AS d
              FROM x JOIN {book} b ON x.part = b.part AND x.pos = b.pos GROUP BY ALL) GROUP BY ALL"""
    steps = [f"""kept AS (SELECT vec_id, label, embedding FROM embeddings
          WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        x AS MATERIALIZED (SELECT vec_id, (i - 1) // (n // {PARTS}) AS part, (i - 1) % (n // {PARTS}) AS pos, floor({SCALE} * embedding[i]::DOUBLE)::BIGINT AS v
          FROM (SELECT *, len(embedding) AS n, unnest(range(1, len(embedding) + 1)) AS i FROM kept)),
        b0 AS MATERIALIZED (SELECT part, entry, pos, v FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry
          FROM (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES})) USING (vec_id))"""]  # fmt: skip
    for r in range(ROUNDS):
        steps.append(f"""a{r} AS MATERIALIZED ({nearest.format(book=f"b{r}")}),
        b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN
          (SELECT part, entry, pos, CASE WHEN sum(x.v) % count(*) < 0 THEN sum(x.v) // count(*) - 1 ELSE sum(x.v) // count(*) END::BIGINT AS v
           FROM x JOIN a{r} USING (vec_id, part) GROUP BY ALL) m USING (part, entry, pos))""")  # fmt: skip
    return f"""WITH {", ".join(steps)},
        last AS MATERIALIZED ({nearest.format(book=f"b{ROUNDS}")}),
        coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM last GROUP BY vec_id)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
          (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos)) FROM b{ROUNDS}) AS codebooks_sha256
        FROM coded JOIN kept USING (vec_id)"""


QUERIES = {"op11_vector_codes": (op11_vector_codes, _sql())}
