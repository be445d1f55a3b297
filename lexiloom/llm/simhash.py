"""SimHash near-duplicates with anchor-point covering.

Fingerprints of 64 bits are linked at ``RADIUS`` = 2 or fewer differing bits. Of two fingerprints
that close, one of the two 32-bit halves differs in at most one bit. On each half, 31 bits are
covered by the code words of the perfect Hamming code (covering radius 1): these are the anchors.
A fingerprint's home is its one anchor within the covering radius; it is also replicated to every
anchor within covering radius plus the half's threshold, 1 + 1 = 2 bits: 15 more. If two
fingerprints differ in at most one bit of a half, the home of the first is within 2 bits of the
second, so comparing each home with all members of its anchor finds every link. Candidates are
verified on all 64 bits. The same anchors find all links at ``WIDER`` = 3 bits, since then too one of
the halves differs in at most one bit; the pipeline uses this radius.

Copies share one fingerprint and are one row here, whatever their number. Each anchor gives back
the links of a spanning forest, at most one a member, never its pairs. A crowded anchor is
compared through keys of the other half, one more than the radius (one of them agrees between any two
linked members), in blocks, so memory stays bounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.llm.components import connected_components
from lexiloom.session import materialize, table

RADIUS, WIDER = 2, 3
SHINGLE = 3
#: Members of an anchor above which it is compared through keys of the other half.
CROWD = 512
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WEIGHTS = np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))


def simhash(text: str | None) -> int:
    """The unsigned fingerprint of one text; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > SHINGLE:
        starts, ends = starts[: 1 - SHINGLE], ends[SHINGLE - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, weight = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), 4096):
        pairs = zip(starts[at : at + 4096].tolist(), ends[at : at + 4096].tolist(), strict=True)
        h = np.array([digest(joined[s:e], 42) for s, e in pairs], dtype="<u8")
        weight += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_WEIGHTS[2 * weight > len(starts)].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and its fingerprint as a signed long; a null text has fingerprint zero."""

    def run(batches):
        for batch in batches:
            fp = np.array([simhash(t.as_py()) for t in batch["text"]], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(fp)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def with_fingerprint(rows: DataFrame) -> DataFrame:
    """The rows, given as structs ``row``, and their fingerprint as ``row_fp``."""

    def run(batches):
        for batch in batches:
            fp = np.array([simhash(t.as_py()) for t in batch["row"].field("text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(fp)], ["row", "row_fp"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("row_fp", T.LongType())]))


def _half(fp, which: int):
    return F.shiftrightunsigned(fp, 32 * which).bitwiseAND(F.lit(0x7FFFFFFF))


def _syndrome(x):
    """XOR of the positions (1 to 31) of the set bits: 0 for a code word."""
    out = F.lit(0)
    for k in range(5):
        mask = sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1)
        out = out + F.shiftleft(F.bit_count(x.bitwiseAND(F.lit(mask))).bitwiseAND(F.lit(1)), k)
    return out


def replicas(reps: DataFrame) -> DataFrame:
    """(half, anchor, home, fp, id) for every anchor that a fingerprint is replicated to."""
    halves = reps.select("fp", "id", F.explode(F.array(F.lit(0), F.lit(1))).alias("half")).withColumn(
        "x", F.when(F.col("half") == 0, _half(F.col("fp"), 0)).otherwise(_half(F.col("fp"), 1))
    )
    halves = halves.withColumn("s", _syndrome(F.col("x")))
    # Position p = 0 stands for the home: the code word reached by flipping the syndrome's bit.
    spots = F.expr("filter(sequence(0, 31), p -> p = 0 OR (s > 0 AND p <> s AND p < (p ^ s)))")
    flip = lambda p: f"CASE WHEN {p} > 0 THEN shiftleft(1L, {p} - 1) ELSE 0L END"
    return halves.withColumn("p", F.explode(spots)).selectExpr(
        "half", f"x ^ ({flip('p')}) ^ ({flip('(p ^ s)')}) AS anchor", "p = 0 AS home", "fp", "id"
    )


def _close(fp: np.ndarray, home: np.ndarray, radius: int):
    """Blocks of index pairs (home, member) with at most ``radius`` differing bits."""
    homes = np.flatnonzero(home)
    step = max(1, (1 << 20) // max(1, len(fp)))
    for at in range(0, len(homes), step):
        part = homes[at : at + step]
        i, j = np.nonzero(np.bitwise_count(fp[part][:, None] ^ fp[None, :]) <= radius)
        yield part[i], j


def _forest(fp: np.ndarray, home: np.ndarray, half: int, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Index pairs of a spanning forest of the links within one anchor."""
    parent = list(range(len(fp)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(blocks, index=None):
        for i, j in blocks:
            if index is not None:
                i, j = index[i], index[j]
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)

    if len(fp) <= CROWD:
        join(_close(fp, home, radius))
    else:
        rest = (fp >> np.uint64(32 * (1 - half))) & np.uint64(0xFFFFFFFF)
        cuts_at = [32 * n // (radius + 1) for n in range(radius + 2)]
        for shift, upto in zip(cuts_at, cuts_at[1:], strict=False):
            key = (rest >> np.uint64(shift)) & np.uint64((1 << (upto - shift)) - 1)
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.diff(key[order])) + 1
            for index in np.split(order, cuts):
                if len(index) > 1:
                    join(_close(fp[index], home[index], radius), index)
    return [(x, root(x)) for x in range(len(fp)) if root(x) != x]


def _links_of(batches, radius: int = RADIUS):
    """Links of rows sorted by (half, anchor); an anchor may run over several batches."""
    rest: list = []  # batches of the anchor that may go on
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def emit(cols, upto):
        half, anchor, home, fp, ids = cols
        change = (np.diff(anchor[:upto]) != 0) | (np.diff(half[:upto]) != 0)
        cuts = np.concatenate(([0], np.flatnonzero(change) + 1, [upto]))
        sizes = np.diff(cuts)
        a, b = [], []
        for g in np.flatnonzero(sizes > 1):
            s, e = cuts[g], cuts[g + 1]
            if home[s:e].any():
                for x, y in _forest(fp[s:e], home[s:e], int(half[s]), radius):
                    a.append(int(ids[s + x]))
                    b.append(int(ids[s + y]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    for batch in batches:
        cols = [batch["half"].to_numpy(), batch["anchor"].to_numpy(), batch["home"].to_numpy(zero_copy_only=False),
                batch["fp"].to_numpy().view(np.uint64), batch["id"].to_numpy()]
        if not len(cols[0]):
            continue
        if rest and all(c[0] == r[-1] and c[-1] == r[-1] for c, r in zip(cols[:2], rest[-1][:2], strict=True)):
            rest.append(cols)  # sorted, so all of it is the same anchor
            continue
        cols = [np.concatenate(x) for x in zip(*rest, cols, strict=True)]
        new = np.flatnonzero((cols[1] != cols[1][-1]) | (cols[0] != cols[0][-1]))
        upto = int(new[-1]) + 1 if len(new) else 0
        if upto:
            yield emit(cols, upto)
        rest = [[x[upto:] for x in cols]]
    if rest:
        cols = [np.concatenate(x) for x in zip(*rest, strict=True)]
        yield emit(cols, len(cols[0]))


def near_components(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id of a table of fingerprints (doc_id, fp) that is cheap to reread."""
    if radius > WIDER:
        raise ValueError(f"the anchors find links of at most {WIDER} bits")
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("id")).where("id IS NOT NULL")
    links = replicas(reps).repartition("half", "anchor").sortWithinPartitions("half", "anchor").mapInArrow(lambda batches: _links_of(batches, radius), "a long, b long")
    moved = connected_components(links)
    by_fp = (
        reps.join(moved, F.col("id") == F.col("node"), "left")
        .select(F.col("fp").alias("f"), F.coalesce("component", "id").alias("component_id"))
    )
    return fps.join(by_fp, F.col("fp") == F.col("f"), "left").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document.

    Null and empty texts, and texts without words, have fingerprint zero and are linked like any
    other; fewer words than a shingle are one shingle; repeated rows share a fingerprint and a
    component; a null doc_id keeps its row and takes part as a member, never as the smallest id; an
    empty table gives no rows. Only doc_id and text are read.
    """
    found = near_components(materialize(fingerprints(docs), "fingerprints"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, radius: int = WIDER) -> DataFrame:
    """The document with the smallest id of every group of near-duplicates, with all its columns.

    Of repeated rows of one id the smallest text stays; a row without an id stays if nothing in its
    group has one. Rows travel as one struct, so no column's name matters.
    """
    found = near_components(materialize(fingerprints(docs), "fingerprints"), radius)
    gone = found.where("doc_id IS NOT NULL AND component_id < doc_id").select(F.col("doc_id").alias("gone_id")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    kept = rows.where("row.doc_id IS NOT NULL").join(gone, F.col("row.doc_id") == F.col("gone_id"), "left_anti")
    nth = F.row_number().over(Window.partitionBy("row.doc_id").orderBy("row.text"))
    kept = kept.withColumn("nth", nth).where("nth = 1").select("row")
    # Rows without an id, which are rare: one for each fingerprint that no document with an id is near.
    lone = found.where("doc_id IS NULL AND component_id IS NULL").select(F.col("fp").alias("lone_fp")).distinct()
    unnamed = with_fingerprint(rows.where("row.doc_id IS NULL")).join(lone, F.col("row_fp") == F.col("lone_fp"), "left_semi")
    nth = F.row_number().over(Window.partitionBy("row_fp").orderBy("row.text"))
    unnamed = unnamed.withColumn("nth", nth).where("nth = 1").select("row")
    return kept.unionByName(unnamed).select("row.*")


def op10_simhash_components(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op10_simhash_components": (op10_simhash_components, None)}
