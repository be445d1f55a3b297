"""Near copies beyond SimHash's reach, by sketches of shingles.

The distinct five-word shingles of a text are dealt into ``GROUPS`` groups by their hash, those of a text of
``LONG`` or more into ``MORE`` groups as well; a sketch is the sum of a group's hashes. An edit changes the sketches of the few groups that its shingles fall into, so edited
copies keep some sketch, while unrelated texts share none. Documents that share a sketch are compared with
the one of the smallest id that has it, so a sketch of any number of documents gives no more pairs than
documents; pairs are then verified on all shingles: ``SIMILAR`` or more of those that either has.

No pair below ``SIMILAR`` is linked. Pairs at or above it are missed if they share no sketch, or if the document
of the smallest id that shares it is similar to neither: at ``SIMILAR`` itself a copy of 300 shingles keeps one
of its sketches with odds of 0.97.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.arrays import mix, window_hashes, word_hashes
from lexiloom.llm.components import connected_components
from lexiloom.session import materialize

SHINGLE, SIMILAR = 5, 0.8
#: Both numbers of groups are powers of two.
GROUPS, MORE, LONG = 32, 128, 250
#: Rows of sketches that are handed on together.
HELD = 1 << 15
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles(text: str | None) -> np.ndarray:
    """Distinct hashes of the runs of five words, in order; a shorter text is one run, one without words has none."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))[2]
    return np.unique(window_hashes(words, min(SHINGLE, len(words)))) if len(words) else words


def sketches(docs: DataFrame) -> DataFrame:
    """(id, n, part, sketch): a row for each group that holds some of a text's ``n`` shingles."""
    def parts(h):
        """(part, sketch) of the groups; the hashes are sorted, so groups follow each other."""
        for groups, offset in ((GROUPS, 0), (MORE, GROUPS)):
            if groups == GROUPS or len(h) >= LONG:
                part = (h >> np.uint64(65 - groups.bit_length())).astype(np.int32)
                first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
                yield part[first] + offset, np.add.reduceat(mix(h), first).view(np.int64)

    def packed(out):
        arrays = [pa.array(np.concatenate([np.zeros(0, dtype=kind), *c]).astype(kind)) for c, kind in zip(out, (np.int64, np.int64, np.int32, np.int64), strict=True)]
        return pa.RecordBatch.from_arrays(arrays, ["id", "n", "part", "sketch"])

    def run(batches):
        for batch in batches:
            out, held = [[], [], [], []], 0
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                h = shingles(text.as_py())
                for part, sums in parts(h) if len(h) else ():
                    for column, values in zip(out, (np.full(len(part), doc_id), np.full(len(part), len(h)), part, sums), strict=True):
                        column.append(values)
                    held += len(part)
                if held > HELD:
                    yield packed(out)
                    out, held = [[], [], [], []], 0
            yield packed(out)

    return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "id long, n long, part int, sketch long")


def similar_pairs(docs: DataFrame) -> DataFrame:
    """(a, b) of documents, by id, that share a sketch with each other and ``SIMILAR`` of their shingles."""
    rows = materialize(sketches(docs), "sketches")
    first = rows.groupBy("part", "sketch").agg(F.min(F.struct("id", "n")).alias("m"), F.count(F.lit(1)).alias("docs")).where("docs > 1").select("part", "sketch", F.col("m.id").alias("a"), F.col("m.n").alias("a_n"))
    pairs = rows.join(first, ["part", "sketch"]).where("id <> a").where(F.least("n", "a_n") >= SIMILAR * F.greatest("n", "a_n"))
    pairs = materialize(pairs.select("a", F.col("id").alias("b")).distinct(), "sketch-pairs")
    texts = docs.select(F.col("doc_id").cast("long").alias("a"), F.col("text").alias("a_text"))
    other = docs.select(F.col("doc_id").cast("long").alias("b"), F.col("text").alias("b_text"))

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch["a_text"], batch["b_text"], strict=True):
                p, q = shingles(x.as_py()), shingles(y.as_py())
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= SIMILAR * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(texts, "a").join(other, "b").select("a", "b", "a_text", "b_text").mapInArrow(run, "a long, b long")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The document with the smallest id of every group of similar ones, with all its columns.

    Takes one row an id, as :func:`lexiloom.llm.simhash.one_of_each_group` gives them; rows without an id and
    texts without words stay. Rows travel as one struct, so no column's name matters; an empty table gives no rows.
    """
    found = connected_components(similar_pairs(docs))
    gone = found.where("component < node").select(F.col("node").alias("gone"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return rows.join(gone, F.col("row.doc_id").cast("long") == F.col("gone"), "left_anti").select("row.*")
