"""Substring dedup with a count-min prefilter.

A window is ``size`` consecutive words of one document. Rows are dealt into chunks by their id and
text; every exchange below is between chunks and shards of the hash space, so a window that a third
of all documents share is one entry per chunk.

1. Sketch: each chunk adds its windows to a partial count-min sketch of ``ROWS`` rows, split into
   shards and sent as the sorted cells that are not zero (the width grows with the corpus, so the
   load of a cell does not). Each shard merges its partial sketches and answers every chunk with one
   bit per cell sent: does the merged cell count two or more? A count-min estimate is never
   too low, so no repeated window is lost.
2. Exact count: a chunk sends only windows estimated repeated, as 128-bit hashes with the smallest
   document that starts them; shards group them and answer with one bit: is there a smaller
   document elsewhere? The chunk's own estimates travel along as bits and are not computed again.
3. Removal: a chunk marks the words of windows that a smaller document has.

The identity of a window is a 128-bit hash of two independent halves, built from 128 bits of every
word by nonlinear steps (no sums of powers, so no pattern of letters or words collides by construction).

A chunk holds 2 MB of text at least and a shard a million windows; both grow with the square root of
the corpus, to ``MOST`` times that (a task then holds about 20 bytes for each byte of its chunk), so that
messages between chunks and shards stay large for long: hundreds of windows at 1 TB. Beyond some 50 TB they
come down to a few windows, and an exchange costs a row for these. A longer document is a chunk of its own size.

Edge cases: a null text has no words; texts shorter than a window keep every word; windows repeated
within one document only are kept; repeated rows with one doc_id never remove each other's words;
a null doc_id counts as larger than every id; an empty table gives no rows. Many rows of one id, or
of none, are dealt by their texts; rows equal in id and text share a chunk. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.arrays import mix, window_hashes, word_hashes
from lexiloom.session import table

SIZE = 50
ROWS = 2
#: Bytes of text in a chunk, bytes of text a shard is planned for, and the most that both grow.
CHUNK_BYTES, SHARD_BYTES, MOST = 2 << 20, 4 << 20, 8
#: Cells of a sketch row for each byte of text, so that a word of 4 bytes or more has 4 cells or more.
CELLS = 1
_LAST = np.iinfo(np.int64).max
_ONE = np.uint64(1)


def _pack(values: np.ndarray) -> bytes:
    """Sorted unique unsigned values as differences of 1, 2, 4 or 8 bytes."""
    gaps = np.diff(values, prepend=values.dtype.type(0))
    used = next(n for n in (1, 2, 4, 8) if n == 8 or int(gaps.max(initial=0)) >> 8 * n == 0)
    return bytes([used]) + gaps.astype(f"<u{used}").tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob, f"<u{blob[0]}", -1, 1), dtype=np.uint64).astype(np.int64)


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, dtype=np.uint8), count=n).view(bool)


class _Plan:
    """Window size, shards as a power of two, and the bits of a shard's cell."""

    def __init__(self, total: int, size: int):
        grown = min(MOST, max(1.0, (total / (64 * CHUNK_BYTES)) ** 0.5))
        self.size, self.chunks = size, max(1, int(-(-total // (grown * CHUNK_BYTES))))
        self.shard_bits = max(0, int(-(-total // (grown * SHARD_BYTES)) - 1).bit_length())
        self.cell_bits = int(grown * SHARD_BYTES * CELLS - 1).bit_length()
        self.shards = 1 << self.shard_bits

    def cells(self, hashes: np.ndarray) -> np.ndarray:
        """The shard and the cell within it: the high bits of a hash."""
        return hashes >> np.uint64(64 - self.shard_bits - self.cell_bits)

    def cuts(self, sorted_cells: np.ndarray) -> np.ndarray:
        edges = np.arange(1, self.shards, dtype=np.uint64) << np.uint64(self.cell_bits)
        return np.concatenate(([0], np.searchsorted(sorted_cells, edges), [len(sorted_cells)])).tolist()


class _Chunk:
    """The distinct windows of one chunk's rows, sorted by their hashes."""

    def __init__(self, ids: np.ndarray, texts: list, plan: _Plan):
        self.plan, self.ids, size = plan, ids, plan.size
        self.raws = [t or b"" for t in texts]
        starts, _, *words = word_hashes(b" ".join(self.raws), 2)
        edges = np.concatenate(([0], np.cumsum([len(r) + 1 for r in self.raws])))
        first = np.searchsorted(starts, edges)
        del starts
        self.words = np.diff(first)
        windows = np.maximum(0, self.words - size + 1)
        self.doc, self.starts = np.repeat(np.arange(len(windows), dtype=np.int32), windows), np.concatenate(([0], np.cumsum(windows)))
        at = np.repeat((first[:-1] - self.starts[:-1]).astype(np.int32), windows)
        at += np.arange(len(at), dtype=np.int32)
        # One half at a time: arrays of a chunk's words are what a task's memory holds most of.
        b = window_hashes(words.pop(), size, 1)[at]
        a = window_hashes(words.pop(), size, 0)[at]
        del at
        order = np.argsort(a).astype(np.int32)
        a, b = a[order], b[order]
        same = a[1:] == a[:-1]
        if (same & (b[1:] != b[:-1])).any():  # equal first halves of different windows
            again = np.lexsort((b, a))
            order, a, b = order[again], a[again], b[again]
            same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        self.head = (np.flatnonzero(np.concatenate(([True], ~same))) if len(a) else np.empty(0)).astype(np.int32)
        self.times, self.order = np.diff(self.head, append=np.int32(len(a))), order
        self.a, self.b = a[self.head], b[self.head]

    def sketch(self):
        """For every row of the sketch: its sorted cells, their counts, and each window's place among them."""
        for row in range(ROWS):
            cell = self.plan.cells(mix(self.a ^ np.uint64(row), 1) if row else self.a)
            order = np.argsort(cell).astype(np.int32) if row else slice(None)  # the first row's cells are in order
            cell = cell[order]
            fresh = np.diff(cell, prepend=cell[:1] ^ _ONE) != 0
            place = np.empty(len(cell), dtype=np.int32)
            place[order] = np.cumsum(fresh, dtype=np.int32) - 1
            sent = cell[fresh]
            del cell, order
            yield sent, np.bincount(place, weights=self.times, minlength=len(sent)), place

    def estimated_repeated(self, answers: dict) -> np.ndarray:
        """The windows whose merged cells count two or more in every row of the sketch."""
        keep = np.ones(len(self.a), dtype=bool)
        for row, (sent, _, place) in enumerate(self.sketch()):
            keep &= _gathered(self.plan.cuts(sent), answers, row)[place]
        return keep

    def smallest(self) -> np.ndarray:
        """The smallest document that starts each window."""
        return np.minimum.reduceat(self.ids[self.doc[self.order]], self.head) if len(self.head) else np.empty(0, dtype=np.int64)


def _gathered(cuts: list, answers: dict, kind: int) -> np.ndarray:
    """The shards' answers of one kind for consecutive slices."""
    return np.concatenate([_flags(answers[kind, k], e - s) for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)) if e > s] or [np.empty(0, dtype=bool)])


def _table(schema, **columns):
    return pa.Table.from_arrays([pa.array(columns[n], t) for n, t in zip(schema.names, schema.types, strict=True)], schema=schema)


#: Kinds of messages: a row of the sketch, then the exact count, then a chunk's own estimates.
EXACT, OWN = ROWS, ROWS + 1
_PARTIAL = pa.schema([("kind", pa.int32()), ("shard", pa.int64()), ("chunk", pa.int64()), ("cells", pa.binary()), ("more", pa.binary())])
_ANSWER = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("shard", pa.int64()), ("bits", pa.binary())])
_CANDIDATE = pa.schema([("kind", pa.int32()), ("shard", pa.int64()), ("chunk", pa.int64()), ("first", pa.binary()), ("second", pa.binary()), ("doc", pa.binary())])
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def _of(t: pa.Table, plan: _Plan) -> _Chunk:
    return _Chunk(t["doc"].to_numpy(), t["text"].cast(pa.binary()).to_pylist(), plan)


def _partial_sketch(plan: _Plan):
    def run(key, t):
        out = {n: [] for n in _PARTIAL.names}
        for row, (sent, counts, _) in enumerate(_of(t, plan).sketch()):
            cell, cuts = sent & np.uint64((1 << plan.cell_bits) - 1), plan.cuts(sent)
            for shard, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if e > s:
                    for column, value in zip(out.values(), (row, shard, key[0].as_py(), _pack(cell[s:e]), _bits(counts[s:e] > 1)), strict=True):
                        column.append(value)
        return _table(_PARTIAL, **out)

    return run


def _merge_sketch(plan: _Plan):
    def run(key, t):
        cells = [_unpack(x.as_py()) for x in t["cells"]]
        once, more = np.zeros(1 << plan.cell_bits, dtype=bool), np.zeros(1 << plan.cell_bits, dtype=bool)
        for cell, blob in zip(cells, t["more"], strict=True):
            more[cell] |= once[cell] | _flags(blob.as_py(), len(cell))
            once[cell] = True
        n = t.num_rows
        return _table(_ANSWER, chunk=t["chunk"], kind=[key[0].as_py()] * n, shard=[key[1].as_py()] * n, bits=[_bits(more[c]) for c in cells])

    return run


def _answers(t: pa.Table) -> dict:
    return {(k, s): b for k, s, b in zip(*(t[c].to_pylist() for c in ("kind", "shard", "bits")), strict=True)}


def _candidates(plan: _Plan):
    def run(key, t, answers):
        out = {n: [] for n in _CANDIDATE.names}
        if t.num_rows:
            chunk, number = _of(t, plan), key[0].as_py()
            keep = chunk.estimated_repeated(_answers(answers))
            rows = [(OWN, -1 - number, number, _bits(keep), b"", b"")]
            a, b, doc = chunk.a[keep], chunk.b[keep], chunk.smallest()[keep]
            cuts = plan.cuts(plan.cells(a))
            for shard, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if e > s:
                    ids, place = np.unique(doc[s:e], return_inverse=True)
                    ids = len(ids).to_bytes(8, "little") + ids.astype("<i8").tobytes() + place.astype("<u2" if len(ids) <= 1 << 16 else "<u4").tobytes()
                    rows.append((EXACT, shard, number, a[s:e].astype("<u8").tobytes(), b[s:e].astype("<u8").tobytes(), ids))
            out = dict(zip(out, zip(*rows, strict=True), strict=True))
        return _table(_CANDIDATE, **out)

    return run


def _smaller_elsewhere(key, t):
    """For each chunk's windows of one shard: has another chunk a smaller document?"""
    kind, shard, n = key[0].as_py(), key[1].as_py(), t.num_rows
    if kind == OWN:
        return _table(_ANSWER, chunk=t["chunk"], kind=[kind] * n, shard=[-1] * n, bits=t["first"])
    a, b, doc, sizes = [], [], [], []
    for first, second, ids in zip(*(t[c].to_pylist() for c in ("first", "second", "doc")), strict=True):
        many, size = int.from_bytes(ids[:8], "little"), len(first) // 8
        known = np.frombuffer(ids, "<i8", many, 8)
        doc.append(known[np.frombuffer(ids, "<u2" if many <= 1 << 16 else "<u4", size, 8 + 8 * many)])
        a.append(np.frombuffer(first, "<u8"))
        b.append(np.frombuffer(second, "<u8"))
        sizes.append(size)
    a, b, doc = np.concatenate(a), np.concatenate(b), np.concatenate(doc)
    order = np.argsort(a)
    x, y = a[order], b[order]
    same = x[1:] == x[:-1]
    if (same & (y[1:] != y[:-1])).any():
        order = np.lexsort((b, a))
        x, y = a[order], b[order]
        same = (x[1:] == x[:-1]) & (y[1:] == y[:-1])
    new = np.concatenate(([True], ~same))
    least = np.minimum.reduceat(doc[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    smaller = np.empty(len(order), dtype=bool)
    smaller[order] = least < doc[order]
    bits = [_bits(x) for x in np.split(smaller, np.cumsum(sizes)[:-1])]
    return _table(_ANSWER, chunk=t["chunk"], kind=[kind] * n, shard=[shard] * n, bits=bits)


def _removal(plan: _Plan, digest: bool):
    """The result rows; ``digest``: with the kept text's digest in place of the text."""

    def run(key, t, answers):
        out = {n: [] for n in _RESULT.names}
        if t.num_rows:
            chunk, bits = _of(t, plan), _answers(answers)
            keep = _flags(bits[OWN, -1], len(chunk.a))
            smaller = np.zeros(len(keep), dtype=bool)
            smaller[keep] = _gathered(plan.cuts(plan.cells(chunk.a[keep])), bits, EXACT)
            gone = np.empty(len(chunk.order), dtype=bool)
            gone[chunk.order] = np.repeat(smaller, chunk.times)
            gone |= _behind(chunk)
            for i, (raw, n) in enumerate(zip(chunk.raws, chunk.words.tolist(), strict=True)):
                words, hit = raw.split(), gone[chunk.starts[i] : chunk.starts[i + 1]]
                if hit.any():
                    edge = np.zeros(n + 1, dtype=np.int64)
                    starts = np.flatnonzero(hit)
                    edge[starts] += 1
                    edge[starts + plan.size] -= 1
                    words = list(compress(words, (np.cumsum(edge[:-1]) == 0).tolist()))
                kept = b" ".join(words)
                out["doc_id"].append(None if chunk.ids[i] == _LAST else int(chunk.ids[i]))
                out["n_words"].append(n)
                out["n_removed"].append(n - len(words))
                out["kept"].append(hashlib.sha256(kept).hexdigest() if digest else kept.decode())
        return _table(_RESULT, **out)

    return run


def _behind(chunk: _Chunk) -> np.ndarray:
    """Windows that a smaller document of the same chunk starts too."""
    out = np.empty(len(chunk.order), dtype=bool)
    out[chunk.order] = np.repeat(chunk.smallest(), chunk.times) < chunk.ids[chunk.doc[chunk.order]]
    return out


def remove_repeats(docs: DataFrame, size: int = SIZE, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words (``kept``), or their digest (``kept_sha256``)."""
    plan = _Plan(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0, size)
    dealt = docs.select(
        F.coalesce("doc_id", F.lit(int(_LAST))).cast("long").alias("doc"),
        "text",
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(plan.chunks)).alias("chunk"),
    )
    ddl = lambda schema: ", ".join(
        f"{n} {({'int64': 'long', 'int32': 'int'}).get(str(t), str(t))}" for n, t in zip(schema.names, schema.types, strict=True)
    )
    by_chunk = dealt.groupBy("chunk")
    cells = by_chunk.applyInArrow(_partial_sketch(plan), ddl(_PARTIAL)).groupBy("kind", "shard").applyInArrow(_merge_sketch(plan), ddl(_ANSWER))
    windows = by_chunk.cogroup(cells.groupBy("chunk")).applyInArrow(_candidates(plan), ddl(_CANDIDATE))
    exact = windows.groupBy("kind", "shard").applyInArrow(_smaller_elsewhere, ddl(_ANSWER))
    out = by_chunk.cogroup(exact.groupBy("chunk")).applyInArrow(_removal(plan, digest), ddl(_RESULT))
    return out.withColumnRenamed("kept", "kept_sha256") if digest else out


def op6_substring_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"), digest=True)


QUERIES = {"op6_substring_dedup": (op6_substring_dedup, None)}
