"""Benchmark decontamination with a BM25 index of the test items and block-max WAND.

Every training passage is a query against an inverted index of the test items. An item's score is
its BM25 score for the passage's words divided by its score for its own words, so one threshold
(``THRESHOLD``) suits items of every length. Items are indexed in classes of length (up to 64
words, 128, 256, ...); a class's passages are twice its length and overlap by half, so any text as
long as an item lies whole in one of them, and one long item does not lengthen the passages that
short items are compared with. All items at or above the threshold are retrieved:

* The words that most items share are "non-essential": no item gets beyond a part of the threshold
  on them alone. A passage whose other, essential words cannot lift it to the threshold, even with
  the greatest contribution of each word in the whole index, is skipped without reading a posting.
* Items of similar words are neighbours, in blocks of ``BLOCK``. For the passages left, the greatest
  contributions of their essential words in each block are summed, a batch of texts at a time; a
  block's non-essential words add what they can give in that block at most. A passage no block of
  which can reach the threshold is skipped.
* The others run document-at-a-time WAND: cursors ordered by item, a pivot from the words' greatest
  contributions, blocks skipped by their own maxima, exact scores last.

All steps only use upper bounds, so nothing at or above the threshold is lost. Retrieved items are
then verified on their words: three-word runs of the item's question part and of its answer part
must each be covered by the document's passage to ``OVERLAP`` or more. An item's question is its
text up to the last question mark, else its first half of words; its answer is the rest.

The index of the test items is sent to every executor; its size follows the benchmark, not the
corpus, and is checked against ``INDEX_LIMIT``: a larger benchmark is indexed in slices that fit,
one pass each. Word frequencies and the mean length are those of the whole benchmark in every slice,
and passages follow an item's class alone, so slicing changes no score and no result.

Edge cases: words are runs of letters, digits and underscores after lower-casing, so case,
punctuation and white space do not matter; null and empty texts match nothing; empty items, and
null ones, match nothing; repeated items (same id and text) are indexed once and reported each; repeated
documents too; an empty table
on either side gives no rows. Only doc_id and text, item_id and text are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import reduce
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.arrays import word_hashes
from lexiloom.session import discard, materialize, table

K1, B = 1.2, 0.75
THRESHOLD, OVERLAP, RUN = 0.5, 0.5, 3
#: Items in a block, words of the shortest class of items, and the part of the threshold that
#: non-essential words may give.
BLOCK, SPAN, SHARED = 2, 64, 0.6
#: Bytes of normalised text that are compared at a time.
BATCH = 1 << 19
#: Bytes of item text that one index may hold.
INDEX_LIMIT = 16 << 20
#: ASCII bytes that separate words; all others, and every non-ASCII byte, belong to words.
_ASCII = bytes(c if c > 127 or chr(c).isalnum() or c == 95 else 32 for c in range(256))
_ODD = re.compile(r"[^\w\x00-\x7f]+")
_EPSILON = 1e-9


def normalized(text: str | None) -> bytes:
    """Lower-cased UTF-8 with one space for every run of other characters than letters and digits."""
    low = (text or "").lower()
    if not low.isascii():
        low = _ODD.sub(" ", low)
    return low.encode("utf-8", "surrogatepass").translate(_ASCII)


def _parts(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """The words of an item's question and of its answer."""
    cut = (text or "").rfind("?")
    question, answer = normalized((text or "")[: cut + 1]).split(), normalized((text or "")[cut + 1 :]).split()
    if not question or not answer:
        words = question or answer
        question, answer = words[: len(words) // 2], words[len(words) // 2 :]
    return question, answer


def _runs(words: list[bytes]) -> set[bytes]:
    n = min(RUN, len(words))
    return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def _starts(sizes: np.ndarray) -> np.ndarray:
    """Where each of consecutive runs of these sizes starts, and the end of the last."""
    return np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All the numbers of the ranges, one after the other."""
    return np.repeat(starts - _starts(sizes)[:-1], sizes) + np.arange(sizes.sum())


class Statistics:
    """Number and mean length of all items, and the number of items of each word."""

    def __init__(self, count: int, mean: float, terms: np.ndarray, df: np.ndarray):
        order = np.argsort(terms)
        self.count, self.mean, self.terms, self.df = count, mean, terms[order], df[order]

    def idf(self, terms: np.ndarray) -> np.ndarray:
        n = self.df[np.searchsorted(self.terms, terms)]
        return np.log1p((self.count - n + 0.5) / (n + 0.5))


class _Class:
    """The postings of items of one class of length; terms are numbers of the whole index."""

    def __init__(self, span: int, width: int, item, term, share, items: int, threshold: float):
        order = np.lexsort((item, term))
        self.span, self.need = span, threshold - _EPSILON
        self.item, self.share, term = item[order], share[order], term[order]
        self.ptr = np.searchsorted(term, np.arange(width + 1))
        some = np.flatnonzero(np.diff(self.ptr))
        self.top = np.zeros(width)
        self.top[some] = np.maximum.reduceat(self.share, self.ptr[some])
        # Greatest contribution of each word in each block of items that has it.
        self.blocks = -(-items // BLOCK)
        key = term * self.blocks + self.item // BLOCK
        head = np.flatnonzero(np.diff(key, prepend=-1))
        self.block_top, self.block_of = np.maximum.reduceat(self.share, head), (self.item // BLOCK)[head]
        self.block_ptr = np.searchsorted(term[head], np.arange(width + 1))
        # Non-essential: the most shared words, as long as no item gets far on them alone.
        held, essential = np.zeros(items), np.ones(width, dtype=bool)
        for t in some[np.argsort(-np.diff(self.ptr)[some], kind="stable")].tolist():
            part = slice(self.ptr[t], self.ptr[t + 1])
            if (held[self.item[part]] + self.share[part]).max() > SHARED * threshold:
                break
            essential[t] = False
            held[self.item[part]] += self.share[part]
        self.base = np.maximum.reduceat(held, np.arange(0, items, BLOCK))
        # One place more, for words of no item.
        self.lift = np.append(np.where(essential, self.top, 0.0), 0.0)
        self._lists: dict = {}

    def postings(self, t: int):
        """Items and contributions of a word, and its greatest contribution by block."""
        known = self._lists.get(t)
        if known is None:
            part, heads = slice(self.ptr[t], self.ptr[t + 1]), slice(self.block_ptr[t], self.block_ptr[t + 1])
            blocks = dict(zip(self.block_of[heads].tolist(), self.block_top[heads].tolist(), strict=True))
            known = self._lists[t] = (self.item[part].tolist(), self.share[part].tolist(), blocks)
        return known

    def passages(self, terms: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, first word, end) of the passages whose bounds reach the threshold.

        ``first`` holds the number of each text's first word and, last, the number of words. A text's
        words are dealt into cells of ``span`` words; a passage is two neighbouring cells.
        """
        hits = np.flatnonzero(self.lift[terms] > 0)
        if not len(hits):
            return []
        width, most = len(self.lift), self.base.max()
        cells = -(-np.diff(first) // self.span)
        cell_ptr = _starts(cells)
        text = np.searchsorted(first, hits, side="right") - 1
        cell = cell_ptr[text] + (hits - first[text]) // self.span
        key = np.unique(cell * width + terms[hits])
        cell, term = key // width, key % width
        lift = np.bincount(cell, weights=self.lift[term], minlength=cell_ptr[-1] + 1)
        last = np.zeros(len(lift), dtype=bool)
        last[cell_ptr[1:][cells > 0] - 1] = True
        pair = lift[:-1] + np.where(last[:-1], 0.0, lift[1:])
        head = pair + most >= self.need
        # A text's last cell is part of the passage before it, if there is one.
        head[cell_ptr[1:][cells > 1] - 1] = False
        head = np.append(head, False)
        # The distinct essential words of every such passage, from its two cells.
        mine, before = head[cell], head[cell - 1] & (cell > 0) & ~last[cell - 1]
        key = np.unique(np.concatenate((key[mine], key[before] - width)))
        cell, term = key // width, key % width
        many = self.block_ptr[term + 1] - self.block_ptr[term]
        at = _ranges(self.block_ptr[term], many)
        spot, row = np.unique(np.repeat(cell, many) * self.blocks + self.block_of[at], return_inverse=True)
        bound = np.bincount(row, weights=self.block_top[at], minlength=len(spot)) + self.base[spot % self.blocks]
        found = np.unique(spot[bound >= self.need] // self.blocks)
        if most >= self.need:  # SHARED above 1: no word is essential to some items
            found = np.flatnonzero(head)
        text = np.searchsorted(cell_ptr, found, side="right") - 1
        start = first[text] + (found - cell_ptr[text]) * self.span
        return list(zip(text.tolist(), start.tolist(), np.minimum(start + 2 * self.span, first[text + 1]).tolist(), strict=True))

    def wand(self, terms: list[int]) -> list[tuple[int, float]]:
        """All (item, score) at or above the threshold for a passage with these distinct terms."""
        have = {t: self.postings(t) for t in terms if self.ptr[t] < self.ptr[t + 1]}
        top = {t: float(self.top[t]) for t in have}
        cursors = [(have[t][0][0], t) for t in have]
        heapify(cursors)
        found = []
        while cursors:
            # Pivot: the first item that the greatest contributions could lift to the threshold.
            taken, bound = [], 0.0
            while cursors and bound < self.need:
                taken.append(heappop(cursors))
                bound += top[taken[-1][1]]
            if bound < self.need:
                break
            pivot = taken[-1][0]
            while cursors and cursors[0][0] == pivot:
                taken.append(heappop(cursors))
            block = pivot // BLOCK
            if sum([have[t][2].get(block, 0.0) for _, t in taken]) >= self.need:
                at = [(have[t], bisect_left(have[t][0], pivot)) for _, t in taken]
                score = sum([x[1][p] for x, p in at if p < len(x[0]) and x[0][p] == pivot])
                if score >= self.need:
                    found.append((pivot, score))
                beyond = pivot + 1
            else:
                # No item of the block can reach it with these words, up to the next cursor.
                beyond = max(pivot + 1, min([(block + 1) * BLOCK] + [c[0] for c in cursors[:1]]))
            for _, t in taken:
                p = bisect_left(have[t][0], beyond)
                if p < len(have[t][0]):
                    heappush(cursors, (have[t][0][p], t))
        return found


class Index:
    """Inverted index of items with normalised BM25 contributions and block maxima."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD, whole: Statistics | None = None):
        """``whole``: the statistics of all items, where ``items`` are a slice."""
        parts = [(i, *map(b" ".join, _parts(t))) for i, t in items]
        parts = [p for p in parts if p[1] or p[2]]
        raws = [p[1] + b" " + p[2] for p in parts]
        starts, _, hashes = word_hashes(b" ".join(raws))
        of = np.searchsorted(_starts(np.array([len(r) + 1 for r in raws], dtype=np.int64)), starts, side="right") - 1
        self.terms, term = np.unique(hashes, return_inverse=True)
        length, width = np.bincount(of, minlength=len(parts)), len(self.terms)
        key, times = np.unique(of * width + term, return_counts=True)
        of, term = key // max(1, width), key % max(1, width)
        df = np.bincount(term, minlength=width)
        whole = whole or Statistics(len(parts), length.mean() if len(parts) else 1.0, self.terms, df)
        norm = K1 * (1 - B + B * length / whole.mean)
        score = whole.idf(self.terms)[term] * times * (K1 + 1) / (times + norm[of])
        share = score / np.bincount(of, weights=score, minlength=len(parts))[of]
        # Items with the same most shared words, mostly of one language, become neighbours.
        order = np.lexsort((term, -df[term], of))
        ptr = _starts(np.bincount(of, minlength=len(parts)))
        most = [order[np.minimum(ptr[:-1] + k, ptr[1:] - 1)] for k in range(3)] if len(parts) else []
        rank = np.lexsort([x for k in most[::-1] for x in (term[k], -df[term[k]])]) if len(parts) else np.empty(0, dtype=np.int64)
        size = np.maximum(SPAN, 1 << np.ceil(np.log2(np.maximum(length, 1))).astype(np.int64))
        self.classes, self.members = [], []
        for span in np.unique(size).tolist():
            mine = rank[size[rank] == span]
            place = np.full(len(parts), -1)
            place[mine] = np.arange(len(mine))
            used = place[of] >= 0
            self.classes.append(_Class(span, width, place[of][used], term[used], share[used], len(mine), threshold))
            self.members.append([parts[i] for i in mine.tolist()])
        # Terms by the low bits of their hash: the first of each slot, then the next of the same slot.
        self.slots = np.uint64((1 << max(10, (8 * width).bit_length())) - 1)
        slot = (self.terms & self.slots).astype(np.int64)
        self.first, self.next = np.full(int(self.slots) + 1, width), np.full(width + 1, width)
        for t in range(width):
            self.next[t], self.first[slot[t]] = self.first[slot[t]], t
        self.terms = np.append(self.terms, np.uint64(0))
        self._runs: dict = {}

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """The term number of every word; the number of terms for words that no item has."""
        term, none = self.first[(hashes & self.slots).astype(np.int64)], len(self.terms) - 1
        while True:
            other = np.flatnonzero((term < none) & (self.terms[term] != hashes))
            if not len(other):
                return term
            term[other] = self.next[term[other]]

    def runs(self, k: int, item: int):
        known = self._runs.get((k, item))
        if known is None:
            known = self._runs[k, item] = tuple(_runs(raw.split()) for raw in self.members[k][item][1:])
        return known

    def matches(self, texts: list):
        """(text number, {(class, item): (score, question share, answer share)}) of texts with verified items."""
        at, held, part = 0, 0, []
        for text in texts:
            part.append(normalized(text))
            held += len(part[-1])
            if held >= BATCH:
                yield from self._matches(part, at)
                at, held, part = at + len(part), 0, []
        yield from self._matches(part, at)

    def _matches(self, raws: list[bytes], number: int):
        raw = b" ".join(raws)
        starts, ends, hashes = word_hashes(raw)
        if not len(self.terms) > 1 or not len(hashes):
            return
        terms = self.lookup(hashes)
        first = np.searchsorted(starts, _starts(np.array([len(r) + 1 for r in raws], dtype=np.int64)))
        found: dict = {}
        for k, group in enumerate(self.classes):
            for text, s, e in group.passages(terms, first):
                distinct = np.unique(terms[s:e])
                hits = group.wand(distinct[distinct < len(self.terms) - 1].tolist())
                if not hits:
                    continue
                words = raw[starts[s] : ends[e - 1]].split()
                runs = {n: {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} for n in range(1, RUN + 1)}
                best = found.setdefault(text, {})
                for item, score in hits:
                    share = [sum(r in runs[r.count(b" ") + 1] for r in part) / len(part) if part else 1.0 for part in self.runs(k, item)]
                    if min(share) >= OVERLAP and ((k, item) not in best or best[k, item][0] < score):
                        best[k, item] = (score, *share)
        for text in sorted(found):
            if found[text]:
                yield number + text, found[text]


def _words(items: DataFrame) -> DataFrame:
    """The distinct words of every item as signed hashes, and one row with a null word and its length."""
    schema = pa.schema([("term", pa.int64()), ("length", pa.int64())])

    def run(batches):
        for batch in batches:
            terms, lengths = [], []
            for text in batch["text"].to_pylist():
                question, answer = _parts(text)
                if question or answer:
                    hashes = word_hashes(b" ".join(question + answer))[2]
                    distinct = np.unique(hashes).view(np.int64).tolist()
                    terms += [None, *distinct]
                    lengths += [len(hashes), *[None] * len(distinct)]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(lengths, pa.int64())], schema=schema)

    return items.select("text").mapInArrow(run, "term long, length long")


def _indexes(docs: DataFrame, items: DataFrame, threshold: float):
    """Broadcast indexes of the items: one, or as many as keep each within ``INDEX_LIMIT``."""
    # Copies of one item are one row, so no slice grows with them.
    rows = items.where("text IS NOT NULL").groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices, whole, counts = max(1, -(-size // INDEX_LIMIT)), None, None
    if slices > 1:
        count, total = _words(rows).where("term IS NULL").agg(F.count(F.lit(1)), F.sum("length")).first()
        counts = materialize(_words(rows).where("term IS NOT NULL").groupBy("term").agg(F.count(F.lit(1)).alias("n")), "item-words")
    for k in range(slices):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k)
        if slices > 1:
            used = counts.join(_words(part).select("term").distinct(), "term").toPandas()
            whole = Statistics(count, (total or 0) / max(1, count), used["term"].to_numpy(np.int64).view(np.uint64), used["n"].to_numpy())
        items_of = [((r.item_id, r.copies), r.text) for r in part.orderBy("item_id", "text").collect()]
        yield docs.sparkSession.sparkContext.broadcast(Index(items_of, threshold, whole))
    if counts is not None:
        discard(counts)


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per (document, item) leak: doc_id, item_id, score, question_overlap, answer_overlap."""
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()),
                        ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])
    found = []
    for index in _indexes(docs, items, threshold):

        def run(batches, index=index):
            for batch in batches:
                out = [[] for _ in schema.names]
                ids = batch["doc_id"]
                for at, items in index.value.matches(batch["text"].to_pylist()):
                    for (k, item), rest in sorted(items.items()):
                        item_id, copies = index.value.members[k][item][0]
                        for column, value in zip(out, (ids[at].as_py(), item_id, *rest), strict=True):
                            column += [value] * copies
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types, strict=True)], schema=schema)

        ddl = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
        found.append(docs.select("doc_id", "text").mapInArrow(run, ddl))
    return reduce(DataFrame.unionByName, found)


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that leak no item, with all their columns; nothing is shuffled."""
    for index in _indexes(docs, items, threshold):

        def run(batches, index=index):
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                clean[[at for at, _ in index.value.matches(batch["text"].to_pylist())]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op4_bm25_decontamination(spark, sf_dir):
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op4_bm25_decontamination": (op4_bm25_decontamination, None)}
