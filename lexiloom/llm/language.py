"""Language identification by language-bitmask n-gram filters.

All languages share one bit-sliced Bloom filter: a table of ``m`` rows, each a bitmask with a bit a
language. An n-gram has ``HASHES`` rows; the AND of their masks has a bit for every language that holds
the n-gram, so one lookup answers for all of them. A document looks up every n-gram of its text; the
popcount of a language is the number of n-grams that have its bit. A filter also says yes by mistake, at
a rate that follows from how full a language's slice is: of n n-grams with h hits at rate f, about
(h - n f) / (1 - f) are true. The language of most true hits, as a share of n, is the prediction.

N-grams are runs of three characters of the lower-cased text that hold letters; everything between words is
one boundary character, which an n-gram may begin or end with. A language holds an n-gram that makes up at
least ``SHARE`` of its n-grams, so no more than 1 / SHARE however large the corpus, and at least
``AGAINST`` of its share in the language that uses it most. Counts are of all documents learned from: a
task adds up equal n-grams before they are shuffled. The filter has at most ``CELLS`` rows a kept n-gram
of the largest language, which bounds what is sent to the executors.

Edge cases: a text that is null or has no letter is ``und`` with score 0; so is every text when nothing
could be learned. A text none of whose n-grams is known gets the language with the most n-grams in the
corpus, score 0. Ties go to the first language in order. Rows with a null lang or doc_id are not learned
from; a null doc_id is not held out. Repeated rows count as often as they occur and fare alike. Texts of
any length are read whole, some ``PIECE`` characters at a time. An empty table gives no rows. Only doc_id,
text and lang are read; lang, source and doc_id are never inputs of a prediction.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.arrays import mix
from lexiloom.session import discard, materialize, table

SIZE = 3
SHARE, AGAINST = 1 / 40_000, 0.1
HASHES, CELLS = 4, 12
UNKNOWN = "und"
#: Characters and documents looked at together; distinct n-grams a task holds before it sends them on.
PIECE, DOCUMENTS, HELD = 1 << 19, 2048, 1 << 20
_GAP = re.compile(r"[\W\d_]")
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(float)


@functools.cache
def _letters() -> np.ndarray:
    """True for the code points that are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def _pieces(texts: list):
    """Lists of (row, part of its text); long texts are cut between words."""
    held, size = [], 0
    for row, text in enumerate(texts):
        text, at = text or "", 0
        while True:
            found = _GAP.search(text, at + PIECE) if len(text) - at > PIECE else None
            end = found.end() if found else len(text)
            held.append((row, text[at:end]))
            size, at = size + end - at, end
            if size > PIECE or len(held) >= DOCUMENTS:
                yield held
                held, size = [], 0
            if at >= len(text):
                break
    if held:
        yield held


def ngrams(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the part) of every n-gram of some texts."""
    low = [p.lower() for p in parts]
    codes = np.frombuffer("\n".join(["", *low, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letters()[codes]
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    kept[0] = True
    at = np.flatnonzero(kept)
    s = np.where(letter[at], codes[at], 0).astype(np.uint64)
    if len(s) < SIZE:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    inner = s[1:-1] > 0
    packed = (s[:-2] | s[1:-1] << np.uint64(21) | s[2:] << np.uint64(42))[inner]
    ends = np.cumsum([len(p) + 1 for p in low])
    return mix(packed), np.searchsorted(ends, at[1:-1][inner] - 1, side="right")


def _counted(train: DataFrame, languages: list[str]) -> DataFrame:
    """(language, ngram, n): how often each language has each n-gram, added up within tasks."""
    number = {x: i for i, x in enumerate(languages)}

    def run(batches):
        held: dict[int, list] = {}
        size = 0

        def merged(parts):
            keys = np.concatenate([k for k, _ in parts])
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], np.concatenate([c for _, c in parts])[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            return keys[first], np.add.reduceat(n, first)

        def flush():
            for code, parts in held.items():
                keys, n = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), code, dtype=np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], ["language", "ngram", "n"])
            held.clear()

        for batch in batches:
            codes = np.array([number[x] for x in batch["lang"].to_pylist()], dtype=np.int64)
            for piece in _pieces(batch["text"].to_pylist()):
                grams, part = ngrams([t for _, t in piece])
                of = codes[[row for row, _ in piece]][part] if len(part) else part
                for code in np.unique(of).tolist():
                    held.setdefault(code, []).append(np.unique(grams[of == code], return_counts=True))
                    size += len(held[code][-1][0])
                if size > HELD:
                    for code, parts in held.items():
                        held[code] = [merged(parts)]
                    size = sum(len(parts[0][0]) for parts in held.values())
                    if size > HELD // 2:
                        yield from flush()
                        size = 0
        yield from flush()

    rows = train.select("lang", "text").mapInArrow(run, "language int, ngram long, n long")
    return rows.groupBy("language", "ngram").agg(F.sum("n").alias("n"))


class Filters:
    """The bit-sliced filter of all languages."""

    def __init__(self, languages: list[str], masks: np.ndarray, default: int):
        #: ``masks[row, word]``: bits of 64 languages each.
        self.languages, self.masks, self.default = languages, masks, default
        bits = self.masks.view(np.uint8)
        full = np.concatenate([np.bincount(bits[:, b], minlength=256) @ _BITS for b in range(bits.shape[1])])
        self.mistakes = (full[: len(languages)] / len(masks)) ** HASHES if languages else np.zeros(0)

    @staticmethod
    def rows(grams: np.ndarray, m: int):
        """The rows of each n-gram, one array a hash; ``m`` is a power of two."""
        step = (grams >> np.uint64(32)) | np.uint64(1)
        for k in range(HASHES):
            yield (grams + np.uint64(k) * step) & np.uint64(m - 1)

    def having(self, grams: np.ndarray) -> np.ndarray:
        """For each n-gram the bitmask of all languages that may hold it."""
        out = None
        for rows in self.rows(grams, len(self.masks)):
            found = self.masks[rows.astype(np.int64)]
            out = found if out is None else out & found
        return out

    def popcounts(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(hits by text and language, number of n-grams by text)."""
        hits, n = np.zeros((len(texts), 8 * self.masks.shape[1] * 8)), np.zeros(len(texts))
        for piece in _pieces(texts):
            grams, part = ngrams([t for _, t in piece])
            rows = np.array([row for row, _ in piece])
            first = rows[0]
            local, count = rows[part] - first if len(part) else part, rows[-1] - first + 1
            n[first : first + count] += np.bincount(local, minlength=count)
            masks = self.having(grams).view(np.uint8).reshape(len(grams), -1)
            for b in range(-(-len(self.languages) // 8)):
                by = np.bincount(local * 256 + masks[:, b], minlength=count * 256).reshape(count, 256)
                hits[first : first + count, 8 * b : 8 * b + 8] += by @ _BITS
        return hits[:, : len(self.languages)], n

    def shares(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(true hits of each language as a share of the n-grams, number of n-grams)."""
        hits, n = self.popcounts(texts)
        true = (hits - n[:, None] * self.mistakes) / np.maximum(1 - self.mistakes, 1e-9)
        return np.clip(true / np.maximum(n, 1)[:, None], 0.0, 1.0), n

    def identify(self, texts: list) -> tuple[list[str], np.ndarray]:
        """The language of each text and its share."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        share, n = self.shares(texts)
        best = share.argmax(axis=1)
        score = share[np.arange(len(texts)), best] if len(texts) else np.zeros(0)
        best = np.where(score > 0, best, self.default)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), n.tolist(), strict=True)], score


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame) -> Filters:
    """The filters of the languages of all labelled documents that are not held out."""
    train = docs.select("doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    languages = sorted(r.lang for r in train.select("lang").distinct().collect())  # language names
    if not languages:
        return Filters([], np.zeros((1, 1), dtype=np.uint64), 0)
    counts = materialize(_counted(train, languages), "ngrams")
    totals = counts.groupBy("language").agg(F.sum("n").alias("total"))
    # One row a language.
    shares = counts.join(F.broadcast(totals), "language").select("language", "ngram", (F.col("n") / F.col("total")).alias("share"))
    most = shares.groupBy("ngram").agg(F.collect_list(F.struct("language", "share")).alias("of"), F.max("share").alias("most"))  # a row a language at most
    kept = most.select("ngram", F.explode(F.filter("of", lambda x: (x["share"] >= SHARE) & (x["share"] >= AGAINST * F.col("most")))).alias("x"))
    kept = materialize(kept.select("ngram", "x.language"), "kept-ngrams")
    size = {r.language: r["count"] for r in kept.groupBy("language").count().collect()}
    total = {r.language: r.total for r in totals.collect()}
    m = 1 << max(6, (CELLS * max(size.values(), default=1) - 1).bit_length())
    masks = np.zeros((m, -(-len(languages) // 64)), dtype=np.uint64)
    # Rows by the same formula as in Filters.rows, with wrapping sums of 64 bits.
    step = F.shiftrightunsigned("ngram", 32).bitwiseOR(F.lit(1).cast("long"))
    low = lambda c: c.bitwiseAND(F.lit(m - 1).cast("long"))
    rows = F.array(*(low(low(F.col("ngram")) + k * low(step)) for k in range(HASHES)))
    sliced = kept.select(F.explode(rows).alias("row"), F.expr("language div 64").cast("int").alias("word"), F.expr("shiftleft(1L, language % 64)").alias("bit"))
    found = sliced.groupBy("row", "word").agg(F.bit_or("bit").alias("mask")).toArrow()  # at most the filter itself
    masks[found["row"].to_numpy(), found["word"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    for done in (counts, kept):
        discard(done)
    return Filters(languages, masks, max(range(len(languages)), key=lambda i: (total.get(i, 0), -i)))


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        for batch in batches:
            names, score = shared.value.identify(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op12_language_filters(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs))


QUERIES = {"op12_language_filters": (op12_language_filters, None)}
