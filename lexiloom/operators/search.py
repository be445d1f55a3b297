"""BM25 over impact-ordered postings or over blocks of documents, keyword search over a positional index or over such blocks.

Searches of few queries never pair all queries of a word with all its documents: BM25 finds a threshold
for each query first and then reads only those impact levels that can reach it; keyword search starts
from a query's rarest word and looks other words up by (word, document). Postings of a frequent word are
dealt over slices in proportion to their number, so that no key is hot. Where the queries grow with the
corpus, BM25 and web-style search work on blocks of documents as arrays, and only results of a block leave it.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.operators.dedup import folded
from lexiloom.operators.words import Cutter, tokens, word_ranges
from lexiloom.session import discard, materialize

K1, B = 1.2, 0.75
#: Impact levels of a word, and postings in a slice of one.
LEVELS, SLICE = 256, 50_000
#: Queries that are looked up by impact levels; more are scored against blocks of documents.
FEW = 200
#: Documents and tokens of a block, tokens that are counted at a time, and classes of queries that meet a block together.
BLOCK, BLOCK_TOKENS, CHUNK_TOKENS, ASKED = 32_768, 1 << 24, 1 << 20, 262_144
#: Shares of the blocks after which the k-th best scores so far become bounds for the rest, and the fewest blocks for that.
ROUNDS, FEWEST = (64, 16, 4), 9
#: Tasks that few blocks are dealt to, and the fewest classes for that; words of a block whose weights are kept for all its documents.
TASKS, SOME, DENSE = 16, 2048, 256
#: Tokens of a block of keyword search, and classes of its queries that meet a block together.
STREAM_TOKENS, CLASSES = 1 << 23, 262_144
#: More than scores can differ by rounding to six digits.
ROUNDING = 1e-6


def _slice(doc: str, slices: str) -> Column:
    return F.pmod(F.xxhash64(doc), F.col(slices))


def impacts(docs: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, words) of the words ``terms`` (term).

    Postings are term, slice, level, doc_id, impact: what the word adds to a document's score, by
    idf ln(1 + (N - df + 0.5) / (df + 0.5)), k1 1.2, b 0.75. Words are term, top (their greatest impact)
    and slices. A level holds impacts above level / LEVELS of the top.
    """
    sized = docs.select("doc_id", tokens("text").alias("t")).withColumn("dl", F.size("t"))
    corpus = sized.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("mean_dl")).first()
    n, mean = corpus.n_docs, corpus.mean_dl or 1.0
    tf = sized.select("doc_id", "dl", F.explode("t").alias("term")).join(terms.distinct(), "term", "left_semi").groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    tf = materialize(tf.withColumn("weight", F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / mean))), "weights")
    words = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("weight").alias("most"))
    idf = F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    words = materialize(words.select("term", idf.alias("idf"), "most", (idf * F.col("most")).alias("top"), F.ceil(F.col("df") / SLICE).cast("int").alias("slices")), "words")
    level = F.least(F.floor(F.col("weight") / F.col("most") * LEVELS), F.lit(LEVELS - 1)).cast("int")
    rows = tf.join(words, "term").select("term", _slice("doc_id", "slices").alias("slice"), level.alias("level"), "doc_id", (F.col("idf") * F.col("weight")).alias("impact"))
    postings = materialize(rows, "postings")
    discard(tf)
    return postings, words.select("term", "top", "slices")


def _complete(pairs: DataFrame, asked: DataFrame, postings: DataFrame) -> DataFrame:
    """Whole scores of (query_id, doc_id), by looking every word of the query up for the document."""
    wanted = pairs.join(asked.select("query_id", "term", "slices"), "query_id").withColumn("slice", _slice("doc_id", "slices"))
    found = wanted.join(postings.select("term", "slice", "doc_id", "impact"), ["term", "slice", "doc_id"])
    return found.groupBy("query_id", "doc_id").agg(F.sum("impact").alias("whole"))


def _read(asked: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, doc_id) of postings of each (query_id, term, slices, least) from the level ``least`` on."""
    keys = asked.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select("query_id", "term", "slice", "least")
    return keys.join(postings, ["term", "slice"]).where(F.col("level") >= F.col("least")).select("query_id", "doc_id")


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k best documents of each query (query_id, query); any word may match.

    Many queries go through :func:`bm25_blocks`. Of few, the highest levels of each word, down to k documents, are
    scored whole first: the k-th best score is a query's threshold. Of its words, those that together cannot reach it bring no candidates; of the
    others only levels that can reach it with the tops of all other words are read, and these scored whole.
    Documents without an id are not found.
    """
    many = queries.limit(FEW + 1).count() > FEW
    return bm25_blocks(docs, queries, k) if many else candidates(docs, queries, k)[1]


_INDEX = "ids array<long>, lengths binary, n_docs long, with_text long, n_tokens long, words array<string>, dfs array<int>, ends binary, docs binary, counts binary"


def _cut(batches, ranges: np.ndarray):
    """(ids, which have a text, words, how many each has) of some documents (doc_id, folded text) at a time."""
    cutter = Cutter(ranges)
    for batch in batches:
        has = batch["text"].is_valid().to_numpy(zero_copy_only=False)
        for at, words, widths in cutter.pieces(batch["text"]):
            yield batch["doc_id"].slice(at, len(widths)), has[at : at + len(widths)], words, widths


def _block_index(batches, ranges: np.ndarray, size: int, tokens: int, chunk: int):
    """Blocks of documents (doc_id, folded text) as arrays: of each word the documents, by place, and how often it occurs there."""
    ids, lengths, chunks, places, waiting, texts, total = [], [], [], {}, [], 0, 0

    def counted():
        """The tokens that wait become (word, document, count)."""
        words = pa.concat_arrays([w for w, _ in waiting]).dictionary_encode()
        codes = np.array([places.setdefault(w, len(places)) for w in words.dictionary.to_pylist()], dtype=np.int64)
        key, n = np.unique(codes[words.indices.to_numpy()] * size + np.concatenate([d for _, d in waiting]), return_counts=True)
        chunks.append((key, n.astype(np.uint32)))
        waiting.clear()

    def whole():
        if waiting:
            counted()
        key = np.concatenate([np.zeros(0, np.int64), *(c[0] for c in chunks)])
        order = np.argsort(key, kind="stable")  # a document is in one chunk
        n = np.concatenate([np.zeros(0, np.uint32), *(c[1] for c in chunks)])[order]
        n = n if n.max(initial=0) >> 16 else n.astype(np.uint16)
        word, doc = np.divmod(key[order], size)
        ends = np.searchsorted(word, np.arange(len(places)), side="right")
        row = {"ids": [ids], "lengths": [np.array(lengths, np.int64).tobytes()], "n_docs": [len(ids)], "with_text": [texts], "n_tokens": [sum(lengths)], "words": [list(places)],
               "dfs": [np.diff(ends, prepend=0).tolist()], "ends": [ends.tobytes()], "docs": [doc.astype(np.uint16).tobytes()], "counts": [n.tobytes()]}
        return pa.RecordBatch.from_pydict(row, schema=schema)

    binary = pa.binary()
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("lengths", binary), ("n_docs", pa.int64()), ("with_text", pa.int64()), ("n_tokens", pa.int64()),
                        ("words", pa.list_(pa.string())), ("dfs", pa.list_(pa.int32())), ("ends", binary), ("docs", binary), ("counts", binary)])
    pending = 0
    for given, has, values, widths in _cut(batches, ranges):
        ends, at = np.cumsum(widths), 0
        while at < len(widths):
            before = ends[at - 1] if at else 0
            # As many documents as fill the chunk or the block, one at least.
            upto = min(max(at + 1, int(np.searchsorted(ends, before + chunk - pending, side="right"))), at + size - len(ids), len(widths))
            some = widths[at:upto]
            waiting.append((values.slice(before, ends[upto - 1] - before), np.repeat(np.arange(len(ids), len(ids) + len(some)), some)))
            ids += given.slice(at, len(some)).to_pylist()
            lengths += some.tolist()
            texts += int(has[at:upto].sum())
            pending, total, at = pending + int(some.sum()), total + int(some.sum()), upto
            if pending >= chunk:
                counted()
                pending = 0
            if len(ids) >= size or total >= tokens:
                yield whole()
                ids, lengths, texts, total, pending = [], [], 0, 0, 0
                chunks.clear()
                places.clear()
    if ids:
        yield whole()


class _Postings:
    """The documents of a block, and the weights of the words in them."""

    def __init__(self, block: pa.Table, mean: float):
        row = {c: block[c][0].as_py() for c in ("ids", "lengths", "ends", "docs", "counts")}
        self.docs, length = np.frombuffer(row["docs"], np.uint16), np.frombuffer(row["lengths"], np.int64)
        counts = np.frombuffer(row["counts"], np.uint16 if len(row["counts"]) == len(row["docs"]) else np.uint32).astype(float)
        self.weight = counts * (K1 + 1) / (counts + (K1 * (1 - B + B * length / mean))[self.docs])
        self.words, self.ends = block["words"].combine_chunks()[0].values, np.frombuffer(row["ends"], np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]) if len(self.ends) else self.ends
        self.most = np.maximum.reduceat(self.weight, self.starts) if len(self.starts) else self.weight
        self.without_id = np.array([n for n, i in enumerate(row["ids"]) if i is None], np.int64)
        self.ids, self.n_docs = np.array([i or 0 for i in row["ids"]], np.int64), len(row["ids"])
        self.total, self.product, self.dense = np.zeros(self.n_docs), np.zeros(self.n_docs), {}

    def everywhere(self, p: int) -> np.ndarray | None:
        """Weights of a frequent word in all documents, where these are kept."""
        low, high = self.starts[p], self.ends[p]
        if p not in self.dense and (high - low) * 8 > self.n_docs and len(self.dense) < DENSE:
            self.dense[p] = np.zeros(self.n_docs)
            self.dense[p][self.docs[low:high]] = self.weight[low:high]
        return self.dense.get(p)

    def add(self, p: int, idf: float) -> None:
        weights = self.everywhere(p)
        if weights is None:
            low, high = self.starts[p], self.ends[p]
            self.total[self.docs[low:high]] += idf * self.weight[low:high]
        else:
            np.multiply(weights, idf, out=self.product)
            np.add(self.total, self.product, out=self.total)

    def looked_up(self, p: int, idf: float, near: np.ndarray) -> np.ndarray:
        """What a word adds to the scores of some documents."""
        weights = self.everywhere(p)
        if weights is not None:
            return idf * weights[near]
        low, high = self.starts[p], self.ends[p]
        mine = self.docs[low:high]
        if len(near) * 16 > len(mine):
            self.product.fill(0)
            self.product[mine] = self.weight[low:high]
            return idf * self.product[near]
        at = np.minimum(np.searchsorted(mine, near.astype(np.uint16)), len(mine) - 1)
        return np.where(mine[at] == near, idf * self.weight[low + at], 0.0)

    def over(self, places, least: float) -> np.ndarray:
        """Documents of the words whose total is above ``least``, and above zero."""
        n = sum(int(self.ends[p] - self.starts[p]) for p in places)
        if n * 8 > self.n_docs:
            return np.flatnonzero(self.total >= least if least > 0 else self.total > 0)
        docs = np.concatenate([self.docs[self.starts[p] : self.ends[p]] for p in places])
        docs = np.sort(docs[self.total[docs] >= least])
        return docs[np.diff(docs, prepend=-1) != 0].astype(np.int64) if len(docs) else docs.astype(np.int64)

    def clear(self, places) -> None:
        if any(p in self.dense for p in places):
            self.total.fill(0)
        else:
            for p in places:
                self.total[self.docs[self.starts[p] : self.ends[p]]] = 0

    def best(self, places, idfs, reach, least: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best with a score of ``least``, for words from the rarest on; ``reach`` is what a word and those after it can add at most."""
        upto = 0
        if least == -np.inf:
            # The k-th best sum of the rare words is a bound.
            while upto < len(places) and (upto == 0 or (self.ends[places[upto]] - self.starts[places[upto]]) * 16 <= self.n_docs):
                self.add(places[upto], idfs[upto])
                upto += 1
            near = self.over(places[:upto], -np.inf)
            near = near[~np.isin(near, self.without_id)] if len(self.without_id) else near
            if len(near) >= k:
                least = np.partition(self.total[near], len(near) - k)[len(near) - k]
        while upto < len(places) and reach[upto] >= least - ROUNDING:
            self.add(places[upto], idfs[upto])
            upto += 1
        near = self.over(places[:upto], least - (reach[upto] if upto < len(places) else 0.0) - 2 * ROUNDING)
        score = self.total[near]
        self.clear(places[:upto])
        for n in range(upto, len(places)):
            if len(near) == 0:
                break
            score += self.looked_up(places[n], idfs[n], near)
            some = score >= least - (reach[n + 1] if n + 1 < len(places) else 0.0) - 2 * ROUNDING
            near, score = near[some], score[some]
        if len(self.without_id):
            some = ~np.isin(near, self.without_id)
            near, score = near[some], score[some]
        if len(near) > k:
            some = score >= np.partition(score, len(near) - k)[len(near) - k] - ROUNDING
            near, score = near[some], score[some]
        first = np.lexsort((self.ids[near], -np.round(score, 6)))[:k]
        return near[first], score[first]


def _best_of_block(block: pa.Table, asked: pa.Table, mean: float, k: int) -> pa.Table:
    """The k best documents of a block for every class of queries (class, terms, idfs, least) that can be among its k best.

    A score below ``least`` is of no use. A class's words are taken from the rarest on and added up over the block, until what
    the others can add stays below that bound; these are looked up for the documents that can still reach it only.
    """
    out = ([], [], [])
    if block.num_rows and asked.num_rows:
        held = _Postings(block, mean)
        terms, idf = asked["terms"].combine_chunks(), asked["idfs"].combine_chunks().flatten().to_numpy()
        place = pc.fill_null(pc.index_in(terms.flatten(), value_set=held.words), -1).to_numpy()
        label, n = asked["class"].to_numpy(), asked.num_rows
        owner = np.repeat(np.arange(n), terms.value_lengths().to_numpy())
        found = place >= 0
        place, idf, owner = place[found], idf[found], owner[found]
        order = np.lexsort((place, held.ends[place] - held.starts[place], owner))
        place, idf, owner = place[order], idf[order], owner[order]
        edges = np.searchsorted(owner, np.arange(n + 1))
        upto = np.concatenate([[0], np.cumsum(idf * held.most[place])])
        reach = upto[edges[owner + 1]] - upto[:-1]
        least = pc.fill_null(asked["least"].combine_chunks(), -np.inf).to_numpy()
        wanted = np.flatnonzero(edges[1:] > edges[:-1])
        wanted = wanted[reach[edges[wanted]] >= least[wanted] - 2 * ROUNDING]
        for c in wanted.tolist():
            low, high = edges[c], edges[c + 1]
            near, score = held.best(place[low:high].tolist(), idf[low:high].tolist(), reach[low:high].tolist(), float(least[c]), k)
            if len(near):
                for column, values in zip(out, (np.full(len(near), label[c]), held.ids[near], score), strict=True):
                    column.append(values)
    columns = [np.concatenate([np.zeros(0, t), *c]) for c, t in zip(out, (np.int64, np.int64, float), strict=True)]
    return pa.table(columns, names=["class", "doc_id", "whole"])


def bm25_blocks(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The result of :func:`bm25` for query sets that grow with the corpus.

    Documents become blocks of postings where they are: no token is shuffled. Queries of the same words are
    one class. Every block meets the classes in parts of ``ASKED`` at most, and its k best documents of each
    class leave it, so rows between tasks are k a class and block at most, however many documents share a word. Many blocks are
    met in rounds: the k-th best score of a class in those before bounds what later blocks add up and hand on.
    """
    spark = docs.sparkSession
    index = partial(_block_index, ranges=word_ranges(spark), size=BLOCK, tokens=BLOCK_TOKENS, chunk=CHUNK_TOKENS)
    blocks = materialize(docs.select("doc_id", folded("text").alias("text")).mapInArrow(index, _INDEX).withColumn("block", F.monotonically_increasing_id()), "blocks")
    corpus = blocks.agg(F.count(F.lit(1)).alias("blocks"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_docs", "with_text", "n_tokens")]).first()
    n, mean = corpus.n_docs, corpus.n_tokens / corpus.with_text if corpus.n_tokens else 1.0
    asked = materialize(queries.select("query_id", F.array_sort(F.array_distinct(tokens("query"))).alias("terms")).where("size(terms) > 0"), "asked")
    classes = materialize(asked.select("terms").distinct().withColumn("class", F.monotonically_increasing_id()), "classes")
    words = classes.select("class", F.explode("terms").alias("term"))
    df = blocks.select(F.explode(F.arrays_zip("words", "dfs")).alias("w")).select(F.col("w.words").alias("term"), "w.dfs").join(words.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("dfs").alias("df"))
    idf = F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    held = words.join(df.select("term", idf.alias("idf")), "term").groupBy("class").agg(F.collect_list(F.struct("term", "idf")).alias("t"))
    held = materialize(held.select("class", F.col("t.term").alias("terms"), F.col("t.idf").alias("idfs")), "class-words")
    numbers = materialize(blocks.select(F.col("block").alias("b"), F.row_number().over(Window.orderBy(F.xxhash64("block"), "block")).alias("nth")), "numbers")  # a row a block
    ends = {-(-corpus.blocks // r) for r in ROUNDS} if corpus.blocks >= FEWEST else set()
    n_classes, ranked, low = classes.count(), None, 0
    for high in sorted({*ends, corpus.blocks}):
        some = numbers.where(F.col("nth").between(low + 1, high)).select("b")
        parts = max(1, -(-n_classes // ASKED), min(TASKS // max(1, high - low), n_classes // SOME))
        bounds = F.lit(None).cast("double").alias("least")
        if ranked is not None:
            bounds = (F.col("score") - 2 * ROUNDING).alias("least")
            reached = ranked.where(F.col("rank") == k).select(F.col("class").alias("r_class"), "score")
        of = held if ranked is None else held.join(reached, F.col("class") == F.col("r_class"), "left")
        # A row a block of documents is broadcast: its number.
        met = of.select("class", "terms", "idfs", bounds, F.pmod(F.xxhash64("class"), F.lit(parts)).cast("int").alias("part")).crossJoin(F.broadcast(some))
        whole = blocks.join(F.broadcast(some), F.col("block") == F.col("b")).select("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "ids", "lengths", "words", "ends", "docs", "counts")
        best = lambda block, some: _best_of_block(block, some, mean, k)
        found = whole.groupBy("block", "part").cogroup(met.groupBy("b", "part")).applyInArrow(best, "class long, doc_id long, whole double")
        found = found.select("class", "doc_id", F.round("whole", 6).alias("score"))
        before, found = ranked, found if ranked is None else ranked.select("class", "doc_id", "score").unionByName(found)
        rank = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("score"), "doc_id"))
        ranked, low = materialize(found.withColumn("rank", rank).where(F.col("rank") <= k), "ranked"), high
        if before is not None:
            discard(before)
    discard(blocks)
    discard(held)
    return asked.join(classes, "terms").select("query_id", "class").join(ranked, "class").select("query_id", "doc_id", "score", "rank")


def candidates(docs: DataFrame, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """((query_id, doc_id) that were scored whole, the result of :func:`bm25`)."""
    terms = queries.select("query_id", F.explode(F.array_distinct(tokens("query"))).alias("term"))
    postings, words = impacts(docs, terms.select("term"))
    asked = materialize(terms.join(words, "term"), "asked")
    counts = postings.groupBy("term", "level").count()  # LEVELS rows a word at most
    above = F.sum("count").over(Window.partitionBy("term").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1))
    enough = counts.withColumn("above", F.coalesce(above, F.lit(0))).where(F.col("above") < k).groupBy("term").agg(F.min("level").alias("least"))
    first = materialize(_complete(_read(asked.join(enough, "term"), postings).distinct(), asked, postings), "first-scores")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("whole")))
    threshold = first.withColumn("nth", nth).where(F.col("nth") == k).select("query_id", (F.col("whole") - ROUNDING).alias("threshold"))
    order = Window.partitionBy("query_id").orderBy("top", "term")
    every = Window.partitionBy("query_id")
    bounds = asked.join(threshold, "query_id").withColumn("upto", F.sum("top").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("top").over(every))
    need = (F.col("threshold") - (F.col("all") - F.col("top"))) / F.col("top")
    # A level's impacts are below (level + 1) / LEVELS of the top, the highest level's at most the top.
    least = F.greatest(F.least(F.floor(need * LEVELS - 1e-6), F.lit(LEVELS - 1)), F.lit(0)).cast("int")
    essential = bounds.where(F.col("upto") >= F.col("threshold")).select("query_id", "term", "slices", least.alias("least"))
    pairs = _read(essential, postings).distinct()
    done = first.select(F.col("query_id").alias("f_q"), F.col("doc_id").alias("f_d"))
    fresh = pairs.join(done, (F.col("query_id") == F.col("f_q")) & (F.col("doc_id").eqNullSafe(F.col("f_d"))), "left_anti")
    scored = first.unionByName(_complete(fresh, asked, postings)).select("query_id", "doc_id", F.round("whole", 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return first.select("query_id", "doc_id").unionByName(fresh), scored.withColumn("rank", rank).where(F.col("rank") <= k)


def parsed(queries: DataFrame) -> DataFrame:
    """Queries (query_id, query) as rows: query_id, alternative, item, minus, offset, term.

    Words must all match; ``or`` separates alternatives; a minus excludes; quotes, and marks within a word,
    make a phrase, whose terms have offsets. What holds no letter or digit is left out.
    """
    items = F.regexp_extract_all("query", F.lit(r'(-?(?:"[^"]*"|\S+))'), 1)
    bare = queries.select("query_id", F.posexplode(items).alias("item", "raw")).withColumn("is_or", F.lower("raw") == "or")
    # The number of separators before an item, within its query.
    before = F.sum(F.col("is_or").cast("int")).over(Window.partitionBy("query_id").orderBy("item").rowsBetween(Window.unboundedPreceding, 0))
    found = bare.withColumn("alternative", before).where(~F.col("is_or")).withColumn("minus", F.col("raw").startswith("-"))
    return found.select("query_id", "alternative", "item", "minus", F.posexplode(tokens("raw")).alias("offset", "term"))


def positional_index(docs: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(index, words): term, slice, doc_id, positions of the words ``terms`` (term); and term, df, slices.

    A document's places of a word are gathered where the document is; the index is written once.
    """
    places = docs.select("doc_id", F.posexplode(tokens("text")).alias("at", "term")).join(terms.distinct(), "term", "left_semi")
    raw = materialize(places.groupBy("doc_id", "term").agg(F.array_sort(F.collect_list("at")).alias("positions")), "positions")
    words = materialize(raw.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("slices", F.ceil(F.col("df") / SLICE).cast("int")), "words")
    index = materialize(raw.join(words, "term").select("term", _slice("doc_id", "slices").alias("slice"), "doc_id", "positions"), "index")
    discard(raw)
    return index, words


def _looked_up(rows: DataFrame, index: DataFrame, how: str = "inner") -> DataFrame:
    """Rows (doc_id, term, slices, ...) with the positions of the term in the document."""
    keyed = rows.withColumn("slice", _slice("doc_id", "slices")).drop("slices")
    return keyed.join(index, ["term", "slice", "doc_id"], how).drop("slice")


def matches(index: DataFrame, words: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, alternative, doc_id) of the documents that match an alternative of a parsed query.

    Candidates are the documents of the alternative's rarest wanted word; a phrase matches where its terms'
    positions, each less its offset, meet. An alternative with an unknown wanted word, or with exclusions
    only, matches nothing.
    """
    sized = items.join(words, "term", "left")
    wanted = sized.where("NOT minus")
    keys = ["query_id", "alternative"]
    whole = wanted.groupBy(*keys).agg(
        F.bool_and(F.col("df").isNotNull()).alias("known"), F.min(F.struct("df", "term", "slices")).alias("rare"), F.countDistinct("item").alias("needs")
    )
    start = whole.where("known").select(*keys, "needs", "rare.term", F.explode(F.sequence(F.lit(0), F.col("rare.slices") - 1)).alias("slice"))
    pairs = start.join(index.select("term", "slice", "doc_id"), ["term", "slice"]).select(*keys, "needs", "doc_id")
    every = pairs.join(sized.where("df IS NOT NULL").select(*keys, "item", "minus", "offset", "term", "slices"), keys)
    sizes = items.groupBy(*keys, "item").agg(F.count(F.lit(1)).alias("terms"))
    shifted = F.transform("positions", lambda p: p - F.col("offset"))
    # A single word matches wherever it stands, so one of its places is enough.
    places = _looked_up(every, index).join(sizes, [*keys, "item"]).withColumn("place", F.explode(F.when(F.col("terms") == 1, F.slice("positions", 1, 1)).otherwise(shifted)))
    met = places.groupBy(*keys, "needs", "doc_id", "item", "minus", "terms", "place").agg(F.count(F.lit(1)).alias("n")).where("n = terms")
    held = met.select(*keys, "needs", "doc_id", "item", "minus").distinct()
    found = held.groupBy(*keys, "needs", "doc_id").agg(F.count_if(~F.col("minus")).alias("has"), F.count_if("minus").alias("excluded"))
    return found.where("has = needs AND excluded = 0").select(*keys, "doc_id")


def covers(index: DataFrame, words: DataFrame, items: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): how closely an alternative's wanted words stand together, its best alternative's.

    A cover is a shortest stretch of words with every term; it adds 0.1, divided by one more than the
    words in it that are no terms.
    """
    keys = ["query_id", "alternative"]
    terms = items.where("NOT minus").select(*keys, "term").distinct().join(words, "term")
    terms = terms.withColumn("t", F.row_number().over(Window.partitionBy(*keys).orderBy("term")) - 1).withColumn("need", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    places = _looked_up(found.join(terms.drop("df"), keys), index)
    flat = places.groupBy(*keys, "doc_id", "need").agg(F.array_sort(F.flatten(F.collect_list(F.transform("positions", lambda p: F.struct(p.alias("pos"), F.col("t").alias("t")))))).alias("p"))
    last = "transform(a.last, (v, i) -> IF(i = p[n].t, n, v))"
    fold = f"""aggregate(sequence(0, size(p) - 1), named_struct('last', array_repeat(-1, cast(need AS int)), 'begun', -1, 'score', 0.0D),
      (a, n) -> IF(array_min({last}) > a.begun, named_struct('last', {last}, 'begun', array_min({last}), 'score', a.score + 0.1D / (1 + p[n].pos - p[array_min({last})].pos - (n - array_min({last})))),
        named_struct('last', {last}, 'begun', a.begun, 'score', a.score))).score"""
    return flat.select("query_id", "doc_id", F.round(F.expr(fold), 6).alias("score")).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))


_STREAMS = "ids binary, lengths binary, codes binary, words array<string>, ends binary, docs binary"


def _streams(batches, ranges: np.ndarray, size: int, tokens: int):
    """Blocks of documents (doc_id, folded text) as arrays: their words by number, in order, and of each word the documents, by place."""
    schema = pa.schema([(c, pa.binary()) for c in ("ids", "lengths", "codes")] + [("words", pa.list_(pa.string())), ("ends", pa.binary()), ("docs", pa.binary())])
    ids, lengths, codes, places, total = [], [], [], {}, 0

    def whole():
        length, code = np.concatenate(lengths), np.concatenate(codes)
        key = np.sort(code.astype(np.int64) * size + np.repeat(np.arange(len(length)), length))
        word, doc = np.divmod(key[np.diff(key, prepend=-1) != 0], size)
        ends = np.searchsorted(word, np.arange(len(places)), side="right")
        row = {"ids": [np.concatenate(ids).tobytes()], "lengths": [length.tobytes()], "codes": [code.tobytes()], "words": [list(places)], "ends": [ends.tobytes()], "docs": [doc.astype(np.uint16).tobytes()]}
        return pa.RecordBatch.from_pydict(row, schema=schema)

    for given, _, values, widths in _cut(batches, ranges):
        ends, at = np.cumsum(widths), 0
        while at < len(widths):
            before = ends[at - 1] if at else 0
            # As many documents as fill the block, one at least.
            upto = min(max(at + 1, int(np.searchsorted(ends, before + tokens - total, side="right"))), at + size - sum(map(len, ids)), len(widths))
            words = values.slice(before, ends[upto - 1] - before).dictionary_encode()
            numbers = np.array([places.setdefault(w, len(places)) for w in words.dictionary.to_pylist()], dtype=np.int32)
            codes.append(numbers[words.indices.to_numpy()])
            ids.append(given.slice(at, upto - at).to_numpy().astype(np.int64))
            lengths.append(widths[at:upto].astype(np.int64))
            total, at = total + len(codes[-1]), upto
            if sum(map(len, ids)) >= size or total >= tokens:
                yield whole()
                ids, lengths, codes, places, total = [], [], [], {}, 0
    if ids:
        yield whole()


def _half_up(score: float) -> float:
    """Rounded to six digits like Spark's round."""
    return float(Decimal(repr(score)).quantize(Decimal("1e-6"), ROUND_HALF_UP))


class _Block:
    """The documents of a block, the words in them and, once asked for, the places of each word."""

    def __init__(self, row):
        self.ids, self.length, self.codes = (np.frombuffer(row[c], t) for c, t in (("ids", np.int64), ("lengths", np.int64), ("codes", np.int32)))
        self.docs, self.ends = np.frombuffer(row["docs"], np.uint16), np.frombuffer(row["ends"], np.int64)
        self.starts, self.first = np.concatenate([[0], self.ends[:-1]]), np.cumsum(self.length) - self.length
        self.place = {w: n for n, w in enumerate(row["words"])}

    @cached_property
    def spots(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places in the block, by word; where a word's begin and the last word's end; the document of each place in the block)."""
        order = np.argsort(self.codes, kind="stable")
        return order, np.concatenate([[0], np.cumsum(np.bincount(self.codes, minlength=len(self.place)))]), np.repeat(np.arange(len(self.ids)), self.length)

    def holding(self, words) -> np.ndarray:
        """Places of the documents that hold all words (numbers), from the rarest word's on."""
        lists = sorted((self.docs[self.starts[w] : self.ends[w]] for w in set(words)), key=len)
        out = lists[0]
        for other in lists[1:]:
            if len(out) == 0:
                break
            out = out[other[np.minimum(np.searchsorted(other, out), len(other) - 1)] == out]
        return out

    def with_phrase(self, docs, words) -> np.ndarray:
        """Those of the documents in which the words follow each other."""
        rare = min(range(len(words)), key=lambda n: self.ends[words[n]] - self.starts[words[n]])
        holders, spots = self._places(docs, [words[rare]])
        low, start = self.first[holders], spots - rare
        inside = (start >= low) & (start + len(words) <= low + self.length[holders])
        holders, start = holders[inside], start[inside]
        for n, w in enumerate(words):
            same = self.codes[start + n] == w
            holders, start = holders[same], start[same]
        return holders[np.diff(holders, prepend=-1) != 0]

    def _places(self, docs, words) -> tuple[np.ndarray, np.ndarray]:
        """(documents, places in the block) of words in some of the documents, in order; a word's places in a document are looked up."""
        order, edges, owner = self.spots
        low, found = self.first[docs], []
        for w in words:
            mine = order[edges[w] : edges[w + 1]]
            begin = np.searchsorted(mine, low)
            n = np.searchsorted(mine, low + self.length[docs]) - begin
            found.append(mine[np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())])
        spots = found[0] if len(found) == 1 else np.sort(np.concatenate(found))
        return owner[spots], spots

    def matching(self, items) -> tuple[np.ndarray, list[int]] | None:
        """(documents, wanted words) of an alternative, whose items are (minus, words)."""
        numbers = [(minus, [self.place.get(w, -1) for w in words]) for minus, words in items]
        wanted = [w for minus, words in numbers if not minus for w in words]
        if not wanted or -1 in wanted:
            return None
        docs = self.holding(wanted)
        for minus, words in numbers:
            if len(docs) == 0:
                return None
            if minus and -1 not in words:
                bad = self.holding(words)
                bad = docs[np.isin(docs, bad)] if len(bad) else docs[:0]
                docs = docs[~np.isin(docs, self.with_phrase(bad, words) if len(words) > 1 and len(bad) else bad)]
            elif not minus and len(words) > 1:
                docs = self.with_phrase(docs, words)
        return (docs, wanted) if len(docs) else None

    def covers(self, docs, wanted) -> np.ndarray:
        """How closely the wanted words stand together in each document, before rounding (see :func:`covers`).

        The last places of all words up to a place begin a cover there, if the earliest of them has not begun one before.
        """
        words = list(dict.fromkeys(wanted))
        holders, spots = self._places(docs, words)
        at, code = np.arange(len(spots)), self.codes[spots]
        new = np.diff(holders, prepend=-1) != 0
        low = np.maximum.accumulate(np.where(new, at, 0))
        earliest = at.copy()
        for w in words:
            np.minimum(earliest, np.maximum.accumulate(np.where(code == w, at, -1)), out=earliest)
        whole = earliest >= low
        begins = whole.copy()
        begins[1:] &= new[1:] | ~whole[:-1] | (earliest[1:] != earliest[:-1])
        n = np.flatnonzero(begins)
        m = earliest[n]
        # Added up in order, like a fold; every document has a place of each word.
        return np.bincount((np.cumsum(new) - 1)[n], weights=0.1 / (1 + spots[n] - spots[m] - (n - m)), minlength=len(docs))

    def ranked(self, found, k: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, rounded scores) of the k best of (documents, wanted words) of alternatives; all if k is None."""
        docs = found[0][0] if len(found) == 1 else np.unique(np.concatenate([docs for docs, _ in found]))
        score = np.zeros(len(docs))
        for mine, wanted in found:
            at = np.searchsorted(docs, mine)
            score[at] = np.maximum(score[at], self.covers(mine, wanted))
        if k is not None and len(docs) > k:
            some = score >= np.partition(score, len(docs) - k)[len(docs) - k] - 2 * ROUNDING
            docs, score = docs[some], score[some]
        values, which = np.unique(score, return_inverse=True)
        score = np.array([_half_up(x) for x in values.tolist()])[which]
        order = np.lexsort((self.ids[docs], -score))[:k]
        return self.ids[docs[order]], score[order]


def _alternatives(terms, keys):
    """The items (minus, words) of each alternative of a query, from its words in order and their keys."""
    out: dict[int, dict[int, tuple[bool, list[str]]]] = {}
    for term, key in zip(terms, keys, strict=True):
        out.setdefault(key >> 40, {}).setdefault(key, (bool(key & 1), []))[1].append(term)
    return [list(items.values()) for items in out.values()]


def _matches_in_block(block: pa.Table, asked: pa.Table, k: int | None, scored: bool) -> pa.Table:
    """(class, doc_ids, scores) of the documents of a block that match a class of queries (class, terms, keys), the k best if scored."""
    out = {"class": [], "doc_ids": [], "scores": []}
    if block.num_rows and asked.num_rows:
        held = _Block({c: block[c][0].as_py() for c in ("ids", "lengths", "codes", "words", "ends", "docs")})
        for part in asked.to_batches(1024):
            for label, terms, keys in zip(part["class"].to_pylist(), part["terms"].to_pylist(), part["keys"].to_pylist(), strict=True):
                found = [f for f in map(held.matching, _alternatives(terms, keys)) if f]
                if not found:
                    continue
                if scored:
                    ids, scores = held.ranked(found, k)
                else:
                    ids, scores = held.ids[np.unique(np.concatenate([docs for docs, _ in found]))], None
                out["class"].append(label)
                out["doc_ids"].append(ids)
                out["scores"].append(scores)
    return pa.table(out, schema=pa.schema([("class", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))]))


def _meetings(blocks: DataFrame, items: DataFrame) -> DataFrame:
    """(class, b): the blocks (block, words) that hold the wanted word of an alternative (class, alternative, minus, term) which the fewest blocks hold.

    An alternative with a wanted word that no block holds meets none.
    """
    wanted = items.where("NOT minus").select("class", "alternative", "term").distinct()
    holding = materialize(blocks.select(F.col("block").alias("b"), F.explode("words").alias("term")).join(wanted.select("term").distinct(), "term", "left_semi"), "holding")
    spread = wanted.join(holding.groupBy("term").agg(F.count(F.lit(1)).alias("blocks")), "term", "left")
    rarest = spread.groupBy("class", "alternative").agg(F.bool_and(F.col("blocks").isNotNull()).alias("known"), F.min(F.struct("blocks", "term")).alias("rare")).where("known")
    return rarest.select("class", F.col("rare.term").alias("term")).join(holding, "term").select("class", "b").distinct()


def _keyword_blocks(docs: DataFrame, queries: DataFrame, k: int | None, scored: bool) -> tuple[DataFrame, DataFrame]:
    """(queries (query_id, class), what :func:`_matches_in_block` finds in all blocks).

    Documents become blocks where they are; of these a shuffle carries the arrays once for about ``CLASSES``
    classes of queries, which are distinct texts of queries. Neither words of documents nor candidates are shuffled, and
    a class is sent to the blocks that can match it only (:func:`_meetings`).
    """
    whole = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", folded("text").alias("text"))
    made = partial(_streams, ranges=word_ranges(docs.sparkSession), size=BLOCK, tokens=STREAM_TOKENS)
    blocks = materialize(whole.mapInArrow(made, _STREAMS).withColumn("block", F.monotonically_increasing_id()), "streams")
    queries = materialize(queries.where("query IS NOT NULL").select("query_id", "query"), "queries")
    classes = materialize(queries.select("query").distinct().withColumn("class", F.monotonically_increasing_id()), "classes")
    items = materialize(parsed(classes.select(F.col("class").alias("query_id"), "query")).withColumnRenamed("query_id", "class"), "items")
    key = F.shiftleft(F.col("alternative").cast("long"), 40).bitwiseOR(F.shiftleft(F.col("item").cast("long"), 1)).bitwiseOR(F.col("minus").cast("long"))
    held = items.groupBy("class").agg(F.array_sort(F.collect_list(F.struct(key.alias("key"), "offset", "term"))).alias("t"))
    parts = max(1, -(-classes.count() // CLASSES))
    held = held.select("class", F.col("t.term").alias("terms"), F.col("t.key").alias("keys"), F.pmod(F.xxhash64("class"), F.lit(parts)).cast("int").alias("p")).join(_meetings(blocks, items), "class")
    dealt = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    find = lambda block, some: _matches_in_block(block, some, k, scored)
    found = dealt.groupBy("block", "part").cogroup(held.groupBy("b", "p")).applyInArrow(find, "class long, doc_ids array<long>, scores array<double>")
    return queries.join(classes, "query").select("query_id", "class"), found


def keyword_matches(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id) of the documents that match web-style queries (query_id, query), a row for each row of both.

    Null and empty queries, and those without letters or digits, match nothing; null texts, and documents
    without an id, match no query.
    """
    asked, found = _keyword_blocks(docs, queries, None, scored=False)
    return asked.join(found.select("class", "doc_ids"), "class").select("query_id", F.explode("doc_ids").alias("doc_id"))


def keyword_search(docs: DataFrame, queries: DataFrame, k: int | None = 10) -> DataFrame:
    """query_id, doc_id, score, rank of the documents that match web-style queries (see :func:`keyword_matches`).

    The k closest covers of each query, ties by doc_id; all matches if k is None. Only the k best of a block leave it.
    """
    asked, found = _keyword_blocks(docs, queries, k, scored=True)
    rows = found.select("class", F.explode(F.arrays_zip("doc_ids", "scores")).alias("m")).select("class", F.col("m.doc_ids").alias("doc_id"), F.col("m.scores").alias("score"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("score"), "doc_id")))
    ranked = ranked if k is None else ranked.where(F.col("rank") <= k)
    return asked.join(ranked, "class").select("query_id", "doc_id", "score", "rank")


def match_all(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id) of documents that hold every term of a query."""
    items = queries.select("query_id", F.lit(0).alias("alternative"), F.posexplode(F.array_distinct(tokens("query"))).alias("item", "term"))
    items = materialize(items.select("query_id", "alternative", "item", F.lit(False).alias("minus"), F.lit(0).alias("offset"), "term"), "items")
    index, words = positional_index(docs, items.select("term"))
    return matches(index, words, items).select("query_id", "doc_id")


def cover_density(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Documents with all terms of a query, ranked by how closely these stand together."""
    items = queries.select("query_id", F.lit(0).alias("alternative"), F.posexplode(F.array_distinct(tokens("query"))).alias("item", "term"))
    items = materialize(items.select("query_id", "alternative", "item", F.lit(False).alias("minus"), F.lit(0).alias("offset"), "term"), "items")
    index, words = positional_index(docs, items.select("term"))
    scored = covers(index, words, items, matches(index, words, items))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)
