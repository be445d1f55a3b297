"""Exact and near duplicate selection over ``documents``."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.session import discard, materialize, table


def folded(text):
    """Lower case with sharp s as ss."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def normalized_fingerprint(text):
    """Digest of the letters-and-digits tokens joined by one space."""
    return F.sha2(F.array_join(F.regexp_extract_all(folded(text), F.lit(r"([\p{L}\p{N}]+)"), 1), " "), 256)


def simhash64(docs: DataFrame) -> DataFrame:
    """doc_id and a signed 64-bit SimHash: tokens weigh as often as they occur, ties set the bit.

    The bits of all tokens are counted where the text is, so one row a document is shuffled. Two bits
    share a sum: bit b in its low half, bit b + 32 in its high half.
    """
    tokens = F.regexp_extract_all(folded("text"), F.lit(r"([\p{L}\p{N}]+)"), 1)
    hashed = docs.select("doc_id", F.explode_outer(tokens).alias("token")).withColumn("h", F.expr("cast(conv(substr(sha2(token, 256), 1, 16), 16, -10) as bigint)"))
    sums = hashed.groupBy("doc_id").agg(
        F.count("token").alias("tokens"), *[F.expr(f"coalesce(sum(shiftrightunsigned(h, {b}) & 4294967297L), 0L)").alias(f"b{b}") for b in range(32)]
    )
    low = [f"IF(2 * (b{b} & 4294967295L) >= tokens, shiftleft(1L, {b}), 0L)" for b in range(32)]
    high = [f"IF(2 * shiftrightunsigned(b{b}, 32) >= tokens, shiftleft(1L, {b + 32}), 0L)" for b in range(32)]
    return sums.select("doc_id", F.expr(" | ".join(low + high)).alias("simhash"))


def similarity(a, b):
    return F.round(1 - F.bit_count(a.bitwiseXOR(b)) / 64, 6)


#: Distinct hashes that one key may hold on average, and hashes of a slice of a key that holds more.
BUCKET, SLICE = 4096, 2048
#: Cells of a matrix of compared hashes.
CELLS = 1 << 20


def _blocks(count: int) -> list[int]:
    """Masks of ``count`` blocks of bits that together are the 64 bits, as signed numbers."""
    sizes = [64 // count + (k < 64 % count) for k in range(count)]
    masks = [((1 << size) - 1) << sum(sizes[:k]) for k, size in enumerate(sizes)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _keyed(count: int, threshold: float):
    """(bits that may differ, number of equal blocks, masks of blocks, a function that gives hashes their keys) for so many distinct hashes.

    At most h bits differ, so of h + r blocks of bits r or more are equal: candidates are the hashes that
    share a choice of r blocks. r follows the number of hashes, so that a key holds few of
    them; the result is the same for every r.
    """
    h = max(d for d in range(65) if round(1 - d / 64, 6) >= threshold)
    r = next((r for r in range(1, 5) if count >> (64 * r // (h + r)) <= BUCKET), 4)
    blocks = _blocks(h + r)
    # Blocks share no bit, so sums of masks are their unions.
    choices = [F.struct(F.lit(sum(1 << k for k in c)).alias("choice"), F.lit(sum(blocks[k] for k in c)).alias("mask")) for c in combinations(range(h + r), r)]

    def keyed(hashes: DataFrame) -> DataFrame:
        return hashes.withColumn("c", F.explode(F.array(*choices))).select("simhash", "c.choice", F.col("simhash").bitwiseAND(F.col("c.mask")).alias("key"))

    return h, r, blocks, keyed


def _slices(n: str):
    return F.ceil(F.col(n) / SLICE).cast("int")


def near_pairs(hashes: DataFrame, threshold: float = 0.92) -> DataFrame:
    """(simhash, other, similarity) of all pairs of distinct hashes at or above the threshold.

    Candidates share a key (:func:`_keyed`). A pair comes up once, at its first r equal blocks.
    Hashes of a key are compared as matrices. A key of many hashes is dealt into slices that meet in
    pairs, each in a group of its own, so no group holds more than about two slices and nothing is broadcast.
    Documents of one hash are one row; ``simhash64`` tells which they are.
    """
    distinct = materialize(hashes.where("simhash IS NOT NULL").select("simhash").distinct(), "hashes")
    count = distinct.count()
    h, r, blocks, keys_of = _keyed(count, threshold)
    keyed = keys_of(distinct)
    sizes = keyed.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sliced = keyed.join(sizes.withColumn("slices", _slices("n")).hint("shuffle_hash"), ["choice", "key"])
    own = sliced.withColumn("own", F.pmod(F.xxhash64("simhash"), F.col("slices")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    dealt = own.select("choice", "key", F.least("own", "with").alias("a"), F.greatest("own", "with").alias("b"), "own", "simhash")
    # The small table is dealt to many tasks: its bytes say nothing of the comparisons.
    tasks = max(int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions")), count // 4096)
    keys = ["choice", "key", "a", "b"]
    found = dealt.repartition(tasks, *keys).groupBy(*keys).applyInArrow(lambda group: _compared(group, blocks, h, r), "simhash long, other long, bits int")
    return found.select("simhash", "other", F.round(1 - F.col("bits") / 64, 6).alias("similarity"))


def near_to(hashes: DataFrame, chosen: DataFrame, threshold: float = 0.92) -> DataFrame:
    """(simhash, other, similarity) of distinct hashes of ``hashes`` and of ``chosen`` (other) that differ, at or above the threshold.

    As :func:`near_pairs`, but only slices of the one side meet slices of the other: pairs follow the
    number of chosen hashes near a hash, not the number of all.
    """
    left = hashes.where("simhash IS NOT NULL").select("simhash").distinct()
    right = materialize(chosen.where("simhash IS NOT NULL").select("simhash").distinct(), "chosen")
    count = left.count()
    h, r, blocks, keys_of = _keyed(count, threshold)
    sides = []
    for df, n in ((left, "n"), (right, "m")):
        keyed = keys_of(df)
        sides.append((keyed, keyed.groupBy("choice", "key").agg(F.count(F.lit(1)).alias(n))))
    (keyed, n), (picked, m) = sides
    both = m.join(n, ["choice", "key"]).select("choice", "key", _slices("n").alias("of"), _slices("m").alias("by")).hint("shuffle_hash")
    part = lambda c: F.pmod(F.xxhash64("simhash"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    asked = keyed.join(both, ["choice", "key"]).select("choice", "key", part("of").alias("a"), every("by").alias("b"), F.lit(False).alias("is_chosen"), "simhash")
    by = picked.join(both, ["choice", "key"]).select("choice", "key", every("of").alias("a"), part("by").alias("b"), F.lit(True).alias("is_chosen"), "simhash")
    tasks = max(int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions")), count // 4096)
    keys = ["choice", "key", "a", "b"]

    def compared(group: pa.Table) -> pa.Table:
        values, is_chosen = group["simhash"].to_numpy(), group["is_chosen"].to_numpy()
        return _met(values[~is_chosen], values[is_chosen], group["choice"][0].as_py(), blocks, h, r)

    found = asked.unionByName(by).repartition(tasks, *keys).groupBy(*keys).applyInArrow(compared, "simhash long, other long, bits int")
    return found.where("simhash <> other").select("simhash", "other", F.round(1 - F.col("bits") / 64, 6).alias("similarity"))


def _compared(group: pa.Table, blocks: list[int], h: int, r: int) -> pa.Table:
    """The near pairs of one group, of a slice with itself or of two slices, the smaller hash first."""
    choice, a, b = (group[c][0].as_py() for c in ("choice", "a", "b"))
    values, own = group["simhash"].to_numpy(), group["own"].to_numpy()
    found = _met(values[own == a], values[own == b], choice, blocks, h, r, once=a == b)
    x, y = found["simhash"].to_numpy(), found["other"].to_numpy()
    return pa.table([np.minimum(x, y), np.maximum(x, y), found["bits"]], names=["simhash", "other", "bits"])


def _met(left: np.ndarray, right: np.ndarray, choice: int, blocks: list[int], h: int, r: int, once: bool = False) -> pa.Table:
    """Pairs of two slices at most h bits apart whose first r equal blocks are the choice; of both orders of a pair one, if ``once``."""
    step, parts = max(1, CELLS // max(1, len(right))), []
    for at in range(0, len(left), step):
        bits = np.bitwise_count((left[at : at + step, None] ^ right[None, :]).view(np.uint64))
        i, j = np.nonzero(bits <= h)
        x, y, n = left[at + i], right[j], bits[i, j]
        if once:
            smaller = x < y
            x, y, n = x[smaller], y[smaller], n[smaller]
        equal = sum((((x ^ y) & mask) == 0).astype(np.int64) << k for k, mask in enumerate(blocks))
        first = np.zeros(len(x), np.int64)
        for _ in range(r):
            lowest = equal & -equal
            first, equal = first | lowest, equal ^ lowest
        keep = first == choice
        parts.append((x[keep], y[keep], n[keep].astype(np.int32)))
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)]
    return pa.table(columns, names=["simhash", "other", "bits"])


KEYS = {"raw_hash": "exact_raw_sha256", "cleaned_hash": "exact_cleaned_sha256", "normalized_hash": "normalized_sections_sha256"}


#: Classes of rows that the first batch of a selection by near matches takes, about.
BATCH = 16_384


def _first_of(rows: DataFrame, key: str) -> DataFrame:
    """The best rank of each value of a key: (f_<key>, m_<key>)."""
    return rows.groupBy(F.col(key).alias(f"f_{key}")).agg(F.min("rank").alias(f"m_{key}"))


def _retained(undecided: DataFrame, linked: list[str], near: DataFrame | None) -> DataFrame:
    """The retained classes of a batch, by rounds of joins.

    A class is retained once no undecided linked one ranks before it, and excluded once linked to a
    retained one. The first undecided class is retained in every round, so rounds end.
    """
    parts, columns = [], undecided.columns
    while not undecided.isEmpty():
        best = undecided
        for key in linked:
            best = best.join(_first_of(undecided, key), F.col(key) == F.col(f"f_{key}"), "left").where(f"m_{key} IS NULL OR rank <= m_{key}").drop(f"f_{key}", f"m_{key}")
        if near is not None:
            around = near.join(_first_of(undecided, "simhash"), F.col("other") == F.col("f_simhash")).groupBy(F.col("simhash").alias("n_simhash")).agg(F.min("m_simhash").alias("n"))
            best = best.join(around, F.col("simhash") == F.col("n_simhash"), "left").where("n IS NULL OR rank < n").drop("n_simhash", "n")
        best = materialize(best.select(*columns), "retained")
        parts.append(best)
        before, undecided = undecided, materialize(_beyond(undecided, best, linked, near), "undecided")
        discard(before)
    out = undecided
    for part in parts:
        out = out.unionByName(part)
    out = materialize(out, "kept")
    for df in (undecided, *parts):
        discard(df)
    return out


def _beyond(rows: DataFrame, kept: DataFrame, linked: list[str], near: DataFrame | None) -> DataFrame:
    """The rows that are linked to none of the retained ones."""
    for key in linked:
        rows = rows.join(kept.select(F.col(key).alias("k")), F.col(key) == F.col("k"), "left_anti")
    if near is not None:
        gone = near.join(kept.select(F.col("simhash").alias("b")), F.col("other") == F.col("b")).select(F.col("simhash").alias("k"))
        rows = rows.join(gone, F.col("simhash") == F.col("k"), "left_anti")
    return rows


def select_canonical(rows: DataFrame, threshold: float | None = None) -> DataFrame:
    """Greedy selection in priority order: a row is compared with retained rows only.

    ``rows`` has identity, pinned, connector_rank, stable_order, raw_hash, cleaned_hash and
    normalized_hash, and with a threshold simhash. The first exact match in priority order wins, else the
    best near score. Rows are numbered in priority order by range partitions, and rows equal in all hashes
    are one class. With near matches, classes are decided in batches by rank, each twice as large
    as the one before: what is near to a class retained earlier is out before its batch begins, so
    the pairs within batches and those with retained classes grow with the rows, where all pairs grow with
    their square. No task gathers a group.
    """
    spark, close = rows.sparkSession, None
    linked = [*KEYS] if threshold is None else [*KEYS, "simhash"]
    order = [F.when(F.col("pinned"), 0).otherwise(1), F.col("connector_rank"), F.col("stable_order"), F.col("identity")]
    rows = rows.select("identity", *[o.alias(f"o{n}") for n, o in enumerate(order)], *[F.coalesce(k, F.lit("")).alias(k) for k in KEYS], *linked[len(KEYS) :])
    places = ["o0", "o1", "o2", "o3"]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = rows.repartitionByRange(tasks, *places).sortWithinPartitions(*places).withColumn("rank", F.monotonically_increasing_id())
    rows = materialize(numbered.select("identity", "rank", *linked), "selection")
    classes = materialize(rows.groupBy(*linked).agg(F.min("rank").alias("rank")), "classes")
    if threshold is None:
        kept = _retained(materialize(classes, "undecided"), linked, None)
    else:
        count = F.count(F.lit(1)).alias("n")
        sizes = sorted((r.part, r.n) for r in classes.groupBy(F.shiftright("rank", 33).alias("part")).agg(count).collect())  # a row a partition
        kept, hashes, closes = None, materialize(classes.select("simhash").distinct(), "hashes"), []
        for low, high in _batches(sizes):
            batch = classes.where(F.shiftright("rank", 33).between(low, high))
            batch = materialize(batch if kept is None else _beyond(batch, kept, linked, close), "undecided")
            pairs = near_pairs(batch, threshold)
            near = materialize(pairs.unionByName(pairs.select(F.col("other").alias("simhash"), F.col("simhash").alias("other"), "similarity")), "near")
            new = _retained(batch, linked, near)
            discard(near)
            closes.append(materialize(near_to(hashes, new, threshold), "close"))
            kept = new if kept is None else kept.unionByName(new)  # one table a batch
            close = closes[0]
            for other in closes[1:]:
                close = close.unionByName(other)
        if kept is None:
            kept = classes
    names = rows.select(F.col("rank").alias("k_rank"), F.col("identity").alias("k_identity")).join(kept.select("rank"), F.col("k_rank") == F.col("rank"), "left_semi")
    # A value of a key has one retained row at most, so these joins multiply nothing.
    for key in KEYS:
        rows = rows.join(_first_of(kept, key), F.col(key) == F.col(f"f_{key}"), "left").drop(f"f_{key}")
    found = [F.when(F.col(f"m_{key}") < F.col("rank"), F.struct(F.col(f"m_{key}").alias("m"), F.lit(k).alias("k"))) for k, key in enumerate(KEYS)]
    rows = rows.withColumn("exact", F.least(*found)).select("identity", "rank", *linked[len(KEYS) :], "exact")
    method = F.when(F.col("exact").isNotNull(), F.element_at(F.array(*map(F.lit, KEYS.values())), F.col("exact.k") + 1))
    match, score = F.col("exact.m"), F.lit(1.0)
    if close is not None:
        own = kept.select("simhash", F.col("simhash").alias("other"), F.lit(1.0).alias("similarity"))
        around = close.unionByName(own).join(_first_of(kept, "simhash"), F.col("other") == F.col("f_simhash")).drop("other", "f_simhash")
        asked = rows.where("exact IS NULL").select("rank", "simhash").join(around, "simhash").where("m_simhash < rank")
        nearest = asked.groupBy(F.col("rank").alias("n_rank")).agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("m_simhash").alias("m"))).alias("nearest"))
        rows = rows.join(nearest, F.col("rank") == F.col("n_rank"), "left")
        method, match = F.coalesce(method, F.when(F.col("nearest").isNotNull(), "simhash64")), F.coalesce(match, F.col("nearest.m"))
        score = F.coalesce(-F.col("nearest.s"), score)
    rows = rows.select("identity", "rank", match.alias("match"), method.alias("method"), score.alias("similarity"))
    rows = rows.join(names, F.col("match") == F.col("k_rank"), "left")
    # A row that was given twice is no copy of itself.
    other = F.when(F.col("k_identity") != F.col("identity"), F.col("k_identity"))
    return rows.select(
        "identity", F.when(other.isNull(), "retained").otherwise("excluded").alias("outcome"), F.coalesce(other, F.col("identity")).alias("retained_identity"),
        F.when(other.isNull(), "unique").otherwise(F.col("method")).alias("method"), F.when(other.isNull(), 1.0).otherwise(F.col("similarity")).alias("similarity"),
    )


def _batches(sizes: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """First and last parts of batches of about BATCH classes, then twice as many each; ``sizes`` are (part, classes)."""
    out, want, held, low = [], BATCH, 0, None
    for part, n in sizes:
        low, held = part if low is None else low, held + n
        if held >= want:
            out.append((low, part))
            want, held, low = want * 2, 0, None
    if low is not None:
        out.append((low, sizes[-1][0]))
    return out


def with_provenance(decisions: DataFrame, sources: DataFrame) -> DataFrame:
    """Retained rows with the sources of what they stand for, sorted; (identity, source) given."""
    also = decisions.where("outcome = 'excluded'").join(sources, "identity").groupBy("retained_identity").agg(F.array_sort(F.collect_set("source")).alias("also_found"))
    kept = decisions.where("outcome = 'retained'").select("identity")
    return kept.join(also, F.col("identity") == F.col("retained_identity"), "left").select("identity", F.array_join(F.coalesce("also_found", F.array()), ",").alias("also_found"))


def _word_runs(words, size: int):
    """Distinct hashes of the runs of ``size`` words."""
    starts = F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)])))


def distinct_items(items: DataFrame, run: int = 3) -> DataFrame:
    """Drops an item whose normalised text lies within a better-ranked one of the same query.

    Wherever a text lies, all its words but the outer ones are words there. So of each text one run of inner words,
    the rarest among its query's items, is joined with the runs of all others (one inner word, if it has
    no more), and only what shares it is compared. Texts of one or two words are searched in their query's
    other texts. Equal texts are one, whatever their number.
    """
    rows = items.withColumn("t", F.trim(F.regexp_replace("text", r"\s+", " ")))
    texts = rows.groupBy("query_id", "t").agg(F.min("rank").alias("r")).withColumn("id", F.monotonically_increasing_id())
    texts = materialize(texts.withColumn("w", F.split("t", " ")), "texts")
    inner = F.slice("w", F.lit(2), F.greatest(F.size("w") - 2, F.lit(0)))
    size = F.when(F.size(inner) >= run, run).when(F.size(inner) > 0, 1)
    held = texts.select("query_id", "id", "r", F.explode(F.array(F.lit(1), F.lit(run))).alias("n"), "w")
    held = held.select("query_id", "id", "r", "n", F.explode(F.when(F.col("n") == 1, _word_runs(F.col("w"), 1)).otherwise(_word_runs(F.col("w"), run))).alias("h"))
    counts = held.groupBy("query_id", "n", "h").agg(F.count(F.lit(1)).alias("texts"))
    own = texts.withColumn("n", size).withColumn("inner", inner).select("query_id", "id", "n", F.explode(F.when(F.col("n") == 1, _word_runs(F.col("inner"), 1)).otherwise(_word_runs(F.col("inner"), run))).alias("h"))
    rare = own.join(counts, ["query_id", "n", "h"]).groupBy("query_id", F.col("id").alias("a")).agg(F.min(F.struct("texts", "n", "h")).alias("m")).select("query_id", "a", "m.n", "m.h")
    pairs = rare.join(held, ["query_id", "n", "h"]).where("a <> id").select("a", F.col("id").alias("b"))
    left, right = texts.select(F.col("id").alias("a"), "t"), texts.select(F.col("id").alias("b"), F.col("t").alias("whole"), "r")
    within = pairs.join(left, "a").join(right, "b").where(F.col("whole").contains(F.col("t"))).select("a", "r")
    few = texts.where(F.size("w") <= 2).select("query_id", F.col("id").alias("a"), "t")
    other = texts.select(F.col("query_id").alias("q"), F.col("t").alias("whole"), "r")
    within = within.unionByName(few.join(other, (F.col("query_id") == F.col("q")) & F.col("whole").contains(F.col("t"))).select("a", "r"))
    best = texts.select(F.col("id").alias("a"), "r").unionByName(within).groupBy("a").agg(F.min("r").alias("best"))
    best = best.join(texts.select(F.col("id").alias("a"), F.col("query_id").alias("q"), F.col("t").alias("of")), "a")
    # A row goes if its text, or one that holds it, has a better rank.
    kept = rows.join(best.select("q", "of", "best"), (F.col("query_id") == F.col("q")) & (F.col("t") == F.col("of")))
    return kept.where(F.col("best") >= F.col("rank")).drop("t", "q", "of", "best")


def exact_dedup_documents(spark, sf_dir):
    """One row per distinct text: its hash, the smallest doc_id and the number of copies.

    Null texts count as empty. Only the 64-digit hash is shuffled, after partial aggregation.
    """
    return (
        table(spark, sf_dir, "documents")
        .select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), "doc_id")
        .groupBy("content_hash")
        .agg(F.min("doc_id").alias("kept_doc_id"), F.count(F.lit(1)).alias("copies"))
    )


def q_normalized(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", normalized_fingerprint("text").alias("fingerprint"))
    return docs.groupBy("fingerprint").agg(F.min("doc_id").alias("kept_doc_id"), F.count(F.lit(1)).alias("copies"))


def q_simhash(spark, sf):
    return simhash64(table(spark, sf, "documents"))


def q_near_pairs(spark, sf):
    hashes = materialize(simhash64(table(spark, sf, "documents")), "simhash")
    return near_pairs(hashes)


def q_canonical(spark, sf):
    """Connector priority: src3 before src1 before the rest, then doc_id."""
    rank = F.when(F.col("source") == "src3", 0).when(F.col("source") == "src1", 1).otherwise(2)
    docs = table(spark, sf, "documents").select(F.sha2("text", 256).alias("content_hash"), "doc_id", rank.alias("connector_rank"))
    best = docs.groupBy("content_hash").agg(F.min(F.struct("connector_rank", "doc_id")).alias("m"))
    return best.select("content_hash", F.col("m.doc_id").alias("canonical_doc_id"))


def _candidates(spark, sf, near: bool = False):
    docs = table(spark, sf, "documents")
    rank = F.when(F.col("source") == "src3", 0).when(F.col("source") == "src1", 1).otherwise(2)
    clean = F.trim(F.regexp_replace("text", r"\s+", " "))
    rows = docs.select(
        F.col("doc_id").alias("identity"), (F.col("doc_id") == 11).alias("pinned"), rank.alias("connector_rank"), F.col("doc_id").alias("stable_order"),
        F.sha2("text", 256).alias("raw_hash"), F.sha2(clean, 256).alias("cleaned_hash"), normalized_fingerprint("text").alias("normalized_hash"), "source",
    )
    return rows if not near else rows.join(simhash64(docs), F.col("identity") == F.col("doc_id")).drop("doc_id")


def q_select_exact(spark, sf):
    return select_canonical(_candidates(spark, sf).drop("source"))


def q_select_near(spark, sf):
    return select_canonical(materialize(_candidates(spark, sf, near=True).drop("source"), "candidates"), 0.92)


def q_provenance(spark, sf):
    rows = _candidates(spark, sf)
    return with_provenance(select_canonical(rows.drop("source")), rows.select("identity", "source"))


def q_crawl(spark, sf):
    """Pages whose text repeats an earlier one of 200 characters or more are duplicates of its owner."""
    text = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    pages = table(spark, sf, "documents").select("doc_id", F.sha2(text, 256).alias("h"), F.length(text).alias("n"))
    owner = F.min("doc_id").over(Window.partitionBy("h"))
    return pages.select("doc_id", F.when(F.col("n") >= 200, owner).otherwise(F.col("doc_id")).alias("owner")).withColumn("outcome", F.when(F.col("owner") == F.col("doc_id"), "kept").otherwise("content_duplicate"))


def q_same_item(spark, sf):
    """The newest document of each (source, length) stands for the item; then one per cleaned hash."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars", F.sha2(F.trim(F.regexp_replace("text", r"\s+", " ")), 256).alias("h"))
    latest = docs.withColumn("n", F.row_number().over(Window.partitionBy("source", "n_chars").orderBy(F.desc("doc_id")))).where("n = 1")
    first = F.row_number().over(Window.partitionBy("h").orderBy("doc_id"))
    return latest.withColumn("m", first).where("m = 1").select("doc_id", "source")


def q_distinct_items(spark, sf):
    """Turns of a conversation as its ranked items."""
    items = table(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), "text").where("text <> ''")
    return distinct_items(items).select("query_id", "rank")


_NORM = r"sha256(array_to_string(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}]+'), ' '))"
_SIMHASH = r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}]+')) AS token FROM documents),
  h AS (SELECT doc_id, CAST(('0x' || left(sha256(token), 16)) AS UBIGINT) AS h, count(*) AS n FROM t GROUP BY 1, 2),
  b AS (SELECT doc_id, b, sum(CASE WHEN ((h >> b) & 1) = 1 THEN n ELSE -n END) AS w FROM h, (SELECT unnest(range(64))::UBIGINT AS b) GROUP BY 1, 2),
  s AS (SELECT doc_id, bit_or(CASE WHEN w >= 0 THEN (1::UBIGINT << b) ELSE 0::UBIGINT END) AS u FROM b GROUP BY 1),
  simhash AS (SELECT doc_id, CAST(CASE WHEN u >= 9223372036854775808 THEN u::HUGEINT - 18446744073709551616 ELSE u::HUGEINT END AS BIGINT) AS simhash FROM s)"""
_RANK = "CASE source WHEN 'src3' THEN 0 WHEN 'src1' THEN 1 ELSE 2 END"

QUERIES = {
    "exact_dedup_documents": (
        exact_dedup_documents,
        """SELECT sha256(coalesce(text, '')) AS content_hash, min(doc_id) AS kept_doc_id, count(*) AS copies
           FROM documents GROUP BY 1""",
    ),
    "normalized_fingerprint_groups": (q_normalized, f"SELECT {_NORM} AS fingerprint, min(doc_id) AS kept_doc_id, count(*) AS copies FROM documents GROUP BY 1"),
    "simhash64_documents": (q_simhash, f"{_SIMHASH} SELECT doc_id, simhash FROM simhash"),
    "near_duplicate_pairs": (
        q_near_pairs,
        f"""{_SIMHASH}, d AS (SELECT DISTINCT simhash FROM simhash)
        SELECT a.simhash, b.simhash AS other, round(1 - bit_count(xor(a.simhash, b.simhash)) / 64, 6) AS similarity FROM d a JOIN d b ON a.simhash < b.simhash
        WHERE bit_count(xor(a.simhash, b.simhash)) <= 5""",
    ),
    "canonical_document_per_hash": (q_canonical, f"SELECT sha256(text) AS content_hash, arg_min(doc_id, {_RANK} * 1000000000 + doc_id) AS canonical_doc_id FROM documents GROUP BY 1"),
    "greedy_duplicates_exact": (
        q_select_exact,
        f"""WITH c AS (SELECT doc_id, sha256(text) AS raw, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS clean, {_NORM} AS norm, CASE WHEN doc_id = 11 THEN 0 ELSE 1 END AS p, {_RANK} AS r FROM documents),
        k AS (SELECT *, first_value(doc_id) OVER w AS kept, first_value(raw) OVER w AS kept_raw, first_value(clean) OVER w AS kept_clean FROM c WINDOW w AS (PARTITION BY norm ORDER BY p, r, doc_id))
        SELECT doc_id AS identity, CASE WHEN kept = doc_id THEN 'retained' ELSE 'excluded' END AS outcome, kept AS retained_identity,
        CASE WHEN kept = doc_id THEN 'unique' WHEN raw = kept_raw THEN 'exact_raw_sha256' WHEN clean = kept_clean THEN 'exact_cleaned_sha256' ELSE 'normalized_sections_sha256' END AS method, 1.0::DOUBLE AS similarity FROM k""",
    ),
    "greedy_duplicates_near": (q_select_near, None),
    "duplicate_provenance": (
        q_provenance,
        f"""WITH k AS (SELECT doc_id, source, first_value(doc_id) OVER (PARTITION BY {_NORM} ORDER BY CASE WHEN doc_id = 11 THEN 0 ELSE 1 END, {_RANK}, doc_id) AS kept FROM documents)
        SELECT kept AS identity, coalesce(string_agg(DISTINCT source, ',' ORDER BY source) FILTER (doc_id <> kept), '') AS also_found FROM k GROUP BY 1""",
    ),
    "crawl_content_duplicates": (
        q_crawl,
        """WITH p AS (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM documents), o AS (SELECT doc_id, CASE WHEN length(t) >= 200 THEN min(doc_id) OVER (PARTITION BY sha256(t)) ELSE doc_id END AS owner FROM p)
        SELECT doc_id, owner, CASE WHEN owner = doc_id THEN 'kept' ELSE 'content_duplicate' END AS outcome FROM o""",
    ),
    "same_item_then_cleaned_duplicates": (
        q_same_item,
        """WITH a AS (SELECT *, row_number() OVER (PARTITION BY source, n_chars ORDER BY doc_id DESC) AS n FROM documents),
        b AS (SELECT *, row_number() OVER (PARTITION BY sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) ORDER BY doc_id) AS m FROM a WHERE n = 1) SELECT doc_id, source FROM b WHERE m = 1""",
    ),
    "distinct_retrieved_items": (
        q_distinct_items,
        """WITH c AS (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations WHERE text <> '')
        SELECT conv_id AS query_id, turn AS rank FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.conv_id = a.conv_id AND b.turn < a.turn AND contains(b.t, a.t))""",
    ),
}
