"""Document fingerprints: a canonical exact digest, in DataFrame functions only.

A text is canonical after NFKC, full case folding, NFKC again, and folding of white space. Its
fingerprint is two seeded 64-bit xxhashes, as 32 hex digits. Documents are grouped by fingerprint
and, inside buckets of two or more, by the bytes of the canonical text, so a hash collision never
joins two texts.

Normalisation and folding call the Unicode library that ships with Spark through the SQL function
``reflect``; no row leaves the JVM.

The order of documents is that of a narrow table (id, length, fingerprint), range-partitioned by id and
sorted within its partitions; where a partition ends, the next one's first row follows, found in a
table of one row a partition. Dense and sparse ids are dealt alike. Only rows whose id is null or not
unique bring their texts into that table, and are ordered by digests of them. Texts are shuffled once, by key: each
document's successor sends it the few code points it needs, and it is edited where its text is.

Edge cases: a null text is empty; the empty text has a fingerprint like any other; equal texts
(repeated rows too) have equal fingerprints; rows order by (doc_id, SHA-256 of the text) with null ids
first, so the "next document" of ties is defined; the only document of a table is its own next; an empty
table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.session import discard, materialize, table

#: Repeated ids up to which they are broadcast.
FEW = 100_000


def canonical(text: Column) -> Column:
    icu = "com.ibm.icu."
    nfkc = lambda c: F.reflect(F.lit(icu + "text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = nfkc(F.reflect(F.lit(icu + "lang.UCharacter"), F.lit("foldCase"), nfkc(text), F.lit(True)))
    return F.trim(F.regexp_replace(folded, r"[\s\x{85}\x{1680}\x{2028}\x{2029}]+", " "))


def halves(canon: Column) -> tuple[Column, Column]:
    """The fingerprint as two longs."""
    return F.xxhash64(canon).alias("f1"), F.xxhash64(F.lit("second"), canon).alias("f2")


def fingerprint(first: Column, second: Column) -> Column:
    return F.concat(*(F.lpad(F.lower(F.hex(x)), 16, "0") for x in (first, second)))


def _parts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keyed, ordered): the texts by key, and the narrow table of all rows in order.

    keyed: tied, key, text. ordered: at (place in the order), tied, key, doc_id, n_chars, f1, f2. The key
    is the id where it is the only one (tied is false), else the place.
    """
    narrow = materialize(rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), *halves(canonical(F.col("text")))), "fingerprints")
    ids = narrow.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("r_id"))
    ids = materialize(ids, "repeated-ids")
    many, own = ids.count(), narrow.withColumn("text", F.lit(None).cast("string"))
    keyed = rows
    if many:
        repeated = F.broadcast(ids) if many <= FEW else ids
        same = F.col("doc_id") == F.col("r_id")
        tied = rows.join(repeated, same, "left_semi").unionByName(rows.where("doc_id IS NULL"))
        own = own.where("doc_id IS NOT NULL").join(repeated, same, "left_anti")
        keyed = rows.where("doc_id IS NOT NULL").join(repeated, same, "left_anti")
        own = own.unionByName(tied.select("doc_id", F.length("text").cast("long").alias("n_chars"), *halves(canonical(F.col("text"))), "text"))
    # Equal rows in any number may be dealt to several partitions: their order does not matter.
    own = own.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(4096)))
    own = unordered = materialize(own, "unordered")
    # The keys, of which range partitioning collects a sample, are short: no text is among them.
    own = own.withColumn("tie", F.sha2("text", 256))
    keys = (F.asc_nulls_first("doc_id"), F.asc_nulls_first("tie"), "salt")
    ordered = own.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
    ordered = ordered.withColumn("tied", F.col("text").isNotNull()).withColumn("at", F.monotonically_increasing_id())
    ordered = materialize(ordered.withColumn("key", F.when(F.col("tied"), F.col("at")).otherwise(F.col("doc_id").cast("long"))).drop("salt"), "ordered")
    for done in (narrow, unordered):
        discard(done)
    keyed = keyed.select(F.lit(False).alias("tied"), F.col("doc_id").cast("long").alias("key"), "text")
    if many:
        keyed = keyed.unionByName(ordered.where("tied").select("tied", "key", "text"))
    return keyed, ordered.drop("text")


def _with_next(ordered: DataFrame) -> DataFrame:
    """Every row with its successor's key and fingerprint; after the last comes the first."""
    part = F.shiftright("at", 33)  # the partition that numbered the row
    ends = ordered.groupBy(part.alias("part")).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    # One row a partition, so that this window and its broadcast do not grow with the rows.
    every = Window.partitionBy(F.lit(0))
    ends = ends.select("last", F.coalesce(F.lead("first").over(every.orderBy("part")), F.min("first").over(every)).alias("jump"))
    after = ordered.join(F.broadcast(ends), F.col("at") == F.col("last"), "left").withColumn("next_at", F.coalesce("jump", F.col("at") + 1)).drop("last", "jump")
    following = ordered.select(F.col("at").alias("a"), F.col("tied").alias("next_tied"), F.col("key").alias("next_key"), F.col("f1").alias("n1"), F.col("f2").alias("n2"))
    return after.join(following, F.col("next_at") == F.col("a"))


def _classes(keyed: DataFrame, ordered: DataFrame) -> DataFrame:
    """(at, class_id, copies) of the rows whose canonical bytes occur more than once or whose bucket holds other bytes."""
    buckets = ordered.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("f1").alias("b1"), F.col("f2").alias("b2"))
    shared = ordered.join(buckets, (F.col("f1") == F.col("b1")) & (F.col("f2") == F.col("b2"))).select("at", "tied", "key", "doc_id", "f1", "f2")
    shared = materialize(shared, "shared")
    # Always by key, whatever the size of the other side, so that cost grows in proportion.
    texts = keyed.hint("merge").join(shared, ["tied", "key"]).select("at", "doc_id", "f1", "f2", canonical(F.col("text")).alias("canon"))
    # Equal bytes meet before the shuffle, so a class of any size is one row per map task.
    bytes_of = texts.groupBy("f1", "f2", "canon").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    alone = bytes_of.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("kinds"), F.min("class_id").alias("class_id"), F.max("copies").alias("copies"))
    alone = materialize(alone, "buckets")
    out = shared.join(alone.where("kinds = 1"), ["f1", "f2"]).select("at", "class_id", "copies")
    collided = alone.where("kinds > 1").select("f1", "f2")
    if not collided.isEmpty():  # different bytes in one bucket: joined on the bytes themselves
        out = out.unionByName(texts.join(collided, ["f1", "f2"]).join(bytes_of, ["f1", "f2", "canon"]).select("at", bytes_of["class_id"], "copies"))
    return out


def canonical_digests(docs: DataFrame) -> DataFrame:
    """Every document with its own, its edited text's and its next document's digest, and its class.

    ``class_id`` is the smallest doc_id with the same canonical bytes and ``copies`` their number.
    """
    keyed, ordered = _parts(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    classes = _classes(keyed, ordered).select(F.col("at").alias("class_at"), "class_id", "copies")
    rows = _with_next(ordered).join(classes, F.col("at") == F.col("class_at"), "left").withColumn("take", F.expr("cast(floor(n_chars / 4) AS int)"))
    rows = materialize(rows.drop("class_at", "a", "next_at"), "rows")
    sent = (
        keyed.alias("t").hint("merge")
        .join(rows, (F.col("t.tied") == F.col("next_tied")) & (F.col("t.key") == F.col("next_key")))
        .select(*[rows[c] for c in rows.columns if c not in ("next_tied", "next_key")], F.expr("left(text, take)").alias("prefix"))
    )
    edited = F.concat(F.expr("left(text, cast(n_chars AS int) - take)"), "prefix")
    e1, e2 = halves(canonical(F.col("edited")))
    return (
        keyed.hint("merge").join(sent, ["tied", "key"])
        .withColumn("edited", edited)
        .select("*", e1.alias("e1"), e2.alias("e2"))
        .select(
            "doc_id",
            "n_chars",
            F.sha2("edited", 256).alias("edited_sha256"),
            fingerprint(F.col("f1"), F.col("f2")).alias("fingerprint"),
            fingerprint(F.col("e1"), F.col("e2")).alias("edited_fingerprint"),
            ((F.col("f1") == F.col("e1")) & (F.col("f2") == F.col("e2"))).cast("double").alias("near_edited"),
            ((F.col("f1") == F.col("n1")) & (F.col("f2") == F.col("n2"))).cast("double").alias("near_next"),
            F.coalesce("class_id", "doc_id").alias("class_id"),
            F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
        )
    )


def op3_canonical_digest(spark, sf_dir):
    return canonical_digests(table(spark, sf_dir, "documents"))


QUERIES = {"op3_canonical_digest": (op3_canonical_digest, None)}
