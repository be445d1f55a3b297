import hashlib
import random
import unicodedata

from pyspark.sql import functions as F

from lexiloom.llm import digest
from lexiloom.llm.digest import canonical_digests, op3_canonical_digest


def canon(t):
    n = lambda s: unicodedata.normalize("NFKC", s)
    return " ".join(n(n(t).casefold()).split())


def check(rows, got):
    """rows: (doc_id, text) in order; got: result rows in the same order."""
    for i, ((d, t), r) in enumerate(zip(rows, got, strict=True)):
        after = rows[(i + 1) % len(rows)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        assert (r.doc_id, r.n_chars) == (d, len(t))
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == float(canon(t) == canon(edited))
        assert r.near_next == float(canon(t) == canon(after))
        same = [e for e, u in rows if canon(u) == canon(t)]
        assert (r.class_id, r.copies) == (min(same), len(same))
    by_print = {}
    for (_, t), r in zip(rows, got, strict=True):
        assert by_print.setdefault(r.fingerprint, canon(t)) == canon(t)
    assert len(by_print) == len({canon(t) for _, t in rows})


def test_small_table(spark):
    rows = [(-5000, "Straße  ﬁn"), (-1, ""), (0, "STRASSE fin "), (3, "é"), (1023, "é"), (1024, "É\n"), (10**7, "aaaa"), (10**12, "aaaa aaaa")]
    df = spark.createDataFrame([(d, t or None, 1) for d, t in rows], "doc_id long, text string, span int").repartition(3)
    got = sorted(canonical_digests(df).collect(), key=lambda r: r.doc_id)
    check(rows, got)
    assert canonical_digests(df.limit(0)).count() == 0
    alone = canonical_digests(df.where("doc_id = 3")).first()
    assert alone.near_next == 1.0


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (None, "x"), (1, "y")], "doc_id long, text string")
    got = canonical_digests(df).collect()
    assert len(got) == 4 and len({r.fingerprint for r in got}) == 2
    assert sorted(r.copies for r in got) == [1, 3, 3, 3]


def test_documents(spark):
    rows = sorted(tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect())
    check(rows, sorted(op3_canonical_digest(spark, "/root/testdata/sf0.001").collect(), key=lambda r: r.doc_id))


def test_ties_and_sparse_ids_in_many_partitions(spark):
    rng = random.Random(2)
    rows = [(rng.choice((None, 5, 5, rng.randrange(-(10**15), 10**15))), rng.choice(("", "A b", "a  B", "x" * rng.randrange(9), "ẞé"))) for _ in range(400)]
    got = canonical_digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(r[1].encode()).hexdigest()))
    want = []
    for i, (d, t) in enumerate(order):
        after, cut = order[(i + 1) % len(order)][1], len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        same = [e for e, u in order if canon(u) == canon(t)]
        want.append((str(d), len(t), hashlib.sha256(edited.encode()).hexdigest(), float(canon(t) == canon(after)), float(canon(t) == canon(edited)), str(min([e for e in same if e is not None], default=d)), len(same)))
    assert sorted(want) == sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.near_next, r.near_edited, str(r.class_id), r.copies) for r in got)


def test_colliding_fingerprints_are_told_apart_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(digest, "halves", lambda c: (F.length(c).cast("long").alias("f1"), F.lit(0).cast("long").alias("f2")))
    df = spark.createDataFrame([(1, "ab"), (2, "cd"), (3, "AB"), (4, "xyz"), (5, "cd"), (6, "ab"), (7, "q")], "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id, r.copies) for r in canonical_digests(df).collect()) == [(1, 1, 3), (2, 2, 2), (3, 1, 3), (4, 4, 1), (5, 2, 2), (6, 1, 3), (7, 7, 1)]


def test_very_long_text(spark):
    long = "Ünïcode  words " * 100_000
    got = {r.doc_id: r for r in canonical_digests(spark.createDataFrame([(1, long), (2, "b" * 500_000), (3, long)], "doc_id long, text string")).collect()}
    assert got[1].edited_sha256 == hashlib.sha256((long[: len(long) - len(long) // 4] + "b" * (len(long) // 4)).encode()).hexdigest() and got[3].class_id == 1


def test_no_python_in_the_plan(spark, capsys):
    op3_canonical_digest(spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
