import math
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from lexiloom.llm import vector_codes
from lexiloom.llm.vector_codes import ENTRIES, PARTS, ROUNDS, Codebook, Tree, compress, op11_vector_codes


def brute(rows):
    """rows: (vec_id, label, vector) -> ({row: (code, error)}, books), by the definition, with Python's integers."""
    order = lambda r: (r[0] is None, r[0] or 0, r[2])
    rows = [r for r in rows if r[2] and None not in r[2] and all(map(math.isfinite, r[2])) and len(r[2]) % PARTS == 0]
    dim = len(min(rows, key=order)[2])
    rows = sorted((r for r in rows if len(r[2]) == dim), key=order)
    w = dim // PARTS
    whole = [[int(v) * 4096 if abs(v) > 2.0**60 else math.floor(v * 4096) for v in r[2]] for r in rows]
    parts = [[x[p * w : (p + 1) * w] for x in whole] for p in range(PARTS)]
    books = [[list(v) for v in part[:ENTRIES]] for part in parts]
    nearest = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(ROUNDS):
        for p in range(PARTS):
            mine = defaultdict(list)
            for v in parts[p]:
                mine[nearest(v, books[p])[1]].append(v)
            for k, own in mine.items():
                books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [[nearest(parts[p][i], books[p]) for p in range(PARTS)] for i in range(len(rows))]
    errors = [sum(d for d, _ in f) for f in found]
    by = defaultdict(int)
    for r, e in zip(rows, errors, strict=True):
        by[r[1]] += e
    most = 2**63 - 1
    return sorted((str(r[0]), "".join(f"{k:02x}" for _, k in f), min(e, most), min(by[r[1]], most)) for r, f, e in zip(rows, found, errors, strict=True)), books


def check(spark, rows, parts=3, kind="float"):
    df = spark.createDataFrame([(*r, 1) for r in rows], f"vec_id long, label int, embedding array<{kind}>, part int").repartition(parts)
    got, books = compress(df)
    want, want_books = brute(rows)
    assert books == want_books
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in got.collect()) == want


def f32(x):
    return float(np.float32(x))


def test_rounds_equal_brute_force(spark):
    rng = random.Random(1)
    centres = [[rng.uniform(-1, 1) for _ in range(24)] for _ in range(9)]
    rows = [(i, rng.choice((None, 1, 2)), [f32(c + rng.gauss(0, 0.05)) for c in rng.choice(centres)]) for i in range(700)]
    rows += [(5000 + i % 3, 1, rows[7][2]) for i in range(300)]  # a third are copies of one vector, ids repeated
    check(spark, rows)


def test_nulls_lengths_and_few_rows(spark):
    good = [0.25] * 16
    rows = [(3, None, good), (None, 1, good), (1, 1, None), (0, 1, [None] + good[1:]), (2, 2, [float("nan")] + good[1:]), (4, 2, [float("inf")] + good[1:]),
            (5, 2, []), (6, 2, [1.0] * 9), (7, 2, [1.0] * 8), (8, 2, [-0.1] * 16)]
    check(spark, rows)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    assert compress(df.limit(0))[0].count() == 0 and compress(df.where("embedding IS NULL"))[0].count() == 0


def test_components_of_any_size(spark):
    rng = random.Random(2)
    rows = [(i, i % 2, [rng.choice((0.0, 1.5, -3e8, 1e30, -2.0**70, 5e300, 0.1)) for _ in range(16)]) for i in range(60)]
    rows += [(100 + i, None, [rng.uniform(-2, 2) for _ in range(16)]) for i in range(200)]
    check(spark, rows, kind="double")
    check(spark, rows[60:] + rows[:5], kind="double")  # few large ones, not among the first entries


def test_labels_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "FEW", 1)
    monkeypatch.setattr(vector_codes, "HEAVY", 4)
    rng = random.Random(3)
    check(spark, [(i, rng.choice((None, None, 1, 1, *range(20))), [f32(rng.uniform(-1, 1)) for _ in range(8)]) for i in range(200)])


def test_balls_hold_their_points_and_their_sums():
    rng = np.random.default_rng(4)
    for x in (rng.normal(0, 400, (900, 5)).astype(int), np.repeat(rng.normal(0, 400, (3, 4)).astype(int), 200, axis=0), np.zeros((500, 2), dtype=int), np.arange(1000).reshape(-1, 1) ** 2):
        tree = Tree.build(x)
        assert sorted(tree.order.tolist()) == list(range(len(x))) and (tree.points == x[tree.order]).all()
        for (s, e), c, r, total, kids in zip(tree.ranges, tree.centres, tree.radii, tree.sums, tree.children, strict=True):
            own = tree.points[s:e].astype(float)
            assert (own.sum(axis=0) == total).all() and (np.sqrt(((own - c) ** 2).sum(axis=1)) <= r + 1e-6).all()
            if kids[0] >= 0:
                assert tree.ranges[kids[0]][0] == s and tree.ranges[kids[1]][1] == e and tree.ranges[kids[0]][1] == tree.ranges[kids[1]][0]
        copy = Tree.unpacked(tree.packed(), x.shape[1])
        book = Codebook(x[:7].tolist()).array
        d = ((x[:, None, :].astype(float) - book[None]) ** 2).sum(axis=2)
        assert (copy.codes(book) == d.argmin(axis=1)).all()


def test_balls_are_owned_without_a_look_at_their_points():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 3000, (16, 8))
    x = np.floor(centres[rng.integers(0, 16, 4000)] + rng.normal(0, 60, (4000, 8))).astype(int)
    balls, _, places, _ = Tree.build(x).owners(np.floor(centres))
    assert len(places) < 200 and len(balls) < 400


def test_embeddings(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.label, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    want, books = brute(rows)
    got = op11_vector_codes(spark, sf)
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in got.collect()) == want
    assert [r[0] for r in got.select("codebooks_sha256").distinct().collect()] == [vector_codes.digest_of(books)]
    assert got.agg(F.count("*")).first()[0] == len(rows)
