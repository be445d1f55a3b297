import random

import numpy as np
import pytest

from lexiloom.operators import nearest
from lexiloom.operators.nearest import search


def brute(corpus, queries, k, cutoff=None):
    def unit(v):
        x = np.array(v, dtype=float)
        return x / np.sqrt((x * x).sum())

    good = [(i, unit(v)) for i, v in corpus if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = []
    for q, v in queries:
        u = unit(v)
        scored = sorted((round(float(1 - u @ x), 6) + 0.0, i) for i, x in good if len(x) == len(u))
        out += [(q, i, n) for n, (d, i) in enumerate([s for s in scored if cutoff is None or s[0] <= cutoff][:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [1024, 5])
def test_equal_to_comparing_everything(spark, monkeypatch, block):
    monkeypatch.setattr(nearest, "BLOCK", block)
    monkeypatch.setattr(nearest, "ASKED", block)
    rng = random.Random(1)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    corpus = [(i, [c + rng.gauss(0, 0.2) for c in rng.choice(centres)]) for i in range(400)]
    corpus += [(1000 + i, centres[3]) for i in range(200)]  # a third are copies
    corpus += [(2000, None), (2001, []), (2002, [0.0] * 8), (2003, [1.0, None] + [0.0] * 6), (2004, [float("nan")] * 8), (None, centres[0]), (2005, [1.0, 2.0, 3.0]), (2006, [3.0, 2.0, 3.0])]
    queries = [(i, v) for i, v in corpus[:400:20]] + [(1000, centres[3]), (2005, [1.0, 2.0, 3.0]), (7000, [-c for c in centres[1]])]
    c = spark.createDataFrame(corpus, "vec_id long, embedding array<double>").repartition(4)
    q = spark.createDataFrame(queries, "vec_id long, embedding array<double>")
    for k, cutoff in ((7, None), (7, 0.05), (1000, None), (3, 0.0), (2, -1.0)):
        found, _ = search(c, q, k, cutoff)
        assert sorted((r.query_id, r.vec_id, r["rank"]) for r in found.collect()) == brute(corpus, queries, k, cutoff), (k, cutoff)
    assert search(c.limit(0), q)[0].count() == 0 and search(c, q.limit(0))[0].count() == 0


def test_most_distances_are_never_computed(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (40, 16))
    x = centres[rng.integers(0, 40, 4000)] + rng.normal(0, 0.05, (4000, 16))
    corpus = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    found, looked = search(corpus, corpus.where("vec_id % 20 = 0"), 5)
    assert found.count() == 1000 and looked.first().distances < 0.2 * 4000 * 200
