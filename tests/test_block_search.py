"""BM25 over blocks of documents is scoring everything, and only the best of a block leave it."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lexiloom.operators import search
from lexiloom.operators.search import bm25, bm25_blocks
from test_search import brute_bm25


@pytest.mark.parametrize("small", [False, True])
def test_blocks_equal_scoring_everything(spark, monkeypatch, small):
    if small:
        for name, value in (("BLOCK", 40), ("CHUNK_TOKENS", 100), ("BLOCK_TOKENS", 500), ("ASKED", 5)):
            monkeypatch.setattr(search, name, value)
    rng = random.Random(5)
    vocabulary = [f"w{n}" for n in range(60)]
    weights = [1 / (n + 1) for n in range(60)]
    docs = [(n, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(0, 40)))) for n in range(300)]
    docs += [(1000 + n, "w0 w1 w2 same") for n in range(150)] + [(2000, None), (2001, ""), (2002, "alone " * 300)]
    queries = [(n, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 7)))) for n in range(25)] + [(50, "same w0"), (51, "none"), (52, ""), (53, None), (54, "w0"), (55, "W0, w0 w59"), (56, "w0 same"), (57, "alone w59")]
    d = spark.createDataFrame([*docs, (None, "w0 w59")], "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(queries, "query_id long, query string")
    want = [r for r in brute_bm25([*docs, (-1, "w0 w59")], queries, 6)]
    want = brute_without(want)
    got = sorted((r.query_id, r.doc_id, r["rank"], r.score) for r in bm25_blocks(d, q, 5).collect())
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(got, want, strict=True))
    assert bm25_blocks(d.limit(0), q).count() == 0 and bm25_blocks(d, q.limit(0)).count() == 0


def brute_without(rows):
    """Without the document that has no id there (-1), the five best of each query."""
    out, seen = [], {}
    for q, d, s, _ in rows:
        if d != -1 and seen.get(q, 0) < 5:
            seen[q] = seen.get(q, 0) + 1
            out.append((q, d, seen[q], s))
    return sorted(out)


def test_many_queries_write_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(search, "FEW", 10)
    monkeypatch.setattr(search, "candidates", None)  # the way that writes a row a query and document
    docs = spark.createDataFrame([(n, f"all of them share these words {n % 7}") for n in range(200)], "doc_id long, text string")
    queries = spark.createDataFrame([(n, f"share these words {n % 7}") for n in range(50)], "query_id long, query string")
    assert bm25(docs, queries, 3).count() == 150


def test_later_blocks_hand_on_what_can_be_among_the_best(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choices(["often", "w1", "w2", "w3", "rare"], [60, 20, 10, 5, 1], k=rng.randrange(1, 30))) for _ in range(400)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(399)) + [None], "text": texts})
    block = pa.Table.from_batches(search._block_index([batch], search.word_ranges(spark), 1000, 1 << 20, 500))
    terms, idfs = [["often", "rare", "w2"], ["often"], ["gone", "w1", "often"]], [[0.1, 4.0, 2.0], [0.1], [9.0, 1.0, 0.1]]
    asked = lambda least: pa.table({"class": [3, 4, 5], "terms": terms, "idfs": idfs, "least": pa.array(least, pa.float64())})
    rows = lambda t: sorted(zip(*(t[c].to_pylist() for c in ("class", "whole", "doc_id")), strict=True), reverse=True)
    every = rows(search._best_of_block(block, asked([None] * 3), 10.0, 1000))
    want = {}
    for c, words, add in zip((3, 4, 5), terms, idfs, strict=True):
        for d, text in enumerate(texts[:399]):
            t = text.split()
            score = sum(i * (n := t.count(w)) * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(t) / 10.0)) for w, i in zip(words, add, strict=True))
            want |= {(c, d): score} if score else {}
    assert {(c, d) for c, _, d in every} == want.keys() and all(abs(s - want[c, d]) < 1e-9 for c, s, d in every)
    for k in (3, 40):
        best = {c: sorted((x for x in every if x[0] == c), key=lambda x: (-round(x[1], 6), x[2]))[:k] for c in (3, 4, 5)}
        bounds = [best[c][k // 2][1] for c in (3, 4, 5)]
        assert rows(search._best_of_block(block, asked([None] * 3), 10.0, k)) == sorted(sum(best.values(), []), reverse=True)
        above = rows(search._best_of_block(block, asked(bounds), 10.0, k))
        assert above == sorted((x for c, bound in zip((3, 4, 5), bounds, strict=True) for x in best[c] if x[1] >= bound - 2e-6), reverse=True) and len(above) < 3 * k
    assert search._best_of_block(block, asked([1e3] * 3), 10.0, 3).num_rows == 0


def test_blocks_of_vectors_are_full_whatever_the_batches_are(spark):
    from lexiloom.operators import nearest

    x = np.random.default_rng(3).normal(size=(3000, 8)).tolist()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        rows = spark.createDataFrame(list(enumerate(x)), "vec_id long, v array<double>").coalesce(1)
        blocks = nearest._blocks(rows, {8: np.eye(8)[:2]}, 1024).select("cell", "ids").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(blocks) <= 4 and sorted(i for b in blocks for i in b.ids) == list(range(3000))
