import itertools
import zlib

import numpy as np

from lexiloom.llm import quality
from lexiloom.llm.quality import fit, keep_good, line_features, marginals, op2_crf_quality, score, train


def test_marginals_match_enumeration():
    rng = np.random.default_rng(4)
    lines = np.array([3, 0, 5, 1])
    scores, move = rng.normal(size=9), rng.normal(size=(2, 2))
    got = marginals(scores, move, lines)[2]
    want, at = [], 0
    for n in lines:
        mass = np.zeros(n)
        total = 0.0
        for labels in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(scores[at + i] * y for i, y in enumerate(labels)) + sum(move[a, b] for a, b in itertools.pairwise(labels)))
            total += w
            mass += w * np.array(labels)
        want += list(mass / total)
        at += n
    assert np.allclose(got, want)


def test_features_do_not_depend_on_the_batch():
    texts = ["One two.\n\nAB CD!!", None, "", " \n\t", "x | y | z\nx x x x", "é É ü"]
    x, size, lines = line_features(texts)
    assert lines.tolist() == [2, 0, 0, 0, 2, 1]
    alone = [line_features([t]) for t in texts]
    assert np.allclose(x, np.concatenate([a[0] for a in alone])) and np.allclose(size, np.concatenate([a[1] for a in alone]))


def test_held_out_accuracy_and_edge_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in op2_crf_quality(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.predicted == int(r.score >= 0.3) for r in rows)
    right = [r.predicted == labels[r.doc_id] for r in rows]
    assert len(right) > 500 and np.mean(right) > 0.98
    bad = [r.predicted for r in rows if labels[r.doc_id] == 0]
    assert np.mean(bad) < 0.05

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf}/labels.parquet"), sample=300)
    edge = spark.createDataFrame([(None, "A text. " * 9, 1), (1, None, 2), (1, "", 3), (2, "\n \n", 4)], "doc_id long, text string, score int")
    got = sorted((str(r.doc_id), r.predicted, r.held_out) for r in score(edge, model).collect())
    assert [g[:2] for g in got if g[0] != "None"] == [("1", 0), ("1", 0), ("2", 0)] and len(got) == 4
    assert score(edge.limit(0), model).count() == 0 and keep_good(edge, model).columns == edge.columns


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    assert score(docs, train(docs, labels)).first().score == 0.5
    assert fit(np.empty((0, 34)), np.empty(0), np.zeros(0, dtype=int), np.zeros(0, dtype=int)).weights is None


def test_training_reads_whole_texts(spark):
    good, bad = "Ordinary words stand in a line of text.", "##### $$$$ @@@@ %%%% ^^^^ &&&&"
    docs = spark.createDataFrame([(i, "\n".join([good] * 80 if i % 2 else [good] * 64 + [bad] * 60)) for i in range(200)], "doc_id long, text string")
    model = train(docs, spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int"))
    probe = spark.createDataFrame([(1, "\n".join([good] * 80)), (2, "\n".join([bad] * 80))], "doc_id long, text string")
    found = {r.doc_id: r.score for r in score(probe, model).collect()}
    assert found[1] > found[2] + 0.3, found


def test_very_long_text_and_very_long_line(spark):
    docs = spark.createDataFrame([(1, "A plain line of text.\n" * 60000), (2, "word " * 300000)], "doc_id long, text string")
    sf = "/root/testdata/sf0.01"
    model = train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert sorted(r.doc_id for r in score(docs, model).collect()) == [1, 2]


def test_repeated_rows_of_a_sampled_id_are_one_text(spark, monkeypatch):
    good, bad = "A calm sentence about the house and its garden, which goes on. " * 4, "BUY NOW!!! $$$ 999 === CLICK >>> "
    rows = [(n, good if n % 2 else bad) for n in range(60)]
    labels = spark.createDataFrame([(n, n % 2) for n in range(60)], "doc_id long, quality int")
    once = train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    often = train(spark.createDataFrame(rows + [rows[7], rows[8]] * 400, "doc_id long, text string"), labels)
    assert (once.weights == often.weights).all()
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 3000)
    fewer = train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert fewer.score([good])[0] > 0.5 > fewer.score([bad])[0]
