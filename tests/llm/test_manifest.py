import hashlib
import random
import zlib

import pytest

from lexiloom.llm import manifest as module
from lexiloom.llm.manifest import ARITY, digest, manifest, op13_merkle_manifest, rise, siblings, sink


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + ARITY])) for i in range(0, len(out[-1]), ARITY)])
    return out


def path(tree, i):
    out = []
    for level in tree[:-1]:
        start = i // ARITY * ARITY
        out.append((i - start, level[start : start + ARITY]))
        i //= ARITY
    return out


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text); the manifest by its definition."""
    code = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: sha("".join(map(code, (*r[:4], t))))
    low = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    by, trees, out = {}, {}, []
    for r in rows:
        by.setdefault(r[1], []).append(r)
    for s, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees[s] = levels([leaf(r, r[4]) for r in own])
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    top = levels([trees[s][-1][0] for s in order])
    for n, s in enumerate(order):
        for i, r in enumerate(by[s]):
            steps = path(trees[s], i) + path(top, n)
            d = leaf(r, low(r[4]) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r[4])
            for k, run in steps:
                d = sha("".join([*run[:k], d, *run[k + 1 :]]))
            out.append((str(r[0]), leaf(r, r[4]), trees[s][-1][0], top[-1][0], sha("".join("".join(run[:k] + run[k + 1 :]) for k, run in steps)), d, d == top[-1][0]))
    return sorted(out)


def check(spark, rows, parts=5):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string").repartition(parts)
    got = manifest(df)[0]
    assert sorted((str(r[0]), *r[1:]) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()) == brute(rows)


def test_sweeps_over_one_block():
    for n in (1, 2, 15, 16, 17, 255, 256, 257, 700):
        nodes = [sha(str(i)) for i in range(n)]
        tree = levels(nodes)
        assert rise(nodes, None) == tree
        assert rise(nodes, 3)[-1] == ([tree[-1][0]] if len(tree) == 4 else [digest(rise(nodes, 2)[-1])])
        for i, proof in enumerate(sink(tree, [(0, "up")])):
            assert [(k, run) for k, run in proof] == [(k, "".join(run)) for k, run in path(tree, i)] + [(0, "up")]
            assert siblings(proof[:-1]) == "".join("".join(run[:k] + run[k + 1 :]) for k, run in path(tree, i))


def test_nulls_ties_copies_and_sources(spark):
    rng = random.Random(1)
    rows = [(rng.choice((None, rng.randrange(10**6), 5)), rng.choice(("a", "a", "a", None, "é", "Z", "")), rng.choice((None, "en")), rng.choice((None, 7)),
             rng.choice((None, "", "Ab é X", "ABC" * rng.randrange(30)))) for _ in range(600)]
    check(spark, rows + [(i, f"s{i}", "x", 1, "T") for i in range(20)] + [(7, "b", "x", 1, "Dup")] * 300)
    check(spark, [(1, "a", None, None, None)])
    check(spark, [(0, None, "de", 9, "A" * 300_000), (3, None, "de", 9, "B\n" * 100_000)])
    empty = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert manifest(empty)[0].count() == 0 and manifest(empty)[1] is None


@pytest.mark.parametrize("count", [16, 17, 256, 257])
def test_many_stages(spark, monkeypatch, count):
    monkeypatch.setattr(module, "LEVELS", 1)  # blocks of 16, so that a source takes several stages
    check(spark, [(i, "a", "x", i, f"T{i}") for i in range(count)] + [(i, "b", "x", 1, "u") for i in range(3)] + [(i, f"s{i:03}", "x", 1, "v") for i in range(33)])


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = op13_merkle_manifest(spark, sf).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == brute(rows)
    assert 0 < sum(not r.verified for r in got) < len(got)
