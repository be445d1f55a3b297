import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lexiloom.operators import search
from lexiloom.operators.search import bm25, candidates, keyword_matches, keyword_search, parsed


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower().replace("ß", "ss"))


def brute_bm25(docs, queries, k):
    toks = {d: words(t) for d, t in docs}
    mean, out = sum(map(len, toks.values())) / sum(t is not None for _, t in docs), []  # a null text has no length
    df = Counter(w for t in toks.values() for w in set(t))
    for q, text in queries:
        scores = {}
        for d, t in toks.items():
            tf = Counter(t)
            hit = [w for w in set(words(text)) if tf[w]]
            if hit:
                scores[d] = round(sum(math.log1p((len(toks) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in hit), 6)
        out += [(q, d, s, n) for n, (d, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k], 1)]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_bm25_equals_scoring_everything(spark, monkeypatch, small):
    if small:  # several slices a word and few levels
        monkeypatch.setattr(search, "SLICE", 7)
        monkeypatch.setattr(search, "LEVELS", 3)
    rng = random.Random(5)
    vocabulary = [f"w{n}" for n in range(60)]
    weights = [1 / (n + 1) for n in range(60)]
    docs = [(n, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(0, 40)))) for n in range(300)]
    docs += [(1000 + n, "w0 w1 w2 same") for n in range(150)] + [(2000, None), (2001, "")]  # a third are copies
    queries = [(n, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 7)))) for n in range(25)] + [(50, "same w0"), (51, "none"), (52, ""), (53, None), (54, "w0"), (55, "W0, w0 w59")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    q = spark.createDataFrame(queries, "query_id long, query string")
    want = brute_bm25(docs, queries, 5)
    got = sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in bm25(d, q, 5).collect())
    assert [(a, b, n) for a, b, _, n in got] == sorted((a, b, n) for a, b, _, n in want)
    assert all(abs(x[2] - y[2]) < 2e-6 for x, y in zip(got, sorted(want), strict=True))
    assert bm25(d.limit(0), q).count() == 0 and bm25(d, q.limit(0)).count() == 0


def test_bm25_leaves_documents_aside(spark):
    rng = random.Random(6)
    common = [f"c{n}" for n in range(8)]
    docs = [(n, " ".join(rng.choices(common, k=rng.randrange(3, 60)) + [f"r{n % 40}"])) for n in range(2000)]
    queries = [(n, f"c0 c1 c2 r{n}") for n in range(40)]
    scored, found = candidates(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, query string"), 10)
    assert found.count() == 400 and scored.count() < 0.1 * 2000 * 40


def test_queries_become_rows(spark):
    rows = [(1, 'red "big dog" or cat -"small mouse" OR x-ray'), (2, "-only"), (3, " - \"\" ... or"), (4, None), (5, "a or or b")]
    got = sorted((r.query_id, r.alternative, r["minus"], r["offset"], r.term) for r in parsed(spark.createDataFrame(rows, "query_id long, query string")).collect())
    assert got == [(1, 0, False, 0, "big"), (1, 0, False, 0, "red"), (1, 0, False, 1, "dog"), (1, 1, False, 0, "cat"), (1, 1, True, 0, "small"), (1, 1, True, 1, "mouse"),
                   (1, 2, False, 0, "x"), (1, 2, False, 1, "ray"), (2, 0, True, 0, "only"), (5, 0, False, 0, "a"), (5, 2, False, 0, "b")]


def brute_match(query, text):
    joined = " " + " ".join(words(text)) + " "
    has = lambda found: " " + " ".join(found) + " " in joined
    clauses = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        if not minus and word.lower() == "or":
            clauses.append([])
        elif words(phrase or word):
            clauses[-1].append((bool(minus), words(phrase or word)))
    return any(any(not m for m, _ in c) and all(has(w) != m for m, w in c) for c in clauses)


@pytest.mark.parametrize("slices", [50_000, 5])
def test_keyword_search_equals_reading_every_text(spark, monkeypatch, slices):
    monkeypatch.setattr(search, "SLICE", slices)
    rng = random.Random(7)
    docs = [(n, " ".join(rng.choices("abcdefgh", k=rng.randrange(0, 14)))) for n in range(150)] + [(500 + n, "a b c a b") for n in range(80)] + [(900, None)]
    made = ['a "b c"', '"a b" -c', "a or h -b", '"a a b"', '"c a" or "d e f"', "-a", "zzz", "a zzz or g", '"b c a b" d', "", "a -zzz", '-"a b" c or "h h"', "x-y or a-b", 'a "b']
    queries = list(enumerate(made)) + [(100, None)]
    got = keyword_search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(queries, "query_id long, query string"), None)
    want = {(n, d) for n, q in enumerate(made) for d, t in docs if brute_match(q.replace('"b', "b") if q.count('"') == 1 else q, t or "")}
    rows = got.collect()
    assert {(r.query_id, r.doc_id) for r in rows} == want and len(rows) == len(want)
    ranks = sorted((r.query_id, r["rank"], -r.score, r.doc_id) for r in rows)
    assert all(a[0] != b[0] or (a[2], a[3]) < (b[2], b[3]) for a, b in zip(ranks, ranks[1:], strict=False))


def test_closer_words_rank_first(spark):
    docs = [(1, "red x x x dog"), (2, "red dog"), (3, "dog x red dog"), (4, "red"), (5, "cat")]
    got = keyword_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, "red dog or cat")], "query_id long, query string")).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in got] == [(3, 0.15), (2, 0.1), (5, 0.1), (1, 0.025)]


def test_keyword_search_over_many_small_blocks_and_parts(spark, monkeypatch):
    """Results are those of reading every text, and no more than the k best of a block leave it for a class of queries."""
    for name, value in (("BLOCK", 16), ("STREAM_TOKENS", 90), ("CLASSES", 3), ("CHUNK_TOKENS", 7)):
        monkeypatch.setattr(search, name, value)
    rng = random.Random(17)
    texts = [(n, " ".join(rng.choices("abcdefgh", k=rng.randrange(0, 14)))) for n in range(90)] + [(200 + n, "a b c a b") for n in range(40)] + [(900, None)]
    made = ['a "b c"', '"a b" -c', "a or h -b", '"a a b" or "b c a"', "-a", "zzz", '-"a b" c or "h h"', "x-y or a-b", "a"] * 2
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2).unionByName(spark.createDataFrame([(None, "a b c")], "doc_id long, text string"))
    queries = spark.createDataFrame(list(enumerate(made)), "query_id long, query string")
    want = sorted((n, d) for n, q in enumerate(made) for d, t in texts if t is not None and brute_match(q, t))
    assert sorted((r.query_id, r.doc_id) for r in keyword_matches(docs, queries).collect()) == want
    whole = sorted(tuple(r) for r in keyword_search(docs, queries, None).collect())
    assert sorted((r[0], r[1]) for r in whole) == want
    assert sorted(tuple(r) for r in keyword_search(docs, queries, 3).collect()) == [r for r in whole if r[3] <= 3]
    found = search._keyword_blocks(docs, queries, 3, scored=True)[1].collect()
    assert len(found) > 9 and max(len(r.doc_ids) for r in found) == 3


def test_queries_go_to_blocks_that_can_match_only(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 10)
    docs = spark.createDataFrame([(n, f"all own{n} blk{n // 10}") for n in range(50)], "doc_id long, text string").coalesce(1)
    asked = [(n, f'own{n} all "own{n} blk{n // 10}" or gone all or own{(n + 25) % 50} -all') for n in range(50)] + [(90, "all -own3"), (91, "-all"), (92, "gone")]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    met, real = [], search._meetings
    monkeypatch.setattr(search, "_meetings", lambda *given: met.append(real(*given)) or met[0])
    assert sorted(tuple(r) for r in keyword_matches(docs, queries).collect()) == sorted([(n, n) for n in range(50)] + [(90, n) for n in range(50) if n != 3])
    assert met[0].count() == 50 * 2 + 5 and met[0].select("b").distinct().count() == 5


def test_covers_of_a_block_equal_the_fold():
    """Scores before rounding are those of a fold over the places of the words, to the last bit."""
    rng = random.Random(12)
    codes = [[rng.randrange(6) for _ in range(rng.randrange(1, 60))] for _ in range(200)]
    flat = np.array([c for t in codes for c in t], np.int32)
    key = np.unique(flat.astype(np.int64) * 1000 + np.repeat(np.arange(200), [len(t) for t in codes]))
    row = {"ids": np.arange(200), "lengths": np.array([len(t) for t in codes]), "codes": flat, "docs": (key % 1000).astype(np.uint16), "ends": np.searchsorted(key // 1000, np.arange(6), side="right")}
    block = search._Block({c: v.tobytes() for c, v in row.items()} | {"words": list("abcdef")})
    for wanted in ([0], [1, 2], [3, 3, 5], [0, 1, 2, 4]):
        docs, want = block.holding(wanted), []
        assert docs.tolist() == [n for n, t in enumerate(codes) if set(wanted) <= set(t)]
        for n in docs.tolist():
            hits = [(at, c) for at, c in enumerate(codes[n]) if c in wanted]
            last, begun, score = dict.fromkeys(wanted, -1), -1, 0.0
            for at, (spot, c) in enumerate(hits):
                last[c] = at
                m = min(last.values())
                if m > begun:
                    score, begun = score + 0.1 / (1 + spot - hits[m][0] - (at - m)), m
            want.append(score)
        assert block.covers(docs, wanted).tolist() == want
        pair = [c for c in wanted[:2]]
        assert block.with_phrase(docs, pair).tolist() == [n for n in docs.tolist() if any(codes[n][i : i + len(pair)] == pair for i in range(len(codes[n])))]
