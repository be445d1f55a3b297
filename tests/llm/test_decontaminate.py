import math
import random
from collections import Counter

import numpy as np

from lexiloom.llm import decontaminate
from lexiloom.llm.arrays import word_hashes
from lexiloom.llm.decontaminate import K1, B, Index, find_leaks, normalized, op4_bm25_decontamination, without_leaks


def _shares(items):
    """Each item's normalised contribution of every word, by the formula."""
    bags = [Counter(normalized(t).split()) for _, t in items]
    mean = sum(b.total() for b in bags) / len(bags)
    df = Counter(w for b in bags for w in b)
    idf = {w: math.log1p((len(bags) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    out = []
    for bag in bags:
        norm = K1 * (1 - B + B * bag.total() / mean)
        part = {w: idf[w] * n * (K1 + 1) / (n + norm) for w, n in bag.items()}
        out.append({w: x / sum(part.values()) for w, x in part.items()})
    return out


def _items(rng):
    vocabulary = [f"w{i}" for i in range(300)] + ["the", "of", "a"] * 40
    # Lengths of three classes: up to 64 words, up to 128, up to 256.
    return [(i, " ".join(rng.choices(vocabulary, k=rng.choice((5, 12, 30, 60, 70, 120, 200))))) for i in range(300)]


def test_wand_returns_everything_above_the_threshold():
    rng = random.Random(1)
    items = _items(rng)
    index, shares, some = Index(items, threshold=0.3), _shares(items), 0
    assert len(index.classes) == 3
    for _ in range(60):
        query = set(rng.choices([w for s in shares for w in s], k=30)) | set(list(rng.choice(shares))[:12])
        terms = index.lookup(word_hashes(b" ".join(sorted(query)))[2])
        got = {members[i][0] for group, members in zip(index.classes, index.members, strict=True) for i, _ in group.wand(terms[terms < len(index.terms) - 1].tolist())}
        want = {i for i, s in enumerate(shares) if sum(x for w, x in s.items() if w in query) >= 0.3}
        assert got == want
        some += len(want)
    assert some > 60


def test_passages_lose_none_that_scoring_every_item_finds():
    rng = random.Random(2)
    items = _items(rng)
    shares = _shares(items)
    words = [w.decode() for s in shares for w in s]
    texts = [" ".join(rng.choices(words, k=rng.choice((0, 1, 40, 63, 64, 65, 130, 700)))) for _ in range(40)]
    texts = [t + " " + " ".join(items[rng.randrange(len(items))][1].split()[: rng.randrange(3, 60)]) for t in texts] + [""]
    for threshold in (0.3, 0.5, 0.8):
        index, some = Index(items, threshold=threshold), 0
        raws = [normalized(t) for t in texts]
        starts, _, hashes = word_hashes(b" ".join(raws))
        ends = np.cumsum([len(r) + 1 for r in raws])
        first = np.searchsorted(starts, [0, *ends.tolist()])
        terms = index.lookup(hashes)
        for group, members in zip(index.classes, index.members, strict=True):
            got, want = set(), set()
            for text, s, e in group.passages(terms, first):
                distinct = np.unique(terms[s:e])
                got |= {(text, s - first[text], members[i][0]) for i, _ in group.wand(distinct[distinct < len(index.terms) - 1].tolist())}
            for text, raw in enumerate(raws):
                bag = raw.split()
                for at in range(0, max(1, len(bag) - group.span), group.span):
                    query = set(bag[at : at + 2 * group.span])
                    want |= {(text, at, m[0]) for m in members if sum(x for w, x in shares[m[0]].items() if w in query) >= threshold}
            assert got == want
            some += len(want)
        assert some > 20


def test_leaks_are_found_and_clean_documents_left(spark):
    item = "What is the capital of Norway and how many people live there? Oslo, with seven hundred thousand people in it."
    other = "Rivers carry sand to the sea where waves grind it into ever finer grains."
    filler = " ".join(f"word{i % 97}" for i in range(5000))
    rows = [
        (1, filler + " " + item.upper().replace(" ", "\n") + " " + filler),
        (2, filler),
        (3, None),
        (4, ""),
        (5, item.split("?")[0] + "?"),
        (6, other),
        (6, other),
        (None, other),
    ]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(10, item), (11, other), (12, None), (13, "")], "item_id long, text string")
    got = sorted((str(r.doc_id), r.item_id) for r in find_leaks(docs, items).collect())
    assert got == [("1", 10), ("6", 11), ("6", 11), ("None", 11)]
    assert sorted(str(r.doc_id) for r in without_leaks(docs, items).collect()) == ["2", "3", "4", "5"]
    assert find_leaks(docs.limit(0), items).count() == 0 and find_leaks(docs, items.limit(0)).count() == 0


def test_documents_match_verbatim_search(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {(d, i) for d, t in docs for i, x in items if b" ".join(normalized(x).split()) in b" ".join(normalized(t).split())}
    got = {(r.doc_id, r.item_id) for r in op4_bm25_decontamination(spark, sf).collect()}
    assert got == want and want


def test_truncated_and_edited_items_are_leaks(spark):
    question, answer = [f"q{i}" for i in range(24)], [f"a{i}" for i in range(24)]
    item = " ".join(question) + "? " + " ".join(answer)
    filler = " ".join(f"word{i % 97}" for i in range(300))
    truncated = " ".join(question[:14] + answer[:14])
    edited = " ".join(question[:14] + ["other"] * 10 + answer[:14] + ["words"] * 10)
    less = " ".join(question[:14] + answer[:8])
    docs = spark.createDataFrame([(1, f"{filler} {truncated} {filler}"), (2, f"{filler} {edited}"), (3, f"{filler} {less}")], "doc_id long, text string")
    items = spark.createDataFrame([(10, item), (11, "Rivers carry sand to the sea where waves grind it.")], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.score for r in find_leaks(docs, items).collect()}
    assert set(found) == {(1, 10), (2, 10)} and all(0.5 <= x < 0.65 for x in found.values())
    assert [r.doc_id for r in without_leaks(docs, items).collect()] == [3]


def test_slices_of_the_benchmark_score_like_one_index(spark, monkeypatch):
    from lexiloom.llm import decontaminate

    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(200)] + ["the", "of"] * 30
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice((8, 20, 40, 59, 100, 150)))) for _ in range(60)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(t.split()[: len(t.split()) * 4 // 5])) for i, t in enumerate(texts)], "doc_id long, text string")
    one = {(r.doc_id, r.item_id): round(r.score, 9) for r in find_leaks(docs, items).collect()}
    monkeypatch.setattr(decontaminate, "INDEX_LIMIT", sum(map(len, texts)) // 5)
    assert {(r.doc_id, r.item_id): round(r.score, 9) for r in find_leaks(docs, items).collect()} == one and len(one) > 20


def test_copies_of_an_item_are_indexed_once_and_reported_each(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "INDEX_LIMIT", 200)
    text = "What is the tallest mountain of the northern range? It is the grey peak above the long valley."
    items = [(1, text)] * 50 + [(2, "Which river runs through the old town? The green one runs through it, slowly.")]
    docs = spark.createDataFrame([(7, "Before. " + text + " After."), (8, "nothing of the kind is here")], "doc_id long, text string")
    got = decontaminate.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(7, 1)] * 50


def test_edited_and_shortened_items_are_found(spark):
    rng = random.Random(8)
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").orderBy("item_id").limit(200).collect() if len(r.text.split()) >= 12]
    carriers = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) BETWEEN 300 AND 3000").orderBy("doc_id").limit(len(items)).collect()]
    shares = {}
    for name, keep in (("a tenth of the words changed", lambda w: [x if rng.random() > 0.1 else "changed" for x in w]), ("the last fifth cut off", lambda w: w[: -(len(w) // 5)]), ("each twelfth word dropped", lambda w: [x for n, x in enumerate(w) if n % 12])):
        docs = [(n, f"{c} {' '.join(keep(t.split()))} {c}") for n, ((_, t), c) in enumerate(zip(items, carriers, strict=False))]
        found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
        hit = {(r.doc_id, r.item_id) for r in found.collect()}
        shares[name] = sum((n, items[n][0]) in hit for n in range(len(docs))) / len(docs)
    print(shares)
    assert min(shares.values()) >= 0.8 and shares["the last fifth cut off"] >= 0.95, shares
