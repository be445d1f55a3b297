import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from lexiloom.llm import language
from lexiloom.llm.language import AGAINST, SHARE, Filters, identify, learn, ngrams, op12_language_filters

SF = "/root/testdata/sf0.01"


def grams_of(text):
    """All n-grams of one text, by the definition."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    padded = " " + " ".join(words) + " " if words else ""
    return [padded[i : i + 3] for i in range(len(padded) - 2) if padded[i + 1] != " "]


def test_ngrams_are_those_of_the_words():
    texts = ["", "A", "ab, c-d!", "Ünï 42 中文 ǅ", "  ", "x" * 5, "İstanbul", "a\nb", "🙂🙂", "é"]
    hashes, part = ngrams(texts)
    assert Counter(part.tolist()) == Counter({i: len(grams_of(t)) for i, t in enumerate(texts) if grams_of(t)})
    by = defaultdict(set)
    for h, g in zip(hashes.tolist(), [g for t in texts for g in grams_of(t)], strict=True):
        by[g].add(h)
    assert all(len(v) == 1 for v in by.values()) and len({h for v in by.values() for h in v}) == len(by)


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(language, "PIECE", 50)
    monkeypatch.setattr(language, "DOCUMENTS", 3)
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab c.é") for _ in range(n)) for n in (0, 10, 49, 50, 51, 500, 3, 3, 3, 3)] + ["z" * 400, None]
    seen = Counter()
    for piece in language._pieces(texts):
        _, part = ngrams([t for _, t in piece])
        seen.update(np.array([row for row, _ in piece])[part].tolist() if len(part) else [])
    assert seen == Counter({i: len(grams_of(t or "")) for i, t in enumerate(texts) if grams_of(t or "")})


def test_filters_hold_what_exact_counting_keeps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = defaultdict(Counter)
    for r in docs.where((F.crc32(F.col("doc_id").cast("string")) % 5 != 0) & F.col("lang").isNotNull()).collect():
        counts[r.lang].update(grams_of(r.text or ""))
    total = {x: sum(c.values()) for x, c in counts.items()}
    share = lambda x, g: counts[x][g] / total[x]
    kept = {x: {g for g in c if share(x, g) >= SHARE and share(x, g) >= AGAINST * max(share(y, g) for y in counts)} for x, c in counts.items()}
    filters = learn(docs)
    assert filters.languages == sorted(counts)
    every = sorted({g for c in counts.values() for g in c})
    hashes = np.array([ngrams([g.strip() if len(g.strip()) == 1 else g.replace(" ", "") and g])[0][grams_of(g).index(g)] for g in every], dtype=np.uint64)
    found = filters.having(hashes)[:, 0]
    for k, x in enumerate(filters.languages):
        bit = (found >> np.uint64(k)) & np.uint64(1) == 1
        own = np.array([g in kept[x] for g in every])
        assert bit[own].all()  # a filter forgets nothing
        wrong = bit[~own].mean() if (~own).any() else 0.0
        assert abs(wrong - filters.mistakes[k]) < 0.01  # and errs as often as it says


def test_popcounts_are_corrected_for_mistakes():
    rng = np.random.default_rng(2)
    masks = np.zeros((1 << 12, 2), dtype=np.uint64)
    masks[rng.random(1 << 12) < 0.7, 0] = 1  # so full that a quarter of all n-grams seem to be in
    filters = Filters([f"l{i:03}" for i in range(70)], masks, 0)
    text = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(4000))
    hits, n = filters.popcounts([text, "", text])
    assert abs(hits[0, 0] / n[0] - filters.mistakes[0]) < 0.03 and filters.mistakes[0] > 0.2 and (hits[0] == hits[2]).all() and n[1] == 0
    share, _ = filters.shares([text])
    assert share[0, 0] < 0.03 and share[0, 1:].max() == 0


def test_edge_rows(spark):
    rows = [(i, "the house and the garden " * 3, "en", 0.1) for i in range(40)] + [(100 + i, "das Haus und der Garten " * 3, "de", 0.2) for i in range(40)]
    rows += [(None, "и и и", "ru", 0.3), (500, "le jardin", None, 0.4), (501, None, "de", 0.5), (502, "", "de", 0.6), (503, "123 !", None, 0.7), (504, "中", None, 0.8), (505, "haus " * 400_000, None, 0.9), (1, "the house", "en", 0.1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    filters = learn(df)
    assert filters.languages == ["de", "en"]  # ru comes without an id
    got = {r.doc_id: r for r in identify(df, filters).collect()}
    assert identify(df, filters).count() == len(rows)
    assert all(got[i].lang_pred == "en" and 0 < got[i].score <= 1 for i in range(40)) and got[107].lang_pred == got[505].lang_pred == "de"
    assert [(got[i].lang_pred, got[i].score) for i in (501, 502, 503)] == [("und", 0.0)] * 3
    assert got[504].score == 0.0 and got[504].lang_pred in ("de", "en") and got[None].held_out is False
    empty = learn(df.limit(0))
    assert identify(df.limit(0), empty).count() == 0 and {r.lang_pred for r in identify(df, empty).collect()} == {"und"}


def test_held_out_accuracy(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op12_language_filters(spark, SF).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(langs) and len(held) > 100
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.98 * len(held)
