import random

from lexiloom.llm import sketches
from lexiloom.llm.sketches import SIMILAR, one_of_each_group, shingles, similar_pairs


def plain(text):
    """The shingles themselves."""
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def likeness(a, b):
    a, b = plain(a), plain(b)
    return len(a & b) / len(a | b) if a and b else 0.0


def rows_of(rng, n):
    """Texts, edited and exact copies of them, parts and mixtures."""
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(2, 9)))
    texts = [[word() for _ in range(rng.choice((0, 1, 3, 5, 8, 60, 300, 900)))] for _ in range(n)]
    for t in list(texts):
        share = rng.choice((0.0, 0.005, 0.01, 0.02, 0.04, 0.1))
        texts.append([word() if rng.random() < share else x for x in t])
        texts.append(t[: len(t) * 9 // 10])
    texts.append(texts[7] + texts[6])
    rng.shuffle(texts)
    return [(i * 7, " ".join(t)) for i, t in enumerate(texts)]


def test_shingles_are_those_of_the_words():
    for text in (None, "", " ", "One", "one TWO three four", "a b c d e", "a b c d e f a b c d e f", "x " * 50, "É é ü \u00a0 b c d"):
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split(" ")
        if "\u00a0" not in (text or ""):
            assert len(shingles(text)) == len(plain(text)), words
    assert (shingles("A B C D E f") == shingles("a b c d e F")).all()


def test_links_are_similar_and_few_are_missed(spark):
    rows = rows_of(random.Random(1), 120)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, sketch string").repartition(4)
    text = dict(rows)
    found = {(r.a, r.b) for r in similar_pairs(df).collect()}
    assert found and all(likeness(text[a], text[b]) >= SIMILAR for a, b in found)
    left = {r.doc_id for r in one_of_each_group(df).collect()}
    ids, parent = sorted(text), {d: d for d in text}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n, m = sorted((len(plain(text[a])), len(plain(text[b]))))
            if n >= SIMILAR * m and n and likeness(text[a], text[b]) >= SIMILAR:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    want = {d for d in ids if root(d) == d}
    assert left >= want and len(left - want) <= 0.05 * (len(ids) - len(want)), (len(left), len(want), len(ids))


def test_large_groups_and_edge_rows(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(500)}" for _ in range(200)]
    rows = [(n, " ".join([*base[:k], "edited", *base[k + 1 :]]), n) for n, k in ((n, rng.randrange(200)) for n in range(300))]
    rows += [(1000, None, 1), (1001, "", 1), (None, " ".join(base), 1), (1002, "short text", 1), (1003, "Short TEXT", 1), (1004, "other text", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int").repartition(3)
    got = one_of_each_group(df)
    assert got.columns == df.columns and sorted(str(r.doc_id) for r in got.collect()) == ["0", "1000", "1001", "1002", "1004", "None"]
    assert one_of_each_group(df.limit(0)).count() == 0
    assert sketches.sketches(df.where("doc_id = 1000")).count() == 0
