import random
import re

import numpy as np
import xxhash

from lexiloom.llm.simhash import near_components, near_duplicates, one_of_each_group, simhash


def plain_simhash(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(fps, radius=2):
    """{doc_id: component} by comparing everything with everything."""
    parent = {d: d for d, _ in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, f) in enumerate(fps):
        for e, g in fps[i + 1 :]:
            if bin(f ^ g).count("1") <= radius:
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
    return {d: root(d) for d, _ in fps}


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def test_fingerprint_matches_the_definition():
    for text in ("", None, "One", "one two", "A b C d", "x " * 9000, "É é \t\n\v ü ü ü", "a\x1cb c\xa0d"):
        assert simhash(text) == plain_simhash(text)


def test_components_match_brute_force(spark):
    rng = random.Random(7)
    fps = []
    for center in [0, 2**64 - 1] + [rng.getrandbits(64) for _ in range(40)]:
        for _ in range(rng.choice((1, 3, 12))):
            f = center
            for _ in range(rng.randrange(4)):
                f ^= 1 << rng.randrange(64)
            fps.append((len(fps), f))
    rng.shuffle(fps)
    df = spark.createDataFrame([(d, signed(f)) for d, f in fps], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in near_components(df).collect()}
    assert got == plain_components(fps)
    assert {r.doc_id: r.component_id for r in near_components(df, 3).collect()} == plain_components(fps, 3)


def test_crowded_anchor_loses_no_link(spark):
    rng = random.Random(3)
    half = 0x12345678
    fps = [(i, rng.getrandbits(12) << 32 | half ^ (1 << rng.randrange(31))) for i in range(1500)]
    df = spark.createDataFrame([(d, signed(f)) for d, f in fps], "doc_id long, fp long")
    for radius in (2, 3):
        got = {r.doc_id: r.component_id for r in near_components(df, radius).collect()}
        assert got == plain_components(fps, radius)


def test_edge_rows(spark):
    rows = [(5, None, "x"), (4, "", "x"), (9, "a b c d", "x"), (9, "a b c d", "y"), (None, "a b c d", "z"), (1, "q", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in near_duplicates(df).collect())
    zero, same = "0" * 16, f"{plain_simhash('a b c d'):016x}"
    assert (("4", zero, 4) in got) and (("5", zero, 4) in got)
    assert got.count(("9", same, 9)) == 2 and ("None", same, 9) in got
    assert near_duplicates(df.limit(0)).count() == 0


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = plain_components([(r.doc_id, plain_simhash(r.text)) for r in rows])
    got = near_duplicates(docs).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(int(r.fingerprint, 16) == plain_simhash(t.text) for r in got for t in rows if t.doc_id == r.doc_id)
    assert np.unique([r.doc_id for r in got]).size == len(rows)


def test_names_of_other_columns_do_not_matter(spark):
    names = ["gone_id", "row_fp", "nth_of_id", "lone_fp", "nth", "row", "fp", "component_id", "f", "node", "a.b"]
    rows = [(1, "a b c d"), (2, "a b c d"), (2, "x y z"), (None, "a b c d"), (None, "other words here now"), (None, "other words here now"), (4, None)]
    df = spark.createDataFrame([(*r, *range(len(names))) for r in rows], f"doc_id long, text string, {', '.join(f'`{n}` int' for n in names)}")
    got = one_of_each_group(df)
    assert got.columns == df.columns
    assert sorted((str(r[0]), str(r[1])) for r in got.collect()) == [("1", "a b c d"), ("4", "None"), ("None", "other words here now")]
