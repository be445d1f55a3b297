import hashlib
import random
import re

from lexiloom.llm import substring
from lexiloom.llm.arrays import window_hashes, word_hashes
from lexiloom.llm.substring import op6_substring_dedup, remove_repeats


def plain(rows, size):
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in split:
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < d:
                gone.update(range(i, i + size))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


def test_small_tables_match_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for d in range(120):
        words = [rng.choice("abc") for _ in range(rng.randrange(30))]
        if rng.random() < 0.4 and rows:
            words[3:3] = (rng.choice(rows)[1] or "").split()[:9]
        rows.append((d // 2 * 3 if d > 100 else d * 7, rng.choice((" ", "\n", "\t ")).join(words)))
    rows += [(1000, None), (1001, ""), (1002, " "), (1003, "é ü \x1c x\xa0y é ü \x1c x\xa0y"), (1004, "é ü \x1c x\xa0y")]
    df = spark.createDataFrame([(d, t, "other") for d, t in rows], "doc_id long, text string, chunk string")
    got = sorted(tuple(r) for r in remove_repeats(df, size=4).collect())
    assert got == plain(rows, 4)
    assert sum(r[2] for r in got) > 100
    assert remove_repeats(df.limit(0)).count() == 0


def test_null_id_is_largest(spark):
    df = spark.createDataFrame([(None, "a b c d"), (3, "a b c d")], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in remove_repeats(df, size=4).collect()}
    assert got == {None: 4, 3: 0}


def test_documents_match_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    want = [(d, n, m, hashlib.sha256(t.encode()).hexdigest()) for d, n, m, t in plain(rows, 50)]
    got = sorted(tuple(r) for r in op6_substring_dedup(spark, "/root/testdata/sf0.01").collect())
    assert got == want


def test_many_chunks_and_shards_match_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    hot = [f"h{i}" for i in range(12)]
    rows = []
    for d in range(300):
        words = [rng.choice("abcdefgh") for _ in range(rng.randrange(60))]
        words[2:2] = hot if d % 3 == 0 else []  # a passage of a third of all documents
        rows.append((d, " ".join(words)))
    rows += [(500, " ".join(rng.choice("abcdefgh") for _ in range(20000)))]  # a very long text
    rows += [(7, " ".join(rng.choice("xyz") for _ in range(40))) for _ in range(100)]  # many rows of one id
    monkeypatch.setattr(substring, "CHUNK_BYTES", 1 << 10)
    monkeypatch.setattr(substring, "SHARD_BYTES", 1 << 11)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in remove_repeats(df, size=6).collect())
    assert got == plain(rows, 6)


def _thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


def test_patterns_that_cancel_in_sums_of_powers_are_kept_apart(spark):
    bits = _thue_morse(2048)
    one, other = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    assert len({tuple(word_hashes(w.encode(), 2)[k].tolist()[0] for k in (2, 3)) for w in (one, other, one[:1024], other[:1024])}) == 4
    short, swapped = (" ".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    long_words = [[one if b ^ flip else other for b in _thue_morse(50)] for flip in (0, 1)]
    rows = [(1, " ".join(long_words[0])), (2, " ".join(long_words[1])), (3, " ".join([one] * 50)), (4, " ".join([other] * 50)), (5, short), (6, swapped)]
    got = sorted(tuple(r) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == plain(rows, 50)


def test_hashes_tell_all_words_and_windows_apart():
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("ab\x00é") for _ in range(rng.choice((1, 2, 7, 8, 9, 15, 16, 17, 63, 64, 65, 200)))).encode() for _ in range(3000)})
    for k in (2, 3):
        hashes = word_hashes(b"\n ".join(words), 2)[k]
        assert len(set(hashes.tolist())) == len(words)
        for size in (1, 2, 3, 50):
            windows = window_hashes(hashes, size, k - 2)
            assert len(set(windows.tolist())) == len(words) - size + 1
            assert windows[7:9].tolist() == window_hashes(hashes[7 : 8 + size], size, k - 2).tolist()
