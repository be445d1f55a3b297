"""Words cut from bytes are those that the engine's own regular expression finds."""

import random

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import words
from lexiloom.operators.dedup import folded


@pytest.mark.parametrize("cut", [1 << 22, 40])
def test_words_equal_the_engine(spark, monkeypatch, cut):
    monkeypatch.setattr(words, "CUT_BYTES", cut)
    rng = random.Random(4)
    every = [chr(c) for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000]
    texts = [None, "", "a", "Stra\u00dfe a_b x\u0301y \u216b \u00b2 \U0001d4b3\U0001d4b4 \u65e5\u672c", " ".join(every), "".join(every[:0x3000]), "\u00e9", "\u00e9"]
    texts += ["".join(rng.choice([" ", "a", rng.choice(every)]) for _ in range(rng.randrange(40))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    rows = df.select("i", folded("text").alias("f"), words.tokens("text").alias("t"), words.leading("text", 3).alias("l")).orderBy("i").toArrow().combine_chunks()
    got, cutter = [], words.Cutter(words.word_ranges(spark))
    for at, found, widths in cutter.pieces(rows["f"].chunk(0)):
        assert at == len(got)
        found = found.to_pylist()
        for n in widths.tolist():
            got.append(found[:n])
            found = found[n:]
        assert not found
    want = rows["t"].to_pylist()
    assert got == [t or [] for t in want] and rows["l"].to_pylist() == [t and t[:3] for t in want]
    some = list(cutter.pieces(rows["f"].chunk(0).slice(10, 20)))
    assert [w for _, found, _ in some for w in found.to_pylist()] == [w for t in want[10:30] for w in t]
    assert df.select(F.array_join(words.leading("text", 3), " ")).collect()[0][0] is None


def test_web_queries_take_the_longest_words(spark, tmp_path):
    from lexiloom.operators.retrieval import _web_queries

    texts = {0: "Bee a ccc dddd \u00e9\u00e9\u00e9 ccc", 20: "one two three", 40: None, 60: "", 80: "x y y Stra\u00dfe zz, \U0001d4b3\U0001d4b3 zz-y", 5: "no query of this one", 100: "a a a a b c d"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.query_id: r["query"] for r in _web_queries(spark, str(tmp_path)).collect()}
    assert got == {0: 'dddd "bee a" OR bee ccc -\u00e9\u00e9\u00e9', 80: 'strasse "x y" OR zz \U0001d4b3\U0001d4b3 -x', 100: 'a "a a" OR b c -d'}
