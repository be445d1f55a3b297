import hashlib
import random

import pytest
from tokenizers import Tokenizer

from lexiloom.llm.bpe import _LATIN, _WORDS, BLOCK, Codec, Decoder, digests, encode_and_decode, load, normalized, op9_bpe_roundtrip, vocabulary_path, words


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(vocabulary_path())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def codec():
    return Codec(load(vocabulary_path()))


def pair(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


CASES = ["", " ", "It's WE'LL 'sun don't", "Éé é ÇŞİ ΣΑΣ ß", "a\x1cb\x85c\xa0d　e​f", "12345 ½ ² ٣", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>",
         "日本語 हिन्दी 🙂🙂 ẹ́", "!!!???...", "͸", "x" * 500, "the" * 300 + "end", "ab" * 40 + "é" * 60, "'" * 90]


def test_cases_match_the_library(codec, library):
    for text in CASES:
        ids, decoded = pair(library, text)
        assert codec.encode(text) == ids, text
        assert codec.decode(ids, plain=True) == decoded


def test_streaming_equals_direct_merging(codec):
    rng = random.Random(8)
    for _ in range(300):
        raw = "".join(rng.choices(["in", "the", "a", "er", "é", "z", "ing", "qu", "!", "ü"], k=rng.randrange(1, 120))).encode()
        direct = codec.merged([codec.inner[b] for b in raw[:-1]] + [codec.final[raw[-1]]])
        assert list(codec.stream(raw)) == direct
        if len(raw) <= 128:
            assert list(codec.transduce([raw, b"the", raw])[2]) == direct


def test_compatibility_is_that_of_merging(codec):
    rng = random.Random(3)
    within, end = [*codec.within.values()], [*codec.at_end.values()]
    pairs = [(rng.choice(within[: rng.choice((300, 3000, 99999))]), rng.choice([within, end][k % 2][: rng.choice((300, 3000, 99999))])) for k in range(40000)]
    got = [codec.compatible(a, b) for a, b in pairs]
    assert got == [codec.merged([*codec.parts[a], *codec.parts[b]]) == [a, b] for a, b in pairs]
    assert 100 < sum(got) < len(got) - 100


def test_random_texts_match_the_library(codec, library):
    rng = random.Random(9)
    parts = ["the ", "ing", "'", "s ", "É", "é", " ", "\n", "12", "ß", "—", "日", "🙂", "é", "ABC", "zqx", "!!", "\t", "<|endoftext|>"]
    for _ in range(1500):
        text = "".join(rng.choices(parts, k=rng.randrange(40)))
        assert codec.encode(text) == pair(library, text)[0], text


def test_long_texts_cross_blocks(codec, library):
    text = "Ünïcode wörds, and 's more. é\n" * (3 * BLOCK // 30)
    assert codec.encode(text) == pair(library, text)[0]


def test_incremental_decoding(codec):
    for text in ("héllo wörld ", "日本語 ", "🙂 ok "):
        assert codec.decode(codec.encode(text)) == text
    ids = codec.encode("日")
    assert codec.decode(codec.encode("日x")[:1]).strip("�") in ("", "日") and codec.decode(ids) == "日 "
    # Token by token, and with a character's bytes split between blocks.
    for text in CASES:
        ids = codec.encode(text)
        for plain in (False, True):
            decoder = Decoder(codec, plain)
            assert "".join([decoder.feed([i]) for i in ids]) + decoder.end() == codec.decode(ids, plain)


def test_every_word_passes_through_the_transducer(library, monkeypatch):
    codec, seen, fed = Codec(load(vocabulary_path())), [], []
    stream, transduce, feed = Codec.stream, Codec.transduce, Decoder.feed
    monkeypatch.setattr(Codec, "stream", lambda self, raw: seen.append(raw) or stream(self, raw))
    monkeypatch.setattr(Codec, "transduce", lambda self, raws: seen.extend(raws) or transduce(self, raws))
    monkeypatch.setattr(Decoder, "feed", lambda self, ids: fed.extend(ids) or feed(self, ids))
    ids = codec.encode("One two, one " + "x" * 300)
    assert sorted(seen) == [b",", b"one", b"two", b"x" * 300]
    assert codec.decode(ids, plain=True) == pair(library, "One two, one " + "x" * 300)[1] and fed == ids


def test_latin_words_are_those_of_the_full_pattern():
    rng = random.Random(12)
    signs = [chr(c) for c in (*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), *range(0x20A0, 0x20C0))]
    for _ in range(3000):
        text = "".join(rng.choices(signs + ["'", "'s", "'re", " "] * 30, k=30))
        assert words(text) == _WORDS.findall(normalized(text))
    assert all(_LATIN.findall(c) == _WORDS.findall(c) for c in signs)


def test_documents_and_edge_rows(spark, codec, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op9_bpe_roundtrip(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids, decoded = pair(library, texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    edge = spark.createDataFrame([(None, "a b", 1), (1, None, 1), (1, "", 1)], "doc_id long, text string, ids int")
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256 == empty) for r in digests(edge).collect()) == [("1", 0, True), ("1", 0, True), ("None", 2, False)]
    assert sorted((str(r.doc_id), len(r.ids), r.decoded) for r in encode_and_decode(edge).collect()) == [("1", 0, ""), ("1", 0, ""), ("None", 2, "a b ")]
    assert digests(edge.limit(0)).count() == 0
