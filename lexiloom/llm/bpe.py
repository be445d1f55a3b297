"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

Texts pass through in blocks that end at white space, where neither normalisation nor the word
pattern nor a merge can reach across. Within a word, the encoding of every prefix ends in exactly
one token: the one that is compatible with the last token of the shorter prefix it continues (two
tokens are compatible when merging their joint symbols gives the two back). Only tokens of at most
``lookahead`` symbols exist, computed from the merge list, so every later token starts within the
last ``lookahead`` positions. Once the chains of last tokens from all of these positions have met,
what lies before the meeting point is stable and is emitted; only the window behind it is kept.
Every word passes through this transducer: words longer than the window one at a time
(:meth:`Codec.stream`), all others together, a position of every word at a time
(:meth:`Codec.transduce`). What it emitted for the latest words is kept in a bounded cache.

Decoding feeds the tokens, block by block, to a state machine that turns their byte symbols into text
incrementally; a character's bytes may come from several tokens. ``plain`` decoding joins the
vocabulary's own strings by spaces, as the tokenizers library does for a vocabulary without a decoder.

Edge cases: a null text is empty and has no tokens; strings of special tokens in a text become their
ids, as in the library; byte sequences that are no text decode to replacement characters; repeated
rows give equal rows; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lexiloom.session import table

#: Characters taken at a time; a block ends before the next white space.
BLOCK = 1 << 16
#: Characters whose words are looked up together, words and pairs of tokens whose results are kept.
QUEUE, CACHE, PAIRS = 1 << 20, 100_000, 1 << 19
#: Rows of a result batch, so that a worker holds few token lists at a time.
ROWS = 512
VOCABULARY = "word_bpe_49k.json"
_SPACES = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The vocabulary's own word pattern, with white space spelled out.
_WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACES}\p{{L}}\p{{N}}]+")
#: The same words where only Latin letters and common signs occur, for the faster library.
_LETTERS, _NUMBERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
_LATIN = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")
_OTHER = re.compile("[^\x00-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]")
_CUT = re.compile(r"[ \n\t\r]")
_MARK = "</w>"
#: A merge is its rank above 32 bits of the token it makes; no merge is larger than any.
_MASK, _NONE = (1 << 32) - 1, 1 << 62
#: The window of a long word, in lookaheads.
WINDOW = 4
_WITHIN, _AT_END = 0x2545F4914F6CDD1D, 0x1B03738712FAD5C9


def _byte_symbols() -> list[str]:
    """The printable symbol of every byte: itself if printable, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str) -> dict:
    """Vocabulary, merges and special tokens of a tokenizer file, as plain values to broadcast."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return {"vocab": spec["model"]["vocab"], "merges": spec["model"]["merges"],
            "special": {t["content"]: t["id"] for t in spec.get("added_tokens", [])}}


def _step(h, byte):
    """The hash of a suffix with one byte more before it; one to one for every byte."""
    if isinstance(h, int):
        h = ((h ^ byte) * 0xFF51AFD7ED558CCD) & 0xFFFFFFFFFFFFFFFF
        return h ^ h >> 29
    h = (h ^ byte) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


class Table:
    """A hash table of fixed size from integers to small integers; arrays of keys are looked up at once."""

    FREE, NONE = np.uint64((1 << 64) - 1), -2
    FACTOR = 0x9E3779B97F4A7C15

    def __init__(self, bits: int):
        self.bits, self.used = bits, 0
        self.keys, self.values = np.full(1 << bits, self.FREE), np.full(1 << bits, self.NONE, dtype=np.int32)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        """The values, ``NONE`` for unknown keys."""
        slot = ((keys * np.uint64(self.FACTOR)) >> np.uint64(64 - self.bits)).astype(np.int64)
        there = self.keys[slot]
        on = np.flatnonzero((there != keys) & (there != self.FREE))
        while len(on):
            slot[on] = (slot[on] + 1) & (len(self.keys) - 1)
            there = self.keys[slot[on]]
            on = on[(there != keys[on]) & (there != self.FREE)]
        return np.where(self.keys[slot] == keys, self.values[slot], self.NONE)

    def add(self, keys: list[int], values: list[int]) -> None:
        """Adds new keys, none twice."""
        self.used += len(keys)
        mask, shift, slots = len(self.keys) - 1, 64 - self.bits, self.keys
        for key, value in zip(keys, values, strict=True):
            slot = (key * self.FACTOR & 0xFFFFFFFFFFFFFFFF) >> shift
            while slots[slot] != self.FREE:
                slot = slot + 1 & mask
            slots[slot], self.values[slot] = key, value


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, spec: dict):
        vocab, symbols = spec["vocab"], _byte_symbols()
        self.strings = {i: s for s, i in vocab.items()} | {i: s for s, i in spec["special"].items()}
        self.special = spec["special"]
        self._specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.inner, self.final = [vocab[s] for s in symbols], [vocab[s + _MARK] for s in symbols]
        self.merges = {}
        for rank, (a, b) in enumerate(spec["merges"]):
            if a in vocab and b in vocab and a + b in vocab:
                self.merges.setdefault((vocab[a], vocab[b]), rank << 32 | vocab[a + b])
        byte_of = {s: b for b, s in enumerate(symbols)}
        self._bytes, self.parts = {}, {}
        for token, i in vocab.items():
            body, ends = token.removesuffix(_MARK), token.endswith(_MARK)
            raw = bytes(byte_of[c] for c in body)
            self._bytes[i] = raw + b" " * ends
            self.parts[i] = tuple(self.inner[b] for b in raw[:-1]) + ((self.final if ends else self.inner)[raw[-1]],) if raw else ()
        # Tokens that encode to themselves, by their bytes: within a word and at its end.
        self.within: dict = {}
        self.at_end: dict = {}
        self._rank: dict = {}
        self._left: dict = {}
        self._right: dict = {}
        for i, p in self.parts.items():
            if p and self._grown(i, p):
                raw, ends = self._bytes[i], self.strings[i].endswith(_MARK)
                (self.at_end if ends else self.within)[raw[:-1] if ends else raw] = i
        self.lookahead = max(map(len, [*self.within, *self.at_end]))
        self.size = np.zeros(max(self.strings) + 1, dtype=np.int64)
        for i, p in self.parts.items():
            self.size[i] = len(p)
        # Every suffix of a token, by its hash, with the token it is, or -1.
        suffixes: dict = {}
        for tokens, seed in ((self.within, _WITHIN), (self.at_end, _AT_END)):
            for raw, i in tokens.items():
                h = seed
                for k in range(len(raw) - 1, -1, -1):
                    h = _step(h, raw[k])
                    suffixes[h] = i if k == 0 else suffixes.get(h, -1)
        self._suffixes = Table((4 * len(suffixes)).bit_length())
        self._suffixes.add([*suffixes], [*suffixes.values()])
        self.decimal = {i: str(i) for i in self.strings}
        self._pairs = Table((4 * PAIRS).bit_length() - 1)
        self._words: dict = {}
        self._older: dict = {}

    def _grown(self, token: int, parts: tuple) -> bool:
        """Does the token encode to itself? If so, notes the tokens on its two edges as it grows.

        An edge is a list of (token, rank it appears at, rank at which a larger one takes its place).
        """
        ids, left, right = list(parts), [(parts[0], -1)], [(parts[-1], -1)]
        while len(ids) > 1:
            best, i = min((self.merges.get(pair, _NONE), i) for i, pair in enumerate(zip(ids, ids[1:], strict=False)))
            if best == _NONE:
                return False
            ids[i : i + 2] = [best & _MASK]
            if i == 0:
                left.append((ids[0], best >> 32))
            if i == len(ids) - 1:
                right.append((ids[-1], best >> 32))
        for edges, edge in ((self._left, left), (self._right, right)):
            edges[token] = [(t, r, until) for (t, r), until in zip(edge, [r for _, r in edge[1:]] + [_NONE], strict=True)]
        return ids == [token]

    def merged(self, ids: list[int]) -> list[int]:
        """Merges symbols by rank, the leftmost first among equals."""
        get, none, mask = self.merges.get, _NONE, _MASK
        ids, order = list(ids), [get(pair, none) for pair in zip(ids, ids[1:], strict=False)]
        while order:
            best = min(order)
            if best == none:
                break
            i = order.index(best)
            ids[i : i + 2] = [best & mask]
            del order[i]
            if i:
                order[i - 1] = get((ids[i - 1], ids[i]), none)
            if i < len(order):
                order[i] = get((ids[i], ids[i + 1]), none)
        return ids

    def compatible(self, a: int, b: int) -> bool:
        """Does b follow a (-1: nothing) as a token of its own?

        It does unless a token on the right edge of a and one on the left edge of b, while both are
        there, form a pair that merges before either is taken by its own side (the leftmost first).
        """
        if a >= 0:
            for x, x_from, x_until in self._right[a]:
                for y, y_from, y_until in self._left[b]:
                    rank = self.merges.get((x, y))
                    if rank is not None and x_from < y_until and y_from < x_until and rank >> 32 < x_until and rank >> 32 <= y_until:
                        return False
        return True

    def _fits(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """:meth:`compatible` of pairs, from the table of known pairs."""
        key = ((before + 1) << 20 | token).astype(np.uint64)
        known = self._pairs[key]
        new = np.unique(key[known == Table.NONE])
        if len(new):
            if self._pairs.used + len(new) > PAIRS:
                self._pairs = Table(self._pairs.bits if len(new) < PAIRS else (4 * len(new)).bit_length())
                new = np.unique(key)
            new = new.tolist()
            self._pairs.add(new, [self.compatible((k >> 20) - 1, k & (1 << 20) - 1) for k in new])
            known = self._pairs[key]
        return known == 1

    def transduce(self, raws: list[bytes]) -> list[tuple[int, ...]]:
        """The tokens of many words that fit in the window; every step takes one position of all words."""
        order = sorted(range(len(raws)), key=lambda k: -len(raws[k]))
        flat = np.frombuffer(b"".join([raws[k] for k in order]), dtype=np.uint8)
        length = np.array([len(raws[k]) for k in order], dtype=np.int64)
        start = np.cumsum(length) - length
        depth = np.arange(len(flat)) - np.repeat(start, length) + 1
        # Tokens that end at each position, by their length.
        ending, at = [], np.arange(len(flat))
        hashes = np.full(len(flat), _WITHIN, dtype=np.uint64)
        hashes[start + length - 1] = _AT_END
        while len(at):
            hashes = _step(hashes, flat[at - len(ending)].astype(np.uint64))
            token = self._suffixes[hashes]
            found = np.full(len(flat), -1, dtype=np.int32)
            found[at] = np.maximum(token, -1)
            ending.append(found)
            on = (token != Table.NONE) & (depth[at] > len(ending))
            at, hashes = at[on], hashes[on]
        # The last token of every prefix: the one that its predecessor is compatible with.
        last = np.full(len(flat), -1, dtype=np.int64)
        alive = np.searchsorted(-length, -np.arange(length.max(initial=0)), side="left")
        for k, many in enumerate(alive.tolist()):
            open_ = start[:many] + k
            for size in range(1, min(k + 1, len(ending)) + 1):
                token = ending[size - 1][open_].astype(np.int64)
                some = np.flatnonzero(token >= 0)
                before = last[open_[some] - size] if size <= k else np.full(len(some), -1)
                fits = some[self._fits(before, token[some])]
                last[open_[fits]] = token[fits]
                open_ = np.delete(open_, fits)
                if not len(open_):
                    break
            if len(open_):
                raise ValueError("a merge list whose tokens do not encode to themselves")
        out: list = [()] * len(raws)
        last, size = last.tolist(), self.size.tolist()
        for k, s, n in zip(order, start.tolist(), length.tolist(), strict=True):
            out[k] = tuple(self._back(last[s : s + n], n, size))
        return out

    def stream(self, raw: bytes):
        """Tokens of one word, emitted once stable, with a window of a few times the lookahead."""
        span, size, n = self.lookahead, self.size, len(raw)
        start, carry, last = 0, -1, []  # the last emitted boundary, the token before it, and the last token up to each position since
        for end in range(1, n + 1):
            tokens = self.within if end < n else self.at_end
            for at in range(end - 1, max(start, end - span) - 1, -1):
                token = tokens.get(raw[at:end])
                if token is not None and self.compatible(last[at - start - 1] if at > start else carry, token):
                    last.append(token)
                    break
            else:
                raise ValueError("a merge list whose tokens do not encode to themselves")
            if end - start >= WINDOW * span and end < n:
                ends = {*range(end - start - span, end - start + 1)}
                while len(ends) > 1:
                    most = max(ends)
                    ends.remove(most)
                    ends.add(most - int(size[last[most - 1]]))
                stable = ends.pop()
                if stable:
                    yield from self._back(last, stable, size)
                    start, carry = start + stable, last[stable - 1]
                    del last[:stable]
        yield from self._back(last, n - start, size)

    def _back(self, last: list[int], k: int, size) -> list[int]:
        """The tokens up to position k, from the chain of last tokens."""
        out = []
        while k:
            out.append(last[k - 1])
            k -= int(size[out[-1]])
        return out[::-1]

    def _parts(self, text: str):
        """The words of a text, block by block, and ids of special tokens between them."""
        at, n = 0, len(text)
        while at < n:
            cut = _CUT.search(text, at + BLOCK) if n - at > BLOCK else None
            end = cut.start() if cut else n
            block, at = text[at:end], end
            for k, part in enumerate(self._specials.split(block) if self._specials else [block]):
                if k % 2:
                    yield self.special[part]
                elif part:
                    yield words(part)

    def blocks(self, texts):
        """(number of the text, ids of its next block); all blocks of a text come one after the other."""
        queue, held = [], 0
        for number, text in enumerate(texts):
            for part in self._parts(text or ""):
                queue.append((number, part))
                held += 1 if isinstance(part, int) else sum(map(len, part))
                if held >= QUEUE:
                    yield from self._encoded(queue)
                    queue, held = [], 0
        yield from self._encoded(queue)

    def _encoded(self, queue: list):
        if len(self._words) >= CACHE:
            self._older, self._words = self._words, {}
        known, older = self._words, self._older
        window = WINDOW * self.lookahead
        new, long = [], {}
        for word in set().union(*[p for _, p in queue if not isinstance(p, int)]).difference(known):
            ids = older.get(word)
            if ids is not None:
                known[word] = ids
            elif len(raw := word.encode("utf-8", "surrogatepass")) > window:
                long[word] = tuple(self.stream(raw))
            else:
                new.append((word, raw))
        known.update(zip([w for w, _ in new], self.transduce([r for _, r in new]), strict=True))
        known.update(long)
        for number, part in queue:
            yield number, [part] if isinstance(part, int) else list(chain.from_iterable(map(known.__getitem__, part)))
        for word in long:
            del known[word]

    def encode(self, text: str | None) -> list[int]:
        return [i for _, ids in self.blocks([text]) for i in ids]

    def decode(self, ids, plain: bool = False) -> str:
        decoder = Decoder(self, plain)
        return decoder.feed(ids) + decoder.end()


def words(text: str) -> list[str]:
    """The words of a part without special tokens, normalised."""
    text = normalized(text)
    return (_LATIN if text.isascii() or not _OTHER.search(text) else _WORDS).findall(text)


def normalized(text: str) -> str:
    """NFC, then lower case character by character (white space is left to the word pattern)."""
    text = unicodedata.normalize("NFC", text)
    return "".join([c.lower() for c in text]) if "Σ" in text else text.lower()


class Decoder:
    """Turns tokens into text one at a time; bytes of an unfinished character are held back."""

    def __init__(self, codec: Codec, plain: bool = False):
        self.codec, self.plain, self.first = codec, plain, True
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        """The text of the next tokens."""
        if self.plain:
            text = " ".join([self.codec.strings.get(i, "") for i in ids])
            gap, self.first = "" if self.first or not ids else " ", self.first and not ids
            return gap + text
        out, raw, known = [], [], self.codec._bytes
        for i in ids:
            if i in known:
                raw.append(known[i])
            else:  # a special token ends whatever is unfinished
                out += [self.state.decode(b"".join(raw), True), self.codec.strings.get(i, "")]
                raw = []
        return "".join(out) + self.state.decode(b"".join(raw))

    def end(self) -> str:
        return "" if self.plain else self.state.decode(b"", True)


_codecs: dict = {}


def _codec(shared) -> Codec:
    """One codec for a vocabulary in a Python worker, whichever query it was built for."""
    if shared.id not in _codecs:
        _codecs.clear()
        _codecs[shared.id] = Codec(shared.value)
    return _codecs[shared.id]


class _Shared:
    def __init__(self, spark, path):
        spec = load(path)
        self.value_of = spark.sparkContext.broadcast(spec)
        self.id = hashlib.sha256(json.dumps(spec, sort_keys=True).encode()).hexdigest()

    @property
    def value(self):
        return self.value_of.value


def _pieces(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def encode_and_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids and the readable decoded text of every document."""
    shared = _Shared(docs.sparkSession, path or vocabulary_path())

    def run(batches):
        codec = _codec(shared)
        for batch in _pieces(batches):
            ids = [[] for _ in range(batch.num_rows)]
            for number, block in codec.blocks(batch["text"].to_pylist()):
                ids[number] += block
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())),
                 pa.array([codec.decode(x) for x in ids], pa.string())],
                ["doc_id", "n_tokens", "ids", "decoded"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the plain decoding, in constant memory a text."""
    shared = _Shared(docs.sparkSession, path or vocabulary_path())

    def run(batches):
        codec = _codec(shared)
        for batch in _pieces(batches):
            rows = [[0, hashlib.sha256(), hashlib.sha256(), Decoder(codec, plain=True)] for _ in range(batch.num_rows)]
            for number, ids in codec.blocks(batch["text"].to_pylist()):
                n, a, b, decoder = row = rows[number]
                if ids:
                    a.update((" " * (n > 0) + " ".join([codec.decimal[i] for i in ids])).encode())
                    b.update(decoder.feed(ids).encode())
                    row[0] += len(ids)
            for _, _, b, decoder in rows:
                b.update(decoder.end().encode())
            counts, ids_sha, decoded_sha = [r[0] for r in rows], [r[1].hexdigest() for r in rows], [r[2].hexdigest() for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe_roundtrip(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op9_bpe_roundtrip": (op9_bpe_roundtrip, None)}
