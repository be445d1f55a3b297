"""Personal data: fixed base patterns, plus spans chosen by boosted trees over generous candidates.

Base spans (e-mail, IPv4, payment card, phone) follow fixed patterns and checks and always stay.
High-recall generators also propose long tokens, number groups, values after key words and loose
addresses; candidates may overlap. Gradient-boosted trees score each one by its format and context.
A threshold per generator, set on candidates the trees were not fitted on, selects those precise enough;
of overlapping selected candidates the likeliest stays, and none lies within a base span.

No span is labelled in the data, so the trees learn from planted values: into every text :func:`plant`
writes made-up personal values (tokens, keys, identifiers, passwords, numbers, addresses) and decoys of
similar form (dates, versions, paths, long words, ranges, plain words after key words), both with and
without key words and quotes around them. A candidate's label is what was planted there; the texts' own
candidates are negatives, except near base spans and key words, where they are left out. No label
comes from a generator or a feature. All candidates of all texts count: they are kept as bins of their
features, Spark adds up histograms of them for every split, and the driver sees these sums only.

Patterns take time linear in the text (runs are consumed once); selection sorts the candidates and
looks up neighbours. Whole texts are read.

Edge cases: a null text is empty and has no spans; repeated rows give equal rows; a null doc_id
stays; an empty table gives no rows, and one without candidates a model that adds nothing. Only
doc_id and text are read; :func:`redact` keeps all columns.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.boosting import GRID, STEP, Boosted, binned, boost, histogram, sigmoid
from lexiloom.session import discard, materialize, table

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.95
#: Values planted in a document.
PLANTS = 6
#: Number of :func:`features`, candidates in a row of the table of bins, and levels of a logit by which thresholds are set.
FEATURES, ROW, LEVELS = 19, 256, 64

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_SEPARATORS = str.maketrans("", "", " -.()+")

_LONG = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}")
_NUMBER = re.compile(r"(?<![0-9A-Za-z])[0-9][0-9 ().-]{4,}[0-9]")
_KEY = r"(?:token|secret|key|password|passwd|pwd)[\"']?\s*[:=]\s*[\"']?"
_KEYED = re.compile(_KEY + r"([^\s\"']{6,})", re.IGNORECASE)
_AFTER_KEY = re.compile(_KEY + r"\Z", re.IGNORECASE)
_AROUND = "\"'`,;:()[]{}<>!?.#$%&*"
#: Kinds of added spans by generator.
GENERATORS = ("secret", "number", "keyed", "address")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base spans in the order of their digest."""
    out = []
    at, past = text.find("@"), 0
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            start = at - _tail(text, past, at)
            if start < at:
                past = domain.end()
                out.append((start, 0, past))
        at = text.find("@", max(at + 1, past))
    first = _DIGIT.search(text)
    if first:
        from_here = first.start()
        for m in _IP.finditer(text, from_here):
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text, from_here):
            if m.end() - m.start() >= 12:
                digits = m[0].translate(_SEPARATORS)
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(m[0].translate(_SEPARATORS)) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def _tail(text: str, low: int, high: int) -> int:
    """Length of the run of local-part characters that ends at ``high``, not before ``low``."""
    n = 64
    while True:
        piece = text[max(low, high - n) : high]
        run = len(piece) - len(piece.rstrip(_LOCAL))
        if run < len(piece) or len(piece) == high - low:
            return run
        n *= 4


def candidates(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, end, generator, follows a key word) of all proposals; they may overlap."""
    out = []

    def trimmed(s, e, generator):
        piece = text[s:e]
        left = len(piece) - len(piece.lstrip(_AROUND))
        right = len(piece.rstrip(_AROUND))
        if right - left >= 6:
            out.append((s + left, s + right, generator, False))

    for m in _LONG.finditer(text):
        trimmed(m.start(), m.end(), 0)
    first = _DIGIT.search(text)
    if first:
        for m in _NUMBER.finditer(text, first.start()):
            out.append((m.start(), m.end(), 1, False))
    if "=" in text or ":" in text:
        for m in _KEYED.finditer(text):
            out.append((m.start(1), m.end(1), 2, True))
    at = text.find("@")
    while at >= 0:
        s, e = at, at + 1
        while s > 0 and not text[s - 1].isspace():
            s -= 1
        while e < len(text) and not text[e].isspace():
            e += 1
        trimmed(s, e, 3)
        at = text.find("@", e)
    return out


def features(text: str, s: int, e: int, generator: int) -> list[float]:
    """Format of the span and of a few characters around it."""
    span, before, after = text[s:e], text[max(0, s - 16) : s], text[e : e + 2]
    n = len(span)
    digits = sum(map(span.count, "0123456789"))
    hexes = digits + sum(map(span.count, "abcdef"))
    return [
        float(generator == 1), float(generator == 3), min(n, 80) / 80, digits / n, hexes / n,
        sum(map(str.isupper, span)) / n, len(set(span)) / min(n, 64), float(not span.isascii()),
        span.count(".") / n, (span.count("-") + span.count(" ")) / n, float("@" in span), float(before.rstrip().endswith(("=", ":"))),
        float(before[-1:] in "\"'" and before != ""), float(after[:1] in "\"'" and after != ""), float(before.endswith(("+", "+ "))),
        float(any(c.isalpha() for c in span) and digits > 0), float(_AFTER_KEY.search(before) is not None), (span.count("/") + span.count("_")) / n,
        float(sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:], strict=False))) / n,
    ]


_HEX, _ALNUM = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_SYLLABLES = "an ber con de el en for ga ing ja la men no or pre ra sta ti un ver".split()


def _made(rng: random.Random) -> tuple[str, bool]:
    """A made-up value, and whether it is personal."""
    some = lambda signs, low, high: "".join(rng.choices(signs, k=rng.randint(low, high)))
    word = lambda low, high: "".join(rng.choices(_SYLLABLES, k=rng.randint(low, high)))
    digits = lambda n: some("0123456789", n, n)
    kind = rng.randrange(12)
    if kind < 6:
        return (
            some(_HEX, 24, 64), some(_ALNUM, 20, 48), "-".join(some(_HEX, n, n) for n in (8, 4, 4, 4, 12)), some(_ALNUM + "!#$%&*?", 8, 16),
            rng.choice((f"({digits(3)}) {digits(3)}-{digits(4)}", f"0{digits(2)} {digits(4)} {digits(4)}", f"{digits(3)}-{digits(2)}-{digits(4)}")),
            f"{word(2, 3)}.{rng.choice('äéöñ')}{word(1, 2)}@{word(2, 3)}",
        )[kind], True
    return (
        rng.choice((f"20{digits(2)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", f"{rng.randint(10, 23)}.{rng.randint(10, 59)}.{rng.randint(10, 59)}")),
        f"{digits(3)}-{digits(3)}", "/".join(word(1, 3) for _ in range(4)), "_".join(word(2, 3) for _ in range(3)),
        rng.choice((str.lower, str.capitalize))(word(6, 12)), word(3, 5),
    )[kind - 6], False


def plant(text: str, rng: random.Random) -> tuple[str, list[tuple[int, int, bool]]]:
    """The text with made-up values between its words, and (start, end, personal) of each."""
    gaps = sorted(rng.sample(range(len(text) + 1), min(PLANTS, len(text) + 1)))
    out, spots, past, length = [], [], 0, 0
    for gap in gaps:
        gap = next((k for k in range(gap, min(gap + 200, len(text))) if text[k].isspace()), None)
        if gap is None or gap < past:
            continue
        value, personal = _made(rng)
        quote = rng.choice(("", "", "'", '"'))
        before = f" {rng.choice(('', '', '', 'token = ', 'password: ', 'key=', 'id: ', 'see ', 'on '))}{quote}"
        out += [text[past:gap], before, value, quote]
        length += gap - past + len(before)
        spots.append((length, length + len(value), personal))
        length += len(value) + len(quote)
        past = gap
    return "".join([*out, text[past:]]), spots


class _Cover:
    """Whether spans overlap some of a list of spans, or lie within one."""

    def __init__(self, spans):
        spans = sorted(spans)
        self.starts, self.reach = [s for s, _ in spans], list(accumulate((e for _, e in spans), max))

    def overlaps(self, s: int, e: int) -> bool:
        k = bisect_left(self.starts, e)
        return k > 0 and self.reach[k - 1] > s

    def holds(self, s: int, e: int) -> bool:
        k = bisect_right(self.starts, s)
        return k > 0 and self.reach[k - 1] >= e


def labelled(text: str, rng: random.Random):
    """(start, end, generator, label) of the candidates of a text with planted values, and that text."""
    text, spots = plant(text, rng)
    found = candidates(text)
    personal, made = _Cover([x[:2] for x in spots if x[2]]), _Cover([x[:2] for x in spots])
    apart = _Cover([(s, e) for s, _, e in base_spans(text)] + [c[:2] for c in found if c[3]])
    starts = [x[0] for x in spots]
    out = []
    for s, e, generator, _ in found:
        if made.overlaps(s, e):
            k = bisect_left(starts, e) - 1
            low, high, _ = spots[k]
            if min(e, high) - max(s, low) >= 0.8 * max(high - low, e - s):  # the value itself, not a part of it
                out.append((s, e, generator, int(personal.overlaps(s, e))))
        elif not apart.overlaps(s, e):
            out.append((s, e, generator, 0))
    return text, out


class Selector:
    """The trees and the threshold of each generator."""

    def __init__(self, model=None, thresholds=(2.0,) * len(GENERATORS)):
        self.model, self.thresholds = model, thresholds

    def added(self, text: str, base) -> list[tuple[int, int, int]]:
        """(start, generator, end) of the selected candidates, by start."""
        found = candidates(text) if self.model else []
        if base:
            cover = _Cover([(s, e) for s, _, e in base])
            found = [c for c in found if not cover.holds(c[0], c[1])]
        if not found:
            return []
        p = self.model.probability(np.array([features(text, s, e, g) for s, e, g, _ in found]))
        chosen = sorted((-x, s, g, e) for x, (s, e, g, _) in zip(p.tolist(), found, strict=True) if x >= self.thresholds[g])
        # The likeliest first; what overlaps an earlier choice (they are disjoint, by start) is left out.
        taken: list[tuple[int, int, int]] = []
        for _, s, g, e in chosen:
            k = bisect_left(taken, (s,))
            if (k == 0 or taken[k - 1][2] <= s) and (k == len(taken) or e <= taken[k][0]):
                insort(taken, (s, g, e))
        return taken


def _thresholds(counts) -> tuple[float, ...]:
    """The lowest probability of each generator with ``PRECISION`` at or above it; 2 for none.

    ``counts`` are (generator, level, candidates, personal ones) of the levels of logits from 0 on.
    """
    out = [2.0] * len(GENERATORS)
    seen, hits = [0] * len(GENERATORS), [0] * len(GENERATORS)
    for g, level, n, personal in sorted(counts, key=lambda c: -c[1]):
        seen[g], hits[g] = seen[g] + n, hits[g] + personal
        if hits[g] >= PRECISION * seen[g]:
            out[g] = float(sigmoid(level / LEVELS - STEP / 2))  # scores are multiples of STEP
    return tuple(out)


def _rows(batches):
    """Rows of up to ROW candidates of texts with planted values: FEATURES bins and a byte each, and how many of them are held out.

    The byte holds label, held out by document, held out by place in it, and generator.
    """
    schema = pa.schema([("x", pa.binary()), ("n", pa.int64()), ("held", pa.int64())])
    for batch in batches:
        out = {"x": [], "n": [], "held": []}
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            seed = zlib.crc32(text.encode()) if doc_id is None else doc_id
            text, found = labelled(text, random.Random(seed))
            held = seed % 3 == 0
            for at in range(0, len(found), ROW):
                some = found[at : at + ROW]
                bins = binned(np.array([features(text, s, e, g) for s, e, g, _ in some]))
                marks = [y | held << 1 | ((at + k) % 3 == 0) << 2 | g << 3 for k, (_, _, g, y) in enumerate(some)]
                out["x"].append(np.column_stack((bins, np.array(marks, np.uint8))).tobytes())
                out["n"].append(len(some))
                out["held"].append(held * len(some))
        yield pa.RecordBatch.from_pydict(out, schema=schema)


def _parts(batches, fold: int, held: bool):
    """Bins (a row a feature), labels and generators of a batch's candidates, those held out or the others."""
    for batch in batches:
        x = np.frombuffer(b"".join(batch["x"].to_pylist()), np.uint8).reshape(-1, FEATURES + 1)
        x = np.ascontiguousarray(x[(x[:, -1] & fold > 0) == held].T)
        yield x[:-1], (x[-1] & 1).astype(float), x[-1] >> 3


def _sums(rows: DataFrame, fold: int, model: Boosted, top) -> np.ndarray:
    """:func:`lexiloom.llm.boosting.histogram` of the candidates that are not held out."""

    def run(batches):
        total = np.zeros((2, FEATURES, GRID + 1, 2), np.int64)
        for bins, y, _ in _parts(batches, fold, held=False):
            total += histogram(model, top, bins, y)
        total = total.reshape(-1, 2)
        place = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total[place, 0]), pa.array(total[place, 1])], ["place", "g", "h"])

    out = np.zeros((2 * FEATURES * (GRID + 1), 2), np.int64)
    # At most a row a bin.
    for r in rows.mapInArrow(run, "place long, g long, h long").groupBy("place").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
        out[r.place] = r.g, r.h
    return out.reshape(2, FEATURES, GRID + 1, 2)


def _levels(rows: DataFrame, fold: int, model: Boosted) -> list[tuple[int, int, int, int]]:
    """(generator, level, candidates, personal ones) of the candidates that are held out, for logits from 0 on."""
    size = 30 * LEVELS + 1

    def run(batches):
        total = np.zeros((2, len(GENERATORS) * size), np.int64)
        for bins, y, g in _parts(batches, fold, held=True):
            score = model.scores(bins)
            key = g.astype(np.int64) * size + np.floor(np.clip(score, 0, 30) * LEVELS).astype(np.int64)
            total += np.stack([np.bincount(key, w, len(GENERATORS) * size) for w in ((score >= 0).astype(float), y * (score >= 0))]).astype(np.int64)
        place = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total[0, place]), pa.array(total[1, place])], ["place", "n", "hits"])

    counts = rows.mapInArrow(run, "place long, n long, hits long").groupBy("place").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    return [(*divmod(r.place, size), r.n, r.hits) for r in counts.collect()]  # at most a row a generator and level


def train(docs: DataFrame) -> Selector:
    """Fits the trees and sets the thresholds on the candidates of all texts, with values planted into each.

    Thresholds come from the documents whose id is divisible by 3, or from every third candidate of a document
    where these are all or none; the trees from the others.
    """
    rows = materialize(docs.where("text IS NOT NULL").select("doc_id", "text").mapInArrow(_rows, "x binary, n long, held long"), "candidates")
    size = rows.agg(F.sum("n").alias("n"), F.sum("held").alias("held")).first()
    fold = 2 if 0 < (size.held or 0) < (size.n or 0) else 4
    model = boost(lambda model, top: _sums(rows, fold, model, top))
    selector = Selector(model, _thresholds(_levels(rows, fold, model))) if model else Selector()
    discard(rows)
    return selector


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def _named(base, added):
    """All spans by start, base kinds before added ones."""
    both = [(s, k, KINDS[k], e) for s, k, e in base] + [(s, len(KINDS) + g, GENERATORS[g], e) for s, g, e in added]
    return [(s, name, e) for s, _, name, e in sorted(both)]


def find_spans(docs: DataFrame, selector: Selector) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, and all spans as kind:start:end."""
    shared = docs.sparkSession.sparkContext.broadcast(selector)

    def run(batches):
        for batch in batches:
            counts, sha, spans = [[] for _ in KINDS], [], []
            for text in batch["text"]:
                text = text.as_py() or ""
                base = base_spans(text)
                for k, column in enumerate(counts):
                    column.append(sum(b[1] == k for b in base))
                sha.append(hashlib.sha256(_joined([(s, KINDS[k], e) for s, k, e in base]).encode()).hexdigest())
                spans.append(_joined(_named(base, shared.value.added(text, base))))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(spans, pa.string())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    )


def redacted(text: str, spans) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    out, past = [], 0
    for s, name, e in spans:
        if s >= past:
            out += [text[past:s], f"[{name.upper()}]"]
        past = max(past, e)
    return "".join([*out, text[past:]])


def redact(docs: DataFrame, selector: Selector) -> DataFrame:
    """The documents with their texts redacted and n_chars, if there, set anew; nulls stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(selector)
    names = docs.columns

    def run(batches):
        for batch in batches:
            texts = []
            for text in batch["text"]:
                text = text.as_py()
                if text:
                    base = base_spans(text)
                    text = redacted(text, _named(base, shared.value.added(text, base)))
                texts.append(text)
            columns = [pa.array(texts, batch.schema.field("text").type) if n == "text" else batch[n] for n in names]
            if "n_chars" in names:
                at = names.index("n_chars")
                columns[at] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)


def op7_pii_spans(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return find_spans(docs, train(docs))


QUERIES = {"op7_pii_spans": (op7_pii_spans, None)}
