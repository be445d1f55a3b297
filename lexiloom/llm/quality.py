"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad. A line's features are shares of character classes, word lengths and
repetition within the line, with those of the lines before and after it; transitions link
neighbouring labels. Forward-backward gives each line's probability of being good; the mean of
these, weighted by line length, calibrated by a logistic curve, is the document's quality.

Only documents carry labels. Training starts with every line bearing its document's label; then
lines of bad documents that the model finds clearly good are relabelled, twice, since bad documents
often start with ordinary lines.

The field is fitted on the whole texts of at most ``SAMPLE`` labelled documents of each label, the
ones with the smallest hash of doc_id, as long as they hold no more than ``SAMPLE_BYTES`` a label (the
first one always counts): the only bounded sample here. Of repeated rows of one id the smallest text is
taken. Scoring is one pass over whole
texts without a shuffle. Labels, lang, source and doc_id are never features.

Edge cases: a null or empty text, or one of white space only, scores 0 and is predicted 0; repeated
rows score alike; a null doc_id is scored and not held out; null labels are skipped and a document
with contradicting labels counts as bad; without any labelled document of one of the two labels
every text scores 0.5. Only doc_id and text, doc_id and quality are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.arrays import word_hashes
from lexiloom.session import table

SAMPLE, SAMPLE_BYTES = 1500, 16 << 20
CUT = 0.3
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "mark": b"#$%&*!~^=+<>@_\\/{}[]", "bar": b"|",
            "stop": b".,;:?'\"()-", "space": b" \t\v\f\r"}
_CODE = np.zeros(256, dtype=np.uint8)
for _n, _bytes in enumerate(_CLASSES.values(), 1):
    _CODE[list(_bytes)] = _n
_OWN = 11
FEATURES = 1 + 3 * _OWN


def line_features(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line that has a word, its length in bytes, and the number of such lines per text."""
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    raw = b"\n".join(raws)
    buf = np.frombuffer(raw, dtype=np.uint8)
    doc_end = np.cumsum([len(r) + 1 for r in raws])
    breaks = np.flatnonzero(buf == 10)
    line_s, line_e = np.concatenate(([0], breaks + 1)), np.concatenate((breaks, [len(buf)]))
    starts, ends, hashes = word_hashes(raw)
    line = np.searchsorted(line_e, starts, side="right")
    n = len(line_s)
    words = np.bincount(line, minlength=n)
    kept = np.flatnonzero(words)
    if not len(kept):
        return np.empty((0, FEATURES)), np.empty(0), np.zeros(len(texts), dtype=np.int64)
    code = _CODE[buf]
    counts = {}
    for k, name in enumerate(_CLASSES, 1):
        hit = np.flatnonzero(code == k)
        counts[name] = np.bincount(np.searchsorted(line_e, hit, side="right"), minlength=n)[kept].astype(float)
    size, w = (line_e - line_s)[kept].astype(float), words[kept].astype(float)
    length = (ends - starts).astype(float)
    short = np.bincount(line, weights=length <= 3, minlength=n)[kept]
    total = np.bincount(line, weights=length, minlength=n)[kept]
    # Distinct words of a line: changes in the order of (line, hash).
    key = (line.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24))
    key.sort()
    fresh = np.ones(len(key), dtype=bool)
    fresh[1:] = key[1:] != key[:-1]
    distinct = np.bincount((key[fresh] >> np.uint64(40)).astype(np.int64), minlength=n)[kept]
    # (A text of over 2**24 lines wraps the line number, which only blurs these shares.)
    visible = np.maximum(1.0, size - counts["space"])
    first = buf[np.minimum(line_s[kept], len(buf) - 1)]
    own = np.stack([
        counts["upper"] / visible,
        np.minimum(1.0, 3 * counts["mark"] / visible),
        np.minimum(1.0, 2 * counts["bar"] / w),
        counts["digit"] / visible,
        1.0 - distinct / w,
        np.minimum(1.0, np.log1p(w) / 8),
        np.minimum(1.0, total / w / 20),
        np.minimum(1.0, counts["stop"] / w),
        short / w,
        (w < 3).astype(float),
        ((first >= 97) & (first <= 122)).astype(float),
    ], axis=1)
    doc = np.searchsorted(doc_end, line_s[kept], side="right")
    lines = np.bincount(doc, minlength=len(texts))
    before, after = np.zeros_like(own), np.zeros_like(own)
    same = (doc[1:] == doc[:-1])[:, None]
    before[1:], after[:-1] = own[:-1] * same, own[1:] * same
    return np.concatenate((np.ones((len(own), 1)), own, before, after), axis=1), size, lines


def _steps(lines: np.ndarray):
    """For position 0, 1, ...: the rows of every document's line at that position."""
    lines = lines[lines > 0]
    head = np.concatenate(([0], np.cumsum(lines)[:-1]))
    order = np.argsort(-lines, kind="stable")
    head, lines = head[order], lines[order]
    alive = np.searchsorted(-lines, -np.arange(lines.max(initial=0)), side="left")
    return [head[:n] + t for t, n in enumerate(alive.tolist())]


def marginals(scores: np.ndarray, move: np.ndarray, lines: np.ndarray):
    """Forward and backward odds (good to bad) of every line, and its probability of being good.

    ``move[i, j]`` is the log potential of label j after label i (1: good).
    """
    e, m = np.exp(np.clip(scores, -30, 30)), np.exp(move)
    steps = _steps(lines)
    forward, backward = np.empty_like(e), np.ones_like(e)
    for t, rows in enumerate(steps):
        if t:
            r = forward[rows - 1]
            forward[rows] = np.clip(e[rows] * (r * m[1, 1] + m[0, 1]) / (r * m[1, 0] + m[0, 0]), 1e-12, 1e12)
        else:
            forward[rows] = e[rows]
    for rows in steps[:0:-1]:
        x = np.clip(e[rows] * backward[rows], 1e-12, 1e12)
        backward[rows - 1] = (m[1, 1] * x + m[1, 0]) / (m[0, 1] * x + m[0, 0])
    odds = forward * backward
    return forward, backward, odds / (1 + odds)


class Model:
    """Weights of the field and of the calibration."""

    def __init__(self, weights=None, move=None, curve=(0.0, 0.0)):
        self.weights, self.move, self.curve = weights, move, curve

    def raw(self, x, size, lines):
        """Length-weighted mean probability of a good line, per document; NaN without lines."""
        p = marginals(x @ self.weights, self.move, lines)[2]
        doc = np.repeat(np.arange(len(lines)), lines)
        total = np.bincount(doc, weights=size, minlength=len(lines))
        with np.errstate(invalid="ignore"):
            return np.bincount(doc, weights=size * p, minlength=len(lines)) / total

    def score(self, texts: list) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), 0.5)
        raw = self.raw(*line_features(texts))
        a, b = self.curve
        return np.where(np.isnan(raw), 0.0, 1 / (1 + np.exp(-(a * raw + b))))


def _fit_field(x, labels, lines, weights, move, rounds: int):
    """Maximises the penalised likelihood of the line labels by Adam."""
    first = np.cumsum(lines[lines > 0])[:-1]
    inner = np.ones(len(x), dtype=bool)
    inner[np.concatenate(([0], first))] = False
    at = np.flatnonzero(inner)
    theta = np.concatenate((weights, move.ravel()))
    pairs = np.bincount((2 * labels[at - 1] + labels[at]).astype(int), minlength=4).astype(float)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    k = len(weights)
    for t in range(1, rounds + 1):
        move = theta[k:].reshape(2, 2)
        scores = x @ theta[:k]
        r, s, p = marginals(scores, move, lines)
        m, ahead = np.exp(move), np.exp(np.clip(scores[at], -30, 30)) * s[at]
        back = r[at - 1]
        joint = np.stack((np.full(len(at), m[0, 0]), m[0, 1] * ahead, back * m[1, 0], back * m[1, 1] * ahead))
        expected = (joint / joint.sum(axis=0)).sum(axis=1)
        g = np.concatenate((x.T @ (labels - p), pairs - expected)) / len(x) - 1e-4 * theta
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        theta = theta + 0.15 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return theta[:k], theta[k:].reshape(2, 2)


def fit(texts_x, size, lines, good) -> Model:
    """A model of labelled documents: their line features, line sizes, line counts and labels."""
    has = lines > 0
    lines, good = lines[has], good[has]
    if not len(good) or good.min() == good.max():
        return Model()
    doc = np.repeat(np.arange(len(lines)), lines)
    labels = good[doc].astype(float)
    weights, move = np.zeros(FEATURES), np.zeros((2, 2))
    for rounds in (60, 30, 30):
        weights, move = _fit_field(texts_x, labels, lines, weights, move, rounds)
        p = marginals(texts_x @ weights, move, lines)[2]
        labels = np.where(good[doc] == 1, 1.0, (p > 0.8).astype(float))
    model = Model(weights, move)
    raw, share = model.raw(texts_x, size, lines), np.clip(np.mean(good), 0.02, 0.98)
    # Both labels weigh the same, so the curve crosses 0.5 between them, then the cut is moved there.
    w = np.where(good == 1, 0.5 / share, 0.5 / (1 - share))
    a, b = 8.0, -4.0
    for _ in range(100):
        q = 1 / (1 + np.exp(-(a * raw + b)))
        d, h = w * (good - q), np.maximum(w * q * (1 - q), 1e-9)
        grad = np.array([(d * raw).sum() - 0.01 * a, d.sum() - 0.01 * b])
        hess = np.array([[(h * raw * raw).sum() + 0.01, (h * raw).sum()], [(h * raw).sum(), h.sum() + 0.01]])
        step = np.linalg.solve(hess, grad)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return Model(weights, move, (a, b + np.log(CUT / (1 - CUT))))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits the field on labelled documents that are not held out."""
    known = (
        labels.where("quality IS NOT NULL AND doc_id IS NOT NULL")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("good"))
    )
    order = F.xxhash64(F.lit("sample"), "doc_id")
    chosen = known.where("good > 0").orderBy(order, "doc_id").limit(sample).unionByName(
        known.where("good <= 0").orderBy(order, "doc_id").limit(sample)
    )
    # At most 2 * sample rows of two numbers each.
    picked = docs.select(F.col("doc_id").alias("id"), "text").join(
        F.broadcast(chosen), F.col("id") == F.col("doc_id")
    ).groupBy("doc_id", "good").agg(F.min("text").alias("text"))
    # Windows over the sample alone.
    before = Window.partitionBy(F.col("good") > 0).orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    held = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(before)
    picked = picked.withColumn("held", held).withColumn("nth", F.count(F.lit(1)).over(before)).where((F.col("held") <= SAMPLE_BYTES) | (F.col("nth") == 1))
    picked = picked.select("doc_id", "good", "text")

    def run(batches):
        for batch in batches:
            x, size, lines = line_features(batch["text"].to_pylist())
            cut = np.cumsum(lines)[:-1]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["good"].cast(pa.int32()),
                 pa.array([v.astype("<f4").tobytes() for v in np.split(x, cut)]),
                 pa.array([v.astype("<f4").tobytes() for v in np.split(size, cut)])],
                ["doc_id", "good", "x", "size"],
            )

    rows = picked.mapInArrow(run, "doc_id long, good int, x binary, size binary").collect()
    rows.sort(key=lambda r: (r.doc_id, r.x))
    x = np.frombuffer(b"".join(bytes(r.x) for r in rows), "<f4").reshape(-1, FEATURES).astype(float)
    size = np.frombuffer(b"".join(bytes(r["size"]) for r in rows), "<f4").astype(float)
    lines = np.array([len(r["size"]) // 4 for r in rows], dtype=np.int64)
    return fit(x, size, lines, np.array([int(r.good > 0) for r in rows]))


def _scores(model: Model, texts: list) -> np.ndarray:
    """Scores a batch in pieces of a few megabytes."""
    out, part, held = [], [], 0
    for text in texts:
        part.append(text)
        held += len(text or "")
        if held > 1 << 21:
            out.append(model.score(part))
            part, held = [], 0
    return np.concatenate([*out, model.score(part)]) if part or not out else np.concatenate(out)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            s = _scores(shared.value, batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(s), pa.array((s >= CUT).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int"
    )


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The documents predicted good, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_scores(shared.value, batch["text"].to_pylist()) >= CUT))

    return docs.mapInArrow(run, docs.schema)


def op2_crf_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op2_crf_quality": (op2_crf_quality, None)}
