import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from lexiloom.llm.boosting import binned, boost, histogram
from lexiloom.llm.pii import KINDS, Selector, _Cover, base_spans, candidates, features, find_spans, labelled, luhn, op7_pii_spans, plant, redact, redacted, train

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for k, kind in enumerate(PATTERNS):
        for m in re.finditer(PATTERNS[kind], text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_match_the_patterns():
    rng = random.Random(2)
    pieces = ["a@b.co", "@", "x.y@", "-", ".", "..", "1", "12", "255", "256", "00012", "4111 1111 1111 1111", "+", "+1 (017) 555-7713", " ", "é", "4111-1111", "(", "b", "\n", "1.2.3.4.5.6.7.8"]
    for _ in range(6000):
        text = "".join(rng.choices(pieces, k=rng.randrange(14)))
        assert base_spans(text) == plain_spans(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 2_000_000, "1" * 2_000_000, "a" * 1_000_000 + "@", "1." * 500_000, "+1" + " " * 1_000_000, "1 " * 500_000):
        base_spans(text)
        Selector(None).added(text, [])


def test_luhn_and_redaction():
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    assert redacted("abcdef", [(1, "ip", 3), (2, "card", 4)]) == "a[IP]ef"


@pytest.fixture(scope="module")
def selector(spark):
    return train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op7_pii_spans(spark, sf).collect():
        base = plain_spans(texts[r.doc_id])
        joined = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[1] == k for b in base) for k in range(4)]
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_added_spans_are_secrets_not_prose(spark, selector):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    secret = re.compile(r'token = "([0-9a-f]{40})"')
    found = missed = other = 0
    for _, text in rows:
        added = selector.added(text, base_spans(text))
        want = {m.span(1) for m in secret.finditer(text)}
        got = {(s, e) for s, _, e in added}
        found += len(want & got)
        missed += len(want - got)
        other += len(got - want)
    assert found > 5 and missed == 0 and other <= found


def test_edge_rows(spark, selector):
    docs = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (None, "mail a@b.co now", "x")], "doc_id long, text string, spans string")
    got = sorted((str(r.doc_id), r.n_email, r.spans) for r in find_spans(docs, selector).collect())
    assert got == [("1", 0, ""), ("1", 0, ""), ("None", 1, "email:5:11")]
    clean = redact(docs, selector)
    assert clean.columns == docs.columns
    assert {r.text for r in clean.collect()} == {None, "", "mail [EMAIL] now"}
    assert find_spans(docs.limit(0), selector).count() == 0 and train(docs.limit(0)).model is None


def test_planted_values_are_found_and_decoys_left(spark, selector):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("text IS NOT NULL").collect()
    right = wrong = missed = 0
    for r in rows:
        text, spots = plant(r.text, random.Random(r.doc_id + 10**9))
        added, base = selector.added(text, base_spans(text)), base_spans(text)
        for s, e, personal in spots:
            hit = any(a < e and s < b for a, _, b in added) or any(a < e and s < b for a, _, b in base)
            right, missed, wrong = right + (personal and hit), missed + (personal and not hit), wrong + (not personal and hit)
    assert right > 500 and right / (right + wrong) > 0.9 and right / (right + missed) > 0.8, (right, wrong, missed)


def test_labels_are_what_was_planted():
    text, found = labelled("some plain words of a text " * 20, random.Random(5))
    _, spots = plant("some plain words of a text " * 20, random.Random(5))
    assert found and {(s, e): y for s, e, _, y in found} == {(s, e): int(p) for s, e, p in spots if any((s, e) == f[:2] for f in found)}


def test_covers_and_selection_match_comparing_all_pairs(selector):
    rng = random.Random(7)
    for _ in range(300):
        spans = [(s, s + rng.randrange(1, 9)) for s in (rng.randrange(40) for _ in range(rng.randrange(8)))]
        cover = _Cover(spans)
        for s in range(40):
            e = s + rng.randrange(1, 7)
            assert cover.overlaps(s, e) == any(a < e and s < b for a, b in spans)
            assert cover.holds(s, e) == any(a <= s and e <= b for a, b in spans)
    for _ in range(30):
        text = " ".join(rng.choice(("token=", '"', "0f" * 14, "x@y", "017 555 7713", "key: a1B2c3D4", "word", "12-34-56-78", "é@b.c/d")) for _ in range(60))
        found = [c for c in candidates(text) if not any(s <= c[0] and c[1] <= e for s, _, e in base_spans(text))]
        p = selector.model.probability(np.array([features(text, s, e, g) for s, e, g, _ in found]))
        taken = []
        for _, s, g, e in sorted((-x, s, g, e) for x, (s, e, g, _) in zip(p.tolist(), found, strict=True) if x >= selector.thresholds[g]):
            if all(e <= a or b <= s for a, _, b in taken):
                taken.append((s, g, e))
        assert selector.added(text, base_spans(text)) == sorted(taken)


def test_many_candidates_take_near_linear_time(selector):
    text = "token = abc9d8e7f6a5b4c3d2e1f0 mail a.b@c.de " * 10_000
    began = time.process_time()
    assert len(selector.added(text, base_spans(text))) == 10_000
    assert time.process_time() - began < 10


def test_trees_and_thresholds_come_from_all_candidates_of_all_texts(spark):
    """The fit over Spark's parts is the fit over one array of every candidate, however the texts are dealt."""
    rng = random.Random(11)
    words = ["plain", "words", "of", "text", "key=", "0123 456 789", "a.b@c", "x/y/zz/longer_names/still"]
    rows = [(None if n % 500 == 7 else n, " ".join(rng.choices(words, k=12))) for n in range(5000)]
    x, y, g, held = [], [], [], []
    for doc_id, text in rows:
        seed = zlib.crc32(text.encode()) if doc_id is None else doc_id
        changed, found = labelled(text, random.Random(seed))
        for s, e, generator, label in found:
            x.append(features(changed, s, e, generator))
            y.append(float(label))
            g.append(generator)
            held.append(seed % 3 == 0)
    bins, y, g, held = binned(np.array(x)).T, np.array(y), np.array(g), np.array(held)
    assert len(y) > 20_000
    model = boost(lambda model, top: histogram(model, top, bins[:, ~held], y[~held]))
    score, thresholds = model.scores(bins), []
    for k in range(4):
        mine = sorted(((np.floor(s * 64), t) for s, t in zip(score[held & (g == k)], y[held & (g == k)], strict=True) if s >= 0), reverse=True)
        least = [lv for n, (lv, _) in enumerate(mine, 1) if (n == len(mine) or mine[n][0] < lv) and sum(t for _, t in mine[:n]) >= 0.95 * n]
        thresholds.append(1 / (1 + np.exp(-least[-1] / 64)) if least else 2.0)
    for parts in (1, 5):
        got = train(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts))
        assert (got.model.base, got.model.trees) == (model.base, model.trees)
        assert np.allclose(got.thresholds, thresholds, atol=1e-6)


def test_one_kind_of_fold_or_label_still_fits(spark):
    rows = [(3 * n, "some plain words of a text " * 9) for n in range(60)]
    assert len(train(spark.createDataFrame(rows, "doc_id long, text string")).model.trees) == 24
    assert train(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).model is None
