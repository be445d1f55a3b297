"""Selection by near matches in batches is the greedy one, and looks at no pairs of rows that are out already."""

import random

import pytest

from lexiloom.operators import dedup

_SCHEMA = "identity long, pinned boolean, connector_rank int, stable_order long, raw_hash string, cleaned_hash string, normalized_hash string, simhash long"


def _signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def _greedy(rows, threshold):
    kept, out = [], {}
    for r in sorted(rows, key=lambda r: (not r[1], r[2], r[3], r[0])):
        exact = [(n, k) for n, o in enumerate(kept) for k in range(3) if o[4 + k] == r[4 + k]]
        close = [(-round(1 - ((r[7] ^ o[7]) & (2**64 - 1)).bit_count() / 64, 6), n) for n, o in enumerate(kept)]
        close = [c for c in close if -c[0] >= threshold]
        if exact:
            out[r[0]] = (kept[min(exact)[0]][0], list(dedup.KEYS.values())[min(exact)[1]], 1.0)
        elif close:
            out[r[0]] = (kept[min(close)[1]][0], "simhash64", -min(close)[0])
        else:
            out[r[0]] = (r[0], "unique", 1.0)
            kept.append(r)
    return out


def test_batches_are_by_rank_and_whole():
    sizes = [(n, 5000) for n in range(20)]
    found = dedup._batches(sizes)
    assert found[0] == (0, 3) and [low for low, _ in found[1:]] == [high + 1 for _, high in found[:-1]] and found[-1][1] == 19
    assert dedup._batches([]) == [] and dedup._batches([(3, 1)]) == [(3, 3)]


@pytest.mark.parametrize("size", [10, 1000])
def test_near_selection_in_batches(spark, monkeypatch, size):
    monkeypatch.setattr(dedup, "BATCH", size)
    monkeypatch.setattr(dedup, "SLICE", 16)
    seen, pairs = [], dedup.near_pairs

    def counted(hashes, threshold):
        found = pairs(hashes, threshold)
        seen.append(found.count())
        return found

    monkeypatch.setattr(dedup, "near_pairs", counted)
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(6)]
    rows = []
    for i in range(240):
        bits = rng.choice(centres)
        for _ in range(rng.randrange(6)):
            bits ^= 1 << rng.randrange(64)
        rows.append((i, i == 7, rng.randrange(3), i, f"r{rng.randrange(200)}", f"c{rng.randrange(220)}", f"n{rng.randrange(230)}", _signed(bits)))
    got = dedup.select_canonical(spark.createDataFrame(rows, _SCHEMA), 0.92).collect()
    assert {r.identity: (r.retained_identity, r.method, r.similarity) for r in got} == _greedy(rows, 0.92) and len(got) == len(rows)
    if size == 10:  # later batches are free of what earlier ones excluded
        assert len(seen) > 1 and sum(seen) < dedup.near_to(spark.createDataFrame(rows, _SCHEMA), spark.createDataFrame(rows, _SCHEMA)).count() / 8


def test_exact_selection_counts_no_bits(spark):
    """Candidates of the exact selection carry no SimHash, so no text is split into tokens for it."""
    assert "simhash" not in dedup._candidates(spark, "/root/testdata/sf0.001").columns
    assert "simhash" in dedup._candidates(spark, "/root/testdata/sf0.001", near=True).columns
