import random

import pytest

from lexiloom.operators.batching import sequential_batches


def fold(sizes, rows, size):
    out, n, used = [], 0, 0
    for i, b in enumerate(sizes):
        if n and n < rows and used + b <= size:
            n, used = n + 1, used + b
        else:
            n, used, start = 1, b, i
        out.append(start)
    return out


@pytest.mark.parametrize("segment", [5, 8, 64, 4096])
def test_batches_equal_a_fold_over_all_rows(spark, segment):
    rng = random.Random(segment)
    sizes = [rng.choice((0, 1, 7, 30, 99, 150, 101, None)) for _ in range(333)]
    rows = [(i * 3, b, "x") for i, b in enumerate(sizes)]
    df = spark.createDataFrame(rows, "chunk_id long, bytes long, batch string").repartition(6)
    got = {r.chunk_id: r.batch for r in sequential_batches(df, 5, 100, segment).collect()}
    assert [got[i * 3] for i in range(len(sizes))] == fold([b or 0 for b in sizes], 5, 100)


def test_edges(spark):
    df = spark.createDataFrame([(None, 60), (1, 60), (2, 10), (2, 10), (3, 500)], "chunk_id long, bytes long")
    assert sorted((str(r.chunk_id), r.batch) for r in sequential_batches(df, 3, 100).collect()) == [("1", 1), ("2", 1), ("2", 1), ("3", 4), ("None", 0)]
    assert sequential_batches(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sequential_batches(df, 64, segment=10)
