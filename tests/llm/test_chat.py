import random

from lexiloom.llm.chat import BLOCK, collapse_and_render, prefix_hashes

SCHEMA = "conv_id long, turn long, role string, text string, pos string"


def plain(rows):
    """{conv_id: text} of the conversations that no longer or equal earlier one starts with."""
    by_id = {}
    for c, t, r, x, _ in rows:
        if c is not None:
            by_id.setdefault((0, c), []).append((t is not None, t or 0, r or "", x or ""))
        else:  # a conversation of one turn; equal ones are one
            by_id[1, r or "", x or ""] = [(True, 0, r or "", x or "")]
    by_id = {c: [(r, x) for _, _, r, x in sorted(turns)] for c, turns in by_id.items()}
    order = lambda c: c
    kept = {}
    for c, turns in by_id.items():
        def beats(d):
            other = by_id[d]
            return d != c and other[: len(turns)] == turns and (len(other) > len(turns) or order(d) < order(c))

        if not any(map(beats, by_id)):
            kept[c] = "".join(f"<|{r}|>\n{x}<|end|>\n" for r, x in turns)
    return kept


def check(spark, rows):
    got = collapse_and_render(spark.createDataFrame(rows, SCHEMA)).collect()
    want = sorted((str(c[1] if c[0] == 0 else None), t) for c, t in plain(rows).items())
    assert sorted((str(r.conv_id), r.text) for r in got) == want
    assert all(r.n_chars == len(r.text) for r in got)
    return got


def test_random_conversations(spark):
    rng = random.Random(4)
    rows = []
    for c in range(150):
        for t in range(rng.randrange(1, 6)):
            rows.append((c, t, rng.choice(("user", "assistant")), rng.choice("ab"), "x"))
    assert len(check(spark, rows)) < 120


def test_long_conversations_cross_blocks(spark):
    long = [(1, t, "user", f"t{t}", "") for t in range(3 * BLOCK)]
    rows = [*long, *[(2, t, r, x, p) for _, t, r, x, p in long[: 2 * BLOCK + 1]], *[(3, t, r, x, p) for _, t, r, x, p in long], (4, 0, "user", "t0", ""), (4, 1, "user", "other", "")]
    got = check(spark, rows)
    assert sorted(r.conv_id for r in got) == [1, 4]


def test_nulls_ties_and_empty(spark):
    rows = [(1, 0, None, None, ""), (2, 0, "", "", ""), (None, 0, "a", "x", ""), (None, 1, "b", "y", ""), (5, 0, "a", "x", ""), (6, None, "a", "x", ""), (6, 1, "b", "y", ""), (7, 1, "b", "y", ""), (7, 1, "a", "x", ""), (8, 3, "z", "", ""), (None, 5, "q", "alone", ""), (None, None, "q", "alone", "")]
    got = check(spark, rows)
    assert sorted(str(r.conv_id) for r in got) == ["1", "6", "8", "None", "None"]
    assert collapse_and_render(spark.createDataFrame(rows, SCHEMA).limit(0)).count() == 0


def test_role_and_text_do_not_run_together(spark):
    df = spark.createDataFrame([(1, 0, "ab", "c", ""), (2, 0, "a", "bc", "")], SCHEMA)
    assert len({(r.ha, r.hb) for r in prefix_hashes(df).collect()}) == 2


def test_very_long_text(spark):
    long = "word " * 400_000
    got = check(spark, [(1, 0, "user", long, ""), (2, 0, "user", long, ""), (2, 1, "assistant", "ok", "")])
    assert [r.conv_id for r in got] == [2]


def test_many_turns_without_conversation(spark):
    rows = [(None, t, "user", f"text {t % 500}", "") for t in range(3000)] + [(1, 0, "user", "text 7", ""), (1, 1, "user", "more", "")]
    assert len(check(spark, rows)) == 500
