"""Operators do the whole job: nothing is lost beyond a prefix, a line or a limit."""

from lexiloom.operators import evaluation as E


def test_items_inside_longer_lines_are_hits(spark):
    item, other = "Rivers carry sand to the sea\nwhere waves grind it fine", "Two words"
    docs = spark.createDataFrame([
        (1, f"Some long line before it. {item.upper().replace(chr(10), '  ')} and after it."),
        (2, "rivers carry sand to the sea where waves"), (3, "nothing of it"), (4, "see (two words) here"), (5, None),
    ], "doc_id long, text string")
    items = spark.createDataFrame([(10, item), (11, other), (12, "Nobody has this text with its many words in it")], "query_id long, text string")
    from pyspark.sql import functions as F

    phrases = items.select("query_id", F.array("text").alias("phrases"))
    ranked = E.rank_by_runs(docs, items)
    assert {r.query_id: r.first_hit for r in E.first_hit(ranked, phrases).collect()} == {10: 1, 11: 1, 12: None}
    assert [r.doc_id for r in ranked.where("query_id = 10").orderBy("rank").collect()] == [1, 2]


def test_every_verbatim_item_is_a_first_hit(spark):
    sf = "/root/testdata/sf0.01"
    clean = lambda t: " ".join((t or "").lower().replace("\u00ad", "").split())
    texts = [clean(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {r.item_id for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if any(clean(r.text) in t for t in texts)}
    got = {r.query_id for r in E.q_first_hit(spark, sf).where("first_hit IS NOT NULL").collect()}
    assert got == want and want


def test_edited_added_and_removed_members_change_a_source(spark):
    schema = "item long, source string, lang string, content_hash string, config_hash string"
    same = [(1, "same", "en", "x", "v1"), (2, "same", "en", None, "v1")]
    before = [*same, (3, "edited", "en", "x", "v1"), (4, "added", "en", "x", "v1"), (5, "lost", "en", "x", "v1"), (6, "lost", "en", "y", "v1"), (7, "config", "en", "x", "v1"), (8, "old", "en", "x", "v1")]
    after = [*same, (3, "edited", "en", "z", "v1"), (4, "added", "en", "x", "v1"), (9, "added", "en", "y", "v1"), (5, "lost", "en", "x", "v1"), (7, "config", "en", "x", "v2"), (8, "new", "en", "x", "v1")]
    from lexiloom.operators.changes import unchanged_sources

    got = {r.source: r.unchanged for r in unchanged_sources(spark.createDataFrame(before, schema), spark.createDataFrame(after, schema)).collect()}
    assert got == {"same": True, "edited": False, "added": False, "lost": False, "config": False}


def test_repeated_site_chrome_goes(spark):
    from lexiloom.sources.markup import website_main_content

    page = "<div><p>Read  our Newsletter</p><p>Story {} of its own</p></div>"
    rows = [(i, f"https://a.example/{i}", page.format(i)) for i in range(3)] + [(i, f"https://b.example/{i}", page.format(i)) for i in (3, 4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r.doc_id, r.text.split()[0]): r.reason for r in website_main_content(pages).collect()}
    assert got == {(i, w): "repeated_site_chrome" if w == "Read" and i < 3 else None for i in range(5) for w in ("Read", "Story")}


def test_findings_have_no_limit(spark):
    from lexiloom.operators.sensitive import findings, redact

    text = "a@b.example " * 10_001 + "4111 1111 1111 1111"
    assert len(findings(text)) == 10_002
    got = redact(spark.createDataFrame([(1, text)], "doc_id long, text string"), actions={"payment_card": "drop_document"}).first()
    assert got.dropped and "@" not in got.text and len(got.findings) == 10_002


def test_votes_scripts_hashes_and_error_rates_read_whole_texts(spark):
    from pyspark.sql import functions as F

    from lexiloom.operators.dedup import simhash64
    from lexiloom.operators.gates import language_vote, script_histogram

    late = spark.createDataFrame([(1, "the " * 13_000 + "und der " * 13_000)], "doc_id long, text string")
    assert language_vote(late).first().language == "de"
    mixed = spark.createDataFrame([(1, "a" * 50_000 + "я" * 50_000)], "doc_id long, text string")
    assert script_histogram(mixed).first().mixed and script_histogram(mixed).first().letters == 100_000
    long = spark.createDataFrame([(1, "x " * 100_000), (2, "x " * 100_000 + "y " * 150_000)], "doc_id long, text string")
    assert len({r.simhash for r in simhash64(long).collect()}) == 2
    texts = spark.createDataFrame([(1, "ab\nee" + "f" * 98), (2, "kitten"), (3, "")], "doc_id long, reference string")
    rates = E.error_rate(texts.withColumn("hypothesis", F.expr("CASE doc_id WHEN 2 THEN 'sitting' ELSE replace(reference, 'e', '') END")), by_line=True)
    assert [round(r.error_rate, 6) for r in rates.orderBy("doc_id").collect()] == [round(2 / 102, 6), round(2 / 6, 6), 0.0]


def test_grids_and_cells_are_whole(spark, tmp_path):
    from lexiloom.sources.delimited import q_grid, q_safe

    line = " | ".join(f"a cell of some length {i}" for i in range(15))
    spark.createDataFrame([(1, "\n".join([line] * 25))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = q_grid(spark, str(tmp_path)).collect()
    assert len(rows) == 25 and {(r.width, r.limited) for r in rows} == {(15, False)}
    assert q_safe(spark, str(tmp_path)).first().cell == "'=" + "\n".join([line] * 25)


def test_selection_by_rounds_is_the_greedy_one(spark):
    import inspect
    import random

    from lexiloom.operators import dedup

    rng = random.Random(5)
    sims = [0, 0b111, 0b111111, 0b111111111, -1, 1 << 40]
    rows = [(i, i == 7, rng.randrange(3), i, rng.choice("abcdefgh") + str(i // 30), rng.choice("stuvwxyz") + str(i // 25), "n" + str(rng.randrange(60)), rng.choice(sims) ^ (rng.randrange(9) << 50)) for i in range(150)]
    rows += [(1000 + i, False, 1, 1000 + i, "copy", "copy", "copy", 0b10101 << 20) for i in range(50)]
    schema = "identity long, pinned boolean, connector_rank int, stable_order long, raw_hash string, cleaned_hash string, normalized_hash string, simhash long"
    for threshold in (None, 0.92):
        kept, want = [], {}
        for r in sorted(rows, key=lambda r: (not r[1], r[2], r[3], r[0])):
            exact = [(n, k) for n, o in enumerate(kept) for k in range(3) if o[4 + k] == r[4 + k]]
            close = [(-round(1 - ((r[7] ^ o[7]) & (2**64 - 1)).bit_count() / 64, 6), n) for n, o in enumerate(kept)] if threshold else []
            close = [c for c in close if -c[0] >= threshold]
            if exact:
                want[r[0]] = (kept[min(exact)[0]][0], list(dedup.KEYS.values())[min(exact)[1]], 1.0)
            elif close:
                want[r[0]] = (kept[min(close)[1]][0], "simhash64", -min(close)[0])
            else:
                want[r[0]] = (r[0], "unique", 1.0)
                kept.append(r)
        got = dedup.select_canonical(spark.createDataFrame(rows, schema), threshold).collect()
        assert {r.identity: (r.retained_identity, r.method, r.similarity) for r in got} == want and len(got) == len(rows)
        assert all((r.outcome == "retained") == (r.identity == r.retained_identity) for r in got)
    assert "applyInPandas" not in inspect.getsource(dedup.select_canonical)


def test_blocks_of_a_large_batch_are_handed_on_in_small_frames():
    import pandas as pd

    from lexiloom.sources import markup

    pages = pd.DataFrame({"page_id": range(1000), "html": ["<p>a</p><p>b</p>"] * 1000})
    frames = list(markup._block_frames(iter([pages]), "tables"))
    assert max(map(len, frames)) <= 2 * markup.PAGES and sum(map(len, frames)) == 2000
    assert [*pd.concat(frames)["page_id"]] == [n for n in range(1000) for _ in range(2)]


def test_redacted_texts_of_a_large_batch_are_handed_on_in_small_ones():
    import pyarrow as pa

    from lexiloom.operators import sensitive

    texts = [None if n == 3 else f"{n} mail a@b.com" for n in range(1000)]
    batches = list(sensitive._redacted(iter([pa.RecordBatch.from_pydict({"doc_id": list(range(1000)), "text": texts})]), sensitive.CLASSES, {}))
    rows = [r for b in batches for r in b.to_pylist()]
    assert max(b.num_rows for b in batches) <= sensitive.TEXTS and [r["doc_id"] for r in rows] == list(range(1000))
    assert [r["text"] for r in rows] == ["" if n == 3 else f"{n} mail [EMAIL]" for n in range(1000)]
