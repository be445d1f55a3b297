from test_pii import plain_spans
from test_simhash import plain_components, plain_simhash
from test_sketches import plain

import corpus_pipeline
from lexiloom.llm import quality
from lexiloom.llm.bpe import Codec, load, vocabulary_path
from lexiloom.llm.decontaminate import normalized
from lexiloom.session import table


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    items = [" ".join(normalized(r.text).decode().split()) for r in table(spark, sf, "benchmark").collect()]
    scored = quality.score(docs, quality.train(docs, table(spark, sf, "labels"))).collect()
    good = {r.doc_id for r in scored if r.predicted}
    component = plain_components([(d, plain_simhash(rows[d].text)) for d in sorted(good)], 3)
    single = sorted(d for d in good if component[d] == d)
    words = {d: plain(rows[d].text) for d in single}
    parent = {d: d for d in single}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(single):
        for b in single[i + 1 :]:
            n, m = sorted((len(words[a]), len(words[b])))
            if n and n >= 0.8 * m and len(words[a] & words[b]) >= 0.8 * len(words[a] | words[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    single = {d for d in single if root(d) == d}
    clean = {d for d in single if not any(i in " ".join(normalized(rows[d].text).decode().split()) for i in items)}
    assert len(rows) > len(good) > len(single) > len(clean)

    got = docs
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], (good, single, clean, clean), strict=True):
        got = stage(spark, got, sf)
        assert got.columns == columns
        kept = got.collect()
        assert sorted(r.doc_id for r in kept) == sorted(want), name
        got = spark.createDataFrame(kept, docs.schema)
    texts = {r.doc_id: r.text for r in kept}
    for d in clean:
        base = plain_spans(rows[d].text)
        assert all(rows[d].text[s:e] not in texts[d] for s, _, e in base)
        assert base or "[" in texts[d] or texts[d] == rows[d].text
    codec = Codec(load(vocabulary_path()))
    final = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r.doc_id for r in final) == sorted(clean)
    assert all(list(r.ids) == codec.encode(texts[r.doc_id]) and r.decoded == codec.decode(r.ids) for r in final)


def test_edge_rows(spark):
    text = "Some ordinary sentence with words, and then another one that ends here. " * 3
    rows = [(3, text, "en", "s", 1), (3, text, "en", "s", 1), (5, text, "en", "s", 1), (None, text, None, None, None), (None, "alone one two", None, None, None), (9, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted((str(r.doc_id), r.text) for r in kept if r.text) == [("3", text), ("None", "alone one two")]
    assert [r.doc_id for r in kept if r.text is None] == [9]
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0
    assert corpus_pipeline.redact_personal_data(spark, docs, "").count() == 6


def test_edge_rows_of_the_other_stages(spark):
    sf = "/root/testdata/sf0.001"
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    good = table(spark, sf, "documents").where("doc_id < 40").collect()
    long = "Some words of a long text that goes on and on. " * 20_000
    rows = [*[(r.doc_id, r.text, None, None, None) for r in good], (None, good[0].text, None, None, None), (None, None, "en", "s", None), (7000, "", "", "", 0), (7000, "", "", "", 0), (7001, long, None, "s", None)]
    docs = spark.createDataFrame(rows, schema)
    # Nulls and empty texts are rejected by quality, which keeps everything of the rows it keeps.
    kept = corpus_pipeline.filter_quality(spark, docs, sf)
    assert kept.columns == docs.columns and kept.where("text IS NULL OR text = ''").count() == 0
    for stage in (corpus_pipeline.filter_quality, corpus_pipeline.drop_benchmark_leaks, corpus_pipeline.redact_personal_data):
        assert stage(spark, docs.limit(0), sf).count() == 0
    leaked = spark.createDataFrame([*[tuple(r) for r in docs.limit(3).collect()], (8000, "x " + table(spark, sf, "benchmark").first().text, None, None, None), (None, None, None, None, None), (8001, "", None, None, None)], schema)
    left = corpus_pipeline.drop_benchmark_leaks(spark, leaked, sf).collect()
    assert 8000 not in {r.doc_id for r in left} and {(r.doc_id, r.text) for r in left} >= {(None, None), (8001, "")}
    tokens = corpus_pipeline.tokenize(spark, docs, sf).collect()
    assert len(tokens) == len(rows) and sorted(r.n_tokens for r in tokens)[:3] == [0, 0, 0]
    assert corpus_pipeline.tokenize(spark, docs.limit(0), sf).count() == 0
