import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lexiloom.operators import blocks as B
from lexiloom.operators import gates as G


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, ordinal long, type string, text string")


def texts(df):
    return [r.text for r in df.orderBy("doc_id", "ordinal").collect()]


def test_unicode_controls_reflow_and_hyphens(spark):
    df = frame(spark, [(1, 0, "paragraph", "é ﬁ"), (1, 1, "paragraph", "a­b‍c࢐d\ne"), (1, 2, "paragraph", "one\ntwo\n\nthree-\nfour \nfive")])
    assert texts(B.normalize_unicode(df))[0] == "é ﬁ" and texts(B.normalize_unicode(df, "NFKC"))[0] == "é fi"
    assert texts(B.remove_controls(df))[1] == "ab‍cd\ne"
    assert texts(B.reflow(df))[2] == "one two\n\nthree-\nfour \nfive"
    assert texts(B.dehyphenate(df))[2] == "one\ntwo\n\nthreefour \nfive"
    known = frame(spark, [(1, 0, "paragraph", "a well-known thing"), (1, 1, "paragraph", "it is well-\nknown and Some-\nthing, three-\nfour"), (2, 0, "paragraph", "well-\nknown")])
    got = texts(B.dehyphenate_compounds(known))
    assert got[1] == "it is well-known and Something, threefour" and got[2] == "wellknown"


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=12), min_size=1, max_size=12))
def test_nfc_equals_the_standard_library(spark, values):
    values = [v.encode("utf-8", "ignore").decode() for v in values]
    df = frame(spark, [(1, i, "paragraph", v) for i, v in enumerate(values)])
    assert texts(B.normalize_unicode(df)) == [unicodedata.normalize("NFC", v) for v in values]


def test_empty_duplicate_and_protected_blocks(spark):
    df = frame(spark, [(1, 0, "paragraph", " "), (1, 1, "table", " "), (1, 2, "paragraph", "x"), (1, 3, "paragraph", "x"), (1, 4, "code", "x"), (2, 0, "paragraph", "x")])
    kept = B.remove_empty(df)
    assert [(r.doc_id, r.ordinal) for r in kept.orderBy("doc_id", "ordinal").collect()] == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 0)]
    single = B.dedupe(kept)
    assert [(r.doc_id, r.ordinal) for r in single.orderBy("doc_id", "ordinal").collect()] == [(1, 1), (1, 2), (1, 4), (2, 0)]
    assert [r.ordinal for r in B.renumber(single).orderBy("doc_id", "ordinal").collect()] == [0, 1, 2, 0]
    status = {(r.doc_id, r.ordinal): r.status for r in B.cleaning_diff(df, single).collect()}
    assert status[1, 0] == "removed" and status[1, 3] == "removed" and status[1, 2] == "unchanged"


def test_margins_and_owner(spark):
    rows = [("s", p, o, "paragraph", t, m) for p in range(4) for o, t, m in ((0, "Header  X", True), (1, f"body {p}", False), (2, f"page {p}", True))]
    df = spark.createDataFrame([*rows, ("s", 4, 0, "footnote", "header x", True)], "source string, doc_id long, ordinal long, type string, text string, at_margin boolean")
    left = B.remove_margins(df, "source", "doc_id")
    assert {r.text for r in left.collect()} == {f"body {p}" for p in range(4)} | {f"page {p}" for p in range(4)} | {"header x"}
    assert B.chrome_owners(df, "source", "doc_id").first().owner == 0
    assert B.remove_margins(df.where("doc_id < 2"), "source", "doc_id").count() == 6


def test_main_content_precedence(spark):
    rows = [(1, True, None, [], False), (1, False, "navigation", ["cookie"], True), (2, False, "banner", ["cookie"], True), (2, False, None, [".cookie-bar"], True), (2, False, None, [], True), (2, None, None, [], False)]
    df = spark.createDataFrame(rows, "doc_id long, html_main boolean, html_role string, html_selectors array<string>, repeated boolean")
    got = sorted((r.doc_id, r.reason or "") for r in B.main_content(df).collect())
    assert got == sorted([(1, ""), (1, "outside_main_content"), (2, "semantic_site_chrome"), (2, "cookie_or_consent_banner"), (2, "repeated_site_chrome"), (2, "")])


def test_quality_policies(spark):
    row = {"doc_id": 1, "character_count": 100, "block_count": 3, "page_count": 4, "empty_block_count": 0, "empty_page_count": 1, "replacement_character_ratio": 0.005, "control_character_ratio": 0.0, "repeated_line_ratio": 0.0, "ocr_confidence_p05": 60.0}
    got = {p: G.evaluate(spark.createDataFrame([row]), p).first() for p in G.POLICIES}
    assert got["default-v1"].decision == "fail" and "error:empty_pages" in got["default-v1"].findings and "warning:ocr_confidence_bounded" in got["default-v1"].findings
    assert got["strict-v1"].findings == ["error:empty_pages", "error:replacement_character_ratio_high", "error:ocr_confidence_low"]
    assert got["warn-v1"].decision == "warn"
    nothing = G.evaluate(spark.createDataFrame([row | {"character_count": 0, "block_count": 0}])).first()
    assert nothing.decision == "exclude" and nothing.findings[0] == "error:no_extractable_text"


def test_languages(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog"), (2, "la la de de en"), (3, "123 !"), (4, "привет мир"), (5, "漢字かな abc"), (6, "für und für")], "doc_id long, text string")
    vote = {r.doc_id: (r.language, r.confidence) for r in G.language_vote(docs).collect()}
    assert vote[1] == ("en", 0.85) and vote[2][0] == "fr" and vote[3] == ("und", 0.4) and vote[6][0] == "de"
    scripts = {r.doc_id: (r.script, r.mixed) for r in G.script_histogram(docs).collect()}
    assert scripts[4] == ("ru", False) and scripts[5][1] and scripts[3] == ("und", False)
