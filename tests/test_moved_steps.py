"""Steps that were moved to where the document is: texts are shuffled by none of them."""

import contextlib
import io

from lexiloom.operators import blocks, chunks, gates

_SF = "/root/testdata/sf0.001"


def _plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_audit_joins_and_shuffles_no_texts(spark):
    plan = _plan(blocks.q_audit_changes(spark, _SF))
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_margins_need_no_window(spark):
    assert "Window" not in _plan(blocks.q_margins(spark, _SF))


def test_language_policy_joins_ids_and_languages_only(spark):
    plan = _plan(gates.q_language_policy(spark, _SF))
    assert "collect_list" not in plan and plan.count("Join") == 1
    found = gates.with_mixed(gates.language_vote(spark.createDataFrame([(1, "the\n" * 10 + "und der"), (2, "the"), (3, None), (4, "aaa яяя")], "doc_id long, text string")))
    assert {r.doc_id: r.mixed for r in found.collect()} == {1: True, 2: False, 3: False, 4: True}


def test_chunks_are_made_once_and_only_as_asked(spark):
    assert "MapInArrow" not in _plan(chunks.q_parent_text(spark, _SF))  # a table that was written once
    docs = chunks.with_blocks(spark.read.parquet(f"{_SF}/documents.parquet"))
    whole, some = chunks.parent_child_chunks(docs), chunks.parent_child_chunks(docs, columns=("doc_id", "ordinal", "text"))
    assert some.columns == ["doc_id", "ordinal", "text"]
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, whole.select("doc_id", "ordinal", "text").collect()))


def test_few_documents_are_taken_up_together(spark):
    """A batch of many documents is taken up in slices, and none is lost between them."""
    docs = spark.range(1000).coalesce(1).selectExpr("id AS doc_id", "'Head\\nA line of text that is its own' AS text")
    found = chunks.parent_child_chunks(chunks.with_blocks(docs), columns=("doc_id", "role", "text"))
    assert found.where("role = 'child'").count() == 1000 and chunks.TAKEN <= 128
