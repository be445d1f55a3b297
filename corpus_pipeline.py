"""A training-data pipeline over ``documents``: filter, deduplicate, decontaminate, redact, tokenize.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
``documents``. A stage sees every row that the one before it kept. Every stage takes an empty table
(and returns one), nulls in any column, and texts of any length; it reads doc_id and text only (the first
one labels too), so other columns and their names do not matter.
"""

from __future__ import annotations

from lexiloom.llm import bpe, decontaminate, pii, quality, simhash, sketches
from lexiloom.session import materialize, table


def filter_quality(spark, docs, sf_dir):
    """Drops documents that the line-level conditional random field rejects.

    Null and empty texts, and those of white space only, score 0 and go. Repeated rows fare alike; a null
    doc_id is no reason to go. Without labels of both kinds every text scores 0.5 and stays.
    """
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark, docs, sf_dir):
    """Keeps the document with the smallest id of every near-duplicate group.

    Groups are those of SimHash fingerprints within three bits; what is left is joined by sketches, at a
    similarity of 0.8 or more of five-word shingles, which finds edited copies beyond SimHash's reach.

    Texts without words (null ones too) are one group. Of repeated rows of one id the smallest text
    stays; a row without an id stays if nothing in its group has one.
    """
    return sketches.one_of_each_group(materialize(simhash.one_of_each_group(docs), "simhash-kept"))


def drop_benchmark_leaks(spark, docs, sf_dir):
    """Drops documents that hold a benchmark item.

    Null and empty texts hold none and stay; of repeated rows all stay or go; null and empty items are
    held by none, and an empty benchmark drops nothing.
    """
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark, docs, sf_dir):
    """Replaces personal data in the texts and sets n_chars anew.

    Null texts stay null (n_chars too), empty ones empty; repeated rows are redacted alike; no row goes.
    """
    return pii.redact(docs, pii.train(docs))


def tokenize(spark, docs, sf_dir):
    """Encodes every text and decodes it again: doc_id, n_tokens, ids, decoded.

    A null text has no tokens and an empty decoding, like an empty one; every row gives a row.
    """
    return bpe.encode_and_decode(docs)


STAGES = [
    ("quality", filter_quality),
    ("near_dedup", near_dedup),
    ("decontamination", drop_benchmark_leaks),
    ("pii", redact_personal_data),
    ("bpe", tokenize),
]

#: No stage before the last can be expressed in SQL; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Applies all stages to ``documents``, each written and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
