"""Experiment aggregation, paired comparison, hit ranks and win/loss counts."""

from __future__ import annotations

from collections import Counter
from itertools import zip_longest

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.session import table

#: Words of the runs by which documents become candidates of an item.
RUN = 5


def precondition(items: DataFrame) -> DataFrame:
    """Why a metric cannot be scored, first reason first; null where it can."""
    reason = (
        F.when(F.col("status") == "failed", "generation_failed")
        .when(F.col("status") == "pending", "pending")
        .when(F.col("needs_reference") & F.coalesce(F.trim("reference") == "", F.lit(True)), "missing_reference")
        .when(F.coalesce(F.trim("answer") == "", F.lit(True)), "empty_answer")
    )
    return items.withColumn("reason", reason)


def summary(items: DataFrame) -> DataFrame:
    """Per candidate and metric: totals, states, the mean of succeeded scores."""
    done = F.col("status") == "succeeded"
    return items.groupBy("candidate", "metric").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(done).alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"), F.round(F.avg(F.when(done, F.col("value"))), 6).alias("mean"),
    )


def known_sums(items: DataFrame, *columns: str) -> DataFrame:
    """Known sum, known count and total of each column; a sum without known values is null."""
    out = [F.count(F.lit(1)).alias("total")]
    for c in columns:
        out += [F.round(F.sum(c), 6).alias(f"{c}_sum"), F.count(c).alias(f"{c}_known")]
    return items.groupBy("candidate").agg(*out)


def all_known_sum(column):
    """The sum, or null if one value is unknown."""
    return F.when(F.count(column) == F.count(F.lit(1)), F.sum(column))


def paired(items: DataFrame) -> DataFrame:
    """Means of both candidates and of their difference, on ordinals where both succeeded."""
    ok = items.where("status = 'succeeded'")
    a = ok.where("candidate = 'a'").select("metric", "ordinal", F.col("value").alias("va"))
    b = ok.where("candidate = 'b'").select("metric", "ordinal", F.col("value").alias("vb"))
    return a.join(b, ["metric", "ordinal"]).groupBy("metric").agg(
        F.count(F.lit(1)).alias("pairs"), F.round(F.avg("va"), 6).alias("mean_a"), F.round(F.avg("vb"), 6).alias("mean_b"), F.round(F.avg(F.col("vb") - F.col("va")), 6).alias("mean_difference")
    )


def _clean(text):
    return F.replace(F.regexp_replace(F.lower(text), r"\s+", " "), F.lit("­"), F.lit(""))


def first_hit(ranked: DataFrame, phrases: DataFrame, top: int = 5) -> DataFrame:
    """Rank of the first text that holds all phrases of its question, within the top ranks."""
    hit = ranked.where(F.col("rank") <= top).join(phrases.withColumnRenamed("query_id", "p_q"), F.col("query_id") == F.col("p_q"))
    hit = hit.withColumn("t", _clean(F.col("text"))).where(F.forall("phrases", lambda p: F.col("t").contains(_clean(p))))
    found = hit.groupBy(F.col("query_id").alias("f_q")).agg(F.min("rank").alias("first_hit"))
    return phrases.join(found, F.col("query_id") == F.col("f_q"), "left").select("query_id", "first_hit")


def hit_summary(hits: DataFrame) -> DataFrame:
    one = F.when(F.col("first_hit") == 1, 1).otherwise(0)
    return hits.agg(
        F.count(F.lit(1)).alias("questions"), F.sum(one).alias("hit_at_1"), F.count("first_hit").alias("hit_at_5"),
        F.round(F.avg(F.coalesce(1 / F.col("first_hit"), F.lit(0.0))), 6).alias("mrr"),
    )


def fact_present(text, groups):
    """Every group of alternatives has one that the text holds."""
    low = F.lower(text)
    return F.forall(groups, lambda g: F.exists(g, lambda o: low.contains(F.lower(o))))


def outcome(a, b):
    return F.when(a > b, "win").when(a < b, "loss").when(a == b, "tie")


def decide(wins, losses, least: int = 5):
    """adopt, reject or keep from win and loss counts."""
    return F.when(wins - losses >= least, "adopt").when(losses - wins >= least, "reject").otherwise("keep")


def _edits(reference: str, hypothesis: str) -> int:
    """Fewest edits of ``reference`` into any part of ``hypothesis``.

    A column of the table is two integers whose bits tell where it rises and falls from one character of the
    reference to the next; a character of the hypothesis turns a column into the next by a few operations on
    whole integers. Memory follows the reference's length alone. The first row stays zero and the least
    value of the last row counts, so both ends of the hypothesis are free.

    No table is needed where bounds meet: each character of the hypothesis matches one of the reference at most and
    every other one of the reference is an edit, so a hypothesis that leaves characters of the reference out, and
    no more, takes as many edits. For the same reason the scan ends once the characters that the hypothesis lacks
    are the only edits.
    """
    size = least = now = len(reference)
    if reference in hypothesis:
        return 0
    if len(hypothesis) < size:
        rest = iter(reference)
        if all(c in rest for c in hypothesis):
            return size - len(hypothesis)
    bound = (Counter(reference) - Counter(hypothesis)).total()
    places: dict[str, int] = {}
    for n, c in enumerate(dict.fromkeys(reference)):
        if n > 256:
            break
        places[c] = int("".join("1" if x == c else "0" for x in reversed(reference)) or "0", 2)
    rare = set(reference) - set(places)
    if rare:  # many kinds of characters: their bits are set one by one
        for n, x in enumerate(reference):
            if x in rare:
                places[x] = places.get(x, 0) | 1 << n
    every, last = (1 << size) - 1, 1 << max(0, size - 1)
    rises, falls = every, 0
    for c in hypothesis:
        same = places.get(c, 0)
        diagonal = (((same & rises) + rises) ^ rises) | same
        up, down = falls | (every & ~(diagonal | rises)), rises & diagonal
        now += bool(up & last) - bool(down & last)
        least = min(least, now)
        if least == bound:
            break
        up, down, level = up << 1 & every, down << 1 & every, same | falls
        rises, falls = down | (every & ~(level | up)), up & level
    return least


def error_rate(df: DataFrame, by_line: bool = False) -> DataFrame:
    """Character error rate of ``hypothesis`` against ``reference``; leading and trailing extra text is free.

    ``by_line`` aligns the n-th lines of both with each other, so that the cost is quadratic in lines only.
    """

    @F.pandas_udf("double")
    def run(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
        out = []
        for r, h in zip(reference.fillna(""), hypothesis.fillna(""), strict=True):
            pairs = list(zip_longest(r.split("\n"), h.split("\n"), fillvalue="")) if by_line else [(r, h)]
            size = sum(len(x) for x, _ in pairs)
            out.append(sum(_edits(x, y) for x, y in pairs if x) / size if size else 0.0)
        return pd.Series(out)

    return df.withColumn("error_rate", run("reference", "hypothesis"))


def blind_assignment(df: DataFrame, seed: int = 7):
    """Which of two answers is shown first, by a hash of the question and the seed."""
    return df.withColumn("first", F.when(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("query_id").cast("string")), 256), 1, 1) < "8", "a").otherwise("b"))


def _items(spark, sf):
    """Labels as two metrics of two candidates: even and odd sources; the pair of a document is its neighbour."""
    labels, docs = table(spark, sf, "labels"), table(spark, sf, "documents").select(F.col("doc_id").alias("d"), "n_chars", "lang")
    rows = labels.join(docs, F.col("doc_id") == F.col("d"))
    status = F.when(F.col("n_chars") < 400, "failed").when(F.col("n_chars") > 8000, "skipped").otherwise("succeeded")
    base = rows.select(
        F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("candidate"), F.floor(F.col("doc_id") / 2).alias("ordinal"), status.alias("status"),
        F.when(F.col("lang") != "fr", F.col("n_chars") / 1000.0).alias("cost"), "n_chars", "quality", "toxic",
    )
    return base.select("*", F.expr("stack(2, 'quality', cast(quality AS double), 'toxic', cast(toxic AS double)) AS (metric, value)"))


def q_precondition(spark, sf):
    docs = table(spark, sf, "documents")
    items = docs.select("doc_id", F.col("text").alias("answer"), F.when(F.col("lang") != "de", F.col("source")).alias("reference"), (F.col("doc_id") % 2 == 0).alias("needs_reference"),
                        F.when(F.col("n_chars") < 300, "failed").when(F.col("n_chars") > 9000, "pending").otherwise("succeeded").alias("status"))
    return precondition(items).groupBy(F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def q_summary(spark, sf):
    return summary(_items(spark, sf))


def q_known(spark, sf):
    return known_sums(_items(spark, sf).where("metric = 'quality'"), "cost", "n_chars")


def q_all_known(spark, sf):
    return _items(spark, sf).where("metric = 'quality'").groupBy("candidate", "status").agg(F.round(all_known_sum(F.col("cost")), 6).alias("cost"))


def q_paired(spark, sf):
    return paired(_items(spark, sf))


def _run_hashes(words, first, last):
    """Hashes of the distinct runs of ``RUN`` words from place ``first`` to place ``last``, counted from 0."""
    starts = F.when(last - first >= RUN - 1, F.sequence(first, last - (RUN - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(RUN)])))


#: Items of one or two words that are searched in every text at a time.
SHORT_ITEMS = 1000


def rank_by_runs(docs: DataFrame, items: DataFrame, top: int = 5) -> DataFrame:
    """The ``top`` documents of each item (query_id, text) by shared word runs, then by length and doc_id.

    A text that holds the item whole shares all runs of its inner words (the outer ones may end
    within longer words), so it ranks before texts that hold fewer. Runs are equi-joined by hash;
    only items of too few words are searched in every text.
    """
    from pyspark.sql import Window

    texts = docs.select("doc_id", F.length("text").alias("n"), F.split(_clean(F.col("text")), " ").alias("w"))
    runs = texts.select("doc_id", "n", F.explode(_run_hashes(F.col("w"), F.lit(0), F.size("w") - 1)).alias("run"))
    asked = items.select("query_id", _clean(F.col("text")).alias("phrase")).withColumn("w", F.split("phrase", " "))
    inner = asked.select("query_id", F.explode(_run_hashes(F.col("w"), F.lit(1), F.size("w") - 2)).alias("run"))
    shared = runs.join(inner, "run").groupBy("query_id", "doc_id", "n").agg(F.count(F.lit(1)).alias("shared"))
    plain = docs.select("doc_id", F.length("text").alias("n"), _clean(F.col("text")).alias("t"))
    one = lambda rows: rows.select("query_id", "doc_id", "n", F.lit(1).cast("long").alias("shared"))
    # Items of three or four words: their second word stands whole in every text that holds them.
    short = asked.where((F.size("w") > 2) & (F.size("w") < RUN + 2)).select("query_id", "phrase", F.element_at("w", 2).alias("word"))
    meets = plain.withColumn("word", F.explode(F.array_distinct(F.split("t", " ")))).join(short, "word").where(F.col("t").contains(F.col("phrase")))
    # Items of one or two words may lie within words: they are searched in every text, a block at a time.
    least = asked.where(F.size("w") <= 2).select("query_id", "phrase")
    shared = shared.unionByName(one(meets))
    blocks = -(-least.count() // SHORT_ITEMS)
    for nth in range(blocks):
        block = F.broadcast(least.where(F.pmod(F.xxhash64("query_id", "phrase"), F.lit(blocks)) == nth))  # about SHORT_ITEMS short phrases
        shared = shared.unionByName(one(plain.join(block, F.col("t").contains(F.col("phrase")))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("shared"), "n", "doc_id"))
    best = shared.withColumn("rank", rank).where(F.col("rank") <= top)
    return best.withColumnRenamed("doc_id", "b_id").join(docs, F.col("b_id").eqNullSafe(F.col("doc_id"))).select("query_id", "doc_id", "text", "rank")


def _hits(spark, sf):
    """Documents ranked for each benchmark item by the word runs they share, and the item as its phrase."""
    docs, items = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return rank_by_runs(docs, items), items.select("query_id", F.array("text").alias("phrases"))


def q_first_hit(spark, sf):
    return first_hit(*_hits(spark, sf))


def q_hit_summary(spark, sf):
    return hit_summary(first_hit(*_hits(spark, sf)))


def q_facts(spark, sf):
    groups = F.array(F.array(F.lit("the"), F.lit("der"), F.lit("que")), F.array(F.lit("and "), F.lit("und "), F.lit(" et "), F.lit(" y ")))
    return table(spark, sf, "documents").select("doc_id", fact_present(F.col("text"), groups).alias("present"))


def q_win_loss(spark, sf):
    """Neighbouring documents compared by length, by language of the first."""
    docs = table(spark, sf, "documents")
    a = docs.where("doc_id % 2 = 0").select(F.floor(F.col("doc_id") / 2).alias("pair"), "lang", F.col("n_chars").alias("na"))
    b = docs.where("doc_id % 2 = 1").select(F.floor(F.col("doc_id") / 2).alias("pair"), F.col("n_chars").alias("nb"))
    counts = a.join(b, "pair").groupBy("lang").agg(*[F.count_if(outcome(F.col("na"), F.col("nb")) == o).alias(n) for o, n in (("win", "wins"), ("loss", "losses"), ("tie", "ties"))])
    return counts.withColumn("net", F.col("wins") - F.col("losses")).withColumn("decision", decide(F.col("wins"), F.col("losses")))


def q_lost_gained(spark, sf):
    """Benchmark items found whole by one method (full text) and not by another (first 200 characters)."""
    ranked, phrases = _hits(spark, sf)
    whole = first_hit(ranked, phrases).where("first_hit IS NOT NULL").select("query_id")
    short = first_hit(ranked.withColumn("text", F.substring("text", 1, 200)), phrases).where("first_hit IS NOT NULL").select("query_id")
    return whole.exceptAll(short).select("query_id", F.lit("lost").alias("change")).unionByName(short.exceptAll(whole).select("query_id", F.lit("gained").alias("change")))


def q_error_rate(spark, sf):
    """Each text against itself with every e dropped, line by line."""
    rows = table(spark, sf, "documents").select("doc_id", F.col("text").alias("reference"), F.replace("text", F.lit("e"), F.lit("")).alias("hypothesis"))
    return error_rate(rows, by_line=True).select("doc_id", F.round("error_rate", 6).alias("error_rate"))


def q_blind(spark, sf):
    return blind_assignment(table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id")))


def q_progress(spark, sf):
    """State of each candidate's run from its items: done once none is pending, failed if all failed."""
    counts = summary(_items(spark, sf)).groupBy("candidate").agg(F.sum("total").alias("total"), F.sum("failed").alias("failed"), F.sum("succeeded").alias("succeeded"))
    state = F.when(F.col("failed") == F.col("total"), "failed").when(F.col("failed") > 0, "completed_with_failures").otherwise("completed")
    return counts.withColumn("state", state)


_ITEMS = """(WITH b AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS candidate, doc_id // 2 AS ordinal, CASE WHEN n_chars < 400 THEN 'failed' WHEN n_chars > 8000 THEN 'skipped' ELSE 'succeeded' END AS status,
  CASE WHEN lang <> 'fr' THEN n_chars / 1000.0::DOUBLE END AS cost, n_chars, quality, toxic FROM labels JOIN documents USING (doc_id))
  SELECT *, 'quality' AS metric, quality::DOUBLE AS value FROM b UNION ALL SELECT *, 'toxic', toxic::DOUBLE FROM b)"""
_CLEAN = "replace(regexp_replace(lower({}), '\\s+', ' ', 'g'), chr(173), '')"
_WORDS = f"string_split({_CLEAN.format('text')}, ' ')"
_RUNS = "list_distinct(list_transform(range({first}, len(w) - {last}), lambda i: array_to_string(w[i + 1:i + 5], ' ')))"
#: The five documents of each item that share most runs of five words; items of under seven words are searched whole.
_FOUND = f"""(WITH d AS (SELECT doc_id, text, length(text) AS n, {_WORDS} AS w FROM documents), i AS (SELECT item_id, text, {_WORDS} AS w FROM benchmark),
  dr AS (SELECT doc_id, n, unnest({_RUNS.format(first=0, last=4)}) AS run FROM d), ir AS (SELECT item_id, unnest({_RUNS.format(first=1, last=5)}) AS run FROM i),
  s AS (SELECT item_id, doc_id, n, count(*) AS shared FROM dr JOIN ir USING (run) GROUP BY 1, 2, 3
    UNION ALL SELECT item_id, doc_id, n, 1 FROM i JOIN d ON contains({_CLEAN.format('d.text')}, {_CLEAN.format('i.text')}) WHERE len(i.w) < 7)
  SELECT s.item_id AS query_id, i.text AS phrase, d.text, row_number() OVER (PARTITION BY s.item_id ORDER BY shared DESC, s.n, s.doc_id) AS rank
  FROM s JOIN i USING (item_id) JOIN d USING (doc_id))"""
_FIRST = f"""(SELECT item_id AS query_id, min(rank) FILTER (rank <= 5 AND contains({_CLEAN.format('f.text')}, {_CLEAN.format('phrase')})) AS first_hit FROM benchmark LEFT JOIN {_FOUND} f ON f.query_id = item_id GROUP BY 1)"""

QUERIES = {
    "metric_preconditions": (
        q_precondition,
        """SELECT CASE WHEN n_chars < 300 THEN 'generation_failed' WHEN n_chars > 9000 THEN 'pending' WHEN doc_id % 2 = 0 AND lang = 'de' THEN 'missing_reference' WHEN trim(text) = '' THEN 'empty_answer' ELSE 'none' END AS reason, count(*) AS n FROM documents GROUP BY 1""",
    ),
    "experiment_summary": (q_summary, f"SELECT candidate, metric, count(*) AS total, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, round(avg(value) FILTER (status = 'succeeded'), 6) AS mean FROM {_ITEMS} GROUP BY 1, 2"),
    "known_cost_sums": (q_known, f"SELECT candidate, count(*) AS total, round(sum(cost), 6) AS cost_sum, count(cost) AS cost_known, CAST(round(sum(n_chars)) AS BIGINT) AS n_chars_sum, count(n_chars) AS n_chars_known FROM {_ITEMS} WHERE metric = 'quality' GROUP BY 1"),
    "all_known_cost": (q_all_known, f"SELECT candidate, status, CASE WHEN count(cost) = count(*) THEN round(sum(cost), 6) END AS cost FROM {_ITEMS} WHERE metric = 'quality' GROUP BY 1, 2"),
    "paired_difference": (q_paired, f"SELECT metric, count(*) AS pairs, round(avg(a.value), 6) AS mean_a, round(avg(b.value), 6) AS mean_b, round(avg(b.value - a.value), 6) AS mean_difference FROM {_ITEMS} a JOIN {_ITEMS} b USING (metric, ordinal) WHERE a.candidate = 'a' AND b.candidate = 'b' AND a.status = 'succeeded' AND b.status = 'succeeded' GROUP BY 1"),
    "benchmark_first_hit": (q_first_hit, f"SELECT * FROM {_FIRST}"),
    "hit_at_k_mrr": (q_hit_summary, f"SELECT count(*) AS questions, CAST(count(*) FILTER (first_hit = 1) AS BIGINT) AS hit_at_1, count(first_hit) AS hit_at_5, round(avg(coalesce(1 / first_hit, 0)), 6) AS mrr FROM {_FIRST}"),
    "fact_groups_present": (q_facts, "SELECT doc_id, (contains(t, 'the') OR contains(t, 'der') OR contains(t, 'que')) AND (contains(t, 'and ') OR contains(t, 'und ') OR contains(t, ' et ') OR contains(t, ' y ')) AS present FROM (SELECT doc_id, lower(text) AS t FROM documents)"),
    "win_loss_tie": (
        q_win_loss,
        """SELECT lang, wins, losses, ties, wins - losses AS net, CASE WHEN wins - losses >= 5 THEN 'adopt' WHEN losses - wins >= 5 THEN 'reject' ELSE 'keep' END AS decision FROM
        (SELECT a.lang, count(*) FILTER (a.n_chars > b.n_chars) AS wins, count(*) FILTER (a.n_chars < b.n_chars) AS losses, count(*) FILTER (a.n_chars = b.n_chars) AS ties FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 2 = 0 GROUP BY 1)""",
    ),
    "lost_and_gained_questions": (
        q_lost_gained,
        f"""WITH w AS (SELECT query_id FROM {_FIRST} WHERE first_hit IS NOT NULL), s AS (SELECT DISTINCT query_id FROM {_FOUND} f WHERE rank <= 5 AND contains({_CLEAN.format('left(f.text, 200)')}, {_CLEAN.format('phrase')}))
        SELECT query_id, 'lost' AS change FROM w WHERE query_id NOT IN (SELECT query_id FROM s) UNION ALL SELECT query_id, 'gained' FROM s WHERE query_id NOT IN (SELECT query_id FROM w)""",
    ),
    "character_error_rate": (q_error_rate, None),
    "blind_assignment": (q_blind, "SELECT item_id AS query_id, CASE WHEN left(sha256('7|' || item_id), 1) < '8' THEN 'a' ELSE 'b' END AS first FROM benchmark"),
    "experiment_progress": (q_progress, f"SELECT candidate, CAST(count(*) AS BIGINT) AS total, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'succeeded') AS succeeded, CASE WHEN count(*) FILTER (status = 'failed') = count(*) THEN 'failed' WHEN count(*) FILTER (status = 'failed') > 0 THEN 'completed_with_failures' ELSE 'completed' END AS state FROM {_ITEMS} GROUP BY 1"),
}
