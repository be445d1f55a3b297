"""Quality gate and language detection, as columns over documents split into pages and blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.operators.blocks import SQL_BLOCKS, document_blocks
from lexiloom.session import table

#: Fixed values of the three saved policies.
POLICIES = {
    "default-v1": {"empty": 0.20, "replacement": 0.01, "control": 0.001, "ocr": 50, "strict": False, "tables_fail": True, "failed": "fail"},
    "strict-v1": {"empty": 0.0, "replacement": 0.001, "control": 0.0, "ocr": 70, "strict": True, "tables_fail": True, "failed": "fail"},
    "warn-v1": {"empty": 0.20, "replacement": 0.01, "control": 0.001, "ocr": 50, "strict": False, "tables_fail": False, "failed": "exclude"},
}
#: Stop words that vote for a Latin-script language.
MARKERS = {
    "en": ("the", "and", "is", "of", "to", "in", "for", "with"),
    "es": ("el", "la", "de", "y", "en", "para", "con", "que"),
    "fr": ("le", "la", "de", "et", "en", "pour", "avec", "que"),
    "de": ("der", "die", "das", "und", "in", "für", "mit", "ist"),
}


def measure(blocks: DataFrame, page_lines: int = 10) -> DataFrame:
    """Characters, blocks, pages, empties and ratios of every document."""
    page = F.expr(f"ordinal div {page_lines}")
    controls = F.length("text") - F.length(F.regexp_replace("text", "[\\p{Cc}&&[^\n\r\t]]", ""))
    pages = blocks.groupBy("doc_id", page.alias("page")).agg(
        F.sum(F.length("text")).alias("chars"),
        F.count(F.lit(1)).alias("blocks"),
        F.count_if(F.trim("text") == "").alias("empty"),
        F.sum(F.length("text") - F.length(F.replace("text", F.lit("�"), F.lit("")))).alias("bad"),
        F.sum(controls).alias("controls"),
    )
    per_doc = pages.groupBy("doc_id").agg(
        F.sum("chars").cast("long").alias("character_count"),
        F.sum("blocks").cast("long").alias("block_count"),
        F.count(F.lit(1)).alias("page_count"),
        F.sum("empty").cast("long").alias("empty_block_count"),
        F.count_if(F.col("chars") == 0).alias("empty_page_count"),
        F.sum("bad").cast("long").alias("bad"),
        F.sum("controls").cast("long").alias("controls"),
    )
    lines = blocks.select("doc_id", F.trim("text").alias("line")).where("line <> ''").groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n"))
    repeats = lines.groupBy(F.col("doc_id").alias("l_id")).agg(F.sum("n").alias("lines"), F.sum(F.col("n") - 1).alias("repeated"))
    ratio = lambda a, b: F.coalesce(F.round(a / F.nullif(b, F.lit(0)), 6), F.lit(0.0))
    return per_doc.join(repeats, F.col("doc_id") == F.col("l_id"), "left").select(
        "doc_id", "character_count", "block_count", "page_count", "empty_block_count", "empty_page_count",
        ratio(F.col("bad"), F.col("character_count")).alias("replacement_character_ratio"),
        ratio(F.col("controls"), F.col("character_count")).alias("control_character_ratio"),
        ratio(F.col("repeated"), F.col("lines")).alias("repeated_line_ratio"),
    )


def evaluate(measured: DataFrame, policy: str = "default-v1") -> DataFrame:
    """findings (``severity:code``) and the decision pass, warn, exclude or fail.

    Optional columns suspicious_reading_order_count, malformed_table_count and ocr_confidence_p05
    count as 0, 0 and null where absent.
    """
    p, warn = POLICIES[policy], policy == "warn-v1"
    has = lambda c, d: F.col(c) if c in measured.columns else F.lit(d)
    order, broken, ocr = has("suspicious_reading_order_count", 0), has("malformed_table_count", 0), has("ocr_confidence_p05", None)
    empty = F.col("empty_page_count") / F.greatest(F.col("page_count"), F.lit(1))
    error = "warning" if warn else "error"
    finding = lambda severity, code: F.lit(f"{severity}:{code}")
    bad, ctl = F.col("replacement_character_ratio"), F.col("control_character_ratio")
    findings = F.array_compact(F.array(
        F.when(F.col("character_count") == 0, finding("error", "no_extractable_text")),
        F.when(F.col("empty_page_count") > 0, F.when(F.lit(not warn) & (empty > p["empty"]), finding("error", "empty_pages")).otherwise(finding("warning", "empty_pages"))),
        F.when(bad > p["replacement"], finding(error, "replacement_character_ratio_high")).when(bad > 0.001, finding("warning", "replacement_characters_present")),
        F.when(ctl > p["control"], finding(error, "control_character_ratio_high")),
        F.when(order > 0, finding("error" if p["strict"] and not warn else "warning", "suspicious_reading_order")),
        F.when(broken > 0, finding("error" if p["tables_fail"] and not warn else "warning", "malformed_tables")),
        F.when(ocr < p["ocr"], finding(error, "ocr_confidence_low")).when(ocr < 70, finding("warning", "ocr_confidence_bounded")),
    ))
    decision = (
        F.when(F.exists("findings", lambda f: f.startswith("error:")),
               F.when((F.col("empty_ratio") >= 0.75) | (F.col("block_count") == 0), "exclude").otherwise(p["failed"]))
        .when(F.size("findings") > 0, "warn")
        .otherwise("pass")
    )
    return measured.withColumn("empty_ratio", empty).withColumn("findings", findings).withColumn("decision", decision).drop("empty_ratio")


def vote(text) -> dict:
    """Columns of the stop-word vote over the whole text."""
    words = F.transform(F.regexp_extract_all(text, F.lit(r"([\p{L}]+)"), 1), lambda w: F.replace(F.lower(w), F.lit("ß"), F.lit("ss")))

    def score(markers):
        return F.size(F.filter("words", lambda w: w.isin(*markers)))

    scores = F.array(*[F.struct(score(m).alias("score"), F.lit(code).alias("code")) for code, m in MARKERS.items()])
    return {"words": words, "best": F.array_max(scores)}


def language_vote(docs: DataFrame) -> DataFrame:
    """language and confidence by stop words; ties go to the larger code, no word to ``und``."""
    columns = vote("text")
    none = F.col("best.score") == 0
    return docs.withColumn("words", columns["words"]).withColumn("best", columns["best"]).withColumn(
        "language", F.when(none, "und").otherwise(F.col("best.code"))
    ).withColumn(
        "confidence",
        F.when(none, 0.40).otherwise(F.round(F.least(F.lit(1.0), 0.55 + F.col("best.score") / F.greatest(F.lit(10), F.size("words"))), 4)),
    ).drop("words", "best")


SCRIPTS = {"ru": "Cyrillic", "ar": "Arabic", "hi": "Devanagari", "ja": "Hiragana", "ko": "Hangul", "zh": "Han", "latin": "Latin"}


def _scripts(docs: DataFrame) -> DataFrame:
    """``docs`` (text) with ``parts``, the letters of each script, and ``letters``.

    Latin letters and common signs are taken out first: scripts that are rare are counted in what is left.
    """
    left = lambda text, cls: F.regexp_replace(text, cls, "")
    pattern = {code: rf"[^\p{{Is{name}}}]+" for code, name in SCRIPTS.items() if code != "latin"}
    pattern["ja"] = r"[^\p{IsHiragana}\p{IsKatakana}]+"
    docs = docs.withColumn("no_latin", left("text", r"\p{IsLatin}+")).withColumn("letters", F.length(left("text", r"[^\p{L}]+")))
    docs = docs.withColumn("others", left("no_latin", r"[\p{IsCommon}\p{IsInherited}]+"))
    counts = {code: F.length(left("others", p)) for code, p in pattern.items()} | {"latin": F.length("text") - F.length("no_latin")}
    parts = F.array(*[F.struct(counts[code].alias("n"), F.lit(code).alias("script")) for code in SCRIPTS])
    return docs.withColumn("parts", parts).drop("no_latin", "others")


#: Two scripts reach a fifth of all letters.
_MIXED = "size(filter(parts, s -> s.n >= 0.2D * greatest(letters, 1))) > 1"


def script_histogram(docs: DataFrame) -> DataFrame:
    """Letters of each script, the dominant one and whether two reach a fifth of all letters."""
    return _scripts(docs).select(
        "doc_id",
        F.col("letters").cast("long").alias("letters"),
        F.when(F.col("letters") == 0, "und").otherwise(F.array_max("parts")["script"]).alias("script"),
        F.coalesce(F.round(F.array_max("parts")["n"] / F.nullif(F.col("letters"), F.lit(0)), 4), F.lit(0.0)).alias("share"),
        F.expr(_MIXED).alias("mixed"),
    )


def page_languages(blocks: DataFrame, page_lines: int = 10) -> DataFrame:
    """doc_id, page, language and confidence of every page of ``page_lines`` blocks."""
    pages = blocks.groupBy("doc_id", F.expr(f"ordinal div {page_lines}").alias("page"))
    text = F.array_join(F.array_sort(F.collect_list(F.struct("ordinal", "text"))).getField("text"), "\n")
    return language_vote(pages.agg(text.alias("text"))).select("doc_id", "page", "language", "confidence")


def line_pages(docs: DataFrame, page_lines: int = 10) -> DataFrame:
    """doc_id and text of every page of ``page_lines`` lines, cut where the document is."""
    lines = docs.select("doc_id", F.split("text", "\n").alias("lines")).where("lines IS NOT NULL")
    first = F.sequence(F.lit(1), F.size("lines"), F.lit(page_lines))
    return lines.select("doc_id", F.explode(F.transform(first, lambda n: F.array_join(F.slice("lines", n, F.lit(page_lines)), "\n"))).alias("text"))


def with_mixed(docs: DataFrame) -> DataFrame:
    """The documents without their texts and with ``mixed``: two scripts reach a fifth of their letters, or their pages of lines differ in language.

    Scripts are counted and pages are judged where the document is; what is joined are ids and languages.
    """
    pages = language_vote(line_pages(docs)).where("language <> 'und'").groupBy(F.col("doc_id").alias("p_id")).agg((F.min("language") != F.max("language")).alias("differ"))
    scripts = _scripts(docs).withColumn("s_mixed", F.coalesce(F.expr(_MIXED), F.lit(False))).drop("text", "parts", "letters")
    joined = scripts.join(pages, F.col("doc_id") == F.col("p_id"), "left")
    return joined.withColumn("mixed", F.col("s_mixed") | F.coalesce("differ", F.lit(False))).drop("p_id", "differ", "s_mixed")


def language_policy(docs: DataFrame, allowlist=("en", "de"), minimum_confidence: float = 0.6, disallowed: str = "exclude", mixed_action: str = "warn") -> DataFrame:
    """Findings and decision of a language policy over detected documents; ``mixed`` counts where it is there.

    A language outside the list takes ``disallowed``; mixed languages fail a document, or warn one that
    passes; low confidence warns.
    """
    low, out = F.col("confidence") < minimum_confidence, ~F.col("language").isin(*allowlist)
    mixed = F.col("mixed") if "mixed" in docs.columns and mixed_action != "allow" else F.lit(False)
    findings = F.array_compact(F.array(F.when(low, "language_confidence_low"), F.when(out, "language_not_allowed"), F.when(mixed, "mixed_languages")))
    decision = F.when(out, disallowed).when(low | mixed, "warn").otherwise("pass")
    if mixed_action == "fail":
        decision = F.when(mixed, "fail").otherwise(decision)
    return docs.withColumn("findings", F.array_join(findings, ",")).withColumn("decision", decision)


def q_measure(spark, sf):
    return measure(document_blocks(spark, sf))


def _worn(spark, sf):
    """The documents' lines with short ones empty and two letters damaged, so that every finding occurs; two lines a page."""
    worn = F.replace(F.replace("text", F.lit("ß"), F.lit("\ufffd")), F.lit("ç"), F.lit("\a"))
    return measure(document_blocks(spark, sf).withColumn("text", F.when(F.length("text") < 60, "").otherwise(worn)), page_lines=2)


def q_evaluate(spark, sf):
    measured = _worn(spark, sf)
    parts = [evaluate(measured, p).select("doc_id", F.lit(p).alias("policy"), F.array_join("findings", ",").alias("findings"), "decision") for p in POLICIES]
    return reduce(DataFrame.unionByName, parts)


def q_publishable(spark, sf):
    """Documents that the gate lets through: pass, or warn where warnings are published."""
    gate = evaluate(measure(document_blocks(spark, sf)))
    return gate.where(F.col("decision").isin("pass", "warn")).select("doc_id", "decision")


def q_client_rendered(spark, sf):
    """Pages with a script in their first 2 MB and under 200 characters of text outside tags."""
    text = F.trim(F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>|\s+", " "))
    pages = table(spark, sf, "pages").select("page_id", F.substring("html", 1, 2_000_000).contains("<script").alias("scripted"), F.length(F.regexp_replace(text, r"\s+", " ")).cast("long").alias("chars"))
    return pages.select("page_id", "chars", (F.col("scripted") & (F.col("chars") < 200)).alias("client_rendered"))


def q_language_vote(spark, sf):
    return language_vote(table(spark, sf, "documents")).select("doc_id", "language", "confidence")


def q_confusion(spark, sf):
    return language_vote(table(spark, sf, "documents")).groupBy("lang", "language").agg(F.count(F.lit(1)).alias("n"))


def q_scripts(spark, sf):
    return script_histogram(table(spark, sf, "documents"))


def q_page_languages(spark, sf):
    return page_languages(document_blocks(spark, sf))


def q_language_policy(spark, sf):
    found = with_mixed(language_vote(table(spark, sf, "documents").select("doc_id", "text")))
    return language_policy(found).select("doc_id", "language", "mixed", "findings", "decision")


_MEASURES = """(SELECT p.doc_id, character_count, block_count, page_count, empty_block_count, empty_page_count, coalesce(round(bad / nullif(character_count, 0), 6), 0.0) AS replacement_character_ratio,
  coalesce(round(controls / nullif(character_count, 0), 6), 0.0) AS control_character_ratio, coalesce(round(repeated / lines, 6), 0.0) AS repeated_line_ratio
  FROM (SELECT doc_id, CAST(sum(c) AS BIGINT) AS character_count, CAST(sum(b) AS BIGINT) AS block_count, count(*) AS page_count, CAST(sum(e) AS BIGINT) AS empty_block_count, count(*) FILTER (c = 0) AS empty_page_count, sum(bad) AS bad, sum(controls) AS controls
        FROM (SELECT doc_id, ordinal // {lines} AS page, sum(length(text)) AS c, count(*) AS b, count(*) FILTER (trim(text) = '') AS e, sum(length(text) - length(replace(text, chr(65533), ''))) AS bad,
              sum(length(text) - length(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{{9f}}]', '', 'g'))) AS controls FROM {blocks} GROUP BY 1, 2) GROUP BY 1) p
  LEFT JOIN (SELECT doc_id, sum(n) AS lines, sum(n - 1) AS repeated FROM (SELECT doc_id, trim(text) AS line, count(*) AS n FROM {blocks} WHERE trim(text) <> '' GROUP BY 1, 2) GROUP BY 1) r USING (doc_id))"""
_MEASURE = _MEASURES.format(lines=10, blocks=SQL_BLOCKS)
_WORN = _MEASURES.format(lines=2, blocks=f"(SELECT doc_id, ordinal, CASE WHEN length(text) < 60 THEN '' ELSE replace(replace(text, 'ß', chr(65533)), 'ç', chr(7)) END AS text FROM {SQL_BLOCKS})")
_WORDS = r"list_transform(regexp_extract_all(text, '[\p{L}]+'), lambda w: replace(lower(w), 'ß', 'ss'))"
_SCORES = ", ".join(f"{{'score': len(list_filter(w, lambda x: x IN {m})), 'code': '{c}'}}" for c, m in MARKERS.items())
_VOTE = f"""(SELECT doc_id, lang, CASE WHEN b.score = 0 THEN 'und' ELSE b.code END AS language,
  CASE WHEN b.score = 0 THEN 0.4::DOUBLE ELSE round(least(1.0::DOUBLE, 0.55::DOUBLE + b.score / greatest(10, len(w))), 4) END AS confidence
  FROM (SELECT *, list_max([{_SCORES}]) AS b FROM (SELECT doc_id, lang, {_WORDS} AS w FROM documents)))"""
_PAGES = _VOTE.replace("FROM documents", f"FROM (SELECT doc_id, ordinal // 10 AS lang, string_agg(text, chr(10) ORDER BY ordinal) AS text FROM {SQL_BLOCKS} GROUP BY 1, 2)")
_SCRIPTS = r"""WITH c AS (SELECT doc_id, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS letters, [
          {'n': length(regexp_replace(text, '[^\p{Cyrillic}]', '', 'g')), 's': 'ru'}, {'n': length(regexp_replace(text, '[^\p{Arabic}]', '', 'g')), 's': 'ar'},
          {'n': length(regexp_replace(text, '[^\p{Devanagari}]', '', 'g')), 's': 'hi'}, {'n': length(regexp_replace(text, '[^\p{Hiragana}\p{Katakana}]', '', 'g')), 's': 'ja'},
          {'n': length(regexp_replace(text, '[^\p{Hangul}]', '', 'g')), 's': 'ko'}, {'n': length(regexp_replace(text, '[^\p{Han}]', '', 'g')), 's': 'zh'},
          {'n': length(regexp_replace(text, '[^\p{Latin}]', '', 'g')), 's': 'latin'}] AS parts FROM documents)
        SELECT doc_id, letters, CASE WHEN letters = 0 THEN 'und' ELSE list_max(parts).s END AS script, coalesce(round(list_max(parts).n / nullif(letters, 0), 4), 0.0) AS share,
        len(list_filter(parts, lambda p: p.n >= 0.2 * greatest(letters, 1))) > 1 AS mixed FROM c"""

QUERIES = {
    "document_measurements": (q_measure, f"SELECT * FROM {_MEASURE}"),
    "quality_gate_decisions": (
        q_evaluate,
        f"""WITH p AS (SELECT * FROM (VALUES ('default-v1', 0.2, 0.01, 0.001, 'fail'), ('strict-v1', 0.0, 0.001, 0.0, 'fail'), ('warn-v1', 0.2, 0.01, 0.001, 'exclude')) v(policy, empty, bad, ctl, failed)),
        f AS (SELECT doc_id, policy, failed, block_count, empty_page_count / greatest(page_count, 1) AS e, concat_ws(',', CASE WHEN character_count = 0 THEN 'error:no_extractable_text' END,
          CASE WHEN empty_page_count > 0 AND policy <> 'warn-v1' AND empty_page_count / page_count > empty THEN 'error:empty_pages' WHEN empty_page_count > 0 THEN 'warning:empty_pages' END,
          CASE WHEN replacement_character_ratio > bad THEN CASE WHEN policy = 'warn-v1' THEN 'warning' ELSE 'error' END || ':replacement_character_ratio_high' WHEN replacement_character_ratio > 0.001 THEN 'warning:replacement_characters_present' END,
          CASE WHEN control_character_ratio > ctl THEN CASE WHEN policy = 'warn-v1' THEN 'warning' ELSE 'error' END || ':control_character_ratio_high' END) AS findings FROM {_WORN}, p)
        SELECT doc_id, policy, findings, CASE WHEN contains(findings, 'error:') THEN CASE WHEN e >= 0.75 OR block_count = 0 THEN 'exclude' ELSE failed END WHEN findings <> '' THEN 'warn' ELSE 'pass' END AS decision FROM f""",
    ),
    "worn_measurements": (lambda spark, sf: _worn(spark, sf), f"SELECT * FROM {_WORN}"),
    "publishable_documents": (q_publishable, f"SELECT doc_id, CASE WHEN empty_page_count > 0 THEN 'warn' ELSE 'pass' END AS decision FROM {_MEASURE} WHERE character_count > 0 AND empty_page_count / page_count <= 0.2"),
    "client_rendered_pages": (
        q_client_rendered,
        r"""WITH t AS (SELECT page_id, contains(left(html, 2000000), '<script') AS s, trim(regexp_replace(regexp_replace(html, '<script\b.*?</script>|<style\b.*?</style>', ' ', 'gis'), '<[^>]*>|\s+', ' ', 'gs')) AS t FROM pages)
        SELECT page_id, length(regexp_replace(t, '\s+', ' ', 'g')) AS chars, s AND length(regexp_replace(t, '\s+', ' ', 'g')) < 200 AS client_rendered FROM t""",
    ),
    "language_vote": (q_language_vote, f"SELECT doc_id, language, confidence FROM {_VOTE}"),
    "language_confusion_matrix": (q_confusion, f"SELECT lang, language, count(*) AS n FROM {_VOTE} GROUP BY 1, 2"),
    "script_histogram": (
        q_scripts,
        _SCRIPTS,
    ),
    "page_languages": (q_page_languages, f"SELECT doc_id, lang AS page, language, confidence FROM {_PAGES}"),
    "language_policy": (
        q_language_policy,
        f"""WITH p AS (SELECT doc_id, count(DISTINCT language) FILTER (language <> 'und') > 1 AS differ FROM {_PAGES} GROUP BY 1), s AS ({_SCRIPTS}), v AS (SELECT v.doc_id, language, confidence, s.mixed OR coalesce(differ, false) AS mixed FROM {_VOTE} v JOIN s ON s.doc_id = v.doc_id LEFT JOIN p ON p.doc_id = v.doc_id)
        SELECT doc_id, language, mixed, concat_ws(',', CASE WHEN confidence < 0.6 THEN 'language_confidence_low' END, CASE WHEN language NOT IN ('en', 'de') THEN 'language_not_allowed' END, CASE WHEN mixed THEN 'mixed_languages' END) AS findings,
        CASE WHEN language NOT IN ('en', 'de') THEN 'exclude' WHEN confidence < 0.6 OR mixed THEN 'warn' ELSE 'pass' END AS decision FROM v""",
    ),
}
