"""Blocks of documents and their ordered cleaning steps.

A block is (doc_id, ordinal, type, text). ``documents`` has one block a line. Steps take and return
block DataFrames, so ``blocks.transform(step)`` chains them; audits are separate DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.session import table

PROTECTED = ("table", "list_item", "code", "quote", "footnote")
LITERALS = ("Released under the MIT License.", "Licensed under the Apache License, Version 2.0.")
#: Format characters newer than Java's tables are listed by hand; line breaks, tabs and joiners stay.
CONTROLS = r"[\p{Cc}\p{Cf}\x{890}\x{891}\x{13439}-\x{1343F}&&[^\n\r\t\x{200C}\x{200D}]]"

#: DuckDB: the same blocks.
SQL_BLOCKS = """(SELECT doc_id, source, ordinal, text,
  CASE WHEN ordinal = 0 THEN 'heading' WHEN contains(text, ' | ') THEN 'table' ELSE 'paragraph' END AS type
  FROM (SELECT doc_id, source, unnest(range(len(l))) AS ordinal, unnest(l) AS text
        FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents)))"""
_SQL_PROTECTED = "('table', 'list_item', 'code', 'quote', 'footnote')"


def blocks_of(docs: DataFrame, *extra: str) -> DataFrame:
    """One block a line: a first line is a heading, a line with `` | `` a table row."""
    kind = F.when(F.col("ordinal") == 0, "heading").when(F.col("text").contains(" | "), "table").otherwise("paragraph")
    return (
        docs.select("doc_id", *extra, F.posexplode(F.split("text", "\n")).alias("ordinal", "text"))
        .withColumn("ordinal", F.col("ordinal").cast("long"))
        .withColumn("type", kind)
    )


def document_blocks(spark, sf_dir, *extra):
    return blocks_of(table(spark, sf_dir, "documents"), *extra)


def is_protected(protected=PROTECTED) -> Column:
    return F.col("type").isin(*protected)


def fingerprint(text) -> Column:
    """White space folded, trimmed, case-folded (sharp s included)."""
    return F.replace(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), F.lit("ß"), F.lit("ss"))


def fingerprint_v2(text) -> Column:
    """The same after NFKC and without control and format characters, so that a soft hyphen does not hide a repeat."""
    nfkc = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(True))
    return fingerprint(F.regexp_replace(nfkc, CONTROLS, ""))


_SQL_FINGERPRINT = "replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'ß', 'ss')"


def normalize_unicode(blocks: DataFrame, form: str = "NFC") -> DataFrame:
    """NFC or NFKC of every text, with a change flag; Spark's own Unicode library does it."""
    text = F.coalesce("text", F.lit(""))
    done = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(form == "NFKC"))
    return blocks.withColumn("normal", done).withColumn("changed", F.col("normal") != text).withColumn("text", F.col("normal")).drop("normal")


def remove_controls(blocks: DataFrame) -> DataFrame:
    clean = F.regexp_replace("text", CONTROLS, "")
    return blocks.withColumn("removed", F.length("text") - F.length(clean)).withColumn("text", clean)


def reflow(blocks: DataFrame, types=("paragraph", "unknown")) -> DataFrame:
    """Single line breaks become spaces, unless a hyphen or white space stands before or white space after."""
    joined = F.regexp_replace("text", r"(?<=[^\s-])(?<!\n)\n(?!\n)(?=\S)", " ")
    return blocks.withColumn("text", F.when(F.col("type").isin(*types), joined).otherwise(F.col("text")))


def dehyphenate(blocks: DataFrame) -> DataFrame:
    """Joins lower-case words that a hyphen and a line break split."""
    return blocks.withColumn("text", F.regexp_replace("text", r"(\p{Ll})-\s*\n\s*(\p{Ll})", "$1$2"))


def dehyphenate_compounds(blocks: DataFrame) -> DataFrame:
    """As above, but a word that the document writes with its hyphen on one line keeps the hyphen.

    The compounds of a document are gathered once (one row a document); each split word is then
    looked up in them.
    """
    pair = r"(?<![\p{L}\p{N}_])([\p{L}]+-[\p{L}]+)(?![\p{L}\p{N}_])"
    known = (
        blocks.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(pair), 1)).alias("w"))
        .groupBy(F.col("doc_id").alias("k_id"))
        .agg(F.collect_set("w").alias("known"))
    )
    # Odd pieces of the split are the words to look up.
    split = F.split(F.regexp_replace("text", r"([\p{L}]+)-\s*\n\s*([\p{L}]+)", "\u0001$1-$2\u0001"), "\u0001")
    joinable = lambda w: F.when(F.array_contains("known", F.lower(w)), w).when(
        w.rlike(r"\p{Ll}-\p{Ll}"), F.regexp_replace(w, "-", "")
    ).otherwise(F.regexp_replace(w, "-", "-\n"))
    fixed = F.transform(split, lambda w, i: F.when(i % 2 == 1, joinable(w)).otherwise(w))
    return blocks.join(known, F.col("doc_id") == F.col("k_id"), "left").withColumn("text", F.array_join(fixed, "")).drop("k_id", "known")


def remove_empty(blocks: DataFrame, minimum: int = 1, protected=PROTECTED) -> DataFrame:
    return blocks.where((F.length(F.regexp_replace("text", r"\s+", "")) >= minimum) | is_protected(protected))


def dedupe(blocks: DataFrame, protected=PROTECTED) -> DataFrame:
    """The first of equal blocks of a document; protected ones all stay."""
    first = F.row_number().over(Window.partitionBy("doc_id", F.sha2("text", 256)).orderBy("ordinal")) == 1
    return blocks.withColumn("first", first | is_protected(protected)).where("first").drop("first")


def renumber(blocks: DataFrame) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("ordinal")
    return blocks.withColumn("ordinal", F.row_number().over(order).cast("long") - 1)


def remove_literals(blocks: DataFrame, literals=LITERALS) -> DataFrame:
    """Removes literals one after another and counts them."""
    count, text = F.lit(0).cast("long"), F.col("text")
    for literal in literals:
        rest = F.replace(text, F.lit(literal), F.lit(""))
        count, text = count + (F.length(text) - F.length(rest)) / len(literal), rest
    return blocks.withColumn("removed", count.cast("long")).withColumn("text", text)


def repeated_fingerprints(blocks: DataFrame, site: str, page: str, ratio: float = 0.6, minimum_pages: int = 3, longest: int = 500, of=fingerprint) -> DataFrame:
    """(site, fp, pages) of fingerprints on at least ``ratio`` of a site's pages."""
    short = blocks.withColumn("fp", of(F.col("text"))).where((F.col("fp") != "") & (F.length("fp") <= longest))
    seen = short.groupBy(site, "fp").agg(F.countDistinct(page).alias("pages"))
    total = blocks.groupBy(F.col(site).alias("s")).agg(F.countDistinct(page).alias("total")).where(F.col("total") >= minimum_pages)
    return seen.join(total, F.col(site) == F.col("s")).where(F.col("pages") / F.col("total") >= ratio).select(site, "fp", "pages", "total")


def remove_margins(blocks: DataFrame, site: str, page: str, ratio: float = 0.6, minimum_pages: int = 3) -> DataFrame:
    """Drops unprotected margin blocks (``at_margin``) whose fingerprint repeats in the margins of a site."""
    margin = blocks.where(F.col("at_margin") & ~is_protected())
    total = blocks.groupBy(F.col(site).alias("t_site")).agg(F.countDistinct(page).alias("total")).where(F.col("total") >= minimum_pages)
    repeated = (
        margin.groupBy(F.col(site).alias("r_site"), fingerprint("text").alias("r_fp"))
        .agg(F.countDistinct(page).alias("n"))
        .join(total, F.col("r_site") == F.col("t_site"))
        .where((F.col("r_fp") != "") & (F.col("n") / F.col("total") >= ratio))
        .select("r_site", "r_fp")
    )
    # Only margins are looked up; all other blocks stay where they are.
    hit = (F.col(site) == F.col("r_site")) & (F.col("m_fp") == F.col("r_fp"))
    kept = margin.withColumn("m_fp", fingerprint("text")).join(repeated, hit, "left_anti").drop("m_fp")
    return blocks.where(~F.coalesce(F.col("at_margin") & ~is_protected(), F.lit(False))).unionByName(kept)


def chrome_owners(blocks: DataFrame, site: str, page: str, **limits) -> DataFrame:
    """The first page that shows each repeated fingerprint (its second version) of a site keeps its copy."""
    keyed = blocks.withColumn("b_fp", fingerprint_v2(F.col("text"))).withColumnRenamed(site, "b_site")
    repeated = repeated_fingerprints(blocks, site, page, of=fingerprint_v2, **limits)
    return (
        keyed.join(repeated, (F.col("b_site") == F.col(site)) & (F.col("b_fp") == F.col("fp")))
        .groupBy(site, F.sha2("fp", 256).alias("fingerprint"))
        .agg(F.min(page).alias("owner"), F.max("pages").alias("pages"))
    )


def main_content(blocks: DataFrame) -> DataFrame:
    """Reason why a web block goes, in the order of precedence; null keeps it.

    Needs html_main, html_role, html_selectors and ``repeated``.
    """
    has_main = F.max(F.col("html_main").cast("int")).over(Window.partitionBy("doc_id")) == 1
    roles = ("navigation", "banner", "contentinfo", "complementary", "dialog", "form")
    hints = F.lower(F.array_join("html_selectors", " ")).rlike("cookie|consent|privacy-banner|gdpr")
    reason = (
        F.when(has_main & ~F.coalesce("html_main", F.lit(False)), "outside_main_content")
        .when(F.col("html_role").isin(*roles), "semantic_site_chrome")
        .when(hints, "cookie_or_consent_banner")
        .when(F.col("repeated"), "repeated_site_chrome")
    )
    return blocks.withColumn("reason", reason)


def select_blocks(blocks: DataFrame, include=(), exclude=()) -> DataFrame:
    """Keeps web blocks with one of the ``include`` selectors, if any, and none of the ``exclude`` ones."""
    keep = F.lit(True)
    if include:
        keep = keep & F.arrays_overlap("html_selectors", F.array(*map(F.lit, include)))
    if exclude:
        keep = keep & ~F.arrays_overlap("html_selectors", F.array(*map(F.lit, exclude)))
    return blocks.where(F.coalesce(keep, F.lit(not include)))


def useful_length(blocks: DataFrame, minimum: int = 1, maximum: int = 2_000_000) -> DataFrame:
    """Characters left in each document and what is wrong with their number."""
    status = (
        F.when(F.col("characters") < minimum, "too_little_useful_content")
        .when(F.col("characters") > maximum, "too_much_useful_content")
        .otherwise("ok")
    )
    return blocks.groupBy("doc_id").agg(F.sum(F.length("text")).alias("characters")).withColumn("status", status)


def cleaning_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """unchanged, rewritten or removed for every block of ``before``, by (doc_id, ordinal)."""
    new = after.select(F.col("doc_id").alias("n_id"), F.col("ordinal").alias("n_ordinal"), F.col("text").alias("n_text"))
    status = F.when(F.col("n_id").isNull(), "removed").when(F.col("n_text").eqNullSafe(F.col("text")), "unchanged").otherwise("rewritten")
    joined = before.join(new, (F.col("doc_id") == F.col("n_id")) & (F.col("ordinal") == F.col("n_ordinal")), "left")
    return joined.select("doc_id", "ordinal", status.alias("status"))


def change_rows(before: DataFrame, after: DataFrame, transform: str) -> DataFrame:
    """Every block that a step removed or rewrote, with digests of both texts."""
    new = after.select(F.col("doc_id").alias("n_id"), F.col("ordinal").alias("n_ordinal"), F.col("text").alias("n_text"))
    joined = before.join(new, (F.col("doc_id") == F.col("n_id")) & (F.col("ordinal") == F.col("n_ordinal")), "left").where(~F.col("n_text").eqNullSafe(F.col("text")))
    status = F.when(F.col("n_id").isNull(), "removed").otherwise("rewritten")
    return joined.select(F.lit(transform).alias("transform"), "doc_id", "ordinal", status.alias("status"), F.sha2("text", 256).alias("before"), F.sha2("n_text", 256).alias("after"))


def standard_clean(text, literals=LITERALS) -> Column:
    """White space collapsed, literals removed, collapsed again."""
    out = F.trim(F.regexp_replace(text, r"\s+", " "))
    for literal in literals:
        out = F.replace(out, F.lit(literal), F.lit(" "))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def _digest(df, *keys):
    """Keys and digest of the text, so that results stay small."""
    return df.select(*keys, F.sha2("text", 256).alias("text_sha256"))


def q_blocks(spark, sf):
    return document_blocks(spark, sf).select("doc_id", "ordinal", "type", F.length("text").cast("long").alias("n_chars"))


def q_remove_empty(spark, sf):
    return _digest(document_blocks(spark, sf).transform(remove_empty, 4), "doc_id", "ordinal")


def q_dedupe(spark, sf):
    return _digest(document_blocks(spark, sf).transform(dedupe), "doc_id", "ordinal", "type")


def q_renumber(spark, sf):
    kept = document_blocks(spark, sf).transform(remove_empty, 4).transform(dedupe)
    return _digest(renumber(kept), "doc_id", "ordinal")


def q_nfc(spark, sf):
    return normalize_unicode(table(spark, sf, "documents")).select("doc_id", F.sha2("text", 256).alias("text_sha256"), "changed")


def q_controls(spark, sf):
    out = remove_controls(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("removed").cast("long").alias("removed"), F.sha2("text", 256).alias("text_sha256"))


def _whole(spark, sf):
    """Whole texts as one paragraph each, with a hyphen and a line break in place of spaces between lower-case letters."""
    text = F.regexp_replace("text", r"(\p{Ll}) (\p{Ll})", "$1-\n$2")
    return table(spark, sf, "documents").select("doc_id", F.lit(0).cast("long").alias("ordinal"), F.lit("paragraph").alias("type"), text.alias("text"))


def q_reflow(spark, sf):
    return _digest(reflow(_whole(spark, sf)), "doc_id")


def q_dehyphenate(spark, sf):
    return _digest(dehyphenate(_whole(spark, sf)), "doc_id")


def q_compounds(spark, sf):
    return _digest(dehyphenate_compounds(_whole(spark, sf)), "doc_id")


def q_literals(spark, sf):
    return remove_literals(table(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id", "removed", F.length("text").cast("long").alias("n_chars_left")
    )


def q_repeated_source_lines(spark, sf):
    found = repeated_fingerprints(document_blocks(spark, sf, "source"), "source", "doc_id", ratio=0.02)
    return found.select("source", F.sha2("fp", 256).alias("fingerprint"), "pages", "total")


def q_chrome_owner(spark, sf):
    return chrome_owners(document_blocks(spark, sf, "source"), "source", "doc_id", ratio=0.02)


def q_margins(spark, sf):
    """A document's first and last lines are its margins; its number of lines is known where it is."""
    docs = table(spark, sf, "documents").withColumn("lines", F.size(F.split("text", "\n")))
    blocks = blocks_of(docs, "source", "lines").withColumn("at_margin", (F.col("ordinal") == 0) | (F.col("ordinal") == F.col("lines") - 1)).drop("lines")
    return remove_margins(blocks, "source", "doc_id", ratio=0.02).select("doc_id", "ordinal")


def q_useful(spark, sf):
    return useful_length(document_blocks(spark, sf).transform(remove_empty, 4), 100, 20_000)


def q_diff(spark, sf):
    before = document_blocks(spark, sf)
    after = before.transform(remove_empty, 4).transform(dedupe).transform(remove_literals).drop("removed")
    return cleaning_diff(before, after).groupBy("doc_id", "status").agg(F.count(F.lit(1)).alias("blocks"))


def q_audit(spark, sf):
    """Changed and removed counts of three steps over the corpus."""
    blocks = document_blocks(spark, sf)
    empty = F.length(F.regexp_replace("text", r"\s+", "")) < 4
    nth = F.row_number().over(Window.partitionBy("doc_id", F.sha2("text", 256)).orderBy("ordinal"))
    flags = blocks.withColumn("nth", nth).withColumn("empty", empty)
    literal = F.lit(False)
    for value in LITERALS:
        literal = literal | F.col("text").contains(value)
    counts = flags.agg(
        F.count_if(F.col("empty") & ~is_protected()).alias("e"),
        F.count_if(F.col("empty") & is_protected()).alias("p"),
        F.count_if((F.col("nth") > 1) & ~is_protected()).alias("d"),
        F.count_if(literal).alias("l"),
    )
    return counts.selectExpr(
        "stack(3, 'remove_empty_blocks', e, p, 'deduplicate_blocks', d, 0L, 'remove_literals', 0L, l) AS (transform, removed, changed_or_retained)"
    )


def q_audit_changes(spark, sf):
    """The changed blocks of three steps, each on what the one before it left.

    Texts are judged and digested where they are; only digests are shuffled, once, to find a document's repeats.
    """
    blocks = document_blocks(spark, sf)
    empty = (F.length(F.regexp_replace("text", r"\s+", "")) < 4) & ~is_protected()
    flags = remove_literals(blocks.withColumn("whole", F.col("text")).withColumn("empty", empty)).select(
        "doc_id", "ordinal", "empty", is_protected().alias("protected"), F.unhex(F.sha2("whole", 256)).alias("before"),
        F.when(F.col("text") != F.col("whole"), F.unhex(F.sha2("text", 256))).alias("after"),
    )
    nth = F.row_number().over(Window.partitionBy("doc_id", "empty", "before").orderBy("ordinal"))
    step = F.when(F.col("empty"), "remove_empty_blocks").when((F.col("nth") > 1) & ~F.col("protected"), "deduplicate_blocks").when(F.col("after").isNotNull(), "remove_literals")
    rewritten = F.col("transform") == "remove_literals"
    return flags.withColumn("nth", nth).withColumn("transform", step).where("transform IS NOT NULL").select(
        "transform", "doc_id", "ordinal", F.when(rewritten, "rewritten").otherwise("removed").alias("status"), F.lower(F.hex("before")).alias("before"),
        F.when(rewritten, F.lower(F.hex("after"))).alias("after"),
    )


def q_standard(spark, sf):
    clean = standard_clean("text")
    n = F.length("clean").cast("long")
    violation = F.when(n < 100, "too_short").when(n > 20_000, "too_long")
    return table(spark, sf, "documents").select("doc_id", clean.alias("clean")).select(
        "doc_id", n.alias("n_chars"), F.sha2("clean", 256).alias("text_sha256"), violation.alias("violation")
    )


def q_page_text(spark, sf, lines: int = 10):
    """Pages of ``lines`` blocks, joined by blank lines in order."""
    pages = document_blocks(spark, sf).groupBy("doc_id", F.expr(f"ordinal div {lines} + 1").alias("page_number"))
    text = F.array_join(F.array_sort(F.collect_list(F.struct("ordinal", "text"))).getField("text"), "\n\n")
    return pages.agg(text.alias("text")).select("doc_id", "page_number", F.sha2("text", 256).alias("text_sha256"))


def q_page_counts(spark, sf, lines: int = 10):
    pages = document_blocks(spark, sf).groupBy("doc_id", F.expr(f"ordinal div {lines} + 1").alias("page_number"))
    return pages.agg(F.sum(F.length("text")).cast("long").alias("character_count"), F.count(F.lit(1)).alias("block_count"))


def q_text_scan(spark, sf, limit: int = 20_000):
    """Byte-order mark stripped; NUL, blank and over-long texts are violations, not failures."""
    text = F.regexp_replace("text", "^\\x{FEFF}", "")
    bad = F.array_compact(F.array(
        F.when(text.contains("\0"), "nul_byte"), F.when(F.trim(text) == "", "blank"), F.when(F.length(text) > limit, "too_long")
    ))
    return table(spark, sf, "documents").select(
        "doc_id", F.sha2(text, 256).alias("text_sha256"), F.array_join(bad, ",").alias("violations")
    )


def q_canonical(spark, sf):
    """Stable block ids and offsets: the id digests sorted-key JSON, offsets are a running sum."""
    blocks = document_blocks(spark, sf)
    before = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("long")
    identity = F.to_json(F.struct("doc_id", "ordinal", "text", "type"))
    return blocks.select(
        F.substring(F.sha2(identity, 256), 1, 32).alias("block_id"), "doc_id", "ordinal",
        start.alias("start_char"), (start + F.length("text")).cast("long").alias("end_char"),
    )


_D = "sha256(text) AS text_sha256"
_SQL_WHOLE = "(SELECT doc_id, regexp_replace(text, '(\\p{Ll}) (\\p{Ll})', '\\1-' || chr(10) || '\\2', 'g') AS text FROM documents)"
_EMPTY = f"(length(regexp_replace(text, '\\s+', '', 'g')) >= 4 OR type IN {_SQL_PROTECTED})"
_DEDUPED = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sha256(text) ORDER BY ordinal) AS nth FROM {{}})
  WHERE nth = 1 OR type IN {_SQL_PROTECTED})"""
_REPEATED = f"""(SELECT source, fp, pages, total FROM
  (SELECT source, fp, count(DISTINCT doc_id) AS pages FROM (SELECT source, doc_id, {_SQL_FINGERPRINT} AS fp FROM {SQL_BLOCKS}) WHERE fp <> '' AND length(fp) <= 500 GROUP BY 1, 2)
  JOIN (SELECT source, count(DISTINCT doc_id) AS total FROM documents GROUP BY 1) USING (source) WHERE total >= 3 AND pages / total >= 0.02)"""
_LITERAL = "replace(replace(text, 'Released under the MIT License.', ''), 'Licensed under the Apache License, Version 2.0.', '')"
_COUNT = """CAST((length(text) - length(replace(text, 'Released under the MIT License.', ''))) / 31
  + (length(text) - length(replace(text, 'Licensed under the Apache License, Version 2.0.', ''))) / 47 AS BIGINT)"""

QUERIES = {
    "blocks_from_documents": (q_blocks, f"SELECT doc_id, ordinal, type, length(text) AS n_chars FROM {SQL_BLOCKS}"),
    "remove_empty_blocks": (q_remove_empty, f"SELECT doc_id, ordinal, {_D} FROM {SQL_BLOCKS} WHERE {_EMPTY}"),
    "dedupe_blocks_in_document": (q_dedupe, f"SELECT doc_id, ordinal, type, {_D} FROM {_DEDUPED.format(SQL_BLOCKS)}"),
    "renumber_cleaned_blocks": (
        q_renumber,
        f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) - 1 AS ordinal, {_D} FROM {_DEDUPED.format(f'(SELECT * FROM {SQL_BLOCKS} WHERE {_EMPTY})')}",
    ),
    "unicode_nfc": (q_nfc, "SELECT doc_id, sha256(nfc_normalize(text)) AS text_sha256, nfc_normalize(text) <> text AS changed FROM documents"),
    "control_characters_removed": (
        q_controls,
        """WITH c AS (SELECT doc_id, text, regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}\\x{AD}\\x{600}-\\x{605}\\x{61C}\\x{6DD}\\x{70F}\\x{180E}\\x{200B}\\x{200E}\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{2064}\\x{2066}-\\x{206F}\\x{FEFF}]', '', 'g') AS t FROM documents)
           SELECT doc_id, length(text) - length(t) AS removed, sha256(t) AS text_sha256 FROM c""",
    ),
    "reflow_lines": (
        q_reflow,  # the second pass takes breaks whose character before the first pass had taken
        f"""SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '([^\\s-])\\n(\\S)', '\\1 \\2', 'g'), '([^\\s-])\\n(\\S)', '\\1 \\2', 'g')) AS text_sha256 FROM {_SQL_WHOLE}""",
    ),
    "dehyphenate_conservative": (
        q_dehyphenate,
        """WITH w AS (SELECT doc_id, regexp_replace(text, '(\\p{Ll}) (\\p{Ll})', '\\1-' || chr(10) || '\\2', 'g') AS text FROM documents)
        SELECT doc_id, sha256(regexp_replace(text, '(\\p{Ll})-\\s*\\n\\s*(\\p{Ll})', '\\1\\2', 'g')) AS text_sha256 FROM w""",
    ),
    "dehyphenate_compounds": (
        q_compounds,
        f"""WITH w AS (SELECT doc_id, text, [lower(x) FOR x IN regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+(?:-[\\p{{L}}\\p{{N}}_]+)*-?') IF regexp_full_match(x, '[\\p{{L}}]+-[\\p{{L}}]+')] AS known,
          string_split(regexp_replace(text, '([\\p{{L}}]+)-\\s*\\n\\s*([\\p{{L}}]+)', chr(1) || '\\1-\\2' || chr(1), 'g'), chr(1)) AS parts FROM {_SQL_WHOLE})
        SELECT doc_id, sha256(array_to_string(list_transform(parts, lambda x, i: CASE WHEN i % 2 = 1 THEN x WHEN list_contains(known, lower(x)) THEN x WHEN regexp_matches(x, '\\p{{Ll}}-\\p{{Ll}}') THEN replace(x, '-', '') ELSE replace(x, '-', '-' || chr(10)) END), '')) AS text_sha256 FROM w""",
    ),
    "literal_boilerplate_removed": (q_literals, f"SELECT doc_id, {_COUNT} AS removed, length({_LITERAL}) AS n_chars_left FROM documents"),
    "repeated_source_lines": (q_repeated_source_lines, f"SELECT source, sha256(fp) AS fingerprint, pages, total FROM {_REPEATED}"),
    "chrome_owner_page": (
        q_chrome_owner,
        f"""SELECT b.source, sha256(r.fp) AS fingerprint, min(doc_id) AS owner, max(r.pages) AS pages
            FROM (SELECT source, doc_id, {_SQL_FINGERPRINT} AS fp FROM {SQL_BLOCKS}) b JOIN {_REPEATED} r ON b.source = r.source AND b.fp = r.fp GROUP BY 1, 2""",
    ),
    "repeated_margin_lines_removed": (
        q_margins,
        f"""WITH b AS (SELECT *, {_SQL_FINGERPRINT} AS fp, (ordinal = 0 OR ordinal = max(ordinal) OVER (PARTITION BY doc_id)) AND type NOT IN {_SQL_PROTECTED} AS m FROM {SQL_BLOCKS}),
        t AS (SELECT source, count(DISTINCT doc_id) AS total FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3),
        r AS (SELECT b.source, fp FROM b JOIN t USING (source) WHERE m AND fp <> '' GROUP BY b.source, fp, total HAVING count(DISTINCT doc_id) / total >= 0.02)
        SELECT doc_id, ordinal FROM b WHERE NOT (m AND EXISTS (SELECT 1 FROM r WHERE r.source = b.source AND r.fp = b.fp))""",
    ),
    "useful_content_length": (
        q_useful,
        f"""SELECT doc_id, characters, CASE WHEN characters < 100 THEN 'too_little_useful_content' WHEN characters > 20000 THEN 'too_much_useful_content' ELSE 'ok' END AS status
            FROM (SELECT doc_id, CAST(sum(length(text)) AS BIGINT) AS characters FROM {SQL_BLOCKS} WHERE {_EMPTY} GROUP BY 1)""",
    ),
    "cleaning_diff_counts": (
        q_diff,
        f"""WITH a AS (SELECT doc_id, ordinal, {_LITERAL} AS new FROM {_DEDUPED.format(f'(SELECT * FROM {SQL_BLOCKS} WHERE {_EMPTY})')})
        SELECT b.doc_id, CASE WHEN a.doc_id IS NULL THEN 'removed' WHEN a.new = b.text THEN 'unchanged' ELSE 'rewritten' END AS status, count(*) AS blocks
        FROM {SQL_BLOCKS} b LEFT JOIN a ON a.doc_id = b.doc_id AND a.ordinal = b.ordinal GROUP BY 1, 2""",
    ),
    "transform_audit": (
        q_audit,
        f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sha256(text) ORDER BY ordinal) AS nth, length(regexp_replace(text, '\\s+', '', 'g')) < 4 AS e, type IN {_SQL_PROTECTED} AS p FROM {SQL_BLOCKS})
        SELECT 'remove_empty_blocks' AS transform, count(*) FILTER (e AND NOT p) AS removed, count(*) FILTER (e AND p) AS changed_or_retained FROM b
        UNION ALL SELECT 'deduplicate_blocks', count(*) FILTER (nth > 1 AND NOT p), 0 FROM b
        UNION ALL SELECT 'remove_literals', 0, count(*) FILTER (contains(text, 'Released under the MIT License.') OR contains(text, 'Licensed under the Apache License, Version 2.0.')) FROM b""",
    ),
    "transform_audit_changes": (
        q_audit_changes,
        f"""WITH b AS (SELECT * FROM {SQL_BLOCKS}), e AS (SELECT * FROM b WHERE {_EMPTY}), d AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sha256(text) ORDER BY ordinal) > 1 AND type NOT IN {_SQL_PROTECTED} AS again FROM e)
        SELECT 'remove_empty_blocks' AS transform, doc_id, ordinal, 'removed' AS status, sha256(text) AS before, CAST(NULL AS VARCHAR) AS after FROM b WHERE NOT {_EMPTY}
        UNION ALL SELECT 'deduplicate_blocks', doc_id, ordinal, 'removed', sha256(text), NULL FROM d WHERE again
        UNION ALL SELECT 'remove_literals', doc_id, ordinal, 'rewritten', sha256(text), sha256({_LITERAL}) FROM d WHERE NOT again AND {_LITERAL} <> text""",
    ),
    "standard_clean": (
        q_standard,
        """WITH a AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents),
        c AS (SELECT doc_id, trim(regexp_replace(replace(replace(t, 'Released under the MIT License.', ' '), 'Licensed under the Apache License, Version 2.0.', ' '), '\\s+', ' ', 'g')) AS t FROM a)
        SELECT doc_id, length(t) AS n_chars, sha256(t) AS text_sha256, CASE WHEN length(t) < 100 THEN 'too_short' WHEN length(t) > 20000 THEN 'too_long' END AS violation FROM c""",
    ),
    "page_text": (
        q_page_text,
        f"SELECT doc_id, page_number, sha256(t) AS text_sha256 FROM (SELECT doc_id, ordinal // 10 + 1 AS page_number, string_agg(text, chr(10) || chr(10) ORDER BY ordinal) AS t FROM {SQL_BLOCKS} GROUP BY 1, 2)",
    ),
    "page_counts": (
        q_page_counts,
        f"SELECT doc_id, ordinal // 10 + 1 AS page_number, CAST(sum(length(text)) AS BIGINT) AS character_count, count(*) AS block_count FROM {SQL_BLOCKS} GROUP BY 1, 2",
    ),
    "utf8_text_scan": (
        q_text_scan,
        """SELECT doc_id, sha256(text) AS text_sha256, concat_ws(',', CASE WHEN contains(text, chr(0)) THEN 'nul_byte' END, CASE WHEN trim(text) = '' THEN 'blank' END,
           CASE WHEN length(text) > 20000 THEN 'too_long' END) AS violations FROM (SELECT doc_id, regexp_replace(text, '^\\x{FEFF}', '') AS text FROM documents)""",
    ),
    "canonical_block_ids": (
        q_canonical,
        f"""WITH b AS (SELECT *, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM {SQL_BLOCKS})
        SELECT left(sha256(to_json({{'doc_id': doc_id, 'ordinal': ordinal, 'text': text, 'type': type}})::VARCHAR), 32) AS block_id, doc_id, ordinal, s AS start_char, s + length(text) AS end_char FROM b""",
    ),
}
