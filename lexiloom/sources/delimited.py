"""Delimited text, table grids and renderings, dataset preview, and export."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.session import table

MAX_ROWS, MAX_COLUMNS, MAX_CELLS = 100_000, 1_000, 1_000_000


def read_delimited(spark, path: str, sep: str = ",", header: bool = True) -> DataFrame:
    """A delimited file, strictly: a malformed row fails the read; no schema is inferred."""
    return spark.read.csv(path, sep=sep, header=header, mode="FAILFAST", inferSchema=False, multiLine=True, escape='"')


def tables_of(docs: DataFrame, separator: str = " | ") -> DataFrame:
    """Rows of cells of the lines that hold the separator; (doc_id, row, cells)."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).where(F.col("text").contains(separator))
    order = Window.partitionBy("doc_id").orderBy("line")
    return lines.select("doc_id", (F.row_number().over(order) - 1).cast("long").alias("row"), F.split("text", r" \| ").alias("cells"))


def scan_tables(rows: DataFrame) -> DataFrame:
    """Rows, width, cells and what a strict reading refuses of each table: its limits, or rows of unequal width."""
    sizes = rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("rows"), F.min(F.size("cells")).alias("least"), F.max(F.size("cells")).cast("long").alias("width"), F.sum(F.size("cells")).cast("long").alias("cells")
    )
    over = (F.col("rows") > MAX_ROWS) | (F.col("width") > MAX_COLUMNS) | (F.col("cells") > MAX_CELLS)
    violation = F.when(over, "table_limit").when(F.col("least") < F.col("width"), "malformed_table")
    return sizes.select("doc_id", "rows", "width", "cells", violation.alias("violation"))


def bounded_grid(rows: DataFrame, max_rows: int = MAX_ROWS, max_columns: int = MAX_COLUMNS, max_cell: int = 2000) -> DataFrame:
    """Rows cut to the limits and padded to their table's width, and whether the limits cut the table."""
    whole = Window.partitionBy("doc_id")
    over = (F.col("row") >= max_rows) | (F.size("cells") > max_columns) | F.exists("cells", lambda c: F.length(c) > max_cell)
    cut = rows.withColumn("limited", F.max(over).over(whole)).where(F.col("row") < max_rows)
    cut = cut.withColumn("cells", F.transform(F.slice("cells", 1, max_columns), lambda c: F.coalesce(F.substring(c, 1, max_cell), F.lit(""))))
    width = F.max(F.size("cells")).over(whole)
    return cut.withColumn("width", width).withColumn("cells", F.concat("cells", F.array_repeat(F.lit(""), F.col("width") - F.size("cells"))))


def markdown_line(cells):
    clean = F.transform(cells, lambda c: F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))
    return F.concat(F.lit("| "), F.array_join(clean, " | "), F.lit(" |"))


def plain_line(cells):
    return F.array_join(F.transform(cells, lambda c: F.replace(F.replace(c, F.lit("\t"), F.lit(" ")), F.lit("\n"), F.lit(" "))), "\t")


def render(grid: DataFrame) -> DataFrame:
    """One Markdown and one tab-separated rendering a table; its first row is the header. ``limited``: the grid lost cells."""
    rows = grid.select("doc_id", "row", "width", "limited", markdown_line("cells").alias("m"), plain_line("cells").alias("p"))
    lines = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("row", "m", "p"))).alias("r"), F.max("width").alias("width"), F.bool_or("limited").alias("limited"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("width")), " | "), F.lit(" |"))
    markdown = F.array_join(F.concat(F.array(F.col("r.m")[0], rule), F.slice("r.m", 2, 2**31 - 1)), "\n")
    return lines.select("doc_id", markdown.alias("markdown"), F.array_join("r.p", "\n").alias("plain"), "limited")


def row_groups(grid: DataFrame, budget: int = 15_500) -> DataFrame:
    """Groups of rows whose rendering with the repeated header fits the byte budget, in order.

    A group closes when the next row would overflow it; the fold runs over row sizes, not texts.
    """
    sized = grid.where("row > 0").select("doc_id", "row", F.octet_length(markdown_line("cells")).alias("b"))
    head = grid.where("row = 0").select(F.col("doc_id").alias("h_id"), "limited", (F.octet_length(markdown_line("cells")) * 2 + 2).alias("h"))
    rows = sized.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("row", "b"))).alias("r")).join(head, F.col("doc_id") == F.col("h_id"))
    step = "(a, x) -> CASE WHEN a.used > 0 AND h + a.used + x.b + 1 > {b} THEN named_struct('used', x.b + 1, 'g', a.g + 1, 'out', array_append(a.out, named_struct('row', x.row, 'g', a.g + 1))) ELSE named_struct('used', a.used + x.b + 1, 'g', a.g, 'out', array_append(a.out, named_struct('row', x.row, 'g', a.g))) END"
    folded = rows.withColumn("f", F.expr(f"aggregate(r, named_struct('used', 0, 'g', 0, 'out', cast(array() AS array<struct<row: bigint, g: int>>)), {step.format(b=budget)})"))
    rows = folded.select("doc_id", "limited", F.explode("f.out").alias("o"))
    return rows.groupBy("doc_id", F.col("o.g").cast("long").alias("group")).agg(F.min("o.row").alias("first_row"), F.max("o.row").alias("last_row"), F.bool_or("limited").alias("limited"))


def header_error(header: list[str]) -> str | None:
    """Why a dataset's header is not one of the three allowed forms."""
    allowed = (["question"], ["question", "reference_answer"], ["reference_answer", "question"])
    return None if list(header) in allowed else "header"


def read_dataset(spark, path: str) -> DataFrame:
    """Rows of a dataset file, numbered from its second line, for :func:`preview_dataset`; a bad header raises."""
    raw = read_delimited(spark, path)
    if header_error(raw.columns):
        raise ValueError("use question (required) and reference_answer (optional) as headers")
    rows = raw if "reference_answer" in raw.columns else raw.withColumn("reference_answer", F.lit(None).cast("string"))
    order = Window.orderBy(F.monotonically_increasing_id())  # one file of a dataset of questions, not a corpus
    return rows.withColumn("row", (F.row_number().over(order) + 1).cast("long"))


def preview_dataset(rows: DataFrame) -> DataFrame:
    """Trimmed questions with row-numbered errors; (row, question, reference_answer)."""
    q, a = F.trim(F.coalesce("question", F.lit(""))), F.trim(F.coalesce("reference_answer", F.lit("")))
    errors = F.array_compact(F.array(F.when((q == "") | (F.length(q) > 4000), "question_length"), F.when(F.length(a) > 12000, "answer_length")))
    return rows.select("row", q.alias("question"), F.nullif(a, F.lit("")).alias("reference_answer"), F.array_join(errors, ",").alias("errors"))


def safe_cell(value):
    """A cell that no spreadsheet takes for a formula."""
    risky = F.ltrim(value).rlike(r"^\s*[=+\-@]") | value.rlike(r"^[\t\r\n]")
    return F.when(value.isNull(), "").when(risky, F.concat(F.lit("'"), value)).otherwise(value)


def export_csv(df: DataFrame, path: str) -> None:
    """Writes every column as a guarded string."""
    df.select(*[safe_cell(F.col(c).cast("string")).alias(c) for c in df.columns]).write.csv(path, header=True, escape='"')


def publish_index(members: DataFrame, path: str) -> None:
    """Immutable membership, one directory an index, so that searches prune to one."""
    members.write.mode("errorifexists").partitionBy("index_id").parquet(path)


def q_grid(spark, sf):
    grid = bounded_grid(tables_of(table(spark, sf, "documents")))
    return grid.select("doc_id", "row", "width", "limited", F.sha2(F.array_join("cells", "\t"), 256).alias("cells_sha256"))


def q_render(spark, sf):
    out = render(bounded_grid(tables_of(table(spark, sf, "documents"))))
    return out.select("doc_id", F.sha2("markdown", 256).alias("markdown_sha256"), F.sha2("plain", 256).alias("plain_sha256"), "limited")


def q_scan(spark, sf):
    return scan_tables(tables_of(table(spark, sf, "documents")))


def q_groups(spark, sf):
    return row_groups(bounded_grid(tables_of(table(spark, sf, "documents"))), budget=800)


def q_preview(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("row"), F.col("text").alias("question"), F.when(F.col("lang") == "en", F.repeat("text", 3)).alias("reference_answer"))
    return preview_dataset(rows).select("row", F.length("question").cast("long").alias("question_chars"), F.length("reference_answer").cast("long").alias("answer_chars"), "errors")


def q_safe(spark, sf):
    value = F.concat(F.element_at(F.array(F.lit(""), F.lit("="), F.lit(" +"), F.lit("\t"), F.lit("-")), (F.col("doc_id") % 5 + 1).cast("int")), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", safe_cell(value).alias("cell"))


_LINES = "(SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS row, string_split(t, ' | ') AS cells FROM (SELECT doc_id, unnest(range(len(l))) AS n, unnest(l) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE contains(t, ' | '))"
_LINE = "'| ' || array_to_string(list_transform(cells, lambda c: replace(replace(c, chr(92), chr(92) || chr(92)), '|', chr(92) || '|')), ' | ') || ' |'"
SQL_TABLE_LINES = f"""(SELECT doc_id, row, {_LINE} AS line FROM (SELECT doc_id, row, list_resize(cells, max(len(cells)) OVER (PARTITION BY doc_id), '') AS cells FROM {_LINES}))"""
#: The group of every data row, under a budget of 800 bytes.
SQL_GROUPS = f"""WITH RECURSIVE l AS (SELECT doc_id, row, strlen(line) AS b FROM {SQL_TABLE_LINES}), h AS (SELECT doc_id, 2 * b + 2 AS h FROM l WHERE row = 0),
  w AS (SELECT doc_id, row, b + 1 AS used, 0 AS g FROM l WHERE row = 1 UNION ALL
    SELECT l.doc_id, l.row, CASE WHEN h + used + b + 1 > 800 THEN b + 1 ELSE used + b + 1 END, CASE WHEN h + used + b + 1 > 800 THEN g + 1 ELSE g END FROM w JOIN l ON l.doc_id = w.doc_id AND l.row = w.row + 1 JOIN h ON h.doc_id = w.doc_id)
  SELECT doc_id, row, g FROM w"""

QUERIES = {
    "table_grids": (
        q_grid,
        f"""WITH l AS (SELECT *, max((row >= 100000 OR len(cells) > 1000 OR len(list_filter(cells, lambda c: length(c) > 2000)) > 0)) OVER (PARTITION BY doc_id) AS limited FROM {_LINES}),
        c AS (SELECT doc_id, row, limited, list_transform(cells[1:1000], lambda c: left(c, 2000)) AS cells FROM l WHERE row < 100000), w AS (SELECT *, max(len(cells)) OVER (PARTITION BY doc_id) AS width FROM c)
        SELECT doc_id, row, width, limited, sha256(array_to_string(list_resize(cells, width, ''), chr(9))) AS cells_sha256 FROM w""",
    ),
    "table_renderings": (
        q_render,
        f"""WITH w AS (SELECT *, max(len(cells)) OVER (PARTITION BY doc_id) AS width FROM {_LINES}), g AS (SELECT doc_id, row, width, list_resize(cells, width, '') AS cells FROM w),
        r AS (SELECT doc_id, row, width, '| ' || array_to_string(list_transform(cells, lambda c: replace(replace(c, chr(92), chr(92) || chr(92)), '|', chr(92) || '|')), ' | ') || ' |' AS m, array_to_string(cells, chr(9)) AS p FROM g)
        SELECT doc_id, sha256(string_agg(CASE WHEN row = 0 THEN m || chr(10) || '| ' || array_to_string(list_resize(['---'], width, '---'), ' | ') || ' |' ELSE m END, chr(10) ORDER BY row)) AS markdown_sha256, sha256(string_agg(p, chr(10) ORDER BY row)) AS plain_sha256, false AS limited FROM r GROUP BY 1""",
    ),
    "table_scan": (
        q_scan,
        f"""SELECT doc_id, count(*) AS rows, CAST(max(len(cells)) AS BIGINT) AS width, CAST(sum(len(cells)) AS BIGINT) AS cells,
        CASE WHEN count(*) > 100000 OR max(len(cells)) > 1000 OR sum(len(cells)) > 1000000 THEN 'table_limit' WHEN min(len(cells)) < max(len(cells)) THEN 'malformed_table' END AS violation FROM {_LINES} GROUP BY 1""",
    ),
    "table_row_groups": (q_groups, f"SELECT doc_id, g AS \"group\", min(row) AS first_row, max(row) AS last_row, false AS limited FROM ({SQL_GROUPS}) GROUP BY 1, 2"),
    "dataset_preview": (
        q_preview,
        """WITH p AS (SELECT doc_id AS row, trim(text) AS q, nullif(trim(coalesce(CASE WHEN lang = 'en' THEN text || text || text END, '')), '') AS a FROM documents)
        SELECT row, length(q) AS question_chars, length(a) AS answer_chars, concat_ws(',', CASE WHEN q = '' OR length(q) > 4000 THEN 'question_length' END, CASE WHEN length(a) > 12000 THEN 'answer_length' END) AS errors FROM p""",
    ),
    "csv_safe_cells": (q_safe, "WITH v AS (SELECT doc_id, (['', '=', ' +', chr(9), '-'])[doc_id % 5 + 1] || text AS v FROM documents) SELECT doc_id, CASE WHEN regexp_matches(v, '^\\s*[=+\\-@]') OR regexp_matches(v, '^[\\t\\r\\n]') THEN '''' || v ELSE v END AS cell FROM v"),
}
