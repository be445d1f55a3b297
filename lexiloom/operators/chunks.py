"""Chunkers with exact lineage, and statistics of chunk sizes.

Windows, spans, sections and statistics are column expressions. Packing to a byte budget depends on
what was packed before, so it runs a document at a time in ``mapInArrow``, where the document is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexiloom.operators.blocks import SQL_BLOCKS, document_blocks
from lexiloom.operators.packing import Limits, Line, page_of, path_of, sections_of
from lexiloom.session import materialize, table
from lexiloom.sources.delimited import SQL_GROUPS, SQL_TABLE_LINES

EMBED_LIMIT = 8191
PREFIX_LIMIT = 300
#: Bytes of chunks that are handed on together, and documents that are taken up together.
HELD, TAKEN = 1 << 20, 64


def windows(docs: DataFrame, size: int = 500, overlap: int = 100) -> DataFrame:
    """Character windows of each text; the last ends with the text, blank texts have none."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length("text") - size) / step), F.lit(0)) * step
    start = F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(step).cast("long")))
    rows = docs.where("trim(text) <> ''").select("doc_id", "text", start.alias("start_char"))
    end = F.least(F.col("start_char") + size, F.length("text").cast("long"))
    return rows.select(
        "doc_id", (F.col("start_char") / step).cast("long").alias("ordinal"), "start_char", end.alias("end_char"),
        F.expr(f"substring(text, cast(start_char + 1 AS int), {size})").alias("text"),
    )


def chunk_spans(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """Block and chunk offsets of every overlap; the join is on doc_id with a range condition."""
    before = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))
    b = blocks.select(F.col("doc_id").alias("b_doc"), F.col("ordinal").alias("block_ordinal"), start.cast("long").alias("b_start"), (start + F.length("text")).cast("long").alias("b_end"))
    hit = (F.col("doc_id") == F.col("b_doc")) & (F.col("b_start") < F.col("end_char")) & (F.col("b_end") > F.col("start_char"))
    low, high = F.greatest("b_start", "start_char"), F.least("b_end", "end_char")
    return chunks.join(b, hit).select(
        "doc_id", F.col("ordinal").alias("chunk_ordinal"), "block_ordinal",
        (low - F.col("b_start")).alias("block_start_char"), (high - F.col("b_start")).alias("block_end_char"),
        (low - F.col("start_char")).alias("chunk_start_char"), (high - F.col("start_char")).alias("chunk_end_char"),
    )


def common_prefix(paths: Column) -> Column:
    """Longest common prefix of an array of heading paths."""
    return F.aggregate(
        paths, F.element_at(paths, 1),
        lambda a, b: F.slice(a, F.lit(1), F.coalesce(F.array_min(F.filter(F.transform(a, lambda x, i: F.when(x.eqNullSafe(F.get(b, i)), None).otherwise(i)), lambda i: i.isNotNull())), F.size(a))),
    )


def sections(blocks: DataFrame) -> DataFrame:
    """Numbers runs of blocks with one heading path and page: a change flag and its running sum."""
    order = Window.partitionBy("doc_id").orderBy("ordinal")
    change = ~(F.col("heading").eqNullSafe(F.lag("heading").over(order)) & F.col("page").eqNullSafe(F.lag("page").over(order)))
    return blocks.withColumn("section", F.sum(F.when(change | (F.row_number().over(order) == 1), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


def embedding_text(path: Column, text: Column) -> Column:
    """``Section: a > b`` and the text; of a longer prefix the longest end within ``PREFIX_LIMIT`` bytes stays, its frame counted."""
    joined = F.array_join(path, " > ")
    room = PREFIX_LIMIT - len("Section: …\n\n".encode())
    # Characters from the end on, as long as their running sum of bytes fits.
    widths = F.transform(F.reverse(F.split(F.right(joined, F.lit(room)), "")), lambda c: F.octet_length(c))
    fits = F.aggregate(
        widths, F.struct(F.lit(0).alias("used"), F.lit(0).alias("n")),
        lambda a, w: F.struct((a["used"] + w).alias("used"), F.when(a["used"] + w <= room, a["n"] + 1).otherwise(a["n"]).alias("n")),
    )["n"]
    whole = F.octet_length(F.concat(F.lit("Section: "), joined, F.lit("\n\n"))) <= PREFIX_LIMIT
    kept = F.when(whole, joined).otherwise(F.concat(F.lit("…"), F.right(joined, fits)))
    return F.when(F.size(path) > 0, F.concat(F.lit("Section: "), kept, F.lit("\n\n"), text)).otherwise(text)


_SPANS = "array<struct<block:bigint,block_start:bigint,block_end:bigint,chunk_start:bigint,chunk_end:bigint>>"
_CHUNKS = (
    "doc_id long, ordinal long, role string, parent_ordinal long, page long, heading_path array<string>, text string, search string, token_count long, "
    f"findings array<string>, spans {_SPANS}"
)
_NAMES = ("doc_id", "ordinal", "role", "parent_ordinal", "page", "heading_path", "text", "search", "token_count", "findings", "spans")
#: What the chunkers take: a row a document with all its blocks in order.
BLOCKS = "array<struct<ordinal:bigint,text:string,path:array<string>,page:bigint,kind:string>>"


def gathered(blocks: DataFrame) -> DataFrame:
    """(doc_id, blocks) of a table of blocks (doc_id, ordinal, text, path, page, kind).

    One document is one row, as every chunker needs it. A block without a doc_id is a document of its own.
    """
    key = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    rows = blocks.select("doc_id", key.alias("lone"), F.struct("ordinal", "text", "path", "page", "kind").alias("b"))
    return rows.groupBy("doc_id", "lone").agg(F.array_sort(F.collect_list("b")).cast(BLOCKS).alias("blocks")).select("doc_id", "blocks")


def _chunked(docs: DataFrame, limits: Limits, within: Limits | None, with_rows: bool, columns=_NAMES) -> DataFrame:
    """Chunks of documents (doc_id, blocks), where the document is: nothing is shuffled. Only ``columns`` are made."""
    has = {c: c in columns for c in _NAMES}

    def chunks_of(doc_id, blocks):
        line, rows = Line(blocks), []
        waiting = line.row_passages(limits.most) if with_rows else {}

        def add(parts, role, up, search=None):
            page, text = page_of(parts) if has["page"] else None, line.text_of(parts) if has["text"] or has["search"] else None
            findings = [p.finding for p in parts if p.finding][:100] if has["findings"] else None
            path, spans = path_of(parts) if has["heading_path"] else None, line.spans(parts) if has["spans"] else None
            rows.append((doc_id, len(rows), role, up, page[0] if page else None, path, text, text if search is None else search, line.joined(parts), findings, spans))

        def add_rows(parts, up):
            """The rows whose lines start within these parts, each once."""
            for p in parts:
                mine = [x for x in waiting.get(p.block, ()) if any(s <= x[0] < e for s, e in p.ranges)]
                for place, passage, search in mine:
                    add([passage], "row", up, search)
                if mine:
                    waiting[p.block] = [x for x in waiting[p.block] if x not in mine]

        for stretches in line.chunks(sections_of(line.parts(limits.most)), within or limits):
            parts = [p for stretch in stretches for p in stretch]
            add(parts, "parent" if within else "passage", None)
            up = len(rows) - 1 if within else None
            for inner in line.chunks(stretches, limits) if within else ():
                add([p for stretch in inner for p in stretch], "child", up)
            add_rows(parts, up)
        return rows

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, types[n]) for n, c in zip(_NAMES, zip(*rows, strict=True), strict=True) if has[n]], schema=schema)

    def taken(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TAKEN):
                yield batch.slice(at, TAKEN)

    def run(batches):
        for batch in taken(batches):
            held, size = [], 0
            every = batch["blocks"].flatten()  # of all documents of the slice
            fields = [every.field(c).to_pylist() for c in ("ordinal", "text", "path", "page", "kind")]
            ends = np.cumsum(batch["blocks"].value_lengths().fill_null(0).to_numpy()).tolist()
            for doc_id, start, end in zip(batch["doc_id"].to_pylist(), [0, *ends], ends, strict=False):
                if end > start:
                    found = chunks_of(doc_id, list(zip(*(f[start:end] for f in fields), strict=True)))
                    held += found
                    size += sum(r[8] for r in found)
                if size > HELD:
                    yield packed(held)
                    held, size = [], 0
            if held:
                yield packed(held)

    text, number, words = pa.string(), pa.int64(), pa.list_(pa.string())
    spans = pa.list_(pa.struct([(c, pa.int64()) for c in ("block", "block_start", "block_end", "chunk_start", "chunk_end")]))
    types = dict(zip(_NAMES, (number, number, text, number, number, words, text, text, number, words, spans), strict=True))
    schema = pa.schema([(n, types[n]) for n in _NAMES if has[n]])
    names = [f.simpleString().split(":", 1) for f in StructType.fromDDL(_CHUNKS)]
    made = ", ".join(f"{n} {t}" for n, t in names if has[n])
    return docs.select("doc_id", F.col("blocks").cast(BLOCKS).alias("blocks")).mapInArrow(run, made)


def section_chunks(docs: DataFrame, target: int = 600, most: int = 800, overlap: int = 80, rows: bool = False) -> DataFrame:
    """Sections of documents (doc_id, blocks) packed to a byte budget with an overlap, short ones joined.

    With ``rows``, the passages of a table's rows (role ``row``) follow the chunk that holds their row; what is
    searched of them is ``search``, which is the text itself for all others.

    Every chunk says which characters of which blocks it holds (``spans``; blocks by their ordinal). Null and
    empty arrays, and blocks without text, give no chunks; repeated rows give equal chunks.
    """
    return _chunked(docs, Limits(target, most, overlap), None, rows)


def parent_child_chunks(docs: DataFrame, child=(240, 320, 40), parent=(900, 1200), rows: bool = False, columns=_NAMES) -> DataFrame:
    """Small children for search within larger parents, which answers are given.

    Blocks are cut at the children's most; parents are packed from these parts, and children from the
    stretches of sections within a parent, short ones joined as between sections. With ``rows``, the passages
    of table rows follow the children of the parent that holds them. Only ``columns`` are made.
    """
    return _chunked(docs, Limits(*child), Limits(*parent), rows, columns)


def passages_beyond(chunks: DataFrame, limit: int = EMBED_LIMIT) -> DataFrame:
    """(doc_id, passages, largest, accepted): whether an embedding model takes all passages of a document; parents are not embedded."""
    embedded = chunks.where("role <> 'parent'").select("doc_id", F.octet_length("text").cast("long").alias("b"))
    return embedded.groupBy("doc_id").agg(F.count(F.lit(1)).alias("passages"), F.max("b").alias("largest")).withColumn("accepted", F.col("largest") <= limit)


def token_distribution(chunks: DataFrame, key: str) -> DataFrame:
    """Per ``key``: least, median, discrete 95th percentile and greatest size of passages, parents, and passages cut from oversize blocks."""
    size, passage = F.when(F.col("role") != "parent", F.col("token_count")), F.col("role") != "parent"
    oversize = F.exists("findings", lambda x: x.startswith("oversize"))
    return chunks.select(key, size.alias("b"), passage.alias("passage"), oversize.alias("oversize")).groupBy(key).agg(
        F.min("b").alias("min_tokens"), F.round(F.expr("percentile(b, 0.5)"), 1).alias("median_tokens"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY b)").cast("long").alias("p95_tokens"), F.max("b").alias("max_tokens"),
        F.count_if("passage").alias("chunks"), F.count_if(~F.col("passage")).alias("parents"), F.count_if(F.col("passage") & F.col("oversize")).alias("oversize"),
    )


def row_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, row, text, limited): one passage a table row, ``column: value`` of its filled cells.

    A first row with text in its first cell only is a title; the header is then the next row that is
    half filled, with two cells at least. A later row of that kind is a label; labels in a row are one,
    and open every row up to the next. Labels that no row follows are a passage of their own.
    """
    from lexiloom.sources.delimited import bounded_grid, tables_of

    neat = F.transform("cells", lambda c: F.trim(F.regexp_replace(c, r"\s+", " ")))
    grid = bounded_grid(tables_of(docs)).select("doc_id", "row", "limited", neat.alias("cells"))
    filled = F.size(F.filter("cells", lambda c: c != ""))
    grid = grid.withColumn("alone", (F.size("cells") > 1) & (F.element_at("cells", 1) != "") & (filled == 1)).withColumn("dense", (filled >= 2) & (filled * 2 >= F.size("cells")))
    heads = grid.groupBy(F.col("doc_id").alias("h_id")).agg(
        F.max("row").alias("last"), F.max(F.when(F.col("row") == 0, F.when(F.col("alone"), F.element_at("cells", 1)).otherwise(""))).alias("title"),
        F.min(F.when((F.col("row") > 0) & F.col("dense"), F.col("row"))).alias("next"),
    )
    below = (F.col("title") != "") & (F.col("next") < F.col("last"))
    heads = heads.select("h_id", "last", F.when(below, F.col("next")).otherwise(0).alias("head"), F.when(below, F.col("title")).otherwise("").alias("title"))
    rows = grid.join(heads, F.col("doc_id") == F.col("h_id"))
    names = rows.where("row = head").select(F.col("doc_id").alias("n_id"), F.col("cells").alias("names"))
    order = Window.partitionBy("doc_id").orderBy("row")
    opens = F.col("alone") & ~F.coalesce(F.lag("alone").over(order), F.lit(False))
    body = rows.where("row > head").withColumn("run", F.sum(opens.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    labels = body.where("alone").groupBy(F.col("doc_id").alias("l_id"), F.col("run").alias("l_run")).agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("row", F.element_at("cells", 1).alias("label")))).getField("label"), " ").alias("label"),
        F.max("row").alias("at"), F.max("last").alias("l_last"), F.max("title").alias("l_title"), F.bool_or("limited").alias("l_limited"),
    )
    pairs = F.filter(F.arrays_zip(F.col("names").alias("h"), F.col("cells").alias("c")), lambda z: z["c"] != "")
    text = F.array_join(F.transform(pairs, lambda z: F.when(z["h"] != "", F.concat(z["h"], F.lit(": "), z["c"])).otherwise(z["c"])), "; ")
    opened = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(c, F.lit(". "))).otherwise("")
    plain = (
        body.where("NOT alone").join(names, F.col("doc_id") == F.col("n_id")).withColumn("text", text).where("text <> ''")
        .join(labels, (F.col("doc_id") == F.col("l_id")) & (F.col("run") == F.col("l_run")), "left")
        .select("doc_id", "row", F.concat(opened(F.col("title")), opened(F.col("label")), "text").alias("text"), "limited")
    )
    return plain.unionByName(labels.where("at = l_last").select(F.col("l_id").alias("doc_id"), F.col("at").alias("row"), F.col("label").alias("text"), F.col("l_limited").alias("limited")))


def table_and_row_passages(docs: DataFrame, budget: int = 800) -> DataFrame:
    """(doc_id, kind, ordinal, text, limited): every table in pieces, and its rows on their own beside it."""
    pieces = table_pieces(docs, budget).select("doc_id", F.lit("table").alias("kind"), F.col("piece").alias("ordinal"), "text", "limited")
    return pieces.unionByName(row_passages(docs).select("doc_id", F.lit("row").alias("kind"), F.col("row").alias("ordinal"), "text", "limited"))


def table_pieces(docs: DataFrame, budget: int = 800) -> DataFrame:
    """Tables cut into pieces under a byte budget, each with the header line again."""
    from lexiloom.sources.delimited import bounded_grid, markdown_line, row_groups, tables_of

    grid = bounded_grid(tables_of(docs))
    groups = row_groups(grid, budget).select(F.col("doc_id").alias("g_id"), F.col("group").alias("piece"), "first_row", "last_row", "limited")
    lines = grid.select("doc_id", "row", markdown_line("cells").alias("line"))
    body = lines.join(groups, (F.col("doc_id") == F.col("g_id")) & F.col("row").between(F.col("first_row"), F.col("last_row")))
    body = body.groupBy("doc_id", "piece").agg(F.array_join(F.array_sort(F.collect_list(F.struct("row", "line"))).getField("line"), "\n").alias("body"), F.bool_or("limited").alias("limited"))
    header = lines.where("row = 0").select(F.col("doc_id").alias("h_id"), F.col("line").alias("header"))
    return body.join(header, F.col("doc_id") == F.col("h_id")).select("doc_id", "piece", F.concat("header", F.lit("\n"), "body").alias("text"), "limited")


def embedding_batches(chunks: DataFrame, rows: int = 64, size: int = 192_000, shard: int = 1024) -> DataFrame:
    """Batches of at most ``rows`` chunks and ``size`` bytes; a batch always takes its first chunk.

    Ids are batched within shards of consecutive ids, so no task folds over the whole index.
    """
    shards = chunks.groupBy(F.floor(F.col("chunk_id") / shard).alias("shard")).agg(F.array_sort(F.collect_list(F.struct("chunk_id", "bytes"))).alias("r"))
    fits = f"a.n > 0 AND a.n < {rows} AND a.used + x.bytes <= {size}"
    fold = f"""aggregate(r, named_struct('n', 0, 'used', 0L, 'batch', -1, 'out', cast(array() AS array<struct<chunk_id: bigint, batch: int>>)),
      (a, x) -> CASE WHEN {fits} THEN named_struct('n', a.n + 1, 'used', a.used + x.bytes, 'batch', a.batch, 'out', array_append(a.out, named_struct('chunk_id', x.chunk_id, 'batch', a.batch)))
      ELSE named_struct('n', 1, 'used', x.bytes, 'batch', a.batch + 1, 'out', array_append(a.out, named_struct('chunk_id', x.chunk_id, 'batch', a.batch + 1))) END).out"""
    return shards.select("shard", F.explode(F.expr(fold)).alias("o")).select("o.chunk_id", "shard", F.col("o.batch").cast("long").alias("batch"))


def size_summary(chunks: DataFrame) -> DataFrame:
    """Count, upper median, min, max, short, oversize and total bytes over all chunks.

    The upper median is the smallest size that half of the chunks or more lie strictly below, read
    from a histogram of sizes, so no task gathers the sizes.
    """
    sizes = chunks.select(F.octet_length("text").cast("long").alias("b"))
    histogram = sizes.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    running = F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    median = histogram.withColumn("cum", running).withColumn("total", total).where(F.col("cum") > F.floor(F.col("total") / 2)).agg(F.min("b").alias("median_bytes"))
    rest = histogram.agg(
        F.sum("n").alias("count"), F.min("b").alias("min_bytes"), F.max("b").alias("max_bytes"),
        F.sum(F.when(F.col("b") < 40, F.col("n")).otherwise(0)).alias("under_40"),
        F.sum(F.when(F.col("b") > EMBED_LIMIT, F.col("n")).otherwise(0)).alias("over_limit"), F.sum(F.col("b") * F.col("n")).alias("total_bytes"),
    )
    return rest.join(F.broadcast(median))


def q_windows(spark, sf):
    return windows(table(spark, sf, "documents")).select("doc_id", "ordinal", "start_char", "end_char", F.sha2("text", 256).alias("text_sha256"))


def q_spans(spark, sf):
    return chunk_spans(document_blocks(spark, sf), windows(table(spark, sf, "documents")))


def _with_heading(spark, sf):
    """The last heading-like line (first line, or one under 40 characters ending in a stop) is the heading."""
    head = F.when((F.col("ordinal") == 0) | ((F.length("text") < 40) & F.col("text").endswith(".")), F.col("text"))
    upto = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return document_blocks(spark, sf).withColumn("heading", F.last(head, True).over(upto)).withColumn("page", F.expr("ordinal div 10"))


def q_sections(spark, sf):
    found = sections(_with_heading(spark, sf)).groupBy("doc_id", "section")
    return found.agg(F.min("ordinal").alias("first_block"), F.count(F.lit(1)).alias("blocks"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))


def _let(value: str, name: str, body: str) -> str:
    """SQL in which ``name`` stands for a value that is computed once, also within lambdas."""
    return f"transform(array({value}), {name} -> {body})[0]"


def with_blocks(docs: DataFrame) -> DataFrame:
    """Documents with their lines as blocks: a heading-like line opens a section, ten lines are a page.

    The lines between two headings are sliced at once, so the cost follows the number of lines.
    """
    heads = "filter(sequence(0, size(lines) - 1), i -> i = 0 OR (length(lines[i]) < 40 AND endswith(lines[i], '.')))"
    kind = "CASE WHEN h + k = 0 THEN 'heading' WHEN contains(x, ' | ') THEN 'table' WHEN startswith(x, '- ') THEN 'list_item' ELSE 'paragraph' END"
    block = f"named_struct('ordinal', cast(h + k AS bigint), 'text', x, 'path', array(lines[h]), 'page', cast((h + k) div 10 AS bigint), 'kind', {kind})"
    stretch = f"transform(slice(lines, h + 1, coalesce(get(heads, j + 1), size(lines)) - h), (x, k) -> {block})"
    found = _let("split(text, '\\n')", "lines", _let(heads, "heads", f"flatten(transform(heads, (h, j) -> {stretch}))"))
    return docs.where("text IS NOT NULL").withColumn("blocks", F.expr(found))


def _chunk_rows(chunks: DataFrame) -> DataFrame:
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["block"], x["block_start"], x["block_end"], x["chunk_start"], x["chunk_end"])), ",")
    return chunks.select("doc_id", "ordinal", "role", "parent_ordinal", "page", F.array_join("heading_path", " > ").alias("path"), "token_count", F.sha2("text", 256).alias("text_sha256"), F.sha2(spans, 256).alias("spans_sha256"))


def q_section_chunks(spark, sf):
    return _chunk_rows(section_chunks(with_blocks(table(spark, sf, "documents"))))


def _with_tables(spark, sf):
    """Documents as a heading and a table: words of their lines as cells of three columns, with a title and label rows."""
    cells = lambda x, i: F.when(i == 0, F.concat(F.element_at(x, 1), F.lit(" |  | "))).when(i % 6 == 3, F.concat(F.element_at(x, 1), F.lit(" |  | "))).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.coalesce(F.get(x, k - 1), F.lit(""))), " | "))
    lines = F.transform(F.split("text", "\n"), lambda line: F.slice(F.split(line, " "), 1, 3))
    body = F.array_join(F.transform(lines, cells), "\n")
    block = lambda n, text, kind: F.struct(F.lit(n).cast("long").alias("ordinal"), text.alias("text"), F.array("source").alias("path"), F.lit(None).cast("long").alias("page"), F.lit(kind).alias("kind"))
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.array(block(0, F.col("source"), "heading"), block(1, body, "table")).alias("blocks"))


def q_row_chunks(spark, sf):
    """Chunks of tables with the passages of their rows behind them, in the document's order."""
    found = section_chunks(_with_tables(spark, sf), rows=True)
    return found.select("doc_id", "ordinal", "role", "token_count", F.sha2("text", 256).alias("text_sha256"), F.sha2("search", 256).alias("search_sha256"))


def q_parent_child(spark, sf):
    columns = ("doc_id", "ordinal", "role", "parent_ordinal", "page", "heading_path", "token_count", "text", "spans")
    return _chunk_rows(parent_child_chunks(with_blocks(table(spark, sf, "documents")), columns=columns))


def q_parent_text(spark, sf):
    """Every child with its parent's size: a self join on (doc_id, parent ordinal) of chunks that are made once, without their texts."""
    sizes = ("doc_id", "ordinal", "role", "parent_ordinal", "token_count")
    chunks = materialize(parent_child_chunks(with_blocks(table(spark, sf, "documents")), columns=sizes), "chunks")
    parents = chunks.where("role = 'parent'").select(F.col("doc_id").alias("p_doc"), F.col("ordinal").alias("p"), F.col("token_count").alias("parent_tokens"))
    children = chunks.where("role = 'child'")
    return children.join(parents, (F.col("doc_id") == F.col("p_doc")) & (F.col("parent_ordinal") == F.col("p")), "left").select("doc_id", "ordinal", "token_count", "parent_tokens")


def q_passage_gate(spark, sf):
    """Documents with a passage of more bytes than an embedding model takes; children stand for their parents."""
    return passages_beyond(parent_child_chunks(with_blocks(table(spark, sf, "documents")), columns=("doc_id", "role", "text")))


def q_passage_tokens(spark, sf):
    """Sizes of the children and numbers of parents, by source."""
    docs = with_blocks(table(spark, sf, "documents"))
    source = docs.select(F.col("doc_id").alias("d"), "source")
    return token_distribution(parent_child_chunks(docs).join(source, F.col("doc_id") == F.col("d")), "source")


def q_embed_gate(spark, sf):
    """Documents with a passage that an embedding model would not take."""
    return document_blocks(spark, sf).groupBy("doc_id").agg(F.max(F.octet_length("text")).cast("long").alias("largest")).withColumn("accepted", F.col("largest") <= EMBED_LIMIT)


def q_summary(spark, sf):
    return size_summary(windows(table(spark, sf, "documents")))


def q_tokens(spark, sf):
    """Per source: least, median, discrete 95th percentile and greatest bytes of its windows."""
    rows = windows(table(spark, sf, "documents")).join(table(spark, sf, "documents").select(F.col("doc_id").alias("d"), "source"), F.col("doc_id") == F.col("d"))
    sized = rows.select("source", F.octet_length("text").cast("long").alias("b"))
    return sized.groupBy("source").agg(
        F.min("b").alias("min_tokens"), F.round(F.expr("percentile(b, 0.5)"), 1).alias("median_tokens"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY b)").cast("long").alias("p95_tokens"), F.max("b").alias("max_tokens"), F.count(F.lit(1)).alias("chunks"),
    )


def q_bytes(spark, sf):
    """Byte length and the longest prefix and suffix of 100 bytes that cut no character."""
    text = F.col("text")
    widths = F.transform(F.split(F.substring(text, 1, 100), ""), lambda c: F.octet_length(c))
    fits = F.aggregate(widths, F.struct(F.lit(0).alias("used"), F.lit(0).alias("n")), lambda a, w: F.when(a["used"] + w <= 100, F.struct((a["used"] + w).alias("used"), (a["n"] + 1).alias("n"))).otherwise(F.struct(F.lit(1000).alias("used"), a["n"].alias("n"))))
    return table(spark, sf, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), fits["n"].cast("long").alias("prefix_chars"))


def q_common_prefix(spark, sf):
    """The common start of the word paths of the first two lines of each document."""
    lines = F.slice(F.split("text", "\n"), 1, 2)
    paths = F.transform(lines, lambda line: F.split(line, " "))
    return table(spark, sf, "documents").select("doc_id", F.array_join(common_prefix(paths), " ").alias("shared"))


def q_embedding_text(spark, sf):
    lines = F.split("text", "\n")
    docs = table(spark, sf, "documents").select("doc_id", "text", F.array("source", "lang", F.element_at(lines, 1)).alias("path"))
    return docs.select("doc_id", F.sha2(embedding_text(F.col("path"), F.col("text")), 256).alias("text_sha256"))


def _labelled_tables(spark, sf):
    """Documents whose texts start with a table: words of their lines as cells, with a title, a header and label rows."""
    line = lambda x, i: F.when(i % 5 == 0, F.concat(F.element_at(F.split(x, " "), 1), F.lit(" |  | "))).otherwise(F.array_join(F.slice(F.split(x, " "), 1, i % 3 + 2), " | "))
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


def q_row_passages(spark, sf):
    return row_passages(_labelled_tables(spark, sf)).select("doc_id", "row", F.sha2("text", 256).alias("text_sha256"), "limited")


def q_table_pieces(spark, sf):
    return table_pieces(table(spark, sf, "documents")).select("doc_id", "piece", F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("text_sha256"), "limited")


def q_table_and_rows(spark, sf):
    found = table_and_row_passages(table(spark, sf, "documents"))
    return found.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("passages"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))


def q_embedding_batches(spark, sf):
    chunks = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.octet_length("text").cast("long").alias("bytes"))
    return embedding_batches(chunks, 16, 40_000)


_WIN = """(SELECT doc_id, start_char, least(start_char + 500, n) AS end_char, start_char // 400 AS ordinal, substr(text, start_char + 1, 500) AS text
  FROM (SELECT doc_id, text, length(text) AS n, unnest(range(0, CAST(greatest(ceil((length(text) - 500) / 400), 0) * 400 AS BIGINT) + 1, 400)) AS start_char FROM documents WHERE trim(text) <> ''))"""
_HEAD = f"""(SELECT *, last_value(CASE WHEN ordinal = 0 OR (length(text) < 40 AND ends_with(text, '.')) THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading, ordinal // 10 AS page FROM {SQL_BLOCKS})"""
_PIECES = f"""(SELECT p.doc_id, g AS piece, h.line || chr(10) || string_agg(l.line, chr(10) ORDER BY l.row) AS text FROM ({SQL_GROUPS}) p JOIN {SQL_TABLE_LINES} l ON l.doc_id = p.doc_id AND l.row = p.row
  JOIN {SQL_TABLE_LINES} h ON h.doc_id = p.doc_id AND h.row = 0 GROUP BY p.doc_id, g, h.line)"""
_LABELLED = """(SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 5 = 0 THEN string_split(x, ' ')[1] || ' |  | ' ELSE array_to_string(string_split(x, ' ')[1:(i - 1) % 3 + 2], ' | ') END), chr(10)) AS text FROM documents)"""
_ROW_PASSAGES = """(WITH l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS row, string_split(t, ' | ') AS c FROM (SELECT doc_id, unnest(range(len(l))) AS n, unnest(l) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {docs})) WHERE contains(t, ' | ')),
  g AS (SELECT doc_id, row, list_transform(list_resize(c, max(len(c)) OVER (PARTITION BY doc_id), ''), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS c FROM l),
  f AS (SELECT *, len(list_filter(c, lambda x: x <> '')) AS n FROM g), k AS (SELECT *, len(c) > 1 AND c[1] <> '' AND n = 1 AS alone, n >= 2 AND n * 2 >= len(c) AS dense FROM f),
  h0 AS (SELECT doc_id, max(row) AS last, max(CASE WHEN row = 0 AND alone THEN c[1] ELSE '' END) AS title, min(row) FILTER (row > 0 AND dense) AS nxt FROM k GROUP BY 1),
  h AS (SELECT doc_id, last, CASE WHEN title <> '' AND nxt < last THEN nxt ELSE 0 END AS head, CASE WHEN title <> '' AND nxt < last THEN title ELSE '' END AS title FROM h0),
  o AS (SELECT k.*, last, head, title, CASE WHEN alone AND NOT coalesce(lag(alone) OVER (PARTITION BY k.doc_id ORDER BY row), false) THEN 1 ELSE 0 END AS opens FROM k JOIN h ON h.doc_id = k.doc_id WHERE row > head),
  b AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY row) AS run FROM o),
  t AS (SELECT doc_id, run, string_agg(c[1], ' ' ORDER BY row) AS label, max(row) AS ending, max(last) AS last FROM b WHERE alone GROUP BY 1, 2),
  p AS (SELECT b.doc_id, b.row, b.run, b.title, array_to_string([CASE WHEN n.c[i] <> '' THEN n.c[i] || ': ' || b.c[i] ELSE b.c[i] END FOR i IN range(1, len(b.c) + 1) IF b.c[i] <> ''], '; ') AS text FROM b JOIN k n ON n.doc_id = b.doc_id AND n.row = b.head WHERE NOT b.alone)
  SELECT p.doc_id, p.row, CASE WHEN title <> '' THEN title || '. ' ELSE '' END || CASE WHEN label <> '' THEN label || '. ' ELSE '' END || text AS text FROM p LEFT JOIN t ON t.doc_id = p.doc_id AND t.run = p.run WHERE text <> ''
  UNION ALL SELECT doc_id, ending, label FROM t WHERE ending = last)"""

QUERIES = {
    "character_windows": (q_windows, f"SELECT doc_id, ordinal, start_char, end_char, sha256(text) AS text_sha256 FROM {_WIN}"),
    "chunk_block_spans": (
        q_spans,
        f"""WITH b AS (SELECT doc_id, ordinal, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s, length(text) AS n FROM {SQL_BLOCKS})
        SELECT c.doc_id, c.ordinal AS chunk_ordinal, b.ordinal AS block_ordinal, greatest(s, start_char) - s AS block_start_char, least(s + n, end_char) - s AS block_end_char,
        greatest(s, start_char) - start_char AS chunk_start_char, least(s + n, end_char) - start_char AS chunk_end_char FROM {_WIN} c JOIN b ON b.doc_id = c.doc_id AND s < end_char AND s + n > start_char""",
    ),
    "block_sections": (
        q_sections,
        f"""WITH f AS (SELECT *, CASE WHEN heading IS NOT DISTINCT FROM lag(heading) OVER w AND page IS NOT DISTINCT FROM lag(page) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c FROM {_HEAD} WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)),
        s AS (SELECT *, CAST(sum(c) OVER (PARTITION BY doc_id ORDER BY ordinal) AS BIGINT) AS section FROM f)
        SELECT doc_id, section, min(ordinal) AS first_block, count(*) AS blocks, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM s GROUP BY 1, 2""",
    ),
    "section_token_chunks": (q_section_chunks, None),
    "parent_child_chunks": (q_parent_child, None),
    "chunks_with_row_passages": (q_row_chunks, None),
    "child_parent_lookup": (q_parent_text, None),
    "passage_size_gate": (q_passage_gate, None),
    "passage_token_distribution": (q_passage_tokens, None),
    "table_row_passages": (q_row_passages, f"SELECT doc_id, row, sha256(text) AS text_sha256, false AS limited FROM {_ROW_PASSAGES.format(docs=_LABELLED)}"),
    "table_pieces": (q_table_pieces, f"SELECT doc_id, piece, strlen(text) AS bytes, sha256(text) AS text_sha256, false AS limited FROM {_PIECES}"),
    "table_and_row_passages": (
        q_table_and_rows,
        f"""SELECT doc_id, kind, count(*) AS passages, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM (SELECT doc_id, 'table' AS kind, text FROM {_PIECES} UNION ALL SELECT doc_id, 'row', text FROM {_ROW_PASSAGES.format(docs='documents')}) GROUP BY 1, 2""",
    ),
    "embedding_batches": (
        q_embedding_batches,
        """WITH RECURSIVE t AS (SELECT doc_id, doc_id // 1024 AS shard, strlen(text) AS b, row_number() OVER (PARTITION BY doc_id // 1024 ORDER BY doc_id) AS n FROM documents),
        w AS (SELECT doc_id, shard, n, 1 AS k, b AS used, 0 AS batch FROM t WHERE n = 1 UNION ALL
          SELECT t.doc_id, t.shard, t.n, CASE WHEN k < 16 AND used + b <= 40000 THEN k + 1 ELSE 1 END, CASE WHEN k < 16 AND used + b <= 40000 THEN used + b ELSE b END, CASE WHEN k < 16 AND used + b <= 40000 THEN batch ELSE batch + 1 END
          FROM w JOIN t ON t.shard = w.shard AND t.n = w.n + 1) SELECT doc_id AS chunk_id, shard, batch FROM w""",
    ),
    "embed_size_gate": (q_embed_gate, f"SELECT doc_id, max(strlen(text)) AS largest, max(strlen(text)) <= 8191 AS accepted FROM {SQL_BLOCKS} GROUP BY 1"),
    "chunk_size_summary": (
        q_summary,
        f"""SELECT count(*) AS count, min(b) AS min_bytes, max(b) AS max_bytes, count(*) FILTER (b < 40) AS under_40, count(*) FILTER (b > 8191) AS over_limit, CAST(sum(b) AS BIGINT) AS total_bytes,
        list_sort(list(b))[count(*) // 2 + 1] AS median_bytes FROM (SELECT strlen(text) AS b FROM {_WIN})""",
    ),
    "token_distribution": (
        q_tokens,
        f"""SELECT source, min(b) AS min_tokens, round(quantile_cont(b, 0.5), 1) AS median_tokens, quantile_disc(b, 0.95) AS p95_tokens, max(b) AS max_tokens, count(*) AS chunks
        FROM (SELECT source, strlen(w.text) AS b FROM {_WIN} w JOIN documents d ON d.doc_id = w.doc_id) GROUP BY 1""",
    ),
    "utf8_byte_budget": (
        q_bytes,
        "SELECT doc_id, strlen(text) AS n_bytes, (SELECT max(i) FROM (SELECT unnest(range(0, least(100, length(text)) + 1)) AS i) WHERE strlen(left(text, i)) <= 100) AS prefix_chars FROM documents",
    ),
    "common_heading_prefix": (
        q_common_prefix,
        """WITH p AS (SELECT doc_id, string_split(string_split(text, chr(10))[1], ' ') AS a, string_split(string_split(text, chr(10))[2], ' ') AS b FROM documents)
        SELECT doc_id, array_to_string(CASE WHEN b IS NULL THEN a ELSE a[1:coalesce(list_min([i FOR i IN range(1, len(a) + 1) IF a[i] IS DISTINCT FROM b[i]]) - 1, len(a))] END, ' ') AS shared FROM p""",
    ),
    "embedding_text_prefix": (
        q_embedding_text,
        """WITH p AS (SELECT doc_id, text, concat(source, ' > ', lang, ' > ', string_split(text, chr(10))[1]) AS j FROM documents),
        c AS (SELECT *, CASE WHEN strlen(j) + 11 > 300 THEN list_max([i FOR i IN range(1, 287) IF strlen(right(j, i)) <= 286]) END AS n FROM p)
        SELECT doc_id, sha256('Section: ' || CASE WHEN n IS NULL THEN j ELSE '…' || right(j, n) END || chr(10) || chr(10) || text) AS text_sha256 FROM c""",
    ),
}
