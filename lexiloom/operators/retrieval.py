"""Vector, keyword and BM25 search, rank fusion, reranking, context packing and citation checks.

Queries are a stated set; they meet the corpus through equi-joins on terms or as a small side of a
checked size, never as pairs of all rows with all rows. Every ranking ends in a unique key.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial
from heapq import nsmallest

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.operators.dedup import folded
from lexiloom.operators.nearest import vector_topk
from lexiloom.operators.search import bm25, cover_density, keyword_matches, keyword_search, match_all
from lexiloom.operators.words import Cutter, leading, tokens, word_ranges
from lexiloom.session import materialize, table

RRF = 60
#: Searches take as queries every row whose id is divisible by this.
QUERY_STEP = 20
#: Centroids that are sent to the executors at a time.
CENTROIDS = 1000


@dataclass(frozen=True)
class Settings:
    """Retrieval settings within their ranges; anything else is refused."""

    mode: str = "hybrid"
    top_k: int = 5
    candidates: int = 50
    vector_weight: float = 0.5
    maximum_distance: float | None = None

    def __post_init__(self):
        bad = [
            name for name, ok in (
                ("mode", self.mode in ("vector", "keyword", "hybrid")), ("top_k", 1 <= self.top_k <= 50), ("candidates", self.top_k <= self.candidates <= 200),
                ("vector_weight", 0 <= self.vector_weight <= 1), ("maximum_distance", self.maximum_distance is None or 0 <= self.maximum_distance <= 2),
            ) if not ok
        ]
        if bad:
            raise ValueError(f"out of range: {', '.join(bad)}")


def doubles(v) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def validate_vectors(df: DataFrame, dims: int = 64) -> DataFrame:
    """Violations of a vector: size, finiteness, range, all zero."""
    v = doubles("embedding")
    bad = F.array_compact(F.array(
        F.when(F.size("embedding") != dims, "dimensions"),
        F.when(F.exists(v, lambda x: F.isnan(x) | (F.abs(x) > 3.4e38)), "not_finite"),
        F.when(F.forall(v, lambda x: F.abs(x) < 1.17e-38), "all_zero"),
    ))
    return df.withColumn("violations", bad)


def web_search(text: Column, query: str) -> Column:
    """Does a text match a web-style query: words are ANDed, ``or`` alternates, ``-`` excludes, quotes are phrases?

    Phrases match by position: their tokens follow each other.
    """
    import re

    joined = F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))
    alternatives, clause = [], F.lit(True)
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        if not minus and word.lower() == "or":
            alternatives.append(clause)
            clause = F.lit(True)
            continue
        found = re.findall(r"[^\W_]+", (phrase or word).lower().replace("ß", "ss"))
        if found:
            has = joined.contains(" " + " ".join(found) + " ")
            clause = clause & (~has if minus else has)
    for other in alternatives:
        clause = other | clause
    return clause


def fuse(left: DataFrame, right: DataFrame, weight: float = 0.5, k: int = 10) -> DataFrame:
    """Weighted reciprocal-rank fusion of two rankings (query_id, item, rank): sum of w / (60 + rank).

    A branch of weight zero is left out.
    """
    a = left.select("query_id", "item", F.col("rank").alias("vector_rank")).where(F.lit(weight > 0))
    b = right.select("query_id", "item", F.col("rank").alias("keyword_rank")).where(F.lit(weight < 1))
    part = lambda w, r: F.coalesce(F.lit(w) / (RRF + F.col(r)), F.lit(0.0))
    both = a.join(b, ["query_id", "item"], "full_outer").withColumn("score", F.round(part(weight, "vector_rank") + part(1 - weight, "keyword_rank"), 9))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k)


def parse_order(reply, n) -> Column:
    """Distinct in-range numbers of a reply, in its order."""
    numbers = F.transform(F.regexp_extract_all(reply, F.lit(r"(\d+)"), 1), lambda s: F.when(F.length(s) < 9, s.cast("int")))
    return F.array_distinct(F.filter(numbers, lambda x: (x >= 1) & (x <= n)))


def rerank(ranked: DataFrame, replies: DataFrame, top_n: int = 5) -> DataFrame:
    """Chosen items in the reply's order, then the rest in the retriever's; renumbered and cut."""
    sizes = ranked.groupBy(F.col("query_id").alias("s_q")).agg(F.max("rank").alias("n"))
    chosen = replies.join(sizes, F.col("query_id") == F.col("s_q")).select(F.col("query_id").alias("c_q"), F.posexplode(parse_order(F.col("reply"), F.col("n"))).alias("place", "chosen"))
    joined = ranked.join(chosen, (F.col("query_id") == F.col("c_q")) & (F.col("rank") == F.col("chosen")), "left")
    order = Window.partitionBy("query_id").orderBy(F.col("place").asc_nulls_last(), "rank")
    return joined.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= top_n).select("query_id", "item", "rank", "new_rank")


def readable(items: DataFrame, cap: int) -> DataFrame:
    """Items up to the first that overflows the byte budget, in rank order."""
    used = F.sum(F.octet_length("text")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return items.withColumn("used_bytes", used).where(F.col("used_bytes") <= cap)


def pack_context(items: DataFrame, cap: int) -> DataFrame:
    """Greedy in rank order: an item that does not fit is skipped and the next is tried."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.octet_length("text").alias("b"))))
    start = F.struct(F.lit(0).alias("used"), F.expr("cast(array() AS array<int>)").alias("kept"))
    step = lambda a, x: F.when(
        a["used"] + x["b"] <= cap, F.struct((a["used"] + x["b"]).alias("used"), F.array_append(a["kept"], x["rank"].cast("int")).alias("kept"))
    ).otherwise(a)
    return items.groupBy("query_id").agg(F.aggregate(ordered, start, step).alias("r")).select(
        "query_id", F.col("r.used").cast("long").alias("used_bytes"), F.transform("r.kept", lambda k: F.concat(F.lit("S"), k.cast("string"))).alias("labels")
    )


def passage_markup(text) -> Column:
    """Text that cannot close the passage element it is put in."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def prompt(template: str, question, context) -> Column:
    """The template with {question} and {context} filled in."""
    return F.replace(F.replace(F.lit(template), F.lit("{context}"), context), F.lit("{question}"), question)


def citations(answer, allowed) -> Column:
    """valid, invalid and missing labels of an answer; code does not cite.

    Every bracket is a reference: several labels (``[S1, S2]``) are one each, anything else that is
    no known label is invalid. An answer that says INSUFFICIENT_EVIDENCE first misses none.
    """
    bare = F.regexp_replace(F.regexp_replace(answer, r"(?s)```.*?(?:```|\z)", " "), r"`[^`\n]*`", " ")
    parts = lambda g: F.transform(F.split(g, ","), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    several = lambda g: (F.size(F.split(g, ",")) > 1) & F.forall(parts(g), lambda x: x.rlike(r"^S\d+$"))
    brackets = F.regexp_extract_all(bare, F.lit(r"\[([^\[\]\n]+)\]"), 1)
    cited = F.array_distinct(F.flatten(F.transform(brackets, lambda g: F.when(several(g), parts(g)).otherwise(F.array(g)))))
    missing = (F.size(cited) == 0) & ~answer.startswith("INSUFFICIENT_EVIDENCE")
    return F.struct(F.array_intersect(cited, allowed).alias("valid"), F.array_except(cited, allowed).alias("invalid"), missing.alias("missing"))


def answer_chain(questions: DataFrame, retrieve, generate, cap: int = 4000) -> DataFrame:
    """question, retriever, context, prompt, model, citation check. ``generate`` maps a prompt column to an answer column."""
    items = retrieve(questions)
    packed = pack_context(items, cap)
    joined = items.join(packed.withColumnRenamed("query_id", "p_q"), (F.col("query_id") == F.col("p_q")) & F.expr("array_contains(labels, concat('S', rank))"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda s: F.concat(F.lit("[S"), s["rank"].cast("string"), F.lit("] "), passage_markup(s["text"]))), "\n")
    context = joined.groupBy(F.col("query_id").alias("c_q")).agg(lines.alias("context"), F.first("labels").alias("labels"))
    asked = questions.join(context, F.col("query_id") == F.col("c_q"), "left").withColumn("prompt", prompt("Use only:\n{context}\n\nQuestion: {question}", F.col("query"), F.coalesce("context", F.lit(""))))
    return asked.withColumn("answer", generate(F.col("prompt"))).withColumn("check", citations(F.col("answer"), F.coalesce("labels", F.array())))


def q_validate(spark, sf):
    return validate_vectors(table(spark, sf, "embeddings")).select("vec_id", F.array_join("violations", ",").alias("violations"))


def q_norms(spark, sf):
    v = doubles("embedding")
    preview = F.array_join(F.transform(F.slice(v, 1, 8), lambda x: F.round(x, 4).cast("decimal(12,4)").cast("string")), ",")
    return table(spark, sf, "embeddings").select("vec_id", F.round(norm(v), 6).alias("l2_norm"), preview.alias("preview"))


def _queries(spark, sf):
    return table(spark, sf, "embeddings").where(F.col("vec_id") % QUERY_STEP == 0)


def q_topk(spark, sf):
    return vector_topk(table(spark, sf, "embeddings"), _queries(spark, sf))


def q_cutoff(spark, sf):
    return vector_topk(table(spark, sf, "embeddings"), _queries(spark, sf), k=20, cutoff=0.8)


def q_centroid(spark, sf):
    """For each label, how many of its vectors lie nearest to its own centroid."""
    rows = table(spark, sf, "embeddings").select("vec_id", "label", doubles("embedding").alias("v"))
    parts = rows.select("label", F.posexplode("v").alias("d", "x")).groupBy("label", "d").agg(F.avg("x").alias("m"))
    centroids = parts.groupBy(F.col("label").alias("c_label")).agg(F.array_sort(F.collect_list(F.struct("d", "m"))).alias("c")).select("c_label", F.col("c.m").alias("c"))
    centroids, best = materialize(centroids, "centroids"), None
    blocks = max(1, -(-centroids.count() // CENTROIDS))
    for nth in range(blocks):  # one block, as long as labels are classes
        block = F.broadcast(centroids.where(F.pmod(F.xxhash64("c_label"), F.lit(blocks)) == nth))
        near = rows.join(block, F.col("c_label") >= F.lit(-(2**31))).select("vec_id", "label", "c_label", F.round(1 - dot("v", "c") / (norm(F.col("v")) * norm(F.col("c"))), 6).alias("d"))
        found = near.groupBy("vec_id", "label").agg(F.min(F.struct("d", "c_label")).alias("m"))
        best = found if best is None else best.unionByName(found).groupBy("vec_id", "label").agg(F.min("m").alias("m"))
    return best.groupBy("label").agg(F.count(F.lit(1)).alias("vectors"), F.count_if(F.col("m.c_label") == F.col("label")).alias("own"))


def _questions(spark, sf, words: int = 6):
    """The first words of the benchmark items of the query set."""
    items = table(spark, sf, "benchmark").where(F.col("item_id") % QUERY_STEP == 0)
    return items.select(F.col("item_id").alias("query_id"), F.array_join(F.slice(tokens("text"), 1, words), " ").alias("query"))


def q_keyword(spark, sf):
    return match_all(table(spark, sf, "documents"), _questions(spark, sf, 2))


def q_cover(spark, sf):
    return cover_density(table(spark, sf, "documents"), _questions(spark, sf, 2))


def q_web(spark, sf):
    hit = web_search(F.col("text"), 'the -of "in the" or der "und die"')
    return table(spark, sf, "documents").where(hit).select("doc_id")


def _web_queries(spark, sf):
    """Web-style queries of the query set: a document's longest words, its first two words as a phrase, an alternative, an exclusion."""
    asked = table(spark, sf, "documents").where((F.col("doc_id") % QUERY_STEP == 0) & F.col("text").isNotNull()).select("doc_id", folded("text").alias("text"))
    return asked.mapInArrow(partial(_web_query_rows, ranges=word_ranges(spark)), "query_id long, query string")


def _web_query_rows(batches, ranges):
    """The queries of folded texts (doc_id, text) with two words and four different ones."""
    cutter = Cutter(ranges)
    for batch in batches:
        for first, words, widths in cutter.pieces(batch["text"]):
            ids, queries, at = [], [], 0
            for doc_id, n in zip(batch["doc_id"].slice(first, len(widths)).to_pylist(), widths.tolist(), strict=True):
                t = words.slice(at, n).to_pylist()
                at += n
                w = nsmallest(4, set(t), key=lambda x: (-len(x), x))
                if len(w) == 4:
                    ids.append(doc_id)
                    queries.append(f'{w[0]} "{t[0]} {t[1]}" OR {w[1]} {w[2]} -{w[3]}')
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(queries, pa.string())], ["query_id", "query"])


def q_web_ranked(spark, sf):
    """Documents that match web-style queries given as data, by cover density."""
    return keyword_search(table(spark, sf, "documents"), _web_queries(spark, sf), k=10)


def q_web_matches(spark, sf):
    return keyword_matches(table(spark, sf, "documents"), _web_queries(spark, sf))


def q_bm25(spark, sf):
    return bm25(table(spark, sf, "documents"), _questions(spark, sf))


def _branches(spark, sf):
    """Vector and keyword rankings of the query set: a document's own vector and first words."""
    vector = vector_topk(table(spark, sf, "embeddings"), _queries(spark, sf), k=30).select("query_id", F.col("vec_id").alias("item"), "rank")
    docs = table(spark, sf, "documents")
    asked = docs.where(F.col("doc_id") % QUERY_STEP == 0).select(F.col("doc_id").alias("query_id"), F.array_join(leading("text", 8), " ").alias("query"))
    keyword = bm25(docs, asked, k=30).select("query_id", F.col("doc_id").alias("item"), "rank")
    return vector, keyword


def q_hybrid(spark, sf):
    return fuse(*_branches(spark, sf), weight=0.6)


def q_branch_counts(spark, sf):
    vector, keyword = _branches(spark, sf)
    fused = fuse(vector, keyword, weight=0.6, k=1000)
    return fused.groupBy("query_id").agg(
        F.count("vector_rank").alias("vector_hits"), F.count("keyword_rank").alias("keyword_hits"), F.count_if(F.col("vector_rank").isNotNull() & F.col("keyword_rank").isNotNull()).alias("both"), F.count(F.lit(1)).alias("candidates")
    )


def _turns(spark, sf):
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).cast("int").alias("rank"), F.col("turn").alias("item"), "text")


def q_rerank(spark, sf):
    """A reply that lists turns from the last, repeats one and names one out of range."""
    turns = _turns(spark, sf)
    replies = turns.groupBy("query_id").agg(F.max("rank").alias("m")).select("query_id", F.concat_ws(", ", F.col("m").cast("string"), F.lit("1"), F.lit("1"), F.lit("99"), F.lit("2")).alias("reply"))
    return rerank(turns, replies, top_n=4)


def q_readable(spark, sf):
    return readable(_turns(spark, sf), 1500).select("query_id", "rank", "used_bytes")


def q_pack(spark, sf):
    return pack_context(_turns(spark, sf), 800).select("query_id", "used_bytes", F.array_join("labels", ",").alias("labels"))


def q_citations(spark, sf):
    """Answers made from turns: words become brackets, labels, code or an answer without evidence."""
    marked = F.replace(F.regexp_replace("text", r" ([a-z]{2}) ", " [$1] "), F.lit("."), F.concat(F.lit(" [S"), F.length("text") % 4, F.lit(", S2] `[S9]`")))
    answer = F.when(F.col("turn") % 3 == 0, marked).when(F.length("text") % 2 == 0, F.concat(F.lit("INSUFFICIENT_EVIDENCE "), "text")).otherwise(F.col("text"))
    turns = table(spark, sf, "conversations").select("conv_id", "turn", answer.alias("answer"))
    check = citations(F.col("answer"), F.array(F.lit("S1"), F.lit("S2"), F.lit("en")))
    return turns.select("conv_id", "turn", check.alias("c")).select("conv_id", "turn", F.array_join("c.valid", ",").alias("valid"), F.array_join("c.invalid", ",").alias("invalid"), "c.missing")


def q_markup(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2(passage_markup("html"), 256).alias("escaped_sha256"))


def q_prompt(spark, sf):
    """The message payload of a question about each conversation's turns."""
    turns = table(spark, sf, "conversations")
    context = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: passage_markup(s["text"])), "\n").alias("context"))
    filled = prompt("Context: {context} Question: {question}", F.concat(F.lit("q"), F.col("conv_id").cast("string")), F.col("context"))
    return context.select("conv_id", F.sha2(filled, 256).alias("prompt_sha256"))


def q_chain(spark, sf):
    """The whole chain with a model that cites its first passage."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    retrieve = lambda q: bm25(docs, q, k=3).join(docs.withColumnRenamed("doc_id", "d"), F.col("doc_id") == F.col("d")).select("query_id", "rank", "text")
    out = answer_chain(_questions(spark, sf), retrieve, lambda p: F.concat(F.lit("See [S"), F.regexp_extract(p, r"\[S(\d+)\]", 1), F.lit("].")))
    return out.select("query_id", "answer", F.array_join("check.valid", ",").alias("valid"), "check.missing")


_T = r"regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}]+')"
_COS = "round(1 - list_inner_product(a::DOUBLE[], b::DOUBLE[]) / (sqrt(list_inner_product(a::DOUBLE[], a::DOUBLE[])) * sqrt(list_inner_product(b::DOUBLE[], b::DOUBLE[]))), 6)"
_VEC = f"""(SELECT query_id, vec_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM
  (SELECT q.vec_id AS query_id, c.vec_id, {_COS.replace("a::", "c.embedding::").replace("b::", "q.embedding::")} + 0.0::DOUBLE AS distance FROM embeddings c, embeddings q WHERE q.vec_id % 20 = 0))"""


def _bm25_sql(questions: str, k: int) -> str:
    return f"""(WITH tk AS (SELECT doc_id, {_T} AS t FROM documents), n AS (SELECT count(*) AS n_docs, avg(len(t)) AS mean_dl FROM tk),
      q AS (SELECT query_id, unnest(list_distinct(t)) AS term FROM {questions}),
      tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM tk) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
      df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
      s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean_dl))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term), n GROUP BY 1, 2)
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= {k})"""


_ASK = f"(SELECT item_id AS query_id, {_T}[1:6] AS t FROM benchmark WHERE item_id % 20 = 0)"
_SELF = f"(SELECT doc_id AS query_id, {_T}[1:8] AS t FROM documents WHERE doc_id % 20 = 0)"
_FUSED = f"""(SELECT query_id, item, vector_rank, keyword_rank, round(coalesce(0.6::DOUBLE / (60 + vector_rank), 0) + coalesce(0.4::DOUBLE / (60 + keyword_rank), 0), 9) AS score
  FROM (SELECT query_id, vec_id AS item, rank AS vector_rank FROM {_VEC} WHERE rank <= 30) FULL JOIN (SELECT query_id, doc_id AS item, rank AS keyword_rank FROM {_bm25_sql(_SELF, 30)}) USING (query_id, item))"""

QUERIES = {
    "validate_vectors": (q_validate, "SELECT vec_id, concat_ws(',', CASE WHEN len(embedding) <> 64 THEN 'dimensions' END, CASE WHEN len(list_filter(embedding, lambda x: isnan(x) OR abs(x) > 3.4e38)) > 0 THEN 'not_finite' END, CASE WHEN len(list_filter(embedding, lambda x: abs(x) >= 1.17e-38)) = 0 THEN 'all_zero' END) AS violations FROM embeddings"),
    "vector_norms": (
        q_norms,
        "SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS l2_norm, array_to_string(list_transform(embedding[1:8], lambda x: CAST(CAST(round(x::DOUBLE, 4) AS DECIMAL(12,4)) AS VARCHAR)), ',') AS preview FROM embeddings",
    ),
    "vector_topk": (q_topk, f"SELECT * FROM {_VEC} WHERE rank <= 10"),
    "vector_topk_cutoff": (q_cutoff, f"SELECT * FROM {_VEC} WHERE distance <= 0.8 AND rank <= 20"),
    "label_centroid_nearest": (
        q_centroid,
        f"""WITH e AS (SELECT vec_id, label, unnest(range(64)) AS d, unnest(embedding::DOUBLE[]) AS x FROM embeddings), m AS (SELECT label, d, avg(x) AS m FROM e GROUP BY 1, 2),
        c AS (SELECT label AS c_label, list(m ORDER BY d) AS c FROM m GROUP BY 1),
        n AS (SELECT vec_id, label, c_label, {_COS.replace("a::", "embedding::").replace("b::", "c::")} AS d FROM embeddings, c),
        b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, c_label) AS r FROM n) SELECT label, count(*) AS vectors, count(*) FILTER (label = c_label) AS own FROM b WHERE r = 1 GROUP BY 1""",
    ),
    "keyword_all_terms": (
        q_keyword,
        f"SELECT query_id, doc_id FROM (SELECT query_id, list_distinct(t[1:2]) AS q FROM {_ASK}), (SELECT doc_id, {_T} AS t FROM documents) WHERE list_has_all(t, q) AND len(q) > 0",
    ),
    "keyword_cover_density": (
        q_cover,
        f"""WITH q AS (SELECT query_id, list_distinct(t[1:2]) AS q FROM {_ASK}), d AS (SELECT doc_id, unnest(t) AS term, unnest(range(len(t))) AS pos FROM (SELECT doc_id, {_T} AS t FROM documents)),
        h AS (SELECT query_id, q, doc_id, term, pos, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY pos) AS n FROM d JOIN q ON list_contains(q, term)),
        l AS (SELECT *, CASE WHEN len(q) = 1 THEN n ELSE CASE WHEN max(CASE WHEN term = q[1] THEN n END) OVER w IS NOT NULL AND max(CASE WHEN term = q[2] THEN n END) OVER w IS NOT NULL
          THEN least(max(CASE WHEN term = q[1] THEN n END) OVER w, max(CASE WHEN term = q[2] THEN n END) OVER w) END END AS s FROM h WINDOW w AS (PARTITION BY query_id, doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        c AS (SELECT query_id, doc_id, s, min(n) AS n FROM l WHERE s IS NOT NULL GROUP BY 1, 2, 3),
        r AS (SELECT c.query_id, c.doc_id, round(sum(0.1::DOUBLE / (1 + e.pos - b.pos - (c.n - c.s))), 6) AS score FROM c JOIN h e ON e.query_id = c.query_id AND e.doc_id = c.doc_id AND e.n = c.n JOIN h b ON b.query_id = c.query_id AND b.doc_id = c.doc_id AND b.n = c.s GROUP BY 1, 2)
        SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= 10""",
    ),
    "web_style_search": (
        q_web,
        f"""SELECT doc_id FROM (SELECT doc_id, ' ' || array_to_string({_T}, ' ') || ' ' AS j FROM documents)
        WHERE (contains(j, ' the ') AND NOT contains(j, ' of ') AND contains(j, ' in the ')) OR (contains(j, ' der ') AND contains(j, ' und die '))""",
    ),
    "keyword_web_matches": (
        q_web_matches,
        f"""WITH d AS (SELECT doc_id, {_T} AS t FROM documents), j AS (SELECT doc_id, ' ' || array_to_string(t, ' ') || ' ' AS j FROM d),
        q AS (SELECT doc_id AS query_id, t[1] || ' ' || t[2] AS p, list_transform(list_sort(list_transform(list_distinct(t), lambda x: {{'n': -length(x), 'w': x}})), lambda x: x.w) AS w FROM d WHERE doc_id % 20 = 0 AND len(t) >= 2)
        SELECT query_id, doc_id FROM q, j WHERE len(w) >= 4 AND ((contains(j, ' ' || w[1] || ' ') AND contains(j, ' ' || p || ' ')) OR (contains(j, ' ' || w[2] || ' ') AND contains(j, ' ' || w[3] || ' ') AND NOT contains(j, ' ' || w[4] || ' ')))""",
    ),
    "keyword_web_ranked": (q_web_ranked, None),
    "bm25_topk": (q_bm25, f"SELECT * FROM {_bm25_sql(_ASK, 10)}"),
    "hybrid_rrf_topk": (q_hybrid, f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS rank FROM {_FUSED}) WHERE rank <= 10"),
    "retrieval_branch_counts": (q_branch_counts, f"SELECT query_id, count(vector_rank) AS vector_hits, count(keyword_rank) AS keyword_hits, count(*) FILTER (vector_rank IS NOT NULL AND keyword_rank IS NOT NULL) AS both, count(*) AS candidates FROM {_FUSED} GROUP BY 1"),
    "rerank_apply": (
        q_rerank,
        """WITH t AS (SELECT conv_id AS query_id, turn AS item, turn + 1 AS rank, max(turn + 1) OVER (PARTITION BY conv_id) AS m FROM conversations),
        o AS (SELECT *, CASE WHEN rank = m THEN 0 WHEN rank = 1 THEN 1 WHEN rank = 2 THEN 2 END AS place FROM t)
        SELECT * FROM (SELECT query_id, item, rank, row_number() OVER (PARTITION BY query_id ORDER BY place NULLS LAST, rank) AS new_rank FROM o) WHERE new_rank <= 4""",
    ),
    "readable_prefix": (q_readable, "SELECT * FROM (SELECT conv_id AS query_id, turn + 1 AS rank, CAST(sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS used_bytes FROM conversations) WHERE used_bytes <= 1500"),
    "context_pack_greedy": (
        q_pack,
        """WITH RECURSIVE t AS (SELECT conv_id, turn, strlen(text) AS b, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
        w AS (SELECT conv_id, n, CASE WHEN b <= 800 THEN b ELSE 0 END AS used, CASE WHEN b <= 800 THEN 'S' || (turn + 1) ELSE '' END AS labels FROM t WHERE n = 1
          UNION ALL SELECT t.conv_id, t.n, CASE WHEN used + b <= 800 THEN used + b ELSE used END, CASE WHEN used + b <= 800 THEN concat_ws(',', nullif(labels, ''), 'S' || (turn + 1)) ELSE labels END FROM w JOIN t ON t.conv_id = w.conv_id AND t.n = w.n + 1)
        SELECT conv_id AS query_id, used AS used_bytes, labels FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) AS r FROM w) WHERE r = 1""",
    ),
    "citation_check": (
        q_citations,
        """WITH a AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN replace(regexp_replace(text, ' ([a-z]{2}) ', ' [\\1] ', 'g'), '.', ' [S' || length(text) % 4 || ', S2] `[S9]`') WHEN length(text) % 2 = 0 THEN 'INSUFFICIENT_EVIDENCE ' || text ELSE text END AS a FROM conversations),
        b AS (SELECT *, regexp_extract_all(regexp_replace(a, '`[^`\\n]*`', ' ', 'g'), '\\[([^\\[\\]\\n]+)\\]', 1) AS g FROM a),
        r AS (SELECT *, flatten(list_transform(g, lambda x: CASE WHEN regexp_full_match(x, 'S[0-9]+(\\s*,\\s*S[0-9]+)+') THEN regexp_split_to_array(x, '\\s*,\\s*') ELSE [x] END)) AS f FROM b),
        d AS (SELECT *, [f[i] FOR i IN range(1, len(f) + 1) IF list_position(f, f[i]) = i] AS f1 FROM r)
        SELECT conv_id, turn, array_to_string([x FOR x IN f1 IF x IN ('S1', 'S2', 'en')], ',') AS valid, array_to_string([x FOR x IN f1 IF x NOT IN ('S1', 'S2', 'en')], ',') AS invalid,
        len(f1) = 0 AND NOT starts_with(a, 'INSUFFICIENT_EVIDENCE') AS missing FROM d""",
    ),
    "passage_markup_escape": (q_markup, "SELECT page_id, sha256(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped_sha256 FROM pages"),
    "prompt_payload": (
        q_prompt,
        """SELECT conv_id, sha256('Context: ' || string_agg(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10) ORDER BY turn) || ' Question: q' || conv_id) AS prompt_sha256 FROM conversations GROUP BY conv_id""",
    ),
    "answer_chain": (q_chain, None),
}
