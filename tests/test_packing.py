import random

from pyspark.sql import functions as F

from lexiloom.functions import citations
from lexiloom.operators.chunks import embedding_text, gathered, parent_child_chunks, passages_beyond, section_chunks, token_distribution, with_blocks
from lexiloom.operators.packing import SHORT, Limits, Line, Part, page_of, path_of, sections_of


def line_of(*texts, kind="paragraph", path=("h",), page=1):
    return Line([(n, t, path, page, kind) for n, t in enumerate(texts)])


def stretches(text, most):
    line = line_of(text)
    return [text[s:e] for s, e in line.stretches(0, len(text), most)]


def texts(line, chunks):
    return [line.text_of(c) for c in chunks]


def test_stretches_end_at_sentences_words_or_anywhere():
    assert stretches("One two. Three four five six.", 12)[0] == "One two. "
    assert stretches("你好。再见。", 9) == ["你好。", "再见。"]
    assert stretches("aaaa bbbb cccc" * 4, 45)[0] == "aaaa bbbb ccccaaaa bbbb ccccaaaa bbbb "
    assert stretches("x" * 100, 45) == ["x" * 45, "x" * 45, "x" * 10]  # no place to move the cut to
    assert stretches("", 5) == [] and stretches("é", 1) == ["é"]
    assert stretches("ab. \n \ncd", 7) == ["ab. \n \n", "cd"]  # white space behind a stop goes with it


def test_a_short_rest_joins_or_takes_words():
    first, second = stretches("word " * 20 + "tail", 100)
    assert len(second) >= SHORT and len(first) <= 100 and first + second == "word " * 20 + "tail"
    assert stretches("first sentence is here. second one", 60) == ["first sentence is here. second one"]


def pieces(rng):
    return "".join(rng.choices(["word ", "é", "a. ", "\n", "长。", "x" * 30, "🙂 "], k=rng.randrange(1, 60)))


def test_random_texts_are_covered_within_the_budget():
    rng = random.Random(1)
    for _ in range(300):
        most = rng.randrange(8, 120)
        line = line_of(*(pieces(rng) for _ in range(4)))
        parts = line.parts(most)
        assert "".join(line.text[s:e] for p in parts for s, e in p.ranges) == line.text
        assert all(line.size_of(p) <= most for p in parts)
        for limits in (Limits(most // 2, most, most // 4), Limits(most // 2, most)):
            chunks = line.fill(parts, limits)
            assert all(line.joined(c) <= most and line.joined(c) == len(line.text_of(c).encode()) for c in chunks)
        assert "".join(line.text[s:e] for c in chunks for p in c for s, e in p.ranges) == line.text  # without an overlap nothing comes twice


def test_chunks_end_where_they_are_full():
    """Of the parts of a chunk no smaller number would do, and it stops only where it may."""
    rng = random.Random(2)
    for _ in range(300):
        line = line_of(*("x" * rng.choice((3, 10, 25, 60)) for _ in range(rng.randrange(2, 30))), kind="code")
        limits = Limits(rng.randrange(40, 90), 130)
        parts = line.parts(limits.most)
        chunks, at = line.fill(parts, limits), 0
        for k, chunk in enumerate(chunks[:-2]):
            for n in range(1, len(chunk) + 1):
                size = line.joined(parts[at : at + n])
                stops = size >= max(limits.target, SHORT) or line.joined(parts[at : at + n + 1]) > limits.most
                assert stops == (n == len(chunk)), (k, n)
            at += len(chunk)


def test_an_overlap_starts_at_a_word():
    line = line_of("alpha beta gamma delta epsilon zeta eta theta iota kappa", "lambda mu nu xi omicron pi rho sigma tau upsilon phi chi")
    first, second = texts(line, line.fill(line.parts(90), Limits(50, 90, 20)))
    assert second.startswith(" theta iota kappa\n\nlambda") or second.startswith("eta theta iota kappa\n\nlambda")
    whole = line_of("one long enough paragraph to fill a chunk alone", "tiny", "another long paragraph that fills a chunk alone")
    assert texts(whole, whole.fill(whole.parts(90), Limits(50, 90, 4)))[1].startswith("tiny\n\nanother")
    code = line_of("x" * 60, "y" * 60, kind="code")
    assert texts(code, code.fill(code.parts(90), Limits(50, 90, 20))) == ["x" * 60, "y" * 60]  # code is not cut for an overlap


def test_a_short_chunk_takes_the_next_parts_first_words():
    line = line_of("A heading", "some words of a paragraph " * 4)
    chunks = line.fill(line.parts(104), Limits(60, 104))
    assert texts(line, chunks)[0].startswith("A heading\n\nsome words") and all(line.joined(c) <= 104 for c in chunks)
    hard = Line([(0, "A heading", ("h",), 1, "heading"), (1, "x" * 99, ("h",), 1, "code")])
    assert [len(c) for c in hard.fill(hard.parts(100), Limits(60, 100))] == [1, 1]


def test_a_short_last_chunk_joins_or_takes_closing_words():
    body = "words of the body of it, " * 3
    line = line_of(body, "end")
    assert len(line.fill(line.parts(100), Limits(50, 100))) == 1
    line = line_of(body.strip(), "the end")
    chunks = line.fill(line.parts(75), Limits(70, 75))
    assert len(chunks) == 2 and line.joined(chunks[1]) >= SHORT and chunks[1][0].block == 0
    assert "".join(line.text[s:e] for c in chunks for p in c for s, e in p.ranges) == line.text


def test_short_sections_join_the_chunk_before_or_open_the_next():
    long, short = "a paragraph that is long enough to stand alone, surely", "short one"

    def packed(most, *blocks):
        line = Line([(n, t, path, page, "paragraph") for n, (t, path, page) in enumerate(blocks)])
        return line, line.chunks(sections_of(line.parts(most)), Limits(min(60, most), most))

    _, join = packed(200, (long, ("A",), 1), (short, ("A", "B"), 1))
    assert [len(c) for c in join] == [2] and path_of(join[0][1]) == ("A",)
    line, carry = packed(200, (short, ("A",), 1), (long, ("B",), 1))
    assert texts(line, carry[0]) == [short + "\n\n" + long] and path_of(carry[0][0]) == ("B",)
    _, apart = packed(200, (short, ("A",), 1), (long, ("B",), 2), (short, ("C",), 3))
    assert [len(c) for c in apart] == [1, 1, 1]
    _, full = packed(60, (long, ("A",), 1), (short, ("B",), 1))
    assert len(full) == 2
    assert path_of([Part(0, ((0, 1),), ("a", "b")), Part(1, ((1, 2),), ("a", "c"))]) == ("a",) and path_of([]) == ()
    assert page_of([Part(0, ((0, 1),), (), None)]) == (None,) and page_of([Part(0, ((0, 1),), (), 1), Part(0, ((0, 1),), (), 2)]) == ()


def test_tables_are_cut_between_rows_under_their_header():
    rows = [f"| row {n} | {n * n} |\n" for n in range(40)]
    line = line_of("| a | b |\n| --- | --- |\n" + "".join(rows), kind="table")
    parts = line.parts(150)
    head = "| a | b |\n| --- | --- |\n"
    assert len(parts) > 3 and all(line.text_of([p]).startswith(head) and line.size_of(p) <= 150 and p.finding is None for p in parts)
    assert "".join(line.text_of([p])[len(head) :] for p in parts) == "".join(rows)
    assert [(x["block_start"], x["chunk_start"]) for x in line.spans(parts[1:2])] == [(0, 0), (parts[1].ranges[1][0], len(head))]
    wide = line_of("head\n" + "w " * 200 + "\nlast row", kind="table")
    assert {p.finding for p in wide.parts(100)} == {"oversize_table_row_split", None} and wide.text_of([wide.parts(100)[-1]]) == "head\nlast row"
    assert {p.finding for p in line_of("h" * 120 + "\nrow", kind="table").parts(100)} == {"oversize_table_split"}
    assert {p.finding for p in line_of("c " * 120, kind="code").parts(100)} == {"oversize_protected_block_split"}
    assert [len(c) for c in line_of("- a list item", "- more").fill(line_of("- a list item", "- more").parts(50), Limits(9, 50))] == [2]


def test_rows_have_passages_with_title_labels_and_header():
    text = "A title |  | \nname | year | n\nNORTH |  | \nAND EAST |  | \nOslo | 1950 | \n |  | \nBergen |  | 7\nLAST |  | "
    line = line_of(text, "x | y\n1 | 2", "no table", kind="table")
    found = line.row_passages(400)
    assert list(found) == [0, 1]
    assert [s for *_, s in found[0]] == ["A title. NORTH AND EAST. name: Oslo; year: 1950", "A title. NORTH AND EAST. name: Bergen; n: 7", "LAST"]
    assert [s for *_, s in found[1]] == ["LAST. x: 1; y: 2"]  # a label goes on in the next table of the same heading
    head = "A title |  | \nname | year | n\n"
    assert line.text_of([found[0][0][1]]) == head + "NORTH |  | \nAND EAST |  | \nOslo | 1950 | \n"
    assert line.text_of([found[0][1][1]]) == head + "NORTH |  | \nAND EAST |  | \nBergen |  | 7\n" and line.text_of([found[0][2][1]]) == head + "LAST |  | "
    assert line.text_of([line_of(text, kind="table").row_passages(60)[0][0][1]]) == "NORTH |  | \nAND EAST |  | \nOslo | 1950 | \n"  # the header does not fit
    ruled = line_of("| a | b |\n| --- | --- |\n| 1 | 2 |\n|  | 3 |", kind="table").row_passages(100)
    assert [s for *_, s in ruled[0]] == ["a: 1; b: 2", "b: 3"]
    for none in ("a | b", "a | b\n1 | 2 | 3", "a | b\n" + "w" * 200 + " | 2"):
        assert line_of(none, kind="table").row_passages(100) == {}
    assert line_of("a | b\n1 | 2").row_passages(100) == {}


_SCHEMA = "doc_id long, ordinal long, text string, path array<string>, page long, kind string"


def test_chunks_of_documents(spark):
    rows = [(1, 0, "Title", ["Title"], 0, "heading"), (1, 1, "A paragraph of the first section. " * 30, ["Title"], 0, "paragraph"), (1, 2, "Tiny", ["Other"], 0, "paragraph"),
            (1, 3, "Next page. " * 9, ["Other"], 1, "paragraph"), (2, 0, None, None, None, None), (None, 0, "No id. ", None, None, None), (None, 0, "None either. ", None, None, None)]
    docs = gathered(spark.createDataFrame(rows, _SCHEMA))
    assert docs.count() == 4 and section_chunks(docs.limit(0)).count() == 0
    got = section_chunks(docs).orderBy("doc_id", "ordinal").collect()
    assert [r.doc_id for r in got if r.doc_id != 1] == [None, None] and all(r.token_count == len(r.text.encode()) <= 800 for r in got)
    one = [r for r in got if r.doc_id == 1]
    assert one[0].text.startswith("Title\n\nA paragraph") and any("Tiny" in r.text and len(r.text) > 20 for r in one)
    block = {(d, n): t for d, n, t, *_ in rows}
    for r in one + parent_child_chunks(docs.where("doc_id = 1")).collect():
        for x in r.spans:  # exact lineage: every character of a chunk but the blank lines
            assert block[r.doc_id, x.block][x.block_start : x.block_end] == r.text[x.chunk_start : x.chunk_end]
        assert sum(x.chunk_end - x.chunk_start for x in r.spans) + 2 * r.text.count("\n\n") == len(r.text)


def test_parents_and_their_children(spark):
    rows = [(1, n, f"Sentence {n} has some words in it. " * 8, ["h"], 0, "paragraph") for n in range(6)]
    rows += [(1, 6, "A note", ["i"], 0, "paragraph"), (1, 7, "head\n" + "cell | cell\n" * 60, ["i"], 0, "table"), (1, 8, "- " + "item " * 20, ["j"], 1, "list_item")]
    found = parent_child_chunks(gathered(spark.createDataFrame(rows, _SCHEMA))).collect()
    parents = {r.ordinal: r for r in found if r.role == "parent"}
    children = [r for r in found if r.role == "child"]
    assert parents and children and all(r.parent_ordinal in parents and r.token_count <= 320 for r in children)
    assert all(p.parent_ordinal is None and p.token_count <= 1200 for p in parents.values())
    for n, p in parents.items():  # without its overlap, a parent is its children
        inside = {(x.block, k) for c in children if c.parent_ordinal == n for x in c.spans for k in range(x.block_start, x.block_end)}
        assert inside == {(x.block, k) for x in p.spans for k in range(x.block_start, x.block_end)}
    tables = [r.text for r in children if any(x.block == 7 for x in r.spans)]
    assert len(tables) > 1 and all("head\ncell | cell\n" in t for t in tables)
    gate = passages_beyond(spark.createDataFrame([(1, "parent", "x" * 9000), (1, "child", "y"), (2, "child", "é" * 5000)], "doc_id long, role string, text string")).collect()
    assert sorted((r.doc_id, r.passages, r.largest, r.accepted) for r in gate) == [(1, 1, 1, True), (2, 1, 10_000, False)]
    sizes = [("a", "child", n, []) for n in range(1, 21)] + [("a", "parent", 999, []), ("a", "child", 7, ["oversize_block_split"])]
    r = token_distribution(spark.createDataFrame(sizes, "source string, role string, token_count long, findings array<string>"), "source").first()
    assert (r.min_tokens, r.median_tokens, r.p95_tokens, r.max_tokens, r.chunks, r.parents, r.oversize) == (1, 10.0, 19, 20, 21, 1, 1)


def test_lines_as_blocks(spark):
    text = "Head\nFirst line that is longer than forty characters, so no head\nShort.\na | b\n- item"
    blocks = with_blocks(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(b.ordinal, b.path, b.page, b.kind) for b in blocks[0].blocks] == [(0, ["Head"], 0, "heading"), (1, ["Head"], 0, "paragraph"), (2, ["Short."], 0, "paragraph"), (3, ["Short."], 0, "table"), (4, ["Short."], 0, "list_item")]
    assert [b.doc_id for b in blocks] == [1, 3] and [b.text for b in blocks[1].blocks] == [""]


def test_texts_without_an_end_take_linear_time(spark):
    import time

    long = spark.createDataFrame([(1, 0, "word " * 200_000, None, None, "paragraph"), (1, 1, "x" * 300_000, None, None, "code")], _SCHEMA)
    began = time.time()
    assert section_chunks(gathered(long)).count() > 1000 and time.time() - began < 60


def test_prefix_is_capped_by_bytes_with_its_frame(spark):
    df = spark.createDataFrame([(["a", "b"],), ([],), (["é" * 300, "end"],), (["x" * 500],)], "p array<string>")
    got = [r[0] for r in df.select(embedding_text(F.col("p"), F.lit("body"))).collect()]
    assert got[0] == "Section: a > b\n\nbody" and got[1] == "body"
    assert got[2] == "Section: …" + "é" * 140 + " > end\n\nbody" and got[3] == "Section: …" + "x" * 286 + "\n\nbody"


def test_every_bracket_is_a_reference(spark):
    answers = ["a [S1] and [note] [S1, S7]", "[S1, x]", "INSUFFICIENT_EVIDENCE: none", "nothing", "`[S1]` [ S2 ]"]
    rows = spark.createDataFrame([(a,) for a in answers], "a string").select(citations(F.col("a"), F.array(F.lit("S1"), F.lit("S2"))).alias("c")).collect()
    assert [(r.c.valid, r.c.invalid, r.c.missing) for r in rows] == [(["S1"], ["note", "S7"], False), ([], ["S1, x"], False), ([], [], False), ([], [], True), ([], [" S2 "], False)]


def test_row_passages_with_title_labels_and_pairs(spark):
    from lexiloom.operators.chunks import row_passages

    table = "A title |  | \nname | year | n\nNORTH |  | \nAND EAST |  | \nOslo | 1950 | \n |  | \nBergen |  | 7\nLAST |  | "
    got = sorted((r.row, r.text) for r in row_passages(spark.createDataFrame([(1, table), (2, "a | b\nonly | x"), (3, None)], "doc_id long, text string")).where("doc_id = 1").collect())
    assert got == [(4, "A title. NORTH AND EAST. name: Oslo; year: 1950"), (6, "A title. NORTH AND EAST. name: Bergen; n: 7"), (7, "LAST")]


def test_strict_scan_of_tables(spark):
    from lexiloom.sources import delimited

    rows = spark.createDataFrame([(1, 0, ["a", "b"]), (1, 1, ["c", "d"]), (2, 0, ["a", "b"]), (2, 1, ["c"]), (3, 0, ["x"] * 1001)], "doc_id long, row long, cells array<string>")
    assert {r.doc_id: r.violation for r in delimited.scan_tables(rows).collect()} == {1: None, 2: "malformed_table", 3: "table_limit"}
    assert delimited.header_error(["question"]) is None and delimited.header_error(["reference_answer"]) == "header"


def test_rows_follow_the_chunk_that_holds_them(spark):
    table = "name | n\n" + "".join(f"row {n} | {n * n}\n" for n in range(60))
    rows = [(1, 0, "Heading", ["h"], 0, "heading"), (1, 1, table, ["h"], 0, "table"), (1, 2, "A closing paragraph. " * 30, ["h"], 0, "paragraph")]
    docs = gathered(spark.createDataFrame(rows, _SCHEMA))
    got = section_chunks(docs, rows=True).orderBy("ordinal").collect()
    plain = section_chunks(docs).orderBy("ordinal").collect()
    assert [r.text for r in got if r.role == "passage"] == [r.text for r in plain] and [r.ordinal for r in got] == list(range(len(got)))
    found = [r for r in got if r.role == "row"]
    assert [r.search for r in found] == [f"name: row {n}; n: {n * n}" for n in range(60)] and all(r.text.startswith("name | n\nrow") for r in found)
    above = None
    for r in got:
        above = r if r.role == "passage" else above
        assert r.role == "passage" or r.text.split("\n")[1] in above.text
        assert all(rows[x.block][2][x.block_start : x.block_end] == r.text[x.chunk_start : x.chunk_end] for x in r.spans)
    family = parent_child_chunks(docs, rows=True).collect()
    parents = {r.ordinal: r for r in family if r.role == "parent"}
    assert sum(r.role == "row" for r in family) == 60 and all(r.text.split("\n")[1] in parents[r.parent_ordinal].text for r in family if r.role == "row")
