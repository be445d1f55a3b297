import random
from urllib.robotparser import RobotFileParser

from lexiloom.functions import citations, in_scope, parse_order, safe_cell, strip_tracking
from lexiloom.operators import retrieval as R
from lexiloom.operators.blocks import select_blocks
from lexiloom.plans import StageCache, identity, run_steps
from lexiloom.sources import delimited, markup, urls
from pyspark.sql import functions as F


def test_canonical_urls(spark):
    ok = {
        "HTTP://Example.COM:80/a/../b/./c%20d/?q=1#f": "http://example.com/b/c%20d/?q=1",
        "https://bücher.example": "https://xn--bcher-kva.example/",
        "https://e.example:8443//x": "https://e.example:8443//x",
        "https://e.example:0443/": "https://e.example/",
        "https://e.example./a+b/é%zz~%7E%2f?": "https://e.example/a+b/%C3%A9%zz~~/",
        "http://[2001:DB8::1]:8080/x": "http://[2001:db8::1]:8080/x",
        "http://e.example/../../x/..": "http://e.example/",
        " http://e.example/a b/%41;p=1": "http://e.example/a%20b/A;p=1",
    }
    bad = {"ftp://x": "unsafe_scheme", "https://u:p@x.example/": "url_credentials", "https:///x": "invalid_url", "https://x:99999/": "invalid_url",
           "http://x:8a/": "invalid_url", "": "unsafe_scheme", None: "unsafe_scheme", f"http://{'a' * 64}.example/": "invalid_hostname"}
    rows = spark.createDataFrame([(u,) for u in [*ok, *bad]], "u string").select("u", urls.canonical_url("u").alias("c")).collect()
    assert {r.u: r.c.url for r in rows if r.u in ok} == ok
    assert {r.u: r.c.violation for r in rows if r.u in bad} == bad


def test_tracking_scope_and_cells(spark):
    df = spark.createDataFrame([("https://a.example/p?utm_x=1&b=%20&ref=2&c=", "=1+1"), ("https://a.example/p?ref=1#f", "ok"), ("https://b.example/q", "\tx"), ("https://a.example/p/x?gclid", None)], "u string, v string")
    rows = df.select(strip_tracking(df.u).alias("s"), in_scope(df.u, ["https://a.example"], ("/p",), ("/p/x",)).alias("i"), safe_cell(df.v).alias("c")).collect()
    assert [r.s for r in rows] == ["https://a.example/p?b=%20&c=", "https://a.example/p#f", "https://b.example/q", "https://a.example/p/x"]
    assert [r.i for r in rows] == [True, True, False, False] and [r.c for r in rows] == ["'=1+1", "ok", "'\tx", ""]


def test_robots_take_the_stricter_reading():
    rules = urls.Robots("Crawl-delay: 7\nUser-agent: *\n\nDisallow: /private\nCrawl-delay: 2\n")
    assert not rules.allows("bot", "https://x.example/private/1") and rules.allows("bot", "https://x.example/open") and rules.delay("bot") == 7.0


def test_robots_groups_and_rules_match_the_standard_reading():
    rng = random.Random(1)
    lines = ["User-agent: *", "User-agent: bot", "user-agent: Other # x", "Disallow: /a", "Allow: /a/b", "Disallow:", "Disallow: /c%20d", "Crawl-delay: 3", "Crawl-delay: x", "", "# note", "Disallow: *", "junk"]
    for _ in range(500):
        text = "\n".join(rng.choices(lines, k=rng.randrange(9)))
        standard = RobotFileParser("https://x.example/robots.txt")
        standard.parse(text.splitlines())
        rules = urls.Robots(text)
        rules.readings = rules.readings[:1]
        for agent in ("bot/1.0", "other", "else"):
            for path in ("/", "/a", "/a/b/c", "/c d", "/c%20d/x?q=1", ""):
                assert rules.allows(agent, f"https://x.example{path}") == standard.can_fetch(agent, f"https://x.example{path}"), (text, agent, path)


def test_links_and_page_identity(spark):
    page = """<head><link rel="canonical" href="https://x/1"><title>t</title></head><a class=b href='/one'>One</a> <A HREF="/two">Two</A><a href=/three>3</a><script>no</script><!-- no -->"""
    df = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    assert [r.href for r in urls.links(df).orderBy("nth").collect()] == ["/one", "/two", "/three"]
    assert sorted((r.page_id, r.canonical, r.visible) for r in urls.page_identity(df).collect()) == [(1, "https://x/1", "One Two 3"), (2, None, None)]


def test_sitemap_refuses_types(spark):
    df = spark.createDataFrame([("a", "<urlset><url><loc> https://x/1 </loc><lastmod>2026-01-02</lastmod></url></urlset>"), ("b", "<!DOCTYPE x><urlset><url><loc>u</loc></url></urlset>")], "site string, xml string")
    rows = urls.sitemap(df).collect()
    assert [(r.site, r.loc, str(r.lastmod)) for r in rows] == [("a", "https://x/1", "2026-01-03 00:00:00")]


def test_markdown(spark):
    text = "# One\nfirst line\nsecond line\n\n### Deep ###\n- item\n> quoted\n```\ncode  a\n\n# not a heading\n```\n## Two\nlast"
    rows = markup.markdown_blocks(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("ordinal").collect()
    assert [(r.type, r.text, list(r.heading_path)) for r in rows] == [
        ("heading", "One", []), ("paragraph", "first line second line", ["One"]), ("heading", "Deep", ["One"]), ("list_item", "item", ["One", "Deep"]),
        ("quote", "quoted", ["One", "Deep"]), ("code", "code  a\n\n# not a heading", ["One", "Deep"]), ("heading", "Two", ["One"]), ("paragraph", "last", ["One", "Two"]),
    ]


def test_html_modes():
    page = "<title>T</title><nav>Menu</nav><main><h1>A &amp; B</h1><p class='x y'>One<br>two<li>item<script>no</script></main><footer>End</footer>"
    plain = [(b[0], b[1]) for b in markup.scan_html(page, "plain")]
    assert ("title", "T") in plain and ("heading", "A & B") in plain and ("paragraph", "One\ntwo") in plain and ("list_item", "item") in plain
    main = [(b[1], b[2]) for b in markup.scan_html(page, "main")]
    assert main == [("One", ("A & B",)), ("two", ("A & B",)), ("item", ("A & B",))]
    rich = {b[1]: b for b in markup.scan_html(page, "structured")}
    assert rich["Menu"][4] == "navigation" and rich["End"][4] == "contentinfo" and rich["One"][3] and ".x" in rich["One"][5]
    assert markup.scan_html(None, "plain") == []


def test_tables(spark):
    rows = spark.createDataFrame([(1, 0, ["a|b", "c"]), (1, 1, ["x\ty"]), (1, 2, ["1", "2", "3"])], "doc_id long, row long, cells array<string>")
    grid = delimited.bounded_grid(rows)
    out = delimited.render(grid).first()
    assert out.markdown == "| a\\|b | c |  |\n| --- | --- | --- |\n| x\ty |  |  |\n| 1 | 2 | 3 |" and out.plain == "a|b\tc\t\nx y\t\t\n1\t2\t3"
    assert delimited.bounded_grid(rows, max_rows=2).where("limited").count() == 2
    big = spark.createDataFrame([(1, i, [str(i) * 40]) for i in range(9)], "doc_id long, row long, cells array<string>")
    groups = delimited.row_groups(delimited.bounded_grid(big), budget=200).orderBy("first_row").collect()
    assert groups[0].first_row == 1 and groups[-1].last_row == 8 and len(groups) > 2


def test_preview_and_files(spark, tmp_path):
    rows = spark.createDataFrame([(2, " q ", None), (3, "", "a"), (4, "x" * 4001, "y" * 12001)], "row long, question string, reference_answer string")
    got = {r.row: (r.question[:3], r.errors) for r in delimited.preview_dataset(rows).collect()}
    assert got == {2: ("q", ""), 3: ("", "question_length"), 4: ("xxx", "question_length,answer_length")}
    path = str(tmp_path / "out")
    delimited.export_csv(spark.createDataFrame([("=cmd", 'say "hi"\nthere')], "a string, b string"), path)
    back = delimited.read_delimited(spark, path).first()
    assert back.a == "'=cmd" and back.b == 'say "hi"\nthere'
    delimited.publish_index(spark.createDataFrame([(1, 5), (2, 6)], "index_id int, chunk int"), str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index")).where("index_id = 1").count() == 1


def test_fusion_by_hand(spark):
    left = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, item long, rank int")
    right = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, item long, rank int")
    rows = R.fuse(left, right, 0.5).orderBy("rank").collect()
    assert [r.item for r in rows] == [11, 10, 12] and rows[0].score == round(0.5 / 62 + 0.5 / 61, 9)
    assert [r.item for r in R.fuse(left, right, 1.0).orderBy("rank").collect()] == [10, 11]
    assert [r.item for r in R.fuse(left, right, 0.0).orderBy("rank").collect()] == [11, 12]


def test_citations_and_orders(spark):
    df = spark.createDataFrame([("x [S1, S9] `[S2]`\n```\n[S3]\n```", "3, 1, 1, 99"), ("none", "no numbers"), ("```[S1]", "2")], "a string, r string")
    rows = df.select(citations(df.a, F.array(F.lit("S1"), F.lit("S2"))).alias("c"), parse_order(df.r, F.lit(3)).alias("o")).collect()
    assert (rows[0].c.valid, rows[0].c.invalid, rows[0].c.missing) == (["S1"], ["S9"], False)
    assert rows[1].c.missing and rows[2].c.missing and [r.o for r in rows] == [[3, 1], [], [2]]


def test_context_packing_skips_what_does_not_fit(spark):
    items = spark.createDataFrame([(1, 1, "a" * 50), (1, 2, "b" * 60), (1, 3, "c" * 50)], "query_id long, rank int, text string")
    assert R.pack_context(items, 100).first().labels == ["S1", "S3"]
    assert [r.rank for r in R.readable(items, 100).collect()] == [1]


def test_web_search(spark):
    df = spark.createDataFrame([("The red fox",), ("a red house",), ("green fox den",)], "t string")
    pick = lambda q: [r.t for r in df.where(R.web_search(F.col("t"), q)).collect()]
    assert pick('"red fox"') == ["The red fox"] and pick("red -fox") == ["a red house"] and pick("house or den") == ["a red house", "green fox den"]


def test_stage_cache(spark, tmp_path):
    cache, calls = StageCache(spark, str(tmp_path)), []

    def build():
        calls.append(1)
        return run_steps(spark.range(3), lambda d: d.where("id > 0"), (lambda d, n: d.limit(n), 1))

    key = identity("s", "1", {"b": 1, "a": 2}, "in")
    assert key == identity("s", "1", {"a": 2, "b": 1}, "in") != identity("s", "2", {"a": 2, "b": 1}, "in")
    assert cache.get(key, build).count() == cache.get(key, build).count() == 1 and len(calls) == 1


def test_whole_tables_without_citations_and_references():
    page = """<h1>T</h1><p>One<sup class="reference">[1]</sup> two <a class="reference internal">kept</a>.</p><div class="reflist"><ol><li>cite</ol></div>
    <table><tr><th>A|x<th>B</tr><tr><td>1<td>in <table><tr><td>nested</table> cell</tr><tr><td></td></tr><tr><td>2<br>3</table>after
    <h2>Notes </h2><p>gone</p><table><tr><td>gone</table><h3>deeper</h3><p>gone too</p><h2>Next</h2><p>back"""
    got = [(b[0], b[1], b[2]) for b in markup.scan_html(page, "tables")]
    assert got == [
        ("heading", "T", ()), ("paragraph", "One two kept .", ("T",)), ("table", "| A\\|x | B |\n| --- | --- |\n| 1 | in nested cell |\n| 2 3 |  |", ("T",)),
        ("paragraph", "after", ("T",)), ("heading", "Next", ("T",)), ("paragraph", "back", ("T", "Next")),
    ]


def test_html_tables_become_grids(spark):
    pages = spark.createDataFrame([(7, "<table><tr><td>a<td>b</tr><tr><td>1</table><table><tr><td>z</table>"), (8, None)], "page_id long, html string")
    rows = sorted((r.doc_id, r.table, r.row, list(r.cells)) for r in markup.html_tables(pages).collect())
    assert rows == [(7, 0, 0, ["a", "b"]), (7, 0, 1, ["1"]), (7, 1, 0, ["z"])]
    grid = delimited.bounded_grid(markup.html_tables(pages).where("table = 0"))
    assert delimited.render(grid).first().markdown == "| a | b |\n| --- | --- |\n| 1 |  |"


def test_roles_and_selectors_come_from_the_element():
    page = '<main id="m"><div role="note" class="a b"><p>x <b class="c">y</b></p></div></main><aside>z</aside></p></div>tail'
    got = {b[1]: b[3:] for b in markup.scan_html(page, "structured")}
    assert got["x y"] == (True, "note", ["#m", ".a", ".b", "div", "main", "p"]) and got["z"][1] == "complementary" and got["tail"] == (False, None, [])


def test_selectors_and_headings_are_whole(spark, monkeypatch):
    """Names sort with dots first, so the element's own comes after those of 60 classes."""
    many = " ".join(f"c{n:02}" for n in range(60))
    page = f'<nav class="{many}"><p>links</p></nav><div class="{many} x-ad"><h2>{"long " * 200}end</h2><p id="z">text</p></div><p>kept</p>'
    got = {b[1]: (b[2], b[5]) for b in markup.scan_html(page, "structured")}
    assert len(got["links"][1]) == 62 and "nav" in got["links"][1] and {".x-ad", "#z", "div", "p"} < set(got["text"][1])
    assert got["text"][0] == ("long " * 200 + "end",)
    blocks = markup.html_blocks(spark.createDataFrame([(1, page)], "page_id long, html string"))
    assert [r.text for r in select_blocks(blocks, exclude=(".x-ad", "nav")).collect()] == ["kept"]
    monkeypatch.setattr(markup, "SELECTORS", 100)
    split = markup.html_blocks(spark.createDataFrame([(1, page)], "page_id long, html string"))
    assert sorted(split.collect()) == sorted(blocks.collect()) and blocks.count() == 4


def test_cover_density(spark):
    docs = spark.createDataFrame([(1, "red fox and a red hen, the fox"), (2, "fox fox red"), (3, "red only"), (4, None), (5, "red x x x fox")], "doc_id long, text string")
    ask = spark.createDataFrame([(7, "Red fox"), (8, "red"), (9, "")], "query_id long, query string")
    got = {(r.query_id, r.doc_id): (r.score, r.rank) for r in R.cover_density(docs, ask).collect()}
    # Covers of the first text: red fox; fox and a red (2 others between); red hen the fox (2 others).
    assert got[7, 1] == (round(0.1 + 0.1 / 3 + 0.1 / 3, 6), 1) and got[7, 2] == (0.1, 2) and got[7, 5] == (0.025, 3) and (7, 3) not in got
    assert got[8, 1] == (0.2, 1) and len([k for k in got if k[0] == 8]) == 4
