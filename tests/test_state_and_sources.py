import datetime as dt
import random
import shutil
import time
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from lexiloom.operators.evaluation import _edits, error_rate
from lexiloom.sources.linkgraph import depths, page_links, resolved, site_depths
from lexiloom.sources.pagestore import discovered, open_store, stream_store
from lexiloom.streaming.buckets import BucketTable
from lexiloom.streaming.leases import STATE_STORE, expired_leases, expired_leases_stream, joined

SF = "/root/testdata/sf0.001"
T = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)


def test_runs_join_within_the_gap():
    assert joined([(50, 50, 1), (0, 0, 1), (9, 9, 1)], 10) == [(0, 9, 2), (50, 50, 1)]
    assert joined([(0, 0, 1), (20, 20, 1), (10, 10, 1)], 11) == [(0, 20, 3)] and joined([(0, 0, 1), (10, 10, 1)], 10) == [(0, 0, 1), (10, 10, 1)]


def test_expired_leases_equal_the_batch_twin_over_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rng = random.Random(1)
    beats = sorted((T + dt.timedelta(seconds=rng.randrange(40_000)), rng.randrange(8)) for _ in range(600))
    # Within a part times are in disorder, and some beats of the first part come with the second, within the watermark.
    parts = [beats[:290] + beats[305:310], beats[290:305] + beats[310:], [(T + dt.timedelta(days=9), 99)], [(T + dt.timedelta(days=9, hours=1), 99)]]
    schema = "ts timestamp, user_id long"

    def go():
        rows = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        query = expired_leases_stream(rows, 300, "30 minutes").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination(180)
        assert query.exception() is None

    try:
        for part in parts:  # a new query each time, from the checkpoint
            rng.shuffle(part)
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            go()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").where("user_id < 99").collect())
    want = sorted(tuple(r) for r in expired_leases(spark.createDataFrame(beats, schema), 300).collect())
    assert got == want and len(want) > 100


def test_bucket_table_rewrites_what_a_batch_touches(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "item long, content_hash string, version long, removed boolean")
    kept = BucketTable(spark, f"file://{tmp_path}/t", 16)
    assert kept.rows() is None
    kept.merge(make([(i, f"a{i}", 1, False) for i in range(200)]), 0)
    kept.merge(make([(3, "b", 2, None), (500, "c", 1, False), (4, None, 2, True)]), 1)
    state = {r.item: (r.content_hash, r.version) for r in kept.rows().collect()}
    assert state[3] == ("b", 2) and state[500] == ("c", 1) and 4 not in state and state[5] == ("a5", 1) and len(state) == 200
    assert sum(e == 1 for e in kept.manifest().values()) <= 3 and len(kept.manifest()) == 16
    again = BucketTable(spark, f"file://{tmp_path}/t", 16)  # a restart; a batch delivered again; late news of a removed item
    again.merge(make([(7, "z", 9, False)]), 1)
    again.merge(make([(4, "old", 1, False)]), 2)
    assert {r.item: (r.content_hash, r.version) for r in again.rows().collect()} == state
    assert [(r.item, r.version) for r in again.rows(tombstones=True).where("removed").collect()] == [(4, 2)]
    again.merge(make([]), 3)
    again.vacuum(keep=1)
    assert {r.item: (r.content_hash, r.version) for r in again.rows().collect()} == state and again.epochs() == [3]
    # A batch that broke off before its manifest is not seen, and is overwritten when it comes again.
    again.merge(make([(3, "d", 3, False)]), 4)
    shutil.rmtree(tmp_path / "t" / "manifest" / "epoch=4")
    again.merge(make([(3, "e", 3, False)]), 4)
    assert again.rows().where("item = 3").first().content_hash == "e"


def test_the_page_store_reads_the_table_in_batches_and_by_cursor(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id")
    n = pages.count()
    pages.repartitionByRange(3, "page_id").write.option("parquet.block.size", 4096).parquet(f"{tmp_path}/pages")
    whole = open_store(spark, f"{tmp_path}/pages")
    key = lambda df: sorted((r.page_id, r.url, r.html) for r in df.select("page_id", "url", "html").collect())
    assert key(whole) == key(pages) and sorted(r.position for r in whole.collect()) == list(range(n))

    def go(seconds):
        query = stream_store(spark, f"{tmp_path}/pages", 7).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").start()
        query.awaitTermination(seconds)
        query.stop()
        return [b["numInputRows"] for b in query.recentProgress]

    first = go(4)
    assert all(x <= 7 for x in first)
    for _ in range(6):  # restarts go on from the checkpoint's cursor
        if (tmp_path / "out").exists() and spark.read.schema("page_id long").parquet(f"{tmp_path}/out").count() >= n:
            break
        go(8)
    assert key(spark.read.parquet(f"{tmp_path}/out")) == key(pages)
    rows = spark.createDataFrame([(1, "u", "x"), (2, "u", ""), (3, "u", None), (4, "u", "y")], "page_id long, url string, html string")
    known = spark.createDataFrame([(1, "no"), (2, "no")], "page_id long, content_hash string").unionByName(rows.where("page_id = 4").select("page_id", F.sha2("html", 256).alias("content_hash")))
    assert {r.page_id: r.outcome for r in discovered(rows, known).collect()} == {1: "changed", 2: "failed", 3: "failed", 4: "unchanged"}


def test_references_are_resolved_by_the_standard(spark):
    base = "http://a/b/c/d;p?q"  # the examples of RFC 3986, 5.4, without fragments
    cases = {"g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g/", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": base,
             "g#s": "http://a/b/c/g", ";x": "http://a/b/c/;x", "": base, ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/",
             "../../g": "http://a/g", "../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "g/./h": "http://a/b/c/g/h",
             "g/../h": "http://a/b/c/h", "g;x=1/../y": "http://a/b/c/y", "g?y/../x": "http://a/b/c/g?y/../x", "HTTPS://Ex.ORG/Path": "https://ex.org/Path", "mailto:a@b": None, "javascript:x()": None, " g\n": "http://a/b/c/g"}
    rows = spark.createDataFrame([(base, r) for r in cases] + [("http://h", "x"), (None, "x"), ("http://h/p", None)], "b string, r string")
    got = [r[0] for r in rows.select(resolved(F.col("b"), F.col("r"))).collect()]
    assert got == [*cases.values(), "http://h/x", None, None]


def test_links_have_anchors_and_targets(spark):
    html = """<!-- <a href="/no">x</a> --><A HREF='/one?a=1&amp;b=2'>First <b>one</b>
      </A><a name=x>none</a><a href=two>2<area href="#top"><script><a href="/js">js</a></script><a title="a > b" href="//o.org/x">other</a>"""
    rows = [(1, "https://h.org/dir/page", html), (2, "https://h.org/", '<base href="/deep/er/"><a href="x">X</a>'), (3, None, '<a href="/a">A</a>'), (4, "https://h.org/", None)]
    got = [tuple(r) for r in page_links(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id", "nth").collect()]
    assert got == [(1, 0, "/one?a=1&b=2", "First one", "https://h.org/one?a=1&b=2"), (1, 1, "two", "2", "https://h.org/dir/two"), (1, 2, "#top", "", "https://h.org/dir/page"),
                   (1, 3, "//o.org/x", "other", "https://o.org/x"), (2, 0, "x", "X", "https://h.org/deep/er/x"), (3, 0, "/a", "A", None)]


@pytest.mark.parametrize("shape", ["random", "chain"])
def test_depths_equal_a_search_in_memory(spark, shape):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(120)}", f"n{rng.randrange(160)}") for _ in range(260)] if shape == "random" else [(f"n{i}", f"n{i + 1}") for i in range(12)] + [("n12", "n0"), ("n3", "n3")]
    nodes, starts = [f"n{i}" for i in range(130)], ["n0", "n7", "unknown"] if shape == "random" else ["n0"]
    out, found, queue = defaultdict(list), {}, deque((s, 0) for s in starts if s in nodes)
    for a, b in edges:
        out[a].append(b)
    while queue:
        node, d = queue.popleft()
        if node in nodes and node not in found:
            found[node] = d
            queue.extend((x, d + 1) for x in out[node])
    one = lambda rows: spark.createDataFrame([(x,) for x in rows], "node string")
    got = depths(one(nodes), spark.createDataFrame(edges, "a string, b string"), one(starts))
    assert {r.node: r.depth for r in got.collect()} == found and got.count() == len(found)


def test_site_depths_stay_within_a_host(spark):
    rows = [(1, "http://h/a#x", '<a href="b">b</a><a href="http://i/c">c</a>'), (2, "http://h/b", '<a href="/a">a</a>'), (3, "http://h/z", ""), (4, "http://i/c", '<a href="/d">d</a>'), (5, "http://i/d", None), (6, None, "<a href=/x>x</a>")]
    got = sorted(tuple(r) for r in site_depths(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [("h", "http://h/a", 0), ("h", "http://h/b", 1), ("h", "http://h/z", None), ("i", "http://i/c", 0), ("i", "http://i/d", 1)]


def test_edits_equal_the_plain_table(spark):
    def plain(r, h):
        row = [0] * (len(h) + 1)
        for i, c in enumerate(r, 1):
            new = [i]
            for j, d in enumerate(h, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
            row = new
        return min(row)

    rng = random.Random(4)
    for _ in range(800):
        r, h = "".join(rng.choices("abcé🙂", k=rng.randrange(1, 80))), "".join(rng.choices("abcéx", k=rng.randrange(0, 90)))
        assert _edits(r, h) == plain(r, h)
    many = "".join(chr(200 + n % 900) for n in range(2000))
    assert _edits(many, "zz" + many[:1000] + "yy" + many[1001:] + "zz") == 2
    long = "".join(rng.choices("abcdefgh ", k=30_000))
    df = spark.createDataFrame([(long, long[:15_000] + "QQQ" + long[15_010:]), ("", "x"), (None, None)], "reference string, hypothesis string")
    assert [round(x.error_rate, 7) for x in error_rate(df).collect()] == [round(10 / 30_000, 7), 0.0, 0.0]


def test_lines_with_characters_left_out_take_linear_time():
    rng = random.Random(3)

    def plain(reference, hypothesis):
        row = [0] * (len(hypothesis) + 1)
        for n, r in enumerate(reference, 1):
            last, row = row, [n]
            for m, h in enumerate(hypothesis, 1):
                row.append(min(last[m] + 1, row[-1] + 1, last[m - 1] + (r != h)))
        return min(row)

    for _ in range(3000):
        reference = "".join(rng.choices("abc", k=rng.randrange(9)))
        kept = "".join(c for c in reference if rng.random() < 0.7)
        for hypothesis in (kept, "".join(rng.choices("abcd", k=rng.randrange(9))), kept + "ab", reference[2:] + "c"):
            assert _edits(reference, hypothesis) == plain(reference, hypothesis), (reference, hypothesis)
    line = "".join(rng.choices("abcdefgh ", k=400_000))
    began = time.process_time()
    assert _edits(line, line.replace("e", "")) == line.count("e")
    assert time.process_time() - began < 3
