import duckdb
from pyspark.sql import functions as F

from lexiloom.llm.hosts import _part, filter_urls, reputation_sql

PAGES = "page_id long, url string, host string"
LABELS = "doc_id long, quality int, url string"


def judge(spark, pages, labels, **options):
    got = filter_urls(spark.createDataFrame([(i, u, "x") for i, u in pages], PAGES), spark.createDataFrame([(d, q, "x") for d, q in labels], LABELS), **options)
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()}


def test_rules_and_parts(spark):
    urls = ["https://WWW.Example.COM/en/1?x#y", "http://shop.example.com/en/", "http://example.com/de/", "http://a.net/es/", "http://net/fr/1", "http://x.net/esp/", "HTTP://e.com", "http://notexample.com/en/1", "x/://h.com/en/://z"]
    got = judge(spark, list(enumerate(urls)), [])
    assert got[0] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[1][2:] == ("example.com/en/", "block") and got[2][2:] == ("com/", "allow") and got[3][2:] == ("net/es/", "block")
    assert got[4][2:] == ("net/fr/", "block") and got[5][2] is None and got[6][:3] == ("e.com", "", None)
    assert got[7][2:] == ("com/", "allow") and got[8][:2] == ("h.com", "/en/://z")


def test_hosts_lean_on_their_domain_and_on_themselves(spark):
    good = [(i, f"http://a{i % 3}.good.org/{i}") for i in range(90)]
    bad = [(100 + i, f"http://b{i % 3}.bad.org/{i}") for i in range(90)]
    pages = [*good, *bad, (500, "http://new.good.org/"), (501, "http://new.bad.org/"), (502, "http://one.good.org/")]
    got = judge(spark, pages, [(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(502, 0)])
    assert got[0][3] == "allow" and got[500][3] == "allow" and got[100][3] == "block" and got[501][3] == "block"


def test_nulls_repeats_and_empty_tables(spark):
    got = filter_urls(spark.createDataFrame([(1, None, ""), (1, None, ""), (None, "no scheme", ""), (2, "http://a.org", "")], PAGES), spark.createDataFrame([(2, None, ""), (None, 1, "")], LABELS)).collect()
    assert len(got) == 4 and all(r.verdict in ("allow", "block") for r in got) and sum(r.host == "" and r.path == "" for r in got) == 3
    assert filter_urls(spark.createDataFrame([], PAGES), spark.createDataFrame([(1, 1, "")], LABELS)).count() == 0


def test_ports_and_addresses_do_not_make_levels(spark):
    hosts = [("shop.good.org:8080", 0), ("10.0.0.7", 0), ("10.0.0.7:81", 0), ("[::1]:9", 0), ("a.b.c.d.net", 0), ("", 0)]
    rows = spark.createDataFrame(hosts, "host string, n int").select("host", F.expr(_part("([^.]+[.])?[^.]*$", "regexp_like")).alias("d"), F.expr(_part("[^.]*$", "regexp_like")).alias("s")).collect()
    assert {r.host: (r.d, r.s) for r in rows} == {
        "shop.good.org:8080": ("good.org", "org"), "10.0.0.7": ("10.0.0.7", "10.0.0.7"), "10.0.0.7:81": ("10.0.0.7", "10.0.0.7"), "[::1]:9": ("[::1]", "[::1]"),
        "a.b.c.d.net": ("d.net", "net"), "": ("", ""),
    }


def test_sql_and_frames_agree_on_odd_hosts(spark):
    urls = [f"http://{h}/{i}" for i, h in enumerate(["10.0.0.7:81", "10.0.0.7", "x.good.org:8080", "x.good.org", "y.good.org", "[::1]:9"] * 9)]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], PAGES)
    labels = spark.createDataFrame([(i, i % 3 % 2, "x") for i in range(40)], LABELS)
    con = duckdb.connect()
    frames = {"pages": pages.toPandas(), "labels": labels.toPandas()}
    for name, frame in frames.items():
        con.register(name, frame)
    want = sorted(con.sql(reputation_sql("pages", "labels")).fetchall())
    assert sorted(tuple(r) for r in filter_urls(pages, labels).collect()) == want
