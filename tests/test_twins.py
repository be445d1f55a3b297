"""Queries against their DuckDB twins on small tables of odd rows."""

import duckdb
import pytest

from lexiloom import registry


def both(spark, folder, name, tables):
    """Rows of a query and of its twin over ``tables`` (name to rows and schema)."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = registry.QUERIES[name](spark, str(folder))
    want = con.sql(registry.ORACLES[name])
    at = [want.columns.index(c) for c in df.columns]
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    return got, sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def shared_url_pages():
    """71 pages of a host; the 35th, which no link reaches by its number, has the URL of the second."""
    url = lambda n: f"https://a.example.com/p/{2 if n == 35 else n}"
    return {"pages": ([(n, url(n), "<article><p>Text</p></article>") for n in range(1, 72)], "page_id long, url string, html string")}


def test_pages_of_one_url_share_their_links(spark, tmp_path):
    got, want = both(spark, tmp_path, "site_depths", shared_url_pages())
    assert got == want
    assert {u.rsplit("/", 1)[1]: d for _, u, d in got}["70"] == 2  # from the 35th page's URL


def test_discovery_counts_pages_behind_a_shared_url(spark, tmp_path):
    got, want = both(spark, tmp_path, "crawl_discovery", shared_url_pages())
    assert got == want


@pytest.mark.parametrize("name", ["html_file_blocks", "html_main_blocks", "html_structured_blocks"])
def test_characters_named_without_a_semicolon(spark, tmp_path, name):
    html = "<html><head><title>Left and&amp</title></head><body><article><h1>Left and&amp</h1><p>a &lt b &amp;lt c&ampd</p></article><footer>&copy 2024</footer></body></html>"
    got, want = both(spark, tmp_path, name, {"pages": ([(1, "https://a.example.com/", html)], "page_id long, url string, html string")})
    assert got == want and got
