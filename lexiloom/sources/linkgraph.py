"""The graph of links between pages: references resolved in column expressions, depths by frontier joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.session import discard, materialize, table

#: Scheme, authority, path, query and fragment of a reference.
_REFERENCE = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(?:#.*)?$"
_INSIDE = r"((?:[^>\"']|\"[^\"]*\"|'[^']*')*)"
_ANCHOR = rf"(?is)<(?:a\b{_INSIDE}>((?:(?!<a\b|<area\b|</a\s*>).)*)|area\b{_INSIDE}>)"
_HREF = r"(?is)(?:^|\s)href\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)"


def without_dot_steps(path: Column) -> Column:
    """A path with its steps of one and two dots taken (RFC 3986, 5.2.4); empty steps stay."""
    parts = F.split(path, "/")
    step = lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.array_append(done, x))
    # The first step of an absolute path is empty and is never taken back.
    kept = F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(F.element_at(parts, 1)), step)
    last = F.element_at(parts, -1)
    return F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))


def resolved(base: Column, reference: Column) -> Column:
    """A reference against a base URL, without its fragment; null if it leads nowhere on the web.

    Any form of reference: whole URLs, ``//host/path``, ``/path``, ``path``, ``../path``, ``?query``, ``#part`` and
    the empty one. Scheme and host come in lower case. Other schemes than http and https give null, as do null
    bases and references.
    """
    ref = F.regexp_replace(F.trim(reference), r"[\t\n\r]", "")
    part = lambda text, n: F.regexp_extract(text, _REFERENCE, n)
    scheme, authority, path, query = (part(ref, n) for n in (1, 2, 3, 4))
    own, host, base_path, base_query = F.lower(part(base, 1)), part(base, 2), part(base, 3), part(base, 4)
    folder = F.regexp_extract(base_path, "^(.*/)[^/]*$", 1)
    merged = F.when(path.startswith("/"), path).when(folder == "", F.concat(F.lit("/"), path)).otherwise(F.concat(folder, path))
    foreign, away = scheme != "", authority != ""
    to_scheme = F.when(foreign, F.lower(scheme)).otherwise(own)
    to_host = F.lower(F.when(foreign | away, authority).otherwise(host))
    to_path = F.when(foreign | away, path).when(path == "", base_path).otherwise(merged)
    to_query = F.when(foreign | away | (path != "") | (query != ""), query).otherwise(base_query)
    web = to_scheme.isin("http", "https") & (to_host != "")
    return F.when(web, F.concat(to_scheme, F.lit("://"), to_host, F.when(to_path == "", "/").otherwise(without_dot_steps(to_path)), to_query))


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, nth, href, anchor text and target of every link of ``pages`` (page_id, url, html), in order.

    A page's ``base`` element is the base of its references. Targets are resolved and have no fragment. Null
    pages have no links; a link without href is none.
    """
    plain = F.regexp_replace("html", r"(?is)<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>", " ")
    unquoted = lambda h: F.regexp_replace(h, r"^[\"']|[\"']$", "")
    decoded = lambda h: F.replace(h, F.lit("&amp;"), F.lit("&"))
    own = F.nullif(unquoted(F.regexp_extract("plain", r"(?is)<base\b[^>]*?\shref\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", plain.alias("plain")).withColumn("base", F.when(own.isNotNull(), resolved(F.col("url"), own)))
    rows = rows.withColumn("base", F.coalesce("base", "url"))
    part = lambda n: F.regexp_extract_all("plain", F.lit(_ANCHOR), n)
    both = F.zip_with(part(1), part(3), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
    found = F.arrays_zip(both.alias("attributes"), part(2).alias("inner"))
    links = rows.select("page_id", "base", F.posexplode(found).alias("nth", "x"))
    links = links.withColumn("href", F.regexp_extract("x.attributes", _HREF, 1)).where("href <> ''")
    text = F.trim(F.regexp_replace(F.regexp_replace("x.inner", r"<[^>]*>", " "), r"\s+", " "))
    href = decoded(unquoted(F.col("href")))
    order = Window.partitionBy("page_id").orderBy("place")
    out = links.select("page_id", F.col("nth").alias("place"), href.alias("href"), text.alias("anchor"), resolved(F.col("base"), href).alias("target"))
    return out.withColumn("nth", F.row_number().over(order) - 1).select("page_id", "nth", "href", "anchor", "target")


def without_fragment(url) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def depths(nodes: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, depth): the fewest steps over ``edges`` (a, b) from ``starts`` (node); unreached nodes have none.

    A breadth-first search: each round joins the frontier with the edges, drops what was visited, and is
    written; one count a round reaches the driver. Edges are written once, dealt by their first end, which is
    shuffled no more; a node of very many links is split by adaptive execution.
    """
    known = nodes.select("node").distinct()
    ways = edges.where("a <> b").join(known, F.col("b") == F.col("node"), "left_semi").select("a", "b").distinct()
    ways = materialize(ways, "edges")
    visited = materialize(starts.join(known, "node", "left_semi").select("node").distinct().withColumn("depth", F.lit(0).cast("long")), "visited")
    depth, frontier, rounds = 0, visited, [visited]
    while not frontier.isEmpty():
        depth += 1
        reached = frontier.select(F.col("node").alias("a")).join(ways, "a").select(F.col("b").alias("node")).distinct()
        fresh = reached.join(visited.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth).cast("long"))
        frontier = materialize(fresh, "frontier")
        rounds.append(frontier)
        # One table of all visited nodes every few rounds, so that the plan does not grow with the depth.
        visited = visited.unionByName(frontier)
        if len(rounds) == 8:
            visited = materialize(visited, "visited")
            for done in rounds[:-1]:
                discard(done)
            rounds = [visited, frontier]
    discard(ways)
    return visited


def site_depths(pages: DataFrame) -> DataFrame:
    """(host, url, depth) of the pages' URLs, from each host's page of the smallest page_id; null: not reached.

    Links lead within a host only. Repeated URLs are one; pages without a URL are left out.
    """
    host = F.lower(F.regexp_extract("url", r"://([^/?#]+)", 1))
    known = pages.where("url IS NOT NULL").select("page_id", host.alias("host"), without_fragment("url").alias("node"))
    links = page_links(pages).where("target IS NOT NULL")
    ends = known.join(links.select(F.col("page_id").alias("l_id"), "target"), F.col("page_id") == F.col("l_id"))
    edges = ends.where(F.lower(F.regexp_extract("target", r"://([^/?#]+)", 1)) == F.col("host")).select(F.col("node").alias("a"), F.col("target").alias("b"))
    starts = known.groupBy("host").agg(F.min_by("node", "page_id").alias("node")).select("node")
    found = depths(known, edges, starts).select(F.col("node").alias("v_node"), "depth")
    return known.select("host", "node").distinct().join(found, F.col("node") == F.col("v_node"), "left").select("host", F.col("node").alias("url"), "depth")


def _linked(spark, sf):
    """Pages with links to the second and third page after their number within their host, in four forms of reference.

    The page numbered n of a host leads to those numbered 2n and 2n + 1; every 17th leads nowhere.
    """
    host, order = F.regexp_extract("url", r"://([^/?#]+)", 1), Window.partitionBy("host").orderBy("page_id")
    rows = table(spark, sf, "pages").withColumn("host", host).withColumn("n", F.row_number().over(order)).withColumn("u", without_fragment("url"))
    to = rows.select(F.col("host").alias("t_host"), F.col("n").alias("t_n"), F.col("u").alias("t"))
    path = F.regexp_extract("t", r"^https?://[^/?#]+(.*)$", 1)
    same = F.regexp_extract("t", "^(https?):", 1) == F.regexp_extract("u", "^(https?):", 1)
    # Forms without a scheme keep the page's own, so they are used where both agree.
    ref = F.when(~same | (F.col("t_n") % 4 == 0), F.col("t")).when(F.col("t_n") % 4 == 1, F.concat(F.lit("//"), F.col("host"), path)).when(F.col("t_n") % 4 == 2, path).otherwise(F.concat(F.lit("../x/./../.."), path))
    link = F.concat(F.lit('<a class="n" href="'), F.replace(ref, F.lit("&"), F.lit("&amp;")), F.lit('#part"><b>Page</b> '), F.col("t_n").cast("string"), F.lit("</a>"))
    pairs = rows.where("n % 17 > 0").select("page_id", "host", "u", F.explode(F.array(F.col("n") * 2, F.col("n") * 2 + 1)).alias("m"))
    made = pairs.join(to, (F.col("host") == F.col("t_host")) & (F.col("m") == F.col("t_n"))).groupBy(F.col("page_id").alias("l_id")).agg(F.array_join(F.array_sort(F.collect_list(link)), " ").alias("links"))
    return rows.join(made, F.col("page_id") == F.col("l_id"), "left").select("page_id", "url", F.concat("html", F.coalesce("links", F.lit(""))).alias("html"))


def q_resolved(spark, sf):
    """Targets and anchor texts of all links of the pages as they are."""
    return page_links(table(spark, sf, "pages"))


def q_depths(spark, sf):
    return site_depths(_linked(spark, sf))


def q_crawl(spark, sf):
    """Per host: pages reached by links, the depth that reaches them, and whether links alone find nine tenths of them."""
    found = site_depths(_linked(spark, sf)).groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count("depth").alias("reached"), F.max("depth").alias("depth"))
    return found.withColumn("discovery", F.when(F.col("reached") * 10 >= F.col("pages") * 9, "links").otherwise("sitemap"))


_N = "(SELECT regexp_extract(url, '://([^/?#]+)', 1) AS host, regexp_replace(url, '#.*$', '') AS url, row_number() OVER (PARTITION BY regexp_extract(url, '://([^/?#]+)', 1) ORDER BY page_id) AS n FROM pages)"
#: DuckDB: the same search. Nodes are URLs, so one that several pages share has the links of all of them.
_DEPTHS = f"""(WITH RECURSIVE n AS (SELECT * FROM {_N}),
  e AS (SELECT DISTINCT a.url AS a, b.url AS b FROM n a JOIN n b ON a.host = b.host AND b.n // 2 = a.n WHERE a.n % 17 > 0 AND a.url <> b.url),
  d (url, depth) USING KEY (url) AS (SELECT url, 0 AS depth FROM n WHERE n = 1
    UNION SELECT e.b, min(d.depth) + 1 FROM d JOIN e ON e.a = d.url WHERE NOT EXISTS (SELECT 1 FROM recurring.d AS seen WHERE seen.url = e.b) GROUP BY 1)
  SELECT n.host, n.url, min(d.depth) AS depth FROM n LEFT JOIN d ON d.url = n.url GROUP BY 1, 2)"""

QUERIES = {
    "resolved_links": (
        q_resolved,
        """SELECT page_id, generate_subscripts(h, 1) - 1 AS nth, unnest(h) AS href, unnest(list_transform(x, lambda s: trim(regexp_replace(regexp_replace(s, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')))) AS anchor,
        regexp_extract(lower(url), '^(https?://[^/?#]+)', 1) || unnest(h) AS target
        FROM (SELECT page_id, url, regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"[^>]*>', 1) AS h, regexp_extract_all(html, '<a\\s[^>]*href="[^"]*"[^>]*>(.*?)</a>', 1) AS x FROM pages)""",
    ),
    "site_depths": (q_depths, f"SELECT * FROM {_DEPTHS}"),
    "crawl_discovery": (q_crawl, f"SELECT host, count(*) AS pages, count(depth) AS reached, max(depth) AS depth, CASE WHEN count(depth) * 10 >= count(*) * 9 THEN 'links' ELSE 'sitemap' END AS discovery FROM {_DEPTHS} GROUP BY 1"),
}
