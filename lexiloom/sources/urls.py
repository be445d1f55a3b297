"""URL normalisation, scope, tracking parameters, links, robots and sitemap rules."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import quote, unquote, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.session import table

#: Fixed values.
TRACKING = ("ref", "fbclid", "gclid")
KEY_BYTES = 2000
#: Signs of a path that stay as they are.
PATH_SIGNS = "/:@!$&'()*+,;=-._~"

_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*):(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
_HOST = r"^(\[[^\]]*\]|[^:\[\]]*)"


def _decoded(path: Column) -> Column:
    """The path with percent signs resolved; signs that start no escape stay."""
    whole = F.regexp_replace(F.replace(path, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(whole), path)


def _without_dots(path: Column) -> Column:
    """Steps of one and two dots resolved; two leading slashes and a trailing one stay."""
    step = lambda done, x: F.when(x.isin("", "."), done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, x))
    steps = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    lead = F.when(path.rlike("^//(?!/)"), "//").otherwise("/")
    tail = F.when(path.endswith("/") & (F.size(steps) > 0), "/").otherwise("")
    return F.concat(lead, F.array_join(steps, "/"), tail)


def _encoded(path: Column) -> Column:
    """Percent-encoded, but for letters, digits, ``PATH_SIGNS`` and the percent sign."""
    form = F.replace(F.url_encode(path), F.lit("+"), F.lit("%20"))
    kept = reduce(lambda c, sign: F.replace(c, F.lit(f"%{ord(sign):02X}"), F.lit(sign)), PATH_SIGNS, form)
    return F.replace(kept, F.lit("%25"), F.lit("%"))


def canonical_url(column) -> Column:
    """Canonical form of each URL, or why it has none, as a struct (url, violation); no row leaves the JVM.

    Scheme and host in lower case, the host in its ASCII form, no default port, dots of the path
    resolved, the path encoded anew, no fragment. Other schemes and credentials are refused.
    """
    url = F.regexp_replace(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")), r"^[\x00-\x20]+", "")
    scheme, authority = F.lower(F.regexp_extract(url, _URL, 1)), F.regexp_extract(url, _URL, 2)
    raw = F.regexp_extract(authority, _HOST, 1)
    bare = F.regexp_replace(raw, r"[\[\]]", "")
    host = F.regexp_replace(F.lower(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), bare)), r"\.+$", "")
    after = F.regexp_replace(authority, _HOST, "")
    port = F.when(after.rlike(r"^:[0-9]{1,5}$"), F.substring(after, 2, 5).cast("int"))
    default = F.when(scheme == "http", 80).otherwise(443)
    violation = (
        F.when(~scheme.isin("http", "https"), "unsafe_scheme")
        .when(authority.contains("@"), "url_credentials")
        .when(~after.rlike(r"^(:[0-9]{0,5})?$") | (port > 65535), "invalid_url")
        .when(bare == "", "invalid_url")
        .when(host.isNull() | ~F.length(host).between(1, 253), "invalid_hostname")
    )
    path = _decoded(F.regexp_extract(url, _URL, 3))
    where = F.concat(F.when(host.contains(":"), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host), F.when(port != default, F.concat(F.lit(":"), port.cast("string"))).otherwise(""))
    query = F.regexp_extract(url, _URL, 4)
    whole = F.concat(scheme, F.lit("://"), where, _encoded(_without_dots(F.when(path == "", "/").otherwise(path))), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.struct(F.when(violation.isNull(), whole).alias("url"), violation.alias("violation"))


def origin(url):
    return F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)


def strip_tracking(url):
    """The URL without utm_* and other tracking parameters; the others keep order and encoding."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    key = lambda s: F.lower(F.try_url_decode(F.substring_index(s, "=", 1)))
    kept = F.filter(F.split(query, "&"), lambda s: ~(key(s).startswith("utm_") | key(s).isin(*TRACKING)))
    joined = F.array_join(kept, "&")
    bare, fragment = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"(#.*)$", 1)
    return F.when(query == "", url).otherwise(F.concat(bare, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(""), fragment))


def bounded_key(value, limit: int = KEY_BYTES):
    """The value, or its start and a digest if it is longer than ``limit`` bytes."""
    head = F.expr(f"left({value}, {limit - 80})")
    return F.when(F.octet_length(value) <= limit, F.col(value)).otherwise(F.concat(head, F.lit("…#sha256="), F.sha2(value, 256)))


def in_scope(url, origins, include=(), exclude=()):
    """Origin allowed, one include prefix if any, no exclude prefix; paths are compared decoded."""
    path = F.coalesce(F.nullif(F.try_url_decode(F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)), F.lit("")), F.lit("/"))
    starts = lambda prefixes: F.exists(F.array(*map(F.lit, prefixes)), lambda p: path.startswith(p))
    out = origin(url).isin(*origins)
    if include:
        out = out & starts(include)
    return out & ~starts(exclude) if exclude else out


def links(pages: DataFrame) -> DataFrame:
    """href of every anchor of a page, in order; quoted either way or bare."""
    anchor = r"(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)"
    found = F.transform(F.regexp_extract_all("html", F.lit(anchor), 1), lambda h: F.regexp_replace(h, r"^[\"']|[\"']$", ""))
    return pages.select("page_id", F.posexplode(found).alias("nth", "href"))


def page_identity(pages: DataFrame) -> DataFrame:
    """page_id, the page's own canonical link (null if it has none), and its visible text without markup."""
    link = F.regexp_extract("html", r"(?is)<link\b([^>]*\brel\s*=\s*[\"']?canonical\b[^>]*)>", 1)
    href = F.regexp_extract(link, r"(?is)\bhref\s*=\s*[\"']?([^\s\"'>]+)", 1)
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<!--.*?-->|<(script|style|noscript|template|svg|head)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    return pages.select("page_id", F.nullif(href, F.lit("")).alias("canonical"), F.trim(F.regexp_replace(bare, r"\s+", " ")).alias("visible"))


@dataclass
class Group:
    """The agents of a robots.txt group, its rules (path, allowed) in order, and its delay."""

    agents: list[str] = field(default_factory=list)
    rules: list[tuple[str, bool]] = field(default_factory=list)
    delay: float | None = None
    closed: bool = False  # a rule or delay came, so that the next agent starts another group


def _path_of(url: str) -> str:
    """What rules are compared with: everything of a URL behind its host, encoded."""
    parts = urlsplit(unquote(url))
    return quote(urlunsplit(("", "", parts.path, parts.query, parts.fragment)))


def robots_groups(text: str, blank_ends: bool) -> list[Group]:
    """The groups of a robots.txt; ``blank_ends``: a blank line ends a group, else only a User-agent line does."""
    groups, now = [], Group()
    for line in [*text.splitlines(), None]:
        if line is None or (line == "" and blank_ends):
            groups += [now] if now.closed else []
            now = Group()
            continue
        key, _, value = (x.strip() for x in line.partition("#")[0].partition(":"))
        key, value = key.lower(), unquote(value)
        if key == "user-agent":
            if now.closed:
                groups.append(now)
                now = Group()
            now.agents.append(value.lower())
        elif now.agents and key in ("allow", "disallow", "crawl-delay"):
            now.closed = True
            if key == "crawl-delay":
                now.delay = float(value) if value.isdigit() else now.delay
            else:
                # An empty Disallow allows everything.
                now.rules.append((_path_of(value), key == "allow" or not value))
    return groups


class Robots:
    """robots.txt read twice, with groups that a blank line ends and with groups that only a User-agent line ends; both must allow."""

    def __init__(self, text: str):
        self.readings = [robots_groups(text, blank_ends) for blank_ends in (True, False)]
        head = text.lower().partition("user-agent")[0]
        fields = [[x.strip() for x in line.partition("#")[0].partition(":")] for line in head.splitlines()]
        self.before = max((float(value) for key, _, value in fields if key == "crawl-delay" and value.isdigit()), default=0.0)

    def _group(self, groups: list[Group], agent: str) -> Group:
        """The first group that names the agent, else the first for all."""
        name = agent.split("/")[0].lower()
        named = (g for g in groups if "*" not in g.agents and any(a in name for a in g.agents))
        return next(named, None) or next((g for g in groups if "*" in g.agents), Group())

    def allows(self, agent: str, url: str) -> bool:
        path = _path_of(url) or "/"
        firsts = (next((ok for rule, ok in self._group(g, agent).rules if rule == "*" or path.startswith(rule)), True) for g in self.readings)
        return all(firsts)

    def delay(self, agent: str) -> float | None:
        return max(self.before, *(self._group(g, agent).delay or 0.0 for g in self.readings)) or None


def robots_allow(pages: DataFrame, agent: str = "*") -> DataFrame:
    """allowed and delay of each (url, robots) row."""

    @F.pandas_udf("struct<allowed: boolean, delay: double>")
    def run(url: pd.Series, robots: pd.Series) -> pd.DataFrame:
        rules: dict = {}
        rows = []
        for u, text in zip(url, robots.fillna(""), strict=True):
            if text not in rules:
                rules[text] = Robots(text)
            rows.append((rules[text].allows(agent, u or ""), rules[text].delay(agent)))
        return pd.DataFrame(rows, columns=["allowed", "delay"])

    return pages.withColumn("rule", run("url", "robots"))


def sitemap(rows: DataFrame) -> DataFrame:
    """(page, loc, lastmod) of sitemap XML; a date alone means the end of that day; documents with types or entities are refused."""
    safe = rows.where(~F.upper("xml").rlike("<!DOCTYPE|<!ENTITY"))
    schema = "url array<struct<loc: string, lastmod: string>>"
    entry = safe.select("site", F.explode(F.from_xml("xml", F.lit(schema), {"rowTag": "urlset"})["url"]).alias("u"))
    moment = F.when(F.length("u.lastmod") == 10, F.date_add(F.to_date("u.lastmod"), 1).cast("timestamp")).otherwise(F.try_to_timestamp("u.lastmod"))
    return entry.select("site", F.trim("u.loc").alias("loc"), moment.alias("lastmod"))


def q_canonical(spark, sf):
    """The pages' URLs in six spellings: capitals, a default port, dots in the path, another scheme, credentials, and as they are."""
    scheme, rest = F.regexp_extract("url", "^(https?)://", 1), F.regexp_extract("url", "^https?://(.*)$", 1)
    host, path = F.regexp_extract(rest, "^([^/?#]*)", 1), F.regexp_extract(rest, "^[^/?#]*(.*)$", 1)
    way = F.col("page_id") % 6
    spelled = (
        F.when(way == 0, F.concat(F.upper(scheme), F.lit("://"), F.upper(host), path)).when(way == 1, F.concat(scheme, F.lit("://"), host, F.when(scheme == "http", ":80").otherwise(":443"), path))
        .when(way == 2, F.concat(scheme, F.lit("://"), host, F.lit("/x/./y/../.."), path)).when(way == 3, F.concat(F.lit("ftp://"), rest)).when(way == 4, F.concat(scheme, F.lit("://me:pw@"), rest)).otherwise(F.col("url"))
    )
    return table(spark, sf, "pages").select("page_id", canonical_url(spelled).alias("c")).select("page_id", "c.url", "c.violation")


def q_origin(spark, sf):
    return table(spark, sf, "pages").groupBy(origin(F.col("url")).alias("origin")).agg(F.count(F.lit(1)).alias("pages"))


def q_tracking(spark, sf):
    return table(spark, sf, "pages").select("page_id", strip_tracking(F.col("url")).alias("url"))


def q_key(spark, sf):
    return table(spark, sf, "pages").select("page_id", bounded_key("html").alias("k")).select("page_id", F.sha2("k", 256).alias("key_sha256"), F.length("k").cast("long").alias("n_chars"))


def q_scope(spark, sf):
    """The pages of a crawl that starts from the first ten hosts in order: its configured origins."""
    pages = table(spark, sf, "pages")
    hosts = pages.select(F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host")).distinct().orderBy("host").limit(10).collect()
    origins = [f"{scheme}://{r.host}" for scheme in ("http", "https") for r in hosts] or [""]
    return pages.where(in_scope(F.col("url"), origins, include=("/en/", "/fr/"), exclude=("/en/9",))).select("page_id", "url")


def q_links(spark, sf):
    return links(table(spark, sf, "pages"))


def q_identity(spark, sf):
    """Every second page names a canonical page of its own host, its attributes in either order."""
    to = F.concat(F.regexp_extract("url", "^(https?://[^/?#]+)", 1), F.lit("/c/"), F.col("page_id").cast("string"))
    link = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit('<link rel="canonical" href="'), to, F.lit('">'))).when(F.col("page_id") % 4 == 2, F.concat(F.lit("<LINK href='"), to, F.lit("' rel='canonical'/>"))).otherwise("")
    pages = table(spark, sf, "pages").withColumn("html", F.regexp_replace("html", "^(.*?<head>)", F.concat(F.lit("$1"), link)))
    return page_identity(pages).select("page_id", "canonical", F.sha2("visible", 256).alias("visible_sha256"))


def q_sections(spark, sf):
    """Distinct URLs of each host by first path segment, seen on secure and on plain pages: a full outer join."""
    url = strip_tracking(F.regexp_replace("url", "#.*$", ""))
    pages = table(spark, sf, "pages").select(F.regexp_extract("url", "^(https?)", 1).alias("scheme"), F.regexp_extract("url", r"://([^/?#]+)", 1).alias("host"), F.regexp_extract("url", r"://[^/?#]+/([^/?#]*)", 1).alias("section"), url.alias("u"))
    count = lambda s, n: pages.where(F.col("scheme") == s).groupBy("host", "section").agg(F.countDistinct("u").alias(n))
    return count("https", "secure").join(count("http", "plain"), ["host", "section"], "full_outer").na.fill(0, ["secure", "plain"])


def q_robots(spark, sf):
    """Rules made of each page's language; the group's blank line must not end it."""
    rules = F.concat(F.lit("User-agent: other\nCrawl-delay: 9\n\nUser-agent: *\n\nCrawl-delay: "), (F.col("page_id") % 5).cast("string"), F.lit("\nDisallow: /"), F.regexp_extract("url", r"://[^/?#]+/([^/?#]*)", 1), F.lit("/1\n"))
    return robots_allow(table(spark, sf, "pages").withColumn("robots", rules)).select("page_id", "rule.allowed", "rule.delay")


def q_sitemap(spark, sf):
    """A sitemap of each host made of its URLs, parsed back."""
    host = F.regexp_extract("url", r"://([^/?#]+)", 1)
    item = F.concat(F.lit("<url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc><lastmod>2026-01-"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"), F.lit("</lastmod></url>"))
    maps = table(spark, sf, "pages").groupBy(host.alias("site")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.array_sort(F.collect_list(item)), ""), F.lit("</urlset>")).alias("xml"))
    return sitemap(maps).select("site", "loc", F.date_format("lastmod", "yyyy-MM-dd").alias("lastmod"))


_TRACK = """(SELECT page_id, url, CASE WHEN NOT contains(url, '?') THEN url ELSE regexp_extract(url, '^([^?#]*)', 1) || CASE WHEN q = '' THEN '' ELSE '?' || q END || regexp_extract(url, '(#.*)$', 1) END AS u
  FROM (SELECT page_id, url, array_to_string(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda s: NOT (starts_with(lower(string_split(s, '=')[1]), 'utm_') OR lower(string_split(s, '=')[1]) IN ('ref', 'fbclid', 'gclid'))), '&') AS q FROM pages))"""

QUERIES = {
    "canonical_urls": (
        q_canonical,
        """SELECT page_id, CASE WHEN page_id % 6 IN (3, 4) THEN NULL ELSE regexp_replace(url, '#.*$', '') END AS url,
        CASE page_id % 6 WHEN 3 THEN 'unsafe_scheme' WHEN 4 THEN 'url_credentials' END AS violation FROM pages""",
    ),
    "url_origins": (q_origin, "SELECT regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, count(*) AS pages FROM pages GROUP BY 1"),
    "strip_tracking_params": (q_tracking, f"SELECT page_id, u AS url FROM {_TRACK}"),
    "bounded_keys": (q_key, "SELECT page_id, sha256(k) AS key_sha256, length(k) AS n_chars FROM (SELECT page_id, CASE WHEN strlen(html) <= 2000 THEN html ELSE left(html, 1920) || '…#sha256=' || sha256(html) END AS k FROM pages)"),
    "url_scope": (
        q_scope,
        r"""SELECT page_id, url FROM pages WHERE regexp_extract(url, '^https?://([^/?#]+)', 1) IN (SELECT DISTINCT regexp_extract(url, '^https?://([^/?#]+)', 1) AS h FROM pages ORDER BY h LIMIT 10)
        AND regexp_matches(url, '^https?://[^/?#]+/(en|fr)/') AND NOT regexp_matches(url, '^https?://[^/?#]+/en/9')""",
    ),
    "page_links": (q_links, """SELECT page_id, generate_subscripts(l, 1) - 1 AS nth, unnest(l) AS href FROM (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1) AS l FROM pages)"""),
    "page_identity": (
        q_identity,
        r"""WITH v AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', ' ', 'gs'), '<head.*?</head>|<script.*?</script>|<style.*?</style>', ' ', 'gs'), '<[^>]*>', ' ', 'gs'), '\s+', ' ', 'g') AS v FROM pages)
        SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/c/' || page_id END AS canonical, sha256(trim(v)) AS visible_sha256 FROM v JOIN pages USING (page_id)""",
    ),
    "url_sections": (
        q_sections,
        f"""WITH p AS (SELECT regexp_extract(url, '^(https?)', 1) AS scheme, regexp_extract(url, '://([^/?#]+)', 1) AS host, regexp_extract(url, '://[^/?#]+/([^/?#]*)', 1) AS section, regexp_replace(u, '#.*$', '') AS u FROM {_TRACK})
        SELECT host, section, count(DISTINCT u) FILTER (scheme = 'https') AS secure, count(DISTINCT u) FILTER (scheme = 'http') AS plain FROM p GROUP BY 1, 2""",
    ),
    "robots_rules": (q_robots, "SELECT page_id, NOT regexp_matches(url, '://[^/?#]+/[^/?#]*/1') AS allowed, CASE WHEN page_id % 5 > 0 THEN (page_id % 5)::DOUBLE END AS delay FROM pages"),
    "sitemap_entries": (q_sitemap, "SELECT regexp_extract(url, '://([^/?#]+)', 1) AS site, url AS loc, strftime(DATE '2026-01-02' + CAST(page_id % 28 AS INT), '%Y-%m-%d') AS lastmod FROM pages"),
}
