"""URL filters: explicit host/path rules, then empirical-Bayes host reputation.

Labelled page outcomes are counted per host. A beta-binomial prior links each level to the one
above it (host to registered domain to suffix to the whole corpus); the strength of each prior is
fitted by moments, so a host with few labelled pages leans on its domain and a host with many on
itself. A page is allowed when the lower bound of its host's posterior reaches a threshold.

The registered domain is the last two labels and the suffix the last one, both without a port: no
suffix list is public in this environment. A numeric address is its own domain and suffix.

Edge cases: a null URL or one without ``://`` has an empty host and path and shares the reputation
of the empty host; null labels count as unlabelled; repeated label rows each count; an empty label
table leaves the prior mean at 0.5. Only the named columns of either table are read, so extra
columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.session import materialize, table

#: (verdict, rule): a rule is a host and the start of a path; it covers the host's subdomains.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


def _split_rule(rule):
    host, slash, path = rule.partition("/")
    return host, slash + path


def _rule_case(rules, verdict: bool) -> str:
    """CASE over the rules from the longest to the shortest: the first that fits wins."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    whens = []
    for decision, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        host, path = _split_rule(rule)
        whens.append(
            f"WHEN (host = {text(host)} OR right(host, {len(host) + 1}) = {text('.' + host)})"
            f" AND left(path, {len(path)}) = {text(path)} THEN {text(decision if verdict else rule)}"
        )
    return f"CASE {' '.join(whens)} END" if whens else "CAST(NULL AS VARCHAR(16))"


def _fit(level: str, parent_mean: str, source: str) -> str:
    """Moment estimate of the intra-class correlation of one level, kept within [0.02, 0.5]."""
    spread = f"sum(n * (k / n - {parent_mean}) * (k / n - {parent_mean}))"
    within = f"sum({parent_mean} * (1 - {parent_mean}))"
    excess = f"sum({parent_mean} * (1 - {parent_mean}) * (n - 1))"
    return (
        f"{level}_fit AS (SELECT coalesce(least(0.5e0, greatest(0.02e0, ({spread} - {within}) / nullif({excess}, 0))),"
        f" 0.02e0) AS rho FROM {source} WHERE n > 0)"
    )


def _shrunk(level: str, parent_mean: str) -> str:
    kappa = f"(1 / (SELECT rho FROM {level}_fit) - 1)"
    return f"(k + {kappa} * {parent_mean}) / (n + {kappa})"


def _part(pattern: str, matches: str) -> str:
    """The end of a host that the pattern finds, without its port; a numeric address whole."""
    name = "regexp_replace(host, ':[0-9]*$', '')"
    return f"CASE WHEN left({name}, 1) = '[' OR {matches}({name}, '^[0-9]+([.][0-9]+){{3}}$') THEN {name} ELSE regexp_extract({name}, '{pattern}', 0) END"


def reputation_sql(pages: str, labels: str, rules=RULES, z: float = 1.645, threshold: float = 0.5) -> str:
    """The whole operator as one SQL statement, for DuckDB."""
    host = "regexp_extract(rest, '^[^/?#]*', 0)"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM {pages}),
parsed AS (
  SELECT page_id, translate({host}, '{upper}', '{lower}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
outcomes AS (
  SELECT doc_id, count(quality) AS n, sum(quality) AS k FROM {labels} WHERE quality IS NOT NULL GROUP BY doc_id),
hosts AS (
  SELECT host, {_part("([^.]+[.])?[^.]*$", "regexp_matches")} AS domain, {_part("[^.]*$", "regexp_matches")} AS suffix,
         CAST(coalesce(sum(n), 0) AS DOUBLE) AS n, CAST(coalesce(sum(k), 0) AS DOUBLE) AS k
  FROM parsed LEFT JOIN outcomes ON page_id = doc_id GROUP BY host),
domains AS (SELECT domain, min(suffix) AS suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY domain),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY suffix),
whole AS (SELECT coalesce((sum(k) + 0.5e0) / (sum(n) + 1), 0.5e0) AS mean FROM suffixes),
suffix_in AS (SELECT suffix, n, k, (SELECT mean FROM whole) AS up FROM suffixes),
{_fit("suffix", "up", "suffix_in")},
suffix_mean AS (SELECT suffix, {_shrunk("suffix", "up")} AS mean FROM suffix_in),
domain_in AS (SELECT d.domain, d.n, d.k, s.mean AS up FROM domains d JOIN suffix_mean s ON d.suffix = s.suffix),
{_fit("domain", "up", "domain_in")},
domain_mean AS (SELECT domain, {_shrunk("domain", "up")} AS mean FROM domain_in),
host_in AS (SELECT h.host, h.n, h.k, m.mean AS up FROM hosts h JOIN domain_mean m ON h.domain = m.domain),
{_fit("host", "up", "host_in")},
host_post AS (
  SELECT host, {_shrunk("host", "up")} AS mean, n + 1 / (SELECT rho FROM host_fit) AS weight FROM host_in),
host_bound AS (SELECT host, mean - {z}e0 * sqrt(mean * (1 - mean) / weight) AS bound FROM host_post)
SELECT p.page_id, p.host, p.path, {_rule_case(rules, False).replace("host", "p.host").replace("path", "p.path")} AS rule,
       coalesce({_rule_case(rules, True).replace("host", "p.host").replace("path", "p.path")},
                CASE WHEN b.bound >= {threshold}e0 THEN 'allow' ELSE 'block' END) AS verdict
FROM parsed p LEFT JOIN host_bound b ON p.host = b.host
"""


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host and path of every URL."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substr(url, instr(url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract("rest", "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.select("page_id", rest.alias("rest")).select("page_id", host.alias("host"), F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1).alias("path"))


def _correlation(level: DataFrame) -> float:
    """Moment estimate of the intra-class correlation of (n, k, up) rows, kept within [0.02, 0.5]."""
    n, k, up = F.col("n"), F.col("k"), F.col("up")
    row = level.where("n > 0").agg(
        F.sum(n * (k / n - up) * (k / n - up)).alias("spread"), F.sum(up * (1 - up)).alias("within"), F.sum(up * (1 - up) * (n - 1)).alias("excess")
    ).first()
    if not row.excess:
        return 0.02
    return min(0.5, max(0.02, (row.spread - row.within) / row.excess))


def host_reputation(hosts: DataFrame) -> DataFrame:
    """host, mean and weight of its posterior, from labelled pages n and good ones k of every host.

    ``hosts`` is a table that is cheap to reread: one row a host. Only one mean and one correlation
    a level pass through the driver.
    """
    split = hosts.withColumn("domain", F.expr(_part("([^.]+[.])?[^.]*$", "regexp_like"))).withColumn("suffix", F.expr(_part("[^.]*$", "regexp_like")))
    whole = split.agg(F.coalesce((F.sum("k") + 0.5) / (F.sum("n") + 1), F.lit(0.5))).first()[0]
    above, keys = None, ("suffix", "domain", "host")
    for depth, key in enumerate(keys):
        columns = keys[max(0, depth - 1) : depth + 1]
        level = split.groupBy(*columns).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        if above is None:
            level = level.withColumn("up", F.lit(whole))
        else:
            up = above.select(F.col(keys[depth - 1]).alias("up_key"), F.col("mean").alias("up"))
            level = level.join(up, F.col(keys[depth - 1]) == F.col("up_key"))
        rho = _correlation(level)
        kappa = 1 / rho - 1
        above = level.select(key, ((F.col("k") + kappa * F.col("up")) / (F.col("n") + kappa)).alias("mean"), (F.col("n") + 1 / rho).alias("weight"))
    return above


def filter_urls(pages: DataFrame, labels: DataFrame, rules=RULES, z: float = 1.645, threshold: float = 0.5) -> DataFrame:
    """Judges each row of ``pages`` (page_id, url) with ``labels`` (doc_id, quality) as outcomes.

    Every step but the last join aggregates before it shuffles, so a host with a third of all pages
    costs one row per map task; in the last join that host's pages are a skewed side that adaptive
    execution splits, the other side has one row per host.
    """
    urls = parsed(pages)
    outcomes = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.count("quality").alias("n"), F.sum("quality").alias("k"))
    counted = urls.join(outcomes, F.col("page_id") == F.col("doc_id"), "left").groupBy("host").agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("n"), F.coalesce(F.sum("k"), F.lit(0)).cast("double").alias("k")
    )
    posterior = host_reputation(materialize(counted, "hosts"))
    mean = F.col("mean")
    bounds = posterior.select(F.col("host").alias("b_host"), (mean - z * F.sqrt(mean * (1 - mean) / F.col("weight"))).alias("bound"))
    method = F.when(F.col("bound") >= threshold, "allow").otherwise("block")
    return urls.join(bounds, F.col("host") == F.col("b_host"), "left").select(
        "page_id", "host", "path", F.expr(_rule_case(rules, False)).cast("string").alias("rule"), F.coalesce(F.expr(_rule_case(rules, True)).cast("string"), method).alias("verdict")
    )


def op8_url_reputation(spark, sf_dir):
    return filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


QUERIES = {"op8_url_reputation": (op8_url_reputation, reputation_sql("pages", "labels"))}
