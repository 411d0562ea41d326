"""URL filters: explicit host/path rules, then empirical-Bayes host reputation.

Only DataFrame functions run here. Labelled page outcomes are summed per site before anything is shuffled on
it; the beta-binomial prior of a level (suffix, registered domain, host) has its parent's shrunk rate as mean
and a strength from the moment estimate of that level's over-dispersion. A host is blocked when the lower
posterior bound of its bad rate exceeds ``cut``. Every level is a scratch table of its own, one row per labelled
name, so plans stay small; only a level's sums (three numbers) reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut, table

#: Rules of the query: host, path prefix, verdict.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
Z, CUT = 1.6448536269514722, 0.5
MAX_RULES = 10_000
# Frequent suffixes of more than one label below which anyone can register a name; a parameter of the filter.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "com.br", "com.cn", "com.mx", "com.tr", "co.in", "co.kr", "co.za", "github.io", "blogspot.com")
_IPV4 = r"^[0-9]+(\.[0-9]+){3}$"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def levels(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[Column, Column, Column]:
    """Site, registered domain and suffix of a host.

    The site is the host without user, port and closing dot. A suffix is the last label, or the longest of
    ``suffixes`` (at most MAX_RULES, of two or three labels); the domain has one label more. IP addresses stand for
    themselves at every level.
    """
    if len(suffixes) > MAX_RULES:
        raise ValueError("use a join for suffix lists of this size")
    site = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", ""), r"\.$", "")
    address = F.regexp_like(site, F.lit(_IPV4)) | F.startswith(site, F.lit("["))
    longer = [F.substring_index(site, ".", -k).isin([x for x in suffixes if x.count(".") == k - 1]) for k in (3, 2)]
    domain = F.when(longer[0], F.substring_index(site, ".", -4)).when(longer[1], F.substring_index(site, ".", -3)).otherwise(F.substring_index(site, ".", -2))
    suffix = F.when(longer[0], F.substring_index(site, ".", -3)).when(longer[1], F.substring_index(site, ".", -2)).otherwise(F.substring_index(site, ".", -1))
    return site, F.when(address, site).otherwise(domain), F.when(address, site).otherwise(suffix)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none. ``rules`` are checked to be at most MAX_RULES."""
    if len(rules) > MAX_RULES:
        raise ValueError("use a join for rule lists of this size")
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, v in reversed(ordered):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))).otherwise(out)
    return out


def _posterior(c: DataFrame, name: str, z: float, carry: tuple[str, ...] = ()) -> DataFrame:
    """name, n, bad, m, lower of the rows of ``c`` (name, n, bad and the parent's rate pm): a scratch table."""
    pq = F.col("pm") * (1 - F.col("pm"))
    spread = F.when(pq > 0, (F.col("bad") - F.col("n") * F.col("pm")) ** 2 / pq).otherwise(0.0)
    s, n, pairs = c.agg(F.sum(spread), F.sum("n"), F.sum(F.col("n") * (F.col("n") - 1))).first()
    rho = max(0.001, min(0.5, (s - n) / pairs)) if pairs else 0.001
    k = 1.0 / rho - 1
    c = c.withColumns({"a": F.col("pm") * k + F.col("bad"), "b": (1 - F.col("pm")) * k + F.col("n") - F.col("bad")})
    sd = F.sqrt(F.col("a") * F.col("b") / ((F.col("a") + F.col("b")) ** 2 * (F.col("a") + F.col("b") + 1)))
    m = F.col("a") / (F.col("a") + F.col("b"))
    return cut(c.select(name, *carry, "n", "bad", m.alias("m"), (m - z * sd).alias("lower")))


def host_reputation(outcomes: DataFrame, z: float = Z, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[DataFrame, DataFrame, DataFrame, float | None]:
    """Lower posterior bounds of the bad rate: per site, per domain, per suffix (each with n, bad, m, lower), and of all.

    ``outcomes``: host string, bad 0/1; null hosts or outcomes don't count. The bound of all is None without outcomes.
    """
    site, domain, suffix = levels(F.col("host"), suffixes)
    hosts = outcomes.where("host is not null and bad is not null").select(site.alias("site"), domain.alias("domain"), suffix.alias("suffix"), "bad")
    hosts = cut(hosts.groupBy("site", "domain", "suffix").agg(F.count("*").cast("double").alias("n"), F.sum("bad").cast("double").alias("bad")))
    domains = cut(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    sums = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    n, bad = sums.agg(F.sum("n"), F.sum("bad")).first()
    a, b = (bad or 0.0) + 0.5, (n or 0.0) - (bad or 0.0) + 0.5
    m = a / (a + b)
    lower = m - z * (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5 if n else None
    by_suffix = _posterior(sums.withColumn("pm", F.lit(m)), "suffix", z)
    by_domain = _posterior(domains.join(by_suffix.select("suffix", F.col("m").alias("pm")), "suffix"), "domain", z)
    by_site = _posterior(hosts.join(by_domain.select("domain", F.col("m").alias("pm")), "domain"), "site", z)
    return by_site, by_domain, by_suffix, lower


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]] = RULES, cut_at: float = CUT, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """Verdict of every row of ``pages`` (page_id, url; more columns are ignored).

    ``outcomes``: page_id, bad (0/1); a page with several is bad if one is; null outcomes and labels whose page is
    unknown don't count. Null urls have empty host and path and get the reputation of the empty host; urls of any
    length are read whole. Ports and users stay in ``host``, but not in the reputation's levels. Hosts without labels
    take the bound of their registered domain, then suffix, then of all pages; with no labels at all everything that
    no rule blocks is allowed. Repeated rows are judged each; of rules of equal length the one first by text holds. An
    empty table gives an empty result.
    """
    host, path = split_url(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path.alias("path"))
    counted = outcomes.select("page_id", F.col("bad").cast("int").alias("bad")).where("bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    by_site, by_domain, by_suffix, lower = host_reputation(p.select("page_id", "host").join(counted, "page_id").select("host", "bad"), suffixes=suffixes)
    # Bounds are looked up once per distinct host; the hosts above the cut are a table, so that a skewed host of the pages can split.
    site, domain, suffix = levels(F.col("host"), suffixes)
    hosts = p.select("host").distinct().select("host", site.alias("site"), domain.alias("domain"), suffix.alias("suffix"))
    for level, name in ((by_site, "site"), (by_domain, "domain"), (by_suffix, "suffix")):
        hosts = hosts.join(level.select(name, F.col("lower").alias(f"_{name}")), name, "left")
    blocked = cut(hosts.where(F.coalesce("_site", "_domain", "_suffix", F.lit(lower).cast("double")) > cut_at).select("host", F.lit("block").alias("_by_method")))
    out = p.join(blocked, "host", "left").withColumn("_r", matching_rule(F.col("host"), F.col("path"), rules))
    by_method = F.coalesce("_by_method", F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.coalesce(F.col("_r.verdict"), by_method).alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is bad if the label of the same id says low quality or toxic, good if it says one of their opposites alone."""
    labels = table(spark, sf_dir, "labels")
    bad = F.greatest(F.when(F.col("quality") == 0, 1).when(F.col("quality").isNotNull(), 0), F.when(F.col("toxic") == 1, 1).when(F.col("toxic").isNotNull(), 0))
    return filter_urls(table(spark, sf_dir, "pages"), labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")))


def _level_sql(name: str, key: str, parent: str, parent_key: str) -> str:
    return f"""
{name}_j AS (SELECT c.*, p.m AS pm FROM {name}_n c JOIN {parent} p ON c."{parent_key}" = p."{parent_key}"),
{name}_k AS (SELECT 1.0::DOUBLE / greatest(0.001, least(0.5, coalesce((sum(CASE WHEN pm*(1-pm) > 0 THEN power(bad - n*pm, 2) / (pm*(1-pm)) ELSE 0 END) - sum(n))
    / nullif(sum(n*(n-1)), 0), 0.001))) - 1 AS k FROM {name}_j),
{name} AS (SELECT *, a/(a+b) AS m, a/(a+b) - {Z} * sqrt(a*b/(power(a+b, 2)*(a+b+1))) AS lower
    FROM (SELECT j.*, pm*k + bad AS a, (1-pm)*k + n - bad AS b FROM {name}_j j, {name}_k)),"""


ORACLE = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
t AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\\.$', '') AS site FROM p),
k AS (SELECT *, regexp_matches(site, '{_IPV4}') OR starts_with(site, '[') AS address, string_split(site, '.') AS x,
    CASE WHEN array_to_string(x[-3:], '.') IN {SUFFIXES} AND len(x) >= 3 THEN 3 WHEN array_to_string(x[-2:], '.') IN {SUFFIXES} THEN 2 ELSE 1 END AS l FROM t),
h AS (SELECT page_id, host, path, site, CASE WHEN address THEN site ELSE array_to_string(x[-l - 1:], '.') END AS domain, CASE WHEN address THEN site ELSE array_to_string(x[-l:], '.') END AS suffix, '' AS "all" FROM k),
o AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY 1),
host_n AS (SELECT site, domain, suffix, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM h JOIN o USING (page_id) GROUP BY 1, 2, 3),
domain_n AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM host_n GROUP BY 1, 2),
suffix_n AS (SELECT suffix, '' AS "all", sum(n) AS n, sum(bad) AS bad FROM domain_n GROUP BY 1),
top AS (SELECT "all", a/(a+b) AS m, a/(a+b) - {Z} * sqrt(a*b/(power(a+b, 2)*(a+b+1))) AS lower
    FROM (SELECT '' AS "all", sum(bad) + 0.5 AS a, sum(n) - sum(bad) + 0.5 AS b FROM suffix_n HAVING sum(n) > 0)),
{_level_sql("suffix_p", "suffix", "top", "all").replace("suffix_p_n", "suffix_n")}
{_level_sql("domain_p", "domain", "suffix_p", "suffix").replace("domain_p_n", "domain_n")}
{_level_sql("host_p", "site", "domain_p", "domain").replace("host_p_n", "host_n")}
rules(rh, rp, v) AS (VALUES {", ".join(map(str, RULES))}),
hit AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY 1)
SELECT h.page_id, h.host, h.path, hit.rule, coalesce(hit.v, CASE WHEN coalesce(a.lower, b.lower, c.lower, d.lower) > {CUT} THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN hit USING (page_id) LEFT JOIN host_p a ON a.site = h.site LEFT JOIN domain_p b ON b.domain = h.domain
LEFT JOIN suffix_p c ON c.suffix = h.suffix LEFT JOIN top d ON d."all" = h."all"
"""
