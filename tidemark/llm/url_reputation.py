"""Empirical-Bayes host reputation for URLs.

Labelled page outcomes (bad or not) are counted for each host, registered domain and suffix. A beta-binomial
prior is fitted by moments at each level from all groups below one parent level: suffixes shrink towards the
whole, domains towards their suffix, hosts towards their domain. The prior's strength comes from how much
rates differ between groups beyond what chance explains, and from how well the parent's rate is known, so a
host with few labels leans on its domain, and one in a domain without any has a wide posterior. A
url is blocked if the lower posterior bound of its host's bad rate is above a limit. Hosts without a label
have the posterior of their domain, or of their suffix. Registered domains go by a rule, not by a list of
all suffixes: the last two labels, or three if the last is a country's and the second a common second level.

Explicit rules, (host, path prefix) pairs that hold for a host and its subdomains, come before the method;
of the rules that fit, the longest wins, and of equally long ones the first by name.

Edge cases: a url that is null or has no ``://`` has empty host and path, and its own group of outcomes. A
host without a dot, or an IP address, is its own domain and suffix; ports count for the host only. Very
long urls are read whole. Outcomes with a null value count for
nothing. Repeated rows give a row each and count each. An empty table gives an empty result; with no
outcomes at all everything is allowed. Further columns of the input are not looked at.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, table

#: The rules of the query, in fixed text: verdict and rule.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Labels that make a suffix of two labels with a country's two letters after them; every other suffix is the last label.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gov", "ltd", "mil", "ne", "net", "nhs", "or", "org", "plc", "sch")
MAX_RULES = 1000


@dataclass(frozen=True)
class Bound:
    max_bad: float = 0.3  #: a host whose bad rate is surely above this is blocked
    z: float = 1.645  #: standard normal quantile of the bound, on the log-odds scale
    least: float = 2.0  #: the least strength of a prior, in observations
    most: float = 1000.0  #: the greatest


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def domain_suffix(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host, whose port doesn't count."""
    host = F.regexp_replace(host, r":[0-9]*$", "")
    two, three = F.substring_index(host, ".", -2), F.substring_index(host, ".", -3)
    long = two.rlike(rf"^({'|'.join(SECOND_LEVEL)})\.[a-z][a-z]$")
    ip = host.rlike(r"^[0-9.]+$") | host.contains(":")
    return F.when(ip, host).when(long, three).otherwise(two), F.when(ip, host).when(long, two).otherwise(F.substring_index(host, ".", -1))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """A struct of the rule that wins (null if none fits) and its verdict."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    fits = []
    for verdict, rule in sorted(rules, key=lambda r: r[1]):
        h, _, p = rule.partition("/")
        fit = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        fits.append(F.when(fit, F.struct(F.lit(-len(rule)).alias("n"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_min(F.array(*fits)) if fits else F.lit(None).cast("struct<n:int,rule:string,verdict:string>")


def _strength(groups: DataFrame, bound: Bound) -> float:
    """The strength of the prior from which groups (n, k, and their prior mean m) come.

    By moments: of the squared deviations of rates from their prior means, weighted by n, what is beyond
    the binomial variance is the variance between groups.
    """
    s = groups.filter("n > 0").agg(
        F.coalesce(F.sum("n"), F.lit(0.0)).alias("n"), F.count("*").alias("g"),
        F.sum(F.expr("n * pow(k / n - m, 2)")).alias("dev"), F.sum(F.expr("n * m * (1 - m)")).alias("var"),
    ).first()
    # Expected deviation: sum of m (1 - m) (1 + (n - 1) rho), with rho = 1 / (strength + 1).
    rho = (s["dev"] * s["n"] / s["var"] - s["g"]) / (s["n"] - s["g"]) if s["n"] > s["g"] and s["var"] else 0.0
    fitted = max(bound.least, 1 / rho - 1) if rho > 0 else bound.most
    # No prior is stronger than all that has been observed.
    return min(fitted, bound.most, s["n"] + 1)


def _with_prior(groups: DataFrame, bound: Bound) -> DataFrame:
    """groups with s, the strength of their prior: of their level's and of what is known of their parent's mean (of), half the harmonic mean."""
    s = F.lit(_strength(groups, bound))
    return groups.withColumn("s", s * F.col("of") / (s + F.col("of")))


def _posterior(groups: DataFrame, bound: Bound) -> DataFrame:
    """groups with their posterior mean m, and its strength of, in the place of their parents'."""
    return _with_prior(groups, bound).withColumn("m", F.expr("(k + s * m) / (n + s)")).withColumn("of", F.expr("n + s"))


def reputations(outcomes: DataFrame, bound: Bound = Bound()) -> DataFrame:
    """host, alpha, beta, blocked for each host of outcomes (host, bad: 0, 1 or null); groups nest host, domain, suffix.

    The counts of a level are one aggregation; its prior's strength, one number, comes to the driver.
    """
    dom, suf = domain_suffix(F.col("host"))
    hosts = outcomes.groupBy("host").agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("k"))
    hosts = checkpointed(hosts.withColumn("domain", dom).withColumn("suffix", suf))  # pages are read once
    domains = checkpointed(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    every = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0.0)).alias("k")).first()
    # Half a bad and half a good page in advance keep the overall rate off 0 and 1.
    suffixes = suffixes.withColumn("m", F.lit((every["k"] + 0.5) / (every["n"] + 1))).withColumn("of", F.lit(every["n"] + 1))
    suffixes = _posterior(suffixes, bound).select("suffix", "m", "of")
    domains = _posterior(domains.join(suffixes, "suffix"), bound).select("domain", "m", "of")
    hosts = _with_prior(hosts.join(domains, "domain"), bound)
    out = hosts.select("host", F.col("n").cast("long").alias("labelled"), F.col("k").cast("long").alias("bad"), F.expr("k + s * m").alias("alpha"), F.expr("n - k + s * (1 - m)").alias("beta"))
    odds = F.log(F.col("alpha") / F.col("beta")) - bound.z * F.sqrt(1 / F.col("alpha") + 1 / F.col("beta"))
    return out.withColumn("lower", 1 / (1 + F.exp(-odds))).withColumn("blocked", F.col("lower") > bound.max_bad)


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple = RULES, bound: Bound = Bound(), key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict, lower (posterior bound of the host's bad rate), for each page; outcomes: url, bad."""
    host, path = host_path(pages[url])
    rows = pages.select(pages[key].alias("page_id"), host.alias("host"), path.alias("path"))
    # Hosts without an outcome are in the count too, with none.
    seen = outcomes.select(host_path(outcomes["url"])[0].alias("host"), outcomes["bad"].cast("int").alias("bad"))
    every = seen.union(rows.select("host", F.lit(None).cast("int").alias("bad")))
    known = reputations(every, bound).select(F.col("host").alias("h"), "lower", "blocked")
    out = rows.join(known, rows["host"] == known["h"]).withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("blocked"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), F.round("lower", 6).alias("lower"))


def op1_url_reputation(spark, sf_dir: str) -> DataFrame:
    """Outcomes: the page of a labelled document (its number is in the path) is bad if that is toxic or of low quality."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), 0)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("n"), bad.alias("bad"))
    number = F.expr(r"try_cast(nullif(regexp_extract(url, '://[^/?#]*/[^/?#]*/([0-9]+)', 1), '') AS bigint)")
    outcomes = pages.select("url", number.alias("n")).join(labels, "n").select("url", "bad")
    return judge(pages, outcomes)


def _moments(groups: str, level: str, b: Bound = Bound()) -> str:
    return f"""s_{level} AS (
  SELECT least(CASE WHEN n > g AND (dev * n / nullif(var, 0) - g) / nullif(n - g, 0) > 0 THEN greatest({b.least}, 1 / ((dev * n / var - g) / (n - g)) - 1) ELSE {b.most} END,
               {b.most}, coalesce(n, 0) + 1) AS s
  FROM (SELECT sum(n) AS n, count(*) AS g, sum(n * pow(k / n - m, 2)) AS dev, sum(n * m * (1 - m)) AS var FROM {groups} WHERE n > 0))"""


ORACLE = rf"""
WITH p AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)),
o AS (
  SELECT host, CASE WHEN toxic = 1 OR quality = 0 THEN 1 WHEN toxic IS NOT NULL OR quality IS NOT NULL THEN 0 END AS bad
  FROM p JOIN labels ON doc_id = TRY_CAST(regexp_extract(url, '://[^/?#]*/[^/?#]*/([0-9]+)', 1) AS BIGINT)
  UNION ALL SELECT host, NULL FROM p),
h AS (
  SELECT host, n, k, array_to_string(CASE WHEN ip THEN parts WHEN long THEN parts[-3:] ELSE parts[-2:] END, '.') AS domain,
         array_to_string(CASE WHEN ip THEN parts WHEN long THEN parts[-2:] ELSE parts[-1:] END, '.') AS suffix
  FROM (SELECT host, CAST(count(bad) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS k, regexp_replace(host, ':[0-9]*$', '') AS name,
               string_split(name, '.') AS parts, regexp_full_match(name, '[0-9.]+') OR contains(name, ':') AS ip,
               regexp_full_match(array_to_string(parts[-2:], '.'), '({"|".join(SECOND_LEVEL)})[.][a-z][a-z]') AS long
        FROM o GROUP BY host)),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY domain, suffix),
f0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d0 GROUP BY suffix),
f1 AS (SELECT *, (SELECT (sum(k) + 0.5) / (sum(n) + 1) FROM f0) AS m, (SELECT sum(n) + 1 FROM f0) AS known FROM f0),
{_moments("f1", "suffix")},
f AS (SELECT suffix, (k + p * m) / (n + p) AS m, n + p AS known FROM (SELECT *, s * known / (s + known) AS p FROM f1, s_suffix)),
d1 AS (SELECT d0.*, m, known FROM d0 JOIN f USING (suffix)),
{_moments("d1", "domain")},
d AS (SELECT domain, (k + p * m) / (n + p) AS m, n + p AS known FROM (SELECT *, s * known / (s + known) AS p FROM d1, s_domain)),
hh AS (SELECT h.host, h.n, h.k, m, known FROM h JOIN d USING (domain)),
{_moments("hh", "host")},
post AS (SELECT host, k + p * m AS a, n - k + p * (1 - m) AS b FROM (SELECT *, s * known / (s + known) AS p FROM hh, s_host)),
low AS (SELECT host, 1 / (1 + exp(-(ln(a / b) - {Bound.z} * sqrt(1 / a + 1 / b)))) AS lower FROM post),
fit AS (
  SELECT page_id, host, path, lower,
         (SELECT max_by(r.rule, length(r.rule)) FROM (VALUES {", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for _, r in RULES)}) r(rule, h, q)
          WHERE (p.host = r.h OR p.host LIKE '%.' || r.h) AND starts_with(p.path, r.q)) AS rule
  FROM p JOIN low USING (host))
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{r}' THEN '{v}'" for v, r in RULES)} WHEN lower > {Bound.max_bad} THEN 'block' ELSE 'allow' END AS verdict,
       round(lower, 6) AS lower
FROM fit
"""
