"""URL filters: rules first, then an empirical-Bayes reputation of the host.

Labelled pages of a host are binomial draws. Their chance of being bad has a
beta prior around the posterior mean of the registered domain, whose own prior
lies around its suffix, whose prior lies around all pages. How closely children
follow their parents (the weight of the prior, in pages) is estimated at each
level from all its hosts by moments. A host is blocked if the lower posterior
bound of its chance lies above a cut, so few labelled pages never suffice.

DataFrame functions only. Counts are combined before they are shuffled, so a
host with a third of all pages does no harm.
"""

from __future__ import annotations

import re
import string
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import quoted
from ..plans.durable import materialise
from ..plans.small import pin_small, spread_join
from .common import table

#: (verdict, host and path): fits the host and all its subdomains if the path begins so.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: A host is blocked if it is this sure that more than CUT of its pages are bad.
SURE, CUT = 0.95, 0.5
#: Bounds of a prior's weight in pages, for levels whose children are all alike or all apart.
LIGHTEST, HEAVIEST = 1.0, 1000.0
Z = NormalDist().inv_cdf(SURE)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first `://` up to `/`, `?`, `#` or the end, then up to `?`, `#` or the end; else empty."""
    pattern = "(?s)://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def site_levels(host: Column, suffixes: tuple[str, ...] = ()) -> tuple[Column, Column, Column]:
    """(site, registered domain, suffix): the host without user and port, its last label before the suffix, the suffix.

    The suffix is the last label, or the longest of `suffixes` that fits. An
    address of numbers is its own domain with an empty suffix.
    """
    site = F.regexp_replace(F.regexp_replace(host, "(?s)^.*@", ""), r"(:[0-9]*)?\.*$", "")
    one = "(?:" + "|".join([*[re.escape(s) for s in suffixes], r"[^.]*"]) + ")$"
    address = site.rlike(r"^\[|^[0-9]+(\.[0-9]+){3}$")
    suffix = F.when(address, "").otherwise(F.regexp_extract(site, rf"(?:^|\.)({one})", 1))
    named = F.regexp_extract(site, rf"(?:^|\.)([^.]+\.{one})", 1)
    return site, F.when(address | (named == ""), site).otherwise(named), suffix


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the last one that fits wins
        at, slash, rest = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def _weight(rows: DataFrame) -> float:
    """The prior's weight by moments: how far children (n, bad) stray from `prior` beyond chance."""
    spread = F.col("prior") * (1 - F.col("prior"))
    found = rows.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("prior"), 2)).alias("strayed"),
        F.sum(spread).alias("chance"), F.sum(spread * (F.col("n") - 1)).alias("more"),
    ).first()
    if not found.more:
        return HEAVIEST
    alike = (found.strayed - found.chance) / found.more
    return HEAVIEST if alike <= 0 else min(max(1 / alike - 1, LIGHTEST), HEAVIEST)


def _posterior(rows: DataFrame, weight: float) -> DataFrame:
    a = F.col("prior") * F.lit(weight) + F.col("bad")
    total = F.lit(weight) + F.col("n")
    mean = a / total
    return rows.withColumn("mean", mean).withColumn(
        "lower", F.col("mean") - F.lit(Z) * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (total + 1)))


def host_reputation(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url",
                    outcome_id: str = "page_id", bad_col: str = "bad", suffixes: tuple[str, ...] = ()) -> DataFrame:
    """One row per site: (site, domain, suffix, n, bad, prior, mean, lower).

    `outcomes` holds labelled pages with 0 or 1 in `bad_col`; null outcomes and
    null ids count nothing, an id that is labelled again counts again. Sites
    without labelled pages get their domain's mean. An empty table gives none.
    """
    of_page = outcomes.where(quoted(outcome_id).isNotNull() & quoted(bad_col).isNotNull()).groupBy(
        quoted(outcome_id).cast("long").alias("_id")).agg(F.count(F.lit(1)).alias("_n"), F.sum(quoted(bad_col).cast("long")).alias("_bad"))
    site, domain, suffix = site_levels(url_parts(quoted(url_col))[0], suffixes)
    sites = materialise(
        pages.select(quoted(id_col).cast("long").alias("_id"), site.alias("site"), domain.alias("domain"), suffix.alias("suffix"))
        .join(of_page, "_id", "left").groupBy("site", "domain", "suffix")
        .agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("bad")), "sites")
    totals = sites.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = ((totals.bad or 0) + 0.5) / ((totals.n or 0) + 1.0)
    parent = None
    for level, above in (("suffix", None), ("domain", "suffix"), ("site", "domain")):
        keys = ["site", "domain", "suffix"][["site", "domain", "suffix"].index(level):]
        rows = sites if level == "site" else sites.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        if above is None:
            rows = rows.withColumn("prior", F.lit(overall))
        else:
            rows = spread_join(rows, pin_small(parent), [above], totals.rows)
        rows = materialise(rows, "prior-" + level)
        rows = _posterior(rows, _weight(rows))
        parent = rows.select(level, F.col("mean").alias("prior"))
    return rows.select("site", "domain", "suffix", "n", "bad", "prior", "mean", "lower")


def judge_urls(pages: DataFrame, reputation: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES,
               cut: float = CUT, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """One row per page: (id, host, path, rule, verdict).

    The longest fitting rule decides, else `block` for a host whose lower bound
    lies above `cut`, else `allow`. A null url or one without `://` has an empty
    host and path and fits no rule. Rows that repeat an id are judged each.
    """
    host, path = url_parts(quoted(url_col))
    rows = pages.select(quoted(id_col).alias(id_col), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select(id_col, "host", "path", rule.alias("rule"), verdict.alias("_ruled"), site_levels(F.col("host"), suffixes)[0].alias("_site"))
    blocked = reputation.where(F.col("lower") > cut).select(F.col("site").alias("_site"), F.lit("block").alias("_earned"))
    judged = rows.join(pin_small(blocked), "_site", "left")
    return judged.select(id_col, "host", "path", "rule", F.coalesce("_ruled", "_earned", F.lit("allow")).alias("verdict"))


def labelled_pages(labels: DataFrame) -> DataFrame:
    """(page_id, bad) from the labels table: a page labelled of low quality or toxic is bad."""
    bad = (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int")
    return labels.where("quality IS NOT NULL OR toxic IS NOT NULL").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))


def url_verdicts(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, host_reputation(pages, labelled_pages(table(spark, sf_dir, "labels"))))


def _level_sql(name: str, keys: str, source: str, prior: str) -> str:
    """Prior, weight and posterior of one level."""
    return f"""
{name}_p AS (SELECT s.*, {prior}),
{name}_w AS (SELECT CASE WHEN coalesce(more, 0) = 0 OR strayed <= chance THEN {HEAVIEST}::DOUBLE
  ELSE least(greatest(more / (strayed - chance) - 1, {LIGHTEST}::DOUBLE), {HEAVIEST}::DOUBLE) END AS w FROM (
    SELECT sum(n * pow(bad / n - prior, 2)) AS strayed, sum(prior * (1 - prior)) AS chance, sum(prior * (1 - prior) * (n - 1)) AS more
    FROM {name}_p WHERE n > 0)),
{name} AS (SELECT *, m - {Z!r}::DOUBLE * sqrt(m * (1 - m) / (w + n + 1)) AS lower FROM (SELECT *, (prior * w + bad) / (w + n) AS m FROM {name}_p, {name}_w))"""


OP12_SQL = rf"""
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '') AS host,
  coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
v AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), '(:[0-9]*)?[.]*$', '') AS site FROM u),
l AS (SELECT doc_id AS page_id, CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL),
t AS (SELECT site, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad FROM v LEFT JOIN l USING (page_id) GROUP BY 1),
sites AS (SELECT *, CASE WHEN regexp_matches(site, '^\[|^[0-9]+([.][0-9]+){{3}}$') THEN site
    ELSE regexp_extract(site, '([^.]+[.])?[^.]*$') END AS domain,
  CASE WHEN regexp_matches(site, '^\[|^[0-9]+([.][0-9]+){{3}}$') THEN '' ELSE regexp_extract(site, '[^.]*$') END AS suffix FROM t),
overall AS (SELECT (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1) AS prior FROM sites),
{_level_sql('a', 'suffix', 'sites', "overall.prior FROM (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM sites GROUP BY 1) s, overall")},
{_level_sql('b', 'domain', 'sites', "a.m AS prior FROM (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM sites GROUP BY 1, 2) s JOIN a USING (suffix)")},
{_level_sql('c', 'site', 'sites', "b.m AS prior FROM sites s JOIN b USING (domain)")},
r AS (SELECT page_id, host, path, site, CASE
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM v)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN c.lower > {CUT}::DOUBLE THEN 'block' ELSE 'allow' END AS verdict
FROM r LEFT JOIN c USING (site)
"""
