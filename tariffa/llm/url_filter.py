"""URL filter by empirical-Bayes host reputation, with stated rules before it.

Labelled pages are counted per host. A host's share of good pages is shrunk towards its registered domain, the
domain's towards its suffix, the suffix's towards all pages, each through a beta-binomial prior whose strength is
fitted by moments over all groups of that level. A page is blocked if the upper bound of its host's posterior lies
below a threshold: hosts with little evidence keep near their prior and are allowed.

The registered domain is the last two labels of the host without port, the suffix the last one (further
two-label suffixes are a parameter). Defined results: a null url, or one without `://`, has empty host and path
and is judged by the reputation of the empty host. Pages without a label count in no share. Repeated rows each
count and each return. Of rules that fit with equal length, block wins. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tariffa.llm.common import lookup, lower_ascii, stored, table

#: (verdict, host, path) of the rules that the query is asked to apply.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
Z, THRESHOLD, STRONGEST = 1.645, 0.5, 1000.0


def host(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def suffix_of(h: Column, two_label: tuple = ()) -> Column:
    bare = F.regexp_replace(h, r":[0-9]*$", "")
    last = F.substring_index(bare, ".", -1)
    return F.when(F.substring_index(bare, ".", -2).isin(*two_label), F.substring_index(bare, ".", -2)).otherwise(last) if two_label else last


def domain_of(h: Column, two_label: tuple = ()) -> Column:
    bare = F.regexp_replace(h, r":[0-9]*$", "")
    two = F.substring_index(bare, ".", -2)
    return F.when(two.isin(*two_label), F.substring_index(bare, ".", -3)).otherwise(two) if two_label else two


def rule_of(h: Column, p: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rh, rp in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block", r[1] + r[2])):
        fits = ((h == rh) | h.endswith("." + rh)) & p.startswith(rp)
        out = F.when(fits, F.struct(F.lit(rh + rp).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def strength(groups: DataFrame) -> Column:
    """One aggregate: prior strength of groups (n labelled, s good) by the moments of a beta-binomial."""
    p = F.sum("s") / F.sum("n")
    between = F.sum(F.col("s") * F.col("s") / F.col("n")) - F.sum("s") * F.sum("s") / F.sum("n") - (F.count(F.lit(1)) - 1) * p * (1 - p)
    var = between / (F.sum("n") - F.sum(F.col("n") * F.col("n")) / F.sum("n"))
    k = F.when(var > 0, F.greatest(F.lit(1.0), F.least(F.lit(STRONGEST), p * (1 - p) / var - 1))).otherwise(F.lit(STRONGEST))
    return F.round(F.coalesce(k, F.lit(STRONGEST)), 6)


def reputation(pages: DataFrame, two_label: tuple = ()) -> DataFrame:
    """Per host of pages (page_id, host, good: 1, 0 or null): pages, n, s, posterior mean and upper bound."""
    hosts = stored(pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("s"))
                   .withColumn("domain", domain_of(F.col("host"), two_label)).withColumn("suffix", suffix_of(F.col("host"), two_label)), "hosts")
    domains = stored(hosts.groupBy("domain").agg(F.first("suffix").alias("suffix"), F.count(F.lit(1)).alias("d_hosts"), F.sum("n").alias("n"), F.sum("s").alias("s")), "domains")
    suffixes = stored(domains.groupBy("suffix").agg(F.count(F.lit(1)).alias("s_domains"), F.sum("n").alias("n"), F.sum("s").alias("s")), "suffixes")
    k = [level.where("n > 0").agg(strength(level).alias("k")).first()["k"] for level in (hosts, domains, suffixes)]
    total = suffixes.agg(((F.coalesce(F.sum("s"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("m"), F.coalesce(F.sum("s_domains"), F.lit(0)).alias("d")).first()
    shrunk = lambda prior, strength: F.round((F.col("s") + strength * prior) / (F.col("n") + strength), 9)
    top = suffixes.select("suffix", "s_domains", shrunk(F.lit(total["m"]), k[2]).alias("m_suffix"))
    mid = lookup(domains, top, "suffix", "s_domains", total["d"], F.col("domain")).select("domain", "d_hosts", shrunk(F.col("m_suffix"), k[1]).alias("m_domain"))
    out = lookup(hosts, mid, "domain", "d_hosts", hosts.count(), F.col("host"))
    a, b = F.col("s") + k[0] * F.col("m_domain"), F.col("n") - F.col("s") + k[0] * (1 - F.col("m_domain"))
    mean = a / (a + b)
    return out.select("host", "pages", "n", "s", F.round(mean, 6).alias("posterior"), F.round(mean + Z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 6).alias("upper"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, threshold: float = THRESHOLD, two_label: tuple = ()) -> DataFrame:
    """page_id, host, path, rule, verdict, posterior and upper of every page.

    outcomes: (page_id, good) with one row per labelled page, good 1 or 0.
    """
    rows = stored(pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")), "page-hosts")
    labelled = rows.join(outcomes.select("page_id", "good"), "page_id", "left")
    hosts = reputation(labelled, two_label)
    out = lookup(rows, hosts, "host", "pages", rows.count(), F.col("page_id")).withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("upper") < threshold, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), own).alias("verdict"), "posterior", "upper")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page counts as good if the labels of its number say so: quality 1 and not toxic."""
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("page_id")).agg(
        F.min(F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).when(F.col("quality").isNotNull(), 0)).alias("good"))
    return judge(table(spark, sf_dir, "pages"), labels)


def _strength_sql(level: str) -> str:
    return f"""(SELECT round(coalesce(CASE WHEN v > 0 THEN greatest(1.0, least({STRONGEST}, p * (1 - p) / v - 1)) ELSE {STRONGEST} END, {STRONGEST}), 6) FROM (
      SELECT p, (q - ss * ss / nn - (g - 1) * p * (1 - p)) / nullif(nn - n2 / nn, 0) AS v FROM (
        SELECT sum(s)::DOUBLE AS ss, sum(n)::DOUBLE AS nn, sum(s)::DOUBLE / sum(n) AS p, sum(s::DOUBLE * s / n) AS q, sum(n::DOUBLE * n) AS n2, count(*) AS g FROM {level} WHERE n > 0)))"""


def _rules_sql() -> str:
    rows = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    return f"(VALUES {rows}) AS r(rv, rh, rp)"


SQL = f"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{PARTS}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '{PARTS}', 2) AS path FROM pages),
 l AS (SELECT doc_id AS page_id, min(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 WHEN quality IS NOT NULL THEN 0 END) AS good FROM labels GROUP BY 1),
 hosts AS (SELECT host, regexp_replace(host, ':[0-9]*$', '') AS bare, count(good) AS n, coalesce(sum(good), 0)::BIGINT AS s FROM u LEFT JOIN l USING (page_id) GROUP BY host),
 h AS (SELECT *, array_to_string(string_split(bare, '.')[-2:], '.') AS domain, string_split(bare, '.')[-1] AS suffix FROM hosts),
 d AS (SELECT domain, min(suffix) AS suffix, sum(n) AS n, sum(s) AS s FROM h GROUP BY domain),
 t AS (SELECT suffix, sum(n) AS n, sum(s) AS s FROM d GROUP BY suffix),
 k AS (SELECT {_strength_sql('h')} AS kh, {_strength_sql('d')} AS kd, {_strength_sql('t')} AS kt, (SELECT (coalesce(sum(s), 0) + 1)::DOUBLE / (coalesce(sum(n), 0) + 2) FROM t) AS m),
 mt AS (SELECT suffix, round((s + kt * m) / (n + kt), 9) AS m FROM t, k),
 md AS (SELECT domain, round((s + kd * mt.m) / (n + kd), 9) AS m FROM d JOIN mt USING (suffix), k),
 ab AS (SELECT host, s + kh * md.m AS a, n - s + kh * (1 - md.m) AS b FROM h JOIN md USING (domain), k),
 post AS (SELECT host, round(a / (a + b), 6) AS posterior, round(a / (a + b) + {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 6) AS upper FROM ab),
 fits AS (SELECT host, path, rh || rp AS rule, rv, row_number() OVER (PARTITION BY host, path ORDER BY length(rh || rp) DESC, rv DESC) AS k
          FROM (SELECT DISTINCT host, path FROM u), {_rules_sql()} WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, u.host, u.path, rule, coalesce(rv, CASE WHEN upper < {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict, posterior, upper
FROM u JOIN post ON u.host = post.host LEFT JOIN fits ON fits.host = u.host AND fits.path = u.path AND fits.k = 1
"""
