"""URL filters: fixed rules, and host reputation by empirical Bayes for what the rules leave open.

Labelled page outcomes (bad or good) are counted by host, registered domain and suffix. A beta-binomial prior
shrinks a host's rate to its domain's, that to its suffix's, and that to the rate of all; how strong each
prior is, follows from how much the rates below it differ beyond chance (moments of the counts). A page is
blocked if the posterior lower bound of its host's bad rate is above a threshold. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skinnyla.llm.common import cut, table

# The rules, as host and path prefix.
BLOCK = ("net/", "example.com/de/")
ALLOW = ("example.net/en/", "org/fr/")
# Labels that make a suffix with the country behind them, and hosts whose subdomains are others' domains.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "ne", "or", "org")
SHARED_HOSTS = ("appspot.com", "blogspot.com", "github.io", "gitlab.io", "herokuapp.com", "netlify.app", "pages.dev", "web.app", "wordpress.com")
#: Bounds of a prior's strength in pages.
STRENGTH = (1.0, 1000.0)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def matched_rule(host: Column, path: Column, rules: list[str]) -> Column:
    """The longest rule that fits (ties: the larger in code points), else null. rules: bounded configuration."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):  # later ones win
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def domain_of(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host without user and port; an address is both its own domain and `ip`.

    The suffix is the last label, the last two under a country's second level (co.uk) and shared hosts (github.io).
    """
    name = F.regexp_replace(host, r"(^[^@]*@)|(:[0-9]*$)|(\.$)", "")
    address = name.rlike(r"^[0-9]+(\.[0-9]+){3}$") | name.startswith("[")
    two = name.rlike(rf"(^|\.)({'|'.join(SECOND_LEVEL)})\.[a-z][a-z]$") | F.substring_index(name, ".", -2).isin(*SHARED_HOSTS)
    domain = F.when(address, name).when(two, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))
    suffix = F.when(address, F.lit("ip")).when(two, F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))
    return domain, suffix


def strength(bad: str, n: str, of_bad: str | Column, of_n: str | Column) -> Column:
    """The strength of a prior (its pseudo-counts) by the moments of the children's counts around their parents' rates.

    With intra-class correlation r, a child of n pages varies by 1 + (n - 1) r times what chance alone gives.
    """
    x, m = F.col(bad), F.col(n)
    of_x, total = (F.col(c) if isinstance(c, str) else c for c in (of_bad, of_n))
    p, use = of_x / total, (m > 0) & (of_x > 0) & (of_x < total)
    rest = 1 - m / total
    excess = F.sum(F.when(use, m * (x / m - p) * (x / m - p) / (p * (1 - p)) - rest))
    room = F.sum(F.when(use, rest * (m - 1)))
    r = F.when(room > 0, F.greatest(excess, F.lit(0.0)) / room)
    low, high = map(F.lit, STRENGTH)
    return F.coalesce(F.when(r * (high + 1) <= 1, high).otherwise(F.greatest(low, (1 - r) / r)), low)


def reputation(outcomes: DataFrame, z: float = 1.0) -> DataFrame:
    """(host, posterior mean, lower bound, n) from outcomes(host, bad 0/1/null).

    Every host of the outcomes gets a row, also those without a labelled page. Counts are aggregated before any
    shuffle, and levels are sums of the host table, which is written once. null outcomes do not count. z: standard
    deviations below the mean.
    """
    hosts = outcomes.groupBy("host").agg(F.sum("bad").alias("bad"), F.count("bad").alias("n")).fillna(0, ["bad"])
    domain, suffix = domain_of(F.col("host"))
    hosts = cut(hosts.withColumn("domain", domain).withColumn("suffix", suffix))
    domains = cut(hosts.groupBy("domain", "suffix").agg(F.sum("bad").alias("d_bad"), F.sum("n").alias("d_n")))
    suffixes = cut(domains.groupBy("suffix").agg(F.sum("d_bad").alias("s_bad"), F.sum("d_n").alias("s_n")))
    every = suffixes.agg(F.coalesce(F.sum("s_bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("s_n"), F.lit(0)).alias("n")).first()
    of_suffix = domains.join(suffixes, "suffix")
    of_domain = hosts.join(domains, ["domain", "suffix"])
    k_s, k_d, k_h = (  # a number each
        F.lit(df.agg(strength(*columns)).first()[0])
        for df, columns in ((suffixes, ("s_bad", "s_n", F.lit(every.bad), F.lit(every.n))), (of_suffix, ("d_bad", "d_n", "s_bad", "s_n")), (of_domain, ("bad", "n", "d_bad", "d_n")))
    )
    p_s = (F.col("s_bad") + k_s * ((every.bad + 1) / (every.n + 2))) / (F.col("s_n") + k_s)
    p_d = (F.col("d_bad") + k_d * F.col("p_s")) / (F.col("d_n") + k_d)
    levels = of_suffix.withColumn("p_s", p_s).select("domain", "suffix", p_d.alias("p_d"))
    a, b = F.col("bad") + k_h * F.col("p_d"), F.col("n") - F.col("bad") + k_h * (1 - F.col("p_d"))
    mean = a / (a + b)
    low = mean - z * F.sqrt(mean * (1 - mean) / (a + b + 1))
    return hosts.join(cut(levels), ["domain", "suffix"]).select("host", mean.alias("bad_rate"), F.greatest(low, F.lit(0.0)).alias("bad_low"), "n")


def judge(pages: DataFrame, outcomes: DataFrame | None = None, block=BLOCK, allow=ALLOW, threshold: float = 0.5, z: float = 1.0, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, bad_rate, bad_low.

    outcomes: labelled pages as (url, bad 0/1). Left out, the rules label the pages: bad if one blocks it, else
    good, as a page that was ruled on and not blocked is; counting only pages that a rule names would make a host
    bad for one path of it. The verdict is the rule's; without a rule, block where the lower bound of the host's bad
    rate is above the threshold, else allow. A null or empty url has an empty host and path, no rule, and is
    judged by the rate of the empty host. Repeated rows and null ids pass one by one; other columns are
    not read. The table of hosts is written before the last join, so that Spark sees its size and
    either broadcasts it or splits the partition of a hot host.
    """
    rules = [*block, *allow]
    named = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    host, path = split_url(F.col("url"))
    named = named.select("page_id", host.alias("host"), path.alias("path")).withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules))
    bad = F.when(F.col("rule").isin(*block), 1).when(F.col("rule").isNotNull(), 0)
    if outcomes is None:
        labelled = named.select("host", F.coalesce(bad, F.lit(0)).alias("bad"))
    else:
        other = outcomes.select(F.col("url").cast("string").alias("url"), "bad")
        labelled = named.select("host", F.lit(None).cast("int").alias("bad")).unionByName(other.select(split_url(F.col("url"))[0].alias("host"), F.col("bad").cast("int").alias("bad")))
    known = cut(reputation(labelled, z).where(F.col("host").isNotNull()))
    verdict = F.when(bad == 1, "block").when(bad == 0, "allow").when(F.col("bad_low") > threshold, "block").otherwise("allow")
    return named.join(known, "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "bad_rate", "bad_low")


def query(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages")).drop("bad_rate", "bad_low")


ORACLE = r"""
WITH parts AS (
  SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages),
named AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM named),
outcomes AS (SELECT host, (coalesce(rule, '') IN ('net/', 'example.com/de/'))::INT AS bad FROM ruled),
counted AS (SELECT host, sum(bad) AS bad, count(*) AS n FROM outcomes GROUP BY host),
named_hosts AS (SELECT *, regexp_replace(host, '(^[^@]*@)|(:[0-9]*$)|(\.$)', '', 'g') AS name FROM counted),
labels AS (SELECT *, string_split(name, '.') AS l, regexp_matches(name, '^[0-9]+(\.[0-9]+){3}$') OR starts_with(name, '[') AS address,
  regexp_matches(name, '(^|\.)(ac|co|com|edu|gov|net|ne|or|org)\.[a-z][a-z]$') OR array_to_string(list_slice(string_split(name, '.'), -2, -1), '.') IN
    ('appspot.com', 'blogspot.com', 'github.io', 'gitlab.io', 'herokuapp.com', 'netlify.app', 'pages.dev', 'web.app', 'wordpress.com') AS two FROM named_hosts),
hosts AS (SELECT host, bad, n, CASE WHEN address THEN name ELSE array_to_string(list_slice(l, CASE WHEN two THEN -3 ELSE -2 END, -1), '.') END AS domain,
  CASE WHEN address THEN 'ip' WHEN two THEN array_to_string(list_slice(l, -2, -1), '.') ELSE list_extract(l, -1) END AS suffix FROM labels),
d AS (SELECT domain, suffix, sum(bad) AS bad, sum(n) AS n FROM hosts GROUP BY domain, suffix),
s AS (SELECT suffix, sum(bad) AS bad, sum(n) AS n FROM d GROUP BY suffix),
e AS (SELECT sum(bad) AS bad, sum(n) AS n FROM s),
pairs AS (SELECT 'h' AS level, h.bad AS x, h.n AS m, d.bad / d.n AS p, d.n AS total FROM hosts h JOIN d USING (domain, suffix)
  UNION ALL SELECT 'd', d.bad, d.n, s.bad / s.n, s.n FROM d JOIN s USING (suffix) UNION ALL SELECT 's', s.bad, s.n, e.bad / e.n, e.n FROM s, e),
moments AS (SELECT level, sum(m * (x / m - p) * (x / m - p) / (p * (1 - p)) - (1 - m / total)) AS excess, sum((1 - m / total) * (m - 1)) AS room
  FROM pairs WHERE p > 0 AND p < 1 GROUP BY level),
k AS (SELECT level, CASE WHEN room > 0 THEN CASE WHEN greatest(excess, 0) / room * 1001 <= 1 THEN 1000.0
  ELSE greatest(1.0, (1 - greatest(excess, 0) / room) / (greatest(excess, 0) / room)) END ELSE 1.0 END AS k FROM moments),
ks AS (SELECT coalesce(max(k) FILTER (level = 'h'), 1.0) AS kh, coalesce(max(k) FILTER (level = 'd'), 1.0) AS kd, coalesce(max(k) FILTER (level = 's'), 1.0) AS ks FROM k),
rates AS (SELECT domain, suffix, kh, (d.bad + kd * (s.bad + ks * (e.bad + 1) / (e.n + 2)) / (s.n + ks)) / (d.n + kd) AS p FROM d JOIN s USING (suffix), ks, e),
ab AS (SELECT host, bad + kh * p AS a, n - bad + kh * (1 - p) AS b FROM hosts JOIN rates USING (domain, suffix)),
low AS (SELECT host, a / (a + b) - 1.0 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) AS low FROM ab)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN low > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled JOIN low USING (host)
"""
