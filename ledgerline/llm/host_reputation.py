"""URL filter by empirical-Bayes host reputation, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.session import write_down

MOST_BAD = 0.3  # a host is blocked if its rate of bad pages is above this
SURELY = 1.28   # standard deviations that the rate is above it (nine in ten)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Second labels that make a suffix of two labels before a country of two letters.
SECOND = ("ac", "co", "com", "edu", "go", "gov", "ne", "net", "or", "org")
ADDRESS = r"^[0-9.]*$|:"


@dataclass(frozen=True)
class Rule:
    """Allows or blocks a host with its subdomains where the path begins with ``path``."""
    verdict: str
    host: str
    path: str


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.when(F.instr(url, "://") > 0, host).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as struct(size, rule, verdict), or null."""
    fits = [F.when(((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path)),
                   F.struct(F.lit(len(r.host) + len(r.path)).alias("size"), F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict")))
            for r in rules]
    return F.array_max(F.array_compact(F.array(*fits))) if fits else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def _two_labels(name: Column) -> Column:
    """Whether the suffix has two labels, as in ``co.uk``."""
    before = F.substring_index(F.substring_index(name, ".", -2), ".", 1)
    return name.rlike(r"(?:^|\.)[^.]+\.[a-z]{2}$") & before.isin(*SECOND)


def suffix_of(name: Column) -> Column:
    """The last label, or the last two where :data:`SECOND` has the one before a country; an address has none."""
    suffix = F.when(_two_labels(name), F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))
    return F.when(name.rlike(ADDRESS), "").otherwise(suffix)


def domain_of(name: Column) -> Column:
    """The registered domain: one label more than the suffix; an address is its own domain."""
    labels = F.when(_two_labels(name), F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))
    return F.when(name.rlike(ADDRESS), name).otherwise(labels)


def prior_strength(level: DataFrame) -> float:
    """How many pages a prior weighs: from the spread of groups with ``n`` outcomes, ``bad`` of them, around
    the prior means ``mean``. What the spread exceeds chance by is the correlation within groups."""
    spread = F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("mean"), 2) / (F.col("mean") * (1 - F.col("mean")))
    row = level.where("n > 0").agg(F.count("*").alias("groups"), F.sum("n").alias("n"), F.sum(spread).alias("s")).first()
    if not row["groups"] or row["n"] <= row["groups"]:
        return 1.0
    correlation = min(0.9, max(0.01, (row["s"] - row["groups"]) / (row["n"] - row["groups"])))
    return 1 / correlation - 1


def shrunk(level: DataFrame, strength: float) -> Column:
    return (F.col("bad") + strength * F.col("mean")) / (F.col("n") + strength)


def host_reputation(hosts: DataFrame) -> DataFrame:
    """``host, rate, deviation`` for rows ``host, n, bad`` (one a host, hosts without outcomes too).

    Beta-binomial posteriors from the suffix to the registered domain to the host: each level's prior
    has the posterior mean of the level above and a strength estimated from all groups of the level.
    The levels' four sums are all that reaches the driver.
    """
    name = F.regexp_replace("host", r"^.*@|:[0-9]*$|\.+$", "")
    placed = write_down(hosts.select("host", "n", "bad", suffix_of(name).alias("suffix"), domain_of(name).alias("domain")))
    total = placed.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = ((total["bad"] or 0) + 1) / ((total["n"] or 0) + 2)
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    suffixes = placed.groupBy("suffix").agg(*sums).withColumn("mean", F.lit(overall))
    suffixes = suffixes.select("suffix", shrunk(suffixes, prior_strength(suffixes)).alias("mean"))
    domains = placed.groupBy("domain", "suffix").agg(*sums).join(suffixes, "suffix")
    domains = domains.select("domain", "suffix", shrunk(domains, prior_strength(domains)).alias("mean"))
    level = write_down(placed.join(domains, ["domain", "suffix"]))
    strength = prior_strength(level)
    rate, weight = shrunk(level, strength), F.col("n") + strength
    return level.select("host", rate.alias("rate"), F.sqrt(rate * (1 - rate) / (weight + 1)).alias("deviation"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule] = (), most_bad: float = MOST_BAD, surely: float = SURELY) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, rate``.

    ``outcomes`` has ``page_id`` and ``bad`` (0 or 1; null counts for nothing); several outcomes of a
    page all count. A rule that fits decides, the longest first (of equally long ones the greater text);
    else a page is blocked if the bad rate of its host is above ``most_bad`` by ``surely`` posterior
    deviations. Hosts without outcomes have their domain's rate, these their suffix's. A null url, or
    one without ``://``, has empty host and path and fits no rule. Repeated rows are judged each; rows
    with null ids are judged but have no outcomes; empty tables give an empty result; other columns
    are ignored. A host with any share of the pages is counted where its pages are read first.
    """
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    counts = outcomes.where("bad is not null").groupBy("page_id").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    named = urls.select("page_id", "host").distinct().join(counts, "page_id", "left")
    hosts = named.groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    known = write_down(host_reputation(hosts))
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("rate") - surely * F.col("deviation") > most_bad, "block").otherwise("allow")
    return urls.join(known, "host", "left").withColumn("fit", rule).select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", own).alias("verdict"), "rate")


#: Verdicts of a page's judging by plain SQL, for DuckDB, with the rules of the registered query.
ORACLE_SQL = r"""
WITH urls AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0
    THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
  CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
outcomes AS (SELECT doc_id AS page_id, count(*) AS n, sum(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE toxic IS NOT NULL OR quality IS NOT NULL GROUP BY doc_id),
hosts AS (SELECT host, coalesce(sum(n), 0) AS n, coalesce(sum(bad), 0) AS bad,
    regexp_replace(host, '^.*@|:[0-9]*$|\.+$', '', 'g') AS name, string_split(name, '.') AS labels,
    regexp_matches(name, '^[0-9.]*$|:') AS address, CASE WHEN regexp_matches(name, '(^|\.)(ac|co|com|edu|go|gov|ne|net|or|org)\.[a-z]{2}$') THEN 2 ELSE 1 END AS k
  FROM (SELECT DISTINCT page_id, host FROM urls) LEFT JOIN outcomes USING (page_id) GROUP BY host),
placed AS (SELECT host, n, bad, CASE WHEN address THEN '' ELSE array_to_string(labels[-k:], '.') END AS suffix,
    CASE WHEN address THEN name ELSE array_to_string(labels[-k - 1:], '.') END AS domain FROM hosts),
overall AS (SELECT (coalesce(sum(bad), 0) + 1.0) / (coalesce(sum(n), 0) + 2) AS mean FROM placed),
s AS (SELECT suffix, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, any_value(mean) AS mean FROM placed, overall GROUP BY suffix),
sk AS (SELECT CASE WHEN count(*) = 0 OR sum(n) <= count(*) THEN 1.0 ELSE
  1 / least(0.9, greatest(0.01, (sum(n * (bad / n - mean) ** 2 / (mean * (1 - mean))) - count(*)) / (sum(n) - count(*)))) - 1 END AS k FROM s WHERE n > 0),
sm AS (SELECT suffix, (bad + k * mean) / (n + k) AS mean FROM s, sk),
d AS (SELECT domain, suffix, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, any_value(mean) AS mean FROM placed JOIN sm USING (suffix) GROUP BY domain, suffix),
dk AS (SELECT CASE WHEN count(*) = 0 OR sum(n) <= count(*) THEN 1.0 ELSE
  1 / least(0.9, greatest(0.01, (sum(n * (bad / n - mean) ** 2 / (mean * (1 - mean))) - count(*)) / (sum(n) - count(*)))) - 1 END AS k FROM d WHERE n > 0),
dm AS (SELECT domain, suffix, (bad + k * mean) / (n + k) AS mean FROM d, dk),
h AS (SELECT host, n::DOUBLE AS n, bad::DOUBLE AS bad, mean FROM placed JOIN dm USING (domain, suffix)),
hk AS (SELECT CASE WHEN count(*) = 0 OR sum(n) <= count(*) THEN 1.0 ELSE
  1 / least(0.9, greatest(0.01, (sum(n * (bad / n - mean) ** 2 / (mean * (1 - mean))) - count(*)) / (sum(n) - count(*)))) - 1 END AS k FROM h WHERE n > 0),
known AS (SELECT host, (bad + k * mean) / (n + k) AS rate, n + k AS weight FROM h, hk),
rules AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) t(verdict, rhost, rpath)),
fits AS (SELECT DISTINCT host, path, rhost || rpath AS rule, verdict FROM (SELECT DISTINCT host, path FROM urls) u JOIN rules
  ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
best AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM fits GROUP BY host, path)
SELECT page_id, u.host, u.path, rule, coalesce(verdict,
  CASE WHEN rate - 1.28 * sqrt(rate * (1 - rate) / (weight + 1)) > 0.3 THEN 'block' ELSE 'allow' END) AS verdict
FROM urls u LEFT JOIN best b ON u.host = b.host AND u.path = b.path LEFT JOIN known k ON u.host = k.host
"""
