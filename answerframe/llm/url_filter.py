"""URL filter by host reputation, with explicit rules on top. DataFrame functions only.

Labelled outcomes of pages (good or bad) are counted per host and shrunk through
beta-binomial priors: suffix towards all pages, registered domain towards its suffix, host
towards its domain. How strongly is estimated from the data, per level (an analysis of
variance of the children's rates). A host is blocked when even the upper bound of its
posterior rate of good pages is below ``min_good``.

Counts are summed before they are shuffled, so a host with a third of all pages costs no
more than any other. Only three numbers per level reach the driver.

Nulls and ties: a null URL, or one without ``://``, has an empty host and path; such pages
form one host of their own. User, port and last dot are parts of the host but not of its domain;
a numeric address is its own domain, and all of them share a suffix. Null outcomes count as unlabelled. Without labelled pages
nothing is blocked. Of rules that fit, the longest wins; of equal ones, the first given.
Repeated pages are judged alike; repeated labels of a page count once (the worst of them).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Labels that below a country's two letters are part of the suffix, as in ``co.uk`` and ``com.sg``.
SECOND_LABELS = ("ac", "co", "com", "edu", "go", "gob", "gov", "mil", "ne", "net", "or", "org")
# What stands for the suffix of numeric addresses; no name can be it.
ADDRESS = "[address]"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def name_of(host: Column) -> Column:
    """The host without user, port and last dot."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", ""), r"\.$", "")


def suffix_of(host: Column, suffixes: Sequence[str] = ()) -> Column:
    """What domains are registered under: the longest of ``suffixes`` that fits, or by rule the last one or two labels."""
    name = name_of(host)
    two = F.substring_index(name, ".", -2)
    found = F.when(name.rlike(r"^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*\])$"), ADDRESS)
    for suffix in sorted(suffixes, key=len, reverse=True):
        found = found.when((name == suffix) | name.endswith("." + suffix), suffix)
    return found.when(two.rlike(rf"^({'|'.join(SECOND_LABELS)})\.[a-z]{{2}}$"), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column, suffixes: Sequence[str] = ()) -> Column:
    """The suffix and one label more; an address is its own domain."""
    suffix, labels = suffix_of(host, suffixes), F.split(name_of(host), r"\.")
    n = F.size(F.split(suffix, r"\.")) + 1
    return F.when(suffix == ADDRESS, name_of(host)).otherwise(F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - n + 1), n), "."))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, both null if none fits. A rule is (verdict, ``host/path``)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        rule_host, _, rest = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def strength(rates: DataFrame) -> float:
    """How many pseudo-pages a parent's rate is worth for a child, from the children's ``n`` and ``good``.

    From the variance between children against that within them; between 1 and 10,000.
    """
    p = F.col("good") / F.col("n")
    s = rates.agg(
        F.count("*").alias("groups"),
        F.sum("n").alias("n"),
        F.sum("good").alias("good"),
        F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum(F.col("good") * F.col("good") / F.col("n")).alias("between"),
        F.sum(F.col("n") * p * (1 - p)).alias("within"),
    ).first()
    if s["groups"] < 2 or s["n"] <= s["groups"]:
        return 10.0
    mean_square_between = (s["between"] - s["good"] ** 2 / s["n"]) / (s["groups"] - 1)
    mean_square_within = s["within"] / (s["n"] - s["groups"])
    size = (s["n"] - s["nn"] / s["n"]) / (s["groups"] - 1)
    excess = mean_square_between - mean_square_within
    if excess <= 0:
        return 10_000.0
    alike = excess / (mean_square_between + (size - 1) * mean_square_within)
    return min(10_000.0, max(1.0, 1 / alike - 1))


def host_reputation(outcomes: DataFrame, hosts: DataFrame, z: float = 1.645, suffixes: Sequence[str] = ()) -> DataFrame:
    """Posterior of every host of ``hosts``: ``host, n, good, mean, upper``.

    ``outcomes`` has ``host`` and ``good`` (1 or 0), a row for each labelled page. Hosts
    without labelled pages get what their domain and suffix say.
    """
    counts = outcomes.filter("good is not null").groupBy("host").agg(
        F.count("*").alias("n"), F.sum(F.col("good").cast("bigint")).alias("good")
    )
    per_host = (
        hosts.select("host").distinct().join(counts, "host", "left")
        .select("host", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("good", F.lit(0)).alias("good"))
        .withColumn("domain", domain_of(F.col("host"), suffixes))
        .withColumn("suffix", suffix_of(F.col("host"), suffixes))
    )
    sums = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    per_domain = per_host.groupBy("domain", "suffix").agg(*sums)
    per_suffix = per_domain.groupBy("suffix").agg(*sums)
    every = per_suffix.agg(*sums).first()
    overall = (every["good"] / every["n"]) if every["n"] else 1.0
    labelled = F.col("n") > 0
    c_suffix, c_domain, c_host = (strength(x.filter(labelled)) for x in (per_suffix, per_domain, per_host))

    def shrunk(towards: Column, worth: float) -> Column:
        return (F.col("good") + F.lit(worth) * towards) / (F.col("n") + F.lit(worth))

    suffixes = per_suffix.select("suffix", shrunk(F.lit(overall), c_suffix).alias("suffix_mean"))
    domains = per_domain.join(suffixes, "suffix").select(
        "domain", "suffix", shrunk(F.col("suffix_mean"), c_domain).alias("domain_mean")
    )
    mean = shrunk(F.col("domain_mean"), c_host)
    return (
        per_host.join(domains, ["domain", "suffix"])
        .withColumn("mean", mean)
        .withColumn("upper", F.col("mean") + z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + c_host + 1)))
        .select("host", "n", "good", "mean", "upper")
    )


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = (), min_good: float = 0.5, z: float = 1.645,
    suffixes: Sequence[str] = (),
) -> DataFrame:
    """``page_id, host, path, rule, verdict, upper`` for every page.

    ``outcomes`` has ``page_id`` and ``good``. ``rules`` and ``suffixes`` (further public
    suffixes, such as ``blogs.example``) become part of the plan: some hundreds at most.
    """
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    once = outcomes.filter("page_id is not null and good is not null").groupBy("page_id").agg(F.min("good").alias("good"))
    reputation = host_reputation(parsed.join(once, "page_id").select("host", "good"), parsed, z, suffixes)
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    # A host may hold a third of the pages. If the reputations are too many to broadcast,
    # the adaptive plan splits such a host's pages over tasks.
    return parsed.join(reputation.select("host", "upper"), "host").select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("upper") < min_good, "block").otherwise("allow")).alias("verdict"), "upper",
    )
