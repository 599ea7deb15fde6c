"""URL filters: explicit host and path rules, then the reputation of the host.

Labelled page outcomes are shrunk with beta-binomial priors from suffix to
registered domain to host; a host is blocked when the lower bound of its bad
rate is too high. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bounds of a fitted prior's weight, in pages.
MIN_STRENGTH, MAX_STRENGTH = 1.0, 10_000.0
DEVIATIONS = 2.0
MAX_BAD_RATE = 0.5
#: What a page is taken to be before anything is labelled.
DEFAULT_RATE = 0.0


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def last_labels(host: Column, count: int) -> Column:
    return F.substring_index(host, ".", -count)


def match_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``rule`` and ``rule_verdict`` of the longest rule that fits ``host`` and ``path``.

    ``rules`` holds ``rule_host``, ``rule_path`` and ``rule_verdict``; a rule
    fits its host and all subdomains when the path starts with its path. Rows
    are matched by equality only: the distinct hosts and paths meet, for every
    parent host, the path lengths its rules have, and each (parent, prefix) is
    looked up. Of two rules of one length the lesser text wins; of equal rules
    block wins over allow (the greater text).
    """
    rules = rules.select(
        F.coalesce("rule_host", F.lit("")).alias("_rule_host"),
        F.coalesce("rule_path", F.lit("")).alias("_prefix"),
        F.col("rule_verdict").alias("_verdict"),
    ).groupBy("_rule_host", "_prefix").agg(F.max("_verdict").alias("_verdict"))
    lengths = rules.select("_rule_host", F.length("_prefix").alias("_length")).distinct()
    hosts = pages.select("host").distinct()
    labels = F.split("host", r"\.", -1)
    parents = hosts.select(
        "host",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size(labels)),
                lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
            )
        ).alias("_rule_host"),
    )
    asked = parents.join(lengths, "_rule_host")
    prefixes = (
        pages.select("host", "path")
        .distinct()
        .join(asked, "host")
        .where(F.length("path") >= F.col("_length"))
        .withColumn("_prefix", F.substr("path", F.lit(1), F.col("_length")))
    )
    text = F.concat("_rule_host", "_prefix")
    fitting = prefixes.join(rules, ["_rule_host", "_prefix"]).groupBy("host", "path").agg(
        F.min(F.struct((-F.length(text)).alias("l"), text.alias("rule"), F.col("_verdict").alias("v"))).alias("_best")
    )
    best = fitting.select("host", "path", F.col("_best.rule").alias("rule"), F.col("_best.v").alias("rule_verdict"))
    return pages.drop("rule", "rule_verdict").join(best, ["host", "path"], "left")


def _shrink(units: DataFrame, parent: str | float) -> tuple[DataFrame, float]:
    """Posterior mean ``rate`` of units with ``n`` and ``bad`` around the parent's; and the prior's weight."""
    mean = F.col(parent) if isinstance(parent, str) else F.lit(parent)
    seen, bad = F.col("n"), F.col("bad")
    raw = F.when(seen > 0, bad / seen).otherwise(0.0)
    # One row: the spread of all units around their parents.
    fit = units.agg(
        F.sum(seen).alias("n"),
        F.sum(seen * mean * (1 - mean)).alias("within"),
        F.sum(seen * (raw - mean) * (raw - mean)).alias("between"),
    ).first()
    within, between = fit["within"] or 0.0, fit["between"] or 0.0
    strength = within / between - 1 if between > 1e-12 else MAX_STRENGTH
    strength = min(max(strength, MIN_STRENGTH), MAX_STRENGTH)
    return units.withColumn("rate", (bad + mean * strength) / (seen + strength)), strength


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """``host, host_pages, host_rate, host_low`` from rows of ``host`` and ``bad`` (null: not labelled).

    Every level's prior sits at its parent's posterior mean; its weight comes
    from the spread of the level, method of moments. The suffix is the last
    label of the host and the registered domain the last two.
    """
    hosts = stage(
        outcomes.groupBy("host").agg(
            F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad")
        ),
        "hosts",
    ).select("*", last_labels(F.col("host"), 2).alias("domain"), last_labels(F.col("host"), 1).alias("suffix"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = total["bad"] / total["n"] if total["n"] else DEFAULT_RATE
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    suffixes, _ = _shrink(hosts.groupBy("suffix").agg(*sums), overall)
    suffixes = suffixes.select("suffix", F.col("rate").alias("suffix_rate"))
    domains, _ = _shrink(hosts.groupBy("domain", "suffix").agg(*sums).join(suffixes, "suffix"), "suffix_rate")
    domains = domains.select("domain", F.col("rate").alias("domain_rate"))
    shrunk, strength = _shrink(hosts.join(domains, "domain"), "domain_rate")
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + strength + 1))
    return shrunk.select(
        "host",
        F.col("n").alias("host_pages"),
        F.col("rate").alias("host_rate"),
        F.greatest(F.lit(0.0), F.col("rate") - DEVIATIONS * deviation).alias("host_low"),
    )


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", bad: str = "bad") -> DataFrame:
    """Add ``host``, ``path``, ``rule``, the host's reputation and ``verdict`` to every row.

    ``bad`` is true or false where a page is labelled, else null. A rule's
    verdict stands; without one the host decides. A url that is null or has no
    ``://`` has an empty host and path, and is judged like any other host.
    Repeated rows count as often as they occur. Columns of these names in the
    input are replaced.
    """
    made = ("host", "path", "rule", "rule_verdict", "host_pages", "host_rate", "host_low", "verdict")
    rows = pages.drop(*made).withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    reputation = host_reputation(rows.select("host", F.col(bad).alias("bad")))
    own = F.when(F.col("host_low") > MAX_BAD_RATE, "block").otherwise("allow")
    judged = match_rules(rows, rules).join(reputation, "host", "left")
    return judged.withColumn("verdict", F.coalesce("rule_verdict", own))
