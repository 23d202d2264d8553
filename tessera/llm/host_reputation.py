"""Empirical-Bayes host reputation: pages are kept or blocked by their host's posterior.

Labelled page outcomes (good or bad) are counted per host, hosts are summed to
registered domains, domains to suffixes, suffixes to the whole. Every level is
shrunk towards the one above by a beta-binomial prior whose strength is fitted
by moments from the spread of the groups on that level. A host is blocked when
the lower bound of its posterior bad rate lies above a threshold; a host without
labels has its domain's posterior, a domain without labels its suffix's, and so
on. A short list of explicit rules goes before the posterior.

Everything is DataFrame expressions, aggregations and joins. Counting starts
with one aggregation per host (map-side combined, so a host with a third of all
pages sends one row per task); the upper levels read that result.

Edge cases: a null url, or one without ``://``, has the empty host and path (the
empty host is a host of its own, with the empty domain and suffix); labels with
null outcomes or null ids are left out; several labels of one page all count;
repeated pages each get their row; without any label the prior is
``no_label_rate``; an empty page table gives no rows. Further columns of the pages
are not carried, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEVELS = ("suffix", "domain", "host")


@dataclass(frozen=True)
class Rule:
    """``action`` (allow or block) for a host with all subdomains and a path prefix."""

    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def rule_column(host: Column, path: Column, rules: Sequence[Rule], field: str = "text") -> Column:
    """``field`` of the longest rule that fits, else null (equal lengths: longer host, then block)."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host), r.action == "block")):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(getattr(r, field))).otherwise(out)
    return out


def suffix_of(host: Column, suffixes: Sequence[str]) -> Column:
    """The longest listed suffix the host ends in, else its last label."""
    out = F.element_at(F.split(host, r"\."), -1)
    for s in sorted(suffixes, key=len):
        out = F.when((host == s) | host.endswith("." + s), F.lit(s)).otherwise(out)
    return out


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix and the label before it; the host itself where there is none."""
    head = F.substr(host, F.lit(1), F.length(host) - F.length(suffix) - 1)
    return F.when(host == suffix, host).otherwise(
        F.concat(F.element_at(F.split(head, r"\."), -1), F.lit("."), suffix))


def _strength(groups: DataFrame, least: float, most: float) -> float:
    """Prior strength of a level by moments: how far ``bad`` spreads around ``n * mean``."""
    n, y, m = F.col("n"), F.col("bad"), F.col("mean")
    v = m * (1 - m)
    got = groups.agg(F.sum((y - n * m) * (y - n * m) - n * v).alias("over"),
                     F.sum(n * (n - 1) * v).alias("scale")).first()  # one row
    if not got["scale"] or got["scale"] <= 0:
        return most
    rho = got["over"] / got["scale"]
    return most if rho <= 1 / (most + 1) else max(least, 1 / rho - 1)


def host_posteriors(outcomes: DataFrame, suffixes: Sequence[str] = (), least: float = 1.0, most: float = 1000.0,
                    no_label_rate: float = 0.5) -> DataFrame:
    """``host, n, bad, a, b``: the beta posterior of the bad rate of every host.

    ``outcomes`` has one row per host with ``host, n, bad`` (labels and bad labels,
    0 for hosts without). ``least`` and ``most`` bound the fitted prior strengths.
    """
    hosts = outcomes.withColumn("suffix", suffix_of(F.col("host"), suffixes))
    hosts = hosts.withColumn("domain", domain_of(F.col("host"), F.col("suffix")))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    mean = total["bad"] / total["n"] if total["n"] else no_label_rate
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("suffix", "domain").agg(*sums)
    suffix = domains.groupBy("suffix").agg(*sums).withColumn("mean", F.lit(float(mean)))
    levels = {"suffix": suffix, "domain": domains, "host": hosts.select("suffix", "domain", "host", "n", "bad")}
    above = None
    for name in LEVELS:
        here = levels[name]
        if above is not None:
            here = here.join(above, LEVELS[LEVELS.index(name) - 1])
        k = _strength(here, least, most)
        a = F.col("bad") + k * F.col("mean")
        b = F.col("n") - F.col("bad") + k * (1 - F.col("mean"))
        here = here.withColumns({"a": a, "b": b})
        above = here.select(name, (F.col("a") / (F.col("a") + F.col("b"))).alias("mean"))
    return here.select("host", "n", "bad", "a", "b")


def bad_rate_bound(a: Column, b: Column, z: float) -> Column:
    """Lower bound of the posterior bad rate: mean less ``z`` standard deviations."""
    mean = a / (a + b)
    return mean - z * F.sqrt(mean * (1 - mean) / (a + b + 1))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[Rule], suffixes: Sequence[str] = (),
               max_bad_rate: float = 0.3, z: float = 1.64, page_id: str = "page_id", url: str = "url",
               label_id: str = "doc_id") -> DataFrame:
    """``page_id, host, path, rule, verdict, bad_rate, bad_rate_low`` for every page.

    ``labels`` has ``label_id`` (a page's id), ``quality`` and ``toxic``; a page is
    bad when it is toxic or of quality 0. Without a fitting rule the verdict is
    ``block`` where the lower bound lies above ``max_bad_rate``.
    """
    parsed = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"),
                          path_of(F.col(url)).alias("path"))
    parsed = parsed.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("host", "path")})
    bad = F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))
    known = labels.filter(F.col(label_id).isNotNull() & (F.col("toxic").isNotNull() | F.col("quality").isNotNull()))
    counts = known.groupBy(F.col(label_id).alias("page_id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(bad.cast("long")).alias("bad"))
    outcomes = parsed.select("page_id", "host").join(counts, "page_id", "left").groupBy("host").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    post = host_posteriors(outcomes, suffixes).select(
        "host", (F.col("a") / (F.col("a") + F.col("b"))).alias("bad_rate"),
        bad_rate_bound(F.col("a"), F.col("b"), z).alias("bad_rate_low"))
    judged = parsed.join(post, "host", "left")
    h, p = F.col("host"), F.col("path")
    by_rule = rule_column(h, p, rules, "action")
    by_rate = F.when(F.col("bad_rate_low") > max_bad_rate, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule_column(h, p, rules).alias("rule"),
                         F.coalesce(by_rule, by_rate).alias("verdict"), "bad_rate", "bad_rate_low")
