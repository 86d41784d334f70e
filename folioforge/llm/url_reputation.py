"""URL filter by the reputation of hosts, estimated with empirical Bayes.

Labelled outcomes of pages are counted by host.  A host's rate of bad pages is shrunk
towards its registered domain's, a domain's towards its suffix's, and a suffix's towards the
rate of all pages: at each level the level above gives the mean of a beta prior, and the
spread of the counts within it gives the prior's weight.  A host is blocked if even the
lower bound of its posterior rate is above the limit.  Rules on hosts and paths go first.

All of it is column expressions, grouped sums and equality joins.  Only counts are joined to
pages; a host with a third of all pages is one row on that side, and Spark splits the other.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.rows import ascii_lower
from folioforge.session import cut_lineage

#: Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = (
    "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au",
    "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "net.au", "ne.jp", "or.jp", "org.au",
    "org.uk",
)


@dataclass(frozen=True)
class Rule:
    """``verdict`` for urls of ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        own = (host == self.host) | host.endswith("." + self.host)
        return own & path.startswith(self.path)


@dataclass(frozen=True)
class Limits:
    """``rate``: bad pages that a host may have.  ``deviations``: standard deviations of the
    posterior between its mean and the bound.  The within-level correlation from which a
    prior's weight follows is kept between ``least`` and ``most``."""

    rate: float = 0.5
    deviations: float = 1.645
    least: float = 0.001
    most: float = 0.5


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` and ``path``; both are empty for null urls and urls without ``://``."""
    after = F.expr(f"substr({url}, instr({url}, '://') + 3)")
    absolute = F.instr(url, "://") > 0
    host = ascii_lower(F.regexp_extract(after, "^[^/?#]*", 0))
    path = F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)
    return pages.withColumns(
        {"host": F.when(absolute, host).otherwise(""), "path": F.when(absolute, path).otherwise("")}
    )


def _levels(host: Column) -> dict[str, Column]:
    bare = F.regexp_replace(host, r":[0-9]*$", "")
    # An address is its own domain and suffix: its last numbers say nothing of another one.
    address = bare.rlike(r"^[0-9]+(\.[0-9]+){3}$")
    two = F.substring_index(bare, ".", -2)
    long_suffix = two.isin(*TWO_LABEL_SUFFIXES)
    return {
        "suffix": F.when(address, bare).when(long_suffix, two).otherwise(F.substring_index(bare, ".", -1)),
        "domain": F.when(address, bare).when(long_suffix, F.substring_index(bare, ".", -3)).otherwise(two),
    }


def _weight(children: DataFrame, limits: Limits) -> float:
    """The weight of the priors of one level, from ``n``, ``k`` and the parent's ``mean``.

    With correlation r of the outcomes of a child, the expected square of k - n * mean is
    n * mean * (1 - mean) * (1 + (n - 1) * r); summed over children that gives r.
    """
    one = F.col("n") * F.col("mean") * (1 - F.col("mean"))
    excess, pairs = children.agg(
        F.sum((F.col("k") - F.col("n") * F.col("mean")) ** 2 - one), F.sum(one * (F.col("n") - 1))
    ).first()
    r = (excess or 0.0) / pairs if pairs else limits.most
    return 1 / min(max(r, limits.least), limits.most) - 1


def _shrunk(counts: DataFrame, limits: Limits) -> DataFrame:
    """Turn a parent's ``mean`` into the row's own posterior: ``mean`` and ``deviation``."""
    s = _weight(counts, limits)
    mean = (F.col("mean") * s + F.col("k")) / (F.col("n") + s)
    return counts.withColumn("mean", mean).withColumn(
        "deviation", F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + s + 1))
    )


def host_reputations(outcomes: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``(host, n, k, mean, deviation)`` for ``(host, bad)``, one row per host.

    Outcomes with null ``bad`` count a host without counting a page.
    """
    hosts = outcomes.groupBy("host").agg(
        F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("k")
    )
    # Stored: weights and means of all levels are taken from the counts, not from the pages.
    hosts = cut_lineage(hosts.withColumns(_levels(F.col("host"))), "hosts")
    counted = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    domains = cut_lineage(counted, "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    n, k = suffixes.agg(F.sum("n"), F.sum("k")).first()
    overall = (k + 1) / (n + 2) if n is not None else 0.5
    suffixes = _shrunk(suffixes.withColumn("mean", F.lit(overall)), limits)
    domains = _shrunk(domains.join(suffixes.select("suffix", "mean"), "suffix"), limits)
    above = domains.select("suffix", "domain", "mean")
    return _shrunk(hosts.join(above, ["suffix", "domain"]), limits).select(
        "host", "n", "k", "mean", "deviation"
    )


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: list[Rule],
    limits: Limits = Limits(),
    page_id: str = "page_id",
) -> DataFrame:
    """``(page_id, host, path, rule, verdict, bad_rate, bad_rate_bound)`` of every page.

    ``outcomes`` is ``(host, bad)``, a row per labelled page.  Of the rules that fit, the
    longest decides, of equally long ones the first in the list; without one, the host's
    reputation does.  A host without any outcome has its domain's rate, and so on up.  Null
    urls have an empty host and path, urls of any length are read whole, repeated pages each
    get a row, an empty table gives none, and other columns don't matter.
    """
    parts = with_host_and_path(pages).select(page_id, "host", "path")
    ordered = sorted(rules, key=lambda r: -len(r.text))
    rule = F.coalesce(
        *[F.when(r.fits(F.col("host"), F.col("path")), F.lit(r.text)) for r in ordered],
        F.lit(None).cast("string"),
    )
    ruled = reduce(lambda c, r: c.when(F.col("rule") == r.text, r.verdict), ordered, F)
    known = host_reputations(
        outcomes.select("host", "bad").unionByName(
            parts.select("host").distinct().withColumn("bad", F.lit(None).cast("boolean"))
        ),
        limits,
    )
    bound = F.greatest(F.col("mean") - limits.deviations * F.col("deviation"), F.lit(0.0))
    by_host = known.select("host", F.col("mean").alias("bad_rate"), bound.alias("bad_rate_bound"))
    judged = parts.withColumn("rule", rule).join(by_host, "host", "left")
    method = F.when(F.col("bad_rate_bound") > limits.rate, "block").otherwise("allow")
    verdict = ruled.otherwise(method) if ordered else method
    return judged.select(
        page_id, "host", "path", "rule", verdict.alias("verdict"), "bad_rate", "bad_rate_bound"
    )
