"""URL filter: allow and block rules, and beyond them the reputation of hosts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from dwellspark.llm.rows import ascii_lower, column, pack, unpack
from dwellspark.session import cut_lineage


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Suffixes of two labels under which domains are registered; all other suffixes are the last label.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in", "com.cn")
#: A host is blocked if, this many standard deviations below its mean, its rate of bad pages still exceeds MOST_BAD.
DEVIATIONS, MOST_BAD = 1.645, 0.5


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffix(host: Column, long_suffixes: tuple[str, ...] = LONG_SUFFIXES) -> Column:
    last_two = F.substring_index(host, ".", -2)
    return F.when(last_two.isin(*long_suffixes), last_two).otherwise(F.substring_index(host, ".", -1))


def host_domain(host: Column, long_suffixes: tuple[str, ...] = LONG_SUFFIXES) -> Column:
    long = F.substring_index(host, ".", -2).isin(*long_suffixes)
    return F.when(long, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else NULL; of two as long, one that blocks."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.verdict != "block", r.text))
    fits = [
        ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path) for r in ordered
    ]
    texts = [F.when(fit, r.text) for fit, r in zip(fits, ordered)]
    verdicts = [F.when(fit, r.verdict) for fit, r in zip(fits, ordered)]
    none = F.lit(None).cast("string")
    return F.coalesce(*texts, none), F.coalesce(*verdicts, none)


def _strength(groups: DataFrame, prior: str) -> float:
    """Pseudo-pages of the beta prior that groups share, by the method of moments.

    The spread of the groups' rates around their prior mean, beyond what sampling explains,
    gives the correlation within groups; its odds against 1 are the strength. Kept within
    1 to 1,000, and 1,000 where no spread is seen.
    """
    n, rate, p = F.col("n"), F.col("bad") / F.col("n"), F.col(prior)
    spread, noise, excess = groups.filter("n > 0").agg(
        F.sum(n * (rate - p) ** 2), F.sum(p * (1 - p)), F.sum(p * (1 - p) * (n - 1))
    ).first()
    if not excess or spread <= noise:
        return 1000.0
    within = min((spread - noise) / excess, 0.5)
    return round(min(max((1 - within) / within, 1.0), 1000.0), 6)


def reputations(outcomes: DataFrame) -> DataFrame:
    """``host, n, bad, alpha, beta``: the posterior of each labelled host's rate of bad pages.

    ``outcomes`` has ``host, bad``, a row per labelled page. The rate of a suffix is shrunk
    towards that of all pages, a domain's towards its suffix's, a host's towards its
    domain's, each by a beta prior whose strength is estimated from the level and is at most what the
    level above knows without the group. Counts
    combine on the map side, so a host with a third of all pages costs each task one row;
    from there on there is a row per host, written once. Four one-row aggregates reach the
    driver.
    """
    hosts = outcomes.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    hosts = cut_lineage(hosts).withColumns({"domain": host_domain(F.col("host")), "suffix": host_suffix(F.col("host"))})

    def level(name: str, above: list[str]) -> DataFrame:
        return hosts.groupBy(name, *above).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    def shrunk(groups: DataFrame) -> DataFrame:
        """``alpha, beta`` of groups with ``n, bad`` and the level above's ``above_alpha, above_beta``.

        What the other groups of the level above say is the prior: the group's own pages are taken out of
        it, so that they are not counted twice. The prior weighs what groups of this level have in common,
        but no more than those pages do, however alike the groups of other domains are.
        """
        groups = groups.withColumns({"pa": F.col("above_alpha") - F.col("bad"), "pb": F.col("above_beta") - (F.col("n") - F.col("bad"))})
        groups = groups.withColumn("prior", F.col("pa") / (F.col("pa") + F.col("pb")))
        weight = F.least(F.lit(_strength(groups, "prior")), F.col("pa") + F.col("pb"))
        return groups.withColumns({
            "alpha": F.col("bad") + weight * F.col("prior"), "beta": F.col("n") - F.col("bad") + weight * (1 - F.col("prior"))
        })

    def above(groups: DataFrame, name: str) -> DataFrame:
        return groups.select(name, F.col("alpha").alias("above_alpha"), F.col("beta").alias("above_beta"))

    pages, bad = (x or 0 for x in hosts.agg(F.sum("n"), F.sum("bad")).first())
    overall = {"above_alpha": F.lit(bad + 1.0), "above_beta": F.lit(pages - bad + 1.0)}
    suffixes = shrunk(level("suffix", []).withColumns(overall))
    domains = shrunk(level("domain", ["suffix"]).join(above(suffixes, "suffix"), "suffix"))
    return shrunk(hosts.join(above(domains, "domain"), "domain")).select("host", "n", "bad", "alpha", "beta")


def surely_bad(alpha: Column, beta: Column, deviations: float, most_bad: float) -> Column:
    """Whether the lower bound of the posterior exceeds ``most_bad``.

    The bound is Wilson's for a rate seen in ``alpha + beta`` pages: around few pages, or rates near 1, the
    spread of the posterior alone would be too sure.
    """
    total, square = alpha + beta, deviations * deviations
    rate = alpha / total
    bound = (rate + square / (2 * total) - deviations * F.sqrt(rate * (1 - rate) / total + square / (4 * total * total))) / (1 + square / total)
    return bound > most_bad


def url_filter(
    pages: DataFrame,
    labels: DataFrame,
    rules: list[Rule],
    deviations: float = DEVIATIONS,
    most_bad: float = MOST_BAD,
    id_column: str = "page_id",
    url_column: str = "url",
    label_id_column: str = "doc_id",
    quality_column: str = "quality",
) -> DataFrame:
    """The pages with ``host, path, rule, verdict``.

    The longest rule that fits decides; else the host's reputation: ``block`` if even the
    lower posterior bound of its rate of bad pages exceeds ``most_bad``, otherwise ``allow``.
    A label belongs to the page of the same id and is bad if its quality is 0; labels without
    quality or page are left out, each of several for a page counts. A NULL url or one
    without ``://`` has empty host and path, fits no rule, and is judged by the host ''.
    Without labels all is allowed. Each row is judged by itself, so repeated rows stay;
    input columns named like an output are replaced.

    Rules are a list the driver holds (tens or hundreds). The pages' urls are joined with the
    labels, then the pages with one row per labelled host; Spark splits hot hosts in that join.
    """
    names = {"page_id": id_column, "url": url_column}
    rows = pack(pages, **names).withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))})
    known = labels.select(column(label_id_column).alias("page_id"), column(quality_column).alias("quality"))
    outcomes = (
        rows.select("page_id", "host")
        .join(known.filter(F.col("quality").isNotNull()), "page_id")
        .select("host", F.when(F.col("quality") == 0, 1).otherwise(0).alias("bad"))
    )
    bad_hosts = reputations(outcomes).filter(surely_bad(F.col("alpha"), F.col("beta"), deviations, most_bad))
    # Hosts that a rule may or may not cover are listed alike; the rule goes first below.
    judged = rows.join(bad_hosts.select("host", F.lit("block").alias("by_host")), "host", "left")
    text, verdict = rule_for(F.col("host"), F.col("path"), rules)
    judged = judged.withColumns({"rule": text, "verdict": F.coalesce(verdict, "by_host", F.lit("allow"))})
    return unpack(judged, pages, names, **{name: F.col(name) for name in ("host", "path", "rule", "verdict")})
