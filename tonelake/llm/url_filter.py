"""URL filters, with built-in expressions only: explicit rules, and a reputation of hosts for all pages that no rule names.

A labelled page is good or bad. The share of bad pages of a host is drawn towards that of its registered domain, that towards its
suffix's, that towards the share of all: at each level a beta-binomial prior, whose weight (in pages) follows from how far children stray from
their parents beyond chance (method of moments). A page is blocked when the lower bound of its host's posterior share passes a threshold, so
hosts of which little is known stay.

Pages are counted by host before anything is shuffled; all levels work on those counts. Three single rows reach the driver.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined_by_key, stored, unused

#: Suffixes of two labels under which names are registered; a parameter, extend it where a fuller list is at hand.
DOUBLE_SUFFIXES = ("ac.jp", "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")
#: A page is blocked if its host's share of bad pages lies above this with a probability of 95 %.
THRESHOLD, DEVIATIONS = 0.5, 1.645
#: A prior counts as at least and at most so many pages.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1000.0
#: The same below a parent of which nothing is known.
FAINT = 0.01
#: Rules become one expression; a longer list is an error.
MOST_RULES = 1000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands after the first ``://``: the host with A-Z in lower case, and the path; both empty without that mark."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), ascii_uppercase, ascii_lowercase), part(2)


def fitting(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule (``host/path``) that fits, and its verdict; nulls without one. A rule fits its host and all subdomains."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    rule = verdict = F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def domain_and_suffix(host: Column, double: tuple[str, ...] = DOUBLE_SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix of a host without user name and port; an address is its own domain and suffix."""
    name = F.regexp_replace(F.regexp_replace(host, "(?s)^.*@", ""), r"(:[0-9]*)?\.*$", "")
    last = lambda k: F.substring_index(name, ".", -k)
    two, address = last(2).isin(*double), name.rlike(r"^[0-9.]*$|^\[")
    return F.when(address, name).when(two, last(3)).otherwise(last(2)), F.when(address, name).when(two, last(2)).otherwise(last(1))


def _weight(children: DataFrame) -> float:
    """Weight of the prior of one level: rows with ``k`` bad of ``m`` labelled pages, and the parent's share ``above``."""
    spread = F.col("above") * (1 - F.col("above"))
    seen = children.where("m > 0").agg(F.sum(F.pow(F.col("k") - F.col("m") * F.col("above"), 2) / F.col("m")).alias("found"), F.sum(spread).alias("chance"), F.sum(spread * (F.col("m") - 1)).alias("more")).first()
    if not seen["more"]:
        return MOST_WEIGHT
    alike = (seen["found"] - seen["chance"]) / seen["more"]
    return min(MOST_WEIGHT, max(LEAST_WEIGHT, 1 / alike - 1 if alike > 0 else MOST_WEIGHT))


def _posterior(children: DataFrame) -> DataFrame:
    """``bad`` and ``good``: pages of each kind in the posterior of rows with ``k``, ``m``, and their parent's share ``above`` and its variance ``doubt``.

    The prior's variance is that among children of one parent plus that of the parent's own share, so below an unknown parent it is wide.
    """
    spread = F.col("above") * (1 - F.col("above"))
    weight = F.greatest(F.lit(FAINT), spread / (spread / (_weight(children) + 1) + F.col("doubt")) - 1)
    return children.withColumn("bad", F.col("k") + weight * F.col("above")).withColumn("good", F.col("m") - F.col("k") + weight * (1 - F.col("above")))


def _as_parents(children: DataFrame, name: str) -> DataFrame:
    """``name, n, above, doubt``: mean and variance of the posteriors, for the next level down."""
    both = F.col("bad") + F.col("good")
    return children.select(name, "n", (F.col("bad") / both).alias("above"), (F.col("bad") * F.col("good") / (both * both * (both + 1))).alias("doubt"))


def reputations(hosts: DataFrame) -> DataFrame:
    """``host, n, k, m, bound`` of ``host, n, k, m`` (pages, bad ones, labelled ones): the lower bound of the share of bad pages."""
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = stored(hosts.withColumnRenamed("n", "pages").withColumn("domain", domain).withColumn("suffix", suffix))
    sums = [F.sum("k").alias("k"), F.sum("m").alias("m"), F.count("*").alias("n")]
    domains = stored(hosts.groupBy("domain", "suffix").agg(*sums))
    suffixes = stored(domains.groupBy("suffix").agg(*sums))
    every = suffixes.agg(F.sum("k").alias("k"), F.sum("m").alias("m"), F.sum("n").alias("n")).first()
    share = ((every["k"] or 0) + 0.5) / ((every["m"] or 0) + 1)
    parents = suffixes.withColumn("above", F.lit(share)).withColumn("doubt", F.lit(share * (1 - share) / ((every["m"] or 0) + 2)))
    parents = _as_parents(_posterior(parents), "suffix")
    below = stored(joined_by_key(domains.withColumnRenamed("n", "hosts"), parents, "suffix", every["n"] or 0))
    parents = _as_parents(_posterior(below.drop("n").withColumnRenamed("hosts", "n")), "domain")
    judged = stored(joined_by_key(hosts, parents, "domain", hosts.count()).drop("n"))
    odds = F.log(F.col("bad") / F.col("good")) - DEVIATIONS * F.sqrt(1 / F.col("bad") + 1 / F.col("good"))
    return _posterior(judged).select("host", F.col("pages").alias("n"), "k", "m", (1 / (1 + F.exp(-odds))).alias("bound"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], bad: Column | None = None, threshold: float = THRESHOLD, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per input row: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``, and its host's ``n_labelled`` and ``n_bad`` pages.

    ``rules``: (``allow`` or ``block``, ``host/path``); the longest that fits decides. ``bad`` (1, 0, null) labels pages; without it those that a
    rule decides are labelled by it. All others are judged by their host's reputation; where nothing is labelled, or a posterior lies at the threshold,
    they are allowed. Null urls, empty ones and those without ``://`` have an empty host and path and are judged as one host without labels. Very long
    urls are read whole. Null ids and repeated rows are rows like any other, and every repetition counts as a page; other columns are not
    carried, so their names cannot clash. An empty table gives no rows.
    """
    host, path = host_and_path(pages[url].cast("string"))
    label = unused("label", [page_id, url])
    rows = pages.select(pages[page_id].alias("page_id"), host.alias("host"), path.alias("path"), (F.lit(None) if bad is None else bad).cast("int").alias(label))
    rule, verdict = fitting(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "verdict": verdict})
    if bad is None:
        rows = rows.withColumn(label, F.when(F.col("verdict") == "block", 1).when(F.col("verdict") == "allow", 0))
    hosts = stored(rows.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.coalesce(label, F.lit(0))).alias("k"), F.count(label).alias("m")))
    known = reputations(hosts)
    found = joined_by_key(rows.drop(label), known, "host", rows.count())
    return found.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("bound") > threshold, "block").otherwise("allow")).alias("verdict"), F.col("m").alias("n_labelled"), F.col("k").alias("n_bad"))
