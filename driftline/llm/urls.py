"""URL filter: explicit rules, and for the rest an empirical-Bayes reputation of the host.

Pages under a rule are labelled outcomes (allow: good, block: bad). A host's rate of good
outcomes is shrunk to its registered domain's, that one to its public suffix's, and that
one to the rate of all. The strength of each prior comes from the data: the overdispersion
of the children's counts around their parents (beta-binomial, by moments). A page without
a rule is blocked if even the upper posterior bound of its host's rate is below one half
(mean and standard deviations of the posterior, a normal approximation of its quantile).
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import Scratch

#: Bound on the rate of good pages, standard deviations of the bound, and limits of the intra-class correlation.
LEAST_RATE, DEVIATIONS, RHO_LOW, RHO_HIGH = 0.5, 1.645, 0.01, 0.95
#: Second-level labels under a two-letter suffix that make a suffix of two labels (fixed values).
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for a null url or one without ``://``."""
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, _URL, 1), _UPPER, _LOWER), F.regexp_extract(text, _URL, 2)


def fitting(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.host + r.path), r.host + r.path)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        name = F.when(fits, F.lit(rule.host + rule.path)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def suffix_and_domain(host: Column) -> tuple[Column, Column]:
    """(public suffix, registered domain) of a host without user and port."""
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    labels = F.split(bare, "\\.")
    n = F.size(labels)
    two = (F.length(F.element_at(labels, -1)) == 2) & (n >= 2) & F.get(labels, n - 2).isin(*SECOND_LEVEL)
    own = F.when(two, 2).otherwise(1)
    last = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), k), ".")
    return last(own), last(own + 1)


def reputation(pages: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Posterior ``alpha`` and ``beta`` of the last level's every value, from rows with the levels and ``good`` (1, 0, null).

    One combined aggregation by host; the levels above are sums of it. Each level is one
    small join on the value of the level above.
    """
    keep = list(levels)
    counts = pages.groupBy(*keep).agg(F.count("good").cast("double").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("double").alias("k"))
    counts = Scratch(pages.sparkSession, "urls").write(counts, "counts")  # a row for each host; read once a level
    total = counts.agg(((F.sum("k") + 1) / (F.sum("n") + 2)).alias("m"))
    parent = total
    on: list[str] = []
    for depth in range(1, len(keep) + 1):
        here = keep[:depth]
        child = counts.groupBy(*here).agg(F.sum("n").alias("n"), F.sum("k").alias("k")) if depth < len(keep) else counts
        child = child.join(parent, on) if on else child.crossJoin(F.broadcast(parent))
        v = F.col("m") * (1 - F.col("m"))
        rho = (F.sum((F.col("k") - F.col("n") * F.col("m")) ** 2) - F.sum(F.col("n") * v)) / F.nullif(F.sum(F.col("n") * (F.col("n") - 1) * v), F.lit(0.0))
        strength = child.agg(F.coalesce(F.greatest(F.lit(RHO_LOW), F.least(F.lit(RHO_HIGH), rho)), F.lit(RHO_HIGH)).alias("rho")).select((1 / F.col("rho") - 1).alias("s"))
        post = child.crossJoin(F.broadcast(strength)).select(*here, (F.col("s") * F.col("m") + F.col("k")).alias("alpha"), (F.col("s") * (1 - F.col("m")) + F.col("n") - F.col("k")).alias("beta"))
        parent, on = post.select(*here, (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("m")), here
    return post


def judge(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` (null without one), ``verdict``, and the posterior ``alpha`` and ``beta`` of its host.

    Null urls and such without ``://`` have an empty host and path; they are judged as
    the host that is empty. Repeated rows are outcomes each. Without labelled outcomes
    the prior is one half and nothing is blocked. An empty table gives an empty result.
    """
    host, path = parts(F.col(f"`{url_col}`").cast("string"))
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, said = fitting(rules, F.col("host"), F.col("path"))
    suffix, domain = suffix_and_domain(F.col("host"))
    rows = rows.withColumns({"rule": rule, "said": said, "suffix": suffix, "domain": domain})
    outcomes = rows.withColumn("good", F.when(F.col("said") == "allow", 1).when(F.col("said") == "block", 0))
    of = reputation(outcomes, ["suffix", "domain", "host"]).select("host", "alpha", "beta")
    a, b = F.col("alpha"), F.col("beta")
    high = a / (a + b) + DEVIATIONS * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    verdict = F.coalesce("said", F.when(high < LEAST_RATE, "block").otherwise("allow"))
    return rows.join(of, "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "alpha", "beta")


def sql(rules: Sequence[Rule]) -> str:
    """The same over ``pages`` for another engine."""
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    order = sorted(rules, key=lambda r: (-len(r.host + r.path), r.host + r.path))
    case = lambda value: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{value(r)}'" for r in order) + " END"
    levels, chain, parent = ["suffix", "domain", "host"], "", "p0"
    for depth in range(1, 4):
        here = ", ".join(levels[:depth])
        join = f"JOIN {parent} USING ({', '.join(levels[: depth - 1])})" if depth > 1 else f"CROSS JOIN {parent}"
        chain += f""",
c{depth} AS (SELECT c.*, m FROM (SELECT {here}, sum(n) AS n, sum(k) AS k FROM counts GROUP BY {here}) c {join}),
s{depth} AS (SELECT 1 / coalesce(greatest({RHO_LOW}, least({RHO_HIGH}, (sum((k - n * m) ** 2) - sum(n * m * (1 - m))) / nullif(sum(n * (n - 1) * m * (1 - m)), 0))), {RHO_HIGH}) - 1 AS s FROM c{depth}),
q{depth} AS (SELECT {here}, s * m + k AS a, s * (1 - m) + n - k AS b FROM c{depth}, s{depth}),
p{depth} AS (SELECT {here}, a / (a + b) AS m FROM q{depth})"""
        parent = f"p{depth}"
    return f"""WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{_URL}', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(coalesce(url, ''), '{_URL}', 2) AS path FROM pages),
l AS (SELECT *, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS labels FROM u),
o AS (SELECT *, CASE WHEN length(labels[-1]) = 2 AND len(labels) >= 2 AND labels[-2] IN ({", ".join(f"'{x}'" for x in SECOND_LEVEL)}) THEN 2 ELSE 1 END AS own FROM l),
r AS (SELECT page_id, host, path, {case(lambda r: r.host + r.path)} AS rule, {case(lambda r: r.verdict)} AS said,
  array_to_string(labels[-own:], '.') AS suffix, array_to_string(labels[-(own + 1):], '.') AS domain FROM o),
counts AS (SELECT suffix, domain, host, CAST(count(said) AS DOUBLE) AS n, CAST(count(*) FILTER (said = 'allow') AS DOUBLE) AS k FROM r GROUP BY ALL),
p0 AS (SELECT (sum(k) + 1) / (sum(n) + 2) AS m FROM counts){chain}
SELECT page_id, r.host, path, rule, coalesce(said, CASE WHEN a / (a + b) + {DEVIATIONS} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) < {LEAST_RATE} THEN 'block' ELSE 'allow' END) AS verdict
FROM r JOIN q3 ON r.host = q3.host"""
