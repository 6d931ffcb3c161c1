"""URL filter: host and path rules, then empirical-Bayes host reputation.

A rule decides the pages of its host and subdomains whose path starts with the rule's path;
the longest rule wins. All other pages are judged by their host's reputation: the rate of
bad pages among the host's labelled pages is shrunk through beta-binomial priors, from the
suffix to the registered domain to the host. Each level's prior has its parent's posterior
mean, and a strength that the overdispersion of the level's counts gives (method of
moments). A host is blocked if the `risk`-quantile of its posterior, a Beta distribution,
exceeds the rate at which the odds of a bad page are `lift` times those of all labelled pages:
then it is worse than that with a probability of 1 - risk. So hosts that are as the corpus is
stay, however bad the corpus, and a few bad pages of a host are no proof.

Rules and reputations are joined by host, after everything has been summed by host; a host
with many pages costs one row on the other side of the join, which is broadcast up to
_BROADCAST_HOSTS hosts (some 20 MB) and shuffled beyond.

Defined results: a null url, or one without ://, has an empty host and path and the
reputation of the host ""; an empty path starts with no rule; rules of equal length: the
longer host, then block; hosts without labelled pages have their domain's reputation; with
no labelled page at all everything without a rule is allowed; repeated rows give a result
each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.llm.common import bounded, materialize, table
from changelens.llm.html_extract import extract, host_of

RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
# Suffixes of two labels under which domains are registered; any other suffix is one label.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.uk", "com.au", "com.br", "com.cn", "gov.uk", "org.uk")

_BROADCAST_HOSTS = 200_000


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.lit(2147483647))
    return F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and every host above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def with_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (page_id, host, path) and the rule that decides them: rule, rule_verdict.

    rules: rule (host/path), verdict.
    """
    cut = F.instr("rule", "/")
    parts = rules.select(
        F.substring("rule", F.lit(1), cut - 1).alias("of"),
        F.struct(
            F.length("rule").alias("length"),
            (cut - 1).alias("host_length"),
            F.when(F.col("verdict") == "block", 1).otherwise(0).alias("blocks"),
            F.substring("rule", cut, F.lit(2147483647)).alias("path"),
            "rule",
            "verdict",
        ).alias("r"),
    ).distinct()
    hosts = pages.select("host").distinct().select("host", F.explode(suffixes(F.col("host"))).alias("of"))
    fitting = bounded(hosts.join(parts, "of").groupBy("host").agg(F.collect_list("r").alias("rules")), _BROADCAST_HOSTS)
    best = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])))
    return pages.join(fitting, "host", "left").withColumn("best", best).drop("rules").withColumn("rule", F.col("best.rule")).withColumn("rule_verdict", F.col("best.verdict")).drop("best")


def _shrunk(children: DataFrame, name: str) -> DataFrame:
    """children (n, k, up: the parent's mean) with the posterior mean of each."""
    spread = F.col("up") * (1 - F.col("up"))
    s = children.agg(
        F.sum((F.col("k") - F.col("n") * F.col("up")) ** 2).alias("s"),
        F.sum(F.col("n") * spread).alias("a"),
        F.sum(F.col("n") * (F.col("n") - 1) * spread).alias("b"),
    ).first()
    rho = (s["s"] - s["a"]) / s["b"] if s["b"] else 0.0
    strength = 1 / min(0.5, max(1e-3, rho)) - 1
    return children.withColumn(f"{name}_strength", F.lit(strength)).withColumn(f"{name}_mean", (F.col("k") + strength * F.col("up")) / (F.col("n") + strength))


def beta_quantiles(a: np.ndarray, b: np.ndarray, q: float, points: int = 2001) -> np.ndarray:
    """The q-quantile of each Beta(a, b), on a grid of the log-odds, where the density has one
    peak and tails that fall exponentially."""
    out = np.empty(len(a))
    for at in range(0, len(a), 500):
        x, y = (v[at : at + 500, None].astype(np.float64) for v in (a, b))
        peak, wide = np.log(x / y), 10 * np.sqrt(1 / x + 1 / y)
        t = peak + np.linspace(-1, 1, points) * np.maximum(wide, 20 / np.minimum(x, y))
        logs = -x * np.logaddexp(0, -t) - y * np.logaddexp(0, t)
        below = np.cumsum(np.exp(logs - logs.max(axis=1, keepdims=True)), axis=1)
        below /= below[:, -1:]
        i = np.minimum((below < q).sum(axis=1), points - 1)
        out[at : at + 500] = 1 / (1 + np.exp(-t[np.arange(len(i)), i]))
    return out


def reputations(outcomes: DataFrame, risk: float = 0.05) -> DataFrame:
    """outcomes (host, bad: 0, 1 or null if the page has no label) -> host, n, k, bad_rate,
    bad_low (the risk-quantile) of every host, and base_rate (of all labelled pages)."""

    @F.pandas_udf("double")
    def quantile(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(beta_quantiles(a.to_numpy(), b.to_numpy(), risk))

    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    labels = F.split("host", r"\.")
    last_two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".")
    wide = last_two.isin(*TWO_LABEL_SUFFIXES)
    kept = F.when(wide, 3).otherwise(2)
    hosts = materialize(
        hosts.withColumn("suffix", F.when(wide, last_two).otherwise(F.element_at(labels, -1))).withColumn(
            "domain", F.array_join(F.slice(labels, F.greatest(F.size(labels) - kept + 1, F.lit(1)), kept), ".")
        )
    )
    domains = materialize(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    tops = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    n, k = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()
    tops = materialize(_shrunk(tops.withColumn("up", F.lit((k + 0.5) / (n + 1.0))), "suffix").select("suffix", "suffix_mean"))
    domains = materialize(_shrunk(domains.join(tops, "suffix").withColumn("up", F.col("suffix_mean")), "domain").select("domain", "domain_mean"))
    hosts = _shrunk(hosts.join(domains, "domain").withColumn("up", F.col("domain_mean")), "host")
    size, rate = F.col("n") + F.col("host_strength"), F.col("host_mean")
    return hosts.select("host", "n", "k", rate.alias("bad_rate"), quantile(rate * size, (1 - rate) * size).alias("bad_low"), F.lit((k + 0.5) / (n + 1.0)).alias("base_rate"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: DataFrame, lift: float = 2.0, risk: float = 0.05) -> DataFrame:
    """pages (page_id, url), outcomes (host, bad) -> page_id, host, path, rule, verdict,
    bad_rate, bad_low."""
    parts = pages.select("page_id", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"))
    known = materialize(reputations(outcomes, risk))
    judged = with_rules(parts, rules).join(bounded(known, _BROADCAST_HOSTS), "host", "left")
    base = F.col("base_rate")
    by_host = F.when(F.col("bad_low") > lift * base / (1 - base + lift * base), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", by_host).alias("verdict"), "bad_rate", "bad_low")


def page_outcomes(pages: DataFrame, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad) of every page: bad is 1 if the page's article is a document labelled of
    low quality or toxic, 0 if it is labelled otherwise, null without a label.

    Texts are matched by a digest of their words, one row per distinct text on the side of
    the documents.
    """
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    labelled = labels.where("quality IS NOT NULL OR toxic IS NOT NULL").select("doc_id", bad.alias("bad")).groupBy("doc_id").agg(F.max("bad").alias("bad"))
    words = F.trim(F.regexp_replace("text", r"(?U)\s+", " "))
    known = (
        docs.where("text IS NOT NULL")
        .select("doc_id", F.sha1(words.cast("binary")).alias("body_sha1"))
        .join(labelled, "doc_id")
        .groupBy("body_sha1")
        .agg(F.max("bad").alias("bad"))
    )
    found = extract(pages).select(F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), "body_sha1")
    return materialize(found).join(materialize(known), "body_sha1", "left").select("host", "bad")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the verdict on every page's url."""
    pages = table(spark, sf_dir, "pages")
    outcomes = page_outcomes(pages, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    rules = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for r, v in RULES])).alias("x")).select("x.*")
    return judge(pages.select("page_id", "url"), outcomes, rules)
