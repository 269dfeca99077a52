"""URL filters in DataFrame functions only: rules, then boosted trees on lexical features.

A rule fits its host and all subdomains if the path starts with the rule's; the
longest rule wins. URLs that no rule fits are judged by gradient-boosted trees.
Labelled URLs are those that a rule fits, those whose host holds a seed word
(blocked), and the rest, which count as allowed. The trees are fitted on a bounded
sample of them; features and the walk through the trees are Spark expressions.
Hosts whose checksum divides by five are held out of the fit: held_out() says how
the trees do on hosts that they have not seen.

Nulls, empties, repeats: a null url, or one without ``://``, has an empty host
and path, fits no rule and is judged by the trees; a null page_id is kept;
repeated rows are judged one by one; a very long url is judged whole; of rules as
long as each other the first wins; without labelled URLs of both kinds the trees
are a constant; an empty table gives no rows; other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftspark.llm import gbt
from shiftspark.llm.common import hash_sample, table

#: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Words that mark a host as unwanted when URLs are labelled.
SEED_WORDS = ["casino", "bets", "poker", "jackpot", "pills", "loans", "spam", "ads-"]
SAMPLE_ROWS = 20_000
#: Suffixes of one label and of two, and first parts of paths, that get statistics of their own: the most frequent of the sample.
SUFFIXES = 100
STATISTICS = ["suffix", "domain", "segment"]
THRESHOLD = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path."""
    url = F.coalesce(F.col("url"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    split = pages.select("page_id", url.alias("url"), rest.alias("rest")).withColumn("raw_host", F.regexp_extract("rest", r"^[^/?#]*", 0))
    path = F.regexp_extract(F.substring(F.col("rest"), F.length("raw_host") + 1, F.length("rest")), r"^[^?#]*", 0)
    return split.select("page_id", "url", F.translate("raw_host", _UPPER, _LOWER).alias("host"), path.alias("path"))


def rule_column(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict), null where none fits; the first of the longest wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later, longer ones override
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _entropy(c: Column) -> Column:
    """Bits a character, from the counts of its distinct characters."""
    n = F.greatest(F.length(c), F.lit(1))
    each = lambda acc, x: acc - (F.length(c) - F.length(F.replace(c, x))) / n * F.log2((F.length(c) - F.length(F.replace(c, x))) / n)
    return F.aggregate(F.array_distinct(F.array_remove(F.split(c, ""), "")), F.lit(0.0), each)


def features(split: DataFrame) -> DataFrame:
    """Lexical features of parts(), beside its columns."""
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    size = lambda c: F.length(c).cast("double")
    without = lambda c, p: size(c) - size(F.regexp_replace(c, p, ""))
    query = F.substring_index(F.substring(url, F.instr(url, "?"), F.length(url)), "#", 1)
    labels = F.split(host, r"\.")
    return split.select(
        "*",
        F.element_at(labels, -1).alias("suffix"), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".").alias("domain"),
        F.translate(F.regexp_extract(path, r"^/([^/]*)", 1), _UPPER, _LOWER).alias("segment"),
        size(url).alias("f_length"), size(host).alias("f_host_length"), size(path).alias("f_path_length"),
        without(path, "/").alias("f_depth"), F.size(labels).cast("double").alias("f_labels"),
        (without(url, "[0-9]") / F.greatest(size(url), F.lit(1.0))).alias("f_digit_ratio"),
        (without(host, "[0-9]") / F.greatest(size(host), F.lit(1.0))).alias("f_host_digit_ratio"),
        without(host, "-").alias("f_host_dashes"),
        F.when(url.contains("?"), without(query, "&") + 1.0).otherwise(0.0).alias("f_parameters"),
        _entropy(url).alias("f_entropy"), _entropy(host).alias("f_host_entropy"),
        F.startswith(url, F.lit("https://")).cast("double").alias("f_https"),
        F.array_max(F.transform(labels, lambda x: F.length(x))).cast("double").alias("f_longest_label"),
        F.coalesce(size(F.regexp_extract(path, r"^/([a-z]{2})/", 1)), F.lit(0.0)).alias("f_language"),
    )


NAMES = [
    "f_length", "f_host_length", "f_path_length", "f_depth", "f_labels", "f_digit_ratio", "f_host_digit_ratio", "f_host_dashes", "f_parameters",
    "f_entropy", "f_host_entropy", "f_https", "f_longest_label", "f_language", *[f"f_{s}_{kind}" for s in STATISTICS for kind in ("rate", "seen")],
]


class UrlModel:
    """Suffix statistics and trees, as joins with tables of at most SUFFIXES rows and Spark expressions."""

    def __init__(self, trees: gbt.Trees, rates: dict[str, dict[str, tuple[float, float]]], prior: float):
        self.trees, self.rates, self.prior = trees, rates, prior

    def score(self, split: DataFrame) -> DataFrame:
        """split with ``score``: how likely a URL is one to block."""
        full = features(split)
        for name, own in self.rates.items():
            rows = [F.struct(F.lit(k).cast("string").alias(name), F.lit(r).alias(f"f_{name}_rate"), F.lit(n).alias(f"f_{name}_seen")) for k, (r, n) in {None: (self.prior, 0.0), **own}.items()]
            known = split.sparkSession.range(1).select(F.inline(F.array(*rows)))
            full = full.join(F.broadcast(known), name, "left").fillna({f"f_{name}_rate": self.prior, f"f_{name}_seen": 0.0})
        return full.withColumn("score", 1 / (1 + F.exp(-F.expr(self.trees.sql(NAMES))))).select(*split.columns, "score")


def _label(rules: list[tuple[str, str, str]], seeds: list[str]) -> Column:
    seeded = F.lit(False)
    for word in seeds:
        seeded = seeded | F.contains("host", F.lit(word))
    return F.coalesce(rule_column(rules)[1], F.when(seeded, "block").otherwise("allow"))


def _held_out() -> Column:
    return F.crc32("host") % 5 == 0


def fit(split: DataFrame, rules: list[tuple[str, str, str]] = RULES, seeds: list[str] = SEED_WORDS, rows: int = SAMPLE_ROWS) -> UrlModel:
    marked = hash_sample(split.where(~_held_out()).withColumn("label", _label(rules, seeds)), rows, "url", "page_id")
    got = features(marked).toPandas()  # at most ``rows`` rows
    y = (got["label"] == "block").to_numpy(float)
    prior = float((y.sum() + 0.5) / (len(y) + 1))
    rates = {}
    for name in STATISTICS:
        seen = got.assign(y=y).groupby(name)["y"].agg(["sum", "count"]).sort_values(["count", "sum"], ascending=False).head(SUFFIXES)
        own = rates[name] = {k: (float((r["sum"] + 5 * prior) / (r["count"] + 5)), float(np.log1p(r["count"]))) for k, r in seen.iterrows()}
        for i, kind in enumerate(("rate", "seen")):
            got[f"f_{name}_{kind}"] = got[name].map(lambda s: own.get(s, (prior, 0.0))[i]).astype(float)
    return UrlModel(gbt.fit(got[NAMES].to_numpy(float).reshape(-1, len(NAMES)), y, trees=25, depth=3, rate=0.3), rates, prior)


def held_out(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, seeds: list[str] = SEED_WORDS) -> DataFrame:
    """ruled, label, verdict (of the trees alone), n: the labelled URLs of hosts that the fit leaves out."""
    split = parts(pages)
    scored = fit(split, rules, seeds).score(split.where(_held_out()))
    verdict = F.when(F.col("score") >= THRESHOLD, "block").otherwise("allow")
    return scored.groupBy(rule_column(rules)[0].isNotNull().alias("ruled"), _label(rules, seeds).alias("label"), verdict.alias("verdict")).agg(F.count("*").alias("n"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, model: UrlModel | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row of pages."""
    split = parts(pages)
    model = model or fit(split, rules)
    rule, verdict = rule_column(rules)
    scored = model.score(split).withColumn("rule", rule)
    return scored.select("page_id", "host", "path", "rule", F.coalesce(verdict, F.when(F.col("score") >= THRESHOLD, "block").otherwise("allow")).alias("verdict"), "score")


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
