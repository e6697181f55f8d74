"""URL verdicts: host and path rules first, gradient-boosted trees on lexical features beyond them.

Everything here is DataFrame expressions and Spark ML; no Python runs on executors.

Defined results for odd input: a NULL url, or one without `://`, has an empty host and path,
fits no rule and is judged by the trees on its (empty) text; repeated rows are judged alike;
an empty table gives an empty result; further columns of the input are kept out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
AUTHORITY = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
#: words in a host by which the weak labels of `weak_labels` call it unwanted
UNWANTED = (
    "adult", "bet", "bets", "betting", "casino", "cheap", "escort", "farm", "free", "gamble", "loan", "loans",
    "pill", "pills", "poker", "porn", "sex", "slots", "spam", "track", "tracker", "viagra", "win", "xxx")
FEATURES = (
    "url_length", "host_length", "path_length", "host_labels", "host_hyphens", "path_depth", "digit_ratio",
    "host_digit_ratio", "entropy", "host_entropy", "n_params", "n_escapes", "vowel_ratio", "top_suffix_rate",
    "suffix_rate")


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all its subdomains, below a path."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, AUTHORITY, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as its text; NULL if none does."""
    found = [
        F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.lit(r.text))
        for r in sorted(rules, key=lambda r: (-len(r.text), r.text))]
    return F.coalesce(*found, F.lit(None).cast("string"))


def entropy(text: Column) -> Column:
    """Shannon entropy in bits over the characters of a text."""
    n = F.length(text)
    parts = F.transform(
        F.array_distinct(F.split(text, "")),
        lambda c: (n - F.length(F.replace(text, c, F.lit("")))).cast("double") / n)
    return F.when(n > 0, F.aggregate(parts, F.lit(0.0), lambda s, p: F.when(p > 0, s - p * F.log2(p)).otherwise(s))
                  ).otherwise(F.lit(0.0))


def _share(text: Column, pattern: str) -> Column:
    n = F.length(text)
    return F.when(n > 0, (n - F.length(F.regexp_replace(text, pattern, ""))) / n).otherwise(F.lit(0.0))


def lexical(urls: DataFrame) -> DataFrame:
    """`urls` (with column url, no other of these names) plus host, path, suffixes and features."""
    base = urls.withColumns({
        "host": host_of(F.col("url")), "path": path_of(F.col("url")), "whole": F.coalesce("url", F.lit(""))})
    labels = F.split("host", r"\.")
    query = F.regexp_extract("whole", r"(?s)^[^?#]*\?([^#]*)", 1)
    return base.withColumns({
        "top_suffix": F.substring_index("host", ".", -1),
        "suffix": F.substring_index("host", ".", -2),
        "url_length": F.length("whole").cast("double"),
        "host_length": F.length("host").cast("double"),
        "path_length": F.length("path").cast("double"),
        "host_labels": F.size(labels).cast("double"),
        "host_hyphens": (F.length("host") - F.length(F.replace("host", F.lit("-"), F.lit("")))).cast("double"),
        "path_depth": (F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))).cast("double"),
        "digit_ratio": _share(F.col("whole"), "[0-9]+"),
        "host_digit_ratio": _share(F.col("host"), "[0-9]+"),
        "entropy": entropy(F.col("whole")),
        "host_entropy": entropy(F.col("host")),
        "n_params": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "[&;]")).cast("double")),
        "n_escapes": F.regexp_count("whole", F.lit("%[0-9A-Fa-f]{2}")).cast("double"),
        "vowel_ratio": _share(F.col("host"), "[aeiou]+"),
    })


@dataclass
class UrlModel:
    """Fitted trees and the suffix statistics they were fitted with."""

    trees: PipelineModel
    rates: DataFrame
    prior: float


def _with_rates(features: DataFrame, rates: DataFrame, prior: float) -> DataFrame:
    """Add the block rates of the two host suffixes; `rates` has at most two rows per labelled url."""
    def side(kind: str) -> DataFrame:
        return F.broadcast(rates.filter(F.col("kind") == kind).select(
            F.col("key").alias(kind), F.col("rate").alias(kind + "_rate")))

    out = features
    for kind in ("top_suffix", "suffix"):
        out = out.join(side(kind), kind, "left").withColumn(
            kind + "_rate", F.coalesce(kind + "_rate", F.lit(prior)))
    return out


def train(labelled: DataFrame, trees: int = 10, depth: int = 4, smoothing: float = 20.0, seed: int = 7) -> UrlModel | None:
    """Fit on labelled urls (url, label 0/1); NULL labels are left out.

    Fits on a bounded table: pass at most some ten thousand rows (see `weak_labels`).
    None if the labels do not hold both classes: there is nothing to learn then, and
    `judge` allows what no rule decides.
    """
    known = labelled.select("url", F.col("label").cast("double").alias("label")).filter("label is not null")
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    prior = counts.get(1.0, 0) / sum(counts.values())
    plain = lexical(known)
    rates = plain.select(
        "label", F.explode(F.array(
            F.struct(F.lit("top_suffix").alias("kind"), F.col("top_suffix").alias("key")),
            F.struct(F.lit("suffix").alias("kind"), F.col("suffix").alias("key")))).alias("s")
    ).groupBy("s.kind", "s.key").agg(
        ((F.sum("label") + smoothing * prior) / (F.count("*") + smoothing)).alias("rate"))
    rates = known.sparkSession.createDataFrame(rates.collect(), rates.schema)
    stages = [
        VectorAssembler(inputCols=list(FEATURES), outputCol="features"),
        GBTClassifier(labelCol="label", featuresCol="features", maxIter=trees, maxDepth=depth, seed=seed)]
    fitted = Pipeline(stages=stages).fit(_with_rates(plain, rates, prior).select("label", *FEATURES).coalesce(2))
    return UrlModel(fitted, rates, prior)


def weak_labels(urls: DataFrame, bound: int = 20_000, words: tuple[str, ...] = UNWANTED) -> DataFrame:
    """Labelled urls from `urls`: about `bound` different ones at most, chosen by their hash.

    The label is 1 where a part of the host, between dots and hyphens, is one of `words`.
    The fraction is bound / rows, so the expected size never exceeds the bound.
    """
    rows = max(1, urls.count())
    share = min(1.0, bound / rows)
    picked = urls.select("url").filter(
        F.col("url").isNotNull() & (F.pmod(F.xxhash64("url"), F.lit(1_000_000)) < int(share * 1_000_000))).distinct()
    parts = F.split(host_of(F.col("url")), "[.-]")
    return picked.select("url", F.arrays_overlap(parts, F.array(*map(F.lit, words))).cast("int").alias("label"))


def judge(urls: DataFrame, id_column: str, rules: list[Rule], model: UrlModel | None) -> DataFrame:
    """id, host, path, rule, verdict (block or allow) and score (NULL where a rule decided or no model is)."""
    given = urls.select(F.col(id_column).alias("row_id"), "url")
    features = lexical(given).withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    if model is None:
        scored = features.withColumn("p", F.lit(0.0))
    else:
        from pyspark.ml.functions import vector_to_array

        scored = model.trees.transform(_with_rates(features, model.rates, model.prior)).withColumn(
            "p", vector_to_array("probability")[1])
    by_rule = F.lit(None).cast("string")
    for r in rules:
        by_rule = F.when(F.col("rule") == r.text, F.lit(r.verdict)).otherwise(by_rule)
    return scored.select(
        F.col("row_id").alias(id_column), "host", "path", "rule",
        F.coalesce(by_rule, F.when(F.col("p") > 0.5, "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("rule").isNull(), F.col("p")).alias("score"))
