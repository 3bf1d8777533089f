"""URL verdicts: host and path rules first, else gradient-boosted trees on lexical features. DataFrame functions only.

The features are length, depth, digit ratio, entropy, parameter count and two statistics of the host's suffix: how often labelled
URLs that have it are blocked, and their share of all. The trees learn from labelled URLs; the bound of that sample is ``MOST_LABELLED`` of each label.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut

#: Labelled URLs of each verdict that the trees learn from: those with the smallest hashes.
MOST_LABELLED = 10_000
#: Suffixes with statistics of their own: the most frequent in the sample.
MOST_SUFFIXES = 1000
TREES, DEPTH = 20, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["length", "depth", "digits", "entropy", "parameters", "suffix_rate", "suffix_share"]

#: (host and path, verdict) of a rule.
Rule = tuple[str, str]


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, else null: its host is the url's or a parent, its path a start of the url's."""
    out = F.lit(None).cast("string")
    for text, _ in sorted(rules, key=lambda r: len(r[0])):
        at = text.index("/")
        own = F.lit(text[:at])
        fits = ((host == own) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        out = F.when(fits, F.lit(text)).otherwise(out)
    return out


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features of a url by name, but for the suffix's rate; null urls are as empty ones."""
    url = F.coalesce(url, F.lit(""))
    size = F.length(url).cast("double")
    letters = F.split(url, "")
    share = lambda c: (size - F.length(F.replace(url, c))) / size
    entropy = F.aggregate(F.filter(F.array_distinct(letters), lambda c: c != ""), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return {
        "length": size,
        "depth": F.regexp_count(path, F.lit("[^/]+")).cast("double"),
        "digits": F.when(size > 0, F.regexp_count(url, F.lit("[0-9]")) / size).otherwise(0.0),
        "entropy": F.coalesce(entropy, F.lit(0.0)),
        "parameters": F.when(query == "", 0.0).otherwise(F.regexp_count(query, F.lit("&")) + 1.0),
        "suffix": F.substring_index(host, ".", -1),
    }


def _features(urls: DataFrame) -> DataFrame:
    return urls.select("*", *[c.alias(n) for n, c in lexical(F.col("url"), F.col("host"), F.col("path")).items()])


def judge_urls(pages: DataFrame, labelled: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row.

    ``labelled`` has ``url`` and ``blocked`` (0 or 1). With labels of one kind only, that is the method's verdict
    everywhere; without any it is allow. Null urls and urls without ``://`` have an empty host and path, fit no
    rule and are judged by the trees. Repeated rows are judged alike; other columns are not read.
    """
    held = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    held = held.withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))})
    held = held.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))

    known = labelled.select(F.col("url").cast("string").alias("url"), F.col("blocked").cast("double").alias("blocked")).where("url IS NOT NULL AND blocked IN (0, 1)")
    known = known.dropDuplicates(["url"])
    sample = [known.where(F.col("blocked") == y).orderBy(F.xxhash64("url"), "url").limit(MOST_LABELLED) for y in (0, 1)]
    sample = sample[0].unionByName(sample[1]).withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))})
    sample = cut(_features(sample).coalesce(1))  # at most 2 * MOST_LABELLED rows; the trees' many small jobs have a task each
    kinds = {r["blocked"] for r in sample.select("blocked").distinct().collect()}
    by_rule = F.coalesce(*[F.when(F.col("rule") == text, F.lit(verdict)) for text, verdict in rules], F.lit(None).cast("string")) if rules else F.lit(None).cast("string")
    if len(kinds) < 2:
        only = "block" if kinds == {1.0} else "allow"
        return held.select("page_id", "host", "path", "rule", F.coalesce(by_rule, F.lit(only)).alias("verdict"))

    rates = sample.groupBy("suffix").agg(F.sum("blocked").alias("b"), F.count("*").alias("n")).orderBy(F.desc("n"), "suffix").limit(MOST_SUFFIXES)
    prior, n = sample.agg(F.avg("blocked"), F.count("*")).first()
    rates = F.broadcast(cut(rates.select("suffix", ((F.col("b") + 10 * prior) / (F.col("n") + 10)).alias("suffix_rate"), (F.col("n") / n).alias("suffix_share"))))
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="features")

    def ready(df: DataFrame) -> DataFrame:
        return assemble.transform(df.join(rates, "suffix", "left").fillna({"suffix_rate": float(prior), "suffix_share": 0.0}))

    trees = GBTClassifier(labelCol="blocked", featuresCol="features", maxIter=TREES, maxDepth=DEPTH, maxBins=32, seed=1, stepSize=0.3)
    model = trees.fit(ready(sample).select("features", "blocked"))
    judged = model.transform(ready(_features(held)))
    verdict = F.coalesce(by_rule, F.when(F.col("prediction") == 1, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
