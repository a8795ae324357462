"""URL filter: rules first, gradient-boosted trees on lexical features for the rest, in DataFrame operations only.

URLs on which a rule decides are the labelled ones. Trees are fitted on a bounded sample of them; the statistics of
host suffixes are counted over all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermaline.staging import stage

# Verdict, host and path of the rules.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: The trees are fitted on at most so many distinct labelled URLs, drawn by hash.
LABELLED = 20_000
PRIOR_ROWS = 20.0
FEATURES = (
    "url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "hyphens", "entropy",
    "parameters", "fragment", "suffix_rate", "domain_rate",
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds host and path; both empty for a null URL or one without '://'."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.col("url").substr(at + 3, F.length("url"))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return pages.withColumn(
        "host", F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    ).withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def with_rule(pages: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Adds rule and ruled (its verdict): of the rules that fit, the longest; else null."""
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}"))) & F.startswith(
            F.col("path"), F.lit(path)
        )
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        ruled = F.when(fits, F.lit(verdict)).otherwise(ruled)
    return pages.withColumn("rule", rule).withColumn("ruled", ruled)


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def with_lexical_features(pages: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url"), F.lit(""))
    size = F.greatest(F.length(url), F.lit(1))
    parts = F.array_distinct(F.split(url, ""))
    entropy = F.aggregate(
        parts,
        F.lit(0.0),
        lambda total, c: F.when(c == "", total).otherwise(
            total
            - ((F.length(url) - F.length(F.replace(url, c, F.lit("")))) / size)
            * F.log2((F.length(url) - F.length(F.replace(url, c, F.lit("")))) / size)
        ),
    )
    return pages.select(
        "*",
        F.length(url).cast("double").alias("url_length"),
        F.length("host").cast("double").alias("host_length"),
        F.length("path").cast("double").alias("path_length"),
        _count(F.col("path"), "/").cast("double").alias("depth"),
        (_count(F.col("host"), ".") + 1).cast("double").alias("labels"),
        (_count(url, "0123456789") / size).alias("digit_ratio"),
        _count(F.col("host"), "-").cast("double").alias("hyphens"),
        entropy.alias("entropy"),
        _count(url, "=&").cast("double").alias("parameters"),
        _count(url, "#").cast("double").alias("fragment"),
        F.substring_index("host", ".", -1).alias("suffix"),
        F.substring_index("host", ".", -2).alias("domain"),
    )


def with_suffix_rates(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """Adds the smoothed share of blocked URLs among the labelled ones of the same suffix and domain.

    The statistics have a row per suffix, combined before the shuffle; a very common suffix costs its rows only the
    join that adaptive execution splits, or none where the statistics are small enough to be sent along.
    """
    base = labelled.agg(F.avg("label")).first()[0] or 0.0
    for key, name in (("suffix", "suffix_rate"), ("domain", "domain_rate")):
        rates = stage(
            labelled.groupBy(key).agg(
                ((F.sum("label") + PRIOR_ROWS * base) / (F.count("*") + PRIOR_ROWS)).alias(name)
            ),
            name,
        )
        pages = pages.join(rates, key, "left").withColumn(name, F.coalesce(name, F.lit(float(base))))
    return pages


def filtered_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, seed: int = 5) -> DataFrame:
    """Pages (page_id, url, ...) to page_id, host, path, rule, verdict, block_probability.

    ``verdict`` is the rule's where one fits, else the trees'; the probability is the trees' own and null where a rule
    decides. Null and empty URLs, and URLs without '://', have an empty host and path and are judged by the trees.
    A URL counts once for the trees, however many copies it has. Without drawn URLs of both verdicts the more frequent one holds for all (allow, if there is none). Repeated
    rows and null ids stay as they are; other columns are ignored. An empty table gives no rows.
    """
    judged = with_lexical_features(with_rule(with_parts(pages.select("page_id", "url")), rules))
    judged = stage(
        judged.withColumn("label", F.when(F.col("ruled").isNotNull(), (F.col("ruled") == "block").cast("double"))),
        "urls",
    )
    labelled = judged.where("label is not null")
    blocked, known = labelled.agg(F.sum("label"), F.count("*")).first()
    blocked = blocked or 0.0
    judged = with_suffix_rates(judged, labelled)
    sample = stage(
        judged.where("label is not null")
        .select("url", "label", *FEATURES)
        .distinct()
        .orderBy(F.xxhash64(F.lit(seed), "url"), "url")
        .limit(LABELLED),
        "sample",
    )
    if sample.select("label").distinct().count() < 2:
        judged = judged.withColumn("prediction", F.lit(1.0 if 2 * blocked > known else 0.0)).withColumn(
            "block_probability", F.col("prediction")
        )
    else:
        assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        trees = GBTClassifier(maxIter=15, maxDepth=4, maxBins=32, subsamplingRate=1.0, seed=seed).fit(
            assembler.transform(sample).select("features", "label")
        )
        judged = trees.transform(assembler.transform(judged)).withColumn(
            "block_probability", F.element_at(vector_to_array("probability"), 2)
        )
    method = F.when(F.col("prediction") == 1.0, "block").otherwise("allow")
    return judged.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("ruled", method).alias("verdict"),
        F.when(F.col("ruled").isNull(), F.col("block_probability")).alias("block_probability"),
    )

