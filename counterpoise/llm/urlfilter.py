"""URL filtering: allow and block rules, and logistic regression where no rule fits.

The model reads hashed character n-grams of host and path and is trained from a small labelled
URL table.  Everything runs as DataFrame operations; training uses the linear model that comes
with Spark.

Defined results: a NULL url or one without ``://`` has an empty host and path; it fits no rule
and gets the model's verdict like any other url.  Without labelled rows, or with one label only,
the model answers with that label, by default ``allow``.  Repeated rows are judged one by one.
Input columns named like an added column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterpoise.llm.common import ascii_lower

BUCKETS = 4096
GRAMS = (2, 3, 4)
TRAIN_URLS = 100_000  # bound of the labelled table
THRESHOLD = 0.5
MAX_RULES = 1000  # rules become one expression
ALLOW, BLOCK = "allow", "block"


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class Rule:
    """``text`` is a host and a path, as in ``example.com/en/``."""

    text: str
    verdict: str

    def fits(self, host: Column, path: Column) -> Column:
        name, slash, rest = self.text.partition("/")
        same_host = (host == name) | host.endswith("." + name)
        return same_host & path.startswith(slash + rest)


def with_rules(df: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """Adds host, path, rule and rule_verdict (NULL where no rule fits); the longest rule wins,
    of equally long ones the first by code point."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    rows = df.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    host, path = F.col("host"), F.col("path")
    none = F.lit(None).cast("string")
    rule, verdict = none, none
    for r in sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):
        rule = F.when(r.fits(host, path), F.lit(r.text)).otherwise(rule)
        verdict = F.when(r.fits(host, path), F.lit(r.verdict)).otherwise(verdict)
    return rows.withColumns({"rule": rule, "rule_verdict": verdict})


def _grams(c: Column, mark: str) -> Column:
    s = F.concat(F.lit("^"), c, F.lit("$"))
    size = F.length(s)

    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.concat(F.lit(mark), F.substring(s, i, F.lit(n))))

    return F.concat(*[of(n) for n in GRAMS])


def with_features(df: DataFrame) -> DataFrame:
    """Adds ``grams`` and ``features`` to rows with host and path."""
    grams = F.concat(_grams(F.col("host"), "h:"), _grams(F.col("path"), "p:"))
    hashing = HashingTF(inputCol="grams", outputCol="features", numFeatures=BUCKETS, binary=True)
    return hashing.transform(df.drop("grams", "features").withColumn("grams", grams))


def train(labelled: DataFrame) -> LogisticRegressionModel | float:
    """Model of label 1 = block; a constant score if there is nothing to tell apart."""
    counts = labelled.groupBy("label").count().orderBy("label").collect()
    if sum(r["count"] for r in counts) > TRAIN_URLS:
        raise ValueError(f"more than {TRAIN_URLS} labelled urls")
    if len(counts) < 2:
        return float(counts[0]["label"]) if counts else 0.0
    rows = with_features(labelled).select("features", "label")
    return LogisticRegression(maxIter=50, regParam=0.001).fit(rows)


def with_score(df: DataFrame, model: LogisticRegressionModel | float) -> DataFrame:
    """Adds ``block_score`` (0 to 1) to rows with host and path."""
    df = df.drop("block_score", "rawPrediction", "probability", "prediction")
    if isinstance(model, float):
        return df.withColumn("block_score", F.lit(model))
    scored = model.transform(with_features(df))
    return scored.withColumn("block_score", vector_to_array("probability")[1]).drop(
        "grams", "features", "rawPrediction", "probability", "prediction"
    )


def filter_urls(df: DataFrame, rules: list[Rule], labelled: DataFrame, url: str = "url"):
    """Adds host, path, rule, verdict and block_score; ``labelled`` has url and verdict."""
    ruled = with_rules(df, rules, url)
    verdict = F.col("verdict") == BLOCK
    model = train(
        labelled.filter(F.col("verdict").isin(ALLOW, BLOCK)).select(
            url_host(F.col("url")).alias("host"),
            url_path(F.col("url")).alias("path"),
            verdict.cast("double").alias("label"),
        )
    )
    by_model = F.when(F.col("block_score") >= THRESHOLD, BLOCK).otherwise(ALLOW)
    verdict = F.coalesce(F.col("rule_verdict"), by_model)
    return with_score(ruled, model).withColumn("verdict", verdict).drop("rule_verdict")
