"""URL filter: rules by host and path first, then a logistic regression on hashed character n-grams.

An address is cut into host (between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A to Z in
lower case) and path (from there to ``?``, ``#`` or the end). A rule names a host and the start of a path;
it fits the host itself and everything below it. Of several the longest decides (ties: the smaller text).

Where no rule fits, the model does. Host and path each give their character n-grams, with marks at both
ends of the host and one at the start of the path, and told apart by a letter in front. Every n-gram is
hashed to one of ``FEATURES`` places, present or not. A ridge logistic regression is fitted on a small
labelled table of addresses, and an address is blocked at a probability of ``THRESHOLD``.

The model reads the label table only, which is small by contract (``MOST_LABELS``; more rows are an error,
not a sample), so driver and tasks hold ``FEATURES`` numbers whatever the number of pages. Judging is one
pass over the pages, without a shuffle.

Null addresses and addresses without ``://`` have an empty host and path; they fit no rule, give the model
nothing to judge, and are allowed, as are all that fit no rule when the label table is empty. A label table with one
label only gives that label. Labelled rows without an address or label do not count; repeated ones count
as often as they occur. Repeated pages each get their row; further columns do not matter.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOST_GRAMS = (3, 4, 5)
PATH_GRAMS = (3, 4)
FEATURES = 1 << 16
RIDGE = 0.0005
ROUNDS = 60
THRESHOLD = 0.5
MOST_LABELS = 10_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @classmethod
    def parse(cls, verdict: str, text: str) -> "Rule":
        host, slash, rest = text.partition("/")
        return cls(verdict, host, slash + rest)

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == F.lit(self.host)) | host.endswith(F.lit("." + self.host))) & path.startswith(F.lit(self.path))


RULES = tuple(Rule.parse(v, t) for v, t in (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def deciding(rules: Sequence[Rule], host: Column, path: Column, value) -> Column:
    """``value`` of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):
        out = F.when(rule.fits(host, path), F.lit(value(rule))).otherwise(out)
    return out


def grams(text: Column, sizes: Sequence[int], name: str) -> Column:
    """All n-grams of ``text``, each behind ``name``."""
    def of(n: int) -> Column:
        cuts = F.transform(F.sequence(F.lit(1), F.length(text) - F.lit(n - 1)), lambda i: F.concat(F.lit(name), F.substr(text, i, F.lit(n))))
        return F.when(F.length(text) >= n, cuts).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(n) for n in sizes])


def url_grams(host: Column, path: Column) -> Column:
    return F.concat(grams(F.concat(F.lit("^"), host, F.lit("$")), HOST_GRAMS, "h"), grams(F.concat(F.lit("^"), path), PATH_GRAMS, "p"))


def _hashed(rows: DataFrame, host: str, path: str, into: str) -> DataFrame:
    hashing = HashingTF(numFeatures=FEATURES, binary=True, inputCol=f"{into}_grams", outputCol=into)
    return hashing.transform(rows.withColumn(f"{into}_grams", url_grams(F.col(host), F.col(path)))).drop(f"{into}_grams")


def fit_urls(labelled: DataFrame, url: str = "url", label: str = "blocked") -> LogisticRegressionModel | bool:
    """A model of the labelled addresses; a plain verdict where there is nothing to tell apart."""
    rows = labelled.where(F.col(label).isNotNull() & F.col(url).isNotNull()).select(
        host_of(F.col(url)).alias("__host"), path_of(F.col(url)).alias("__path"), F.col(label).cast("double").alias("__y")).where(F.col("__host") != "")
    shape = rows.agg(F.count("*").alias("n"), F.min("__y").alias("lo"), F.max("__y").alias("hi")).first()
    if shape["n"] > MOST_LABELS:
        raise ValueError(f"{shape['n']} labelled addresses; this filter learns from {MOST_LABELS} at most")
    if shape["lo"] == shape["hi"]:
        return bool(shape["lo"])
    # One ordered partition: sums run in one order, so reruns agree.
    features = _hashed(rows, "__host", "__path", "__x").repartition(1).sortWithinPartitions("__host", "__path", "__y")
    return LogisticRegression(
        featuresCol="__x", labelCol="__y", predictionCol="__said", rawPredictionCol="__raw", probabilityCol="__p", regParam=RIDGE, standardization=False,
        maxIter=ROUNDS).fit(features)


def filter_urls(
    pages: DataFrame, labelled: DataFrame, rules: Sequence[Rule] = RULES, id: str = "page_id", url: str = "url", threshold: float = THRESHOLD,
) -> DataFrame:
    """(id, host, path, rule, verdict, probability) for every row of ``pages``; probability is null under a rule."""
    model = fit_urls(labelled)
    cut = pages.select(F.col(id).alias("__id"), host_of(F.col(url)).alias("__host"), path_of(F.col(url)).alias("__path"))
    host, path = F.col("__host"), F.col("__path")
    judged = cut.withColumns({
        "__rule": deciding(rules, host, path, lambda r: r.text), "__ruled": deciding(rules, host, path, lambda r: r.verdict)})
    if isinstance(model, bool):
        p = F.lit(float(model))
    else:
        free = F.col("__rule").isNull()  # the others give the model nothing to do
        asked = judged.withColumns({"__h": F.when(free, host).otherwise(""), "__t": F.when(free, path).otherwise("")})
        judged = model.transform(_hashed(asked, "__h", "__t", "__x"))
        p = vector_to_array("__p")[1]
    p = F.when(host == "", F.lit(0.0)).otherwise(p)
    return judged.select(
        F.col("__id").alias(id), host.alias("host"), path.alias("path"), F.col("__rule").alias("rule"),
        F.coalesce("__ruled", F.when(p >= threshold, "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("__rule").isNull(), p).alias("probability"))
