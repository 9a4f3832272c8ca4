"""Language identification of web pages by Bayesian evidence fusion.

Evidence per language, as log probabilities that add up: how likely the visible text is under a byte
trigram model, how often pages of the language declare the markup language that the page declares, how
often their host ends in its address suffix, and a prior of the host.

Every language that a document with a text has is one that can be answered. The trigram model is fitted on
a bounded sample of each, and mixed with what all have in common, so a language with few documents does not
take the pages that no model knows. All other tables come
from grouped sums over all pages of what the text alone says (soft counts): declared languages and
suffixes with additive smoothing, hosts smoothed towards their domain, domains towards the whole. A page's
own share is taken out of its host's and domain's sums, so it is not its own evidence. Sums per host are
partial aggregates; only these small rows meet the pages again, in a join that may be split, so a host
with a third of all pages is no bottleneck. The page's markup itself is read once and never shuffled.

Trigrams of a text depend on each other, so its log likelihood counts as that of ``TEXT_WORTH`` trigrams
at most. Null and empty pages have no text: prior, suffix and declaration decide. A missing or unknown
declaration and a missing address are values like others. Repeated rows each get their own result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.llm.common import stored

SAMPLE_ROWS = 2000
BUCKETS = 1 << 14
TEXT_WORTH = 40
SMOOTH = 1.0
HOST_WORTH = 20.0
DOMAIN_WORTH = 20.0
#: Share of all languages' trigrams together in the model of each.
COMMON = 0.05
#: Width of the range of id hashes that the sample is taken from, against the width that holds it on average.
MARGIN = 2.0
_FLOOR = -30.0

_DROP = re.compile(r"<!--.*?-->|<(script|style|nav|head)\b.*?</\1\s*>", re.S | re.I)
_TAG = re.compile(r"<[^>]*>|&#?\w+;")


def visible(html: str) -> str:
    """Text outside tags, scripts, styles, navigation and the head; the whole text if there is no markup."""
    return _TAG.sub(" ", _DROP.sub(" ", html)) if "<" in html else html


def trigrams(text: str) -> np.ndarray:
    """Bucket of every three bytes; white space and digits count as one blank."""
    raw = re.sub(rb"[\s\d]+", b" ", text.lower().encode("utf-8", "replace"))
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, dtype=np.int64)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 14)).astype(np.int64)


def fit_text_model(docs: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages by name, and log probabilities (language, bucket); from the ``sample_rows`` of each language with the smallest id hashes."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(id).alias("h"), F.col(id).alias("id"))
    # One row per language. Few rows of a language are below its limit on hashes, so the window sees a bounded number.
    sizes = known.groupBy("lang").agg(F.count("*").alias("size"), F.min("h").alias("least"))
    limits = F.broadcast(sizes.select("lang", "least", F.when(
        F.col("size") > MARGIN * sample_rows, F.lit(-2.0 ** 63) + F.lit(2.0 ** 64 * MARGIN * sample_rows) / F.col("size")).alias("limit")))
    near = known.select("lang", "h", "id").join(limits, "lang").where(
        F.col("limit").isNull() | (F.col("h") < F.col("limit")) | (F.col("h") == F.col("least"))).select("lang", "h", "id").distinct()
    picked = near.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))).where(F.col("n") <= sample_rows).drop("n")
    fields = T.StructType([T.StructField("lang", T.StringType()), T.StructField("counts", T.BinaryType())])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, x in zip(batch["lang"], batch["text"]):
                found = np.bincount(trigrams(x), minlength=BUCKETS).astype(np.float64)
                sums[name] = sums[name] + found if name in sums else found
        yield pd.DataFrame([(k, v.tobytes()) for k, v in sums.items()], columns=["lang", "counts"])

    # At most sample_rows ids of each language: a proven bound for the broadcast. The sample's texts meet in a few partitions,
    # so a few tables of counts come back, whatever number of files the documents lie in.
    counted = known.join(F.broadcast(picked), ["lang", "h", "id"]).select("lang", "text").repartition(8).mapInPandas(count, fields).toPandas()
    names = sorted(counted["lang"].unique())
    table = np.zeros((len(names), BUCKETS))
    for name, raw in zip(counted["lang"], counted["counts"]):
        table[names.index(name)] += np.frombuffer(raw)
    common = table.sum(axis=0) + 0.1
    common /= common.sum()
    own = table.sum(axis=1, keepdims=True)
    share = np.where(own > 0, table / np.maximum(own, 1.0), common)
    return names, np.log((1 - COMMON) * share + COMMON * common)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9a-f:.]+\]|[^/?#:\[\]]*)", 1)
    return F.regexp_replace(host, r"\.+$", "")


def declared_of(html: Column) -> Column:
    """The first part of the lang attribute of <html>, in lower case; empty where there is none."""
    found = F.regexp_extract(F.coalesce(html, F.lit("")), r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", 1)
    return F.lower(found)


def _shares(logs: Column) -> Column:
    """Log values to probabilities."""
    top = F.array_max(logs)
    e = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def _sums(n: int, column: str) -> list[Column]:
    return [F.sum(F.get(column, F.lit(i))).alias(f"s{i}") for i in range(n)]


def _packed(n: int) -> Column:
    return F.array(*[F.col(f"s{i}") for i in range(n)])


def identify_languages(
    pages: DataFrame, docs: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", sample_rows: int = SAMPLE_ROWS, text_worth: int = TEXT_WORTH,
) -> DataFrame:
    """(id, lang, confidence, text_lang, declared, host) for every row of ``pages``."""
    names, model = fit_text_model(docs, sample_rows=sample_rows)
    n = len(names)
    if not n:
        return pages.select(F.col(id), F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"),
                            F.lit(None).cast("string").alias("text_lang"), declared_of(F.col(html)).alias("declared"), host_of(F.col(url)).alias("host"))

    @F.pandas_udf("array<double>")
    def likelihood(column: pd.Series) -> pd.Series:
        out = []
        for x in column:
            found = trigrams(visible(x)) if x else np.empty(0, dtype=np.int64)
            logs = model[:, found].sum(axis=1) * min(1.0, text_worth / len(found)) if len(found) else np.zeros(n)
            out.append(np.maximum(logs - logs.max(), _FLOOR))
        return pd.Series(out, dtype=object)

    host = host_of(F.col(url))
    seen = stored(pages.select(
        F.col(id).alias("id"), host.alias("host"), F.element_at(F.split(host, r"\."), -1).alias("suffix"),
        F.array_join(F.slice(F.split(host, r"\."), F.greatest(F.size(F.split(host, r"\.")) - 1, F.lit(1)), F.lit(2)), ".").alias("domain"),
        declared_of(F.col(html)).alias("declared"), likelihood(F.col(html)).alias("text")))
    soft = seen.withColumn("p", _shares(F.col("text")))

    # One row per value: hosts first, domains and suffixes from hosts.
    hosts = stored(soft.groupBy("host", "domain", "suffix").agg(*_sums(n, "p")))
    total = hosts.agg(*[F.coalesce(F.sum(f"s{i}"), F.lit(0.0)) for i in range(n)]).first()
    weight = [float(x) for x in total]
    whole = sum(weight)
    base = [(w + SMOOTH) / (whole + SMOOTH * n) for w in weight]
    domains = hosts.groupBy("domain").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(n)]).select("domain", _packed(n).alias("domain_sums"))
    both = hosts.select("host", "domain", "suffix", _packed(n).alias("host_sums")).join(domains, "domain")

    def given(column: str) -> DataFrame:
        """log P(value | language) per value of ``column``, with additive smoothing."""
        sums = soft.groupBy(column).agg(*_sums(n, "p")) if column == "declared" else hosts.groupBy(column).agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(n)])
        values = sums.count()
        logs = F.array(*[F.log((F.col(f"s{i}") + F.lit(SMOOTH)) / F.lit(weight[i] + SMOOTH * (values + 1))) for i in range(n)])
        return sums.select(column, logs.alias(f"{column}_given"))

    def others(sums: str) -> Column:
        return F.zip_with(sums, "p", lambda s, p: F.greatest(s - p, F.lit(0.0)))

    def towards(sums: Column, prior: Column, worth: float) -> Column:
        size = F.aggregate(sums, F.lit(0.0), lambda s, x: s + x)
        return F.zip_with(sums, prior, lambda s, p: (s + F.lit(worth) * p) / (size + F.lit(worth)))

    placed = soft.join(both.drop("domain", "suffix"), "host").join(given("suffix"), "suffix").join(given("declared"), "declared")
    placed = placed.withColumn("domain_prior", towards(others("domain_sums"), F.array(*[F.lit(b) for b in base]), DOMAIN_WORTH))
    placed = placed.withColumn("host_prior", towards(others("host_sums"), F.col("domain_prior"), HOST_WORTH))
    parts = F.transform(
        F.arrays_zip("text", "host_prior", "suffix_given", "declared_given"),
        lambda z: z["text"] + F.log(F.greatest(z["host_prior"], F.lit(1e-12))) + z["suffix_given"] + z["declared_given"])
    fused = placed.withColumn("logs", parts).withColumn("shares", _shares(F.col("logs")))
    labels = F.array(*[F.lit(x) for x in names])
    best = F.array_max("shares")
    return fused.select(
        F.col("id").alias(id), F.element_at(labels, F.array_position("shares", best).cast("int")).alias("lang"), F.round(best, 6).alias("confidence"),
        F.element_at(labels, F.array_position("p", F.array_max("p")).cast("int")).alias("text_lang"), "declared", "host")
