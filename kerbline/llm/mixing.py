"""Mixing sources to target weights by systematic sampling.

Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating, and share all words by weight;
a target stops at ``CAP`` times its source's size, and the excess is shared again by weight among the
others, until none is above. Each round is one aggregation over the sources.

Copies: within a source every document expects target / size copies. Documents stand in order of size
(then a hash of the id), expected copies are summed along that order, one random offset per source is
added, and a document is taken once for each whole number its stretch crosses. Lying next to documents of
its own size, whatever one document loses another one gains, so the words taken stay within about one
large document of the target; and a stretch of at most ``CAP`` crosses at most ``CAP`` whole numbers.
Expected copies are counted in whole parts of 2**-24, so sums along a source are exact.

A source may hold any share of all rows: the order is cut by range into even partitions, documents are
numbered inside a partition, and small counts per (source, partition) carry the numbers on.

Null texts have size 0. Repeated rows are rows of their own. A source of size 0 has target 0 and its
documents are not taken. The offset is a hash of the source and the seed: reruns agree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.common import WORD, fresh, stored, whole
from kerbline.session import cut_lineage

WEIGHTS = (1, 2, 3)
CAP = 3
PARTS = 1 << 24
SEED = 20


def word_count(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def numbered_by_range(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows sorted by range, with ``__part`` and ``__at``, the place inside the part; written once."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    return stored(placed.select(
        *df.columns, F.shiftrightunsigned("__id", 33).alias("__part"), F.col("__id").bitwiseAND((1 << 33) - 1).alias("__at")))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(__s, __none, source_size, target, __w) from one row per source, (__s, __none, source_size)."""
    numbered = numbered_by_range(sizes, [F.col("__none"), F.col("__s")])
    firsts = numbered.groupBy("__part").agg(F.count("*").alias("__n"))
    before = firsts.withColumn("__before", F.coalesce(
        F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    number = F.col("__before") + F.col("__at")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (number % len(weights) + 1).cast("int"))
    weighed = cut_lineage(numbered.join(before, "__part").select("__s", "__none", "source_size", weight.cast("long").alias("__w")))

    big = lambda c: F.col(c).cast("decimal(38,0)")
    total = weighed.agg(F.sum(big("source_size")).alias("t")).first()["t"] or 0
    # A source is capped when cap * size * (weight of the rest) < (words left for the rest) * its weight.
    rest_weight = weighed.agg(F.sum(big("__w")).alias("w")).first()["w"] or 0
    left, n_capped = total, 0
    while rest_weight:
        capped = F.lit(cap) * big("source_size") * F.lit(rest_weight) < F.lit(left) * big("__w")
        now = weighed.agg(
            F.sum(F.when(capped, 1).otherwise(0)).alias("n"), F.sum(F.when(capped, big("source_size")).otherwise(0)).alias("size"),
            F.sum(F.when(capped, big("__w")).otherwise(0)).alias("w"), F.sum(big("__w")).alias("all_w")).first()
        if now["n"] == n_capped:
            break
        n_capped, left, rest_weight = now["n"], total - cap * now["size"], now["all_w"] - now["w"]
    if rest_weight:
        capped = F.lit(cap) * big("source_size") * F.lit(rest_weight) < F.lit(left) * big("__w")
        share = (F.lit(left) * big("__w")).cast("double") / F.lit(rest_weight).cast("double")
    else:
        capped, share = F.lit(True), F.lit(0.0)
    target = F.when(capped, (F.lit(cap) * F.col("source_size")).cast("double")).otherwise(share)
    return weighed.withColumn("target", target)


def mix_sources(
    docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED,
) -> DataFrame:
    """(id, source, size, source_size, target, copies) for every row of ``docs``."""
    sized = docs.select(
        F.col(id).alias("__doc"), F.coalesce(F.col(source), F.lit("")).alias("__s"), F.col(source).isNull().alias("__none"),
        word_count(F.col(text)).alias("size"))
    numbered = numbered_by_range(
        sized.withColumn("__h", F.xxhash64("__doc", F.lit(seed))),
        [F.col("__none"), F.col("__s"), F.col("size"), F.col("__h"), F.col("__doc")])
    # One row per source and partition it reaches into: sums carry the numbering across partitions.
    pieces = cut_lineage(numbered.groupBy("__none", "__s", "__part").agg(
        F.count("*").alias("__n"), F.min("__at").alias("__first"), F.sum("size").alias("__size")))
    targets = source_targets(pieces.groupBy("__none", "__s").agg(F.sum("__size").alias("source_size")), weights, cap)
    along = Window.partitionBy("__none", "__s").orderBy("__part")
    expected = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * PARTS)).otherwise(F.lit(0)).cast("long")
    offset = F.pmod(F.xxhash64("__none", "__s", F.lit(seed)), F.lit(PARTS))
    pieces = pieces.withColumn("__before", F.coalesce(
        F.sum("__n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    pieces = pieces.join(targets, ["__none", "__s"]).select(
        F.col("__none"), F.col("__s"), F.col("__part"), F.col("source_size"), F.col("target"), expected.alias("__e"), offset.alias("__u"),
        (F.col("__before") - F.col("__first")).alias("__shift"))
    start = (F.col("__at") + F.col("__shift")) * F.col("__e") + F.col("__u")
    copies = F.shiftright(start + F.col("__e"), 24) - F.shiftright(start, 24)
    return numbered.join(pieces, ["__none", "__s", "__part"]).select(
        F.col("__doc").alias(id), F.when(~F.col("__none"), F.col("__s")).alias(source), "size", "source_size", "target", copies.alias("copies"))


def take_mix(docs: DataFrame, id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it is taken, with their columns.

    Rows that share id, source and size are told apart by their place among each other.
    """
    source, text = options.get("source", "source"), options.get("text", "text")
    names = {n: fresh(docs, f"__{n}") for n in ("id", "s", "none", "size", "no", "copies", "each")}
    mixed = mix_sources(docs, id, **options)
    keys = [names[n] for n in ("id", "s", "none", "size")]
    same = Window.partitionBy(*keys)
    taken = mixed.where(F.col("copies") > 0).select(
        F.col(id).alias(keys[0]), F.coalesce(F.col(source), F.lit("")).alias(keys[1]), F.col(source).isNull().alias(keys[2]),
        F.col("size").alias(keys[3]), F.col("copies").alias(names["copies"]))
    taken = taken.withColumn(names["no"], F.row_number().over(same.orderBy(F.col(names["copies"]).desc())))
    rows = docs.withColumns({
        keys[0]: F.col(id), keys[1]: F.coalesce(F.col(source), F.lit("")), keys[2]: F.col(source).isNull(), keys[3]: word_count(F.col(text))})
    rows = rows.withColumn(names["no"], F.row_number().over(same.orderBy(F.xxhash64(F.col(text)))))
    on = [rows[k].eqNullSafe(taken[k]) if k == keys[0] else rows[k] == taken[k] for k in [*keys, names["no"]]]
    out = rows.join(taken, reduce(lambda a, b: a & b, on)).select(
        *[rows[f"`{c}`"] for c in docs.columns], F.explode(F.sequence(F.lit(1), taken[names["copies"]])).alias(names["each"]))
    return out.drop(names["each"])
