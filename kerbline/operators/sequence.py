"""Order-dependent columns computed without ever putting one key into one task.

A plain window over a busy key sorts every row of that key in a single task. Here each key is cut
into chunks that follow the order (a span of time, a span of sequence numbers). Windows run inside a
chunk. One small row per chunk carries what the chunk needs from all before it (the last row, the sums,
the minimum); only these rows are windowed over the whole key. They are then united with the rows, as the
first row of their chunk, so the same window picks their values up: no join, and rows are shuffled once.

The input is read twice, by the windows and by the carries, which are aggregated before they move. So a
pass built on another pass should start from a written result (``cut_lineage``): stacked lazily, each
level would double the work below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_CHUNK = "__chunk"
_MARK = "__mark"


def stitched(
    df: DataFrame,
    *,
    keys: list[str],
    order: list[str],
    chunk: Column,
    previous: dict[str, str] | None = None,
    running_sum: dict[str, Column] | None = None,
    running_min: dict[str, Column] | None = None,
    running_last: dict[str, Column] | None = None,
) -> DataFrame:
    """Add order-dependent columns per key.

    ``previous``: output -> column, the value on the row before (null on the key's first row).
    ``running_sum`` and ``running_min``: output -> expression, up to and including the row.
    ``running_last``: output -> expression, its last non-null value on any EARLIER row.
    ``chunk`` must never decrease along ``order`` within a key.
    """
    previous, running_sum = previous or {}, running_sum or {}
    running_min, running_last = running_min or {}, running_last or {}
    base = df.withColumn(_CHUNK, chunk)
    for i, e in enumerate(running_sum.values()):
        base = base.withColumn(f"__s{i}", e)
    for i, e in enumerate(running_min.values()):
        base = base.withColumn(f"__m{i}", e)
    for i, e in enumerate(running_last.values()):
        base = base.withColumn(f"__l{i}", e)

    position = F.struct(*[F.col(c) for c in order])
    carry_aggs = []
    if previous:
        carry_aggs.append(F.max_by(F.struct(*[F.col(c) for c in dict.fromkeys(previous.values())]), position).alias("__tail"))
    carry_aggs += [F.sum(f"__s{i}").alias(f"__cs{i}") for i in range(len(running_sum))]
    carry_aggs += [F.min(f"__m{i}").alias(f"__cm{i}") for i in range(len(running_min))]
    carry_aggs += [
        F.max_by(f"__l{i}", F.when(F.col(f"__l{i}").isNotNull(), position)).alias(f"__cl{i}") for i in range(len(running_last))
    ]

    across = Window.partitionBy(*keys).orderBy(_CHUNK)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = []
    if previous:
        carried.append(F.lag("__tail").over(across).alias("__ptail"))
    carried += [F.sum(f"__cs{i}").over(before).alias(f"__ps{i}") for i in range(len(running_sum))]
    carried += [F.min(f"__cm{i}").over(before).alias(f"__pm{i}") for i in range(len(running_min))]
    carried += [F.last(f"__cl{i}", ignorenulls=True).over(before).alias(f"__pl{i}") for i in range(len(running_last))]
    # A chunk's first row holds, in the very columns the windows read, what stands before the chunk.
    before_chunk = base.groupBy(*keys, _CHUNK).agg(*carry_aggs).select(*keys, _CHUNK, *carried)
    # A column that is both a key or the order and a source of ``previous`` goes by a name of its own.
    sources = {col: f"__v{i}" for i, col in enumerate(dict.fromkeys(previous.values()))}
    rows = base.withColumns({name: F.col(col) for col, name in sources.items()}).withColumn(_MARK, F.lit(1))
    marks = before_chunk.select(
        *keys, _CHUNK, F.lit(0).alias(_MARK), *[F.col("__ptail").getField(col).alias(name) for col, name in sources.items()],
        *[F.col(f"__ps{i}").alias(f"__s{i}") for i in range(len(running_sum))],
        *[F.col(f"__pm{i}").alias(f"__m{i}") for i in range(len(running_min))],
        *[F.col(f"__pl{i}").alias(f"__l{i}") for i in range(len(running_last))],
    )
    together = rows.unionByName(marks, allowMissingColumns=True)

    inside = Window.partitionBy(*keys, _CHUNK).orderBy(_MARK, *order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    found: dict[str, Column] = {}
    for out, col in previous.items():
        found[f"__o_{out}"] = F.lag(sources[col]).over(inside)
    for i, out in enumerate(running_sum):
        found[f"__o_{out}"] = F.coalesce(F.sum(f"__s{i}").over(upto), F.lit(0))
    for i, out in enumerate(running_min):
        found[f"__o_{out}"] = F.min(f"__m{i}").over(upto)
    for i, out in enumerate(running_last):
        found[f"__o_{out}"] = F.last(f"__l{i}", ignorenulls=True).over(earlier)
    outs = [*previous, *running_sum, *running_min, *running_last]
    return together.withColumns(found).where(F.col(_MARK) == 1).select(
        *[F.col(c) for c in df.columns if c not in outs], *[F.col(f"__o_{out}").alias(out) for out in outs])


def global_row_number(df: DataFrame, *, order: list[str], chunk: Column, out: str, keys: list[str] | None = None) -> DataFrame:
    """Row numbers along ``order``, per key or over the whole table, sorted chunk by chunk."""
    if keys:
        return stitched(df, keys=keys, order=order, chunk=chunk, running_sum={out: F.lit(1).cast("bigint")})
    whole = df.withColumn("__all", F.lit(0))
    return stitched(
        whole, keys=["__all"], order=order, chunk=chunk, running_sum={out: F.lit(1).cast("bigint")}
    ).drop("__all")


def ranked_values(
    df: DataFrame, *, keys: list[str], value: str, chunk: Column, ranks: dict[str, Column]
) -> DataFrame:
    """The value at given 0-based ranks of each key's sorted values, exactly and without sorting raw rows.

    Equal values are counted first; ranks are found on the cumulative counts. ``ranks`` are
    expressions over ``n``, the key's number of non-null values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c"))
    if keys:
        keyed, ks = counts, keys
    else:
        keyed, ks = counts.withColumn("__all", F.lit(0)), ["__all"]
    cumulative = stitched(keyed, keys=ks, order=[value], chunk=chunk, running_sum={"__upto": F.col("__c")})
    totals = keyed.groupBy(*ks).agg(F.sum("__c").alias("n"))
    joined = cumulative.join(totals, ks)
    picks = [
        F.max(F.when((F.col("__upto") - F.col("__c") <= rank) & (rank < F.col("__upto")), F.col(value))).alias(name)
        for name, rank in ranks.items()
    ]
    out = joined.groupBy(*ks).agg(F.max("n").alias("n"), *picks)
    return out if keys else out.drop("__all")
