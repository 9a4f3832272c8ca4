"""A pass over a sequence moves its rows once."""

import re

from pyspark.sql import functions as F

from kerbline.operators.sequence import stitched


def passed(df):
    return stitched(df, keys=["k"], order=["at", "n"], chunk=F.floor(F.col("at") / 10), previous={"before": "at", "k_before": "k"},
                    running_sum={"total": F.col("v")}, running_min={"low": F.col("v")}, running_last={"seen": F.when(F.col("v") > 5, F.col("v"))})


def test_values_equal_a_plain_window(spark):
    from pyspark.sql import Window

    df = spark.range(400).select((F.col("id") % 3).alias("k"), F.floor(F.col("id") / 2).alias("at"), F.col("id").alias("n"),
                                 F.when(F.col("id") % 4 > 0, (F.col("id") * 7) % 11).alias("v"), F.lit("wide").alias("w"))
    df = df.withColumn("k", F.when(F.col("k") > 0, F.col("k")))  # a null key is a key
    w = Window.partitionBy("k").orderBy("at", "n")
    upto, earlier = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("*", F.lag("at").over(w).alias("before"), F.lag("k").over(w).alias("k_before"), F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("total"),
                     F.min("v").over(upto).alias("low"), F.last(F.when(F.col("v") > 5, F.col("v")), ignorenulls=True).over(earlier).alias("seen"))
    got = passed(df)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_rows_are_exchanged_once(spark, folder):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        spark.range(100).selectExpr("id % 7 k", "id at", "id n", "id v", "'wide' w").write.parquet(f"{folder}/rows")
        df = spark.read.parquet(f"{folder}/rows")
        plan = passed(df)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "Join" not in plan
    # Exchanges: the carries' aggregation, their window over the key, and the one of the rows.
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 3
