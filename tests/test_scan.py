import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuscle.operators.scan import running


def frame(spark):
    r = random.Random(5)
    rows = [(r.choice([None, 1, 1, 1, 1, 2]), i, r.choice([None, None, "s%d" % i]), r.randint(-3, 9)) for i in range(4000)] + [(3, None, None, 1), (4, 1, "only", None)]
    return spark.createDataFrame(rows, "k int, at int, mark string, n int").repartition(5)


def test_one_key_of_most_rows_equals_the_window(spark):
    df = frame(spark)
    w = Window.partitionBy("k").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("*", F.count("*").over(w).alias("pos"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("upto"), F.last("mark", ignorenulls=True).over(w).alias("section"))
    got = running(df, ["k"], ["at"], {"pos": F.lit(1), "upto": F.col("n")}, {"section": F.col("mark")})
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_hot_key_is_scanned_in_segments(spark):
    df = spark.range(20000).selectExpr("7 AS k", "id AS at", "1 AS n")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put together
    try:
        got = running(df, ["k"], ["at"], {"pos": F.lit(1)})
        assert got.filter("pos <> at + 1").count() == 0
        parts = [r["count"] for r in got.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) > 1 and max(parts) < 15000


def test_empty(spark):
    assert running(frame(spark).limit(0), ["k"], ["at"], {"pos": F.lit(1)}).count() == 0
