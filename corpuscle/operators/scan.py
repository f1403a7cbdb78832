"""Running values within a key, in order, where one key may hold any share of all rows.

A window gives each key to one task. Here rows are range-partitioned by key and order, so a large key
is cut into segments; each segment is scanned by itself, one summary a segment is carried into the next, and the
carried value is added. Only the first key of a partition can have begun before it, so what is carried
has at most one row a partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import written

_PART = "__scan_part"


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, tops: dict[str, Column] | None = None) -> DataFrame:
    """All rows and columns, plus running columns over the rows of a key up to and with the row itself.

    keys, order: column names; order ascends, nulls first, and should be total within a key: of rows that tie the
    order is any. `sums`: name -> expression, summed (``F.lit(1)`` numbers the rows from 1, null adds nothing, a sum begins
    at 0). `lasts`: name -> expression, the last value that is not null (null before the first). `tops`: name -> expression, the largest.
    Null keys are a key. An empty table gives an empty table. The rows are written to the shared folder once.
    """
    sums, lasts, tops = sums or {}, lasts or {}, tops or {}
    values = {f"__scan_{n}": c for n, c in (sums | lasts | tops).items()}
    rows = df.select("*", *(c.alias(n) for n, c in values.items()))
    rows = written(rows.repartitionByRange(*keys, *order).withColumn(_PART, F.spark_partition_id()))
    place = F.struct(*order)

    def last(name: str) -> Column:
        return F.max_by(f"__scan_{name}", F.when(F.col(f"__scan_{name}").isNotNull(), place))

    segments = rows.groupBy(_PART, *keys).agg(*(F.sum(f"__scan_{n}").alias(n) for n in sums), *(last(n).alias(n) for n in lasts), *(F.max(f"__scan_{n}").alias(n) for n in tops))
    before = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = segments.select(
        F.col(_PART).alias("__scan_to"),
        *(F.col(k).alias(f"__scan_key{i}") for i, k in enumerate(keys)),
        *(F.sum(n).over(before).alias(f"__scan_from_{n}") for n in sums),
        *(F.last(n, ignorenulls=True).over(before).alias(f"__scan_from_{n}") for n in lasts),
        *(F.max(n).over(before).alias(f"__scan_from_{n}") for n in tops),
        F.count("*").over(before).alias("__scan_earlier"),
    ).filter("__scan_earlier > 0").drop("__scan_earlier")
    carried = rows.sparkSession.createDataFrame(carried.collect(), carried.schema)
    upto = Window.partitionBy(_PART, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select(
        *df.columns, _PART,
        *(F.sum(f"__scan_{n}").over(upto).alias(f"__scan_{n}") for n in sums),
        *(F.last(f"__scan_{n}", ignorenulls=True).over(upto).alias(f"__scan_{n}") for n in lasts),
        *(F.max(f"__scan_{n}").over(upto).alias(f"__scan_{n}") for n in tops),
    )
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__scan_key{i}")) for i, k in enumerate(keys)), F.col(_PART) == F.col("__scan_to"))
    joined = local.join(F.broadcast(carried), same, "left")
    added = {n: F.coalesce(f"__scan_{n}", F.lit(0)) + F.coalesce(f"__scan_from_{n}", F.lit(0)) for n in sums}
    added |= {n: F.coalesce(f"__scan_{n}", f"__scan_from_{n}") for n in lasts}
    added |= {n: F.greatest(f"__scan_{n}", f"__scan_from_{n}") for n in tops}
    return joined.select(*df.columns, *(c.alias(n) for n, c in added.items()))
