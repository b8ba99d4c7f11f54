"""Exact ranks without gathering a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spandrel.session import materialize


def global_rank(df: DataFrame, group: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """Rank 1, 2, ... of each row within its group by ``order``, whatever the size of the group.

    Rows are range-partitioned by (group, order), so a hot group spreads over as many tasks as its size needs; the rank
    is the position inside the range plus the number of rows of the group in earlier ranges. Only those counts, one per
    group and range that it spans, are joined. ``order`` must be total for a defined result; rows that tie on all of it
    are ranked in no defined order among themselves. Nulls in a group column form a group.
    """
    keys = [F.col(g) for g in group]
    ranged = df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id())
    # A table, as a recomputed range partitioning might cut elsewhere.
    ranged = materialize(ranged, "ranged")
    sizes = ranged.groupBy(*group, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(W.partitionBy(*group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    # The local position is per (group, range): both are in the window's key, so a range is never merged with another.
    local = ranged.withColumn("__pos", F.row_number().over(W.partitionBy(*group, "__part").orderBy(*order)))
    on = [local[g].eqNullSafe(before[g]) for g in group] + [local["__part"] == before["__part"]]
    return local.join(before, on).select(*[local[c] for c in df.columns], (F.col("__pos") + F.col("__before")).alias(rank))


def dense_ids(df: DataFrame, column: str, name: str = "id", start: int = 0) -> DataFrame:
    """The distinct non-null values of a column with dense ids in the values' own order: (column, name int).

    The values are sorted in ranges; only one count per range comes to the driver.
    """
    spark = df.sparkSession
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    ranged = materialize(values.repartitionByRange(column).withColumn("__part", F.spark_partition_id()), "values")
    counts = sorted((r[0], r[1]) for r in ranged.groupBy("__part").count().collect())
    offsets, at = [], start
    for part, n in counts:
        offsets.append((part, at))
        at += n
    before = spark.createDataFrame(offsets or [(0, start)], "__part int, __before int")
    pos = F.row_number().over(W.partitionBy("__part").orderBy(column))
    return ranged.withColumn("__pos", pos).join(F.broadcast(before), "__part").select(column, (F.col("__pos") + F.col("__before") - 1).cast("int").alias(name))
