"""First rows, pages and diverse choices per group; only prunable ranks, so no group is sorted whole where a few rows do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows per key with their rank 1..k. ``order`` must be total for a defined result.

    The filter on row_number lets each task drop what can't be among the first k before the shuffle. Null keys form a
    group. An empty table gives no rows.
    """
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def first_per_key(df: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """Per key the row with the least (order...), as an aggregate that combines before the shuffle; nulls come first."""
    row = F.min(F.struct(*order, *keep)).alias("__row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col("__row")[c].alias(c) for c in [*order, *keep]])


def diverse_top_k(df: DataFrame, keys: list[str], variety: str, order: list[Column], k: int) -> DataFrame:
    """Up to k rows per key: the first of each value of ``variety`` in order, then the others in order; null is a value.

    At most k + 1 rows per (key, variety) can come out, so those ranks are cut first, each before its shuffle.
    """
    nth = F.row_number().over(W.partitionBy(*keys, variety).orderBy(*order))
    few = df.withColumn("__nth", nth).where(F.col("__nth") <= k + 1)
    return top_k(few, keys, [(F.col("__nth") > 1).cast("int").asc(), *order], k).drop("__nth")


def recommended_and_diverse(ranked: DataFrame, keys: list[str], variety: str, rank: str, others: int) -> DataFrame:
    """Of ranked rows the first (role recommended) and the next ``others`` that differ from it and each other in variety."""
    head = ranked.where(F.col(rank) == 1)
    first = head.select(*keys, F.col(variety).alias("__first"))
    rest = ranked.join(first, keys).where(~F.col(variety).eqNullSafe(F.col("__first"))).drop("__first")
    one = rest.withColumn("__nth", F.row_number().over(W.partitionBy(*keys, variety).orderBy(rank))).where("__nth = 1").drop("__nth")
    more = top_k(one, keys, [F.asc(rank)], others, "__j").drop("__j")
    return head.withColumn("role", F.lit("recommended")).unionByName(more.withColumn("role", F.lit("diverse")))


def page(df: DataFrame, keys: list[str], order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of each key with ``rank`` and ``more``: whether a row follows the page.

    One row beyond the page is ranked too, so no count of the group is needed.
    """
    upto = top_k(df, keys, order, number * size + 1)
    more = F.max("rank").over(W.partitionBy(*keys)) > number * size
    return upto.withColumn("more", more).where((F.col("rank") > (number - 1) * size) & (F.col("rank") <= number * size))


def keep_or_all(df: DataFrame, keys: list[str], wanted: Column) -> DataFrame:
    """Rows for which ``wanted`` holds; of a key without any, all its rows. The choice is an aggregate joined back."""
    flag = F.coalesce(wanted, F.lit(False))
    any_of = df.groupBy(*keys).agg(F.bool_or(flag).alias("__any"))
    return df.join(any_of, keys).where(flag | ~F.col("__any")).drop("__any")
