"""Capping records per dominant contributor by salted pre-ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spandrel.operators.ranks import global_rank
from spandrel.session import materialize

#: Rows of one contributor that one task ranks; a contributor with more is spread over as many salts.
SALT_ROWS = 500_000


def cap_per_contributor(
    df: DataFrame,
    contributor: str,
    order: list[Column],
    unique: str,
    max_count: int | None = None,
    max_share: float | None = None,
    salt_rows: int = SALT_ROWS,
) -> DataFrame:
    """Every row with ``kept``: whether it is among its contributor's best rows.

    order: the quality, best first, and to a total order; unique: a column that spreads a contributor over the salts.
    max_count: rows kept per contributor; max_share: rows kept as a share of all rows (rounded down, at least 1). The
    smaller holds. A null contributor is one contributor. No row is lost: rows beyond the cap come out with kept =
    false. An empty table gives no rows. Repeated rows count as often as they come.

    Method: rows are ranked within (contributor, salt) first; a contributor has one salt per ``salt_rows`` of its rows,
    so the largest is ranked by as many tasks as its size needs. What is beyond the cap there is beyond it in all; the
    rest, at most cap rows a salt, is ranked again, while the other rows keep their salts. A share's cap grows with the
    data, so its ranks come from range-partitioned positions instead.
    """
    if max_count is None and max_share is None:
        raise ValueError("max_count or max_share")
    if {"kept", "__salt", "__pre", "__rank", "__salts", "__again"} & set(df.columns):
        raise ValueError("kept, __salt, __salts, __pre, __again and __rank are reserved")
    if max_share is not None:
        df = materialize(df, "capped")
        share = max(1, int(max_share * df.count()))
        if max_count is None or share < max_count:
            ranked = global_rank(df, [contributor], order, "__rank")
            return ranked.withColumn("kept", F.col("__rank") <= share).drop("__rank")
    # Only contributors that need more than one salt are joined: at most one per salt_rows rows of the table.
    sizes = df.groupBy(contributor).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > salt_rows)
    large = sizes.select(F.col(contributor).alias("__c"), F.ceil(F.col("__n") / salt_rows).cast("int").alias("__salts"))
    salted = df.join(large, F.col(contributor).eqNullSafe(F.col("__c")), "left").drop("__c")
    salted = salted.withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(unique), F.col("__salts")), F.lit(0))).drop("__salts")
    pre = salted.withColumn("__pre", F.row_number().over(W.partitionBy(contributor, "__salt").orderBy(*order)))
    # Candidates of all salts meet in one key, other rows stay apart by salt.
    again = pre.withColumn("__again", F.when(F.col("__pre") <= max_count, F.lit(-1)).otherwise(F.col("__salt")))
    ranked = again.withColumn("__rank", F.row_number().over(W.partitionBy(contributor, "__again").orderBy(*order)))
    return ranked.select(*df.columns, ((F.col("__again") == -1) & (F.col("__rank") <= max_count)).alias("kept"))
