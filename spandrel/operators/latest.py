"""Latest row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], versions: list[str], keep: list[str]) -> DataFrame:
    """Per key the row with the greatest (versions..., keep...), as one aggregation that combines before the shuffle.

    Nulls in a version sort lowest. Rows that tie on all versions are told apart by the kept columns, so the
    result is the same on every run. Rows with a null key form a key of their own. An empty table gives none.
    """
    picked = F.max(F.struct(*versions, *[c for c in keep if c not in versions])).alias("__row")
    out = df.select(*dict.fromkeys([*keys, *versions, *keep])).groupBy(*keys).agg(picked)
    return out.select(*keys, *[F.col("__row")[c].alias(c) for c in keep if c not in keys])
