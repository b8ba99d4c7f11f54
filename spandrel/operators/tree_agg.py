"""Per-key aggregates over keys of any skew, by multi-level tree aggregation.

Rows are combined in chunks of bounded size first, whatever their key; the chunk states of a key are then merged in
rounds of a fixed fan-in. No task ever receives all partial states of a hot key: a merge task sees at most ``fan_in``
states per key, and the number of rounds grows with the logarithm of the number of chunks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How the state of an aggregate is built from rows and merged from states.
_BUILD = {
    "count": lambda c: F.count(F.lit(1)) if c == "*" else F.count(c),
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
}
_MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def tree_aggregate(
    df: DataFrame,
    keys: list[str],
    aggs: dict[str, tuple[str, str]],
    chunk_rows: int = 250_000,
    fan_in: int = 16,
) -> DataFrame:
    """One row per key with ``aggs`` = {output: (count|sum|min|max, column or "*")}.

    chunk_rows: rows of one chunk at the first level. Nulls in a key are a key of their own, as in groupBy; nulls in a
    value are ignored, as in SQL. Repeated rows count as often as they come. An empty table gives no rows. Extra columns
    are not read. ``__chunk`` is reserved.
    """
    bad = [f for f, _ in aggs.values() if f not in _BUILD]
    if bad:
        raise ValueError(f"no mergeable state for {bad}")
    used = [c for _, c in aggs.values() if c != "*"]
    # Chunks are numbered by task and place in the task, each once, so a merge of fan_in numbers meets at most that many
    # states of a key. One row per task is aggregated to learn how many there are.
    part = F.spark_partition_id()
    sizes = df.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("p").alias("p"), F.max("n").alias("n")).first()
    blocks = max(1, math.ceil((sizes.n or 0) / chunk_rows))
    chunks = ((sizes.p or 0) + 1) * blocks
    # Level 0: the position in the input, not the key, decides the chunk: each run of chunk_rows rows of a task is one,
    # and Spark combines it before the shuffle, so a chunk sends one state per key.
    block = F.floor(F.monotonically_increasing_id() % (1 << 33) / chunk_rows)
    level = df.select(*dict.fromkeys([*keys, *used])).withColumn("__chunk", (part.cast("bigint") * blocks + block).cast("bigint"))
    level = level.groupBy(*keys, "__chunk").agg(*[_BUILD[f](c).alias(out) for out, (f, c) in aggs.items()])
    while chunks > 1:
        chunks = math.ceil(chunks / fan_in)
        level = level.withColumn("__chunk", F.expr(f"__chunk div {fan_in}")).groupBy(*keys, "__chunk").agg(*[_MERGE[f](out).alias(out) for out, (f, _) in aggs.items()])
    return level.drop("__chunk")
