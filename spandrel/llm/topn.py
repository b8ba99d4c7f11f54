"""Top N items within every group, by statistics-guided skipping over files clustered by group."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spandrel.session import table_path

#: Bytes of one row group of the clustered files: small enough that a hot group spans many of them.
ROW_GROUP_BYTES = 1 << 20


def _open(path: str) -> pq.ParquetFile:
    u = urlparse(path)
    if u.scheme in ("", "file"):
        return pq.ParquetFile(u.path, coerce_int96_timestamp_unit="us")
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    return pq.ParquetFile(system.open_input_file(name), coerce_int96_timestamp_unit="us")


def _plan(meta: pq.FileMetaData) -> list[tuple[float | None, str | None, int]]:
    """(greatest score, the group if the row group holds but one, its number), unknown statistics first, then descending."""
    at = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
    out = []
    for k in range(meta.num_row_groups):
        g, s = (meta.row_group(k).column(at[c]).statistics for c in ("__g", "__s"))
        known = g is not None and s is not None and g.has_min_max and s.has_min_max
        out.append((s.max, g.min if g.min == g.max else None, k) if known else (None, None, k))
    return sorted(out, key=lambda x: (x[0] is not None, -(x[0] or 0), x[2]))


def _scan(paths: Iterator[pa.RecordBatch], n: int, schema: pa.Schema, read: list[int] | None = None) -> Iterator[pa.RecordBatch]:
    """Candidates of each file: per group its first n rows and all that tie with the n-th score.

    The rows of a file are sorted by __g and descending __s. A row group is skipped if its greatest score lies strictly
    below the current n-th score of every group in it. One with several groups holds the head of all but the first of
    them, rows that no other row group has seen, so only those of a single group can ever be skipped; a group of
    millions has mostly these. ``read`` gets the numbers of the row groups that were read.
    """
    for batch in paths:
        for path in batch.column(0).to_pylist():
            with _open(path) as file:
                nth: dict[str, float] = {}  # group -> its n-th score so far
                best: dict[str, list[float]] = {}
                for top, only, k in _plan(file.metadata):
                    if top is not None and only in nth and top < nth[only]:
                        continue
                    if read is not None:
                        read.append(k)
                    rows = file.read_row_group(k, columns=schema.names).combine_chunks()
                    groups = rows.column("__g").combine_chunks().dictionary_encode()
                    codes, scores = groups.indices.to_numpy(), rows.column("__s").to_numpy()
                    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
                    ends = np.append(starts[1:], len(codes))
                    keep = np.zeros(len(codes), dtype=bool)
                    for begin, end in zip(starts, ends):
                        g = groups.dictionary[codes[begin]].as_py()
                        run = scores[begin:end]
                        least = max(nth.get(g, -np.inf), run[n - 1] if len(run) >= n else -np.inf)
                        keep[begin:end] = run >= least
                        held = best[g] = sorted([*best.get(g, []), *run[:n].tolist()], reverse=True)[:n]
                        if len(held) == n:
                            nth[g] = held[-1]
                    if keep.any():
                        yield from rows.filter(pa.array(keep)).cast(schema).to_batches()


def top_n_per_group(df: DataFrame, group: str, score: str, ties: list[str], n: int, row_group_bytes: int = ROW_GROUP_BYTES) -> DataFrame:
    """The n rows of each group with the greatest score; ties by ``ties`` ascending, nulls of the score last.

    Returns the input's columns and ``rank`` (1..n). ``group`` is a string column; rows with a null group don't come
    out; a group of fewer than n rows comes out whole. Repeated rows count as often as they come and share no rank
    (their order among themselves doesn't show). An empty table gives no rows. The result is the same on every run if
    ``ties`` ends in a unique column. A NaN score is greater than any number.

    Method: the rows are clustered by (group, score descending) into range-partitioned files of small row groups, so a
    group of millions spreads over many files. Each file's row groups are read in descending greatest score; one that
    lies strictly below the current n-th score of its group is skipped. What is left, at most n rows and ties per group
    and file, is ranked by one window.
    """
    spark = df.sparkSession
    if {"__g", "__s", "rank"} & set(df.columns):
        raise ValueError("__g, __s and rank are reserved")
    # A total order without NaN, whose comparisons are all false: NaN is greatest, as Spark sorts it, null least. What the
    # double can't tell apart ties here and is told apart by the last rank.
    number = F.col(score).cast("double")
    total = F.when(number.isNull(), F.lit(float("-inf"))).when(F.isnan(number), F.lit(float("inf"))).otherwise(number)
    keyed = df.where(F.col(group).isNotNull()).select(F.col(group).alias("__g"), total.alias("__s"), *df.columns)
    path = table_path(spark, "clustered")
    (keyed.repartitionByRange("__g", F.desc("__s")).sortWithinPartitions("__g", F.desc("__s")).write.option("parquet.block.size", row_group_bytes).option("parquet.page.size", row_group_bytes // 8).parquet(path))
    clustered = spark.read.schema(keyed.schema).parquet(path)
    files = clustered.inputFiles()
    if not files:
        return df.limit(0).withColumn("rank", F.lit(1))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in keyed.schema])
    listed = spark.createDataFrame([(f,) for f in files], "path string").repartition(min(len(files), max(spark.sparkContext.defaultParallelism * 4, 8)))
    arrow = to_arrow_schema(schema)
    kept = listed.mapInArrow(lambda it: _scan(it, n, arrow), schema)
    order = [F.desc_nulls_last(score), *[F.asc_nulls_last(c) for c in ties]]
    return kept.withColumn("rank", F.row_number().over(W.partitionBy("__g").orderBy(*order))).where(F.col("rank") <= n).drop("__g", "__s")
