"""Items that appear together: pair counts over baskets by an external sort of packed 64-bit pair codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.operators.ranks import dense_ids
from spandrel.session import materialize

#: Pair codes in one run before it is sorted and run-length counted.
RUN_CODES = 4_000_000
#: Items of one block of a basket: a basket with more is paired block by block, in rows of their own.
BLOCK_ITEMS = 2_048


def _runs(batches: Iterator[pa.RecordBatch], run_codes: int) -> Iterator[pa.RecordBatch]:
    """Rows of (ids, other ids or null) -> sorted, run-length counted runs of codes (a << 32 | b), a < b.

    Without other ids all pairs within a row are formed, else those between its two lists.
    """
    upper: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    held: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        codes, counts = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts.astype(np.int64))], ["code", "n"])

    def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))

    for batch in batches:
        flat, ends = lists(batch.column(0))
        flat2, ends2 = lists(batch.column(1))
        begin = begin2 = 0
        for end, end2 in zip(ends, ends2):
            ids, others = flat[begin:end], flat2[begin2:end2]
            begin, begin2 = end, end2
            if len(others):
                a, b = np.minimum.outer(ids, others), np.maximum.outer(ids, others)
                held.append(((a << 32) | b).ravel())
                size += len(ids) * len(others)
            elif len(ids) > 1:
                m = len(ids)
                if m not in upper:
                    if len(upper) > 500:
                        upper.clear()
                    upper[m] = np.triu_indices(m, 1)
                a, b = upper[m]
                held.append((ids[a] << 32) | ids[b])
                size += len(a)
            if size >= run_codes:
                yield flush()
                size = 0
    if held:
        yield flush()


def _run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merged, sorted (code, n) -> one row per code; a code may go on in the next batch."""
    last, total = None, 0
    for batch in batches:
        code, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(code):
            continue
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        sums = np.add.reduceat(n, first)
        keys = code[first]
        if last is not None:
            if keys[0] == last:
                sums[0] += total
            else:
                keys, sums = np.concatenate([[last], keys]), np.concatenate([[total], sums])
        last, total = keys[-1], sums[-1]
        if len(keys) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(keys[:-1]), pa.array(sums[:-1])], ["code", "c"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([total], pa.int64())], ["code", "c"])


def basket_rows(coded: DataFrame, block_items: int) -> DataFrame:
    """(basket, id) -> rows (ids, others) that together hold every pair of each basket once.

    A basket of at most ``block_items`` items is one row. A larger one is cut into blocks by its ids: each block is a
    row, and so is each pair of blocks, so no row and no task holds a large basket or all of its pairs.
    """
    sizes = coded.groupBy("basket").agg(F.count(F.lit(1)).alias("m"))
    few = sizes.where(F.col("m") > block_items).withColumn("blocks", F.ceil(F.col("m") / block_items).cast("int")).select("basket", "blocks")
    cut = coded.join(few, "basket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    # The ids are dense, so their remainder spreads them evenly; every block meets every other once.
    own = F.pmod("id", "blocks").cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least(own, b).alias("lo"), F.greatest(own, b).alias("hi")))
    rows = cut.select("basket", "id", own.alias("own"), F.explode(others).alias("p")).select("basket", "id", "own", "p.lo", "p.hi")
    side = [F.array_sort(F.collect_list(F.when(F.col("own") == F.col(x), F.col("id")))) for x in ("lo", "hi")]
    listed = rows.groupBy("basket", "lo", "hi").agg(side[0].alias("ids"), F.when(F.first("lo") == F.first("hi"), F.array().cast("array<int>")).otherwise(side[1]).alias("others"))
    # A block that meets one without items in this basket has no pairs.
    return listed.where("lo = hi or (size(ids) > 0 and size(others) > 0)").select("ids", "others")


def co_occurrence(df: DataFrame, basket: str, item: str, min_count: int = 1, min_share: tuple[int, int] | None = None, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Per pair of items the baskets with both, and how far that is above chance.

    Returns (item_a string, item_b string, c, f_a, f_b, n_baskets bigint, lift, odds_ratio, log_odds_se double), a < b.
    c: baskets with both; f: baskets with the item; lift = c*N/(f_a*f_b); odds_ratio of the 2x2 table with 0.5 added to
    each cell (continuity correction), log_odds_se the standard error of its logarithm. Only pairs with
    c >= min_count and, with min_share = (p, q), c*q >= p*N come out; items too rare for any such pair are left out
    before pairs are formed, which loses no pair.

    Rows with a null basket or item don't count; a repeated item in a basket counts once; an empty string is an item.
    A basket with one item counts in N. An empty table gives no rows. Extra columns are not read. At most 2^31 - 1
    different items can be coded; more are an error.

    Method: the items of a basket become dense ids, each task packs pairs into 64-bit codes and keeps sorted runs with
    run lengths, Spark's external sort spills and merges the runs of one code range, and the merged run lengths are
    added up. No pair row carries a string until the counts are final. Large baskets are paired in blocks.
    """
    rows = df.select(F.col(basket).alias("basket"), F.col(item).alias("item")).where("basket is not null and item is not null")
    once = materialize(rows.distinct(), "baskets")
    n = once.select("basket").distinct().count()
    least = max(min_count, 1, -(-min_share[0] * n // min_share[1]) if min_share else 1)
    freq = once.groupBy("item").agg(F.count(F.lit(1)).alias("f")).where(F.col("f") >= least)
    freq = materialize(freq, "frequencies")
    words = materialize(dense_ids(freq, "item").join(freq, "item"), "items")
    coded = once.join(words.select("item", "id"), "item").select("basket", "id")
    runs = basket_rows(coded, block_items).mapInArrow(lambda it: _runs(it, RUN_CODES), "code bigint, n bigint")
    merged = runs.repartition("code").sortWithinPartitions("code").mapInArrow(_run_lengths, "code bigint, c bigint")
    pairs = merged.where(F.col("c") >= least).select(F.shiftright("code", 32).cast("int").alias("a"), F.col("code").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b"), "c")

    def side(s: str) -> DataFrame:
        return words.select(F.col("id").alias(s), F.col("item").alias(f"item_{s}"), F.col("f").alias(f"f_{s}"))

    c, fa, fb, total = (F.col(x).cast("double") for x in ("c", "f_a", "f_b", "n_baskets"))
    both, only_a, only_b, neither = c + 0.5, fa - c + 0.5, fb - c + 0.5, total - fa - fb + c + 0.5
    return (
        pairs.join(side("a"), "a")
        .join(side("b"), "b")
        .withColumn("n_baskets", F.lit(n).cast("bigint"))
        .select(
            "item_a", "item_b", "c", "f_a", "f_b", "n_baskets",
            (c * total / (fa * fb)).alias("lift"),
            (both * neither / (only_a * only_b)).alias("odds_ratio"),
            F.sqrt(1 / both + 1 / only_a + 1 / only_b + 1 / neither).alias("log_odds_se"),
        )
    )
