"""Top rows and caps per group: ties, nulls, NaN, repeats, hot groups, skipping."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from spandrel.llm import topn
from spandrel.llm.capping import cap_per_contributor


def test_top_n(spark):
    random.seed(8)
    nan = float("nan")
    rows = [(random.choice(["hot", "hot", "hot", "a", "b", None]), random.choice([None, nan, 1.0, 2.0, 3.0, random.random()]), k) for k in range(2_000)] + [("hot", 3.0, 5), ("big", 2.0**53 + 1, -1)]
    df = spark.createDataFrame(rows, "g string, s double, id int").withColumn("rank_", F.lit(1)).repartition(3)

    def key(r):
        s = r[1]
        return (s is None, 0 if s is None else -2 if s != s else -1, 0 if s is None or s != s else -s, r[2])

    want = {}
    for g in {r[0] for r in rows} - {None}:
        want[g] = [r[2] for r in sorted((r for r in rows if r[0] == g), key=key)[:4]]
    got = {}
    for r in topn.top_n_per_group(df, "g", "s", ["id"], 4, row_group_bytes=2_000).orderBy("g", "rank").collect():
        got.setdefault(r.g, []).append(r.id)
    assert got == want
    assert topn.top_n_per_group(df.limit(0), "g", "s", ["id"], 4).count() == 0
    with pytest.raises(ValueError):
        topn.top_n_per_group(df.withColumnRenamed("rank_", "rank"), "g", "s", ["id"], 4)


def test_row_groups_are_skipped(spark, tmp_path):
    n = 60_000
    df = spark.range(n).select(F.when(F.col("id") % 50 == 0, "cold").otherwise("hot").alias("__g"), F.rand(3).alias("__s"), F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("filler"))
    path = str(tmp_path / "clustered")
    df.coalesce(1).sortWithinPartitions("__g", F.desc("__s")).write.option("parquet.block.size", 40_000).option("parquet.page.size", 4_000).option("parquet.block.size.row.check.min", 50).parquet(path)
    back = spark.read.parquet(path)
    file = back.inputFiles()[0]
    read: list[int] = []
    import pyarrow as pa

    batches = list(topn._scan(iter([pa.RecordBatch.from_pydict({"p": [file]})]), 5, to_arrow_schema(back.schema), read))
    total = topn._open(file).metadata.num_row_groups
    assert total >= 20 and len(read) < total / 3  # most are skipped, and none wrongly:
    kept = {g: sorted((s for b in batches for x, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if x == g), reverse=True)[:5] for g in ("hot", "cold")}
    for g, best in kept.items():
        assert best == [r["__s"] for r in back.where(F.col("__g") == g).orderBy(F.desc("__s")).limit(5).collect()]


def test_caps(spark):
    random.seed(9)
    rows = [(random.choice(["hot", "hot", "hot", "a", None]), random.choice([None, 1.0, 2.0]), k) for k in range(3_000)]
    df = spark.createDataFrame(rows, "c string, s double, id int").repartition(4)
    order = [F.desc_nulls_last("s"), F.asc("id")]
    for salt_rows in (100, 1_000_000):
        out = cap_per_contributor(df, "c", order, "id", max_count=7, salt_rows=salt_rows).collect()
        assert len(out) == len(rows)
        for c in ("hot", "a", None):
            own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
            assert {r.id for r in out if r.c == c and r.kept} == {r[2] for r in own[:7]}
    share = cap_per_contributor(df, "c", order, "id", max_share=0.1).groupBy("c").agg(F.count_if("kept").alias("k")).collect()
    assert {r.c: r.k for r in share} == {"hot": 300, "a": 300, None: 300}
    assert cap_per_contributor(df.limit(0), "c", order, "id", max_count=7).count() == 0
    with pytest.raises(ValueError):
        cap_per_contributor(df, "c", order, "id")
