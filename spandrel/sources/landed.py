"""Network sources: each landed once in a cache, then read as a table; a fetcher is given from outside.

Queries never call a network. ``fetch(key)`` returns (ok, body, status) and is called on executors, one partition per
batch of keys, at most ``tries`` times with growing waits; what came is kept by key, so a run resumes where one stopped.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Fetch = Callable[[list[str]], dict[str, tuple[bool, str | None, int]]]
SCHEMA = "key string, ok boolean, body string, status int, tries int"
#: Keys of one batched request, attempts, seconds before a clone or request is given up.
BATCH, TRIES, CLONE_TRIES, TIMEOUT = 8, 4, 2, 300


def fetch_all(spark: SparkSession, keys: DataFrame, key: str, fetch: Fetch, batch: int = BATCH, tries: int = TRIES, wait: float = 1.0) -> DataFrame:
    """(key, ok, body, status, tries) per distinct key. A failing key never stops the others; its last status is kept."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            names = pdf["key"].tolist()
            for at in range(0, len(names), batch):
                open_keys, got, n = names[at : at + batch], {}, 0
                while open_keys and n < tries:
                    if n:
                        time.sleep(wait * 2 ** (n - 1))
                    n += 1
                    try:
                        answers = fetch(open_keys)
                    except Exception:  # noqa: BLE001 - any failure of a source is a failed attempt
                        answers = {}
                    for k in open_keys:
                        got[k] = (*answers.get(k, (False, None, 0)), n)
                    open_keys = [k for k in open_keys if not got[k][0] and got[k][2] != 404]
                yield pd.DataFrame([(k, *got[k]) for k in names[at : at + batch]], columns=["key", "ok", "body", "status", "tries"])

    return keys.select(F.col(key).alias("key")).where("key is not null").distinct().mapInPandas(run, SCHEMA)


def land(spark: SparkSession, keys: DataFrame, key: str, fetch: Fetch, cache: str, **options) -> DataFrame:
    """What the cache has for the keys, after fetching what it lacks. Answers are appended; only good ones count as had."""
    try:
        had = spark.read.schema(SCHEMA).parquet(cache)
        had.take(1)
    except Exception:  # noqa: BLE001 - no cache yet
        had = spark.createDataFrame([], SCHEMA)
    todo = keys.join(had.where("ok").select(F.col("key").alias(key)), key, "left_anti")
    fetch_all(spark, todo, key, fetch, **options).write.mode("append").parquet(cache)
    return spark.read.schema(SCHEMA).parquet(cache).join(keys.select(F.col(key).alias("key")).distinct(), "key", "left_semi")


def search_terms(spark: SparkSession, terms: list[str], search: Callable[[str], list[str]], limit: int, **options) -> DataFrame:
    """(term, full_name, hits): results per term, at most ``limit`` a term, one partition a term."""

    def fetch(keys: list[str]) -> dict:
        return {k: (True, "\n".join(search(k)[:limit]), 200) for k in keys}

    rows = fetch_all(spark, spark.createDataFrame([(t,) for t in terms], "term string").repartition(max(len(terms), 1)), "term", fetch, 1, **options)
    return rows.where("ok").select(F.col("key").alias("term"), F.explode(F.split("body", "\n")).alias("full_name")).where("full_name <> ''").groupBy("term", "full_name").agg(F.count(F.lit(1)).alias("hits"))


def source_spans(sources: DataFrame, links: DataFrame, link: str) -> DataFrame:
    """Links joined with texts that were landed by (repo, sha, path), an immutable key; a link without one keeps null."""
    from spandrel.functions.names import parse_permalink

    at = links.withColumn("__at", parse_permalink(link)).withColumn("__repo", F.concat_ws("/", "__at.owner", "__at.repo"))
    on = [F.col("__repo") == sources["repo"], F.col("__at.sha") == sources["sha"], F.col("__at.path") == sources["path"]]
    return at.join(sources, on, "left").select(*[at[c] for c in links.columns], sources["text"], F.col("__at.line").alias("anchor"))


def page_key(symbol):
    """Path of a symbol's specification page: the clean symbol in lower case, dots as slashes."""
    from spandrel.functions.names import clean_symbol

    return F.replace(F.lower(clean_symbol(symbol)), F.lit("."), F.lit("/"))
