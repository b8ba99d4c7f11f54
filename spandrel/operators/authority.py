"""Authority of authors and repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spandrel.operators.topk import top_k

#: Names of accounts that aren't people.
BOTS = ["dependabot", "github-actions", "renovate", "greenkeeper", "snyk-bot", "codecov", "imgbot"]


def without_bots(contributors: DataFrame, login: str, k: int, keys: list[str], contributions: str) -> DataFrame:
    """Contributors that aren't bots (by ending [bot] or by name), the first k per key by contributions."""
    people = contributors.where(~F.lower(login).endswith("[bot]") & ~F.lower(login).isin(BOTS))
    return top_k(people, keys, [F.desc(contributions), F.asc(login)], k)


def author_scores(owned: DataFrame, given: DataFrame, k: int) -> DataFrame:
    """(login, repo, stars) owned and contributed to -> per login the stars of the first k of each, and their sum."""
    first = [top_k(rows, ["login"], [F.desc("stars"), F.asc("repo")], k) for rows in (owned, given)]
    zero = F.lit(0).cast("bigint")
    both = first[0].select("login", F.col("stars").alias("own"), zero.alias("other")).unionByName(first[1].select("login", zero.alias("own"), F.col("stars").alias("other")))
    return both.groupBy("login").agg(F.sum("own").alias("owned_stars"), F.sum("other").alias("given_stars"), F.sum(F.col("own") + F.col("other")).alias("score"))


def repo_authority(contributors: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """(repo, owner, login, contributions) and (login, score) -> per repo authority, raw_max, contributors.

    Of the first k contributors the owner counts with the whole score, others with their share of those k's
    contributions; the greatest counts, truncated. A contributor without a score has 0.
    """
    kept = top_k(contributors, ["repo"], [F.desc("contributions"), F.asc("login")], k)
    total = F.sum("contributions").over(W.partitionBy("repo"))
    rows = kept.withColumn("total", total).join(scores, "login", "left").withColumn("score", F.coalesce("score", F.lit(0)))
    weighted = F.when(F.col("login") == F.col("owner"), F.col("score").cast("double")).otherwise(F.col("score").cast("double") * F.col("contributions") / F.col("total"))
    return rows.groupBy("repo").agg(F.floor(F.max(weighted)).alias("authority"), F.max("score").alias("raw_max"), F.count(F.lit(1)).alias("contributors"))
