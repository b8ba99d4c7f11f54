"""Candidates, discovery and the gate that decides which repositories are analyzed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.functions.names import clean_repo, link_repo
from spandrel.plans import base
from spandrel.sources.tables import table

#: Fixed values of the gate: last accepted push, least bytes and share of the language.
CUTOFF, LEAST_BYTES, LEAST_SHARE, LANGUAGE = "2024-06-07", 3000, 0.2, "Swift"
#: Names that are pages of a host, not repositories.
RESERVED = ["sponsors", "topics", "about", "features", "marketplace", "settings", "apps", "orgs", "users", "collections", "login", "notifications", "explore", "pulls", "issues", "new", "search", "trending", "stars", "watching"]


def language_bytes(entries: str, language: str) -> tuple[Column, Column]:
    """(bytes of one language, bytes of all) of an array of map entries; a null value counts as 0."""
    one = F.aggregate(F.filter(entries, lambda e: e["key"] == language), F.lit(0).cast("bigint"), lambda a, e: a + F.coalesce(e["value"], F.lit(0)))
    total = F.aggregate(entries, F.lit(0).cast("bigint"), lambda a, e: a + F.coalesce(e["value"], F.lit(0)))
    return F.coalesce(one, F.lit(0).cast("bigint")), F.coalesce(total, F.lit(0).cast("bigint"))


def reason_of(dead: Column, disabled: Column, pushed: Column, own: Column, share: Column) -> Column:
    """The first rule that excludes a repository, or ok. An empty or null push date isn't stale."""
    return (
        F.when(dead, "dead_or_renamed")
        .when(disabled, "disabled")
        .when((F.coalesce(pushed, F.lit("")) != "") & (pushed < CUTOFF), "stale")
        .when((own < LEAST_BYTES) | (share < LEAST_SHARE), "not_swift")
        .otherwise("ok")
    )


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, total = language_bytes("entries", LANGUAGE)
    rows = base.repos(spark, sf_dir).withColumns({"own_bytes": own, "all_bytes": total})
    rows = rows.withColumn("share", F.round(F.col("own_bytes") / F.greatest("all_bytes", F.lit(1)) + 1e-9, 4))
    never = F.lit(False)
    return rows.withColumn("reason", reason_of(F.col("sha").isNull(), never, F.col("pushed_at"), F.col("own_bytes"), F.col("share")))


def language_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).select("repo", "own_bytes", "all_bytes", "share")


def gate_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).select("repo", "pushed_at", "reason")


def gate_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).groupBy("reason").agg(F.count(F.lit(1)).alias("repos"))


def included_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What later stages read of an included repository; most stars first."""
    return _gated(spark, sf_dir).where("reason = 'ok'").select("repo", "default_branch", "stars", "pushed_at", "own_bytes", "share").orderBy(F.desc("stars"), F.asc("repo"))


def candidates(rows: DataFrame, owner: str, repo: str, category: str, seen: list[str], self_name: tuple[str, str] = ("", "")) -> DataFrame:
    """(owner, repo, categories array) per case-folded name: the first spelling by ``seen``, categories as a sorted set.

    Names reserved by the host, empty names and one's own list are left out.
    """
    clean = rows.withColumn("__repo", link_repo(repo)).where(f"coalesce({owner}, '') <> '' and coalesce(__repo, '') <> ''")
    clean = clean.where(~F.lower("__repo").isin(RESERVED) & ~((F.lower(owner) == self_name[0]) & (F.lower("__repo") == self_name[1])))
    first = F.min(F.struct(*seen, F.col(owner).alias("owner"), F.col("__repo").alias("repo"))).alias("__first")
    out = clean.groupBy(F.lower(owner).alias("__o"), F.lower("__repo").alias("__r")).agg(first, F.array_sort(F.collect_set(category)).alias("categories"))
    return out.select("__first.owner", "__first.repo", "categories")


def candidate_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of all scans; categories as text."""
    rows = table(spark, sf_dir, "repos").select("owner", "repo", "scanned_at", F.explode_outer("categories").alias("category"))
    return candidates(rows, "owner", "repo", "category", ["scanned_at"]).select("owner", "repo", F.array_join("categories", ",").alias("categories"))


def merge_discoveries(known: DataFrame, run: DataFrame) -> DataFrame:
    """(full_name, term, hits) of earlier runs and a new one -> one table with the same key: terms add up, nothing is lost."""
    return known.unionByName(run).groupBy("full_name", "term").agg(F.sum("hits").alias("hits"))


def discovery_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repository the terms that found it in any scan, and the hits; the latest scan is merged into the earlier ones."""
    rows = table(spark, sf_dir, "repos").where("full_name is not null").select(clean_repo("full_name").alias("full_name"), "scanned_at", F.explode("found_by").alias("term"))
    hits = rows.groupBy("full_name", "term", "scanned_at").agg(F.count(F.lit(1)).alias("hits"))
    last = hits.groupBy("full_name").agg(F.max("scanned_at").alias("last"))
    marked = hits.join(last, "full_name")
    merged = merge_discoveries(marked.where("scanned_at < last").select("full_name", "term", "hits"), marked.where("scanned_at = last").select("full_name", "term", "hits"))
    return merged.groupBy("full_name").agg(F.array_join(F.array_sort(F.collect_list("term")), ",").alias("terms"), F.sum("hits").alias("hits"))


def pending(todo: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in the log of processed keys; a null key is never in it."""
    return todo.join(log.select(key).distinct(), key, "left_anti")


def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories of which no example has been captured yet."""
    return pending(base.repos(spark, sf_dir).select("repo", "stars"), base.examples(spark, sf_dir), "repo")


def membership_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repository with whether examples, files or occurrences know it; new if none does."""
    out = base.repos(spark, sf_dir).select("repo")
    known = {
        "in_examples": base.examples(spark, sf_dir).select("repo"),
        "in_files": base.files(spark, sf_dir).select("repo"),
        "in_occurrences": table(spark, sf_dir, "occurrences").select(clean_repo("repo").alias("repo")),
    }
    for name, rows in known.items():
        out = out.join(rows.where("repo is not null").distinct().withColumn(name, F.lit(True)), "repo", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out.withColumn("is_new", ~F.col("in_examples") & ~F.col("in_files") & ~F.col("in_occurrences"))


QUERIES = {f.__name__: f for f in (language_share, gate_reason, gate_histogram, included_repos, candidate_dedup, discovery_merge, resume_anti_join, membership_flags)}

_LINK = r"regexp_replace(regexp_replace(regexp_replace(trim(repo, E' \t\n\r'), '[#?].*$', ''), '\.git$', ''), '[).,;:*\"''`]+$', '')"
_GATED = f"""with {base.REPOS_SQL},
    b as (select *, coalesce(languages['{LANGUAGE}'], 0) as own_bytes, coalesce(list_sum(map_values(languages)), 0)::bigint as all_bytes from reps),
    s as (select *, round(own_bytes::double / greatest(all_bytes, 1) + 1e-9, 4) as share from b),
    g as (select *, case when sha is null then 'dead_or_renamed' when coalesce(pushed_at, '') <> '' and pushed_at < '{CUTOFF}' then 'stale'
                    when own_bytes < {LEAST_BYTES} or share < {LEAST_SHARE}::double then 'not_swift' else 'ok' end as reason from s)"""

SQL = {
    "language_share": f"{_GATED} select repo, own_bytes, all_bytes, share from g",
    "gate_reason": f"{_GATED} select repo, pushed_at, reason from g",
    "gate_histogram": f"{_GATED} select reason, count(*) as repos from g group by reason",
    "included_repos": f"{_GATED} select repo, default_branch, stars, pushed_at, own_bytes, share from g where reason = 'ok'",
    "candidate_dedup": f"""with r as (select owner, {_LINK} as repo, scanned_at, categories from repos),
        k as (select * from r where coalesce(owner, '') <> '' and coalesce(repo, '') <> '' and lower(repo) not in ({base.quoted(RESERVED)})),
        f as (select *, row_number() over (partition by lower(owner), lower(repo) order by scanned_at, owner, repo) as rn from k),
        c as (select lower(owner) as o, lower(repo) as r, string_agg(distinct category, ',' order by category) as categories from (select owner, repo, unnest(categories) as category from k) group by all)
        select f.owner, f.repo, coalesce(c.categories, '') as categories from f left join c on c.o = lower(f.owner) and c.r = lower(f.repo) where rn = 1""",
    "discovery_merge": f"""with t as (select {base.REPO.format('full_name')} as full_name, unnest(found_by) as term from repos where full_name is not null),
        h as (select full_name, term, count(*) as hits from t group by all)
        select full_name, string_agg(term, ',' order by term) as terms, sum(hits)::bigint as hits from h group by full_name""",
    "resume_anti_join": f"with {base.REPOS_SQL}, {base.EXAMPLES_SQL} select repo, stars from reps where not exists (select 1 from ex where ex.repo = reps.repo)",
    "membership_flags": f"""with {base.REPOS_SQL}, {base.EXAMPLES_SQL}, {base.FILES_SQL},
        o as (select distinct {base.REPO.format('repo')} as repo from occurrences),
        m as (select repo, repo in (select repo from ex where repo is not null) as in_examples, repo in (select repo from files where repo is not null) as in_files,
                     repo in (select repo from o where repo is not null) as in_occurrences from reps)
        select *, not in_examples and not in_files and not in_occurrences as is_new from m""",
}
