"""The usage catalog: what each symbol is used for, where, how often, in which shapes and with what else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spandrel.functions.names import arg_shape, example_key, is_poor_snippet, permalink, style_category
from spandrel.operators.topk import diverse_top_k, first_per_key, keep_or_all, page, recommended_and_diverse, top_k
from spandrel.plans import base
from spandrel.plans.profiles import SCORES_SQL, quality_scores, repo_symbols
from spandrel.sources.tables import table

#: A symbol in fewer repositories has a small corpus; shapes stored and shown; examples kept per symbol.
LOW_CORPUS, SHAPES, SHAPES_SHOWN, EXAMPLES, PAGE = 10, 15, 6, 25, 6
#: Fixed values of co-occurrence: repositories with the symbol, with both, lift, share from which a symbol is everywhere.
LEAST_REPOS, LEAST_BOTH, LEAST_LIFT, UBIQUITOUS, CO_SHOWN, CO_MODIFIERS = 5, 5, 1.5, 0.8, 8, 12
#: Symbols of another platform that say nothing here.
NOISE = ["immersionStyle", "ornament", "onImmersionChange", "dragConfiguration"]
ENV_KEY = r"\\\.([A-Za-z_]\w*)"


def usage_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per (dim, sym): uses, repositories and whether the corpus is small; two levels, so a hot symbol combines per repository first."""
    per_repo = base.matched(spark, sf_dir).groupBy("dim", "sym", "repo").agg(F.count(F.lit(1)).alias("n"))
    out = per_repo.groupBy("dim", "sym").agg(F.sum("n").alias("total_uses"), F.count("repo").alias("repo_count"))
    return out.withColumn("low_corpus", F.col("repo_count") < LOW_CORPUS)


def dimension_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind and dimension (null: none) the uses and different symbols."""
    rows = base.uses(spark, sf_dir).groupBy("kind", "dim", "sym").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("kind", "dim").agg(F.sum("n").alias("uses"), F.count(F.lit(1)).alias("symbols"))


def top_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten repositories that use each symbol most; ties by name."""
    per_repo = base.matched(spark, sf_dir).groupBy("dim", "sym", "repo").agg(F.count(F.lit(1)).alias("uses"))
    return top_k(per_repo, ["dim", "sym"], [F.desc("uses"), F.asc("repo")], 10)


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per (dim, sym, shape): uses, share of all shaped uses; the most used shapes first, then those of at least a hundredth."""
    rows = base.matched(spark, sf_dir, "args").withColumn("shape", arg_shape("args", "trailing_closure")).where("shape is not null")
    counts = rows.groupBy("dim", "sym", "shape").agg(F.count(F.lit(1)).alias("uses"))
    totals = counts.groupBy("dim", "sym").agg(F.sum("uses").alias("total"))
    top = top_k(counts, ["dim", "sym"], [F.desc("uses"), F.asc("shape")], SHAPES)
    return top.join(totals, ["dim", "sym"]).where(F.col("uses") * 100 >= F.col("total"))


def arg_shape_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shapes(spark, sf_dir).select("dim", "sym", "rank", "shape", "uses")


def consensus_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first shapes of each symbol with their percentage of the stored ones."""
    kept = _shapes(spark, sf_dir).withColumn("stored", F.sum("uses").over(W.partitionBy("dim", "sym")))
    return kept.where(F.col("rank") <= SHAPES_SHOWN).select("dim", "sym", "rank", "shape", "uses", F.expr("cast((200 * uses + stored) div (2 * stored) as int)").alias("percent"))


def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first use of each symbol in each repository by path, line and column: an aggregate, no window over a hot symbol."""
    rows = base.matched(spark, sf_dir, "path", "line", "col", "src", "args").withColumn("shape", arg_shape("args", "trailing_closure"))
    first = first_per_key(rows, ["dim", "sym", "repo"], ["path", "line", "col", "occ_id"], ["src", "shape"])
    links = base.repos(spark, sf_dir).select("repo", "permalink_base")
    return first.join(links, "repo", "left").select(
        "dim", "sym", "repo", example_key("repo", "path", "line").alias("example_id"), "path", "line", "src", "shape", permalink("permalink_base", "path", "line").alias("permalink")
    )


def first_seen_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_seen(spark, sf_dir).select("dim", "sym", "repo", "example_id", "path", "line", "permalink")


def _order() -> list[Column]:
    """Rank of examples: whole snippets, then the repository's score and stars, then its name."""
    return [F.asc("poor"), F.desc("score"), F.desc("stars"), F.asc("repo")]


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = first_seen(spark, sf_dir).withColumn("poor", is_poor_snippet("src").cast("int"))
    scored = rows.join(quality_scores(spark, sf_dir).select("repo", "score", "stars", "platform"), "repo")
    return diverse_top_k(scored, ["dim", "sym"], "shape", _order(), EXAMPLES)


def ranked_examples_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 25 examples a symbol: the best of each shape first, then the rest."""
    return _ranked(spark, sf_dir).select("dim", "sym", "rank", "repo", "example_id", "shape")


def recommended_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the ranked examples the first, and the next three whose shapes differ from it and each other."""
    return recommended_and_diverse(_ranked(spark, sf_dir), ["dim", "sym"], "shape", "rank", 3).select("dim", "sym", "role", "rank", "example_id")


def examples_page(spark: SparkSession, sf_dir: str, number: int = 2, size: int = PAGE) -> DataFrame:
    """The second page of every symbol's examples (from the shipped ones), and whether another page follows."""
    rows = base.examples(spark, sf_dir).where("sym is not null")
    return page(rows, ["sym"], [F.desc_nulls_last("score"), F.desc_nulls_last("stars"), F.asc("example_id")], number, size).select("sym", "rank", "example_id", "more")


def platform_filter_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples of the desktop platform; all of a symbol that has none."""
    rows = base.examples(spark, sf_dir).where("sym is not null")
    return keep_or_all(rows, ["sym"], F.col("platform") == "macos").select("sym", "example_id", "platform")


def environment_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses per environment key: those mined from the arguments of Environment attributes, and its key paths, apart."""
    rows = base.uses(spark, sf_dir, "args")
    known = F.broadcast(base.dimensions(spark, sf_dir).where(F.array_contains("dims", "environmentKeys")).select(F.col("sym").alias("key")))
    mined = rows.where("kind = 'attribute' and sym = 'Environment'").select("repo", F.explode("args").alias("arg")).select("repo", F.explode(F.regexp_extract_all("arg", F.lit(ENV_KEY), F.lit(1))).alias("key"))
    both = mined.join(known, "key").select("key", "repo", F.lit("mined").alias("via")).unionByName(rows.where("dim = 'environmentKeys'").select(F.col("sym").alias("key"), "repo", F.lit("keypath").alias("via")))
    return both.groupBy("key", "via").agg(F.count(F.lit(1)).alias("uses"), F.countDistinct("repo").alias("repos"))


def usage_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols in use with their availability; a symbol without an entry keeps nulls."""
    seen = base.matched(spark, sf_dir).groupBy("sym").agg(F.count(F.lit(1)).alias("uses"))
    return seen.join(F.broadcast(base.availability(spark, sf_dir)), "sym", "left").select("sym", "uses", "introduced", "deprecated", "renamed")


def style_value_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Style values with their category by the type in which they are used first by name, else other."""
    known = table(spark, sf_dir, "symbol_catalog").where("dim = 'styleValues' and sym is not null").select("sym").distinct()
    parents = base.matched(spark, sf_dir, "scope").where("dim = 'styleValues' and scope is not null").groupBy("sym").agg(F.min("scope").alias("scope"))
    return known.join(parents, "sym", "left").select("sym", style_category("scope").alias("category"))


# ---- Co-occurrence per repository


def symbol_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories per symbol of modifiers, types and property wrappers, and whether it is in more than four fifths of all."""
    n = base.repos(spark, sf_dir).count()
    freq = repo_symbols(spark, sf_dir).groupBy("sym").agg(F.count(F.lit(1)).alias("repos"))
    return freq.withColumn("n_repos", F.lit(n).cast("bigint")).withColumn("ubiquitous", F.col("repos") * 5 > F.col("n_repos") * 4)


def cooccurrence_lift(spark: SparkSession, sf_dir: str, least_lift: float = LEAST_LIFT) -> DataFrame:
    """Per symbol the eight others used most above chance in the same repositories.

    Symbols of at least five repositories, both in at least five, lift before rounding at least ``least_lift``; symbols
    that are nearly everywhere and noise don't come out as partners. A repository is one basket of at most a few
    hundred catalogue symbols, so the self join is bounded per basket; symbols in too few repositories leave before it.
    """
    own = repo_symbols(spark, sf_dir)
    freq = symbol_frequency(spark, sf_dir)
    left = own.join(F.broadcast(freq.where(F.col("repos") >= LEAST_REPOS).select("sym", F.col("repos").alias("n"))), "sym")
    partners = freq.where((F.col("repos") >= LEAST_BOTH) & ~F.col("ubiquitous") & ~F.col("sym").isin(NOISE)).select("sym", F.col("repos").alias("g"), "n_repos")
    right = own.join(F.broadcast(partners), "sym").withColumnRenamed("sym", "other")
    both = left.join(right, "repo").where("sym <> other").groupBy("sym", "other", "n", "g", "n_repos").agg(F.count(F.lit(1)).alias("repos")).where(F.col("repos") >= LEAST_BOTH)
    lift = (F.col("repos") / F.col("n")) / (F.col("g") / F.col("n_repos"))
    kept = both.where(lift >= least_lift).withColumn("lift", F.round(lift + 1e-9, 1))
    return top_k(kept, ["sym"], [F.desc("lift"), F.desc("repos"), F.asc("other")], CO_SHOWN).select("sym", "rank", "other", "lift", "repos")


#: Anchors whose company is reported.
ANCHORS = ["MenuBarExtra", "searchable", "NavigationSplitView", "Text", "padding"]


def anchored_comodifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per anchor the twelve modifiers in most of the repositories that have it, the anchor itself among them."""
    own = repo_symbols(spark, sf_dir)
    anchors = own.where(F.col("sym").isin(ANCHORS)).select("repo", F.col("sym").alias("anchor"))
    modifiers = base.matched(spark, sf_dir).where("dim = 'modifiers'").select("repo", "sym").distinct()
    counts = anchors.join(modifiers, "repo").groupBy("anchor", "sym").agg(F.count(F.lit(1)).alias("repos"))
    return top_k(counts, ["anchor"], [F.desc("repos"), F.asc("sym")], CO_MODIFIERS).select("anchor", "rank", "sym", "repos")


QUERIES = {
    f.__name__: f
    for f in (
        usage_index, dimension_counts, top_repos, arg_shape_top, consensus_share, first_seen_example, ranked_examples_diverse, recommended_examples, examples_page,
        platform_filter_fallback, environment_keys, usage_availability, style_value_categories, symbol_frequency, cooccurrence_lift, anchored_comodifiers,
    )
}

_U = f"with {base.USES_SQL}"
_SHAPES = f"""{_U},
    c as (select dim, sym, {base.SHAPE_SQL} as shape, count(*) as uses from matched where {base.SHAPE_SQL} is not null group by all),
    r as (select *, row_number() over (partition by dim, sym order by uses desc, shape) as rank, sum(uses) over (partition by dim, sym) as total from c),
    k as (select *, sum(uses) over (partition by dim, sym) as stored from r where rank <= {SHAPES} and uses * 100 >= total)"""
_FIRST = f"""{_U}, {base.REPOS_SQL},
    f0 as (select *, {base.SHAPE_SQL} as shape, row_number() over (partition by dim, sym, repo order by path, line, col, occ_id) as rn from matched),
    f1 as (select f0.dim, f0.sym, f0.repo, 'ex_' || substr(md5(f0.repo || ':' || path || ':' || line), 1, 10) as example_id, path, line, src, shape,
                  permalink_base || path || '#L' || line as permalink from f0 left join reps on reps.repo = f0.repo where rn = 1)"""
_POOR = r"case when trim(coalesce(src, ''), E' \t\n\r') = '' or length(trim(src, E' \t\n\r')) < 12 or right(trim(src, E' \t\n\r'), 1) in ('(', '{', ',') then 1 else 0 end"
_RANKED = f"""{_FIRST}, {SCORES_SQL},
    s0 as (select f1.*, {_POOR} as poor, scores.score, scores.stars from f1 join scores on scores.repo = f1.repo),
    s1 as (select *, row_number() over (partition by dim, sym, shape order by poor, score desc, stars desc, repo) as nth from s0),
    s2 as (select *, row_number() over (partition by dim, sym order by (nth > 1)::int, poor, score desc, stars desc, repo) as rank from s1),
    s3 as (select * from s2 where rank <= {EXAMPLES})"""
_SYMS = f"""{_U}, {base.REPOS_SQL},
    rs as (select distinct repo, sym from matched where dim in ('modifiers', 'types', 'propertyWrappers')),
    nr as (select count(*) as n_repos from reps),
    fr as (select sym, count(*) as repos from rs group by sym),
    fq as (select sym, repos, n_repos, repos * 5 > n_repos * 4 as ubiquitous from fr, nr)"""

SQL = {
    "usage_index": f"{_U} select dim, sym, count(*) as total_uses, count(distinct repo) as repo_count, count(distinct repo) < {LOW_CORPUS} as low_corpus from matched group by dim, sym",
    "dimension_counts": f"{_U} select kind, dim, count(*) as uses, count(distinct sym) as symbols from uses group by kind, dim",
    "top_repos": f"{_U} select * from (select dim, sym, repo, count(*) as uses, row_number() over (partition by dim, sym order by count(*) desc, repo)::int as rank from matched group by dim, sym, repo) where rank <= 10",
    "arg_shape_top": f"{_SHAPES} select dim, sym, rank::int as rank, shape, uses from k",
    "consensus_share": f"{_SHAPES} select dim, sym, rank::int as rank, shape, uses, ((200 * uses + stored) // (2 * stored))::int as percent from k where rank <= {SHAPES_SHOWN}",
    "first_seen_example": f"{_FIRST} select dim, sym, repo, example_id, path, line, permalink from f1",
    "ranked_examples_diverse": f"{_RANKED} select dim, sym, rank::int as rank, repo, example_id, shape from s3",
    "recommended_examples": f"""{_RANKED},
        h as (select dim, sym, shape as first_shape from s3 where rank = 1),
        d as (select s3.*, row_number() over (partition by s3.dim, s3.sym, shape order by rank) as k from s3 join h using (dim, sym) where shape is distinct from first_shape),
        e as (select *, row_number() over (partition by dim, sym order by rank) as j from d where k = 1)
        select dim, sym, 'recommended' as role, rank::int as rank, example_id from s3 where rank = 1
        union all select dim, sym, 'diverse', rank::int, example_id from e where j <= 3""",
    "examples_page": f"""with {base.EXAMPLES_SQL},
        r as (select sym, example_id, row_number() over (partition by sym order by score desc nulls last, stars desc nulls last, example_id) as rank,
                     count(*) over (partition by sym) as n from ex where sym is not null)
        select sym, rank::int as rank, example_id, n > {2 * PAGE} as more from r where rank > {PAGE} and rank <= {2 * PAGE}""",
    "platform_filter_fallback": f"""with {base.EXAMPLES_SQL},
        a as (select *, bool_or(coalesce(platform = 'macos', false)) over (partition by sym) as any_mac from ex where sym is not null)
        select sym, example_id, platform from a where platform = 'macos' or not any_mac""",
    "environment_keys": f"""{_U},
        m as (select repo, unnest(regexp_extract_all(arg, '\\\\\\.([A-Za-z_]\\w*)', 1)) as key from (select repo, unnest(args) as arg from uses where kind = 'attribute' and sym = 'Environment')),
        b as (select key, repo, 'mined' as via from m where key in (select sym from symbol_catalog where dim = 'environmentKeys')
              union all select sym, repo, 'keypath' from uses where dim = 'environmentKeys')
        select key, via, count(*) as uses, count(distinct repo) as repos from b group by key, via""",
    "usage_availability": f"""{_U}, {base.AVAIL_SQL}
        select u.sym, uses, introduced, deprecated, renamed from (select sym, count(*) as uses from matched group by sym) u left join avail on avail.sym = u.sym""",
    "style_value_categories": f"""{_U},
        p as (select sym, min(scope) as scope from matched where dim = 'styleValues' and scope is not null group by sym)
        select k.sym, case when scope like '%Style' then 'controlStyle' when scope = 'Color' then 'color' when scope = 'Material' then 'material'
               when scope like '%Alignment' or scope in ('UnitPoint', 'Edge', 'Axis') then 'alignment' when scope = 'Edge.Set' then 'edge' when scope like '%Placement' then 'placement'
               when scope in ('Visibility', 'Prominence', 'ControlSize', 'ContentMode') then 'appearance' else 'other' end as category
        from (select distinct sym from symbol_catalog where dim = 'styleValues' and sym is not null) k left join p on p.sym = k.sym""",
    "symbol_frequency": f"{_SYMS} select sym, repos, n_repos, ubiquitous from fq",
    "cooccurrence_lift": f"""{_SYMS},
        p as (select a.sym, b.sym as other, count(*) as repos from rs a join rs b on a.repo = b.repo and a.sym <> b.sym group by all),
        l as (select p.sym, p.other, p.repos, (p.repos / x.repos) / (y.repos / y.n_repos) as lift from p join fq x on x.sym = p.sym join fq y on y.sym = p.other
              where x.repos >= {LEAST_REPOS} and p.repos >= {LEAST_BOTH} and not y.ubiquitous and p.other not in ({base.quoted(NOISE)})),
        r as (select sym, other, repos, round(lift + 1e-9, 1) as lift from l where lift >= {LEAST_LIFT})
        select * from (select sym, row_number() over (partition by sym order by lift desc, repos desc, other)::int as rank, other, lift, repos from r) where rank <= {CO_SHOWN}""",
    "anchored_comodifiers": f"""{_SYMS},
        a as (select repo, sym as anchor from rs where sym in ({base.quoted(ANCHORS)})),
        m as (select distinct repo, sym from matched where dim = 'modifiers')
        select * from (select anchor, row_number() over (partition by anchor order by count(*) desc, m.sym)::int as rank, m.sym, count(*) as repos from a join m using (repo) group by anchor, m.sym)
        where rank <= {CO_MODIFIERS}""",
}

