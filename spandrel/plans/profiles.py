"""Profiles, scores, adoption and leaderboards of repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.functions.names import is_demo, version_text, year_of
from spandrel.operators.authority import author_scores, repo_authority
from spandrel.operators.topk import top_k
from spandrel.plans import base
from spandrel.sources.tables import table

#: Fixed values of reports: unmatched symbols a kind and their least repositories, repositories of a deprecated symbol, leaders.
UNMATCHED, UNMATCHED_REPOS, DEPRECATED_REPOS, LEADERS, MODERN_LEADERS, MODERN_LEAST = 40, 3, 8, 50, 30, 30


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different (repo, dim, sym); a hot repository shrinks to the catalogue's few hundred symbols before it is grouped."""
    return base.matched(spark, sf_dir).select("repo", "dim", "sym").distinct()


def repo_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different (repo, sym) of modifiers, types and property wrappers: what co-occurrence looks at."""
    return _symbols(spark, sf_dir).where(F.col("dim").isin("modifiers", "types", "propertyWrappers")).select("repo", "sym").distinct()


def repo_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per repository: symbols per dimension, floor, deprecated symbols, imports, lines of code, platform."""
    syms = _symbols(spark, sf_dir).join(F.broadcast(base.availability(spark, sf_dir)), "sym", "left")
    signal = F.col("dim").isin("types", "modifiers", "propertyWrappers") & F.col("sym").isin(base.PLATFORM_SIGNALS)
    by_repo = syms.groupBy("repo").agg(
        *[F.array_sort(F.collect_set(F.when(F.col("dim") == d, F.col("sym")))).alias(d) for d in base.DIMS],
        F.coalesce(F.max("introduced"), F.lit(0.0)).alias("floor"),
        F.array_sort(F.collect_set(F.when(F.col("deprecated"), F.col("sym")))).alias("deprecated_syms"),
        F.bool_or(signal).alias("signal"),
    )
    own = base.files(spark, sf_dir)
    loc = own.groupBy("repo").agg(F.sum("loc").alias("loc"), F.count(F.lit(1)).alias("files"))
    imports = own.select("repo", F.explode("imports").alias("module")).distinct().groupBy("repo").agg(F.array_sort(F.collect_list("module")).alias("imports"))
    facts = base.repos(spark, sf_dir).join(by_repo, "repo", "left").join(loc, "repo", "left").join(imports, "repo", "left")
    none = F.array().cast("array<string>")
    facts = facts.withColumns({c: F.coalesce(c, none) for c in [*base.DIMS, "deprecated_syms", "imports", "categories", "found_by"]})
    facts = facts.withColumns({"floor": F.coalesce("floor", F.lit(0.0)), "loc": F.coalesce("loc", F.lit(0)), "files": F.coalesce("files", F.lit(0))})
    mac = F.array_contains("imports", "AppKit") | F.coalesce("signal", F.lit(False))
    return facts.withColumn("platform", F.when(mac, "macos").otherwise("other")).withColumn("total_apis", sum(F.size(d) for d in base.DIMS))


def authorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repository the greatest authority that examples state."""
    return base.examples(spark, sf_dir).where("repo is not null").groupBy("repo").agg(F.max("author_authority").alias("authority"))


def score_of(stars: Column, authority: Column, floor: Column, pushed: Column, contributors: Column, deprecated: Column, demo: Column, desktop: Column) -> Column:
    """Quality of a repository in [0, 1]: stars and authority first, then floor, recency and contributors, less penalties.

    Each part is at most 1 before it is weighted; authority is damped by few stars before that. Four decimals.
    """
    one = F.lit(1.0)

    def unit(c: Column) -> Column:
        return F.least(one, F.greatest(F.lit(0.0), c))

    by_stars = F.log10(stars + 1) / 5
    by_author = F.log10(authority + 1) / 6 * F.least(one, (stars + 10) / 60)
    parts = 0.30 * F.least(one, by_stars) + 0.30 * F.least(one, by_author) + 0.15 * unit((floor - 10) / 16) + 0.15 * unit((year_of(pushed) - 2023) / 3) + 0.10 * F.least(one, F.log10(contributors + 1) / 2.5)
    off = F.when(deprecated, 0.30).otherwise(0.0) + F.when(demo, 0.20).otherwise(0.0) + F.when(desktop, 0.0).otherwise(0.25)
    return F.round(F.greatest(F.lit(0.0), parts - off), 4)


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = repo_facts(spark, sf_dir).join(authorities(spark, sf_dir), "repo", "left")
    score = score_of(
        F.col("stars"), F.coalesce("authority", F.lit(0)), F.col("floor"), F.col("pushed_at"), F.size("found_by"),
        F.size("deprecated_syms") > 0, is_demo("repo"), F.col("platform") == "macos",
    )
    return facts.select("repo", "stars", "platform", "floor", F.coalesce("authority", F.lit(0)).alias("authority"), score.alias("score"))


def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and provenance of every repository."""
    return quality_scores(spark, sf_dir).select("repo", "stars", "platform", "authority", version_text("floor").alias("min_macos"), "score")


def repo_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per repository; lists as text, sorted."""
    f = repo_facts(spark, sf_dir)
    counts = [F.size(d).alias(f"n_{d}") for d in base.DIMS]
    return f.select("repo", "stars", "platform", "loc", F.array_join("imports", ",").alias("imports"), version_text("floor").alias("min_macos"), F.array_join("deprecated_syms", ",").alias("deprecated"), *counts, "total_apis")


def _share(c: Column) -> Column:
    """Percentage of rows with one decimal, from integers, so that it is the same on every run."""
    return F.round(F.count_if(c) * F.lit(1000.0) / F.count(F.lit(1)) / 10 + 1e-9, 1)


def adoption_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of repositories per feature, in percent: one row per feature."""
    f = repo_facts(spark, sf_dir)

    def has(dim: str, *syms: str) -> Column:
        return F.arrays_overlap(dim, F.array(*map(F.lit, syms)))

    def imports(module: str) -> Column:
        return F.array_contains("imports", module)

    features = {
        "Observable_macro": has("propertyWrappers", "Observable"), "StateObject": has("propertyWrappers", "StateObject"), "ObservedObject": has("propertyWrappers", "ObservedObject"),
        "NavigationStack_or_Split": has("types", "NavigationStack", "NavigationSplitView"), "NavigationView": has("types", "NavigationView"),
        "SwiftData": has("propertyWrappers", "Model") | imports("SwiftData"), "MenuBarExtra": has("types", "MenuBarExtra"), "Settings_scene": has("types", "Settings"),
        "searchable": has("modifiers", "searchable"), "AppKit_bridging": imports("AppKit"), "Charts_imported": imports("Charts"), "uses_deprecated_api": F.size("deprecated_syms") > 0,
    }
    row = f.agg(F.count(F.lit(1)).alias("repos"), *[_share(c).alias(n) for n, c in features.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("percent")) for n in features])).alias("p")
    return row.select("repos", pairs).select("p.feature", "p.percent", "repos")


def category_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per category of at least two repositories their mean number of different modifiers."""
    rows = repo_facts(spark, sf_dir).select(F.explode("categories").alias("category"), F.size("modifiers").alias("n"))
    out = rows.groupBy("category").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("total")).where("repos >= 2")
    return out.select("category", "repos", F.round(F.col("total") / F.col("repos") + 1e-9, 1).alias("avg_modifiers"))


def category_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.repos(spark, sf_dir).select(F.explode("categories").alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("repos"))


def unmatched_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind the forty most used symbols that are in no dimension, then those of at least three repositories."""
    rows = base.uses(spark, sf_dir).where("dim is null").where(F.col("kind").isin("modifier", "attribute", "type", "member") & F.col("sym").rlike(r"^\p{L}"))
    per_repo = rows.groupBy("kind", "sym", "repo").agg(F.count(F.lit(1)).alias("n"))
    counts = per_repo.groupBy("kind", "sym").agg(F.sum("n").alias("uses"), F.count("repo").alias("repos"))
    return top_k(counts, ["kind"], [F.desc("uses"), F.asc("sym")], UNMATCHED).where(F.col("repos") >= UNMATCHED_REPOS).select("kind", "rank", "sym", "uses", "repos")


def deprecated_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deprecated symbols in use: repositories, replacement, and the eight repositories with most uses."""
    old = F.broadcast(base.availability(spark, sf_dir).where("deprecated"))
    per_repo = base.matched(spark, sf_dir).join(old, "sym").groupBy("sym", "renamed", "repo").agg(F.count(F.lit(1)).alias("n"))
    repos = per_repo.groupBy("sym", "renamed").agg(F.count("repo").alias("repos"))
    top = top_k(per_repo, ["sym"], [F.desc("n"), F.asc("repo")], DEPRECATED_REPOS)
    listed = top.groupBy("sym").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "repo", "n"))), lambda x: F.concat_ws(":", x["repo"], x["n"].cast("string"))), ",").alias("top_repos"))
    return repos.join(listed, "sym").select("sym", "renamed", "repos", "top_repos")


def rankings_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaderboards: most APIs, modifiers and components in use (50 each), and the most modern of those with thirty APIs (30).

    Each board takes its first rows before they are numbered, so no task sorts all repositories.
    """
    f = repo_facts(spark, sf_dir).select("repo", "total_apis", F.size("modifiers").alias("modifiers"), F.size("types").alias("types"), "floor")

    def board(name: str, rows: DataFrame, value: Column, k: int) -> DataFrame:
        first = rows.select(F.lit(name).alias("board"), "repo", value.cast("double").alias("value")).orderBy(F.desc("value"), F.asc("repo")).limit(k)
        return top_k(first, ["board"], [F.desc("value"), F.asc("repo")], k)

    return (
        board("total_apis", f, F.col("total_apis"), LEADERS)
        .unionByName(board("modifiers", f, F.col("modifiers"), LEADERS))
        .unionByName(board("types", f, F.col("types"), LEADERS))
        .unionByName(board("most_modern", f.where((F.col("floor") > 0) & (F.col("total_apis") >= MODERN_LEAST)), F.col("floor"), MODERN_LEADERS))
    )


def corpus_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the corpus: repositories, files, lines, and different symbols in use per dimension."""
    used = _symbols(spark, sf_dir).select("dim", "sym").distinct().groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    own = base.files(spark, sf_dir).agg(F.count(F.lit(1)).alias("files"), F.sum("loc").alias("loc"))
    sizes = own.select(F.explode(F.map_from_arrays(F.array(F.lit("files"), F.lit("loc")), F.array(F.col("files"), F.col("loc")))).alias("name", "n"))
    repos = base.repos(spark, sf_dir).agg(F.count(F.lit(1)).alias("n")).select(F.lit("repos").alias("name"), "n")
    return repos.unionByName(sizes).unionByName(used.select(F.concat(F.lit("symbols:"), "dim").alias("name"), "n"))


def repo_authorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authority per repository from its contributors; here a part is the repository, its suppliers the contributors."""
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("repo"), F.col("l_suppkey").alias("login")).agg(F.count(F.lit(1)).alias("contributions"))
    owners = items.groupBy("repo").agg(F.min("login").alias("owner"))
    scores = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("login"), F.greatest(F.floor("s_acctbal"), F.lit(0)).cast("bigint").alias("score"))
    return repo_authority(items.join(owners, "repo"), scores, 8)


def author_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score per author: the stars of what they own and of what they contributed to, the first hundred of each; here nations, customers and suppliers."""
    owned = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("login"), F.col("c_custkey").alias("repo"), F.greatest(F.floor("c_acctbal"), F.lit(0)).cast("bigint").alias("stars"))
    given = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("login"), F.col("s_suppkey").alias("repo"), F.greatest(F.floor("s_acctbal"), F.lit(0)).cast("bigint").alias("stars"))
    return author_scores(owned, given, 100)


QUERIES = {
    f.__name__: f
    for f in (quality_score, repo_profile, adoption_pct, category_fingerprint, category_histogram, unmatched_topk, deprecated_usage, rankings_top, corpus_index, repo_authorities, author_score)
}

#: Needs matched, files and reps before it.
FACTS_SQL = f"""{base.AVAIL_SQL},
sy as (select distinct repo, dim, sym from matched),
br as (select repo, {", ".join(f"count(distinct case when dim = '{d}' then sym end) as n_{d}, coalesce(list(distinct sym) filter (dim = '{d}'), []) as l_{d}" for d in base.DIMS)},
       coalesce(max(introduced), 0) as floor, coalesce(list_sort(list(distinct sy.sym) filter (deprecated)), []) as old,
       bool_or(dim in ('types', 'modifiers', 'propertyWrappers') and sy.sym in ({base.quoted(base.PLATFORM_SIGNALS)})) as signal
       from sy left join avail using (sym) group by repo),
lo as (select repo, sum(loc) as loc, count(*) as files from files group by repo),
im as (select repo, list_sort(list(distinct module)) as imports from (select repo, unnest(imports) as module from files) group by repo),
facts as (
  select reps.repo, stars, pushed_at, coalesce(categories, []) as categories, coalesce(found_by, []) as found_by, coalesce(floor, 0) as floor, coalesce(old, []) as old,
         coalesce(imports, []) as imports, coalesce(loc, 0)::bigint as loc, {", ".join(f"coalesce(n_{d}, 0)::int as n_{d}, coalesce(l_{d}, []) as l_{d}" for d in base.DIMS)},
         ({" + ".join(f"coalesce(n_{d}, 0)" for d in base.DIMS)})::int as total_apis,
         case when list_contains(coalesce(imports, []), 'AppKit') or coalesce(signal, false) then 'macos' else 'other' end as platform
  from reps left join br on br.repo = reps.repo left join lo on lo.repo = reps.repo left join im on im.repo = reps.repo)"""
_SCORE = """round(greatest(0.0::double, 0.30::double * least(1, log10(stars + 1) / 5) + 0.30::double * least(1, log10(authority + 1) / 6 * least(1.0::double, (stars + 10) / 60))
  + 0.15::double * least(1.0::double, greatest(0, (floor - 10) / 16)) + 0.15::double * least(1.0::double, greatest(0, (coalesce(try_cast(substr(pushed_at, 1, 4) as int), 2023) - 2023) / 3))
  + 0.10::double * least(1, log10(len(found_by) + 1) / 2.5::double)
  - (case when len(old) > 0 then 0.30::double else 0 end + case when regexp_matches(repo, 'sample|example|tutorial|demo|playground', 'i') then 0.20::double else 0 end
     + case when platform = 'macos' then 0 else 0.25::double end)), 4)"""
SCORES_SQL = f"""{FACTS_SQL}, {base.EXAMPLES_SQL},
au as (select repo, max(author_authority) as authority from ex where repo is not null group by repo),
sc as (select facts.*, coalesce(authority, 0) as authority from facts left join au on au.repo = facts.repo),
scores as (select repo, stars, platform, floor, authority, {_SCORE} as score from sc)"""
_TEXT = "case when floor <> 0 then regexp_replace(regexp_replace(printf('%.2f', floor::double), '0+$', ''), '\\.$', '') end"
_F = f"with {base.USES_SQL}, {base.REPOS_SQL}, {FACTS_SQL}"
_PCT = "round(1000.0::double * count(*) filter ({0}) / count(*) / 10 + 1e-9, 1)"
_FEATURES = {
    "Observable_macro": "list_contains(l_propertyWrappers, 'Observable')", "StateObject": "list_contains(l_propertyWrappers, 'StateObject')", "ObservedObject": "list_contains(l_propertyWrappers, 'ObservedObject')",
    "NavigationStack_or_Split": "list_has_any(l_types, ['NavigationStack', 'NavigationSplitView'])", "NavigationView": "list_contains(l_types, 'NavigationView')",
    "SwiftData": "list_contains(l_propertyWrappers, 'Model') or list_contains(imports, 'SwiftData')", "MenuBarExtra": "list_contains(l_types, 'MenuBarExtra')", "Settings_scene": "list_contains(l_types, 'Settings')",
    "searchable": "list_contains(l_modifiers, 'searchable')", "AppKit_bridging": "list_contains(imports, 'AppKit')", "Charts_imported": "list_contains(imports, 'Charts')", "uses_deprecated_api": "len(old) > 0",
}


def _board(name: str, value: str, k: int, where: str = "true") -> str:
    return f"select * from (select '{name}' as board, repo, ({value})::double as value, row_number() over (order by {value} desc, repo)::int as rank from facts where {where}) where rank <= {k}"


SQL = {
    "quality_score": f"with {base.USES_SQL}, {base.REPOS_SQL}, {SCORES_SQL} select repo, stars, platform, authority, {_TEXT} as min_macos, score from scores",
    "repo_profile": f"""{_F} select repo, stars, platform, loc, array_to_string(imports, ',') as imports, {_TEXT} as min_macos, array_to_string(old, ',') as deprecated,
        {", ".join(f"n_{d}" for d in base.DIMS)}, total_apis from facts""",
    "adoption_pct": f"{_F} " + " union all ".join(f"select '{n}' as feature, {_PCT.format(c)} as percent, count(*) as repos from facts" for n, c in _FEATURES.items()),
    "category_fingerprint": f"""{_F} select category, count(*) as repos, round(sum(n_modifiers) / count(*) + 1e-9, 1) as avg_modifiers
        from (select unnest(categories) as category, n_modifiers from facts) group by category having count(*) >= 2""",
    "category_histogram": f"with {base.REPOS_SQL} select category, count(*) as repos from (select unnest(categories) as category from reps) group by category",
    "unmatched_topk": f"""with {base.USES_SQL},
        c as (select kind, sym, count(*) as uses, count(distinct repo) as repos from uses where dim is null and kind in ('modifier', 'attribute', 'type', 'member') and regexp_matches(sym, '^\\p{{L}}') group by kind, sym),
        r as (select *, row_number() over (partition by kind order by uses desc, sym)::int as rank from c)
        select kind, rank, sym, uses, repos from r where rank <= {UNMATCHED} and repos >= {UNMATCHED_REPOS}""",
    "deprecated_usage": f"""with {base.USES_SQL}, {base.AVAIL_SQL},
        p as (select m.sym, renamed, m.repo, count(*) as n from matched m join avail a on a.sym = m.sym and a.deprecated group by all),
        r as (select *, row_number() over (partition by sym order by n desc, repo) as rank from p)
        select sym, any_value(renamed) as renamed, count(repo) as repos, string_agg(repo || ':' || n, ',' order by rank) filter (rank <= {DEPRECATED_REPOS}) as top_repos from r group by sym""",
    "rankings_top": f"{_F} "
    + " union all ".join([_board("total_apis", "total_apis", LEADERS), _board("modifiers", "n_modifiers", LEADERS), _board("types", "n_types", LEADERS), _board("most_modern", "floor", MODERN_LEADERS, f"floor > 0 and total_apis >= {MODERN_LEAST}")]),
    "corpus_index": f"""with {base.USES_SQL}, {base.REPOS_SQL}
        select 'repos' as name, count(*) as n from reps union all select 'files', count(*) from files union all select 'loc', sum(loc)::bigint from files
        union all select 'symbols:' || dim, count(distinct sym) from matched group by dim""",
    "repo_authorities": """with i as (select l_partkey as repo, l_suppkey as login, count(*) as contributions from lineitem group by all),
        o as (select repo, min(login) as owner from i group by repo),
        k as (select i.*, owner, row_number() over (partition by i.repo order by contributions desc, login) as rank from i join o on o.repo = i.repo),
        t as (select k.*, sum(contributions) over (partition by repo) as total, greatest(floor(coalesce(s_acctbal, 0)), 0)::bigint as score from k left join supplier on s_suppkey = login where rank <= 8)
        select repo, floor(max(case when login = owner then score::double else score::double * contributions / total end))::bigint as authority, max(score) as raw_max, count(*) as contributors from t group by repo""",
    "author_score": """with a as (select c_nationkey as login, greatest(floor(c_acctbal), 0)::bigint as stars, row_number() over (partition by c_nationkey order by greatest(floor(c_acctbal), 0) desc, c_custkey) as k from customer),
        b as (select s_nationkey as login, greatest(floor(s_acctbal), 0)::bigint as stars, row_number() over (partition by s_nationkey order by greatest(floor(s_acctbal), 0) desc, s_suppkey) as k from supplier),
        u as (select login, stars, 0 as given from a where k <= 100 union all select login, 0, stars from b where k <= 100)
        select login, sum(stars)::bigint as owned_stars, sum(given)::bigint as given_stars, sum(stars + given)::bigint as score from u group by login""",
}
