"""Resolution of names and intents, and suggestions for names that nothing has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spandrel.functions.names import tokens
from spandrel.operators.topk import keep_or_all, top_k
from spandrel.plans import base
from spandrel.sources.tables import table

#: The order in which a name is looked up in the dimensions, and suggestions shown.
LOOKUP_ORDER = ["modifiers", "propertyWrappers", "macros", "valueBuilders", "styleValues", "types", "environmentKeys"]
SUGGESTED = 5
#: Queries that the reports below answer; the operators take any table of queries.
ASKED = ["paddin", "navigationstak", "button style", "zzz", "color", "sheet presentation", "text field style", "PADDING", "vstack"]
#: Intents, each with the names and recipes that serve it.
ALIASES = [
    ("modal sheet", ["sheet", "popover", "alert"], ["present-sheet"]), ("text input", ["TextField", "SecureField", "Text"], ["form-input"]),
    ("layout spacing", ["padding", "frame", "VStack"], []), ("navigation", ["NavigationStack", "NavigationSplitView"], ["split-view"]), ("button", ["Button", "buttonStyle"], ["button-row"]),
]
RECIPES = [("present-sheet", ["sheet", "Button"]), ("form-input", ["TextField", "Form"]), ("split-view", ["NavigationSplitView", "List"]), ("button-row", ["Button", "HStack", "padding"])]


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sym, dim) of the shipped catalogue, a table of fixed size."""
    return table(spark, sf_dir, "symbol_catalog").where("sym is not null and dim is not null").select("sym", "dim").distinct()


def resolve_names(names: DataFrame, known: DataFrame) -> DataFrame:
    """(query) -> (query, sym, dim): the exact name first, then one that differs in case; dimensions in lookup order.

    Both are equi-joins on the lower-case name; names that nothing has don't come out.
    """
    place = F.array_position(F.array(*map(F.lit, LOOKUP_ORDER)), F.col("dim"))
    pairs = names.select("query", F.lower("query").alias("low")).join(known.select("sym", "dim", F.lower("sym").alias("low")), "low")
    order = [(F.col("sym") == F.col("query")).desc(), place.asc(), F.asc("sym")]
    return top_k(pairs, ["query"], order, 1).select("query", "sym", "dim")


def resolve_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every symbol of the examples, and the same in lower case, resolved."""
    seen = base.examples(spark, sf_dir).where("sym is not null").select("sym")
    names = seen.select(F.col("sym").alias("query")).unionByName(seen.select(F.lower("sym").alias("query"))).distinct()
    return resolve_names(names, symbols(spark, sf_dir))


def suggest(queries: DataFrame, known: DataFrame, limit: int) -> DataFrame:
    """(query) -> (query, rank, sym): names for a query that nothing matches.

    One word: names that contain it, shortest first, else the nearest by edit distance. Several words: names that
    contain most of them, shortest first, else the nearest to the longest word. Queries are few and typed by people,
    ``known`` is the catalogue's fixed list of names, so every query meets every name.
    """
    q = queries.select("query", tokens("query", 2).alias("t")).withColumn("low", F.when(F.size("t") > 0, F.col("t")[0]).otherwise(F.lower("query")))
    longest = F.reduce("t", F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    q = q.withColumn("many", F.size("t") > 1).withColumn("near", F.when(F.col("many"), longest).otherwise(F.col("low")))
    names = known.select("sym").distinct().withColumn("l", F.lower("sym"))
    pairs = q.join(F.broadcast(names), F.lit(True))
    hits = F.when(F.col("many"), F.size(F.filter("t", lambda x: F.contains(F.col("l"), x)))).otherwise(F.contains("l", "low").cast("int"))
    pairs = pairs.select("query", "sym", hits.alias("hits"), F.length("sym").alias("len"), F.levenshtein("l", "near").alias("distance"))
    best = F.max("hits").over(W.partitionBy("query")) > 0
    kept = pairs.withColumn("any", best).where(~F.col("any") | (F.col("hits") > 0))
    order = [F.when(F.col("any"), -F.col("hits")).asc(), F.when(F.col("any"), F.col("len")).otherwise(F.col("distance")).asc(), F.asc("sym")]
    return top_k(kept, ["query"], order, limit).select("query", "rank", "sym")


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(q,) for q in ASKED], "query string")


def suggest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggest(_asked(spark), symbols(spark, sf_dir), SUGGESTED)


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ALIASES, "intent string, apis array<string>, recipes array<string>")


def match_intents(queries: DataFrame, known: DataFrame) -> DataFrame:
    """(query, intent, apis, recipes): an intent matches if either text contains the other, if they share a word of four
    letters, or if the query is one of its names. Intents are a curated list of some dozens."""
    q = queries.select("query", F.lower("query").alias("low"), tokens("query", 4).alias("words"))
    a = F.broadcast(known.select("intent", "apis", "recipes", tokens("intent", 4).alias("own")))
    hit = F.contains("low", "intent") | F.contains("intent", "low") | F.arrays_overlap("words", "own") | F.exists("apis", lambda x: F.lower(x) == F.col("low"))
    return q.join(a, hit).select("query", "intent", "apis", "recipes")


def intent_alias_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_intents(_asked(spark), aliases(spark)).select("query", "intent", F.array_join("apis", ",").alias("apis"))


def resolve_intents(queries: DataFrame, known: DataFrame, names: DataFrame) -> DataFrame:
    """(query, rank, sym): names of matching intents in their order, then names that contain the query, shortest first; each once."""
    alias = match_intents(queries, known).select("query", "intent", F.posexplode("apis").alias("pos", "sym")).select("query", "sym", F.struct(F.lit(0).alias("a"), F.lit(0).alias("n"), F.col("intent").alias("t"), "pos").alias("o"))
    own = queries.join(F.broadcast(names.select("sym").distinct()), F.contains(F.lower("sym"), F.lower("query")))
    subs = own.select("query", "sym", F.struct(F.lit(1).alias("a"), F.length("sym").alias("n"), F.col("sym").alias("t"), F.lit(0).alias("pos")).alias("o"))
    once = alias.unionByName(subs).groupBy("query", "sym").agg(F.min("o").alias("o"))
    return once.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("o"))).select("query", "rank", "sym")


def intent_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_intents(_asked(spark), aliases(spark), symbols(spark, sf_dir))


def recipes_by_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipes that name a symbol of the catalogue."""
    recipes = spark.createDataFrame(RECIPES, "recipe string, apis array<string>")
    return recipes.select("recipe", F.explode("apis").alias("sym")).join(symbols(spark, sf_dir).select("sym").distinct(), "sym", "left_semi")


def recipe_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples per recipe: those whose snippet names one of its symbols; all of its symbols' examples if none does."""
    recipes = spark.createDataFrame(RECIPES, "recipe string, apis array<string>")
    rows = recipes.select("recipe", "apis", F.explode("apis").alias("sym")).join(base.examples(spark, sf_dir).select("example_id", "sym", "src"), "sym")
    named = F.exists("apis", lambda a: F.contains(F.coalesce("src", F.lit("")), F.concat(a, F.lit("("))))
    return keep_or_all(rows, ["recipe"], named).select("recipe", "example_id")


def example_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index from example id to its place, with the parts of its permalink."""
    from spandrel.functions.names import parse_permalink

    rows = base.examples(spark, sf_dir).withColumn("at", parse_permalink("permalink"))
    return rows.select("example_id", "repo", "path", "line", F.col("at.owner").alias("link_owner"), F.col("at.repo").alias("link_repo"), F.col("at.sha").alias("link_sha"), F.col("at.line").alias("link_line"))


QUERIES = {f.__name__: f for f in (resolve_precedence, suggest_names, intent_alias_join, intent_resolution, recipes_by_symbol, recipe_examples, example_locations)}


def _list(values: list[str]) -> str:
    return f"[{base.quoted(values)}]::varchar[]"


_Q = "(values " + ", ".join(f"('{q}')" for q in ASKED) + ") q(query)"
_A = "(values " + ", ".join(f"('{i}', {_list(a)}, {_list(r)})" for i, a, r in ALIASES) + ") a(intent, apis, recipes)"
_R = "(values " + ", ".join(f"('{n}', {_list(a)})" for n, a in RECIPES) + ") r(recipe, apis)"
_TOK = "list_filter(string_split_regex(lower({0}), '[^a-z]+'), lambda x: length(x) >= {1})"
_HIT = f"""contains(lower(query), intent) or contains(intent, lower(query)) or list_has_any({_TOK.format('query', 4)}, {_TOK.format('intent', 4)})
    or list_contains(list_transform(apis, lambda x: lower(x)), lower(query))"""
SQL = {
    "resolve_precedence": f"""with {base.EXAMPLES_SQL},
        n as (select sym as query from ex where sym is not null union select lower(sym) from ex where sym is not null),
        s as (select distinct sym, dim from symbol_catalog where sym is not null and dim is not null),
        r as (select query, s.sym, dim, row_number() over (partition by query order by (s.sym = query)::int desc, list_position({_list(LOOKUP_ORDER)}, dim), s.sym) as k from n join s on lower(s.sym) = lower(query))
        select query, sym, dim from r where k = 1""",
    "suggest_names": f"""with n as (select distinct sym, lower(sym) as l from symbol_catalog where sym is not null and dim is not null),
        t as (select query, {_TOK.format('query', 2)} as t from {_Q}),
        p as (select query, sym, l, t, case when len(t) > 1 then len(list_filter(t, lambda x: contains(l, x))) else contains(l, coalesce(t[1], lower(query)))::int end as hits,
                     levenshtein(l, case when len(t) > 1 then list_reduce(t, lambda a, x: case when length(x) > length(a) then x else a end) else coalesce(t[1], lower(query)) end) as d from t, n),
        a as (select *, max(hits) over (partition by query) > 0 as any_hit from p),
        r as (select query, sym, row_number() over (partition by query order by case when any_hit then -hits else 0 end, case when any_hit then length(sym) else d end, sym)::int as rank from a where not any_hit or hits > 0)
        select query, rank, sym from r where rank <= {SUGGESTED}""",
    "intent_alias_join": f"select query, intent, array_to_string(apis, ',') as apis from {_Q}, {_A} where {_HIT}",
    "intent_resolution": f"""with m as (select query, unnest(apis) as sym, 0 as a, 0 as n, intent as t, unnest(range(len(apis))) as pos from {_Q}, {_A} where {_HIT}),
        s as (select query, sym, 1 as a, length(sym) as n, sym as t, 0 as pos from {_Q}, (select distinct sym from symbol_catalog where sym is not null and dim is not null) where contains(lower(sym), lower(query))),
        u as (select *, row_number() over (partition by query, sym order by a, n, t, pos) as k from (select * from m union all select * from s))
        select query, row_number() over (partition by query order by a, n, t, pos)::int as rank, sym from u where k = 1""",
    "recipes_by_symbol": f"select recipe, sym from (select recipe, unnest(apis) as sym from {_R}) where sym in (select sym from symbol_catalog where sym is not null and dim is not null)",
    "recipe_examples": f"""with {base.EXAMPLES_SQL},
        e as (select recipe, apis, unnest(apis) as sym from {_R}),
        j as (select recipe, example_id, len(list_filter(apis, lambda x: contains(coalesce(src, ''), x || '('))) > 0 as named from e join ex using (sym)),
        f as (select *, bool_or(named) over (partition by recipe) as any_named from j)
        select recipe, example_id from f where named or not any_named""",
    "example_locations": f"""with {base.EXAMPLES_SQL}, x as (select *, regexp_matches(permalink, '^https?://[^/]+/([^/]+)/([^/]+)/blob/([^/]+)/([^#]+)#L([0-9]+)') as ok from ex)
        select example_id, repo, path, line, {", ".join(f"case when ok then regexp_extract(permalink, '^https?://[^/]+/([^/]+)/([^/]+)/blob/([^/]+)/([^#]+)#L([0-9]+)', {k}){c} end as link_{n}" for k, n, c in ((1, 'owner', ''), (2, 'repo', ''), (3, 'sha', ''), (5, 'line', '::int')))} from x""",
}
