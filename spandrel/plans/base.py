"""Tables of the usage corpus in their clean, current form, and the same as SQL for the twins of the queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.functions.names import clean_repo, clean_symbol, version_number
from spandrel.operators.latest import latest_per_key
from spandrel.sources.tables import table

#: Modules whose import makes a file count, and the dimensions in the order of their precedence.
UI_IMPORTS = ["SwiftUI", "SwiftUICore", "Charts"]
DIMS = ["modifiers", "types", "valueBuilders", "macros", "styleValues", "propertyWrappers", "environmentKeys"]
#: Containers that only count with a closure behind them.
CONTAINERS = [
    "Form", "List", "Section", "Group", "VStack", "HStack", "ZStack", "NavigationStack", "NavigationSplitView", "NavigationView", "ScrollView",
    "Table", "Grid", "GridRow", "TabView", "Menu", "DisclosureGroup", "GroupBox", "LazyVGrid", "LazyHGrid", "LazyVStack", "LazyHStack",
    "WindowGroup", "Window", "Settings", "MenuBarExtra", "ToolbarItem", "ToolbarItemGroup",
]
#: Symbols that prove an app of the desktop platform.
PLATFORM_SIGNALS = [
    "MenuBarExtra", "Settings", "NSViewRepresentable", "NSViewControllerRepresentable", "NSHostingController", "windowStyle", "menuBarExtraStyle",
    "windowResizability", "NSApplicationDelegateAdaptor", "HSplitView", "windowToolbarStyle", "onExitCommand",
]


def occurrences(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One row per occ_id, its last delivery, with clean ``sym`` and ``repo`` and the named columns of the table."""
    rows = table(spark, sf_dir, "occurrences").where("sym is not null and occ_id is not null")
    keep = list(dict.fromkeys(["sym", *columns]))
    one = latest_per_key(rows, ["occ_id"], ["ingested_at"], keep).withColumn("sym", clean_symbol("sym"))
    return one.withColumn("repo", clean_repo("repo")) if "repo" in keep else one


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per doc_id, its last scan: doc_id, repo, path, imports, loc, skipped."""
    rows = table(spark, sf_dir, "source_files").where("doc_id is not null")
    return latest_per_key(rows, ["doc_id"], ["scanned_at", "ingested_at"], ["repo", "path", "loc", "skipped", "imports"]).withColumn("repo", clean_repo("repo"))


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per repository, its last scan; ``repo`` is the clean full name, stars at least 0."""
    rows = table(spark, sf_dir, "repos").where("full_name is not null").select(
        clean_repo("full_name").alias("name"), "owner", "sha", "default_branch", "stars", "pushed_at", "categories", F.map_entries("languages").alias("entries"),
        "swift_share", "discovered_via", "found_by", "permalink_base", "scanned_at",
    )
    keep = [c for c in rows.columns if c not in ("name", "scanned_at")]
    return latest_per_key(rows, ["name"], ["scanned_at"], keep).withColumnsRenamed({"name": "repo"}).withColumn("stars", F.greatest(F.coalesce("stars", F.lit(0)), F.lit(0)))


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per example_id, its last capture, with clean sym and repo."""
    rows = table(spark, sf_dir, "examples").where("example_id is not null")
    keep = ["sym", "kind", "repo", "path", "line", "permalink", "src", "shape", "stars", "author_authority", "min_macos", "platform", "score"]
    return latest_per_key(rows, ["example_id"], ["captured_at"], keep).withColumns({"sym": clean_symbol("sym"), "repo": clean_repo("repo")})


def dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per symbol of the shipped catalogue its dimensions. The table has a fixed few hundred rows."""
    known = table(spark, sf_dir, "symbol_catalog").where("sym is not null and dim is not null")
    return known.groupBy("sym").agg(F.array_sort(F.collect_set("dim")).alias("dims"))


def availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per symbol: introduced (the least version, null if none is known), deprecated (all entries are), renamed (the first)."""
    known = table(spark, sf_dir, "symbol_catalog").where("sym is not null")
    v = F.when(F.col("introduced_macos").isNotNull(), version_number("introduced_macos"))
    return known.groupBy("sym").agg(F.min(v).alias("introduced"), F.bool_and(F.coalesce("deprecated", F.lit(False))).alias("deprecated"), F.min(F.when(F.col("renamed") != "", F.col("renamed"))).alias("renamed"))


def dimension_of(kind: Column, sym: Column, dims: Column, implicit: Column, trailing: Column) -> Column:
    """The dimension in which an occurrence counts, or null: by its kind, in fixed precedence, with the container and implicit guards."""

    def has(d: str) -> Column:
        return F.coalesce(F.array_contains(dims, d), F.lit(False))

    closed = ~sym.isin(CONTAINERS) | F.coalesce(trailing, F.lit(False))
    own = F.coalesce(implicit, F.lit(False))
    return (
        F.when((kind == "modifier") & has("modifiers"), "modifiers")
        .when((kind == "modifier") & has("valueBuilders"), "valueBuilders")
        .when((kind == "type") & has("types") & closed, "types")
        .when((kind == "macro") & has("macros"), "macros")
        .when((kind == "member") & own & has("styleValues"), "styleValues")
        .when((kind == "member") & own & has("valueBuilders"), "valueBuilders")
        .when((kind == "attribute") & has("propertyWrappers"), "propertyWrappers")
        .when((kind == "keypath") & has("environmentKeys"), "environmentKeys")
    )


def ui_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where(F.arrays_overlap("imports", F.array(*map(F.lit, UI_IMPORTS)))).select("doc_id")


def uses(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Occurrences of files that import a UI module, with ``dim`` (null if the symbol counts in none)."""
    need = dict.fromkeys(["doc_id", "repo", "kind", "implicit", "trailing_closure", *columns])
    occ = occurrences(spark, sf_dir, *need)
    # The catalogue is of fixed size; files and occurrences are joined on doc_id by shuffle or as AQE decides.
    dims = F.broadcast(dimensions(spark, sf_dir))
    rows = occ.join(ui_files(spark, sf_dir), "doc_id", "left_semi").join(dims, "sym", "left")
    dim = dimension_of(F.col("kind"), F.col("sym"), F.col("dims"), F.col("implicit"), F.col("trailing_closure"))
    return rows.withColumn("dim", dim).drop("dims")


def matched(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return uses(spark, sf_dir, *columns).where("dim is not null")


# ---- The same tables for DuckDB

SYM = r"trim(split_part(regexp_replace(trim({0}, E' \t\n\r'), '^[.@]', ''), '(', 1), E' \t\n\r')"
REPO = r"regexp_replace(lower(trim({0}, E' \t\n\r')), '\.git$', '')"
VERSION = "coalesce(try_cast(split_part({0}, '.', 1) as int) + case when contains({0}, '.') then try_cast(split_part({0}, '.', 2) as int) else 0 end / 100.0::double, 0.0::double)"


def quoted(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


OCC_SQL = f"""
occ as (
  select * exclude (rn, sym, repo), {SYM.format('sym')} as sym, {REPO.format('repo')} as repo
  from (select *, row_number() over (partition by occ_id order by ingested_at desc nulls last) as rn
        from occurrences where sym is not null and occ_id is not null) where rn = 1)"""
FILES_SQL = f"""
files as (
  select doc_id, {REPO.format('repo')} as repo, path, imports, loc, skipped
  from (select *, row_number() over (partition by doc_id order by scanned_at desc nulls last, ingested_at desc nulls last) as rn
        from source_files where doc_id is not null) where rn = 1),
ui as (select doc_id from files where list_has_any(imports, [{quoted(UI_IMPORTS)}]))"""
REPOS_SQL = f"""
reps as (
  select {REPO.format('full_name')} as repo, owner, sha, default_branch, greatest(coalesce(stars, 0), 0) as stars, pushed_at, categories, languages, swift_share,
         discovered_via, found_by, permalink_base
  from (select *, row_number() over (partition by {REPO.format('full_name')} order by scanned_at desc nulls last) as rn from repos where full_name is not null) where rn = 1)"""
EXAMPLES_SQL = f"""
ex as (
  select example_id, {SYM.format('sym')} as sym, kind, {REPO.format('repo')} as repo, path, line, permalink, src, shape, stars, author_authority, min_macos, platform, score
  from (select *, row_number() over (partition by example_id order by captured_at desc nulls last) as rn from examples where example_id is not null) where rn = 1)"""
AVAIL_SQL = f"""
avail as (
  select sym, min(case when introduced_macos is not null then {VERSION.format('introduced_macos')} end) as introduced,
         bool_and(coalesce(deprecated, false)) as deprecated, min(nullif(renamed, '')) as renamed
  from symbol_catalog where sym is not null group by sym)"""
USES_SQL = f"""{OCC_SQL}, {FILES_SQL},
dims as (select sym, list(distinct dim) as ds from symbol_catalog where sym is not null and dim is not null group by sym),
uses as (
  select o.*, case
    when kind = 'modifier' and list_contains(ds, 'modifiers') then 'modifiers'
    when kind = 'modifier' and list_contains(ds, 'valueBuilders') then 'valueBuilders'
    when kind = 'type' and list_contains(ds, 'types') and (o.sym not in ({quoted(CONTAINERS)}) or coalesce(trailing_closure, false)) then 'types'
    when kind = 'macro' and list_contains(ds, 'macros') then 'macros'
    when kind = 'member' and coalesce(implicit, false) and list_contains(ds, 'styleValues') then 'styleValues'
    when kind = 'member' and coalesce(implicit, false) and list_contains(ds, 'valueBuilders') then 'valueBuilders'
    when kind = 'attribute' and list_contains(ds, 'propertyWrappers') then 'propertyWrappers'
    when kind = 'keypath' and list_contains(ds, 'environmentKeys') then 'environmentKeys' end as dim
  from occ o semi join ui on o.doc_id = ui.doc_id left join dims on dims.sym = o.sym),
matched as (select * from uses where dim is not null)"""
SHAPE_SQL = "case when args is null then null when len(args) = 0 and coalesce(trailing_closure, false) then '{ }' else '(' || array_to_string(args, ', ') || ')' end"
