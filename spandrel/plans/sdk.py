"""The symbol catalogue: which names are modifiers, value builders and styles, and since when."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.functions.names import is_public_name, version_number, version_text
from spandrel.plans import base
from spandrel.sources.tables import table

#: Modifiers kept although general libraries use their names; statics that say nothing.
PROTECTED = ["padding", "offset", "tag", "scale", "userActivity", "frame", "background"]
GENERIC = ["allCases", "standard", "shared", "default", "none", "zero", "init", "some"]
#: A curated layer over the mined availability: symbol, introduced, replacement; and names whose flag is withdrawn.
CURATED = [("padding", "10.15", "safeAreaPadding"), ("frame", "10.15", "containerRelativeFrame"), ("overlay", "12.0", "overlay(alignment:content:)")]
UNFLAGGED = ["overlay"]


def _names(spark: SparkSession, sf_dir: str, kind: str, more: str = "true") -> DataFrame:
    """Different symbols of a kind; the distinct combines before its shuffle, so hot symbols cost nothing."""
    return table(spark, sf_dir, "occurrences").where("sym is not null").where(f"kind = '{kind}' and {more}").select(base.clean_symbol("sym").alias("sym")).where(is_public_name("sym")).distinct()


def host_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per enclosing type its different public modifiers and members."""
    rows = base.occurrences(spark, sf_dir, "kind", "scope").where("scope is not null").where(F.col("kind").isin("modifier", "member") & is_public_name("sym"))
    one = rows.select("scope", "kind", "sym").distinct().groupBy("scope")
    return one.agg(F.count_if(F.col("kind") == "modifier").alias("methods"), F.count_if(F.col("kind") == "member").alias("statics"), F.array_join(F.array_sort(F.collect_set("sym")), ",").alias("names"))


def modifier_names(hosts: DataFrame, library: DataFrame, protected: list[str]) -> DataFrame:
    """Union of the hosts' methods without those a general library has too, unless they are protected."""
    clash = hosts.intersect(library).where(~F.col("sym").isin(protected))
    return hosts.join(clash, "sym", "left_anti")


def modifier_set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modifiers by use, without names that are members too; here members stand for a general library."""
    return modifier_names(_names(spark, sf_dir, "modifier"), _names(spark, sf_dir, "member", "not coalesce(implicit, false)"), PROTECTED)


def value_builder_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Implicit members that are neither modifiers nor key paths nor generic names."""
    builders = _names(spark, sf_dir, "member", "implicit").where(~F.col("sym").isin(GENERIC))
    return builders.join(modifier_set_algebra(spark, sf_dir), "sym", "left_anti").join(_names(spark, sf_dir, "keypath"), "sym", "left_anti")


def roll_up_overloads(rows: DataFrame) -> DataFrame:
    """(sym, ord, introduced, deprecated, renamed) per overload -> one row per symbol.

    introduced: the least version, compared as numbers; deprecated: all overloads are; renamed: the first that isn't empty.
    """
    parts = F.split("introduced", r"\.")
    version = F.when(F.col("introduced").isNotNull(), F.struct(F.coalesce(parts[0].try_cast("int"), F.lit(0)).alias("major"), F.coalesce(F.get(parts, F.lit(1)).try_cast("int"), F.lit(0)).alias("minor")))
    out = rows.groupBy("sym").agg(
        F.min(version).alias("v"),
        F.bool_and(F.coalesce("deprecated", F.lit(False))).alias("deprecated"),
        F.min_by("renamed", F.when(F.coalesce("renamed", F.lit("")) != "", F.col("ord"))).alias("renamed"),
        F.count(F.lit(1)).alias("overloads"),
    )
    return out.select("sym", F.when(F.col("v").isNotNull(), F.format_string("%d.%d", "v.major", "v.minor")).alias("introduced"), "deprecated", "renamed", "overloads")


def overload_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.array_position(F.array(*map(F.lit, base.DIMS)), F.col("dim"))
    rows = table(spark, sf_dir, "symbol_catalog").where("sym is not null").select("sym", order.alias("ord"), F.col("introduced_macos").alias("introduced"), "deprecated", "renamed")
    return roll_up_overloads(rows)


def with_curated(mined: DataFrame, curated: DataFrame, unflagged: list[str]) -> DataFrame:
    """Curated rows over mined ones, per symbol: they force deprecated, replace what they state and add new symbols; last, names are un-flagged."""
    c = curated.select("sym", F.col("introduced").alias("c_introduced"), F.col("renamed").alias("c_renamed"), F.lit(True).alias("c"))
    both = mined.join(c, "sym", "full")
    flag = F.when(F.col("sym").isin(unflagged), F.lit(False)).otherwise(F.coalesce("c", "deprecated", F.lit(False)))
    return both.select("sym", F.coalesce("c_introduced", "introduced").alias("introduced"), flag.alias("deprecated"), F.coalesce("c_renamed", "renamed").alias("renamed"))


def layered_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    curated = spark.createDataFrame(CURATED, "sym string, introduced string, renamed string")
    return with_curated(overload_rollup(spark, sf_dir), curated, UNFLAGGED)


def version_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of the catalogue as numbers and as text again."""
    v = table(spark, sf_dir, "symbol_catalog").select("introduced_macos").distinct()
    number = version_number("introduced_macos")
    return v.select("introduced_macos", number.alias("number"), version_text(number).alias("text"))


QUERIES = {f.__name__: f for f in (host_groups, modifier_set_algebra, value_builder_difference, overload_rollup, layered_override, version_forms)}

_N = f"select distinct {base.SYM.format('sym')} as sym from occurrences where sym is not null and regexp_matches({base.SYM.format('sym')}, '^[A-Za-z][A-Za-z0-9_]*$') and kind = "
_MODS = f"""m as ({_N} 'modifier'), l as ({_N} 'member' and not coalesce(implicit, false)),
    mods as (select sym from m where sym not in (select sym from l) or sym in ({base.quoted(PROTECTED)}))"""
_ROLL = f"""o as (select sym, introduced_macos, deprecated, renamed, list_position([{base.quoted(base.DIMS)}], dim) as ord from symbol_catalog where sym is not null),
    v as (select *, case when introduced_macos is not null then (coalesce(try_cast(split_part(introduced_macos, '.', 1) as int), 0), coalesce(try_cast(nullif(split_part(introduced_macos, '.', 2), '') as int), 0)) end as ver from o),
    roll as (select sym, case when min(ver) is not null then min(ver)[1] || '.' || min(ver)[2] end as introduced, bool_and(coalesce(deprecated, false)) as deprecated,
                    arg_min(renamed, ord) filter (coalesce(renamed, '') <> '') as renamed, count(*) as overloads from v group by sym)"""
_CUR = "(values " + ", ".join(f"('{s}', '{i}', '{r}')" for s, i, r in CURATED) + ") c(sym, introduced, renamed)"
SQL = {
    "host_groups": f"""with {base.OCC_SQL}, p as (select distinct scope, kind, sym from occ where scope is not null and kind in ('modifier', 'member') and regexp_matches(sym, '^[A-Za-z][A-Za-z0-9_]*$'))
        select scope, count(*) filter (kind = 'modifier') as methods, count(*) filter (kind = 'member') as statics, string_agg(distinct sym, ',' order by sym) as names from p group by scope""",
    "modifier_set_algebra": f"with {_MODS} select sym from mods",
    "value_builder_difference": f"with {_MODS}, b as ({_N} 'member' and implicit), k as ({_N} 'keypath') select sym from b where sym not in ({base.quoted(GENERIC)}) and sym not in (select sym from mods) and sym not in (select sym from k)",
    "overload_rollup": f"with {_ROLL} select sym, introduced, deprecated, renamed, overloads from roll",
    "layered_override": f"""with {_ROLL} select coalesce(roll.sym, c.sym) as sym, coalesce(c.introduced, roll.introduced) as introduced,
        case when coalesce(roll.sym, c.sym) in ({base.quoted(UNFLAGGED)}) then false else c.sym is not null or coalesce(deprecated, false) end as deprecated, coalesce(c.renamed, roll.renamed) as renamed
        from roll full join {_CUR} on c.sym = roll.sym""",
    "version_forms": f"""select introduced_macos, number, case when number <> 0 then regexp_replace(regexp_replace(printf('%.2f', number), '0+$', ''), '\\.$', '') end as text
        from (select distinct introduced_macos, {base.VERSION.format('introduced_macos')} as number from symbol_catalog)""",
}
