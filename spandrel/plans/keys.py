"""Results per key of tables in which a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.operators.tree_agg import tree_aggregate
from spandrel.plans.base import occurrences
from spandrel.session import materialize


def _uses(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One row per occ_id with its clean symbol, kind and the named columns; the last delivery counts."""
    return materialize(occurrences(spark, sf_dir, "kind", *columns).drop("occ_id"), "uses")


def p4_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses, last line and first and last scan of every (sym, kind)."""
    uses = _uses(spark, sf_dir, "line", "scanned_at")
    aggs = {"uses": ("count", "*"), "last_line": ("max", "line"), "first_scan": ("min", "scanned_at"), "last_scan": ("max", "scanned_at")}
    return tree_aggregate(uses, ["sym", "kind"], aggs)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with at least one fiftieth of all uses."""
    uses = _uses(spark, sf_dir)
    total = uses.count()
    per_key = tree_aggregate(uses, ["sym", "kind"], {"uses": ("count", "*")})
    return per_key.where((F.col("uses") * 50 >= total) & F.col("kind").isNotNull()).select("sym", "kind")


QUERIES = {"p4_found": p4_found, "p4_per_key": p4_per_key}

_SYM = r"trim(split_part(regexp_replace(trim(sym, E' \t\n\r'), '^[.@]', ''), '(', 1), E' \t\n\r')"

_SQL_USES = f"""
    with ranked as (
      select occ_id, {_SYM} as sym, kind, line, scanned_at,
             row_number() over (partition by occ_id order by ingested_at desc nulls last) as rn
      from occurrences where sym is not null and occ_id is not null),
    uses as (select * from ranked where rn = 1)
"""

SQL = {
    "p4_found": _SQL_USES
    + """select sym, kind from uses where kind is not null group by sym, kind
         having count(*) * 50 >= (select count(*) from uses)""",
    "p4_per_key": _SQL_USES
    + """select sym, kind, count(*) as uses, max(line) as last_line, min(scanned_at) as first_scan, max(scanned_at) as last_scan
         from uses group by sym, kind""",
}
