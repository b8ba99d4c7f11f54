"""Markdown: lines and links with the heading they stand under."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spandrel.functions.names import link_repo
from spandrel.operators.lint import lines_of

#: Headings of the first four levels count; a link to a repository.
HEADING = r"^#{1,4}[ \t]+"
LINK = r"https?://[\w.-]+/([A-Za-z0-9][\w.-]*)/([A-Za-z0-9][\w.-]*)"


def lines_under_headings(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, line int, line_text, heading): every line that is no heading, with the one before it.

    A heading ends the deeper ones before it, so the deepest open heading is the last one; lines before any have
    Uncategorized. Lines are numbered within the text, one window per document.
    """
    rows = docs.select(*keys, F.posexplode(lines_of(text)).alias("__pos", "line_text"))
    title = F.btrim(F.regexp_replace(F.regexp_replace("line_text", HEADING, ""), r"[ \t]*#*[ \t]*$", ""), F.lit(" \t"))
    rows = rows.withColumn("own", F.when(F.col("line_text").rlike(HEADING), title))
    last = F.last("own", ignorenulls=True).over(W.partitionBy(*keys).orderBy("__pos").rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("heading", F.coalesce(last, F.lit("Uncategorized"))).where("own is null").select(*keys, (F.col("__pos") + 1).alias("line"), "line_text", "heading")


def links_under_headings(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, line, owner, repo, category): links to repositories with the heading they stand under."""
    rows = lines_under_headings(docs, keys, text)
    owner, repo = (F.regexp_extract_all("line_text", F.lit(LINK), F.lit(k)) for k in (1, 2))
    found = rows.withColumn("__l", F.explode(F.arrays_zip(owner.alias("owner"), repo.alias("repo"))))
    return found.select(*keys, "line", F.col("__l.owner").alias("owner"), link_repo("__l.repo").alias("repo"), F.col("heading").alias("category"))
