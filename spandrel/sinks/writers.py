"""Sinks: resume logs, one folder per dimension or repository, framed logs, single documents."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_log(rows: DataFrame, path: str, key: str) -> None:
    """Append rows whose key the log lacks, as JSON lines; a second run with the same rows adds nothing."""
    spark = rows.sparkSession
    try:
        done = spark.read.schema(rows.schema).json(path).select(key).distinct()
        todo = rows.join(done, key, "left_anti")
    except Exception:  # noqa: BLE001 - no log yet
        todo = rows
    todo.write.mode("append").json(path)


def write_by(rows: DataFrame, path: str, column: str, how: str = "parquet") -> None:
    """One folder per value of a column; only the folders of the values in ``rows`` are replaced, and all at once."""
    name = "partitionOverwriteMode"
    rows.repartition(column).write.mode("overwrite").option(name, "dynamic").partitionBy(column).format(how).save(path)


def framed(header: DataFrame, bodies: DataFrame, key: str) -> DataFrame:
    """(key, value): header line, body lines and trailer line of each unit as JSON, in this order within a key.

    The trailer counts the bodies; a unit without its trailer wasn't completed. Write with ``write_framed``.
    """
    head = header.select(F.col(key).alias("k"), F.lit(0).alias("o"), F.lit("").alias("s"), F.to_json(F.struct(F.lit("repo").alias("type"), *header.columns)).alias("value"))
    fields = [c for c in bodies.columns if c != key]
    line = F.to_json(F.struct(*fields))
    body = bodies.select(F.col(key).alias("k"), F.lit(1).alias("o"), line.alias("s"), line.alias("value"))
    counts = header.select(key).join(bodies.groupBy(key).agg(F.count(F.lit(1)).alias("files")), key, "left")
    tail = counts.select(F.col(key).alias("k"), F.lit(2).alias("o"), F.lit("").alias("s"), F.to_json(F.struct(F.lit("done").alias("type"), F.coalesce("files", F.lit(0)).alias("files"))).alias("value"))
    return head.unionByName(body).unionByName(tail).withColumnRenamed("k", key)


def write_framed(rows: DataFrame, path: str, key: str) -> None:
    """Framed lines, one folder per key, each committed as a whole."""
    ordered = rows.repartition(key).sortWithinPartitions(key, "o", "s").select(key, "value")
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).text(path)


def write_document(rows: DataFrame, key: str, most: int = 100_000) -> str:
    """One JSON document {key: row} of a small report, for people; larger results are tables."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows: write a table")
    return json.dumps({str(r[key]): r.asDict(recursive=True) for r in got}, indent=1, sort_keys=True, default=str)


def sarif(findings: DataFrame, tool: str, most: int = 100_000) -> str:
    """A SARIF 2.1.0 document of findings (rule_id, severity, message, path, line); lines start at 1."""
    from spandrel.operators.lint import sarif_level

    rows = findings.select("rule_id", sarif_level(F.col("severity")).alias("level"), "message", "path", F.greatest("line", F.lit(1)).alias("line")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} findings: export per domain")
    results = [
        {"ruleId": r.rule_id, "level": r.level, "message": {"text": r.message}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": r.path}, "region": {"startLine": r.line}}}]}
        for r in rows
    ]
    driver = {"name": tool, "rules": [{"id": i} for i in sorted({r.rule_id for r in rows})]}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": driver}, "results": results}]}, indent=1)


def dashboard(by_severity: DataFrame, by_domain: DataFrame, by_status: DataFrame, findings: DataFrame, most: int = 1000) -> str:
    """A Markdown page with three roll-ups and the first findings; nothing in it depends on the time."""
    from spandrel.plans.evaluate import markdown_table

    parts = [("Severity", by_severity), ("Domain", by_domain), ("Status", by_status), ("Findings", findings)]
    return "\n".join(f"## {title}\n\n{markdown_table(rows, most)}" for title, rows in parts)
