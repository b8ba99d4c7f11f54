"""Files, framed logs, delimited tables, symbol graphs and rule sets as sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folders that are never scanned, endings that are left out, largest file.
PRUNED = [".git", ".build", "build", "Pods", "Carthage", "DerivedData", "node_modules", "vendor", "Vendor", "checkouts", ".swiftpm"]
EXCLUDED = ["Tests.swift", ".generated.swift"]
MOST_BYTES = 2_000_000


def scan_files(spark: SparkSession, folder: str, glob: str = "*.swift", pruned: list[str] = PRUNED, excluded: list[str] = EXCLUDED) -> DataFrame:
    """(path, bytes bigint, text, skipped): every file under a folder, without pruned folders and excluded endings.

    Files of more than MOST_BYTES come out as skipped rows without text. Paths are relative to the folder.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    # Paths come as URIs or plain; what follows the folder's own path is kept.
    tail = F.regexp_replace(F.element_at(F.split("path", "/" + folder.strip("/").replace(".", r"\.") + "/"), -1), "^/", "")
    rows = raw.select(tail.alias("path"), F.col("length").alias("bytes"), "content")
    parts = F.split("path", "/")
    rows = rows.where(~F.arrays_overlap(parts, F.array(*map(F.lit, pruned))))
    for end in excluded:
        rows = rows.where(~F.col("path").endswith(end))
    big = F.col("bytes") > MOST_BYTES
    text = F.when(~big, F.try_validate_utf8(F.col("content").cast("string")))
    return rows.select("path", "bytes", text.alias("text"), F.when(big, "too large").when(text.isNull(), "unreadable").alias("skipped"))


def read_framed(spark: SparkSession, path: str, header: T.StructType, body: T.StructType, trailer: T.StructType) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A framed log of JSON lines -> (headers, bodies, trailers, bad lines), each with ``file``.

    Lines say what they are in ``type``: repo, done, or none for a body. A line that is no JSON is kept as bad and stops
    nothing; a file without a header has its bodies without one.
    """
    raw = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("file")).where("btrim(value) <> ''")
    ok = F.try_parse_json("value").isNotNull() & F.col("value").rlike(r"^\s*\{")
    kind = F.coalesce(F.get_json_object("value", "$.type"), F.lit("file"))
    tagged = raw.withColumn("ok", ok).withColumn("kind", F.when(ok, kind))

    def part(name: str, schema: T.StructType) -> DataFrame:
        return tagged.where(F.col("ok") & (F.col("kind") == name)).select("file", F.from_json("value", schema).alias("__r")).select("file", "__r.*")

    return part("repo", header), part("file", body), part("done", trailer), tagged.where("not ok").select("file", "value")


def completed(headers: DataFrame, trailers: DataFrame) -> DataFrame:
    """Headers of files whose trailer was written: the units that a restart may skip."""
    return headers.join(trailers.select("file").distinct(), "file", "left_semi")


def read_delimited(spark: SparkSession, path: str, columns: list[str], sep: str = "\t", least: int | None = None) -> DataFrame:
    """Lines as columns; comments (#), blank lines and lines with fewer than ``least`` columns (all) are left out."""
    raw = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    quoted = "\\" + sep if sep in r"|.^$*+?()[]{}\\" else sep
    parts = raw.select(F.split("value", quoted, len(columns)).alias("p")).where(F.size("p") >= (least or len(columns)))
    return parts.select(*[F.btrim(F.get("p", F.lit(k))).alias(c) for k, c in enumerate(columns)])


_GRAPH = "symbols array<struct<names:struct<title:string>,availability:array<struct<domain:string,introduced:struct<major:int,minor:int>,deprecated:struct<major:int,minor:int>,isUnconditionallyDeprecated:boolean,renamed:string>>>>"


def read_symbol_graph(spark: SparkSession, path: str, domain: str = "macOS") -> DataFrame:
    """(sym, introduced, deprecated, renamed) per symbol: its first entry for a platform, or nulls if it has none."""
    graph = spark.read.schema(_GRAPH).option("multiLine", "true").json(path).select(F.explode("symbols").alias("s"))
    entry = F.get(F.filter("s.availability", lambda a: a["domain"] == domain), F.lit(0))
    rows = graph.select(F.substring_index("s.names.title", "(", 1).alias("sym"), entry.alias("a"))
    version = F.when(F.col("a.introduced.major").isNotNull(), F.concat_ws(".", F.col("a.introduced.major").cast("string"), F.coalesce(F.col("a.introduced.minor"), F.lit(0)).cast("string")))
    old = F.coalesce(F.col("a.isUnconditionallyDeprecated"), F.lit(False)) | F.col("a.deprecated").isNotNull()
    return rows.select("sym", version.alias("introduced"), old.alias("deprecated"), F.col("a.renamed").alias("renamed"))


def read_rules(texts: list[str]) -> list[dict]:
    """Rules of several YAML texts, documents apart by ---; hard is a severity of its own. Needs PyYAML."""
    import yaml

    rules = [r for text in texts for r in yaml.safe_load_all(text) if r]
    for r in rules:
        if "id" not in r or "rule" not in r:
            raise ValueError("a rule needs id and rule")
        if r.setdefault("severity", "warning") not in ("hint", "info", "warning", "error", "hard"):
            raise ValueError(f"unknown severity {r['severity']}")
    return rules


def front_matter(texts: list[str], key: str, default: str | None = None) -> str | None:
    """The first value of a key in the front matter of several settings texts, most specific first."""
    for text in texts:
        lines = (text or "").splitlines()
        if lines[:1] == ["---"] and "---" in lines[1:]:
            for line in lines[1 : lines.index("---", 1)]:
                name, _, value = line.partition(":")
                if name.strip() == key and value.strip():
                    return value.strip().strip("\"'")
    return default


def catalog_folder(flag: str | None, env: str | None, places: list[str], exists) -> str:
    """The first of flag, environment and places that holds an index; raises LookupError if none does."""
    for place in [flag, env, *places]:
        if place and exists(f"{place.rstrip('/')}/index"):
            return place
    raise LookupError("no catalog found")
