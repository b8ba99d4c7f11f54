"""Session factory, the shared folder of a session, and the intermediate tables in it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Intermediate tables of this driver, by application.
_TABLES: dict[str, list[str]] = {}


def build_session(master: str = "local[*]", app: str = "spandrel", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the plans assume: UTC, AQE, Arrow."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it in spark.checkpoint.dir.

    Where the session names none (tests, a laptop), a temporary folder is made and set, but only for a
    local master: on a cluster a machine-local folder would lose data with its machine.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="spandrel-")
        atexit.register(shutil.rmtree, _OWN[sc.applicationId], ignore_errors=True)
    return _OWN[sc.applicationId]


def table_path(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table, which ``release`` deletes."""
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut the lineage: write df as a table into the shared folder and read it back.

    A lost executor then costs a re-read, not a recomputation, and a plan that uses df twice runs it once. The table
    stays until ``release``, as results that are computed later may read it.
    """
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables of this application so far; call it once the results that read them are written."""
    sc = spark.sparkContext
    paths = _TABLES.pop(sc.applicationId, [])
    for path in paths:
        place = sc._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)
    return len(paths)
