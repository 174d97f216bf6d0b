"""Session set-up, the task-size limit and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_TASK = "spark.augury.rowsPerTask"
DEFAULT_ROWS_PER_TASK = 500_000

# Settings every job of this library relies on. Cluster sizes (shuffle partitions, memory) stay with the caller.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def build_session(app_name: str = "augury", master: str | None = None, conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**REQUIRED_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the required settings to a session somebody else made."""
    for key, value in REQUIRED_CONF.items():
        spark.conf.set(key, value)
    return spark


def rows_per_task(spark: SparkSession) -> int:
    """Most rows of one ordered group that one task may sort; larger groups are cut into runs."""
    return int(spark.conf.get(ROWS_PER_TASK, str(DEFAULT_ROWS_PER_TASK)))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only for local runs without it."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(shared)
        shared = spark.sparkContext.getCheckpointDir()
    return shared.rstrip("/")


_paths: dict[str, list[str]] = {}  # scratch paths handed out, per application
_tables: dict[str, list[str]] = {}  # names of catalog tables over them
_releases = 0


def releases() -> int:
    """How often ``release`` has run: results kept from before hold on to tables that are gone."""
    return _releases


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder."""
    path = f"{scratch_dir(spark)}/augury-{name}-{uuid.uuid4().hex}"
    _paths.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def scratch_table(spark: SparkSession, name: str) -> tuple[str, str]:
    """A new catalog name and the path in the shared folder for its files; ``release`` drops both."""
    table = f"augury_{name}_{uuid.uuid4().hex}"
    _tables.setdefault(spark.sparkContext.applicationId, []).append(table)
    return table, scratch_path(spark, name)


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables this application wrote so far; returns how many paths there were.

    Call it once results are stored: tables that still read an intermediate one can no longer be computed.
    """
    global _releases
    _releases += 1
    done = _paths.pop(spark.sparkContext.applicationId, [])
    for name in _tables.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"drop table if exists `{name}`")
    for path in done:
        remove(spark, path)
    return len(done)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of this library's own, in whatever file system it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    kept = _paths.get(spark.sparkContext.applicationId, [])
    if path in kept:
        kept.remove(path)


def dated_files(spark: SparkSession, path: str, known: set[str] | None = None, first: int = 0) -> set[str]:
    """The names of the data files in a folder, none if there is no folder.

    With ``known``, the files besides those get times a second apart in the order of their names, ``first`` seconds and more
    after a time that is the same for the whole application: jobs of several tasks end their files in any order.
    """
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(target):
        return set()
    names = {s.getPath().getName() for s in files.listStatus(target)}
    names = {n for n in names if not n.startswith(("_", "."))}
    if known is not None:
        start = spark.sparkContext.startTime
        for k, name in enumerate(sorted(names - known)):
            files.setTimes(spark._jvm.org.apache.hadoop.fs.Path(path, name), start + 1000 * (first + k), -1)
    return names


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Used where a costly result has several readers. The written table cuts the lineage, survives lost executors,
    keeps column pruning and gives the planner real sizes.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
