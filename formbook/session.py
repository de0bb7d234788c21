"""Session settings, the shared scratch folder and staged tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# A group above this many rows is split across tasks (operators/hot.py).
HOT_GROUP_ROWS = 10_000_000
# Pieces a group or part is cut into at a time; what stays too large is cut again.
HOT_GROUP_SPLITS = 64
# A join side is broadcast only when it is counted to hold at most this many rows.
BROADCAST_ROWS = 200_000


def build_session(app: str = "formbook", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators rely on."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def hot_group_rows(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.formbook.hotGroupRows", str(HOT_GROUP_ROWS)))


def hot_group_splits(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.formbook.hotGroupSplits", str(HOT_GROUP_SPLITS)))


def broadcast_rows(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.formbook.broadcastRows", str(BROADCAST_ROWS)))


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a folder of its own; a cluster
    session must set it, since a machine-local folder is lost with its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder every executor can reach.")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="formbook-")
    return _LOCAL_FOLDERS[app]


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder."""
    return f"{shared_folder(spark)}/formbook/{name}-{uuid.uuid4().hex[:12]}"


_STAGED: dict[tuple, str] = {}


def folder_stamp(spark: SparkSession, folder: str) -> tuple:
    """Names, sizes and times of what lies in a folder and in its tables: new files
    change it. Read through Hadoop, so any store will do."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def listed(at) -> list:
        found = [(f.getPath(), f.getLen(), f.getModificationTime(), f.isDirectory()) for f in fs.listStatus(at)]
        return sorted((p.getName(), size, time, tuple(listed(p)) if is_dir else ()) for p, size, time, is_dir in found)

    return tuple(listed(path)) if fs.exists(path) else ()


def staged(spark: SparkSession, key: tuple, build, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``build()`` once per session under ``key`` and read it back.

    ``key`` is a name and the folder the table derives from; when files there change,
    the table is built anew.

    Stages that many queries share (the contest facts) are tables, not
    re-derived plans: readers get column pruning, partition pruning and row
    counts, and a lost executor costs a re-read, not a re-derivation.
    """
    full = (spark.sparkContext.applicationId, *key, folder_stamp(spark, key[1]))
    if full not in _STAGED:
        path = new_path(spark, key[0])
        df = build()
        if partition_by:
            df = df.hint("rebalance", *partition_by)
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
        _STAGED[full] = path
    return spark.read.parquet(_STAGED[full])
