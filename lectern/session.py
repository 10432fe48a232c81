"""Session helpers: a tuned local session, table loading and durable staging.

Staged tables cut the lineage of iterative plans. They go to the shared folder
named by ``spark.checkpoint.dir``; only where that is unset in a local session
a temporary folder of this machine is used. On a cluster it has to be set.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "lectern", cores: int | str = "*", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than there are cores, spread over all of them.

    A small table is one file with one row group, and would keep one core busy.
    A table of cluster size has more partitions than cores and stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and staged tables that every executor sees."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor sees")
        where = "file://" + tempfile.mkdtemp(prefix="lectern-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", where) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has no lineage, survives the loss of executors, and is removed
    when the driver process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lectern/{name}-{os.getpid()}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _remove_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def release(df: DataFrame) -> None:
    """Remove a staged table that nothing will read again; any other frame stays as it is."""
    path = getattr(df, "_staged_at", None)
    if path:
        _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone already
        pass


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    atexit.register(_remove, spark, path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever they run; once a session."""
    import zipfile
    from pathlib import Path
    from urllib.parse import urlparse

    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    where = urlparse(shared_dir(spark))
    # the driver's file server hands the archive on; only the driver reads this path
    folder = Path(where.path if where.scheme in ("", "file") else tempfile.mkdtemp()) / "lectern"
    folder.mkdir(parents=True, exist_ok=True)
    archive = folder / f"package-{uuid.uuid4().hex}.zip"
    root = Path(__file__).resolve().parent
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
    atexit.register(lambda: archive.unlink(missing_ok=True))
