"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "wattloom", cores: str = "8", **conf: str) -> SparkSession:
    """Session for a laptop, tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # no call site per column expression: building a plan takes half the time
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


#: Folder of each application without a configured one; only tests and laptops come here.
_own_dirs: dict[str, str] = {}
_cleared: set[tuple[str, str]] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Where it is unset, driver and executors must be one process, and a temporary folder serves.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="wattloom-")
    return _own_dirs[app]


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def folder_exists(spark: SparkSession, path: str) -> bool:
    fs, where = _file_system(spark, path)
    return fs.exists(where)


def scratch_root(spark: SparkSession) -> str:
    """This application's own folder below the shared one; it goes when the application ends."""
    app = spark.sparkContext.applicationId
    root = f"{shared_dir(spark)}/wattloom-{app}"
    if (app, root) not in _cleared:
        fs, where = _file_system(spark, root)
        fs.mkdirs(where)
        fs.deleteOnExit(where)
        _cleared.add((app, root))
    return root


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in this application's folder; nothing is reused between runs."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all that :func:`cut_lineage` and :func:`scratch` wrote; for long sessions, when no result is pending."""
    fs, where = _file_system(spark, scratch_root(spark))
    fs.delete(where, True)
    fs.mkdirs(where)


def replace_folder(spark: SparkSession, fresh: str, path: str) -> None:
    """Puts the complete folder ``fresh`` in the place of ``path``; the old one goes after the switch."""
    fs, target = _file_system(spark, path)
    _, new = _file_system(spark, fresh)
    _, old = _file_system(spark, f"{fresh}.old")
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"can't move {path} aside")
    if not fs.rename(new, target):
        raise OSError(f"can't move {fresh} to {path}")
    if had:
        fs.delete(old, True)


def cut_lineage(df: DataFrame, label: str) -> DataFrame:
    """Materialise ``df`` as parquet in the shared folder and read it back.

    The files survive the loss of executors, so later stages never recompute
    (and never see a different outcome of) what was before the cut.
    """
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
