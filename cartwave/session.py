"""Session settings and the shared folder for checkpoints and written tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "cartwave") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus) if str(cpus).isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.debug.maxToStringFields", "400")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_own_dirs: dict[str, str] = {}
_cleaned: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session that names none gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _own_dirs:
        _own_dirs[context.applicationId] = tempfile.mkdtemp(prefix="cartwave-")
    return _own_dirs[context.applicationId]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under the application's part of the shared folder, which is deleted when the driver ends."""
    app = spark.sparkContext.applicationId
    folder = f"{shared_dir(spark)}/cartwave/{app}"
    if app not in _cleaned:
        _cleaned.add(app)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        atexit.register(_delete, jvm, conf, folder)
    return f"{folder}/{uuid.uuid4().hex}/{name}"


def release(spark: SparkSession) -> None:
    """Delete what the session has stored for itself so far; results that read it must have been used."""
    context = spark.sparkContext
    _delete(context._jvm, context._jsc.hadoopConfiguration(), f"{shared_dir(spark)}/cartwave/{context.applicationId}")


def _delete(jvm, conf, folder: str) -> None:
    try:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    except (Py4JError, OSError, AttributeError):
        pass  # the JVM has gone first


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder if it is there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame, *even_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    ``even_by`` stores it in even parts by a hash of these columns.  Ends the lineage of iterative work: a lost executor costs a re-read, not a
    re-run of every earlier round.
    """
    return stored(df, *even_by)[0]


def stored(df: DataFrame, *even_by: str) -> tuple[DataFrame, str]:
    """``cut`` with the path, for a table that is deleted before the driver ends."""
    path = fresh_path(df.sparkSession, "cut")
    if even_by:
        df = df.repartition(*even_by)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def spread_out(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores for a table stored in fewer files than there are cores.

    A table with enough partitions is left where it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)
