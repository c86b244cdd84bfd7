"""Session and table access."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def session(app: str = "vitrine", master: str | None = None, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution on; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; any path Spark's readers accept works as ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share; only where that is unset (tests) a temporary one is made."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        app = spark.sparkContext.applicationId
        if app not in _own_dirs:
            _own_dirs[app] = tempfile.mkdtemp(prefix="vitrine-")
            atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
        base = f"file://{_own_dirs[app]}"
    made = f"{base.rstrip('/')}/vitrine-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(made)
    return made


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts its lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_shared(spark: SparkSession) -> int:
    """Delete the folders that :func:`shared_dir` gave this application, once nothing reads the tables staged there; how many there were."""
    made = _made.pop(spark.sparkContext.applicationId, [])
    for path in made:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(made)


def folder_exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
