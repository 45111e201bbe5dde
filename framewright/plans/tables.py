"""Reading tables and staging intermediate results."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_SHIPPED: set[str] = set()
_STAGED: dict[str, set[str]] = {}


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver found it."""
    if (app := spark.sparkContext.applicationId) in _SHIPPED:
        return
    import framewright

    package = Path(framewright.__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="framewright-")) / "framewright.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f"framewright/{f.relative_to(package)}")
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. A folder of this machine serves only a local master."""
    conf = spark.sparkContext.getConf()
    if folder := spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir"):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="framewright-")
    return _LOCAL[app]


def staged_path(spark: SparkSession, name: str) -> str:
    folder = f"{shared_dir(spark)}/framewright-{spark.sparkContext.applicationId}"
    if folder not in _STAGED:
        _STAGED[folder] = set()
        atexit.register(_remove, spark, folder)
    _STAGED[folder].add(path := f"{folder}/{name}-{uuid.uuid4().hex}")
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends here, and lost executors take nothing along."""
    spark = df.sparkSession
    df.write.parquet(path := staged_path(spark, name))
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more, so that a long job holds only what it needs."""
    for df in tables:
        if path := getattr(df, "_staged_path", None):
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            _delete(spark, folder)
    except Exception:  # noqa: BLE001 - the session is already gone; the folder's owner cleans it
        pass
