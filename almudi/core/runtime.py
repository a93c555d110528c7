"""Reading inputs, and cutting lineage in a folder that every executor can reach."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_SWEPT: set[str] = set()


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The table ``name`` of ``sf_dir``, narrowed to ``columns`` when given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Only where the cluster names none (tests on local masters) a folder of our own is
    made; anywhere else a missing setting is an error, because a machine-local folder
    would be lost with its executor.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    app = sc.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="almudi-")
        atexit.register(shutil.rmtree, _OWN[app], True)
    return f"file://{_OWN[app]}"


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/almudi/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder, which is deleted when the
    application's driver exits."""
    folder = _own_folder(spark)
    if folder not in _SWEPT:
        _SWEPT.add(folder)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        atexit.register(_delete, jvm, conf, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def _delete(jvm, conf, folder: str) -> bool:
    try:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(conf).delete(path, True)
    except Exception:  # noqa: BLE001 - at exit the gateway may be gone
        return False


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> str:
    """Write ``df`` as Parquet under the shared folder; returns the path.

    Unlike a checkpoint the table is columnar, so later reads prune columns and
    partitions.
    """
    path = scratch(df.sparkSession, name)
    w = df.write.mode("errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return path


def tabled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name))


def sweep(spark: SparkSession) -> bool:
    """Deletes this application's intermediate tables from the shared folder; not for while a
    result is still to be read from them."""
    return _delete(spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), _own_folder(spark))
