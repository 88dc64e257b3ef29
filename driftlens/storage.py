"""Cutting lineage at tables that every executor can read again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster, from ``spark.checkpoint.dir``.

    Where the setting is missing, a local master gets a temporary folder; a cluster gets an error, as a
    machine's own folder would be lost with that machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="driftlens-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table into the shared folder and reads it back.

    Later stages start from the files: a lost executor costs a read, not the lineage, and the plan that
    follows sees the table's real size. The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/driftlens/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    kept = spark.read.schema(df.schema).parquet(path)
    kept._cut_at = path
    return kept


def release(df: DataFrame) -> None:
    """Deletes the table that ``cut`` made ``df`` of, where nothing reads it any more."""
    path = getattr(df, "_cut_at", None)
    if path is not None:
        _delete(df.sparkSession, path)
        _written[:] = [w for w in _written if w[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone already
            pass
