"""Cutting lineage: intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Folder of each staged table that is still there.
_STAGED: dict[str, None] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (`spark.checkpoint.dir`). Only where that is unset and Spark runs in one process, as in tests, a local one is set.

    On a cluster each executor would write to its own disk and the table would come back short, so there an unset folder is an error.
    """
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not one_process(sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="chashma-")
    sc.setCheckpointDir(own)
    return own


def one_process(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as a table in the shared folder and read it back.

    What follows starts from files instead of the lineage, so a lost executor costs re-reading, not
    recomputing, and values that depend on partition order (assigned ids) are fixed. The table is
    compressed and read by column. It is removed when the driver ends, or earlier by `released`.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/chashma/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED[path] = None
    kept = spark.read.schema(df.schema).parquet(path)
    kept._staged_at = path
    return kept


def released(kept: DataFrame) -> None:
    """Remove a staged table that nothing will read again: all that was made from it has been staged."""
    _remove(kept._staged_at)


def _remove(path: str) -> None:
    sc = SparkContext._active_spark_context
    if sc is None:
        return
    try:
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
        _STAGED.pop(path, None)
    except Exception:  # the context may be gone, or the folder
        pass


@atexit.register
def _remove_staged() -> None:
    for path in list(_STAGED):
        _remove(path)
