"""The same operators over streams: normalisation as rows arrive, and windowed counts that wait for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chashma.operators import normalize as N


def read_folder(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def normalized(stream: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Stateless: every record by itself."""
    return N.normalize(stream, id_col, text_col)


def status_windows(stream: DataFrame, time_col: str, text_col: str, window: str = "1 hour", late: str = "3 days") -> DataFrame:
    """Texts and changes per window of arrival.

    In append mode, for endless streams, a window comes out when rows later than `late` cannot come any more, and later
    rows are dropped. In complete mode all windows come out with all rows.
    """
    rows = stream.withWatermark(time_col, late).select(time_col, F.coalesce(N.trimmable(F.col(text_col)), F.lit(False)).alias("changed"))
    return rows.groupBy(F.window(time_col, window)).agg(F.count("*").alias("texts"), F.count_if("changed").alias("changes")).select("window.start", "window.end", "texts", "changes")


def run_to_end(stream: DataFrame, name: str, folder: str, mode: str = "append") -> DataFrame:
    """What is there now, as a table in the shared folder: in append mode what is final by the watermark, in complete mode all.

    Each batch is written by the executors, none of it goes to the driver; in complete mode a batch replaces the ones before it.
    """
    table = f"{folder}/{name}"
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is run again after a failure replaces itself
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    batches = sorted(int(f.getPath().getName().partition("=")[2]) for f in files.listStatus(where)) if files.exists(where) else []
    if not batches:
        return spark.createDataFrame([], schema)
    kept = batches[-1:] if mode == "complete" else batches
    return spark.read.schema(schema).parquet(*(f"{table}/batch={b}" for b in kept))
