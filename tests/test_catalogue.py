"""Every core query runs over whole tables and equals its SQL."""

import pytest

from chashma.plans import catalogue
from tests.conftest import rows_of, run_sql


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, smallest, name):
    got = catalogue.QUERIES[name](spark, smallest).toPandas()
    assert len(set(got.columns)) == len(got.columns)
    if name in catalogue.SQL:
        want = run_sql(smallest, catalogue.SQL[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)


def test_streamed_windows_equal_a_batch(spark, smallest):
    from pyspark.sql import functions as F

    from chashma.operators import normalize as N

    docs = spark.read.parquet(f"{smallest}/documents.parquet")
    rows = docs.select("crawled_at", F.coalesce(N.trimmable(F.col("text")), F.lit(False)).alias("changed"))
    want = rows.groupBy(F.window("crawled_at", "1 hour")).agg(F.count("*").alias("texts"), F.count_if("changed").alias("changes")).select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("window.end", "yyyy-MM-dd HH:mm:ss").alias("end"), "texts", "changes")
    got = catalogue.QUERIES["streamed_windows"](spark, smallest)
    assert rows_of(got.toPandas()) == rows_of(want.toPandas())
    assert got.agg(F.sum("texts")).first()[0] == docs.where("crawled_at IS NOT NULL").count()


def test_late_rows_of_several_batches(spark, tmp_path):
    from pyspark.sql import functions as F

    from chashma.streaming import audit

    days = ["2024-03-20", "2024-03-01", "2024-03-21", "2024-03-02"]
    for day in days:  # files are read in the order of their times
        spark.createDataFrame([(f"{day} 10:00:00", " a ")], "at string, text string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = audit.read_folder(spark, str(tmp_path / "in"), "at timestamp, text string", 1)
    got = audit.run_to_end(audit.status_windows(stream, "at", "text"), "late_rows", str(tmp_path / "state"), "complete")
    assert sorted(str(r.start.date()) for r in got.collect()) == sorted(days)
    # in append mode only windows that no late row can reach any more
    again = audit.run_to_end(audit.status_windows(audit.read_folder(spark, str(tmp_path / "in"), "at timestamp, text string", 1), "at", "text"), "late_rows", str(tmp_path / "again"))
    assert set(str(r.start.date()) for r in again.collect()) < set(days)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
