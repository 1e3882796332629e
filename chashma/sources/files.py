"""Reading and writing corpora: JSON arrays, JSON lines, CSV, shards with a manifest, fingerprints, a census of parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """(source_record_id, item VARIANT) of the items of JSON arrays, in order, from files of any size.

    Files are read in splits at line breaks, with the brackets of the array on lines of their own and an item on each other line, as `write_json_array`
    and most tools lay them out; commas at the ends are taken off, and numbers come from counts per split. Any other layout does not parse and ends
    the read with an error; for such files there is `read_small_json_array`.
    """
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), F.trim(F.regexp_replace("value", "^\ufeff", "")).alias("value"))
    own = F.when(F.col("value").isin("[", "]", "],"), F.lit("")).otherwise(F.regexp_replace("value", r"\s*,\z", ""))
    items = lines.withColumn("own", own).where("own != ''")
    return _numbered(items.select("file", "at", F.parse_json("own").alias("item")))


def _numbered(items: DataFrame) -> DataFrame:
    """Consecutive numbers in the order of (file, at): counts per split of a staged table and running sums over the splits, so no task holds all items."""
    from chashma.plans.lineage import staged

    kept = staged(items.withColumn("split", F.shiftright("at", 33)), "items")
    counts = kept.groupBy("file", "split").agg(F.count("*").alias("n"))  # one row per split
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("file", "split").orderBy("at")) - 1
    return kept.join(before, ["file", "split"]).select((F.col("before") + inside).cast("bigint").alias("source_record_id"), "item")


def read_small_json_array(spark: SparkSession, path: str) -> DataFrame:
    """(source_record_id, item VARIANT) of the items of one JSON array per file in any layout. A file is one value, so it has to fit into a task's memory."""
    whole = spark.read.text(path, wholetext=True).select(F.parse_json(F.regexp_replace("value", "^\ufeff", "")).alias("v"))
    whole.createOrReplaceTempView("chashma_json_array")
    return spark.sql("SELECT cast(e.pos AS BIGINT) AS source_record_id, e.value AS item FROM chashma_json_array, LATERAL variant_explode(v) AS e")


def write_json_array(df: DataFrame, path: str, id_col: str) -> None:
    """One JSON array in each file, an item on each line, in the order of the ids over all files."""
    rows = df.repartitionByRange(F.col(id_col)).sortWithinPartitions(id_col).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("item"))

    def lines(batches):
        import pyarrow as pa

        last = None
        for batch in batches:
            items = batch.column(0).to_pylist()
            if not items:
                continue
            out = ["["] if last is None else [last + ","]
            out += [i + "," for i in items[:-1]]
            last = items[-1]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[", "]"] if last is None else [last, "]"], pa.string())], ["value"])

    rows.mapInArrow(lines, "value string").write.text(path)


def classify_items(items: DataFrame, field: str = "text") -> DataFrame:
    """Each item with its type and its text, if it is an object with a text field that is a string."""
    kind, inner = F.schema_of_variant("item"), F.try_variant_get("item", f"$.{field}", "variant")
    text_kind = F.schema_of_variant(inner)
    named = F.when(~kind.startswith("OBJECT"), "NON_DICTIONARY_RECORD").when(inner.isNull(), "MISSING_TEXT_FIELD").when(text_kind != "STRING", "NON_STRING_TEXT").otherwise("TEXT")
    return items.select("source_record_id", named.alias("record_type"), F.when(named == "TEXT", F.try_variant_get("item", f"$.{field}", "string")).alias("text"))


def _ranges(spark: SparkSession, path: str, head: int, tail: int) -> DataFrame:
    """(path, size_bytes, modified_at, first bytes, last bytes) of each file. Files are listed by Spark, and of each only the two ranges are read, by the tasks, through the Hadoop file system of the path."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))
    hosts = spark.sparkContext.getConf().get("spark.hadoop.fs.defaultFS", "file:///")

    def read(batches):
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            heads, tails = [], []
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                where, inner = fs.FileSystem.from_uri(name if ":" in name else hosts + name)
                with where.open_input_file(inner) as f:
                    heads.append(f.read_at(min(size, head), 0))
                    tails.append(f.read_at(min(size, tail), max(0, size - tail)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.binary()), pa.array(tails, pa.binary())], ["path", "size_bytes", "modified_at", "head", "tail"])

    return files.mapInArrow(read, "path string, size_bytes bigint, modified_at timestamp, head binary, tail binary")


def boundaries(spark: SparkSession, path: str) -> DataFrame:
    """(path, starts_with_bracket, ends_with_bracket, has_bom) of each file, from its first and last 4 KiB."""
    head, tail = F.regexp_replace(F.col("head").cast("string"), "^\ufeff", ""), F.col("tail").cast("string")
    return _ranges(spark, path, 4096, 4096).select("path", head.rlike(r"^\s*\[").alias("starts_with_bracket"), tail.rlike(r"\]\s*\z").alias("ends_with_bracket"), F.hex(F.substring("head", 1, 3)).eqNullSafe("EFBBBF").alias("has_bom"))


def fingerprints(spark: SparkSession, path: str, chunk: int = 1 << 20) -> DataFrame:
    """(path, size, modified, hashes of the first and last chunk) of each file: equal before and after a run if the input was not touched. Object stores have no inodes, so there is none."""
    return _ranges(spark, path, chunk, chunk).select("path", "size_bytes", "modified_at", F.sha2("head", 256).alias("first_chunk_sha256"), F.sha2("tail", 256).alias("last_chunk_sha256"))


def write_shards(df: DataFrame, path: str, id_col: str, rows_per_part: int = 100_000, overwrite: bool = False) -> None:
    """JSON lines in part folders by id range, sorted; an existing folder is refused unless it may be overwritten. Spark commits atomically and marks the end with `_SUCCESS`."""
    parts = df.withColumn("part_number", F.floor(F.col(id_col) / rows_per_part).cast("int"))
    parts.repartition("part_number").sortWithinPartitions("part_number", id_col).write.mode("overwrite" if overwrite else "errorifexists").partitionBy("part_number").json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, rows, empty lines, bytes, print) of the files of shards. Files are read in splits, so their size does not matter; the print is a sum over the hashes of lines with their places."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path).select(F.input_file_name().alias("path"), "value")
    half = F.conv(F.left(F.sha2("value", 256), F.lit(15)), 16, 10).cast("bigint")
    return lines.groupBy("path").agg(F.count("*").alias("rows"), F.count_if(F.trim("value") == "").alias("empty_lines"), F.sum(F.octet_length("value") + 1).alias("bytes"), F.bit_xor(half).alias("lines_print"))


def read_shards(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of shards; a line that is no object of this schema ends the read with an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, empty for missing; a byte order mark before the first name is dropped; quoted line breaks are kept."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.lstrip("﻿")) for c in df.columns))


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """The named columns in this order; those that a frame lacks are empty, others are left out."""
    df.select(*((F.col(c) if c in df.columns else F.lit("")).cast("string").alias(c) for c in columns)).write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_by_category(df: DataFrame, path: str, category: str) -> None:
    """One CSV folder for each category, whose name is made safe for paths."""
    df.withColumn("category", F.regexp_replace(category, "[^A-Za-z0-9_.-]+", "_")).write.mode("overwrite").partitionBy("category").option("header", True).csv(path)


def rows_at(df: DataFrame, wanted: DataFrame, id_col: str) -> DataFrame:
    """The rows of the wanted ids; with tables partitioned by part, only the parts they name are read."""
    return df.join(wanted.select(id_col).distinct(), id_col, "left_semi")


def first_ids(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """Records with ids below n; all if n is 0."""
    return df.where(F.col(id_col) < n) if n else df


def part_census(df: DataFrame, id_col: str, part: Column, rows_per_part: int, text_col: str | None = None) -> DataFrame:
    """For each part: rows, null ids, first and last id, and rows whose id lies in another part; with a text column also empty texts, bytes, and a print of all texts that does not depend on their order."""
    c = F.col
    rows = df.select(c(id_col).alias("id"), part.cast("bigint").alias("part"), *([c(text_col).alias("text")] if text_col else []))
    more = []
    if text_col:
        half = F.conv(F.left(F.sha2("text", 256), F.lit(15)), 16, 10).cast("bigint")
        more = [F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("empty_rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("bigint").alias("bytes"), F.coalesce(F.bit_xor(half), F.lit(0)).alias("texts_print")]
    return rows.groupBy("part").agg(F.count("*").alias("rows"), F.count_if(c("id").isNull()).alias("null_ids"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count_if(F.floor(c("id") / rows_per_part) != c("part")).alias("misplaced"), *more)


def markdown(df: DataFrame, limit: int = 200) -> str:
    """A table for reports, of at most `limit` rows."""
    rows = df.limit(limit).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])
