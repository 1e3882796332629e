"""Queries of the text operators: name -> (spark, folder of tables) -> DataFrame, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chashma.llm import copies, garbled, languages, leaks, lookalikes, near, proportions, quality, sentences, tokens
from chashma.llm.tables import table


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, folder, "documents"), "doc_id", "text")


def p8_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The hash of each document's text, decoded from its ids."""
    back = tokens.decode_corpus(tokens.encode_corpus(table(spark, folder, "documents"), "doc_id", "text"))
    return back.select("doc_id", F.sha2("text", 256).alias("text_sha256"))


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).where(F.col("longest_run") >= 10).select("doc_id", "item_id")


def p9_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """Also passages with substituted words: overlaps of at least ten words, three quarters of them equal."""
    return _leaks(spark, folder).where(F.col("overlap_words") >= 10)


def p9_leaked_items(spark: SparkSession, folder: str) -> DataFrame:
    found = _leaks(spark, folder).where(F.col("longest_run") >= 10).groupBy("item_id").agg(F.count("*").alias("documents"), F.max("longest_run").alias("longest_run"))
    return table(spark, folder, "eval_items").select("item_id", "split", "task").join(found, "item_id")


def _looks(spark: SparkSession, folder: str) -> DataFrame:
    rows = None
    for name, key, text, stored in (("routing_signal_audit", "sample_id", "sentence_text", None), ("validation_documents", "document_sample_id", "normalized_text", "normalized_text_sha256"), ("seen_texts", "text_id", "text_value", None)):
        sha = F.col(stored) if stored else F.lit(None).cast("string")
        part = table(spark, folder, name).select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("key"), F.col(text).alias("text"), sha.alias("stored_sha256"))
        rows = part if rows is None else rows.unionAll(part)
    return rows


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalikes.alike_pairs(_looks(spark, folder))


def p7_classes(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each row that looks like another but differs, with its class: no pairs."""
    return lookalikes.classes(_looks(spark, folder))


def p7_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Each text of the three tables in its form, rows delivered twice once: the hash of that form beside the stored one, and the hash that is equal for all texts that look the same."""
    rows = _looks(spark, folder).dropDuplicates(["table_name", "key", "text", "stored_sha256"])
    formed = lookalikes.with_forms(rows, F.col("key"), F.col("text"), "table_name", "stored_sha256")
    return formed.select("table_name", "key", "form", F.sha2("form", 256).alias("form_sha256"), "stored_sha256", F.sha2("skeleton", 256).alias("look_sha256"), (F.col("form") != F.col("text")).alias("changed"))


def _sampled(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return proportions.sample(table(spark, folder, "validation_documents"), table(spark, folder, "sampling_targets"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Parts whose sample lacks more than the draw left of them."""
    return proportions.report(*_sampled(spark, folder)).where("shortfall > 0").select(F.col("category").alias("part_number"))


def p1_quotas(spark: SparkSession, folder: str) -> DataFrame:
    return proportions.report(*_sampled(spark, folder)).withColumnRenamed("category", "part_number")


def p1_sample(spark: SparkSession, folder: str) -> DataFrame:
    drawn, _ = _sampled(spark, folder)
    return drawn.select(F.col("document_id").alias("source_record_id"), F.col("category").alias("part_number"), "sample_key")


def _records(spark: SparkSession, folder: str, index_text: str) -> DataFrame:
    """Rows of both tables; of duplicate_index the column `index_text`."""
    seen = table(spark, folder, "seen_texts").select(F.lit("seen_texts").alias("table_name"), F.col("text_id").alias("key"), F.col("text_value").alias("text"), F.col("occurrence_count").alias("occurrences"))
    index = table(spark, folder, "duplicate_index").select(F.lit("duplicate_index").alias("table_name"), F.col("first_source_record_id").alias("key"), F.col(index_text).alias("text"), F.col("occurrence_count").alias("occurrences"))
    return seen.unionAll(index)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return copies.copies(_records(spark, folder, "digest"))


def p2_records(spark: SparkSession, folder: str) -> DataFrame:
    return copies.collapse(_records(spark, folder, "digest"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return near.similar_pairs(_records(spark, folder, "text_preview"))


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each row that is like another, with its group and the classes of other word sets that its own is linked to."""
    return near.groups(_records(spark, folder, "text_preview"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return garbled.find_garbled(table(spark, folder, "documents")).select("doc_id").distinct()


def p10_restored(spark: SparkSession, folder: str) -> DataFrame:
    return garbled.find_garbled(table(spark, folder, "documents"))


def _statistics(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "routing_signal_audit")
    common = [r["word"] for r in table(spark, folder, "common_words").collect()]  # a fixed list
    return quality.statistics(rows, "sample_id", "sentence_text", quality.learn(rows, "sample_id", "sentence_text", common))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _statistics(spark, folder).where("kind != 'prose'").select(F.col("key").alias("sample_id"))


def p4_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return quality.ratios(_statistics(spark, folder)).withColumnRenamed("key", "sample_id")


def p4_measures(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics without the kind, which is the only one that is learnt."""
    return quality.ratios(_statistics(spark, folder)).withColumnRenamed("key", "sample_id").drop("kind")


def _segments(spark: SparkSession, folder: str, prose_only: bool = False) -> DataFrame:
    return languages.segments(table(spark, folder, "routing_signal_audit"), table(spark, folder, "common_words"), "sample_id", "sentence_text", "lang", prose_only)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return languages.relabelled(_segments(spark, folder, True)).select(F.col("key").alias("sample_id"), "lang")


def p5_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Of every row, `und` where there is no text."""
    return languages.languages(_segments(spark, folder)).withColumnRenamed("key", "sample_id")


def p5_segments(spark: SparkSession, folder: str) -> DataFrame:
    return _segments(spark, folder).select(F.col("key").alias("sample_id"), "segment", "start_char", "end_char", "lang", "confidence")


def _sentences(spark: SparkSession, folder: str, with_text: bool) -> DataFrame:
    return sentences.sentences(table(spark, folder, "routing_signal_audit"), "sample_id", "sentence_text", with_text, prose_only=not with_text)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Of prose, as lists, tables and junk are no cases."""
    return _sentences(spark, folder, False).where("sentence > 0").select(F.col("key").alias("sample_id"), "start_char")


def p6_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Of every text."""
    return _sentences(spark, folder, True).withColumnRenamed("key", "sample_id")


QUERIES = {f.__name__: f for f in (p6_found, p6_sentences, p4_found, p4_statistics, p4_measures, p5_found, p5_languages, p5_segments, p10_found, p10_restored, p3_found, p3_groups, p2_found, p2_records, p1_found, p1_quotas, p1_sample, p7_found, p7_classes, p7_forms, p8_ids, p8_round_trip, p9_found, p9_overlaps, p9_leaked_items)}
