"""Audits of sentence ends: what was split, what was protected, and in which family an odd split falls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chashma.functions import text as T
from chashma.operators.relate import neighbours
from chashma.operators.segment import ORDINALS

PROTECTED = ("INITIAL_BOUNDARY_PROTECTED", "DOTTED_NAME_OR_DOMAIN_PROTECTED", "ABBREVIATION_BOUNDARY_PROTECTED", "ROMAN_EXPANSION_INITIAL_PROTECTED", "SUSPICIOUS_ORDINAL_PERIOD_PROTECTED", "QUOTE_OR_SPEECH_CONTINUATION", "LOWERCASE_AFTER_STRONG_PUNCTUATION_PROTECTED")


def events(sentences: DataFrame, parents: DataFrame, id_col: str, text_col: str, around: int = 220) -> DataFrame:
    """One row for each flag of each sentence: the group, whether it split or protected, and the text around its end."""
    texts = parents.select(F.col(id_col).cast("bigint").alias("source_record_id"), F.col(text_col).alias("parent_text"))
    rows = sentences.select("source_record_id", "sentence_id", "sentence_start_char", "sentence_end_char", "segmentation_method", F.explode("boundary_flags").alias("boundary_group")).join(texts, "source_record_id")
    kind = F.when(F.col("boundary_group").isin(*PROTECTED), "PROTECT_NO_SPLIT").when(F.col("boundary_group") == "LOWERCASE_AFTER_TERMINAL", "SPLIT").otherwise("WHOLE_SENTENCE_REVIEW")
    return rows.select("source_record_id", "sentence_id", "boundary_group", kind.alias("event"), T.following_class(F.col("parent_text"), F.col("sentence_end_char")).alias("following"), T.context(F.col("parent_text"), F.col("sentence_end_char") - 1, F.col("sentence_end_char"), around).alias("context"))


def lowercase_families(sentences: DataFrame) -> DataFrame:
    """Sentences followed by a small letter, with the families their ends belong to."""
    rows = neighbours(sentences, "source_record_id", "sentence_index_in_record", "sentence_text").where(F.array_contains("boundary_flags", "LOWERCASE_AFTER_TERMINAL"))
    left, right = F.regexp_extract("sentence_text", r"(\S+)\s*\z", 1), F.regexp_extract(F.coalesce("next_text", F.lit("")), r"^\s*(\S+)", 1)
    return rows.select("source_record_id", "sentence_id", left.alias("left_token"), right.alias("right_token"), families(left, right).alias("families"))


def families(left: Column, right: Column) -> Column:
    found = T.flags(
        ("ELLIPSIS", left.rlike(r"(\.{2,}|…)[\"»”’)\]]*\z")), ("QUESTION_OR_EXCLAMATION", left.rlike(r"[!?][\"»”’)\]]*\z")), ("NUMBER_BEFORE", left.rlike(r"\d\.\z")), ("SHORT_TOKEN_BEFORE", left.rlike(r"^\p{L}{1,3}\.\z")),
        ("ORDINAL_BEFORE", left.rlike(r"(?i)inchi\.\z")), ("SUFFIX_AFTER", right.rlike(r"^(ning|ni|ga|da|dan)\b")), ("QUOTE_BEFORE", left.rlike(r"[\"»”’]\z")),
    )
    return F.when(F.size(found) == 0, F.array(F.lit("OTHER"))).otherwise(found)


def family_counts(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("families").alias("family")).groupBy("family").agg(F.count("*").alias("events"))


def token_pairs(rows: DataFrame, k: int = 30) -> DataFrame:
    """The k most frequent pairs of tokens around an end."""
    return rows.groupBy("left_token", "right_token").agg(F.count("*").alias("events")).orderBy(F.desc("events"), "left_token", "right_token").limit(k)


def roman_events(df: DataFrame, id_col: str, text_col: str, least_right: int = 12) -> DataFrame:
    """Ordinal phrases behind an initial: fragment, words behind it, and whether the end should be protected, with reasons."""
    pattern = rf"(?:^|\s)((?:[A-Z]|Sh|SH|Ch|CH|O['ʻʼ‘’]|G['ʻʼ‘’])\.\s+{ORDINALS})\.(\s+[^.!?…]*)"
    text = F.col(text_col)
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("fragment"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("right"))
    rows = df.where(text.isNotNull()).select(F.col(id_col).alias("source_record_id"), F.inline(both))
    words = F.regexp_count("right", F.lit(r"(?U)\S+"))
    why = T.flags(("FEW_WORDS_AFTER", words < least_right), ("METADATA_AFTER", F.col("right").rlike(r"(?i)\b(manba|foto|surat|muallif)\b")), ("NOT_LOWERCASE_AFTER", ~T.starts_lowercase(F.col("right"))))
    return rows.select("source_record_id", "fragment", words.alias("words_after"), why.alias("reasons")).withColumn("prediction", F.when(F.size("reasons") == 0, "PROTECT").otherwise("LEAVE"))


def triage(events: DataFrame, reviewed: DataFrame, key: list[str]) -> DataFrame:
    """Events with their review, if there is one, and what is left to do."""
    joined = events.join(reviewed.select(*key, "label"), key, "left")
    return joined.withColumn("triage", F.when(F.col("label").isNull() & (F.col("prediction") == "PROTECT"), "PENDING_PROTECT").when(F.col("label").isNull(), "PENDING_LEAVE").when(F.col("label") == F.col("prediction"), "AGREED").otherwise("DISPUTED"))


def inner_ends(text: Column) -> Column:
    """The text behind each mark or run of marks that has a letter or digit behind it, over line breaks too."""
    ends = T.places(text, r"[.!?…](?![.!?…])", T.PLACE)
    return F.filter(F.transform(ends, lambda at: F.substring(text, at + 2, 1 << 30)), lambda right: right.rlike(r"[\p{L}\p{N}]"))


def review_hints(events: DataFrame) -> DataFrame:
    """What to look at in a protected end: capital or digit behind it, few words, a quote, another end close by."""
    right = F.col("right")
    hints = T.flags(("CAPITAL_AFTER", right.rlike(r"^\s*\p{Lu}")), ("DIGIT_AFTER", right.rlike(r"^\s*\d")), ("SHORT_RIGHT_SIDE", F.regexp_count(right, F.lit(r"(?U)\S+")) < 4), ("QUOTE_NEAR", right.rlike(r"^\s*[\"«“]")), ("END_NEAR", F.substring(right, 1, 20).rlike("[.!?…]")))
    return events.withColumn("hints", hints)
