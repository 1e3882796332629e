"""Allow-listed normalisation of texts, its contract and an independent check. Only columns; nothing is shuffled but the check's join.

Null texts are invalid input: every field about the text is null and the status says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chashma.functions import text as T

TRIM = "TRIM_ONE_TRAILING_ASCII_SPACE"
SCHEMA_VERSION = "normalized_record_v1"
STATUSES = ("CHANGED_SAFE", "CHANGED_SAFE_REVIEW_REQUIRED", "UNCHANGED", "UNCHANGED_REVIEW_REQUIRED", "INVALID_INPUT_REVIEW_REQUIRED")


def trimmable(text: Column) -> Column:
    """One space at the end, and no blank before it. Only the last two characters are matched."""
    return F.right(text, F.lit(2)).rlike(r"(?U)^\S \z")


def apply_operations(text: Column, allowed: tuple[str, ...] = (TRIM,)) -> Column:
    return F.when(trimmable(text), F.left(text, F.length(text) - 1)).otherwise(text) if TRIM in allowed else text


def boundary_review_flags(text: Column) -> Column:
    """Flags of the raw text; of those about its end the first that holds."""
    end = (
        F.when(text.endswith("  "), "MULTIPLE_TRAILING_ASCII_SPACES")
        .when(text.endswith("\t"), "TRAILING_TAB")
        .when(text.endswith("\n") | text.endswith("\r"), "TRAILING_NEWLINE")
        .when(F.right(text, F.lit(2)).rlike(r"(?U)^\s \z"), "WHITESPACE_BEFORE_TRAILING_ASCII_SPACE")
        .when(F.right(text, F.lit(1)).rlike(r"(?U)^[\s&&[^ ]]\z"), "OTHER_TRAILING_WHITESPACE")
    )
    start = T.flags(("EMPTY_OR_WHITESPACE_TEXT", ~text.rlike(r"(?U)\S")), ("LEADING_WHITESPACE", F.left(text, F.lit(1)).rlike(r"(?U)^\s")))
    return F.array_sort(F.filter(F.concat(start, F.array(end)), lambda x: x.isNotNull()))


def status(changed: Column, review: Column) -> Column:
    return F.when(changed & review, STATUSES[1]).when(changed, STATUSES[0]).when(review, STATUSES[3]).otherwise(STATUSES[2])


def normalize(df: DataFrame, id_col: str, text_col: str, allowed: tuple[str, ...] = (TRIM,)) -> DataFrame:
    """One normalised record for each row: text, hashes, lengths, operations, review flags, gap rules and status."""
    raw = F.col("raw_text")
    high, ambiguous = tuple(T.HIGH_GAPS), tuple(T.AMBIGUOUS_GAPS)
    out = df.select(F.col(id_col).cast("bigint").alias("source_record_id"), F.col(text_col).alias("raw_text"))
    out = out.withColumn("normalized_text", apply_operations(raw, allowed))
    new = F.col("normalized_text")
    # one cheap pass decides whether the rules have to look; each step is used several times above it, so Catalyst keeps it apart
    out = out.withColumn("gap", T.gap_possible(new))
    none = F.when(raw.isNotNull(), F.array().cast("array<string>"))
    when_gap = lambda yes, no: F.when(F.col("gap"), yes).otherwise(no)
    zero = F.when(raw.isNotNull(), 0)
    total = lambda names: sum((T.gap_count(new, n) for n in names[1:]), T.gap_count(new, names[0]))
    out = out.withColumns(
        {
            "input_valid": raw.isNotNull(),
            "changed": raw != new,
            "high_confidence_gap_count": when_gap(total(high), zero),
            "ambiguous_gap_count": when_gap(total(ambiguous), zero),
            "high_confidence_rule_ids": when_gap(T.gap_rules_found(new, high), none),
            "ambiguous_rule_ids": when_gap(T.gap_rules_found(new, ambiguous), none),
            "boundary": boundary_review_flags(raw),
        }
    )
    gaps = T.flags(("HIGH_CONFIDENCE_APOSTROPHE_GAP", F.col("high_confidence_gap_count") > 0), ("AMBIGUOUS_APOSTROPHE_GAP", F.col("ambiguous_gap_count") > 0))
    out = out.withColumn("review_flags", F.when(raw.isNotNull(), F.array_sort(F.array_union("boundary", gaps))))
    return out.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), "source_record_id", "input_valid", T.sha256(raw).alias("raw_text_sha256"), T.sha256(new).alias("normalized_text_sha256"),
        F.length(raw).alias("raw_character_count"), F.length(new).alias("normalized_character_count"), (F.length(new) - F.length(raw)).alias("character_delta"), "normalized_text",
        F.when(raw.isNotNull(), F.when(F.col("changed"), F.array(F.lit(TRIM))).otherwise(F.array().cast("array<string>"))).alias("operations_applied"),
        F.when(F.col("changed"), 1).otherwise(0).alias("operation_count"),
        F.when(raw.isNull(), STATUSES[4]).otherwise(status(F.col("changed"), F.size("review_flags") > 0)).alias("normalization_status"),
        "review_flags", F.when(raw.isNull(), True).otherwise(F.size("review_flags") > 0).alias("review_required"),
        "high_confidence_gap_count", "ambiguous_gap_count", "high_confidence_rule_ids", "ambiguous_rule_ids",
    )


#: Row-level problems of the contract, as conditions on raw text and normalised record.
def contract_problems(raw: Column, allowed: tuple[str, ...] = (TRIM,)) -> dict[str, Column]:
    new, ops, n = F.col("normalized_text"), F.col("operations_applied"), F.size("operations_applied")
    changed = raw != new
    return {
        "unapproved_operation": F.size(F.array_except(ops, F.array(*map(F.lit, allowed)))) > 0,
        "unexplained_text_change": changed & (n == 0),
        "operation_without_text_change": ~changed & (n > 0),
        "invalid_trim_transformation": (n == 1) & ~(trimmable(raw) & (new == F.left(raw, F.length(raw) - 1))),
        "unexpected_operation_sequence": n > 1,
        "invalid_unchanged_delta": (n == 0) & (F.length(raw) != F.length(new)),
        "idempotence_failure": apply_operations(new, allowed) != new,
        "status_mismatch": F.col("normalization_status") != status(changed, F.col("review_required")),
        "review_boolean_mismatch": F.col("review_required") != (F.size("review_flags") > 0),
    }


def validate(raw: DataFrame, normalized: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Problem counts (problem, failing) of a run against its input, joined by id; also rows on one side only."""
    told = normalized.withColumnRenamed("source_record_id", "n_id")
    both = raw.select(F.col(id_col).cast("bigint").alias("r_id"), F.col(text_col).alias("raw_text")).join(told, F.col("r_id") == F.col("n_id"), "full_outer")
    valid = F.col("raw_text").isNotNull() & F.col("n_id").isNotNull()
    checks = {
        "missing_row": F.col("n_id").isNull(), "extra_row": F.col("r_id").isNull(), "raw_hash_mismatch": valid & (F.col("raw_text_sha256") != F.sha2("raw_text", 256)),
        "normalized_hash_mismatch": valid & (F.col("normalized_text_sha256") != F.sha2("normalized_text", 256)), "raw_count_mismatch": valid & (F.col("raw_character_count") != F.length("raw_text")),
        "delta_mismatch": valid & (F.col("character_delta") != F.col("normalized_character_count") - F.col("raw_character_count")), "schema_version_mismatch": F.col("n_id").isNotNull() & (F.col("schema_version") != SCHEMA_VERSION),
        "input_validity_mismatch": F.col("n_id").isNotNull() & F.col("r_id").isNotNull() & (F.col("input_valid") != F.col("raw_text").isNotNull()),
        **{k: valid & c for k, c in contract_problems(F.col("raw_text")).items()},
    }
    one = both.agg(*(F.count_if(c).alias(k) for k, c in checks.items()))
    return one.unpivot([], list(checks), "problem", "failing")


def split_valid(normalized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of valid input with their text, and rows of invalid input with what is known of them."""
    valid = normalized.where("input_valid").select("source_record_id", "normalized_text", "normalized_text_sha256", "normalization_status", "review_flags")
    return valid, normalized.where("NOT input_valid").select("source_record_id", "schema_version", "normalization_status")


def counters(normalized: DataFrame) -> DataFrame:
    """(kind, name, records): counts of statuses, flags and operations in one pass."""
    kinds = F.concat(
        F.array(F.struct(F.lit("status").alias("kind"), F.col("normalization_status").alias("name"))),
        F.transform(F.coalesce("review_flags", F.array().cast("array<string>")), lambda x: F.struct(F.lit("flag").alias("kind"), x.alias("name"))),
        F.transform(F.coalesce("operations_applied", F.array().cast("array<string>")), lambda x: F.struct(F.lit("operation").alias("kind"), x.alias("name"))),
    )
    return normalized.select(F.explode_outer(kinds).alias("k")).groupBy("k.kind", "k.name").agg(F.count("*").alias("records"))


def run_checks(normalized: DataFrame, raw: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(name, status, observed, expected) of equalities that hold for a whole run and its input; the row problems of `validate` are one of them."""
    c = F.col
    scalars = {"problems": validate(raw, normalized, id_col, text_col).agg(F.sum("failing").cast("bigint")), "source_rows": raw.agg(F.count("*")), "source_texts": raw.agg(F.count(text_col))}
    one = normalized.agg(
        F.count("*").alias("rows"), F.count_if("input_valid").alias("valid"), F.count_if(~c("input_valid")).alias("invalid"), F.count_if(c("operation_count") > 0).alias("changed"),
        F.count_if(c("normalization_status").startswith("CHANGED")).alias("changed_status"), F.count_if("review_required").alias("review"), F.sum("operation_count").cast("bigint").alias("operations"),
        F.coalesce(F.sum("character_delta"), F.lit(0)).cast("bigint").alias("delta"), F.count_if(c("review_required") & c("normalization_status").endswith("REVIEW_REQUIRED")).alias("review_status"), F.count_distinct("source_record_id").alias("ids"),
        F.count_if(c("input_valid") & c("normalization_status").startswith("UNCHANGED")).alias("unchanged"), F.count_if(c("input_valid") & ~c("review_required")).alias("without_review"), F.count_if(c("input_valid") & c("review_required")).alias("valid_review"),
    ).withColumns({n: d.scalar() for n, d in scalars.items()})
    pairs = {
        "input_output_record_count": (c("rows"), c("source_rows")), "texts_are_valid_rows": (c("valid"), c("source_texts")), "changed_and_unchanged_make_valid": (c("changed") + c("unchanged"), c("valid")), "review_and_no_review_make_valid": (c("valid_review") + c("without_review"), c("valid")), "no_row_problems": (c("problems"), F.lit(0).cast("bigint")),
        "valid_and_invalid_make_all": (c("valid") + c("invalid"), c("rows")), "changed_rows_have_changed_status": (c("changed_status"), c("changed")), "review_rows_have_review_status": (c("review_status"), c("review")),
        "one_operation_for_each_change": (c("operations"), c("changed")), "delta_is_minus_changes": (c("delta"), -c("changed")), "ids_are_unique": (c("ids"), c("rows")),
    }
    rows = F.array(*(F.struct(F.lit(k).alias("name"), F.when(a == b, "PASS").otherwise("FAIL").alias("status"), a.alias("observed"), b.alias("expected")) for k, (a, b) in pairs.items()))
    return one.select(F.inline(rows))
