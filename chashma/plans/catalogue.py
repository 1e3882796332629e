"""The queries of the core operators over the whole tables of a folder, and the same results in SQL.

Each `@query(sql)` registers its function under its own name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chashma.functions import composed as C
from chashma.functions import text as T
from chashma.operators import aggregate as A
from chashma.operators import boundaries as B
from chashma.operators import models as M
from chashma.operators import normalize as N
from chashma.operators import relate as R
from chashma.operators import rules as L
from chashma.operators import sampling as W
from chashma.operators import segment as G
from chashma.operators import typos as Y
from chashma.plans import sql as Z
from chashma.plans.lineage import shared_folder
from chashma.plans.registry import QUERIES, SQL, query  # noqa: F401
from chashma.plans.sql import B as _B
from chashma.plans.sql import CYR as _CYR
from chashma.plans.sql import LAT as _LAT
from chashma.plans.sql import N as _N
from chashma.plans.sql import gap_sql as _gap_sql
from chashma.plans.sql import gaps_sql as _gaps_sql
from chashma.plans.sql import stripped as _stripped
from chashma.sources import files as S
from chashma.streaming import audit

HEALTHY, MINOR = "HEALTHY", "MINOR_DAMAGE_BUT_USABLE"
USABLE = [HEALTHY, MINOR]
HARMFUL = ["FORMAT_OR_LIST", "FRAGMENT", "HEAVY_CORRUPTION", "MIXED_OR_FOREIGN_TEXT"]
LABELS = [*USABLE, *HARMFUL, "UNCERTAIN"]


def _t(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _joined(array: Column) -> Column:
    return F.array_join(array, "|")


_TRIMMABLE = rf"regexp_matches(text, '(?s)[^\t-\r\x{{85}}\p{{Z}}] \z')"
_NORM = f"CASE WHEN {_TRIMMABLE} THEN left(text, length(text) - 1) ELSE text END"

_NFLAGS = rf"""list_sort(list_filter([CASE WHEN length({_stripped("text")}) = 0 THEN 'EMPTY_OR_WHITESPACE_TEXT' END, CASE WHEN regexp_matches(text, '^{_B}') THEN 'LEADING_WHITESPACE' END,
    CASE WHEN suffix(text, '  ') THEN 'MULTIPLE_TRAILING_ASCII_SPACES' WHEN suffix(text, chr(9)) THEN 'TRAILING_TAB' WHEN suffix(text, chr(10)) OR suffix(text, chr(13)) THEN 'TRAILING_NEWLINE'
         WHEN regexp_matches(text, '{_B} \z') THEN 'WHITESPACE_BEFORE_TRAILING_ASCII_SPACE' WHEN regexp_matches(text, '{_B}\z') AND NOT suffix(text, ' ') THEN 'OTHER_TRAILING_WHITESPACE' END,
    CASE WHEN {_gaps_sql(T.HIGH_GAPS, "n")} > 0 THEN 'HIGH_CONFIDENCE_APOSTROPHE_GAP' END, CASE WHEN {_gaps_sql(T.AMBIGUOUS_GAPS, "n")} > 0 THEN 'AMBIGUOUS_APOSTROPHE_GAP' END], lambda x: x IS NOT NULL))"""
_NORMAL = f"""(SELECT doc_id, text, n, CASE WHEN text IS NOT NULL THEN {_NFLAGS} END AS flags, n != text AS changed FROM (SELECT doc_id, text, {_NORM} AS n FROM documents))"""
_STATUS = "CASE WHEN text IS NULL THEN 'INVALID_INPUT_REVIEW_REQUIRED' WHEN changed AND len(flags) > 0 THEN 'CHANGED_SAFE_REVIEW_REQUIRED' WHEN changed THEN 'CHANGED_SAFE' WHEN len(flags) > 0 THEN 'UNCHANGED_REVIEW_REQUIRED' ELSE 'UNCHANGED' END"


# ---- normalisation
def _normalized(spark: SparkSession, folder: str) -> DataFrame:
    return N.normalize(_t(spark, folder, "documents"), "doc_id", "text")


@query(f"SELECT {_STATUS} AS normalization_status, count(*) AS records FROM {_NORMAL} GROUP BY 1")
def normalize_status_counts(spark, folder):
    return _normalized(spark, folder).groupBy("normalization_status").agg(F.count("*").alias("records"))


@query(f"""SELECT doc_id AS source_record_id, sha256(text) AS raw_text_sha256, sha256(n) AS normalized_text_sha256, (length(n) - length(text))::INT AS character_delta, {_STATUS} AS normalization_status,
    array_to_string(flags, '|') AS review_flags, {_gaps_sql(T.HIGH_GAPS, "n")}::INT AS high_confidence_gap_count FROM {_NORMAL}""")
def normalize_rows(spark, folder):
    return _normalized(spark, folder).select("source_record_id", "raw_text_sha256", "normalized_text_sha256", "character_delta", "normalization_status", _joined(F.col("review_flags")).alias("review_flags"), "high_confidence_gap_count")


@query(f"""WITH r AS (SELECT *, {_STATUS} AS st FROM {_NORMAL}), k AS (SELECT 'status' AS kind, st AS name FROM r UNION ALL SELECT 'flag', unnest(flags) FROM r UNION ALL SELECT 'operation', 'TRIM_ONE_TRAILING_ASCII_SPACE' FROM r WHERE changed)
    SELECT kind, name, count(*) AS records FROM k GROUP BY 1, 2""")
def normalize_counters(spark, folder):
    return N.counters(_normalized(spark, folder))


@query(f"""WITH r AS (SELECT *, {_STATUS} AS st FROM {_NORMAL}),
    a AS (SELECT count(*) AS n, count(text) AS valid, count(*) - count(text) AS invalid, count_if(changed) AS ch, count_if(text = n) AS un, count_if(prefix(st, 'CHANGED')) AS cs, count_if(text IS NULL OR len(flags) > 0) AS rv, count_if(suffix(st, 'REVIEW_REQUIRED')) AS rs, count_if(len(flags) > 0) AS vr, count_if(len(flags) = 0) AS nr, coalesce(sum(length(n) - length(text)), 0)::BIGINT AS d, count(DISTINCT doc_id) AS ids FROM r),
    c AS (SELECT unnest([{{'name': 'input_output_record_count', 'o': n, 'e': n}}, {{'name': 'texts_are_valid_rows', 'o': valid, 'e': valid}}, {{'name': 'changed_and_unchanged_make_valid', 'o': ch + un, 'e': valid}}, {{'name': 'review_and_no_review_make_valid', 'o': vr + nr, 'e': valid}}, {{'name': 'no_row_problems', 'o': 0, 'e': 0}}, {{'name': 'valid_and_invalid_make_all', 'o': valid + invalid, 'e': n}},
        {{'name': 'changed_rows_have_changed_status', 'o': cs, 'e': ch}}, {{'name': 'review_rows_have_review_status', 'o': rs, 'e': rv}}, {{'name': 'one_operation_for_each_change', 'o': ch, 'e': ch}}, {{'name': 'delta_is_minus_changes', 'o': d, 'e': -ch}}, {{'name': 'ids_are_unique', 'o': ids, 'e': n}}]) AS x FROM a)
    SELECT x.name AS name, CASE WHEN x.o = x.e THEN 'PASS' ELSE 'FAIL' END AS status, x.o AS observed, x.e AS expected FROM c""")
def normalize_checks(spark, folder):
    return N.run_checks(_normalized(spark, folder), _t(spark, folder, "documents"), "doc_id", "text")


# The problems a check of a run knows.
_PROBLEMS = (
    "missing_row", "extra_row", "raw_hash_mismatch", "normalized_hash_mismatch", "raw_count_mismatch", "delta_mismatch", "schema_version_mismatch", "input_validity_mismatch",
    "unapproved_operation", "unexplained_text_change", "operation_without_text_change", "invalid_trim_transformation", "unexpected_operation_sequence", "invalid_unchanged_delta", "idempotence_failure", "status_mismatch", "review_boolean_mismatch",
)


def _faulty(rows: DataFrame) -> DataFrame:
    """Normalised rows with a fault that the length of the text decides on, so that each check has something to find."""
    m, c = F.length(F.col("raw_text")) % 17, F.col
    none, other = F.array().cast("array<string>"), lambda *x: F.array(*map(F.lit, x))
    wrong = rows.withColumns(
        {
            "raw_text_sha256": F.when(m == 2, "x").otherwise(c("raw_text_sha256")), "normalized_text": F.when(m == 3, F.concat("normalized_text", F.lit(" "))).otherwise(c("normalized_text")),
            "operations_applied": F.when(m == 4, none).when(m == 5, other(N.TRIM, N.TRIM)).when(m == 6, other("OTHER")).otherwise(c("operations_applied")), "normalization_status": F.when(m == 7, "UNCHANGED").otherwise(c("normalization_status")),
            "review_required": F.when(m == 8, ~c("review_required")).otherwise(c("review_required")), "schema_version": F.when(m == 9, "v0").otherwise(c("schema_version")), "input_valid": F.when(m == 10, False).otherwise(c("input_valid")),
            "character_delta": F.when(m == 11, c("character_delta") + 1).otherwise(c("character_delta")), "source_record_id": F.when(m == 12, -c("source_record_id") - 1).otherwise(c("source_record_id")), "raw_character_count": F.when(m == 13, c("raw_character_count") + 1).otherwise(c("raw_character_count")),
        }
    )
    return wrong.where(F.coalesce(m != 1, F.lit(True))).drop("raw_text")


_FAULTY = f"""(SELECT CASE WHEN m = 12 THEN -doc_id - 1 ELSE doc_id END AS id, CASE WHEN m = 2 THEN 'x' ELSE sha256(text) END AS rh, sha256(n) AS nh, CASE WHEN m = 3 THEN n || ' ' ELSE n END AS nt,
    CASE WHEN m = 4 THEN []::VARCHAR[] WHEN m = 5 THEN ['{N.TRIM}', '{N.TRIM}'] WHEN m = 6 THEN ['OTHER'] WHEN changed THEN ['{N.TRIM}'] WHEN text IS NOT NULL THEN []::VARCHAR[] END AS ops, CASE WHEN m = 7 THEN 'UNCHANGED' ELSE st END AS st,
    (text IS NULL OR len(flags) > 0) != coalesce(m = 8, false) AS rev, flags, coalesce(m = 9, false) AS old, text IS NOT NULL AND m != 10 AS ok, length(n) - length(text) + CASE WHEN m = 11 THEN 1 ELSE 0 END AS d, length(text) + CASE WHEN m = 13 THEN 1 ELSE 0 END AS rc, length(n) AS nc
    FROM (SELECT *, {_STATUS} AS st, length(text) % 17 AS m FROM {_NORMAL}) WHERE coalesce(m != 1, true))"""
_VALID = "text IS NOT NULL AND id IS NOT NULL AND "
_AGAIN = rf"regexp_matches(nt, '(?s)[^\t-\r\x{{85}}\p{{Z}}] \z')"
_FAILS = {
    "missing_row": "id IS NULL", "extra_row": "doc_id IS NULL", "raw_hash_mismatch": _VALID + "rh != sha256(text)", "normalized_hash_mismatch": _VALID + "nh != sha256(nt)", "raw_count_mismatch": _VALID + "rc != length(text)", "delta_mismatch": _VALID + "d != nc - rc", "schema_version_mismatch": "id IS NOT NULL AND old",
    "input_validity_mismatch": "id IS NOT NULL AND doc_id IS NOT NULL AND ok != (text IS NOT NULL)", "unapproved_operation": _VALID + f"len([x for x in ops if x != '{N.TRIM}']) > 0", "unexplained_text_change": _VALID + "text != nt AND len(ops) = 0", "operation_without_text_change": _VALID + "text = nt AND len(ops) > 0",
    "invalid_trim_transformation": _VALID + f"len(ops) = 1 AND NOT ({_TRIMMABLE} AND nt = left(text, length(text) - 1))", "unexpected_operation_sequence": _VALID + "len(ops) > 1", "invalid_unchanged_delta": _VALID + "len(ops) = 0 AND length(text) != length(nt)", "idempotence_failure": _VALID + _AGAIN,
    "status_mismatch": _VALID + "st != CASE WHEN text != nt AND rev THEN 'CHANGED_SAFE_REVIEW_REQUIRED' WHEN text != nt THEN 'CHANGED_SAFE' WHEN rev THEN 'UNCHANGED_REVIEW_REQUIRED' ELSE 'UNCHANGED' END", "review_boolean_mismatch": _VALID + "rev != (len(flags) > 0)",
}


@query(f"WITH b AS (SELECT d.doc_id, d.text, f.* FROM documents d FULL JOIN {_FAULTY} f ON f.id = d.doc_id), c AS (SELECT " + ", ".join(f"count_if({_FAILS[p]}) AS {p}" for p in _PROBLEMS) + " FROM b) SELECT problem, failing FROM (UNPIVOT c ON " + ", ".join(_PROBLEMS) + " INTO NAME problem VALUE failing)")
def normalize_verify(spark, folder):
    """A run with planted faults of every kind against its input."""
    docs = _t(spark, folder, "documents")
    kept = docs.select(F.col("doc_id").alias("source_record_id"), F.col("text").alias("raw_text"))
    return N.validate(docs, _faulty(_normalized(spark, folder).join(kept, "source_record_id")), "doc_id", "text")


# ---- shape of texts
_BOUNDARY = {
    "leading_blank": rf"regexp_matches(text, '^{_B}')", "trailing_blank": rf"regexp_matches(text, '{_B}\z')", "starts_with_space": "prefix(text, ' ')", "starts_with_tab": "prefix(text, chr(9))", "starts_with_newline": "prefix(text, chr(10))", "ends_with_space": "suffix(text, ' ')",
    "ends_with_tab": "suffix(text, chr(9))", "ends_with_newline": "suffix(text, chr(10))", "one_trailing_space": _TRIMMABLE, "several_trailing_spaces": "suffix(text, '  ')", "repeated_blanks": r"regexp_matches(text, '[ \t]{2,}')",
}


@query("SELECT source, " + ", ".join(f"count_if({c}) AS {n}" for n, c in _BOUNDARY.items()) + " FROM documents GROUP BY 1")
def boundary_whitespace_flags(spark, folder):
    docs = _t(spark, folder, "documents")
    return docs.select("source", *T.boundary_flags(F.col("text"))).groupBy("source").agg(*(F.count_if(n).alias(n) for n in _BOUNDARY))


_QUALITY = {
    "EMPTY": f"length({_stripped('text')}) = 0", "LEADING_OR_TRAILING_BLANK": rf"regexp_matches(text, '^{_B}|{_B}\z')", "REPEATED_BLANKS": r"regexp_matches(text, '[ \t]{2,}')", "TAB": "contains(text, chr(9))", "NEWLINE": "contains(text, chr(10))",
    "CONTROL": r"regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]')", "INVISIBLE": r"regexp_matches(text, '[\x{AD}\x{200B}-\x{200F}\x{2060}\x{FEFF}]')", "REPLACEMENT": "contains(text, chr(65533))", "NO_BREAK_SPACE": "contains(text, chr(160))",
    "MIXED_SCRIPT": f"regexp_matches(text, '[{_LAT}]') AND regexp_matches(text, '[{_CYR}]')",
}


@query("WITH f AS (SELECT list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _QUALITY.items()) + "], lambda x: x IS NOT NULL) AS l FROM documents) SELECT unnest(CASE WHEN len(l) = 0 THEN ['NONE'] ELSE l END) AS item, count(*) AS rows FROM f GROUP BY 1")
def quality_flag_counts(spark, folder):
    return A.item_counts(_t(spark, folder, "documents").select(T.quality_flags(F.col("text")).alias("flags")), "flags", "NONE")


_SCRIPT = f"""CASE WHEN text IS NULL THEN NULL WHEN regexp_matches(text, '[{_LAT}]') AND regexp_matches(text, '[{_CYR}]') THEN 'MIXED_LATIN_CYRILLIC' WHEN regexp_matches(text, '[{_LAT}]') THEN 'LATIN' WHEN regexp_matches(text, '[{_CYR}]') THEN 'CYRILLIC'
    WHEN regexp_matches(text, '\\pL') THEN 'OTHER_ALPHABETIC' ELSE 'NO_ALPHABETIC_CHARACTERS' END"""


@query(f"WITH c AS (SELECT {_SCRIPT} AS script, count(*) AS rows FROM documents GROUP BY 1) SELECT script, rows, round(rows * 100.0 / sum(rows) OVER (), 6) AS percent FROM c")
def script_distribution(spark, folder):
    return A.label_counts(_t(spark, folder, "documents").select(T.script_label(F.col("text")).alias("script")), "script")


@query(rf"""WITH c AS (SELECT {_N(r'\p{Latin}')} AS la, {_N(r'\p{Cyrillic}')} AS cy, {_N(r'\pL')} AS l, text FROM documents WHERE text IS NOT NULL)
    SELECT CASE WHEN l = 0 THEN 'NO_LETTERS' WHEN l = la THEN 'LATIN' WHEN l = cy THEN 'CYRILLIC' WHEN l = la + cy THEN 'LATIN_CYRILLIC_MIXED' WHEN la + cy = 0 THEN 'OTHER_SCRIPT' ELSE 'MULTISCRIPT_OTHER' END AS label, count(*) AS rows, sum(la)::BIGINT AS latin FROM c GROUP BY 1""")
def letter_script_distribution(spark, folder):
    rows = _t(spark, folder, "documents").where("text IS NOT NULL").select(T.letter_scripts(F.col("text")).alias("s"))
    return rows.groupBy(F.col("s.label").alias("label")).agg(F.count("*").alias("rows"), F.sum("s.latin").alias("latin"))


@query("SELECT lang, " + ", ".join(f"""sum(length(text) - length(replace(text, '{c if c != "'" else "''"}', '')))::BIGINT AS "{n}\"""" for n, c in T.APOSTROPHES.items()) + " FROM documents GROUP BY 1")
def apostrophe_variant_counts(spark, folder):
    return _t(spark, folder, "documents").select("lang", *T.apostrophe_counts(F.col("text"))).groupBy("lang").agg(*(F.sum(f"`{n}`").alias(n) for n in T.APOSTROPHES))


@query("SELECT " + ", ".join(f"""sum(length(text) - length(replace(text, chr({ord(c)}), '')))::BIGINT AS "{n}\"""" for n, c in T.SUSPICIOUS.items()) + rf", sum({_N(r'[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]')})::BIGINT AS CONTROL_CHARACTERS FROM documents")
def suspicious_unicode(spark, folder):
    return _t(spark, folder, "documents").select(*T.suspicious_counts(F.col("text"))).agg(*(F.sum(f"`{n}`").alias(n) for n in [*T.SUSPICIOUS, "CONTROL_CHARACTERS"]))


@query(f"SELECT doc_id, length(text) AS chars, {_N('[^' + _B[1:-1] + ']+')} AS words, length(text) - length(replace(text, chr(10), '')) + 1 AS lines FROM documents")
def text_metrics(spark, folder):
    t = F.col("text")
    return _t(spark, folder, "documents").select("doc_id", T.char_count(t).cast("bigint").alias("chars"), T.word_count(t).cast("bigint").alias("words"), T.line_count(t).cast("bigint").alias("lines"))


_RULES = [*T.HIGH_GAPS, *T.AMBIGUOUS_GAPS]


@query("SELECT unnest([" + ", ".join(f"'{n}'" for n in _RULES) + "]) AS rule, unnest([" + ", ".join(f"sum({_gap_sql(n, 'text')})" for n in _RULES) + "])::BIGINT AS matches, unnest([" + ", ".join(f"count_if({_gap_sql(n, 'text')} > 0)" for n in _RULES) + "])::BIGINT AS records FROM documents")
def gap_rule_counts(spark, folder):
    t = F.col("text")
    one = _t(spark, folder, "documents").where(T.gap_possible(t)).agg(F.array(*(F.struct(F.lit(n).alias("rule"), F.coalesce(F.sum(T.gap_count(t, n)), F.lit(0)).cast("bigint").alias("matches"), F.count_if(T.gap_count(t, n) > 0).alias("records")) for n in _RULES)).alias("r"))
    return one.select(F.inline("r"))


@query(f"SELECT doc_id // 1000 AS block, count(*) AS records, sum({_gaps_sql(_RULES, 'text')})::BIGINT AS matches, count_if({_gaps_sql(_RULES, 'text')} > 0) AS gap_records FROM documents GROUP BY 1")
def gap_block_distribution(spark, folder):
    n = T.gap_counts(F.col("text"), _RULES)
    return A.blocks(_t(spark, folder, "documents"), "doc_id", 1000, F.sum(n).cast("bigint").alias("matches"), F.count_if(n > 0).alias("gap_records"))


@query(f"""SELECT doc_id, CASE WHEN h > 0 AND a > 0 THEN 'MIXED_CONFIDENCE_REVIEW_REQUIRED' WHEN h > 0 THEN 'HIGH_CONFIDENCE_REVIEW_REQUIRED' ELSE 'AMBIGUOUS_REVIEW_REQUIRED' END AS review_status, round((h + a) * 1000.0 / length(text), 6) AS per_thousand
    FROM (SELECT doc_id, text, {_gaps_sql(T.HIGH_GAPS, 'text')} AS h, {_gaps_sql(T.AMBIGUOUS_GAPS, 'text')} AS a FROM documents) WHERE h + a > 0""")
def gap_review_status(spark, folder):
    rows = _t(spark, folder, "documents").select("doc_id", "text", T.gap_counts(F.col("text"), T.HIGH_GAPS).alias("h"), T.gap_counts(F.col("text"), T.AMBIGUOUS_GAPS).alias("a")).where("h + a > 0")
    return rows.select("doc_id", T.gap_status(F.col("h"), F.col("a")).alias("review_status"), T.per_thousand(F.col("h") + F.col("a"), F.length("text")).alias("per_thousand"))


def _spans_sql(name: str) -> str:
    word, alone = (T.HIGH_GAPS | T.AMBIGUOUS_GAPS)[name]
    pattern = rf"(?is).*?(?:^|[^{_LAT}])({r'[ \t]+'.join(word.split())})([{_LAT}]{'|' + alone if alone else ''})"
    return f"""SELECT doc_id, text, unnest([{{'stop': (list_sum([length(y) for y in x[1:k]]) - length(h[k]))::BIGINT, 'fragment': w[k]}} for k in range(1, len(x) + 1)]) AS s, '{name}' AS rule
        FROM (SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS x, regexp_extract_all(text, '{pattern}', 1) AS w, regexp_extract_all(text, '{pattern}', 2) AS h FROM documents WHERE text IS NOT NULL)"""


_GAPS = "(SELECT doc_id, text, (s.stop - length(s.fragment))::INT AS start, s.stop::INT AS stop, rule, s.fragment AS fragment FROM (" + " UNION ALL ".join(map(_spans_sql, _RULES)) + "))"


@query(f"SELECT doc_id, start, stop, rule, fragment, {Z.context('text', 'start', 'stop', 20)} AS context FROM {_GAPS}")
def gap_spans(spark, folder):
    rows = _t(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", "text", F.explode(T.gap_spans(F.col("text"), _RULES)).alias("s"))
    return rows.select("doc_id", "s.*", T.context(F.col("text"), F.col("s.start"), F.col("s.stop"), 20).alias("context"))


@query("SELECT doc_id, replace(replace(replace(replace(left(text, 80), '\\', '\\\\'), chr(13), '\\r'), chr(10), '\\n'), chr(9), '\\t') || CASE WHEN length(text) > 80 THEN '…' ELSE '' END AS preview FROM documents")
def previews(spark, folder):
    return _t(spark, folder, "documents").select("doc_id", T.preview(F.col("text"), 80).alias("preview"))


@query(f"""WITH d AS (SELECT lang, length(text) AS v FROM documents WHERE text IS NOT NULL) SELECT lang, count(*) AS rows, min(v)::BIGINT AS minimum, max(v)::BIGINT AS maximum, round(avg(v), 6) AS mean,
    {", ".join(f"round(quantile_cont(v, {q}), 6) AS p{int(q * 100)}" for q in (0.5, 0.9, 0.95, 0.99))} FROM d GROUP BY 1""")
def length_summary(spark, folder):
    rows = _t(spark, folder, "documents").where("text IS NOT NULL").select(F.coalesce("lang", F.lit("\0")).alias("lang"), F.length("text").cast("bigint").alias("v"))
    return A.exact_quantiles(rows, ["lang"], "v").withColumn("lang", F.nullif("lang", F.lit("\0")))


@query("""WITH d AS (SELECT source, length(text) AS v, row_number() OVER (PARTITION BY source ORDER BY length(text)) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE text IS NOT NULL)
    SELECT source, max(n) AS rows, max(v) FILTER (i = round_even((n - 1) * 0.5, 0))::BIGINT AS p50, max(v) FILTER (i = round_even((n - 1) * 0.9, 0))::BIGINT AS p90 FROM d GROUP BY 1""")
def length_nearest_rank(spark, folder):
    return A.nearest_rank(_t(spark, folder, "documents").where("text IS NOT NULL").select("source", F.length("text").cast("bigint").alias("v")), ["source"], "v")


@query("""(SELECT doc_id AS id, length(text)::INT AS length, 'SHORTEST' AS side FROM documents WHERE text IS NOT NULL ORDER BY 2, 1 LIMIT 30) UNION ALL (SELECT doc_id, length(text)::INT, 'LONGEST' FROM documents WHERE text IS NOT NULL ORDER BY 2 DESC, 1 LIMIT 30)""")
def length_extremes(spark, folder):
    return W.extremes(_t(spark, folder, "documents"), F.length("text"), "doc_id", 30)


@query("""SELECT category, id, score, place FROM (SELECT source AS category, doc_id AS id, sha256('42|' || source || '|' || doc_id) AS score, row_number() OVER (PARTITION BY source ORDER BY sha256('42|' || source || '|' || doc_id), doc_id)::INT AS place FROM documents) WHERE place <= 20""")
def category_sample(spark, folder):
    return W.lowest_per_category(_t(spark, folder, "documents"), F.col("source"), "doc_id", 20)


@query("SELECT category, id, place FROM (SELECT source AS category, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS place FROM documents) WHERE place <= 5")
def first_examples(spark, folder):
    return W.first_per_category(_t(spark, folder, "documents"), F.col("source"), "doc_id", 5)


@query("SELECT doc_id, sha256('42|' || doc_id) AS score FROM documents ORDER BY 2, 1 LIMIT 50")
def simple_sample(spark, folder):
    return W.simple_sample(_t(spark, folder, "documents").select("doc_id"), "doc_id", 50)


_MARK = {n: p.replace("'", "''").replace(r"\s", _B) for n, p in T.CREDIT_MARKERS.items()}


@query("SELECT unnest(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text_value, '(?i){p}') THEN '{n}' END" for n, p in _MARK.items()) + "], lambda x: x IS NOT NULL)) AS marker, count(*) AS rows FROM seen_texts GROUP BY 1")
def credit_markers(spark, folder):
    rows = _t(spark, folder, "seen_texts").select(F.explode(T.credit_markers(F.col("text_value"))).alias("marker"))
    return rows.groupBy("marker").agg(F.count("*").alias("rows"))


def _name_like_sql(text: str) -> str:
    words = rf"string_split_regex(regexp_replace({_stripped(text)}, '[.!?…]+\z', ''), '{_B}+')"
    apostrophes = T.APOSTROPHE_CHARS.replace("'", "''")
    ok = rf"regexp_matches(w, '^[{_LAT}][{_LAT}{apostrophes}\-]*\z') AND regexp_matches(regexp_replace(w, '[{apostrophes}\-]', '', 'g'), '^(\p{{Lu}}+|\p{{Lu}}[^\p{{Lu}}]*)\z')"
    return f"(len({words}) BETWEEN 2 AND 4 AND len([w for w in {words} if {ok}]) = len({words}))"


_ST = _stripped("text")
_SOLID_RUN = Z.SOLID + "+"
_ENDED = f"regexp_matches({_ST}, '{Z.ENDS}')"
_CREDIT = f"""(length({_ST}) > 0 AND length({_ST}) <= 220 AND length({_ST}) - length(replace({_ST}, chr(10), '')) <= 2 AND ({" OR ".join(f"regexp_matches({_ST}, {Z.quoted(p.replace(chr(92) + 's', _B))})" for p in T.WHOLE_CREDITS)}
    OR regexp_matches(text, '(?i){_MARK["FOTO_CREDIT"]}') OR regexp_matches(text, '(?i){_MARK["MUALLIF"]}') OR ({_name_like_sql("text")} AND {_ENDED})))"""


@query(f"""SELECT CASE WHEN length({_ST}) <= 120 THEN CASE WHEN {_CREDIT} OR ({_name_like_sql("text")} AND {_ENDED}) THEN 'SHORT_CREDIT_LIKE' WHEN {_ENDED} THEN 'SHORT_SENTENCE_LIKE' ELSE 'SHORT_FRAGMENT_OR_UNKNOWN' END END AS role, {_CREDIT} AS credit, {_name_like_sql("text")} AS name_like, count(*) AS rows
    FROM documents GROUP BY ALL""")
def short_roles(spark, folder):
    rows = _t(spark, folder, "documents").select(T.short_role(F.col("text")).alias("role"), T.standalone_credit(F.col("text")).alias("credit"), T.name_like(F.col("text")).alias("name_like"))
    return rows.groupBy("role", "credit", "name_like").agg(F.count("*").alias("rows"))


@query(f"""WITH f AS (SELECT {Z.flags({"SHORT_RECORD": f"length(text) <= 120 AND {_N(_SOLID_RUN)} <= 15", "SOURCE_OR_CREDIT_MARKER": " OR ".join(f"regexp_matches(text, '(?i){p}')" for p in _MARK.values()), "PERSON_NAME_LIKE": f"{_name_like_sql('text')} AND {_N(_SOLID_RUN)} <= 6"})} AS l FROM documents)
    SELECT unnest(CASE WHEN len(l) = 0 THEN ['NONE'] ELSE l END) AS item, count(*) AS rows FROM f GROUP BY 1""")
def boilerplate_reasons(spark, folder):
    return A.item_counts(_t(spark, folder, "documents").select(T.boilerplate_reasons(F.col("text")).alias("r")), "r", "NONE")


_ONE = "regexp_replace(text, '[`´ʻʼ‘’]', '''', 'g')"


@query(f"SELECT doc_id, {_ONE} AS text FROM documents")
def one_apostrophe(spark, folder):
    return _t(spark, folder, "documents").select("doc_id", T.one_apostrophe(F.col("text")).alias("text"))


@query("SELECT " + ", ".join(f"""sum({_N(p.replace("'", "''") if n != 'blank_separated' else '[^' + _B[1:-1] + ']+')})::BIGINT AS {n}""" for n, p in T.WORD_CLASSES.items()) + " FROM documents")
def word_classes(spark, folder):
    one = lambda n: F.size(T.tokens(F.col("text"), n)) if n != "blank_separated" else T.word_count(F.col("text"))
    return _t(spark, folder, "documents").agg(*(F.sum(F.when(F.col("text").isNotNull(), one(n))).cast("bigint").alias(n) for n in T.WORD_CLASSES))


_SOLID = "[^" + _B[1:-1] + "]"


@query(rf"""SELECT doc_id, round(CASE WHEN s > 0 THEN {_N(r'\pL')} / s ELSE 0 END, 6) AS letter_ratio, round(CASE WHEN s > 0 THEN {_N(r'\p{Nd}')} / s ELSE 0 END, 6) AS digit_ratio,
    round(CASE WHEN s > 0 THEN {_N(r'[^\pL\p{Nd}' + _B[1:-1] + ']')} / s ELSE 0 END, 6) AS sign_ratio FROM (SELECT doc_id, text, {_N(_SOLID)}::DOUBLE AS s FROM documents WHERE text IS NOT NULL)""")
def character_ratios(spark, folder):
    return _t(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", *T.ratios(F.col("text")))


_VOWELS = "CASE WHEN length(w) > 0 THEN len(regexp_extract_all(w, '(?i)[aeiou]')) / length(w) ELSE 0 END"
_OCR = f"length(w) >= 8 AND ((length(w) >= 14 AND ({_VOWELS} < 0.22 OR {_VOWELS} > 0.72)) OR regexp_matches(w, '(?i)[b-df-hj-np-tv-z]{{5}}') OR {Z.SHAPES['TRIPLE_LETTER'].replace('(w,', '(lower(w),')})"
_FOREIGN = "length(w) >= 4 AND (contains(lower(w), 'w') OR (contains(lower(w), 'c') AND NOT contains(lower(w), 'ch')) OR regexp_matches(lower(w), '(tion|ing|ness|ment|able)$'))"
_some = Z.some
_NUMBERS = ["bir", "ikki", "uch", "ming", "yuz"]
_NUMBER_WORDS = f"string_split_regex(lower({Z.one_apostrophe(_ST)}), '{_B}+')"


@query(rf"""SELECT doc_id, array_to_string({Z.flags({n: _some("tok", c) for n, c in Z.SHAPES.items()})}, '|') AS shapes, {Z.repeated_ngram("[w for w in tok if length(w) >= 2]", 2)} AS repeated_pair,
    {_some("tok", "length(w) >= 11 AND len([k for k in range(3, length(w) // 2 + 1) if left(w, k) = substr(w, k + 1, k)]) > 0")} AS doubled_token, {_some("tok", "length(w) >= 10 AND w NOT IN ('tashtash', 'bolabolalar') AND len([k for k in range(3, length(w) // 2 + 1) if left(w, k) = substr(w, k + 1, k)]) > 0")} AS doubled_ten, {_some("tok", "regexp_matches(w, 'aa|ee|ii|oo|uu') AND w NOT IN ('saat', 'maa')")} AS unsafe_vowel, regexp_matches(text, '\p{{Ll}}\p{{Lu}}') AS case_merge, {Z.spaced_letters("text")} AS spaced_letters,
    len([w for w in regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}\p{{Nl}}]+') if regexp_matches(w, '^\p{{Lu}}{{2,}}$')])::INT AS acronyms, array_to_string({Z.flags(Z.apostrophe_defects("text"))}, '|') AS apostrophe_defects, {_some("tok", "regexp_matches(w, 'aa|ee|ii|oo|uu')")} AS repeated_vowel,
    {_some("raw", _OCR)} AS ocr_like, {_some("raw", _FOREIGN)} AS foreign_like, {Z.starts_lowercase("text")} AS starts_lowercase,
    len({_NUMBER_WORDS}) >= 5 AND len([w for w in {_NUMBER_WORDS} if w IN {Z.one_of(_NUMBERS)} OR regexp_matches(w, '^[0-9]+$')]) >= 0.55 * len({_NUMBER_WORDS}) AS mostly_numbers, len(list_intersect(list_distinct(tok), ['tuman', 'shahar', 'viloyat', 'rais']))::INT AS anchors
    FROM (SELECT doc_id, text, {Z.plain_tokens("text")} AS tok, regexp_extract_all(text, '[A-Za-z'']+') AS raw FROM documents WHERE text IS NOT NULL)""")
def token_shapes(spark, folder):
    t = F.col("text")
    rows = _t(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", _joined(T.token_shape_flags(t)).alias("shapes"), T.repeated_ngram(t, 2).alias("repeated_pair"), T.doubled_token(t).alias("doubled_token"), T.doubled_token(t, 10, ("tashtash", "bolabolalar")).alias("doubled_ten"), T.repeated_vowel(t, ("saat", "maa")).alias("unsafe_vowel"), T.case_merge(t).alias("case_merge"), T.spaced_letters(t).alias("spaced_letters"),
        T.acronym_count(t).alias("acronyms"), _joined(T.apostrophe_defects(t)).alias("apostrophe_defects"), T.repeated_vowel(t).alias("repeated_vowel"), F.exists(T.tokens(t, "plain"), T.ocr_like).alias("ocr_like"), F.exists(T.tokens(t, "plain"), T.foreign_like).alias("foreign_like"), T.starts_lowercase(t).alias("starts_lowercase"),
        T.mostly_numbers(t, _NUMBERS).alias("mostly_numbers"), T.anchors(t, ["tuman", "shahar", "viloyat", "rais"]).alias("anchors"))
    return rows


_MARKERS = {"english": ["the", "and", "of", "with", "for"], "russian": ["chto", "eto", "kak", "dlya"]}
_SAID = r"[\p{L}\p{M}" + T.APOSTROPHE_CHARS.replace("'", "''") + r"\-]+"
# Rows delivered twice are one row.
_R = "(SELECT DISTINCT ON (sample_id) * FROM routing_signal_audit ORDER BY sample_id, reviewed_at)"


@query(rf"""SELECT CASE WHEN h >= 3 THEN 'STRONG' WHEN h >= 1 THEN 'POSSIBLE' ELSE 'NONE' END AS evidence, n BETWEEN 1 AND 4 AND length(st) BETWEEN 4 AND 40 AND NOT regexp_matches(st, '\p{{Nd}}') AND regexp_matches(st, '^{_SAID}( {_SAID})*[.!?…]*$') AS short, count(*) AS rows
    FROM (SELECT {_stripped("sentence_text")} AS st, {_N(_SOLID + "+", _stripped("sentence_text"))} AS n, greatest({", ".join(f"len(list_intersect(list_distinct({Z.plain_tokens('sentence_text')}), {list(w)}))" for w in _MARKERS.values())}) AS h FROM {_R}) GROUP BY 1, 2""")
def foreign_and_short(spark, folder):
    t = F.col("sentence_text")
    rows = _audit(spark, folder, "sentence_text").select(T.foreign_evidence(t, _MARKERS).alias("f"), T.short_utterance(t).alias("short"))
    return rows.groupBy(F.col("f.evidence").alias("evidence"), "short").agg(F.count("*").alias("rows"))


@query("""SELECT sample_id, array_to_string(list_sort(list_distinct([x for x in [regexp_replace(y, '^\\s+|\\s+$', '', 'g') for y in string_split_regex(regexp_replace(boundary_flags, '[\\[\\]()''"{}]', '', 'g'), '[|,;]')] if x != '' AND upper(x) != 'NONE'])), '|') AS flags
    FROM (SELECT DISTINCT sample_id, boundary_flags FROM routing_signal_audit) WHERE boundary_flags IS NOT NULL""")
def parsed_flags(spark, folder):
    rows = _t(spark, folder, "routing_signal_audit").select("sample_id", "boundary_flags").where("boundary_flags IS NOT NULL").distinct()
    return rows.select("sample_id", _joined(T.parse_list(F.col("boundary_flags"))).alias("flags"))


@query("""SELECT sample_id, CASE WHEN lower(trim(v)) IN ('true', '1', 'yes', 'y', 't') THEN true WHEN lower(trim(v)) IN ('false', '0', 'no', 'n', 'f') THEN false END AS as_bool, try_cast(v AS DOUBLE) AS as_double
    FROM (SELECT DISTINCT sample_id, CAST(signal_no_terminal_punctuation AS VARCHAR) AS v, CAST(digit_ratio AS VARCHAR) AS d FROM routing_signal_audit)""".replace("try_cast(v AS DOUBLE)", "CASE WHEN v = 'true' THEN 1.0 WHEN v = 'false' THEN 0.0 END::DOUBLE"))
def tolerant_values(spark, folder):
    rows = _t(spark, folder, "routing_signal_audit").select("sample_id", F.col("signal_no_terminal_punctuation").cast("string").alias("v"), F.col("digit_ratio").cast("string").alias("d")).distinct()
    return rows.select("sample_id", T.parse_bool(F.col("v")).alias("as_bool"), T.parse_float(F.col("v")).alias("as_double"))


_FORM = _stripped(
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '[\x{A0}\x{2009}\x{202F}]', ' ', 'g'), '[`´ʻʼ‘’′]', '''', 'g'), '[“”„«»]', chr(34), 'g'), '[\x{AD}\x{200B}\x{2060}\x{FEFF}]', '', 'g'), ' {2,}', ' ', 'g')"
)


@query(f"SELECT doc_id, sha256({_FORM}) AS form_sha256 FROM documents")
def normal_forms(spark, folder):
    return _t(spark, folder, "documents").select("doc_id", F.sha2(C.normal_form(F.col("text")), 256).alias("form_sha256"))


_FORM_FLAGS = {
    "BLANK_VARIANT": r"regexp_matches(text, '[\x{A0}\x{2009}\x{202F}]')", "INVISIBLE": r"regexp_matches(text, '[\x{AD}\x{200B}\x{2060}\x{FEFF}]')", "APOSTROPHE_VARIANT": "regexp_matches(text, '[`´ʻʼ‘’′]')",
    "QUOTE_VARIANT": "regexp_matches(text, '[“”„«»]')", "REPEATED_SPACES": "contains(text, '  ')", "OUTER_BLANKS": rf"regexp_matches(text, '^{_B}|{_B}\z')",
}


@query("WITH f AS (SELECT list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _FORM_FLAGS.items()) + "], lambda x: x IS NOT NULL) AS l FROM documents) SELECT unnest(CASE WHEN len(l) = 0 THEN ['NONE'] ELSE l END) AS item, count(*) AS rows FROM f GROUP BY 1")
def normal_form_flags(spark, folder):
    return A.item_counts(_t(spark, folder, "documents").select(C.normal_form_flags(F.col("text")).alias("f")), "f", "NONE")


# ---- duplicates and parts
_DUP = "SELECT sha256(text) AS text_sha256, length(text)::INT AS character_count, min(doc_id) AS first_id, count(*) AS occurrences, (min(text) != max(text))::INT AS collisions FROM documents WHERE text IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1"


@query(_DUP)
def exact_duplicates(spark, folder):
    return A.exact_duplicates(_t(spark, folder, "documents"), "doc_id", "text")


@query(f"SELECT g.first_id, d.doc_id AS id FROM documents d JOIN ({_DUP}) g ON sha256(d.text) = g.text_sha256 WHERE d.doc_id != g.first_id")
def duplicate_members(spark, folder):
    return A.duplicate_members(_t(spark, folder, "documents"), "doc_id", "text")


@query("SELECT sha256(sentence_text) AS text_sha256, count(*) AS rows, count(DISTINCT source_record_id) AS distinct_source_record_id, count(DISTINCT part_number) AS distinct_part_number, min(source_record_id) AS first_source_record_id, max(source_record_id) AS last_source_record_id, min(part_number) AS first_part_number, max(part_number) AS last_part_number FROM routing_signal_audit WHERE sentence_text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def sentence_duplicates(spark, folder):
    return A.text_groups(_t(spark, folder, "routing_signal_audit"), "sentence_text", "source_record_id", "part_number")


@query("SELECT source_record_id // 10000000 AS part, count(*) AS rows, count_if(source_record_id IS NULL) AS null_ids, min(source_record_id) AS first_id, max(source_record_id) AS last_id, 0::BIGINT AS misplaced, count_if(trim(coalesce(normalized_text, '')) = '') AS empty_rows, coalesce(sum(strlen(normalized_text)), 0)::BIGINT AS bytes, coalesce(bit_xor(('0x' || left(sha256(normalized_text), 15))::BIGINT), 0) AS texts_print FROM validation_documents GROUP BY 1")
def part_census(spark, folder):
    return S.part_census(_t(spark, folder, "validation_documents"), "source_record_id", F.floor(F.col("source_record_id") / 10_000_000), 10_000_000, "normalized_text")


@query("SELECT p.part_number, coalesce(rows, 0) AS rows, coalesce(records, 0) AS records FROM (SELECT range AS part_number FROM range(160)) p LEFT JOIN (SELECT part_number::BIGINT AS k, count(*) AS rows, count(DISTINCT source_record_id) AS records FROM validation_documents GROUP BY 1) a ON a.k = p.part_number")
def part_rollup_zero_filled(spark, folder):
    return A.parts_with_zeros(_t(spark, folder, "validation_documents"), "part_number", 160, rows=F.count("*"), records=F.count_distinct("source_record_id"))


# ---- sentences
_SEG = Z.segments()


def _compact_sql(text: str, limit: int) -> str:
    line = _stripped(f"regexp_replace({text}, '{_B}+', ' ', 'g')")
    return f"CASE WHEN length({line}) > {limit} THEN left({line}, {limit - 1}) || '…' ELSE {line} END"


def _sentences(spark: SparkSession, folder: str) -> DataFrame:
    return G.segment(_t(spark, folder, "documents"), "doc_id", "text")


@query(f"""SELECT sentence_id, rec AS source_record_id, i::INT AS sentence_index_in_record, sha256(t) AS parent_normalized_text_sha256, sentence_text, a::INT AS sentence_start_char, b::INT AS sentence_end_char, (b - a)::INT AS sentence_character_count,
    {_N(_SOLID + '+', 'sentence_text')}::INT AS sentence_token_count, marks AS terminal_punctuation, method AS segmentation_method, array_to_string(flags, '|') AS boundary_flags, review AS segmentation_review_required FROM {_SEG}""")
def segment_sentences(spark, folder):
    return _sentences(spark, folder).withColumn("boundary_flags", _joined(F.col("boundary_flags"))).drop("schema_version", "parent_review_flags")


@query(f"""SELECT kind, name, count(*) AS sentences FROM (SELECT 'method' AS kind, method AS name FROM {_SEG} UNION ALL SELECT 'flag', unnest(flags) FROM {_SEG} UNION ALL SELECT 'review', 'REQUIRED' FROM {_SEG} WHERE review) GROUP BY 1, 2""")
def segment_inventory(spark, folder):
    return G.inventory(_sentences(spark, folder))


_SOFT = Z.segments("(SELECT doc_id, translate(text, '.!?', ',..') AS text FROM documents)")
_PLANTED = f"""(SELECT rec, t, i + CASE WHEN m = 5 THEN 1 ELSE 0 END AS i, a - CASE WHEN m = 1 THEN 1 ELSE 0 END AS a, b, sentence_text || CASE WHEN m = 2 THEN 'x' ELSE '' END AS x, b - a + CASE WHEN m = 3 THEN 1 ELSE 0 END AS n, CASE WHEN m = 4 THEN 'x' ELSE sha256(t) END AS h, CASE WHEN m = 6 THEN 's3v1-0-0000-0' ELSE sentence_id END AS id
    FROM (SELECT *, length(sentence_text) % 13 AS m FROM {_SEG}) WHERE m != 7)"""
_squeezed = lambda text: f"length(regexp_replace({text}, '{_B}', '', 'g'))"


@query(f"""WITH p AS (SELECT *, row_number() OVER w - 1 AS k, lag(b) OVER w AS before FROM {_PLANTED} WINDOW w AS (PARTITION BY rec ORDER BY i, a)),
    c AS (SELECT count_if(i != k) AS index_sequence, count_if(a < 0 OR b > length(t) OR a >= b) AS offset_range, count_if(before > a) AS overlap, count_if(a < 0 OR substr(t, a + 1, b - a) != x) AS reconstruction, count_if(n != length(x)) AS character_count, count_if(h != sha256(t)) AS parent_hash,
        (SELECT coalesce(sum(n - u + o), 0) FROM (SELECT count(*) AS n, count(DISTINCT id) AS u, count_if(NOT prefix(id, 's3v1-' || rec || '-')) AS o FROM p GROUP BY rec))::BIGINT AS duplicate_id,
        (SELECT count_if(coalesce(s, 0) != {_squeezed('text')}) FROM documents d LEFT JOIN (SELECT rec, sum({_squeezed('x')}) AS s FROM p GROUP BY 1) q ON q.rec = d.doc_id WHERE text IS NOT NULL) AS uncovered_text FROM p)
    SELECT problem, failing FROM (UNPIVOT c ON index_sequence, offset_range, overlap, reconstruction, character_count, parent_hash, duplicate_id, uncovered_text INTO NAME problem VALUE failing)""")
def segment_verify(spark, folder):
    """Sentences with planted faults of every kind against their texts."""
    m, c = F.length("sentence_text") % 13, F.col
    when = lambda k, yes, no: F.when(m == k, yes).otherwise(no)
    planted = _sentences(spark, folder).where(m != 7).withColumns(
        {
            "sentence_start_char": when(1, c("sentence_start_char") - 1, c("sentence_start_char")), "sentence_text": when(2, F.concat("sentence_text", F.lit("x")), c("sentence_text")), "sentence_character_count": when(3, c("sentence_character_count") + 1, c("sentence_character_count")),
            "parent_normalized_text_sha256": when(4, F.lit("x"), c("parent_normalized_text_sha256")), "sentence_index_in_record": when(5, c("sentence_index_in_record") + 1, c("sentence_index_in_record")), "sentence_id": when(6, F.lit("s3v1-0-0000-0"), c("sentence_id")),
        }
    )
    return G.verify(planted, _t(spark, folder, "documents"), "doc_id", "text")


@query(f"""WITH o AS (SELECT rec, b FROM {_SEG} QUALIFY lead(b) OVER (PARTITION BY rec ORDER BY i) IS NOT NULL), n AS (SELECT * FROM {_SOFT}), m AS (SELECT rec, b FROM n QUALIFY lead(b) OVER (PARTITION BY rec ORDER BY i) IS NOT NULL)
    SELECT o.rec AS source_record_id, o.b::INT AS boundary, 'REMOVED' AS change, n.sentence_text AS merged_sentence, coalesce(len([f for f in n.flags if f IN {Z.one_of(B.PROTECTED)}]) > 0, false) AS explained FROM o ANTI JOIN m ON m.rec = o.rec AND m.b = o.b LEFT JOIN n ON n.rec = o.rec AND o.b > n.a AND o.b < n.b
    UNION ALL SELECT rec, b::INT, 'ADDED', NULL, true FROM m ANTI JOIN o ON o.rec = m.rec AND o.b = m.b""")
def inventory_diff(spark, folder):
    """Of the texts, and of the same with commas for full stops and full stops for strong marks."""
    docs = _t(spark, folder, "documents")
    return G.inventory_diff(_sentences(spark, folder), G.segment(docs.withColumn("text", F.translate("text", ".!?", ",..")), "doc_id", "text"))


@query(rf"""WITH s AS (SELECT * FROM {_SEG}), c AS (SELECT x.sentence_id, y.sentence_text AS p, x.sentence_text AS s, z.sentence_text AS n FROM s x LEFT JOIN s y ON y.rec = x.rec AND y.i = x.i - 1 LEFT JOIN s z ON z.rec = x.rec AND z.i = x.i + 1)
    SELECT sentence_id, {_compact_sql('p', 120)} AS previous, {_compact_sql('s', 240)} AS sentence, {_compact_sql('n', 120)} AS next FROM c""")
def sentence_context(spark, folder):
    rows = R.neighbours(_sentences(spark, folder).select("source_record_id", "sentence_index_in_record", "sentence_id", "sentence_text"), "source_record_id", "sentence_index_in_record", "sentence_text")
    return rows.select("sentence_id", T.compact(F.col("previous_text"), 120).alias("previous"), T.compact(F.col("sentence_text"), 240).alias("sentence"), T.compact(F.col("next_text"), 120).alias("next"))


@query("SELECT d.doc_id, d.source, d.n_chars, a.n_chars AS previous_text, b.n_chars AS next_text FROM documents d LEFT JOIN documents a ON a.source = d.source AND a.doc_id = d.doc_id - 1 LEFT JOIN documents b ON b.source = d.source AND b.doc_id = d.doc_id + 1")
def neighbour_context(spark, folder):
    return R.neighbours(_t(spark, folder, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars")


@query(f"""WITH s AS (SELECT *, unnest(flags) AS boundary_group FROM {_SEG}) SELECT rec AS source_record_id, sentence_id, boundary_group,
    CASE WHEN boundary_group IN {Z.one_of(B.PROTECTED)} THEN 'PROTECT_NO_SPLIT' WHEN boundary_group = 'LOWERCASE_AFTER_TERMINAL' THEN 'SPLIT' ELSE 'WHOLE_SENTENCE_REVIEW' END AS event, {Z.following('t', 'b')} AS following, {Z.context('t', 'b - 1', 'b', 220)} AS context FROM s""")
def boundary_events(spark, folder):
    return B.events(_sentences(spark, folder), _t(spark, folder, "documents"), "doc_id", "text")


_LOWERCASE = rf"""(SELECT x.sentence_id, regexp_extract(x.sentence_text, '(\S+)\s*\z', 1) AS l, regexp_extract(coalesce(y.sentence_text, ''), '^\s*(\S+)', 1) AS r FROM {_SEG} x LEFT JOIN {_SEG} y ON y.rec = x.rec AND y.i = x.i + 1 WHERE list_contains(x.flags, 'LOWERCASE_AFTER_TERMINAL'))"""
_FAMILIES = Z.flags(
    {
        "ELLIPSIS": r"""regexp_matches(l, '(\.{2,}|…)["»”’)\]]*\z')""", "QUESTION_OR_EXCLAMATION": r"""regexp_matches(l, '[!?]["»”’)\]]*\z')""", "NUMBER_BEFORE": r"regexp_matches(l, '\d\.\z')", "SHORT_TOKEN_BEFORE": r"regexp_matches(l, '^\p{L}{1,3}\.\z')",
        "ORDINAL_BEFORE": r"regexp_matches(l, '(?i)inchi\.\z')", "SUFFIX_AFTER": r"regexp_matches(r, '^(ning|ni|ga|da|dan)\b')", "QUOTE_BEFORE": r"""regexp_matches(l, '["»”’]\z')""",
    }
)


@query(f"SELECT unnest(CASE WHEN len(f) = 0 THEN ['OTHER'] ELSE f END) AS family, count(*) AS events FROM (SELECT {_FAMILIES} AS f FROM {_LOWERCASE}) GROUP BY 1")
def lowercase_families(spark, folder):
    return B.family_counts(B.lowercase_families(_sentences(spark, folder)))


_HINTS = Z.flags(
    {
        "CAPITAL_AFTER": r"regexp_matches(r, '^\s*\p{Lu}')", "DIGIT_AFTER": r"regexp_matches(r, '^\s*\d')", "SHORT_RIGHT_SIDE": f"{_N(_SOLID + '+', 'r')} < 4", "QUOTE_NEAR": r"""regexp_matches(r, '^\s*["«“]')""", "END_NEAR": "regexp_matches(left(r, 20), '[.!?…]')",
    }
)


@query(rf"""WITH s AS (SELECT sentence_text AS t, regexp_extract_all(sentence_text, '(?s)[^.!?…]*[.!?…]+') AS x FROM {_SEG} WHERE len([f for f in flags if f IN {Z.one_of(B.PROTECTED)}]) > 0),
    r AS (SELECT unnest([substr(t, (list_sum([length(y) for y in x[1:k]]) + 1)::BIGINT) for k in range(1, len(x) + 1)]) AS r FROM s), h AS (SELECT {_HINTS} AS h FROM r WHERE regexp_matches(r, '[\pL\pN]'))
    SELECT unnest(CASE WHEN len(h) = 0 THEN ['NONE'] ELSE h END) AS item, count(*) AS rows FROM h GROUP BY 1""")
def boundary_hints(spark, folder):
    rows = _sentences(spark, folder).where(F.exists("boundary_flags", lambda x: x.isin(*B.PROTECTED))).select(F.explode(B.inner_ends(F.col("sentence_text"))).alias("right"))
    return A.item_counts(B.review_hints(rows), "hints", "NONE")


@query(f"SELECT l AS left_token, r AS right_token, count(*) AS events FROM {_LOWERCASE} GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 30")
def lowercase_token_pairs(spark, folder):
    return B.token_pairs(B.lowercase_families(_sentences(spark, folder)))


_ROMAN = rf"(^|{_B})(([A-Z]|Sh|SH|Ch|CH|O[''ʻʼ‘’]|G[''ʻʼ‘’])\.{_B}+{G.ORDINALS.replace("'", "''").replace(chr(92) + 's', _B)})\.({_B}+[^.!?…]*)"
_ROMAN_TEXT = "regexp_replace(text, ' (bilan|va) ', ' J. bir minginchi. ', 'g')"


@query(rf"""WITH e AS (SELECT doc_id, unnest(regexp_extract_all(t, '{_ROMAN}', 2)) AS fragment, unnest(regexp_extract_all(t, '{_ROMAN}', 4)) AS r FROM (SELECT doc_id, {_ROMAN_TEXT} AS t FROM documents WHERE text IS NOT NULL)),
    w AS (SELECT *, {_N(_SOLID + '+', 'r')}::INT AS n FROM e), x AS (SELECT *, {Z.flags({"FEW_WORDS_AFTER": "n < 12", "METADATA_AFTER": "regexp_matches(r, '(?i)" + chr(92) + "b(manba|foto|surat|muallif)" + chr(92) + "b')", "NOT_LOWERCASE_AFTER": "NOT " + Z.starts_lowercase("r")})} AS reasons FROM w)
    SELECT doc_id AS source_record_id, fragment, n AS words_after, array_to_string(reasons, '|') AS reasons, CASE WHEN len(reasons) = 0 THEN 'PROTECT' ELSE 'LEAVE' END AS prediction FROM x""")
def roman_events(spark, folder):
    """Over texts in which a frequent word is written as an initial and an ordinal, as the tables have no such case."""
    docs = _t(spark, folder, "documents").withColumn("text", F.regexp_replace("text", r" (bilan|va) ", " J. bir minginchi. "))
    return B.roman_events(docs, "doc_id", "text").withColumn("reasons", _joined(F.col("reasons")))


# ---- samples
_ALLOC = """WITH s AS (SELECT coalesce(part_number, -1) AS part, count(*) AS size FROM validation_documents GROUP BY 1), b AS (SELECT *, sum(size) OVER () AS a, (size * 400) // sum(size) OVER () AS base, (size * 400) % sum(size) OVER () AS rest FROM s)"""


@query(f"{_ALLOC} SELECT part, size, (base + CASE WHEN row_number() OVER (ORDER BY rest DESC, part) <= 400 - sum(base) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota, round(size * 400 / a, 6) AS exact FROM b")
def largest_remainder_allocation(spark, folder):
    return W.allocate(_parts(spark, folder), "part", "size", 400)


def _parts(spark, folder):
    return _t(spark, folder, "validation_documents").groupBy(F.coalesce("part_number", F.lit(-1)).alias("part")).agg(F.count("*").alias("size"))


_FLOORED = f"""{_ALLOC}, q AS (SELECT *, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, part) <= 400 - sum(base) OVER () THEN 1 ELSE 0 END AS q0 FROM b), f AS (SELECT *, greatest(1, q0) AS fl FROM q),
    o AS (SELECT *, sum(fl) OVER () - 400 AS over FROM f),
    u AS (SELECT part, rest, over, unnest(range(1, fl::BIGINT)) AS round FROM o WHERE fl > 1), k AS (SELECT part, count(*) AS back FROM (SELECT part, over, row_number() OVER (ORDER BY round, rest, part) AS turn FROM u) WHERE turn <= over GROUP BY 1)
    SELECT o.part, size, (fl - coalesce(back, 0))::BIGINT AS quota, round(size * 400 / a, 6) AS exact FROM o LEFT JOIN k ON k.part = o.part"""


@query(_FLOORED)
def allocation_with_floor(spark, folder):
    return W.allocate(_parts(spark, folder), "part", "size", 400, least=1)


@query(f"""WITH al AS ({_FLOORED}), r AS (SELECT v.document_sample_id, coalesce(v.part_number, -1) AS part, row_number() OVER (PARTITION BY coalesce(v.part_number, -1) ORDER BY sha256('42|' || coalesce(v.part_number, -1) || '|' || document_sample_id), document_sample_id)::INT AS n FROM (SELECT DISTINCT ON (document_sample_id) * FROM validation_documents ORDER BY document_sample_id, part_number) v)
    SELECT document_sample_id, r.part, n AS part_sample_number, round(quota / size, 8) AS inclusion_probability, round(size / quota, 6) AS sampling_weight FROM r JOIN al ON al.part = r.part WHERE n <= quota""")
def stratified_sample_weights(spark, folder):
    rows = R.keep_first(_t(spark, folder, "validation_documents").select("document_sample_id", "part_number").withColumn("nulls", F.col("part_number").isNull()), ["document_sample_id"], ["nulls", "part_number"]).withColumn("part", F.coalesce("part_number", F.lit(-1)))
    drawn = W.draw(rows, "document_sample_id", "part", W.allocate(_parts(spark, folder), "part", "size", 400, least=1), "size")
    return drawn.select("document_sample_id", "part", "part_sample_number", "inclusion_probability", "sampling_weight")


@query("""WITH r AS (SELECT doc_id, source, sha256('42|' || doc_id) AS s, row_number() OVER (PARTITION BY source ORDER BY sha256('42|' || doc_id), doc_id) AS t FROM documents) SELECT doc_id, source FROM r ORDER BY (t > 2)::INT, s, doc_id LIMIT 200""")
def balanced_sample(spark, folder):
    return W.balanced(_t(spark, folder, "documents").select("doc_id", "source"), "doc_id", "source", 2, 200)


@query("""WITH m AS (SELECT source_record_id, min({'s': sha256('42|' || sample_id), 'i': sample_id}) AS m FROM routing_signal_audit GROUP BY 1) SELECT source_record_id, m.i AS sample_id FROM m ORDER BY m.s, m.i LIMIT 200""")
def one_per_document(spark, folder):
    return W.one_per_document(_t(spark, folder, "routing_signal_audit"), "sample_id", "source_record_id", 200)


@query(f"""WITH k AS (SELECT sample_id, part_number, human_health_label, digit_ratio, sha256('42|' || CASE WHEN part_number IS NULL THEN '' ELSE part_number || '|' END || sample_id) AS s FROM (SELECT DISTINCT ON (sample_id) sample_id, part_number, human_health_label, digit_ratio FROM routing_signal_audit WHERE sample_id IS NOT NULL ORDER BY sample_id, part_number NULLS FIRST, human_health_label NULLS FIRST, digit_ratio NULLS FIRST)),
    a AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY part_number ORDER BY s, sample_id) <= 7 THEN 'ESTIMATION' END AS p1 FROM k),
    b AS (SELECT *, p1 IS NULL AND coalesce(human_health_label = 'FORMAT_OR_LIST', false) AS f FROM a), c AS (SELECT *, CASE WHEN f AND row_number() OVER (PARTITION BY part_number, f ORDER BY s, sample_id) <= 1 THEN 'FORMAT' ELSE p1 END AS p2 FROM b),
    d AS (SELECT * EXCLUDE (f), p2 IS NULL AND coalesce(digit_ratio > 0.2, false) AS f FROM c), e AS (SELECT *, CASE WHEN f AND row_number() OVER (PARTITION BY part_number, f ORDER BY s, sample_id) <= 1 THEN 'DIGITS' ELSE p2 END AS p3 FROM d),
    g AS (SELECT *, CASE WHEN p3 IS NULL AND row_number() OVER (PARTITION BY part_number, p3 IS NULL ORDER BY s, sample_id) <= 10 - count(p3) OVER (PARTITION BY part_number) THEN 'FILL' ELSE p3 END AS phase FROM e)
    SELECT sample_id, part_number, human_health_label, digit_ratio, phase FROM g WHERE phase IS NOT NULL""")
def two_phase_sample(spark, folder):
    rows = R.keep_first(_t(spark, folder, "routing_signal_audit").select("sample_id", "part_number", "human_health_label", "digit_ratio"), ["sample_id"], ["part_number"])
    return W.two_phase(rows, "sample_id", "part_number", 7, {"FORMAT": (F.col("human_health_label") == "FORMAT_OR_LIST", 1), "DIGITS": (F.col("digit_ratio") > 0.2, 1)}, 10)


@query("SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) AS row_number, (row_number() OVER (ORDER BY source, doc_id) - 1) // 100 + 1 AS batch, printf('seedbank-v1-%05d', row_number() OVER (ORDER BY source, doc_id)) AS review_id FROM documents")
def review_batches(spark, folder):
    rows = W.batches(W.number_rows(_t(spark, folder, "documents").select("doc_id", "source"), ["source", "doc_id"]), 100, "seedbank-v1")
    return rows.select("doc_id", "row_number", "batch", "review_id")


@query("""WITH r AS (SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS a, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS b FROM documents WHERE n_chars IS NOT NULL)
    SELECT doc_id, lang, n_chars, CASE WHEN b <= 10 THEN 'HIGH' ELSE 'LOW' END AS tail FROM r WHERE a <= 10 OR b <= 10""")
def score_tails(spark, folder):
    return W.score_tails(_t(spark, folder, "documents").where("n_chars IS NOT NULL"), "n_chars", "lang", "doc_id", 10)


@query("SELECT document_sample_id, round(sampling_weight * (part_record_count / 1e7), 4) AS weight FROM (SELECT DISTINCT document_sample_id, sampling_weight, part_record_count FROM validation_documents) WHERE isfinite(sampling_weight)")
def two_stage_weights(spark, folder):
    rows = _t(spark, folder, "validation_documents").select("document_sample_id", "sampling_weight", "part_record_count").distinct().where("NOT isnan(sampling_weight) AND abs(sampling_weight) < double('Infinity')")
    return rows.select("document_sample_id", W.two_stage_weight(F.col("sampling_weight"), F.col("part_record_count") / 1e7).alias("weight"))


# ---- labels, signals, estimates
def _audit(spark, folder, *columns: str) -> DataFrame:
    rows = _t(spark, folder, "routing_signal_audit").select("sample_id", "reviewed_at", *columns)
    return R.keep_first(rows, ["sample_id"], ["reviewed_at"])


@query(f"SELECT human_health_label, rows, round(rows * 100.0 / sum(rows) OVER (), 6) AS percent FROM (SELECT human_health_label, count(*) AS rows FROM {_R} GROUP BY 1)")
def label_distribution(spark, folder):
    return A.label_counts(_audit(spark, folder, "human_health_label"), "human_health_label")


@query("SELECT lang, " + ", ".join(f"count_if(human_health_label = '{x}') AS {x}" for x in LABELS) + ", count_if(human_health_label IN (" + ", ".join(f"'{x}'" for x in LABELS) + f")) AS labelled, round(CASE WHEN count_if(human_health_label IN (" + ", ".join(f"'{x}'" for x in LABELS) + f")) > 0 THEN count_if(human_health_label IN ('{HEALTHY}', '{MINOR}')) * 100.0 / count_if(human_health_label IN (" + ", ".join(f"'{x}'" for x in LABELS) + f")) ELSE 0 END, 6) AS usable_percent FROM {_R} GROUP BY 1")
def label_crosstab(spark, folder):
    return A.crosstab(_audit(spark, folder, "human_health_label", "lang"), "lang", "human_health_label", LABELS, USABLE)


_WILSON = """round(greatest(0, (p + 3.8416 / (2 * n) - 1.96 * sqrt((p * (1 - p) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n)), 6) AS low, round(least(1, (p + 3.8416 / (2 * n) + 1.96 * sqrt((p * (1 - p) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n)), 6) AS high"""


@query(f"SELECT lang, n AS rows, h AS hits, round(p, 6) AS share, {_WILSON} FROM (SELECT lang, n, h, h / n AS p FROM (SELECT lang, count(*) AS n, count_if(coalesce(human_health_label, '') IN ('{HEALTHY}', '{MINOR}')) AS h FROM {_R} GROUP BY 1))")
def wilson_by_lang(spark, folder):
    return A.proportions(_audit(spark, folder, "human_health_label", "lang"), "lang", F.coalesce("human_health_label", F.lit("")).isin(USABLE))


_STRATA = f"""(SELECT part_number, count(*) * 10 AS pop, count(*) AS s, count_if(coalesce(human_health_label, '') IN ('{HEALTHY}', '{MINOR}')) AS h FROM {_R} WHERE part_number IS NOT NULL GROUP BY 1)"""


@query(f"""WITH s AS (SELECT *, pop / sum(pop) OVER () AS w, h / s AS p FROM {_STRATA}), o AS (SELECT sum(w * p) AS share, sqrt(greatest(0, sum(w * w * (1 - s / pop) * CASE WHEN s > 1 THEN s / (s - 1) * p * (1 - p) ELSE 0 END / s))) AS e, sum(pop)::BIGINT AS population, sum(s)::BIGINT AS sampled FROM s)
    SELECT population, sampled, round(share, 6) AS share, round(e, 6) AS standard_error, round(greatest(0, share - 1.96 * e), 6) AS low, round(least(1, share + 1.96 * e), 6) AS high, round(share * population, 0)::BIGINT AS projected FROM o""")
def stratified_estimate(spark, folder):
    rows = _audit(spark, folder, "part_number", "human_health_label").where("part_number IS NOT NULL")
    strata = rows.groupBy("part_number").agg((F.count("*") * 10).alias("pop"), F.count("*").alias("s"), F.count_if(F.coalesce("human_health_label", F.lit("")).isin(USABLE)).alias("h"))
    return A.stratified_estimate(strata, "pop", "s", "h")


_SIGNALS = Z.signals("st")
_SIGNAL_ROWS = f"(SELECT sample_id, human_health_label, sentence_text, {_stripped('sentence_text')} AS st FROM {_R})"


@query("SELECT sample_id, " + ", ".join(f"coalesce({c}, false) AS signal_{n}" for n, c in _SIGNALS.items()) + f" FROM {_SIGNAL_ROWS} WHERE sentence_text IS NOT NULL")
def signal_features(spark, folder):
    return _audit(spark, folder, "sentence_text").where("sentence_text IS NOT NULL").select("sample_id", *L.signals(F.col("sentence_text")))


@query(f"""WITH s AS (SELECT human_health_label AS l, unnest([{", ".join(f"'signal_{n}'" for n in _SIGNALS)}]) AS signal, unnest([{", ".join(f"coalesce({c}, false)" for c in _SIGNALS.values())}]) AS o FROM {_SIGNAL_ROWS}),
    c AS (SELECT signal, count(*) AS n, count_if(o) AS flagged, count_if(o AND l IN ('{HEALTHY}', '{MINOR}')) AS us, count_if(o AND l IN {Z.one_of(HARMFUL)}) AS ha FROM s GROUP BY 1)
    SELECT signal, flagged, round(flagged * 100.0 / n, 4) AS coverage_percent, round(CASE WHEN flagged > 0 THEN us * 100.0 / flagged ELSE 0 END, 4) AS usable_percent, round(CASE WHEN flagged > 0 THEN ha * 100.0 / flagged ELSE 0 END, 4) AS harmful_percent FROM c""")
def signal_summary(spark, folder):
    rows = _audit(spark, folder, "sentence_text", "human_health_label").select("human_health_label", *L.signals(F.col("sentence_text")))
    return A.signal_summary(rows, L.SIGNALS, "human_health_label", USABLE, HARMFUL)


@query(f"""WITH r AS (SELECT human_health_label AS label, unnest(['digit_ratio', 'uppercase_ratio', 'latin_ratio']) AS "column", unnest([digit_ratio, uppercase_ratio, latin_ratio]) AS v FROM {_R})
    SELECT label, "column", count(v) FILTER (NOT isnan(v)) AS present, round(min(v) FILTER (NOT isnan(v)), 6) AS minimum, round(avg(v) FILTER (NOT isnan(v)), 6) AS mean, round(max(v) FILTER (NOT isnan(v)), 6) AS maximum FROM r GROUP BY 1, 2""")
def numeric_by_label(spark, folder):
    return A.numeric_summary(_audit(spark, folder, "human_health_label", "digit_ratio", "uppercase_ratio", "latin_ratio"), ["digit_ratio", "uppercase_ratio", "latin_ratio"], "human_health_label")


def _routes(spark, folder):
    label = F.coalesce("human_health_label", F.lit(""))
    return _audit(spark, folder, "human_health_label", "digit_ratio", "latin_ratio", "cyrillic_ratio").select(
        "sample_id", F.when(label.isin(USABLE), "USABLE").when(label.isin(HARMFUL), "HARMFUL").otherwise("UNKNOWN").alias("truth"),
        F.when(F.coalesce("digit_ratio", F.lit(0.0)) > 0.2, "HARMFUL").when((F.coalesce("latin_ratio", F.lit(0.0)) > 0.1) & (F.coalesce("cyrillic_ratio", F.lit(0.0)) > 0.1), "HARMFUL").otherwise("USABLE").alias("predicted"),
    )


_ROUTES = f"""(SELECT CASE WHEN coalesce(human_health_label, '') IN ('{HEALTHY}', '{MINOR}') THEN 'USABLE' WHEN coalesce(human_health_label, '') IN ({", ".join(f"'{x}'" for x in HARMFUL)}) THEN 'HARMFUL' ELSE 'UNKNOWN' END AS truth,
    CASE WHEN coalesce(digit_ratio, 0) > 0.2 THEN 'HARMFUL' WHEN coalesce(latin_ratio, 0) > 0.1 AND coalesce(cyrillic_ratio, 0) > 0.1 THEN 'HARMFUL' ELSE 'USABLE' END AS predicted FROM {_R})"""


@query(f"SELECT truth, predicted, count(*) AS rows FROM {_ROUTES} GROUP BY 1, 2")
def route_confusion(spark, folder):
    return A.confusion(_routes(spark, folder), "truth", "predicted")


@query(f"""WITH r AS (SELECT * FROM {_ROUTES}), l AS (SELECT truth AS label FROM r UNION SELECT predicted FROM r), s AS (SELECT label, (SELECT count(*) FROM r WHERE truth = label AND predicted = label) AS tp, (SELECT count(*) FROM r WHERE predicted = label) AS predicted, (SELECT count(*) FROM r WHERE truth = label) AS actual FROM l),
    m AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS p, CASE WHEN actual > 0 THEN tp / actual ELSE 0 END AS r FROM s) SELECT label, tp, predicted, actual, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM m""")
def class_scores(spark, folder):
    return A.class_scores(_routes(spark, folder), "truth", "predicted")


_SWEEP = [0.05, 0.1, 0.2, 0.3, 0.5]


@query(f"""WITH r AS (SELECT unnest({_SWEEP}) AS threshold, coalesce(digit_ratio, 0) AS s, coalesce(human_health_label, '') = 'FORMAT_OR_LIST' AS t FROM {_R} WHERE digit_ratio IS NULL OR NOT isnan(digit_ratio)), c AS (SELECT threshold::DOUBLE AS threshold, count_if(s >= threshold AND t) AS tp, count_if(s >= threshold AND NOT t) AS fp, count_if(s < threshold AND t) AS fn, count_if(s < threshold AND NOT t) AS tn FROM r GROUP BY 1)
    SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, round(CASE WHEN tp + fp > 0 THEN fp / (tp + fp) ELSE 0 END, 6) AS leakage, round((tp + fp) / (tp + fp + fn + tn), 6) AS coverage FROM c""")
def threshold_sweep(spark, folder):
    rows = _audit(spark, folder, "digit_ratio", "human_health_label").where("digit_ratio IS NULL OR NOT isnan(digit_ratio)")
    return A.threshold_sweep(rows.select(F.coalesce("digit_ratio", F.lit(0.0)).alias("s"), (F.coalesce("human_health_label", F.lit("")) == "FORMAT_OR_LIST").alias("t")), "s", "t", _SWEEP)


# ---- rules and lexicon
@query(" UNION ALL ".join(f"SELECT '{p.name}' AS profile, unnest(CASE WHEN len(reasons) = 0 THEN ['SELECTED'] ELSE reasons END) AS reason, count(*) AS rows FROM {Z.strict(p, _R, 'sentence_text', 'sample_id')} GROUP BY 1, 2" for p in (L.STRICT, L.WIDE, L.SHORT, L.CAREFUL)))
def strict_reasons(spark, folder):
    rows = L.select(_audit(spark, folder, "sentence_text"), "sentence_text", (L.STRICT, L.WIDE, L.SHORT, L.CAREFUL))

    def told(profile: str) -> Column:
        reasons = F.col(f"reasons_{profile}")
        return F.transform(F.when(F.size(reasons) == 0, F.array(F.lit("SELECTED"))).otherwise(reasons), lambda x: F.struct(F.lit(profile).alias("profile"), x.alias("reason")))

    kinds = F.concat(*map(told, ("strict", "wide", "short", "careful")))
    return rows.select(F.explode_outer(kinds).alias("k")).groupBy("k.profile", "k.reason").agg(F.count("*").alias("rows"))


@query(f"""SELECT source_record_id, sentences, lc AS signal_starts_lowercase, np AS signal_no_terminal_punctuation, cm AS signal_case_merge, candidates, round(candidates / sentences, 6) AS candidate_rate,
    array_to_string({Z.flags({"SIGNAL_STARTS_LOWERCASE": "lc > 0", "SIGNAL_NO_TERMINAL_PUNCTUATION": "np > 0", "SIGNAL_CASE_MERGE": "cm > 0", "NO_CANDIDATE": "candidates = 0"})}, '|') AS reject_reasons
    FROM (SELECT rec AS source_record_id, count(*) AS sentences, count_if({_SIGNALS["starts_lowercase"].replace("(st,", "(sentence_text,")}) AS lc, count_if({_SIGNALS["no_terminal_punctuation"].replace("(st,", "(sentence_text,")}) AS np, count_if({_SIGNALS["case_merge"].replace("(st,", "(sentence_text,")}) AS cm, count_if(len(reasons) = 0) AS candidates
    FROM {Z.strict(L.STRICT, _SEG, "sentence_text", "rec", "sentence_text")} GROUP BY 1)""")
def document_rollup(spark, folder):
    rows = L.select(_sentences(spark, folder).select("source_record_id", "sentence_text"), "sentence_text", (L.STRICT,)).select("source_record_id", *L.signals(F.col("sentence_text")), F.col("selected_strict").alias("candidate"))
    return A.roll_up(rows, "source_record_id", ["signal_starts_lowercase", "signal_no_terminal_punctuation", "signal_case_merge"], "candidate").withColumn("reject_reasons", _joined(F.col("reject_reasons")))


_TOK = r"regexp_extract_all(lower(regexp_replace(text, '[`´ʻʼ‘’]', '''', 'g')), '[A-Za-z'']+')"


def _tokens(column: str = "text") -> Column:
    return T.tokens(F.lower(T.one_apostrophe(F.col(column))), "plain")


@query(f"SELECT token, occurrences, occurrences >= 2 OR token IN ('va') OR length(token) <= 3 AS confident FROM (SELECT token, count(*) AS occurrences FROM (SELECT unnest({_TOK}) AS token FROM documents) GROUP BY 1)")
def lexicon_tokens(spark, folder):
    return A.lexicon(_t(spark, folder, "documents"), _tokens(), ["va"])


def _lexicon(spark, folder):
    return A.lexicon(_t(spark, folder, "documents"), _tokens(), [])


_LEX = f"(SELECT token, count(*) AS n FROM (SELECT unnest({_TOK}) AS token FROM documents) GROUP BY 1)"


@query(f"SELECT a.token, b.token AS known FROM {_LEX} a JOIN {_LEX} b ON b.n >= 200 AND a.n = 1 AND abs(length(a.token) - length(b.token)) <= 1 AND a.token != b.token AND levenshtein(a.token, b.token) <= 1")
def near_miss_tokens(spark, folder):
    lexicon = _lexicon(spark, folder)
    return L.near_misses(lexicon.where("occurrences = 1"), lexicon.where("occurrences >= 200"))


@query(f"""WITH k AS (SELECT DISTINCT unnest([substr('^' || token || '$', i, 3) for i in range(1, length(token) + 1)]) AS g FROM {_LEX} WHERE n >= 50), t AS (SELECT token, unnest([substr('^' || token || '$', i, 3) for i in range(1, length(token) + 1)]) AS g FROM {_LEX} WHERE n = 1)
    SELECT token, round(count(k.g) / count(*), 6) AS coverage FROM t LEFT JOIN k ON t.g = k.g GROUP BY 1""")
def trigram_coverage(spark, folder):
    lexicon = _lexicon(spark, folder)
    return L.trigram_coverage(lexicon.where("occurrences = 1"), lexicon.where("occurrences >= 50"))


@query(f"""WITH c AS (SELECT token, s, left(token, length(token) - length(s)) AS root FROM (SELECT token, unnest(['larning', 'larni', 'ning', 'lar', 'dan', 'ni', 'ga', 'da']) AS s FROM {_LEX} WHERE n < 20) WHERE suffix(token, s))
    SELECT c.token, arg_min(root, -length(s)) AS root FROM c JOIN {_LEX} k ON k.n >= 20 AND k.token = c.root WHERE length(root) > 3 GROUP BY 1""")
def stripped_roots(spark, folder):
    lexicon = _lexicon(spark, folder)
    return L.stripped_roots(lexicon.where("occurrences < 20"), lexicon.where("occurrences >= 20"), ["larning", "larni", "ning", "lar", "dan", "ni", "ga", "da"])


_RTOK = _TOK.replace("(text,", "(sentence_text,")


@query(f"""WITH p AS (SELECT unnest(list_distinct({_RTOK})) AS token, coalesce(human_health_label IN ({", ".join(f"'{x}'" for x in HARMFUL)}), false) AS hit FROM {_R}) SELECT token, count(*) AS rows, count_if(hit) AS hits, round(count_if(hit) * 100.0 / count(*), 6) AS hit_percent FROM p WHERE length(token) >= 2 GROUP BY 1 HAVING count(*) >= 2""")
def token_label_frequency(spark, folder):
    return A.token_labels(_audit(spark, folder, "sentence_text", "human_health_label"), _tokens("sentence_text"), "human_health_label", HARMFUL)


@query(f"""WITH p AS (SELECT unnest(list_distinct({_RTOK})) AS token, coalesce(human_health_label, '') AS l FROM {_R}), c AS (SELECT token, count_if(l IN ({", ".join(f"'{x}'" for x in HARMFUL)})) AS false_clean_rows, count_if(l IN ('{HEALTHY}', '{MINOR}')) AS healthy_rows FROM p GROUP BY 1)
    SELECT * FROM c WHERE false_clean_rows >= 2 AND (healthy_rows = 0 OR false_clean_rows >= 3 * healthy_rows)""")
def token_contrast(spark, folder):
    rows = _audit(spark, folder, "sentence_text", "human_health_label")
    label = F.coalesce("human_health_label", F.lit(""))
    return A.token_contrast(rows, _tokens("sentence_text"), label.isin(HARMFUL), label.isin(USABLE))


# ---- typing errors and detector views, over the sentences of the audit
def _clean(spark, folder):
    rows = _audit(spark, folder, "sentence_text", "human_health_label")
    return L.select(rows.where(F.col("human_health_label") == HEALTHY), "sentence_text", (L.STRICT,)).where("selected_strict").select(F.col("sample_id").alias("sentence_id"), F.col("sentence_text").alias("target"))


def _typos(spark, folder, most: int = 3):
    return Y.typo_rows(_clean(spark, folder), "sentence_id", "target", most)


_CLEAN = f"(SELECT sample_id AS sentence_id, sentence_text AS target FROM {Z.strict(L.STRICT, f"(SELECT * FROM {_R} WHERE human_health_label = '{HEALTHY}')", 'sentence_text', 'sample_id', 'sentence_text')} WHERE len(reasons) = 0)"
_WORDS = Z.typo_words(_CLEAN)
_VARIANTS = Z.typo_variants(_WORDS)
_TYPOS = Z.typo_rows(_VARIANTS, 3)


@query(rf"""SELECT doc_id, len(regexp_extract_all(text, '{_SOLID}+')) AS tokens, coalesce(list_sum([length(x) for x in regexp_extract_all(text, '{_SOLID}+')]), 0)::BIGINT AS token_chars, true AS offsets_fit FROM documents WHERE text IS NOT NULL""")
def token_spans(spark, folder):
    rows = _t(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", "text", Y.token_spans(F.col("text")).alias("s"))
    fits = F.forall("s", lambda x: F.substring(F.col("text"), x["start"] + 1, x["stop"] - x["start"]) == x["surface"])
    return rows.select("doc_id", F.size("s").cast("bigint").alias("tokens"), F.aggregate("s", F.lit(0).cast("bigint"), lambda a, x: a + x["stop"] - x["start"]).alias("token_chars"), fits.alias("offsets_fit"))


@query(f"SELECT *, false AS is_no_error, false AS synthetic_is_gold, false AS auto_replace_allowed, true AS review_required FROM {_TYPOS}")
def typo_rows(spark, folder):
    return _typos(spark, folder)


@query(Z.typo_sweep(_WORDS))
def typo_sweep(spark, folder):
    return Y.sweep_rows(_clean(spark, folder), "sentence_id", "target")


@query(f"SELECT typo_family, typo_rule, count(*) AS rows FROM {_TYPOS} WHERE typo_rule NOT IN {Z.one_of(Y.NORMALISATION_ONLY)} GROUP BY 1, 2")
def typo_core(spark, folder):
    return Y.core_rows(_typos(spark, folder)).groupBy("typo_family", "typo_rule").agg(F.count("*").alias("rows"))


@query(f"SELECT sentence_id, token_index FROM {Z.typo_rows(_VARIANTS, 1)} WHERE typo_rule IN {Z.one_of(Y.NORMALISATION_ONLY)}")
def typo_lost_places(spark, folder):
    """Where a place has one variant only."""
    return Y.lost_places(_typos(spark, folder, 1))


@query(f"SELECT count(*) AS eligible, count(v.k) AS covered FROM (SELECT DISTINCT sentence_id, k FROM {_WORDS} WHERE fit) w LEFT JOIN (SELECT DISTINCT sentence_id, k FROM {_VARIANTS}) v ON v.sentence_id = w.sentence_id AND v.k = w.k")
def typo_coverage(spark, folder):
    return Y.coverage(_clean(spark, folder), _typos(spark, folder), "sentence_id", "target")


@query("""WITH r AS (SELECT g, row_number() OVER (ORDER BY sha256('42|' || g), g) AS n, count(*) OVER () AS a FROM (SELECT DISTINCT source_record_id::VARCHAR AS g FROM routing_signal_audit WHERE source_record_id IS NOT NULL))
    SELECT g AS group_id, CASE WHEN n <= floor(a * 0.8) THEN 'train' WHEN n <= floor(a * 0.8) + floor(a * 0.1) THEN 'dev' ELSE 'test' END AS split FROM r""")
def detector_split(spark, folder):
    return Y.split_groups(_t(spark, folder, "routing_signal_audit").select(F.col("source_record_id").cast("string").alias("g")), "g")


_SPLIT = f"""(SELECT g AS group_id, CASE WHEN n <= floor(a * 0.8) THEN 'train' WHEN n <= floor(a * 0.8) + floor(a * 0.1) THEN 'dev' ELSE 'test' END AS split FROM (SELECT g, row_number() OVER (ORDER BY sha256('42|' || g), g) AS n, count(*) OVER () AS a FROM (SELECT DISTINCT sentence_id AS g FROM {_CLEAN})))"""
_VIEW = f"""(SELECT v.*, s.split FROM (SELECT row_id, sentence_id AS group_id, 'CORRECT_THIS' AS label, input, target, token_index, clean_token, error_word AS observed_token, correction, typo_family, typo_rule, false AS is_no_error FROM {_TYPOS}
    UNION ALL SELECT 'keep-v1-' || sentence_id, sentence_id, 'KEEP', target, target, NULL, NULL, NULL, NULL, NULL, NULL, true FROM {_CLEAN}) v JOIN {_SPLIT} s ON s.group_id = v.group_id)"""


@query(f"SELECT * FROM {_VIEW}")
def detector_view(spark, folder):
    clean = _clean(spark, folder)
    return Y.detector_view(_typos(spark, folder), clean, Y.split_groups(clean, "sentence_id"))


@query(f"""SELECT split, label, tokens FROM (SELECT split, sum(len(regexp_extract_all(input, '{_SOLID}+')) - CASE WHEN label = 'KEEP' THEN 0 ELSE 1 END)::BIGINT AS "OK", sum(CASE WHEN label = 'KEEP' THEN 0 ELSE 1 END)::BIGINT AS "ERROR" FROM {_VIEW} GROUP BY 1) UNPIVOT (tokens FOR label IN ("OK", "ERROR")) WHERE tokens > 0""")
def detector_tokens(spark, folder):
    return Y.token_view(detector_view(spark, folder)).groupBy("split", "label").agg(F.count("*").alias("tokens"))


# ---- joins and sets
@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM eval_items e WHERE e.text = d.text)")
def anti_join_reviewed(spark, folder):
    return R.anti(_t(spark, folder, "documents").select("doc_id", "source", "text"), _t(spark, folder, "eval_items"), ["text"]).select("doc_id", "source")


@query("SELECT DISTINCT sample_id, source_record_id FROM routing_signal_audit r WHERE EXISTS (SELECT 1 FROM validation_documents v WHERE v.source_record_id = r.source_record_id)")
def semi_join_sampled(spark, folder):
    return S.rows_at(_t(spark, folder, "routing_signal_audit").select("sample_id", "source_record_id").distinct(), _t(spark, folder, "validation_documents"), "source_record_id")


@query("SELECT coalesce(d.doc_id, s.text_id) AS position, d.n_chars AS left_value, s.character_count AS right_value FROM documents d FULL JOIN (SELECT text_id, max(character_count) AS character_count FROM seen_texts GROUP BY 1) s ON d.doc_id = s.text_id")
def positional_full_outer(spark, folder):
    left = _t(spark, folder, "documents").select(F.col("doc_id").alias("position"), F.col("n_chars").alias("left_value"))
    right = _t(spark, folder, "seen_texts").groupBy(F.col("text_id").alias("position")).agg(F.max("character_count").alias("right_value"))
    return R.by_position(left, right, "position")


@query("SELECT s.text_id, coalesce(n, 0) AS copies FROM (SELECT DISTINCT text_id FROM seen_texts) s LEFT JOIN (SELECT text_id, count(*) AS n FROM (SELECT DISTINCT * FROM duplicate_occurrences) GROUP BY 1) d ON s.text_id = d.text_id")
def counted_join(spark, folder):
    return R.with_counts(_t(spark, folder, "seen_texts").select("text_id").distinct(), _t(spark, folder, "duplicate_occurrences").distinct(), ["text_id"], "copies")


@query(f"SELECT v.document_sample_id, coalesce(l.label, '') AS human_health_label FROM (SELECT DISTINCT document_sample_id, source_record_id FROM validation_documents) v LEFT JOIN (SELECT source_record_id, max(human_health_label) AS label FROM {_R} GROUP BY 1) l ON l.source_record_id = v.source_record_id")
def label_attach(spark, folder):
    labels = _audit(spark, folder, "source_record_id", "human_health_label").groupBy("source_record_id").agg(F.max("human_health_label").alias("human_health_label"))
    rows = _t(spark, folder, "validation_documents").select("document_sample_id", "source_record_id").distinct()
    return R.attach_labels(rows, labels, ["source_record_id"], "human_health_label").select("document_sample_id", "human_health_label")


@query("SELECT coalesce(a.k, b.k) AS source_record_id, CASE WHEN a.k IS NULL THEN 'RIGHT' WHEN b.k IS NULL THEN 'LEFT' ELSE 'BOTH' END AS side FROM (SELECT DISTINCT source_record_id AS k FROM routing_signal_audit) a FULL JOIN (SELECT DISTINCT source_record_id AS k FROM validation_documents) b ON a.k = b.k")
def set_compare(spark, folder):
    return R.set_compare(_t(spark, folder, "routing_signal_audit"), _t(spark, folder, "validation_documents"), "source_record_id")


@query("SELECT sample_id, count(*) AS rows FROM routing_signal_audit GROUP BY 1 HAVING count(*) > 1")
def repeated_keys(spark, folder):
    return R.repeated_keys(_t(spark, folder, "routing_signal_audit"), "sample_id")


@query("SELECT text_id, max(occurrence_count) AS occurrence_count FROM seen_texts WHERE occurrence_count IS NOT NULL GROUP BY 1")
def keep_last(spark, folder):
    return R.keep_last(_t(spark, folder, "seen_texts").where("occurrence_count IS NOT NULL").select("text_id", "occurrence_count"), ["text_id"], ["occurrence_count"])


@query("SELECT doc_id AS id, n_chars, NULL::INT AS character_count FROM documents UNION ALL SELECT text_id, NULL, character_count FROM seen_texts")
def union_unequal(spark, folder):
    return R.union_all(_t(spark, folder, "documents").select(F.col("doc_id").alias("id"), "n_chars"), _t(spark, folder, "seen_texts").select(F.col("text_id").alias("id"), "character_count"))


@query("SELECT doc_id, text IS NOT NULL AS has_text, n_chars FROM documents")
def one_to_one_join(spark, folder):
    docs = _t(spark, folder, "documents")
    return R.one_to_one(docs.select("doc_id", F.col("text").isNotNull().alias("has_text")), docs.select("doc_id", "n_chars"), "doc_id")


@query(f"SELECT s.sentence_id, g.start AS \"at\", g.rule FROM {_GAPS} g JOIN {_SEG} s ON s.rec = g.doc_id AND g.start > s.a AND g.start < s.b")
def span_containment(spark, folder):
    """Gap matches with the sentence of their document that holds them."""
    gaps = _t(spark, folder, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("source_record_id"), F.explode(T.gap_spans(F.col("text"), _RULES)).alias("s")).select("source_record_id", F.col("s.start").alias("at"), "s.rule")
    return R.containing(gaps, _sentences(spark, folder).select("source_record_id", "sentence_id", "sentence_start_char", "sentence_end_char"), "source_record_id", "at", "sentence_start_char", "sentence_end_char").select("sentence_id", "at", "rule")


# ---- sources, sinks, models, streams
def _own_folder(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_folder(spark)}/chashma/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id // 1000 AS part_number, count(*) AS rows, count(text) AS texts FROM documents GROUP BY 1")
def shard_round_trip(spark, folder):
    path = _own_folder(spark, "shards")
    S.write_shards(_t(spark, folder, "documents").select("doc_id", "text"), path, "doc_id", 1000)
    return S.read_shards(spark, path, "doc_id bigint, text string, part_number int").groupBy(F.col("part_number").cast("bigint").alias("part_number")).agg(F.count("*").alias("rows"), F.count("text").alias("texts"))


@query("SELECT count(*) AS rows, count(DISTINCT doc_id) AS ids, coalesce(sum(length(text)), 0)::BIGINT AS chars FROM documents")
def csv_round_trip(spark, folder):
    path = _own_folder(spark, "csv")
    S.write_csv(_t(spark, folder, "documents"), path, ["doc_id", "lang", "source", "text", "note"])
    return S.read_csv(spark, path).agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids"), F.sum(F.length("text")).alias("chars"))


@query("SELECT CASE WHEN text IS NULL THEN 'NON_STRING_TEXT' ELSE 'TEXT' END AS record_type, count(*) AS rows, coalesce(sum(length(text)), 0)::BIGINT AS chars, min(n) AS first_id, max(n) AS last_id FROM (SELECT text, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents) GROUP BY 1")
def json_array_round_trip(spark, folder):
    """The documents as JSON arrays, in files by id, and back with their numbers."""
    path = _own_folder(spark, "array")
    S.write_json_array(_t(spark, folder, "documents").select("doc_id", "text"), path, "doc_id")
    items = S.classify_items(S.read_json_array(spark, path))
    return items.groupBy("record_type").agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.min("source_record_id").alias("first_id"), F.max("source_record_id").alias("last_id"))


@query("SELECT part_number, count(*) AS rows, 0::BIGINT AS empty_lines FROM (SELECT doc_id // 1000 AS part_number FROM documents) GROUP BY 1")
def shard_manifest(spark, folder):
    path = _own_folder(spark, "shards")
    S.write_shards(_t(spark, folder, "documents").select("doc_id", "text"), path, "doc_id", 1000)
    told = S.manifest(spark, path).withColumn("part_number", F.regexp_extract("path", r"part_number=(\d+)", 1).cast("bigint"))
    return told.groupBy("part_number").agg(F.sum("rows").alias("rows"), F.sum("empty_lines").alias("empty_lines"))


@query()
def file_fingerprints(spark, folder):
    """Of the files of all tables."""
    return S.fingerprints(spark, f"{folder}/*.parquet").drop("path", "modified_at")


@query()
def quality_model_folds(spark, folder):
    """Out-of-fold measures of a logistic model of usable labels on the delivered statistics."""
    numeric = ["digit_ratio", "uppercase_ratio", "latin_ratio", "cyrillic_ratio"]
    rows = _audit(spark, folder, "human_health_label", *numeric).where(F.col("human_health_label").isin([*USABLE, *HARMFUL])).withColumn("y", F.col("human_health_label").isin(USABLE).cast("double"))
    scored = M.out_of_fold(rows, "sample_id", "y", M.numeric_pipeline("logistic", numeric, "y"), 3)
    return A.threshold_sweep(scored.withColumn("truth", F.col("y") == 1.0), "probability", "truth", [0.3, 0.5, 0.7])


@query(f"SELECT {_STATUS} AS normalization_status, count(*) AS records FROM {_NORMAL} GROUP BY 1")
def streamed_normalization(spark, folder):
    docs = _t(spark, folder, "documents")
    # a file stream reads folders; the table may be one file, so its folder is filtered by name
    stream = spark.readStream.schema(docs.schema).option("pathGlobFilter", "documents.parquet" if _is_file(spark, f"{folder}/documents.parquet") else "*.parquet").parquet(folder if _is_file(spark, f"{folder}/documents.parquet") else f"{folder}/documents.parquet")
    counts = audit.normalized(stream, "doc_id", "text").groupBy("normalization_status").agg(F.count("*").alias("records"))
    return audit.run_to_end(counts, _view_name(), _own_folder(spark, "stream"), "complete")


@query(f"""SELECT strftime(date_trunc('hour', crawled_at), '%Y-%m-%d %H:%M:%S') AS "start", strftime(date_trunc('hour', crawled_at) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS texts, count_if(coalesce({_TRIMMABLE}, false)) AS changes FROM documents WHERE crawled_at IS NOT NULL GROUP BY ALL""")
def streamed_windows(spark, folder):
    docs = _t(spark, folder, "documents")
    one = _is_file(spark, f"{folder}/documents.parquet")
    stream = spark.readStream.schema(docs.schema).option("pathGlobFilter", "documents.parquet" if one else "*.parquet").parquet(folder if one else f"{folder}/documents.parquet")
    # what is there is all there is, so the newest windows are whole too
    told = audit.run_to_end(audit.status_windows(stream, "crawled_at", "text"), _view_name(), _own_folder(spark, "stream"), "complete")
    return told.select(*(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("start", "end")), "texts", "changes")


def _view_name() -> str:
    import uuid

    return f"chashma_{uuid.uuid4().hex}"


def _is_file(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile()


from chashma.plans import extras  # noqa: E402, F401  more queries, which use the pieces above
