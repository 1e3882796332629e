"""More queries of the core operators: parsers, review work, files, models and checks. Registered with those of `catalogue`."""

from __future__ import annotations

from pyspark.sql import functions as F

from chashma.functions import text as T
from chashma.operators import aggregate as A
from chashma.operators import boundaries as B
from chashma.operators import models as M
from chashma.operators import normalize as N
from chashma.operators import relate as R
from chashma.operators import rules as L
from chashma.operators import sampling as W
from chashma.operators import typos as Y
from chashma.plans import sql as Z
from chashma.plans.catalogue import _NORMAL, _R, _ROUTES, _SEG, _STATUS, HARMFUL, HEALTHY, LABELS, MINOR, USABLE, _audit, _joined, _lexicon, _LEX, _normalized, _own_folder, _routes, _sentences, _t
from chashma.plans.registry import query
from chashma.sources import files as S


# ---- functions of one text
@query("SELECT sample_id, coalesce(nullif(trim(sentence_id), ''), nullif(trim(sample_id), '')) AS named FROM (SELECT DISTINCT sample_id, sentence_id FROM routing_signal_audit)")
def first_named_values(spark, folder):
    rows = _t(spark, folder, "routing_signal_audit").select("sample_id", "sentence_id").distinct()
    return rows.select("sample_id", T.first_named(rows.columns, "no_such_column", "Sentence_ID", "SAMPLE_ID").alias("named"))


@query(f"SELECT rec AS source_record_id, count(*) AS sentences FROM {_SEG} GROUP BY 1")
def records_of_sentences(spark, folder):
    return _sentences(spark, folder).select(T.record_of_sentence(F.col("sentence_id")).alias("source_record_id")).groupBy("source_record_id").agg(F.count("*").alias("sentences"))


@query(rf"SELECT doc_id, round(CASE WHEN length(text) > 0 THEN {Z.N(r'\pL')} / length(text) ELSE 0 END, 6) AS letter_ratio FROM documents WHERE text IS NOT NULL")
def letter_ratios(spark, folder):
    return _t(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", T.letter_ratio_of_all(F.col("text")).alias("letter_ratio"))


@query(r"SELECT run, count(*) AS runs FROM (SELECT replace(replace(unnest(regexp_extract_all(text, '[ \t]{2,}')), ' ', '<SPACE>'), chr(9), '<TAB>') AS run FROM documents) GROUP BY 1")
def blank_run_shapes(spark, folder):
    return _t(spark, folder, "documents").select(F.explode(T.blank_runs(F.col("text"))).alias("run")).groupBy("run").agg(F.count("*").alias("runs"))


@query("SELECT doc_id, CASE WHEN s < 1024 THEN printf('%.2f B', s::DOUBLE) WHEN s < 1048576 THEN printf('%.2f KiB', round(s / 1024, 2)) ELSE printf('%.2f MiB', round(s / 1048576, 2)) END AS size FROM (SELECT doc_id, strlen(text) AS s FROM documents WHERE text IS NOT NULL)")
def text_sizes(spark, folder):
    return _t(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", T.human_size(F.octet_length("text").cast("bigint")).alias("size"))


@query(" UNION ALL ".join(f"SELECT '{n}' AS map, count(*) FILTER (WHERE {Z.one_apostrophe('text', m)} != text) AS changed, count(*) FILTER (WHERE regexp_matches({Z.one_apostrophe('text', m)}, '[`´ʻʼ‘’]')) AS left_over FROM documents" for n, m in T.APOSTROPHE_MAPS.items()))
def apostrophe_maps(spark, folder):
    docs, t = _t(spark, folder, "documents"), F.col("text")
    each = F.array(*(F.struct(F.lit(n).alias("map"), F.count_if(T.one_apostrophe(t, m) != t).alias("changed"), F.count_if(T.one_apostrophe(t, m).rlike("[`´ʻʼ‘’]")).alias("left_over")) for n, m in T.APOSTROPHE_MAPS.items()))
    return docs.agg(each.alias("r")).select(F.inline("r"))


@query(r"SELECT printf('U+%04X', ord(c)) AS code, count(*) AS occurrences FROM (SELECT unnest(regexp_extract_all(text, '[\p{Cf}\p{Cc}\x{FFFD}]')) AS c FROM documents) WHERE c NOT IN (chr(9), chr(10), chr(13)) GROUP BY 1")
def format_characters(spark, folder):
    return _t(spark, folder, "documents").select(F.explode(T.format_characters(F.col("text"))).alias("code")).groupBy("code").agg(F.count("*").alias("occurrences"))


@query(f"SELECT doc_id, {Z.broken_spacing('text')} AS broken_spacing FROM documents WHERE text IS NOT NULL")
def broken_spacing(spark, folder):
    return _t(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", T.broken_spacing(F.col("text")).alias("broken_spacing"))


@query(r"SELECT sample_id, v, CASE WHEN regexp_matches(trim(v), '^[+-]?[0-9]+(\.0*)?$') THEN regexp_replace(trim(v), '\.0*$', '')::BIGINT END AS as_int FROM (SELECT DISTINCT sample_id, unnest([' ' || stored_character_count || ' ', actual_token_count || '.0', CASE WHEN digit_ratio > 0 THEN '0.5' ELSE '-7' END, human_health_label]) AS v FROM routing_signal_audit)")
def tolerant_integers(spark, folder):
    c = F.col
    rows = _t(spark, folder, "routing_signal_audit").select("sample_id", F.explode(F.array(F.concat(F.lit(" "), c("stored_character_count").cast("string"), F.lit(" ")), F.concat(c("actual_token_count").cast("string"), F.lit(".0")), F.when(c("digit_ratio") > 0, "0.5").otherwise("-7"), c("human_health_label"))).alias("v")).distinct()
    return rows.select("sample_id", "v", T.parse_int(c("v")).alias("as_int"))


@query("SELECT CASE WHEN text IS NULL THEN 'OBJECT<doc_id: BIGINT>' ELSE 'OBJECT<doc_id: BIGINT, text: STRING>' END AS shape, count(*) AS rows FROM documents GROUP BY 1")
def schema_shapes(spark, folder):
    return A.schema_shapes(_items(spark, folder, "doc_id", "text"), "item")


@query("SELECT unnest(['doc_id', 'lang', 'source', 'no_such_field']) AS field, unnest([count(doc_id), count(lang), count(source), 0]) AS present, unnest([count(*) - count(doc_id), count(*) - count(lang), count(*) - count(source), count(*)]) AS missing FROM documents")
def field_presence(spark, folder):
    return A.field_presence(_items(spark, folder, "doc_id", "lang", "source"), "item", ["doc_id", "lang", "source", "no_such_field"])


def _items(spark, folder, *fields: str):
    return _t(spark, folder, "documents").select(F.parse_json(F.to_json(F.struct(*fields))).alias("item"))


# ---- normalised rows
@query(f"SELECT 'VALID' AS side, {_STATUS} AS normalization_status, count(*) AS rows, sum(length(n))::BIGINT AS chars FROM {_NORMAL} WHERE text IS NOT NULL GROUP BY 2 UNION ALL SELECT 'INVALID', 'INVALID_INPUT_REVIEW_REQUIRED', count(*), NULL FROM documents WHERE text IS NULL HAVING count(*) > 0")
def valid_and_invalid(spark, folder):
    valid, invalid = N.split_valid(_normalized(spark, folder))
    one = valid.groupBy("normalization_status").agg(F.count("*").alias("rows"), F.sum(F.length("normalized_text")).alias("chars")).withColumn("side", F.lit("VALID"))
    two = invalid.groupBy("normalization_status").agg(F.count("*").alias("rows")).withColumn("side", F.lit("INVALID"))
    return one.unionByName(two, allowMissingColumns=True)


# ---- joins, selections, outcomes
@query("SELECT d.doc_id, o.first_source FROM (SELECT doc_id FROM documents) d LEFT JOIN (SELECT text_id, min(source_record_id) AS first_source FROM duplicate_occurrences WHERE source_record_id IS NOT NULL GROUP BY 1) o ON o.text_id = d.doc_id")
def first_of_key(spark, folder):
    right = _t(spark, folder, "duplicate_occurrences").where("source_record_id IS NOT NULL").select(F.col("text_id").alias("doc_id"), F.col("source_record_id").alias("first_source"))
    return R.left_first(_t(spark, folder, "documents").select("doc_id"), right, "doc_id", "first_source")


@query("SELECT DISTINCT text_id, source_record_id FROM duplicate_occurrences o WHERE EXISTS (SELECT 1 FROM seen_texts s WHERE s.text_id = o.text_id AND s.occurrence_count > 2)")
def semi_join_occurrences(spark, folder):
    return R.semi(_t(spark, folder, "duplicate_occurrences").distinct(), _t(spark, folder, "seen_texts").where("occurrence_count > 2"), ["text_id"])


_OUTCOME = f"CASE WHEN sel AND hea THEN 'SELECTED_HEALTHY' WHEN sel THEN 'FALSE_CLEAN' WHEN hea THEN 'MISSED_HEALTHY' ELSE 'REJECTED' END"
_OUTCOMES = "(" + " UNION ALL ".join(f"SELECT lang, '{p.name}' AS profile, len(reasons) = 0 AS sel, coalesce(human_health_label IN ('{HEALTHY}', '{MINOR}'), false) AS hea FROM {Z.strict(p, _R, 'sentence_text', 'lang', 'human_health_label')}" for p in (L.STRICT, L.WIDE)) + ")"


@query(f"""SELECT *, round(CASE WHEN selected_healthy + false_clean > 0 THEN selected_healthy / (selected_healthy + false_clean) ELSE 0 END, 6) AS precision, round(CASE WHEN selected_healthy + missed_healthy > 0 THEN selected_healthy / (selected_healthy + missed_healthy) ELSE 0 END, 6) AS recall
    FROM (SELECT profile, lang, {", ".join(f"count_if({_OUTCOME} = '{n.upper()}') AS {n}" for n in ("selected_healthy", "false_clean", "missed_healthy", "rejected"))} FROM {_OUTCOMES} GROUP BY 1, 2)""")
def selection_by_profile(spark, folder):
    """What each profile selects, against the labels, for each language."""
    rows = L.select(_audit(spark, folder, "sentence_text", "human_health_label", "lang"), "sentence_text", (L.STRICT, L.WIDE))
    healthy = F.coalesce(F.col("human_health_label").isin(USABLE), F.lit(False))
    told = rows.select("lang", F.explode_outer(F.array(*(F.struct(F.lit(p).alias("profile"), R.selection_outcome(F.col(f"selected_{p}"), healthy).alias("outcome")) for p in ("strict", "wide")))).alias("x")).select("lang", "x.*")
    return A.selection_scores(told, "outcome", "profile", "lang")


_FLAG_LIST = r"""list_sort(list_distinct([x for x in [regexp_replace(y, '^\s+|\s+$', '', 'g') for y in string_split_regex(regexp_replace(boundary_flags, '[\[\]()''"{}]', '', 'g'), '[|,;]')] if x != '' AND upper(x) != 'NONE']))"""


@query(f"WITH r AS (SELECT {_FLAG_LIST} AS l, t.* FROM (SELECT boundary_flags, truth, predicted FROM {_ROUTES.replace('SELECT CASE', 'SELECT boundary_flags, CASE', 1)}) t) SELECT truth, predicted, unnest(CASE WHEN coalesce(len(l), 0) = 0 THEN ['NONE'] ELSE l END) AS flag, count(*) AS rows FROM r GROUP BY 1, 2, 3")
def route_transitions(spark, folder):
    flags = _audit(spark, folder, "boundary_flags").select("sample_id", T.parse_list(F.col("boundary_flags")).alias("flags"))
    return A.transitions(_routes(spark, folder).join(flags, "sample_id"), "truth", "predicted", "flags")


_LEVELS = {
    "REJECT": ("replacement_character", "mixed_latin_cyrillic", "url_or_mail", "bracket_imbalance"),
    "QUARANTINE": ("many_digits", "capitals", "bullet", "spaced_letters", "very_long"),
    "REPAIRABLE_USABLE": ("apostrophe_gap", "repeated_blanks", "repeated_signs", "case_merge", "line_break", "no_terminal_punctuation"),
}
_SIGNAL_SQL = Z.signals("st")
_LEVEL_SQL = {name: Z.flags({n.upper(): f"coalesce({_SIGNAL_SQL[n]}, false)" for n in names}) for name, names in _LEVELS.items()}


@query(f"""WITH f AS (SELECT {", ".join(f"{sql} AS {name}" for name, sql in _LEVEL_SQL.items())} FROM (SELECT *, {Z.stripped('sentence_text')} AS st FROM {_R}) WHERE sentence_text IS NOT NULL),
    d AS (SELECT {"CASE " + " ".join(f"WHEN len({n}) > 0 THEN '{n}'" for n in _LEVELS) + " ELSE 'DIRECT_HEALTHY' END"} AS decision, {"CASE " + " ".join(f"WHEN len({n}) > 0 THEN {n}" for n in _LEVELS) + " ELSE ['NONE'] END"} AS why FROM f)
    SELECT decision, unnest(why) AS reason, count(*) AS rows FROM d GROUP BY 1, 2""")
def health_routes(spark, folder):
    """Decisions by levels of rules, here the signals of damage, with their reasons."""
    rows = _audit(spark, folder, "sentence_text").where("sentence_text IS NOT NULL").select("sample_id", *L.signals(F.col("sentence_text")))
    decision, why = L.route_by({name: {n.upper(): F.col(f"signal_{n}") for n in names} for name, names in _LEVELS.items()}, "DIRECT_HEALTHY")
    told = rows.select(decision.alias("decision"), why.alias("why")).select("decision", F.explode_outer(F.when(F.size("why") == 0, F.array(F.lit("NONE"))).otherwise(F.col("why"))).alias("reason"))
    return told.groupBy("decision", "reason").agg(F.count("*").alias("rows"))


@query(f"""SELECT DISTINCT ON (k) k AS normal_text, origin, id FROM (SELECT lower({Z.stripped(Z.one_apostrophe('text'))}) AS k, 1 AS origin, doc_id AS id FROM documents WHERE text IS NOT NULL UNION ALL SELECT lower({Z.stripped(Z.one_apostrophe('text_value'))}), 2, text_id FROM seen_texts WHERE text_value IS NOT NULL) ORDER BY k, origin, id""")
def seed_union(spark, folder):
    """Texts of two tables, each once by its normal form, the first table's before the second's."""
    normal = lambda c: F.lower(T.strip(T.one_apostrophe(F.col(c))))
    one = _t(spark, folder, "documents").where("text IS NOT NULL").select(normal("text").alias("normal_text"), F.lit(1).alias("origin"), F.col("doc_id").alias("id"))
    two = _t(spark, folder, "seen_texts").where("text_value IS NOT NULL").select(normal("text_value").alias("normal_text"), F.lit(2).alias("origin"), F.col("text_id").alias("id"))
    return R.keep_first(R.union_all(one, two), ["normal_text"], ["origin", "id"])


# ---- review work
_PRIORITIES = {"CORRUPT": "human_health_label = 'HEAVY_CORRUPTION'", "FOREIGN": "human_health_label = 'MIXED_OR_FOREIGN_TEXT'", "MANY_DIGITS": "digit_ratio > 0.2", "UNLABELLED": "human_health_label IS NULL"}
_PRIORITY = "CASE " + " ".join(f"WHEN {c} THEN {i}" for i, c in enumerate(_PRIORITIES.values(), 1)) + f" ELSE {len(_PRIORITIES) + 1} END"


@query(f"SELECT sample_id, priority::INT AS priority, {[*_PRIORITIES, 'OTHER']}[priority] AS priority_name, row_number() OVER (ORDER BY priority, part_number NULLS FIRST, sample_id) AS row_number FROM (SELECT sample_id, part_number, {_PRIORITY} AS priority FROM {_R})")
def review_priorities(spark, folder):
    rows = _audit(spark, folder, "part_number", "human_health_label", "digit_ratio")
    return W.priority_order(rows, {n: F.expr(c) for n, c in _PRIORITIES.items()}, ["part_number", "sample_id"]).select("sample_id", "priority", "priority_name", "row_number")


@query("SELECT batch, rows, reviewed, unknown_labels, " + ", ".join(LABELS) + ", rows - reviewed AS pending, CASE WHEN rows = reviewed THEN 'DONE' WHEN reviewed = 0 THEN 'NEW' ELSE 'STARTED' END AS state FROM (SELECT coalesce(part_number, -1) AS batch, count(*) AS rows, "
       + f"count_if(coalesce(trim(human_health_label), '') != '') AS reviewed, count_if(coalesce(trim(human_health_label), '') != '' AND human_health_label NOT IN {Z.one_of(LABELS)}) AS unknown_labels, " + ", ".join(f"count_if(human_health_label = '{x}') AS {x}" for x in LABELS) + f" FROM {_R} GROUP BY 1)")
def review_progress(spark, folder):
    rows = _audit(spark, folder, "part_number", "human_health_label").select(F.coalesce("part_number", F.lit(-1)).alias("batch"), "human_health_label")
    return W.batch_progress(rows, "batch", "human_health_label", LABELS)


@query(f"""WITH e AS (SELECT sample_id, CASE WHEN signal_no_terminal_punctuation THEN 'LEAVE' ELSE 'PROTECT' END AS p, CASE WHEN human_health_label IN ('{HEALTHY}', '{MINOR}') THEN 'PROTECT' WHEN human_health_label IS NOT NULL THEN 'LEAVE' END AS l FROM {_R})
    SELECT CASE WHEN l IS NULL AND p = 'PROTECT' THEN 'PENDING_PROTECT' WHEN l IS NULL THEN 'PENDING_LEAVE' WHEN l = p THEN 'AGREED' ELSE 'DISPUTED' END AS triage, count(*) AS events FROM e GROUP BY 1""")
def review_triage(spark, folder):
    rows = _audit(spark, folder, "signal_no_terminal_punctuation", "human_health_label")
    events = rows.select("sample_id", F.when(F.coalesce("signal_no_terminal_punctuation", F.lit(False)), "LEAVE").otherwise("PROTECT").alias("prediction"))
    reviewed = rows.where("human_health_label IS NOT NULL").select("sample_id", F.when(F.col("human_health_label").isin(USABLE), "PROTECT").otherwise("LEAVE").alias("label"))
    return B.triage(events, reviewed, ["sample_id"]).groupBy("triage").agg(F.count("*").alias("events"))


@query("SELECT text_id, coalesce(nullif(trim(first_record_id::VARCHAR), ''), left(sha256(text_value), 16)) AS group_id FROM (SELECT DISTINCT text_id, first_record_id, text_value FROM seen_texts)")
def stable_groups(spark, folder):
    rows = _t(spark, folder, "seen_texts").select("text_id", "first_record_id", "text_value").distinct()
    return rows.select("text_id", Y.group_id(F.lit("  "), F.col("first_record_id"), text=F.col("text_value")).alias("group_id"))


_GATES = {"off": "false", "low_trigrams": "coverage < 0.45", "hard_seven": "coverage < 0.45 AND length(token) >= 7", "hard_six": "coverage < 0.45 AND length(token) >= 6"}
_COVERAGE = f"""(WITH k AS (SELECT DISTINCT unnest([substr('^' || token || '$', i, 3) for i in range(1, length(token) + 1)]) AS g FROM {_LEX} WHERE n >= 50), t AS (SELECT token, unnest([substr('^' || token || '$', i, 3) for i in range(1, length(token) + 1)]) AS g FROM {_LEX} WHERE n = 1)
    SELECT token, round(count(k.g) / count(*), 6) AS coverage FROM t LEFT JOIN k ON t.g = k.g GROUP BY 1)"""


@query(f"WITH u AS (SELECT doc_id, unnest(list_distinct({Z.plain_tokens('text')})) AS token FROM documents), b AS (SELECT u.doc_id, " + ", ".join(f"coalesce({c}, false) AS {n}" for n, c in _GATES.items()) + f" FROM u LEFT JOIN (SELECT token AS t2, coverage FROM {_COVERAGE}) c ON c.t2 = u.token) SELECT " + ", ".join(f"(SELECT count(*) FROM (SELECT doc_id FROM b GROUP BY 1 HAVING bool_or({n}))) AS {n}" for n in _GATES))
def lexical_gate(spark, folder):
    """How many texts each profile of the gate holds back for a rare token unlike the frequent ones."""
    lexicon = _lexicon(spark, folder)
    coverage = L.trigram_coverage(lexicon.where("occurrences = 1"), lexicon.where("occurrences >= 50"))
    used = _t(spark, folder, "documents").select("doc_id", F.explode(F.array_distinct(T.tokens(F.lower(T.one_apostrophe(F.col("text"))), "plain"))).alias("token"))
    held = used.join(coverage, "token", "left").groupBy("doc_id").agg(*(F.bool_or(F.coalesce(F.expr(c), F.lit(False))).alias(n) for n, c in _GATES.items()))
    return held.agg(*(F.count_if(n).alias(n) for n in _GATES))


# ---- files
@query("SELECT regexp_replace(source, '[^A-Za-z0-9_.-]+', '_', 'g') AS category, count(*) AS rows, count(DISTINCT doc_id) AS ids FROM documents WHERE source IS NOT NULL GROUP BY 1")
def category_files(spark, folder):
    path = _own_folder(spark, "categories")
    S.write_by_category(_t(spark, folder, "documents").where("source IS NOT NULL").select("doc_id", "source"), path, "source")
    return spark.read.option("header", True).csv(path).groupBy("category").agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids"))


@query("SELECT line, number FROM (SELECT '| lang | rows |' AS line, 1 AS number UNION ALL SELECT '|---|---|', 2 UNION ALL SELECT '| ' || coalesce(lang, '') || ' | ' || n || ' |', (2 + row_number() OVER (ORDER BY lang NULLS FIRST))::INT FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1))")
def report_lines(spark, folder):
    """A report of counts as lines of a table."""
    counts = _t(spark, folder, "documents").groupBy("lang").agg(F.count("*").alias("rows")).orderBy("lang")
    return spark.createDataFrame([(line, i) for i, line in enumerate(S.markdown(counts).split("\n"), 1)], "line string, number int")


@query("SELECT doc_id, source FROM documents WHERE doc_id < 500")
def prefix_scan(spark, folder):
    """The feature is the limit: records below an id, as for a trial run."""
    return S.first_ids(_t(spark, folder, "documents").select("doc_id", "source"), "doc_id", 500)


@query("SELECT count(*) AS rows, count(DISTINCT doc_id) AS ids, coalesce(sum(length(source)), 0)::BIGINT AS chars FROM documents")
def bom_csv_round_trip(spark, folder):
    """A CSV whose first name has a byte order mark before it."""
    path = _own_folder(spark, "bom")
    docs = _t(spark, folder, "documents").select(F.col("doc_id").alias("﻿doc_id"), "source")
    S.write_csv(docs, path, docs.columns)
    return S.read_csv(spark, path).agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids"), F.sum(F.length("source")).alias("chars"))


@query("SELECT true AS starts_with_bracket, true AS ends_with_bracket, false AS has_bom, 1::BIGINT AS files")
def array_boundaries(spark, folder):
    """First and last signs of a JSON array of all documents' ids and sources, written as one file of lines."""
    path = _own_folder(spark, "bounds")
    rows = _t(spark, folder, "documents").select("doc_id", "source")
    S.write_json_array(rows, path, "doc_id")
    return S.boundaries(spark, path).groupBy("starts_with_bracket", "ends_with_bracket", "has_bom").agg(F.count("*").alias("files"))


# ---- models
_NUMERIC = ["digit_ratio", "uppercase_ratio", "latin_ratio", "cyrillic_ratio"]
_LABELLED = f"(SELECT * FROM {_R} WHERE human_health_label IN {Z.one_of([*USABLE, *HARMFUL])})"


def _labelled(spark, folder, *columns: str):
    rows = _audit(spark, folder, "human_health_label", *columns).where(F.col("human_health_label").isin([*USABLE, *HARMFUL]))
    return rows.withColumn("y", F.col("human_health_label").isin(USABLE).cast("double"))


@query(f"""SELECT name, CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS status, observed FROM (SELECT unnest(['has_rows', 'unique_ids', 'all_labelled', 'several_labels']) AS name, unnest([n > 0, n = ids, un = 0, labels > 1]) AS ok, unnest([n, ids, un, labels]) AS observed
    FROM (SELECT count(*) AS n, count(DISTINCT sample_id) AS ids, count_if(NOT coalesce(human_health_label IN {Z.one_of(LABELS)}, false)) AS un, count(DISTINCT human_health_label) AS labels FROM routing_signal_audit))""")
def model_preflight(spark, folder):
    return M.preflight(_t(spark, folder, "routing_signal_audit"), "sample_id", "human_health_label", LABELS)


@query(f"SELECT route, count(*) AS rows FROM (SELECT CASE WHEN coalesce(latin_ratio, 0) >= 0.6 THEN CASE WHEN coalesce(digit_ratio, 0) >= 0.05 THEN 'DIRECT_HEALTHY' ELSE 'REPAIRABLE_USABLE' END WHEN coalesce(cyrillic_ratio, 0) >= 0.5 THEN 'REJECT' ELSE 'QUARANTINE' END AS route FROM {_R} WHERE NOT isnan(coalesce(latin_ratio, 0)) AND NOT isnan(coalesce(digit_ratio, 0)) AND NOT isnan(coalesce(cyrillic_ratio, 0))) GROUP BY 1")
def staged_routes(spark, folder):
    """The staged decision with delivered ratios for scores."""
    rows = _audit(spark, folder, "latin_ratio", "digit_ratio", "cyrillic_ratio").select(*(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("latin_ratio", "digit_ratio", "cyrillic_ratio"))).where("NOT isnan(latin_ratio) AND NOT isnan(digit_ratio) AND NOT isnan(cyrillic_ratio)")
    return rows.select(M.staged_route("latin_ratio", "digit_ratio", "cyrillic_ratio", (0.6, 0.05, 0.5)).alias("route")).groupBy("route").agg(F.count("*").alias("rows"))


_CUTS = [0.2, 0.4, 0.6, 0.8]


@query(f"""WITH r AS (SELECT unnest({_CUTS})::DOUBLE AS threshold, latin_ratio AS s, human_health_label IN ('{HEALTHY}', '{MINOR}') AS t FROM {_LABELLED} WHERE latin_ratio IS NOT NULL AND NOT isnan(latin_ratio)), c AS (SELECT threshold, count_if(s >= threshold AND t) AS tp, count_if(s >= threshold AND NOT t) AS fp, count_if(s < threshold AND t) AS fn, count_if(s < threshold AND NOT t) AS tn FROM r GROUP BY 1),
    m AS (SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, round(CASE WHEN tp + fp > 0 THEN fp / (tp + fp) ELSE 0 END, 6) AS leakage, round((tp + fp) / (tp + fp + fn + tn), 6) AS coverage FROM c)
    SELECT *, leakage <= 0.3 AND tp + fp > 0 AS within FROM m ORDER BY within DESC, CASE WHEN within THEN 0 ELSE leakage END, coverage DESC, recall DESC, precision DESC, threshold LIMIT 1""")
def threshold_choice(spark, folder):
    rows = _labelled(spark, folder, "latin_ratio").where("latin_ratio IS NOT NULL AND NOT isnan(latin_ratio)").withColumn("probability", F.col("latin_ratio"))
    return M.best_threshold(rows, "y", _CUTS, 0.3)


@query(f"SELECT count(*) AS scored, count_if(y) AS positive, true AS all_probabilities FROM (SELECT human_health_label IN ('{HEALTHY}', '{MINOR}') AS y FROM {_LABELLED})")
def frozen_model(spark, folder):
    """A logistic model fitted, saved with its mark, loaded again and applied to rows without labels."""
    rows = _labelled(spark, folder, *_NUMERIC)
    path = _own_folder(spark, "model")
    M.save(M.numeric_pipeline("logistic", _NUMERIC, "y").fit(M.weighted(rows, "y")), path)
    scored = M.frozen(path, rows.select("sample_id", *_NUMERIC), rows.select("sample_id", "y"), "sample_id")
    return scored.agg(F.count("*").alias("scored"), F.count_if(F.col("y") == 1.0).alias("positive"), F.bool_and(F.col("probability").between(0.0, 1.0)).alias("all_probabilities"))


@query()
def model_kinds(spark, folder):
    """Out-of-fold measures of the tree, forest and boosted models; the trees' settings are smaller than the default, as they are fitted twice each."""
    rows = _labelled(spark, folder, *_NUMERIC).select("sample_id", "y", *_NUMERIC).cache()
    out = None
    for kind in ("tree", "forest", "boosted"):
        scored = M.out_of_fold(rows, "sample_id", "y", M.numeric_pipeline(kind, _NUMERIC, "y", trees=20, rounds=5), 2)
        part = A.threshold_sweep(scored.withColumn("truth", F.col("y") == 1.0), "probability", "truth", [0.5]).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionAll(part)
    return out


@query()
def text_model_folds(spark, folder):
    """Out-of-fold measures of the model that sees the text; with fewer features and rounds than the default, as it is fitted twice."""
    rows = _labelled(spark, folder, "sentence_text").where("length(trim(sentence_text)) > 5").select("sample_id", "y", "sentence_text")
    scored = M.out_of_fold(rows, "sample_id", "y", M.text_pipeline("sentence_text", "y", features=1 << 10, rounds=8), 2)
    return A.threshold_sweep(scored.withColumn("truth", F.col("y") == 1.0), "probability", "truth", [0.3, 0.5, 0.7])
