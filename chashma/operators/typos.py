"""Synthetic typing errors of clean sentences, and the views a detector is trained on. Variants are arrays of structs, so a sentence is never scanned in Python.

Where a choice is random it follows a SHA-256 of seed and place, the same on every engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chashma.functions.text import PLACE, places

# Marks around a word, apostrophe-like marks, letter pairs that are simplified, and which rules only undo normalisation.
OPENING = r"""["'“”‘’(\[{«»„]*"""
CLOSING = r"""[.,!?;:…"'“”‘’)\]}«»]*"""
MARKS = "'‘’ʻʼ`"
SIMPLER = (("sh", "s", "phonetic_sh_to_s"), ("Sh", "S", "phonetic_Sh_to_S"), ("ch", "c", "phonetic_ch_to_c"), ("Ch", "C", "phonetic_Ch_to_C"), ("g'", "g", "apostrophe_g_drop"), ("G'", "G", "apostrophe_G_drop"), ("o'", "o", "apostrophe_o_drop"), ("O'", "O", "apostrophe_O_drop"))
NORMALISATION_ONLY = ("apostrophe_ascii_to_backtick", "apostrophe_ascii_to_curly_left")


def token_spans(text: Column) -> Column:
    """Array of (index, start, stop, surface) of the words between blanks; linear in the text."""
    surfaces, starts = F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0)), places(text, r"(?U)(?<!\S)\S", PLACE)
    both = F.zip_with(surfaces, starts, lambda s, a: F.struct(a.alias("start"), s.alias("surface")))
    return F.transform(both, lambda x, i: F.struct(i.alias("index"), x["start"].alias("start"), (x["start"] + F.length(x["surface"])).alias("stop"), x["surface"].alias("surface")))


def split_surface(surface: Column) -> tuple[Column, Column, Column]:
    """Opening marks, core, closing marks."""
    pattern = rf"(?s)^({OPENING})(.*?)({CLOSING})\z"
    return tuple(F.regexp_extract(surface, pattern, k) for k in (1, 2, 3))


def eligible(core: Column) -> Column:
    return (F.length(core) >= 2) & ~core.rlike(r"^\d+\z") & core.rlike("[A-Za-zÀ-ÿʻʼ‘’'`-]")


def _replace_first(text: Column, old: str, new: str) -> Column:
    at = F.instr(text, old)
    return F.when(at > 0, F.concat(F.left(text, at - 1), F.lit(new), F.substring(text, at + len(old), F.length(text))))


def candidates(core: Column) -> Column:
    """Array of (priority, rule, family, corrupted) of all rules that change a word, in the order of the rules."""
    n = F.length(core)
    half = F.floor(n / 2).cast("int")
    marked = core.rlike(f"[{MARKS}]")
    swap = F.greatest(F.lit(1), half - 1)
    piece = lambda a, b: F.substring(core, a + 1, b - a)
    every: list[tuple[int, str, str, Column]] = [
        (1, "apostrophe_drop", "apostrophe", F.when(marked, F.regexp_replace(core, f"[{MARKS}]", ""))),
        (1, "apostrophe_ascii_to_backtick", "apostrophe", F.when(core.contains("'"), F.replace(core, F.lit("'"), F.lit("`")))),
        (2, "apostrophe_ascii_to_curly_left", "apostrophe", F.when(core.contains("'"), F.replace(core, F.lit("'"), F.lit("‘")))),
        (2, "apostrophe_to_ascii", "apostrophe", F.when(core.rlike("[‘’ʻʼ`]"), F.translate(core, "‘’ʻʼ`", "'''''"))),
        *((2, rule, "phonetic" if rule.startswith("phonetic") else "apostrophe", _replace_first(core, old, new)) for old, new, rule in SIMPLER),
        (3, "drop_last_char", "deletion", F.when(n >= 4, F.left(core, n - 1))),
        (3, "drop_middle_char", "deletion", F.when(n >= 5, F.concat(piece(F.lit(0), half), piece(half + 1, n)))),
        (3, "duplicate_middle_char", "insertion", F.when(n >= 3, F.concat(piece(F.lit(0), half + 1), piece(half, n)))),
        (4, "duplicate_last_char_short_token", "insertion", F.when((n >= 2) & (n <= 4), F.concat(core, F.right(core, F.lit(1))))),
        (3, "swap_inner_chars", "transposition", F.when((n >= 4) & (swap + 1 < n), F.concat(piece(F.lit(0), swap), piece(swap + 1, swap + 2), piece(swap, swap + 1), piece(swap + 2, n)))),
        (5, "split_word_middle", "spacing", F.when(n >= 7, F.concat(piece(F.lit(0), half), F.lit(" "), piece(half, n)))),
    ]
    told = F.array(*(F.struct(F.lit(p).alias("priority"), F.lit(r).alias("rule"), F.lit(f).alias("family"), c.alias("corrupted")) for p, r, f, c in every))
    return F.filter(told, lambda v: v["corrupted"].isNotNull() & (v["corrupted"] != "") & (v["corrupted"] != core))


def distinct_variants(core: Column, fits: Column, forms: Column) -> Column:
    """Of candidates and their forms: each form once, sorted; a doubled last letter if there is none."""
    once = F.filter(fits, lambda v, i: F.array_position(forms, v["corrupted"]) == i + 1)
    last = F.array(F.struct(F.lit(99).alias("priority"), F.lit("duplicate_last_char_fallback").alias("rule"), F.lit("fallback").alias("family"), F.concat(core, F.right(core, F.lit(1))).alias("corrupted")))
    return F.when(F.size(fits) > 0, F.array_sort(once)).otherwise(last)


def with_variants(df: DataFrame, core: str, name: str) -> DataFrame:
    """The variants of a word as a column, in steps, so that none is computed inside another's lambda."""
    steps = df.withColumn("_fits", candidates(F.col(core))).withColumn("_forms", F.transform("_fits", lambda v: v["corrupted"]))
    return steps.withColumn(name, distinct_variants(F.col(core), F.col("_fits"), F.col("_forms"))).drop("_fits", "_forms")


def choose(found: Column, place: Column, most: int = 3, seed: str = "42") -> Column:
    """At most `most` variants: lower priorities first, in hash order within one."""
    keyed = F.transform(found, lambda v: F.struct(v["priority"].alias("priority"), F.sha2(F.concat_ws("|", F.lit(seed), place, v["rule"]), 256).alias("k"), v["rule"].alias("rule"), v["family"].alias("family"), v["corrupted"].alias("corrupted")))
    return F.slice(F.array_sort(keyed), 1, most)


def words_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(sentence_id, index, start, stop, surface, prefix, core, suffix) of the eligible words; no sentence goes with its words."""
    named = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("sentence_id"), F.explode(token_spans(F.col(text_col))).alias("t"))
    prefix, core, suffix = split_surface(F.col("t.surface"))
    return named.select("sentence_id", "t.*", prefix.alias("prefix"), core.alias("core"), suffix.alias("suffix")).where(eligible(F.col("core")))


def typo_rows(df: DataFrame, id_col: str, text_col: str, most: int = 3, seed: str = "42") -> DataFrame:
    """One row for each chosen variant of each eligible word: the sentence with and without the error, and where it is.

    Variants are made where the word stands, so there is no join on words and no shuffle; the sentence is only carried along.
    """
    named = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("sentence_id"), F.col(text_col).alias("target"))
    prefix, core, suffix = split_surface(F.col("t.surface"))
    words = named.select("sentence_id", "target", F.explode(token_spans(F.col("target"))).alias("t")).select("sentence_id", "target", "t.*", prefix.alias("prefix"), core.alias("core"), suffix.alias("suffix"))
    words = with_variants(words.where(eligible(F.col("core"))), "core", "found")
    place = F.concat_ws("|", "sentence_id", F.col("index").cast("string"))
    # each word has a variant; a plain explode would push a filter on it down to the text and make all variants there once more
    rows = words.withColumn("chosen", choose(F.col("found"), place, most, seed)).drop("found").select("*", F.posexplode_outer("chosen").alias("rank", "v"))
    noisy = F.concat("prefix", "v.corrupted", "suffix")
    return rows.select(
        F.format_string("v11-%s-%03d-%02d", F.col("sentence_id"), F.col("index"), F.col("rank")).alias("row_id"), "sentence_id", "target",
        F.concat(F.left("target", F.col("start")), noisy, F.substring("target", F.col("stop") + 1, F.length("target"))).alias("input"), F.col("index").alias("token_index"), F.col("start").alias("token_start_char"), F.col("stop").alias("token_end_char"),
        F.col("core").alias("clean_token"), F.col("v.corrupted").alias("corrupted_token"), noisy.alias("error_word"), F.col("surface").alias("correction"), F.col("v.family").alias("typo_family"), F.col("v.rule").alias("typo_rule"), (F.col("rank") + 1).alias("variant_rank"),
        F.lit(False).alias("is_no_error"), F.lit(False).alias("synthetic_is_gold"), F.lit(False).alias("auto_replace_allowed"), F.lit(True).alias("review_required"),
    )


# The ten rules of a sweep, in their order, with their families.
SWEEP = {
    "apostrophe_drop": "apostrophe",
    "apostrophe_ascii_to_backtick": "apostrophe",
    "phonetic_sh": "phonetic",
    "phonetic_ch": "phonetic",
    "drop_last": "deletion",
    "drop_inner": "deletion",
    "duplicate_inner": "insertion",
    "swap_inner": "transposition",
    "split_word": "spacing",
    "duplicate_last_char_fallback": "insertion_fallback",
}


def sweep_variants(core: Column) -> Column:
    """Array of (rule, family, corrupted): what each rule of the sweep makes of a word, where it changes it."""
    n = F.length(core)
    half, swap = F.floor(n / 2).cast("int"), F.greatest(F.lit(1), F.floor(n / 2).cast("int") - 1)
    piece = lambda a, b: F.substring(core, a + 1, b - a)
    made = {
        "apostrophe_drop": F.replace(core, F.lit("'"), F.lit("")), "apostrophe_ascii_to_backtick": F.replace(core, F.lit("'"), F.lit("`")), "phonetic_sh": F.coalesce(_replace_first(core, "sh", "s"), _replace_first(core, "Sh", "S")), "phonetic_ch": F.coalesce(_replace_first(core, "ch", "c"), _replace_first(core, "Ch", "C")),
        "drop_last": F.when(n >= 4, F.left(core, n - 1)), "drop_inner": F.when(n >= 5, F.concat(piece(F.lit(0), half), piece(half + 1, n))), "duplicate_inner": F.when(n >= 4, F.concat(piece(F.lit(0), half + 1), piece(half, n))),
        "swap_inner": F.when(n >= 4, F.concat(piece(F.lit(0), swap), piece(swap + 1, swap + 2), piece(swap, swap + 1), piece(swap + 2, n))), "split_word": F.when(n >= 7, F.concat(piece(F.lit(0), half), F.lit(" "), piece(half, n))), "duplicate_last_char_fallback": F.when(n >= 2, F.concat(core, F.right(core, F.lit(1)))),
    }
    told = F.array(*(F.struct(F.lit(rule).alias("rule"), F.lit(family).alias("family"), made[rule].alias("corrupted")) for rule, family in SWEEP.items()))
    return F.filter(told, lambda v: v["corrupted"].isNotNull() & (v["corrupted"] != "") & (v["corrupted"] != core))


def sweep_rows(df: DataFrame, id_col: str, text_col: str, seed: str = "42") -> DataFrame:
    """One row for each eligible word: one of the variants that apply, picked by a hash of seed and place; and a row without a variant for each word that is not eligible."""
    named = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("sentence_id"), F.explode(token_spans(F.col(text_col))).alias("t"))
    _, core, _ = split_surface(F.col("t.surface"))
    words = named.select("sentence_id", F.col("t.index").alias("token_index"), F.col("t.surface").alias("surface"), core.alias("core")).withColumn("eligible", eligible(F.col("core"))).withColumn("fits", sweep_variants(F.col("core")))
    turn = F.conv(F.left(F.sha2(F.concat_ws("|", F.lit(seed), "sentence_id", F.col("token_index").cast("string")), 256), F.lit(8)), 16, 10).cast("bigint")
    v = F.when(F.col("eligible"), F.get("fits", F.pmod(turn, F.greatest(F.size("fits"), F.lit(1))).cast("int")))
    return words.withColumn("v", v).select("sentence_id", "token_index", "surface", "core", "eligible", "v.rule", "v.family", "v.corrupted")


def coverage(df: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(eligible, covered): eligible words, and those that have at least one row."""
    words = words_of(df, id_col, text_col).select("sentence_id", F.col("index").alias("token_index"))
    have = rows.select("sentence_id", "token_index").distinct().withColumn("have", F.lit(1))
    return words.distinct().join(have, ["sentence_id", "token_index"], "left").agg(F.count("*").alias("eligible"), F.count("have").alias("covered"))


def core_rows(rows: DataFrame) -> DataFrame:
    """Without the rules that normalisation would undo; with how many rows each place keeps."""
    kept = rows.where(~F.col("typo_rule").isin(*NORMALISATION_ONLY))
    counts = kept.groupBy("sentence_id", "token_index").agg(F.count("*").alias("rows_of_place"))
    return kept.join(counts, ["sentence_id", "token_index"]).withColumn("change", F.concat_ws(" -> ", "correction", "error_word"))


def lost_places(rows: DataFrame) -> DataFrame:
    """Places that `core_rows` leaves without any row."""
    key = ["sentence_id", "token_index"]
    return rows.select(*key).distinct().join(rows.where(~F.col("typo_rule").isin(*NORMALISATION_ONLY)).select(*key), key, "left_anti")


def group_id(*candidates: Column, text: Column) -> Column:
    """The first id that is not empty, else a hash of the text."""
    return F.coalesce(*(F.nullif(F.trim(c.cast("string")), F.lit("")) for c in candidates), F.left(F.sha2(text, 256), F.lit(16)))


def split_groups(groups: DataFrame, group: str, seed: str = "42", train: float = 0.8, dev: float = 0.1) -> DataFrame:
    """(group, split): whole groups in hash order, `train` and `dev` shares rounded down, the rest test.

    The order is cut by exact counts over hash ranges, so no task ranks all groups: a range of the hash's first bits is placed by running sums, and only inside it rows are ranked.
    """
    ids = groups.where(F.col(group).isNotNull()).select(F.col(group).alias("group_id")).distinct().withColumn("score", F.sha2(F.concat_ws("|", F.lit(seed), "group_id"), 256)).withColumn("bin", F.left("score", F.lit(3)))
    bins = ids.groupBy("bin").agg(F.count("*").alias("in_bin"))  # at most 4096 rows
    edges = bins.withColumn("before", F.coalesce(F.sum("in_bin").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum("in_bin").over(Window.partitionBy(F.lit(0))))
    ranked = ids.join(edges, "bin").withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy("bin").orderBy("score", "group_id")))
    first, second = F.floor(F.col("all") * F.lit(train)), F.floor(F.col("all") * F.lit(dev))
    return ranked.select("group_id", F.when(F.col("place") <= first, "train").when(F.col("place") <= first + second, "dev").otherwise("test").alias("split"))


def detector_view(typos: DataFrame, clean: DataFrame, splits: DataFrame) -> DataFrame:
    """Rows to correct and rows to keep, with the split of their group. `clean`: (sentence_id, target)."""
    wrong = typos.select("row_id", F.col("sentence_id").alias("group_id"), F.lit("CORRECT_THIS").alias("label"), "input", "target", "token_index", "clean_token", F.col("error_word").alias("observed_token"), "correction", "typo_family", "typo_rule", "is_no_error")
    keep = clean.select(F.concat(F.lit("keep-v1-"), "sentence_id").alias("row_id"), F.col("sentence_id").alias("group_id"), F.lit("KEEP").alias("label"), F.col("target").alias("input"), "target", F.lit(True).alias("is_no_error"))
    return wrong.unionByName(keep, allowMissingColumns=True).join(splits, "group_id")


def token_view(view: DataFrame) -> DataFrame:
    """One row for each word of each input, labelled where it is the corrupted one."""
    rows = view.select("row_id", "group_id", "split", F.col("label").alias("sentence_label"), "token_index", token_spans(F.col("input")).alias("spans")).withColumn("t", F.explode("spans"))
    hit = (F.col("sentence_label") == "CORRECT_THIS") & (F.col("t.index") == F.col("token_index"))
    return rows.select("row_id", "group_id", "split", "sentence_label", F.col("t.index").alias("token_index"), F.col("t.surface").alias("token"), F.col("t.start").alias("token_start_char"), F.col("t.stop").alias("token_end_char"), F.when(F.coalesce(hit, F.lit(False)), "ERROR").otherwise("OK").alias("label"))
