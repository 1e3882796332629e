"""Rule-based sentences of Uzbek Latin prose with exact offsets, flags for review and stable ids.

The scan is sequential (flags of protected ends move on to the next split), so it runs in one Arrow-fed
Python function for each batch; everything after it (ids, hashes, checks) is built of columns.

A text ends a sentence at a run of `.!?…` with the quotes and brackets that close behind it, unless a rule
protects the end. Offsets are zero-based, half open and count code points. Null texts have no sentences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VERSION = "phase_03_sentence_record_v1"
LONG = 400

# Marks, words and phrases the rules know.
TERMINALS = ".!?…"
CLOSERS = "\"»”’)]}"
SPEECH = frozenset(("deb", "dedi", "deya", "degan", "deyiladi", "deganidek", "shiori"))
ABBREVIATIONS = frozenset(("aj", "mchj", "prof", "dr", "kv"))
LETTER_PAIRS = frozenset(("sh", "ch", "o'", "g'"))
SUFFIXES = frozenset(("ning", "ni", "ga", "da", "dan"))
DOMAINS = frozenset(("uz", "ru", "com", "net", "org", "day", "az", "info"))
ORDINALS = r"(?:bir\s+minginchi|besh\s+yuzinchi|birinchi|beshinchi|o'ninchi|yuzinchi)"
REVIEW = ("LOWERCASE_AFTER_TERMINAL", "NO_TERMINAL_PUNCTUATION", "VERY_LONG_SEGMENT", "SHORT_TOKEN_BEFORE_PERIOD", "SUSPICIOUS_ORDINAL_PERIOD_PROTECTED", "ROMAN_EXPANSION_INITIAL_PROTECTED", "LOWERCASE_AFTER_STRONG_PUNCTUATION_PROTECTED")

_END = re.compile(rf"[{re.escape(TERMINALS)}]+")
_CLOSE = re.compile(rf"[{re.escape(CLOSERS)}]*")
_WORD = r"[A-Za-zÀ-ÖØ-öø-ÿʻʼ‘’']+"
_NEXT = re.compile(rf"[{re.escape(CLOSERS)}]*\s*({_WORD})")
_LETTER = re.compile(_WORD[:-1])
_ORDINAL_TAIL = re.compile(ORDINALS + r"\Z", re.I)
_INITIAL_ORDINAL = re.compile(rf"(?:^|\s)(?:[A-Z]|Sh|SH|Ch|CH|O['ʻʼ‘’]|G['ʻʼ‘’])\.\s+(?-i:{ORDINALS})\Z")


def _protecting(text: str, at: int, stop: int, after_quotes: int) -> tuple[str, ...]:
    """Flags of the first rule that keeps text[at:stop] from ending a sentence; none if it ends one."""
    first = at
    while first and _LETTER.match(text, first - 1):
        first -= 1
    before = text[first:at]
    # all ordinal phrases end alike, so most ends need no look at more
    near = text[max(0, at - 200) : at] if before.lower().endswith("inchi") else ""
    # a run of several dots has no next word here: the rules look right behind its first mark
    follows = _NEXT.match(text, at + 1)
    following = follows.group(1) if follows else ""
    if text[at] == ".":
        initial = len(before) == 1 and before.isupper() or before.lower() in LETTER_PAIRS and before[0].isupper()
        if initial and following:
            return ("INITIAL_BOUNDARY_PROTECTED", "SHORT_TOKEN_BEFORE_PERIOD")
        if len(before) >= 2 and following.lower() in DOMAINS:
            return ("DOTTED_NAME_OR_DOMAIN_PROTECTED",)
        if before.lower() in ABBREVIATIONS:
            return ("ABBREVIATION_BOUNDARY_PROTECTED",)
        if following[:1].islower() and _INITIAL_ORDINAL.search(near):
            return ("ROMAN_EXPANSION_INITIAL_PROTECTED", "SUSPICIOUS_ORDINAL_PERIOD_PROTECTED")
        if following and _ORDINAL_TAIL.search(near) and (following.lower() in SUFFIXES or following.isupper()):
            return ("SUSPICIOUS_ORDINAL_PERIOD_PROTECTED",)
    beyond = _NEXT.match(text, after_quotes)
    if beyond and beyond.group(1).lower() in SPEECH:
        return ("QUOTE_OR_SPEECH_CONTINUATION",)
    if text[at] in "?!" and _next_character(text, after_quotes).islower():
        return ("LOWERCASE_AFTER_TERMINAL", "LOWERCASE_AFTER_STRONG_PUNCTUATION_PROTECTED")
    return ()


def _next_character(text: str, at: int) -> str:
    while at < len(text) and (text[at].isspace() or text[at] in CLOSERS):
        at += 1
    return text[at : at + 1]


def scan(text: str) -> list[tuple[int, int, str, str, list[str]]]:
    """(start, end, closing marks, method, flags) of the sentences of a text."""
    out: list[tuple[int, int, str, str, list[str]]] = []
    start, pending, at = 0, set(), 0

    def emit(stop: int, marks: str, method: str, extra: set[str]) -> None:
        piece = text[start:stop]
        a = start + len(piece) - len(piece.lstrip())
        b = start + len(piece.rstrip())
        if a < b:
            named = pending | extra | ({"VERY_LONG_SEGMENT"} if b - a >= LONG else set())
            out.append((a, b, marks, method, sorted(named)))

    while m := _END.search(text, at):
        quotes = _CLOSE.match(text, m.end()).end()
        kept = _protecting(text, m.start(), m.end(), quotes)
        at = quotes
        if kept:
            pending |= set(kept)
            continue
        low = {"LOWERCASE_AFTER_TERMINAL"} if _next_character(text, quotes).islower() else set()
        emit(quotes, m.group(), "RULE_TERMINAL_PUNCTUATION", low)
        start, pending = quotes, set()
    if start < len(text):
        emit(len(text), "", "TRAILING_FRAGMENT", {"NO_TERMINAL_PUNCTUATION"})
    return out


_SPANS = "source_record_id bigint, normalized_text string, parent_review_flags array<string>, spans array<struct<start:int,stop:int,marks:string,method:string,flags:array<string>>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("marks", pa.string()), ("method", pa.string()), ("flags", pa.list_(pa.string()))]))


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [[dict(zip(("start", "stop", "marks", "method", "flags"), s)) for s in scan(t)] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(spans, _SPAN_TYPE)], ["source_record_id", "normalized_text", "parent_review_flags", "spans"])


def segment(df: DataFrame, id_col: str, text_col: str, flags_col: str | None = None) -> DataFrame:
    """Sentence records of all texts: id, index, offsets, text, marks, method, flags, lineage."""
    parent = F.col(flags_col) if flags_col else F.array().cast("array<string>")
    rows = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("source_record_id"), F.col(text_col).alias("normalized_text"), parent.alias("parent_review_flags"))
    spans = rows.mapInArrow(_scan_batches, _SPANS).select("source_record_id", F.sha2("normalized_text", 256).alias("parent_normalized_text_sha256"), "normalized_text", "parent_review_flags", F.posexplode("spans").alias("sentence_index_in_record", "s"))
    text = F.substring("normalized_text", F.col("s.start") + 1, F.col("s.stop") - F.col("s.start"))
    named = spans.withColumn("sentence_text", text)
    return named.select(
        F.lit(VERSION).alias("schema_version"), sentence_id(*map(F.col, ("source_record_id", "sentence_index_in_record", "s.start", "s.stop", "sentence_text"))).alias("sentence_id"), "source_record_id", "sentence_index_in_record",
        "parent_normalized_text_sha256", "sentence_text", F.col("s.start").alias("sentence_start_char"), F.col("s.stop").alias("sentence_end_char"), F.length("sentence_text").alias("sentence_character_count"),
        F.regexp_count("sentence_text", F.lit(r"(?U)\S+")).alias("sentence_token_count"), F.col("s.marks").alias("terminal_punctuation"), F.col("s.method").alias("segmentation_method"), F.col("s.flags").alias("boundary_flags"),
        F.arrays_overlap("s.flags", F.array(*map(F.lit, REVIEW))).alias("segmentation_review_required"), "parent_review_flags",
    )


def sentence_id(record: Column, index: Column, start: Column, stop: Column, text: Column) -> Column:
    """Stable as long as record, index, offsets, text and version are."""
    digest = F.sha2(F.concat_ws("\n", F.lit(VERSION), *(c.cast("string") for c in (record, index, start, stop)), text), 256)
    return F.format_string("s3v1-%d-%04d-%s", record, index, F.left(digest, F.lit(16)))


def verify(sentences: DataFrame, parents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(problem, failing): sequence of indexes, offsets, overlap, reconstruction, counts, parent's hash, ids, and texts with characters that no sentence covers.

    The sentences of a text are put side by side in order and compared with it once, so the text is not copied to each of them. An id names its
    record, so ids are unique if none repeats within a record and none names another.
    """
    c = F.col
    texts = parents.where(c(text_col).isNotNull()).select(c(id_col).cast("bigint").alias("source_record_id"), c(text_col).alias("parent_text"))
    fields = F.struct(c("sentence_index_in_record").alias("i"), c("sentence_start_char").alias("a"), c("sentence_end_char").alias("b"), c("sentence_text").alias("t"), c("sentence_character_count").alias("n"), c("parent_normalized_text_sha256").alias("h"), c("sentence_id").alias("id"))
    together = sentences.groupBy("source_record_id").agg(F.array_sort(F.collect_list(fields)).alias("s"))
    rows = texts.join(together, "source_record_id", "left").withColumn("s", F.coalesce("s", F.array().cast(together.schema["s"].dataType))).withColumn("size", F.length("parent_text")).withColumn("sha", F.sha2("parent_text", 256))
    many = lambda f: F.size(F.filter("s", f))
    prefix = F.concat(F.lit("s3v1-"), c("source_record_id").cast("string"), F.lit("-"))
    solid = lambda t: F.length(F.regexp_replace(t, r"(?U)\s", ""))
    checks = {
        "index_sequence": many(lambda x, k: x["i"] != k),
        "offset_range": many(lambda x: (x["a"] < 0) | (x["b"] > c("size")) | (x["a"] >= x["b"])),
        "overlap": many(lambda x, k: (k > 0) & (F.get("s", k - 1)["b"] > x["a"])),
        "reconstruction": many(lambda x: (x["a"] < 0) | (F.substring(c("parent_text"), x["a"] + 1, x["b"] - x["a"]) != x["t"])),
        "character_count": many(lambda x: x["n"] != F.length(x["t"])),
        "parent_hash": many(lambda x: x["h"] != c("sha")),
        "duplicate_id": F.size("s") - F.size(F.array_distinct(F.transform("s", lambda x: x["id"]))) + many(lambda x: ~x["id"].startswith(prefix)),
        "uncovered_text": (F.aggregate("s", F.lit(0), lambda n, x: n + solid(x["t"])) != solid(c("parent_text"))).cast("int"),
    }
    return rows.agg(*(F.coalesce(F.sum(x), F.lit(0)).cast("bigint").alias(k) for k, x in checks.items())).unpivot([], list(checks), "problem", "failing")


def inventory(sentences: DataFrame) -> DataFrame:
    """(kind, name, sentences): counts by method and flag, and of reviews."""
    kinds = F.concat(F.array(F.struct(F.lit("method").alias("kind"), F.col("segmentation_method").alias("name"))), F.transform("boundary_flags", lambda x: F.struct(F.lit("flag").alias("kind"), x.alias("name"))), F.when(F.col("segmentation_review_required"), F.array(F.struct(F.lit("review").alias("kind"), F.lit("REQUIRED").alias("name")))).otherwise(F.array()))
    return sentences.select(F.explode_outer(kinds).alias("k")).groupBy("k.kind", "k.name").agg(F.count("*").alias("sentences"))


def inner_boundaries(sentences: DataFrame) -> DataFrame:
    """(source_record_id, boundary): ends of all sentences of a record but the last."""
    inside = Window.partitionBy("source_record_id").orderBy(F.desc("sentence_index_in_record"))
    return sentences.withColumn("r", F.row_number().over(inside)).where("r > 1").select("source_record_id", F.col("sentence_end_char").alias("boundary"))


def inventory_diff(old: DataFrame, new: DataFrame, approved: tuple[str, ...] = ("QUOTE_OR_SPEECH_CONTINUATION", "INITIAL_BOUNDARY_PROTECTED", "DOTTED_NAME_OR_DOMAIN_PROTECTED", "ABBREVIATION_BOUNDARY_PROTECTED", "ROMAN_EXPANSION_INITIAL_PROTECTED", "SUSPICIOUS_ORDINAL_PERIOD_PROTECTED", "LOWERCASE_AFTER_STRONG_PUNCTUATION_PROTECTED")) -> DataFrame:
    """Boundaries that one inventory has and the other has not; of removed ones, the merged sentence and whether its flags explain it."""
    a, b = inner_boundaries(old), inner_boundaries(new)
    removed, added = a.join(b, ["source_record_id", "boundary"], "left_anti").withColumn("change", F.lit("REMOVED")), b.join(a, ["source_record_id", "boundary"], "left_anti").withColumn("change", F.lit("ADDED"))
    spans = new.select(F.col("source_record_id").alias("rec"), "sentence_text", "boundary_flags", "sentence_start_char", "sentence_end_char")
    # a boundary lies in one sentence of its own record: an equality join, then a range within the record
    merged = removed.join(spans, (F.col("rec") == F.col("source_record_id")) & (F.col("boundary") > F.col("sentence_start_char")) & (F.col("boundary") < F.col("sentence_end_char")), "left")
    told = merged.select("source_record_id", "boundary", "change", F.col("sentence_text").alias("merged_sentence"), F.coalesce(F.arrays_overlap("boundary_flags", F.array(*map(F.lit, approved))), F.lit(False)).alias("explained"))
    return told.unionByName(added.select("source_record_id", "boundary", "change", F.lit(None).cast("string").alias("merged_sentence"), F.lit(True).alias("explained")))
