"""One form for texts that look the same, made by DuckDB inside Arrow partitions.

Each Arrow batch is a relation for an embedded SQL expression, which gives two forms of a text:
`form` has compatibility forms, invisible characters, unusual blanks, apostrophe-like marks and hyphens
mapped and letters composed (NFC); `skeleton` also folds look-alike letters of other scripts into the
Latin ones, with their accents, so that two texts look the same exactly if their skeletons are equal. Letter case,
ordinary blanks, other punctuation and accents stay as they are, and so do compatibility characters that do not look like
what they stand for: superscripts, subscripts, circled signs, fractions, leaders of dots, spacing accents and the long s.

Defined cases: null gives null in both forms and never pairs; an empty text is itself; rows delivered
twice count once; rows without a key are left out of the pairs.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chashma.plans.lineage import staged

# What looks the same. Each string is mapped to the one before the colon.
FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
ASCII = "".join(chr(c) for c in range(0x21, 0x7F))
BLANKS = "               　"
APOSTROPHES = "`´‘’‛ʹʻʼʽʾʿˈˊˋ′‵ꞌ"
HYPHENS = "‐‑‒−﹣⁃˗"
INVISIBLE = r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}]"
#: Kinds of compatibility characters that look like what they stand for.
ALIKE_KINDS = ("wide", "narrow", "font", "noBreak", "square", "small", "compat", "initial", "medial", "final", "isolated", "vertical")
#: Compatibility characters that do not: leaders of dots and the long s.
UNALIKE = "\u2024\u2025\u2026ſẛ"
#: Letters of other scripts: the Latin letter, a colon, those that look like it.
LOOK_ALIKES = (
    "A:АΑᎪ a:аα B:ВΒᏴ C:СϹᏟ c:сϲ D:Ꭰ d:ԁ E:ЕΕᎬ e:е F:Ϝ G:Ԍ g:ɡ H:НΗᎻ h:һ I:ІΙӀ i:іιι J:ЈᎫ j:јϳ "
    "K:КΚK k:κ L:Ꮮ l:ӏ M:МΜᎷ N:Ν n:ո O:ОΟՕ o:оοօ P:РΡᏢ p:рρ Q:Ԛ q:ԛ S:ЅՏ s:ѕ T:ТΤᎢ U:Ս u:ս V:Ѵ v:ѵν W:Ԝ w:ԝ "
    "X:ХΧ x:хχ Y:УΥ y:у Z:ΖᏃ Ё:Ë ё:ë Ї:Ï ї:ï"
)


def compatibility() -> dict[str, str]:
    """What Unicode's compatibility characters of the alike kinds stand for; those that have a rule of their own above are left out."""
    known = set(FULL_WIDTH + BLANKS + APOSTROPHES + HYPHENS + UNALIKE)
    out = {}
    for c in map(chr, (*range(0xA0, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1EE00, 0x1EF00))):
        kind, _, _ = unicodedata.decomposition(c).partition(">")
        to = unicodedata.normalize("NFKC", c)
        if kind.startswith("<") and kind[1:] in ALIKE_KINDS and c not in known and to != c and not (len(to) > 1 and to[0] == " "):
            out[c] = to
    return out


def _pairs(told: str) -> tuple[str, str, dict[str, str]]:
    """Letters of other scripts, alone and with accents, the Latin ones they look like, and those for which Latin has no single letter."""
    alone: dict[str, str] = {}
    for entry in told.split():
        to, _, alike = entry.partition(":")
        if to not in "ЁёЇї":  # these follow from their base letters
            for c in alike:
                alone.setdefault(c, to)
    single, several = dict(alone), {}
    for c in map(chr, range(0x370, 0x530)):
        base, *marks = unicodedata.normalize("NFD", c)
        if marks and base in alone:
            to = unicodedata.normalize("NFC", alone[base] + "".join(marks))
            (single if len(to) == 1 else several)[c] = to
    return "".join(single), "".join(single.values()), several


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _where(column: str, chars: str, sql: str) -> str:
    """`sql` for texts that have one of the characters, others as they are: `translate` sets up its table for each row it is called on."""
    return f"CASE WHEN regexp_matches({column}, {_quoted('[' + _ranges(chars) + ']')}) THEN {sql} ELSE {column} END"


def plain_sql(column: str = "text") -> str:
    """SQL for full-width forms, invisible characters, blanks, apostrophes and hyphens."""
    source = FULL_WIDTH + BLANKS + APOSTROPHES + HYPHENS
    target = ASCII + " " * len(BLANKS) + "'" * len(APOSTROPHES) + "-" * len(HYPHENS)
    # a full-width grave accent becomes an ordinary one first
    sql = _where(column, source, f"translate(translate({column}, {_quoted(source)}, {_quoted(target)}), '`', {_quoted(chr(39))})")
    return f"regexp_replace({sql}, {_quoted(INVISIBLE)}, '', 'g')"


def has_compatibility(column: str = "text") -> str:
    """SQL for whether a text has a character of the compatibility table; the plain steps neither make nor change any."""
    return f"regexp_matches({column}, {_quoted('[' + _ranges(compatibility()) + ']')})"


def composed_sql(column: str = "plain") -> str:
    """SQL for the compatibility table, through which only the few texts go that have one of its characters, and composition."""
    table = compatibility()
    entries = ", ".join(f"{_quoted(c)}: {_quoted(to)}" for c, to in table.items())
    spelt = f"array_to_string(list_transform(regexp_extract_all({column}, '(?s).'), lambda c: coalesce(map_extract_value(MAP {{{entries}}}, c), c)), '')"
    return f"nfc_normalize(CASE WHEN {has_compatibility(column)} THEN {spelt} ELSE {column} END)"


def _ranges(chars) -> str:
    """A character class."""
    out: list[list[int]] = []
    for o in sorted(map(ord, chars)):
        if out and out[-1][1] == o - 1:
            out[-1][1] = o
        else:
            out.append([o, o])
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in out)


def skeleton_sql(column: str = "form") -> str:
    """SQL for the form with look-alike letters folded, and accents composed with the Latin letters."""
    source, target, several = _pairs(LOOK_ALIKES)
    sql = f"translate({column}, {_quoted(source)}, {_quoted(target)})"
    for c, to in several.items():
        sql = f"replace({sql}, {_quoted(c)}, {_quoted(to)})"
    return _where(column, source + "".join(several), f"nfc_normalize({sql})")


def forms_of(rows: str) -> str:
    """A relation with `form` and `skeleton` of the column `text` of a relation."""
    return f"(SELECT *, {skeleton_sql()} AS skeleton FROM (SELECT *, {composed_sql()} AS form FROM (SELECT *, {plain_sql()} AS plain FROM {rows})))"


def _run(sql: str, names: list[str], casts: dict[str, pa.DataType]):
    """`sql` over each batch. Its table of compatibility characters is large, so a batch without any such character goes by the same expression without it."""
    asked, table, bare = f"SELECT count(*) FROM batch WHERE {has_compatibility()}", composed_sql(), "nfc_normalize(plain)"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect()
        con.execute("SET threads = 1")
        for batch in batches:
            if batch.num_rows == 0:
                continue
            con.register("batch", pa.Table.from_batches([batch]))
            out = con.sql(sql if con.sql(asked).fetchall()[0][0] else sql.replace(table, bare)).to_arrow_table()
            con.unregister("batch")
            yield from out.select(names).cast(pa.schema([(n, casts[n]) for n in names])).combine_chunks().to_batches()

    return run


def with_forms(df: DataFrame, key: Column, text: Column, *beside: str) -> DataFrame:
    """(key, text, form, skeleton) of each row, and the string columns named in `beside`."""
    held = ", ".join(["key", "text", *beside])
    sql = f"SELECT {held}, form, skeleton FROM {forms_of('batch')}"
    names = ["key", "text", "form", "skeleton", *beside]
    rows = df.select(key.cast("string").alias("key"), text.alias("text"), *beside)
    return rows.mapInArrow(_run(sql, names, dict.fromkeys(names, pa.string())), ", ".join(f"{n} string" for n in names))


def _prints(df: DataFrame) -> DataFrame:
    """(table_name, key, looks, text_print): 128-bit prints of skeleton and text, so that no text is shuffled."""
    sql = f"SELECT table_name, key, unhex(md5(skeleton)) AS looks, unhex(md5(text)) AS text_print FROM {forms_of('(SELECT * FROM batch WHERE text IS NOT NULL AND key IS NOT NULL)')}"
    names = ["table_name", "key", "looks", "text_print"]
    kinds = {"table_name": pa.string(), "key": pa.string(), "looks": pa.binary(), "text_print": pa.binary()}
    return df.select("table_name", "key", "text").mapInArrow(_run(sql, names, kinds), "table_name string, key string, looks binary, text_print binary")


def alike_classes(df: DataFrame) -> DataFrame:
    """Of rows (table_name, key, text): one row (table_name, key, looks, text_print) for each row that has a different text of the same look.

    Counting goes through partial aggregates, so a look shared by a third of all rows is no hot group.
    """
    prints = staged(_prints(df), "looks")
    several = prints.groupBy("table_name", "looks").agg(F.min("text_print").alias("a"), F.max("text_print").alias("b")).where("a != b").select("table_name", "looks")
    return prints.join(several, ["table_name", "looks"], "left_semi").dropDuplicates(["table_name", "looks", "text_print", "key"])


def alike_pairs(df: DataFrame) -> DataFrame:
    """All pairs of rows of one table with different texts of one look, key_a < key_b as strings."""
    rows = staged(alike_classes(df), "alike")
    a = rows.select("table_name", "looks", F.col("key").alias("key_a"), F.col("text_print").alias("print_a"))
    b = rows.select("table_name", "looks", F.col("key").alias("key_b"), F.col("text_print").alias("print_b"))
    pairs = a.join(b, ["table_name", "looks"]).where("key_a < key_b AND print_a != print_b")
    return pairs.select("table_name", "key_a", "key_b").distinct()


def classes(df: DataFrame) -> DataFrame:
    """One row for each row that has a different text of its look: the smallest key of its class, and how many rows and different texts the class has."""
    rows = staged(alike_classes(df), "alike")
    told = rows.groupBy("table_name", "looks").agg(F.min("key").alias("class_key"), F.count_distinct("key").alias("class_rows"), F.count_distinct("text_print").alias("class_texts"))
    return rows.select("table_name", "looks", "key").distinct().join(told, ["table_name", "looks"]).select("table_name", "key", "class_key", "class_rows", "class_texts")
