"""Records that are the same but for formatting: blanks, letter case, punctuation or the order of fields.

Plan (dictionary encoding): a record is its whole text and, if it is a record card, its `name: value` fields.
Each distinct value is canonicalised once in a dictionary, whose key is a 128-bit print of the value: values are moved once for
their dictionary entry, and everything else moves prints and ids. Distinct canonical values
get integer ids, and records become sorted tuples of ids, which are grouped instead of texts. Groups are
counted with partial aggregates and members find their group by a join on ids, which AQE splits where
it is skewed; no group is collected.

Two records are copies if their whole texts have one id, or if both are cards and have the same fields
in any order; classes are closed under both (an iteration over distinct ids with pointer jumping, which ends after one round
unless one text can be read as several cards).

Defined cases: null texts and null keys are left out; texts without letters and digits are all equal;
rows delivered twice count once (of different texts under one key the smallest print counts); a null
occurrence count counts as 0; repeated fields count as often as they stand; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chashma.plans.lineage import staged

SEPARATORS = r"[;|\n\r\x0B\x0C\x{85}\x{2028}\x{2029}]"
_BLANK = r"[\s\p{Z}]"
FIELD = rf"(?s)^{_BLANK}*[^:\s\p{{Z}}][^:]*:.*[^\s\p{{Z}}]"


def canonical(value: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]", "")


def card_fields(text: Column) -> Column:
    """The parts of a record card, else null. Each part has the form `name: value`; there are at least two."""
    parts = F.filter(F.split(text, SEPARATORS), lambda p: F.length(F.regexp_replace(p, _BLANK, "")) > 0)
    return F.when((F.size(parts) > 1) & F.forall(parts, lambda p: p.rlike(FIELD)), parts)


def _print(canon: Column) -> Column:
    return F.unhex(F.md5(canon))


def _canon_field(raw: Column) -> Column:
    """Name and value are reduced apart and stay apart."""
    at = F.instr(raw, ":")
    return F.concat(canonical(F.substring(raw, F.lit(1), at)), F.lit(":"), canonical(F.substring(raw, at + 1, F.length(raw))))


def encode_records(rows: DataFrame) -> DataFrame:
    """Of rows (table_name, key, text, occurrences): (table_name, key, occurrences, whole, fields), with ids for values; staged."""
    good = rows.where("text IS NOT NULL AND key IS NOT NULL")
    whole = F.struct(F.lit(-1).alias("no"), F.col("text").alias("raw"))
    fields = F.transform(F.coalesce(card_fields(F.col("text")), F.array().cast("array<string>")), lambda p, i: F.struct(i.alias("no"), p.alias("raw")))
    parts = good.select("table_name", "key", "occurrences", F.unhex(F.md5("text")).alias("row_print"), F.explode(F.concat(F.array(whole), fields)).alias("part"))
    parts = parts.select("table_name", "key", "occurrences", "row_print", "part.no", (F.col("part.no") < 0).alias("kind"), F.unhex(F.md5("part.raw")).alias("raw_print"), "part.raw")
    # read twice: values for the dictionary, prints for the records
    parts = staged(parts, "parts")
    spelt = parts.groupBy("kind", "raw_print").agg(F.any_value("raw").alias("raw"))
    spelt = staged(spelt.select("kind", "raw_print", _print(F.when(F.col("kind"), canonical(F.col("raw"))).otherwise(_canon_field(F.col("raw")))).alias("value")), "spellings")
    # an id is fixed once it is written; it would change if the numbering ran again
    ids = staged(spelt.select("kind", "value").distinct().withColumn("id", F.monotonically_increasing_id()), "values")
    coded = parts.drop("raw").join(spelt.join(ids, ["kind", "value"]).select("kind", "raw_print", "id"), ["kind", "raw_print"])
    columns = ["table_name", "key", "occurrences", "row_print", "no", "id"]
    once = coded.select(columns).repartition("table_name", "key").groupBy("table_name", "key", "row_print").agg(F.max("occurrences").alias("occurrences"), F.max(F.when(F.col("no") < 0, F.col("id"))).alias("whole"), F.collect_set(F.when(F.col("no") >= 0, F.struct("no", "id"))).alias("set"))
    record = F.min(F.struct("row_print", "occurrences", "whole", F.array_sort(F.transform("set", lambda x: x["id"])).alias("fields"))).alias("r")
    return staged(once.groupBy("table_name", "key").agg(record).select("table_name", "key", "r.occurrences", "r.whole", "r.fields"), "records")


def _linked(records: DataFrame) -> DataFrame:
    """(table_name, whole, class): texts that cards with equal fields put into one class, with the smallest id as its name.

    A round gives each text the smallest class of its cards, then that class' own class, so the rounds grow with the logarithm of the longest chain.
    """
    cards = records.where(F.size("fields") > 1).select("table_name", "fields", "whole").distinct()
    shared = cards.groupBy("table_name", "fields").agg(F.min("whole").alias("low"), F.max("whole").alias("high")).where("low < high").select("table_name", "fields")
    edges = staged(cards.join(shared, ["table_name", "fields"], "left_semi"), "card-edges")
    labels = edges.select("table_name", "whole").distinct().withColumn("class", F.col("whole"))
    while True:
        low = edges.join(labels, ["table_name", "whole"]).groupBy("table_name", "fields").agg(F.min("class").alias("class"))
        nearer = edges.join(low, ["table_name", "fields"]).groupBy("table_name", "whole").agg(F.min("class").alias("class"), F.count("*").alias("readings"))
        nearer = staged(nearer, "card-classes")
        # a text read as one card only is settled after one round; so are all, if there is no other
        if not nearer.where("readings > 1").limit(1).count():
            return nearer.select("table_name", "whole", "class")
        jump = nearer.select("table_name", F.col("whole").alias("class"), F.col("class").alias("further"))
        moved = staged(nearer.join(jump, ["table_name", "class"]).select("table_name", "whole", F.least("class", "further").alias("class")), "card-classes")
        changed = moved.join(labels.withColumnRenamed("class", "old"), ["table_name", "whole"]).where("class != old").limit(1).count()
        labels = moved
        if not changed:
            return labels


def copy_classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, class of each text): classes have one row with the smallest key, the records and the summed occurrences."""
    by_text = records.groupBy("table_name", "whole").agg(F.min("key").alias("low"), F.count("*").alias("n"), F.sum(F.coalesce("occurrences", F.lit(0))).alias("sum"))
    named = by_text.join(_linked(records), ["table_name", "whole"], "left").withColumn("class", F.coalesce("class", "whole"))
    named = staged(named, "classes")
    classes = named.groupBy("table_name", "class").agg(F.min("low").alias("key"), F.sum("n").alias("records"), F.sum("sum").alias("occurrence_count"))
    return classes, named.select("table_name", "whole", "class")


def collapse(rows: DataFrame) -> DataFrame:
    """One row for each class of copies: its smallest key, how many records it has and their occurrences."""
    classes, _ = copy_classes(encode_records(rows))
    return classes.select("table_name", "key", "records", "occurrence_count")


def copies(rows: DataFrame) -> DataFrame:
    """One row for each copy: key_a the smallest key of its class, key_b its own."""
    records = encode_records(rows)
    classes, named = copy_classes(records)
    several = classes.where("records > 1").select("table_name", "class", F.col("key").alias("key_a"))
    texts = named.join(several, ["table_name", "class"]).select("table_name", "whole", "key_a")
    return records.select("table_name", "whole", F.col("key").alias("key_b")).join(texts, ["table_name", "whole"]).where("key_a != key_b").select("table_name", "key_a", "key_b")
