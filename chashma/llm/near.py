"""Groups of texts that share most of their words but differ by small edits, insertions or reordering.

The fingerprint of a text is its signature of `SLOTS` minima of hashes over its distinct words, cut into
`SLOTS / WIDTH` blocks, and one bit of each slot. Two texts that differ in fewer slots than there are
blocks have an equal block (pigeonhole); texts with a shared share of words `s` differ in about
`SLOTS * (1 - s)` slots, so at the threshold of 3/4 the guarantee is replaced by a chance of
`1 - (1 - s**WIDTH)**blocks`, which is 0.9999. Blocks are joined, the Hamming distance of the bits drops pairs
far from the threshold (five standard deviations), and the words of the rest are compared exactly.

Texts with equal word sets are one class before anything is joined, so copies never meet pair by pair
in a block. A block value shared by very many classes is a skewed join key, which AQE splits.

Words: as defined in TESTDATA.md; a word is compared by 64 bits of a hash. Defined cases: null texts and texts
below `least_words` distinct words are in no pair; rows delivered twice count once (of different texts
under one key the smallest print counts); empty tables give no rows; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chashma.plans.lineage import released, staged

WIDTH, BLOCKS = 6, 48
SLOTS = WIDTH * BLOCKS
LONGS = (SLOTS + 63) // 64
THRESHOLD = 0.75
LEAST_WORDS = 15
_FIND = regex.compile(r"[\p{L}\p{N}]+")
MARKS = "'`´‘’ʻʼ"


def words_of(text: str | None) -> set[str]:
    """Distinct words; a replacement for each mark is several times faster than one translation of all."""
    if not text:
        return set()
    text = text.lower()
    for mark in MARKS:
        text = text.replace(mark, "")
    return set(_FIND.findall(text))


def _constants() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    # 32 bits are enough for minima of a text's words, and numpy multiplies them several times faster than 64
    return rng.integers(0, 2**31, SLOTS, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, SLOTS, dtype=np.uint32)


def _word_sets(least_words: int):
    """Texts as their distinct words, each as 64 bits of a hash, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import xxhash

        digest = xxhash.xxh3_64_intdigest
        known: dict[str, int] = {}
        for batch in batches:
            at, sets, prints, rows = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                words = words_of(text)
                if len(words) < least_words:
                    continue
                if len(known) > 500_000:
                    known.clear()
                codes = [*map(known.get, words)]
                if None in codes:
                    for w in words:
                        if w not in known:
                            known[w] = digest(w)
                    codes = [*map(known.__getitem__, words)]
                codes = np.sort(np.array(codes, np.uint64))
                at.append(i)
                sets.append(codes)
                prints.append(hashlib.md5(codes.tobytes()).digest())
                rows.append(hashlib.md5(text.encode("utf-8", "surrogatepass")).digest())
            if not at:
                continue
            index, ends = pa.array(at), np.cumsum([len(x) for x in sets])
            words = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("table_name").take(index), batch.column("key").take(index), pa.array(prints, pa.binary()), pa.array(rows, pa.binary()), words], ["table_name", "key", "class", "row_print", "words"])

    return run


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks and bits of word sets."""
    import xxhash

    a, b = _constants()
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column("words")
        flat = (lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(32)).astype(np.uint32)
        lens = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        starts, order, lo = np.cumsum(lens) - lens, np.argsort(lens, kind="stable"), 0
        slots = np.empty((len(lens), SLOTS), np.uint32)
        # texts of like size side by side, short ones filled up with their own words, so that all steps run over whole columns
        while lo < len(order):
            longest = int(lens[order[min(lo + 255, len(order) - 1)]])
            some = order[lo : lo + max(1, min(256, (1 << 20) // longest))]
            lo += len(some)
            words = flat[starts[some] + np.arange(int(lens[some].max()))[:, None] % lens[some]]
            h = np.empty_like(words)
            for k in range(SLOTS):
                np.multiply(words, a[k], out=h)
                np.bitwise_xor(h, b[k], out=h)
                slots[some, k] = h.min(axis=0)
        low = slots.astype(np.uint64)
        # rows of different tables share no block
        own = np.array([xxhash.xxh3_64_intdigest(t or "") for t in batch.column("table_name").to_pylist()], np.uint64)
        blocks = np.zeros((len(lens), BLOCKS), np.uint64)
        for k in range(BLOCKS):
            h = own + np.uint64(k + 1)
            for j in range(WIDTH):
                h = (h ^ low[:, k * WIDTH + j]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            blocks[:, k] = h >> np.uint64(16)  # 48 bits tell blocks apart and leave two bytes less to move
        raw = np.packbits(((slots >> np.uint32(7)) & np.uint32(1)).astype(np.uint8), axis=1)
        wide = np.zeros((len(lens), LONGS * 8), np.uint8)
        wide[:, : raw.shape[1]] = raw
        fixed = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1]), pa.int32()), pa.array(np.ascontiguousarray(m).reshape(-1).view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("id"), fixed(blocks), fixed(wide.view(np.int64))], ["id", "blocks", "bits"])


def fingerprints(rows: DataFrame, least_words: int = LEAST_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, classes, prints) of rows (table_name, key, text): the class of each key, the words of each class, and its blocks and bits, all staged."""
    good = rows.where("text IS NOT NULL AND key IS NOT NULL").select("table_name", F.col("key").cast("bigint").alias("key"), "text")
    made = staged(good.mapInArrow(_word_sets(least_words), "table_name string, key bigint, class binary, row_print binary, words array<bigint>"), "word-sets")
    members = staged(made.groupBy("table_name", "key").agg(F.min(F.struct("row_print", "class")).alias("m")).select("table_name", "key", "m.class"), "members")
    # an id is fixed by the table it is written to, so fingerprints are made after it
    shown = staged(made.groupBy("table_name", "class").agg(F.first("words").alias("words")).withColumn("id", F.monotonically_increasing_id()), "classes")
    released(made)  # members and classes have all of it
    return members, shown, staged(shown.select("table_name", "id", "words").mapInArrow(_fingerprints, "id bigint, blocks array<bigint>, bits array<bigint>"), "fingerprints")


def similar_classes(classes: DataFrame, prints: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(table_name, id_a, id_b, shared, distinct): pairs of classes whose shared words are at least `threshold` of all their words."""
    entries = prints.select("id", F.explode("blocks").alias("block"))
    a, b = (entries.select(F.col("id").alias(f"id_{x}"), "block") for x in "ab")
    candidates = a.join(b, "block").where("id_a < id_b").select("id_a", "id_b").distinct()
    most = SLOTS * (1 - threshold) / 2
    most += 5 * (SLOTS * (1 - threshold) / 2 * (1 - (1 - threshold) / 2)) ** 0.5
    # most pairs end here, so words move for the others only
    bits = lambda x: prints.select(F.col("id").alias(f"id_{x}"), *(F.col("bits")[k].alias(f"bits_{x}{k}") for k in range(LONGS)))
    apart = sum((F.bit_count(F.col(f"bits_a{k}").bitwiseXOR(F.col(f"bits_b{k}"))) for k in range(1, LONGS)), F.bit_count(F.col("bits_a0").bitwiseXOR(F.col("bits_b0"))))
    near = staged(candidates.join(bits("a"), "id_a").join(bits("b"), "id_b").where(apart <= most).select("id_a", "id_b"), "near")
    words = lambda x: classes.select(*(["table_name"] if x == "a" else []), F.col("id").alias(f"id_{x}"), F.col("words").alias(f"words_{x}"))
    counted = near.join(words("a"), "id_a").join(words("b"), "id_b").withColumn("shared", F.size(F.array_intersect("words_a", "words_b")))
    counted = counted.withColumn("distinct", F.size("words_a") + F.size("words_b") - F.col("shared"))
    return counted.where(F.col("shared") >= F.lit(threshold) * F.col("distinct")).select("table_name", "id_a", "id_b", "shared", "distinct")


def similar_pairs(rows: DataFrame, threshold: float = THRESHOLD, least_words: int = LEAST_WORDS) -> DataFrame:
    """All pairs of rows of one table, key_a < key_b, whose distinct words are alike: pairs of classes and pairs within a class."""
    members, classes, prints = fingerprints(rows, least_words)
    links = staged(similar_classes(classes, prints, threshold), "links")
    named = members.join(classes.select("table_name", "class", "id"), ["table_name", "class"]).select("table_name", "key", "id")
    one, two = (named.select("table_name", F.col("key").alias(f"key_{x}"), F.col("id").alias(f"id_{x}")) for x in "ab")
    across = links.select("id_a", "id_b").join(one, "id_a").join(two.drop("table_name"), "id_b").select("table_name", "key_a", "key_b")
    within = one.join(two.select(F.col("key_b"), F.col("id_b").alias("id_a")), "id_a").where("key_a < key_b").select("table_name", "key_a", "key_b")
    return across.select("table_name", F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b")).unionAll(within)


def groups(rows: DataFrame, threshold: float = THRESHOLD, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row for each key of a text that is like another: its group (the smallest key of its connected texts) and the classes linked to its own.

    Components by rounds of taking the smallest label of the neighbours and then the label's own label;
    each round is a staged table, and rounds end when no label changes.
    """
    members, classes, prints = fingerprints(rows, least_words)
    links = staged(similar_classes(classes, prints, threshold), "links")
    both = staged(links.select("id_a", "id_b").unionAll(links.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"))), "edges")
    labels = staged(both.groupBy("id_a").agg(F.least(F.min("id_b"), F.col("id_a")).alias("label")).withColumnRenamed("id_a", "id"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "id_b"), "id_b").groupBy("id_a").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("id_a", "id"), "id").select("id", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("label").alias("far"))
        moved = staged(step.join(jump, "next", "left").select("id", "label", F.least("next", F.coalesce("far", "next")).alias("next")), "labels")
        changed = moved.where("label != next").limit(1).count()
        labels = moved.select("id", F.col("next").alias("label"))
        if not changed:
            break
    degree = both.groupBy("id_a").agg(F.count("*").alias("links")).withColumnRenamed("id_a", "id")
    named = members.join(classes.select("table_name", "class", "id"), ["table_name", "class"]).select("table_name", "key", "id")
    sizes = named.groupBy("id").agg(F.count("*").alias("n"), F.min("key").alias("low"))
    told = sizes.join(labels, "id", "left").join(degree, "id", "left").where("n > 1 OR label IS NOT NULL").select("id", F.coalesce("label", "id").alias("label"), "low", "n", F.coalesce("links", F.lit(0)).alias("links"))
    told = staged(told, "told")
    heads = told.groupBy("label").agg(F.min("low").alias("group_key"), F.sum("n").alias("group_rows"))
    return named.join(told.join(heads, "label").select("id", "group_key", "group_rows", "links"), "id").select("table_name", "key", "group_key", "group_rows", "links")
