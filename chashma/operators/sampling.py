"""Deterministic samples, allocations, weights, batches and top-k. Random order is the order of a SHA-256 of seed and key, the same everywhere.

A category may hold much of the data, so none is ranked whole: the order is uniform, so `lowest` counts the rows of each
category by the first characters of their hash and keeps those up to the one that holds the last wanted row; what is ranked
after that is little more than what is wanted. Where rows are ranked by a value of their own, the rank is compared with a
constant directly above the window, so that each task passes on only that many rows of a category.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(seed: str, *keys: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(seed), *(k.cast("string") for k in keys)), 256)


def extremes(df: DataFrame, length: Column, id_col: str, k: int) -> DataFrame:
    """The k shortest and k longest rows, ties by id: two distributed top-k selections."""
    rows = df.select(F.col(id_col).alias("id"), length.alias("length")).where("length IS NOT NULL")
    return rows.orderBy("length", "id").limit(k).withColumn("side", F.lit("SHORTEST")).unionAll(rows.orderBy(F.desc("length"), "id").limit(k).withColumn("side", F.lit("LONGEST")))


def lowest_per_category(df: DataFrame, category: Column, id_col: str, k: int, seed: str = "42", salts: int = 64) -> DataFrame:
    """k rows of each category, those with the lowest hashes of seed, category and id. Two steps, so that a hot category is ranked in `salts` pieces first."""
    scored = df.select(category.alias("category"), F.col(id_col).alias("id")).where("category IS NOT NULL").withColumn("score", hash_order(seed, F.col("category"), F.col("id")))
    piece = Window.partitionBy("category", "salt").orderBy("score", "id")
    some = scored.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts))).withColumn("r", F.row_number().over(piece)).where(F.col("r") <= k).drop("r", "salt")
    return some.withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy("score", "id"))).where(F.col("place") <= k)


def first_per_category(df: DataFrame, category: Column, id_col: str, k: int, salts: int = 64) -> DataFrame:
    """The k lowest ids of each category."""
    rows = df.select(category.alias("category"), F.col(id_col).alias("id")).where("category IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    some = rows.withColumn("r", F.row_number().over(Window.partitionBy("category", "salt").orderBy("id"))).where(F.col("r") <= k).drop("r", "salt")
    return some.withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy("id"))).where(F.col("place") <= k)


def simple_sample(df: DataFrame, id_col: str, k: int, seed: str = "42") -> DataFrame:
    """k rows in hash order, as a reservoir would keep them."""
    return df.withColumn("score", hash_order(seed, F.col(id_col))).orderBy("score", id_col).limit(k)


def allocate(strata: DataFrame, name: str, size: str, total: int, least: int = 0) -> DataFrame:
    """Largest remainder: integer quotas in proportion to sizes that sum to `total`, ties by name; `least` for each stratum, given back by the smallest remainders. One row per stratum."""
    every = Window.partitionBy(F.lit(0))
    c = F.col
    rows = strata.withColumn("all", F.sum(size).over(every)).withColumn("base", F.floor(c(size) * total / c("all")).cast("bigint")).withColumn("rest", (c(size) * total) % c("all"))
    rows = rows.withColumn("left", F.lit(total) - F.sum("base").over(every)).withColumn("place", F.row_number().over(every.orderBy(F.desc("rest"), F.asc(name))))
    rows = rows.withColumn("quota", c("base") + F.when(c("place") <= c("left"), 1).otherwise(0))
    if least:
        rows = rows.withColumn("floored", F.greatest(F.lit(least), "quota")).withColumn("over", F.sum("floored").over(every) - F.lit(total))
        # units above the floor are given back in rounds, smallest remainders first; there are no more units than the sample has rows
        units = rows.where(c("floored") > least).select(name, "rest", "over", F.explode(F.sequence(F.lit(1), (c("floored") - least).cast("int"))).alias("round"))
        back = units.withColumn("turn", F.row_number().over(every.orderBy("round", "rest", name))).where("turn <= over").groupBy(name).agg(F.count("*").alias("back"))
        rows = rows.join(back, name, "left").withColumn("quota", c("floored") - F.coalesce("back", F.lit(0)))
    return rows.select(name, size, F.col("quota").cast("bigint").alias("quota"), F.round(c(size) * total / c("all"), 6).alias("exact"))


def lowest(df: DataFrame, by: list[str], score: str, most: Column, digits: int = 4) -> DataFrame:
    """The rows among which the `most` lowest hex scores of each category are: all up to the first `digits` characters of the last of them. `most` may use the columns of `by`.

    Counting is a partial aggregate and yields at most `16**digits` rows a category; null categories are a category of their own.
    """
    binned = df.withColumn("_bin", F.left(score, F.lit(digits)))
    counts = binned.groupBy(*by, "_bin").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = counts.withColumn("_before", before).where(F.col("_before") < most).groupBy(*by).agg(F.max("_bin").alias("_last"))
    renamed = edges.select(*(F.col(c).alias(f"_{c}") for c in by), "_last")
    same = F.col("_bin") <= F.col("_last")
    for c in by:
        same = same & binned[c].eqNullSafe(F.col(f"_{c}"))
    return binned.join(renamed, same).select(*df.columns)


def draw(df: DataFrame, id_col: str, stratum: str, quotas: DataFrame, size: str, seed: str = "42") -> DataFrame:
    """`quota` rows of each stratum in hash order, with inclusion probability n / N and weight N / n."""
    scored = df.withColumn("score", hash_order(seed, F.col(stratum), F.col(id_col))).join(quotas.select(stratum, size, "quota"), stratum)
    near = lowest(scored, [stratum, "quota"], "score", F.col("quota"))
    ranked = near.withColumn("part_sample_number", F.row_number().over(Window.partitionBy(stratum).orderBy("score", id_col))).where("part_sample_number <= quota")
    return ranked.withColumn("inclusion_probability", F.round(F.col("quota") / F.col(size), 8)).withColumn("sampling_weight", F.round(F.col(size) / F.col("quota"), 6)).drop("score")


def two_stage_weight(document: Column, within: Column) -> Column:
    return F.round(document * within, 4)


def two_phase(df: DataFrame, id_col: str, part: str, estimation: int, targeted: dict[str, tuple[Column, int]], total: int, seed: str = "42") -> DataFrame:
    """Per part: `estimation` rows at random, then up to so many of each targeted kind, then random rows up to `total`; no row twice. Each later phase ranks what the earlier left.

    No phase needs more than the lowest rows of a part, or of the rows of a kind in it, so many as all phases take together; only those are ranked.
    """
    inside = Window.partitionBy(part)
    most = F.lit(estimation + sum(k for _, k in targeted.values()) + total)
    scored = df.withColumn("score", hash_order(seed, F.col(part), F.col(id_col)))
    some = [lowest(scored, [part], "score", most), *(lowest(scored.where(F.coalesce(condition, F.lit(False))), [part], "score", most) for condition, _ in targeted.values())]
    rows = some[0]
    for other in some[1:]:
        rows = rows.unionAll(other)
    rows = rows.dropDuplicates([id_col]).withColumn("phase", F.when(F.row_number().over(inside.orderBy("score", id_col)) <= estimation, F.lit("ESTIMATION")))
    for name, (condition, k) in targeted.items():
        fits = F.col("phase").isNull() & F.coalesce(condition, F.lit(False))
        place = F.row_number().over(Window.partitionBy(part, fits).orderBy("score", id_col))
        rows = rows.withColumn("phase", F.when(fits & (place <= k), F.lit(name)).otherwise(F.col("phase")))
    used = F.count("phase").over(inside)
    place = F.row_number().over(Window.partitionBy(part, F.col("phase").isNull()).orderBy("score", id_col))
    rows = rows.withColumn("used", used).withColumn("phase", F.when(F.col("phase").isNull() & (place <= F.lit(total) - F.col("used")), F.lit("FILL")).otherwise(F.col("phase")))
    return rows.where("phase IS NOT NULL").drop("score", "used")


def balanced(df: DataFrame, id_col: str, part: str, per_part: int, total: int, seed: str = "42") -> DataFrame:
    """At most `per_part` rows of each part in hash order, then others, up to `total`."""
    rows = df.withColumn("score", hash_order(seed, F.col(id_col)))
    turn = F.row_number().over(Window.partitionBy(part).orderBy("score", id_col))
    first = lowest(rows, [part], "score", F.lit(per_part)).withColumn("turn", turn).where(F.col("turn") <= per_part).drop("turn").withColumn("late", F.lit(0))
    others = rows.join(first.select(id_col), id_col, "left_anti").select(rows.columns).withColumn("late", F.lit(1)).orderBy("score", id_col).limit(total)
    return first.select(*rows.columns, "late").unionAll(others.select(*rows.columns, "late")).orderBy("late", "score", id_col).limit(total).drop("score", "late")


def one_per_document(df: DataFrame, id_col: str, document: str, total: int, seed: str = "42") -> DataFrame:
    """The row with the lowest hash of each document, then `total` of them."""
    best = df.withColumn("score", hash_order(seed, F.col(id_col))).groupBy(document).agg(F.min(F.struct("score", F.col(id_col).alias("id"))).alias("m"))
    return best.select(document, F.col("m.id").alias(id_col), "m.score").orderBy("score", id_col).limit(total).drop("score")


def number_rows(df: DataFrame, order: list[str]) -> DataFrame:
    """Consecutive numbers from 1 in a global order without one task holding all rows: a range sort, counts per partition, and offsets."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    from chashma.plans.lineage import staged

    kept = staged(parts, "ranges")
    offsets = kept.groupBy("_p").agg(F.count("*").alias("_n"))  # one row per partition
    before = offsets.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return kept.join(before, "_p").withColumn("row_number", (F.col("_before") + inside).cast("bigint")).drop("_p", "_before")


def batches(numbered: DataFrame, size: int, prefix: str) -> DataFrame:
    """Batch numbers and sequential review ids of numbered rows."""
    return numbered.withColumn("batch", F.floor((F.col("row_number") - 1) / size).cast("bigint") + 1).withColumn("review_id", F.format_string(prefix + "-%05d", F.col("row_number")))


def score_tails(df: DataFrame, score: str, truth: str, id_col: str, k: int) -> DataFrame:
    """The k highest and k lowest scores within each class; a row that is both is high."""
    rows = df.select(id_col, truth, score)
    tail = lambda order, name: rows.withColumn("place", F.row_number().over(Window.partitionBy(truth).orderBy(order, id_col))).where(F.col("place") <= k).drop("place").withColumn("tail", F.lit(name))
    both = tail(F.desc(score), "HIGH").unionAll(tail(F.asc(score), "LOW"))
    return both.groupBy(id_col, truth, score).agg(F.min("tail").alias("tail"))


def priority_order(df: DataFrame, priorities: dict[str, Column], order: list[str]) -> DataFrame:
    """Rows with the first priority whose condition holds (1, 2, …; the last for none) and their number in the order of priority, then of the named columns; no task holds all rows."""
    level = F.lit(len(priorities) + 1)
    for i, condition in reversed(list(enumerate(priorities.values(), 1))):
        level = F.when(F.coalesce(condition, F.lit(False)), i).otherwise(level)
    names = F.array(*map(F.lit, [*priorities, "OTHER"]))
    rows = df.withColumn("priority", level.cast("int")).withColumn("priority_name", F.element_at(names, F.col("priority")))
    return number_rows(rows, ["priority", *order])


def batch_progress(rows: DataFrame, batch: str, label: str, labels: list[str]) -> DataFrame:
    """For each batch: rows, reviewed and pending ones, its state, labels that are none, and the count of each label as a column."""
    has = F.coalesce(F.trim(label) != "", F.lit(False))
    out = rows.groupBy(batch).agg(F.count("*").alias("rows"), F.count_if(has).alias("reviewed"), F.count_if(has & ~F.col(label).isin(labels)).alias("unknown_labels"), *(F.count_if(F.col(label) == x).alias(x) for x in labels))
    return out.withColumn("pending", F.col("rows") - F.col("reviewed")).withColumn("state", F.when(F.col("pending") == 0, "DONE").when(F.col("reviewed") == 0, "NEW").otherwise("STARTED"))
