"""A sample whose shares per category match given targets.

Plan: one shuffle counts eligible documents once each; what follows per category has one row per
target. Quotas: largest remainder over the targets, raised to the floors, lowered to what is there. What
categories lack goes to the others in proportion to their targets, in rounds, as each can take no more than it has;
the rounds are settled at once by running sums over the categories in the order in which they fill up. The
documents with the smallest random keys of a category are taken without sorting it: keys are counted
in `2**key_bits` bins, the bin holding the last taken key is found from running sums, documents in lower
bins are taken whole, and only that one bin is ranked. So a category with a third of all rows is never in one task.

Defined cases: a document counts as eligible if one of its rows is (category set, allocation at least 1,
weight finite and positive); rows delivered twice count once, a document named with several categories
belongs to the smallest; targets without documents get quota 0 and a shortfall; categories without
a target are not sampled but count for the size; empty tables give no rows; null or repeated targets count 0 or once (the largest).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chashma.plans.lineage import staged

SHARE = 3  # one document of this many is drawn
KEY_BITS = 16


def random_key(seed: int, key: Column) -> Column:
    """60 bits of a hash of seed and key, the same on every engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"))), 1, 15), 16, 10).cast("bigint")


def eligible(documents: DataFrame, doc: str = "source_record_id", part: str = "part_number", allocated: str = "part_allocated_documents", weight: str = "sampling_weight") -> DataFrame:
    """(document_id, category), once for each eligible document."""
    rows = documents.select(F.col(doc).alias("document_id"), F.col(part).alias("category"), F.col(allocated).alias("allocated"), F.col(weight).cast("double").alias("weight"))
    good = rows.where("document_id IS NOT NULL AND category IS NOT NULL AND allocated >= 1 AND weight > 0 AND NOT isnan(weight) AND weight < double('Infinity')")
    return good.groupBy("document_id").agg(F.min("category").alias("category"))


def quotas(documents: DataFrame, targets: DataFrame, part: str = "part_number", permille: str = "target_permille", floor: str = "min_documents", share: int = SHARE) -> DataFrame:
    """One row for each target: available, wanted (share, ceiling and floor), ideal and quota. `documents` as from `eligible`.

    The sum of quotas is n = floor(E / share) unless floors exceed it or documents lack in all categories that have a target.
    """
    counts = documents.groupBy("category").agg(F.count("*").alias("documents"))
    told = targets.where(F.col(part).isNotNull()).groupBy(F.col(part).alias("category")).agg(F.coalesce(F.max(permille), F.lit(0)).cast("bigint").alias("permille"), F.coalesce(F.max(floor), F.lit(0)).cast("bigint").alias("floor"))
    # the counts are one row per category, so the total comes from them
    total = counts.agg(F.floor(F.coalesce(F.sum("documents"), F.lit(0)) / share).cast("bigint")).scalar()
    rows = told.join(counts, "category", "left").withColumn("n", total).withColumn("available", F.coalesce("documents", F.lit(0)).cast("bigint"))
    c = F.col
    rows = rows.withColumn("base", F.expr("(permille * n) div 1000")).withColumn("rest", (c("permille") * c("n")) % 1000)
    every = Window.partitionBy(F.lit(0))  # one row per target
    rows = rows.withColumn("left", F.expr("sum(rest) OVER (PARTITION BY 0) div 1000")).withColumn("place", F.row_number().over(every.orderBy(F.desc("rest"), F.asc("category"))))
    rows = rows.withColumn("ideal", c("base") + F.when(c("place") <= c("left"), 1).otherwise(0))
    rows = rows.withColumn("wanted", F.greatest("floor", F.expr("(permille * n + 999) div 1000"))).withColumn("first_quota", F.least("available", F.greatest("ideal", "floor")))
    rows = rows.withColumn("gap", c("n") - F.sum("first_quota").over(every))
    # what is lacking: a category takes its share of targets, or all it has if that is less; categories fill up in the order of room for each unit of target
    rows = rows.withColumn("room", F.when(c("permille") > 0, c("available") - c("first_quota")).otherwise(0))
    fills = every.orderBy((c("room") / F.greatest(c("permille"), F.lit(1))), "category")
    rows = rows.withColumn("weight_from", F.sum(F.when(c("room") > 0, c("permille")).otherwise(0)).over(fills.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("room_before", F.coalesce(F.sum("room").over(fills.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    full = (c("gap") - c("room_before")) * c("permille") >= c("room") * c("weight_from")
    rows = rows.withColumn("is_full", (c("room") == 0) | full)
    rows = rows.withColumn("to_share", F.greatest(F.lit(0), c("gap") - F.coalesce(F.sum(F.when(c("is_full"), c("room"))).over(every), F.lit(0)))).withColumn("weights", F.coalesce(F.sum(F.when(~c("is_full"), c("permille"))).over(every), F.lit(0)))
    rows = rows.withColumn("taken", F.expr("CASE WHEN is_full THEN room ELSE (to_share * permille) div weights END")).withColumn("over", F.expr("CASE WHEN is_full THEN -1 ELSE (to_share * permille) % weights END"))
    rows = rows.withColumn("turn", F.row_number().over(every.orderBy(F.desc("over"), "category"))).withColumn("still", F.least("gap", F.sum("room").over(every)) - F.sum("taken").over(every))
    rows = rows.withColumn("taken", c("taken") + F.when((c("turn") <= c("still")) & ~c("is_full"), 1).otherwise(0))
    # what floors took beyond n comes from categories above their floor, by largest remainder of what they have above it
    rows = rows.withColumn("above", F.greatest(F.lit(0), c("first_quota") - F.least("floor", "available"))).withColumn("all_above", F.sum("above").over(every)).withColumn("back", F.least(-c("gap"), "all_above"))
    rows = rows.withColumn("given", F.expr("CASE WHEN back > 0 THEN (above * back) div all_above ELSE 0 END")).withColumn("part", F.expr("CASE WHEN back > 0 THEN (above * back) % all_above ELSE 0 END"))
    rows = rows.withColumn("turn", F.row_number().over(every.orderBy(F.desc("part"), "category"))).withColumn("given", c("given") + F.when((c("turn") <= c("back") - F.sum("given").over(every)) & (c("above") > c("given")), 1).otherwise(0))
    quota = F.when(c("gap") >= 0, c("first_quota") + c("taken")).otherwise(c("first_quota") - c("given"))
    return rows.select("category", "permille", "floor", "n", "available", "ideal", "wanted", quota.cast("bigint").alias("quota"))


def draw(documents: DataFrame, plan: DataFrame, seed: int = 42, key_bits: int = KEY_BITS) -> DataFrame:
    """(document_id, category, sample_key) of the `quota` documents with the smallest random keys of each category; ties by id."""
    keyed = documents.withColumn("sample_key", random_key(seed, F.col("document_id"))).withColumn("bin", F.shiftright("sample_key", 60 - key_bits).cast("int"))
    bins = keyed.groupBy("category", "bin").agg(F.count("*").alias("in_bin"))
    running = Window.partitionBy("category").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most 2**key_bits rows
    edge = (
        bins.join(plan.where("quota > 0").select("category", "quota"), "category")
        .withColumn("before", F.coalesce(F.sum("in_bin").over(running), F.lit(0)))
        .where("before < quota")
        .groupBy("category")
        .agg(F.max("bin").alias("last_bin"), F.max("before").alias("before"), F.first("quota").alias("quota"))
    )
    near = keyed.join(edge, "category").where("bin <= last_bin")
    last = near.where("bin = last_bin").withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy("sample_key", "document_id"))).where("place <= quota - before")
    columns = ["document_id", "category", "sample_key"]
    return near.where("bin < last_bin").select(columns).unionAll(last.select(columns))


def sample(documents: DataFrame, targets: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(sample, plan) for raw rows and targets."""
    once = staged(eligible(documents), "eligible")
    plan = quotas(once, targets)
    return draw(once, plan, seed), plan


def report(drawn: DataFrame, plan: DataFrame) -> DataFrame:
    """What came out for each target: documents drawn, what they lack of `wanted`, what the draw left, and the shortfall: what is lacking even if all that is left were drawn."""
    counts = drawn.groupBy("category").agg(F.count("*").alias("drawn"))
    c = F.col
    rows = plan.join(counts, "category", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)).cast("bigint"))
    rows = rows.withColumn("missing", F.greatest(F.lit(0).cast("bigint"), c("wanted") - c("drawn"))).withColumn("left", c("available") - c("drawn"))
    return rows.withColumn("shortfall", F.greatest(F.lit(0).cast("bigint"), c("missing") - c("left")))
