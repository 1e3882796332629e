"""Joins and set operations as the audits need them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_unique(df: DataFrame, *keys: str) -> Column:
    """Aggregate: whether the keys name each row."""
    return F.count("*") == F.count_distinct(*keys)


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join that fails if a key occurs twice on either side; both checks are partial aggregates that end at the first repeated key."""
    for side in (left, right):
        if side.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
            raise ValueError(f"{key} is not unique")
    return left.join(right, key, "left")


def left_first(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """Left join with the first row of each key on the right."""
    return left.join(keep_first(right, [key], [order]), key, "left")


def by_position(left: DataFrame, right: DataFrame, position: str, how: str = "full_outer") -> DataFrame:
    """Rows of one explicit position side by side; there is no implicit row order."""
    return left.join(right, position, how)


def anti(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys), keys, "left_anti")


def semi(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys), keys, "left_semi")


def with_counts(left: DataFrame, right: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Left join with how often the keys occur on the right, 0 if never."""
    return left.join(right.groupBy(*keys).agg(F.count("*").alias(name)), keys, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("bigint"))


def neighbours(df: DataFrame, document: str, index: str, text: str) -> DataFrame:
    """Previous and next text in a document whose indexes are dense: by equality joins on (document, index), so that a document with very many rows is no hot group."""
    side = lambda by, name: df.select(F.col(document), (F.col(index) + by).alias(index), F.col(text).alias(name))
    return df.join(side(1, "previous_text"), [document, index], "left").join(side(-1, "next_text"), [document, index], "left")


def containing(points: DataFrame, spans: DataFrame, document: str, point: str, start: str, stop: str) -> DataFrame:
    """Points with the spans of their document that hold them: an equality join on the document, then the range."""
    return points.join(spans, document).where((F.col(point) > F.col(start)) & (F.col(point) < F.col(stop)))


def attach_labels(left: DataFrame, labels: DataFrame, keys: list[str], label: str, default: str = "") -> DataFrame:
    return left.join(labels.select(*keys, label), keys, "left").withColumn(label, F.coalesce(label, F.lit(default)))


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all frames; columns that one lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in an explicit order; as an aggregate, so a hot key is combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    m = F.min(F.struct(*order, *(c for c in rest if c not in order))).alias("m")
    return df.groupBy(*keys).agg(m).select(*keys, *(F.col(f"m.{c}") for c in rest))


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    m = F.max(F.struct(*order, *(c for c in rest if c not in order))).alias("m")
    return df.groupBy(*keys).agg(m).select(*keys, *(F.col(f"m.{c}") for c in rest))


def set_compare(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys of the left only, the right only, or both."""
    sides = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    found = sides.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return found.select(key, F.when(F.col("l") + F.col("r") == 2, "BOTH").when(F.col("l") == 1, "LEFT").otherwise("RIGHT").alias("side"))


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def selection_outcome(selected: Column, healthy: Column) -> Column:
    return F.when(selected & healthy, "SELECTED_HEALTHY").when(selected, "FALSE_CLEAN").when(healthy, "MISSED_HEALTHY").otherwise("REJECTED")
