"""Counts, exact distributions, duplicates, estimates and quality measures. All group by partial aggregates; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chashma.functions import text as T


def label_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Rows and percentage for each combination of labels; nulls are a label of their own."""
    counts = df.groupBy(*columns).agg(F.count("*").alias("rows"))
    total = counts.agg(F.sum("rows")).scalar()
    return counts.select(*columns, "rows", T.percent(F.col("rows"), total).alias("percent"))


def item_counts(df: DataFrame, items: str, none: str = "SELECTED") -> DataFrame:
    """Rows for each item of an array column; rows without items count under `none`."""
    told = F.coalesce(F.col(items), F.array().cast("array<string>"))
    # an outer explode, as a plain one pushes a filter on the array below it and so makes the array twice
    return df.select(F.explode_outer(F.when(F.size(told) == 0, F.array(F.lit(none))).otherwise(told)).alias("item")).groupBy("item").agg(F.count("*").alias("rows"))


def exact_quantiles(df: DataFrame, group: list[str], value: str, probabilities: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """Minimum, maximum, mean and quantiles, interpolated on (n - 1) * q. Exact on a histogram: one row for each distinct value, not for each row."""
    histogram = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    inside = Window.partitionBy(*group).orderBy(value) if group else Window.partitionBy(F.lit(0)).orderBy(value)
    cumulated = histogram.withColumn("upto", F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    totals = histogram.groupBy(*group).agg(F.sum("n").alias("rows"), F.min(value).alias("minimum"), F.max(value).alias("maximum"), (F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("mean"))
    if group:
        joined = cumulated.join(totals, group)
    else:
        one = totals.withColumn("all", F.lit(0))
        joined = cumulated.withColumn("all", F.lit(0)).join(one, "all")  # one row on the right
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col(value)))

    def quantile(q: float) -> Column:
        place = (F.max("rows") - 1) * F.lit(q)
        rank = (F.col("rows") - 1) * F.lit(q)
        low, high = at(F.floor(rank)), at(F.ceil(rank))
        return F.round(low + (high - low) * (place - F.floor(place)), 6).alias(f"p{q * 100:g}".replace(".", "_"))

    return joined.groupBy(*group).agg(F.max("rows").alias("rows"), F.max("minimum").alias("minimum"), F.max("maximum").alias("maximum"), F.round(F.max("mean"), 6).alias("mean"), *(quantile(q) for q in probabilities))


def nearest_rank(df: DataFrame, group: list[str], value: str, probabilities: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """Quantiles that are values of the data: at index round-half-even((n - 1) * q)."""
    histogram = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    cumulated = histogram.withColumn("upto", F.sum("n").over(Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    joined = cumulated.join(histogram.groupBy(*group).agg(F.sum("n").alias("rows")), group)
    at = lambda q: F.min(F.when(F.col("upto") > F.bround((F.col("rows") - 1) * F.lit(q), 0), F.col(value)))
    return joined.groupBy(*group).agg(F.max("rows").alias("rows"), *(at(q).alias(f"p{q * 100:g}") for q in probabilities))


def blocks(df: DataFrame, id_col: str, size: int, *measures: Column) -> DataFrame:
    """Measures for each block of `size` neighbouring ids."""
    return df.groupBy(F.floor(F.col(id_col) / size).alias("block")).agg(F.count("*").alias("records"), *measures)


def exact_duplicates(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each text that occurs more than once: hash, length, first id, occurrences. Texts are grouped by hash and length; a last column counts different texts behind one hash.

    Two phases: hashes and lengths give the candidates, then the whole texts of the candidates alone are compared: a group whose smallest and largest
    texts differ is a collision. Ids of copies are not gathered (a text may be a third of all rows); `duplicate_members` lists them as rows.
    """
    texts = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.sha2(text_col, 256).alias("text_sha256"), F.length(text_col).alias("character_count"), F.col(text_col).alias("text"))
    key = ["text_sha256", "character_count"]
    candidates = texts.groupBy(*key).agg(F.min("id").alias("first_id"), F.count("*").alias("occurrences")).where("occurrences > 1")
    # partial aggregates keep one or two texts a group and task
    compared = texts.join(candidates.select(*key), key, "left_semi").groupBy(*key).agg((F.max("text") != F.min("text")).cast("int").alias("collisions"))
    return candidates.join(compared, key)


def duplicate_members(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(first_id, id) of each copy after the first."""
    hashed = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.sha2(text_col, 256).alias("text_sha256"))
    groups = hashed.groupBy("text_sha256").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("text_sha256", "first_id")
    return hashed.join(groups, "text_sha256").where("id != first_id").select("first_id", "id")


def text_groups(df: DataFrame, text_col: str, *distinct: str) -> DataFrame:
    """Texts that occur more than once: rows, distinct values of other columns, and the first and last of them as a preview of fixed size."""
    grouped = df.where(F.col(text_col).isNotNull()).groupBy(F.sha2(text_col, 256).alias("text_sha256"))
    return grouped.agg(F.count("*").alias("rows"), *(F.count_distinct(c).alias(f"distinct_{c}") for c in distinct), *(f(c).alias(f"{n}_{c}") for c in distinct for n, f in (("first", F.min), ("last", F.max)))).where("rows > 1")


def crosstab(df: DataFrame, group: str, label: str, labels: list[str], usable: list[str]) -> DataFrame:
    """Rows for each group and label, and the share of usable ones."""
    table = df.groupBy(group).agg(*(F.count_if(F.col(label) == x).alias(x) for x in labels), F.count_if(F.col(label).isin(labels)).alias("labelled"))
    return table.withColumn("usable_percent", T.percent(sum((F.col(x) for x in usable[1:]), F.col(usable[0])), F.col("labelled")))


def parts_with_zeros(df: DataFrame, part: str, parts: int, **measures: Column) -> DataFrame:
    """Measures for every part 0 .. parts - 1, also for those without rows."""
    every = df.sparkSession.range(parts).select(F.col("id").alias(part))
    told = df.groupBy(F.col(part).cast("bigint").alias(part)).agg(*(m.alias(n) for n, m in measures.items()))
    return every.join(told, part, "left").select(part, *(F.coalesce(F.col(n), F.lit(0)).alias(n) for n in measures))


def roll_up(rows: DataFrame, key: str, risks: list[str], candidate: str) -> DataFrame:
    """For each document: sentences, sentences with each risk, the share of candidates, and why it is rejected (any risk)."""
    sums = rows.groupBy(key).agg(F.count("*").alias("sentences"), *(F.count_if(F.col(r)).alias(r) for r in risks), F.count_if(F.col(candidate)).alias("candidates"))
    return sums.withColumn("candidate_rate", F.round(F.col("candidates") / F.col("sentences"), 6)).withColumn("reject_reasons", T.flags(*((r.upper(), F.col(r) > 0) for r in risks), ("NO_CANDIDATE", F.col("candidates") == 0)))


def token_labels(df: DataFrame, tokens: Column, label: str, positive: list[str], least: int = 2) -> DataFrame:
    """In how many rows a token of two or more characters stands, and in how many of them with one of the labels."""
    pairs = df.select(F.explode(F.array_distinct(tokens)).alias("token"), F.col(label).isin(positive).alias("hit")).where("length(token) >= 2")
    return pairs.groupBy("token").agg(F.count("*").alias("rows"), F.count_if(F.coalesce("hit", F.lit(False))).alias("hits")).where(F.col("rows") >= least).withColumn("hit_percent", T.percent(F.col("hits"), F.col("rows")))


def token_contrast(df: DataFrame, tokens: Column, false_clean: Column, healthy: Column) -> DataFrame:
    """Tokens that mark rows wrongly held for clean: in at least two of them, and in none or a third as many healthy ones."""
    pairs = df.select(F.explode(F.array_distinct(tokens)).alias("token"), false_clean.alias("fc"), healthy.alias("hc"))
    return pairs.groupBy("token").agg(F.count_if("fc").alias("false_clean_rows"), F.count_if("hc").alias("healthy_rows")).where("false_clean_rows >= 2 AND (healthy_rows = 0 OR false_clean_rows >= 3 * healthy_rows)")


def lexicon(df: DataFrame, tokens: Column, safe: list[str]) -> DataFrame:
    """(token, occurrences, confident): a token is confident if seen twice, listed as safe or at most three characters long."""
    counts = df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("occurrences"))
    return counts.withColumn("confident", (F.col("occurrences") >= 2) | F.col("token").isin(safe or [""]) | (F.length("token") <= 3))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(truth, predicted).agg(F.count("*").alias("rows"))


def class_scores(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 of each class; 0 where undefined."""
    each = df.select(F.explode(F.array(F.struct(F.col(truth).alias("label"), (F.col(truth) == F.col(predicted)).cast("int").alias("tp"), F.lit(0).alias("as_predicted"), F.lit(1).alias("as_truth")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("tp"), F.lit(1).alias("as_predicted"), F.lit(0).alias("as_truth")))).alias("x")).select("x.*")
    sums = each.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("as_predicted").alias("predicted"), F.sum("as_truth").alias("actual"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = share(F.col("tp"), F.col("predicted")), share(F.col("tp"), F.col("actual"))
    return sums.select("label", "tp", "predicted", "actual", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"))


def threshold_sweep(df: DataFrame, score: str, truth: str, thresholds: list[float]) -> DataFrame:
    """True and false positives and negatives and the measures they give, at each threshold; one pass over the rows."""
    c = F.col
    many = df.select(F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"), c(score).alias("s"), c(truth).alias("t"))
    sums = many.groupBy("threshold").agg(F.count_if((c("s") >= c("threshold")) & c("t")).alias("tp"), F.count_if((c("s") >= c("threshold")) & ~c("t")).alias("fp"), F.count_if((c("s") < c("threshold")) & c("t")).alias("fn"), F.count_if((c("s") < c("threshold")) & ~c("t")).alias("tn"))
    share = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    return sums.select("*", share(c("tp"), c("tp") + c("fp")).alias("precision"), share(c("tp"), c("tp") + c("fn")).alias("recall"), share(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")).alias("f1"), share(c("fp"), c("tp") + c("fp")).alias("leakage"), share(c("tp") + c("fp"), c("tp") + c("fp") + c("fn") + c("tn")).alias("coverage"))


def signal_summary(df: DataFrame, signals: list[str], label: str, usable: list[str], harmful: list[str]) -> DataFrame:
    """For each boolean signal: rows flagged, their share, and the shares of usable and harmful labels among them. Signals are unpivoted in one pass."""
    pairs = df.select(F.explode_outer(F.array(*(F.struct(F.lit(s).alias("signal"), F.coalesce(F.col(s), F.lit(False)).alias("on")) for s in signals))).alias("x"), F.col(label).alias("label"))
    sums = pairs.groupBy("x.signal").agg(F.count("*").alias("rows"), F.count_if("x.on").alias("flagged"), F.count_if(F.col("x.on") & F.col("label").isin(usable)).alias("usable"), F.count_if(F.col("x.on") & F.col("label").isin(harmful)).alias("harmful"))
    return sums.select("signal", "flagged", T.percent(F.col("flagged"), F.col("rows"), 4).alias("coverage_percent"), T.percent(F.col("usable"), F.col("flagged"), 4).alias("usable_percent"), T.percent(F.col("harmful"), F.col("flagged"), 4).alias("harmful_percent"))


def numeric_summary(df: DataFrame, values: list[str], label: str) -> DataFrame:
    """For each label and numeric column: values that are numbers, minimum, mean and maximum."""
    ok = lambda v: F.when(F.isnan(F.col(v).cast("double")), None).otherwise(F.col(v).cast("double"))
    pairs = df.select(F.col(label).alias("label"), F.explode(F.array(*(F.struct(F.lit(v).alias("column"), ok(v).alias("value")) for v in values))).alias("x")).select("label", "x.*")
    return pairs.groupBy("label", "column").agg(F.count("value").alias("present"), F.round(F.min("value"), 6).alias("minimum"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 6).alias("maximum"))


def wilson(successes: Column, trials: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval; null without trials."""
    n, p = trials.cast("double"), successes / trials
    centre, spread = p + z * z / (2 * n), z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    low, high = ((centre - spread) / (1 + z * z / n), (centre + spread) / (1 + z * z / n))
    return F.when(trials > 0, F.round(F.greatest(F.lit(0.0), low), 6)), F.when(trials > 0, F.round(F.least(F.lit(1.0), high), 6))


def proportions(df: DataFrame, group: str, hit: Column) -> DataFrame:
    """Share of hits in each group with its Wilson interval."""
    sums = df.groupBy(group).agg(F.count("*").alias("rows"), F.count_if(hit).alias("hits"))
    low, high = wilson(F.col("hits"), F.col("rows"))
    return sums.select(group, "rows", "hits", F.round(F.col("hits") / F.col("rows"), 6).alias("share"), low.alias("low"), high.alias("high"))


def stratified_estimate(strata: DataFrame, population: str, sampled: str, hits: str, z: float = 1.96) -> DataFrame:
    """The share in the population, from strata of known size, with finite-population correction: one row per stratum goes in, one row comes out."""
    every = Window.partitionBy(F.lit(0))
    c = F.col
    rows = strata.where(c(sampled) > 0).withColumn("w", c(population) / F.sum(population).over(every)).withColumn("p", c(hits) / c(sampled))
    spread = F.when(c(sampled) > 1, c(sampled) / (c(sampled) - 1) * c("p") * (1 - c("p"))).otherwise(0.0)
    one = rows.agg(F.sum(c("w") * c("p")).alias("share"), F.sum(c("w") * c("w") * (1 - c(sampled) / c(population)) * spread / c(sampled)).alias("variance"), F.sum(population).alias("population"), F.sum(sampled).alias("sampled"))
    error = F.sqrt(F.greatest(F.lit(0.0), c("variance")))
    return one.select("population", "sampled", F.round("share", 6).alias("share"), F.round(error, 6).alias("standard_error"), F.round(F.greatest(F.lit(0.0), c("share") - z * error), 6).alias("low"), F.round(F.least(F.lit(1.0), c("share") + z * error), 6).alias("high"), F.round(c("share") * c("population"), 0).cast("bigint").alias("projected"))


def schema_shapes(items: DataFrame, variant: str) -> DataFrame:
    """(shape, rows): the inferred shape of each item of a VARIANT column."""
    return items.groupBy(F.schema_of_variant(variant).alias("shape")).agg(F.count("*").alias("rows"))


def field_presence(items: DataFrame, variant: str, fields: list[str]) -> DataFrame:
    """(field, present, missing): in how many items each field has a value."""
    have = F.array(*(F.struct(F.lit(f).alias("field"), F.try_variant_get(variant, f"$.{f}", "string").isNotNull().alias("has")) for f in fields))
    return items.select(F.explode_outer(have).alias("x")).groupBy("x.field").agg(F.count_if("x.has").alias("present"), F.count_if(~F.col("x.has")).alias("missing"))


def transitions(df: DataFrame, truth: str, predicted: str, flags: str) -> DataFrame:
    """(truth, predicted, flag, rows): how often a row of one class goes to another, for each of its flags; `NONE` without flags."""
    told = F.coalesce(F.col(flags), F.array().cast("array<string>"))
    rows = df.select(truth, predicted, F.explode_outer(F.when(F.size(told) == 0, F.array(F.lit("NONE"))).otherwise(told)).alias("flag"))
    return rows.groupBy(truth, predicted, "flag").agg(F.count("*").alias("rows"))


def selection_scores(df: DataFrame, outcome: str, *groups: str) -> DataFrame:
    """For each group: healthy, false clean and missed rows among the selected and the rest, with precision and recall of the selection."""
    count = lambda name: F.count_if(F.col(outcome) == name)
    sums = df.groupBy(*groups).agg(count("SELECTED_HEALTHY").alias("selected_healthy"), count("FALSE_CLEAN").alias("false_clean"), count("MISSED_HEALTHY").alias("missed_healthy"), count("REJECTED").alias("rejected"))
    share = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    hit = F.col("selected_healthy")
    return sums.select("*", share(hit, hit + F.col("false_clean")).alias("precision"), share(hit, hit + F.col("missed_healthy")).alias("recall"))
