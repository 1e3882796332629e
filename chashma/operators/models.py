"""Training and frozen use of text quality classifiers with Spark ML: folds, four model kinds, thresholds, a staged decision."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import IDF, HashingTF, Imputer, NGram, RegexTokenizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chashma.operators.aggregate import threshold_sweep

KINDS = ("logistic", "tree", "forest", "boosted")


def preflight(df: DataFrame, id_col: str, label: str, labels: list[str]) -> DataFrame:
    """(name, status, observed): whether rows can be trained on."""
    one = df.agg(F.count("*").alias("rows"), F.count_distinct(id_col).alias("ids"), F.count_if(~F.coalesce(F.col(label).isin(labels), F.lit(False))).alias("unlabelled"), F.count_distinct(label).alias("labels"))
    checks = F.array(*(F.struct(F.lit(n).alias("name"), F.when(ok, "PASS").otherwise("FAIL").alias("status"), o.alias("observed")) for n, ok, o in (("has_rows", F.col("rows") > 0, F.col("rows")), ("unique_ids", F.col("rows") == F.col("ids"), F.col("ids")), ("all_labelled", F.col("unlabelled") == 0, F.col("unlabelled")), ("several_labels", F.col("labels") > 1, F.col("labels")))))
    return one.select(F.inline(checks))


def numeric_pipeline(kind: str, numeric: list[str], label: str, trees: int = 400, rounds: int = 30) -> Pipeline:
    filled = [f"{c}_filled" for c in numeric]
    stages = [Imputer(strategy="median", inputCols=numeric, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw_features"), StandardScaler(inputCol="raw_features", outputCol="features", withMean=True)]
    model = {
        "logistic": lambda: LogisticRegression(labelCol=label, weightCol="weight", maxIter=50, regParam=0.01),
        "tree": lambda: DecisionTreeClassifier(labelCol=label, weightCol="weight", maxDepth=5, minInstancesPerNode=8, seed=42),
        "forest": lambda: RandomForestClassifier(labelCol=label, weightCol="weight", numTrees=trees, maxDepth=10, seed=42),
        "boosted": lambda: GBTClassifier(labelCol=label, weightCol="weight", maxIter=rounds, maxDepth=4, seed=42),
    }[kind]()
    return Pipeline(stages=[*stages, model])


def text_pipeline(text: str, label: str, features: int = 1 << 14, chars: tuple[int, int] = (3, 6), rounds: int = 40) -> Pipeline:
    """Words, word pairs and runs of `chars` characters by hashed TF-IDF, and a logistic model."""
    stages = [RegexTokenizer(inputCol=text, outputCol="words", pattern=r"\s+"), RegexTokenizer(inputCol=text, outputCol="chars", pattern=".", gaps=False), NGram(n=2, inputCol="words", outputCol="pairs")]
    runs = [f"chars_{n}" for n in range(chars[0], chars[1] + 1)]
    stages += [NGram(n=n, inputCol="chars", outputCol=f"chars_{n}") for n in range(chars[0], chars[1] + 1)]
    vectors = []
    for c in ("words", "pairs", *runs):
        stages += [HashingTF(inputCol=c, outputCol=f"{c}_tf", numFeatures=features), IDF(inputCol=f"{c}_tf", outputCol=f"{c}_idf", minDocFreq=2)]
        vectors.append(f"{c}_idf")
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=vectors, outputCol="features"), LogisticRegression(labelCol=label, weightCol="weight", maxIter=rounds, regParam=0.01)])


def weighted(df: DataFrame, label: str) -> DataFrame:
    """Weights that give both classes the same sum; the share is a scalar subquery."""
    p = df.agg(F.count_if(F.col(label) == 1.0) / F.count("*")).scalar()
    return df.withColumn("weight", F.when(F.col(label) == 1.0, 0.5 / F.greatest(p, F.lit(1e-9))).otherwise(0.5 / F.greatest(1 - p, F.lit(1e-9))))


def folds(df: DataFrame, id_col: str, k: int = 5) -> DataFrame:
    """Folds by a hash of the id, so that each class is spread evenly and nothing is sorted or shuffled."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.col(id_col)), F.lit(k)).cast("int"))


def out_of_fold(df: DataFrame, id_col: str, label: str, pipeline: Pipeline, k: int = 5) -> DataFrame:
    """(id, label, probability): each row scored by the model that did not see its fold. A fit is one job for each fold."""
    rows, out = weighted(folds(df, id_col, k), label), None
    for f in range(k):
        scored = pipeline.fit(rows.where(F.col("fold") != f)).transform(rows.where(F.col("fold") == f))
        part = scored.select(id_col, label, vector_to_array("probability")[1].alias("probability"))
        out = part if out is None else out.unionAll(part)
    return out


def best_threshold(scored: DataFrame, label: str, thresholds: list[float], most_leakage: float) -> DataFrame:
    """The threshold within the leakage that is allowed, by coverage, recall and precision; if none is within, the one that leaks least."""
    sweep = threshold_sweep(scored.withColumn("truth", F.col(label) == 1.0), "probability", "truth", thresholds)
    ok = (F.col("leakage") <= most_leakage) & (F.col("tp") + F.col("fp") > 0)
    return sweep.withColumn("within", ok).orderBy(F.desc("within"), F.when(ok, F.lit(0.0)).otherwise(F.col("leakage")), F.desc("coverage"), F.desc("recall"), F.desc("precision"), "threshold").limit(1)


def staged_route(usable: str, direct: str, reject: str, thresholds: tuple[float, float, float]):
    """Usable first; of those direct or repairable; of the others reject or quarantine."""
    u, d, r = thresholds
    return F.when(F.col(usable) >= u, F.when(F.col(direct) >= d, "DIRECT_HEALTHY").otherwise("REPAIRABLE_USABLE")).otherwise(F.when(F.col(reject) >= r, "REJECT").otherwise("QUARANTINE"))


def save(model: PipelineModel, path: str) -> None:
    """Write a model and, last, the mark that it is frozen."""
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(f"{path}/model")
    spark.range(1).select(F.lit(True).alias("frozen"), F.lit(len(model.stages)).alias("stages")).write.mode("overwrite").json(f"{path}/frozen")


def frozen(path: str, blind: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """Score rows with a saved model; without its mark this is an error. Labels are joined last, so they cannot reach the scores."""
    blind.sparkSession.read.json(f"{path}/frozen").first()
    scored = PipelineModel.load(f"{path}/model").transform(blind).select(id_col, vector_to_array("probability")[1].alias("probability"))
    return scored.join(labels, id_col, "left")
