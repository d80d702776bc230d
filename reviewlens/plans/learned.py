"""A sentence scorer learned from labelled texts, to use in place of a lexicon."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.functions.text import WORD, word_array
from reviewlens.operators.ranking import top_per_group


MOST_FEATURES = 1 << 22
MOST_CLASSES = 1_000
"""Classes whose counts the driver holds to weigh them."""


def stratified(labelled: DataFrame, per_class: int, seed: int = 42) -> DataFrame:
    """At most ``per_class`` rows of each class ``score``, by a seeded hash of the row.

    Common classes are cut inside each task, so no task holds one whole. Rows without a
    class are left out. A rare class is taken whole.
    """
    columns = labelled.columns
    drawn = labelled.where(F.col("score").isNotNull()).withColumn("_draw", F.xxhash64(F.lit(seed), *columns))
    return top_per_group(drawn, ["score"], ["_draw", "sentence"], per_class, rank="_rank").select(*columns)


def class_weights(labelled: DataFrame) -> Column:
    """What a row of each class ``score`` weighs so that all classes weigh the same in sum."""
    counts = labelled.where(F.col("score").isNotNull()).groupBy("score").count().limit(MOST_CLASSES + 1).collect()
    if len(counts) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    total = sum(row["count"] for row in counts)
    weight = F.lit(None).cast("double")
    for row in counts:
        weight = F.when(F.col("score") == row.score, F.lit(total / len(counts) / row["count"])).otherwise(weight)
    return weight


def _buckets(labelled: DataFrame) -> int:
    words = labelled.select(F.explode(word_array("sentence")).alias("word"))
    distinct = words.agg(F.approx_count_distinct("word")).head()[0]
    features = 1 << max(10, (4 * distinct - 1).bit_length())
    if features > MOST_FEATURES:
        raise ValueError(f"{distinct} words ask for {features} buckets: choose a number of features")
    return features


def fit_scorer(
    labelled: DataFrame,
    features: int | None = None,
    max_iter: int = 30,
    reg: float = 1e-2,
    tol: float = 1e-4,
    balanced: bool = False,
) -> PipelineModel:
    """Train on ``sentence`` and its class ``score`` (0, 1, ...).

    With ``balanced`` every class weighs the same in sum, so a rare one is not given up
    for a common one.

    ``features`` is the number of buckets that words are hashed to. By default it is four
    times the distinct words, so that few of them share one. The driver holds a weight
    for each bucket and class, so beyond ``MOST_FEATURES`` it has to be chosen.
    """
    if features is None:
        features = _buckets(labelled)
    stages = [
        RegexTokenizer(inputCol="sentence", outputCol="_words", pattern=WORD, gaps=False),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=features),
        IDF(inputCol="_counts", outputCol="_features"),
        LogisticRegression(
            featuresCol="_features",
            labelCol="_label",
            predictionCol="_class",
            family="multinomial",
            weightCol="_weight",
            maxIter=max_iter,
            regParam=reg,
            tol=tol,
        ),
    ]
    weight = class_weights(labelled) if balanced else F.lit(1.0)
    rows = labelled.select("sentence", F.col("score").cast("double").alias("_label"), weight.alias("_weight"))
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return Pipeline(stages=stages).fit(rows)
    finally:
        rows.unpersist()


def learned_scores(model: PipelineModel, sentences: DataFrame) -> DataFrame:
    """Add ``score``, the class the model predicts for each sentence."""
    predicted = model.transform(sentences)
    return predicted.select(*sentences.columns, F.col("_class").cast("int").alias("score"))


def confusion(judged: DataFrame) -> DataFrame:
    """``given``, ``score``, ``n``: how often each class was taken for each."""
    return judged.groupBy("given", "score").agg(F.count(F.lit(1)).alias("n"))


def recalls(matrix: DataFrame) -> DataFrame:
    """``given``, ``n``, ``recall`` of each given class of a confusion matrix."""
    right = F.sum(F.when(F.col("given") == F.col("score"), F.col("n")).otherwise(0))
    return matrix.groupBy("given").agg(F.sum("n").alias("n"), (right / F.sum("n")).alias("recall"))


def balanced_accuracy(matrix: DataFrame) -> float:
    """The mean recall of the given classes; of ``k`` classes a constant answer has ``1 / k``."""
    return recalls(matrix).agg(F.avg("recall")).head()[0] or 0.0
