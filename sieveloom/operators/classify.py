"""Text classifiers on soft labels."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import words


def vectors(df: DataFrame, text: str, dims: int) -> DataFrame:
    """``df`` with ``__x``: hashed counts of the lower-case words, of length 1; null texts have none."""
    split = df.withColumn("__w", words(F.lower(F.coalesce(text, F.lit("")))))
    return Normalizer(inputCol="__tf", outputCol="__x").transform(HashingTF(numFeatures=dims, inputCol="__w", outputCol="__tf").transform(split)).drop("__w", "__tf")


def train_soft(df: DataFrame, text: str, probabilities: str, dims: int = 1 << 14, iterations: int = 40, reg: float = 1e-4):
    """A linear classifier that minimises the cross-entropy against label distributions.

    The cross-entropy of a distribution is the sum of those of its labels,
    weighted by their probabilities: a row becomes one weighted row per label
    of positive probability.  Null distributions are left out.
    """
    rows = vectors(df.where(F.col(probabilities).isNotNull()).select(text, probabilities), text, dims).select("__x", F.posexplode(probabilities).alias("__y", "__p")).where("__p > 0")
    return LogisticRegression(featuresCol="__x", labelCol="__y", weightCol="__p", family="multinomial", maxIter=iterations, regParam=reg, standardization=False).fit(rows.withColumn("__y", F.col("__y").cast("double")))


def apply_soft(df: DataFrame, model, text: str, keys: list[str]) -> DataFrame:
    """``keys``, ``probs`` and the likeliest ``label``, the first of equal ones."""
    scored = model.transform(vectors(df.select(*keys, text), text, model.numFeatures))
    p = scored.select(*keys, vector_to_array("probability").alias("probs"))
    return p.withColumn("label", (F.array_position("probs", F.array_max("probs")) - 1).cast("int"))
