"""Expressions over arrays of numbers: dot products, distances, softmax, argmax."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_l2(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def cosine_distance(a: Column, b: Column) -> Column:
    """Squared distance of unit vectors: 2 - 2 x.y."""
    return F.lit(2.0) - F.lit(2.0) * dot(a, b)


def _scaled(v: Column, by: Column) -> Column:
    """Elements divided by a number that is evaluated once."""
    return let(F.struct(v.alias("v"), by.alias("by")), lambda s: F.transform(s["v"], lambda x: x.cast("double") / s["by"]))


def l2_normalise(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return _scaled(v, F.when(norm > 0, norm).otherwise(1.0))


def log_softmax(v: Column) -> Column:
    def body(s):
        log_sum = F.log(total(F.transform(s["v"], lambda x: F.exp(x.cast("double") - s["top"])))) + s["top"]
        return let(log_sum, lambda z: F.transform(s["v"], lambda x: x.cast("double") - z))

    return let(F.struct(v.alias("v"), F.array_max(v).cast("double").alias("top")), body)


def softmax(v: Column) -> Column:
    e = let(F.struct(v.alias("v"), F.array_max(v).cast("double").alias("top")), lambda s: F.transform(s["v"], lambda x: F.exp(x.cast("double") - s["top"])))
    return let(e, lambda x: _scaled(x, total(x)))


def argmax(v: Column) -> Column:
    """Index of the first greatest element, from 0."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def temper(p: Column, temperature: float) -> Column:
    """Probabilities to the power of 1 / temperature, renormalised."""
    return let(F.transform(p, lambda x: F.pow(x, F.lit(1.0 / temperature))), lambda q: _scaled(q, total(q)))


def mean_pool(vectors: Column, size: int) -> Column:
    """Element-wise mean of an array of arrays."""
    n = F.size(vectors)
    zero = F.array_repeat(F.lit(0.0), size)
    return F.transform(F.aggregate(vectors, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y.cast("double"))), lambda x: x / n)
