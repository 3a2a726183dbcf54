"""Joins with guarantees: validated keys, guarded lengths, mandatory lookups, positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """Broadcast a side if it has at most so many rows, else leave the join to the planner.

    The rows that were read to see this become the side, so that what they come
    from (group means, thresholds) is computed once; ``limit`` stops beyond the bound.
    """
    held = df.limit(rows + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(held, df.schema)) if len(held) <= rows else df


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that fails when a key repeats on either side; the counts share the join's partitioning."""
    w = Window.partitionBy(*keys)

    def checked(df: DataFrame, side: str) -> DataFrame:
        n = F.count(F.lit(1)).over(w)
        return df.withColumn("__n", F.when(n > 1, F.raise_error(F.lit(f"keys repeat on the {side}"))).otherwise(n)).where("__n = 1").drop("__n")

    return checked(left, "left").join(checked(right, "right"), keys, "inner")


def left_chain(base: DataFrame, others: list[DataFrame], keys: list[str]) -> DataFrame:
    """Left outer joins in turn; clashing columns of the later frames are dropped."""
    for o in others:
        base = base.join(o.select(*keys, *[c for c in o.columns if c not in base.columns]), keys, "left")
    return base


def gather(positions: DataFrame, arrays: DataFrame, key: str, array: str, at: str, name: str) -> DataFrame:
    """The element of ``arrays.array`` at ``positions.at`` (from 0) of the same key; NULL beyond its end."""
    items = arrays.select(key, F.posexplode(array).alias(at, name))
    return positions.join(items, [key, at], "left")


def length_guarded(rows: DataFrame, values: DataFrame, shard: str, keys: list[str], columns: list[str]) -> DataFrame:
    """Left join in which a shard's values count only if there are as many as it has rows, else they are all NULL."""
    n_rows, n_values = rows.groupBy(shard).agg(F.count("*").alias("__rows")), values.groupBy(shard).agg(F.count("*").alias("__values"))
    fit = n_rows.join(n_values, shard).where("__rows = __values").select(shard)
    return rows.join(values.join(fit, shard, "left_semi"), keys, "left").select(*rows.columns, *columns)


def mandatory(left: DataFrame, lookup: DataFrame, key: str, value: str) -> DataFrame:
    """Left join that fails for a key without a value."""
    joined = left.join(lookup.withColumn("__hit", F.lit(True)), key, "left")
    return joined.withColumn(value, F.when(F.col("__hit").isNull(), F.raise_error(F.concat(F.lit("no entry for "), F.col(key).cast("string")))).otherwise(F.col(value))).drop("__hit")


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Independent product of two distributions ``(domain array<int>, weight)``: domains joined up, weights multiplied.

    Both sides are small tables by their meaning (24 labels each); the result is their product by definition.
    """
    right = b.select(F.col("domain").alias("d2"), F.col("weight").alias("w2"))
    return a.join(small(right)).select(F.concat("domain", "d2").alias("domain"), (F.col("weight") * F.col("w2")).alias("weight"))


def nearest_values(df: DataFrame, x: str, targets: DataFrame, keep: int, ties: list[Column]) -> DataFrame:
    """The ``keep`` rows nearest to each target ``(q, value)``; ``row_number`` prunes in every task before the shuffle."""
    gap = F.abs(F.col(x) - F.col("value"))
    joined = df.where(F.col(x).isNotNull()).join(small(targets))
    w = Window.partitionBy("q").orderBy(gap, *ties)
    return joined.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= keep)
