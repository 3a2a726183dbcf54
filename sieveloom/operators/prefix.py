"""Running totals and ranks over any order, without putting a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def running_sum(df: DataFrame, value: str, by: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of the group up to and with this one, in ``order``.

    ``order`` must be total within a group.  Rows are range-partitioned by
    group and order, so a hot group spans many tasks; each task sums its part,
    the totals of (group, part), a table of the size groups plus parts, are summed up in
    turn, and every row adds the offset of its part.  NULL values count as 0.
    """
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    keys = [F.col(f"`{b}`") for b in by]
    parts = df.repartitionByRange(n, *keys, *order).withColumn("__part", F.spark_partition_id())
    parts = cut(parts)  # the parts must not move between the two uses
    v = F.coalesce(F.col(f"`{value}`"), F.lit(0))
    totals = parts.groupBy(*keys, "__part").agg(F.sum(v).alias("__sum"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    local = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = parts.withColumn("__run", F.sum(v).over(local))
    match = [rows[b].eqNullSafe(offsets[b]) for b in by] + [rows["__part"] == offsets["__part"]]
    joined = rows.join(offsets, match, "inner").select(*[rows[c] for c in parts.columns if c != "__part"], (F.col("__run") + F.col("__before")).alias(name))
    return joined


def row_numbers(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """Dense numbers from 1 in a total order, by the same two levels of sums."""
    return running_sum(df.withColumn("__one", F.lit(1)), "__one", by, order, name).drop("__one")


def budget_prefix(df: DataFrame, tokens: str, budget: Column, by: list[str], order: list[Column]) -> DataFrame:
    """Rows in order until the total of ``tokens`` reaches ``budget``, the row that reaches it included; none for a budget of 0."""
    return running_sum(df, tokens, by, order, "__cum").where((F.col("__cum") - F.col(tokens) < budget) & (budget > 0)).drop("__cum")


def rank_table(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    """``(by..., x, n, below, total)``: occurrences of each value, how many are lower, and the group's non-null values."""
    counts = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("n"))
    run = running_sum(counts, "n", by, [F.col(x).asc()], "__upto")
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    return run.join(totals, by).withColumn("below", F.col("__upto") - F.col("n")).drop("__upto") if by else run.crossJoin(F.broadcast(totals)).withColumn("below", F.col("__upto") - F.col("n")).drop("__upto")


def average_ranks(df: DataFrame, x: str, by: list[str], name: str) -> DataFrame:
    """``df`` with the percentile rank of x in its group, ties at their mean; values are counted before they are ranked."""
    table = rank_table(df, x, by).select(*by, x, ((F.col("below") + (F.col("n") + 1) / 2) / F.col("total")).alias(name))
    return df.join(table, [*by, x], "left")
