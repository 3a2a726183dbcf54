"""Exact quantiles with linear interpolation, in bounded memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Accuracy of the first, approximate pass: the second looks closely at about 4 / ACCURACY of the values.
ACCURACY = 100_000
#: Brackets up to which a value's place among them is found by compiled comparisons.
COMPARED = 32


def _numbers(v: list[float]) -> str:
    return "array(" + ", ".join(f"{a:.9f}D" for a in v) + ")"


def _reached(x: Column, bounds: Column | list[float], strictly: bool) -> Column:
    """How many of the sorted bounds the value has reached, or lies above."""
    test = lambda b: b < x if strictly else b <= x
    if isinstance(bounds, list):
        if len(bounds) <= COMPARED:
            return sum((F.when(test(F.lit(float(b))), 1).otherwise(0) for b in bounds), F.lit(0))
        bounds = F.array(*[F.lit(float(b)) for b in bounds])
    return F.size(F.filter(bounds, test))


def quantiles(df: DataFrame, x: str, ps: list[float], by: list[str] = []) -> DataFrame:  # noqa: B006
    """``(by..., p, value)`` for each group with non-null values; NULLs are skipped.

    An approximate pass brackets each quantile.  The second pass is one
    aggregation: values inside a bracket, a small share of all, are counted one
    by one, those between brackets are counted together with their least and
    greatest, so that no row is repeated however many quantiles are asked for.
    The running count of this table, of a few values per 100,000 rows, gives
    the exact ranks.  ``by`` is a grouping of bounded size (topics, formats),
    whose table of brackets is joined back; without one the brackets are
    computed at once and become literals.
    """
    ps = sorted({float(p) for p in ps})
    data = df.where(F.col(x).isNotNull()).select(*by, F.col(x).cast("double").alias("__x"))
    eps = 2.0 / ACCURACY
    approx = data.groupBy(*by).agg(
        F.expr(f"percentile_approx(__x, {_numbers([max(0.0, p - eps) for p in ps])}, {ACCURACY})").alias("__lo"),
        F.expr(f"percentile_approx(__x, {_numbers([min(1.0, p + eps) for p in ps])}, {ACCURACY})").alias("__hi"),
    )
    if by:
        data = data.join(F.broadcast(approx), by)  # a row per group
        lo, hi = F.col("__lo"), F.col("__hi")
    else:
        row = approx.first()
        lo, hi = (row["__lo"], row["__hi"]) if row and row["__lo"] else ([], [])
    v = F.col("__x")
    # the brackets from above to reached hold the value
    placed = data.select(*by, "__x", _reached(v, lo, False).alias("__reached"), _reached(v, hi, True).alias("__above"))
    inside = F.when(F.col("__reached") > F.col("__above"), v)
    cells = placed.groupBy(*by, "__reached", "__above", inside.alias("__in")).agg(F.count(F.lit(1)).alias("__c"), F.min("__x").alias("__least"), F.max("__x").alias("__most"))
    group = Window.partitionBy(*by)
    upto = F.sum("__c").over(group.orderBy("__least").rowsBetween(Window.unboundedPreceding, 0))
    ranked = cells.withColumn("__n", F.sum("__c").over(group)).withColumn("__before", upto - F.col("__c"))
    # the places wanted: the rank below and the one above each quantile; brackets reach as far as the next value at least
    wanted = F.transform(F.array(*[F.lit(p) for p in ps]), lambda p: F.struct(p.alias("p"), ((F.col("__n") - 1) * p).alias("h")))
    held = lambda r: (r >= F.col("__before")) & (r < F.col("__before") + F.col("__c"))
    at = lambda r: F.when(held(r), F.when(r == F.col("__before"), F.col("__least")).otherwise(F.col("__most")))
    hits = F.filter(wanted, lambda t: held(F.floor(t["h"])) | held(F.ceil(t["h"])))
    found = ranked.select(*by, "__before", "__c", "__least", "__most", F.explode(hits).alias("__t")).select(
        *by, F.col("__t.p").alias("p"), F.col("__t.h").alias("__h"), at(F.floor("__t.h")).alias("__a"), at(F.ceil("__t.h")).alias("__b")
    )
    value = F.max("__a") + (F.max("__b") - F.max("__a")) * (F.max("__h") - F.floor(F.max("__h")))
    return found.groupBy(*by, "p").agg(value.alias("value"))


def threshold(df: DataFrame, x: str, p: float) -> float | None:
    """One quantile of the whole frame as a number for a pushed-down filter."""
    row = quantiles(df, x, [p]).first()
    return None if row is None else row["value"]


def quantile_table(df: DataFrame, columns: dict[str, list[float]]) -> dict[tuple[str, float], float]:
    """Quantiles of several columns by (column, p), the table that a set of run configurations shares."""
    return {(c, r["p"]): r["value"] for c, ps in columns.items() for r in quantiles(df, c, sorted(set(ps))).collect()}
