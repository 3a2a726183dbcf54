"""Mixing sources to target weights by nested hash thresholds, without sorting.

Every record has a fixed hash of 60 bits, read as digits of ``WIDTHS`` bits.
The tokens of a domain are summed by the first digit; the budget of a mix in
the domain falls into one bucket, of which alone the next digit is summed, and
the last digit tells the few records of a bucket of the second level apart.  A
record is in if its hash lies below the threshold found.  The first histogram
has a fixed size, however many records or how hot a domain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir

#: Bits of the digits: 4096 buckets, 4096 in the boundary bucket, and the records of one of these.
WIDTHS = (12, 12, 36)


def _below(level: int) -> int:
    """Bits after the digit of a level."""
    return sum(WIDTHS[level + 1 :])


def _digit(h: Column, level: int) -> Column:
    return F.shiftright(h, _below(level)).bitwiseAND(F.lit((1 << WIDTHS[level]) - 1).cast("bigint"))


def hashed(records: DataFrame, keys: list[str]) -> DataFrame:
    """``records(domain, tokens, keys...)`` with ``h``, a hash of the keys from 0 to 2**60 - 1: the first 60 bits of the md5 of the keys, which every engine repeats."""
    return records.withColumn("h", F.conv(F.substring(F.md5(F.concat_ws("-", *keys)), 1, 15), 16, 10).cast("bigint"))


def plan(records: DataFrame, mixes: DataFrame) -> DataFrame:
    """What each mix takes of each domain, from ``hashed`` records and ``mixes(mix_id, domain, weight, max_repeats, total_share)``.

    The target of a domain is ``weight / sum of the mix's weights * total_share
    * tokens of the corpus``.  All records are taken ``whole_copies`` times and
    those with ``h < threshold`` once more, so that the tokens taken are the
    most that don't exceed the target; ``short`` holds where even
    ``max_repeats`` copies of every record stay below the target, and then they
    are all taken.  Columns: mix_id, domain, size, target, whole_copies,
    threshold, reached, target_share, short, actual_share.  Null or negative
    weights count as 0, null repeats as 0; a domain without records has size 0
    and is short unless its target is 0; repeated rows of a mix stay repeated.
    """
    shared_dir(records.sparkSession)
    corpus = records.groupBy("domain", _digit(F.col("h"), 0).alias("b")).agg(F.sum("tokens").alias("t")).checkpoint()
    sizes = corpus.groupBy("domain").agg(F.sum("t").alias("size"))
    in_mix = Window.partitionBy("mix_id")
    corpus_size = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("corpus"))  # one row
    weight = F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))
    goal = (
        mixes.select("mix_id", "domain", weight.alias("weight"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"), F.coalesce("total_share", F.lit(0.0)).alias("total_share"))
        .withColumn("row", F.row_number().over(Window.partitionBy("mix_id", "domain").orderBy("weight")))
        .join(F.broadcast(sizes), "domain", "left")
        .join(F.broadcast(corpus_size))
        .withColumn("size", F.coalesce("size", F.lit(0)))
        .withColumn("target_share", F.coalesce(F.try_divide("weight", F.sum("weight").over(in_mix)), F.lit(0.0)))
        .withColumn("target", F.col("target_share") * F.col("total_share") * F.col("corpus"))
        .withColumn("short", F.col("size") * F.col("max_repeats") < F.col("target"))
        .withColumn("whole_copies", F.when(F.col("short"), F.col("max_repeats")).otherwise(F.coalesce(F.floor(F.try_divide("target", "size")), F.lit(0))).cast("int"))
        .withColumn("budget", F.when(F.col("short"), F.lit(0.0)).otherwise(F.col("target") - F.col("whole_copies") * F.col("size")))
        .withColumn("below", F.lit(0).cast("bigint"))
        .withColumn("threshold", F.lit(0).cast("bigint"))
    ).checkpoint()
    key = ["mix_id", "domain", "row"]
    inside = records
    for level in range(len(WIDTHS)):
        edge = F.broadcast(goal.where("budget > 0").select(*key, "budget", "below", F.shiftright("threshold", _below(level) + WIDTHS[level]).alias("prefix")))
        if level == 0:
            histogram = corpus.join(edge, "domain")
        else:
            # only records of a boundary bucket are looked at again
            inside = inside.withColumn("prefix", F.shiftright("h", _below(level) + WIDTHS[level]))
            inside = inside.join(F.broadcast(goal.where("budget > 0").select("domain", F.shiftright("threshold", _below(level) + WIDTHS[level]).alias("prefix")).distinct()), ["domain", "prefix"], "left_semi").select("domain", "prefix", "h", "tokens").checkpoint()
            histogram = inside.join(edge, ["domain", "prefix"]).groupBy(*key, "budget", "below", _digit(F.col("h"), level).alias("b")).agg(F.sum("tokens").alias("t"))
        run = F.sum("t").over(Window.partitionBy(*key).orderBy("b").rowsBetween(Window.unboundedPreceding, 0)) + F.col("below")
        cut = histogram.withColumn("run", run).groupBy(*key).agg(F.max(F.when(F.col("run") <= F.col("budget"), F.col("run"))).alias("more"), F.min(F.when(F.col("run") > F.col("budget"), F.col("b"))).alias("edge"))
        goal = (
            goal.join(F.broadcast(cut), key, "left")
            .withColumn("below", F.coalesce("more", "below"))
            .withColumn("threshold", F.col("threshold") + F.shiftleft(F.coalesce("edge", F.lit(0).cast("bigint")), _below(level)))
            .drop("more", "edge")
        ).checkpoint()
    reached = F.col("whole_copies") * F.col("size") + F.col("below")
    return goal.select("mix_id", "domain", "size", "target", "max_repeats", "whole_copies", "threshold", reached.alias("reached"), "target_share", "short").withColumn("actual_share", F.coalesce(F.try_divide("reached", F.sum("reached").over(in_mix)), F.lit(0.0)))


def copies(records: DataFrame, planned: DataFrame) -> DataFrame:
    """``hashed`` records with ``mix_id`` and ``n_copies >= 1``, one row per record and mix that takes it.

    The plan has one row per mix and domain, a fixed table, and is broadcast.
    """
    n = F.col("whole_copies") + (F.col("h") < F.col("threshold")).cast("int")
    return records.join(F.broadcast(planned.select("mix_id", "domain", "whole_copies", "threshold")), "domain").withColumn("n_copies", n).where("n_copies > 0").drop("whole_copies", "threshold", "h")
