"""Functions for SQL: ``register_all(spark)`` makes them known by name."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


#: ``entropy_of_counts(array)``: natural-log entropy of an array of counts, zeros and NULLs skipped; NULL stays.
ENTROPY = """
CREATE OR REPLACE TEMPORARY FUNCTION entropy_of_counts(counts ARRAY<DOUBLE>) RETURNS DOUBLE RETURN
  aggregate(filter(counts, x -> x > 0), named_struct('t', 0D, 'l', 0D), (a, x) -> named_struct('t', a.t + x, 'l', a.l + x * ln(x)), a -> if(a.t > 0, ln(a.t) - a.l / a.t, 0D))
"""


@udtf(returnType="pos int, item string")
class NGrams:
    """``ngrams(text, n)``: word n-grams with their places."""

    def eval(self, text: str, n: int):
        words = (text or "").split()
        for i in range(len(words) - n + 1):
            yield i, " ".join(words[i : i + n])


def register_all(spark: SparkSession) -> list[str]:
    spark.sql(ENTROPY)
    spark.udtf.register("ngrams", NGrams)
    return ["entropy_of_counts", "ngrams"]


def shard_stem(index):
    return F.format_string("CC_shard_%08d_processed", index)
