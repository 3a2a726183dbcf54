"""Schemas of the data model and the rules that make missing values NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ["shard_idx", "doc_idx"]
# Schemas as DDL: they are needed before there is a session to parse them.
DOCUMENTS = "shard_idx int, doc_idx int, url string, text string"
ANNOTATIONS = "shard_idx int, doc_idx int, topic int, format int, cluster24 int, dclm_score float, fwedu_score float, fwedu_rounded int, token_count int"
DISTRIBUTION = "domain array<int>, weight double, tokens bigint, documents bigint"
# Fixed value: fields of a run configuration, as the files name them.
RUN_CONFIG = (
    "run_id int, type string, feature string, percentile double, direction string, top_pct double, topic int, threshold int, seed int, frac double,"
    " restrict_feature string, restrict_top_pct double, dclm_top_pct double, selectors array<struct<feature: string, percentile: double, direction: string>>,"
    " features array<string>, weights array<double>, means array<double>, stds array<double>"
)
#: Integer columns in which -1 stands for a missing value.
MISSING_IS_MINUS_ONE = ("fwedu_rounded", "token_count")
# Columns of the master frame.
HEURISTICS = ("char_count", "word_count", "mean_word_length", "frac_alpha", "frac_digit", "frac_punctuation", "frac_uppercase", "frac_lines_terminal_punct", "frac_lines_bullet", "type_token_ratio", "stopword_fraction", "ngram_rep_2", "ngram_rep_3", "ngram_rep_4", "num_lines", "mean_line_length")
SCORES = ("qr_educational_value", "qr_writing_style", "qr_required_expertise", "qr_facts_and_trivia", "pc_arc_easy", "pc_lambada", "textbook_quality", "ai_generated", "dclm_score", "fwedu_rounded")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Every NaN of a float or double column as NULL: then comparisons drop it, aggregates skip it, sorts can sink it."""
    return df.select(*[F.nullif(F.col(f"`{f.name}`"), F.lit(float("nan"))).alias(f.name) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.col(f"`{f.name}`") for f in df.schema.fields])


def minus_one_to_null(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in MISSING_IS_MINUS_ONE if c in df.columns})


def newest(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """The row of greatest ``ts`` of each key; ``row_number <= 1`` lets every task keep one row per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col(ts).desc_nulls_last())
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def master(spark: SparkSession, folder: str) -> DataFrame:
    """The master frame, one row per key: newest rows, keys renamed, missing values NULL, labels out of range NULL."""
    df = newest(spark.read.parquet(f"{folder}/master.parquet").where("__shard_idx IS NOT NULL AND __doc_idx IS NOT NULL"), ["__shard_idx", "__doc_idx"], "built_at")
    df = minus_one_to_null(nan_to_null(df)).withColumnsRenamed({"__shard_idx": "shard_idx", "__doc_idx": "doc_idx", "__in_train_pool": "in_train_pool", "url_registered_domain": "domain"})
    return df.withColumns({c: F.when(F.col(c).between(0, 23), F.col(c)) for c in ("topic", "format")})


def existing(df: DataFrame, columns) -> list[str]:
    """The wanted columns that a frame has, in the order wanted."""
    return [c for c in columns if c in df.columns]


def order_key(*parts: Column) -> list[Column]:
    """Total order by key for breaking ties."""
    return [p.asc_nulls_last() for p in parts]
