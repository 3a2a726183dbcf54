"""Registry of queries: a callable over a session and a folder of tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the function under its name, with SQL if it can be stated."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def master(spark: SparkSession, folder: str) -> DataFrame:
    return schema.master(spark, folder)


def r6(c: Column, name: str) -> Column:
    return F.round(c.cast("double"), 6).alias(name)


_DOUBLES = (
    "mean_word_length frac_alpha frac_digit frac_punctuation frac_uppercase frac_lines_terminal_punct frac_lines_bullet type_token_ratio stopword_fraction ngram_rep_2 ngram_rep_3"
    " ngram_rep_4 mean_line_length numeric_density question_density flesch_kincaid_grade flesch_reading_ease qr_educational_value qr_writing_style qr_required_expertise qr_facts_and_trivia"
    " pc_arc_easy pc_lambada textbook_quality ai_generated dclm_score"
).split()
#: The master frame in SQL: newest row of each key, missing values NULL (by their text, as isnan is folded by file statistics that leave NaN out).
M = (
    "WITH m AS (SELECT __shard_idx AS shard_idx, __doc_idx AS doc_idx, __in_train_pool AS in_train_pool, url, url_netloc, url_registered_domain AS domain, char_count, word_count, num_lines, "
    + ", ".join(f"CASE WHEN CAST({c} AS VARCHAR) = 'nan' THEN NULL ELSE {c} END AS {c}" for c in _DOUBLES)
    + ", CASE WHEN fwedu_rounded >= 0 THEN fwedu_rounded END AS fwedu_rounded, CASE WHEN topic BETWEEN 0 AND 23 THEN topic END AS topic, CASE WHEN format BETWEEN 0 AND 23 THEN format END AS format,"
    " cluster24, CASE WHEN token_count >= 0 THEN token_count END AS token_count, built_at"
    " FROM (SELECT *, row_number() OVER (PARTITION BY __shard_idx, __doc_idx ORDER BY built_at DESC NULLS LAST) AS rn FROM master WHERE __shard_idx IS NOT NULL AND __doc_idx IS NOT NULL) WHERE rn = 1)"
)
