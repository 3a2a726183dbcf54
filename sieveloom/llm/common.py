"""Helpers shared by the training-data operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir as shared_dir

#: Characters of text handled at once inside a Python worker; bounds its memory
#: whatever the Arrow batch holds.
CHUNK_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def least_hash(df: DataFrame, key: str, n: int) -> DataFrame:
    """``n`` rows at most, those of least hash of ``key`` (repeated and null keys by their order): a sample that every run and layout repeats.

    Rows are counted first, and only hashes below the share that is wanted, with
    a wide margin, are ordered: a task passes on few rows however many it has.
    """
    total = df.count()
    h = F.xxhash64(key)
    if total > 2 * n:
        share = min((n + 8 * n**0.5 + 64) / total, 1.0)
        df = df.where(h <= F.lit(min(int(-(2**63) + share * 2**64), 2**63 - 1)))
    return df.orderBy(h, key).limit(n)


def latest(df: DataFrame, keys: list[str], ts: str, values: list[str]) -> DataFrame:
    """One row per key with the values of its row of greatest ``ts``.

    ``max_by`` over fixed-width values aggregates by hash with a map-side
    combine, so a hot key costs one partial row per task.  Rows sharing key
    and timestamp are exact copies.  Keys with a null part are no keys and are
    dropped; a null timestamp is older than any other.
    """
    when: Column = F.coalesce(F.col(ts), F.timestamp_micros(F.lit(-(2**60))))
    known = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    return known.groupBy(*keys).agg(*[F.max_by(v, when).alias(v) for v in values])


def chunks(texts: list[str | None], chars: int = CHUNK_CHARS):
    """Yield (start, end) of runs of texts holding about ``chars`` characters, at least one text each."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > chars:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def arrow_map(df: DataFrame, columns: list[str], fn, schema: str) -> DataFrame:
    """``mapInArrow`` over some columns: ``fn(dict of lists) -> dict of lists or arrays`` per run of rows."""
    text = "text" if "text" in columns else None

    def run(batches):
        for b in batches:
            data = {c: b.column(i).to_pylist() for i, c in enumerate(columns)}
            n = b.num_rows
            for lo, hi in chunks(data[text]) if text else [(0, n)] * (n > 0):
                out = fn({c: v[lo:hi] for c, v in data.items()})
                yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))

    spark = df.sparkSession
    types = _arrow_types(spark, schema)
    return df.select(*columns).mapInArrow(run, schema)


def _arrow_types(spark: SparkSession, schema: str) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    del spark  # parsing DDL needs a session to be there
    return [to_arrow_type(f.dataType) for f in StructType.fromDDL(schema).fields]


def unclash(df: DataFrame, needed: list[str]) -> DataFrame:
    """Only the named columns, so that extra columns of an input can't clash with computed names."""
    return df.select(*[F.col(f"`{c}`") for c in needed])
