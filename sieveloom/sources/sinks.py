"""Sinks: index sets, subsets of every data set, idempotent writes, manifests, merged results."""

from __future__ import annotations

import io
import json
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODES = {"skip": "ignore", "overwrite": "overwrite", "abort": "errorifexists"}


def write(df: DataFrame, path: str, fmt: str = "parquet", if_exists: str = "abort", by: list[str] = []) -> None:  # noqa: B006
    """Write once: ``skip`` keeps what is there, ``overwrite`` replaces it, ``abort`` fails."""
    w = df.write.mode(MODES[if_exists]).format(fmt)
    (w.option("header", "true") if fmt == "csv" else w).partitionBy(*by).save(path) if by else (w.option("header", "true") if fmt == "csv" else w).save(path)


def write_index(selected: DataFrame, path: str, if_exists: str = "abort") -> None:
    """Selected positions, sorted within shards, one folder per shard."""
    out = selected.select("shard_idx", "doc_idx").repartition("shard_idx").sortWithinPartitions("shard_idx", "doc_idx")
    write(out, path, if_exists=if_exists, by=["shard_idx"])


def write_subset(spark: SparkSession, selected: DataFrame, sources: dict[str, str], target: str, if_exists: str = "abort", formats: dict[str, str] | None = None) -> None:
    """Every data set (with shard and position) cut down to the selected rows, under the same name and in its own format.

    ``formats`` names ``jsonl_zst``, ``npy`` or ``npz`` sets; the others are
    Parquet.  Files of kept rows are laid out anew: positions are those of the
    selection, from 0 within each shard.
    """
    from .readers import register

    register(spark)
    keys = selected.select("shard_idx", "doc_idx").distinct()
    for name, path in sources.items():
        kind = (formats or {}).get(name, "parquet")
        rows = spark.read.format(kind).load(path)
        kept = rows.join(keys, ["shard_idx", "doc_idx"], "left_semi")
        if kind == "parquet":
            write(kept, f"{target}/{name}", if_exists=if_exists)
            continue
        if _there(f"{target}/{name}"):
            if if_exists == "abort":
                raise FileExistsError(f"{target}/{name}")
            if if_exists == "skip":
                continue
        # places of the kept rows within their shard: a shard is a file, its keys a bounded group
        at = keys.withColumn("__at", F.expr("row_number() OVER (PARTITION BY shard_idx ORDER BY doc_idx) - 1"))
        moved = kept.join(at, ["shard_idx", "doc_idx"]).withColumn("doc_idx", F.col("__at")).drop("__at")
        {"jsonl_zst": write_jsonl_zst, "npy": write_npy, "npz": write_npz}[kind](moved, f"{target}/{name}").collect()


def _files(path: str):
    """File system and path of a folder: any scheme that Arrow knows (hdfs, s3, gs), or a path that all executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _there(path: str) -> bool:
    from pyarrow import fs

    system, at = _files(path)
    return system.get_file_info(at).type != fs.FileType.NotFound


@contextmanager
def _placed(path: str):
    """A stream to a file that appears under its name when it is complete; a repeated or failed task leaves no half-written one."""
    import uuid

    system, at = _files(path)
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    held = f"{at}.{uuid.uuid4().hex}.part"
    try:
        with system.open_output_stream(held, compression=None) as out:
            yield out
        system.move(held, at)
    except BaseException:
        if system.get_file_info(held).is_file:
            system.delete_file(held)
        raise


def _per_shard(df: DataFrame, columns: list[str], save) -> DataFrame:
    """``(shard_idx, rows)`` of ``save(shard, rows in position order)`` for each shard; a shard is one file, so one task holds its rows."""

    def run(frames):
        held: list[pd.DataFrame] = []
        done = None
        for f in frames:
            for shard, part in f.groupby("shard_idx", sort=False):
                if done is not None and shard != done:
                    rows = pd.concat(held)
                    save(int(done), rows)
                    yield pd.DataFrame({"shard_idx": [int(done)], "rows": [len(rows)]})
                    held = []
                done = shard
                held.append(part)
        if held:
            rows = pd.concat(held)
            save(int(done), rows)
            yield pd.DataFrame({"shard_idx": [int(done)], "rows": [len(rows)]})

    keyed = df.where("shard_idx IS NOT NULL AND doc_idx IS NOT NULL")
    return keyed.select("shard_idx", "doc_idx", *columns).repartition("shard_idx").sortWithinPartitions("shard_idx", "doc_idx").mapInPandas(run, "shard_idx int, rows bigint")


def _stem(shard: int) -> str:
    return f"CC_shard_{shard:08d}_processed"


def write_jsonl_zst(df: DataFrame, folder: str) -> DataFrame:
    """Documents as ``.jsonl.zst``, a file per shard, in position order; returns (shard_idx, rows) as written.

    Positions that are not there become blank lines, so they keep their numbers.
    """

    def save(shard, rows):
        import zstandard

        with _placed(f"{folder}/{_stem(shard)}.jsonl.zst") as raw, zstandard.ZstdCompressor().stream_writer(raw, closefd=False) as out:
            at = 0
            for doc, url, text in zip(rows["doc_idx"].tolist(), rows["url"], rows["text"]):
                out.write(b"\n" * (doc - at) + (json.dumps({"url": url, "text": text}, ensure_ascii=False) + "\n").encode())
                at = doc + 1

    return _per_shard(df, ["url", "text"], save)


def _laid_out(rows: pd.DataFrame, column: str) -> np.ndarray:
    """Values at their positions, NaN between; arrays of one value as a one-dimensional array."""
    values = [np.atleast_1d(np.asarray(v if v is not None else [np.nan], float)) for v in rows[column]]
    width = max(map(len, values))
    out = np.full((int(rows["doc_idx"].max()) + 1, width), np.nan)
    for at, v in zip(rows["doc_idx"], values):
        out[at, : len(v)] = v
    return out[:, 0] if width == 1 else out


def write_npy(df: DataFrame, folder: str, value: str = "value") -> DataFrame:
    """Numbers or arrays of numbers as ``.npy``, a file per shard, NaN at positions that are not there; returns (shard_idx, rows)."""

    def save(shard, rows):
        with _placed(f"{folder}/{_stem(shard)}.npy") as out:
            held = io.BytesIO()
            np.save(held, _laid_out(rows, value))
            out.write(held.getvalue())

    return _per_shard(df, [value], save)


def write_npz(df: DataFrame, folder: str) -> DataFrame:
    """``(shard_idx, name, doc_idx, value)`` as compressed ``.npz``, a file per shard with an array per name; returns (shard_idx, rows)."""

    def save(shard, rows):
        held = io.BytesIO()
        np.savez_compressed(held, **{str(n): _laid_out(part, "value") for n, part in rows.groupby("name")})
        with _placed(f"{folder}/{_stem(shard)}.npz") as out:
            out.write(held.getvalue())

    return _per_shard(df, ["name", "value"], save)


def write_mixes(mixes: DataFrame, folder: str) -> int:
    """Every mix of ``(mix, domain, weight)`` as ``mix<i>.json``, weights keyed by domain; a few hundred small files, written by the driver."""
    by: dict[int, dict] = {}
    for r in mixes.orderBy("mix", "domain").collect():
        by.setdefault(r["mix"], {})[str(r["domain"])] = r["weight"]
    for i, weights in by.items():
        with _placed(f"{folder}/mix{i}.json") as out:
            out.write(json.dumps(weights, indent=2).encode())
    return len(by)


def write_counted(df: DataFrame, path: str, shard: str = "shard_idx", if_exists: str = "abort", **counters) -> tuple[dict, DataFrame]:
    """Writes once and counts on the way: the whole frame's ``counters`` (named aggregate columns, observed while writing), and rows by shard as written."""
    from pyspark.sql import Observation

    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in counters.items()])
    fresh = if_exists == "overwrite" or not _there(path)
    write(counted, path, if_exists=if_exists)
    by = df.sparkSession.read.parquet(path).groupBy(shard).agg(F.count("*").alias("rows"))
    return (dict(seen.get) if fresh else {}), by


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New records merged into old ones: new values win, missing keys are created, absent values keep the old."""
    both = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    names = list(dict.fromkeys([*old.columns, *new.columns]))
    pick = lambda c: F.coalesce(*[F.col(f"{s}.{c}") for s, df in (("n", new), ("o", old)) if c in df.columns]).alias(c)
    return both.select(*[pick(c) for c in names])


#: Rows of a report at most.
REPORTED = 1_000


def report(df: DataFrame, path: str, title: str, best: dict[str, str] = {}, digits: int = 4) -> str:  # noqa: B006
    """A small table as Markdown, in the frame's order; of the columns in ``best`` (``min`` or ``max``) the best value is bold and the best and worst rows are named.

    A table of more than REPORTED rows is an error: a report is read by people.
    """
    rows = df.limit(REPORTED + 1).collect()
    if len(rows) > REPORTED:
        raise ValueError(f"more than {REPORTED} rows to report")
    kinds = dict(df.dtypes)
    numeric = {c for c in df.columns if kinds[c] in ("double", "float", "int", "bigint", "smallint", "tinyint") or kinds[c].startswith("decimal")}
    shown = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else str(v).replace("|", "\\|")
    top = {c: (min if how == "min" else max)(known) for c, how in best.items() if (known := [r[c] for r in rows if r[c] is not None])}
    out = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "|".join("---:" if c in numeric else "---" for c in df.columns) + "|"]
    out += ["| " + " | ".join(f"**{shown(r[c])}**" if c in top and r[c] == top[c] else shown(r[c]) for c in df.columns) + " |" for r in rows]
    for c, how in best.items():
        known = [r for r in rows if r[c] is not None]
        for word, pick in (("Best", how), ("Worst", "max" if how == "min" else "min")):
            if known:
                r = (min if pick == "min" else max)(known, key=lambda r: r[c])  # noqa: B023
                out += ["", f"{word} {c}: {shown(r[df.columns[0]])} at {shown(r[c])}"]
    text = "\n".join(out) + "\n"
    with _placed(path) as f:
        f.write(text.encode())
    return text


def manifest(path: str, **options) -> bool:
    """Options as sorted ``key: value`` lines; the first write wins. True if written."""
    if _there(path):
        return False
    with _placed(path) as out:
        out.write("".join(f"{k}: {json.dumps(v)}\n" for k, v in sorted(options.items())).encode())
    return True
