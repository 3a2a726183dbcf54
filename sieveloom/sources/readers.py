"""Sources: NumPy files, zstd JSON lines, distributions, taxonomies, result folders."""

from __future__ import annotations

import io
import json
import re
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schema

STEM = re.compile(r"CC_shard_(\d{8})_processed")


def shard_index(path: str) -> int | None:
    """The shard number in a file name, None if it has none."""
    m = STEM.search(path)
    return int(m[1]) if m else None


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Files(DataSourceReader):
    """One partition per file of a folder or pattern; ``read`` yields rows of one file."""

    suffix = ""

    def __init__(self, options):
        path = Path(options["path"])
        found = sorted(path.rglob(f"*{self.suffix}")) if path.is_dir() else sorted(path.parent.glob(path.name))
        self.paths, self.options = [str(p) for p in found], options

    def partitions(self):
        return [_File(p) for p in self.paths] or [_File("")]


class _JsonLines(_Files):
    suffix = ".jsonl.zst"

    def read(self, partition):
        if not partition.path:
            return
        import zstandard

        most, tolerant = int(self.options.get("max_docs", -1)), self.options.get("tolerant", "false") == "true"
        with open(partition.path, "rb") as raw, zstandard.ZstdDecompressor().stream_reader(raw) as stream:
            for i, line in enumerate(io.TextIOWrapper(stream, "utf-8", errors="replace")):
                if 0 <= most <= i:
                    break
                if not line.strip():
                    continue  # blank lines count but yield nothing
                try:
                    o = json.loads(line)
                except ValueError:
                    if tolerant:
                        continue
                    raise
                yield shard_index(partition.path), i, o.get("url"), o.get("text")


class JsonLinesZst(DataSource):
    """``spark.read.format("jsonl_zst")``: documents keyed by shard and physical line number. Options ``max_docs``, ``tolerant``."""

    @classmethod
    def name(cls):
        return "jsonl_zst"

    def schema(self):
        return schema.DOCUMENTS

    def reader(self, schema):
        return _JsonLines(self.options)


class _Npy(_Files):
    suffix = ".npy"

    def read(self, partition):
        if not partition.path:
            return
        a = np.load(partition.path, mmap_mode="r", allow_pickle=False)
        for i in range(len(a)):
            v = a[i]
            yield shard_index(partition.path), i, [float(x) for x in np.atleast_1d(v)]


class Npy(DataSource):
    """``spark.read.format("npy")``: rows of one- or two-dimensional arrays as ``(shard_idx, doc_idx, value array<double>)``; NaN stays for the caller's ``nan_to_null``."""

    @classmethod
    def name(cls):
        return "npy"

    def schema(self):
        return "shard_idx int, doc_idx int, value array<double>"

    def reader(self, schema):
        return _Npy(self.options)


class _Npz(_Files):
    suffix = ".npz"

    def read(self, partition):
        if not partition.path:
            return
        with np.load(partition.path, allow_pickle=False) as z:
            for name in z.files:
                a = z[name]
                for i in range(len(a) if a.ndim else 1):
                    yield shard_index(partition.path), name, i, [float(x) for x in np.atleast_1d(a[i] if a.ndim else a).ravel()]


class Npz(DataSource):
    """``spark.read.format("npz")``: every numeric array of the containers, long: ``(shard_idx, name, doc_idx, value)``."""

    @classmethod
    def name(cls):
        return "npz"

    def schema(self):
        return "shard_idx int, name string, doc_idx int, value array<double>"

    def reader(self, schema):
        return _Npz(self.options)


def register(spark: SparkSession) -> None:
    for source in (JsonLinesZst, Npy, Npz):
        spark.dataSource.register(source)


def scalar(df: DataFrame, name: str) -> DataFrame:
    """A one-dimensional annotation as a column, NaN as NULL."""
    return df.select("shard_idx", "doc_idx", F.nullif(F.get("value", F.lit(0)), F.lit(float("nan"))).alias(name))


def named(df: DataFrame, names: list[str]) -> DataFrame:
    """A two-dimensional annotation as one column per name."""
    return df.select("shard_idx", "doc_idx", *[F.nullif(F.get("value", F.lit(i)), F.lit(float("nan"))).alias(n) for i, n in enumerate(names)])


def distribution(spark: SparkSession, path: str) -> DataFrame:
    """``(domain array<int>, weight, tokens, documents)`` of a JSON list; single labels become arrays of one."""
    raw = spark.read.schema("domain string, weight double, tokens bigint, documents bigint").json(path, multiLine=True)
    listed = F.when(F.col("domain").startswith("["), F.from_json("domain", "array<int>")).otherwise(F.array(F.try_to_number("domain", F.lit("999999999")).cast("int")))
    return raw.select(listed.alias("domain"), "weight", "tokens", "documents")


def taxonomy(text: str) -> list[tuple[int, str, list[str]]]:
    """``(code, choice, lines of its description)`` of a taxonomy file: a ``choices:`` list of block entries, each ``- name: description``.

    Reads the small part of YAML that such files use; they are a few dozen entries and read on the driver.
    """
    out, inside = [], False
    for line in text.splitlines():
        if re.match(r"choices\s*:", line):
            inside = True
        elif inside and re.match(r"\S", line) and not line.startswith("-"):
            break
        elif inside and (m := re.match(r"\s*-\s+(?:\"([^\"]*)\"|'([^']*)'|\|?-?\s*(.*))\s*$", line)):
            out.append((len(out), (m[1] or m[2] or m[3] or "").strip(), []))
        elif inside and out and line.strip():
            code, name, more = out[-1]
            out[-1] = (code, name or line.strip(), more + ([line.strip()] if name else []))
    return out


def results(spark: SparkSession, pattern: str, kind: str = "run_id int, val_loss double") -> DataFrame:
    """All result records of a pattern, those without a loss left out."""
    return spark.read.schema(kind).json(pattern, multiLine=True).where("val_loss IS NOT NULL")


def flatten_config(df: DataFrame, key: str, maps: dict[str, str]) -> DataFrame:
    """Long ``(key, name, value)`` of map columns, names prefixed (``cfg.``, ``sum.``), those starting with ``_`` dropped."""
    out = None
    for column, prefix in maps.items():
        kept = F.map_filter(column, lambda k, v: ~k.startswith("_"))
        one = df.select(key, F.explode(kept).alias("name", "value")).withColumn("name", F.concat(F.lit(prefix), "name"))
        out = one if out is None else out.unionByName(one)
    return out


def availability(spark: SparkSession, folders: dict[str, str], shards: list[int]) -> DataFrame:
    """``(folder, present, missing)``: how many of the shards each folder has, and which are absent; names alone are listed."""
    wanted = spark.createDataFrame([(s,) for s in shards], "shard_idx int")
    out = None
    for name, path in folders.items():
        have = [s for p in Path(path).glob("*") if (s := shard_index(p.name)) is not None]
        rows = spark.createDataFrame([(s,) for s in have], "shard_idx int").distinct().withColumn("hit", F.lit(1))
        one = wanted.join(rows, "shard_idx", "left").agg(F.lit(name).alias("folder"), F.count("hit").alias("present"), F.array_sort(F.collect_list(F.when(F.col("hit").isNull(), F.col("shard_idx")))).alias("missing"))
        out = one if out is None else out.unionByName(one)
    return out


def locate(rows: DataFrame, at: str, sizes: DataFrame, shard: str, n: str) -> DataFrame:
    """``rows`` with ``shard`` and ``local`` of the global row number ``at``, over shards laid end to end in order; NULL beyond the last.

    ``sizes`` has a row per shard, its rows with a document at least; the ends
    are summed on the driver (tens of thousands of shards) and looked up by a
    range join with the broadcast table.
    """
    spark = rows.sparkSession
    listed = sizes.orderBy(shard).select(shard, n).collect()
    ends = np.cumsum([r[1] for r in listed])
    known = spark.createDataFrame([(r[0], int(e - r[1]), int(e)) for r, e in zip(listed, ends)], "shard int, __start bigint, __stop bigint")
    # a row falls into one bucket of global numbers, a shard into those it covers: an equi-join, not a comparison with every shard
    width = max(int(np.ceil(ends[-1] / max(len(listed), 1))), 1) if len(ends) else 1
    spans = known.where("__stop > __start").withColumn("__b", F.explode(F.sequence(F.floor(F.col("__start") / width), F.floor((F.col("__stop") - 1) / width))))
    hit = (F.col("__b") == F.floor(F.col(at) / width)) & (F.col(at) >= F.col("__start")) & (F.col(at) < F.col("__stop"))
    return rows.join(F.broadcast(spans), hit, "left").select(*rows.columns, "shard", (F.col(at) - F.col("__start")).cast("bigint").alias("local"))


def prompt_config(text: str) -> dict:
    """A prompt file: templates, choices, demonstrations and labels by name.

    Reads the part of YAML that such files use: names with a value on their
    line, a block after ``|`` or ``>``, a list of values or of such maps.
    """
    lines = [line.rstrip() for line in text.splitlines()]
    indent = lambda s: len(s) - len(s.lstrip(" "))

    def scalar(v: str):
        v = v.strip()
        if len(v) > 1 and v[0] == v[-1] and v[0] in "'\"":
            return v[1:-1]
        if v in ("", "null", "~"):
            return None
        if v in ("true", "false"):
            return v == "true"
        return int(v) if re.fullmatch(r"-?\d+", v) else v

    def block(i: int, outer: int, fold: bool) -> tuple[str, int]:
        held = []
        while i < len(lines) and (not lines[i] or indent(lines[i]) > outer):
            held.append(lines[i])
            i += 1
        while held and not held[-1]:
            held.pop()
        margin = min((indent(x) for x in held if x), default=0)
        return (" " if fold else "\n").join(x[margin:] for x in held), i

    def value(v: str, i: int, outer: int):
        if re.fullmatch(r"[|>][+-]?", v.strip()):
            return block(i, outer, v.strip()[0] == ">")
        return scalar(v), i

    def parse(i: int, least: int):
        """The map or list that begins at line i, indented by ``least`` or more."""
        while i < len(lines) and (not lines[i] or lines[i].lstrip().startswith("#")):
            i += 1
        if i >= len(lines) or indent(lines[i]) < least:
            return None, i
        own = indent(lines[i])
        out = [] if lines[i].lstrip().startswith("- ") or lines[i].strip() == "-" else {}
        while i < len(lines):
            line = lines[i]
            if not line or line.lstrip().startswith("#"):
                i += 1
                continue
            if indent(line) < own or (indent(line) == own and isinstance(out, list) != bool(re.match(r"\s*-(?:\s|$)", line))):
                break
            if isinstance(out, list):
                rest = line.lstrip()[1:].strip()
                if not rest:
                    item, i = parse(i + 1, own + 1)
                elif re.match(r"[A-Za-z_]\w*:(?:\s|$)", rest):
                    lines[i] = " " * (own + 2) + rest
                    item, i = parse(i, own + 1)
                else:
                    item, i = value(rest, i + 1, own)
                out.append(item)
                continue
            name, rest = line.strip().split(":", 1)
            i += 1
            if rest.strip():
                out[name], i = value(rest, i, own)
            else:
                listed = i < len(lines) and indent(lines[i]) == own and re.match(r"\s*-(?:\s|$)", lines[i])
                out[name], i = parse(i, own if listed else own + 1)
        return out, i

    return parse(0, 0)[0] or {}
