"""Sources, sinks and streams: round trips over small files."""

import json

import numpy as np
import zstandard
from pyspark.sql import functions as F

from sieveloom.sources import readers, sinks
from sieveloom.streaming import streams


def test_json_lines(spark, tmp_path):
    readers.register(spark)
    lines = [json.dumps({"text": "a", "url": "u"}), "", json.dumps({"text": None}), "{broken", json.dumps({"text": "z"})]
    (tmp_path / "CC_shard_00000007_processed.jsonl.zst").write_bytes(zstandard.compress("\n".join(lines).encode()))
    df = spark.read.format("jsonl_zst").option("tolerant", "true").load(str(tmp_path))
    assert sorted(map(tuple, df.collect())) == [(7, 0, "u", "a"), (7, 2, None, None), (7, 4, None, "z")]
    assert spark.read.format("jsonl_zst").option("max_docs", "2").load(str(tmp_path)).count() == 1


def test_numpy(spark, tmp_path):
    readers.register(spark)
    np.save(tmp_path / "CC_shard_00000003_processed.npy", np.array([[1.0, 2.0], [np.nan, 4.0]]))
    df = spark.read.format("npy").load(str(tmp_path))
    assert sorted(map(tuple, readers.named(df, ["a", "b"]).collect()), key=str) == [(3, 0, 1.0, 2.0), (3, 1, None, 4.0)]
    np.savez(tmp_path / "x.npz", k=np.arange(3))
    assert spark.read.format("npz").load(str(tmp_path)).count() == 3


def test_subset_and_lines_round_trip(spark, tmp_path):
    readers.register(spark)
    docs = spark.createDataFrame([(1, 0, "u", "a\nb"), (1, 3, None, "ü"), (2, 1, "v", None)], "shard_idx int, doc_idx int, url string, text string")
    assert sorted(map(tuple, sinks.write_jsonl_zst(docs, str(tmp_path / "z")).collect())) == [(1, 2), (2, 1)]
    back = spark.read.format("jsonl_zst").load(str(tmp_path / "z"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
    sinks.write(docs, str(tmp_path / "docs"))
    sinks.write(docs.limit(0), str(tmp_path / "docs"), if_exists="skip")
    sinks.write_subset(spark, docs.where("doc_idx = 3"), {"docs": str(tmp_path / "docs")}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/docs")).count() == 1
    sinks.write_index(docs, str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index")).count() == 3
    assert sinks.manifest(str(tmp_path / "m/args.yaml"), a=1) and not sinks.manifest(str(tmp_path / "m/args.yaml"), a=2)


def test_distribution_taxonomy_results(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([{"domain": 3, "weight": 0.25}, {"domain": [1, 2], "weight": 0.75}]))
    assert sorted((r["domain"], r["weight"]) for r in readers.distribution(spark, str(tmp_path / "d.json")).collect()) == [([1, 2], 0.75), ([3], 0.25)]
    assert [x[1] for x in readers.taxonomy("template: x\nchoices:\n- Art\n- 'Law'\ndemos: []\n")] == ["Art", "Law"]
    for i, loss in enumerate([4.2, None]):
        (tmp_path / f"run_{i}.json").write_text(json.dumps({"run_id": i, "val_loss": loss}))
    assert readers.results(spark, str(tmp_path / "run_*.json")).count() == 1
    a = readers.availability(spark, {"x": str(tmp_path)}, [1, 2]).first()
    assert (a["present"], a["missing"]) == (0, [1, 2])
    m = spark.createDataFrame([(1, {"lr": "1", "_x": "2"})], "id int, cfg map<string, string>")
    assert [tuple(r) for r in readers.flatten_config(m, "id", {"cfg": "cfg."}).collect()] == [(1, "cfg.lr", "1")]


def test_streams(spark, tmp_path):
    docs = spark.createDataFrame([(i, "word " * i, i % 2, i) for i in range(1, 9)], "doc_id int, text string, domain int, tokens int")
    docs.limit(4).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        q = streams.resume(streams.features(streams.documents(spark, str(tmp_path / "in"), docs.schema)), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4  # a second run does nothing again
    streams.running_statistics(streams.documents(spark, str(tmp_path / "in"), docs.schema), "domain", "tokens", str(tmp_path / "st"), str(tmp_path / "cp2")).awaitTermination()
    s = streams.statistics(spark, str(tmp_path / "st"), "domain")
    assert s.agg(F.sum("documents")).first()[0] == 4 and abs(s.agg(F.sum("weight")).first()[0] - 1) < 1e-9


def test_windows(spark, data):
    ev = spark.read.parquet(f"{data}/events.parquet")
    q = streams.windowed(spark.readStream.schema(ev.schema).parquet(f"{data}/events.parquet*")).writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT count(*) FROM w").first()[0] > 0


def test_subset_in_the_formats_of_the_sources(spark, tmp_path):
    readers.register(spark)
    docs = spark.createDataFrame([(1, 0, "u", "a"), (1, 3, None, "b"), (1, 5, "w", "c"), (2, 1, "v", None)], "shard_idx int, doc_idx int, url string, text string")
    numbers = spark.createDataFrame([(1, 0, [1.0]), (1, 3, [2.0]), (1, 5, None), (2, 1, [4.0])], "shard_idx int, doc_idx int, value array<double>")
    arrays = spark.createDataFrame([(1, "a", 0, [1.0, 2.0]), (1, "a", 3, [3.0, 4.0]), (1, "b", 3, [9.0])], "shard_idx int, name string, doc_idx int, value array<double>")
    assert sorted(map(tuple, sinks.write_jsonl_zst(docs, str(tmp_path / "z")).collect())) == [(1, 3), (2, 1)]
    assert sorted(map(tuple, sinks.write_npy(numbers, str(tmp_path / "n")).collect())) == [(1, 3), (2, 1)]
    sinks.write_npz(arrays, str(tmp_path / "c")).collect()
    a = np.load(tmp_path / "n/CC_shard_00000001_processed.npy")
    assert a.shape == (6,) and a[3] == 2 and np.isnan(a[1]) and np.isnan(a[5])
    with np.load(tmp_path / "c/CC_shard_00000001_processed.npz") as z:
        assert z["a"].shape == (4, 2) and z["b"][3] == 9
    assert not list(tmp_path.rglob("*.part"))
    chosen = docs.where("doc_idx >= 3")
    sets = {"z": str(tmp_path / "z"), "n": str(tmp_path / "n"), "c": str(tmp_path / "c")}
    kinds = {"z": "jsonl_zst", "n": "npy", "c": "npz"}
    for _ in range(2):
        sinks.write_subset(spark, chosen, sets, str(tmp_path / "out"), "skip", kinds)
    assert sorted(map(tuple, spark.read.format("jsonl_zst").load(str(tmp_path / "out/z")).collect()), key=str) == [(1, 0, None, "b"), (1, 1, "w", "c")]
    assert [r["value"][0] for r in spark.read.format("npy").load(str(tmp_path / "out/n")).orderBy("doc_idx").collect()][0] == 2.0
    assert {(r["name"], r["doc_idx"]): r["value"] for r in spark.read.format("npz").load(str(tmp_path / "out/c")).collect()} == {("a", 0): [3.0, 4.0], ("b", 0): [9.0]}


def test_mixes_and_counters(spark, tmp_path):
    mixes = spark.createDataFrame([(0, 3, 0.5), (0, 1, 0.5), (1, 1, 1.0)], "mix int, domain int, weight double")
    assert sinks.write_mixes(mixes, str(tmp_path / "mixes")) == 2
    assert json.loads((tmp_path / "mixes/mix0.json").read_text()) == {"1": 0.5, "3": 0.5}
    rows = spark.createDataFrame([(1, "a"), (1, None), (2, "b")], "shard_idx int, text string")
    seen, by = sinks.write_counted(rows, str(tmp_path / "counted"), empty=F.count(F.when(F.col("text").isNull(), 1)))
    assert seen == {"rows": 3, "empty": 1} and sorted(map(tuple, by.collect())) == [(1, 2), (2, 1)]
    assert sinks.write_counted(rows.limit(0), str(tmp_path / "counted"), if_exists="skip")[1].count() == 2


def test_prompt_files():
    text = """
# a prompt
system_template: "You are: kind"
template: |
  {text}

  Pick one: {choices}
randomize_seed: 42
randomize_choices: false
choices:
- Art
- 'Law'
- |
  Health
  and sport
demonstrations:
  - text: >
      one
      two
    choice: Law
  -
    text: three
    choice: Art
labels: ~
"""
    c = readers.prompt_config(text)
    assert c["system_template"] == "You are: kind" and c["template"] == "{text}\n\nPick one: {choices}" and c["randomize_seed"] == 42 and c["randomize_choices"] is False and c["labels"] is None
    assert c["choices"] == ["Art", "Law", "Health\nand sport"]
    assert c["demonstrations"] == [{"text": "one two", "choice": "Law"}, {"text": "three", "choice": "Art"}]
    assert readers.prompt_config("") == {}


def test_locate(spark):
    sizes = spark.createDataFrame([(0, 3), (4, 1), (7, 5)], "shard_idx int, n bigint")
    got = {r["id"]: (r["shard"], r["local"]) for r in readers.locate(spark.range(11), "id", sizes, "shard_idx", "n").collect()}
    lengths = [(0, 0), (0, 1), (0, 2), (4, 0), *((7, i) for i in range(5))]
    assert [got[i] for i in range(9)] == lengths and got[9] == got[10] == (None, None)
    assert readers.locate(spark.range(2), "id", sizes.limit(0), "shard_idx", "n").where("shard IS NULL").count() == 2


def test_report(spark, tmp_path):
    df = spark.createDataFrame([("A|x", 4.25, 1200), ("B", 4.1, None), ("C", None, 7)], "run string, loss double, n bigint")
    text = sinks.report(df, str(tmp_path / "r/table.md"), "Runs", {"loss": "min"}, 2)
    assert text == (tmp_path / "r/table.md").read_text() and "| B | **4.10** |  |" in text and "| A\\|x | 4.25 | 1,200 |" in text
    assert "Best loss: B at 4.10" in text and "Worst loss: A\\|x at 4.25" in text and "|---|---:|---:|" in text
    assert sinks.report(df.limit(0), str(tmp_path / "e.md"), "None", {"loss": "min"}).count("\n") == 4
