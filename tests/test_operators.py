"""Operators against brute force and their invariants."""

import json

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveloom.functions.udfs import register_all
from sieveloom.operators import additive, clustering, evaluate, joins, mixes, prefix, regression, selection
from sieveloom.operators.classify import apply_soft, train_soft
from sieveloom.operators.quantiles import quantiles
from sieveloom.schema import nan_to_null


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(1)
    g = np.where(rng.random(600) < 0.4, 0, rng.integers(1, 6, 600))  # a hot group
    rows = [(int(i), int(a), float(np.round(s, 1)) if rng.random() > 0.05 else None, int(t)) for i, (a, s, t) in enumerate(zip(g, rng.random(600), rng.integers(1, 50, 600)))]
    return spark.createDataFrame(rows, "id int, g int, s double, t int").persist()


def test_running_sum(scored):
    p = scored.toPandas().sort_values(["g", "id"])
    want = p.groupby("g")["t"].cumsum()
    got = prefix.running_sum(scored, "t", ["g"], [F.col("id").asc()], "c").toPandas().set_index("id")["c"]
    assert (got.loc[p["id"]].to_numpy() == want.to_numpy()).all()


def test_running_sum_of_nothing(scored):
    assert prefix.running_sum(scored.limit(0), "t", [], [F.col("id")], "c").count() == 0


def test_ranks(scored):
    got = prefix.average_ranks(scored, "s", ["g"], "r").toPandas().set_index("id")["r"]
    p = scored.toPandas().set_index("id")
    want = p.groupby("g")["s"].rank(method="average", pct=True, na_option="keep")
    assert np.allclose(got.sort_index(), want.sort_index(), equal_nan=True)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e3, 1e3), min_size=1, max_size=40), st.floats(0, 1))
def test_quantiles(spark, xs, p):
    df = spark.createDataFrame([(float(x),) for x in xs] + [(None,)], "x double")
    assert quantiles(df, "x", [p]).first()["value"] == pytest.approx(np.quantile(xs, p), abs=1e-9)


def test_grouped_quantiles(scored):
    got = {(r["g"], r["p"]): r["value"] for r in quantiles(scored, "s", [0.1, 0.5, 0.85], ["g"]).collect()}
    for g, f in scored.toPandas().groupby("g"):
        for p in (0.1, 0.5, 0.85):
            assert got[g, p] == pytest.approx(np.nanquantile(f["s"], p))


@pytest.mark.parametrize("budget", [1, 500, 3000])
def test_budget_is_minimal(scored, budget):
    rows = selection.by_tokens(scored, "s", "t", budget, [F.col("id")]).toPandas()
    total = rows["t"].sum()
    assert total >= budget
    last = rows.sort_values(["s", "id"], ascending=[True, False], na_position="first").iloc[0]
    assert total - last["t"] < budget


def test_budget_edges(scored):
    assert selection.by_tokens(scored, "s", "t", 0, [F.col("id")]).count() == 0
    with pytest.raises(ValueError, match="Insufficient"):
        selection.by_tokens(scored, "s", "t", 10**9, [F.col("id")])


def test_multi_epoch(scored):
    total = scored.agg(F.sum("t")).first()[0]
    r = selection.multi_epoch(scored, "s", "t", 2 * total + 10, [F.col("id")]).toPandas()
    assert r["n_repeats"].min() == 2 and r["n_repeats"].max() == 3
    assert selection.multi_epoch(scored, "s", "t", 2 * total, [F.col("id")], repeat=False).agg(F.sum("n_repeats")).first()[0] == 600


def test_floor_then_fill(scored):
    r = selection.floor_then_fill(scored, ["g"], "s", 60, 0.05, [F.col("id")]).toPandas()
    assert len(r) == 60 and set(r["g"]) == set(range(6))
    assert len(selection.floor_then_fill(scored, ["g"], "s", 3, 0.5, [F.col("id")]).collect()) == 3


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 30), min_size=1, max_size=8), st.integers(0, 120))
def test_water_fill(spark, sizes, target):
    df = spark.createDataFrame(list(enumerate(sizes)), "c int, n int")
    q = {r["c"]: r["quota"] for r in selection.water_fill(df, "c", "n", target).collect()}
    assert sum(q.values()) == min(target, sum(sizes)) and all(q[i] <= n for i, n in enumerate(sizes))
    assert all(q[i] == n or q[i] >= max(q.values()) - 1 for i, n in enumerate(sizes))


def test_hierarchical_sample(scored):
    df = scored.withColumn("h", F.col("id") % 3)
    r = clustering.hierarchical_sample(df, ["g", "h"], "s", 100, [F.col("id")])
    assert r.agg(F.sum("n_copies")).first()[0] == 100


def test_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    b = spark.createDataFrame([(1, "p"), (1, "q")], "k int, b string")
    with pytest.raises(Exception, match="keys repeat"):
        joins.one_to_one(a, b, ["k"]).collect()
    with pytest.raises(Exception, match="no entry"):
        joins.mandatory(a, b.limit(1), "k", "b").collect()
    assert joins.left_chain(a, [b.withColumnRenamed("b", "a")], ["k"]).columns == ["k", "a"]
    assert nan_to_null(spark.createDataFrame([(float("nan"),)], "x double")).first()[0] is None


def test_packing(spark):
    docs = spark.createDataFrame([(i, list(range(i * 10, i * 10 + 7))) for i in range(20)] + [(99, [])], "k int, ids array<int>")
    flat = [x for i in range(20) for x in range(i * 10, i * 10 + 7)]
    rows = sorted(mixes.packed(docs, ["k"], "ids", 15).collect())
    assert [x for r in rows for x in r["ids"]] == flat[: len(flat) // 16 * 16]


def test_proposals():
    prior = {i: i + 1.0 for i in range(6)}
    rows = pd.DataFrame(mixes.proposals(prior, 5), columns=["mix", "d", "w"])
    assert rows.groupby("mix")["w"].sum().round(9).eq(1).all() and rows["mix"].nunique() == 5


def test_kmeans(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.1, (40, 2)) for c in ((0, 0), (5, 5), (0, 5))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id int, v array<double>")
    c, p = clustering.kmeans(df, "v", 3, 4)
    assert p < 10 and sorted(map(tuple, c.round())) == [(0, 0), (0, 5), (5, 5)]
    a = clustering.assign(df, "id", "v", [c]).groupBy("cluster_0").count().collect()
    assert sorted(r["count"] for r in a) == [40, 40, 40]


def test_kmeans_with_tasks_without_rows(spark):
    # one row each in two of sixteen tasks, as where few rows are left of a large table
    df = spark.range(0, 1600, 1, 16).where("id IN (5, 1500)").selectExpr("id", "array(id / 100.0D, 1.0D) AS v")
    c, n, _ = clustering.step(df, "v", np.array([[0.0, 0.0], [20.0, 0.0]]))
    assert n.tolist() == [1, 1] and c.tolist() == [[0.05, 1.0], [15.0, 1.0]]
    assert clustering.step(df.where("id < 0"), "v", np.zeros((2, 2)))[1].tolist() == [0, 0]
    e = spark.range(0, 4000, 1, 16).selectExpr("id", "array(id % 4 * 10.0D, id / 4000.0D) AS v")
    low, high = clustering.hierarchical(e, "id", "v", [4, 2], 2, resample=2)
    assert low.shape == (4, 2) and high.shape == (2, 2) and sorted(np.round(low[:, 0]).tolist()) == [0, 10, 20, 30]


def test_split(spark):
    rng = np.random.default_rng(1)
    blobs = [(c, b, rng.normal((10 * c, 5 * b), 0.1, 2).tolist()) for c in range(5) for b in range(2) for _ in range(20 + 10 * c)]
    rows = [(i, c, v) for i, (c, _, v) in enumerate(blobs)] + [(900, 7, [1.0, 1.0]), (901, 7, [1.0, 1.0]), (902, 8, [2.0, 1.0]), (903, 8, None), (904, None, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, label int, v array<double>").repartition(5)
    got = {r["id"]: (r["label"], r["part"]) for r in clustering.split(df, "id", "v", "label", 2).collect()}
    assert set(got) == set(range(len(blobs))) | {900, 901, 902} and got[900] == got[901]
    seen = {(c, b): {got[i] for i, x in enumerate(blobs) if x[:2] == (c, b)} for c in range(5) for b in range(2)}
    assert all(len(x) == 1 for x in seen.values()) and len(set.union(*seen.values())) == 10 and all(x[0] == c for (c, _), p in seen.items() for x in p)
    assert clustering.split(df.limit(0), "id", "v", "label", 2).count() == 0


def test_split_query_covers_every_cluster(spark, data):
    from sieveloom.plans import registry

    got = {(r["label"], r["part"]): r["size"] for r in registry.QUERIES["clu_08_split_clusters"](spark, data).collect()}
    want = {r["label"]: r["count"] for r in spark.read.parquet(f"{data}/embeddings.parquet").groupBy("label").count().collect()}
    assert {c: sum(n for (a, _), n in got.items() if a == c) for c in want} == want and len(got) == 2 * len(want)


def test_one_dimensional(spark, data):
    from sieveloom.plans import registry
    from sieveloom.schema import master

    rng = np.random.default_rng(6)
    x = np.round(np.concatenate([rng.normal(0.2, 0.02, 400), rng.normal(0.5, 0.02, 30), rng.normal(0.8, 0.05, 200), [0.0, 1.0]]), 3)
    df = spark.createDataFrame([(g, float(v)) for g in (1, 2) for v in x[:: 3 * g - 2]] + [(1, None), (None, 0.5), (4, 0.5)], "g int, x double").repartition(5)
    for power in (1, 2, 3):
        got = clustering.generalised_1d_by(df, "x", "g", 3, power)
        assert set(got) == {1, 2, 4}
        for g in (1, 2):
            assert got[g] == pytest.approx(clustering.generalised_1d(np.sort(x[:: 3 * g - 2]), 3, power), abs=1e-6)
    scores = master(spark, data).where("topic IS NOT NULL AND dclm_score IS NOT NULL").select("topic", "dclm_score").toPandas()
    r = registry.QUERIES["clu_11_one_dimensional"](spark, data).toPandas()
    for g, f in scores.groupby("topic"):
        assert r[r["topic"] == g].sort_values("centre")["value"].tolist() == pytest.approx(clustering.generalised_1d(np.sort(f["dclm_score"].to_numpy()), 3, 2), abs=2e-6)


def test_seeds(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 10, (12, 5))
    x = np.vstack([centres[rng.integers(0, 12, 3000)] + rng.normal(0, 0.3, (3000, 5)), np.tile(centres[0], (1500, 1))])  # a third of the rows are copies
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    one, other = (clustering.seed(df.repartition(n), "v", 12, key="id") for n in (3, 7))
    assert one.shape == (12, 5) and np.allclose(one, other)  # whatever the partitions
    best = ((x[:, None] - centres) ** 2).sum(axis=2).min(axis=1).sum()
    assert clustering.nearest(x, one)[1].sum() < 20 * best
    assert len(clustering.seed(df.where("id >= 3000"), "v", 4)) == 1 and len(clustering.seed(df.limit(0), "v", 4)) == 0
    assert clustering.kmeans(df.limit(0), "v", 3, 2)[1] == 0.0


def test_regression(spark):
    rng = np.random.default_rng(3)
    n = 800
    f = pd.DataFrame({"id": range(n), "a": rng.normal(2, 3, n), "b": rng.normal(size=n), "g": rng.integers(0, 3, n)})
    f["y"] = 1 + 2 * (f["a"] - 2) / 3 - f["b"] + 0.5 * (f["g"] == 1) + rng.normal(0, 0.05, n)
    df = spark.createDataFrame(f)
    m = {t: v for t, _, v in regression.ridge(df, regression.Design(["a", "b"], ["g"]), ["y"], 1e-6).rows()}
    assert m["a"] == pytest.approx(2, abs=0.1) and m["b"] == pytest.approx(-1, abs=0.1) and m["g=1"] == pytest.approx(0.5, abs=0.05)
    assert regression.r2(df, regression.Design(["a", "b"], ["g"]), "y") > 0.99
    l1 = {t: v for t, _, v in regression.lasso(df, regression.Design(["a", "b"], []), "y", [1e-3, 1.0], F.col("id")).rows()}
    assert l1["a"] == pytest.approx(2, abs=0.15)
    em = regression.factor_em(df, ["a", "b", "y"], 1, 50)
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(em.history, em.history[1:]))
    cor = regression.factor_correlations(em, regression.correlation(df, ["a", "b", "y"]))
    assert [x[:2] for x in cor] == [(0, "composite"), (0, "a"), (0, "b"), (0, "y")] and all(abs(x[2]) <= 1 + 1e-9 for x in cor)
    z = (f[["a", "b", "y"]] - f[["a", "b", "y"]].mean()) / f[["a", "b", "y"]].std(ddof=0)
    score = z @ np.linalg.solve(em.loadings @ em.loadings.T + np.diag(em.noise), em.loadings)[:, 0]
    assert cor[3][2] == pytest.approx(np.corrcoef(score, z["y"])[0, 1], abs=1e-6) and cor[0][2] == pytest.approx(np.corrcoef(score, z.mean(axis=1))[0, 1], abs=1e-6)


def test_posterior(spark):
    rng = np.random.default_rng(8)
    n = 3000
    f = pd.DataFrame({"a": rng.normal(2, 3, n), "g": rng.integers(0, 4, n), "h": np.where(rng.random(n) < 0.3, "x", "y")})
    effect = np.array([0.0, 1.0, -1.0, 0.5])[f["g"]]
    f["y"] = 2 * (f["a"] - f["a"].mean()) / f["a"].std(ddof=0) + effect + rng.normal(0, 1, n)
    f["z"] = f["y"] * 0.5 + rng.normal(0, 1, n)
    post = regression.gibbs(spark.createDataFrame(f), regression.Design(["a"], ["g", "h"]), ["y", "z"], 3, 80, 30, thin=2)
    diag = {r["param"]: r for r in evaluate.diagnostics(spark.createDataFrame(post.draws, "chain int, draw int, param string, value double")).collect()}
    assert all(r["r_hat"] < 1.1 and r["ess"] > 50 for r in diag.values()) and len(diag) == 3 + 3 * 2
    mean = pd.DataFrame(post.draws, columns=["c", "d", "p", "v"]).groupby("p")["v"].mean()
    assert mean["variance numbers|y"] == pytest.approx(4, rel=0.1) and mean["variance g|y"] == pytest.approx(effect.var(), rel=0.2) and mean["variance h|y"] < 0.01
    assert mean["sigma|y|y"] == pytest.approx(1, rel=0.1) and mean["sigma|y|z"] == pytest.approx(0.5, rel=0.15)
    b = {(t, y): (m, s) for t, y, m, s in post.coefficients}
    assert abs(b["a", "y"][0] - 2) < 4 * b["a", "y"][1] and 0 < b["a", "y"][1] < 0.1
    # a tight prior of one block draws its effects to none
    tight = regression.gibbs(spark.createDataFrame(f), regression.Design(["a"], ["g", "h"]), ["y", "z"], 1, 40, 10, prior_sd={**regression.PRIOR_SD, "g": 0.001})
    assert abs({(t, y): m for t, y, m, _ in tight.coefficients}["g=1", "y"]) < 0.1


def test_latent_quality(spark):
    rng = np.random.default_rng(9)
    n = 4000
    f = pd.DataFrame({"a": rng.normal(size=n), "g": rng.integers(0, 3, n)})
    q = 0.8 * f["a"] + 0.7 * (f["g"] == 1) + rng.normal(size=n)
    for i, w in enumerate((1.0, 0.6, 0.3)):
        f[f"s{i}"] = 5 + 2 * (w * q + rng.normal(0, 0.5, n))
    df = spark.createDataFrame(f)
    m = regression.latent_quality(df, regression.Design(["a"], ["g"]), ["s0", "s1", "s2"])
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(m.history[1:], m.history[2:])) and (m.loading > 0).all() and m.loading[0] > m.loading[1] > m.loading[2]
    gamma = dict(zip(m.terms, m.gamma))
    assert gamma["a"] == pytest.approx(0.8, abs=0.12) and gamma["g=1"] == pytest.approx(0.7, abs=0.15) and abs(gamma["g=2"]) < 0.15
    turned = regression.latent_quality(df.withColumn("s2", -F.col("s2")), regression.Design(["a"], ["g"]), ["s0", "s1", "s2"])
    assert turned.loading[2] == 0.05 and regression.latent_quality(df.withColumn("s2", -F.col("s2")), regression.Design(["a"], ["g"]), ["s0", "s1", "s2"], least_loading=None).loading[2] < 0


def test_additive(spark):
    rng = np.random.default_rng(10)
    n = 6000
    f = pd.DataFrame({"id": range(n), "a": rng.normal(size=n), "b": rng.random(n), "c": rng.normal(size=n), "g": rng.choice(["x", "y", "z"], n)})
    f["y"] = np.sin(2 * f["a"]) + (f["g"] == "y") * 1.0 + 1.5 * np.sign(f["b"] - 0.5) * np.sign(f["c"]) + rng.normal(0, 0.1, n)
    f.loc[:50, "a"] = np.nan
    df = spark.createDataFrame(f)
    alone = additive.fit(df, ["a", "b", "c"], ["g"], "y", 64, 60, pairs=0)
    g = additive.fit(df, ["a", "b", "c"], ["g"], "y", 64, 60, pairs=1)
    fit = lambda m: np.corrcoef(*[additive.predict(df, ["id", "y"], m).toPandas()[c] for c in ("y", "prediction")])[0, 1] ** 2
    assert ("b", "c") in g.tables and fit(alone) < 0.5 < 0.9 < fit(g)
    assert g.importance()[0][0] == "b x c" and {t for t, _ in g.importance()} == {"a", "b", "c", "g", "b x c"}
    curve = {(f_, l): e for f_, _, _, l, e in g.curves() if l}
    assert curve["g", "y"] - curve["g", "x"] == pytest.approx(1, abs=0.1) and len(g.grids()) == g.pair_bins**2
    assert additive.predict(df.limit(0), ["id"], g).count() == 0
    # missing numbers are the medians of the scored rows
    high = df.where("a > 1 OR a IS NULL")
    p = additive.predict(high.where("g = 'x'").withColumn("b", F.lit(0.9)).withColumn("c", F.lit(1.0)), ["id", "a"], g, impute=True).toPandas()
    assert p[p["a"].isna()]["prediction"].nunique() == 1
    assert additive.fit(df.limit(0), ["a"], ["g"], "y").tables == {}


def test_soft_labels(spark):
    rows = [(i, ("the oven and the bread " if i % 2 else "a compiler with software ") * 3, [0.2, 0.8] if i % 2 else [0.9, 0.1]) for i in range(60)] + [(60, None, [1.0, 0.0]), (61, "oven", None)]
    df = spark.createDataFrame(rows, "id int, text string, probs array<double>")
    out = {r["id"]: r for r in apply_soft(df, train_soft(df, "text", "probs", 1 << 8, 30, 1e-6), "text", ["id"]).collect()}
    assert all(out[i]["label"] == i % 2 for i in range(60)) and len(out) == 62
    assert out[1]["probs"][1] == pytest.approx(0.8, abs=0.03) and out[0]["probs"][0] == pytest.approx(0.9, abs=0.03)  # soft, not pushed to 1


def test_bootstrap(scored):
    b = evaluate.bootstrap(scored, "s", "g", F.col("id"), 100).collect()
    means = scored.groupBy("g").agg(F.avg("s").alias("m")).collect()
    for r in means:
        row = next(x for x in b if x["g"] == str(r["g"]))
        assert row["q025"] <= r["m"] <= row["q975"] and row["sd"] > 0


def test_udfs(spark):
    register_all(spark)
    e = spark.sql("SELECT entropy_of_counts(array(1, 1, 0)), entropy_of_counts(array(1, 2, NULL)), entropy_of_counts(array()), entropy_of_counts(NULL)").first()
    assert e[0] == pytest.approx(np.log(2)) and e[1] == pytest.approx(np.log(3) - 2 / 3 * np.log(2)) and e[2] == 0 and e[3] is None
    assert [tuple(r) for r in spark.sql("SELECT * FROM ngrams('a b c', 2)").collect()] == [(0, "a b"), (1, "b c")]


def test_configs(spark, scored):
    df = scored.withColumns({"u": F.rand(1), "v": F.rand(2)}).persist()
    for c in mixes.generate_configs(df, ["u", "v"], 5, 0.05):
        assert json.dumps(c) and selection.intersection(df, [(s["feature"], s["percentile"], s["direction"]) for s in c["selectors"]]).count() >= 30


def test_checkpoints_need_a_shared_folder():
    from types import SimpleNamespace

    from sieveloom.session import shared_dir

    def cluster(folder):
        set_to = []
        context = SimpleNamespace(getCheckpointDir=lambda: set_to[-1] if set_to else None, setCheckpointDir=set_to.append, master="spark://host:7077")
        return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default=None: folder), sparkContext=context), set_to

    session_, set_to = cluster("hdfs://shared/checkpoints")
    assert shared_dir(session_) == "hdfs://shared/checkpoints" == set_to[0]
    with pytest.raises(ValueError):
        shared_dir(cluster(None)[0])


def test_large_top_k_and_samples(spark, monkeypatch):
    df = spark.range(3000).select("id", (F.col("id") % 7).cast("double").alias("s")).repartition(6)
    small_ = [r["id"] for r in selection.top_n(df, "s", 500, [F.col("id")]).collect()]
    sample = {r["id"] for r in selection.random_rows(df, F.col("id"), 40, 3).collect()}
    monkeypatch.setattr(selection, "GATHERED", 10)
    assert sorted(r["id"] for r in selection.top_n(df, "s", 500, [F.col("id")]).collect()) == sorted(small_)
    assert {r["id"] for r in selection.random_rows(df, F.col("id"), 40, 3).collect()} == sample and len(sample) == 40
    assert selection.random_rows(df, F.col("id"), 5000, 3).count() == 3000


def test_many_quantiles_of_hot_values(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([np.full(2000, 0.5), rng.normal(size=3000), [np.inf, -np.inf]])
    ps = [i / 256 for i in range(257)]
    df = spark.createDataFrame([(float(v), int(i % 2)) for i, v in enumerate(x)] + [(None, 1)], "x double, g int").repartition(5)
    got = {r["p"]: r["value"] for r in quantiles(df.where("abs(x) < 1e9"), "x", ps).collect()}
    finite = x[np.isfinite(x)]
    assert len(got) == 257 and all(v == pytest.approx(np.quantile(finite, p), abs=1e-12) for p, v in got.items())
    plan = quantiles(df, "x", [0.1, 0.5], ["g"])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert quantiles(df.limit(0), "x", [0.5]).count() == 0 == quantiles(df.where("x IS NULL"), "x", [0.5], ["g"]).count()
