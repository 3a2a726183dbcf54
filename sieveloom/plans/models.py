"""Embeddings, clusters and statistical models over the corpus tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import additive, clustering, evaluate, regression
from ..schema import KEY
from .base import M, master, query, r6, table

_E = "WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) for x in embedding] AS v FROM embeddings), c AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS c, v AS cv FROM (SELECT * FROM e ORDER BY vec_id LIMIT 8)), x AS (SELECT vec_id, v, c, list_sum([(v[i] - cv[i]) * (v[i] - cv[i]) for i in range(1, len(v) + 1)]) AS d2 FROM e, c), a AS (SELECT vec_id, any_value(v) AS v, arg_min(c, round(d2, 9) * 1000000 + c) AS cluster, min(d2) AS d2 FROM x GROUP BY vec_id)"


def _centroids(spark, d, k=8):
    rows = table(spark, d, "embeddings").orderBy("vec_id").limit(k).collect()
    return np.array([r["embedding"] for r in rows], np.float64)


@query(_E + " SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, round(d2, 4) AS dist2 FROM a")
def clu_j12_nearest_centroid(spark, d):
    a = clustering.assign(table(spark, d, "embeddings"), "vec_id", "embedding", [_centroids(spark, d)])
    return a.select("vec_id", F.col("cluster_0").alias("cluster"), F.round("dist2_0", 4).alias("dist2"))


@query(_E + ", m AS (SELECT cluster, i, avg(v[i]) AS m FROM a, range(1, 65) t(i) GROUP BY 1, 2) SELECT CAST(cluster AS INTEGER) AS cluster, CAST(i - 1 AS INTEGER) AS dim, round(m, 5) AS mean FROM m")
def clu_02_lloyd_step(spark, d):
    c, n, _ = clustering.step(table(spark, d, "embeddings"), "embedding", _centroids(spark, d))
    return spark.createDataFrame([(int(i), j, float(v)) for i in range(len(c)) if n[i] for j, v in enumerate(c[i])], "cluster int, dim int, m double").select("cluster", "dim", F.round("m", 5).alias("mean"))


@query(_E + " SELECT CAST(cluster AS INTEGER) AS cluster, count(*) AS size, round(sum(d2), 3) AS potential FROM a GROUP BY 1")
def clu_47_sizes_and_potential(spark, d):
    a = clustering.assign(table(spark, d, "embeddings"), "vec_id", "embedding", [_centroids(spark, d)])
    return a.groupBy(F.col("cluster_0").alias("cluster")).agg(F.count("*").alias("size"), F.round(F.sum("dist2_0"), 3).alias("potential"))


@query(_E + " SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(row_number() OVER (PARTITION BY cluster ORDER BY round(d2, 6), vec_id) AS BIGINT) AS position FROM a")
def clu_w10_distance_order(spark, d):
    from ..operators.prefix import row_numbers

    a = clustering.assign(table(spark, d, "embeddings"), "vec_id", "embedding", [_centroids(spark, d)])
    a = a.select("vec_id", F.col("cluster_0").alias("cluster"), F.round("dist2_0", 6).alias("d"))
    return row_numbers(a, ["cluster"], [F.col("d").asc(), F.col("vec_id").asc()], "position").select("vec_id", "cluster", F.col("position").cast("bigint").alias("position"))


@query("SELECT label, list(vec_id ORDER BY vec_id) AS members, count(*) AS size FROM embeddings GROUP BY label")
def clu_09_inversion(spark, d):
    return clustering.invert(table(spark, d, "embeddings"), "label", "vec_id")


@query("SELECT 0 AS level, label AS cluster_id, count(*) AS leaves FROM embeddings GROUP BY label UNION ALL SELECT 1, CAST(label % 3 AS INTEGER), count(*) FROM embeddings GROUP BY label % 3")
def clu_10_flat_hierarchy(spark, d):
    e = table(spark, d, "embeddings")
    first = e.select(F.col("label").alias("cluster_id"), F.col("vec_id").alias("child_id"))
    second = e.select((F.col("label") % 3).cast("int").alias("cluster_id"), F.col("label").cast("bigint").alias("child_id")).distinct()
    return clustering.flatten_hierarchy([first, second]).groupBy("level", "cluster_id").agg(F.count("*").alias("leaves"))


@query("WITH s AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT label, n, CAST(row_number() OVER (ORDER BY n DESC, label) AS INTEGER) AS rank FROM s")
def clu_w13_size_order(spark, d):
    from pyspark.sql import Window

    s = table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return s.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "label")))  # a row per cluster


@query()
def clu_03_kmeans(spark, d):
    c, p = clustering.kmeans(table(spark, d, "embeddings"), "embedding", 6, 4, key="vec_id")
    return clustering.assign(table(spark, d, "embeddings"), "vec_id", "embedding", [c]).groupBy(F.col("cluster_0").alias("cluster")).agg(F.count("*").alias("size"), F.round(F.sum("dist2_0"), 4).alias("potential"))


@query()
def clu_07_hierarchical_kmeans(spark, d):
    levels = clustering.hierarchical(table(spark, d, "embeddings"), "vec_id", "embedding", [8, 3], 2, resample=10)
    a = clustering.assign(table(spark, d, "embeddings"), "vec_id", "embedding", levels)
    return a.groupBy("cluster_1", "cluster_0").agg(F.count("*").alias("size"))


@query()
def clu_08_split_clusters(spark, d):
    e = table(spark, d, "embeddings")
    return clustering.split(e, "vec_id", "embedding", "label", 2).groupBy("label", "part").agg(F.count("*").alias("size"))


@query()
def clu_11_one_dimensional(spark, d):
    """Cluster centres of each topic's scores under a fourth-power distortion, over all its records."""
    centres = clustering.generalised_1d_by(master(spark, d).where("topic IS NOT NULL"), "dclm_score", "topic", 3, 2)
    return spark.createDataFrame([(g, i, round(float(v), 6)) for g, c in sorted(centres.items()) for i, v in enumerate(c)], "topic int, centre int, value double")


def _frame(spark, d):
    m = master(spark, d).where("topic IS NOT NULL AND format IS NOT NULL AND dclm_score BETWEEN 0 AND 1 AND qr_educational_value IS NOT NULL AND textbook_quality IS NOT NULL").na.drop(subset=["frac_alpha", "mean_word_length", "type_token_ratio"])
    return m.select(*KEY, "topic", "format", "domain", "in_train_pool", "dclm_score", "qr_educational_value", "textbook_quality", "frac_alpha", "mean_word_length", "type_token_ratio")


_X = ["frac_alpha", "mean_word_length", "type_token_ratio"]
_Y = ["dclm_score", "qr_educational_value", "textbook_quality"]


@query(M + ", f AS (SELECT * FROM m WHERE topic IS NOT NULL AND format IS NOT NULL AND dclm_score BETWEEN 0 AND 1 AND qr_educational_value IS NOT NULL AND textbook_quality IS NOT NULL AND frac_alpha IS NOT NULL AND mean_word_length IS NOT NULL AND type_token_ratio IS NOT NULL) SELECT 'dclm_score' AS target, round(avg(dclm_score), 6) AS mean FROM f UNION ALL SELECT 'qr_educational_value', round(avg(qr_educational_value), 6) FROM f UNION ALL SELECT 'textbook_quality', round(avg(textbook_quality), 6) FROM f")
def mod_04_mean_baseline(spark, d):
    one = _frame(spark, d).agg(*[F.avg(y).alias(y) for y in _Y])
    return one.unpivot([], _Y, "target", "mean").select("target", r6(F.col("mean"), "mean"))


@query()
def mod_02_ridge(spark, d):
    model = regression.ridge(_frame(spark, d), regression.Design(_X, ["topic", "format"]), _Y, 1.0)
    return spark.createDataFrame(model.rows(), "term string, target string, value double").select("term", "target", r6(F.col("value"), "value"))


@query()
def mod_03_ridge_alpha(spark, d):
    rows = regression.choose_alpha(_frame(spark, d), regression.Design(_X, ["topic"]), _Y, F.concat_ws("-", *KEY))
    return spark.createDataFrame(rows, "alpha double, rmse double, chosen boolean").select("alpha", r6(F.col("rmse"), "rmse"), "chosen")


@query()
def mod_24_incremental_r2(spark, d):
    f = _frame(spark, d)
    specs = [("topic", regression.Design([], ["topic"])), ("+format", regression.Design([], ["topic", "format"])), ("+heuristics", regression.Design(_X, ["topic", "format"]))]
    return spark.createDataFrame([(n, float(regression.r2(f, s, "dclm_score"))) for n, s in specs], "spec string, r2 double").select("spec", r6(F.col("r2"), "r2"))


def _posterior(spark, d):
    """Topic, format and the larger url domains as label blocks beside the numbers."""
    f = _frame(spark, d)
    top = [r["domain"] for r in f.where("domain IS NOT NULL").groupBy("domain").count().orderBy(F.desc("count"), "domain").limit(20).collect()]
    f = f.withColumn("site", F.when(F.col("domain").isin(top), F.col("domain")).otherwise("OTHER"))
    return regression.gibbs(f, regression.Design(_X, ["topic", "format", "site"]), _Y, chains=2, draws=120, burn=40, thin=2)


@query()
def mod_05_gibbs(spark, d):
    """Diagnostics of the noise covariance and of the variance each block explains."""
    rows = spark.createDataFrame(_posterior(spark, d).draws, "chain int, draw int, param string, value double")
    return evaluate.diagnostics(rows).select("param", r6(F.col("r_hat"), "r_hat"), r6(F.col("ess"), "ess"))


@query()
def mod_05_coefficients(spark, d):
    c = spark.createDataFrame(_posterior(spark, d).coefficients, "term string, target string, mean double, sd double")
    return c.select("term", "target", r6(F.col("mean"), "mean"), r6(F.col("sd"), "sd"))


@query()
def mod_06_block_variances(spark, d):
    """Posterior mean of the variance that numbers, topics, formats and sites explain, by score, and its share."""
    rows = spark.createDataFrame(_posterior(spark, d).draws, "chain int, draw int, param string, value double").where("param LIKE 'variance %'")
    v = rows.groupBy(F.regexp_extract("param", r"variance (.*)\|", 1).alias("block"), F.regexp_extract("param", r"\|(.*)$", 1).alias("target")).agg(F.avg("value").alias("v"))
    return v.select("block", "target", r6(F.col("v"), "variance"), r6(F.col("v") / F.expr("sum(v) OVER (PARTITION BY target)"), "share"))


@query()
def mod_07_factor_em(spark, d):
    """One latent quality whose prior mean is a regression on numbers, topic and format."""
    m = regression.latent_quality(_frame(spark, d), regression.Design(_X, ["topic", "format"]), _Y)
    rows = [("score", y, float(a), float(w), float(v)) for y, a, w, v in zip(_Y, m.alpha, m.loading, m.noise)] + [("prior", t, float(g), None, None) for t, g in zip(m.terms, m.gamma)]
    x = spark.createDataFrame(rows, "kind string, name string, coefficient double, loading double, noise double")
    return x.select("kind", "name", *[r6(F.col(c), c) for c in ("coefficient", "loading", "noise")])


@query()
def mod_53_factor_correlation(spark, d):
    f = _frame(spark, d)
    m = regression.factor_em(f, _Y, 2, 60)
    rows = regression.factor_correlations(m, regression.correlation(f, _Y))
    return spark.createDataFrame(rows, "factor int, score string, r double").select("factor", "score", r6(F.col("r"), "r"))


@query()
def mod_08_two_factor_scores(spark, d):
    f = _frame(spark, d)
    m = regression.factor_em(f, [*_Y, *_X], 2, 60)
    return regression.factor_scores(f, KEY, m).select(*KEY, r6(F.col("quality"), "quality"))


@query()
def mod_09_lasso(spark, d):
    model = regression.lasso(_frame(spark, d), regression.Design(_X, ["topic"]), "dclm_score", [1e-4, 1e-3, 1e-2], F.concat_ws("-", *KEY))
    return spark.createDataFrame(model.rows(), "term string, target string, value double").select("term", "target", r6(F.col("value"), "value"))


_GX = ["frac_alpha", "mean_word_length", "type_token_ratio", "stopword_fraction", "char_count", "qr_educational_value", "textbook_quality"]


def _additive(spark, d, labels=("topic", "format")):
    m = master(spark, d).withColumns({c: F.col(c).cast("string") for c in ("topic", "format")})
    return m, additive.fit(m.where("dclm_score BETWEEN 0 AND 1"), _GX, list(labels), "dclm_score", bins=256)


@query()
def mod_10_additive(spark, d):
    """Single terms of 256 bins, nominal labels and the 20 strongest pairs; all rows scored, missing numbers as the medians of the scored rows."""
    m, g = _additive(spark, d)
    return additive.predict(m, KEY, g, impute=True).select(*KEY, r6(F.col("prediction"), "prediction"))


@query()
def mod_10_numbers_only(spark, d):
    """The variant without labels: its fit on the rows it was made of."""
    m, g = _additive(spark, d, ())
    scored = additive.predict(m.where("dclm_score BETWEEN 0 AND 1"), [*KEY, "dclm_score"], g)
    return scored.agg(F.count("*").alias("n"), r6(1 - F.sum((F.col("dclm_score") - F.col("prediction")) ** 2) / (F.var_pop("dclm_score") * F.count("*")), "r2"))


@query()
def mod_16_importance(spark, d):
    _, g = _additive(spark, d)
    return spark.createDataFrame(g.importance(), "term string, importance double").select("term", r6(F.col("importance"), "importance"))


@query()
def mod_16_curves(spark, d):
    _, g = _additive(spark, d)
    return spark.createDataFrame(g.curves(), "feature string, bin int, least double, label string, effect double").select("feature", "bin", r6(F.col("least"), "least"), "label", r6(F.col("effect"), "effect"))


@query()
def mod_16_pair_grids(spark, d):
    _, g = _additive(spark, d)
    return spark.createDataFrame(g.grids(), "a string, b string, i int, j int, effect double").select("a", "b", "i", "j", r6(F.col("effect"), "effect"))


@query()
def mod_14_soft_labels(spark, d):
    """Documents classified by a linear model of label distributions: the recorded topic with its confidence, the rest spread over the others."""
    from ..operators.classify import apply_soft, train_soft
    from ..schema import newest

    t = newest(table(spark, d, "domains_topics").where("shard_idx IS NOT NULL AND doc_idx IS NOT NULL"), KEY, "annotated_at").where("topic BETWEEN 0 AND 23 AND topic_confidence BETWEEN 0 AND 1 AND NOT isnan(topic_confidence)")
    soft = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: F.when(i == F.col("topic"), F.col("topic_confidence")).otherwise((1 - F.col("topic_confidence")) / 23.0).cast("double"))
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", *KEY, "text")
    model = train_soft(docs.join(t.select(*KEY, soft.alias("probs")), KEY), "text", "probs", dims=1 << 12, iterations=15)
    return apply_soft(docs, model, "text", ["doc_id"]).select("doc_id", "label", F.round(F.array_max("probs"), 4).alias("confidence"))


@query()
def mod_12_pca(spark, d):
    values, vectors = regression.pca(_frame(spark, d), [*_X, *_Y])
    return spark.createDataFrame([(i, n, float(values[i]), float(abs(vectors[j, i]))) for i in range(len(values)) for j, n in enumerate([*_X, *_Y])], "component int, feature string, variance double, loading double").select("component", "feature", r6(F.col("variance"), "variance"), r6(F.col("loading"), "loading"))


@query()
def mod_14_keyword_chooser(spark, d):
    from ..operators.annotate import annotate, keyword_chooser

    names = table(spark, d, "taxonomy").where("kind = 'topic'").orderBy("code").collect()
    a = annotate(table(spark, d, "documents").select("doc_id", "text"), "doc_id", keyword_chooser({r["name"]: [r["name"]] for r in names}), "topic", {"": "string", "_probs": "array<double>"}, by_length=True)
    return a.select("doc_id", "topic", F.round(F.array_max("topic_probs"), 6).alias("confidence"))


@query("SELECT time_bucket(INTERVAL '10 minutes', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def evt_stream_like_windows(spark, d):
    """The batch form of the windowed stream in ``streaming``: events per type and ten minutes."""
    return table(spark, d, "events").groupBy(F.window("ts", "10 minutes")["start"].alias("start"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
