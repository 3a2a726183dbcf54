"""Aggregations, correlations and decompositions over the master frame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import joins, prefix
from ..operators.quantiles import quantiles
from ..schema import KEY
from ..session import cut
from .base import M, master, query, r6, table

S4 = ["dclm_score", "qr_educational_value", "qr_writing_style", "textbook_quality"]
_LONG = " UNION ALL ".join(f"SELECT shard_idx, doc_idx, topic, format, domain, '{c}' AS feature, {c} AS x FROM m" for c in S4)
ML = M + f", l AS ({_LONG})"


def long(spark, d, extra=("topic", "format")):
    return master(spark, d).select(*KEY, *extra, *S4).unpivot([*KEY, *extra], S4, "feature", "x")


@query(M + "SELECT topic, format, count(*) AS documents, CAST(sum(token_count) AS BIGINT) AS tokens, round(sum(token_count) / sum(sum(token_count)) OVER (), 9) AS weight FROM m WHERE topic IS NOT NULL AND format IS NOT NULL AND token_count > 0 GROUP BY topic, format")
def agg_01_domain_statistics(spark, d):
    by = master(spark, d).where("topic IS NOT NULL AND format IS NOT NULL AND token_count > 0").groupBy("topic", "format").agg(F.count("*").alias("documents"), F.sum("token_count").alias("tokens"))
    return by.withColumn("weight", F.round(F.col("tokens") / F.expr("sum(tokens) OVER ()"), 9))


@query(M + "SELECT topic, format, CAST(grouping(topic) AS INTEGER) * 2 + CAST(grouping(format) AS INTEGER) AS level, CAST(sum(token_count) AS BIGINT) AS tokens FROM m WHERE topic IS NOT NULL AND format IS NOT NULL AND token_count > 0 GROUP BY CUBE (topic, format)")
def agg_02_marginals_cube(spark, d):
    return master(spark, d).where("topic IS NOT NULL AND format IS NOT NULL AND token_count > 0").cube("topic", "format").agg(F.grouping_id().cast("int").alias("level"), F.sum("token_count").alias("tokens"))


@query(M + "SELECT topic, format, round(sum(token_count) / nullif(sum(sum(token_count)) OVER (PARTITION BY topic), 0), 6) AS given_topic, round(sum(token_count) / nullif(sum(sum(token_count)) OVER (PARTITION BY format), 0), 6) AS given_format FROM m WHERE topic IS NOT NULL AND format IS NOT NULL AND token_count > 0 GROUP BY topic, format")
def agg_02_conditionals(spark, d):
    by = master(spark, d).where("topic IS NOT NULL AND format IS NOT NULL AND token_count > 0").groupBy("topic", "format").agg(F.sum("token_count").alias("t"))
    share = lambda c: r6(F.col("t") / F.nullif(F.sum("t").over(Window.partitionBy(c)), F.lit(0)), f"given_{c}")
    return by.select("topic", "format", share("topic"), share("format"))


@query(ML + " SELECT topic, feature, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, count(x) AS n FROM l WHERE topic IS NOT NULL GROUP BY topic, feature")
def agg_03_grouped_moments(spark, d):
    return long(spark, d).where("topic IS NOT NULL").groupBy("topic", "feature").agg(r6(F.avg("x"), "mean"), r6(F.stddev_samp("x"), "std"), F.count("x").alias("n"))


@query(ML + ", g AS (SELECT topic, feature, avg(x) AS mean FROM l WHERE topic IS NOT NULL GROUP BY 1, 2) SELECT topic, feature, round(mean, 6) AS mean, round((mean - avg(mean) OVER (PARTITION BY feature)) / nullif(stddev_samp(mean) OVER (PARTITION BY feature), 0), 6) AS z FROM g")
def agg_05_cross_group_z(spark, d):
    g = long(spark, d).where("topic IS NOT NULL").groupBy("topic", "feature").agg(F.avg("x").alias("m"))
    return g.select("topic", "feature", r6(F.col("m"), "mean"), F.round(stats.z_score(F.col("m"), F.col("feature")), 6).alias("z"))


@query(M + "SELECT domain, count(*) AS n FROM m WHERE domain IS NOT NULL GROUP BY 1 ORDER BY n DESC, domain LIMIT 20")
def agg_06_value_counts(spark, d):
    return master(spark, d).where("domain IS NOT NULL").groupBy("domain").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain").limit(20)


@query(M + ", c AS (SELECT domain, count(*) AS n FROM m WHERE domain IS NOT NULL GROUP BY 1) SELECT count(*) AS levels, CAST(sum(CASE WHEN n > 100 THEN 1 ELSE 0 END) AS BIGINT) AS above_100, CAST(sum(CASE WHEN n >= 50 THEN 1 ELSE 0 END) AS BIGINT) AS from_50, min(n) AS smallest, max(n) AS largest FROM c")
def agg_07_zipf_and_extremes(spark, d):
    c = master(spark, d).where("domain IS NOT NULL").groupBy("domain").agg(F.count("*").alias("n"))
    return c.agg(F.count("*").alias("levels"), F.count_if(F.col("n") > 100).alias("above_100"), F.count_if(F.col("n") >= 50).alias("from_50"), F.min("n").alias("smallest"), F.max("n").alias("largest"))


@query(M + "SELECT topic, count(DISTINCT domain) AS domains, count(DISTINCT format) AS formats FROM m WHERE topic IS NOT NULL GROUP BY topic")
def agg_08_distinct_counts(spark, d):
    return master(spark, d).where("topic IS NOT NULL").groupBy("topic").agg(F.countDistinct("domain").alias("domains"), F.countDistinct("format").alias("formats"))


@query(ML + " SELECT feature, count(*) - count(x) AS missing, round((count(*) - count(x)) / count(*) * 100, 6) AS pct FROM l GROUP BY feature")
def agg_10_missing_profile(spark, d):
    m = master(spark, d)
    one = m.agg(*[(F.count("*") - F.count(c)).alias(c) for c in S4], F.count("*").alias("n"))
    return one.unpivot(["n"], S4, "feature", "missing").select("feature", "missing", r6(F.col("missing") / F.col("n") * 100, "pct"))


_SKEW = "sum(pow(x - mu, 3)) / count(x) / pow(var_pop(x), 1.5)"
_KURT = "sum(pow(x - mu, 4)) / count(x) / pow(var_pop(x), 2) - 3"


@query(ML + f", c AS (SELECT *, avg(x) OVER (PARTITION BY feature) AS mu FROM l WHERE x IS NOT NULL), a AS (SELECT feature, count(x) AS n, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS mn, max(x) AS mx, quantile_cont(x, 0.01) AS p1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.99) AS p99, {_SKEW} AS g1, {_KURT} AS g2 FROM c GROUP BY feature) SELECT feature, n, round(mean, 6) AS mean, round(std, 6) AS std, round(mn, 6) AS min, round(p1, 6) AS p1, round(median, 6) AS median, round(p99, 6) AS p99, round(mx, 6) AS max, round(g1 * sqrt(n * (n - 1)) / (n - 2), 5) AS skew, round((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6), 4) AS kurt FROM a")
def agg_11_feature_summary(spark, d):
    x = F.col("x")
    values = cut(master(spark, d).select(*S4)).unpivot([], S4, "feature", "x").where("x IS NOT NULL")  # three passes follow
    a = values.groupBy("feature").agg(F.count(x).alias("n"), r6(F.avg(x), "mean"), r6(F.stddev_samp(x), "std"), r6(F.min(x), "min"), r6(F.max(x), "max"), F.round(stats.sample_skewness(x), 5).alias("skew"), F.round(stats.sample_kurtosis(x), 4).alias("kurt"))
    q = quantiles(values, "x", [0.01, 0.5, 0.99], ["feature"]).groupBy("feature").pivot("p", [0.01, 0.5, 0.99]).agg(F.round(F.first("value"), 6)).toDF("feature", "p1", "median", "p99")
    return a.join(F.broadcast(q), "feature")  # a row per feature


@query(ML + f", c AS (SELECT *, avg(x) OVER (PARTITION BY feature) AS mu FROM l WHERE x IS NOT NULL) SELECT feature, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round({_SKEW}, 5) AS skew, round({_KURT}, 4) AS kurt, round(avg(CASE WHEN x <= 0.01 THEN 1.0 ELSE 0.0 END), 6) AS low, CASE WHEN max(x) <= 1.5 THEN round(avg(CASE WHEN x >= 0.99 THEN 1.0 ELSE 0.0 END), 6) END AS high FROM c GROUP BY feature")
def agg_12_score_summary(spark, d):
    x = F.col("x")
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return long(spark, d).where("x IS NOT NULL").groupBy("feature").agg(r6(F.avg(x), "mean"), r6(F.stddev_pop(x), "std"), F.round(F.skewness(x), 5).alias("skew"), F.round(F.kurtosis(x), 4).alias("kurt"), share(x <= 0.01).alias("low"), F.when(F.max(x) <= 1.5, share(x >= 0.99)).alias("high"))


@query(M + "SELECT CAST(p AS DOUBLE) AS p, round(v, 6) AS value FROM (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95]) AS p, unnest(quantile_cont(dclm_score, [0.05, 0.25, 0.5, 0.75, 0.95])) AS v FROM m)")
def agg_13_exact_quantiles(spark, d):
    return quantiles(master(spark, d), "dclm_score", [0.05, 0.25, 0.5, 0.75, 0.95]).select("p", r6(F.col("value"), "value"))


@query(M + "SELECT topic, round(quantile_cont(dclm_score, 0.8), 6) AS p80, round(median(dclm_score), 6) AS median FROM m WHERE topic IS NOT NULL AND dclm_score IS NOT NULL GROUP BY topic")
def agg_14_grouped_quantiles(spark, d):
    q = quantiles(master(spark, d).where("topic IS NOT NULL"), "dclm_score", [0.8, 0.5], ["topic"])
    return q.groupBy("topic").pivot("p", [0.8, 0.5]).agg(F.round(F.first("value"), 6)).toDF("topic", "p80", "median")


_PAIRS = [(a, b) for i, a in enumerate(S4) for b in S4[i + 1 :]]


@query(M + ", c AS (SELECT * FROM m WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in S4) + ") " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM c" for a, b in _PAIRS))
def agg_16_pearson_complete(spark, d):
    one = master(spark, d).na.drop(subset=S4).agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in _PAIRS])
    return _pairs(one)


def _pairs(one):
    parts = F.split("pair", r"\|")
    return one.unpivot([], one.columns, "pair", "v").select(parts[0].alias("a"), parts[1].alias("b"), r6(F.col("v"), "r"))


@query(M + " " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM m WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in _PAIRS))
def agg_16_pearson_pairwise(spark, d):
    return _pairs(master(spark, d).agg(*[F.corr(F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))).alias(f"{a}|{b}") for a, b in _PAIRS]))


_RANKED = "(rank() OVER ({0} ORDER BY {1}) + (count(*) OVER ({2}) - 1) / 2.0)"


def _rank_sql(c, by=""):
    return _RANKED.format(f"PARTITION BY {by}" if by else "", c, f"PARTITION BY {by + ', ' if by else ''}{c}")


def spearman(df, a, b, by):
    """Rank correlation of complete rows per group, ranks from value counts, ties at their mean rank."""
    x = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    x = prefix.average_ranks(prefix.average_ranks(x, a, by, "__ra"), b, by, "__rb")
    return x.groupBy(*by).agg(F.corr("__ra", "__rb").alias("rho"), F.count("*").alias("n"))


@query(M + f", c AS (SELECT *, {_rank_sql('dclm_score')} AS ra, {_rank_sql('qr_educational_value')} AS rb FROM m WHERE dclm_score IS NOT NULL AND qr_educational_value IS NOT NULL) SELECT round(corr(ra, rb), 6) AS rho, count(*) AS n FROM c")
def agg_17_spearman(spark, d):
    return spearman(master(spark, d).select("dclm_score", "qr_educational_value"), "dclm_score", "qr_educational_value", []).select(r6(F.col("rho"), "rho"), "n")


@query(M + ", g AS (SELECT topic, avg(dclm_score) AS a, avg(qr_educational_value) AS b FROM m WHERE topic IS NOT NULL GROUP BY 1) SELECT round(corr(a, b), 6) AS between_r FROM g")
def agg_18_between_groups(spark, d):
    g = master(spark, d).where("topic IS NOT NULL").groupBy("topic").agg(F.avg("dclm_score").alias("a"), F.avg("qr_educational_value").alias("b"))
    return g.agg(r6(F.corr("a", "b"), "between_r"))


@query(M + ", c AS (SELECT dclm_score - avg(dclm_score) OVER (PARTITION BY topic) AS a, qr_educational_value - avg(qr_educational_value) OVER (PARTITION BY topic) AS b FROM m WHERE topic IS NOT NULL AND dclm_score IS NOT NULL AND qr_educational_value IS NOT NULL) SELECT round(corr(a, b), 6) AS within_r FROM c")
def agg_19_within_groups(spark, d):
    m = master(spark, d).where("topic IS NOT NULL AND dclm_score IS NOT NULL AND qr_educational_value IS NOT NULL").select("topic", "dclm_score", "qr_educational_value")
    g = m.groupBy("topic").agg(F.avg("dclm_score").alias("ma"), F.avg("qr_educational_value").alias("mb"))
    return m.join(joins.small(g), "topic").agg(r6(F.corr(F.col("dclm_score") - F.col("ma"), F.col("qr_educational_value") - F.col("mb")), "within_r"))


_WITHIN = M + f", c AS (SELECT topic, {_rank_sql('dclm_score', 'topic')} AS ra, {_rank_sql('qr_educational_value', 'topic')} AS rb FROM m WHERE topic IS NOT NULL AND dclm_score IS NOT NULL AND qr_educational_value IS NOT NULL), g AS (SELECT topic, corr(ra, rb) AS rho, count(*) AS n FROM c GROUP BY topic)"


@query(_WITHIN + " SELECT round(avg(CASE WHEN n >= 50 THEN rho END), 6) AS mean_rho, round(coalesce(sum(CASE WHEN n >= 100 THEN rho END), 0) / count(*), 6) AS over_all FROM g")
def agg_20_within_topic_spearman(spark, d):
    """Mean over topics of 50 rows or more, and the sum over topics of 100 or more divided by the number of all topics."""
    m = master(spark, d).where("topic IS NOT NULL").select("topic", "dclm_score", "qr_educational_value")
    g = spearman(m, "dclm_score", "qr_educational_value", ["topic"])
    return g.agg(r6(F.avg(F.when(F.col("n") >= 50, F.col("rho"))), "mean_rho"), r6(F.coalesce(F.sum(F.when(F.col("n") >= 100, F.col("rho"))), F.lit(0.0)) / F.count("*"), "over_all"))


@query(_WITHIN + " SELECT round(coalesce((SELECT sum(rho) FROM g WHERE n >= 100), 0) / (SELECT count(DISTINCT topic) FROM m WHERE topic IS NOT NULL), 6) AS mean_rho, (SELECT count(*) FROM g WHERE n >= 100 AND rho IS NOT NULL) AS topics")
def agg_21_within_topic_spearman_over_all(spark, d):
    """The sum over topics of 100 complete rows or more divided by the number of all topics, those without complete rows included."""
    m = master(spark, d).where("topic IS NOT NULL").select("topic", "dclm_score", "qr_educational_value")
    g = spearman(m, "dclm_score", "qr_educational_value", ["topic"]).where("n >= 100")
    every = m.agg(F.countDistinct("topic").alias("every"))  # one row
    return g.agg(F.coalesce(F.sum("rho"), F.lit(0.0)).alias("s"), F.count("rho").alias("topics")).join(F.broadcast(every)).select(r6(F.col("s") / F.col("every"), "mean_rho"), "topics")


@query(_WITHIN + f", x AS (SELECT {_rank_sql('dclm_score')} AS ra, {_rank_sql('qr_educational_value')} AS rb FROM m WHERE topic IS NOT NULL AND dclm_score IS NOT NULL AND qr_educational_value IS NOT NULL) SELECT topic, round((SELECT corr(ra, rb) FROM x) - rho, 6) AS drop FROM g ORDER BY drop DESC, topic LIMIT 10")
def agg_22_rank_agreement_drop(spark, d):
    m = master(spark, d).where("topic IS NOT NULL").select("topic", "dclm_score", "qr_educational_value")
    whole = spearman(m, "dclm_score", "qr_educational_value", []).select(F.col("rho").alias("all_rho"))
    g = spearman(m, "dclm_score", "qr_educational_value", ["topic"]).join(F.broadcast(whole))  # one row
    return g.select("topic", r6(F.col("all_rho") - F.col("rho"), "drop")).orderBy(F.desc("drop"), "topic").limit(10)


@query(M + ", g AS (SELECT topic, count(dclm_score) AS n, avg(dclm_score) AS mu FROM m WHERE topic IS NOT NULL GROUP BY 1), t AS (SELECT avg(dclm_score) AS mu, var_pop(dclm_score) * count(dclm_score) AS ss FROM m WHERE topic IS NOT NULL) SELECT round(sum(g.n * pow(g.mu - t.mu, 2)) / any_value(t.ss), 6) AS r2 FROM g, t")
def agg_23_anova_r2(spark, d):
    g = master(spark, d).where("topic IS NOT NULL").groupBy("topic").agg(F.count("dclm_score").alias("n"), F.avg("dclm_score").alias("mu"), F.var_pop("dclm_score").alias("v")).where("n > 0")
    whole = g.agg(F.sum("n").alias("nn"), (F.sum(F.col("n") * F.col("mu")) / F.sum("n")).alias("gm"), F.sum(F.col("n") * F.col("v")).alias("within"))
    b = g.join(F.broadcast(whole)).agg(F.sum(F.col("n") * F.pow(F.col("mu") - F.col("gm"), 2)).alias("b"), F.first("within").alias("w"))
    return b.select(r6(F.col("b") / (F.col("b") + F.col("w")), "r2"))


@query(M + ", c AS (SELECT format AS level, count(*) AS n FROM m WHERE format IS NOT NULL GROUP BY 1), p AS (SELECT n / sum(n) OVER () AS p FROM c) SELECT round(-sum(p * ln(p)), 6) AS entropy, round(CASE WHEN count(*) <= 1 THEN 0 ELSE -sum(p * ln(p)) / ln(count(*)) END, 6) AS normalised FROM p")
def agg_27_entropy(spark, d):
    c = master(spark, d).where("format IS NOT NULL").groupBy("format").agg(F.count("*").alias("n"))
    p = c.select((F.col("n") / F.expr("sum(n) OVER ()")).alias("p"))
    return p.agg(r6(stats.entropy(F.col("p")), "entropy"), r6(F.when(F.count("*") <= 1, 0.0).otherwise(stats.entropy(F.col("p")) / F.log(F.count("*").cast("double"))), "normalised"))


@query(M + ", c AS (SELECT topic, avg(dclm_score) AS e, count(*) AS n FROM m WHERE topic IS NOT NULL AND dclm_score IS NOT NULL GROUP BY 1), w AS (SELECT *, n / sum(n) OVER () AS w FROM c) SELECT round(greatest(sum(w * e * e) - pow(sum(w * e), 2), 0), 6) AS variance FROM w")
def agg_30_weighted_level_variance(spark, d):
    c = master(spark, d).where("topic IS NOT NULL AND dclm_score IS NOT NULL").groupBy("topic").agg(F.avg("dclm_score").alias("e"), F.count("*").alias("n"))
    w = c.withColumn("w", F.col("n") / F.expr("sum(n) OVER ()"))
    return w.agg(r6(F.greatest(F.sum(F.col("w") * F.col("e") * F.col("e")) - F.pow(F.sum(F.col("w") * F.col("e")), F.lit(2)), F.lit(0.0)), "variance"))


@query(ML + ", v AS (SELECT feature, var_pop(x) AS v FROM l GROUP BY 1) SELECT feature, CASE WHEN sum(v) OVER () > 0 THEN round(v / sum(v) OVER (), 6) END AS share FROM v")
def agg_31_variance_shares(spark, d):
    v = long(spark, d).groupBy("feature").agg(F.var_pop("x").alias("v"))
    total = F.expr("sum(v) OVER ()")
    return v.select("feature", F.when(total > 0, F.round(F.col("v") / total, 6)).alias("share"))


@query("SELECT l_orderkey, round(sum(l_discount * l_extendedprice) / greatest(sum(l_extendedprice), 1), 6) AS weighted FROM lineitem GROUP BY l_orderkey")
def agg_32_length_weighted_mean(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(r6(F.sum(F.col("l_discount") * F.col("l_extendedprice")) / F.greatest(F.sum("l_extendedprice"), F.lit(1.0)), "weighted"))


@query(M + ", a AS (SELECT topic, sum(token_count) / sum(sum(token_count)) OVER () AS w FROM m WHERE topic IS NOT NULL AND token_count > 0 GROUP BY 1), t AS (SELECT domain AS topic, weight FROM mixtures WHERE mix_id = 1), c AS (SELECT topic, least(weight, w / 0.15) AS c FROM t JOIN a USING (topic)) SELECT topic, round(c / sum(c) OVER (), 6) AS weight FROM c")
def agg_34_capped_renormalisation(spark, d):
    by = master(spark, d).where("topic IS NOT NULL AND token_count > 0").groupBy("topic").agg(F.sum("token_count").alias("t"))
    a = by.select("topic", (F.col("t") / F.expr("sum(t) OVER ()")).alias("w"))
    t = table(spark, d, "mixtures").where("mix_id = 1").select(F.col("domain").alias("topic"), "weight")
    c = t.join(joins.small(a), "topic").withColumn("c", F.least("weight", F.col("w") / 0.15))
    return c.select("topic", r6(F.col("c") / F.expr("sum(c) OVER ()"), "weight"))


_RESULTS = [("V0", "random", 4.2390, 100), ("V1", "dclm", 4.3405, 90), ("V2", "fwedu", 4.3001, 80), ("V3", "random", 4.2501, 70), ("V4", "random", 4.2440, 60), ("V5", "fwedu", None, 50)]
_RESULT_SQL = "r AS (SELECT rid, family, CAST(loss AS DOUBLE) AS loss, n FROM (VALUES " + ", ".join(f"('{a}', '{b}', {'NULL' if c is None else c}, {e})" for a, b, c, e in _RESULTS) + ") v(rid, family, loss, n))"


@query("WITH " + _RESULT_SQL + " SELECT family, round(avg(loss), 6) AS mean_loss, arg_min(rid, loss) AS best, arg_max(rid, loss) AS worst, round(max(loss) - min(loss), 6) AS spread, round(avg(loss) - (SELECT avg(loss) FROM r WHERE family = 'random'), 6) AS gap FROM r WHERE loss IS NOT NULL GROUP BY family")
def agg_35_leaderboard(spark, d):
    r = spark.createDataFrame(_RESULTS, "rid string, family string, loss double, n int").where("loss IS NOT NULL")
    base = r.where("family = 'random'").agg(F.avg("loss").alias("base"))
    return r.groupBy("family").agg(F.avg("loss").alias("m"), F.min_by("rid", "loss").alias("best"), F.max_by("rid", "loss").alias("worst"), F.round(F.max("loss") - F.min("loss"), 6).alias("spread")).join(F.broadcast(base)).select("family", r6(F.col("m"), "mean_loss"), "best", "worst", "spread", r6(F.col("m") - F.col("base"), "gap"))


@query(M + "SELECT topic, round(sqrt(avg(pow(dclm_score - textbook_quality, 2))), 6) AS rmse, round(avg(abs(dclm_score - textbook_quality)), 6) AS mae, CASE WHEN var_pop(textbook_quality) * count(*) > 1e-12 THEN round(1 - avg(pow(dclm_score - textbook_quality, 2)) / var_pop(textbook_quality), 5) END AS r2 FROM m WHERE topic IS NOT NULL AND dclm_score IS NOT NULL AND textbook_quality IS NOT NULL GROUP BY topic")
def agg_37_regression_metrics(spark, d):
    e = F.col("dclm_score") - F.col("textbook_quality")
    y = F.col("textbook_quality")
    return master(spark, d).where("topic IS NOT NULL AND dclm_score IS NOT NULL AND textbook_quality IS NOT NULL").groupBy("topic").agg(r6(F.sqrt(F.avg(e * e)), "rmse"), r6(F.avg(F.abs(e)), "mae"), F.when(F.var_pop(y) * F.count("*") > 1e-12, F.round(1 - F.avg(e * e) / F.var_pop(y), 5)).alias("r2"))


@query("WITH t AS (SELECT doc_id, arg_max(topic, labelled_at) AS truth FROM labels WHERE topic IS NOT NULL GROUP BY 1), p AS (SELECT shard_idx, doc_idx, arg_max(topic, annotated_at) AS guess, arg_max(topic_confidence, annotated_at) AS conf FROM domains_topics WHERE NOT isnan(topic_confidence) AND topic IS NOT NULL AND topic_confidence IS NOT NULL GROUP BY 1, 2), j AS (SELECT truth, CASE WHEN guess = truth THEN 1.0 ELSE 0.0 END AS hit, conf FROM documents JOIN t USING (doc_id) JOIN p USING (shard_idx, doc_idx)) SELECT truth, count(*) AS n, round(avg(hit), 6) AS accuracy, round(avg(CASE WHEN conf > 0.75 THEN hit END), 6) AS accuracy_sure, round(avg(CASE WHEN conf > 0.75 THEN 1.0 ELSE 0.0 END), 6) AS sure FROM j GROUP BY truth")
def agg_38_classification_metrics(spark, d):
    t = table(spark, d, "labels").where("topic IS NOT NULL").groupBy("doc_id").agg(F.max_by("topic", "labelled_at").alias("truth"))
    p = table(spark, d, "domains_topics").where("topic IS NOT NULL AND topic_confidence IS NOT NULL AND NOT isnan(topic_confidence)").groupBy(*KEY).agg(F.max_by("topic", "annotated_at").alias("guess"), F.max_by("topic_confidence", "annotated_at").alias("conf"))
    j = table(spark, d, "documents").select("doc_id", *KEY).join(t, "doc_id").join(p, KEY).withColumn("hit", F.when(F.col("guess") == F.col("truth"), 1.0).otherwise(0.0))
    sure = F.col("conf") > F.lit(0.75)
    return j.groupBy("truth").agg(F.count("*").alias("n"), r6(F.avg("hit"), "accuracy"), r6(F.avg(F.when(sure, F.col("hit"))), "accuracy_sure"), r6(F.avg(F.when(sure, 1.0).otherwise(0.0)), "sure"))


@query(M + ", b AS (SELECT least(10, CAST(floor(dclm_score * 10) AS INTEGER) + 1) AS bin, qr_educational_value AS y FROM m WHERE dclm_score BETWEEN 0 AND 1 AND qr_educational_value IS NOT NULL) SELECT bin, count(*) AS n, round(avg(y), 6) AS mean FROM b GROUP BY bin HAVING count(*) > 50")
def agg_39_binned_mean(spark, d):
    b = master(spark, d).where("dclm_score BETWEEN 0 AND 1 AND qr_educational_value IS NOT NULL").select(stats.equal_bin(F.col("dclm_score"), F.lit(0.0), F.lit(1.0), 10).alias("bin"), F.col("qr_educational_value").alias("y"))
    return b.groupBy("bin").agg(F.count("*").alias("n"), r6(F.avg("y"), "mean")).where("n > 50")


@query(M + ", r AS (SELECT min(word_count) AS lo, max(word_count) AS hi FROM m WHERE word_count IS NOT NULL) SELECT least(30, CAST(floor((word_count - lo) / CAST(hi - lo AS DOUBLE) * 30) AS INTEGER) + 1) AS bin, count(*) AS n FROM m, r WHERE word_count IS NOT NULL GROUP BY 1")
def agg_40_histogram(spark, d):
    m = master(spark, d).where("word_count IS NOT NULL").select(F.col("word_count").cast("double").alias("x"))
    r = m.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))  # one row
    return m.join(F.broadcast(r)).groupBy(stats.equal_bin(F.col("x"), F.col("lo"), F.col("hi"), 30).alias("bin")).agg(F.count("*").alias("n"))


@query(M + "SELECT least(20, CAST(floor(dclm_score * 20) AS INTEGER) + 1) AS bx, least(20, CAST(floor(frac_alpha * 20) AS INTEGER) + 1) AS b_y, count(*) AS n FROM m WHERE dclm_score BETWEEN 0 AND 1 AND frac_alpha BETWEEN 0 AND 1 GROUP BY 1, 2")
def agg_41_two_dimensional_bins(spark, d):
    b = lambda c: stats.equal_bin(F.col(c), F.lit(0.0), F.lit(1.0), 20)
    return master(spark, d).where("dclm_score BETWEEN 0 AND 1 AND frac_alpha BETWEEN 0 AND 1").groupBy(b("dclm_score").alias("bx"), b("frac_alpha").alias("b_y")).agg(F.count("*").alias("n"))


@query(M + "SELECT topic, round(quantile_cont(dclm_score, 0.25), 6) AS q1, round(quantile_cont(dclm_score, 0.5), 6) AS q2, round(quantile_cont(dclm_score, 0.75), 6) AS q3 FROM m WHERE topic IS NOT NULL AND dclm_score IS NOT NULL GROUP BY topic HAVING count(*) >= 100")
def agg_42_quartiles_by_group(spark, d):
    m = master(spark, d).where("topic IS NOT NULL AND dclm_score IS NOT NULL").select("topic", "dclm_score")
    big = m.groupBy("topic").count().where("count >= 100").select("topic")
    q = quantiles(m.join(joins.small(big), "topic", "left_semi"), "dclm_score", [0.25, 0.5, 0.75], ["topic"])
    return q.groupBy("topic").pivot("p", [0.25, 0.5, 0.75]).agg(F.round(F.first("value"), 6)).toDF("topic", "q1", "q2", "q3")


@query(M + "SELECT topic, round(regr_slope(qr_educational_value, dclm_score), 6) AS slope, round(regr_intercept(qr_educational_value, dclm_score), 6) AS intercept, round(corr(qr_educational_value, dclm_score), 6) AS r FROM m WHERE topic IS NOT NULL AND dclm_score IS NOT NULL AND qr_educational_value IS NOT NULL GROUP BY topic")
def agg_43_linear_fit(spark, d):
    return master(spark, d).where("topic IS NOT NULL AND dclm_score IS NOT NULL AND qr_educational_value IS NOT NULL").groupBy("topic").agg(r6(F.regr_slope("qr_educational_value", "dclm_score"), "slope"), r6(F.regr_intercept("qr_educational_value", "dclm_score"), "intercept"), r6(F.corr("qr_educational_value", "dclm_score"), "r"))


@query(M + ", t AS (SELECT avg(frac_alpha) AS mu, stddev_pop(frac_alpha) AS sd FROM m WHERE in_train_pool) SELECT shard_idx, doc_idx, round((frac_alpha - mu) / CASE WHEN sd < 1e-8 THEN 1 ELSE sd END, 6) AS z FROM m, t WHERE frac_alpha IS NOT NULL")
def agg_45_standardise_on_train(spark, d):
    m = master(spark, d).where("frac_alpha IS NOT NULL").select(*KEY, "in_train_pool", "frac_alpha")
    t = m.where("in_train_pool").agg(F.avg("frac_alpha").alias("mu"), F.stddev_pop("frac_alpha").alias("sd"))  # one row
    return m.join(F.broadcast(t)).select(*KEY, r6((F.col("frac_alpha") - F.col("mu")) / F.when(F.col("sd") < 1e-8, 1.0).otherwise(F.col("sd")), "z"))


@query(ML + " SELECT feature, round(min(x), 6) AS lo, round(max(x), 6) AS hi, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM l WHERE x IS NOT NULL GROUP BY feature")
def agg_46_raw_ranges(spark, d):
    return long(spark, d).where("x IS NOT NULL").groupBy("feature").agg(r6(F.min("x"), "lo"), r6(F.max("x"), "hi"), r6(F.avg("x"), "mean"), r6(F.stddev_pop("x"), "std"))


@query(M + "SELECT shard_idx, doc_idx, round((x - lo) / (hi - lo + 1e-12), 6) AS scaled FROM (SELECT shard_idx, doc_idx, dclm_score AS x FROM m WHERE dclm_score IS NOT NULL), (SELECT min(dclm_score) AS lo, max(dclm_score) AS hi FROM m)")
def agg_54_min_max_scale(spark, d):
    m = master(spark, d).where("dclm_score IS NOT NULL").select(*KEY, "dclm_score")
    r = m.agg(F.min("dclm_score").alias("lo"), F.max("dclm_score").alias("hi"))  # one row
    return m.join(F.broadcast(r)).select(*KEY, r6((F.col("dclm_score") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-12), "scaled"))


@query("SELECT item_id, gold, CAST(list_position(n, list_min(n)) - 1 AS INTEGER) AS chosen, list_position(n, list_min(n)) - 1 = gold AS correct FROM (SELECT item_id, gold, [len(c) for c in completions] AS n FROM eval_items)")
def agg_48_multiple_choice(spark, d):
    """The option of least loss per item, the first of equal ones; loss is any column, here the length of the option."""
    n = F.transform("completions", F.length)
    chosen = (F.array_position(n, F.array_min(n)) - 1).cast("int")
    return table(spark, d, "eval_items").select("item_id", "gold", chosen.alias("chosen"), (chosen == F.col("gold")).alias("correct"))


@query("SELECT vec_id, CAST(list_position(v, list_max(v)) - 1 AS INTEGER) AS best, round(list_max(v) - (m + ln(list_sum([exp(x - m) for x in v]))), 6) AS log_prob FROM (SELECT vec_id, v, list_max(v) AS m FROM (SELECT vec_id, [CAST(x AS DOUBLE) for x in embedding[1:8]] AS v FROM embeddings))")
def agg_49_option_log_probabilities(spark, d):
    from ..functions.vector import argmax, log_softmax

    v = F.slice("embedding", 1, 8)
    return table(spark, d, "embeddings").select("vec_id", argmax(v).alias("best"), r6(F.array_max(log_softmax(v)), "log_prob"))


@query("SELECT user_id, round(sum(abs(value)) / count(*), 6) AS loss, round(sum(sum(abs(value))) OVER () / sum(count(*)) OVER (), 6) AS corpus_loss FROM events GROUP BY user_id")
def agg_50_sequence_loss(spark, d):
    by = table(spark, d, "events").groupBy("user_id").agg(F.sum(F.abs("value")).alias("s"), F.count("*").alias("n"))
    return by.select("user_id", r6(F.col("s") / F.col("n"), "loss"), r6(F.expr("sum(s) OVER ()") / F.expr("sum(n) OVER ()"), "corpus_loss"))


@query("WITH c AS (SELECT event_type AS chain, count(*) AS n, avg(value) AS mu, var_samp(value) AS v FROM events GROUP BY 1) SELECT round(sqrt(((avg(n) - 1) / avg(n) * avg(v) + var_samp(mu)) / avg(v)), 6) AS r_hat FROM c")
def agg_51_r_hat(spark, d):
    """Potential scale reduction over chains of about equal length: between-chain against within-chain variance."""
    c = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mu"), F.var_samp("value").alias("v"))
    return c.agg(r6(F.sqrt(((F.avg("n") - 1) / F.avg("n") * F.avg("v") + F.var_samp("mu")) / F.avg("v")), "r_hat"))


@query(M + "SELECT topic, CAST(sum(CASE WHEN dclm_score >= 0.5 THEN token_count ELSE 0 END) AS BIGINT) AS selected, round(sum(CASE WHEN dclm_score >= 0.5 THEN token_count ELSE 0 END) / sum(token_count) * 100, 6) AS pct FROM m WHERE topic IS NOT NULL AND token_count > 0 GROUP BY topic")
def agg_56_selection_report(spark, d):
    chosen = F.when(F.col("dclm_score") >= 0.5, F.col("token_count")).otherwise(0)
    return master(spark, d).where("topic IS NOT NULL AND token_count > 0").groupBy("topic").agg(F.sum(chosen).alias("selected"), r6(F.sum(chosen) / F.sum("token_count") * 100, "pct"))


@query(M + ", s AS (SELECT 'dclm' AS kind, 1 AS run, sum(token_count) AS t FROM m WHERE dclm_score >= 0.5 UNION ALL SELECT 'dclm', 2, sum(token_count) FROM m WHERE dclm_score >= 0.95 UNION ALL SELECT 'fwedu', 3, sum(token_count) FROM m WHERE fwedu_rounded >= 3) SELECT kind, coalesce(t, 0) >= 50000 AS kept, count(*) AS n FROM s GROUP BY 1, 2")
def agg_57_config_tally(spark, d):
    m = master(spark, d)
    tests = [("dclm", F.col("dclm_score") >= 0.5), ("dclm", F.col("dclm_score") >= 0.95), ("fwedu", F.col("fwedu_rounded") >= 3)]
    one = m.agg(*[F.coalesce(F.sum(F.when(t, F.col("token_count"))), F.lit(0)).alias(f"{k}_{i}") for i, (k, t) in enumerate(tests)])  # one pass for all configurations
    return one.unpivot([], one.columns, "run", "t").groupBy(F.split("run", "_")[0].alias("kind"), (F.col("t") >= 50000).alias("kept")).agg(F.count("*").alias("n"))


def difference_in_means(masks, runs, docs, least: int):
    """Per document the mean quality of the runs that include it less that of those that don't; 0 below ``least`` runs.

    ``masks(run_id, key...)`` long, ``runs(run_id, loss)`` short: quality is the
    loss scaled to 0..1 and turned round; what excludes a document is the total less what includes it.
    """
    q = runs.where("loss IS NOT NULL").withColumn("q", stats.min_max(-F.col("loss")))
    total = q.agg(F.sum("q").alias("tq"), F.count("*").alias("tn"))  # one row
    by = masks.join(joins.small(q.select("run_id", "q")), "run_id").groupBy(*KEY).agg(F.sum("q").alias("sq"), F.count("*").alias("n"))
    x = docs.join(by, KEY, "left").fillna(0, ["sq", "n"]).join(F.broadcast(total))
    outside = F.coalesce((F.col("tq") - F.col("sq")) / F.nullif(F.col("tn") - F.col("n"), F.lit(0)), F.lit(0.0))
    target = F.when(F.col("n") < least, 0.0).otherwise(F.col("sq") / F.nullif(F.col("n"), F.lit(0)) - outside)
    return x.select(*KEY, r6(target, "target"), F.col("n").alias("runs"))


def difference_by_tests(docs, tests: dict, losses: dict, least: int):
    """``difference_in_means`` where a run includes what passes its test: the runs are a short list, so a row sums over them itself and nothing is shuffled."""
    known = {i: v for i, v in losses.items() if v is not None and i in tests}
    if not known:
        return docs.select(*KEY, F.lit(0.0).alias("target"), F.lit(0).cast("bigint").alias("runs"))
    lo, hi = min(known.values()), max(known.values())
    q = {i: (hi - v) / (hi - lo + 1e-12) for i, v in known.items()}
    n = reduce(lambda a, b: a + b, [F.when(tests[i], 1).otherwise(0) for i in q]).cast("bigint")
    inside = reduce(lambda a, b: a + b, [F.when(tests[i], v).otherwise(0.0) for i, v in q.items()])
    x = docs.withColumns({"__n": n, "__q": inside})
    outside = F.coalesce((F.lit(sum(q.values())) - F.col("__q")) / F.nullif(F.lit(len(q)) - F.col("__n"), F.lit(0)), F.lit(0.0))
    target = F.when(F.col("__n") < least, 0.0).otherwise(F.col("__q") / F.nullif(F.col("__n"), F.lit(0)) - outside)
    return x.select(*KEY, r6(target, "target"), F.col("__n").alias("runs"))


@query(M + ", run AS (SELECT * FROM (VALUES (1, 4.2), (2, 4.4), (3, 4.3), (4, NULL)) v(run_id, loss)), q AS (SELECT run_id, (max(loss) OVER () - loss) / (max(loss) OVER () - min(loss) OVER () + 1e-12) AS q FROM run WHERE loss IS NOT NULL), k AS (SELECT shard_idx, doc_idx, 1 AS run_id FROM m WHERE dclm_score >= 0.5 UNION ALL SELECT shard_idx, doc_idx, 2 FROM m WHERE frac_alpha >= 0.78 UNION ALL SELECT shard_idx, doc_idx, 3 FROM m WHERE fwedu_rounded >= 2), b AS (SELECT shard_idx, doc_idx, sum(q) AS sq, count(*) AS n FROM k JOIN q USING (run_id) GROUP BY 1, 2), t AS (SELECT sum(q) AS tq, count(*) AS tn FROM q) SELECT shard_idx, doc_idx, coalesce(n, 0) AS runs, round(CASE WHEN coalesce(n, 0) < 1 THEN 0.0 ELSE sq / n - coalesce((tq - sq) / nullif(tn - n, 0), 0) END, 6) AS target FROM m LEFT JOIN b USING (shard_idx, doc_idx), t")
def agg_25_difference_in_means(spark, d):
    m = master(spark, d).select(*KEY, "dclm_score", "frac_alpha", "fwedu_rounded")
    tests = {1: F.col("dclm_score") >= 0.5, 2: F.col("frac_alpha") >= 0.78, 3: F.col("fwedu_rounded") >= 2}
    return difference_by_tests(m, tests, {1: 4.2, 2: 4.4, 3: 4.3, 4: None}, 1)


_MASKS = M + """, r AS (SELECT * FROM (VALUES ('A', 'high score', 4.24), ('B', 'plain letters', 4.31), ('C', 'educational', 4.28), ('D', 'in flight', NULL)) v(run, strategy, loss)),
k AS (SELECT 'A' AS run, * FROM m WHERE dclm_score >= 0.5 UNION ALL SELECT 'B', * FROM m WHERE frac_alpha >= 0.78 UNION ALL SELECT 'C', * FROM m WHERE fwedu_rounded >= 2 UNION ALL SELECT 'D', * FROM m WHERE topic = 1),
c AS (SELECT run, strategy, CAST(loss AS DOUBLE) AS loss, count(*) AS n_sel, count(*) / (SELECT count(*) FROM m) AS frac, avg(dclm_score) AS dclm, avg(fwedu_rounded) AS fwedu, avg(textbook_quality) AS textbook FROM k JOIN r USING (run) WHERE loss IS NOT NULL GROUP BY 1, 2, 3)
"""


def calibration(docs, tests: dict, runs, scores: dict):
    """Per finished run of ``runs(run, strategy, loss)`` the rows it selects, their share, and the mean of each score over them; one pass over the rows for all runs."""
    whole = docs.agg(F.count("*").alias("__all"), *[c for i, t in tests.items() for c in (F.count(F.when(t, 1)).alias(f"{i}|n_sel"), *[F.avg(F.when(t, F.col(s))).alias(f"{i}|{name}") for name, s in scores.items()])]).first()
    rows = [(str(i), int(whole[f"{i}|n_sel"]), whole[f"{i}|n_sel"] / max(whole["__all"], 1), *[whole[f"{i}|{name}"] for name in scores]) for i in tests]
    table_ = docs.sparkSession.createDataFrame(rows, "run string, n_sel bigint, frac double, " + ", ".join(f"`{n}` double" for n in scores))
    return runs.where("loss IS NOT NULL").join(F.broadcast(table_), "run").where("n_sel > 0")


def _calibration(spark, d):
    tests = {"A": F.col("dclm_score") >= 0.5, "B": F.col("frac_alpha") >= 0.78, "C": F.col("fwedu_rounded") >= 2, "D": F.col("topic") == 1}
    runs = spark.createDataFrame([("A", "high score", 4.24), ("B", "plain letters", 4.31), ("C", "educational", 4.28), ("D", "in flight", None)], "run string, strategy string, loss double")
    return calibration(master(spark, d), tests, runs, {"dclm": "dclm_score", "fwedu": "fwedu_rounded", "textbook": "textbook_quality"})


@query(_MASKS + "SELECT run, strategy, loss, n_sel, round(frac, 6) AS frac, round(dclm, 6) AS dclm, round(fwedu, 6) AS fwedu, round(textbook, 6) AS textbook FROM c")
def agg_36_calibration_table(spark, d):
    """What each finished run selected, beside its loss."""
    return _calibration(spark, d).select("run", "strategy", "loss", "n_sel", *[r6(F.col(c), c) for c in ("frac", "dclm", "fwedu", "textbook")])


@query(_MASKS + "SELECT (SELECT arg_min(run, loss) FROM c) AS best, min(loss) AS best_loss, (SELECT arg_max(run, loss) FROM c) AS worst, max(loss) AS worst_loss, round(max(loss) - min(loss), 6) AS spread FROM c")
def agg_36_best_and_worst(spark, d):
    return _calibration(spark, d).agg(F.min_by("run", "loss").alias("best"), F.min("loss").alias("best_loss"), F.max_by("run", "loss").alias("worst"), F.max("loss").alias("worst_loss"), r6(F.max("loss") - F.min("loss"), "spread"))


@query(M + ", k AS (SELECT shard_idx, doc_idx, CAST(dclm_score >= 0.5 AS INTEGER) + CAST(frac_alpha >= 0.78 AS INTEGER) AS n FROM m WHERE dclm_score IS NOT NULL AND frac_alpha IS NOT NULL) SELECT round(avg(n), 6) AS mean, min(n) AS lo, max(n) AS hi FROM k")
def agg_26_coverage_per_document(spark, d):
    n = reduce(lambda a, b: a + b, [(F.col("dclm_score") >= 0.5).cast("int"), (F.col("frac_alpha") >= 0.78).cast("int")])
    return master(spark, d).where("dclm_score IS NOT NULL AND frac_alpha IS NOT NULL").select(n.alias("n")).agg(r6(F.avg("n"), "mean"), F.min("n").alias("lo"), F.max("n").alias("hi"))
