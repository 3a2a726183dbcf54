"""Projections, joins, windows, sorts and set operations over the corpus tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import joins, prefix, selection
from ..operators.quantiles import threshold
from ..schema import KEY, existing, minus_one_to_null, nan_to_null
from .base import M, master, query, r6, table

#: Ties are broken by key.
K = KEY


# projections and filters ----------------------------------------------------


@query("SELECT __shard_idx AS shard_idx, __doc_idx AS doc_idx, CASE WHEN CAST(pc_arc_easy AS VARCHAR) = 'nan' THEN NULL ELSE pc_arc_easy END AS pc_arc, CAST(topic AS BIGINT) AS topic_code, 1 AS one, CAST(CASE WHEN fwedu_rounded >= 0 THEN fwedu_rounded END AS FLOAT) AS fwedu FROM master")
def proj_01_rename_cast_constant(spark, d):
    m = minus_one_to_null(nan_to_null(table(spark, d, "master")))
    return m.select(F.col("__shard_idx").alias("shard_idx"), F.col("__doc_idx").alias("doc_idx"), F.col("pc_arc_easy").alias("pc_arc"), F.col("topic").cast("bigint").alias("topic_code"), F.lit(1).alias("one"), F.col("fwedu_rounded").cast("float").alias("fwedu"))


@query("SELECT doc_id, CAST(row_number() OVER (ORDER BY shard_idx, doc_idx, doc_id) - 1 AS BIGINT) AS row_id FROM documents")
def proj_04_surrogate_row_id(spark, d):
    n = prefix.row_numbers(table(spark, d, "documents").select("doc_id", *KEY), [], [*[F.col(c).asc_nulls_last() for c in K], F.col("doc_id").asc()], "n")
    return n.select("doc_id", (F.col("n") - 1).cast("bigint").alias("row_id"))


@query(M + ", t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY shard_idx, doc_idx ORDER BY annotated_at DESC) AS rn FROM tokens) WHERE rn = 1) SELECT shard_idx, doc_idx, coalesce(CASE WHEN t.token_count >= 0 THEN t.token_count END, m.token_count, -1) AS token_count FROM m LEFT JOIN t USING (shard_idx, doc_idx)")
def proj_05_missing_source_default(spark, d):
    from ..schema import newest

    t = minus_one_to_null(newest(table(spark, d, "tokens"), KEY, "annotated_at")).select(*KEY, F.col("token_count").alias("own"))
    return master(spark, d).select(*KEY, "token_count").join(t, KEY, "left").select(*KEY, F.coalesce("own", "token_count", F.lit(-1)).alias("token_count"))


@query(M + "SELECT shard_idx, doc_idx, topic, format FROM m WHERE dclm_score IS NOT NULL AND fwedu_rounded IS NOT NULL AND topic IS NOT NULL AND format IS NOT NULL")
def proj_06_drop_null_rows(spark, d):
    return master(spark, d).na.drop(subset=["dclm_score", "fwedu_rounded", "topic", "format"]).select(*KEY, "topic", "format")


@query(M + ", top AS (SELECT domain FROM m WHERE domain IS NOT NULL GROUP BY domain ORDER BY count(*) DESC, domain LIMIT 10) SELECT shard_idx, doc_idx, domain FROM m WHERE domain IN (SELECT domain FROM top)")
def proj_07_set_membership(spark, d):
    m = master(spark, d).select(*KEY, "domain")
    top = m.where("domain IS NOT NULL").groupBy("domain").count().orderBy(F.desc("count"), "domain").limit(10)
    return m.join(F.broadcast(top.select("domain")), "domain", "left_semi").select(*KEY, "domain")


@query(M + "SELECT shard_idx, doc_idx FROM m WHERE topic = 1 AND format = 0")
def proj_08_composite_key(spark, d):
    return master(spark, d).where(F.struct("topic", "format") == F.struct(F.lit(1), F.lit(0))).select(*KEY)


@query(M + "SELECT shard_idx, doc_idx, dclm_score >= 0.5 AS high, dclm_score <= 0.1 AS low FROM m WHERE dclm_score >= 0.5 OR dclm_score <= 0.1")
def proj_09_threshold(spark, d):
    s = F.col("dclm_score")
    return master(spark, d).where((s >= 0.5) | (s <= 0.1)).select(*KEY, (s >= 0.5).alias("high"), (s <= 0.1).alias("low"))


@query(M + "SELECT shard_idx, doc_idx FROM m WHERE dclm_score >= 0.2 AND frac_alpha >= 0.6 AND word_count <= 2000")
def proj_10_conjunction(spark, d):
    return master(spark, d).where("dclm_score >= 0.2 AND frac_alpha >= 0.6 AND word_count <= 2000").select(*KEY)


@query(M + ", x AS (SELECT *, coalesce(domain, 'MISSING') AS dom FROM m), top AS (SELECT dom FROM x GROUP BY dom ORDER BY count(*) DESC, dom LIMIT 8) SELECT CASE WHEN dom IN (SELECT dom FROM top) THEN dom ELSE 'OTHER' END AS bucket, count(*) AS n FROM x GROUP BY 1")
def proj_11_other_bucket(spark, d):
    x = master(spark, d).select(F.coalesce("domain", F.lit("MISSING")).alias("dom"))
    counts = x.groupBy("dom").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "dom").limit(8).select("dom", F.lit(True).alias("hit"))
    return counts.join(F.broadcast(top), "dom", "left").groupBy(F.when(F.col("hit"), F.col("dom")).otherwise("OTHER").alias("bucket")).agg(F.sum("n").alias("n"))


@query(M + "SELECT 'dclm_score' AS feature, round(count(dclm_score) / count(*), 6) AS coverage FROM m HAVING count(dclm_score) >= 0.1 * count(*) UNION ALL SELECT 'qr_writing_style', round(count(qr_writing_style) / count(*), 6) FROM m HAVING count(qr_writing_style) >= 0.1 * count(*) UNION ALL SELECT 'ai_generated', round(count(ai_generated) / count(*), 6) FROM m HAVING count(ai_generated) >= 0.1 * count(*)")
def proj_13_coverage_gate(spark, d):
    cols = existing(master(spark, d), ("dclm_score", "qr_writing_style", "ai_generated", "not_there"))
    one = master(spark, d).agg(*[(F.count(c) / F.count("*")).alias(c) for c in cols])
    return one.unpivot([], cols, "feature", "coverage").where("coverage >= 0.1").select("feature", r6(F.col("coverage"), "coverage"))


@query(M + "SELECT shard_idx, doc_idx, greatest(least(dclm_score, 1.0), 0.0) AS clipped, CAST(round_even(greatest(least(qr_educational_value, 5.0), 0.0), 0) AS INTEGER) AS rounded, dclm_score >= 0.5 AND dclm_score IS NOT NULL AS good FROM m WHERE dclm_score IS NOT NULL AND qr_educational_value IS NOT NULL")
def proj_14_clip_round_guard(spark, d):
    s = F.col("dclm_score")
    return master(spark, d).where("dclm_score IS NOT NULL AND qr_educational_value IS NOT NULL").select(*KEY, stats.clip(s, 0.0, 1.0).alias("clipped"), stats.clamp_round(F.col("qr_educational_value"), 0, 5).alias("rounded"), ((s >= 0.5) & s.isNotNull()).alias("good"))


@query(M + " SELECT feature, round(std, 6) AS std, std < 0.01 AS flat FROM (SELECT 'frac_digit' AS feature, stddev_samp(frac_digit) AS std FROM m UNION ALL SELECT 'frac_alpha', stddev_samp(frac_alpha) FROM m UNION ALL SELECT 'word_count', stddev_samp(word_count) FROM m)")
def proj_16_quality_flags(spark, d):
    cols = ["frac_digit", "frac_alpha", "word_count"]
    one = master(spark, d).agg(*[F.stddev_samp(c).alias(c) for c in cols])
    return one.unpivot([], cols, "feature", "std").select("feature", r6(F.col("std"), "std"), (F.col("std") < 0.01).alias("flat"))


# joins ----------------------------------------------------------------------


@query(M + "SELECT doc_id, lang, topic, round(dclm_score, 6) AS dclm_score FROM documents JOIN m USING (shard_idx, doc_idx)")
def join_01_inner_on_key(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", *KEY).join(master(spark, d).select(*KEY, "topic", "dclm_score"), KEY).select("doc_id", "lang", "topic", r6(F.col("dclm_score"), "dclm_score"))


@query(M + "SELECT d.doc_id, m.format FROM documents d JOIN m USING (shard_idx, doc_idx)")
def join_02_one_to_one(spark, d):
    return joins.one_to_one(table(spark, d, "documents").select("doc_id", *KEY), master(spark, d).select(*KEY, "format"), KEY).select("doc_id", "format")


_LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY shard_idx, doc_idx ORDER BY annotated_at DESC) AS rn FROM {0}) WHERE rn = 1)"


@query(f"SELECT doc_id, t.token_count, p.topic, f.format FROM documents LEFT JOIN {_LATEST.format('tokens')} t USING (shard_idx, doc_idx) LEFT JOIN {_LATEST.format('domains_topics')} p USING (shard_idx, doc_idx) LEFT JOIN {_LATEST.format('domains_formats')} f USING (shard_idx, doc_idx)")
def join_03_left_chain(spark, d):
    from ..schema import newest

    others = [newest(table(spark, d, t), KEY, "annotated_at").select(*KEY, c) for t, c in (("tokens", "token_count"), ("domains_topics", "topic"), ("domains_formats", "format"))]
    return joins.left_chain(table(spark, d, "documents").select("doc_id", *KEY), others, KEY).drop(*KEY)


@query("SELECT vec_id, CAST(vec_id % 70 AS INTEGER) AS at, CASE WHEN vec_id % 70 < len(embedding) THEN embedding[CAST(vec_id % 70 AS INTEGER) + 1] END AS v FROM embeddings")
def join_04_positional_gather(spark, d):
    e = table(spark, d, "embeddings")
    return joins.gather(e.select("vec_id", (F.col("vec_id") % 70).cast("int").alias("at")), e, "vec_id", "embedding", "at", "v").select("vec_id", "at", "v")


@query("WITH k AS (SELECT DISTINCT shard_idx, doc_idx FROM tokens WHERE token_count > 0), fit AS (SELECT a.shard_idx FROM (SELECT shard_idx, count(*) AS n FROM documents GROUP BY 1) a JOIN (SELECT shard_idx, count(*) AS n FROM k GROUP BY 1) b USING (shard_idx) WHERE a.n <= b.n AND b.n <= a.n) SELECT doc_id, CASE WHEN k.doc_idx IS NOT NULL AND d.shard_idx IN (SELECT shard_idx FROM fit) THEN 1 END AS hit FROM documents d LEFT JOIN k USING (shard_idx, doc_idx)")
def join_05_length_guard(spark, d):
    k = table(spark, d, "tokens").where("token_count > 0").select(*KEY).distinct().withColumn("hit", F.lit(1))
    return joins.length_guarded(table(spark, d, "documents").select("doc_id", *KEY), k, "shard_idx", KEY, ["hit"]).select("doc_id", "hit")


@query(M + "SELECT shard_idx, doc_idx, t.name AS topic_name, f.name AS format_name FROM m LEFT JOIN (SELECT * FROM taxonomy WHERE kind = 'topic') t ON t.code = topic LEFT JOIN (SELECT * FROM taxonomy WHERE kind = 'format') f ON f.code = format")
def join_06_dictionary_lookup(spark, d):
    names = table(spark, d, "taxonomy")
    one = lambda kind: joins.small(names.where(F.col("kind") == kind).select(F.col("code").alias(kind), F.col("name").alias(f"{kind}_name")))
    return master(spark, d).select(*KEY, "topic", "format").join(one("topic"), "topic", "left").join(one("format"), "format", "left").select(*KEY, "topic_name", "format_name")


_DIST = "{0} AS (SELECT {1} AS d, sum(token_count) / sum(sum(token_count)) OVER () AS w FROM m WHERE {1} IS NOT NULL AND token_count > 0 GROUP BY 1)"


def _dist(spark, d, c):
    by = master(spark, d).where(f"{c} IS NOT NULL AND token_count > 0").groupBy(c).agg(F.sum("token_count").alias("t"))
    return by.select(F.array(c).alias("domain"), (F.col("t") / F.expr("sum(t) OVER ()")).alias("weight"))


@query(M + ", " + _DIST.format("a", "topic") + ", " + _DIST.format("b", "format") + " SELECT a.d AS topic, b.d AS format, round(a.w * b.w, 9) AS weight FROM a, b")
def join_07_product_of_distributions(spark, d):
    p = joins.product(_dist(spark, d, "topic"), _dist(spark, d, "format"))
    return p.select(F.col("domain")[0].alias("topic"), F.col("domain")[1].alias("format"), F.round("weight", 9).alias("weight"))


@query(M + "SELECT topic, name, count(*) AS n FROM m JOIN taxonomy ON kind = 'topic' AND code = topic GROUP BY 1, 2")
def join_08_mandatory_lookup(spark, d):
    names = table(spark, d, "taxonomy").where("kind = 'topic'").select(F.col("code").alias("topic"), "name")
    return joins.mandatory(master(spark, d).where("topic IS NOT NULL").groupBy("topic").agg(F.count("*").alias("n")), joins.small(names), "topic", "name").select("topic", "name", "n")


@query("SELECT domain, round(avg(w), 9) AS weight, count(*) AS lists FROM (SELECT mix_id, domain, weight / sum(weight) OVER (PARTITION BY mix_id) AS w FROM mixtures) WHERE domain IN (SELECT domain FROM mixtures WHERE mix_id = 1) GROUP BY domain")
def join_09_align_and_average_distributions(spark, d):
    m = table(spark, d, "mixtures").withColumn("w", F.col("weight") / F.sum("weight").over(Window.partitionBy("mix_id")))
    first = m.where("mix_id = 1").select("domain")
    return m.join(joins.small(first), "domain", "left_semi").groupBy("domain").agg(F.round(F.avg("w"), 9).alias("weight"), F.count("*").alias("lists"))


@query("SELECT doc_id FROM documents SEMI JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality >= 4) USING (doc_id)")
def join_10_semi(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").where("quality >= 4"), "doc_id", "left_semi")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def join_11_anti(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_anti")


_CONFIGS = [(1, "dclm_score", 0.5), (2, "dclm_score", 0.8), (3, "qr_writing_style", 0.5), (4, "textbook_quality", 0.7)]
_CONFIG_SQL = "c AS (SELECT * FROM (VALUES (1, 'dclm_score', 0.5), (2, 'dclm_score', 0.8), (3, 'qr_writing_style', 0.5), (4, 'textbook_quality', 0.7)) v(run_id, feature, thr)), long AS (SELECT shard_idx, doc_idx, token_count, 'dclm_score' AS feature, dclm_score AS x FROM m UNION ALL SELECT shard_idx, doc_idx, token_count, 'qr_writing_style', qr_writing_style FROM m UNION ALL SELECT shard_idx, doc_idx, token_count, 'textbook_quality', textbook_quality FROM m)"


def _runs(spark, d):
    """(run_id, key, token_count) of the rows each configuration selects: the thresholds are a short list and broadcast."""
    c = spark.createDataFrame(_CONFIGS, "run_id int, feature string, thr double")
    long = master(spark, d).select(*KEY, "token_count", "dclm_score", "qr_writing_style", "textbook_quality").unpivot([*KEY, "token_count"], ["dclm_score", "qr_writing_style", "textbook_quality"], "feature", "x")
    return long.join(F.broadcast(c), "feature").where("x >= thr")


@query(M + ", " + _CONFIG_SQL + " SELECT run_id, count(*) AS n, CAST(coalesce(sum(token_count), 0) AS BIGINT) AS tokens FROM long JOIN c USING (feature) WHERE x >= thr GROUP BY run_id")
def join_13_configs_by_documents(spark, d):
    return _runs(spark, d).groupBy("run_id").agg(F.count("*").alias("n"), F.coalesce(F.sum("token_count"), F.lit(0)).cast("bigint").alias("tokens"))


@query("SELECT a.domain, a.weight AS weight_1, b.weight AS weight_2 FROM mixtures a JOIN mixtures b USING (domain) WHERE a.mix_id = 1 AND b.mix_id = 2")
def join_14_self_comparison(spark, d):
    m = table(spark, d, "mixtures").select("mix_id", "domain", "weight")
    one = lambda i: m.where(F.col("mix_id") == i).select("domain", F.col("weight").alias(f"weight_{i}"))
    return one(1).join(one(2), "domain")


_LOSSES = [(1, 4.24), (2, 4.31), (3, None), (4, 4.28)]
_LOSS_SQL = "l AS (SELECT * FROM (VALUES (1, 4.24), (2, 4.31), (3, NULL), (4, 4.28)) v(run_id, loss))"


@query(M + ", " + _CONFIG_SQL + ", " + _LOSS_SQL + " SELECT run_id, CAST(loss AS DOUBLE) AS loss, count(*) AS n FROM long JOIN c USING (feature) JOIN l USING (run_id) WHERE x >= thr AND loss IS NOT NULL GROUP BY 1, 2")
def join_15_results_with_masks(spark, d):
    losses = spark.createDataFrame(_LOSSES, "run_id int, loss double").where("loss IS NOT NULL")
    return _runs(spark, d).groupBy("run_id").agg(F.count("*").alias("n")).join(losses, "run_id").select("run_id", "loss", "n")


@query("WITH p AS (SELECT * FROM (VALUES (1, 'sc'), (2, 'art'), (3, 'f')) v(demo, prefix)) SELECT demo, min(code) AS code FROM p JOIN taxonomy ON kind = 'topic' AND starts_with(name, prefix) GROUP BY demo")
def join_16_prefix_lookup(spark, d):
    demos = spark.createDataFrame([(1, "sc"), (2, "art"), (3, "f")], "demo int, prefix string")
    names = table(spark, d, "taxonomy").where("kind = 'topic'")
    return names.join(F.broadcast(demos), F.expr("startswith(name, prefix)")).groupBy("demo").agg(F.min("code").alias("code"))


@query(M + ", q AS (SELECT unnest([0.1, 0.5, 0.9]) AS q, unnest(quantile_cont(dclm_score, [0.1, 0.5, 0.9])) AS value FROM m), n AS (SELECT q, shard_idx, doc_idx, row_number() OVER (PARTITION BY q ORDER BY abs(dclm_score - value), shard_idx, doc_idx) AS rn FROM m, q WHERE dclm_score IS NOT NULL), s AS (SELECT *, row_number() OVER (PARTITION BY q, shard_idx ORDER BY rn) AS k FROM n WHERE rn <= 30), t AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rn) AS pick FROM s WHERE k = 1) SELECT CAST(q AS DOUBLE) AS q, shard_idx, doc_idx FROM t WHERE pick <= 2")
def join_17_nearest_from_distinct_shards(spark, d):
    from ..operators.quantiles import quantiles

    m = master(spark, d).select(*KEY, "dclm_score")
    near = joins.nearest_values(m, "dclm_score", quantiles(m, "dclm_score", [0.1, 0.5, 0.9]).select(F.col("p").alias("q"), "value"), 30, K)
    first = near.withColumn("k", F.row_number().over(Window.partitionBy("q", "shard_idx").orderBy("rn"))).where("k = 1")
    return first.withColumn("pick", F.row_number().over(Window.partitionBy("q").orderBy("rn"))).where("pick <= 2").select("q", *KEY)


@query(M + "SELECT shard_idx, doc_idx, round(dclm_score - avg(dclm_score) OVER (PARTITION BY topic), 6) AS demeaned FROM m WHERE topic IS NOT NULL")
def join_18_group_mean_back(spark, d):
    m = master(spark, d).where("topic IS NOT NULL").select(*KEY, "topic", "dclm_score")
    means = m.groupBy("topic").agg(F.avg("dclm_score").alias("mean"))  # pre-aggregated, one row per topic
    return m.join(joins.small(means), "topic").select(*KEY, r6(F.col("dclm_score") - F.col("mean"), "demeaned"))


# windows --------------------------------------------------------------------


@query(M + "SELECT shard_idx, doc_idx, topic, CASE WHEN dclm_score IS NOT NULL THEN round((rank() OVER (PARTITION BY topic ORDER BY dclm_score NULLS LAST) + (count(*) OVER (PARTITION BY topic, dclm_score) - 1) / 2.0) / count(dclm_score) OVER (PARTITION BY topic), 6) END AS pct FROM m WHERE topic IS NOT NULL")
def win_01_percentile_rank(spark, d):
    m = master(spark, d).where("topic IS NOT NULL").select(*KEY, "topic", "dclm_score")
    return prefix.average_ranks(m, "dclm_score", ["topic"], "pct").select(*KEY, "topic", r6(F.col("pct"), "pct"))


@query(M + ", s AS (SELECT *, count(*) OVER (PARTITION BY topic) AS n, row_number() OVER (PARTITION BY topic ORDER BY dclm_score NULLS FIRST, shard_idx, doc_idx) - 1 AS pos FROM m WHERE topic IS NOT NULL) SELECT shard_idx, doc_idx, CASE WHEN n >= 50 THEN round(pos / greatest(n - 1, 1), 6) END AS share FROM s")
def win_02_order_share(spark, d):
    m = master(spark, d).where("topic IS NOT NULL").select(*KEY, "topic", "dclm_score")
    at = prefix.row_numbers(m, ["topic"], [F.col("dclm_score").asc_nulls_first(), *K], "at").join(joins.small(m.groupBy("topic").agg(F.count("*").alias("n"))), "topic")
    return at.select(*KEY, F.when(F.col("n") >= 50, F.round((F.col("at") - 1) / F.greatest(F.col("n") - 1, F.lit(1)), 6)).alias("share"))


@query(M + ", s AS (SELECT *, sum(token_count) OVER (ORDER BY dclm_score DESC NULLS LAST, shard_idx, doc_idx ROWS UNBOUNDED PRECEDING) AS cum FROM m WHERE token_count > 0) SELECT shard_idx, doc_idx FROM s WHERE cum - token_count < 100000")
def win_03_token_cutoff(spark, d):
    m = master(spark, d).where("token_count > 0").select(*KEY, "dclm_score", "token_count")
    return prefix.budget_prefix(m, "token_count", F.lit(100000), [], [F.col("dclm_score").desc_nulls_last(), *K]).select(*KEY)


_HASH = "((('0x' || substr(md5({0} || ':{1}'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"
_MKEY = "(shard_idx || '-' || doc_idx)"


@query(M + f", s AS (SELECT *, sum(token_count) OVER (ORDER BY {_HASH.format(_MKEY, 7)}, shard_idx, doc_idx ROWS UNBOUNDED PRECEDING) AS cum FROM m WHERE token_count > 0) SELECT shard_idx, doc_idx FROM s WHERE cum - token_count < 100000")
def win_04_random_token_cutoff(spark, d):
    m = master(spark, d).where("token_count > 0").select(*KEY, "token_count").withColumn("u", stats.hash_uniform(F.concat_ws("-", *KEY), 7))
    return prefix.budget_prefix(m, "token_count", F.lit(100000), [], [F.col("u").asc(), *K]).select(*KEY)


@query(M + ", s AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY dclm_score DESC NULLS LAST, shard_idx, doc_idx) AS rn, count(*) OVER (PARTITION BY topic) AS n FROM m WHERE topic IS NOT NULL) SELECT shard_idx, doc_idx, topic FROM s WHERE rn <= greatest(1, round_even(n * 0.2, 0))")
def win_05_top_fraction(spark, d):
    m = master(spark, d).where("topic IS NOT NULL").select(*KEY, "topic", "dclm_score")
    return selection.top_fraction(m, ["topic"], "dclm_score", 0.2, K).select(*KEY, "topic")


@query(M + ", c AS (SELECT domain, count(*) AS n FROM m WHERE domain IS NOT NULL GROUP BY 1) SELECT domain, n, row_number() OVER (ORDER BY n DESC, domain) AS rank FROM c")
def win_07_frequency_rank(spark, d):
    c = master(spark, d).where("domain IS NOT NULL").groupBy("domain").agg(F.count("*").alias("n"))
    return prefix.row_numbers(c, [], [F.col("n").desc(), F.col("domain").asc()], "rank").select("domain", "n", F.col("rank").cast("bigint").alias("rank"))


@query("SELECT shard_idx, doc_idx, doc_id, CAST(coalesce(sum(n_chars) OVER (ORDER BY shard_idx, doc_idx, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(coalesce(sum(n_chars) OVER (ORDER BY shard_idx, doc_idx, doc_id ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) AS stop FROM documents")
def win_08_running_offsets(spark, d):
    r = prefix.running_sum(table(spark, d, "documents").select(*KEY, "doc_id", "n_chars"), "n_chars", [], [*K, F.col("doc_id")], "stop")
    return r.select(*KEY, "doc_id", (F.col("stop") - F.coalesce("n_chars", F.lit(0))).cast("bigint").alias("start"), F.col("stop").cast("bigint").alias("stop"))


@query("WITH x AS (SELECT user_id, value, lag(value, 1) OVER w AS l1, lag(value, 2) OVER w AS l2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), c AS (SELECT user_id, avg(value) AS mu, var_pop(value) AS v FROM events GROUP BY 1) SELECT user_id, round(avg((value - mu) * (l1 - mu)) / nullif(any_value(v), 0), 6) AS lag1, round(avg((value - mu) * (l2 - mu)) / nullif(any_value(v), 0), 6) AS lag2 FROM x JOIN c USING (user_id) GROUP BY user_id")
def win_09_lag_autocorrelation(spark, d):
    e = table(spark, d, "events").select("user_id", "value", "ts", "event_id")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    c = e.groupBy("user_id").agg(F.avg("value").alias("mu"), F.var_pop("value").alias("v"))
    x = e.withColumns({"l1": F.lag("value", 1).over(w), "l2": F.lag("value", 2).over(w)}).join(c, "user_id")
    one = lambda k: F.round(F.avg((F.col("value") - F.col("mu")) * (F.col(f"l{k}") - F.col("mu"))) / F.nullif(F.first("v"), F.lit(0.0)), 6).alias(f"lag{k}")
    return x.groupBy("user_id").agg(one(1), one(2))


@query(M + "SELECT topic, format, round(sum(token_count) / sum(sum(token_count)) OVER (PARTITION BY topic), 6) AS share FROM m WHERE topic IS NOT NULL AND format IS NOT NULL AND token_count > 0 GROUP BY topic, format")
def win_12_ratio_to_total(spark, d):
    by = master(spark, d).where("topic IS NOT NULL AND format IS NOT NULL AND token_count > 0").groupBy("topic", "format").agg(F.sum("token_count").alias("t"))
    return by.select("topic", "format", r6(F.col("t") / F.sum("t").over(Window.partitionBy("topic")), "share"))


@query("WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT doc_id, CAST(least(7, (SELECT max(k) FROM range(8) t(k) WHERE round_even(n / 8.0 * k, 0) <= i)) AS INTEGER) AS worker FROM n")
def win_14_contiguous_parts(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    n = docs.count()
    starts = [round(n / 8 * k) for k in range(8)]
    numbered = prefix.row_numbers(docs, [], [F.col("doc_id").asc()], "i").withColumn("i", F.col("i") - 1)
    return numbered.select("doc_id", (sum(F.when(F.col("i") >= s, 1).otherwise(0) for s in starts) - 1).cast("int").alias("worker"))


# sorts and limits -----------------------------------------------------------


@query(M + "SELECT shard_idx, doc_idx, dclm_score FROM m ORDER BY dclm_score DESC NULLS LAST, shard_idx, doc_idx LIMIT 100")
def sort_01_top_k(spark, d):
    return selection.top_n(master(spark, d).select(*KEY, "dclm_score"), "dclm_score", 100, K)


@query(M + "(SELECT 'top' AS side, shard_idx, doc_idx FROM m WHERE dclm_score IS NOT NULL ORDER BY dclm_score DESC, shard_idx, doc_idx LIMIT 50) UNION ALL (SELECT 'bottom', shard_idx, doc_idx FROM m WHERE dclm_score IS NOT NULL ORDER BY dclm_score, shard_idx, doc_idx LIMIT 50)")
def sort_03_top_and_bottom(spark, d):
    m = master(spark, d).where("dclm_score IS NOT NULL").select(*KEY, "dclm_score")
    side = lambda name, order: m.orderBy(order, *K).limit(50).select(F.lit(name).alias("side"), *KEY)
    return side("top", F.desc("dclm_score")).unionByName(side("bottom", F.asc("dclm_score")))


@query(M + f"SELECT shard_idx, doc_idx FROM m ORDER BY fwedu_rounded DESC NULLS LAST, {_HASH.format(_MKEY, 3)}, shard_idx, doc_idx LIMIT 200")
def sort_04_random_ties(spark, d):
    m = master(spark, d).select(*KEY, "fwedu_rounded")
    return m.orderBy(F.col("fwedu_rounded").desc_nulls_last(), stats.hash_uniform(F.concat_ws("-", *KEY), 3), *K).limit(200).select(*KEY)


@query(M + "SELECT shard_idx, doc_idx FROM m WHERE dclm_score >= (SELECT quantile_cont(dclm_score, 0.85) FROM m)")
def sort_05_percentile_top(spark, d):
    m = master(spark, d).select(*KEY, "dclm_score")
    return m.where(F.col("dclm_score") >= F.lit(threshold(m, "dclm_score", 0.85))).select(*KEY)


@query("SELECT doc_id FROM documents WHERE shard_idx IN (SELECT DISTINCT shard_idx FROM documents ORDER BY 1 LIMIT 3)")
def sort_06_first_shards(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "shard_idx")
    return docs.join(F.broadcast(docs.select("shard_idx").distinct().orderBy("shard_idx").limit(3)), "shard_idx", "left_semi").select("doc_id")


# set operations -------------------------------------------------------------


@query("SELECT shard_idx, doc_idx, token_count, NULL::INTEGER AS topic FROM tokens UNION ALL SELECT shard_idx, doc_idx, NULL, topic FROM domains_topics")
def set_01_union_all(spark, d):
    return table(spark, d, "tokens").select(*KEY, "token_count").unionByName(table(spark, d, "domains_topics").select(*KEY, "topic"), allowMissingColumns=True)


@query(M + "SELECT shard_idx, doc_idx, CAST(row_number() OVER (ORDER BY CASE WHEN in_train_pool THEN 0 ELSE 1 END, shard_idx, doc_idx) AS BIGINT) AS position FROM m")
def set_02_ordered_union(spark, d):
    m = master(spark, d).select(*KEY, "in_train_pool")
    train, val = m.where("in_train_pool").withColumn("o", F.lit(0)), m.where("in_train_pool IS NULL OR NOT in_train_pool").withColumn("o", F.lit(1))
    return prefix.row_numbers(train.unionByName(val), [], [F.col("o"), *K], "position").select(*KEY, F.col("position").cast("bigint").alias("position"))


@query("SELECT shard_idx, doc_idx FROM documents EXCEPT SELECT shard_idx, doc_idx FROM tokens")
def set_03_difference(spark, d):
    return table(spark, d, "documents").select(*KEY).exceptAll(table(spark, d, "tokens").select(*KEY)).distinct().join(table(spark, d, "tokens").select(*KEY), KEY, "left_anti")


@query(M + "(SELECT shard_idx, doc_idx FROM m WHERE dclm_score >= 0.5) INTERSECT (SELECT shard_idx, doc_idx FROM m WHERE fwedu_rounded >= 3)")
def set_04_intersection(spark, d):
    m = master(spark, d)
    return m.where("dclm_score >= 0.5").select(*KEY).intersect(m.where("fwedu_rounded >= 3").select(*KEY))


@query(M + "(SELECT shard_idx, doc_idx FROM m WHERE dclm_score >= 0.8) UNION (SELECT shard_idx, doc_idx FROM m WHERE fwedu_rounded >= 4)")
def set_05_union_distinct(spark, d):
    m = master(spark, d)
    return m.where("dclm_score >= 0.8").select(*KEY).union(m.where("fwedu_rounded >= 4").select(*KEY)).distinct()


@query("SELECT DISTINCT lower(trim(source)) AS source FROM documents")
def set_06_distinct(spark, d):
    return table(spark, d, "documents").select(F.lower(F.trim("source")).alias("source")).distinct()


@query("SELECT mix_id, domain, CAST(copy AS INTEGER) AS copy FROM mixtures, LATERAL (SELECT unnest(range(1, max_repeats + 1)) AS copy) WHERE max_repeats > 0")
def set_07_repeat(spark, d):
    return selection.repeat_rows(table(spark, d, "mixtures").select("mix_id", "domain", "max_repeats"), "max_repeats").drop("max_repeats")
