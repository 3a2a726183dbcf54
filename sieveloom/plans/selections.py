"""Selection policies, sampling, mixtures over the master frame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import stats
from ..operators import evaluate, prefix, selection
from ..operators.quantiles import threshold
from ..schema import KEY
from .base import M, master, query, r6, table
from .relational import _HASH, _MKEY, K

S = "dclm_score"
_ORDER = "dclm_score DESC NULLS LAST, shard_idx, doc_idx"


def pool(spark, d):
    return master(spark, d).where("token_count > 0").select(*KEY, "topic", "format", S, "fwedu_rounded", "qr_educational_value", "textbook_quality", "token_count")


MP = M + ", p AS (SELECT * FROM m WHERE token_count > 0)"


def u():
    """The key as a string, what random numbers are made from."""
    return F.concat_ws("-", *KEY)


@query(MP + f", s AS (SELECT *, sum(token_count) OVER (ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING) AS cum FROM p) SELECT shard_idx, doc_idx, token_count FROM s WHERE cum - token_count < 200000")
def sel_01_token_budget(spark, d):
    return selection.by_tokens(pool(spark, d), S, "token_count", 200_000, K).select(*KEY, "token_count")


@query(MP + ", s AS (SELECT *, sum(token_count) OVER (ORDER BY -dclm_score DESC NULLS LAST, shard_idx, doc_idx ROWS UNBOUNDED PRECEDING) AS cum FROM p) SELECT shard_idx, doc_idx FROM s WHERE cum - token_count < 50000")
def sel_02_inverted(spark, d):
    x = pool(spark, d).withColumn("s", selection.score_expression(F.col(S), invert=True))
    return selection.by_tokens(x, "s", "token_count", 50_000, K).select(*KEY)


@query(MP + ", q AS (SELECT quantile_cont(dclm_score, 0.7) AS q FROM p), s AS (SELECT p.*, CASE WHEN dclm_score >= q THEN 0.0 END AS s FROM p, q), c AS (SELECT *, sum(token_count) OVER (ORDER BY shard_idx, doc_idx ROWS UNBOUNDED PRECEDING) AS cum FROM s WHERE s IS NOT NULL) SELECT shard_idx, doc_idx FROM c WHERE cum - token_count < 50000")
def sel_03_quantile_threshold(spark, d):
    x = pool(spark, d)
    x = x.withColumn("s", selection.score_expression(F.col(S), at_least=threshold(x, S, 0.7))).where("s IS NOT NULL")
    return selection.by_tokens(x, "s", "token_count", 50_000, K).select(*KEY)


@query(MP + ", s AS (SELECT *, round(abs(dclm_score - (SELECT median(dclm_score) FROM p)), 9) AS s FROM p), c AS (SELECT *, sum(token_count) OVER (ORDER BY s DESC NULLS LAST, shard_idx, doc_idx ROWS UNBOUNDED PRECEDING) AS cum FROM s) SELECT shard_idx, doc_idx FROM c WHERE cum - token_count < 50000")
def sel_04_from_median(spark, d):
    x = pool(spark, d)
    x = x.withColumn("s", F.round(selection.score_expression(F.col(S), median=threshold(x, S, 0.5)), 9))
    return selection.by_tokens(x, "s", "token_count", 50_000, K).select(*KEY)


@query(MP + f", s AS (SELECT *, round(dclm_score / 0.5 - ln(-ln({_HASH.format(_MKEY, 305)})), 9) AS s FROM p), c AS (SELECT *, sum(token_count) OVER (ORDER BY s DESC NULLS LAST, shard_idx, doc_idx ROWS UNBOUNDED PRECEDING) AS cum FROM s) SELECT shard_idx, doc_idx FROM c WHERE cum - token_count < 100000")
def sel_05_gumbel_top_k(spark, d):
    x = pool(spark, d).withColumn("s", F.round(selection.sampled_score(F.col(S), u(), 305, 0.5), 9))
    return selection.by_tokens(x, "s", "token_count", 100_000, K).select(*KEY)


@query(MP + f", t AS (SELECT sum(token_count) AS t FROM p), c AS (SELECT p.*, t, sum(token_count) OVER (ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING) AS cum FROM p, t) SELECT shard_idx, doc_idx, CAST((20000000 // t) + CASE WHEN cum - token_count < 20000000 % t THEN 1 ELSE 0 END AS INTEGER) AS n_repeats FROM c WHERE (20000000 // t) + CASE WHEN cum - token_count < 20000000 % t THEN 1 ELSE 0 END > 0")
def sel_06_multi_epoch(spark, d):
    return selection.multi_epoch(pool(spark, d), S, "token_count", 20_000_000, K).select(*KEY, "n_repeats")


@query(MP + f", t AS (SELECT domain AS topic, weight / sum(weight) OVER () AS w FROM mixtures WHERE mix_id = 1), c AS (SELECT p.*, round_even(300000 * w, 0) AS quota, sum(token_count) OVER (PARTITION BY topic ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING) AS cum FROM p JOIN t USING (topic)) SELECT shard_idx, doc_idx, topic FROM c WHERE cum - token_count < quota")
def sel_07_domain_quota(spark, d):
    t = table(spark, d, "mixtures").where("mix_id = 1").select(F.col("domain").alias("topic"), (F.col("weight") / F.expr("sum(weight) OVER ()")).alias("weight"))
    return selection.by_quota(pool(spark, d), t, "topic", S, "token_count", 300_000, K).select(*KEY, "topic")


@query(MP + f", c AS (SELECT *, sum(token_count) OVER (ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING) AS cum FROM p) SELECT shard_idx, doc_idx FROM c WHERE cum - token_count < 30000")
def sel_08_no_reference_is_one_domain(spark, d):
    one = pool(spark, d).withColumn("domain", F.lit(0))
    target = spark.createDataFrame([(0, 1.0)], "domain int, weight double")
    return selection.by_quota(one, target, "domain", S, "token_count", 30_000, K).select(*KEY)


@query()
def sel_09_retry_until_met(spark, d):
    """Shares of the topics that add up to less than 1: the budget is raised until the selection holds what was asked for."""
    x = pool(spark, d)
    t = spark.createDataFrame([(i, 0.8 / 24) for i in range(24)], "topic int, weight double")
    return selection.retry_until(lambda b: selection.by_quota(x, t, "topic", S, "token_count", b, K), 20_000, "token_count", 5).select(*KEY, "topic")


@query("SELECT doc_id FROM documents WHERE shard_idx NOT IN (SELECT DISTINCT shard_idx FROM documents ORDER BY 1 DESC LIMIT 2)")
def sel_10_held_out_tail(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "shard_idx")
    tail = docs.select("shard_idx").distinct().orderBy(F.desc("shard_idx")).limit(2)
    return docs.join(F.broadcast(tail), "shard_idx", "left_anti").select("doc_id")


def _strategy(name, order):
    return f"(SELECT '{name}' AS strategy, shard_idx, doc_idx FROM (SELECT *, sum(token_count) OVER (ORDER BY {order}, shard_idx, doc_idx ROWS UNBOUNDED PRECEDING) AS cum FROM p) WHERE cum - token_count < 60000)"


@query(MP + " " + " UNION ALL ".join([_strategy("random", _HASH.format(_MKEY, 11)), _strategy("dclm", f"dclm_score DESC NULLS LAST, {_HASH.format(_MKEY, 11)}"), _strategy("fwedu", f"fwedu_rounded DESC NULLS LAST, {_HASH.format(_MKEY, 11)}")]))
def sel_11_equal_token_strategies(spark, d):
    x = pool(spark, d).withColumn("u", stats.hash_uniform(u(), 11))
    orders = {"random": [F.col("u").asc()], "dclm": [F.col(S).desc_nulls_last(), F.col("u").asc()], "fwedu": [F.col("fwedu_rounded").desc_nulls_last(), F.col("u").asc()]}
    return reduce(lambda a, b: a.unionByName(b), [prefix.budget_prefix(x, "token_count", F.lit(60_000), [], [*o, *K]).select(F.lit(n).alias("strategy"), *KEY) for n, o in orders.items()])


@query(MP + f" SELECT 'random' AS policy, shard_idx, doc_idx FROM p WHERE {_HASH.format(_MKEY, 5)} < 0.15 UNION ALL SELECT 'p85', shard_idx, doc_idx FROM p WHERE dclm_score >= (SELECT quantile_cont(dclm_score, 0.85) FROM p) UNION ALL SELECT 'fwedu3', shard_idx, doc_idx FROM p WHERE fwedu_rounded >= 3 UNION ALL SELECT 'within', shard_idx, doc_idx FROM p JOIN (SELECT topic, quantile_cont(dclm_score, 0.85) AS q FROM p WHERE dclm_score IS NOT NULL AND topic IS NOT NULL GROUP BY topic) USING (topic) WHERE dclm_score >= q AND topic IN (SELECT topic FROM p GROUP BY topic HAVING count(*) >= 50)")
def sel_12_top_percent_policies(spark, d):
    x = pool(spark, d)
    parts = {"random": selection.bernoulli(x, u(), 0.15, 5), "p85": selection.above(x, S, 85), "fwedu3": x.where("fwedu_rounded >= 3"), "within": selection.within_group_top(x.where("topic IS NOT NULL"), "topic", S, 15, 50)}
    return reduce(lambda a, b: a.unionByName(b), [v.select(F.lit(n).alias("policy"), *KEY) for n, v in parts.items()])


def _config(spark, d, **config):
    return selection.apply_config(master(spark, d), config).select(*KEY)


@query(M + "SELECT shard_idx, doc_idx FROM m WHERE qr_educational_value <= (SELECT quantile_cont(qr_educational_value, 0.3) FROM m)")
def sel_13_single_threshold(spark, d):
    return _config(spark, d, type="single_threshold", feature="qr_educational_value", percentile=30, direction="below")


@query(M + "SELECT shard_idx, doc_idx FROM m WHERE dclm_score >= (SELECT quantile_cont(dclm_score, 0.4) FROM m) AND frac_alpha >= (SELECT quantile_cont(frac_alpha, 0.3) FROM m) AND ngram_rep_2 <= (SELECT quantile_cont(ngram_rep_2, 0.8) FROM m)")
def sel_14_multi_intersection(spark, d):
    return _config(spark, d, type="multi_intersection", selectors=[{"feature": S, "percentile": 40}, {"feature": "frac_alpha", "percentile": 30}, {"feature": "ngram_rep_2", "percentile": 80, "direction": "below"}])


def _linear(avg, std, fill):
    z = lambda c, w: f"{'coalesce(' if fill else '('}({c} - (SELECT {avg}({c}) FROM m)) / (SELECT {std}({c}) FROM m) * {w}{', 0)' if fill else ')'}"
    return f"{z('frac_alpha', '1.0')} + {z('mean_word_length', '-0.5')}"


@query(M + f", s AS (SELECT *, {_linear('avg', 'stddev_samp', False)} AS s FROM m) SELECT shard_idx, doc_idx FROM s WHERE round(s, 9) >= (SELECT quantile_cont(round(s, 9), 0.8) FROM s)")
def sel_15_linear_top(spark, d):
    return _config(spark, d, type="linear_top", features=["frac_alpha", "mean_word_length"], weights=[1.0, -0.5], top_pct=20)


@query(M + f", s AS (SELECT *, {_linear('avg', 'stddev_pop', True)} AS s FROM m) SELECT shard_idx, doc_idx FROM s WHERE round(s, 9) >= (SELECT quantile_cont(round(s, 9), 0.8) FROM s)")
def sel_16_linear_top_simple(spark, d):
    return _config(spark, d, type="linear_top_simple", features=["frac_alpha", "mean_word_length"], weights=[1.0, -0.5], top_pct=20)


@query(M + "SELECT shard_idx, doc_idx FROM m WHERE textbook_quality >= (SELECT quantile_cont(textbook_quality, 0.9) FROM m)")
def sel_17_targeted_top(spark, d):
    return _config(spark, d, type="targeted_top", feature="textbook_quality", top_pct=10)


@query(M + "SELECT shard_idx, doc_idx FROM m WHERE topic = 1 AND dclm_score >= (SELECT quantile_cont(dclm_score, 0.6) FROM m WHERE topic = 1)")
def sel_18_topic_conditional(spark, d):
    return _config(spark, d, type="topic_conditional", topic=1, feature=S, percentile=60)


@query(M + "SELECT shard_idx, doc_idx FROM m JOIN (SELECT topic, quantile_cont(dclm_score, 0.75) AS q FROM m WHERE topic IS NOT NULL AND dclm_score IS NOT NULL GROUP BY 1) USING (topic) WHERE dclm_score >= q")
def sel_19_within_topic_top(spark, d):
    return _config(spark, d, type="within_topic_top", feature=S, top_pct=25)


@query(M + "SELECT shard_idx, doc_idx FROM m WHERE fwedu_rounded >= 3")
def sel_20_fwedu_at_least(spark, d):
    return _config(spark, d, type="fwedu_geq", threshold=3)


@query(M + f"SELECT shard_idx, doc_idx FROM m WHERE {_HASH.format(_MKEY, 42)} < 0.3")
def sel_21_random(spark, d):
    return _config(spark, d, type="random", frac=0.3, seed=42)


@query(M + ", a AS (SELECT * FROM m WHERE dclm_score >= (SELECT quantile_cont(dclm_score, 0.6) FROM m)) SELECT shard_idx, doc_idx FROM a WHERE frac_alpha >= (SELECT quantile_cont(frac_alpha, 0.5) FROM a)")
def sel_22_top_then_restrict(spark, d):
    return _config(spark, d, type="dclm_top_then_restrict", dclm_top_pct=40, restrict_feature="frac_alpha", restrict_top_pct=50)


@query(M + ", r AS (SELECT * FROM (VALUES (0, 3), (1, 6)) v(run_id, threshold)), s AS (SELECT run_id, count(shard_idx) AS n, coalesce(sum(token_count), 0) AS t FROM r LEFT JOIN m ON fwedu_rounded >= threshold GROUP BY run_id) SELECT run_id, CASE WHEN n < 200 THEN 'aborted' WHEN t < 10000 THEN 'dropped' ELSE 'ok' END AS status, n AS rows, CAST(t AS BIGINT) AS tokens FROM s")
def sel_23_guard_rails(spark, d):
    rows = []
    for i, c in enumerate([{"type": "fwedu_geq", "threshold": 3}, {"type": "fwedu_geq", "threshold": 6}]):
        rows.append((i, *selection.guarded(selection.apply_config(master(spark, d), c), "token_count", 200, 10_000)))
    return spark.createDataFrame(rows, "run_id int, status string, rows bigint, tokens bigint")


@query()
def sel_24_generated_configs(spark, d):
    """Seeded random configurations that leave enough rows; the percentile grid is computed once."""
    import json

    from ..operators.mixes import generate_configs

    m = master(spark, d)
    return spark.createDataFrame([(c["run_id"], c["type"], json.dumps(c, sort_keys=True)) for c in generate_configs(m, ["dclm_score", "frac_alpha", "textbook_quality"], 12, 0.02)], "run_id int, type string, config string")


@query(M + f", r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY {_ORDER}) AS rn, count(*) OVER (PARTITION BY topic) AS n FROM m WHERE topic IS NOT NULL), g AS (SELECT *, rn <= greatest(1, round_even(n * 0.05, 0)) AS is_floor FROM r), o AS (SELECT *, row_number() OVER (ORDER BY is_floor DESC, {_ORDER}) AS at_ FROM g) SELECT shard_idx, doc_idx, is_floor FROM o WHERE at_ <= 300")
def sel_26_floor_then_fill(spark, d):
    m = master(spark, d).where("topic IS NOT NULL").select(*KEY, "topic", S)
    return selection.floor_then_fill(m, ["topic"], S, 300, 0.05, K).select(*KEY, "is_floor")


def _policies(spark, d):
    m = master(spark, d).where("topic IS NOT NULL").select(*KEY, "topic", S, "textbook_quality", "token_count")
    parts = {"global_dclm": selection.top_n(m, S, 300, K), "random": selection.random_rows(m, u(), 300, 9), "within_topic": selection.top_fraction(m, ["topic"], S, 0.1, K), "floor": selection.floor_then_fill(m, ["topic"], S, 300, 0.05, K).drop("is_floor")}
    return reduce(lambda a, b: a.unionByName(b), [v.withColumn("policy", F.lit(n)) for n, v in parts.items()])


_POLICY_SQL = (
    M + f", b AS (SELECT shard_idx, doc_idx, topic, dclm_score, textbook_quality, token_count FROM m WHERE topic IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY {_ORDER}) AS rn, count(*) OVER (PARTITION BY topic) AS n FROM b),"
    f" g AS (SELECT *, rn <= greatest(1, round_even(n * 0.05, 0)) AS is_floor FROM r), o AS (SELECT *, row_number() OVER (ORDER BY is_floor DESC, {_ORDER}) AS at_ FROM g),"
    f" s AS ((SELECT 'global_dclm' AS policy, b.* FROM b ORDER BY {_ORDER} LIMIT 300) UNION ALL (SELECT 'random', b.* FROM b ORDER BY {_HASH.format(_MKEY, 9)} LIMIT 300) UNION ALL"
    " (SELECT 'within_topic', shard_idx, doc_idx, topic, dclm_score, textbook_quality, token_count FROM r WHERE rn <= greatest(1, round_even(n * 0.1, 0))) UNION ALL (SELECT 'floor', shard_idx, doc_idx, topic, dclm_score, textbook_quality, token_count FROM o WHERE at_ <= 300)),"
    " e AS (SELECT policy, -sum(p * ln(p)) AS entropy, count(*) AS coverage FROM (SELECT policy, topic, count(*) / sum(count(*)) OVER (PARTITION BY policy) AS p FROM s GROUP BY 1, 2) GROUP BY 1),"
    " a AS (SELECT policy, count(*) AS n, avg(dclm_score) AS m, stddev_samp(dclm_score) / sqrt(count(dclm_score)) AS se, avg(textbook_quality) AS tq, CAST(coalesce(sum(token_count), 0) AS BIGINT) AS tokens FROM s GROUP BY 1)"
)


@query(_POLICY_SQL + " SELECT a.policy, n, round(m, 6) AS mean_dclm, round(se, 6) AS se_dclm, tokens, round(entropy, 6) AS entropy, coverage FROM a JOIN e USING (policy)")
def sel_28_policy_metrics(spark, d):
    x = evaluate.policy_metrics(_policies(spark, d), "policy", [S], "topic", "token_count")
    return x.select("policy", "n", F.col(f"mean_{S}").alias("mean_dclm"), F.col(f"se_{S}").alias("se_dclm"), "tokens", "entropy", "coverage")


@query(_POLICY_SQL + ", z AS (SELECT policy, round(m, 6) AS m, round(entropy, 6) AS h FROM a JOIN e USING (policy)) SELECT policy, round(m - (SELECT m FROM z WHERE policy = 'global_dclm'), 6) AS delta_mean, round(h - (SELECT h FROM z WHERE policy = 'global_dclm'), 6) AS delta_entropy FROM z")
def sel_29_policy_deltas(spark, d):
    x = evaluate.policy_metrics(_policies(spark, d), "policy", [S], "topic", "token_count").select("policy", F.col(f"mean_{S}").alias("mean"), "entropy")
    return evaluate.deltas(x, "policy", "global_dclm", ["mean", "entropy"])


_FLOORS = (0.0, 0.025, 0.05, 0.1)
_FRONTIER = (
    M + f", r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY {_ORDER}) AS rn, count(*) OVER (PARTITION BY topic) AS n FROM m WHERE topic IS NOT NULL), s AS ("
    + " UNION ALL ".join(f"(SELECT 'floor_{f:.3f}' AS policy, topic, dclm_score, token_count FROM r ORDER BY {f > 0} AND rn <= greatest(1, round_even(n * {f}, 0)) DESC, {_ORDER} LIMIT 300)" for f in _FLOORS)
    + "), e AS (SELECT policy, -sum(p * ln(p)) AS entropy, count(*) AS coverage FROM (SELECT policy, topic, count(*) / sum(count(*)) OVER (PARTITION BY policy) AS p FROM s GROUP BY 1, 2) GROUP BY 1)"
    " SELECT policy, count(*) AS n, round(avg(dclm_score), 6) AS mean_dclm_score, round(stddev_samp(dclm_score) / sqrt(count(dclm_score)), 6) AS se_dclm_score, CAST(coalesce(sum(token_count), 0) AS BIGINT) AS tokens, round(any_value(entropy), 6) AS entropy, any_value(coverage) AS coverage FROM s JOIN e USING (policy) GROUP BY policy"
)


@query(_FRONTIER)
def sel_27_quality_diversity_frontier(spark, d):
    m = master(spark, d).where("topic IS NOT NULL").select(*KEY, "topic", S, "token_count")
    parts = [selection.floor_then_fill(m, ["topic"], S, 300, f, K).drop("is_floor").withColumn("policy", F.lit(f"floor_{f:.3f}")) for f in _FLOORS]
    return evaluate.policy_metrics(reduce(lambda a, b: a.unionByName(b), parts), "policy", [S], "topic", "token_count")


@query(f"SELECT shard_idx FROM (SELECT DISTINCT shard_idx FROM documents) ORDER BY {_HASH.format('shard_idx', 305)}, shard_idx LIMIT 4")
def sel_31_shard_sample(spark, d):
    s = table(spark, d, "documents").select("shard_idx").distinct()
    return selection.random_rows(s, F.col("shard_idx"), 4, 305)


@query(f"SELECT doc_id FROM documents ORDER BY {_HASH.format('doc_id', 1)}, doc_id LIMIT 150")
def sel_32_row_sample(spark, d):
    return selection.random_rows(table(spark, d, "documents").select("doc_id"), F.col("doc_id"), 150, 1)


@query(M + f", r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY {_HASH.format(_MKEY, 8)}, {_MKEY}) AS rn, count(*) OVER (PARTITION BY topic) AS n FROM m WHERE topic IS NOT NULL) SELECT shard_idx, doc_idx, rn <= round_even(n * 0.2, 0) AS is_test FROM r")
def sel_33_stratified_split(spark, d):
    m = master(spark, d).where("topic IS NOT NULL").select(*KEY, "topic")
    return selection.stratified_split(m, "topic", u(), 0.2, 8).select(*KEY, "is_test")


@query()
def sel_34_bootstrap(spark, d):
    b = evaluate.bootstrap(_policies(spark, d), S, "policy", u(), 200)
    return b.select("policy", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "q025", "q50", "q975")])


@query("WITH e AS (SELECT vec_id, label, sqrt(list_sum([CAST(x AS DOUBLE) * x for x in embedding])) AS dist FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(dist, 9), vec_id) AS rn FROM e) SELECT vec_id, label, CAST(rn AS INTEGER) AS rn FROM r WHERE rn <= 5")
def sel_35_closest_per_cluster(spark, d):
    from ..functions.vector import dot

    e = table(spark, d, "embeddings").select("vec_id", "label", F.round(F.sqrt(dot(F.col("embedding"), F.col("embedding"))), 9).alias("dist"))
    return selection.closest_per_cluster(e, "label", "dist", 5, [F.col("vec_id")]).select("vec_id", "label", "rn")


@query(M + ", c AS (SELECT topic, count(*) AS size FROM m WHERE topic IS NOT NULL GROUP BY 1), x AS (SELECT max(v) AS v FROM (SELECT unnest(range(0, 5001)) AS v) t WHERE (SELECT sum(least(size, t.v)) FROM c) <= 1000), q AS (SELECT topic, size, least(size, v) AS base, size > v AS more, row_number() OVER (PARTITION BY size > v ORDER BY topic) AS at_ FROM c, x) SELECT topic, size, base + CASE WHEN more AND at_ <= 1000 - (SELECT sum(base) FROM q) THEN 1 ELSE 0 END AS quota FROM q")
def sel_36_water_fill(spark, d):
    sizes = master(spark, d).where("topic IS NOT NULL").groupBy("topic").agg(F.count("*").alias("size"))
    return selection.water_fill(sizes, "topic", "size", 1000)


@query()
def sel_37_hierarchical_sample(spark, d):
    from ..operators.clustering import hierarchical_sample

    m = master(spark, d).where("topic IS NOT NULL AND format IS NOT NULL").select(*KEY, "topic", "format", F.abs(F.col(S) - 0.5).alias("dist"))
    return hierarchical_sample(m, ["topic", "format"], "dist", 500, K).select(*KEY, "topic", "format", "n_copies")


@query("WITH t AS (SELECT vec_id, unnest(range(0, 64)) AS pos FROM embeddings), g AS (SELECT vec_id, pos, row_number() OVER (ORDER BY vec_id, pos) - 1 AS at_ FROM t) SELECT CAST(at_ // 129 AS BIGINT) AS sequence, count(*) AS n, min(vec_id) AS first_doc FROM g GROUP BY 1 HAVING count(*) = 129")
def sel_38_sequence_packing(spark, d):
    from ..operators.mixes import packed

    docs = table(spark, d, "embeddings").select("vec_id", F.sequence(F.lit(0), F.lit(63)).alias("ids"))
    return packed(docs, ["vec_id"], "ids", 128).select("sequence", F.size("ids").cast("bigint").alias("n"), "first_doc")


@query("WITH t AS (SELECT vec_id, label, unnest(range(1, 4)) AS i, unnest([round(CAST(x AS DOUBLE), 5) for x in embedding[1:3]]) AS x FROM embeddings) SELECT label, list(x ORDER BY vec_id, i) AS gathered FROM t GROUP BY label")
def sel_39_token_gather(spark, d):
    rows = table(spark, d, "embeddings").select("label", "vec_id", F.transform(F.slice("embedding", 1, 3), lambda x: F.round(x.cast("double"), 5)).alias("v"))
    g = rows.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("vec_id", "v"))).alias("s"))
    return g.select("label", F.flatten(F.transform("s", lambda x: x["v"])).alias("gathered"))


@query()
def mix_28_dirichlet_proposals(spark, d):
    """Accepted mixture proposals in the long form of a mix output: mix, domain, weight."""
    from ..operators.mixes import proposals

    prior = {r["topic"]: r["w"] for r in master(spark, d).where("topic IS NOT NULL AND token_count > 0").groupBy("topic").agg(F.sum("token_count").cast("double").alias("w")).collect()}
    return spark.createDataFrame(proposals(prior, 16), "mix int, domain int, weight double").select("mix", "domain", r6(F.col("weight"), "weight"))
