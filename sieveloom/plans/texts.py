"""Text features, urls and scalar functions over documents, eval items and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats, text, url, vector
from .base import query, r6, table

_WS = text.WS
_WORDS = f"list_filter(string_split_regex(coalesce(text, ''), '[{_WS}]+'), lambda w: w <> '')"
_LINES = "CASE WHEN coalesce(text, '') = '' THEN [''] ELSE string_split(text, chr(10)) END"
_BLANK = f"regexp_full_match(x, '[{_WS}]*')"
_D = (
    f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w, {_LINES} AS l FROM documents),"
    f" e AS (SELECT doc_id, t, w, len(w) AS n, length(t) AS c, [lower(x) for x in w] AS lw, l, list_filter(l, lambda x: NOT {_BLANK}) AS f FROM d)"
)


def _count(cls: str) -> str:
    return f"(length(t) - length(regexp_replace(t, '{cls}', '', 'g')))"


_BASIC = ["char_count", "word_count", "num_lines", "mean_word_length", "mean_line_length", "frac_alpha", "frac_digit", "frac_punctuation", "frac_uppercase"]


def _features(spark, d, names: list[str], make=text.heuristics):
    whole = {"char_count", "word_count", "num_lines"}
    staged, cols = text.with_features(table(spark, d, "documents").select("doc_id", "text"), "text", make)
    return staged.select("doc_id", *[cols[n].alias(n) if n in whole else r6(cols[n], n) for n in names])


@query(
    _D + " SELECT doc_id, CAST(c AS INTEGER) AS char_count, CAST(n AS INTEGER) AS word_count, CAST(CASE WHEN c = 0 THEN 0 ELSE len(l) END AS INTEGER) AS num_lines,"
    f" CASE WHEN n > 0 THEN round(length(regexp_replace(t, '[{_WS}]+', '', 'g')) / n, 6) END AS mean_word_length, CASE WHEN n > 0 THEN round((c - (len(l) - 1)) / len(l), 6) END AS mean_line_length,"
    f" CASE WHEN n > 0 THEN round({_count(chr(92) + 'p{L}')} / c, 6) END AS frac_alpha, CASE WHEN n > 0 THEN round({_count('[' + chr(92) + 'p{Nd}²³¹]')} / c, 6) END AS frac_digit,"
    f" CASE WHEN n > 0 THEN round({_count('[!-/:-@' + chr(92) + '[-`{-~]')} / c, 6) END AS frac_punctuation, CASE WHEN n > 0 THEN round({_count(chr(92) + 'p{Lu}')} / nullif({_count(chr(92) + 'p{L}')}, 0), 6) END AS frac_uppercase FROM e"
)
def text_01_character_features(spark, d):
    return _features(spark, d, _BASIC)


@query(
    _D + " SELECT doc_id, CASE WHEN n > 0 THEN round(len(list_filter(f, lambda x: regexp_matches(x, '[.?!\"]\\s*$'))) / nullif(len(f), 0), 6) END AS frac_lines_terminal_punct,"
    " CASE WHEN n > 0 THEN round(len(list_filter(f, lambda x: regexp_matches(x, '^\\s*(?:[-*•]|\\d+\\.)\\s'))) / nullif(len(f), 0), 6) END AS frac_lines_bullet FROM e"
)
def text_08_line_features(spark, d):
    return _features(spark, d, ["frac_lines_terminal_punct", "frac_lines_bullet"])


@query(
    _D + " SELECT doc_id, CASE WHEN n > 0 THEN round(len(list_distinct(lw)) / n, 6) END AS type_token_ratio, CASE WHEN n > 0 THEN round(len(list_filter(lw, lambda x: list_contains(["
    + ", ".join("'" + s.replace("'", "''") + "'" for s in text.STOP_WORDS)
    + "], x))) / n, 6) END AS stopword_fraction FROM e"
)
def text_10_vocabulary_features(spark, d):
    return _features(spark, d, ["type_token_ratio", "stopword_fraction"])


@query(
    _D + ", g AS (SELECT doc_id, k, unnest(CASE WHEN n >= k THEN [array_to_string(lw[i:i + k - 1], ' ') for i in range(1, n - k + 2)] ELSE [] END) AS g FROM e, (VALUES (2), (3), (4)) v(k)),"
    " c AS (SELECT doc_id, k, count(*) AS c FROM g GROUP BY doc_id, k, g), s AS (SELECT doc_id, k, sum(CASE WHEN c >= 2 THEN c ELSE 0 END) AS r FROM c GROUP BY 1, 2)"
    " SELECT e.doc_id, round(a.r * 2 / n, 6) AS ngram_rep_2, round(b.r * 3 / n, 6) AS ngram_rep_3, round(x.r * 4 / n, 6) AS ngram_rep_4 FROM e LEFT JOIN s a ON a.doc_id = e.doc_id AND a.k = 2 LEFT JOIN s b ON b.doc_id = e.doc_id AND b.k = 3 LEFT JOIN s x ON x.doc_id = e.doc_id AND x.k = 4"
)
def text_12_ngram_repetition(spark, d):
    return _features(spark, d, ["ngram_rep_2", "ngram_rep_3", "ngram_rep_4"])


@query("SELECT doc_id, regexp_replace(lower(regexp_extract(coalesce(url, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)), '^www\\.', '') AS netloc FROM documents")
def text_18_url_netloc(spark, d):
    return table(spark, d, "documents").select("doc_id", url.netloc(F.col("url")).alias("netloc"))


@query(
    "WITH n AS (SELECT doc_id, regexp_replace(lower(regexp_extract(coalesce(url, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)), '^www\\.', '') AS netloc FROM documents),"
    " h AS (SELECT *, regexp_replace(regexp_replace(netloc, '^.*@', ''), ':\\d*$', '') AS host FROM n), l AS (SELECT *, string_split(regexp_replace(host, '\\.$', ''), '.') AS l FROM h),"
    " s AS (SELECT *, CASE WHEN len(l) >= 2 AND regexp_matches(l[-1], '^[a-z]{2}$') AND list_contains([" + ", ".join(f"'{x}'" for x in url.SECOND_LABELS) + "], l[-2]) THEN 2 ELSE 1 END AS k FROM l)"
    " SELECT doc_id, CASE WHEN len(l) > k AND NOT regexp_full_match(host, '\\d+(\\.\\d+){3}') AND host[1:1] <> '[' THEN array_to_string(l[len(l) - k:len(l)], '.') ELSE netloc END AS domain FROM s"
)
def text_19_registered_domain(spark, d):
    return table(spark, d, "documents").select("doc_id", url.registered_domain(F.col("url")).alias("domain"))


_DISCOURSE = ["discourse_causal", "discourse_elaborative", "discourse_temporal", "explanation_density", "pronoun_density", "hedge_density", "question_density"]
#: Sentences in SQL: RE2 has no look-behind, so a mark is put behind sentence ends first.
_S = (
    f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), e AS (SELECT doc_id, t, list_filter([regexp_replace(regexp_replace(x, '^[{_WS}]+', ''), '[{_WS}]+$', '') for x in"
    " string_split_regex(regexp_replace(regexp_replace(t, '([.!?])[\"'')\\]]?\\s+([A-Z\"''(\\[])', '\\1\x01\\2', 'g'), '([.!?])[\"'')\\]]?\\s+([A-Z\"''(\\[])', '\\1\x01\\2', 'g'), '\x01|\\n+')], lambda x: x <> '') AS s FROM d),"
    " f AS (SELECT *, greatest(len(s), 1) AS n FROM e)"
)


@query()
def text_21_discourse_features(spark, d):
    return _features(spark, d, ["discourse_contrastive", *_DISCOURSE], text.synthetic)


@query(_S + " SELECT doc_id, CAST(CASE WHEN t = '' THEN 0 ELSE len(s) END AS INTEGER) AS sentences, CASE WHEN len(s) > 0 THEN round(len(list_filter(s, lambda x: ends_with(x, '?'))) / n, 6) END AS question_density FROM f")
def text_20_sentences(spark, d):
    s = text.sentences(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(s).alias("sentences"), F.when(F.size(s) > 0, F.round(text.count_where(s, lambda x: x.endswith("?")) / F.size(s), 6)).alias("question_density"))


@query(
    _D + " SELECT doc_id, CASE WHEN c > 0 THEN round(len(list_filter(l, lambda x: regexp_matches(x, '^\\s*(?:[-*•]|\\d+[.)])\\s'))) / len(l), 6) END AS list_density,"
    f" CASE WHEN c > 0 THEN round((SELECT sum(len(list_filter(string_split_regex(p, '[{_WS}]+'), lambda w: w <> ''))) / count(*) FROM (SELECT unnest(string_split_regex(t, '\\n\\s*\\n')) AS p) WHERE NOT regexp_full_match(p, '[{_WS}]*')), 6) END AS avg_paragraph_length FROM e"
)
def text_33_structure_features(spark, d):
    return _features(spark, d, ["list_density", "avg_paragraph_length"], text.synthetic)


@query()
def text_30_synthetic_features(spark, d):
    """All eighteen features; their regular expressions need look-around, which the oracle's engine lacks."""
    return _features(spark, d, list(text.synthetic(F.col("text"))), text.synthetic)


@query(
    _D + """, y AS (SELECT doc_id, n, greatest(len(list_filter(w, lambda x: regexp_matches(x, '[.!?]["'')\\]]*$'))), 1) AS s,
    list_sum([greatest(len(regexp_extract_all(x, '[aeiouyà-öø-ü]+')) - CASE WHEN regexp_matches(x, '[^aeiouy]e$') AND NOT regexp_matches(x, '[^aeiouy]le$') THEN 1 ELSE 0 END, 1) for x in lw]) AS syl FROM e)
    SELECT doc_id, CASE WHEN n > 0 THEN round(0.39 * (n / s) + 11.8 * (syl / n) - 15.59, 6) END AS flesch_kincaid_grade, CASE WHEN n > 0 THEN round(206.835 - 1.015 * (n / s) - 84.6 * (syl / n), 6) END AS flesch_reading_ease FROM y"""
)
def text_37_readability(spark, d):
    r = text.readability(F.col("text"))
    return text.spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", *[r6(c, n) for n, c in r.items()])


@query()
def text_40_token_count(spark, d):
    """Tokens of a byte-pair vocabulary, plus one for the start of the text."""
    from ..operators.tokens import byte_pairs, encoded

    return encoded(table(spark, d, "documents"), "doc_id", byte_pairs()).select("doc_id", (F.size("ids") + 1).alias("tokens"))


@query()
def src_21_packed_tokens(spark, d):
    """Lengths and offsets of the flat store of token ids, in document order."""
    from ..operators.tokens import byte_pairs, encoded, offsets

    return offsets(encoded(table(spark, d, "documents"), "doc_id", byte_pairs()), ["doc_id"])


@query("SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+|[^A-Za-z0-9\\s]')) + 1 AS INTEGER) AS tokens FROM documents")
def text_40_simple_token_count(spark, d):
    return table(spark, d, "documents").select("doc_id", text.simple_token_count(F.col("text")).alias("tokens"))


_PROB = "(ai_generated >= 0 AND ai_generated <= 1 AND CAST(ai_generated AS VARCHAR) <> 'nan')"


@query(f"SELECT __shard_idx AS shard_idx, __doc_idx AS doc_idx, round(CASE WHEN topic = 0 THEN ai_generated ELSE 1 - ai_generated END, 6) AS flipped, round(0.5 * ai_generated + (1 - ai_generated) * 0.25, 6) AS collapsed, round(ln(greatest(least(ai_generated, 0.9999), 0.0001) / (1 - greatest(least(ai_generated, 0.9999), 0.0001))), 6) AS logit, round(ln(1 + greatest(word_count, 0)), 6) AS log_words FROM master WHERE {_PROB} AND topic IS NOT NULL")
def text_41_score_transforms(spark, d):
    m = table(spark, d, "master").where("ai_generated BETWEEN 0 AND 1 AND NOT isnan(ai_generated) AND topic IS NOT NULL")
    p = F.col("ai_generated")
    return m.select(F.col("__shard_idx").alias("shard_idx"), F.col("__doc_idx").alias("doc_idx"), r6(F.when(F.col("topic") == 0, p).otherwise(1 - p), "flipped"), r6(0.5 * p + (1 - p) * 0.25, "collapsed"), r6(stats.logit(p), "logit"), r6(stats.log1p_floor(F.col("word_count")), "log_words"))


@query(f"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '^[{_WS}]+', ''), '[{_WS}]+$', ''), '\\r\\n|\\n|\\r', ' ', 'g'), '^ +', ''), ' +$', '') AS line FROM documents")
def text_43_one_line(spark, d):
    return table(spark, d, "documents").select("doc_id", text.one_line(F.col("text")).alias("line"))


@query("WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) for x in embedding[1:24]] AS v FROM embeddings), p AS (SELECT vec_id, v, [exp(x - list_max(v)) for x in v] AS e FROM e), q AS (SELECT vec_id, v, [x / list_sum(e) for x in e] AS p FROM p), t AS (SELECT vec_id, v, p, [pow(x, 0.5) for x in p] AS r FROM q) SELECT vec_id, CAST(list_position(v, list_max(v)) - 1 AS INTEGER) AS argmax, round(list_max(p), 6) AS softmax_max, round(list_max(r) / list_sum(r), 6) AS tempered_max FROM t")
def text_45_softmax_argmax_temper(spark, d):
    v = F.slice("embedding", 1, 24)
    p = table(spark, d, "embeddings").select("vec_id", v.alias("v")).withColumn("p", vector.softmax(F.col("v")))
    return p.select("vec_id", vector.argmax(F.col("v")).alias("argmax"), r6(F.array_max("p"), "softmax_max"), r6(F.array_max(vector.temper(F.col("p"), 2.0)), "tempered_max"))


@query("WITH p AS (SELECT domain, weight / sum(weight) OVER () AS p FROM mixtures WHERE mix_id = 1) SELECT domain, round(sqrt(p) / sum(sqrt(p)) OVER (), 9) AS prior FROM p")
def text_50_prior_temperature(spark, d):
    p = table(spark, d, "mixtures").where("mix_id = 1").select("domain", (F.col("weight") / F.expr("sum(weight) OVER ()")).alias("p"))
    return p.select("domain", F.round(F.sqrt("p") / F.sum(F.sqrt("p")).over(_all()), 9).alias("prior"))


def _all():
    from pyspark.sql import Window

    return Window.partitionBy()


@query("SELECT doc_id, coalesce(url, '') || chr(10) || chr(10) || coalesce(CASE WHEN length(text) > 200 THEN text[1:200] || '... (truncated)' ELSE text END, '') AS rendered FROM documents")
def text_51_template_and_truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", text.truncated(F.col("url"), F.col("text"), 200).alias("rendered"))


@query("SELECT item_id, array_to_string([chr(64 + CAST(i AS INTEGER)) || ': ' || completions[i] for i in range(1, len(completions) + 1)], chr(10)) AS options FROM eval_items")
def text_52_option_block(spark, d):
    return table(spark, d, "eval_items").select("item_id", text.option_block(F.col("completions")).alias("options"))


@query(f"WITH o AS (SELECT item_id, CAST(i - 1 AS INTEGER) AS i, ((('0x' || substr(md5(item_id || '-' || (i - 1) || ':305'), 1, 13))::BIGINT) + 0.5) / 4503599627370496.0 AS u FROM eval_items, LATERAL (SELECT unnest(range(1, len(completions) + 1)) AS i)) SELECT item_id, list(i ORDER BY u, i) AS permutation FROM o GROUP BY item_id")
def text_53_seeded_permutation(spark, d):
    """Options in the order of a hash of item and option: a permutation that every engine and run repeats."""
    o = table(spark, d, "eval_items").select("item_id", F.posexplode("completions").alias("i", "o"))
    u = stats.hash_uniform(F.concat_ws("-", F.col("item_id").cast("string"), F.col("i").cast("string")), 305)
    return o.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(u.alias("u"), "i"))), lambda s: s["i"]).alias("permutation"))


@query("SELECT vec_id, CAST(i AS INTEGER) AS chunk, round(list_sum([CAST(x AS DOUBLE) for x in embedding[i * 10 + 1:i * 10 + 10]]), 5) AS total FROM embeddings, LATERAL (SELECT unnest(range(0, greatest(CAST(ceil(len(embedding) / 10.0) AS BIGINT), 1))) AS i)")
def text_54_chunks(spark, d):
    c = table(spark, d, "embeddings").select("vec_id", F.posexplode(text.windows(F.col("embedding"), 10)).alias("chunk", "v"))
    return c.select("vec_id", "chunk", F.round(vector.total(F.col("v")), 5).alias("total"))


@query("WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) for x in embedding] AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum([x * x for x in v])) AS s FROM e), b AS (SELECT v, s FROM n WHERE vec_id = (SELECT min(vec_id) FROM n)) SELECT n.vec_id, round(n.s, 5) AS norm, round(list_sum([(n.v[i] - b.v[i]) * (n.v[i] - b.v[i]) for i in range(1, len(n.v) + 1)]), 4) AS l2, round(abs(2 - 2 * list_sum([n.v[i] / n.s * b.v[i] / b.s for i in range(1, len(n.v) + 1)])), 5) AS cos FROM n, b")
def text_55_normalise_and_distance(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding", vector.l2_normalise(F.col("embedding")).alias("u"))
    first = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("b"), F.col("u").alias("bu"))
    return e.join(F.broadcast(first)).select("vec_id", F.round(F.sqrt(vector.dot(F.col("embedding"), F.col("embedding"))), 5).alias("norm"), F.round(vector.squared_l2(F.col("embedding"), F.col("b")), 4).alias("l2"), F.round(F.abs(vector.cosine_distance(F.col("u"), F.col("bu"))), 5).alias("cos"))


@query("WITH s AS (SELECT doc_id, array_to_string([trim(regexp_replace(x, '[ \\t\\x0B\\f\\r]+', ' ', 'g')) for x in string_split(coalesce(text, ''), chr(10))], chr(10)) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 80 THEN t[1:80] || '...' ELSE t END AS snippet FROM s")
def text_58_snippet(spark, d):
    return table(spark, d, "documents").select("doc_id", text.snippet(F.col("text"), 80).alias("snippet"))


_FAMILIES = [("qr_", "qurater"), ("pc_", "predictive"), ("frac_", "surface"), ("ngram_", "repetition")]


def family(name):
    """The family of a feature by the prefix of its name."""
    c = F.lit("other")
    for prefix, label in reversed(_FAMILIES):
        c = F.when(name.startswith(prefix), label).otherwise(c)
    return c


@query("SELECT kind, code, CASE WHEN starts_with(name, 'qr_') THEN 'qurater' WHEN starts_with(name, 'pc_') THEN 'predictive' WHEN starts_with(name, 'frac_') THEN 'surface' WHEN starts_with(name, 'ngram_') THEN 'repetition' ELSE 'other' END AS family FROM taxonomy")
def text_60_family_map(spark, d):
    return table(spark, d, "taxonomy").select("kind", "code", family(F.col("name")).alias("family"))


@query("SELECT doc_id, printf('CC_shard_%08d_processed', shard_idx) AS stem, shard_idx AS back, concat_ws('_', 'topic' || CAST(shard_idx AS VARCHAR), 'doc' || CAST(doc_idx AS VARCHAR)) AS route FROM documents")
def text_61_shard_stem_and_route(spark, d):
    stem = F.format_string("CC_shard_%08d_processed", F.col("shard_idx"))
    return table(spark, d, "documents").select("doc_id", stem.alias("stem"), F.regexp_extract(stem, r"CC_shard_0*(\d+)_", 1).cast("int").alias("back"), F.concat_ws("_", F.concat(F.lit("topic"), "shard_idx"), F.concat(F.lit("doc"), "doc_idx")).alias("route"))


@query()
def text_57_entity_features(spark, d):
    from ..operators.annotate import entity_features

    return entity_features(text.spread(table(spark, d, "documents").select("doc_id", "text")))


@query()
def text_59_curve_shape(spark, d):
    from ..operators.evaluate import curve_shapes
    from .aggregates import long

    return curve_shapes(long(spark, d).where("x BETWEEN 0 AND 1").join(table(spark, d, "master").groupBy(F.col("__shard_idx").alias("shard_idx"), F.col("__doc_idx").alias("doc_idx")).agg(F.max("word_count").alias("y")), ["shard_idx", "doc_idx"]), "feature", "x", "y")


@query("SELECT item_id, coalesce(passage || chr(10) || chr(10), '') || question AS context, completions, gold FROM eval_items WHERE question IS NOT NULL")
def src_17_benchmark_items(spark, d):
    """Items as (context, completions, gold), the passage before the question."""
    e = table(spark, d, "eval_items").where("question IS NOT NULL")
    return e.select("item_id", F.concat(F.coalesce(F.concat("passage", F.lit("\n\n")), F.lit("")), "question").alias("context"), "completions", "gold")


@query("SELECT user_id, array_to_string(list(event_type ORDER BY ts, event_id), chr(10)) AS conversation FROM events GROUP BY user_id")
def src_14_conversations(spark, d):
    """Turns of a conversation joined in order by line ends; here the events of a user."""
    t = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("turns"))
    return t.select("user_id", F.array_join(F.transform("turns", lambda s: s["event_type"]), "\n").alias("conversation"))


@query("SELECT doc_id, lang FROM documents")
def src_06_projected_scan(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang")


@query("SELECT shard_idx, doc_idx, topic AS label FROM domains_topics UNION ALL SELECT shard_idx, doc_idx, format FROM domains_formats")
def src_07_glob_concat(spark, d):
    return table(spark, d, "domains_topics").select("shard_idx", "doc_idx", F.col("topic").alias("label")).unionByName(table(spark, d, "domains_formats").select("shard_idx", "doc_idx", F.col("format").alias("label")))


@query("WITH s AS (SELECT shard_idx, count(*) AS n FROM documents GROUP BY 1), e AS (SELECT shard_idx, n, sum(n) OVER (ORDER BY shard_idx) AS stop FROM s), g AS (SELECT vec_id, vec_id % (SELECT sum(n) FROM s) AS row_id FROM embeddings) SELECT vec_id, CAST(row_id AS BIGINT) AS row_id, shard_idx AS shard, CAST(row_id - (stop - n) AS BIGINT) AS local FROM g JOIN e ON row_id >= stop - n AND row_id < stop")
def src_08_sharded_matrix(spark, d):
    """Global row numbers as (shard, place in it) over shards laid end to end."""
    from ..sources.readers import locate

    sizes = table(spark, d, "documents").groupBy("shard_idx").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))  # one row
    rows = table(spark, d, "embeddings").select("vec_id").join(F.broadcast(total)).select("vec_id", (F.col("vec_id") % F.col("total")).alias("row_id"))
    return locate(rows, "row_id", sizes, "shard_idx", "n").select("vec_id", "row_id", "shard", "local")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT vec_id FROM embeddings WHERE label = 3)")
def src_10_subset_view(spark, d):
    e = table(spark, d, "embeddings")
    return e.join(e.where("label = 3").select("vec_id"), "vec_id", "left_semi").select("vec_id", "label")


@query("SELECT shard_idx, count(*) AS n, min(doc_idx) AS first, max(doc_idx) AS last FROM documents WHERE n_chars > 500 GROUP BY shard_idx")
def src_18_index_per_shard(spark, d):
    return table(spark, d, "documents").where("n_chars > 500").groupBy("shard_idx").agg(F.count("*").alias("n"), F.min("doc_idx").alias("first"), F.max("doc_idx").alias("last"))


@query("WITH t AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+|[^A-Za-z0-9\\s]')) + 1 AS n FROM documents) SELECT doc_id, CAST(sum(n) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS start, CAST(n AS BIGINT) AS n FROM t")
def src_21_token_store(spark, d):
    """Lengths and offsets of a flat token store in document order."""
    from ..operators.prefix import running_sum

    t = text.spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", text.simple_token_count(F.col("text")).cast("bigint").alias("n"))
    return running_sum(t, "n", [], [F.col("doc_id").asc()], "stop").select("doc_id", (F.col("stop") - F.col("n")).alias("start"), "n")


@query("SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.quality, o.quality) AS quality, o.toxic FROM (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels WHERE annotator = 'ann_a' GROUP BY 1) o FULL JOIN (SELECT doc_id, max(quality) AS quality FROM labels WHERE annotator = 'ann_b' GROUP BY 1) n ON o.doc_id = n.doc_id")
def src_26_upsert(spark, d):
    from ..sources.sinks import upsert

    lab = table(spark, d, "labels")
    old = lab.where("annotator = 'ann_a'").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    new = lab.where("annotator = 'ann_b'").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return upsert(old, new, "doc_id")
