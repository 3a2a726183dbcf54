"""Queries ``pN_...`` over the tables of a corpus folder, and their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import spread
from . import abuse, cutoff, encoding, leakage, lines, mixing, reading, subjects
from .common import latest, shared_dir, table

KEY = ["shard_idx", "doc_idx"]




def _documents(spark: SparkSession, d: str) -> DataFrame:
    """All documents, dealt out where a single small file would leave cores idle."""
    return spread(table(spark, d, "documents"))


# 1: token budget -----------------------------------------------------------

def _counts(spark: SparkSession, d: str, every_key: bool = False) -> DataFrame:
    return encoding.usable_counts(_documents(spark, d), table(spark, d, "tokens"), every_key=every_key)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d).where("NOT usable AND NOT blank").select("doc_id")


def p1_totals(spark: SparkSession, d: str) -> DataFrame:
    return encoding.token_budget(_counts(spark, d, every_key=True), table(spark, d, "domains_topics"), table(spark, d, "domains_formats"))


def p1_recorded(spark: SparkSession, d: str) -> DataFrame:
    """The budget of the recorded counts alone, for comparison: what it leaves uncounted has to be estimated."""
    return encoding.token_budget(encoding.recorded_counts(table(spark, d, "tokens")), table(spark, d, "domains_topics"), table(spark, d, "domains_formats")).where("dimension IN ('topic', 'format')")


_RECORDED = """
WITH k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY shard_idx, doc_idx ORDER BY annotated_at DESC NULLS LAST) AS rn FROM tokens WHERE shard_idx IS NOT NULL AND doc_idx IS NOT NULL) WHERE rn = 1),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY shard_idx, doc_idx ORDER BY annotated_at DESC NULLS LAST) AS rn FROM domains_topics) WHERE rn = 1),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY shard_idx, doc_idx ORDER BY annotated_at DESC NULLS LAST) AS rn FROM domains_formats) WHERE rn = 1),
w AS (SELECT CASE WHEN token_count BETWEEN 1 AND 1000000 THEN token_count END AS n, topic, format FROM k LEFT JOIN t USING (shard_idx, doc_idx) LEFT JOIN f USING (shard_idx, doc_idx)),
s AS (SELECT 'topic' AS dimension, CASE WHEN topic BETWEEN 0 AND 23 THEN CAST(topic AS VARCHAR) ELSE '(unknown)' END AS slice, n FROM w
  UNION ALL SELECT 'format', CASE WHEN format BETWEEN 0 AND 23 THEN CAST(format AS VARCHAR) ELSE '(unknown)' END, n FROM w)
SELECT dimension, slice, count(*) AS documents, CAST(coalesce(sum(n), 0) AS BIGINT) AS tokens, CAST(0 AS BIGINT) AS estimated_documents, count(*) - count(n) AS uncounted_documents FROM s GROUP BY dimension, slice
"""


# 2: subjects ---------------------------------------------------------------

def _subjects(spark: SparkSession, d: str) -> DataFrame:
    documents = _documents(spark, d)
    names = {r["name"]: r["code"] for r in table(spark, d, "taxonomy").where("kind = 'topic'").collect()}
    rules = subjects.mine(subjects.labelled(documents, table(spark, d, "labels"), table(spark, d, "domains_topics")), names)
    return subjects.assign(documents, rules)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "topic")


def p2_makeup(spark: SparkSession, d: str) -> DataFrame:
    """Documents by subject, of these the ones it is the main subject of, and its share of all assignments."""
    by = _subjects(spark, d).groupBy("topic").agg(F.count("*").alias("documents"), F.sum((F.col("rank") == 1).cast("bigint")).alias("main"))
    names = table(spark, d, "taxonomy").where("kind = 'topic'").select(F.col("code").alias("topic"), "name")
    return by.join(F.broadcast(names), "topic", "left").withColumn("share", F.col("documents") / F.expr("sum(documents) OVER ()"))


# 3: cutoffs ----------------------------------------------------------------

def _scored(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "master").select(F.col("__shard_idx").alias("shard_idx"), F.col("__doc_idx").alias("doc_idx"), "topic", "dclm_score", "built_at")
    shared_dir(spark)
    good = latest(m, KEY, "built_at", ["topic", "dclm_score"]).where("topic BETWEEN 0 AND 23 AND dclm_score BETWEEN 0 AND 1 AND NOT isnan(dclm_score)")
    return good.select(*KEY, F.col("topic").alias("grp"), F.col("dclm_score").alias("score")).checkpoint()


def _cuts(spark: SparkSession, d: str, scored: DataFrame) -> DataFrame:
    return cutoff.cutoffs(scored, table(spark, d, "keep_targets").select(F.col("topic").alias("grp"), F.col("keep_fraction").alias("fraction")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    scored = _scored(spark, d)
    return cutoff.keep(scored, _cuts(spark, d, scored)).select(*KEY)


def p3_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    return _cuts(spark, d, _scored(spark, d)).select(F.col("grp").alias("topic"), "n", "k", "cutoff", "kept")


_RECORDS = """
WITH newest AS (SELECT __shard_idx AS shard_idx, __doc_idx AS doc_idx, topic, dclm_score,
  row_number() OVER (PARTITION BY __shard_idx, __doc_idx ORDER BY built_at DESC) AS rn
  FROM master WHERE __shard_idx IS NOT NULL AND __doc_idx IS NOT NULL),
r AS (SELECT * FROM newest WHERE rn = 1 AND topic BETWEEN 0 AND 23 AND NOT isnan(dclm_score) AND dclm_score BETWEEN 0 AND 1),
a AS (SELECT *, count(*) OVER (PARTITION BY topic) AS n, count(*) OVER (PARTITION BY topic ORDER BY dclm_score DESC) AS reach FROM r),
c AS (SELECT topic, any_value(n) AS n, CAST(ceil(any_value(keep_fraction) * any_value(n)) AS BIGINT) AS k,
  max(CASE WHEN reach >= keep_fraction * n THEN dclm_score END) AS cutoff FROM a JOIN keep_targets USING (topic) GROUP BY topic)
"""


# 4: kinds of text ----------------------------------------------------------

def _kinds(spark: SparkSession, d: str, with_statistics: bool = False) -> DataFrame:
    return lines.classify(_documents(spark, d), with_statistics)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _kinds(spark, d).where("kind <> 'prose'").select("doc_id", "kind")


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    return _kinds(spark, d, with_statistics=True)


# 5: reading level ----------------------------------------------------------

def _levels(spark: SparkSession, d: str) -> DataFrame:
    documents = _documents(spark, d)
    return reading.levels(documents, reading.fit(documents, table(spark, d, "labels")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).select("doc_id", "reading_level")


def p5_profile(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).groupBy("reading_level").agg(F.count("*").alias("documents"))


# 6: mixtures ---------------------------------------------------------------

def _mixing(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    shared_dir(spark)
    topics = latest(table(spark, d, "domains_topics"), KEY, "annotated_at", ["topic"]).where("topic BETWEEN 0 AND 23")
    counts = latest(table(spark, d, "tokens"), KEY, "annotated_at", ["token_count"]).where("token_count BETWEEN 1 AND 1000000")
    records = topics.join(counts, KEY).select(*KEY, F.col("topic").alias("domain"), F.col("token_count").cast("bigint").alias("tokens"))
    records = mixing.hashed(records, KEY).checkpoint()
    return records, mixing.plan(records, table(spark, d, "mixtures"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _mixing(spark, d)[1].where("short").select("mix_id", "domain")


def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    rounded = [F.round(c, n).alias(c) for c, n in (("target", 6), ("target_share", 9), ("actual_share", 9))]
    return _mixing(spark, d)[1].select("mix_id", "domain", "size", "reached", "short", *rounded)


def p6_copies(spark: SparkSession, d: str) -> DataFrame:
    records, planned = _mixing(spark, d)
    return mixing.copies(records, planned)


_SIZES = """
WITH t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY shard_idx, doc_idx ORDER BY annotated_at DESC) AS rn FROM domains_topics) WHERE rn = 1 AND topic BETWEEN 0 AND 23),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY shard_idx, doc_idx ORDER BY annotated_at DESC) AS rn FROM tokens) WHERE rn = 1 AND token_count BETWEEN 1 AND 1000000),
s AS (SELECT topic AS domain, sum(token_count) AS size FROM t JOIN k USING (shard_idx, doc_idx) GROUP BY topic),
g AS (SELECT m.mix_id, m.domain, coalesce(size, 0) AS size, max_repeats, weight / sum(weight) OVER (PARTITION BY mix_id) * total_share * (SELECT sum(size) FROM s) AS target FROM mixtures m LEFT JOIN s USING (domain))
"""

#: What a mix takes of a domain beyond whole copies: records in the order of their hash while they fit the rest of the target.
_TAKEN = _SIZES + """
, r AS (SELECT shard_idx, doc_idx, topic AS domain, token_count AS tokens, CAST('0x' || substr(md5(shard_idx || '-' || doc_idx), 1, 15) AS BIGINT) AS h FROM t JOIN k USING (shard_idx, doc_idx)),
w AS (SELECT *, size * max_repeats < target AS short, CASE WHEN size * max_repeats < target THEN max_repeats WHEN size = 0 THEN 0 ELSE CAST(floor(target / size) AS INTEGER) END AS whole,
  target / nullif((SELECT sum(size) FROM s), 0) / (SELECT any_value(total_share) FROM mixtures x WHERE x.mix_id = g.mix_id) AS target_share FROM g),
o AS (SELECT mix_id, w.domain, shard_idx, doc_idx, tokens, whole, CASE WHEN short THEN 0.0 ELSE target - whole * size END AS budget, sum(tokens) OVER (PARTITION BY mix_id, w.domain ORDER BY h ROWS UNBOUNDED PRECEDING) AS run FROM w JOIN r ON r.domain = w.domain)
"""


# 7: encoding ---------------------------------------------------------------

def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(_documents(spark, d))


# 8: leakage ----------------------------------------------------------------

def p8_matches(spark: SparkSession, d: str) -> DataFrame:
    return leakage.search(_documents(spark, d), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_matches(spark, d).select("doc_id", "item_id")


# 9: abusive language -------------------------------------------------------

def _abuse(spark: SparkSession, d: str, columns: list[str]) -> DataFrame:
    documents = _documents(spark, d)
    return abuse.score(documents, abuse.fit(documents, table(spark, d, "labels")), columns)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _abuse(spark, d, ["doc_id"]).where("abusive").select("doc_id")


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    source = F.coalesce(F.nullif(F.lower(F.trim("source")), F.lit("")), F.lit("(unknown)")).alias("source")
    by = _abuse(spark, d, ["doc_id", "source"]).groupBy(source).agg(F.count("*").alias("documents"), F.sum(F.col("abusive").cast("bigint")).alias("abusive"))
    return by.withColumn("rate", F.col("abusive") / F.col("documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_totals, p1_recorded, p2_found, p2_makeup, p3_found, p3_cutoffs, p4_found, p4_shares, p5_found, p5_profile, p6_found, p6_shares, p6_copies, p7_ids, p8_found, p8_matches, p9_found, p9_rates)}

SQL = {
    "p1_recorded": _RECORDED,
    "p3_found": _RECORDS + "SELECT shard_idx, doc_idx FROM r JOIN c USING (topic) WHERE dclm_score >= cutoff",
    "p3_cutoffs": _RECORDS + "SELECT topic, n, k, cutoff, (SELECT count(*) FROM r WHERE r.topic = c.topic AND dclm_score >= cutoff) AS kept FROM c",
    "p6_copies": _TAKEN + "SELECT mix_id, domain, shard_idx, doc_idx, CAST(tokens AS BIGINT) AS tokens, CAST(whole + CASE WHEN run <= budget THEN 1 ELSE 0 END AS INTEGER) AS n_copies FROM o WHERE whole + CASE WHEN run <= budget THEN 1 ELSE 0 END > 0",
    "p6_shares": _TAKEN + """, e AS (SELECT mix_id, domain, coalesce(max(CASE WHEN run <= budget THEN run END), 0) AS rest FROM o GROUP BY 1, 2),
f AS (SELECT w.*, whole * size + coalesce(rest, 0) AS got FROM w LEFT JOIN e ON e.mix_id = w.mix_id AND e.domain = w.domain)
SELECT mix_id, domain, CAST(size AS BIGINT) AS size, round(target, 6) AS target, CAST(got AS BIGINT) AS reached, round(target_share, 9) AS target_share, round(got / sum(got) OVER (PARTITION BY mix_id), 9) AS actual_share, short FROM f""",
    "p6_found": _SIZES + "SELECT mix_id, domain FROM g WHERE size * max_repeats < target",
}
