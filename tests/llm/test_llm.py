"""Training-data operators on small fixtures: edge cases, brute force, round trips, held-out accuracy."""

import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveloom.llm import abuse, cutoff, encoding, leakage, lines, mixing, queries, reading, subjects
from sieveloom.llm.common import latest, least_hash
from sieveloom.llm.tokenizer import SPLIT_PATTERN, _UNUSUAL, encoder, split

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, url string, shard_idx int, doc_idx int, fetched_at timestamp"
PROSE = "The cat sat on the mat because it was warm and the dog was not at home. Later the man went to the shop, and he bought some bread for his family. "
LONG = PROSE * 2000


def docs(spark, texts, extra=False):
    rows = [(i, t, "en", "s", len(t) if t is not None else None, f"http://x.example/{i}", 0, i, None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOC)
    # columns whose names clash with computed ones
    return df.withColumns({c: F.lit(1) for c in ("kind", "score", "topic", "n_tokens", "usable", "ids", "share")}) if extra else df


EDGE = [None, "", "  \n", "a", PROSE, PROSE, LONG, "日本語のテキストです。", "x" * 50_000, "😀 ​"]


# 7, 1: encoding ------------------------------------------------------------


def test_encoding_round_trip(spark):
    df = docs(spark, EDGE, extra=True)
    got = {r["doc_id"]: r["ids"] for r in encoding.encode(df).collect()}
    e = encoder()
    assert got[0] == [] and got[1] == []
    for i, t in enumerate(EDGE):
        assert e.decode(got[i]) == (t or "")
    assert encoding.encode(df.limit(0)).count() == 0


def test_encoding_equals_public_library():
    import base64

    import tiktoken

    from sieveloom.llm.tokenizer import TOKENIZER_DIR, VOCABULARY

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{TOKENIZER_DIR}/{VOCABULARY}", "rb"))}
    t = tiktoken.Encoding("own", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    e = encoder()
    for s in ["Hello world's  \n\n end ", "naïve café ½ x² \x1c   <|endoftext|>", "شكرا 123 नमस्ते", "a\r\n\tb   ", "…—“quoted”'ll", PROSE]:
        assert [i for p in split(s) for i in e[p]] == t.encode_ordinary(s)


def test_usual_characters_split_alike():
    import re

    import regex

    for c in map(chr, range(0x11000)):
        if not _UNUSUAL.search(c):
            assert bool(re.match(r"[^\W\d_]", c)) == bool(regex.match(r"\p{L}", c)) and bool(re.match(r"\d", c)) == bool(regex.match(r"\p{N}", c)) and bool(re.match(r"\s", c)) == bool(regex.match(r"\s", c))


def test_usable_counts(spark):
    d = docs(spark, [PROSE] * 6 + [None, " "])
    n = len([i for p in split(PROSE) for i in encoder()[p]]) + 1
    tok = spark.createDataFrame([(0, 0, n, 1), (0, 1, n, 2), (0, 1, None, 1), (0, 2, n * 4, 1), (0, 3, n, 1), (0, 3, -1, 2), (0, 3, -1, 2), (0, 4, n // 4, 1), (None, 5, n, 1)], "shard_idx int, doc_idx int, token_count int, t int").withColumn("annotated_at", F.timestamp_seconds("t")).drop("t")
    r = {x["doc_id"]: x for x in encoding.usable_counts(d, tok).collect()}
    assert [r[i]["usable"] for i in range(6)] == [True, True, False, False, False, False]
    assert r[2]["n_used"] == n and r[6]["blank"] and r[7]["blank"] and r[6]["n_estimated"] == 0
    none = spark.createDataFrame([], "shard_idx int, doc_idx int, topic int, format int, annotated_at timestamp")
    t = {(x["dimension"], x["slice"]): x["tokens"] for x in encoding.token_budget(encoding.usable_counts(d, tok), none, none).collect()}
    assert t["source", "s"] == 6 * n == t["topic", "(unknown)"]


@pytest.mark.parametrize("hot", [0, 3, 10**6])
def test_counts_join_lengths_with_frequencies(spark, hot):
    """Whatever pieces are frequent, the join gives the tokens of each text; equal texts and ids are each counted."""
    d = docs(spark, [*EDGE, LONG], extra=True)
    d = d.unionByName(d)
    got = sorted((r["doc_id"], r["n_tokens"]) for r in encoding.count_tokens(d, ["doc_id"], hot=hot).collect())
    n = lambda t: sum(len(encoder()[p]) for p in split(t)) if t and not t.isspace() else 0
    assert got == sorted([(i, n(t)) for i, t in enumerate([*EDGE, LONG])] * 2)
    lengths = {r["piece"]: r for r in encoding.piece_lengths(d).collect()}
    assert lengths[" cat"]["n"] == 2 * (LONG.count(" cat") * 2 + 2) and len(lengths) == len({p for t in EDGE if t for p in split(t)})
    assert encoding.count_tokens(d.limit(0), ["doc_id"], hot=hot).count() == 0


def test_budget_of_keys_without_text(spark):
    d = docs(spark, [PROSE, None])
    n = len([i for p in split(PROSE) for i in encoder()[p]]) + 1
    tok = spark.createDataFrame([(0, 0, 9 * n), (7, 1, 100), (7, 2, 50), (7, 3, -1), (7, 4, None), (7, 5, 2_000_000)], "shard_idx int, doc_idx int, token_count int").withColumn("annotated_at", F.timestamp_seconds(F.lit(1)))
    lab = spark.createDataFrame([(0, 0, 3, 4), (7, 1, 3, 4), (7, 2, 5, 99), (7, 3, 5, 4)], "shard_idx int, doc_idx int, topic int, format int").withColumn("annotated_at", F.timestamp_seconds(F.lit(1)))
    counts = encoding.usable_counts(d, tok, every_key=True)
    assert counts.count() == 7 and encoding.usable_counts(d, tok).count() == 2
    got = {(x["dimension"], x["slice"]): (x["documents"], x["tokens"], x["estimated_documents"], x["uncounted_documents"]) for x in encoding.token_budget(counts, lab, lab).collect()}
    assert got["topic", "3"] == (2, n + 100, 1, 0) and got["topic", "5"] == (2, 50, 0, 1) and got["topic", "(unknown)"] == (3, 0, 1, 2)
    assert got["source", "(unknown)"] == (5, 150, 0, 3) == got["lang", "(unknown)"] and got["source", "s"] == (2, n, 2, 0)
    four = "source, lang, topic, format"
    assert got[four, '["s","en","3","4"]'] == (1, n, 1, 0) and got[four, '["(unknown)","(unknown)","3","4"]'] == (1, 100, 0, 0)
    for i in range(4):
        assert sum(v[i] for k, v in got.items() if k[0] == four) == sum(v[i] for k, v in got.items() if k[0] == "lang")


def test_latest(spark):
    df = spark.createDataFrame([(1, 1, 5, 1), (1, 1, None, 2), (1, None, 3, 3), (2, 1, 7, None)], "a int, b int, v int, t int").withColumn("t", F.timestamp_seconds("t"))
    assert sorted(map(tuple, latest(df, ["a", "b"], "t", ["v"]).collect())) == [(1, 1, None), (2, 1, 7)]


def test_least_hash(spark):
    df = spark.range(5000).unionByName(spark.range(3)).repartition(5)
    h = {r["id"]: r["h"] for r in spark.range(5000).select("id", F.xxhash64("id").alias("h")).collect()}
    rows = sorted([*range(5000), 0, 1, 2], key=lambda i: h[i])
    for n in (1, 40, 1000, 3000, 9000):
        assert sorted(r["id"] for r in least_hash(df, "id", n).collect()) == sorted(rows[:n])
    assert least_hash(df, "id", 0).count() == 0 == least_hash(df.limit(0), "id", 5).count()


# 3: cutoffs ----------------------------------------------------------------


@pytest.mark.parametrize("fractions", [[0.25, 0.5, 1.0, 0.0, 2.0], [0.001, 0.999, 0.3333, 0.75, 0.1]])
def test_cutoffs(spark, fractions):
    rng = np.random.default_rng(5)
    g = np.where(rng.random(3000) < 0.4, 0, rng.integers(0, 5, 3000))
    s = np.where(g == 1, 0.5, np.round(rng.random(3000), 2))  # ties, and a group of one value
    s[g == 2] = rng.random((g == 2).sum())
    records = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, s)], "grp int, score double").repartition(7)
    targets = spark.createDataFrame([(i, f) for i, f in enumerate(fractions)] + [(9, 0.5), (None, 0.5), (4, None)], "grp int, fraction double")
    got = {r["grp"]: r for r in cutoff.cutoffs(records, targets).collect()}
    assert set(got) == set(range(5))
    for i, f in enumerate(fractions):
        x = np.sort(s[g == i])[::-1]
        k = min(len(x), math.ceil(f * len(x)))
        if k <= 0:
            assert got[i]["cutoff"] is None and got[i]["kept"] == 0
        else:
            assert got[i]["cutoff"] == x[k - 1] and got[i]["kept"] == (x >= x[k - 1]).sum() and got[i]["n"] == len(x)
    kept = cutoff.keep(records, cutoff.cutoffs(records, targets))
    assert kept.count() == sum(r["kept"] for r in got.values())


def test_cutoffs_of_nothing(spark):
    none = spark.createDataFrame([], "grp int, score double")
    t = spark.createDataFrame([(1, 0.5)], "grp int, fraction double")
    assert cutoff.cutoffs(none, t).count() == 0


# 6: mixtures ---------------------------------------------------------------


def test_mixing(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(d), int(t)) for i, (d, t) in enumerate(zip(np.where(rng.random(2000) < 0.5, 0, rng.integers(1, 4, 2000)), rng.integers(1, 100, 2000)))]
    rec = mixing.hashed(spark.createDataFrame(rows, "k int, domain int, tokens bigint"), ["k"]).persist()
    mixes = spark.createDataFrame([(1, 0, 0.2, 1, 0.5), (1, 1, 0.5, 2, 0.5), (1, 9, 0.3, 5, 0.5), (2, 2, 3.0, 2, 0.1), (2, 3, None, 1, 0.1), (2, 0, 1.0, 4, 0.1)], "mix_id int, domain int, weight double, max_repeats int, total_share double")
    p = {(r["mix_id"], r["domain"]): r for r in mixing.plan(rec, mixes).collect()}
    total = sum(t for *_, t in rows)
    size = {d: sum(t for _, x, t in rows if x == d) for d in range(4)}
    taken = {(r["mix_id"], r["domain"]): r["t"] for r in mixing.copies(rec, mixing.plan(rec, mixes)).groupBy("mix_id", "domain").agg(F.sum(F.col("tokens") * F.col("n_copies")).alias("t")).collect()}
    for (m, d), r in p.items():
        w = {(1, 0): 0.2, (1, 1): 0.5, (1, 9): 0.3, (2, 2): 0.75, (2, 3): 0.0, (2, 0): 0.25}[m, d] * (0.5 if m == 1 else 0.1) * total
        assert r["target"] == pytest.approx(w)
        repeats = {(1, 0): 1, (1, 1): 2, (1, 9): 5, (2, 2): 2, (2, 3): 1, (2, 0): 4}[m, d]
        assert r["short"] == (size.get(d, 0) * repeats < w)
        assert r["reached"] == taken.get((m, d), 0)
        assert r["reached"] <= w + 1e-6 and (r["short"] or w - r["reached"] < 100)
    # of an empty corpus every target is 0 and met
    assert [r["target"] for r in mixing.plan(rec.limit(0), mixes).where("NOT short").collect()] == [0.0] * 6
    assert mixing.plan(rec, mixes.limit(0)).count() == 0


# 4: kinds ------------------------------------------------------------------

LIST = "\n".join(f"- {w}" for w in "apple pear red cherry plum grape melon fig".split())
TABLE = "name,count,price\n" + "\n".join(f"item,{i},{i * 3.5:.2f}" for i in range(12))
JUNK = "Home | Menu | Contact | Log in | Share | Top | Sitemap | FAQ | Next | Prev"


def test_kinds(spark):
    d = docs(spark, [*EDGE, LIST, TABLE, JUNK, "cheap shoes online " * 40, "- This is a sentence about the house.\n- And this is another one, as it was said."], extra=True)
    r = {x["doc_id"]: x["kind"] for x in lines.classify(d).collect()}
    assert [r[i] for i in range(3)] == [None] * 3
    assert [r[i] for i in (4, 5, 6)] == ["prose"] * 3
    assert [r[i] for i in range(10, 15)] == ["list", "table", "junk", "junk", "prose"]
    assert lines.classify(d.limit(0)).count() == 0


def test_statistics_beside_the_kinds(spark):
    texts = [None, "  ", PROSE, "Ab1, cd!\n- the x", LONG + "#" * 1000]
    d = docs(spark, texts, extra=True)
    r = {x["doc_id"]: x for x in lines.classify(d, True, lines.Model()).collect()}
    plain = {x["doc_id"]: x for x in lines.classify(d, model=lines.Model()).collect()}
    assert all(r[i][c] == plain[i][c] for i in r for c in plain[i].asDict()) and "frac_alpha" not in plain[2]
    assert r[0]["mean_word_length"] is None is r[1]["frac_alpha"] and r[0]["char_count"] == 0 and r[1]["char_count"] == 2
    x = r[3]
    assert x["mean_word_length"] == 12 / 5 and x["frac_alpha"] == 8 / 16 and x["mean_line_length"] == 7.5 and x["frac_symbol"] == 3 / 16
    assert x["frac_lines_terminal_punct"] == 1 / 2 and x["stopword_fraction"] == 1 / 5 and r[2]["frac_lines_terminal_punct"] == 1
    assert r[4]["char_count"] == len(texts[4]) and r[4]["frac_symbol"] == pytest.approx((LONG.count(".") + LONG.count(",") + 1000) / len(texts[4]))
    assert {"mean_word_length", "frac_alpha", "mean_line_length", "frac_symbol"} <= set(queries.p4_shares(spark, "/root/testdata/sf0.001").columns)


def test_statistics_equal_the_base_features(spark, data):
    """The same numbers as the native expressions of the core give, on real and on odd texts."""
    from sieveloom.functions.text import heuristics, with_features

    odd = [*EDGE, "A\r\nB.\r\n- c?\u2028\n1. d \n•x\n• y", "²³ ½ ٣ é É ǅ ß ΟΔΟΣ İI", "\u00a0\u3000", "a\x1cb\x85c.", '"q"\t\n*\tz', "一二三。\n四!"]
    d = docs(spark, odd).select("doc_id", "text").unionByName(spark.read.parquet(f"{data}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    staged, native = with_features(d, "text", heuristics)
    names = [c for c in lines.STATISTICS if c in native]
    want = {r["doc_id"]: r for r in staged.select("doc_id", "text", *[native[c].alias(c) for c in names]).collect()}
    ids = sorted(want)
    got = lines.statistics([want[i]["text"] for i in ids])
    assert len(names) == len(lines.STATISTICS) - 1
    for k, i in enumerate(ids):
        for c in names:
            a, b = got[c][k], want[i][c]
            assert a == b or a == pytest.approx(b, rel=1e-12), (want[i]["text"][:80], c)


def test_posterior_is_forward_backward():
    import itertools

    rng = np.random.default_rng(0)
    codes = rng.integers(0, int(np.prod(lines.SIZES)), 9)
    m = lines.Model()
    moves, want_moves = np.zeros((4, 4)), np.zeros((4, 4))
    lengths = np.array([3, 5, 1])
    post = m.posterior(codes, lengths, moves)
    for a, n in ((0, 3), (3, 5), (8, 1)):
        want, own, total = np.zeros((n, 4)), np.zeros((4, 4)), 0.0
        for path in itertools.product(range(4), repeat=n):
            p = m.start[path[0]] * np.prod([m.move[i, j] for i, j in zip(path, path[1:])]) * np.prod([m.likelihood[codes[a + t], s] for t, s in enumerate(path)])
            total += p
            for t, s in enumerate(path):
                want[t, s] += p
            for i, j in zip(path, path[1:]):
                own[i, j] += p
        assert np.allclose(post[a : a + n], want / total)
        want_moves += own / total
    assert np.allclose(moves, want_moves)
    counts = m.expected([(codes, lengths)])
    assert counts[-1] == 3 and counts[-21:-17].sum() == pytest.approx(3) and counts[:20].sum() == pytest.approx(9)


def test_likelihood_of_statistics():
    m = lines.Model()
    x = (4, 0, 1, 2, 3, 1, 0, 2, 1, 2)
    p = np.prod([t[:, v] for t, v in zip(m.tables, x)], axis=0)
    assert np.allclose(m.likelihood[np.ravel_multi_index(x, lines.SIZES)], np.maximum(p / p.max(), 1e-6), rtol=1e-5)


def test_kinds_are_estimated_on_all_documents(spark):
    """Expected counts of parts of the corpus add up: the model doesn't depend on the partitions."""
    d = docs(spark, [*EDGE, LIST, TABLE, JUNK] * 3)
    one, many = (lines.estimate(lines.observed(d.repartition(n), ["doc_id"]), 2) for n in (1, 5))
    assert np.allclose(one.move, many.move) and np.allclose(one.likelihood, many.likelihood)


# 5: reading level ----------------------------------------------------------


def test_reading_levels(spark):
    easy = ["We see a dog. The cat is big. I like my red ball. Look at the sun. He can run fast. "] * 4
    hard = ["The epistemological ramifications of heterogeneous methodology necessitate considerable reconceptualisation within the institutional framework. "] * 4
    texts = [" ".join((easy if i % 2 else hard)[:4]) * 2 for i in range(40)] + [None, "", "short text"]
    d = docs(spark, texts, extra=True)
    lab = spark.createDataFrame([(i, 1 if i % 2 else 4) for i in range(30)] + [(31, None)], "doc_id bigint, reading_level int")
    model = reading.fit(d, lab)
    r = {x["doc_id"]: x["reading_level"] for x in reading.levels(d, model, lines.Model()).collect()}
    assert all(r[i] == (1 if i % 2 else 4) for i in range(30, 40)) and not {40, 41, 42} & set(r)
    assert reading.fit(d, lab.limit(0)) is None and reading.levels(d, None, lines.Model()).count() == 0


def test_latent_levels_follow_the_difficulties():
    """Simulated Rasch-type texts: documents' levels come back from the words alone, thresholds part the judged ones, words of one level get its steps."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    home = np.arange(60) % 4
    say = lambda level: [words[i] for i in rng.choice(60, 8, p=np.where(home == level - 1, 3.0, 1.0) / np.where(home == level - 1, 3.0, 1.0).sum())]
    level = rng.integers(1, 5, 200)
    texts = [[say(v if rng.random() < 0.8 else rng.integers(1, 5)) for _ in range(20)] for v in level]
    counts, sentences = np.zeros((60, 4)), np.zeros(4)
    for t, v in zip(texts[:100], level):
        sentences[v - 1] += len(t)
        for s in t:
            for w in set(s):
                counts[words.index(w), v - 1] += 1
    m = reading.Difficulties(words, counts, sentences, 8 * sentences.sum())
    assert (m.rate.argmax(axis=1) == home).mean() > 0.9
    flat, doc = reading._flat(texts)
    place, shares, _ = reading.latent(m, flat, doc, 200)
    cuts = reading.thresholds(place[:100], level[:100])
    assert (np.searchsorted(cuts, place[100:]) + 1 == level[100:]).mean() > 0.9 and np.allclose(shares.sum(axis=1), 1)
    assert reading.latent(m, [], np.zeros(0, np.int64), 1)[0] == pytest.approx(2.5)
    assert reading.thresholds(np.array([1.0, 2.0]), np.array([1, 1])).tolist() == [np.inf] * 3


# 2: subjects ---------------------------------------------------------------


def test_subjects(spark):
    words = {1: ["compiler", "software", "branch"], 9: ["soup", "oven", "bread"]}
    say = lambda t, n: " ".join(f"The {words[t][k % 3]} and the {words[t][(k + 1) % 3]} were there for a while in the house." for k in range(n))
    texts = [say(1 if i % 2 else 9, 6) for i in range(40)] + [say(1, 4) + " " + say(9, 4), None, "", "Thank you for the visit and see you again."]
    d = docs(spark, texts).withColumn("url", F.when(F.col("doc_id") == 43, "https://x.example/oven/a").otherwise("https://x.example/"))
    lab = spark.createDataFrame([(i, 1 if i % 2 else 9) for i in range(30)], "doc_id bigint, topic int").withColumn("labelled_at", F.lit(None).cast("timestamp"))
    top = spark.createDataFrame([(0, i, 25) for i in range(40)], "shard_idx int, doc_idx int, topic int").withColumn("annotated_at", F.lit(None).cast("timestamp"))
    rules = subjects.mine(subjects.labelled(d, lab, top), {"software": 1, "food": 9})
    r = {}
    for x in subjects.assign(d, rules, lines.Model()).collect():
        r.setdefault(x["doc_id"], set()).add(x["topic"])
    assert all(r[i] == {1 if i % 2 else 9} for i in range(40)) and r[40] == {1, 9} and r[43] == {9} and 41 not in r and 42 not in r
    empty = subjects.mine(subjects.labelled(d.limit(0), lab, top), {"food": 9})
    assert empty.evidence(["food"]) == {9: 4.0} and not empty.pairs


# 8: leakage ----------------------------------------------------------------


def test_leakage(spark):
    rng = np.random.default_rng(4)
    vocab = [f"{a}{b}" for a in ("tor", "mi", "zan", "pol", "gar", "lus") for b in ("vek", "dra", "nim", "sol", "pek", "hul", "bor", "tal")]
    passage = [" ".join(rng.choice(vocab, 50)) + "." for _ in range(12)]
    items = spark.createDataFrame([(i, None if i == 11 else p, p if i == 11 else "Which one?", ["a", "b"], 1) for i, p in enumerate(passage)] + [(20, passage[0], "Why?", ["a"], 7), (21, None, None, None, None)], "item_id bigint, passage string, question string, completions array<string>, gold int")
    w = passage[1].split()
    texts = [None, "", PROSE, PROSE + passage[0] + PROSE, PROSE + " ".join(w[25:]) + " " + PROSE + " ".join(w[:25]), " ".join(w[:12]), passage[2].upper().replace("O", "O­"), passage[3].replace(" ", "\n"), PROSE + passage[11], " ".join("changed" if k % 9 == 4 else x for k, x in enumerate(passage[4].split())), LONG + passage[5]]
    d = docs(spark, texts, extra=True)
    found = leakage.find(d, *leakage.build(d, items))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(3, 0), (3, 20), (4, 1), (6, 2), (7, 3), (8, 11), (9, 4), (10, 5)}
    assert leakage.find(d, *leakage.build(d, items.limit(0))).count() == 0
    assert leakage.find(d.limit(0), *leakage.build(d.limit(0), items)).count() == 0


def test_leakage_of_changed_words(spark):
    """Passages of which every third or fourth word is another one, in pieces, or with words put in: nine of ten are found, and no other."""
    rng = np.random.default_rng(6)
    vocab = [f"{a}{b}" for a in ("tor", "mi", "zan", "pol", "gar", "lus") for b in ("vek", "dra", "nim", "sol", "pek", "hul", "bor", "tal")]
    passage = [rng.choice(vocab, 50).tolist() for _ in range(20)]
    items = spark.createDataFrame([(i, " ".join(p), "Which one?", ["a", "b"], 1) for i, p in enumerate(passage)], "item_id bigint, passage string, question string, completions array<string>, gold int")
    changes = [lambda p: [f"x{i}" if i % 3 == 2 else w for i, w in enumerate(p)], lambda p: [f"x{i}" if i % 4 == 1 else w for i, w in enumerate(p)], lambda p: p[34:] + ["so"] * 9 + p[17:34] + ["so"] * 9 + p[:17], lambda p: [x for w in p for x in (w, "so")], lambda p: p[20:48]]
    cut = [p[:18] for p in passage]  # below a half
    texts = [PROSE + " ".join(f(p)) + " " + PROSE for f in changes for p in passage] + [PROSE + " ".join(p) for p in cut]
    got = {(r["doc_id"], r["item_id"]) for r in leakage.search(docs(spark, texts), items).collect()}
    want = {(j * 20 + i, i) for j in range(len(changes)) for i in range(20)}
    assert got <= want and len(got) >= 0.9 * len(want)
    assert got == {(r["doc_id"], r["item_id"]) for r in leakage.search(docs(spark, texts), items, block=7).collect()}


def test_leakage_copied_into_a_third_of_the_rows(spark):
    rng = np.random.default_rng(8)
    vocab = [f"{a}{b}" for a in ("tor", "mi", "zan", "pol", "gar", "lus") for b in ("vek", "dra", "nim", "sol", "pek", "hul", "bor", "tal")]
    other = [f"w{i}x" for i in range(500)]
    passage = [" ".join(rng.choice(vocab, 50)) for _ in range(3)]
    items = spark.createDataFrame([(i, p, "Which one?", ["a", "b"], 1) for i, p in enumerate(passage)], "item_id bigint, passage string, question string, completions array<string>, gold int")
    w = passage[0].split()
    texts = [PROSE + passage[0]] * 70 + [PROSE + " ".join(w[:30]) + " " + PROSE, PROSE + passage[1]] + [PROSE + " ".join(rng.choice(other, 60)) for _ in range(138)]
    d = docs(spark, texts)
    assert {(r["doc_id"], r["item_id"]) for r in leakage.find(d, *leakage.build(d, items)).collect()} == {(i, 0) for i in range(71)} | {(71, 1)}


def test_decomposition(spark):
    rng = np.random.default_rng(1)
    passages = [[f"w{i}" for i in rng.integers(0, 80, 30)] for _ in range(20)]
    index = leakage.Index(passages, {f"w{i}": 1.0 + i / 80 for i in range(80)})
    leakage.decompose(spark, index)
    a = np.zeros((20, len(index.code)))
    for k, p in enumerate(passages):
        ids, v = index.vector(p)
        a[k, ids] = v
    assert np.linalg.norm(a - a @ index.basis @ index.basis.T) < 1e-3  # rank 20 is found whole


# 9: abusive language -------------------------------------------------------


def test_abuse(spark):
    bad = ["You are a filthy bastard and nobody likes you.", "Shut up, you worthless idiot.", "I will hurt you badly, you scum."]
    names = ["Anna", "Bert", "Carl", "Dora", "Emil", "Fritz"]
    text = lambda i: " ".join(f"{names[(i + k) % 6]} went to the shop number {i * 7 + k} and bought some bread." for k in range(6))
    texts = [text(i) + (" " + bad[i % 3] + " " if i % 4 == 0 else " ") + text(i + 1) for i in range(120)] + [None, "", "You are a f i l t h y  b a s t a r d and nobody likes you."]
    d = docs(spark, texts, extra=True)
    lab = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)] + [(2, None)], "doc_id bigint, toxic int")
    r = {x["doc_id"]: x for x in abuse.score(d, abuse.fit(d, lab)).collect()}
    wrong = [i for i in range(80, 120) if r[i]["abusive"] != (i % 4 == 0)]
    assert len(wrong) <= 1 and r[120]["score"] is None and not r[121]["abusive"]
    assert abuse.fit(d, lab.where("toxic = 0")) is None and abuse.score(d, None).where("abusive").count() == 0


def test_normalisation():
    assert abuse.normalise("Sеx ​F.I.L.T.H immmmbecile") == "sex filth imbecile"
    assert abuse.normalise("Привет, друзья") == "привет, друзья"


def test_features_stay_inside_parts():
    a, _ = abuse.features(["abcdef", "ghijkl"])
    b = np.concatenate([abuse.features(["abcdef"])[0], abuse.features(["ghijkl"])[0]])
    assert sorted(a) == sorted(b)


def _plain_score(model, parts):
    b, o = abuse.features(parts)
    return np.bincount(o, weights=model.weight[b], minlength=len(parts)) / abuse._size(np.bincount(o, minlength=len(parts))) + model.bias


def test_abuse_scores_by_place():
    model = abuse.Classifier(np.random.default_rng(0).normal(size=abuse.BUCKETS), -1.0)
    for parts in (["a"], ["ab", "a", "", "abc"], ["é", "naïve café", "x" * 300], ["a\x00b", "abcdef", "a b\x00c d"], [PROSE[i : i + i % 70 + 1] for i in range(140)]):
        assert np.allclose(model.score(parts), _plain_score(model, parts), rtol=0, atol=1e-12)
    # less work than the n-grams of all sentences one by one with their owners
    many = [f"{i} {PROSE}" for i in range(3000)]

    def seconds(f):
        took = []
        for _ in range(5):
            began = time.thread_time()
            f()
            took.append(time.thread_time() - began)
        return min(took)

    assert seconds(lambda: model.score(many)) < 0.75 * seconds(lambda: [_plain_score(model, many[i : i + 300]) for i in range(0, 3000, 300)])


def test_abuse_sentences_of_many_texts():
    """Texts at once give what each gives by itself, by the patterns tried on every place."""
    cut = re.compile(r"(?<=[.!?…])[\"'”’»)]*\s+|\n\s*\n|\n(?=\s*(?:[-–—*•>|\d]|user_))")

    def plain(text):
        t = text.lower()
        if not t.isascii():
            fold = abuse._INVISIBLE if abuse._CYRILLIC.search(t) and not re.search("[a-z]", t) else abuse._FOLD
            t = "".join(fold.get(ord(c), c) or "" for c in t)
        t = abuse._SPACED.sub(lambda m: re.sub(r"[ .\-_*]", "", m[0]) if "*" not in m[0] else m[0], t)
        t = abuse._LEET.sub(lambda m: abuse._LEETS[m[0]], abuse._DRAWN.sub(r"\1", t))
        return [" ".join(x.split()) for x in cut.split(t) if x and not x.isspace()]

    rng, signs = random.Random(3), "abcdefiiilllsss..  --__**!!!@@$013457\n\n\n\t é…”\"')аеоßü​\x00\x85>•ABC?|"
    texts = ["", " ", "a", "\n\n\n", "? . \"' )\n- x", "No.\" He\n\n1 went", "f i l t h y", "a.b.b.b.c", "é b é b é", "\ud800 a b c d e", "h4te y0u", "user_1\nuser_2: hi\n user_3", "Привет, друзья", "sоооo"]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randrange(0, 120))) for _ in range(5000)]
    assert abuse.sentences(texts) == [plain(t) for t in texts] and abuse.sentences([]) == []


# queries on the smallest tables -------------------------------------------


@pytest.mark.parametrize("name", ["p1_recorded", "p3_found", "p3_cutoffs", "p6_found", "p6_shares", "p6_copies"])
def test_against_sql(spark, data, name):
    import duckdb

    con = duckdb.connect()
    for t in ("master", "tokens", "domains_topics", "domains_formats", "keep_targets", "mixtures"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, data), con.sql(queries.SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    got, wanted = sorted(tuple(r[c] for c in cols) for r in df.collect()), sorted(tuple(r[want.columns.index(c)] for c in cols) for r in want.fetchall())
    assert len(got) == len(wanted) and all(a == b or isinstance(a, float) and a == pytest.approx(b, rel=1e-9, abs=1e-6) for x, y in zip(got, wanted) for a, b in zip(x, y))


def table(data, name):
    import pandas as pd

    return pd.read_parquet(f"{data}/{name}.parquet")


def test_totals_cover_all_keys_and_documents(spark, data):
    got = queries.p1_totals(spark, data).toPandas()
    tokens, documents = table(data, "tokens"), table(data, "documents")
    keys = set(map(tuple, tokens[["shard_idx", "doc_idx"]].dropna().astype(int).to_numpy()))
    here = list(map(tuple, documents[["shard_idx", "doc_idx"]].to_numpy()))
    n = len(documents) + len(keys - set(here))
    sums = got.groupby("dimension")[["documents", "tokens", "estimated_documents", "uncounted_documents"]].sum()
    assert set(sums.index) == {"source", "lang", "topic", "format", "source, lang, topic, format"}
    assert (sums["documents"] == n).all() and sums["tokens"].nunique() == 1
    # keys without a text count as recorded, if from 1 to a million
    newest = tokens.sort_values("annotated_at").drop_duplicates(["shard_idx", "doc_idx"], keep="last")
    bare = newest[[k not in set(here) for k in map(tuple, newest[["shard_idx", "doc_idx"]].to_numpy())]]["token_count"]
    texts = sum(r["n_used"] or 0 for r in encoding.usable_counts(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/tokens.parquet")).collect())
    assert sums["tokens"].iloc[0] == bare[(bare >= 1) & (bare <= encoding.MOST)].sum() + texts


def test_found_rows_are_documents(spark, data):
    """Of every pN query over documents: ids of documents, once each where a row is a document."""
    documents = table(data, "documents").set_index("doc_id")
    blank = documents["text"].fillna("").str.strip() == ""
    p2 = queries.p2_found(spark, data).toPandas()
    assert len(p2) > 0.7 * (~blank).sum() and not p2.duplicated().any() and p2["topic"].between(0, 23).all() and not blank[p2["doc_id"]].any()
    makeup = queries.p2_makeup(spark, data).toPandas()
    assert makeup["documents"].sum() == len(p2) and makeup["main"].sum() == p2["doc_id"].nunique() and makeup["share"].sum() == pytest.approx(1)
    p4 = queries.p4_found(spark, data).toPandas()
    shares_ = queries.p4_shares(spark, data).toPandas()
    assert set(p4["kind"]) <= {"list", "table", "junk"} and len(shares_) == len(documents) and p4["doc_id"].is_unique and (shares_["kind"].isna() == blank.loc[shares_["doc_id"]].to_numpy()).all()
    assert np.allclose(shares_[["prose", "list", "table", "junk"]].dropna().sum(axis=1), 1)
    p5 = queries.p5_found(spark, data).toPandas()
    assert p5["doc_id"].is_unique and p5["reading_level"].between(1, 4).all() and (documents.loc[p5["doc_id"], "text"].str.split().str.len() >= 60).all()
    assert queries.p5_profile(spark, data).toPandas().set_index("reading_level")["documents"].to_dict() == p5["reading_level"].value_counts().to_dict()


def test_leaks_share_words_with_their_items(spark, data):
    documents, items = table(data, "documents").set_index("doc_id")["text"], table(data, "eval_items").set_index("item_id")
    got = queries.p8_matches(spark, data).toPandas()
    assert not got.duplicated(["doc_id", "item_id"]).any() and (got["share"] >= 0.5).all()
    for r in got.itertuples():
        passage = items.loc[r.item_id, "passage"] or items.loc[r.item_id, "question"]
        words, have = leakage.tokens(passage), set(leakage.tokens(documents[r.doc_id]))
        assert sum(w in have for w in words) > 0.4 * len(words)


def test_rates_count_every_document(spark, data):
    r = queries.p9_rates(spark, data).toPandas()
    assert r["documents"].sum() == len(table(data, "documents")) and (r["abusive"] <= r["documents"]).all()
