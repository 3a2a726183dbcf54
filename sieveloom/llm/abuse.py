"""Abusive, hateful or sexual language by a character n-gram linear classifier.

Texts are normalised against disguise (invisible and look-alike characters,
spaced-out or drawn-out words) and cut into sentences.  A sentence is the
counts of its character n-grams, hashed; each feature is scaled by its naive
Bayes log-count ratio between abusive and other sentences, and a logistic
regression is fitted on the scaled features.  Only documents are labelled, so
the sentences of abusive documents that bear the label are found in turn with
the classifier.  A document's score is that of its worst sentence.

Counts, scores and gradients are summed over the cluster: the different
sentences of the judged documents are a table of a few parts, of which a pass
returns one array of numbers each.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, chunks, least_hash, shared_dir, unclash

#: Judged documents at most (abusive ones first, then least hash; of them at most half abusive), hash buckets, n-gram lengths in bytes, turns between sentences and classifier.
LABELLED, BUCKETS, ORDERS, TURNS = 3_000, 1 << 20, (3, 4, 5), 3
#: Share of the other documents that may hold abuse by mistake, and log ratio that n-grams reach by chance.
STRAY, CHANCE = 0.02, 1.0
#: Passes of the regression, its step, its pull towards the plain ratios, smoothing of the ratios, weight of abusive against other sentences, and parts of the table of sentences.
EPOCHS, STEP, PULL, SMOOTH, BALANCE, PARTS = 30, 0.03, 1e-4, 4.0, 0.5, 4

# Characters that look like Latin letters, and digits or signs that stand for letters inside words.
_ALIKE = dict(zip("аеорсухіјѕԁһӏοαερικνυ", "aeopcyxijsdhloaepiknu"))
_INVISIBLE = dict.fromkeys([0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x2028, 0x202F), *range(0x2060, 0x2065), 0xFEFF, *range(0xFE00, 0xFE10)])
_FOLD = {**_INVISIBLE, **{ord(a): b for a, b in _ALIKE.items()}, **{ord(a): b for a, b in zip("áàâäãåéèêëíìîïóòôöõúùûüçñ", "aaaaaaeeeeiiiiooooouuuucn")}, 0xDF: "ss", 0x2019: "'", 0x2018: "'", 0x201C: '"', 0x201D: '"', 0xA0: " "}
_UNUSUAL = re.compile("[^\x00-\x7f]")
_CYRILLIC = re.compile("[а-яёα-ω]{3}")
_SPACED = re.compile(r"\b(?:\w[ .\-_*]){3,}\w\b")
_APART = re.compile(r"[ .\-_*]\w[ .\-_*]\w[ .\-_*]")
_SIGN = re.compile(r"[013457@$!][a-z]")
_DRAWN = re.compile(r"([a-z])\1{2,}")
_LEET = re.compile(r"(?<=[a-z])[013457@$!](?=[a-z])|\b[013457@$](?=[a-z]{2})")
_LEETS = dict(zip("013457@$!", "oleastasi"))
# after an end of sentence quotes and spaces; an empty line; a line that is an entry. It starts with one set of characters, which the search skips to; this first one belongs to the sentence before
_CUT = re.compile(r"([.!?…\n])(?:(?<=[.!?…])[\"'”’»)]*\s+|(?<=\n)\s*\n|(?<=\n)(?=\s*(?:[-–—*•>|\d]|user_)))")
# Classes of bytes: letters, signs that stand for letters, what stands between spaced-out letters, ASCII word characters.
_LETTER, _STANDS, _BETWEEN, _WORD = 1, 2, 4, 8
_CLASS = np.array([_LETTER * (97 <= i <= 122) | _STANDS * (chr(i) in "013457@$!") | _BETWEEN * (chr(i) in " .-_*") | _WORD * (i < 128 and (chr(i).isalnum() or chr(i) == "_")) for i in range(256)], np.uint8)


def _fold(text: str) -> str:
    """Lower case without accents, invisible characters and look-alikes."""
    t = text.lower()
    if not t.isascii():
        # whole words in another script stay; single letters of it inside Latin words are look-alikes
        fold = _INVISIBLE if _CYRILLIC.search(t) and not re.search("[a-z]", t) else _FOLD
        for c in set(_UNUSUAL.findall(t)):
            if (x := fold.get(ord(c), c)) != c:
                t = t.replace(c, x or "")
    return t


def normalise(text: str) -> str:
    """Lower case without accents, invisible characters, look-alikes and the spacing of letters."""
    return _normalised([text])[0]


def _normalised(texts: list[str]) -> list[str]:
    """``normalise`` of each text; what the patterns need is looked for in the bytes of some texts at once."""
    out = [_fold(t) for t in texts]
    for lo, hi in chunks(out, 4 * AT_ONCE):
        raw = [t.encode("utf-8", "replace") for t in out[lo:hi]]
        start = np.cumsum([0, *(len(x) + 1 for x in raw)])
        b = np.frombuffer(b"\n".join([*raw, *[b""] * 6]), np.uint8)
        kind = _CLASS[b]
        letter, stands, between, word = (kind & k != 0 for k in (_LETTER, _STANDS, _BETWEEN, _WORD))
        at = lambda hit: {*(np.searchsorted(start, np.flatnonzero(hit), "right") - 1 + lo).tolist()}  # noqa: B023, E731
        apart = at(between[:-4] & word[1:-3] & between[2:-2] & word[3:-1] & between[4:]) | {i for i in range(lo, hi) if not out[i].isascii() and _APART.search(out[i])}
        drawn, signs = at((b[:-2] == b[1:-1]) & (b[1:-1] == b[2:]) & letter[2:]), at(stands[:-1] & letter[1:])
        for i in apart | drawn | signs:
            t, joined = out[i], i in apart and _SPACED.search(out[i])
            if joined:
                t = _SPACED.sub(lambda m: re.sub(r"[ .\-_*]", "", m[0]) if "*" not in m[0] else m[0], t)
            if joined or i in drawn:
                t = _DRAWN.sub(r"\1", t)
            out[i] = _LEET.sub(lambda m: _LEETS[m[0]], t) if joined or i in signs else t
    return out


def sentences(texts: list[str]) -> list[list[str]]:
    """Of each text."""
    cut = [_CUT.split(t) for t in _normalised(texts)]
    return [[" ".join(w) for s, end in zip(x[::2], [*x[1::2], ""]) if (w := (s + end).split())] for x in cut]


_FACTOR, _MIX = np.uint64(0x100000001B3), np.uint64(0xBF58476D1CE4E5B9)


def _bytes(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The parts as one row of bytes, each between spaces and after a mark, and their lengths in it."""
    raw = [p.encode("utf-8", "replace") for p in parts]
    return np.frombuffer(b"\x00 " + b" \x00 ".join(raw) + b" ", np.uint8), np.array([len(x) + 3 for x in raw])


def _buckets(raw: np.ndarray, n: int) -> np.ndarray:
    """Hash bucket of the n-gram that starts at each place; ``raw`` has the bytes as 64 bits."""
    m = len(raw) - n + 1
    h = raw[:m] ^ np.uint64(n * int(_FACTOR))
    for i in range(1, n):
        h *= _FACTOR
        h ^= raw[i : m + i]
    h ^= h >> np.uint64(29)
    h *= _MIX
    h >>= np.uint64(40)
    h &= np.uint64(BUCKETS - 1)
    return h.view(np.int64)


def features(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all n-grams of all parts, and the part each belongs to; n-grams don't cross parts."""
    raw, size = _bytes(parts) if parts else (np.zeros(0, np.uint8), np.zeros(0, np.int64))
    wide, which = raw.astype(np.uint64), np.repeat(np.arange(len(parts)), size)
    end = (raw == 0).astype(np.int32).cumsum()
    buckets, owner = [], []
    for n in ORDERS:
        if len(raw) < n:
            continue
        h = _buckets(wide, n)
        # inside one part: the mark stands at the start of a part only
        good = (raw[: len(h)] != 0) & (end[: len(h)] == end[n - 1 :])
        buckets.append(h[good].astype(np.int32))
        owner.append(which[: len(h)][good])
    if not buckets:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(owner)


#: Characters of sentences whose n-grams are looked up at once.
AT_ONCE = 50_000


class Classifier:
    """Weight per bucket (ratio times coefficient) and intercept; a sentence's sum is divided by its size."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight.astype(np.float32), bias

    def score(self, parts: list[str]) -> np.ndarray:
        """Of each sentence; some at once, so that the arrays of their n-grams stay in the cache of a processor."""
        out, first, size = [], 0, 0
        for i, p in enumerate(parts, 1):
            size += len(p)
            if size > AT_ONCE or i == len(parts):
                out.append(self._score(parts[first:i]))
                first, size = i, 0
        return np.concatenate(out) if out else np.zeros(0)

    def _score(self, parts: list[str]) -> np.ndarray:
        raw, size = _bytes(parts)
        if np.count_nonzero(raw == 0) > len(parts):  # a mark inside a part
            b, o = features(parts)
            return np.bincount(o, weights=self.weight[b], minlength=len(parts)) / _size(np.bincount(o, minlength=len(parts))) + self.bias
        wide, end = raw.astype(np.uint64), size.cumsum()
        # sums over the places of each part; n-grams that start at a mark or reach the next part weigh nothing
        total, n_grams = np.zeros(len(raw)), np.zeros(len(parts))
        for n in ORDERS:
            w = self.weight[_buckets(wide, n)]
            for out in (end - size, *(end - k for k in range(1, n))):
                w[out[(out >= 0) & (out < len(w))]] = 0
            total[: len(w)] += w
            n_grams += np.maximum(size - n, 0)
        return np.add.reduceat(total, end - size) / _size(n_grams) + self.bias


def _size(n_grams: np.ndarray) -> np.ndarray:
    """What sums are divided by, so that a score tells the density of abuse; very short sentences count as longer."""
    return (n_grams + 30) / 10


def _sums(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``n`` values."""
    total = np.zeros(len(n))
    if (some := n > 0).any():
        total[some] = np.add.reduceat(x, (n.cumsum() - n)[some], dtype=float)
    return total


class _Sentences:
    """The different sentences of judged documents, spread over the cluster, and what is summed over them.

    A row holds the sentences of a batch as arrays: their occurrences in
    abusive and in other documents, these documents, and the buckets of their
    n-grams with the counts.  Which sentences bear the label is kept here, a
    bit for each, by row.
    """

    def __init__(self, judged: DataFrame):
        def cut(data):
            rows = [(i, bad, s) for i, bad, own in zip(data["doc_id"], data["bad"], sentences(data["text"])) for s in own]
            return {"doc_id": [r[0] for r in rows], "bad": [r[1] for r in rows], "s": [r[2] for r in rows]}

        def pack(batches):
            for k, f in enumerate(batches):
                part = TaskContext.get().partitionId() * 1_000_000 + k
                b, c, n = [], [], []
                for lo, hi in chunks(text := f.column(0).to_pylist(), 4 * AT_ONCE):
                    bucket, owner = features(text[lo:hi])
                    key, count = np.unique(owner * BUCKETS + bucket, return_counts=True)
                    owner, bucket = np.divmod(key, BUCKETS)
                    b.append(bucket.astype(np.int32))
                    c.append(count.astype(np.float32))
                    n.append(np.bincount(owner, minlength=hi - lo))
                held = [np.concatenate(b), np.concatenate(c), np.concatenate(n).astype(np.int32), f.column(1).to_numpy(), f.column(2).to_numpy()]
                for docs in (f.column(3).to_pylist(), f.column(4).to_pylist()):
                    held += [np.array([d for own in docs for d in own], np.int64), np.array([len(own) for own in docs], np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), *(pa.array([x.tobytes()], pa.large_binary()).cast(pa.binary()) for x in held)], names=["part", *self.arrays])

        pairs = arrow_map(judged, ["doc_id", "bad", "text"], cut, "doc_id bigint, bad boolean, s string")
        of = lambda c: F.collect_set(F.when(c, F.col("doc_id")))
        by = pairs.groupBy("s").agg(F.count(F.when(F.col("bad"), 1)).alias("in_pos"), F.count(F.when(~F.col("bad"), 1)).alias("in_neg"), of(F.col("bad")).alias("pos"), of(~F.col("bad")).alias("neg"))
        self.rows = by.repartition(PARTS, "s").select("s", "in_pos", "in_neg", "pos", "neg").mapInArrow(pack, "part bigint, " + ", ".join(f"{a} binary" for a in self.arrays)).checkpoint()
        self.context = judged.sparkSession.sparkContext
        # the buckets that are met, numbered: what is sent and returned is of their number
        self.number = None
        self.used = np.unique(np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(x, np.int32) for _, x in self._over(lambda b, **_: np.unique(b).tobytes(), []))]))
        number = np.zeros(BUCKETS, np.int32)
        number[self.used] = np.arange(len(self.used))
        self.number = self.context.broadcast(number)
        occurs = lambda in_pos, in_neg, **_: (np.frombuffer(in_pos, np.int64) > np.frombuffer(in_neg, np.int64)).tobytes()
        self.candidate = {k: np.frombuffer(x, bool) for k, x in self._over(occurs, ["in_pos", "in_neg"])}
        self.bears = self.candidate

    arrays = ("buckets", "counts", "sizes", "in_pos", "in_neg", "pos", "n_pos", "neg", "n_neg")

    def _over(self, each, columns: list[str]) -> list[tuple[int, bytes]]:
        """``each`` of every row: of its part, buckets ``b``, counts ``c``, their sentence ``o``, each sentence's divisor ``root``, and the columns as bytes."""
        number = self.number

        def run(batches):
            for f in batches:
                for r in f.to_pylist():
                    b, c, n = (np.frombuffer(r[k], t) for k, t in (("buckets", np.int32), ("counts", np.float32), ("sizes", np.int32)))
                    b = number.value[b] if number is not None else b
                    o = np.repeat(np.arange(len(n)), n)
                    x = each(part=r["part"], b=b, c=c, o=o, root=_size(np.bincount(o, weights=c, minlength=len(n))), **{k: r[k] for k in columns})
                    yield pa.RecordBatch.from_arrays([pa.array([r["part"]], pa.int64()), pa.array([x], pa.binary())], names=["part", "x"])

        return [(r["part"], r["x"]) for r in self.rows.select("part", "buckets", "counts", "sizes", *columns).mapInArrow(run, "part bigint, x binary").collect()]

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each bucket in sentences that bear the label and in others."""
        bears, size = self.bears, len(self.used)

        def each(part, b, c, o, root, in_pos, in_neg):
            pos, neg = np.frombuffer(in_pos, np.int64) * bears[part], np.frombuffer(in_neg, np.int64) + np.frombuffer(in_pos, np.int64) * ~bears[part]
            return np.concatenate([np.bincount(b, weights=c * pos[o], minlength=size), np.bincount(b, weights=c * neg[o], minlength=size)]).astype(np.float32).tobytes()

        total = sum((np.frombuffer(x, np.float32).astype(float) for _, x in self._over(each, ["in_pos", "in_neg"])), np.zeros(2 * size))
        return total[:size], total[size:]

    def score(self, ratio: np.ndarray, own: np.ndarray) -> tuple[dict[int, np.ndarray], np.ndarray]:
        """Scores of the sentences by row, and of the other documents that of the worst sentence which can't bear the label."""
        bears, candidate, sent = self.bears, self.candidate, self.context.broadcast((ratio.astype(np.float32), own.astype(np.float32)))

        def each(part, b, c, o, root, neg, n_neg):
            ratio, own = sent.value
            z = np.bincount(o, weights=np.where(bears[part][o], own[b], ratio[b]) * c, minlength=len(root)) / root
            docs, n = np.frombuffer(neg, np.int64), np.frombuffer(n_neg, np.int32)
            other = np.repeat(~candidate[part], n)
            return np.concatenate([z, *_greatest(docs[other], np.repeat(z, n)[other])]).tobytes()

        scores, best = {}, []
        for part, x in self._over(each, ["neg", "n_neg"]):
            x, n = np.frombuffer(x), len(self.candidate[part])
            scores[part] = x[:n]
            best.append(x[n:].reshape(2, -1))
        sent.destroy()
        return scores, _greatest(*np.concatenate([np.zeros((2, 0)), *best], axis=1))[1]

    def documents(self, model: Classifier) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the judged documents, and which are abusive."""
        weight, bias = model.weight[self.used], model.bias

        def each(part, b, c, o, root, pos, n_pos, neg, n_neg):
            z = np.bincount(o, weights=weight[b] * c, minlength=len(root)) / root + bias
            of = lambda docs, n: np.stack(_greatest(np.frombuffer(docs, np.int64), np.repeat(z, np.frombuffer(n, np.int32))))
            bad, good = of(pos, n_pos), of(neg, n_neg)
            return np.concatenate([[bad.shape[1]], bad.ravel(), good.ravel()]).tobytes()

        bad, good = [np.zeros((2, 0))], [np.zeros((2, 0))]
        for _, x in self._over(each, ["pos", "n_pos", "neg", "n_neg"]):
            x = np.frombuffer(x)
            n = int(x[0])
            bad.append(x[1 : 1 + 2 * n].reshape(2, -1))
            good.append(x[1 + 2 * n :].reshape(2, -1))
        bad, good = (_greatest(*np.concatenate(x, axis=1))[1] for x in (bad, good))
        return np.concatenate([bad, good]), np.repeat([True, False], [len(bad), len(good)])

    def regress(self, ratio: np.ndarray) -> Classifier:
        """Logistic regression on the scaled counts by gradient steps of adapted size; coefficients start at and are pulled to a common value."""
        start, size, bears, number = 0.1, len(ratio), self.bears, self.number
        n_bears, n_other = (sum(int(x.sum()) for x in m.values()) for m in (bears, {k: ~x for k, x in bears.items()}))

        def prepare(batches):
            for f in batches:
                for r in f.to_pylist():
                    b, c, n = (np.frombuffer(r[k], t) for k, t in (("buckets", np.int32), ("counts", np.float32), ("sizes", np.int32)))
                    # a bucket as often as it is met: less to read in each pass than counts of numbers
                    every = np.repeat(number.value[b], c.astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (every, _sums(c, n).astype(np.int32), bears[r["part"]])], names=["b", "n", "y"])

        scaled = self.rows.select("part", "buckets", "counts", "sizes").mapInArrow(prepare, "b binary, n binary, y binary").checkpoint()
        v, bias = np.full(size, start), -1.0
        m, s = np.zeros(size + 1), np.zeros(size + 1)
        for k in range(1, EPOCHS + 1):
            now = self.context.broadcast(((ratio * v).astype(np.float32), bias))

            def gradient(batches, now=now):
                weight, bias = now.value
                grad = np.zeros(size + 1)
                for f in batches:
                    for r in f.to_pylist():
                        b, n, y = (np.frombuffer(r[k], t) for k, t in (("b", np.int32), ("n", np.int32), ("y", bool)))
                        z = _sums(weight[b], n) / _size(n) + bias
                        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * np.where(y, BALANCE / max(n_bears, 1), (1 - BALANCE) / max(n_other, 1))
                        grad[:-1] += np.bincount(b, weights=np.repeat(g / _size(n), n), minlength=size)
                        grad[-1] += g.sum()
                yield pa.RecordBatch.from_arrays([pa.array([grad.astype(np.float32).tobytes()], pa.binary())], names=["x"])

            grad = sum(np.frombuffer(r["x"], np.float32).astype(float) for r in scaled.mapInArrow(gradient, "x binary").collect())
            now.destroy()
            grad[:-1] = ratio * grad[:-1] + PULL * (v - start)
            m = 0.9 * m + 0.1 * grad
            s = 0.99 * s + 0.01 * grad**2
            step = STEP * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-5)
            v = v - step[:-1]
            bias = bias - 3 * step[-1]
        weight = np.zeros(BUCKETS)
        weight[self.used] = ratio * v
        return Classifier(weight, bias)


def _greatest(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys and the greatest value of each."""
    if not len(keys):
        return np.zeros(0), np.zeros(0)
    order = np.lexsort((values, keys))
    keys, values = keys[order], values[order]
    last = np.append(keys[1:] != keys[:-1], True)
    return keys[last].astype(float), values[last]


def _ratios(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Naive Bayes log-count ratio of each bucket from its occurrences, and the same without one abusive occurrence.

    SMOOTH counts are spread over both classes by size, so the ratio is 0 where
    neither class has the n-gram.
    """
    share = max(p.sum(), 1.0) / max(p.sum() + q.sum(), 1.0)
    against = np.log((q + SMOOTH * (1 - share)) / (1 - share))
    return tuple(np.log((np.maximum(c, 0) + SMOOTH * share) / share) - against for c in (p, p - 1))


def train(judged: DataFrame) -> Classifier:
    """From ``judged(doc_id, bad, text)``; judgements may err either way. Deterministic but for the order of sums.

    A sentence of an abusive document bears the label if its n-grams, its own
    occurrence not counted, tell more against it than the worst sentence of
    all but ``STRAY`` of the other documents does.  The bias is set where the
    fewest judged documents are on the wrong side, in the middle of equal places.
    """
    table = _Sentences(judged)
    p, q = table.counts()
    for _ in range(TURNS):
        # what ordinary sentences of a language or subject gather by chance doesn't count
        scores, worst = table.score(*(np.where(r > 0, np.maximum(r - CHANCE, 0), r) for r in _ratios(p, q)))
        level = max(float(np.quantile(worst, 1 - STRAY)) if len(worst) else 0.0, 0.5)
        found = {k: table.candidate[k] & (z > level) for k, z in scores.items()}
        if not any(x.any() for x in found.values()):
            break
        table.bears = found
        p, q = table.counts()
    model = table.regress(_ratios(p, q)[0])
    score_, bad = table.documents(model)
    table.number.destroy()
    order = np.argsort(score_, kind="stable")
    x, y = score_[order], bad[order]
    wrong = np.concatenate([[0], np.cumsum(y)]) + (~y).sum() - np.concatenate([[0], np.cumsum(~y)])
    best = np.flatnonzero(wrong[1:-1] == wrong[1:-1].min()) + 1 if len(x) > 1 else np.zeros(0, int)
    if len(best):
        i = best[len(best) // 2]
        model.bias -= float(x[i - 1] + x[i]) / 2
    return model


def fit(documents: DataFrame, labels: DataFrame, sample: int = LABELLED) -> Classifier | None:
    """The classifier from judged documents (abusive if most judgements say so, ties too); None without abusive ones."""
    shared_dir(documents.sparkSession)
    judged = labels.where("toxic IN (0, 1)").groupBy("doc_id").agg((F.avg("toxic") >= 0.5).alias("bad")).checkpoint()
    bad = least_hash(judged.where("bad"), "doc_id", sample // 2)
    n = bad.count()
    if not n:
        return None
    judged = bad.unionByName(least_hash(judged.where("NOT bad"), "doc_id", sample - n))
    return train(unclash(documents, ["doc_id", "text"]).where("text IS NOT NULL").join(F.broadcast(judged), "doc_id"))


def score(documents: DataFrame, model: Classifier | None, columns: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """``columns`` with ``score`` (log odds of the worst sentence; null for null and blank texts) and ``abusive``. One pass, no shuffle.

    Without a model (no abusive document was ever judged) every score is null.
    """
    kinds = dict(documents.dtypes)

    def run(data):
        out = {c: data[c] for c in columns}
        parts = sentences([t if t and model else "" for t in data["text"]])
        flat = [s for p in parts for s in p]
        z = model.score(flat) if flat else np.zeros(0)
        first = np.cumsum([0, *map(len, parts)])
        out["score"] = [float(z[a:b].max()) if b > a else None for a, b in zip(first, first[1:])]
        out["abusive"] = [bool(v is not None and v > 0) for v in out["score"]]
        return out

    return arrow_map(documents, [*columns, "text"], run, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", score double, abusive boolean")
