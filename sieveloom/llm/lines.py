"""Kinds of text by a hidden Markov model over the lines of a document.

A text is cut into segments: lines, and within long lines sentences, entries
or table rows.  Every segment is described by a few discrete statistics; the
hidden state of a segment is prose, list, table or junk.  One pass over the
texts writes the statistics of all segments, a number each.  Emission tables
start from stated beliefs and are re-estimated with the transitions by
expectation maximisation over the segments of all documents, whose expected
counts are summed over the cluster; posterior state shares, weighted by
characters, give the kind of a document.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS
from .common import arrow_map, shared_dir, unclash

STATES = ("prose", "list", "table", "junk")
#: Rounds of estimation at most, and the change of every probability at which it has settled.
ROUNDS, SETTLED = 6, 0.002

# Frequent function words, used to see whether words form language and which.
FUNCTION_WORDS = {
    "en": "the a an and or but of to in on at by for with from as is are was were be been it its this that these those he she they we you i my your his her their our not no so if when where who what which than then there has have had can will would do does did more most some any all only also very about into after before because while although".split(),
    "de": "der die das den dem des ein eine einen einem einer und oder aber nicht ist sind war waren wird wurde hat haben zu in im am an auf mit von für bei nach aus als wie auch nur noch so dass es er sie wir ich ihr man sich viele mehr sehr schon immer wer was wenn denn zum zur über einfach".split(),
    "fr": "le la les l un une des du de d et ou mais ne pas que qu qui est sont était être a ont en au aux dans sur pour par avec ce cette ces il elle ils nous vous on se s plus très aussi sans car si comme tout tous selon quand".split(),
    "es": "el la los las un una unos unas de del y o pero no que es son era fue ser ha han en a al con por para se su sus lo le más muy también sin como si este esta todo todos cuando porque según hay ya".split(),
}
# Fixed value: labels of page navigation.
NAVIGATION = set("home menu contact kontakt sitemap faq imprint impressum prev previous next top share login log in out close cart search help about privacy cookies subscribe print back x accueil inicio startseite suche weiter zurück".split())

_WORDS = frozenset(w for ws in FUNCTION_WORDS.values() for w in ws)
_LANG = {lang: frozenset(ws) for lang, ws in FUNCTION_WORDS.items()}
_TAGS = re.compile(r"</?(?:t[drh]|table|tbody|thead|li|ul|ol|p|div|br|span|b|i|a)\b[^>]*>")
_ROW = re.compile(r"</tr>|</li>|<br */?>|</p>")
_SENTENCE = re.compile(r"(?<=[.!?…;|])[\"'”’»)]*\s+|(?<=[。！？])")
_UNPLAIN = re.compile(r"[^A-Za-zÀ-ÿ0-9 .,'’!?\":;()\-]")
_DIGIT = re.compile(r"\d")
_CSV = re.compile(r",(?=\S)|,$")
_UNWRAPPED = re.compile(r",\S|\||\t| {3}|[{}<>=]")
_HEX = re.compile(r"(?:[0-9a-f]{2,8}\s+){6,}")
_ODD = re.compile(r"[^\w\s.,'’\"“”„«»;:!?()\-–—¿¡…&%€$°/]|[_ÃÂâ�]")
_MOJIBAKE = re.compile("Ã.|Â |â€|ï»¿|�")
_BULLET = re.compile(r"\s*(?:[-*•–·+>]|\[[ xX]?\]|\d{1,3}[.)]|[a-z][.)])\s")
_NUMBER = re.compile(r"[-+(]?[\d][\d.,:/%€$-]*\)?[a-z%°€$]{0,3}$")
_PAIR = re.compile(r"[^\s:][^:\n]{0,38}[:=]\s*(\S+)(?:\s\S+){0,2}\s*$")
_SPEAKER = re.compile(r"\s*(?:@?[A-Za-z]\w*_?\d+)(?:\s+wrote)?\s*[:>]\s+|\s*>+\s")
_CLUSTER = re.compile(r"[bcdfghjklmnpqrstvwxz]{5,}|\b[bcdfghjklmnpqrstvwxz]{3,}\b", re.I)
_GAP = re.compile(r" {2,}|\t")
_LATIN = re.compile(r"[A-Za-z]")
_SPACED = re.compile(r"[Ͱ-῿]")
_LETTER = re.compile(r"[^\W\d_]")


def segments(text: str) -> list[str]:
    """Lines of a text, long ones cut after sentences and entries, table and list markup cut by rows."""
    if "<" in text and _TAGS.search(text):
        text = _TAGS.sub(lambda m: "\n" if _ROW.fullmatch(m.group()) else "\t" if m.group() in ("</td>", "</th>") else "", text)
    out: list[str] = []
    held = ""
    for line in text.splitlines():
        line = line.strip()
        if not line:
            if held:
                _cut(held, out)
                held = ""
            continue
        if held:
            # hard-wrapped prose: a line of ordinary length that doesn't end a sentence goes on in the next
            if len(held) >= 35 and line[0].isalnum() and (held[-1].isalnum() or held[-1] in ",-’'") and not _UNWRAPPED.search(line) and not _BULLET.match(line) and (_function_words(held[-90:]) or ". " in held or line[-1] == "."):
                held += " " + line
                continue
            _cut(held, out)
        held = line
    if held:
        _cut(held, out)
    return out


def _cut(line: str, out: list[str]) -> None:
    if len(line) > 60:
        out.extend(s for s in _SENTENCE.split(line) if s and not s.isspace())
    else:
        out.append(line)


def _function_words(s: str) -> int:
    return sum(w in _WORDS for w in s.lower().replace("'", " ").replace("’", " ").split())


#: Number of values of each statistic of a segment.
SIZES = (5, 4, 3, 4, 4, 2, 4, 3, 2, 3)


#: What a value of each statistic adds to the number that stands for all of them.
STRIDES = tuple(int(np.prod(SIZES[i + 1 :])) for i in range(len(SIZES)))


def _size(n: int) -> int:
    return 0 if n <= 1 else 1 if n <= 3 else 2 if n <= 6 else 3 if n <= 12 else 4


_SIZE_OF = [_size(n) * STRIDES[0] for n in range(40)]
_GRAMMAR_OF = [i * STRIDES[4] for i in range(SIZES[4])]
_SEPARATED, _WITH_DIGITS = 2 * STRIDES[1], STRIDES[2]


def observe(s: str, before: str) -> int:
    """The statistics of a segment as one number; ``before`` is the segment before it."""
    if s[-1] in ".!?;" and s != before and len(s) > 20 and s[0].isalpha() and not _UNPLAIN.search(s):
        # most sentences: letters, numbers and ordinary punctuation only
        words = s.lower().split()
        n = len(words)
        if 4 < n < 40 and (fw := sum(map(_WORDS.__contains__, words))) > 1 and (n < 8 or len(set(words)) >= 0.55 * n):
            return _SIZE_OF[n] + (_SEPARATED if s[-1] == ";" else 0) + (_WITH_DIGITS if _DIGIT.search(s) else 0) + _GRAMMAR_OF[1 if fw < 0.15 * n else 2 if fw < 0.3 * n else 3]
    if len(s) < 50 and s != before:
        # short entries recur
        known = _entries.get(s)
        if known is None:
            if len(_entries) > ENTRIES:
                _entries.clear()
            known = _entries[s] = _number(_observe(s, ""))
        return known
    return _number(_observe(s, before))


def _number(values: tuple[int, ...]) -> int:
    return sum(v * k for v, k in zip(values, STRIDES))


#: Short segments whose statistics a worker keeps.
ENTRIES = 200_000
_entries: dict[str, int] = {}


def numbers_free(body: str) -> bool:
    return not _DIGIT.search(body) and ",," not in body and "|" not in body


#: Words over which repetition is judged.
RUN = 40


def _observe(s: str, before: str) -> tuple[int, ...]:
    speaker = _SPEAKER.match(s)
    body = s[speaker.end() :] or s if speaker else s
    bullet = 1 if _BULLET.match(body) else 0
    csv = len(_CSV.findall(body))
    words = (body.replace(",", ", ") if csv else body).lower().replace("'", " ").replace("’", " ").replace("(", " ").replace(")", " ").split()
    if bullet:
        words = words[1:]
    n = len(words) or 1
    bare = [w.strip(".,;:!?\"“”„«»…-–*_#|[]") for w in words]
    fw = sum(map(_WORDS.__contains__, bare))
    last = body.rstrip(" \"'”’»)*")[-1:]
    end = 0 if last and last in ".!?…。！？" else 1 if last == ":" else 2 if last and last in ";,|" else 3
    share = fw / n
    grammar = 0 if fw == 0 else 1 if share < 0.15 else 2 if share < 0.3 else 3
    if end == 0 and n > 3 and numbers_free(body) and (body[2:] if bullet else body).lstrip()[:1].isupper():
        grammar = max(grammar, 1)  # a sentence by its form, of words of content only
    latin = _LATIN.search(body)
    if not latin and len(_LETTER.findall(body)) > 0.5 * len(body):
        grammar = 3 if end == 0 else 2 if n > 3 else 0  # scripts without function words here
        if not _SPACED.search(body):  # scripts without spaces: two signs count as a word
            n = max(n, len(body) // 2)
    numbers = sum(1 for w in words if _NUMBER.match(w))
    digits = 0 if numbers == 0 else 1 if numbers < 0.25 * n else 2
    pipes, gaps = body.count("|"), len(_GAP.findall(body.strip()))
    cells = max(pipes - 1, gaps if gaps * 3 >= n - 1 or "\t" in body else 0, csv)
    fields = 3 if cells >= 2 else 2 if cells == 1 or ((pair := _PAIR.match(body)) and (not fw or pair[1][:1].isdigit())) else 1 if "," in body and end == 3 else 0
    odd = len(_ODD.findall(body))
    strange = 0 if odd == 0 else 1 if odd < 0.06 * len(body) else 2 if odd < 0.2 * len(body) else 3
    if odd > 0.1 * len(body) and _MOJIBAKE.search(body) or _HEX.search(body):
        strange, digits = 3, min(digits, 1)
    longest = max(map(len, words), default=0) if latin else 0
    long_ = 0 if longest < 24 else 1 if longest < 40 else 2
    noise = 1 if n > 2 and latin and len(_CLUSTER.findall(body)) > 0.25 * n else 0
    nav = sum(map(NAVIGATION.__contains__, bare))
    # runs of RUN words, so that the share of different ones doesn't fall with the length
    runs = [bare[i : i + RUN] for i in range(0, max(len(bare) - RUN // 4, 1), RUN)]
    different = sum(len(set(r)) for r in runs) / max(sum(map(len, runs)), 1)
    if nav >= 0.7 * n or s == before or n >= 10 and different < 0.4 and digits < 2:
        again = 2
    else:
        again = 1 if nav >= 0.34 * n or n >= 8 and different < 0.55 and digits < 2 else 0
    return _size(n), end, digits, fields, grammar, bullet, strange, long_, noise, again


def beliefs() -> list[np.ndarray]:
    """Emission tables before estimation, (state, value) per statistic: the stated starting point, rows sum to 1."""
    rows = [
        # words: 1, 2-3, 4-6, 7-12, more
        [[1, 3, 12, 34, 50], [22, 40, 25, 8, 5], [20, 32, 25, 13, 10], [14, 18, 12, 16, 40]],
        # ends with: stop, colon, separator, nothing
        [[88, 2, 2, 8], [3, 4, 30, 63], [3, 3, 12, 82], [6, 2, 12, 80]],
        # numbers: none, few, many
        [[88, 11, 1], [94, 5, 1], [15, 25, 60], [85, 10, 5]],
        # fields: none, comma, pair or two, several
        [[90, 6, 3, 1], [75, 20, 4, 1], [3, 2, 35, 60], [80, 8, 6, 6]],
        # function words: none, few, some, many
        [[4, 12, 38, 46], [68, 8, 12, 12], [78, 8, 8, 6], [84, 10, 3, 3]],
        # bullet
        [[96, 4], [55, 45], [97, 3], [95, 5]],
        # odd characters: none, few, some, many
        [[93, 5, 1.5, 0.5], [90, 8, 1.5, 0.5], [60, 20, 18, 2], [35, 10, 15, 40]],
        # longest word: ordinary, long, very long
        [[98, 1.5, 0.5], [98, 1.5, 0.5], [90, 6, 4], [60, 12, 28]],
        # consonant clusters
        [[99, 1], [98, 2], [97, 3], [70, 30]],
        # menu labels or repetition: none, some, most
        [[97, 2.5, 0.5], [82, 17, 1], [82, 17, 1], [40, 12, 48]],
    ]
    return [np.array(r, float) / np.sum(r, axis=1, keepdims=True) for r in rows]


class Model:
    """Start, transition and emission probabilities; picklable and small."""

    def __init__(self):
        self.start = np.array([0.82, 0.07, 0.05, 0.06])
        stay = 0.9
        self.move = np.full((4, 4), (1 - stay) / 3) + np.eye(4) * (stay - (1 - stay) / 3)
        self.tables = beliefs()
        self.index()

    def index(self) -> None:
        """The likelihood of the states for every combination of statistics, scaled to 1 at most; no statistic can rule a state out alone."""
        log = np.zeros((*SIZES, 4))
        for i, table in enumerate(self.tables):
            log += np.log(table).T.reshape([-1 if j == i else 1 for j in range(len(SIZES))] + [4])
        log = log.reshape(-1, 4)
        self.likelihood = np.maximum(np.exp(log - log.max(axis=1, keepdims=True)), 1e-6).astype(np.float32)

    def posterior(self, codes: np.ndarray, lengths: np.ndarray, moves: np.ndarray | None = None) -> np.ndarray:
        """State probabilities of all segments of many documents, none empty; forward and backward over all documents at once.  Expected moves are added to ``moves``."""
        if not len(codes):
            return np.zeros((0, 4))
        # laid out by place in the document, longest documents first: the segments of a step are a slice
        order = np.argsort(-lengths, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        steps = int(lengths.max())
        alive = np.searchsorted(-lengths[order], -np.arange(1, steps + 1), "right")
        begin = np.concatenate([[0], np.cumsum(alive)])
        place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        at = begin[place] + np.repeat(rank, lengths)
        e = np.empty((len(codes), 4), np.float32)
        e[at] = self.likelihood[codes]
        move, forward, back, state = self.move.astype(np.float32), np.empty_like(e), np.ones_like(e), None
        for t in range(steps):
            own = slice(begin[t], begin[t + 1])
            state = (self.start.astype(np.float32) if t == 0 else state[: alive[t]] @ move) * e[own]
            state /= state.sum(axis=1, keepdims=True)
            forward[own] = state
        for t in range(steps - 2, -1, -1):
            later = slice(begin[t + 1], begin[t + 2])
            b = (back[later] * e[later]) @ move.T
            back[begin[t] : begin[t] + alive[t + 1]] = b / b.sum(axis=1, keepdims=True)
        if moves is not None and steps > 1:
            # a segment and the next of its document
            now = np.concatenate([np.arange(begin[t], begin[t] + alive[t + 1]) for t in range(steps - 1)])
            f, coming = forward[now], back[begin[1] :] * e[begin[1] :]
            f = f / ((f @ move) * coming).sum(axis=1, keepdims=True)
            moves += self.move * (f.T.astype(float) @ coming.astype(float))
        post = forward * back
        return (post / post.sum(axis=1, keepdims=True))[at]

    def expected(self, documents) -> np.ndarray:
        """Expected counts under the model as one row: by statistic, value and state, of first segments, of moves, and the documents; of ``documents`` in batches ``(codes, lengths)``."""
        by_code, first, moves, n = np.zeros((len(self.likelihood), 4)), np.zeros(4), np.zeros((4, 4)), 0
        for codes, lengths in documents:
            post = self.posterior(codes, lengths, moves)
            for s in range(4):
                by_code[:, s] += np.bincount(codes, weights=post[:, s], minlength=len(by_code))
            first += post[np.cumsum(lengths) - lengths].sum(axis=0, dtype=float)
            n += len(lengths)
        grid = by_code.reshape(*SIZES, 4)
        sums = [grid.sum(axis=tuple(j for j in range(len(SIZES)) if j != i)).T.ravel() for i in range(len(SIZES))]
        return np.concatenate([*sums, first, moves.ravel(), [float(n)]])

    def estimate(self, expected: np.ndarray) -> float:
        """Probabilities from expected counts, and their greatest change; a share ``BELIEF`` of the beliefs stays, more for states met in fewer than ``PRIOR`` segments."""
        before = np.concatenate([*[t.ravel() for t in self.tables], self.start, self.move.ravel()])
        done = 0
        for i, table in enumerate(beliefs()):
            counts = expected[done : done + table.size].reshape(table.shape)
            done += table.size
            found = (counts + 1) / (counts + 1).sum(axis=1, keepdims=True)
            weight = np.minimum(counts.sum(axis=1, keepdims=True) / PRIOR, 1) * (1 - BELIEF)
            self.tables[i] = weight * found + (1 - weight) * table
        self.start = (expected[done : done + 4] + 20 * np.array([0.82, 0.07, 0.05, 0.06])) / (expected[-1] + 20)
        moves = expected[done + 4 : done + 20].reshape(4, 4) + 50 * (np.eye(4) * 0.86 + 0.035)
        self.move = moves / moves.sum(axis=1, keepdims=True)
        self.index()
        return float(np.abs(np.concatenate([*[t.ravel() for t in self.tables], self.start, self.move.ravel()]) - before).max())


#: Share of the beliefs in the estimated tables, and segments of a state from which on it is no more.
BELIEF, PRIOR = 0.3, 1000.0


def describe(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[str]]]:
    """Statistics of segments, those of one as a number, documents' numbers of segments, segments' characters, and the segments."""
    rows, lengths, chars, parts = [], [], [], []
    for t in texts:
        own = segments(t) if t else []
        rows.extend(map(observe, own, ["", *own]))
        chars.extend(map(len, own))
        lengths.append(len(own))
        parts.append(own)
    return np.array(rows, np.int32), np.array(lengths, np.int64), np.array(chars, np.int32), parts


def shares(model: Model, codes: np.ndarray, lengths: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Character-weighted state shares per document; without segments all 0."""
    out = np.zeros((len(lengths), 4))
    has = lengths > 0
    if has.any():
        post = model.posterior(codes, lengths[has])
        first = (np.cumsum(lengths) - lengths)[has]
        total = np.add.reduceat(post * chars[:, None], first, axis=0)
        out[has] = total / total.sum(axis=1, keepdims=True)
    return out


def kinds(share: np.ndarray) -> list[str | None]:
    """The state of the largest share; None without text."""
    best = share.argmax(axis=1)
    return [STATES[b] if s.any() else None for b, s in zip(best, share)]


def observed(documents: DataFrame, columns: list[str], also=None, schema: str = "") -> DataFrame:
    """``columns`` with the statistics and the characters of each document's segments, four bytes each, written to the shared folder.

    ``also(data, segments)`` gives further columns of ``schema`` from the same
    pass, so that a text is cut and looked at once, whatever is asked of it.
    """
    shared_dir(documents.sparkSession)

    def run(data):
        codes, lengths, chars, parts = describe(data["text"])
        ends = np.cumsum(lengths) * 4
        cut = lambda a: [a[e - n * 4 : e] for e, n in zip(ends.tolist(), lengths.tolist())]
        out = {c: data[c] for c in columns} | (also(data, parts) if also else {})
        return out | {"__codes": cut(codes.tobytes()), "__chars": cut(chars.tobytes())}

    known = dict(documents.dtypes)
    kept = ", ".join(f"`{c}` {known[c]}" for c in columns)
    used = list(dict.fromkeys([*columns, *(["url"] if also and "url" in documents.columns else []), "text"]))
    return arrow_map(documents, used, run, ", ".join(x for x in (kept, schema, "__codes binary, __chars binary") if x)).checkpoint()


def _join(blobs) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(blobs), np.int32), np.array([len(b) // 4 for b in blobs], np.int64)


def estimate(documents: DataFrame, rounds: int = ROUNDS) -> Model:
    """The model estimated from all ``observed`` documents; a round is one pass over their numbers, a task returns one row of expected counts."""
    model = Model()

    def expect(batches):
        total = model.expected(_join([b for b in batch.column(0).to_pylist() if b]) for batch in batches)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "n"])

    for _ in range(rounds):
        rows = documents.select("__codes").mapInArrow(expect, "i int, n double").groupBy("i").agg(F.sum("n").alias("n")).collect()
        counts = np.zeros(sum(SIZES) * 4 + 21)
        for r in rows:
            counts[r["i"]] = r["n"]
        if not counts[-1] or model.estimate(counts) < SETTLED:
            break
    return model


def judged(documents: DataFrame, model: Model) -> DataFrame:
    """``observed`` documents with ``kind``, the shares of prose, list, table and junk, and ``n_lines`` in place of their numbers; null kind and shares for null and blank texts."""
    columns = [c for c in documents.columns if not c.startswith("__")]

    def run(data):
        codes, lengths = _join(data["__codes"])
        share = shares(model, codes, lengths, _join(data["__chars"])[0])
        kind = kinds(share)
        out = {c: data[c] for c in columns} | {"kind": kind}
        for i, s in enumerate(STATES):
            out[s] = [float(v) if k else None for v, k in zip(share[:, i], kind)]
        return out | {"n_lines": lengths.tolist()}

    known = dict(documents.dtypes)
    return arrow_map(documents, [*columns, "__codes", "__chars"], run, ", ".join([*(f"`{c}` {known[c]}" for c in columns), "kind string, prose double, list double, table double, junk double, n_lines bigint"]))


#: Names and types of the statistics of a text beside its kind.
STATISTICS = {
    **dict.fromkeys(("char_count", "word_count", "num_lines"), "int"),
    **dict.fromkeys(("mean_word_length", "mean_line_length", "frac_alpha", "frac_digit", "frac_punctuation", "frac_uppercase", "frac_symbol", "frac_lines_terminal_punct", "frac_lines_bullet", "type_token_ratio", "stopword_fraction"), "double"),
}
_SYMBOL, _PUNCTUATION, _SPACE, _UPPER, _LETTER_, _FIGURE, _OTHER = range(7)
# White space, ends of prose lines and marks of lists, as the base features define them.
_BLANKS = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_WORDS_OF = re.compile(f"[^{_BLANKS}]+")
_TERMINAL = re.compile(r"[.?!\"][ \t\n\x0b\f\r]*(?:\r\n|[\n\r\x85\u2028\u2029])?\Z")
_MARKED = re.compile(r"\s*(?:[-*•]|\d+\.)\s", re.ASCII)
_STOPS = frozenset(STOP_WORDS)
_classes: list[np.ndarray] = []


def _class_of() -> np.ndarray:
    """The class of every code point, made once in a worker."""
    if not _classes:
        import unicodedata

        kinds = {"Lu": _UPPER, "Nd": _FIGURE}
        table = np.array([kinds.get(k, {"L": _LETTER_, "M": _OTHER, "N": _OTHER}.get(k[0], _SYMBOL)) for k in map(unicodedata.category, map(chr, range(0x110000)))], np.uint8)
        table[[c for c in range(33, 127) if not chr(c).isalnum()]] = _PUNCTUATION
        table[[0xB2, 0xB3, 0xB9]] = _FIGURE
        table[[ord(c) for c in _BLANKS]] = _SPACE
        _classes.append(table)
    return _classes[0]


def statistics(texts: list[str | None]) -> dict[str, list]:
    """STATISTICS of each text: the base features but the repetition of n-grams, and ``frac_symbol``, the share of signs that are no letter, mark, number or white space.

    A null text counts as empty; a text without words has its numbers of
    characters, words and lines only.
    """
    table = _class_of()
    out: dict[str, list] = {c: [] for c in STATISTICS}
    share = lambda a, b: float(a) / float(b) if b else None
    for t in texts:
        t = t or ""
        chars, words, held = len(t), _WORDS_OF.findall(t), t.split("\n")
        n, lines_ = len(words), len(held) if t else 0
        row = {"char_count": chars, "word_count": n, "num_lines": lines_}
        if n:
            count = np.bincount(table[np.frombuffer(t.encode("utf-32-le"), np.uint32)], minlength=7).tolist()
            letters, lower = count[_UPPER] + count[_LETTER_], t.lower() if len(t.lower()) == chars else None
            lower = _WORDS_OF.findall(lower) if lower is not None else [w.lower() for w in words]
            filled = [x for x in held if _WORDS_OF.search(x)]
            row |= {
                "mean_word_length": share(chars - count[_SPACE], n), "mean_line_length": share(chars - (lines_ - 1), lines_),
                "frac_alpha": share(letters, chars), "frac_digit": share(count[_FIGURE], chars), "frac_punctuation": share(count[_PUNCTUATION], chars),
                "frac_uppercase": share(count[_UPPER], letters), "frac_symbol": share(count[_SYMBOL] + count[_PUNCTUATION], chars),
                "frac_lines_terminal_punct": share(sum(bool(_TERMINAL.search(x)) for x in filled), len(filled)), "frac_lines_bullet": share(sum(bool(_MARKED.match(x)) for x in filled), len(filled)),
                "type_token_ratio": share(len(set(lower)), n), "stopword_fraction": share(sum(map(_STOPS.__contains__, lower)), n),
            }
        for c in out:
            out[c].append(row.get(c))
    return out


def classify(documents: DataFrame, with_statistics: bool = False, model: Model | None = None) -> DataFrame:
    """``(doc_id, kind, prose, list, table, junk, n_lines)`` per document; null kind and shares for null and blank texts.

    Texts are read once; without a ``model`` one is estimated on all of them.
    ``with_statistics`` adds the ``statistics`` of each text.
    """
    also = (lambda data, _: statistics(data["text"])) if with_statistics else None
    seen = observed(unclash(documents, ["doc_id", "text"]), ["doc_id"], also, ", ".join(f"{c} {k}" for c, k in STATISTICS.items()) if with_statistics else "")
    return judged(seen, model or estimate(seen)).select("doc_id", "kind", *STATES, "n_lines", *(STATISTICS if with_statistics else ()))
