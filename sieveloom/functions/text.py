"""Text features as native column expressions; all of them run inside the JVM without a shuffle.

Null texts count as empty.  A text without words has character, word and line
counts only, the other features are NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unicode white space, as a character class body understood by Java and RE2.
WS = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Word boundaries by ASCII letters and digits, the same in every engine.
_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

# English stop words (the list shipped with pyspark.ml is not used, as it needs a JVM to be read).
STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her hers herself it it's its itself "
    "they them their theirs themselves what which who whom this that that'll these those am is are was were be been being have has had having do does did doing a an the "
    "and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under "
    "again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don "
    "don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't "
    "mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()
# Phrases whose density the discourse features measure.
CAUSAL = ("because", "therefore", "thus", "hence", "consequently", "as a result", "since", "so that", "due to", "owing to")
CONTRASTIVE = ("however", "although", "nevertheless", "despite", "whereas", "on the other hand", "in contrast", "conversely")
CONTRASTIVE_INITIAL = ("but", "yet")  # at the start of a sentence only
ELABORATIVE = ("furthermore", "moreover", "additionally", "specifically", "in particular", "for example", "for instance", "namely", "that is", "in other words")
TEMPORAL = ("first", "then", "next", "finally", "subsequently", "meanwhile", "afterward", "previously", "before this", "after this")
EXPLANATION = ("because", "since", "this means", "the reason is", "this is due to", "which shows that", "which means", "which indicates", "this implies", "this suggests")
PRONOUNS = ("he", "she", "it", "they", "this", "that", "these", "those", "his", "her", "its", "their")
FIRST_PERSON = ("I", "me", "my", "mine", "we", "us", "our")
HEDGES = ("might", "could", "perhaps", "maybe", "seems", "arguably", "possibly", "apparently", "likely", "unlikely", "probably")

# Patterns that define the features of lines and sentences.
BULLET = r"^\s*(?:[-*•]|\d+\.)\s"
LIST_LINE = r"^\s*(?:[-*•]|\d+[.)])\s"
TERMINAL = r"[.?!\"]\s*$"
SENTENCE_BREAK = r"(?<=[.!?])[\"')\]]?\s+(?=[A-Z\"'(\[])|\n+"


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    return F.filter(F.split(_text(text), f"[{WS}]+"), lambda w: w != "")


def split_lines(text: Column) -> Column:
    return F.split(_text(text), "\n")


def _blank(s: Column) -> Column:
    return s.rlike(f"^[{WS}]*$")


def sentences(text: Column) -> Column:
    trimmed = F.transform(F.split(_text(text), SENTENCE_BREAK), lambda s: F.regexp_replace(s, f"^[{WS}]+|[{WS}]+$", ""))
    return F.filter(trimmed, lambda s: s != "")


def count_where(items: Column, test) -> Column:
    return F.size(F.filter(items, test))


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, NULL where b is 0 or NULL."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def distinct_share(items: Column) -> Column:
    return ratio(F.size(F.array_distinct(items)), F.size(items))


def let(value: Column, body) -> Column:
    """``body`` of a value evaluated once: expressions named inside a lambda would be evaluated for each element."""
    return F.transform(F.array(value), body)[0]


def once_share(items: Column) -> Column:
    """Share of the items that occur once, by one sort of their hashes."""
    return let(F.transform(items, lambda x: F.xxhash64(x)), lambda a: F.lit(1.0) - ratio(_repeated(a), F.size(a)))


def _repeated(items: Column) -> Column:
    """Number of hashes equal to another one: one walk over the sorted array with the last item and its run.

    64 bits tell the few thousand items of a text apart: two different ones
    agree in one of about 10**12 texts of 5,000 words.
    """
    start = F.struct(F.lit(None).cast("bigint").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("n"))

    def step(acc, x):
        same = x.eqNullSafe(acc["last"])
        run = F.when(same, acc["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), (acc["n"] + F.when(~same, 0).when(acc["run"] == 1, 2).otherwise(1)).alias("n"))

    return F.aggregate(F.array_sort(items), start, step, lambda acc: acc["n"])


def ngram_repetition(items: Column, n: int) -> Column:
    """n times the n-grams that occur twice or more, over the words; may exceed 1; NULL below n words."""

    def body(w):
        grams = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
        return F.when(F.size(w) >= n, ratio(_repeated(grams) * n, F.size(w)))

    return let(F.transform(items, lambda x: F.xxhash64(x)), body)


def pieces(text: Column) -> dict[str, Column]:
    """What several features share: words, lower-case and bare words, lines, sentences and counts of them."""
    w, lines, s = words(text), split_lines(text), sentences(text)
    bare = F.filter(F.transform(w, lambda x: F.regexp_replace(F.lower(x), r"^[.,;:!?\"'()\[\]{}]+|[.,;:!?\"'()\[\]{}]+$", "")), lambda x: x != "")
    return {"words": w, "lower": F.transform(w, F.lower), "bare": bare, "lines": lines, "filled": F.filter(lines, lambda x: ~_blank(x)), "sentences": s, "alpha": F.regexp_count(_text(text), F.lit(r"\p{L}"))}


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly where the input has fewer splits than there are cores, as a single small file has; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def with_features(df: DataFrame, text: str, make) -> tuple[DataFrame, dict[str, Column]]:
    """The frame with the shared pieces as columns ``__...``, and the features over them.

    The pieces are a projection of their own: the optimizer keeps it apart, as
    its expressions are costly and used more than once, so each is evaluated once
    per row; those no chosen feature uses are pruned.
    """
    staged = spread(df).withColumns({f"__{k}": c for k, c in pieces(F.col(text)).items()})
    return staged, make(F.col(text), {k: F.col(f"__{k}") for k in pieces(F.col(text))})


def heuristics(text: Column, p: dict[str, Column] | None = None) -> dict[str, Column]:
    """The sixteen base features by name."""
    p = p or pieces(text)
    t = _text(text)
    w, lower, lines, filled, alpha = p["words"], p["lower"], p["lines"], p["filled"], p["alpha"]
    n, chars = F.size(w), F.length(t)
    some = lambda c: F.when(n > 0, c)
    num_lines = F.when(chars == 0, 0).otherwise(F.size(lines))
    return {
        "char_count": chars,
        "word_count": n,
        "mean_word_length": some(ratio(F.length(F.regexp_replace(t, f"[{WS}]+", "")), n)),
        "frac_alpha": some(ratio(alpha, chars)),
        "frac_digit": some(ratio(F.regexp_count(t, F.lit(r"[\p{Nd}²³¹]")), chars)),
        "frac_punctuation": some(ratio(F.regexp_count(t, F.lit(r"[!-/:-@\[-`{-~]")), chars)),
        "frac_uppercase": some(ratio(F.regexp_count(t, F.lit(r"\p{Lu}")), alpha)),
        "frac_lines_terminal_punct": some(ratio(count_where(filled, lambda x: x.rlike(TERMINAL)), F.size(filled))),
        "frac_lines_bullet": some(ratio(count_where(filled, lambda x: x.rlike(BULLET)), F.size(filled))),
        "type_token_ratio": some(distinct_share(lower)),
        "stopword_fraction": some(ratio(F.regexp_count(F.concat(F.lit(" "), F.array_join(lower, "  "), F.lit(" ")), F.lit(f" (?:{'|'.join(STOP_WORDS)}) ")), n)),
        "ngram_rep_2": some(ngram_repetition(lower, 2)),
        "ngram_rep_3": some(ngram_repetition(lower, 3)),
        "ngram_rep_4": some(ngram_repetition(lower, 4)),
        "num_lines": num_lines,
        "mean_line_length": some(ratio(chars - (num_lines - 1), num_lines)),
    }


def phrases(text: Column, *lists: tuple[str, ...], initial: tuple[str, ...] = ()) -> Column:
    """Occurrences of phrases, of ``initial`` ones only at the start of a line or after a sentence's end."""
    parts = [f"{_B}(?:{'|'.join(p for ps in lists for p in ps)}){_E}"]
    if initial:
        parts.append(rf"(?:^|[.!?]\s+|\n)\s*(?:{'|'.join(initial)}){_E}")
    return F.regexp_count(_text(text), F.lit("(?im)" + "|".join(parts)))


def synthetic(text: Column, p: dict[str, Column] | None = None) -> dict[str, Column]:
    """The eighteen features of explanatory style by name; all NULL for an empty text."""
    p = p or pieces(text)
    t = _text(text)
    s, w, bare, lines, filled = p["sentences"], p["words"], p["bare"], p["lines"], p["filled"]
    n_sent = F.greatest(F.size(s), F.lit(1))
    n_words = F.greatest(F.size(w), F.lit(1))
    strip = lambda x: F.regexp_replace(x, f"^[{WS}]+|[{WS}]+$", "")
    header = lambda x: (F.length(strip(x)) < 80) & ~strip(x).rlike(r"[.?!]$") & (strip(x).startswith("#") | strip(x).rlike(r"^(?:[A-Z][A-Za-z0-9_'-]*\s*)+$"))
    # fixed value: what an indented line of code looks like
    code = r"(?m)^(?: {4,}|\t+).*(?:[{}]|(?<![A-Za-z0-9_])(?:def|class|import|function|var|SELECT|CREATE)(?![A-Za-z0-9_])|</?(?:div|p|span|a|li|ul|ol|h[1-6])(?![A-Za-z0-9_])).*$"
    covered = lambda pattern: F.aggregate(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.lit(0), lambda a, x: a + F.length(x))
    paragraphs = F.filter(F.split(t, r"\n\s*\n"), lambda x: ~_blank(x))
    proper = F.aggregate(
        F.transform(s, lambda x: F.regexp_extract_all(x, F.lit(r"[A-Za-z][A-Za-z'-]*"), F.lit(0))),
        F.lit(0),
        lambda a, ws: a + F.size(F.filter(F.slice(ws, 2, 1_000_000_000), lambda x: x.rlike("^[A-Z]"))),
    )
    has = F.size(s) > 0
    out = {
        "discourse_causal": ratio(phrases(text, CAUSAL), n_sent),
        "discourse_contrastive": ratio(phrases(text, CONTRASTIVE, initial=CONTRASTIVE_INITIAL), n_sent),
        "discourse_elaborative": ratio(phrases(text, ELABORATIVE), n_sent),
        "discourse_temporal": ratio(phrases(text, TEMPORAL), n_sent),
        "explanation_density": ratio(phrases(text, EXPLANATION), n_sent),
        "question_density": F.when(has, ratio(count_where(s, lambda x: x.endswith("?")), n_sent)),
        "pronoun_density": ratio(phrases(text, PRONOUNS), n_sent),
        "first_person_fraction": F.when(has, ratio(count_where(s, lambda x: x.rlike(f"{_B}(?:{'|'.join(FIRST_PERSON)}){_E}")), n_sent)),
        "hedge_density": ratio(phrases(text, HEDGES), n_sent),
        "hapax_legomena_ratio": once_share(bare),
        "header_density": ratio(count_where(filled, header), F.size(filled)),
        "code_fraction": ratio(F.least(covered("(?s)```.*?```") + covered(code), F.length(t)), F.length(t)),
        "avg_paragraph_length": ratio(F.aggregate(paragraphs, F.lit(0), lambda a, p: a + F.size(words(p))), F.size(paragraphs)),
        "list_density": ratio(count_where(lines, lambda x: x.rlike(LIST_LINE)), F.size(lines)),
        "numeric_density": ratio(F.regexp_count(t, F.lit(rf"{_B}\d+(?:\.\d+)?{_E}")), n_words) * 1000,
        "proper_noun_density": ratio(proper, n_words) * 1000,
        **readability(text, w),
    }
    return {k: F.when(F.length(t) > 0, v) for k, v in out.items()}


def syllables(word: Column) -> Column:
    """Vowel groups, a silent final e left out, one at least."""
    lower = F.lower(word)
    silent = F.when(lower.rlike("[^aeiouy]e$") & ~lower.rlike("[^aeiouy]le$"), 1).otherwise(0)
    return F.greatest(F.regexp_count(lower, F.lit("[aeiouyà-öø-ü]+")) - silent, F.lit(1))


def readability(text: Column, all_words: Column | None = None, limit: int | None = None) -> dict[str, Column]:
    """Flesch-Kincaid grade and Flesch reading ease, of the first ``limit`` words where given (5000 in the reference); NULL without words."""
    w = words(text) if all_words is None else all_words
    w = w if limit is None else F.slice(w, 1, limit)
    s = F.greatest(count_where(w, lambda x: x.rlike(r"[.!?][\"')\]]*$")), F.lit(1))
    syl = F.aggregate(w, F.lit(0), lambda a, x: a + syllables(x))
    counts = F.struct(F.size(w).alias("n"), s.alias("s"), syl.alias("syl"))
    return {
        "flesch_kincaid_grade": let(counts, lambda c: 0.39 * ratio(c["n"], c["s"]) + 11.8 * ratio(c["syl"], c["n"]) - 15.59),
        "flesch_reading_ease": let(counts, lambda c: 206.835 - 1.015 * ratio(c["n"], c["s"]) - 84.6 * ratio(c["syl"], c["n"])),
    }


def snippet(text: Column, limit: int) -> Column:
    """White space runs inside lines as one blank, cut with an ellipsis beyond ``limit`` characters."""
    t = F.array_join(F.transform(split_lines(text), lambda x: F.trim(F.regexp_replace(x, r"[ \t\x0B\f\r]+", " "))), "\n")
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("..."))).otherwise(t)


def one_line(text: Column) -> Column:
    """Line ends as blanks, outer white space removed."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(_text(text), f"^[{WS}]+|[{WS}]+$", ""), r"\r\n|\n|\r", " "), r"^ +| +$", "")


def truncated(url: Column, text: Column, limit: int) -> Column:
    """Url, blank line, text; cut at ``limit`` characters of text with a mark."""
    t = F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("... (truncated)"))).otherwise(text)
    return F.concat(F.coalesce(url, F.lit("")), F.lit("\n\n"), F.coalesce(t, F.lit("")))


def option_block(choices: Column) -> Column:
    """Lettered choices, one per line."""
    return F.array_join(F.transform(choices, lambda c, i: F.concat(F.char(i + 65), F.lit(": "), c)), "\n")


def simple_token_count(text: Column) -> Column:
    """Words and single signs, plus one for the start of the text."""
    return F.regexp_count(_text(text), F.lit(r"[A-Za-z0-9]+|[^A-Za-z0-9\s]")) + 1


def windows(items: Column, size: int) -> Column:
    """Consecutive slices of ``size``; an empty array gives one empty slice."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / size).cast("int") - 1, F.lit(0))), lambda i: F.slice(items, i * size + 1, size))
