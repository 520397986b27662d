"""Line-first cleaning (built-in expressions only).

Every line is judged alone, by shares of its words: it fails when it does not
end like a sentence, looks like a navigation bar, holds boilerplate, is
shouted, is mostly symbols or repeats few words.  Failing lines are removed; a document then fails when it
has lost more than ``MAX_LOSS`` of its word characters, or when the plain
length and repetition limits reject it.

Everything happens inside the row: words, lines and three-word windows are
arrays of the document, so nothing is shuffled and a hot source or a group of
copies makes no difference.  Repeated windows are found by sorting the 64-bit
window hashes of one text (n log n), never by comparing all pairs.

A document of one long line is judged by that line: a stray separator, one
phrase or a missing last mark among many words does not fail it.

Cases: NULL text counts as empty (no words, ``base_failed``); rows are judged
one by one, so ties and repeated rows get equal results; extra columns are
ignored by ``judge`` and kept by ``clean``; texts of any length are judged
whole, as arrays of one row; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, words

MIN_WORDS = 50
MAX_REPEAT_PCT = 50
#: A document may lose this share of its word characters with its failing lines.
MAX_LOSS = 0.5
#: Fixed phrases of web boilerplate, matched in lower-cased lines.
BOILERPLATE = ("accept cookies", "all rights reserved", "cookie policy", "click here to", "enable javascript",
               "log in to", "lorem ipsum", "privacy policy", "sign up for", "skip to content",
               "subscribe to our", "terms of use")
#: Sentence marks: Latin and CJK, Arabic and Urdu, Devanagari, Armenian, Ethiopic, Tibetan, Burmese, Khmer.
ENDS = ".!?:;…。！？｡؟۔؛।॥։።།။។"
#: Thai and Lao have no mark for the end of a sentence, so any of their letters may end a line.
UNMARKED = "฀-໿"
#: A line ends well with a sentence mark, perhaps closed by quotes or brackets.
CLOSED = rf"""[{ENDS}{UNMARKED}]["'”’»)\]]{{0,7}}$"""
#: A line of so many words may lack the last mark, if it has one inside for each so many words.
LONG_LINE = 40
SENTENCE = rf"[{ENDS}]\s"
#: Separators of a menu or a bread-crumb trail, as words of their own: one for each so many words at most.
NAVIGATION, NAVIGATION_WORDS = ("|", "»", ">", "•", "·"), 8
#: Words that a line needs for each boilerplate phrase in it.
PHRASE_WORDS = 20
SYMBOLS = "[#*$%&|<>]"
#: Any character that the navigation or symbol rules ask for.
MARKS = "[#*$%&|<>»•·]"


def _phrases(lowered: Column) -> Column:
    """How many of the phrases a text has."""
    return reduce(lambda a, b: a + b, (F.contains(lowered, F.lit(p)).cast("int") for p in BOILERPLATE))


def _any_phrase(lowered: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(lowered, F.lit(p)) for p in BOILERPLATE))


def line_ok(line: Column, w: Column, marked: Column, phrased: Column) -> Column:
    """Whether a line with the words ``w`` passes every line rule.

    ``marked`` and ``phrased`` say whether its text has any mark of the
    navigation and symbol rules, and any boilerplate phrase, at all: most
    texts have none, and their lines are not searched for them.
    """
    n = F.size(w)
    closed = F.substring(F.rtrim(line, F.lit(" \t\n\x0b\f\r")), -8, 8).rlike(CLOSED)
    closed = closed | ((n >= LONG_LINE) & (F.regexp_count(line, F.lit(SENTENCE)) * LONG_LINE >= n))
    shouted = (n >= 2) & (line == F.upper(line)) & (line != F.lower(line))
    navigation = marked & (F.size(F.filter(w, lambda x: x.isin(*NAVIGATION))) * NAVIGATION_WORDS > n)
    symbols = marked & (F.regexp_count(line, F.lit(SYMBOLS)) * 4 > n)
    boilerplate = phrased & (_phrases(F.lower(line)) * PHRASE_WORDS > n)
    monotone = (n >= 8) & (F.size(F.array_distinct(w)) * 2 < n)
    return closed & ~shouted & ~navigation & ~symbols & ~boilerplate & ~monotone


def _length(w: Column) -> Column:
    """Characters in an array of words."""
    return F.length(F.array_join(w, "")).cast("long")


def with_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Two struct columns: ``__doc``, the row as it is, and ``__q`` with counts, verdicts and the cleaned text.

    The steps are separate projections: each reads the arrays of the one
    before as columns, so no array is computed anew for every element.
    """
    src = F.coalesce(F.col(text_col), F.lit(""))
    # A line break is white space, so the words of a text are those of its lines.
    lines = F.transform(F.split(src, "\n"), lambda x: F.struct(x.alias("t"), words(x).alias("w")))
    step = docs.select(F.struct("*").alias("__doc"), F.filter(lines, lambda x: F.size(x["w"]) > 0).alias("__l"),
                       src.rlike(MARKS).alias("__marked"), _any_phrase(F.lower(src)).alias("__phrased"))
    good = F.filter("__l", lambda x: line_ok(x["t"], x["w"], F.col("__marked"), F.col("__phrased")))
    step = step.select("__doc", F.col("__l.t").alias("__l"), F.flatten("__l.w").alias("__w"), good.alias("__good"))
    hashes = F.expr("""
        if(size(__w) < 3, CAST(array() AS array<bigint>), transform(sequence(0, size(__w) - 3),
           i -> xxhash64(get(__w, i), get(__w, i + 1), get(__w, i + 2))))""")
    step = step.select("__doc", "__l", F.col("__good.t").alias("__good"), F.size("__w").cast("long").alias("__n"),
                       _length(F.col("__w")).alias("__chars"), _length(F.flatten("__good.w")).alias("__left"),
                       hashes.alias("__h"))
    # A text without equal window hashes repeats no window; only the others are sorted.
    ordered = F.expr("""
        if(size(array_distinct(__h)) = size(__h), CAST(array() AS array<struct<h: bigint, p: int>>),
           sort_array(transform(__h, (h, p) -> struct(h, p))))""")
    step = step.select("__doc", "__l", "__good", "__n", "__chars", "__left", ordered.alias("__g"))
    # Starts of windows found again: a neighbour in sorted order has the same hash.
    again = F.expr("""
        sort_array(transform(filter(__g, (x, i) -> x.h <=> get(__g, i - 1).h OR x.h <=> get(__g, i + 1).h), x -> x.p))""")
    step = step.select("__doc", "__l", "__good", "__n", "__chars", "__left", again.alias("__r"))
    covered = F.expr("aggregate(transform(__r, (p, i) -> least(3, coalesce(get(__r, i + 1) - p, 3))), 0L, (a, x) -> a + x)")
    step = step.select("__doc", "__n", "__chars", "__left", covered.alias("__rep"),
                       (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("__dup"),
                       F.array_join("__good", "\n").alias("__clean"))
    base_failed = (F.col("__n") < MIN_WORDS) | (F.col("__rep") * 100 > F.col("__n") * MAX_REPEAT_PCT)
    lost = F.when(F.col("__chars") > 0, 1 - F.col("__left") / F.col("__chars")).otherwise(F.lit(1.0))
    step = step.select("__doc", "__n", "__chars", "__rep", "__dup", "__clean", "__left",
                       base_failed.alias("__failed"))
    q = F.struct(
        F.col("__n").alias("n_words"), F.col("__chars").alias("word_chars"),
        F.regexp_count(F.coalesce(F.col(f"__doc.`{text_col}`"), F.lit("")), F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.col("__dup").alias("n_dup_lines"), F.col("__rep").alias("n_repeat_words"),
        F.col("__failed").alias("base_failed"), F.col("__left").alias("kept_chars"),
        (~F.col("__failed") & (lost <= MAX_LOSS)).alias("kept"), F.col("__clean").alias("clean_text"))
    return step.select("__doc", q.alias("__q"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its counts, ``base_failed``, ``kept``, and the word characters left after cleaning."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    q = with_features(d)
    return q.select("__doc.doc_id", "__q.n_words", "__q.word_chars", "__q.n_symbols", "__q.n_dup_lines",
                    "__q.n_repeat_words", "__q.base_failed", "__q.kept", "__q.kept_chars")


def clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that pass, in their own columns, with failing and blank lines removed from the text.

    An ``n_chars`` column, if there is one, is brought up to date.
    """
    # The row number keeps the filter above the features: pushed below, it would compute every array many times over.
    q = with_features(docs, text_col).select("*", F.monotonically_increasing_id().alias("__row"))
    q = q.where(F.col("__q.kept") & (F.col("__row") >= 0))
    out = []
    for f in docs.schema.fields:
        if f.name == text_col:
            out.append(F.col("__q.clean_text").alias(f.name))
        elif f.name == "n_chars":
            out.append(F.length("__q.clean_text").cast(f.dataType).alias(f.name))
        else:
            out.append(F.col(f"__doc.`{f.name}`"))
    return q.select(*out)
