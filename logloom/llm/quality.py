"""Line-first quality rules.

Each line of a text is judged on its own: it needs the end of a sentence, must not
consist of marks and separators, and must not be a menu entry or a stock phrase.
Lines that fail are removed; a document that loses too much of its text is rejected.
Before that, a document fails the base test if it is short or mostly repeats itself.

Everything is a column expression: one pass over the texts, no shuffle, no Python.

Defined cases: a null or empty text has no words and fails the base test; lines without
a word are dropped from the cleaned text and count nowhere; equal rows get equal results;
other columns do not take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, words

MIN_WORDS = 50
MAX_REPEATED_PCT = 50
MIN_KEPT_PCT = 50
MAX_MARKS_PCT = 10
SHORT_LINE = 200

SYMBOLS = r"[#*$%&|<>]"
SENTENCE_END = r"""[.!?…。！？]["'”’»)\]]*([\x20\x09-\x0D]|\z)"""
MARKS = r"[#*$%&|<>{}=_~^\\!?»›·•]"
#: A short line that is one entry of a menu.
NAVIGATION = (
    r"(?i)^[\x20\x09-\x0D]*(home|menu|search|login|log in|log out|sign in|sign up|register|next|previous|back to top|"
    r"skip to content|share this|read more|contact us|about us|site map|sitemap)[\x20\x09-\x0D.:>»]*\z"
)
#: A short line that says nothing of its own.
BOILERPLATE = (
    r"(?i)(javascript|cookie policy|use of cookies|uses cookies|accept cookies|privacy policy|terms of use|terms of service|"
    r"terms and conditions|all rights reserved|licensed under|copyright (©|\(c\)|[0-9]{4})|lorem ipsum|"
    r"subscribe to our|click here|page not found|powered by)"
)


def line_facts(line: Column) -> Column:
    """chars: code points that are not white space; ok: the line stays."""
    chars = F.char_length(F.regexp_replace(line, SPACES, ""))
    marks = F.char_length(line) - F.char_length(F.regexp_replace(line, MARKS, ""))

    def judged(n: Column) -> Column:
        punctuation = line.rlike(SENTENCE_END) & ~((marks >= 3) & (marks * 100 > n * MAX_MARKS_PCT))
        stock = (n <= SHORT_LINE) & (line.rlike(NAVIGATION) | line.rlike(BOILERPLATE))
        return F.struct(n.alias("chars"), ((n > 0) & punctuation & ~stock).alias("ok"), line.alias("line"))

    return let(chars, judged)


def repeated_words(word_list: Column) -> Column:
    """How many words lie in 3-word windows that the list has twice or more.

    Windows are sorted by hash; those with an equal neighbour are repeated.  Their
    positions in order cover min(3, distance to the next) words each.
    """
    last = F.size(word_list) - 3
    windows = F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda i: F.struct(
            F.xxhash64(F.get(word_list, i), F.get(word_list, i + 1), F.get(word_list, i + 2)).alias("h"), i.alias("i")
        ),
    )

    def covered(ordered: Column) -> Column:
        def same(w: Column, k: Column) -> Column:
            return F.coalesce(F.get(ordered, k)["h"] == w["h"], F.lit(False))

        twice = F.filter(ordered, lambda w, k: same(w, k - 1) | same(w, k + 1))
        places = F.sort_array(F.transform(twice, lambda w: w["i"]))
        return let(
            places,
            lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))),
                F.lit(0).cast("long"),
                lambda total, x: total + x,
            ),
        )

    return F.when(last < 1, F.lit(0).cast("long")).otherwise(let(F.sort_array(windows), covered))


def measures(text: Column) -> Column:
    """All figures of a text as one struct; `lines` has the facts of each line with a word."""
    whole = F.coalesce(text, F.lit(""))

    def of(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        texts = F.transform(lines, lambda x: x["line"])
        return F.struct(
            (F.size(lines) - F.size(F.array_distinct(texts))).cast("long").alias("n_dup_lines"),
            F.size(lines).cast("long").alias("n_lines"),
            F.size(F.filter(lines, lambda x: x["ok"])).cast("long").alias("kept_lines"),
            F.aggregate(
                lines, F.lit(0).cast("long"), lambda n, x: n + F.when(x["ok"], x["chars"]).otherwise(0)
            ).alias("kept_chars"),
            F.array_join(F.transform(F.filter(lines, lambda x: x["ok"]), lambda x: x["line"]), "\n").alias("clean_text"),
        )

    judged = F.filter(F.transform(F.split(whole, "\n"), line_facts), lambda x: x["chars"] > 0)
    return F.struct(
        let(words(text), of).alias("base"),
        let(judged, of_lines).alias("line"),
        (F.size(F.split(whole, SYMBOLS)) - 1).cast("long").alias("n_symbols"),
    )


def clean_documents(
    docs: DataFrame,
    *,
    min_words: int = MIN_WORDS,
    max_repeated_pct: int = MAX_REPEATED_PCT,
    min_kept_pct: int = MIN_KEPT_PCT,
) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, figures, base_failed, kept, clean_text."""
    m = docs.select("doc_id", measures(F.col("text")).alias("m"))
    flat = m.select(
        "doc_id",
        F.col("m.base.n_words").alias("n_words"),
        F.col("m.base.word_chars").alias("word_chars"),
        F.col("m.n_symbols").alias("n_symbols"),
        F.col("m.line.n_dup_lines").alias("n_dup_lines"),
        F.col("m.base.n_repeat_words").alias("n_repeat_words"),
        F.col("m.line.n_lines").alias("n_lines"),
        F.col("m.line.kept_lines").alias("kept_lines"),
        F.col("m.line.kept_chars").alias("kept_chars"),
        F.col("m.line.clean_text").alias("clean_text"),
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated_pct * F.col("n_words"))
    return flat.withColumn("base_failed", failed).withColumn(
        "kept", ~failed & (100 * F.col("kept_chars") >= min_kept_pct * F.col("word_chars"))
    )
