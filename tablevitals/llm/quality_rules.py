"""Quality rules, line first, in built-in functions alone.

Every line is held against rules for punctuation, navigation and boilerplate. Lines that fail go, and a document that
loses too much of its text that way goes as a whole. Base counts of words, symbols and repetitions come from the same
pass: a document is one row throughout and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablevitals.llm.common import ascii_lower, ref, whole_text

#: White space between words, as a regular expression class and as plain characters.
SPACE, SPACES = r"[\x20\x09-\x0D]", " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
#: A document needs so many words, and at most this percentage of them in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: A line of fewer characters must end like a sentence; a longer one must only hold a mark that ends one.
SHORT_LINE = 120
ENDS = r"""[.!?:;…。！？"'”’»)\]]$"""
MARKS = "[.!?…。！？]"
#: Lines of up to so many characters may be navigation: entries parted by bars, arrows or dots, or just names of pages.
MENU_LINE = 200
MENU = r"[|>»›•·].*[|>»›•·]"
PAGES = (r"^[\x20\x09-\x0D]*((home|menu|next|previous|prev|back|top|search|log ?in|log ?out|sign ?in|sign ?up|register|about|about us|"
         r"contact|contact us|help|faq|sitemap|read more|more|share|print|subscribe|skip to content)[\x20\x09-\x0D.:/-]*)+$")
#: A line that holds one of these, A-Z lower-cased, is boilerplate.
BOILERPLATE = ("all rights reserved", "copyright (c)", "copyright ©", "©", "licensed under", "privacy policy",
               "cookie policy", "terms of use", "terms of service", "use cookies", "uses cookies", "accept cookies",
               "javascript", "lorem ipsum", "click here", "{", "}")
#: Percent of a document's characters that failing lines may hold.
MOST_LOST = 40


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often and wherever ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _has_word(line: Column) -> Column:
    return F.regexp(line, F.lit(r"[^\x20\x09-\x0D]"))


def word_list(text: Column) -> Column:
    return _let(F.btrim(text, F.lit(SPACES)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(
        F.split(t, SPACE + "+")))


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of three words that occur twice or more in the list.

    Windows are sorted by a 64-bit hash with their places, neighbours alike give the repeated places, and these, in
    order, cover up to three words each.
    """
    def of_sorted(sorted_windows: Column) -> Column:
        flagged = F.transform(sorted_windows, lambda w, k: F.when(
            w["hash"].eqNullSafe(F.get(sorted_windows, k - 1)["hash"])
            | w["hash"].eqNullSafe(F.get(sorted_windows, k + 1)["hash"]), w["at"]))
        return _let(F.sort_array(F.array_compact(flagged)), lambda places: F.aggregate(
            F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - p, F.lit(3)))),
            F.lit(0).cast("long"), lambda total, n: total + n))

    windows = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, k: F.struct(
        F.xxhash64(w, F.get(words, k + 1), F.get(words, k + 2)).alias("hash"), k.alias("at")))
    return _let(F.sort_array(windows), of_sorted)


def line_fails(line: Column) -> Column:
    """Whether a line with words breaks a rule."""
    def broken(low: Column) -> Column:
        punctuation = F.when(F.char_length(low) < SHORT_LINE, ~F.regexp(
            F.right(F.rtrim(low, F.lit(SPACES)), F.lit(1)), F.lit(ENDS))).otherwise(~F.regexp(low, F.lit(MARKS)))
        navigation = (F.char_length(low) <= MENU_LINE) & (F.regexp(low, F.lit(MENU)) | F.regexp(low, F.lit(PAGES)))
        return reduce(or_, [F.contains(low, F.lit(phrase)) for phrase in BOILERPLATE], punctuation | navigation)
    return _let(ascii_lower(line), broken)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, clean_text, the counts below, base_failed and kept.

    n_words; word_chars, code points in words; n_symbols, characters of ``SYMBOLS``; n_dup_lines, lines with a word
    equal to an earlier line; n_repeat_words, words in windows of three that occur twice or more; n_lines with a word,
    n_failed of them that break a rule, and text_chars and lost_chars, code points of both. ``clean_text`` has the
    lines that pass; blank ones stay, and line feeds part them as before. A document is kept unless it has under 50
    words, over half of them repeated, or over 40 % of its characters in failing lines.

    A missing text counts as empty: no counts, not kept, and its clean text is empty. Repeated rows and ids are taken
    row by row; an empty table gives none; other columns are ignored whatever their names. Windows are told apart by
    64 bits, so that two different ones of a text of 60,000 words are taken for one once in ten billion such texts.
    """
    text = whole_text(ref(text_col))
    lines = F.split(F.col("text"), "\n", -1)
    parts = docs.select(ref(id_col).alias("doc_id"), text.alias("text")).select(
        "doc_id", "text", F.transform(lines, lambda x: F.struct(
            x.alias("line"), _has_word(x).alias("filled"), (_has_word(x) & line_fails(x)).alias("fails"))).alias("lines"),
        _let(word_list(F.col("text")), lambda w: F.struct(
            F.size(w).cast("long").alias("n"), repeated_words(w).alias("repeated"),
            F.aggregate(w, F.lit(0).cast("long"), lambda n, x: n + F.char_length(x)).alias("chars"))).alias("words"))
    filled = F.transform(F.filter("lines", lambda x: x["filled"]), lambda x: x["line"])
    chars = "aggregate({}, 0L, (n, x) -> n + char_length(x.line))"
    counted = parts.select(
        "doc_id",
        F.array_join(F.transform(F.filter("lines", lambda x: ~x["fails"]), lambda x: x["line"]), "\n").alias("clean_text"),
        F.col("words.n").alias("n_words"),
        F.col("words.chars").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        _let(filled, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.col("words.repeated").alias("n_repeat_words"),
        F.size(F.filter("lines", lambda x: x["filled"])).cast("long").alias("n_lines"),
        F.size(F.filter("lines", lambda x: x["fails"])).cast("long").alias("n_failed"),
        F.expr(chars.format("filter(lines, x -> x.filled)")).alias("text_chars"),
        F.expr(chars.format("filter(lines, x -> x.fails)")).alias("lost_chars"))
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return counted.withColumn("base_failed", base).withColumn(
        "kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= MOST_LOST * F.col("text_chars")))
