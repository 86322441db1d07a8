"""Line-first cleaning: rules judge each line, failing lines go, then documents that lose too much go.

Row-local column expressions only: no shuffle, nothing collected.

Defined results: a null or blank text has no words, keeps nothing and is rejected; repeated rows
and repeated ids are judged row by row; other columns pass through, but those that carry the name of
a result are replaced; an empty table gives an empty table. A text of any length is judged whole.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelspark.llm.common import SPACE, whole, words

MIN_WORDS = 50             # a document with fewer words is rejected
MAX_REPEAT_PERCENT = 50    # share of its words in repeated three-word windows
MAX_LOST_PERCENT = 50      # share of its non-blank characters on removed lines
SYMBOLS = "[#*$%&|<>]"
SYMBOL_PERCENT = 30        # symbols per hundred words of a line
SHOUT_PERCENT = 30         # "!!" and "??" per hundred words of a line
BAR_PERCENT = 20           # stand-alone separators per hundred words of a line
SHORT_LINE = 8             # a line of fewer words needs a closing mark
CLOSING = r"""[.!?:;,"'”’)\]…]$"""
BOILERPLATE = ["all rights reserved", "cookie policy", "enable javascript", "licensed under",
               "privacy policy", "spdx-license-identifier", "subscribe to our newsletter", "terms of use"]
_ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "clean_text",
          "lost_chars", "kept", "_w", "_h", "_l"]


def _without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, F.lit(pattern), F.lit("")))


def _line_facts(line: Column) -> Column:
    return F.struct(line.alias("line"), words(line).alias("w"), F.lower(line).alias("low"))


def _line_fails(facts: Column) -> Column:
    """Whether a line with a word fails a punctuation, navigation or boilerplate rule."""
    line, n = facts["line"], F.size(facts["w"])
    symbols = F.length(line) - _without(line, SYMBOLS)
    shouts = (F.length(line) - _without(line, r"!!|\?\?")) / 2
    bars = F.size(F.filter(facts["w"], lambda w: w.isin("|", "·", "»", "›", ">")))
    boilerplate = F.contains(facts["low"], F.lit(BOILERPLATE[0]))
    for phrase in BOILERPLATE[1:]:
        boilerplate = boilerplate | F.contains(facts["low"], F.lit(phrase))
    return (n > 0) & ((100 * symbols > SYMBOL_PERCENT * n) | (100 * shouts > SHOUT_PERCENT * n)
                      | (100 * bars > BAR_PERCENT * n)
                      | ((n < SHORT_LINE) & ~F.rlike(F.rtrim(line), F.lit(CLOSING))) | boilerplate)


def _covered_words(windows: Column) -> Column:
    """Words inside windows that occur twice or more, from the window hashes in text order."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(ordered: Column) -> Column:
        return F.filter(ordered, lambda p, k: (F.get(ordered, k - 1)["h"] == p["h"])
                        | (F.get(ordered, k + 1)["h"] == p["h"]))

    def covered(at: Column) -> Column:
        new = F.transform(at, lambda p, k: F.coalesce(F.least(F.lit(3), p - F.get(at, k - 1)), F.lit(3)))
        return F.aggregate(new, F.lit(0), lambda total, x: total + x)

    # A one-element transform binds an array to a name, so that it is sorted once.
    hits = F.get(F.transform(F.array(placed), repeated), 0)
    at = F.sort_array(F.transform(hits, lambda p: p["i"]))
    return F.get(F.transform(F.array(at), covered), 0)


def quality_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every input row and column, with base counts, clean_text, lost_chars and the verdict kept.

    clean_text is the text without its failing lines, lost_chars counts the non-blank characters on
    them. kept is false when the base rules fail or lost_chars exceeds MAX_LOST_PERCENT of all.
    """
    body = whole(text)
    docs = docs.drop(*[c for c in _ADDED if c != text])
    step = docs.withColumns({"_w": words(text),
                             "_l": F.transform(F.split(body, "\n", -1), _line_facts)})
    step = step.withColumns({
        "_h": F.when(F.size("_w") > 2, F.slice(F.transform(
            "_w", lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2))), 1, F.size("_w") - 2)),
        "_l": F.transform("_l", lambda x: F.struct(x["line"].alias("line"), (F.size(x["w"]) > 0).alias("wordy"),
                                                   _line_fails(x).alias("fails")))})
    wordy = F.transform(F.filter("_l", lambda x: x["wordy"]), lambda x: x["line"])
    step = step.withColumns({
        "_n": F.size("_w").cast("long"), "_c": _without(body, SPACE).cast("long"),
        "_r": F.when(F.size("_h") > F.size(F.array_distinct("_h")), _covered_words(F.col("_h"))).otherwise(0),
        "_d": F.transform(F.array(wordy), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0],
        "_lost": F.aggregate(F.filter("_l", lambda x: x["fails"]), F.lit(0), lambda n, x: n + _without(x["line"], SPACE))})
    failed = (F.col("_n") < MIN_WORDS) | (100 * F.col("_r") > MAX_REPEAT_PERCENT * F.col("_n"))
    results = F.struct(
        F.col("_n").alias("n_words"), F.col("_c").alias("word_chars"),
        (F.length(body) - _without(body, SYMBOLS)).cast("long").alias("n_symbols"),
        F.col("_d").cast("long").alias("n_dup_lines"), F.col("_r").cast("long").alias("n_repeat_words"),
        failed.alias("base_failed"),
        F.array_join(F.transform(F.filter("_l", lambda x: ~x["fails"]), lambda x: x["line"]), "\n").alias("clean_text"),
        F.col("_lost").cast("long").alias("lost_chars"),
        (~failed & (100 * F.col("_lost") <= MAX_LOST_PERCENT * F.col("_c"))).alias("kept"))
    # A generator of one row: a filter on a result stays above it instead of repeating the work below.
    return step.select(*docs.columns, F.inline(F.array(results)))


def rules_stage(docs: DataFrame) -> DataFrame:
    """Kept documents, their failing lines removed, with exactly the columns of the input."""
    judged = quality_rules(docs.select(F.struct(*docs.columns).alias("_row"), "text")).where("kept")
    out = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return judged.select(*[out.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
