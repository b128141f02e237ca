"""Line-first cleaning: lines that fail a rule go, then documents that lost too much of their text.

All of it is built-in functions on one row, so a document never leaves the task that read it and a hot
source or a group of copies needs no care: there is no shuffle.

Rules per line (a line without a word is neither judged nor counted):

* punctuation: it must end in a terminal mark (closing marks and blanks may follow, up to eight characters in
  all), and decorative marks in a row may come with one word in four at most;
* navigation: so may menu separators;
* boilerplate: no fixed phrase of page furniture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, fresh

# fixed values: phrases of page furniture, matched case-insensitively
BOILERPLATE = (
    "cookie policy",
    "accept cookies",
    "enable javascript",
    "javascript is disabled",
    "privacy policy",
    "terms of use",
    "terms of service",
    "all rights reserved",
    "click here",
    "read more",
    "sign up for",
    "log in to",
    "subscribe to our",
    "share this",
    "skip to content",
    "back to top",
    "lorem ipsum",
)
# fixed values: marks that may end a sentence, and marks that may follow them
TERMINAL = ".!?…。！？"
CLOSING = "\"')\\]»”’"
# menu separators, and the same decorative mark twice or more
FURNITURE = r"[|»›·•]|([!#$%&*+/<=>?@^_~\\-])\1+"


def line_passes(line: Column, words_per_mark: int = 4) -> Column:
    """True if a line with words passes the rules. Two or more furniture marks may stand in a line only if there
    are ``words_per_mark`` words to each of them: that is the punctuation rule for symbols, and the navigation rule."""
    marks = F.regexp_count(line, F.lit(FURNITURE))
    return (
        F.rlike(F.substring(line, -8, 8), F.lit(f"[{TERMINAL}][{CLOSING}]*\\s*$"))
        & ((marks < 2) | (marks * words_per_mark <= F.regexp_count(line, F.lit(SPACE)) + 1))
        & ~F.rlike(line, F.lit(r"(?i)\b(?:" + "|".join(BOILERPLATE) + r")\b"))
    )


def judge_lines(
    df: DataFrame,
    text: str = "text",
    result: str = "quality",
    max_lost_share: float = 0.5,
    min_words: int = 50,
    max_repeat_percent: int = 50,
) -> DataFrame:
    """Adds a struct column ``result`` (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    n_lines, n_failed_lines, lost_chars, kept, clean_text) and keeps every other column.

    ``kept`` is false if the base rules fail or if lines with more than ``max_lost_share`` of the characters of
    all lines fail. ``clean_text`` holds the lines that pass, and the lines without words as they are. A null text
    counts as an empty one: no words, base_failed. Texts of any length are judged whole; repeated rows and rows
    with equal keys are judged one by one. An existing column named ``result`` is an error.
    """
    if result.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column {result} exists")
    t, words, hashes, windows, places, marked, found = fresh(
        df, "_t", "_words", "_hashes", "_windows", "_places", "_marked", "_found"
    )
    c = F.col
    out = df.withColumn(t, F.coalesce(c(text), F.lit("")))
    out = out.withColumn(words, F.array_remove(F.split(c(t), SPACE), ""))
    # three-word windows as 64-bit hashes; only texts that repeat one are sorted with the positions
    out = out.withColumn(
        hashes,
        F.when(
            F.size(words) > 2,
            F.transform(
                F.sequence(F.lit(0), F.size(words) - 3),
                lambda i: F.xxhash64(F.get(c(words), i), F.get(c(words), i + 1), F.get(c(words), i + 2)),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    out = out.withColumn(
        windows,
        F.when(
            F.size(F.array_distinct(c(hashes))) < F.size(c(hashes)),
            F.sort_array(F.transform(c(hashes), lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    out = out.withColumn(
        places,
        F.sort_array(
            F.transform(
                F.filter(
                    c(windows),
                    lambda w, i: F.coalesce(w["h"] == F.get(c(windows), i - 1)["h"], F.lit(False))
                    | F.coalesce(w["h"] == F.get(c(windows), i + 1)["h"], F.lit(False)),
                ),
                lambda w: w["i"],
            )
        ),
    )
    judge = lambda x: F.struct(
        x.alias("line"),
        F.rlike(x, F.lit(WORD)).alias("judged"),
        (~F.rlike(x, F.lit(WORD)) | line_passes(x)).alias("ok"),
    )
    out = out.withColumn(marked, F.transform(F.split(c(t), "\n"), judge))
    covered = F.aggregate(
        c(places),
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    chars = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + F.length(x["line"]))
    judged = F.filter(c(marked), lambda x: x["judged"])
    failed = F.filter(c(marked), lambda x: ~x["ok"])
    lines = F.transform(judged, lambda x: x["line"])
    n_words, n_repeat = F.size(words).cast("long"), F.coalesce(covered, F.lit(0).cast("long"))
    base = F.struct(
        n_words.alias("n_words"),
        F.length(F.array_join(c(words), "")).cast("long").alias("word_chars"),
        F.regexp_count(c(t), F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        n_repeat.alias("n_repeat_words"),
        ((n_words < min_words) | (100 * n_repeat > max_repeat_percent * n_words)).alias("base_failed"),
        F.size(judged).alias("n_lines"),
        F.size(failed).alias("n_failed_lines"),
        chars(failed).alias("lost_chars"),
        chars(judged).alias("all_chars"),
        F.array_join(
            F.transform(F.filter(c(marked), lambda x: x["ok"]), lambda x: x["line"]), "\n"
        ).alias("clean_text"),
    )
    out = out.withColumn(found, base)
    b = c(found)
    return out.select(
        *[df[x] for x in df.columns],
        F.struct(
            *[
                b[x].alias(x)
                for x in (
                    "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed n_lines n_failed_lines lost_chars"
                ).split()
            ],
            # the id keeps a filter on the result above this projection: pushed below, it would have every step
            # above computed again inside the others, for each word
            (
                ~b["base_failed"]
                & (b["lost_chars"] <= b["all_chars"] * F.lit(max_lost_share))
                & (F.monotonically_increasing_id() >= 0)
            ).alias("kept"),
            b["clean_text"].alias("clean_text"),
        ).alias(result),
    )


def keep_clean(df: DataFrame, text: str = "text", **limits) -> DataFrame:
    """Rows whose document is kept, with the failing lines taken out of the text; same columns, same order."""
    (result,) = fresh(df, "_quality")
    judged = judge_lines(df, text, result, **limits).where(F.col(result)["kept"])
    return judged.withColumn(text, F.col(result)["clean_text"]).select(*df.columns)
