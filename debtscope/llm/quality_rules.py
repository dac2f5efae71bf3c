"""Line-first cleaning: rules per line, then a verdict per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from debtscope.functions.rows import let
from debtscope.llm.shared import WHITE, beside, of_row, text_of, words_of

SYMBOL = r"[#*$%&|<>]"
#: Phrases of page furniture, matched in lower case anywhere in a line.
BOILERPLATE = (
    "accept all cookies",
    "all cookies on this site",
    "click here to",
    "enable javascript",
    "please enable cookies",
    "skip to content",
    "subscribe to our newsletter",
    "sign in to continue",
    "terms of use | privacy",
)


def repeated_words(words: Column, width: int = 8) -> Column:
    """Words inside windows of ``width`` words that the text holds twice or more.

    Windows are hashed and put in order inside the row; a text whose windows
    all differ stops after a distinct count.
    """
    windows = F.when(
        F.size(words) >= width,
        F.transform(F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda i: F.xxhash64(F.slice(words, i, width))),
    ).otherwise(F.array().cast("array<bigint>"))

    def starts(placed: Column) -> Column:
        again = F.filter(
            placed,
            lambda p, i: ((i > 0) & (F.get(placed, i - 1)["h"] == p["h"]))
            | ((i < F.size(placed) - 1) & (F.get(placed, i + 1)["h"] == p["h"])),
        )
        return F.sort_array(F.transform(again, lambda p: p["i"]))

    def covered(begins: Column) -> Column:
        return F.aggregate(
            F.transform(begins, lambda s, i: F.least(F.lit(width), F.coalesce(F.get(begins, i + 1) - s, F.lit(width)))),
            F.lit(0).cast("long"),
            lambda total, n: total + n,
        )

    def count(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            let(let(placed, starts), covered)
        )

    return let(windows, count)


def bad_line(line: Column) -> Column:
    """True for a line with words that fails a rule.

    Punctuation: no letter-bearing line may end without a closing mark when it
    is longer than 30 words, carry two doubled exclamation marks or more, or
    hold symbols for a tenth of its words or more. Navigation: three bars or more.
    Boilerplate: a fixed phrase of page furniture.
    """
    n = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    furniture = F.lit(False)
    for phrase in BOILERPLATE:
        furniture = furniture | F.lower(line).contains(phrase)
    return (
        (F.regexp_count(line, F.lit(r"!!")) >= 2)
        | (F.regexp_count(line, F.lit(SYMBOL + r"+")) * 10 >= F.greatest(n, F.lit(10)))
        | (F.regexp_count(line, F.lit(r"[|»›]")) >= 3)
        | ((n > 30) & ~F.btrim(line, F.lit(WHITE)).rlike(r"[.!?:;,…\"'”’»)\]]$"))
        | furniture
    )


def clean_lines(
    docs: DataFrame,
    text_col: str = "text",
    min_words: int = 20,
    max_repeat_percent: int = 30,
    max_lost: float = 0.3,
) -> DataFrame:
    """Measure each document, take out failing lines and judge what is left.

    Adds ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``n_bad_lines`` (long), ``lost`` (share of the code
    points of lines with words that failing lines hold), ``base_failed``,
    ``kept`` and ``clean_text``; input columns of these names are replaced.
    The base test asks for ``min_words`` words and at most
    ``max_repeat_percent`` of them in repeated windows; ``kept`` also asks
    that ``lost`` is at most ``max_lost``.

    Everything happens inside the row: no shuffle. A null or empty text has no
    words, fails the base test and has an empty ``clean_text``.
    """
    text = text_of(text_col)
    of_words = let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n"),
            F.length(F.array_join(w, "")).cast("long").alias("chars"),
            repeated_words(w).alias("repeats"),
        ),
    )

    def judged(lines: Column) -> Column:
        full = F.filter(lines, lambda x: F.btrim(x, F.lit(WHITE)) != "")
        return let(
            F.transform(full, lambda x: F.struct(x.alias("x"), bad_line(x).alias("bad"))),
            lambda y: F.struct(
                (F.size(y) - F.size(F.array_distinct(F.transform(y, lambda z: z["x"])))).cast("long").alias("dups"),
                F.size(F.filter(y, lambda z: z["bad"])).cast("long").alias("bad"),
                _chars(F.filter(y, lambda z: z["bad"])).alias("bad_chars"),
                _chars(y).alias("chars"),
            ),
        )

    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bad_lines", "lost", "base_failed", "kept", "clean_text")
    measured = beside(docs, added, text=text, w=of_words, l=let(F.split(text, "\n"), judged))
    text = F.col("text")
    lost = F.when(F.col("l.chars") > 0, F.col("l.bad_chars") / F.col("l.chars")).otherwise(F.lit(0.0))
    failed = (F.col("w.n") < min_words) | (F.col("w.repeats") * 100 > F.col("w.n") * max_repeat_percent)
    stays = F.filter(F.split(text, "\n"), lambda x: (F.btrim(x, F.lit(WHITE)) == "") | ~bad_line(x))
    names = {
        "n_words": F.col("w.n"),
        "word_chars": F.col("w.chars"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOL)).cast("long"),
        "n_dup_lines": F.col("l.dups"),
        "n_repeat_words": F.col("w.repeats"),
        "n_bad_lines": F.col("l.bad"),
        "lost": lost,
        "base_failed": failed,
        "kept": ~failed & (lost <= max_lost),
        "clean_text": F.when(F.col("l.bad") == 0, text).otherwise(F.array_join(stays, "\n")),
    }
    return measured.select(*of_row(docs, added), *[value.alias(name) for name, value in names.items()])


def _chars(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0).cast("long"), lambda total, z: total + F.length(z["x"]))
