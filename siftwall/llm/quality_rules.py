"""Line-first cleaning of documents and rules over what is left."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that separate words (x20, x09 to x0D).
BLANKS = " \t\n\x0b\f\r"
#: Characters counted as symbols.
_SYMBOLS = "#*$%&|<>"
#: Phrases that mark a line as part of a page's frame rather than of its text.
BOILERPLATE = (
    "enable javascript",
    "accept all cookies",
    "we use cookies",
    "cookie policy",
    "privacy policy",
    "terms of use",
    "terms of service",
    "lorem ipsum",
    "sign up for our newsletter",
    "subscribe to our newsletter",
    "click here to",
    "back to top",
    "skip to content",
    "share on facebook",
    "add to cart",
)


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules and of the verdict on the document."""

    #: A line's separators per hundred words from which it counts as navigation.
    separators_pct: int = 30
    #: A line's symbols and marks of shouting per hundred characters that are too many.
    marks_pct: int = 10
    #: Words from which a line is judged on repetition, and its least distinct share.
    repeat_words: int = 12
    distinct_pct: int = 34
    #: Words up to which a line without the end of a sentence is a heading or a list item.
    open_words: int = 30
    #: Characters of a document that must survive, of a hundred.
    kept_pct: int = 50


def without(text: Column, characters: str) -> Column:
    """The text less some characters; one scan for each, which is cheap where there is none."""
    for character in characters:
        text = F.replace(text, F.lit(character), F.lit(""))
    return text


def number_of(text: Column, characters: str) -> Column:
    return F.char_length(text) - F.char_length(without(text, characters))


def split_words(text: Column) -> Column:
    """Words of a text; blanks become single spaces first, so that a plain split will do."""
    for blank in BLANKS[1:]:
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def _has_word(line: Column) -> Column:
    return F.ltrim(line, F.lit(BLANKS)) != ""


def line_fails(line: Column, rules: LineRules) -> Column:
    """Whether a line breaks a punctuation, navigation or boilerplate rule.

    Cheap tests stand before dear ones. A test on a one-element array binds what it looks
    at to a name, so that lower case and words are made once per line.
    """
    # punctuation: symbols and exclamation marks in bulk, or a long line without a sentence
    marks = number_of(line, _SYMBOLS + "!~^_=+")
    marked = (marks > 0) & (marks * 100 >= F.char_length(without(line, BLANKS)) * rules.marks_pct)
    closed = F.rlike(line, F.lit("[.!?:;…。！？؟।]([\"'”’»)\\]}]*)(\\s|$)"))
    bars = number_of(line, "|»›·•→")

    def phrased(lower: Column) -> Column:
        found = F.lit(False)
        for phrase in BOILERPLATE:
            found = found | F.contains(lower, F.lit(phrase))
        return found

    def worded(words: Column) -> Column:
        n = F.size(words)
        unclosed = (n > rules.open_words) & ~closed
        # the same few words over and over
        again = (n >= rules.repeat_words) & (
            F.size(F.array_distinct(words)) * 100 < n * rules.distinct_pct
        )
        # navigation: separators between single entries
        navigation = (bars >= 3) & (bars * 100 >= n * rules.separators_pct)
        return unclosed | again | navigation

    return (
        marked | F.exists(F.array(F.lower(line)), phrased) | F.exists(F.array(split_words(line)), worded)
    )


def _repeated_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur at least twice.

    A window is one number, its hash above its place, so that equal ones stand side by side
    once sorted; neighbours with the same hash bits are then compared by their words. Where
    any of these differ, and beyond 2^20 words, where places leave a hash few bits, whole
    hash, words and place are sorted instead, so the count is exact for any text. The cost grows as n log n with the text, and nothing leaves the row.
    """
    n = F.size(words)
    # the longer the text, the more bits its places take
    low = F.lit((1 << 20) - 1).cast("long")
    for bits in (16, 12, 8):
        low = F.when(n <= 1 << bits, F.lit((1 << bits) - 1).cast("long")).otherwise(low)

    def same(i: Column, j: Column) -> Column:
        equal = F.get(words, i) == F.get(words, j)
        for k in (1, 2):
            equal = equal & (F.get(words, i + k) == F.get(words, j + k))
        return equal

    def count(mask: Column) -> Column:
        numbers = F.transform(
            F.slice(words, 1, n - 2),
            lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))
            .bitwiseAND(F.bitwise_not(mask))
            .bitwiseOR(i.cast("long")),
        )

        def place(x: Column) -> Column:
            return x.bitwiseAND(mask).cast("int")

        def close(x: Column, y: Column) -> Column:
            return x.bitwiseXOR(y).bitwiseAND(F.bitwise_not(mask)) == 0

        def neighbours(ordered: Column, like) -> Column:
            def beside(x: Column, k: Column) -> Column:
                after = F.coalesce(like(x, F.get(ordered, k + 1)), F.lit(False))
                return after | ((k > 0) & like(x, F.get(ordered, k - 1)))

            return F.filter(ordered, beside)

        def repeated(near: Column) -> Column:
            def differs(x: Column, k: Column) -> Column:
                y = F.get(near, k + 1)
                return F.coalesce(close(x, y) & ~same(place(x), place(y)), F.lit(False))

            twice = neighbours(near, lambda x, y: close(x, y) & same(place(x), place(y)))
            places = F.transform(twice, place)
            found = F.concat(
                places, F.transform(places, lambda i: i + 1), F.transform(places, lambda i: i + 2)
            )
            # different windows with the same bits may stand between equal ones
            unsure = F.size(F.filter(near, differs)) > 0
            return F.when(unsure, F.lit(-1)).otherwise(F.size(F.array_distinct(found)))

        # one-element arrays bind what they hold to a name, so that it is made once
        near = F.transform(F.array(F.sort_array(numbers)), lambda o: neighbours(o, close))
        return F.get(F.transform(near, repeated), F.lit(0))

    def covered(ordered: Column) -> Column:
        def like(x: Column, y: Column) -> Column:
            return F.coalesce((x["h"] == y["h"]) & (x["w"] == y["w"]), F.lit(False))

        twice = F.filter(
            ordered,
            lambda x, k: like(x, F.get(ordered, k + 1)) | ((k > 0) & like(x, F.get(ordered, k - 1))),
        )
        places = F.transform(twice, lambda x: x["i"])
        return F.concat(places, F.transform(places, lambda i: i + 1), F.transform(places, lambda i: i + 2))

    def window(w: Column, i: Column) -> Column:
        three = F.array(w, F.get(words, i + 1), F.get(words, i + 2))
        return F.struct(
            F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), three.alias("w"), i.alias("i")
        )

    windows = F.sort_array(F.transform(F.slice(words, 1, n - 2), window))
    long = F.size(F.array_distinct(F.flatten(F.transform(F.array(windows), covered))))
    short = F.when(n <= 1 << 20, F.get(F.transform(F.array(low), count), F.lit(0))).otherwise(F.lit(-1))
    counted = F.get(
        F.transform(F.array(short), lambda c: F.when(c < 0, long).otherwise(c)), F.lit(0)
    )
    return F.when(n >= 4, counted).otherwise(F.lit(0)).cast("long")


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: LineRules | None = None,
) -> DataFrame:
    """One row per input row: counts, the cleaned text, and the verdict.

    Columns ``id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    n_lines, n_failed_lines, chars_left_pct, clean_text, kept``. Lines are judged first: those
    that break a rule are removed, and a document stays if it passes the base rules (at
    least 50 words, at most half of them in repeated 3-word windows) and keeps
    ``rules.kept_pct`` of its characters. Null text counts as empty; texts without words
    fail. Repeated rows give repeated results. One pass without a shuffle; a row's cost
    grows as n log n with its length.
    """
    rules = rules or LineRules()
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("t"))
    split = base.select(
        "id",
        "t",
        split_words(F.col("t")).alias("w"),
        F.filter(F.split("t", "\n"), _has_word).alias("l"),
    )
    counted = split.select(
        "id",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(without(F.col("t"), BLANKS)).cast("long").alias("word_chars"),
        number_of(F.col("t"), _SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("w")).alias("n_repeat_words"),
        F.size("l").cast("long").alias("n_lines"),
        F.filter("l", lambda x: ~line_fails(x, rules)).alias("good"),
    )
    cleaned = counted.select(
        "*",
        F.array_join("good", "\n").alias("clean_text"),
        (F.col("n_lines") - F.size("good")).alias("n_failed_lines"),
    ).withColumn(
        "chars_left_pct",
        F.when(
            F.col("word_chars") > 0,
            F.char_length(without(F.col("clean_text"), BLANKS)) * 100.0 / F.col("word_chars"),
        ).otherwise(F.lit(0.0)),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return cleaned.select(
        "id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        "n_lines",
        "n_failed_lines",
        "chars_left_pct",
        "clean_text",
        (~failed & (F.col("chars_left_pct") >= rules.kept_pct)).alias("kept"),
    )


def keep_good(docs: DataFrame, text_col: str = "text", rules: LineRules | None = None) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns and their text as it was."""
    whole = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    judged = quality_rules(whole, "row", "text", rules).select(
        "id", "kept", F.monotonically_increasing_id().alias("mark")
    )
    # a filter is not moved below a numbered projection; there, it would repeat all the work
    return judged.where("kept AND mark >= 0").select("id.*")
