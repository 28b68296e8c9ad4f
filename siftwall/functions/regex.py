"""Regular-expression capture that runs a pattern once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Joins captured groups before they are split again; a Unicode noncharacter.
_MARK = "￿"


def bind(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add ``value`` as a column that later steps refer to but never re-evaluate.

    Catalyst moves filters below a plain projection and inlines the expression for
    every use, which would run a regular expression again for each parsed field. It
    does not look through the generator used here.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def capture(text: Column, pattern: str, groups: int) -> Column:
    """The leftmost match of ``pattern`` as an array of strings.

    Position 0 holds the text before the match, 1..n its groups, ``""`` for a group
    that took no part. Without a match the array has one element, see ``matched``.

    One ``regexp_extract`` per group would run the pattern once per group. Here the
    match is replaced by its marked groups in one go and the line is split at the
    marks; what follows the first n groups (the rest of the line, further matches) is
    not looked at. Lines that already hold the mark take the group-by-group way.
    """
    marked = "".join(f"{_MARK}${g}" for g in range(1, groups + 1)) + _MARK
    fast = F.split(F.regexp_replace(text, pattern, marked), _MARK)
    numbers = F.sequence(F.lit(1), F.lit(groups))
    extracted = F.transform(
        numbers, lambda g: F.call_function("regexp_extract", text, F.lit(pattern), g)
    )
    before = F.slice(F.split(text, pattern, 2), 1, 1)
    return (
        F.when(~F.contains(text, F.lit(_MARK)), fast)
        .when(F.rlike(text, F.lit(pattern)), F.concat(before, extracted))
        .otherwise(F.array(text))
    )


def matched(fields: Column) -> Column:
    """Whether ``capture`` found its pattern; false for a null text."""
    return F.coalesce(F.size(fields), F.lit(0)) > 1


# The characters that count as white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove white space, in the Unicode sense, from both ends."""
    return F.trim(text, F.lit(WHITE_SPACE))
