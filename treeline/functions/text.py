"""Lines, trimming and other text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What ends a line besides a newline (a carriage return and a newline
# together end one line), and what counts as white space around one.
ALL_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
RETURN_ONLY = "\r"
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def split_lines(text: Column, breaks: str = ALL_BREAKS) -> Column:
    """The lines of a text; a final line break opens no further line, '' has none.

    Texts that only use newlines, nearly all of them, are split without a regular expression.
    """
    last = F.right(text, F.lit(1))
    body = (
        F.when(text.endswith("\r\n"), F.left(text, F.length(text) - 2))
        .when(last.isin("\n", *breaks), F.left(text, F.length(text) - 1))
        .otherwise(text)
    )
    plain = F.translate(F.replace(body, F.lit("\r\n"), F.lit("\n")), breaks, "\n" * len(breaks))
    unified = F.when(text.rlike(f"[{breaks}]"), plain).otherwise(body)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(unified, "\n"))


def with_lines(df: DataFrame, text: str = "text", breaks: str = ALL_BREAKS) -> DataFrame:
    """One row per line (`line_no` from 1, `line`) in place of the text column."""
    kept = [c for c in df.columns if c != text]
    return df.select(*kept, F.posexplode(split_lines(F.col(text), breaks)).alias("_i", "line")).select(
        *kept, (F.col("_i") + 1).alias("line_no"), "line"
    )


def strip(text: Column) -> Column:
    """Trim Unicode white space on both sides."""
    return F.btrim(text, F.lit(BLANKS))


def without_blanks(text: Column) -> Column:
    """Remove every white-space character."""
    return F.translate(text, BLANKS, "")


def count_of(text: Column, needle: Column | str) -> Column:
    """Non-overlapping occurrences of a literal substring (length+1 for an empty one)."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    removed = F.length(text) - F.length(F.replace(text, needle, F.lit("")))
    return F.when(needle == "", F.length(text) + 1).otherwise(
        F.try_divide(removed, F.length(needle)).cast("int")
    ).cast("int")
