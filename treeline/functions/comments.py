"""Comment regions of whole texts, without a per-line state machine.

A text is cut by one regular expression into code gaps and comments. Marks set
before the cut tell how many directives start in each piece, so the question
"does this directive start inside a comment" needs no character offsets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from treeline.functions.text import split_lines

C_COMMENT = r"(?s)//[^\n]*|/\*.*?(?:\*/|\z)"
HASH_COMMENT = r"#[^\n]*"
# Blanks that can stand inside one line, and the characters that end it.
_INLINE = r"[\t \x1f\xa0\u1680\u2000-\u200a\u202f\u205f\u3000]*"
_STOP = r"\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
INCLUDE = rf'#{_INLINE}include{_INLINE}(?:<([^>{_STOP}]+)>|"([^"{_STOP}]+)")'
_MARK = "\x02"
_CUT = "\x03"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _marks(piece: Column) -> Column:
    return F.length(piece) - F.length(F.replace(piece, F.lit(_MARK), F.lit("")))


def includes_of(text: Column) -> Column:
    """Include directives of a text: array<struct<line, raw, target, commented>>, text order."""
    marked = F.array_join(
        F.transform(
            split_lines(text),
            lambda line: F.regexp_replace(F.translate(line, _MARK, "\x01"), INCLUDE, _MARK + "$0"),
        ),
        "\n",
    )
    flags = F.flatten(
        F.zip_with(
            F.split(marked, C_COMMENT, -1),
            _all(marked, C_COMMENT),
            lambda gap, comment: F.concat(
                F.array_repeat(F.lit(False), _marks(gap)),
                F.array_repeat(F.lit(True), F.coalesce(_marks(comment), F.lit(0))),
            ),
        )
    )
    found = F.flatten(
        F.transform(
            split_lines(text),
            lambda line, i: F.transform(
                _all(line, INCLUDE), lambda raw: F.struct((i + 1).alias("line"), raw.alias("raw"))
            ),
        )
    )
    return F.zip_with(
        found,
        flags,
        lambda hit, commented: F.struct(
            hit["line"].alias("line"),
            hit["raw"].alias("raw"),
            F.concat(
                F.regexp_extract(hit["raw"], INCLUDE, 1), F.regexp_extract(hit["raw"], INCLUDE, 2)
            ).alias("target"),
            commented.alias("commented"),
        ),
    )


def _body(note: Column) -> Column:
    """A comment without its markers."""
    return (
        F.when(note.startswith("/*"), F.regexp_replace(note.substr(F.lit(3), F.length(note)), r"\*/\z", ""))
        .when(note.startswith("//"), note.substr(F.lit(3), F.length(note)))
        .otherwise(note.substr(F.lit(2), F.length(note)))
    )


def comment_slices(text: Column, comment: str = C_COMMENT) -> Column:
    """Comment text per line: one array of slices for every line of the text."""
    joined = F.array_join(
        F.transform(split_lines(text), lambda line: F.translate(line, _CUT, "\x01")), "\n"
    )
    pieces = F.zip_with(
        F.split(joined, comment, -1),
        _all(joined, comment),
        lambda gap, note: F.concat(
            F.regexp_replace(gap, r"[^\n]+", ""),
            F.coalesce(
                F.concat(F.lit(_CUT), F.replace(_body(note), F.lit("\n"), F.lit("\n" + _CUT))), F.lit("")
            ),
        ),
    )
    return F.transform(F.split(F.array_join(pieces, ""), "\n", -1), lambda row: F.split(row, _CUT, -1))


def line_fragments(
    text: Column, fragments: Callable[[Column], Column], comment: str = C_COMMENT
) -> Column:
    """Per line, the fragments of its comment slices; a slice holding a quote is dropped whole."""
    return F.transform(
        comment_slices(text, comment),
        lambda row: F.flatten(
            F.transform(F.filter(row, lambda part: ~part.rlike("[\"']")), fragments)
        ),
    )
