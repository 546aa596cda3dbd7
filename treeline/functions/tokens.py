"""The two tokenizers: query/corpus tokens and name tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"
WORD_RUN = r"[A-Za-z0-9_]+"
CJK_RUN = r"[\u4e00-\u9fff]+"

# A digit run that starts no word is never part of an identifier. The cheap character
# test stands before the look-behind, so other characters are passed over quickly.
_LOOSE_DIGITS = r"[0-9](?<![A-Za-z0-9_][0-9])[0-9]*"
# Pieces of an identifier part: a capitalised or lower-case run, a capital run ending
# before another capital or at the part's end, or a whole part with neither.
_PIECE = (
    r"[a-z]+"
    r"|[A-Z](?:[a-z]+|[A-Z]*(?=[A-Z]|(?![A-Za-z0-9])))"
    r"|(?=[A-Z0-9])(?<![A-Za-z0-9])(?:[A-Z]?[0-9]+)+(?![A-Za-z0-9])"
)
_NAME_PIECE = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"


def cjk_bigrams(text: Column) -> Column:
    """Default segmentation of CJK runs: overlapping pairs, short runs whole."""
    pairs = F.transform(
        F.regexp_extract_all(text, F.lit(CJK_RUN), F.lit(0)),
        lambda run: F.when(F.length(run) <= 2, F.array(run)).otherwise(
            F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: run.substr(i, F.lit(2)))
        ),
    )
    return F.flatten(pairs)


def raw_pieces(text: Column) -> Column:
    """Latin tokens in their original case, in text order, repeats kept."""
    cleaned = F.regexp_replace(text, _LOOSE_DIGITS, " ")
    return F.regexp_extract_all(cleaned, F.lit(_PIECE), F.lit(0))


def mixed_pieces(text: Column, segment: Callable[[Column], Column] = cjk_bigrams) -> Column:
    """All tokens, Latin before CJK, not yet lower-cased."""
    return F.when(text.rlike(CJK_RUN), F.concat(raw_pieces(text), segment(text))).otherwise(raw_pieces(text))


def mixed_tokens(text: Column, segment: Callable[[Column], Column] = cjk_bigrams) -> Column:
    """Lower-cased query/corpus tokens, repeats kept."""
    return F.transform(mixed_pieces(text, segment), F.lower)


def name_tokens(name: Column) -> Column:
    """Distinct lower-case words of an identifier or path, in first-seen order, space-joined."""
    words = F.transform(
        F.filter(F.split(name, r"[_\-./]"), lambda part: part != ""),
        lambda part: F.when(
            part.rlike("[A-Za-z0-9]"), F.regexp_extract_all(part, F.lit(_NAME_PIECE), F.lit(0))
        ).otherwise(F.array(part)),
    )
    return F.coalesce(F.array_join(F.array_distinct(F.transform(F.flatten(words), F.lower)), " "), F.lit(""))


def identifiers(text: Column) -> Column:
    """Identifier-shaped runs of a text."""
    return F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0))


def word_runs(text: Column) -> Column:
    """Maximal runs of word characters."""
    return F.regexp_extract_all(text, F.lit(WORD_RUN), F.lit(0))


def cjk_fragments(text: Column, least: int = 2) -> Column:
    """CJK runs of at least `least` characters."""
    return F.filter(
        F.regexp_extract_all(text, F.lit(CJK_RUN), F.lit(0)), lambda run: F.length(run) >= least
    )
