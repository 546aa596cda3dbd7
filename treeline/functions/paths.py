"""Path columns: normalising, names, ancestors and globs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from treeline.functions.text import strip


def posix(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def clean_prefix(path: Column) -> Column:
    """A module path as used for matching: forward slashes, no blanks or slashes around it."""
    return F.btrim(strip(posix(path)), F.lit("/"))


def base_name(path: Column) -> Column:
    """Last segment; trailing slashes do not count, '' stays ''."""
    return F.substring_index(F.rtrim(posix(path), F.lit("/")), "/", -1)


def suffix(path: Column) -> Column:
    """Lower-case file suffix with its dot, '' for none (a leading dot opens no suffix)."""
    return F.lower(F.regexp_extract(base_name(path), r"[^.].*?(\.[^.]+)\z", 1))


def ancestors(path: Column, include_self: bool = True) -> Column:
    """Every path prefix that ends on a segment boundary, shortest first."""
    parts = F.split(path, "/")
    last = F.size(parts) if include_self else F.size(parts) - 1
    return F.when(last >= 1, F.transform(
        F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )).otherwise(F.array().cast("array<string>"))


def in_skipped_directory(path: Column, names: tuple[str, ...]) -> Column:
    joined = "|".join(re.escape(n) for n in names)
    return path.rlike(rf"(?:^|/)(?:{joined})/")


def is_safe(path: Column) -> Column:
    """True for a relative path that cannot leave the workspace."""
    cleaned = posix(strip(path))
    depth = F.aggregate(
        F.filter(F.split(cleaned, "/"), lambda part: (part != "") & (part != ".")),
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("low")),
        lambda acc, part: F.struct(
            (acc["now"] + F.when(part == "..", -1).otherwise(1)).alias("now"),
            F.least(acc["low"], acc["now"] + F.when(part == "..", -1).otherwise(1)).alias("low"),
        ),
        lambda acc: acc["low"],
    )
    return (cleaned != "") & ~cleaned.startswith("/") & (depth >= 0)


def is_safe_path(path: str) -> bool:
    """The same of one path that the driver holds, without a job."""
    depth = 0
    cleaned = path.strip(" \t\n\r\f\v\u00a0").replace("\\", "/")
    for part in cleaned.split("/"):
        depth += {"": 0, ".": 0, "..": -1}.get(part, 1)
        if depth < 0:
            return False
    return cleaned != "" and not cleaned.startswith("/")


_GLOB_REGEX = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}


def glob_regex(pattern: str) -> str:
    """Whole-path regular expression of a glob: '*' stays in a segment, '**' crosses segments."""
    cut = re.split(r"(\*\*/|\*\*|\*|\?)", pattern)
    return "^" + "".join(_GLOB_REGEX.get(piece) or re.escape(piece) for piece in cut) + "$"


def name_regex(pattern: str) -> str:
    """Regular expression of a file-name pattern (`*`, `?`, `[..]`), case-sensitive."""
    cut = re.split(r"(\*|\?|\[!?\]?[^\]]*\])", pattern)
    out = []
    for piece in cut:
        if piece == "*":
            out.append(".*")
        elif piece == "?":
            out.append(".")
        elif piece.startswith("[") and piece.endswith("]") and len(piece) > 2:
            inner = piece[1:-1].replace("\\", "\\\\")
            out.append("[^" + inner[1:] + "]" if inner.startswith("!") else "[" + inner + "]")
        else:
            out.append(re.escape(piece))
    return r"(?s)\A" + "".join(out) + r"\z"


def matches_glob(path: Column, pattern: str) -> Column:
    return path.rlike(glob_regex(pattern))


def matches_name(path: Column, pattern: str) -> Column:
    return base_name(path).rlike(name_regex(pattern))
