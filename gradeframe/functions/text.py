"""Small text helpers shared by all extraction and comparison expressions.

Everything here is a ``Column`` built from built-in functions, so it stays in
the JVM and inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ColumnLike = Column | str

# The characters Python's ``str.strip`` and ``\s`` treat as white space. Spark's
# ``trim`` without a character set only knows the plain space.
WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())

# Line boundaries of ``str.splitlines`` other than the line feed.
SOFT_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def char_class(chars: str, negate: bool = False) -> str:
    """A Java regex class holding exactly the given characters."""
    body = "".join(f"\\x{{{ord(c):x}}}" for c in chars)
    return f"[{'^' if negate else ''}{body}]"


SPACE = char_class(WHITESPACE)
NON_SPACE = char_class(WHITESPACE, negate=True)
DIGIT = r"\p{Nd}"
ALNUM = r"[\p{L}\p{N}]"
WORD = r"[\p{L}\p{N}_]"


def as_column(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(text: ColumnLike) -> Column:
    return F.btrim(as_column(text), F.lit(WHITESPACE))


def blank_to_null(text: ColumnLike) -> Column:
    """Turn '' into NULL while naming its argument once.

    ``nullif`` would evaluate a regex chain twice when it sits in a later branch
    of a ``coalesce``.
    """
    return F.try_element_at(F.array_remove(F.array(as_column(text)), F.lit("")), F.lit(1))


def last_match(text: ColumnLike, pattern: str, group: int = 1) -> Column:
    """Last of all non-overlapping matches, NULL if there is none."""
    matches = F.regexp_extract_all(as_column(text), F.lit(pattern), F.lit(group))
    return F.try_element_at(matches, F.lit(-1))


def last_found(text: ColumnLike, pattern: str) -> Column:
    """Last match in which group 1 took part, NULL if there is none.

    For patterns whose further alternatives only step over text that cannot
    match, so that no stretch of a degenerate text is scanned again and again.
    """
    groups = F.regexp_extract_all(as_column(text), F.lit(pattern), F.lit(1))
    return F.try_element_at(F.array_remove(groups, F.lit("")), F.lit(-1))
