"""Answer normalisation, number parsing and equivalence."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column, functions as F

from gradeframe.functions.text import DIGIT, WHITESPACE, ColumnLike, as_column, strip

# Fixed values of the normal form.
# Behind the bar: an opening that is no fraction, stepped over up to its brace.
FRACTION_MARKUP = r"frac\{([^}]++)\}\{([^}]++)\}|(frac\{[^}]++(?:\}|\z))"
DIGIT_COMMA = rf"({DIGIT}),({DIGIT})"
# Up to three wrapping pairs of parentheses, outermost count first.
WRAPPING = r"^\(\(\((.*)\)\)\)$|^\(\((.*)\)\)$|^\((.*)\)$"
# Plain numbers, fractions and words, which none of the rules changes.
NORMAL_ALREADY = r"^[-a-z0-9]++(?:[./][-a-z0-9]++)*+\z"
CLOSING_PUNCTUATION = "。．.!！；;，,"

TOLERANCE = 1e-6

# Grammar of a float literal in lower case, as a conversion from text accepts it.
_DIGITS = rf"{DIGIT}++(?:_{DIGIT}++)*+"
FLOAT = (
    rf"[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?"
    r"|inf(?:inity)?|nan)"
)
# A number, a fraction of two numbers, or a percentage. The look at the first
# character turns most words away without trying the grammar.
NUMERIC = rf"^(?=[+\-.in{DIGIT}]){FLOAT}(?:/{FLOAT}|%)?$"
# Spellings that a plain cast to double would not take.
UNUSUAL = r"[^\x00-\x7f]|_|nan"

# Decimal digits of other scripts and their values, from the character database.
_FOREIGN_DIGITS = "".join(
    chr(i) for i in range(128, sys.maxunicode + 1) if unicodedata.category(chr(i)) == "Nd")
_FOREIGN_VALUES = "".join(str(unicodedata.decimal(c)) for c in _FOREIGN_DIGITS)


# Code points that Unicode reserves for use inside a program.
_OPEN, _BAR, _CLOSE = "\ufdd0", "\ufdd1", "\ufdd2"


def _rewrite_fractions(text: Column) -> Column:
    """``frac{a}{b}`` to ``a/b``, and drop dollar signs.

    One replacement serves both alternatives of the pattern; a stepped-over
    opening is recognised by its empty numerator and denominator.
    """
    marked = F.regexp_replace(text, FRACTION_MARKUP, f"{_OPEN}$1{_BAR}$2{_CLOSE}$3")
    restored = F.replace(marked, F.lit(_OPEN + _BAR + _CLOSE), F.lit(""))
    return F.translate(restored, _BAR + "$" + _OPEN + _CLOSE, "/")


def normalize_answer(answer: ColumnLike) -> Column:
    """Comparison form of an answer; NULL becomes ''.

    The answer is named twice; pass a column, not a long expression.
    """
    given = F.coalesce(as_column(answer).cast("string"), F.lit(""))
    return F.when(F.rlike(given, F.lit(NORMAL_ALREADY)), given).otherwise(_normalize(given))


def _normalize(text: Column) -> Column:
    text = F.lower(strip(text))
    text = F.translate(text, WHITESPACE + "\\", "")
    text = _rewrite_fractions(text)
    text = F.regexp_replace(text, DIGIT_COMMA, "$1$2")
    text = F.ltrim(text, F.lit("="))
    text = F.regexp_replace(text, WRAPPING, "$1$2$3")
    return F.rtrim(text, F.lit(CLOSING_PUNCTUATION))


def numeric_text(text: ColumnLike) -> Column:
    """Castable spelling of a text in normal form, NULL if it is no number."""
    text = as_column(text)
    # The underscore has no counterpart in the values, so it is dropped.
    plain = F.translate(text, _FOREIGN_DIGITS + "_", _FOREIGN_VALUES)
    usual = F.regexp_replace(plain, "[+-]nan", "nan")
    return F.when(F.rlike(text, F.lit(NUMERIC)),
                  F.when(F.rlike(text, F.lit(UNUSUAL)), usual).otherwise(text))


def numeric_value(text: ColumnLike) -> Column:
    """Value of a ``numeric_text``: a/b (NULL for b = 0), a% or plain."""
    text = as_column(text)
    ratio = F.try_divide(F.substring_index(text, "/", 1).try_cast("double"),
                         F.substring_index(text, "/", -1).try_cast("double"))
    return (F.when(F.contains(text, F.lit("/")), ratio)
            .when(F.endswith(text, F.lit("%")),
                  F.rtrim(text, F.lit("%")).try_cast("double") / 100)
            .otherwise(text.try_cast("double")))


def verdict(pred: ColumnLike, gold: ColumnLike, pred_number: ColumnLike, gold_number: ColumnLike,
            strict: bool = False) -> Column:
    """Equivalence from normal forms and their numbers.

    Equal text wins; two numbers decide on their distance; otherwise a
    non-empty gold answer inside the prediction counts, unless ``strict``.
    """
    pred, gold = as_column(pred), as_column(gold)
    a, b = as_column(pred_number), as_column(gold_number)
    contained = F.lit(False) if strict else (gold != "") & F.contains(pred, gold)
    # inf - inf and nan give NaN, which Spark orders above every number.
    close = F.abs(a - b) < TOLERANCE
    return (F.when(pred == gold, F.lit(True))
            .when(a.isNotNull() & b.isNotNull(), close)
            .otherwise(contained))
