"""Short-answer extraction from free text.

The cascade tries a boxed answer, a LaTeX fraction, an answer marker, the last
number and finally the last line. ``coalesce`` evaluates lazily, so a row pays
only for the rules up to the one that fires. Substring tests, which are byte
scans, spare most texts the regex passes that cannot match.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gradeframe.functions.text import (
    DIGIT, SOFT_BREAKS, SPACE, WHITESPACE, ColumnLike, as_column, blank_to_null, char_class,
    last_found, last_match, strip,
)

# The patterns and the punctuation that define the answers.
# Behind the bar: openings that never close or go on, which are stepped over.
BOXED = r"\\boxed\{([^}]++)\}|\\boxed\{[^}]++\z"
LATEX_FRACTION = r"(\\frac\{[^}]++\}\{[^}]++\})|\\frac\{[^}]++(?:\}|\z)"
# A marker takes the rest of its line; the answer ends at the first soft break.
# A lone soft break is a blank answer, which hands over to the next marker.
_REST_OF_LINE = (rf"{SPACE}*({char_class(SOFT_BREAKS + chr(10), negate=True)}+"
                 rf"|{char_class(SOFT_BREAKS)}).*")
ANSWER_MARKERS = (
    rf"(?iud)Answer:{_REST_OF_LINE}",
    rf"(?iud)答案[:：]{_REST_OF_LINE}",
    rf"(?iud)final answer is:?{_REST_OF_LINE}",
    rf"(?iud)最终答案[:：是]{_REST_OF_LINE}",
)
TRAILING_PUNCTUATION = "。.!！；;，,"

# Pieces of a text for counting braces: box openings, braces, and what lies between.
BRACE_PIECES = r"\\boxed\{|[{}]|[^{}\\]++|\\"

# Possessive digits: a run of digits is never entered in its middle, so the
# scan is linear even on very long runs.
FRACTION_NUMBER = rf"(?:-|(?<!{DIGIT})){DIGIT}++/{DIGIT}++"
DECIMAL_NUMBER = rf"(?<!{DIGIT})-?{DIGIT}++\.{DIGIT}++"
INTEGER_NUMBER = rf"(?<!{DIGIT})-?{DIGIT}++(?!\.)"

STRATEGIES = ("boxed", "fraction", "marker", "number", "last_line")


def _balanced_box(text: Column) -> Column:
    """Content of the last box that closes and lies in no other closed box, of any depth.

    One pass over the pieces keeps the places of open braces; places of plain
    braces are negative. A box closes after all boxes in it, so the last one to
    close is the one wanted.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("open"),
                     F.lit(None).cast("int").alias("begin"), F.lit(None).cast("int").alias("end"))

    def step(state: Column, piece: Column) -> Column:
        after = state["at"] + F.length(piece)
        depth = F.size(state["open"])
        top = F.try_element_at(state["open"], F.lit(-1))
        boxed = (piece == "}") & F.coalesce((top >= 0) & (state["at"] > top), F.lit(False))
        opened = (F.when(piece == "{", F.array_append(state["open"], F.lit(-1)))
                  .when(F.startswith(piece, F.lit("\\boxed{")), F.array_append(state["open"], after))
                  .when((piece == "}") & (depth > 0), F.slice(state["open"], F.lit(1), depth - 1))
                  .otherwise(state["open"]))
        return F.struct(after.alias("at"), opened.alias("open"),
                        F.when(boxed, top).otherwise(state["begin"]).alias("begin"),
                        F.when(boxed, state["at"]).otherwise(state["end"]).alias("end"))

    pieces = F.regexp_extract_all(text, F.lit(BRACE_PIECES), F.lit(0))
    place = F.aggregate(pieces, start, step, lambda s: F.struct(s["begin"], s["end"]))
    return F.transform(F.array(place), lambda s: F.substring(
        text, s["begin"] + 1, s["end"] - s["begin"]))[0]


def boxed_answer(text: ColumnLike, balanced: bool = False) -> Column:
    """Content of the last box. ``balanced`` keeps nested braces together, however deep."""
    text = as_column(text)
    found = _balanced_box(text) if balanced else last_found(text, BOXED)
    return strip(F.when(F.contains(text, F.lit("\\boxed{")), found))


def latex_fraction(text: ColumnLike) -> Column:
    text = as_column(text)
    return F.when(F.contains(text, F.lit("\\frac{")), last_found(text, LATEX_FRACTION))


def strip_trailing_punctuation(text: ColumnLike) -> Column:
    return strip(F.rtrim(strip(text), F.lit(TRAILING_PUNCTUATION)))


def _marked(text: ColumnLike, pattern: str) -> Column:
    return blank_to_null(strip_trailing_punctuation(last_match(text, pattern)))


def marked_answer(text: ColumnLike) -> Column:
    """Rest of the line behind the last answer marker, by marker priority."""
    english, chinese, final_english, final_chinese = ANSWER_MARKERS
    text = as_column(text)
    has_chinese = F.contains(text, F.lit("答案"))
    return F.coalesce(
        _marked(text, english),
        F.when(has_chinese, _marked(text, chinese)),
        _marked(text, final_english),
        F.when(has_chinese, _marked(text, final_chinese)),
    )


def last_number(text: ColumnLike) -> Column:
    """Last fraction, else last decimal, else last integer not before a full stop."""
    text = as_column(text)
    return F.coalesce(
        F.when(F.contains(text, F.lit("/")), last_match(text, FRACTION_NUMBER, 0)),
        F.when(F.contains(text, F.lit(".")), last_match(text, DECIMAL_NUMBER, 0)),
        last_match(text, INTEGER_NUMBER, 0),
    )


def last_line(text: ColumnLike) -> Column:
    """Last non-empty line, '' for a blank text."""
    stripped = F.rtrim(as_column(text), F.lit(WHITESPACE))
    return strip(F.substring_index(stripped, "\n", -1))


def extract_answer(text: ColumnLike, balanced: bool = False) -> Column:
    """The full cascade; NULL only for a NULL text."""
    return F.coalesce(
        blank_to_null(boxed_answer(text, balanced)),
        latex_fraction(text),
        marked_answer(text),
        last_number(text),
        last_line(text),
    )
