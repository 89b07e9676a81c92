"""Choice-letter extraction for multiple-choice answers."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from gradeframe.functions.text import (
    ALNUM, NON_SPACE, WHITESPACE, WORD, ColumnLike, as_column, char_class,
)

DEFAULT_LABELS = ("A", "B", "C", "D", "E")

# Phrases that introduce a letter, in order of trust. Gaps are
# possessive, because nothing that may follow a gap is part of one. Spellings that
# differ in the first letter share an alternative, which is measurably faster.
_GAP = char_class(WHITESPACE + ":") + "*+"
PHRASES = (
    rf"(?:[aA]nswer|ANSWER){_GAP}(?:(?:is|IS){_GAP})?\(?([A-E])",
    rf"(?:[cC]orrect|CORRECT){_GAP}(?:(?:answer|option|choice){_GAP})?\(?([A-E])",
    rf"(?:[oO]ption|OPTION|[cC]hoice|CHOICE){_GAP}\(?([A-E])",
    r"\(([A-E])\)",
    r"\[([A-E])\]",
)

# Words of which a text has one if the phrase can match; byte scans for them spare most texts the patterns.
_SIGNS = (("nswer", "ANSWER"), ("orrect", "CORRECT"), ("ption", "OPTION", "hoice", "CHOICE"), ("(",), ("[",))

# First character of each line when a non-alphanumeric or the line end follows.
_LINE_SPACE = char_class(WHITESPACE.replace("\n", ""))
LINE_LEAD = rf"(?md)^{_LINE_SPACE}*+({NON_SPACE})(?!{ALNUM})"


def default_labels() -> Column:
    return F.array(*[F.lit(c) for c in DEFAULT_LABELS])


def _first_common(candidates: Column, allowed: Column) -> Column:
    return F.try_element_at(F.array_intersect(candidates, allowed), F.lit(1))


def _if_label(letter: Column, labels: Column) -> Column:
    """The letter if it is a label, else NULL, naming the letter once."""
    return F.get(labels, (F.array_position(labels, letter) - 1).cast("int"))


def phrase_choice(text: ColumnLike, labels: Column) -> Column:
    """Letter of the first phrase whose first match names a valid label."""
    text = as_column(text)

    def guarded(pattern: str, signs: tuple[str, ...]) -> Column:
        there = reduce(or_, [F.contains(text, F.lit(sign)) for sign in signs])
        return F.when(there, _if_label(F.regexp_extract(text, pattern, 1), labels))

    return F.coalesce(*[guarded(p, s) for p, s in zip(PHRASES, _SIGNS)])


def line_choice(text: ColumnLike, labels: Column) -> Column:
    """Leading letter of the first line that starts with a label, any case."""
    leads = F.regexp_extract_all(as_column(text), F.lit(LINE_LEAD), F.lit(1))
    # One upper() over the joined leads; a lead is never a line feed.
    upper_leads = F.split(F.upper(F.array_join(leads, "\n")), "\n")
    return _first_common(upper_leads, labels)


def word_choice(text: ColumnLike, labels: Column) -> Column:
    """First label, in label order, that stands alone, between no word characters.

    One pattern finds all lone characters; only longer labels are searched one
    by one, as they are spelled.
    """
    text = as_column(text)
    lone = F.regexp_extract_all(text, F.lit(f"(?<!{WORD}){WORD}(?!{WORD})"), F.lit(0))

    def spelled(label: Column) -> Column:
        quoted = F.concat(F.lit("\\Q"), F.replace(label, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
        edge = lambda part, found: F.when(F.rlike(label, F.lit(part)), F.lit(found[0])).otherwise(F.lit(found[1]))
        before = edge(f"^{WORD}", (f"(?<!{WORD})", f"(?<={WORD})"))
        after = edge(f"{WORD}$", (f"(?!{WORD})", f"(?={WORD})"))
        return ~F.rlike(label, F.lit(f"^{WORD}$")) & (label != "") & F.rlike(text, F.concat(before, quoted, after))

    return _first_common(labels, F.concat(lone, F.filter(labels, spelled)))


def labels_present(upper_text: ColumnLike, labels: Column) -> Column:
    """Labels occurring anywhere in the upper-cased text."""
    upper_text = as_column(upper_text)
    return F.filter(labels, lambda c: F.contains(upper_text, c))


def last_bounded(upper_text: ColumnLike, reversed_text: ColumnLike, present: ColumnLike) -> Column:
    """Last label whose final occurrence has no alphanumeric neighbour.

    ``reversed_text`` turns the search for the last occurrence into a search for
    the first one.
    """
    upper_text, reversed_text = as_column(upper_text), as_column(reversed_text)
    size = F.length(upper_text)

    def locate(c: Column) -> Column:
        tail = F.instr(reversed_text, F.reverse(c))
        return F.struct(c.alias("label"), (size - tail - F.length(c) + 2).alias("at"))

    def bounded(hit: Column) -> Column:
        at = hit["at"]
        before = F.substring(upper_text, at - 1, F.lit(1))
        after = F.substring(upper_text, at + 1, F.lit(1))
        return (((at == 1) | ~F.rlike(before, F.lit(ALNUM)))
                & ((at == size) | ~F.rlike(after, F.lit(ALNUM))))

    hits = F.filter(F.transform(F.reverse(as_column(present)), locate), bounded)
    return F.try_element_at(hits, F.lit(1))["label"]


def choice_letter(text: ColumnLike, labels: Column) -> Column:
    """All rules as one expression, for use on array elements."""
    upper = F.upper(as_column(text))
    present = labels_present(upper, labels)
    return F.coalesce(
        phrase_choice(text, labels), line_choice(text, labels), word_choice(text, labels),
        F.when(F.size(present) == 1, F.get(present, F.lit(0))),
        F.when(F.size(present) > 1, last_bounded(upper, F.reverse(upper), present)))
