"""The library's expressions as SQL functions, for queries written as text.

Each is a SQL function with a RETURN body of built-in functions, which Spark
puts into the query's plan, so no Python runs. They live as long as the session.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from gradeframe.functions import choice, equivalence, extract, passk, text

PREFIX = "gradeframe_"


def _quoted(value: str) -> str:
    """A SQL literal that takes backslashes as they are."""
    if "'" in value:
        raise ValueError("a raw literal cannot hold a quote")
    return f"r'{value}'"


def _last(source: str, pattern: str, group: int, found: bool = False) -> str:
    every = f"regexp_extract_all({source}, {_quoted(pattern)}, {group})"
    return f"try_element_at(array_remove({every}, ''), -1)" if found else f"try_element_at({every}, -1)"


def _strip(value: str) -> str:
    return f"btrim({value}, {_quoted(text.WHITESPACE)})"


def _marked(pattern: str) -> str:
    bare = f"trim(TRAILING {_quoted(extract.TRAILING_PUNCTUATION)} FROM {_strip(_last('answer', pattern, 1))})"
    return f"nullif({_strip(bare)}, '')"


def _normal(value: str) -> str:
    value = f"translate(lower({_strip(value)}), {_quoted(text.WHITESPACE + chr(92))}, '')"
    marks = equivalence._OPEN, equivalence._BAR, equivalence._CLOSE
    opened = f"{marks[0]}$1{marks[1]}$2{marks[2]}$3"
    value = f"regexp_replace({value}, {_quoted(equivalence.FRACTION_MARKUP)}, '{opened}')"
    value = f"translate(replace({value}, '{''.join(marks)}', ''), '{marks[1]}${marks[0]}{marks[2]}', '/')"
    value = f"trim(LEADING '=' FROM regexp_replace({value}, {_quoted(equivalence.DIGIT_COMMA)}, '$1$2'))"
    value = f"regexp_replace({value}, {_quoted(equivalence.WRAPPING)}, '$1$2$3')"
    return f"trim(TRAILING {_quoted(equivalence.CLOSING_PUNCTUATION)} FROM {value})"


def _definitions(p: str) -> list[tuple[str, str, str]]:
    """(signature, type, body) of each function, in an order in which later ones may call earlier ones."""
    english, chinese, final_english, final_chinese = extract.ANSWER_MARKERS
    phrases = ", ".join(f"{p}label_of(regexp_extract(answer, {_quoted(x)}, 1), labels)" for x in choice.PHRASES)
    line_feed = _quoted("\n")
    foreign, values = equivalence._FOREIGN_DIGITS + "_", equivalence._FOREIGN_VALUES
    return [
        ("boxed_answer(answer STRING)", "STRING", f"""CASE WHEN contains(answer, {_quoted(chr(92) + 'boxed{')})
            THEN {_strip(_last('answer', extract.BOXED, 1, True))} END"""),
        ("latex_fraction(answer STRING)", "STRING", f"""CASE WHEN contains(answer, {_quoted(chr(92) + 'frac{')})
            THEN {_last('answer', extract.LATEX_FRACTION, 1, True)} END"""),
        ("marked_answer(answer STRING)", "STRING", f"""coalesce({_marked(english)},
            CASE WHEN contains(answer, '答案') THEN {_marked(chinese)} END, {_marked(final_english)},
            CASE WHEN contains(answer, '答案') THEN {_marked(final_chinese)} END)"""),
        ("last_number(answer STRING)", "STRING", f"""coalesce(
            CASE WHEN contains(answer, '/') THEN {_last('answer', extract.FRACTION_NUMBER, 0)} END,
            CASE WHEN contains(answer, '.') THEN {_last('answer', extract.DECIMAL_NUMBER, 0)} END,
            {_last('answer', extract.INTEGER_NUMBER, 0)})"""),
        ("last_line(answer STRING)", "STRING", _strip(
            f"substring_index(trim(TRAILING {_quoted(text.WHITESPACE)} FROM answer), {line_feed}, -1)")),
        ("extract_answer(answer STRING)", "STRING", f"""coalesce(nullif({p}boxed_answer(answer), ''),
            {p}latex_fraction(answer), {p}marked_answer(answer), {p}last_number(answer), {p}last_line(answer))"""),
        ("normal_text(answer STRING)", "STRING", f"""CASE WHEN answer RLIKE {_quoted(equivalence.NORMAL_ALREADY)}
            THEN answer ELSE {_normal('answer')} END"""),
        ("normalize_answer(answer STRING)", "STRING", f"{p}normal_text(coalesce(answer, ''))"),
        ("number_text(answer STRING)", "STRING", f"""CASE WHEN answer RLIKE {_quoted(equivalence.NUMERIC)} THEN
            CASE WHEN answer RLIKE {_quoted(equivalence.UNUSUAL)} THEN regexp_replace(
              translate(answer, {_quoted(foreign)}, {_quoted(values)}), '[+-]nan', 'nan') ELSE answer END END"""),
        ("value_of(spelled STRING)", "DOUBLE", """CASE WHEN contains(spelled, '/') THEN try_divide(
              try_cast(substring_index(spelled, '/', 1) AS DOUBLE), try_cast(substring_index(spelled, '/', -1) AS DOUBLE))
            WHEN endswith(spelled, '%') THEN try_cast(trim(TRAILING '%' FROM spelled) AS DOUBLE) / 100
            ELSE try_cast(spelled AS DOUBLE) END"""),
        ("numeric_value(answer STRING)", "DOUBLE", f"{p}value_of({p}number_text(answer))"),
        ("close_or_within(pred STRING, gold STRING, a DOUBLE, b DOUBLE)", "BOOLEAN", f"""CASE
            WHEN a IS NOT NULL AND b IS NOT NULL THEN abs(a - b) < {equivalence.TOLERANCE!r}D
            ELSE gold <> '' AND contains(pred, gold) END"""),
        ("same_normal(pred STRING, gold STRING)", "BOOLEAN", f"""CASE WHEN pred = gold THEN true
            ELSE {p}close_or_within(pred, gold, {p}numeric_value(pred), {p}numeric_value(gold)) END"""),
        ("is_equiv(pred STRING, gold STRING)", "BOOLEAN",
         f"{p}same_normal({p}normalize_answer(pred), {p}normalize_answer(gold))"),
        ("long_fail(n DOUBLE, c DOUBLE, k DOUBLE, rest DOUBLE)", "DOUBLE", """exp((n + 0.5D) * log1p(c * k / (n * rest))
            + c * log1p(-k / (n - c)) + k * log1p(-c / (n - k))
            + 1 / (12 * (n - c)) - 1 / (360 * (n - c) * (n - c) * (n - c)) - 1 / (12 * n) + 1 / (360 * n * n * n)
            - 1 / (12 * rest) + 1 / (360 * rest * rest * rest)
            + 1 / (12 * (n - k)) - 1 / (360 * (n - k) * (n - k) * (n - k)))"""),
        ("all_fail(n DOUBLE, c DOUBLE, k DOUBLE)", "DOUBLE", f"""CASE WHEN least(c, k) <= {passk._DIRECT_FACTORS} THEN
              aggregate(sequence(0, CAST(least(c, k, {passk._DIRECT_FACTORS}D) AS INT) - 1), 1D,
                        (product, j) -> product * (1 - greatest(c, k) / (n - j)))
            WHEN n - c - k < 1 THEN 0D ELSE {p}long_fail(n, c, k, greatest(n - c - k, 1D)) END"""),
        ("pass_of(n DOUBLE, c DOUBLE, k DOUBLE)", "DOUBLE", f"""CASE WHEN n <= 0 OR k <= 0 OR c <= 0 THEN 0D
            WHEN k > n - c THEN 1D ELSE 1 - {p}all_fail(n, c, k) END"""),
        ("pass_at_k(n BIGINT, c BIGINT, k BIGINT)", "DOUBLE",
         f"{p}pass_of(CAST(n AS DOUBLE), CAST(c AS DOUBLE), CAST(least(greatest(k, 0), n) AS DOUBLE))"),
        ("label_of(letter STRING, labels ARRAY<STRING>)", "STRING",
         "get(labels, CAST(array_position(labels, letter) - 1 AS INT))"),
        ("phrase_choice(answer STRING, labels ARRAY<STRING>)", "STRING", f"coalesce({phrases})"),
        ("line_choice(answer STRING, labels ARRAY<STRING>)", "STRING", f"""try_element_at(array_intersect(split(upper(
            array_join(regexp_extract_all(answer, {_quoted(choice.LINE_LEAD)}, 1), {line_feed})), {line_feed}), labels), 1)"""),
        ("word_choice(answer STRING, labels ARRAY<STRING>)", "STRING", f"""try_element_at(array_intersect(labels,
            regexp_extract_all(answer, {_quoted(f'(?<!{text.WORD}){text.WORD}(?!{text.WORD})')}, 0)), 1)"""),
        ("bounded_choice(shouted STRING, present ARRAY<STRING>)", "STRING", f"""CASE WHEN size(present) = 1 THEN present[0]
            ELSE try_element_at(filter(reverse(present), label -> shouted RLIKE concat('(?s)^(?:.*[^\\\\p{{L}}\\\\p{{N}}])?',
              label, '(?![\\\\p{{L}}\\\\p{{N}}])(?:(?!', label, ').)*$')), 1) END"""),
        ("present_labels(shouted STRING, labels ARRAY<STRING>)", "ARRAY<STRING>",
         "filter(labels, label -> contains(shouted, label))"),
        ("choice_letter(answer STRING, labels ARRAY<STRING>)", "STRING", f"""coalesce({p}phrase_choice(answer, labels),
            {p}line_choice(answer, labels), {p}word_choice(answer, labels),
            {p}bounded_choice(upper(answer), {p}present_labels(upper(answer), labels)))"""),
    ]


def register(spark: SparkSession, prefix: str = PREFIX) -> list[str]:
    """Define the functions in the session, each under ``prefix`` and its name; returns the names.

    ``extract_answer``, ``normalize_answer``, ``is_equiv``, ``pass_at_k`` and
    ``choice_letter`` are the ones to call; the others are their parts.
    ``choice_letter`` takes labels of one letter each.
    """
    names = []
    for signature, kind, body in _definitions(prefix):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{signature} RETURNS {kind} RETURN {body}")
        names.append(prefix + signature.split("(")[0])
    return names
