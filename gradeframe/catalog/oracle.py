"""The text rules once more as DuckDB SQL, for checking the Spark expressions.

RE2 has no lookaround, so numbers and letters are found in other ways here.
"""

from __future__ import annotations

from gradeframe.functions.text import SOFT_BREAKS, SPACE, WHITESPACE, char_class

WS = f"'{WHITESPACE}'"
PUNCT = "'。.!！；;，,'"
MARKERS = (
    f"(?i)Answer:{SPACE}*(.+)",
    f"(?i)答案[:：]{SPACE}*(.+)",
    f"(?i)final answer is:?{SPACE}*(.+)",
    f"(?i)最终答案[:：是]{SPACE}*(.+)",
)


# The phrases that introduce a letter, written out once more.
_GAP = char_class(WHITESPACE + ":") + "*"
CHOICE_PHRASES = (
    rf"(?:answer|Answer|ANSWER){_GAP}(?:is|IS)?{_GAP}\(?([A-E])",
    rf"(?:correct|Correct|CORRECT){_GAP}(?:answer|option|choice)?{_GAP}\(?([A-E])",
    rf"(?:option|Option|OPTION|choice|Choice|CHOICE){_GAP}\(?([A-E])",
    r"\(([A-E])\)",
    r"\[([A-E])\]",
)


def boxed(t: str) -> str:
    return rf"trim(regexp_extract_all({t}, '\\boxed\{{([^}}]+)\}}', 1)[-1], {WS})"


def fraction(t: str) -> str:
    return rf"regexp_extract_all({t}, '\\frac\{{[^}}]+\}}\{{[^}}]+\}}')[-1]"


def _one_marker(t: str, pattern: str) -> str:
    candidate = f"trim(regexp_extract_all({t}, '{pattern}', 1)[-1], {WS})"
    line = f"regexp_extract({candidate}, '^{char_class(SOFT_BREAKS, negate=True)}*')"
    return f"nullif(trim(rtrim(trim({line}, {WS}), {PUNCT}), {WS}), '')"


def marker(t: str) -> str:
    return f"coalesce({', '.join(_one_marker(t, p) for p in MARKERS)})"


def number(t: str) -> str:
    tokens = f"regexp_extract_all({t}, '[0-9]+|[^0-9]')"
    # Digit tokens not before a full stop; a minus belongs to them unless digits precede it.
    integer = f"""(SELECT CASE WHEN k[i - 1] = '-' AND NOT regexp_matches(coalesce(k[i - 2], ''), '^[0-9]')
        AND i > 1 THEN '-' ELSE '' END || k[i]
      FROM (SELECT k, list_filter(range(1, len(k) + 1), lambda j:
        regexp_matches(k[j], '^[0-9]') AND coalesce(k[j + 1], '') <> '.')[-1] AS i
        FROM (SELECT {tokens} AS k)))"""
    return f"""coalesce(regexp_extract_all({t}, '-?[0-9]+/[0-9]+')[-1],
      regexp_extract_all({t}, '(?:^|[^0-9])(-?[0-9]+\\.[0-9]+)', 1)[-1], {integer})"""


def last_line(t: str) -> str:
    return f"trim(string_split(rtrim({t}, {WS}), chr(10))[-1], {WS})"


def answer(t: str) -> str:
    return (f"coalesce(nullif({boxed(t)}, ''), {fraction(t)}, {marker(t)}, {number(t)}, "
            f"{last_line(t)})")


def strategy(t: str) -> str:
    return f"""CASE WHEN {boxed(t)} <> '' THEN 'boxed' WHEN {fraction(t)} IS NOT NULL THEN 'fraction'
      WHEN {marker(t)} IS NOT NULL THEN 'marker' WHEN {number(t)} IS NOT NULL THEN 'number'
      WHEN {t} IS NOT NULL THEN 'last_line' END"""


def normal(t: str) -> str:
    s = f"lower(trim(coalesce({t}, ''), {WS}))"
    s = f"replace(regexp_replace({s}, '{SPACE}+', '', 'g'), chr(92), '')"
    s = rf"regexp_replace({s}, 'frac\{{([^}}]+)\}}\{{([^}}]+)\}}', '\1/\2', 'g')"
    s = f"replace({s}, '$', '')"
    s = rf"regexp_replace({s}, '([0-9]),([0-9])', '\1\2', 'g')"
    s = f"regexp_replace({s}, '^=+', '')"
    for _ in range(3):
        s = rf"regexp_replace({s}, '^\((.*)\)$', '\1')"
    return f"rtrim({s}, '。．.!！；;，,')"


_DIGITS = "[0-9]+(?:_[0-9]+)*"
_FLOAT = (rf"[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?"
          r"|inf|infinity|nan)")


def _double(x: str) -> str:
    return (f"CASE WHEN regexp_full_match({x}, '{_FLOAT}') "
            f"THEN try_cast(replace(ltrim({x}, '+'), '_', '') AS DOUBLE) END")


def parsed(x: str) -> str:
    parts = f"string_split({x}, '/')"
    return f"""coalesce(
      CASE WHEN len({parts}) = 2 THEN ({_double(parts + '[1]')}) / nullif(({_double(parts + '[2]')}), 0) END,
      CASE WHEN suffix({x}, '%') THEN ({_double(f"left({x}, -1)")}) / 100 END,
      {_double(x)})"""


def judged(source: str, pred: str, gold: str) -> str:
    """``source`` with the columns p, g and is_correct."""
    return f"""(SELECT *, CASE WHEN p = g THEN true
        WHEN pn IS NOT NULL AND gn IS NOT NULL THEN coalesce(abs(pn - gn) < 1e-6, false)
        ELSE g <> '' AND contains(p, g) END AS is_correct
      FROM (SELECT *, {parsed('p')} AS pn, {parsed('g')} AS gn
        FROM (SELECT *, {normal(pred)} AS p, {normal(gold)} AS g FROM {source})))"""


def choice(t: str, labels: str, order: str = "ABCDE") -> str:
    phrases = []
    for pattern in CHOICE_PHRASES:
        found = f"upper(regexp_extract({t}, '{pattern}', 1))"
        phrases.append(f"CASE WHEN list_contains({labels}, {found}) THEN {found} END")
    letter = r"[\p{L}\p{N}]"
    line = f"""upper(list_filter(list_transform(string_split({t}, chr(10)), lambda l: trim(l, {WS})),
      lambda l: l <> '' AND list_contains({labels}, upper(l[1]))
        AND (length(l) = 1 OR NOT regexp_matches(l[2], '{letter}')))[1][1])"""
    # One constant pattern per letter; DuckDB compiles those once.
    word, last = [], []
    for c in order:
        alone = rf"(?:^|[^\p{{L}}\p{{N}}_]){c}(?:$|[^\p{{L}}\p{{N}}_])"
        word.append(f"WHEN list_contains({labels}, '{c}') AND regexp_matches({t}, '{alone}') THEN '{c}'")
        final = rf"(?s)^(?:.*[^\p{{L}}\p{{N}}])?{c}(?:[^\p{{L}}\p{{N}}{c}][^{c}]*)?$"
        last.insert(0, f"WHEN list_contains({labels}, '{c}') "
                       f"AND regexp_matches(upper({t}), '{final}') THEN '{c}'")
    word, last = f"CASE {' '.join(word)} END", f"CASE {' '.join(last)} END"
    present = f"list_filter({labels}, lambda c: contains(upper({t}), c))"
    only = f"CASE WHEN len({present}) = 1 THEN {present}[1] END"
    return f"coalesce({', '.join(phrases)}, {line}, {word}, {only}, {last})"


def pass_at_k(n: str, c: str, k: str) -> str:
    return f"""(CASE WHEN {n} <= 0 OR {k} <= 0 OR {c} <= 0 THEN 0.0
      WHEN least({k}, {n}) > {n} - {c} THEN 1.0
      ELSE 1 - list_aggregate(list_transform(range({n} - {c} + 1, {n} + 1),
        lambda i: 1 - least({k}, {n})::DOUBLE / i), 'product') END)"""
