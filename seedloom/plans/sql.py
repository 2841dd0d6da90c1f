"""Pieces of the DuckDB statements that the queries are checked against."""

from __future__ import annotations

from ..functions.text import LINE_END, SPACE, WORD

# The patterns of ``functions.text`` in the form of the other engine.
LABEL_PREFIX = f"(?i)^[{SPACE}]*(?:Sensitive|Non-sensitive)[{SPACE}]*:[{SPACE}]*"
MARKER_PREFIX = f"(?i)^[{SPACE}]*(?:(?:Sensitive|Non-sensitive)[{SPACE}]*:[{SPACE}]*|:[{SPACE}]*)?<<<[{SPACE}]*"
ARTIFACT = f"(?i)(<<<|>>>|^[{SPACE}]*(Sensitive|Non-sensitive)[{SPACE}]*:|Classify one PII-detection text|Respond with exactly one label)"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def squash(x: str) -> str:
    return f"regexp_replace({x}, '[{SPACE}]+', ' ', 'g')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def strip_chars(x: str, chars: str) -> str:
    return f"regexp_replace({x}, {quoted(f'^[{chars}]+|[{chars}]+$')}, '', 'g')"


def kept(x: str) -> str:
    return f"CASE WHEN length({x}) BETWEEN 10 AND 500 AND NOT regexp_matches({x}, '{ARTIFACT}') THEN {x} END"


def rows(*statements: str) -> str:
    return " UNION ALL ".join(statements)


def splits(columns: str) -> str:
    return rows(*(f"SELECT '{s}' AS split, {columns} FROM {s}" for s in ("train", "valid", "test")))


def has_word(x: str, words: list[str]) -> str:
    return f"regexp_matches({x}, '(?i)(^|[^{WORD}])({'|'.join(words)})($|[^{WORD}])')"


def first_line(x: str) -> str:
    return f"regexp_extract({x}, '^[^{LINE_END}]*')"


def macro_f1(true: str, pred: str) -> str:
    """Mean of the F1 of both labels."""
    one = "coalesce(2.0 * count(*) FILTER ({t} = '{l}' AND {p} = '{l}') / nullif(count(*) FILTER ({t} = '{l}') + count(*) FILTER ({p} = '{l}'), 0), 0.0)"
    return "(" + " + ".join(one.format(t=true, p=pred, l=name) for name in ("Non-sensitive", "Sensitive")) + ") / 2"
