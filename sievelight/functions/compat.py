"""One place for the text rules every operator shares.

Patterns in this library are written in the common regex dialect with ASCII word boundaries and Unicode white space.
`regex` rewrites such a pattern for the JVM engine, where `\\b` is Unicode aware and `\\s` is ASCII only. On text that is
pure ASCII the two dialects agree and the plain spelling is several times faster, so `by_script` picks one per row.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The white space characters that trimming and `\s` cover.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
SPACE_CLASS = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

ASCII_CLASSES = {r"\d": "0-9", r"\w": "A-Za-z0-9_", r"\s": r"\t\n\x0B\f\r "}

WORD = "[A-Za-z0-9_]"
BOUNDARY = f"(?:(?<!{WORD})(?={WORD})|(?<={WORD})(?!{WORD}))"

DECIMAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"


def regex(pattern: str, flags: str = "") -> str:
    """JVM spelling of a pattern for any text; `flags` is any of i, m, s."""
    return _spell(pattern, flags, True)


def ascii_regex(pattern: str, flags: str = "") -> str:
    """JVM spelling of a pattern for text known to be pure ASCII."""
    return _spell(pattern, flags, False)


def _spell(pattern: str, flags: str, any_text: bool) -> str:
    out = []
    in_class = False
    i = 0
    while i < len(pattern):
        c = pattern[i]
        pair = pattern[i : i + 2]
        if c == "\\" and len(pair) == 2:
            if any_text and pair == r"\b" and not in_class:
                out.append(BOUNDARY)
            elif any_text and pair == r"\s":
                out.append(SPACE_CLASS if in_class else f"[{SPACE_CLASS}]")
            elif any_text and pair == r"\S":
                out.append(f"[^{SPACE_CLASS}]")
            elif pair in ASCII_CLASSES:
                # Written out, a class is one bit set; a shorthand inside a class is a chain of tests and far slower.
                out.append(ASCII_CLASSES[pair] if in_class else f"[{ASCII_CLASSES[pair]}]")
            else:
                out.append(pair)
            i += 2
            continue
        if c == "[" and in_class:
            out.append(r"\[")
        elif c == "$" and not in_class and "m" not in flags:
            out.append(r"\z")
        else:
            out.append(c)
        if c == "[":
            in_class = True
        elif c == "]":
            in_class = False
        i += 1
    prefix = f"(?{''.join(sorted(flags))})" if flags else ""
    return prefix + "".join(out)


Spelling = Callable[..., str]


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def by_script(text: Column, build: Callable[[Spelling], Column]) -> Column:
    """`build` with the spelling that fits each row's text; only one of the two is evaluated."""
    return F.when(is_ascii(text), build(ascii_regex)).otherwise(build(regex))


def matches(text: Column, pattern: str, flags: str = "") -> Column:
    return by_script(text, lambda spell: text.rlike(spell(pattern, flags)))


def replaced(text: Column, pattern: str, flags: str, mark: str) -> Column:
    return by_script(text, lambda spell: F.regexp_replace(text, spell(pattern, flags), mark))


def extracted(text: Column, pattern: str, flags: str, group: int) -> Column:
    return by_script(text, lambda spell: F.regexp_extract(text, spell(pattern, flags), group))


def regex_column(pattern: Column, flags: Column) -> Column:
    """The same rewrite for a pattern that is data. Only boundaries and flags change."""
    escaped = BOUNDARY.replace("\\", "\\\\").replace("$", "\\$")
    body = F.regexp_replace(pattern, r"(?<!\\)((?:\\\\)*)\\b", "$1" + escaped)
    wanted = F.regexp_replace(F.coalesce(flags, F.lit("")), "[^ims]", "")
    wanted = F.when(F.contains(wanted, F.lit("i")), F.concat(wanted, F.lit("u"))).otherwise(wanted)
    return F.concat(F.when(wanted != "", F.concat(F.lit("(?"), wanted, F.lit(")"))).otherwise(F.lit("")), body)


def trim(col: Column) -> Column:
    return F.btrim(col, F.lit(SPACE_CHARS))


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def is_blank(col: Column) -> Column:
    return trim(text_or_empty(col)) == ""


def split_lines(text: Column) -> Column:
    return F.split(text, r"\r?\n", -1)


def number(col: Column) -> Column:
    """Double value of a numeric text, NULL when the text is not a number; blank text is 0."""
    t = trim(col.cast("string"))
    digits = F.substr(t, F.lit(3))

    def radix(mark: str, allowed: str, base: int) -> Column:
        return F.when(t.rlike(f"^0[{mark}]{allowed}+\\z"), F.conv(digits, base, 10).try_cast("double"))

    return F.coalesce(
        F.when(t == "", F.lit(0.0)),
        F.when(t.rlike(DECIMAL), t.try_cast("double")),
        radix("xX", "[0-9a-fA-F]", 16),
        radix("oO", "[0-7]", 8),
        radix("bB", "[01]", 2),
    )


def half_up(col: Column) -> Column:
    """Round to a whole number, halves towards plus infinity."""
    return F.floor(col + F.lit(0.5))


def _refuse(_: str):
    raise ValueError("not a JSON constant")


def _is_json(text: str | None) -> bool | None:
    if text is None:
        return None
    try:
        json.loads(text, parse_constant=_refuse, parse_int=len, parse_float=len)
    except (ValueError, RecursionError):
        return False
    return True


@F.pandas_udf(T.BooleanType())
def is_json(text: pd.Series) -> pd.Series:
    """Strict JSON validity. Built-in parsers accept trailing text, so this is the library's one Python function."""
    return text.map(_is_json, na_action="ignore").astype("object")
