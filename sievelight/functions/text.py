"""Text normalisation: line shapes, masked patterns, severities, fingerprints, keys and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievelight.functions.compat import Spelling, by_script, is_ascii, is_blank, matches, regex, text_or_empty, trim

# Stamps, masks and word lists that decide the results.
STAMP = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z)"
LOOSE_STAMP = r"^\s*\[?(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2})"
DENIED = r"\b(401|403)\b|unauthori|forbidden|failed login|invalid token"
ID_TOKEN = r"\d{2,}"
MASKS = [
    (r"^\s*\[?\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?Z?\]?\s*", "", ""),
    (r"\bses_[A-Za-z0-9]+\b", "", "<sid>"),
    (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "i", "<uuid>"),
    (r"\b0x[0-9a-f]+\b", "i", "<hex>"),
    (r"\b(?=[0-9a-f]*\d)[0-9a-f]{10,}\b", "i", "<hex>"),
    (r"[A-Za-z]:\\[^\s\"'|]+", "", "<path>"),
    (r"(?:\/[\w.-]+){3,}", "", "<path>"),
    (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "", "<ip>"),
    (r"\b\d{1,2}:\d{2}(?::\d{2})?Z?\b", "", "<t>"),
    (r"\b\d+(?:\.\d+)?\s?(?:ms|s|m|h|d|kb|mb|gb|%)(?![A-Za-z])", "i", "<q>"),
    (r"-r\d+\b", "", "-r<n>"),
    (r"#\d+", "", "#<n>"),
    (r"\b\d+x\b", "", "<n>x"),
    (r"\b\d+\b", "", "<n>"),
]
NEGATED = (
    r"\b(?:0|no|zero|without)\s+(?:errors?|failures?|failed|warnings?|exceptions?)\b"
    r"|\b(?:errors?|failures?|failed|warnings?)\s*[:=]\s*0\b|error_count=0"
)
ERROR_WORDS = r"\b(?:error|fatal|exception|crash(?:ed)?|panic|traceback|segfault|unhandled|failed|failure)\b"
WARN_WORDS = (
    r"\b(?:warn(?:ing)?|stale|timeout|timed out|refused|denied|retry(?:ing)?|held|blocked|stuck|abort(?:ed)?"
    r"|deprecated|noop|no valid lock|glitch)\b"
)
FINGERPRINT_PREFIX = "bt-"
KEY_LETTERS = "a-z0-9\\u0590-\\u05FF"
HEBREW = "[\\u0590-\\u05FF]"
WORD_LETTERS = r"\p{L}\p{N}"


def stamp_ms(line: Column) -> Column:
    """Epoch milliseconds of a leading UTC stamp, NULL without one or when it is not a real date."""
    stamp = F.regexp_extract(line, regex(STAMP), 1)
    return F.unix_millis(F.when(stamp != "", stamp).try_cast("timestamp"))


def without_stamp(line: Column) -> Column:
    return F.regexp_replace(line, regex(STAMP), "")


def stamp_text(line: Column) -> Column:
    """Leading date and time as written, NULL without one."""
    stamp = F.regexp_extract(line, regex(LOOSE_STAMP), 1)
    return F.when(stamp != "", stamp)


def collapse(col: Column, spell: Spelling = regex) -> Column:
    """Every run of white space becomes one space. Single spaces are left alone instead of being rewritten."""
    return trim(F.regexp_replace(col, spell(r"\s{2,}|[\s&&[^ ]]"), " "))


def shape_of(line: Column) -> Column:
    """What a line looks like once its stamp, numbers and ids are folded away."""
    folded = F.lower(without_stamp(text_or_empty(line)))
    for pattern, mark in ((r"[0-9a-f]{6,}", "#"), (r"\d+", "#"), (r"[^a-z# /._-]+", " ")):
        folded = F.regexp_replace(folded, pattern, mark)
    return trim(F.regexp_replace(folded, " {2,}", " "))


def normalize_line(line: Column) -> Column:
    """The pattern of a log line: everything that varies between repeats becomes a mark."""

    def build(spell: Spelling) -> Column:
        masked = text_or_empty(line)
        for pattern, flags, mark in MASKS:
            masked = F.regexp_replace(masked, spell(pattern, flags), mark)
        return collapse(masked, spell)

    return by_script(line, build)


def severity(line: Column) -> Column:
    return by_script(
        line,
        lambda spell: F.when(line.rlike(spell(NEGATED, "i")), "info")
        .when(line.rlike(spell(ERROR_WORDS, "i")), "error")
        .when(line.rlike(spell(WARN_WORDS, "i")), "warn")
        .otherwise("info"),
    )


def fingerprint(pattern: Column) -> Column:
    return F.concat(F.lit(FINGERPRINT_PREFIX), F.left(F.sha1(pattern), F.lit(8)))


def family_of(pattern: Column) -> Column:
    """First two words of a pattern, a leading session mark dropped."""
    words = F.split(F.regexp_replace(pattern, "^<sid> ", ""), " ", -1)
    return F.array_join(F.slice(words, 1, 2), " ")


def is_continuation(line: Column) -> Column:
    """Indented and without a leading date: belongs to the line above."""
    dated = line.rlike(regex(r"^\s*\[?\d{4}-\d{2}-\d{2}"))
    return line.rlike(regex(r"^\s+\S")) & ~dated


def is_denied(line: Column, pattern: str = DENIED) -> Column:
    return matches(line, pattern, "i")


def id_tokens(line: Column) -> Column:
    """Distinct digit runs of two or more digits after the stamp."""
    return F.array_distinct(F.regexp_extract_all(without_stamp(line), F.lit(ID_TOKEN), F.lit(0)))


def norm_text(col: Column, keep_all_scripts: bool = False) -> Column:
    """Key text: case, punctuation and spacing removed.

    By default only a-z, digits and Hebrew survive, so rows in other scripts can share an empty key;
    `keep_all_scripts` keeps every letter and digit.
    """
    lowered = F.lower(text_or_empty(col))
    # A class over several Unicode blocks is many times slower than one of ASCII only, so it is kept for texts it matters to.
    wide, is_plain = (WORD_LETTERS, is_ascii(lowered)) if keep_all_scripts else (KEY_LETTERS, ~lowered.rlike(HEBREW))
    plain = F.regexp_replace(lowered, "[^a-z0-9]+", " ")
    return trim(F.when(is_plain, plain).otherwise(F.regexp_replace(lowered, f"[^{wide}]+", " ")))


def tokenize(text: Column) -> Column:
    """Lower-case runs of letters and digits of any script."""
    lowered = F.lower(text_or_empty(text))
    plain = F.regexp_extract_all(lowered, F.lit("[a-z0-9]+"), F.lit(0))
    return F.when(is_ascii(lowered), plain).otherwise(F.regexp_extract_all(lowered, F.lit(f"[{WORD_LETTERS}]+"), F.lit(0)))


def filled(col: Column) -> Column:
    return ~is_blank(col)
