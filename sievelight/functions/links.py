"""Links, query parameters and personal-data predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievelight.functions.compat import regex

# Link, address and number patterns.
MARKDOWN_LINK = r"\[([^\]]*)\]\(([^)\s]+)\)"
HREF_LINK = r"href\s*=\s*[\"'](https?:\/\/[^\"'\s>]+)[\"']"
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
DIGIT_RUN = r"\+?[\d][\d\s-]*\d"
# A run that is long enough spans nine characters; testing this first spares most lines the full search.
NINE_CHARS = r"\d[\d\s-]{7,}\d"
UTM3 = ("utm_source", "utm_medium", "utm_campaign")


def links_in_line(line: Column) -> Column:
    """http(s) urls of a line: markdown links first, then href links."""
    markdown = F.regexp_extract_all(line, F.lit(regex(MARKDOWN_LINK)), F.lit(2))
    external = F.filter(markdown, lambda u: u.rlike(r"(?i)^https?:\/\/"))
    return F.concat(external, F.regexp_extract_all(line, F.lit(regex(HREF_LINK, "i")), F.lit(1)))


def url_params(url: Column) -> Column:
    """array<struct<name, value>> of the query, in order; a value that cannot be decoded is NULL."""
    query = F.coalesce(F.get(F.split(url, r"\?", -1), F.lit(1)), F.lit(""))
    parts = F.filter(F.split(query, "&", -1), lambda p: p != "")

    def pair(part: Column) -> Column:
        at = F.instr(part, "=")
        value = F.when(at == 0, F.lit("")).otherwise(F.try_url_decode(F.substring(part, at + 1, F.length(part))))
        name = F.when(at == 0, part).otherwise(F.substring(part, F.lit(1), at - 1))
        return F.struct(name.alias("name"), value.alias("value"))

    return F.transform(parts, pair)


def link_utm(url: Column) -> Column:
    """map<lower-case name, struct<name, value>> of the utm_* parameters; the last of a repeated name wins."""
    utm = F.filter(url_params(url), lambda p: F.lower(p["name"]).startswith("utm_"))

    def is_last(pair: Column, position: Column) -> Column:
        later = F.slice(utm, position + 2, F.size(utm))
        return ~F.exists(later, lambda other: F.lower(other["name"]) == F.lower(pair["name"]))

    kept = F.filter(utm, is_last)
    return F.map_from_entries(F.transform(kept, lambda p: F.struct(F.lower(p["name"]), p)))


def lower_ok(text: Column) -> Column:
    """Not empty and free of upper case."""
    return F.coalesce((text != "") & (text == F.lower(text)), F.lit(False))


def has_phone(line: Column) -> Column:
    """A digit run of ten digits, or of nine with a separator; a date stays below both."""

    def long_enough(run: Column) -> Column:
        digits = F.length(F.regexp_replace(run, r"\D", ""))
        separators = F.regexp_count(run, F.lit(regex(r"[\s-]")))
        return (digits >= 10) | ((separators >= 1) & (digits >= 9))

    runs = F.regexp_extract_all(line, F.lit(regex(DIGIT_RUN)), F.lit(0))
    return line.rlike(regex(NINE_CHARS)) & F.exists(runs, long_enough)


def is_pii_line(line: Column) -> Column:
    return (F.contains(line, F.lit("@")) & line.rlike(regex(EMAIL))) | has_phone(line)
