"""Tag, attribute and offset helpers over stored markup."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievelight.functions.compat import regex


def attribute(tag: Column, name: str) -> Column:
    """Value of a simple attribute, empty text without one."""
    return F.regexp_extract(tag, regex(rf"\b{name}\s*=\s*[\"']?([\w-]+)", "i"), 1)


def has_attribute(tag: Column, name: str) -> Column:
    return tag.rlike(regex(rf"\b{name}\s*=", "i"))


#: Matches whose running sums are made in one fold; it copies its result at every match, so it is kept short.
RUN = 256


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once: inside another lambda it would be computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(steps: Column, chars_of: Callable[[Column], Column], lines_of: Callable[[Column], Column]) -> Column:
    """struct<chars, lines, seen>: sums over an array, and the sums before each element, in order."""
    none = F.array().cast("array<struct<chars:int,lines:int>>")
    state = F.struct(F.lit(0).alias("chars"), F.lit(0).alias("lines"), none.alias("seen"))

    def step(sums: Column, one: Column) -> Column:
        chars, lines = sums["chars"], sums["lines"]
        now = F.struct(chars.alias("chars"), lines.alias("lines"))
        return F.struct((chars + chars_of(one)).alias("chars"), (lines + lines_of(one)).alias("lines"), F.array_append(sums["seen"], now).alias("seen"))

    return F.aggregate(steps, state, step)


def match_spans(text: Column, pattern: str) -> Column:
    """array<struct<match, start, line>> of every match: 1-based offset and line number.

    The pieces between matches and the matches themselves cover the text once, so both numbers
    are running sums over them and the text is not cut again for each match. The sums are made in runs of RUN
    matches and once more over the runs, so that the work grows with the number of matches and not with its square.
    """
    java = F.lit(pattern)

    def place(pair: Column) -> Column:
        piece, match = pair["piece"], pair["match"]
        return F.struct(
            match.alias("match"), F.length(piece).alias("before"), newlines(piece).alias("above"), F.length(match).alias("size"), newlines(match).alias("breaks")
        )

    def places(found: Column) -> Column:
        # The piece after the last match has none of its own and leaves with it.
        pairs = F.arrays_zip(F.slice(F.split(text, java, -1), F.lit(1), F.size(found)).alias("piece"), found.alias("match"))
        return F.transform(pairs, place)

    def sums(run: Column) -> Column:
        return _running(run, lambda p: p["before"] + p["size"], lambda p: p["above"] + p["breaks"])

    def cut(places: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(places), F.lit(1)), F.lit(RUN))
        return F.transform(starts, lambda at: _bound(F.slice(places, at, F.lit(RUN)), lambda run: F.struct(run.alias("run"), sums(run).alias("sums"))))

    def spans(runs: Column) -> Column:
        before = _running(runs, lambda r: r["sums"]["chars"], lambda r: r["sums"]["lines"])["seen"]

        def shifted(run: Column, base: Column) -> Column:
            def span(one: Column, seen: Column) -> Column:
                start = base["chars"] + seen["chars"] + one["before"] + 1
                line = base["lines"] + seen["lines"] + one["above"] + 1
                return F.struct(one["match"].alias("match"), start.alias("start"), line.alias("line"))

            return F.zip_with(run["run"], run["sums"]["seen"], span)

        return F.flatten(F.zip_with(runs, before, shifted))

    none = F.array().cast("array<struct<match:string,start:int,line:int>>")
    found = F.regexp_extract_all(text, java, F.lit(0))
    return _bound(found, lambda all_: F.when(F.size(all_) == 0, none).otherwise(_bound(_bound(places(all_), cut), spans)))


def newlines(text: Column) -> Column:
    """Line ends of a text. They are single bytes, so the bytes that go with them count them without reading characters."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
