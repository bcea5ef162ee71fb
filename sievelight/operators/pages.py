"""Page corpus audit over `pages(page_id, url, html)`. Details name lines and tags, never page text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.functions.compat import is_blank, regex, text_or_empty, trim
from sievelight.functions.html import attribute, has_attribute, match_spans
from sievelight.operators.findings import as_findings, from_hits, hit, hits, text, union_findings
from sievelight.plans.skew import attach_facts
from sievelight.plans.spread import explode_once

# Tags, style rules, input types without a label, and link kinds.
HTML_TAG = r"<html\b[^>]*>"
TITLE = r"<title\b[^>]*>(.*?)<\/title\s*>"
IMG_TAG = r"<img\b[^>]*>"
CONTROL_TAG = r"<(input|select|textarea)\b[^>]*>"
LABEL_FOR = r"<label\b[^>]*\bfor\s*=\s*[\"']?([\w-]+)"
LABEL_BLOCK = r"<label\b[^>]*>(.*?)<\/label\s*>"
INLINE_STYLE = r"\bstyle\s*=\s*\"([^\"]*)\""
STYLE_BLOCK = r"<style\b[^>]*>(.*?)<\/style\s*>"
ANCHOR_TAG = r"<a\b[^>]*>"
ANY_TAG = r"<[a-z][^>]*>"
COLOR = r"#[0-9a-f]{3,8}\b|\brgba?\s*\(|\bhsla?\s*\("
PHYSICAL = (
    r"\b(margin-left|margin-right|padding-left|padding-right|border-left|border-right|border-top-left-radius"
    r"|border-top-right-radius|border-bottom-left-radius|border-bottom-right-radius)\b"
    r"|text-align\s*:\s*(left|right)\b|float\s*:\s*(left|right)\b|clear\s*:\s*(left|right)\b"
    r"|(?<![\w-])(left|right)\s*:"
)
SKIP_TYPES = ("hidden", "submit", "button", "reset", "image")
EXTERNAL = r"^https?:\/\/"
OTHER_SCHEME = r"^(mailto:|tel:|javascript:|data:)"
RESOURCE_NOISE = r"^Failed to load resource"
CHECKS = 7


def _source(df: DataFrame) -> DataFrame:
    return df.withColumn("source", F.col("page_id").cast("string"))


def _extract(col: Column, pattern: str, flags: str, group: int) -> Column:
    return F.regexp_extract(col, regex(pattern, flags), group)


def match_lines(text_col: Column, pattern: str, flags: str = "") -> Column:
    """array<struct<match, start, line>>: where a pattern matches, by offset and line."""
    return match_spans(text_col, regex(pattern, flags))


def _head_hits() -> Column:
    html = text_or_empty(F.col("html"))
    tag = _extract(html, HTML_TAG, "i", 0)
    lang = attribute(tag, "lang")
    return hits(
        (lang == "", hit("missing-lang", "html has no lang attribute")),
        (is_blank(_extract(html, TITLE, "is", 1)), hit("no-title", "page has no title")),
        (
            lang.rlike("(?i)^he") & (F.lower(attribute(tag, "dir")) != "rtl"),
            hit("missing-dir", "Hebrew page without dir=rtl"),
        ),
    )


def page_head(pages: DataFrame) -> DataFrame:
    """`missing-lang`, `no-title`, and `missing-dir` for a Hebrew page that is not right to left."""
    return from_hits(pages, _head_hits(), "page_id")


def _alt_hits() -> Column:
    bare = F.filter(match_lines(F.col("html"), IMG_TAG, "i"), lambda m: ~has_attribute(m["match"], "alt"))
    return F.transform(
        bare, lambda m: hit("missing-alt", text("line ", m["line"], ": img tag without an alt attribute"), m["line"])
    )


def missing_alt(pages: DataFrame) -> DataFrame:
    return from_hits(pages, _alt_hits(), "page_id")


def _is_control(tag: Column) -> Column:
    kind = F.lower(_extract(tag, CONTROL_TAG, "i", 1))
    return ~((kind == "input") & F.lower(attribute(tag, "type")).isin(*SKIP_TYPES))


def _with_labels(pages: DataFrame) -> DataFrame:
    """Adds the ids that labels name and the ranges that labels enclose."""
    html = F.col("html")
    return pages.withColumn("for_ids", F.regexp_extract_all(html, F.lit(regex(LABEL_FOR, "i")), F.lit(1))).withColumn(
        "labels",
        F.transform(
            match_lines(html, LABEL_BLOCK, "is"),
            lambda m: F.struct(m["start"].alias("lo"), (m["start"] + F.length(m["match"])).alias("hi")),
        ),
    )


def _label_hits() -> Column:
    def unlabelled(control: Column) -> Column:
        tag, at = control["match"], control["start"]
        id_of = attribute(tag, "id")
        named = (id_of != "") & F.array_contains("for_ids", id_of)
        wrapped = F.exists("labels", lambda r: (at > r["lo"]) & (at < r["hi"]))
        spoken = has_attribute(tag, "aria-label") | has_attribute(tag, "aria-labelledby") | has_attribute(tag, "title")
        return _is_control(tag) & ~spoken & ~named & ~wrapped

    def describe(control: Column) -> Column:
        name = F.lower(_extract(control["match"], CONTROL_TAG, "i", 1))
        words = text("line ", control["line"], ": ", name, " control without a label, aria-label or title")
        return hit("missing-label", words, control["line"])

    return F.transform(F.filter(match_lines(F.col("html"), CONTROL_TAG, "i"), unlabelled), describe)


def missing_label(pages: DataFrame) -> DataFrame:
    """Form controls without a label, aria-label, aria-labelledby or title."""
    return from_hits(_with_labels(pages), _label_hits(), "page_id")


def _page_styles(name: str, pattern: str, flags: str) -> Column:
    return F.transform(
        match_lines(F.col("html"), pattern, flags),
        lambda m: F.struct(
            F.lit(name).alias("name"), _extract(m["match"], pattern, flags, 1).alias("css"), m["line"].alias("line")
        ),
    )


def _own_styles() -> Column:
    return F.concat(_page_styles("inline style", INLINE_STYLE, "i"), _page_styles("style block", STYLE_BLOCK, "is"))


def style_sources(pages: DataFrame, css: DataFrame | None = None) -> DataFrame:
    """`page_id, name, css, line`: inline styles, style blocks and, given `css(page_id, css)`, external sheets."""
    out = explode_once(pages, _own_styles(), "style", "page_id").select("page_id", "style.*")
    if css is None:
        return out
    sheets = css.filter(F.coalesce("css", F.lit("")) != "")
    return out.unionByName(sheets.select("page_id", F.lit("css").alias("name"), "css", F.lit(None).cast("int").alias("line")))


def _color_check(name: Column, css: Column, line: Column) -> tuple[Column, Column]:
    return _style_check("hardcoded-color", COLOR, " uses a hardcoded color", name, css, line)


def _physical_check(name: Column, css: Column, line: Column) -> tuple[Column, Column]:
    return _style_check("physical-css", PHYSICAL, " uses a physical property", name, css, line)


def _style_check(kind: str, pattern: str, words: str, name: Column, css: Column, line: Column) -> tuple[Column, Column]:
    place = F.when(line.isNull(), F.lit("")).otherwise(text(" at line ", line))
    return css.rlike(regex(pattern, "i")), hit(kind, text(name, place, words), line, name)


def hardcoded_color(styles: DataFrame) -> DataFrame:
    return from_hits(styles, hits(_color_check(F.col("name"), F.col("css"), F.col("line"))), "page_id")


def physical_css(styles: DataFrame) -> DataFrame:
    return from_hits(styles, hits(_physical_check(F.col("name"), F.col("css"), F.col("line"))), "page_id")


def _attribute_text(tag: Column, name: str) -> Column:
    """Whole value of an attribute, NULL when the tag does not have it."""
    quoted = regex(rf"\s{name}\s*=\s*\"([^\"]*)\"", "i")
    single = regex(rf"\s{name}\s*=\s*'([^']*)'", "i")
    plain = regex(rf"\s{name}\s*=\s*([^\s\"'>]+)", "i")
    value = F.coalesce(*[F.when(tag.rlike(p), F.regexp_extract(tag, p, 1)) for p in (quoted, single, plain)])
    return F.replace(value, F.lit("&amp;"), F.lit("&"))


def _hrefs(html: Column) -> Column:
    tags = F.regexp_extract_all(html, F.lit(regex(ANCHOR_TAG, "i")), F.lit(0))
    values = F.transform(tags, lambda t: trim(_attribute_text(t, "href")))
    return F.filter(values, lambda v: v.isNotNull())


def broken_anchor(pages: DataFrame, include_text: bool = False) -> DataFrame:
    """`#id` links without that id on the page."""
    html = F.col("html")
    tags = F.regexp_extract_all(html, F.lit(regex(ANY_TAG, "i")), F.lit(0))
    ids = F.filter(F.transform(tags, lambda t: _attribute_text(t, "id")), lambda v: v.isNotNull())
    wanted = F.filter(_hrefs(html), lambda h: h.rlike("^#."))
    missing = _source(
        explode_once(pages, wanted, "href", "page_id", ids.alias("ids")).filter(
            ~F.array_contains("ids", F.coalesce(F.try_url_decode(F.replace(F.substr("href", F.lit(2)), F.lit("+"), F.lit("%2B"))), F.lit("")))
        )
    )
    detail = text("anchor ", F.col("href"), " has no target id") if include_text else F.lit("anchor has no target id")
    return as_findings(missing, "broken-link", detail, key=F.col("href") if include_text else None)


def page_path(url: Column) -> Column:
    """A url without query and fragment, dot segments resolved."""
    bare = F.regexp_replace(url, r"[?#][\s\S]*", "")
    origin = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*:\/\/[^\/]*)?", 0)
    steps = F.split(F.substr(bare, F.length(origin) + 1), "/", -1)

    def walk(done: Column, step: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(step.isin("", "."), done).when(step == "..", up).otherwise(F.array_append(done, step))

    kept = F.aggregate(steps, F.array().cast("array<string>"), walk)
    return F.concat(origin, F.lit("/"), F.array_join(kept, "/"))


def internal_links(pages: DataFrame) -> DataFrame:
    """`page_id, url, href, target`: links that lead to a path of the same site, resolved against their page."""
    href = F.col("href")
    links = explode_once(pages, _hrefs(F.col("html")), "href", "page_id", "url").filter(
        (href != "") & ~href.rlike(f"(?i){EXTERNAL}") & ~href.rlike(f"(?i){OTHER_SCHEME}") & ~href.startswith("#")
    )
    decoded = F.try_url_decode(F.replace(F.regexp_replace(href, r"[?#][\s\S]*", ""), F.lit("+"), F.lit("%2B")))
    rel = F.coalesce(decoded, F.regexp_replace(href, r"[?#][\s\S]*", ""))
    bare = F.regexp_replace("url", r"[?#][\s\S]*", "")
    scheme = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*:)\/\/", 1)
    origin = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*:\/\/[^\/]*)?", 0)
    folder = F.concat(origin, F.regexp_replace(F.substr(bare, F.length(origin) + 1), r"[^\/]*\z", ""))
    absolute = (
        F.when(F.col("rel").startswith("//"), F.concat(scheme, F.col("rel")))
        .when(F.col("rel").startswith("/"), F.concat(origin, F.col("rel")))
        .otherwise(F.concat(folder, F.when(folder == origin, F.lit("/")).otherwise(F.lit("")), F.col("rel")))
    )
    return (
        links.withColumn("rel", rel)
        .filter(F.col("rel") != "")
        .select("page_id", "url", "href", page_path(absolute).alias("target"))
    )


def broken_link(pages: DataFrame, include_text: bool = False) -> DataFrame:
    """Relative links whose target is not among the stored pages.

    Targets are looked up once each; a target that a third of all links share is then a broadcast fact.
    """
    links = internal_links(pages)
    stored = pages.select(page_path(F.col("url")).alias("target")).distinct().withColumn("stored", F.lit(True))
    facts = links.groupBy("target").agg(F.count("*").alias("copies")).join(stored, "target", "left")
    known = attach_facts(links, "target", facts, "copies", ["stored"], F.concat_ws(" ", "page_id", "href"))
    missing = _source(known.filter(F.col("stored").isNull()))
    detail = (
        text("link ", F.col("href"), " points to a page that does not exist")
        if include_text
        else F.lit("link points to a page that does not exist")
    )
    return as_findings(missing, "broken-link", detail, key=F.col("href") if include_text else None)


def link_stats(pages: DataFrame) -> DataFrame:
    """`page_id, links, external, inputs, images` per page."""
    html = F.col("html")
    controls = F.regexp_extract_all(html, F.lit(regex(CONTROL_TAG, "i")), F.lit(0))
    return pages.select("page_id", html, _hrefs(html).alias("hrefs")).select(
        "page_id",
        F.size("hrefs").alias("links"),
        F.size(F.filter("hrefs", lambda h: h.rlike(f"(?i){EXTERNAL}"))).alias("external"),
        F.size(F.filter(controls, _is_control)).alias("inputs"),
        F.regexp_count(html, F.lit(regex(IMG_TAG, "i"))).alias("images"),
    )


def browser_event_defects(events: DataFrame, include_text: bool = False) -> DataFrame:
    """Findings of a stored browser log `page_id, type, text, url, status, canceled`.

    Types: `error` and other console levels, `exception`, `response`, `failed`. A failed resource also logs a
    generic console line, which is left out.
    """
    kind, words = F.col("type"), F.coalesce("text", F.lit(""))
    console = (kind == "error") & ~words.rlike(f"(?i){RESOURCE_NOISE}")
    request = ((kind == "response") & (F.col("status") >= 400)) | ((kind == "failed") & ~F.coalesce("canceled", F.lit(False)))
    name = F.when(console | (kind == "exception"), "console-error").when(request, "bad-request")
    found = _source(events.withColumn("kind", name).filter(F.col("kind").isNotNull()))
    if include_text:
        detail = (
            F.when(kind == "response", text(F.col("status"), " ", F.coalesce("url", F.lit(""))))
            .when(kind == "failed", text("request failed: ", words))
            .otherwise(F.get(F.split(words, "\n", -1), F.lit(0)))
        )
    else:
        detail = F.when(kind == "response", text("status ", F.col("status"))).otherwise(kind)
    return as_findings(found, F.col("kind"), detail)


def page_findings(pages: DataFrame, css: DataFrame | None = None) -> DataFrame:
    """The seven markup and style checks in one scan of the pages."""

    def both(style: Column) -> Column:
        cells = (style["name"], style["css"], style["line"])
        return hits(_color_check(*cells), _physical_check(*cells))

    styled = F.flatten(F.transform(_own_styles(), both))
    found = from_hits(_with_labels(pages), F.concat(_head_hits(), _alt_hits(), _label_hits(), styled), "page_id")
    if css is None:
        return found
    sheets = css.filter(F.coalesce("css", F.lit("")) != "").select("page_id", F.lit("css").alias("name"), "css", F.lit(None).cast("int").alias("line"))
    return union_findings([found, hardcoded_color(sheets), physical_css(sheets)])


def site_rollup(findings: DataFrame, pages: DataFrame, checks: int = CHECKS) -> DataFrame:
    """`kind, findings, pages, checks` over many pages."""
    total = pages.select(F.count("*")).scalar()
    return (
        findings.groupBy("kind")
        .agg(F.count("*").alias("findings"))
        .select("kind", "findings", total.alias("pages"), F.lit(checks).alias("checks"))
    )
