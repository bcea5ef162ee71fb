"""Retrieval, page audits and text audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelight.functions.text import tokenize
from sievelight.operators import pages as pg
from sievelight.operators import retrieval as rt
from sievelight.operators import textaudit as ta
from sievelight.plans.session import stored
from sievelight.plans.sizing import broadcast_if_small
from sievelight.sources.lines import decode_bytes
from workload import inputs as i

TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
SQL_INDEX = (
    f"toks AS (SELECT doc_id AS doc, {TOKENS} AS tokens FROM documents), lengths AS (SELECT doc, len(tokens) AS length FROM toks), "
    "postings AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(tokens) AS term FROM toks) GROUP BY 1, 2), "
    "dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY 1), stats AS (SELECT count(*) AS n, avg(length) AS average FROM lengths)"
)
SQL_TERMS = (
    "terms AS (SELECT query, term, min(pos) AS pos FROM (SELECT item_id AS query, unnest(t) AS term, unnest(range(len(t))) AS pos FROM ("
    f"SELECT item_id, {TOKENS} AS t FROM benchmark)) GROUP BY 1, 2)"
)
SQL_RANKED = (
    f"{SQL_INDEX}, {SQL_TERMS}, matched AS (SELECT query, doc, term, pos, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, "
    "tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * greatest(length, 1) / average)) AS part FROM terms JOIN postings USING (term) JOIN dfs USING (term) JOIN lengths USING (doc), stats), "
    "summed AS (SELECT query, doc, round(sum(idf * part), 9) AS raw FROM matched GROUP BY 1, 2), "
    "ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY raw DESC, doc) AS INTEGER) AS place FROM summed WHERE raw > 0 QUALIFY place <= 5)"
)


def _index(spark, sf_dir):
    return rt.build_index(i.documents(spark, sf_dir))


def _ranked(spark, sf_dir, digits=6, hits=False):
    return rt.bm25_topk(_index(spark, sf_dir), i.benchmark_queries(spark, sf_dir), digits=digits, hits=hits)


def _postings(spark, sf_dir):
    return _index(spark, sf_dir).postings.drop("source")


def _weights(spark, sf_dir):
    index = _index(spark, sf_dir)
    weighted = index.df.join(broadcast_if_small(index.stats), "source")
    return weighted.select("term", "df", F.round(rt.idf(F.col("df"), F.col("n")), 9).alias("idf"))


def _hits(spark, sf_dir):
    got = _ranked(spark, sf_dir, hits=True)
    return got.select("query", "place", "doc", F.array_join("hits", " ").alias("hits"))


def _expectations(spark, sf_dir):
    """Each benchmark passage expects the document of its own number, and one of its three best, so that all places occur."""
    own = i.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.col("item_id").alias("doc"))
    ranked = stored(_ranked(spark, sf_dir))
    best = ranked.filter(F.col("place") == F.col("query") % 3 + 1).select("query", "doc")
    return rt.rank_eval(ranked, own.unionByName(best).distinct())


def _decoded(spark, sf_dir):
    """Documents as bytes in three encodings, decoded again."""
    docs = i.table(spark, sf_dir, "documents")
    content = (
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE")))
        .when(F.col("doc_id") % 3 == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")))
        .otherwise(F.encode("text", "UTF-8"))
    )
    text = decode_bytes(content)
    return docs.select("doc_id", F.md5(text.cast("binary")).alias("digest"), F.length(text).alias("chars"))


PHRASES = ("of the", "nicht", "les", "para los", "was", "state-of-the-art")


def _finding(kind: str, words: str, where: str, relation: str, row: str = "CAST(NULL AS BIGINT)", key: str = "CAST(NULL AS VARCHAR)") -> str:
    return (
        f"SELECT CAST(page_id AS VARCHAR) AS source, '{kind}' AS kind, {row} AS \"row\", {key} AS key, {words} AS detail FROM {relation} WHERE {where}"
    )


SQL_TAG = r"regexp_extract(html, '(?i)<html\b[^>]*>')"
SQL_LANG = rf"regexp_extract({SQL_TAG}, '(?i)\blang\s*=\s*[\"'']?([\w-]+)', 1)"
SQL_TITLE = r"trim(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1))"
SQL_HEAD = " UNION ALL ".join(
    [
        _finding("missing-lang", "'html has no lang attribute'", f"{SQL_LANG} = ''", "source_pages"),
        _finding("no-title", "'page has no title'", f"{SQL_TITLE} = ''", "source_pages"),
        _finding(
            "missing-dir",
            "'Hebrew page without dir=rtl'",
            rf"regexp_matches({SQL_LANG}, '(?i)^he') AND lower(regexp_extract({SQL_TAG}, '(?i)\bdir\s*=\s*[\"'']?([\w-]+)', 1)) <> 'rtl'",
            "source_pages",
        ),
    ]
)
SQL_CHANGED = (
    "source_pages AS (SELECT page_id, url, replace(CASE WHEN page_id % 5 = 1 THEN replace(html, '<html lang=\"fr\"', '<html lang=\"he\"') "
    "WHEN page_id % 5 = 2 THEN replace(html, ' lang=', ' data-x=') ELSE html END, '<title>', CASE WHEN page_id % 7 = 0 THEN '<title></title><title>' ELSE '<title>' END) AS html FROM pages)"
)


def _changed_pages(spark, sf_dir):
    """Pages with some heads broken."""
    return i.table(spark, sf_dir, "pages").selectExpr(
        "page_id",
        "url",
        "replace(case when page_id % 5 = 1 then replace(html, '<html lang=\"fr\"', '<html lang=\"he\"')"
        " when page_id % 5 = 2 then replace(html, ' lang=', ' data-x=') else html end, '<title>',"
        " if(page_id % 7 = 0, '<title></title><title>', '<title>')) as html",
    )


SQL_ALT = _finding(
    "missing-alt",
    "'line ' || line || ': img tag without an alt attribute'",
    r"NOT regexp_matches(match, '(?i)\balt\s*=')",
    i.sql_spans("forms", r"(?i)<img\b[^>]*>"),
    "line",
)
# Controls inside a label block are fine, so the blocks are cut out first; they hold no line breaks.
SQL_BARE = (
    r"(SELECT page_id, regexp_replace(html, '(?is)<label\b[^>]*>.*?</label\s*>', '', 'g') AS html, "
    r"regexp_extract_all(html, '(?i)<label\b[^>]*\bfor\s*=\s*[\"'']?([\w-]+)', 1) AS for_ids FROM forms)"
)
SQL_TAG_NAME = r"lower(regexp_extract(match, '(?i)<(input|select|textarea)', 1))"
SQL_LABEL = _finding(
    "missing-label",
    f"'line ' || line || ': ' || {SQL_TAG_NAME} || ' control without a label, aria-label or title'",
    rf"NOT ({SQL_TAG_NAME} = 'input' AND lower(regexp_extract(match, '(?i)\btype\s*=\s*[\"'']?([\w-]+)', 1)) IN ('hidden', 'submit', 'button', 'reset', 'image')) "
    r"AND NOT list_contains(for_ids, regexp_extract(match, '(?i)\bid\s*=\s*[\"'']?([\w-]+)', 1)) AND NOT regexp_matches(match, '(?i)\b(aria-label|aria-labelledby|title)\s*=')",
    i.sql_spans(SQL_BARE, r"(?i)<(?:input|select|textarea)\b[^>]*>", "page_id, for_ids"),
    "line",
)
SQL_STYLES = (
    r"styles AS (SELECT page_id, 'inline style' AS name, regexp_extract(match, '\"([^\"]*)\"', 1) AS css, line FROM "
    + i.sql_spans("forms", r'(?i)\bstyle\s*=\s*"[^"]*"')
    + r" UNION ALL SELECT page_id, 'style block', regexp_extract(match, '(?is)<style\b[^>]*>(.*?)</style\s*>', 1), line FROM "
    + i.sql_spans("forms", r"(?is)<style\b[^>]*>.*?</style\s*>")
    + ")"
)
SQL_COLOR = _finding(
    "hardcoded-color",
    "name || ' at line ' || line || ' uses a hardcoded color'",
    r"regexp_matches(css, '(?i)#[0-9a-f]{3,8}\b|\brgba?\s*\(|\bhsla?\s*\(')",
    "styles",
    "line",
    "name",
)
SQL_PHYSICAL = _finding(
    "physical-css",
    "name || ' at line ' || line || ' uses a physical property'",
    r"regexp_matches(css, '(?i)\b(margin|padding|border)-(left|right)\b|\bborder-(top|bottom)-(left|right)-radius\b|(text-align|float|clear)\s*:\s*(left|right)\b|(^|[^\w-])(left|right)\s*:')",
    "styles",
    "line",
    "name",
)
SQL_HREFS = (
    "hrefs AS (SELECT page_id, url, html, unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*\\shref\\s*=\\s*\"([^\"]*)\"', 1)) AS href FROM forms)"
)
SQL_ANCHOR = _finding(
    "broken-link", "'anchor has no target id'", "href LIKE '#_%' AND NOT contains(html, ' id=\"' || substr(href, 2) || '\"')", "hrefs"
)
SQL_BROKEN = (
    r"targets AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+') || '/' || array_to_string(list_filter(string_split(regexp_replace(href, '[?#].*', ''), '/'), "
    r"lambda x: x <> '' AND x <> '.'), '/') AS target FROM hrefs WHERE href LIKE '/%'), "
    r"stored AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]+') || '/' || array_to_string(list_filter(string_split(regexp_replace(regexp_extract(url, '^[a-z]+://[^/]+(.*)$', 1), "
    r"'[?#].*', ''), '/'), lambda x: x <> '' AND x <> '.'), '/') AS target FROM pages) "
)
FORMS = f"WITH {i.SQL_FORMS}"
SQL_ALL_PAGES = " UNION ALL ".join([SQL_HEAD.replace("source_pages", "forms"), SQL_ALT, SQL_LABEL, SQL_COLOR, SQL_PHYSICAL])


def _forms(fn):
    return lambda spark, sf_dir: fn(i.page_forms(spark, sf_dir))


def _browser_events(spark, sf_dir):
    """Events as a stored browser log."""
    events = i.table(spark, sf_dir, "events").selectExpr(
        "user_id as page_id",
        "case event_type when 'error' then 'error' when 'view' then 'response' when 'click' then 'failed' when 'signup' then 'exception' else 'log' end as type",
        "if(value > 20, 'failed to load resource: x', concat('broke at ', event_id)) as text",
        "concat('https://a.test/', event_id) as url",
        "cast(if(value > 10, 404, 200) as int) as status",
        "if(value > 15, true, null) as canceled",
    )
    return pg.browser_event_defects(events)


SQL_BROWSER = (
    "SELECT CAST(user_id AS VARCHAR) AS source, CASE WHEN event_type IN ('error', 'signup') THEN 'console-error' ELSE 'bad-request' END AS kind, CAST(NULL AS BIGINT) AS \"row\", "
    "CAST(NULL AS VARCHAR) AS key, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'exception' WHEN 'view' THEN 'status 404' ELSE 'failed' END AS detail FROM events "
    "WHERE (event_type = 'error' AND value <= 20) OR event_type = 'signup' OR (event_type = 'view' AND value > 10) OR (event_type = 'click' AND value <= 15)"
)

def _headed_lines(spark, sf_dir):
    """Document lines as headings."""
    return i.document_lines(spark, sf_dir).select("source", "line_no", F.concat(F.lit("## "), F.col("line")).alias("line"))


SQL_SECTIONS = (
    "SELECT source, 'missing-section' AS kind, CAST(NULL AS BIGINT) AS \"row\", s AS key, 'runbook is missing a ' || s || ' section' AS detail FROM ("
    "SELECT source, unnest(list_filter([CASE WHEN NOT bool_or(regexp_matches(line, '(?i)^Of\\b')) THEN 'Of' END, CASE WHEN NOT bool_or(regexp_matches(line, '(?i)^The\\b')) THEN 'The' END, "
    "CASE WHEN NOT bool_or(regexp_matches(line, '(?i)^Es\\b')) THEN 'Es' END], lambda x: x IS NOT NULL)) AS s FROM lines GROUP BY source HAVING bool_or(regexp_matches(line, '(?i)the')))"
)
SQL_JARGON = " UNION ALL ".join(
    f"SELECT source, 'jargon' AS kind, line_no AS \"row\", '{p}' AS key, 'line ' || line_no || ' uses banned jargon \"{p}\"' AS detail FROM lines "
    f"WHERE regexp_matches(line, '(?i)\\b{p.replace(' ', chr(92) + 's+')}\\b')"
    for p in PHRASES
)
SQL_LONG = (
    "SELECT source, 'long-line' AS kind, line_no AS \"row\", CAST(NULL AS VARCHAR) AS key, 'line ' || line_no || ' is ' || length(line) || ' chars (limit 120)' AS detail FROM lines WHERE length(line) > 120"
)

QUERIES = {
    "decode_bytes": (_decoded, "SELECT doc_id, md5(text) AS digest, CAST(length(text) AS INTEGER) AS chars FROM documents"),
    "tokenize": (
        lambda s, d: i.documents(s, d).select("doc", F.size(tokenize(F.col("text"))).alias("tokens")),
        f"SELECT doc_id AS doc, CAST(len({TOKENS}) AS INTEGER) AS tokens FROM documents",
    ),
    "build_index": (
        _postings,
        f"WITH {SQL_INDEX} SELECT doc, CAST(length AS INTEGER) AS length, term, tf FROM postings JOIN lengths USING (doc)",
    ),
    "idf": (_weights, f"WITH {SQL_INDEX} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 9) AS idf FROM dfs, stats"),
    "bm25_topk": (
        lambda s, d: _ranked(s, d).drop("source"),
        f"WITH {SQL_RANKED} SELECT query, place, doc, round(raw, 6) AS score FROM ranked",
    ),
    "hit_terms": (
        _hits,
        f"WITH {SQL_RANKED} SELECT query, any_value(place) AS place, doc, string_agg(term, ' ' ORDER BY round(idf, 9) DESC, pos) AS hits FROM ranked JOIN matched USING (query, doc) GROUP BY query, doc",
    ),
    "rank_eval": (
        _expectations,
        f"WITH {SQL_RANKED} SELECT e.query, e.doc, place, coalesce(place = 1, false) AS at_first, place IS NULL AS miss "
        "FROM (SELECT item_id AS query, item_id AS doc FROM benchmark UNION SELECT query, doc FROM ranked WHERE place = query % 3 + 1) e "
        "LEFT JOIN ranked r ON r.query = e.query AND r.doc = e.doc",
    ),
    "index_stats": (
        lambda s, d: rt.index_stats(_index(s, d), i.benchmark_queries(s, d)),
        f"WITH {SQL_INDEX} SELECT 'documents' AS source, (SELECT n FROM stats) AS files, (SELECT count(*) FROM dfs) AS terms, (SELECT count(*) FROM benchmark) AS queries",
    ),
    "page_head": (lambda s, d: pg.page_head(_changed_pages(s, d)), f"WITH {SQL_CHANGED} {SQL_HEAD}"),
    "missing_alt": (_forms(pg.missing_alt), f"{FORMS} {SQL_ALT}"),
    "missing_label": (_forms(pg.missing_label), f"{FORMS} {SQL_LABEL}"),
    "style_sources": (
        _forms(pg.style_sources),
        f"{FORMS}, {SQL_STYLES} SELECT page_id, name, css, CAST(line AS INTEGER) AS line FROM styles",
    ),
    "hardcoded_color": (lambda s, d: pg.hardcoded_color(pg.style_sources(i.page_forms(s, d))), f"{FORMS}, {SQL_STYLES} {SQL_COLOR}"),
    "physical_css": (lambda s, d: pg.physical_css(pg.style_sources(i.page_forms(s, d))), f"{FORMS}, {SQL_STYLES} {SQL_PHYSICAL}"),
    "match_lines": (
        lambda s, d: i.page_forms(s, d)
        .select("page_id", F.explode(pg.match_lines(F.col("html"), r"</p>")).alias("m"))
        .groupBy("page_id", F.col("m.line").cast("long").alias("line"))
        .agg(F.count("*").alias("matches")),
        f"{FORMS} SELECT page_id, line, count(*) AS matches FROM {i.sql_spans('forms', '</p>')} GROUP BY 1, 2",
    ),
    "broken_anchor": (_forms(pg.broken_anchor), f"{FORMS}, {SQL_HREFS} {SQL_ANCHOR}"),
    "broken_link": (
        _forms(pg.broken_link),
        f"{FORMS}, {SQL_HREFS}, {SQL_BROKEN} "
        + _finding("broken-link", "'link points to a page that does not exist'", "target NOT IN (SELECT target FROM stored)", "targets"),
    ),
    "link_stats": (
        _forms(pg.link_stats),
        f"{FORMS} SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<a\\b[^>]*\\shref\\s*=')) AS INTEGER) AS links, "
        "CAST(len(regexp_extract_all(html, '(?i)<a\\b[^>]*\\shref\\s*=\\s*\"https?://')) AS INTEGER) AS external, "
        "CAST(len(regexp_extract_all(html, '(?i)<(input|select|textarea)\\b')) - CASE WHEN page_id % 5 = 0 THEN 1 ELSE 0 END AS INTEGER) AS inputs, "
        "CAST(len(regexp_extract_all(html, '(?i)<img\\b')) AS INTEGER) AS images FROM forms",
    ),
    "browser_event_defects": (_browser_events, SQL_BROWSER),
    "page_findings": (_forms(pg.page_findings), f"{FORMS}, {SQL_STYLES} {SQL_ALL_PAGES}"),
    "site_rollup": (
        lambda s, d: pg.site_rollup(pg.page_findings(i.page_forms(s, d)), i.page_forms(s, d)),
        f"{FORMS}, {SQL_STYLES} SELECT kind, count(*) AS findings, (SELECT count(*) FROM forms) AS pages, 7 AS checks FROM ({SQL_ALL_PAGES}) GROUP BY 1",
    ),
    "jargon": (lambda s, d: ta.jargon(i.document_lines(s, d), PHRASES), f"WITH {i.SQL_DOCUMENT_LINES} {SQL_JARGON}"),
    "long_line": (lambda s, d: ta.long_line(i.document_lines(s, d)), f"WITH {i.SQL_DOCUMENT_LINES} {SQL_LONG}"),
    "missing_section": (
        lambda s, d: ta.missing_section(_headed_lines(s, d), "the", ("Of", "The", "Es")),
        f"WITH {i.SQL_DOCUMENT_LINES} {SQL_SECTIONS}",
    ),
    "text_findings": (
        lambda s, d: ta.text_findings(i.document_lines(s, d)),
        f"WITH {i.SQL_DOCUMENT_LINES} {SQL_LONG} UNION ALL "
        + " UNION ALL ".join(
            f"SELECT source, 'jargon', line_no, '{p}', 'line ' || line_no || ' uses banned jargon \"{p}\"' FROM lines WHERE regexp_matches(line, '(?i)\\b{p.replace(' ', chr(92) + 's+')}\\b')"
            for p in ta.JARGON
        )
        + " UNION ALL SELECT source, 'missing-section', NULL, s, 'runbook is missing a ' || s || ' section' FROM (SELECT source, unnest(list_filter(["
        + ", ".join(f"CASE WHEN NOT bool_or(regexp_matches(line, '(?i)^#{{1,3}}\\s*{s}\\b')) THEN '{s}' END" for s in ta.SECTIONS)
        + "], lambda x: x IS NOT NULL)) AS s FROM lines GROUP BY source HAVING bool_or(regexp_matches(line, '(?i)runbook')))",
    ),
}
