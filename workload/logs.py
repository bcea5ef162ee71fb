"""Abuse signals and triage over logs made from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelight.functions import text as tx
from sievelight.operators import abuse, triage
from sievelight.operators.findings import by_kind, kinds
from sievelight.plans.session import stored
from sievelight.sources.known import add_known, mark_known
from sievelight.sources.lines import log_lines_from_text, read_log_lines
from sievelight.sources.sinks import save_known
from workload import inputs as i
from workload.files import scratch

HALF_HOUR = 1_800_000


def sql_burst(n: int, window: int, source: str = "lines") -> str:
    return (
        f'SELECT source, "row", ts_ms, CAST(total AS BIGINT) AS events FROM (SELECT *, sum(c) OVER (PARTITION BY source '
        f"ORDER BY ts_ms RANGE BETWEEN CURRENT ROW AND {window} FOLLOWING) AS total FROM (SELECT source, ts_ms, "
        f'min(n) AS "row", count(*) AS c FROM {source} WHERE ts_ms IS NOT NULL GROUP BY 1, 2)) WHERE total >= {n}'
    )


DENIED_LINES = (
    r"(SELECT * FROM lines WHERE regexp_matches(line, '(?i)\b(401|403)\b|unauthori|forbidden|failed login|invalid token'))"
)


def sql_sweep(n: int, window: int) -> str:
    return (
        "SELECT a.source, a.\"row\", a.ts_ms, count(DISTINCT t.token) AS ids FROM (SELECT source, ts_ms, min(n) AS \"row\" "
        "FROM tokens GROUP BY 1, 2) a JOIN tokens t ON a.source = t.source AND t.ts_ms BETWEEN a.ts_ms AND "
        f"a.ts_ms + {window} GROUP BY ALL HAVING count(DISTINCT t.token) >= {n}"
    )


SQL_TOKENS = (
    r"tokens AS (SELECT source, n, ts_ms, unnest(regexp_extract_all(regexp_replace(line, '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z', ''), "
    r"'\d{2,}')) AS token FROM lines)"
)


def sql_rhythm(max_cv: float) -> str:
    frame = "OVER (PARTITION BY source ORDER BY n ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)"
    return (
        f"SELECT source, n AS \"row\", mean_gap, spread / mean_gap AS cv FROM (SELECT source, n, count(gap) {frame} AS gaps, "
        f"min(gap) {frame} AS smallest, avg(gap) {frame} AS mean_gap, stddev_pop(gap) {frame} AS spread FROM ("
        "SELECT source, n, lead(ts_ms) OVER (PARTITION BY source ORDER BY n) - ts_ms AS gap FROM lines WHERE ts_ms IS NOT NULL)) "
        f"WHERE gaps = 8 AND smallest >= 0 AND mean_gap > 0 AND spread / mean_gap < {max_cv}"
    )


SQL_SHAPE = (
    r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(line, '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z', '')), "
    r"'[0-9a-f]{6,}', '#', 'g'), '\d+', '#', 'g'), '[^a-z# /._-]+', ' ', 'g'), '\s+', ' ', 'g'))"
)


def sql_template(n: int, minutes: int) -> str:
    return (
        f'SELECT source, min(n) AS "row", count(*) AS lines, count(DISTINCT ts_ms // 60000) AS minutes FROM (SELECT *, {SQL_SHAPE} AS shape '
        f"FROM lines) WHERE shape <> '' GROUP BY source, shape HAVING count(*) >= {n} AND count(DISTINCT ts_ms // 60000) >= {minutes}"
    )


# Thresholds at which every signal occurs in these logs.
LOUD = {"rate": (4, HALF_HOUR), "rhythm": (8, 0.4), "template": (5, 2), "auth": (3, HALF_HOUR), "sweep": (6, HALF_HOUR)}
SQL_ABUSE = (
    f"WITH {i.SQL_ACCESS}, {SQL_TOKENS}, found AS ("
    f"SELECT source, 'rate-burst' AS kind, \"row\", 'line ' || \"row\" || ' starts a 30min window with ' || events || ' timestamped lines' AS detail FROM ({sql_burst(4, HALF_HOUR)}) "
    f"UNION ALL SELECT source, 'machine-rhythm', \"row\", 'line ' || \"row\" || ' starts 8 even gaps' FROM ({sql_rhythm(0.4)}) "
    f"UNION ALL SELECT source, 'template-reuse', \"row\", 'line ' || \"row\" || ' shape repeats ' || lines || ' times across ' || minutes || ' minutes' FROM ({sql_template(5, 2)}) "
    f"UNION ALL SELECT source, 'auth-burst', \"row\", 'line ' || \"row\" || ' starts a 30min window with ' || events || ' denied lines' FROM ({sql_burst(3, HALF_HOUR, DENIED_LINES)}) "
    f"UNION ALL SELECT source, 'sweep', \"row\", 'line ' || \"row\" || ' starts a 30min window with ' || ids || ' distinct id tokens' FROM ({sql_sweep(6, HALF_HOUR)})), "
    'firsts AS (SELECT source, kind, min("row") AS "row", arg_min(detail, "row") AS detail FROM found GROUP BY 1, 2) '
)


SQL_NORM = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line,
  '^\s*\[?\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?Z?\]?\s*', ''),
  '\bses_[A-Za-z0-9]+\b', '<sid>', 'g'),
  '(?i)\b0x[0-9a-f]+\b', '<hex>', 'g'),
  '(?i)\b[0-9a-f]{10,}\b', '<hex>', 'g'),
  '(?:/[\w.-]+){3,}', '<path>', 'g'),
  '\b\d{1,3}(?:\.\d{1,3}){3}\b', '<ip>', 'g'),
  '\b\d{1,2}:\d{2}(?::\d{2})?Z?\b', '<t>', 'g'),
  '(?i)\b\d+(?:\.\d+)?\s?(?:ms|s|m|h|d|kb|mb|gb|%)([^A-Za-z]|$)', '<q>\1', 'g'),
  '-r\d+\b', '-r<n>', 'g'), '#\d+', '#<n>', 'g'), '\b\d+x\b', '<n>x', 'g'), '\b\d+\b', '<n>', 'g'), '\s+', ' ', 'g'))"""

SQL_HEADS = i.SQL_SERVICE + f""", heads AS (
  SELECT *, 'bt-' || left(sha1(pattern), 8) AS id,
    CASE WHEN regexp_matches(line, '(?i)\\b(?:0|no|zero|without)\\s+(?:errors?|failures?|failed|warnings?|exceptions?)\\b|\\b(?:errors?|failures?|failed|warnings?)\\s*[:=]\\s*0\\b|error_count=0') THEN 'info'
         WHEN regexp_matches(line, '(?i)\\b(?:error|fatal|exception|crash(?:ed)?|panic|traceback|segfault|unhandled|failed|failure)\\b') THEN 'error'
         WHEN regexp_matches(line, '(?i)\\b(?:warn(?:ing)?|stale|timeout|timed out|refused|denied|retry(?:ing)?|held|blocked|stuck|abort(?:ed)?|deprecated|noop|no valid lock|glitch)\\b') THEN 'warn'
         ELSE 'info' END AS severity, substr(line, 1, 19) AS ts
  FROM (SELECT source, line_no, line, {SQL_NORM} AS pattern FROM lines WHERE trim(line) <> '' AND NOT regexp_matches(line, '^\\s+\\S'))),
patterns AS (
  SELECT source, id, count(*) AS "count", min(line_no) AS first_line, arg_min(severity, line_no) AS severity, arg_min(pattern, line_no) AS pattern,
         arg_min(ts, line_no) AS first_ts, arg_max(ts, line_no) AS last_ts, arg_min(trim(line), line_no) AS sample
  FROM heads GROUP BY 1, 2),
families AS (
  SELECT source, array_to_string(string_split(regexp_replace(pattern, '^<sid> ', ''), ' ')[1:2], ' ') AS family, count(*) AS lines,
         min(line_no) AS first_line, CASE WHEN bool_or(severity = 'error') THEN 'error' ELSE 'warn' END AS severity
  FROM heads WHERE severity <> 'info' GROUP BY 1, 2),
stacks AS (
  SELECT source, head AS line_no, list(trim(line) ORDER BY line_no) AS stack FROM (
    SELECT l.source, l.line_no, l.line, (SELECT max(h.line_no) FROM heads h WHERE h.source = l.source AND h.line_no < l.line_no AND h.line_no >= l.line_no - 3) AS head
    FROM lines l WHERE regexp_matches(l.line, '^\\s+\\S')) JOIN patterns p USING (source) WHERE head = p.first_line GROUP BY 1, 2),
context AS (
  SELECT p.source, p.first_line AS line_no, coalesce(list(trim(l.line) ORDER BY l.line_no) FILTER (trim(l.line) <> ''), []) AS before
  FROM patterns p LEFT JOIN lines l ON l.source = p.source AND l.line_no BETWEEN p.first_line - 2 AND p.first_line - 1 GROUP BY 1, 2)"""


def _known(spark, sf_dir):
    """Ids of the even log, kept as a stored table."""
    even = i.service_lines(spark, sf_dir).filter("source = 'even'")
    folder = scratch(spark)
    save_known(triage.pattern_counts(even).filter("severity <> 'info'"), folder)
    return spark.read.parquet(folder)


def _marked(spark, sf_dir):
    """All problem patterns against a set that took the even log's in two runs, the second with nothing new in half of them."""
    patterns = stored(triage.pattern_counts(i.service_lines(spark, sf_dir)).filter("severity <> 'info'"))
    even, folder = patterns.filter("source = 'even'"), scratch(spark)
    add_known(even.filter("first_line % 2 = 0"), folder)
    add_known(even, folder)
    return mark_known(patterns, folder).select("source", "id", "status")


SQL_KNOWN = "SELECT DISTINCT id FROM patterns WHERE source = 'even' AND severity <> 'info'"


def _abuse(fn, **settings):
    return lambda spark, sf_dir: fn(i.access_lines(spark, sf_dir), **settings)


def _triage(fn):
    return lambda spark, sf_dir: fn(i.service_lines(spark, sf_dir))


def _read_log_lines(spark, sf_dir):
    folder = scratch(spark)
    i.access_lines(spark, sf_dir).select("line").write.text(folder)
    return read_log_lines(spark, folder).select("line", "ts_ms")


def _document_log(spark, sf_dir):
    docs = i.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source"), "text")
    return log_lines_from_text(docs).select("source", "line_no", "n", F.length("line").alias("chars"))


def _joined(df, name):
    return df.withColumn(name, F.array_join(name, " / "))


def _triage_report(spark, sf_dir):
    got = triage.triage(stored(i.service_lines(spark, sf_dir)), _known(spark, sf_dir))
    return _joined(_joined(got, "before"), "stack").select("source", "id", "status", "count", "first_line", "before", "stack")


QUERIES = {
    "read_log_lines": (_read_log_lines, f"WITH {i.SQL_ACCESS} SELECT line, ts_ms FROM lines"),
    "log_lines_from_text": (
        _document_log,
        f"WITH {i.SQL_DOCUMENT_LINES} SELECT source, line_no, row_number() OVER (PARTITION BY source ORDER BY line_no) AS n, "
        "CAST(length(line) AS INTEGER) AS chars FROM lines WHERE trim(line) <> ''",
    ),
    "shape_of": (
        lambda s, d: i.access_lines(s, d).groupBy("source", tx.shape_of(F.col("line")).alias("shape")).agg(F.count("*").alias("lines")),
        f"WITH {i.SQL_ACCESS} SELECT source, {SQL_SHAPE} AS shape, count(*) AS lines FROM lines GROUP BY 1, 2",
    ),
    "rate_burst": (_abuse(abuse.rate_burst, n=4, window_ms=HALF_HOUR), f"WITH {i.SQL_ACCESS} {sql_burst(4, HALF_HOUR)}"),
    "machine_rhythm": (
        lambda s, d: abuse.machine_rhythm(i.access_lines(s, d), max_cv=0.4).select(
            "source", "row", F.round("mean_gap", 3).alias("mean_gap"), F.round("cv", 6).alias("cv")
        ),
        f'WITH {i.SQL_ACCESS} SELECT source, "row", round(mean_gap, 3) AS mean_gap, round(cv, 6) AS cv FROM ({sql_rhythm(0.4)})',
    ),
    "template_reuse": (_abuse(abuse.template_reuse), f"WITH {i.SQL_ACCESS} {sql_template(5, 2)}"),
    "auth_burst": (_abuse(abuse.auth_burst, n=3, window_ms=HALF_HOUR), f"WITH {i.SQL_ACCESS} {sql_burst(3, HALF_HOUR, DENIED_LINES)}"),
    "id_sweep": (_abuse(abuse.id_sweep, n=6, window_ms=HALF_HOUR), f"WITH {i.SQL_ACCESS}, {SQL_TOKENS} {sql_sweep(6, HALF_HOUR)}"),
    "abuse_findings": (
        lambda s, d: abuse.abuse_findings(stored(i.access_lines(s, d)), **LOUD).drop("key"),
        SQL_ABUSE + "SELECT source, kind, \"row\", detail FROM firsts",
    ),
    "abuse_findings_all": (
        lambda s, d: abuse.abuse_findings(stored(i.access_lines(s, d)), first_only=False, **LOUD).drop("key"),
        SQL_ABUSE + 'SELECT source, kind, "row", detail FROM found',
    ),
    "scan_totals": (
        _abuse(abuse.scan_totals),
        f"WITH {i.SQL_ACCESS} SELECT source, count(*) AS rows, count(ts_ms) AS events FROM lines GROUP BY 1",
    ),
    "kinds": (
        lambda s, d: _joined(kinds(abuse.abuse_findings(stored(i.access_lines(s, d)), **LOUD)), "kinds"),
        SQL_ABUSE + "SELECT source, array_to_string(list(kind ORDER BY kind), ' / ') AS kinds FROM firsts GROUP BY 1",
    ),
    "by_kind": (
        lambda s, d: by_kind(abuse.abuse_findings(stored(i.access_lines(s, d)), first_only=False, **LOUD)),
        SQL_ABUSE + "SELECT source, kind, count(*) AS findings FROM found GROUP BY 1, 2",
    ),
    "normalize_line": (
        lambda s, d: triage.head_lines(i.service_lines(s, d)).groupBy("source", "pattern").agg(F.count("*").alias("lines")),
        f"WITH {SQL_HEADS} SELECT source, pattern, count(*) AS lines FROM heads GROUP BY 1, 2",
    ),
    "severity": (
        lambda s, d: triage.head_lines(i.service_lines(s, d)).groupBy("source", "severity").agg(F.count("*").alias("lines")),
        f"WITH {SQL_HEADS} SELECT source, severity, count(*) AS lines FROM heads GROUP BY 1, 2",
    ),
    "fingerprint": (
        lambda s, d: triage.head_lines(i.service_lines(s, d)).select("source", "line_no", "id"),
        f"WITH {SQL_HEADS} SELECT source, line_no, id FROM heads",
    ),
    "pattern_agg": (
        _triage(triage.pattern_agg),
        f'WITH {SQL_HEADS} SELECT source, id, severity, "count", pattern, first_line, first_ts, last_ts, sample FROM patterns',
    ),
    "attach_continuations": (
        lambda s, d: _joined(triage.attach_continuations(stored(i.service_lines(s, d))), "stack"),
        f"WITH {SQL_HEADS} SELECT source, line_no, array_to_string(stack, ' / ') AS stack FROM stacks",
    ),
    "line_context": (
        lambda s, d: _joined(triage.line_context(i.service_lines(s, d)), "before"),
        f"WITH {SQL_HEADS} SELECT source, line_no, array_to_string(before, ' / ') AS before FROM context",
    ),
    "family_agg": (_triage(triage.family_agg), f"WITH {SQL_HEADS} SELECT source, family, severity, lines, first_line FROM families"),
    "rank_problems": (
        lambda s, d: triage.rank_problems(triage.pattern_agg(i.service_lines(s, d)), numbered=True).select(
            "source", "id", "severity", "count", "first_line", "place"
        ),
        f'WITH {SQL_HEADS} SELECT source, id, severity, "count", first_line, row_number() OVER (PARTITION BY source '
        "ORDER BY severity, \"count\" DESC, first_line) AS place FROM patterns WHERE severity <> 'info'",
    ),
    "save_known": (_known, f"WITH {SQL_HEADS} {SQL_KNOWN}"),
    "new_vs_known": (
        lambda s, d: triage.new_vs_known(
            triage.rank_problems(triage.pattern_agg(i.service_lines(s, d))), _known(s, d)
        ).select("source", "id", "status"),
        f"WITH {SQL_HEADS}, known AS ({SQL_KNOWN}) SELECT source, id, CASE WHEN id IN (SELECT id FROM known) THEN 'known' ELSE 'new' END AS status "
        "FROM patterns WHERE severity <> 'info'",
    ),
    "mark_known": (
        _marked,
        f"WITH {SQL_HEADS}, known AS ({SQL_KNOWN}) SELECT source, id, CASE WHEN id IN (SELECT id FROM known) THEN 'known' ELSE 'new' END AS status "
        "FROM patterns WHERE severity <> 'info'",
    ),
    "triage": (
        _triage_report,
        f"WITH {SQL_HEADS}, known AS ({SQL_KNOWN}) SELECT p.source, p.id, CASE WHEN p.id IN (SELECT id FROM known) THEN 'known' ELSE 'new' END AS status, "
        "p.\"count\", p.first_line, array_to_string(c.before, ' / ') AS before, coalesce(array_to_string(s.stack, ' / '), '') AS stack FROM patterns p "
        "JOIN context c ON c.source = p.source AND c.line_no = p.first_line LEFT JOIN stacks s ON s.source = p.source AND s.line_no = p.first_line "
        "WHERE p.severity <> 'info'",
    ),
    "triage_summary": (
        lambda s, d: triage.triage_summary(i.service_lines(s, d)),
        f"WITH {SQL_HEADS}, f AS (SELECT source, count(*) AS families, max(lines) AS biggest_family FROM families GROUP BY 1) "
        'SELECT source, CAST(sum("count") AS BIGINT) AS lines, count(*) AS patterns, count(*) FILTER (severity <> \'info\') AS problem_patterns, '
        "count(*) FILTER (severity = 'error') AS error_patterns, any_value(families) AS families, any_value(biggest_family) AS biggest_family "
        "FROM patterns LEFT JOIN f USING (source) GROUP BY 1",
    ),
}
