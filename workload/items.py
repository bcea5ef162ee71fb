"""Board, requirement and file-corpus audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelight.operators import board as bd
from sievelight.operators import filecorpus as fc
from sievelight.operators import requirements as rq
from sievelight.plans.session import stored
from sievelight.sources.corpus import read_md_table
from workload import inputs as i

ITEMS = f"WITH {i.SQL_ITEMS}"


def sql_item(kind: str, words: str, where: str) -> str:
    return f"SELECT source, '{kind}' AS kind, CAST(line AS BIGINT) AS \"row\", id AS key, id || ' {words}' AS detail FROM items WHERE {where}"


SQL_PROOFS = " UNION ALL ".join(
    [
        sql_item("missing-f2p", "has no F2P proof line", "NOT regexp_matches(done_when, '(?i)F2P')"),
        sql_item("missing-p2p", "has no P2P proof line", "NOT regexp_matches(done_when, '(?i)P2P')"),
    ]
)
SQL_OWNER = " UNION ALL ".join(
    [
        sql_item("missing-owner", "names no owner role", "owner = ''"),
        sql_item("missing-scorecard", "names no scorecard row", "scorecard = ''"),
    ]
)
SQL_STATUS = " UNION ALL ".join(
    [
        sql_item("done-without-evidence", "is DONE with empty evidence", "upper(status) = 'DONE' AND evidence = ''"),
        sql_item("blocked-without-next", "is BLOCKED with empty evidence", "upper(status) = 'BLOCKED' AND evidence = ''"),
    ]
)


def _on(build, fn):
    return lambda spark, sf_dir: fn(build(spark, sf_dir))


def _reqs(spark, sf_dir):
    return rq.parse_requirements(i.spec_lines(spark, sf_dir))


def _coverage(spark, sf_dir):
    lines, reqs = i.spec_lines(spark, sf_dir), stored(_reqs(spark, sf_dir))
    return rq.coverage(reqs, rq.plan_cases(reqs), rq.parse_proofs(lines))


SPECS = f"WITH {i.SQL_SPECS}"
SQL_FLAGS = (
    "SELECT source, flag AS kind, line_no AS \"row\", id AS key, CASE flag WHEN 'incomplete' THEN 'says \"' || regexp_extract(text, '(?i)\\b(tbd|todo|to be decided|to be defined|fill me)\\b') || '\"' "
    "ELSE '\"' || regexp_extract(text, '(?i)\\b(fast|quick|easy|simple)\\b') || '\" with no number or example' END AS detail FROM judged WHERE flag IS NOT NULL"
)

FILES = f"WITH {i.SQL_FILES}"


def sql_file(kind: str, words: str, where: str, row: str = "CAST(NULL AS BIGINT)") -> str:
    return f"SELECT source, '{kind}' AS kind, {row} AS \"row\", name AS key, name || ' {words}' AS detail FROM files WHERE {where}"


SQL_MISSING_FILE = (
    "SELECT source, 'missing-file' AS kind, CAST(NULL AS BIGINT) AS \"row\", name AS key, name || ' missing from the scaffold' AS detail FROM (SELECT source, unnest(list_filter(["
    + ", ".join(f"CASE WHEN NOT bool_or(name = '{n}') THEN '{n}' END" for n in fc.REQUIRED_FILES)
    + ", CASE WHEN NOT bool_or(name IN ('agent.md', 'AGENT.md')) THEN 'agent.md' END], lambda x: x IS NOT NULL)) AS name FROM files GROUP BY source)"
)
SQL_WIDE = sql_file(
    "overbroad-scope",
    "grants tools by wildcard",
    r"name IN ('agent.md', 'AGENT.md') AND regexp_matches(text, '(?i)\btools\s*:\s*(\*|\"all\"|''all''|\[\s*\*\s*\])|allow[^:\n]{0,40}:\s*(shell|anything|all\b)|run\s+any\s+(command|thing|tool)')",
)
SQL_FRONT = sql_file(
    "bad-frontmatter",
    "lacks name/description front matter",
    r"name = 'SKILL.md' AND NOT regexp_matches(text, '(?ms)^---\s*.*?\bname:\s*\S+.*?\bdescription:\s*\S+.*?---')",
)
SQL_UNSAFE = (
    "SELECT source, 'unsafe-capability' AS kind, CAST(min(no) AS BIGINT) AS \"row\", name AS key, name || ' runs a network, shell or eval capability' AS detail FROM ("
    "SELECT source, name, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS no FROM (SELECT source, name, string_split(text, chr(10)) AS parts FROM files "
    "WHERE name IN ('run.mjs', 'server.mjs', 'main.mjs', 'index.mjs'))) "
    r"WHERE regexp_matches(line, '(?i)fetch\s*\(|http\s*\.\s*request|https\s*\.\s*request|WebSocket\s*\(|child_process|execSync|eval\s*\(|rm\s+-rf') "
    r"AND NOT regexp_matches(line, 'localhost|127\.0\.0\.1') GROUP BY source, name"
)
SQL_SECRET = r"regexp_matches(name, '(?i)\.(md|mjs|json)$') AND regexp_matches(text, '(?i)sk-[A-Za-z0-9]{8,}|AKIA[0-9A-Z]{16}|api[_-]?key\s*[:=]\s*[\"''][^\"'' ]{6,}[\"'']')"
SQL_LEAKS = sql_file("secret-leak", "holds a key-like secret in the open", SQL_SECRET)
SQL_FIRST_LEAK = SQL_LEAKS.replace("FROM files WHERE", "FROM (SELECT source, min(name) AS name FROM files WHERE") + " GROUP BY source)"
SQL_BROKEN = sql_file("broken-manifest", "is not valid JSON", "name IN ('mcp.json', 'package.json', 'manifest.json') AND NOT json_valid(text)")


def _secret_files(spark, sf_dir):
    """The same files with a key planted where the text has a long number."""
    planted = F.regexp_replace("text", "[0-9]{12,}", "sk-abcd1234efgh")
    return i.scaffold_files(spark, sf_dir).withColumn("text", planted)


SECRETS = f"WITH {i.SQL_FILES.replace('files AS', 'plain AS', 1)}, files AS (SELECT source, name, regexp_replace(text, '[0-9]{{12,}}', 'sk-abcd1234efgh', 'g') AS text FROM plain)"


def _manifest(spark, sf_dir):
    """Documents as paths of repositories of ten files."""
    return i.table(spark, sf_dir, "documents").selectExpr(
        "concat('r', cast(floor(doc_id / 10) as bigint)) as source",
        "case lang when 'en' then if(n_chars % 3 = 0, concat('test/t', doc_id, '.test.js'), concat('tests/sub/t', doc_id, '.test.mjs'))"
        " when 'fr' then if(n_chars % 2 = 0, concat('tests/test_', doc_id, '.py'), 'pytest.ini')"
        " when 'de' then if(n_chars % 2 = 0, 'Cargo.toml', 'lib/Cargo.toml') else concat('s', doc_id, if(n_chars % 2 = 0, '.sln', '.txt')) end as path",
    )


SQL_KINDS = r"""WITH manifest AS (
  SELECT 'r' || (doc_id // 10) AS source, CASE lang
    WHEN 'en' THEN CASE WHEN n_chars % 3 = 0 THEN 'test/t' || doc_id || '.test.js' ELSE 'tests/sub/t' || doc_id || '.test.mjs' END
    WHEN 'fr' THEN CASE WHEN n_chars % 2 = 0 THEN 'tests/test_' || doc_id || '.py' ELSE 'pytest.ini' END
    WHEN 'de' THEN CASE WHEN n_chars % 2 = 0 THEN 'Cargo.toml' ELSE 'lib/Cargo.toml' END
    ELSE 's' || doc_id || CASE WHEN n_chars % 2 = 0 THEN '.sln' ELSE '.txt' END END AS path FROM documents)
SELECT DISTINCT source, CASE WHEN regexp_matches(path, '^tests?/[^/]*\.test\.m?js$') THEN 'node-test' WHEN regexp_matches(path, '^tests/test_[^/]*\.py$') OR path = 'pytest.ini' THEN 'pytest'
  WHEN path = 'Cargo.toml' THEN 'cargo-test' ELSE 'dotnet-test' END AS id, CASE WHEN regexp_matches(path, '^tests?/[^/]*\.test\.m?js$') THEN 'node-test' ELSE 'cmd' END AS kind
FROM manifest WHERE regexp_matches(path, '^tests?/[^/]*\.test\.m?js$|^tests/test_[^/]*\.py$|^pytest.ini$|^Cargo.toml$|^[^/]*\.sln$')"""

QUERIES = {
    "read_md_table": (
        lambda s, d: read_md_table(i.board_lines(s, d)),
        f"{ITEMS} SELECT source, id, status, scorecard, what, done_when, owner, evidence, line FROM items",
    ),
    "board_proofs": (_on(i.board_items, bd.board_proofs), f"{ITEMS} {SQL_PROOFS}"),
    "board_owner": (_on(i.board_items, bd.board_owner), f"{ITEMS} {SQL_OWNER}"),
    "board_status": (_on(i.board_items, bd.board_status), f"{ITEMS} {SQL_STATUS}"),
    "board_findings": (_on(i.board_items, bd.board_findings), f"{ITEMS} {SQL_PROOFS} UNION ALL {SQL_OWNER} UNION ALL {SQL_STATUS}"),
    "parse_requirements": (
        _reqs,
        f"{SPECS} SELECT source, position, id, text, line_no, proof FROM reqs",
    ),
    "parse_proofs": (_on(i.spec_lines, rq.parse_proofs), f"{SPECS} SELECT source, line_no, kind, text FROM proofs"),
    "requirement_flags": (_on(_reqs, rq.requirement_flags), f"{SPECS} {SQL_FLAGS}"),
    "expand_cases": (_on(_reqs, rq.expand_cases), f'{SPECS} SELECT source, position, req, "case", type, "check", expect FROM expanded'),
    "boundary_cases": (_on(_reqs, rq.boundary_cases), f'{SPECS} SELECT source, position, req, "case", type, "check", expect FROM bounds'),
    "coverage": (
        _coverage,
        f"{SPECS}, counted AS (SELECT source, count(*) AS cases, count(*) FILTER (type = 'negative') AS negative, count(*) FILTER (type = 'boundary') AS boundary, "
        "count(*) FILTER (type = 'regression') AS regression FROM plan GROUP BY 1), p AS (SELECT source, count(*) AS lines FROM proofs GROUP BY 1) "
        "SELECT source, count(*) AS requirements, any_value(cases) AS cases, any_value(negative) AS negative, any_value(boundary) AS boundary, any_value(regression) AS regression, "
        "count(DISTINCT id) FILTER (flag IS NOT NULL) AS flagged, CAST(0 AS BIGINT) AS uncovered, count(*) FILTER (proof <> '') + any_value(lines) AS proof_lines FROM judged JOIN counted USING (source) JOIN p USING (source) GROUP BY 1",
    ),
    "missing_file": (_on(i.scaffold_files, fc.missing_file), f"{FILES} {SQL_MISSING_FILE}"),
    "overbroad_scope": (_on(i.scaffold_files, fc.overbroad_scope), f"{FILES} {SQL_WIDE}"),
    "bad_frontmatter": (_on(i.scaffold_files, fc.bad_frontmatter), f"{FILES} {SQL_FRONT}"),
    "unsafe_capability": (_on(i.scaffold_files, fc.unsafe_capability), f"{FILES} {SQL_UNSAFE}"),
    "secret_leak": (_on(_secret_files, fc.secret_leak), f"{SECRETS} {SQL_FIRST_LEAK}"),
    "secret_leak_all": (lambda s, d: fc.secret_leak(_secret_files(s, d), first_only=False), f"{SECRETS} {SQL_LEAKS}"),
    "broken_manifest": (_on(i.scaffold_files, fc.broken_manifest), f"{FILES} {SQL_BROKEN}"),
    "scaffold_findings": (
        _on(_secret_files, fc.scaffold_findings),
        f"{SECRETS} " + " UNION ALL ".join([SQL_MISSING_FILE, SQL_WIDE, SQL_FRONT, SQL_UNSAFE, SQL_FIRST_LEAK, SQL_BROKEN]),
    ),
    "detect_test_kind": (_on(_manifest, fc.detect_test_kind), SQL_KINDS),
}
