"""Dataset cleaning and campaign attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelight.functions import text as tx
from sievelight.functions.links import is_pii_line, url_params
from sievelight.operators import campaign as cp
from sievelight.operators import cleaning as cl
from sievelight.sources import datasets, sinks
from workload import inputs as i
from workload.files import scratch

EMPTY = "trim({0}) = ''"
SQL_NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9\\x{{0590}}-\\x{{05FF}}]+', ' ', 'g'))"
SQL_SHAPED = "regexp_matches(trim(email), '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$')"


def norm(column: str) -> str:
    return SQL_NORM.format(column)


SQL_MISSING = " UNION ALL ".join(
    f"SELECT source, 'missing-field' AS kind, n AS \"row\", '{f}' AS key, 'row ' || n || ' is missing field \"{f}\"' AS detail FROM data WHERE {EMPTY.format(f)}"
    for f in ("id", "name", "email")
)
SQL_EMAIL = (
    "SELECT source, 'bad-email' AS kind, n AS \"row\", 'email' AS key, 'row ' || n || ' has a bad email in field \"email\"' AS detail "
    f"FROM data WHERE trim(email) <> '' AND NOT {SQL_SHAPED}"
)
SQL_AGE = (
    "SELECT source, 'out-of-range' AS kind, n AS \"row\", 'age' AS key, 'row ' || n || ' has field \"age\" outside its range' AS detail "
    "FROM data WHERE CAST(age AS DOUBLE) < 0 OR CAST(age AS DOUBLE) > 120"
)


def sql_exact(keys: list[str]) -> str:
    same = ", ".join(norm(k) for k in keys)
    return (
        "SELECT source, 'exact-dupe' AS kind, n AS \"row\", CAST(f AS VARCHAR) AS key, 'row ' || n || ' is an exact dupe of row ' || f AS detail "
        f"FROM (SELECT *, min(n) OVER (PARTITION BY source, {same}) AS f FROM data) WHERE f < n"
    )


def sql_near(keys: list[str], tagged: str) -> str:
    """`tagged` is a list of tagged keys in order of preference."""
    same = ", ".join(norm(k) for k in keys)
    return (
        f"SELECT source, 'near-dupe' AS kind, n AS \"row\", CAST(f AS VARCHAR) AS key, 'row ' || n || ' is a near-dupe of row ' || f || ' (same ' "
        "|| CASE left(tag, 2) WHEN 'ct' THEN '\"company\"+\"title\"' WHEN 'em' THEN '\"email\"' ELSE '\"name\"' END || ')' AS detail FROM ("
        "SELECT source, n, arg_min(tag, pos) AS tag, arg_min(f, pos) AS f FROM (SELECT *, min(n) OVER (PARTITION BY source, tag) AS f FROM ("
        f"SELECT source, n, unnest(range(1, len(tags) + 1)) AS pos, unnest(tags) AS tag FROM (SELECT source, n, list_filter({tagged}, lambda x: x IS NOT NULL) AS tags "
        f"FROM (SELECT *, min(n) OVER (PARTITION BY source, {same}) AS e FROM data) WHERE e = n))) WHERE f < n GROUP BY 1, 2)"
    )


APPLICANT_KEYS = ["id", "name", "email", "age"]
SQL_APPLICANT_TAGS = f"[CASE WHEN trim(email) <> '' THEN 'em:' || {norm('email')} WHEN trim(name) <> '' THEN 'nm:' || {norm('name')} END]"
SQL_APPLICANTS_FOUND = (
    f"WITH {i.SQL_APPLICANTS}, found AS ({SQL_MISSING} UNION ALL {SQL_EMAIL} UNION ALL {SQL_AGE} "
    f"UNION ALL {sql_exact(APPLICANT_KEYS)} UNION ALL {sql_near(APPLICANT_KEYS, SQL_APPLICANT_TAGS)}) "
)
SQL_OFFERS = "data AS (SELECT p_brand AS source, p_partkey + 1 AS n, CAST(p_partkey AS VARCHAR) AS id, p_type AS company, p_name AS title FROM part)"
SQL_OFFER_TAGS = f"['ct:' || {norm('company')} || '|' || {norm('title')}]"
SQL_DOCUMENTS = "data AS (SELECT lang AS source, doc_id + 1 AS n, text FROM documents)"


def _on(build, fn, **settings):
    return lambda spark, sf_dir: fn(build(spark, sf_dir), **settings)


def _clean(spark, sf_dir, keep_near=False):
    df = i.applicants(spark, sf_dir)
    return cl.clean_rows(df, cl.dataset_findings(df), keep_near)


def _read_back(form: str):
    """Applicants written in one format and read as a dataset; row numbers are per file and left out."""

    def run(spark, sf_dir):
        folder = scratch(spark)
        df = i.applicants(spark, sf_dir).select("id", "name", "email", "age")
        if form == "csv":
            df.write.option("header", True).option("quoteAll", True).option("emptyValue", "").csv(folder)
        else:
            df.write.json(folder)
        return datasets.read_dataset(spark, folder, form).select("id", "name", "email", "age")

    return run


def _written_clean(spark, sf_dir):
    folder = scratch(spark)
    sinks.write_clean(_clean(spark, sf_dir), folder, "jsonl")
    return spark.read.schema("id string, name string, email string, age string").json(folder)


def _written_findings(spark, sf_dir):
    folder = scratch(spark)
    sinks.write_findings(cl.missing_field(i.applicants(spark, sf_dir)), folder)
    return spark.read.schema("source string, kind string, row long, key string, detail string").json(folder)


def _links(spark, sf_dir):
    return cp.extract_links(i.linked_posts(spark, sf_dir))


def _params(spark, sf_dir):
    pairs = _links(spark, sf_dir).select("source", "file", "line_no", F.posexplode(url_params(F.col("url"))).alias("at", "p"))
    return pairs.select("source", "file", "line_no", (F.col("at") + 1).cast("long").alias("pos"), "p.name", "p.value")


def _utm(spark, sf_dir):
    used = _links(spark, sf_dir).select("source", "file", "line_no", F.explode(cp.link_utm(F.col("url"))).alias("key", "p"))
    return used.select("source", "file", "line_no", "key", "p.name", "p.value")


def _visits(spark, sf_dir):
    return _links(spark, sf_dir).select("source", "url", (F.col("line_no") * 10).cast("string").alias("visits"))


def _scoreboard(spark, sf_dir):
    sales = _links(spark, sf_dir).filter("line_no = 2")
    return cp.scoreboard_join(_visits(spark, sf_dir), sales, i.campaigns(spark, sf_dir))


def _hashes(spark, sf_dir):
    docs = i.table(spark, sf_dir, "documents")
    files = docs.selectExpr("source", "concat('d', doc_id, '.md') as file", "lpad(doc_id, 12, '0') as position", "text")
    return cp.content_hash(files)


SQL_LINKS = f"WITH {i.SQL_POSTS}, {i.SQL_CAMPAIGNS} "
SQL_LOWER = "value <> '' AND value = lower(value)"
SQL_BAD_UTM = (
    "SELECT source, 'bad-utm' AS kind, line_no AS \"row\", file AS key, CASE WHEN name <> key THEN 'link line ' || line_no || ' uses an uppercase name for \"' || key || '\"' "
    f"ELSE 'link line ' || line_no || ' ' || key || ' value is not lowercase' END AS detail FROM utm WHERE name <> key OR NOT ({SQL_LOWER})"
)
SQL_MISSING_UTM = (
    "SELECT source, 'missing-utm' AS kind, line_no AS \"row\", file AS key, 'link line ' || line_no || ' is missing ' || array_to_string(lacking, ', ') AS detail FROM ("
    "SELECT l.source, l.file, l.line_no, list_filter(['utm_source', 'utm_medium', 'utm_campaign'], lambda k: NOT coalesce(list_contains(have, k), false)) AS lacking "
    "FROM links l LEFT JOIN (SELECT source, file, line_no, list(key) AS have FROM utm WHERE value <> '' GROUP BY 1, 2, 3) u USING (source, file, line_no)) WHERE len(lacking) > 0"
)
SQL_FIELDS = (
    "SELECT source, 'missing-field' AS kind, CAST(NULL AS BIGINT) AS \"row\", 'utm_campaign' AS key, 'campaign file is missing utm_campaign' AS detail FROM campaigns WHERE utm_campaign = '' "
    "UNION ALL SELECT source, 'bad-utm', NULL, 'utm_medium', 'campaign field utm_medium is not lowercase' FROM campaigns WHERE utm_medium <> lower(utm_medium)"
)
SQL_PII = (
    r"regexp_matches(line, '[\w.+-]+@[\w-]+\.[\w.-]+') OR len(list_filter(regexp_extract_all(line, '\+?[\d][\d\s-]*\d'), lambda r: "
    r"length(regexp_replace(r, '\D', '', 'g')) >= 10 OR (length(regexp_replace(r, '\D', '', 'g')) >= 9 AND regexp_matches(r, '[\s-]')))) > 0"
)
SQL_TRIPLES = (
    "t AS (SELECT source, file, line_no, url, lower(coalesce(max(value) FILTER (key = 'utm_source'), '')) AS a, lower(coalesce(max(value) FILTER (key = 'utm_medium'), '')) AS b, "
    "lower(coalesce(max(value) FILTER (key = 'utm_campaign'), '')) AS c FROM (SELECT * FROM utm UNION ALL SELECT source, file, line_no, url, '', '', '' FROM links) GROUP BY 1, 2, 3, 4)"
)
SQL_HIT = "a = lower(utm_source) AND b = lower(utm_medium) AND c = lower(utm_campaign) AND utm_campaign <> ''"

QUERIES = {
    "norm_text": (
        lambda s, d: i.document_rows(s, d).groupBy("source", tx.norm_text(F.col("text")).alias("key")).agg(F.count("*").alias("rows")),
        f"WITH {i.SQL_APPLICANTS.replace('data AS', 'unused AS')}, {SQL_DOCUMENTS} SELECT source, {norm('text')} AS key, count(*) AS rows FROM data GROUP BY 1, 2",
    ),
    "missing_field": (_on(i.applicants, cl.missing_field), f"WITH {i.SQL_APPLICANTS} {SQL_MISSING}"),
    "bad_email": (_on(i.applicants, cl.bad_email), f"WITH {i.SQL_APPLICANTS} {SQL_EMAIL}"),
    "out_of_range": (_on(i.applicants, cl.out_of_range), f"WITH {i.SQL_APPLICANTS} {SQL_AGE}"),
    "nested_out_of_range": (
        _on(i.offers, cl.nested_out_of_range),
        "SELECT p_brand AS source, 'out-of-range' AS kind, p_partkey + 1 AS \"row\", 'pay.min' AS key, 'row ' || (p_partkey + 1) || ' has field \"pay.min\" outside range' AS detail "
        "FROM part WHERE p_retailprice < 950 UNION ALL SELECT p_brand, 'out-of-range', p_partkey + 1, 'pay.max', 'row ' || (p_partkey + 1) || ' has field \"pay.max\" outside range' "
        "FROM part WHERE p_size > 40",
    ),
    "exact_dupe": (_on(i.document_rows, cl.exact_dupe), f"WITH {SQL_DOCUMENTS} {sql_exact(['text'])}"),
    "near_dupe": (_on(i.offers, cl.near_dupe), f"WITH {SQL_OFFERS} {sql_near(['id', 'company', 'title'], SQL_OFFER_TAGS)}"),
    "near_dupe_by_email": (
        _on(i.applicants, cl.near_dupe),
        f"WITH {i.SQL_APPLICANTS} {sql_near(APPLICANT_KEYS, SQL_APPLICANT_TAGS)}",
    ),
    "dataset_findings": (_on(i.applicants, cl.dataset_findings), SQL_APPLICANTS_FOUND + "SELECT * FROM found"),
    "clean_rows": (_clean, SQL_APPLICANTS_FOUND + 'SELECT * FROM data WHERE (source, n) NOT IN (SELECT source, "row" FROM found)'),
    "clean_rows_keep_near": (
        lambda s, d: _clean(s, d, keep_near=True),
        SQL_APPLICANTS_FOUND + "SELECT * FROM data WHERE (source, n) NOT IN (SELECT source, \"row\" FROM found WHERE kind <> 'near-dupe')",
    ),
    "read_dataset_csv": (_read_back("csv"), f"WITH {i.SQL_APPLICANTS} SELECT id, trim(name) AS name, email, age FROM data"),
    "read_dataset_jsonl": (_read_back("jsonl"), f"WITH {i.SQL_APPLICANTS} SELECT id, name, email, age FROM data"),
    "write_clean": (
        _written_clean,
        SQL_APPLICANTS_FOUND + 'SELECT id, name, email, age FROM data WHERE (source, n) NOT IN (SELECT source, "row" FROM found)',
    ),
    "write_findings": (_written_findings, f"WITH {i.SQL_APPLICANTS} {SQL_MISSING}"),
    "extract_links": (_links, SQL_LINKS + "SELECT source, file, line_no, url FROM links"),
    "url_params": (_params, SQL_LINKS + "SELECT source, file, line_no, CAST(pos AS BIGINT) AS pos, name, value FROM params"),
    "link_utm": (_utm, SQL_LINKS + "SELECT source, file, line_no, key, name, value FROM utm"),
    "campaign_fields": (_on(i.campaigns, cp.campaign_fields), SQL_LINKS + SQL_FIELDS),
    "bad_utm": (_on(_links, cp.bad_utm), SQL_LINKS + SQL_BAD_UTM),
    "missing_utm": (_on(_links, cp.missing_utm), SQL_LINKS + SQL_MISSING_UTM),
    "campaign_findings": (
        lambda s, d: cp.campaign_findings(i.campaigns(s, d), i.linked_posts(s, d)),
        # Page numbers in the posts are short, and their urls hold neither mails nor long digit runs.
        SQL_LINKS + f"{SQL_FIELDS} UNION ALL {SQL_BAD_UTM} UNION ALL {SQL_MISSING_UTM}",
    ),
    "pii_scan": (
        lambda s, d: cp.pii_scan(i.document_lines(s, d)),
        f"WITH {i.SQL_DOCUMENT_LINES} SELECT source, 'pii' AS kind, line_no AS \"row\", file AS key, 'file ' || file || ' line ' || line_no || ' holds an email or phone' AS detail "
        f"FROM lines WHERE {SQL_PII}",
    ),
    "is_pii_line": (
        lambda s, d: i.document_lines(s, d).groupBy(is_pii_line(F.col("line")).alias("personal")).agg(F.count("*").alias("lines")),
        f"WITH {i.SQL_DOCUMENT_LINES} SELECT {SQL_PII} AS personal, count(*) AS lines FROM lines GROUP BY 1",
    ),
    "scoreboard_join": (
        _scoreboard,
        SQL_LINKS.rstrip() + f", {SQL_TRIPLES} SELECT source, CAST(sum(line_no * 10) AS DOUBLE) AS visits_total, CAST(coalesce(sum(line_no * 10) FILTER ({SQL_HIT}), 0) AS DOUBLE) AS visits_joined, "
        f"count(*) FILTER (line_no = 2) AS sales_total, count(*) FILTER (line_no = 2 AND {SQL_HIT}) AS sales_joined FROM t JOIN campaigns USING (source) GROUP BY 1",
    ),
    "content_hash": (
        _hashes,
        "WITH files AS (SELECT source, lpad(CAST(doc_id AS VARCHAR), 12, '0') || chr(10) || 'd' || doc_id || '.md' AS place, text FROM documents), "
        "blocks AS (SELECT source, left(sha256(place), 2) AS block, sha256(string_agg(sha256(place || chr(10) || text), '' ORDER BY place)) AS hash FROM files GROUP BY 1, 2) "
        "SELECT source, left(sha256(string_agg(hash, '' ORDER BY block)), 16) AS digest FROM blocks GROUP BY 1",
    ),
}
