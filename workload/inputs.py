"""Operator inputs derived from the shared tables, once for Spark and once as SQL common table expressions.

Every derivation keeps all rows of its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.operators.evaluation import rubric_checks
from sievelight.plans.spread import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
SQL_STAMP = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


def _keyed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.withColumn("k", F.get_json_object("props", "$.k").cast("long")).withColumn(
        "stamp", F.date_format("ts", STAMP)
    )


SQL_EVENTS = f"keyed AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, {SQL_STAMP} AS stamp FROM events)"


def access_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One access log per event type; errors are denied requests."""
    line = F.concat_ws(
        " ",
        "stamp",
        F.when(F.col("event_type") == "error", "403 forbidden").otherwise("served"),
        F.expr("concat('lane', chr(97 + cast(k % 26 as int)))"),
        F.concat(F.lit("user "), "user_id"),
        F.concat(F.lit("item "), "k"),
    )
    # Whole milliseconds of the event time, as the stamp in the line says them.
    ts_ms = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return _keyed_events(spark, sf_dir).select(
        F.col("event_type").alias("source"), (F.col("event_id") + 1).alias("n"), ts_ms.alias("ts_ms"), line.alias("line")
    )


SQL_ACCESS = SQL_EVENTS + """, lines AS (
  SELECT event_type AS source, event_id + 1 AS n, epoch_us(ts) // 1000 AS ts_ms,
         stamp || CASE WHEN event_type = 'error' THEN ' 403 forbidden' ELSE ' served' END
         || ' lane' || chr(CAST(97 + k % 26 AS INTEGER)) || ' user ' || user_id || ' item ' || k AS line
  FROM keyed)"""


def service_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two service logs of physical lines: an entry, a continuation line for errors, blank lines."""
    kind = F.col("event_type")
    lane = F.expr("chr(97 + cast(k % 26 as int))")
    key = F.concat(F.lit("0"), F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 11))

    def say(*parts) -> object:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    k, value = F.col("k"), F.floor("value").cast("string")
    body = (
        F.when(kind == "error", say("ERROR store ", lane, " write failed host=10.0.0.", k % 16, " port=", k, " (timeout ", value, "ms)"))
        .when(kind == "signup", say("WARN copy ", lane, " stale key=", key, " age ", k, "s"))
        .when(kind == "click", say("info checks ", lane, " done: 0 errors, 0 failures"))
        .when(kind == "view", say("GET /shop/item/", k, "/page.html took ", value, " ms at 12:30:", F.lpad(k % 60, 2, "0")))
        .otherwise(say("retry of order #", F.col("event_id"), " step-r", k, " ", k, "x 0x", key))
    )
    head = F.concat(F.col("stamp"), F.lit(" ses_u"), F.col("user_id"), F.lit(" "), body)
    deep = F.when(kind == "error", F.concat(F.lit("    at step "), k, F.lit(" of store"))).otherwise("")
    physical = F.posexplode(F.array(head, deep, F.lit("")))
    return (
        _keyed_events(spark, sf_dir)
        .select(F.expr("if(user_id % 2 = 0, 'even', 'odd')").alias("source"), "event_id", physical.alias("at", "line"))
        .select("source", (F.col("event_id") * 3 + F.col("at") + 1).alias("line_no"), "line")
    )


SQL_SERVICE = SQL_EVENTS + """, entries AS (
  SELECT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS source, event_id, event_type, k,
         stamp || ' ses_u' || user_id || ' ' || CASE event_type
           WHEN 'error' THEN 'ERROR store ' || chr(CAST(97 + k % 26 AS INTEGER)) || ' write failed host=10.0.0.' || (k % 16)
             || ' port=' || k || ' (timeout ' || CAST(floor(value) AS BIGINT) || 'ms)'
           WHEN 'signup' THEN 'WARN copy ' || chr(CAST(97 + k % 26 AS INTEGER)) || ' stale key=0'
             || substr(md5(CAST(event_id AS VARCHAR)), 1, 11) || ' age ' || k || 's'
           WHEN 'click' THEN 'info checks ' || chr(CAST(97 + k % 26 AS INTEGER)) || ' done: 0 errors, 0 failures'
           WHEN 'view' THEN 'GET /shop/item/' || k || '/page.html took ' || CAST(floor(value) AS BIGINT) || ' ms at 12:30:'
             || lpad(CAST(k % 60 AS VARCHAR), 2, '0')
           ELSE 'retry of order #' || event_id || ' step-r' || k || ' ' || k || 'x 0x0' || substr(md5(CAST(event_id AS VARCHAR)), 1, 11)
         END AS line
  FROM keyed), lines AS (
  SELECT source, event_id * 3 + 1 AS line_no, line FROM entries
  UNION ALL SELECT source, event_id * 3 + 2, CASE WHEN event_type = 'error' THEN '    at step ' || k || ' of store' ELSE '' END FROM entries
  UNION ALL SELECT source, event_id * 3 + 3, '' FROM entries)"""


def applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as an applicant list per market segment, with gaps, bad mails, shared mails and odd ages."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_mktsegment as source",
        "c_custkey + 1 as n",
        "cast(c_custkey as string) as id",
        "if(c_custkey % 97 = 0, ' ', c_name) as name",
        "case when c_acctbal < 0 then '' when c_custkey % 50 = 7 then 'nobody at mail'"
        " else concat('User', c_custkey - c_custkey % 9, '@mail.test') end as email",
        "cast(cast(floor(c_acctbal / 60) as bigint) as string) as age",
    )


SQL_APPLICANTS = """data AS (
  SELECT c_mktsegment AS source, c_custkey + 1 AS n, CAST(c_custkey AS VARCHAR) AS id,
         CASE WHEN c_custkey % 97 = 0 THEN ' ' ELSE c_name END AS name,
         CASE WHEN c_acctbal < 0 THEN '' WHEN c_custkey % 50 = 7 THEN 'nobody at mail'
              ELSE 'User' || (c_custkey - c_custkey % 9) || '@mail.test' END AS email,
         CAST(CAST(floor(c_acctbal / 60) AS BIGINT) AS VARCHAR) AS age
  FROM customer)"""


def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a dataset per language."""
    return table(spark, sf_dir, "documents").selectExpr("lang as source", "doc_id + 1 as n", "text")


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as job-like offers per brand: company, title and a pay struct."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_brand as source",
        "p_partkey + 1 as n",
        "cast(p_partkey as string) as id",
        "p_type as company",
        "p_name as title",
        "struct(p_retailprice - 950 as min, if(p_size > 40, -1D * p_size, 5D) as max) as pay",
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as one corpus."""
    return table(spark, sf_dir, "documents").select(F.lit("documents").alias("source"), F.col("doc_id").alias("doc"), "text")


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`source, file, line_no, line` of every document line; the source is the document."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").cast("string").alias("source"),
        F.concat(F.lit("d"), F.col("doc_id")).alias("file"),
        F.posexplode(F.split("text", "\r?\n", -1)).alias("at", "line"),
    ).select("source", "file", (F.col("at") + 1).cast("long").alias("line_no"), "line")


SQL_DOCUMENT_LINES = """lines AS (
  SELECT CAST(doc_id AS VARCHAR) AS source, 'd' || doc_id AS file,
         CAST(unnest(range(1, len(parts) + 1)) AS BIGINT) AS line_no, unnest(parts) AS line
  FROM (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS parts FROM documents))"""

RUBRIC = [
    ("at-most-eight-lines", "maxLines", "8", None),
    ("two-lines", "minLines", "2", None),
    ("small-word", "regex", r"\b(the|der|les|los)\b", "i"),
    ("no-mail", "notRegex", r"[\w.+-]+@[\w-]+\.[\w.-]+", None),
    ("stops", "contains", ".", None),
    ("no-marks", "notContains", "%%%", None),
]


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns as recorded answers, whoever speaks; a conversation is a case."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select(F.col("conv_id").alias("case"), F.col("turn").alias("run"), "text")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("case")).distinct()
    return ids.withColumn("checks", rubric_checks(RUBRIC))


SQL_CHECKED = r"""checked AS (
  SELECT conv_id AS "case", turn AS run, text, unnest([
    {'key': 'at-most-eight-lines', 'ok': filled <= 8}, {'key': 'two-lines', 'ok': filled >= 2},
    {'key': 'small-word', 'ok': regexp_matches(text, '(?i)\b(the|der|les|los)\b')},
    {'key': 'no-mail', 'ok': NOT regexp_matches(text, '[\w.+-]+@[\w-]+\.[\w.-]+')},
    {'key': 'stops', 'ok': contains(text, '.')}, {'key': 'no-marks', 'ok': NOT contains(text, '%%%')}]) AS c
  FROM (SELECT *, len(list_filter(string_split_regex(text, '\r?\n'), lambda x: trim(x) <> '')) AS filled FROM conversations)),
scored AS (SELECT "case", run, bool_and(c.ok) AS passed FROM checked GROUP BY 1, 2)"""


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as scored answers: the language is the suite, good quality passes."""
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    return labels.join(docs.select("doc_id", "lang", "n_chars"), "doc_id").select(
        F.col("lang").alias("suite"), F.col("doc_id").alias("case"), "n_chars", (F.col("quality") == 1).alias("passed")
    )


SQL_GRADED = """graded AS (
  SELECT lang AS suite, doc_id AS "case", n_chars, quality = 1 AS passed FROM labels JOIN documents USING (doc_id))"""


def sql_wilson(passed: str, n: str) -> dict[str, str]:
    """Rate, low and high of a Wilson interval as SQL over two expressions."""
    p, t = f"(CAST({passed} AS DOUBLE) / {n})", f"CAST({n} AS DOUBLE)"
    scale = f"(1 + 3.8416 / {t})"
    centre = f"(({p} + 3.8416 / (2 * {t})) / {scale})"
    spread = f"(1.96 * sqrt({p} * (1 - {p}) / {t} + 3.8416 / (4 * {t} * {t})) / {scale})"
    return {"rate": p, "low": f"greatest(0.0, {centre} - {spread})", "high": f"least(1.0, {centre} + {spread})"}


def linked_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A post per page with two tagged links to it; the campaign is the page's top-level domain."""
    pages = table(spark, sf_dir, "pages")
    return pages.selectExpr(
        "regexp_extract(url, '^[a-z]+://[^/]*\\\\.([a-z]+)/', 1) as source",
        "concat('posts/', page_id, '.md') as file",
        "concat('# Page ', page_id, '\\nSee [it](', url, if(instr(url, '?') > 0, '&', '?'), 'utm_source=feed&utm_medium=',"
        " if(page_id % 3 = 0, 'Mail', 'mail'), if(page_id % 4 = 0, '', concat('&utm_campaign=c+', page_id % 5)), ')\\n\\n<a href=\"',"
        " url, '\">', page_id, '</a> and [local](/x)') as text",
    )


SQL_POSTS = r"""posts AS (
  SELECT regexp_extract(url, '^[a-z]+://[^/]*\.([a-z]+)/', 1) AS source, 'posts/' || page_id || '.md' AS file, page_id,
         url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_source=feed&utm_medium='
         || CASE WHEN page_id % 3 = 0 THEN 'Mail' ELSE 'mail' END
         || CASE WHEN page_id % 4 = 0 THEN '' ELSE '&utm_campaign=c+' || (page_id % 5) END AS tagged, url
  FROM pages),
links AS (
  SELECT source, file, CAST(2 AS BIGINT) AS line_no, tagged AS url FROM posts
  UNION ALL SELECT source, file, 4, url FROM posts),
params AS (
  SELECT source, file, line_no, url, pos, CASE WHEN contains(part, '=') THEN split_part(part, '=', 1) ELSE part END AS name,
         CASE WHEN contains(part, '=') THEN url_decode(replace(substr(part, instr(part, '=') + 1), '+', ' ')) ELSE '' END AS value
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS pos, unnest(parts) AS part
        FROM (SELECT *, string_split(split_part(url, '?', 2), '&') AS parts FROM links))
  WHERE part <> ''),
utm AS (
  SELECT source, file, line_no, url, lower(name) AS key, arg_max(name, pos) AS name, arg_max(value, pos) AS value
  FROM params WHERE lower(name) LIKE 'utm\_%' ESCAPE '\' GROUP BY ALL)"""


def campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One campaign per top-level domain; one of them lacks a field and one shouts."""
    posts = linked_posts(spark, sf_dir).select("source").distinct()
    return posts.selectExpr(
        "source",
        "map('utm_source', 'feed', 'utm_medium', if(source = 'org', 'Mail', 'mail'), 'utm_campaign', if(source = 'net', '', 'c 1')) as fields",
        "concat('{\"name\": \"', source, '\"}') as text",
    )


SQL_CAMPAIGNS = """campaigns AS (
  SELECT DISTINCT source, 'feed' AS utm_source, CASE WHEN source = 'org' THEN 'Mail' ELSE 'mail' END AS utm_medium,
         CASE WHEN source = 'net' THEN '' ELSE 'c 1' END AS utm_campaign FROM posts)"""


def page_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages over several lines, with images, form controls and links added from their own columns."""
    return table(spark, sf_dir, "pages").selectExpr(
        "page_id",
        "url",
        "concat(replace(replace(html, '<nav>', concat('<nav>\\n<img src=\"', page_id, '.png\"', if(page_id % 3 = 0, ' alt=\"\"', ''), '>\\n"
        "<input type=\"', if(page_id % 5 = 0, 'hidden', 'text'), '\" id=\"f', page_id, '\">', if(page_id % 2 = 0, concat('<label for=\"f',"
        " page_id, '\">f</label>'), ''))), '</article>', '\\n<label>m <input name=\"m\"></label><select name=\"s\"></select>\\n"
        "</article>'), '<a href=\"#top\">t</a><a href=\"#main\" id=\"main\">m</a><a href=\"',"
        " regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1), '\">self</a><p style=\"color:#a', page_id % 10, 'b; float:left\">x</p>') as html",
    )


SQL_FORMS = r"""forms AS (
  SELECT page_id, url, replace(replace(html, '<nav>', '<nav>' || chr(10) || '<img src="' || page_id || '.png"'
    || CASE WHEN page_id % 3 = 0 THEN ' alt=""' ELSE '' END || '>' || chr(10) || '<input type="'
    || CASE WHEN page_id % 5 = 0 THEN 'hidden' ELSE 'text' END || '" id="f' || page_id || '">'
    || CASE WHEN page_id % 2 = 0 THEN '<label for="f' || page_id || '">f</label>' ELSE '' END), '</article>',
    chr(10) || '<label>m <input name="m"></label><select name="s"></select>' || chr(10) || '</article>')
    || '<a href="#top">t</a><a href="#main" id="main">m</a><a href="' || regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1)
    || '">self</a><p style="color:#a' || (page_id % 10) || 'b; float:left">x</p>' AS html
  FROM pages)"""


def sql_spans(relation: str, pattern: str, keep: str = "page_id") -> str:
    """Matches of a pattern with their line, as SQL: `keep, match, line`."""
    p = pattern.replace("'", "''")
    return (
        f"(SELECT {keep}, found[i] AS match, CAST(1 + len(before) - len(replace(before, chr(10), '')) AS BIGINT) AS line FROM ("
        f"SELECT *, array_to_string(list_transform(range(1, i + 1), lambda j: pieces[j] || CASE WHEN j < i THEN found[j] ELSE '' END), '') AS before "
        f"FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM (SELECT {keep}, regexp_extract_all(html, '{p}') AS found, "
        f"string_split_regex(html, '{p}') AS pieces FROM {relation}))))"
    )


def board_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as work items of one board per priority."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderpriority as source",
        "concat('O-', o_orderkey) as id",
        "case o_orderstatus when 'F' then 'DONE' when 'P' then 'blocked' else 'READY' end as status",
        "if(o_custkey % 7 = 0, '', 'Speed') as scorecard",
        "concat('order of ', o_custkey) as what",
        "concat(if(o_orderkey % 10 = 1, '', 'F2P: a. '), if(o_orderkey % 10 = 2, '', 'p2p: b')) as done_when",
        "if(o_custkey % 11 = 0, '', 'cook') as owner",
        "if(o_totalprice < 100000, '', 'seen') as evidence",
        "cast(o_orderkey + 3 as int) as line",
    )


SQL_ITEMS = """items AS (
  SELECT o_orderpriority AS source, 'O-' || o_orderkey AS id,
         CASE o_orderstatus WHEN 'F' THEN 'DONE' WHEN 'P' THEN 'blocked' ELSE 'READY' END AS status,
         CASE WHEN o_custkey % 7 = 0 THEN '' ELSE 'Speed' END AS scorecard, 'order of ' || o_custkey AS what,
         trim(CASE WHEN o_orderkey % 10 = 1 THEN '' ELSE 'F2P: a. ' END || CASE WHEN o_orderkey % 10 = 2 THEN '' ELSE 'p2p: b' END) AS done_when,
         CASE WHEN o_custkey % 11 = 0 THEN '' ELSE 'cook' END AS owner,
         CASE WHEN o_totalprice < 100000 THEN '' ELSE 'seen' END AS evidence, CAST(o_orderkey + 3 AS INTEGER) AS line
  FROM orders)"""


def board_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same board as pipe table lines, with one header row kept out of the items."""
    columns = ["id", "status", "scorecard", "what", "done_when", "owner", "evidence"]
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *columns), F.lit(" |"))
    return board_items(spark, sf_dir).select("source", F.col("line").cast("long").alias("line_no"), row.alias("line"))


def spec_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as requirement lines of one spec per priority."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderpriority as source",
        "o_orderkey + 1 as line_no",
        "case when o_orderkey % 11 = 0 then concat('## Order ', o_orderkey)"
        " when o_orderkey % 13 = 0 then concat('- f2p: order ', o_orderkey, ' fails')"
        " when o_orderstatus = 'F' then concat('- Ship at most ', o_custkey % 50, ' items within ', o_custkey % 7, '.5 days (HTTP ', 200 + o_orderkey % 5, ')')"
        " when o_orderstatus = 'P' then concat(o_orderkey % 9, '. The **form** must be `fast` and ', if(o_custkey % 2 = 0, 'stay unchanged', 'TBD'))"
        " else concat('| OD-', o_orderkey, ' | Existing price stays over ', o_custkey % 100, ' in 2019 | n >= ', o_orderkey % 3, ' |') end as line",
    )


SQL_SPECS = r"""specs AS (
  SELECT o_orderpriority AS source, o_orderkey + 1 AS line_no, CASE
    WHEN o_orderkey % 11 = 0 THEN '## Order ' || o_orderkey
    WHEN o_orderkey % 13 = 0 THEN '- f2p: order ' || o_orderkey || ' fails'
    WHEN o_orderstatus = 'F' THEN '- Ship at most ' || (o_custkey % 50) || ' items within ' || (o_custkey % 7) || '.5 days (HTTP ' || (200 + o_orderkey % 5) || ')'
    WHEN o_orderstatus = 'P' THEN (o_orderkey % 9) || '. The **form** must be `fast` and ' || CASE WHEN o_custkey % 2 = 0 THEN 'stay unchanged' ELSE 'TBD' END
    ELSE '| OD-' || o_orderkey || ' | Existing price stays over ' || (o_custkey % 100) || ' in 2019 | n >= ' || (o_orderkey % 3) || ' |' END AS line
  FROM orders),
proofs AS (
  SELECT source, line_no, upper(regexp_extract(line, '(?i)^(?:[-*•]\s*)?(F2P|P2P)\s*:\s*(.+)$', 1)) AS kind,
         regexp_extract(line, '(?i)^(?:[-*•]\s*)?(F2P|P2P)\s*:\s*(.+)$', 2) AS text
  FROM specs WHERE regexp_matches(line, '(?i)^(?:[-*•]\s*)?(F2P|P2P)\s*:\s*(.+)$')),
reqs AS (
  SELECT source, row_number() OVER (PARTITION BY source ORDER BY line_no) AS position, own_id, text, line_no, proof,
         coalesce(own_id, 'R' || row_number() OVER (PARTITION BY source ORDER BY line_no)) AS id
  FROM (SELECT source, line_no, CASE WHEN line LIKE '|%' THEN trim(split_part(line, '|', 2)) END AS own_id,
          regexp_replace(replace(replace(CASE WHEN line LIKE '|%' THEN trim(split_part(line, '|', 3))
            ELSE regexp_extract(line, '(?i)^(?:[-*•]|\d+[.)]|REQ[-\w]*:|Requirement:)\s*(.+)$', 1) END, '`', ''), '**', ''), '\s+', ' ', 'g') AS text,
          CASE WHEN line LIKE '|%' THEN trim(split_part(line, '|', 4)) ELSE '' END AS proof
        FROM specs WHERE NOT regexp_matches(line, '^#{1,6}\s') AND NOT regexp_matches(line, '(?i)^(?:[-*•]\s*)?(F2P|P2P)\s*:\s*(.+)$')
          AND (line LIKE '|%' OR regexp_matches(line, '(?i)^(?:[-*•]|\d+[.)]|REQ[-\w]*:|Requirement:)\s*(.+)$')))),
judged AS (
  SELECT *, CASE WHEN regexp_matches(text, '(?i)\b(tbd|todo|to be decided|to be defined|fill me)\b') THEN 'incomplete'
    WHEN regexp_matches(text, '(?i)\b(fast|quick|easy|simple)\b') AND NOT regexp_matches(text || proof, '\d') THEN 'untestable' END AS flag,
    regexp_matches(text, '(?i)\b(name|value|field|form|file|send|set|add|type)\b') AS inputy,
    regexp_matches(text, '(?i)\b(existing|unchanged|stay|stays)\b') AS guard
  FROM reqs),
expanded AS (
  SELECT source, position, id AS req, 'T' || position || '.1' AS "case", 'positive' AS type, 'With a typical valid input, verify: ' || text AS "check",
    CASE WHEN bool_or(flag IS NOT NULL) OVER (PARTITION BY source, id ORDER BY position) THEN 'blocked: the requirement needs a measurable criterion first' ELSE 'requirement holds' END AS expect FROM judged
  UNION ALL SELECT source, position, id, 'T' || position || '.2', 'negative',
    CASE WHEN inputy THEN 'With empty, malformed or oversized input, verify: ' ELSE 'With the precondition missing, verify: ' END || text,
    'fails cleanly: clear message, nothing half-done' FROM judged WHERE inputy OR NOT guard
  UNION ALL SELECT source, position, id, 'T' || position || '.r', 'regression',
    'Re-run the checks that guarded this area before the change and compare: ' || text, 'same results as before the change (P2P)' FROM judged WHERE guard),
numbers AS (
  SELECT source, position, id, text, unnest(range(1, len(found) + 1)) AS i, unnest(found) AS raw FROM (
    SELECT *, list_filter(regexp_extract_all(regexp_replace(text, '(?i)(http|status|code|error|version|v|id|#)\s*\d+(\.\d+)?', '', 'g'),
      '\d+(?:\.\d+)?\s*(?:%|[A-Za-z]{1,12})?'), lambda x: NOT regexp_matches(x, '^(19|20)\d\d$')) AS found FROM reqs)),
limits AS (
  SELECT *, CAST(regexp_extract(raw, '\d+(?:\.\d+)?') AS DOUBLE) AS v,
    CASE WHEN regexp_matches(raw, '(items|days)$') THEN ' ' || regexp_extract(raw, '(items|days)$') ELSE '' END AS unit,
    CASE WHEN text LIKE '%at most%' THEN 'atmost' ELSE 'atleast' END AS rel FROM numbers),
bounds AS (
  SELECT source, position, id AS req, 'T' || position || '.b' || ((i - 1) * 3 + w + 1) AS "case", 'boundary' AS type,
    'Use ' || regexp_replace(CAST(CAST(v + (w - 1) * CASE WHEN v = floor(v) THEN 1 ELSE 0.1 END AS DECIMAL(18, 2)) AS VARCHAR), '\.?0+$', '')
      || unit || ' (' || ['below', 'at', 'above'][w + 1] || ' the limit ' || regexp_replace(CAST(CAST(v AS DECIMAL(18, 2)) AS VARCHAR), '\.?0+$', '') || '): ' || text AS "check",
    CASE WHEN w = 1 THEN 'accepted' WHEN (rel = 'atmost') = (w = 0) THEN 'accepted' ELSE 'rejected or flagged' END AS expect
  FROM limits, (SELECT unnest([0, 1, 2]) AS w)),
plan AS (SELECT * FROM expanded UNION ALL SELECT * FROM bounds)"""


def scaffold_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the files of scaffold folders of ten files each."""
    return table(spark, sf_dir, "documents").selectExpr(
        "concat('r', cast(floor(doc_id / 10) as bigint)) as source",
        "case doc_id % 10 when 0 then 'SKILL.md' when 1 then 'run.mjs' when 2 then if(lang = 'en', 'agent.md', 'AGENT.md')"
        " when 3 then 'mcp.json' when 4 then if(n_chars % 2 = 0, 'test.mjs', 'other.mjs') else concat('d', doc_id, '.md') end as name",
        "case doc_id % 10 when 0 then if(lang = 'en', concat('---\\nname: x\\ndescription: y\\n---\\n', text), text)"
        " when 1 then concat(text, if(lang = 'fr', '\\nfetch(\"http://localhost/\")', '\\n\\nawait Fetch (\"https://far.test\")'))"
        " when 2 then concat(text, if(n_chars % 2 = 0, '\\ntools: *', '\\ntools: read'))"
        " when 3 then concat('{\"id\": ', doc_id, if(lang = 'en', '}', '} x')) else text end as text",
    )


SQL_FILES = """files AS (
  SELECT 'r' || (doc_id // 10) AS source, CASE doc_id % 10 WHEN 0 THEN 'SKILL.md' WHEN 1 THEN 'run.mjs'
      WHEN 2 THEN CASE WHEN lang = 'en' THEN 'agent.md' ELSE 'AGENT.md' END WHEN 3 THEN 'mcp.json'
      WHEN 4 THEN CASE WHEN n_chars % 2 = 0 THEN 'test.mjs' ELSE 'other.mjs' END ELSE 'd' || doc_id || '.md' END AS name,
    CASE doc_id % 10 WHEN 0 THEN CASE WHEN lang = 'en' THEN '---' || chr(10) || 'name: x' || chr(10) || 'description: y' || chr(10) || '---' || chr(10) || text ELSE text END
      WHEN 1 THEN text || CASE WHEN lang = 'fr' THEN chr(10) || 'fetch("http://localhost/")' ELSE chr(10) || chr(10) || 'await Fetch ("https://far.test")' END
      WHEN 2 THEN text || CASE WHEN n_chars % 2 = 0 THEN chr(10) || 'tools: *' ELSE chr(10) || 'tools: read' END
      WHEN 3 THEN '{"id": ' || doc_id || CASE WHEN lang = 'en' THEN '}' ELSE '} x' END ELSE text END AS text
  FROM documents)"""


def order_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per priority and day as a metric history; a day with a very large order is a failed run."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("suite"), F.to_date("o_orderdate").alias("run_ts"))
        .agg(
            F.count("*").alias("value"),
            (F.max("o_totalprice") > 480000).alias("failed"),
            F.count_if(F.expr("o_orderstatus = 'P' and o_totalprice < 20000")).cast("int").alias("uncounted"),
        )
    )


SQL_HISTORY = """history AS (
  SELECT o_orderpriority AS suite, CAST(o_orderdate AS DATE) AS run_ts, count(*) AS value, max(o_totalprice) > 480000 AS failed,
         CAST(count(*) FILTER (o_orderstatus = 'P' AND o_totalprice < 20000) AS INTEGER) AS uncounted
  FROM orders GROUP BY 1, 2)"""
