"""Sources of whole files: tables written as files of that kind and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelight.operators import campaign as cp
from sievelight.operators import evaluation as ev
from sievelight.sources import corpus
from sievelight.sources.campaigns import read_campaigns
from sievelight.sources.datasets import read_json_dataset
from sievelight.sources.lines import read_log_lines
from workload import inputs as i
from workload.files import scratch


def _one_file_each(df: DataFrame, folders: list[str], text: str) -> str:
    """Every row as a text file of its own, below a folder per value of `folders`."""
    folder = scratch(df.sparkSession)
    df.select(*folders, F.col(text).alias("value")).write.partitionBy(*folders).text(folder)
    return folder


def _json_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applicants as JSON arrays of up to 500 objects."""
    rows = i.applicants(spark, sf_dir).select(F.floor(F.col("n") / 500).alias("part"), "n", F.struct("id", "name", "email", "age").alias("row"))
    arrays = rows.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("n", "row"))).alias("all"))
    texts = arrays.select("part", F.to_json(F.transform("all", lambda x: x["row"])).alias("text"))
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "name", "email", "age")])
    got = read_json_dataset(spark, _one_file_each(texts, ["part"], "text"), schema)
    return got.select(F.regexp_extract("source", "part=([0-9]+)", 1).cast("long").alias("part"), "n", "id", "name", "email", "age")


SQL_ARRAYS = (
    f"WITH {i.SQL_APPLICANTS} SELECT n // 500 AS part, row_number() OVER (PARTITION BY n // 500 ORDER BY n) AS n, id, name, email, age FROM data"
)


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in files of fifty, one folder per language."""
    docs = i.table(spark, sf_dir, "documents").select("lang", F.floor(F.col("doc_id") / 50).alias("part"), "doc_id", "text")
    parts = docs.groupBy("lang", "part").agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("all"))
    texts = parts.select("lang", "part", F.array_join(F.transform("all", lambda x: x["text"]), "\n").alias("text"))
    got = corpus.read_corpus(spark, _one_file_each(texts, ["lang", "part"], "text"))
    named = got.select(F.regexp_extract("doc", "^lang=([^/]*)/part=([0-9]+)/[^/]*$", 1).alias("lang"), F.regexp_extract("doc", "^lang=([^/]*)/part=([0-9]+)/[^/]*$", 2).cast("long").alias("part"), "text")
    return named.select("lang", "part", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


SQL_CORPUS = (
    "SELECT lang, doc_id // 50 AS part, length(t) AS chars, md5(t) AS digest FROM (SELECT lang, doc_id // 50 * 50 AS doc_id, string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS t "
    "FROM documents GROUP BY lang, doc_id // 50 * 50)"
)


def _eval_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as answers and their conversations as cases, in nested JSON files of a hundred, scored after reading."""
    turns = i.table(spark, sf_dir, "conversations").select(F.floor(F.col("conv_id") / 100).alias("part"), F.col("conv_id").cast("string").alias("case"), F.col("turn").cast("int").alias("run"), "text")
    answers = turns.groupBy("part").agg(F.to_json(F.struct(F.collect_list(F.struct("case", "run", "text")).alias("answers"))).alias("text"))
    checks = ev.rubric_checks([*i.RUBRIC, ("is-json", "json", None, None)])
    ids = turns.select("part", "case").distinct().withColumn("checks", checks)
    cases = ids.groupBy("part").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("case").alias("id"), "checks")).alias("cases"))).alias("text"))
    got, said = corpus.read_eval_suite(spark, _one_file_each(cases, ["part"], "text"), _one_file_each(answers, ["part"], "text"))
    checked = said.join(got, "case")
    return checked.groupBy("case").agg(F.count("*").alias("answers"), F.sum(F.length("text")).alias("chars"), F.max(F.size("checks")).alias("checks"), F.max(F.get("checks", F.lit(6))["kind"]).alias("last_kind"))


SQL_SUITE = "SELECT CAST(conv_id AS VARCHAR) AS \"case\", count(*) AS answers, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(7 AS INTEGER) AS checks, 'json' AS last_kind FROM conversations GROUP BY 1"


def _judge_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a reply file, its odd turns below a result heading; files of even ones name a verdict."""
    turns = i.table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "text").alias("t"), (F.col("turn") % 2).alias("odd"))
    halves = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("odd") == 0, F.col("t")))).alias("a"), F.array_sort(F.collect_list(F.when(F.col("odd") == 1, F.col("t")))).alias("b"))

    def text(name: str):
        return F.array_join(F.transform(name, lambda x: x["text"]), "\n")

    body = F.concat(text("a"), F.lit("\n## Result\n<task_result>\nconv "), "conv_id", F.when(F.col("conv_id") % 2 == 0, " Verdict: PASS\n").otherwise("\n"), text("b"), F.lit("\n</task_result>\nend"))
    folder = _one_file_each(halves.select("conv_id", body.alias("text")), ["conv_id"], "text")
    got = corpus.read_judge_replies(spark, folder + "/*", r"^part-.*\.txt$")
    return got.select(F.regexp_extract("text", "conv ([0-9]+)", 1).cast("long").alias("conv_id"), F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


SQL_REPLIES = """SELECT conv_id, length(t) AS chars, md5(t) AS digest FROM (
  SELECT conv_id, trim('conv ' || conv_id || ' Verdict: PASS' || chr(10) || coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (turn % 2 = 1), ''), ' ' || chr(10) || chr(9) || chr(13)) AS t
  FROM conversations GROUP BY conv_id) WHERE conv_id % 2 = 0"""


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document ids in files of up to five hundred: a JSON array in every other one, the keys of an object in the rest."""
    docs = i.table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 500).alias("part"), F.concat(F.lit("bt-"), "doc_id").alias("id"))
    sets = docs.groupBy("part").agg(F.collect_list("id").alias("ids"))
    seen = F.map_from_arrays(F.col("ids"), F.transform("ids", lambda _: F.lit("seen")))
    texts = sets.select("part", F.when(F.col("part") % 2 == 0, F.to_json("ids")).otherwise(F.to_json(seen)).alias("text"))
    return corpus.read_known(spark, _one_file_each(texts, ["part"], "text"))


def _named_files(spark: SparkSession, files: DataFrame) -> str:
    """`source, file, text` as files of those names, in one folder per source. Names are moved one by one: a few sources only."""
    folder, root = _one_file_each(files, ["source", "file"], "text"), scratch(spark)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.globStatus(path(f"{folder}/source=*/file=*/part-*")):
        parts = status.getPath().toString().split("/")
        to = path(f"{root}/{parts[-3].split('=', 1)[1]}/{parts[-2].split('=', 1)[1].replace('%2F', '/')}")
        fs.mkdirs(to.getParent())
        fs.rename(status.getPath(), to)
    return root


def _campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The campaigns of the pages as folders: their fields, all their posts in one file, and their visits."""
    posts = i.linked_posts(spark, sf_dir).groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("text"))
    links = cp.extract_links(i.linked_posts(spark, sf_dir)).filter("url NOT LIKE '%,%'")
    rows = links.select("source", F.concat("url", F.lit(","), F.col("line_no") * 10).alias("row"))
    visits = rows.groupBy("source").agg(F.concat(F.lit("URL,Visits\n"), F.array_join(F.array_sort(F.collect_list("row")), "\n")).alias("text"))
    fields = i.campaigns(spark, sf_dir).select("source", F.concat(F.to_json("fields"), F.when(F.col("source") == "net", " junk").otherwise("")).alias("text"))
    files = [fields.withColumn("file", F.lit("campaign.json")), posts.withColumn("file", F.lit("posts/all.md")), visits.withColumn("file", F.lit("visits.csv"))]
    both = files[0].unionByName(files[1]).unionByName(files[2])
    got = read_campaigns(spark, _named_files(spark, both))

    def by_name(df: DataFrame) -> DataFrame:
        return df.withColumn("source", F.substring_index("source", "/", -1))

    said = by_name(got.visits).groupBy("source").agg(F.count("*").alias("visits_rows"), F.sum(F.col("visits").cast("long")).alias("visits"))
    text = by_name(got.posts).groupBy("source").agg(F.sum(F.length("text")).alias("chars"))
    medium = by_name(got.campaigns).select("source", F.col("fields")["utm_medium"].alias("utm_medium"))
    return medium.join(said, "source", "left").join(text, "source", "left")


SQL_CAMPAIGN_FILES = (
    f"WITH {i.SQL_POSTS}, {i.SQL_CAMPAIGNS}, t AS (SELECT source, sum(length('# Page ' || page_id || chr(10) || 'See [it](' || tagged || ')' || chr(10) || chr(10) || '<a href=\"' || url || '\">' "
    "|| page_id || '</a> and [local](/x)') + 1) AS chars FROM posts GROUP BY 1), v AS (SELECT source, count(*) AS visits_rows, CAST(sum(line_no * 10) AS BIGINT) AS visits FROM links WHERE NOT contains(url, ',') GROUP BY 1) "
    "SELECT source, CASE WHEN source <> 'net' THEN utm_medium END AS utm_medium, visits_rows, visits, CAST(chars AS BIGINT) AS chars FROM campaigns LEFT JOIN v USING (source) LEFT JOIN t USING (source)"
)


def _log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as log files of five hundred ids per language: line numbers, blank lines and what counts as a line."""
    docs = i.table(spark, sf_dir, "documents").select("lang", F.floor(F.col("doc_id") / 500).alias("part"), F.struct("doc_id", "text").alias("doc"))
    parts = docs.groupBy("lang", "part").agg(F.array_sort(F.collect_list("doc")).alias("all"))
    texts = parts.select("lang", "part", F.array_join(F.transform("all", lambda x: x["text"]), "\n\n").alias("text"))
    got = read_log_lines(spark, _one_file_each(texts, ["lang", "part"], "text"))
    place = "lang=([^/]*)/part=([0-9]+)/"
    return got.select(
        F.regexp_extract("source", place, 1).alias("lang"), F.regexp_extract("source", place, 2).cast("long").alias("part"), "line_no", "n", F.length("line").alias("chars")
    )


SQL_LOG_LINES = """WITH t AS (SELECT lang, doc_id // 500 AS part, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS text FROM documents GROUP BY 1, 2),
l AS (SELECT lang, part, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS line_no FROM (SELECT lang, part, string_split(text, chr(10)) AS parts FROM t))
SELECT lang, part, line_no, row_number() OVER (PARTITION BY lang, part ORDER BY line_no) AS n, CAST(length(line) AS INTEGER) AS chars FROM l WHERE trim(line) <> ''"""

QUERIES = {
    "read_dataset_json": (_json_arrays, SQL_ARRAYS),
    "read_corpus": (_corpus, SQL_CORPUS),
    "read_eval_suite": (_eval_suite, SQL_SUITE),
    "read_judge_replies": (_judge_replies, SQL_REPLIES),
    "read_known": (_known, "SELECT DISTINCT 'bt-' || doc_id AS id FROM documents"),
    "read_campaigns": (_campaigns, SQL_CAMPAIGN_FILES),
    "read_log_lines_numbered": (_log_lines, SQL_LOG_LINES),
}
