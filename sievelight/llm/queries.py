"""The operators as registered queries over whole tables, with SQL where SQL can say the same."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm.decontam import benchmark_hits, contaminated
from sievelight.llm.jaccard import jaccard_components
from sievelight.llm.merkle import fold, hex_of, merkle_proofs, proof_digest, row_digest
from sievelight.llm.middle import fill_in_middle
from sievelight.llm.pieces import build_dictionary, document_digests, encoded_segments, load_model
from sievelight.llm.quality import quality_verdicts
from sievelight.llm.ranking import document_features, fit_quality_ranking, ranked_documents
from sievelight.llm.sharding import hash_class, hilbert_shards, log_class
from sievelight.llm.suffixes import suffix_dedup
from sievelight.llm.toxicity import fit_toxicity, toxicity_scores
from sievelight.llm.urls import url_filter
from sievelight.llm.warc import resolve_revisits
from sievelight.llm.wrappers import extract_main_text
from sievelight.plans.session import stored

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


#: The model file of op3; any SentencePiece file of pieces by merges or by unigram scores will do.
PIECE_MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, model = _table(spark, sf_dir, "documents"), load_model(PIECE_MODEL)
    segments = encoded_segments(docs, build_dictionary(docs, model), model)
    return document_digests(docs, segments, model)


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf_dir, "documents")).drop("spans")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_verdicts(_table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good"
    )


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Pages with `outcome`: 1 if the document whose number ends the url's path is labelled good and not toxic, else 0, or null."""
    labels = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")).alias("outcome"))
    number = F.regexp_extract(F.col("url"), "://[^/?#]*[^?#]*?/([0-9]{1,18})(?:\\.html)?/?(?:[?#]|$)", 1)
    pages = pages.withColumn("_doc", F.when(number != "", number.cast("long")))
    return pages.join(labels, F.col("_doc") == F.col("doc_id"), "left").drop("_doc", "doc_id")


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = page_outcomes(_table(spark, sf_dir, "pages").select("page_id", "url"), _table(spark, sf_dir, "labels"))
    judged = url_filter(pages, RULES, F.col("outcome"), bound=BOUND)
    return judged.select("page_id", "host", "path", "rule", "verdict")


BOUND = 0.6


def _shrunk_sql(level: str, key: str, mean: str) -> str:
    """Adds alpha and beta to a table of good, seen and the parent's mean."""
    return f"""{level}_m AS (SELECT * EXCLUDE above, greatest(0.001, least(0.999, {mean})) AS mean FROM {level}_in),
{level}_w AS (SELECT 1 / greatest(0.001, least(0.5, coalesce(
    (sum(seen * (good / seen - mean) * (good / seen - mean) / (mean * (1 - mean))) - count(*)) / nullif(sum(seen - 1), 0), 0.5))) - 1 AS weight
  FROM {level}_m WHERE seen > 0),
{level}_p AS (SELECT t.*, weight * mean + good AS alpha, weight * (1 - mean) + seen - good AS beta FROM {level}_m t, {level}_w)"""


def _rules_sql() -> tuple[str, str]:
    rule = verdict = ""
    for say, text in sorted(RULES, key=lambda r: -len(r[1])):
        host, path = text[: text.index("/")], text[text.index("/") :]
        fits = f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN"
        rule, verdict = f"{rule} {fits} '{text}'", f"{verdict} {fits} '{say}'"
    return f"CASE{rule} END", f"CASE{verdict} END"


OP6_SQL = f"""WITH parsed AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
         TRY_CAST(nullif(regexp_extract(url, '://[^/?#]*[^?#]*?/([0-9]{{1,18}})(?:\\.html)?/?(?:[?#]|$)', 1), '') AS BIGINT) AS doc
  FROM pages),
outcomes AS (SELECT doc_id, min(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS outcome FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
hosts AS (
  SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix,
         CAST(coalesce(sum(outcome), 0) AS DOUBLE) AS good, CAST(count(outcome) AS DOUBLE) AS seen
  FROM parsed LEFT JOIN outcomes ON doc = doc_id GROUP BY host),
suffix_in AS (SELECT suffix, sum(good) AS good, sum(seen) AS seen, (SELECT (sum(good) + 1) / (sum(seen) + 2) FROM hosts) AS above FROM hosts GROUP BY suffix),
{_shrunk_sql('suffix', 'suffix', 'above')},
domain_in AS (SELECT domain, d.suffix, d.good, d.seen, alpha / (alpha + beta) AS above
  FROM (SELECT domain, suffix, sum(good) AS good, sum(seen) AS seen FROM hosts GROUP BY domain, suffix) d JOIN suffix_p USING (suffix)),
{_shrunk_sql('domain', 'domain', 'above')},
host_in AS (SELECT host, h.good, h.seen, alpha / (alpha + beta) AS above FROM hosts h JOIN domain_p USING (domain)),
{_shrunk_sql('host', 'host', 'above')},
known AS (SELECT host, alpha / (alpha + beta) - 1.645 * sqrt(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1))) AS lower FROM host_p)
SELECT page_id, host, path, {_rules_sql()[0]} AS rule, coalesce({_rules_sql()[1]}, CASE WHEN lower >= {BOUND} THEN 'allow' ELSE 'block' END) AS verdict
FROM parsed JOIN known USING (host)"""


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text").cast("binary")
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"),
        hash_class(F.col("lang"), 16).alias("lang"),
        hash_class(F.col("source"), 16).alias("source"),
    )
    axes = [F.col("lang"), F.col("source"), log_class(F.col("size") / 16, 15)]
    return hilbert_shards(docs, axes, 40, "doc_id").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def archive_records(pages: DataFrame) -> DataFrame:
    """Archive records of a page table: every page has a full response, a failed one and a 304 for a variant of its URL.

    The validators and times of the 304s vary with the page's number: other etags, weak ones, dates only, payload
    digests only, none at all, and captures before the page's own response.
    """
    n, tag = F.col("page_id"), F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    base = F.substring_index("url", "#", 1)
    variant = F.concat(base, F.when(base.contains("?"), "&").otherwise("?"), F.lit("utm_campaign=again#x"))
    date, digest = F.concat(F.lit("day "), n), F.sha1(F.coalesce("html", F.lit("")))

    def record(k: int, url, ts, kind: str, status: int, etag, modified, digest, age: str):
        headers = F.map_from_arrays(
            F.array(*map(F.lit, ("date", "cache-control", "content-length", "etag"))),
            F.array(ts.cast("string"), F.lit(f"max-age={age}"), F.length("html").cast("string"), F.coalesce(etag, F.lit(""))),
        )
        return F.struct(
            (n * 4 + k).alias("record_id"), url.alias("url"), ts.alias("ts"), F.lit(kind).alias("kind"), F.lit(status).alias("status"),
            etag.alias("etag"), modified.alias("last_modified"), digest.alias("digest"), headers.alias("headers"),
        )

    none, last = F.lit(None).cast("string"), n % 20
    late = F.when(n % 11 == 0, n * 10 - 5).otherwise(n * 10 + 5 + 1000 * (n % 3))
    sent = F.when(last < 12, tag).when(last < 14, F.concat(F.lit("W/"), tag)).when(last < 16, F.lit('"other"'))
    rows = F.array(
        record(0, F.col("url"), n * 10, "response", 200, tag, date, digest, "60"),
        record(1, variant, late, "revisit", 304, sent, F.when(last < 18, date), F.when(last < 19, digest), "600"),
        record(2, F.col("url"), n * 10 + 2, "response", 500, none, none, none, "0"),
    )
    return pages.select(F.explode(rows).alias("r")).select("r.*")


def op8_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = resolve_revisits(archive_records(_table(spark, sf_dir, "pages")))
    fields = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return told.withColumn("headers", F.array_join(fields, "\n"))


OP8_SQL = """WITH n AS (SELECT *, '"' || md5(coalesce(html, '')) || '"' AS tag, sha1(coalesce(html, '')) AS dig, split_part(url, '#', 1) AS base, page_id % 20 AS l FROM pages),
records AS (
  SELECT page_id * 4 AS record_id, url, page_id * 10 AS ts, 'response' AS kind, tag AS etag, 'day ' || page_id AS modified, dig AS digest, length(html) AS size FROM n
  UNION ALL
  SELECT page_id * 4 + 1, base || CASE WHEN contains(base, '?') THEN '&' ELSE '?' END || 'utm_campaign=again#x',
         CASE WHEN page_id % 11 = 0 THEN page_id * 10 - 5 ELSE page_id * 10 + 5 + 1000 * (page_id % 3) END, 'revisit',
         CASE WHEN l < 12 THEN tag WHEN l < 14 THEN 'W/' || tag WHEN l < 16 THEN '"other"' END, CASE WHEN l < 18 THEN 'day ' || page_id END,
         CASE WHEN l < 19 THEN dig END, length(html) FROM n),
parsed AS (SELECT *, translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', '') AS path, regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) AS query FROM records),
fields AS (SELECT record_id, string_agg(f, '&' ORDER BY f) AS query FROM (SELECT record_id, unnest(string_split(query, '&')) AS f FROM parsed) WHERE f <> '' AND NOT starts_with(f, 'utm_') GROUP BY record_id),
named AS (SELECT p.* EXCLUDE query, regexp_replace(host, ':(80|443)?$', '') || path || coalesce('?' || f.query, '') AS canonical_url FROM parsed p LEFT JOIN fields f USING (record_id)),
met AS (
  SELECT v.*, o.record_id AS original_id, o.etag AS o_etag, o.modified AS o_modified, o.digest AS o_digest, o.size AS o_size,
         row_number() OVER (PARTITION BY v.record_id ORDER BY o.ts DESC, o.record_id DESC) AS place
  FROM named v LEFT JOIN named o ON o.kind = 'response' AND o.canonical_url = v.canonical_url AND o.ts < v.ts WHERE v.kind = 'revisit'),
judged AS (
  SELECT *, CASE WHEN original_id IS NULL THEN 'orphan'
    WHEN etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = o_etag THEN 'resolved' ELSE 'mismatch' END
    WHEN modified IS NOT NULL THEN CASE WHEN modified = o_modified THEN 'resolved' ELSE 'mismatch' END
    WHEN digest IS NOT NULL THEN CASE WHEN digest = o_digest THEN 'resolved' ELSE 'mismatch' END ELSE 'unvalidated' END AS outcome
  FROM met WHERE place = 1)
SELECT record_id, canonical_url, original_id, outcome, CASE WHEN outcome = 'resolved' THEN
  'cache-control: max-age=600' || chr(10) || 'content-length: ' || o_size || chr(10) || 'date: ' || ts || chr(10) || 'etag: ' || coalesce(etag, '') END AS headers
FROM judged"""


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = benchmark_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return contaminated(hits).withColumn("score", F.round("score", 6))


def held_out(doc_id="doc_id"):
    """True for documents whose labels are never learned from."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, _table(spark, sf_dir, "labels").filter(~held_out()))
    scored = toxicity_scores(docs, model)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))


def op11_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = stored(document_features(_table(spark, sf_dir, "documents")))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    ranking = fit_quality_ranking(features, _table(spark, sf_dir, "labels").filter(~held), label="quality")
    ranked = ranked_documents(features, ranking)
    return ranked.select("doc_id", held.alias("held_out"), "score", F.col("kept").cast("int").alias("predicted"), "strength")


MANIFEST_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [F.col(c) for c in MANIFEST_FIELDS]
    tampered = row_digest([*fields[:-1], F.replace("text", F.lit("\n"), F.lit(""))])
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    rows = _table(spark, sf_dir, "documents").select("doc_id", "source", row_digest(fields).alias("leaf"), F.when(struck, tampered).alias("tampered"))
    proven = merkle_proofs(rows, keep=("tampered",))
    proven = proven.withColumn("folded", fold(F.coalesce("tampered", "leaf"), F.col("steps")))
    digests = [hex_of(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")]
    return proven.select(
        "doc_id", *digests, proof_digest(F.col("steps")).alias("proof_sha256"), hex_of(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified")
    )


def _field_sql(column: str, value: str | None = None) -> str:
    value = value or f"CAST({column} AS VARCHAR)"
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def _levels_sql(name: str, levels: int) -> str:
    """Tables {name}1, {name}2, ...: each level's nodes per tree of {name}0 (tree, level, pos, h), while a tree has more than one."""
    made = [
        f"""{name}{k + 1} AS (SELECT tree, {k + 1} AS level, pos // 3 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS size FROM {name}{k}) WHERE size > 1 GROUP BY tree, pos // 3)"""
        for k in range(levels)
    ]
    return ",\n".join(made) + f",\n{name} AS (" + " UNION ALL ".join(f"SELECT * FROM {name}{k}" for k in range(levels + 1)) + ")"


#: Enough levels for 3^12 rows of a source and as many sources.
SQL_LEVELS = 12

OP12_SQL = f"""WITH RECURSIVE crc_step(byte, c, k) AS (
  SELECT byte, byte, 0 FROM (SELECT CAST(range AS BIGINT) AS byte FROM range(256))
  UNION ALL SELECT byte, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_step WHERE k < 8),
ids AS (SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS digits FROM documents WHERE doc_id IS NOT NULL),
crcs(doc_id, digits, k, c) AS (
  SELECT doc_id, digits, 0, CAST(4294967295 AS BIGINT) FROM ids
  UNION ALL SELECT doc_id, digits, crcs.k + 1, xor(crcs.c >> 8, t.c) FROM crcs
  JOIN crc_step t ON t.k = 8 AND t.byte = xor(crcs.c & 255, CAST(ascii(substr(digits, crcs.k + 1, 1)) AS BIGINT)) WHERE crcs.k < strlen(digits)),
struck AS (SELECT doc_id FROM crcs WHERE k = strlen(digits) AND xor(c, 4294967295) % 2 = 0),
leaves AS (
  SELECT doc_id, source, sha256({' || '.join(_field_sql(c) for c in MANIFEST_FIELDS)}) AS leaf,
         sha256({' || '.join(_field_sql(c) for c in MANIFEST_FIELDS[:-1])} || {_field_sql('text', "replace(text, chr(10), '')")}) AS changed FROM documents),
placed AS (
  SELECT d.doc_id, leaf, CASE WHEN s.doc_id IS NULL THEN leaf ELSE changed END AS seen,
         dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY d.doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM leaves d LEFT JOIN struck s ON s.doc_id = d.doc_id),
low0 AS (SELECT tree, 0 AS level, pos, leaf AS h FROM placed),
{_levels_sql('low', SQL_LEVELS)},
low_top AS (SELECT tree, max(level) AS height, arg_max(h, level) AS subroot FROM low GROUP BY tree),
high0 AS (SELECT 0 AS tree, 0 AS level, tree AS pos, subroot AS h FROM low_top),
{_levels_sql('high', SQL_LEVELS)},
high_top AS (SELECT max(level) AS height, arg_max(h, level) AS root FROM high),
steps AS (
  SELECT p.tree AS tree, p.pos AS pos, a.level AS k,
         coalesce(string_agg(a.h, '' ORDER BY a.pos) FILTER (WHERE a.pos < p.pos // CAST(pow(3, a.level) AS BIGINT)), '') AS l,
         coalesce(string_agg(a.h, '' ORDER BY a.pos) FILTER (WHERE a.pos > p.pos // CAST(pow(3, a.level) AS BIGINT)), '') AS r
  FROM placed p JOIN low_top t ON t.tree = p.tree JOIN low a ON a.tree = p.tree AND a.level < t.height AND a.pos // 3 = p.pos // CAST(pow(3, a.level + 1) AS BIGINT)
  GROUP BY p.tree, p.pos, a.level
  UNION ALL
  SELECT p.tree, p.pos, t.height + a.level,
         coalesce(string_agg(a.h, '' ORDER BY a.pos) FILTER (WHERE a.pos < p.tree // CAST(pow(3, a.level) AS BIGINT)), ''),
         coalesce(string_agg(a.h, '' ORDER BY a.pos) FILTER (WHERE a.pos > p.tree // CAST(pow(3, a.level) AS BIGINT)), '')
  FROM placed p JOIN low_top t ON t.tree = p.tree, high_top, high a WHERE a.level < high_top.height AND a.pos // 3 = p.tree // CAST(pow(3, a.level + 1) AS BIGINT)
  GROUP BY p.tree, p.pos, t.height, a.level),
proofs AS (SELECT tree, pos, sha256(string_agg(l || r, '' ORDER BY k)) AS proof FROM steps GROUP BY tree, pos),
folded(tree, pos, k, h) AS (
  SELECT tree, pos, 0, seen FROM placed
  UNION ALL SELECT f.tree, f.pos, f.k + 1, sha256(l || f.h || r) FROM folded f JOIN steps s ON s.tree = f.tree AND s.pos = f.pos AND s.k = f.k),
ends AS (SELECT tree, pos, arg_max(h, k) AS h FROM folded GROUP BY tree, pos)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, e.h AS folded_root, e.h = root AS verified
FROM placed p JOIN low_top t ON t.tree = p.tree JOIN ends e ON e.tree = p.tree AND e.pos = p.pos LEFT JOIN proofs x ON x.tree = p.tree AND x.pos = p.pos, high_top"""


def op13_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(_table(spark, sf_dir, "documents"), restored=True)
    digests = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def _draw_sql(k: int) -> str:
    return f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT)"


OP13_SQL = f"""WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS units FROM documents),
drawn AS (
  SELECT *, len(units) AS n, {_draw_sql(0)} % (len(units) + 1) AS a, {_draw_sql(1)} % (len(units) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {_draw_sql(2)} % 100 >= 50 THEN 'plain'
              WHEN {_draw_sql(3)} % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (
  SELECT *, array_to_string(units[1:least(a, b)], '') AS p, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS m,
         array_to_string(units[greatest(a, b) + 1:], '') AS s FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM parts"""


QUERIES = {f.__name__: f for f in (op1_jaccard, op2_main_text, op3_pieces, op4_suffixes, op5_quality, op6_urls, op7_sharding, op8_revisits, op9_decontamination, op10_toxicity, op11_ranking, op12_manifest, op13_middle)}
ORACLES = {"op6_urls": OP6_SQL, "op8_revisits": OP8_SQL, "op12_manifest": OP12_SQL, "op13_middle": OP13_SQL}
