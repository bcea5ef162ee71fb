import codecs
import json
import os
import random
import re

import pytest
from helpers import rows_of, stamp
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelight.operators import cleaning as cl
from sievelight.operators import triage as tr
from sievelight.operators.evaluation import pass_gate, score_answers
from sievelight.operators.findings import union_findings
from sievelight.operators.retrieval import bm25_topk, build_index
from sievelight.sources import corpus, datasets, json_ranges, lines, sinks
from sievelight.sources.campaigns import read_campaigns
from sievelight.sources.lines import read_numbered_lines


def put(folder, name, text, encoding="utf8"):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode(encoding))
    return str(path)


def test_line_numbers_of_split_files(spark, tmp_path):
    want = []
    for name, count in (("a.log", 700), ("b.log", 30)):
        rows = ["" if i % 5 == 0 else f"{stamp(i)} line {i}" + "\r" * (i % 2) for i in range(1, count + 1)]
        put(tmp_path, name, "\n".join(rows) + "\n")
        n = 0
        for no, row in enumerate(rows, 1):
            n += bool(row)
            want.append((name, no, n if row else None, row.rstrip("\r")))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        df = lines.read_log_lines(spark, str(tmp_path), keep_blank=True)
        got = df.withColumn("source", F.substring_index("source", "/", -1))
        assert rows_of(got.na.fill(-1, ["n"]), "source", "line_no", "n", "line") == sorted((s, no, n or -1, x) for s, no, n, x in want)
        assert df.select("ts_ms").filter("ts_ms is not null").count() == sum(1 for w in want if w[2])
        assert lines.read_log_lines(spark, str(tmp_path)).count() == sum(1 for w in want if w[2])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize(("size", "cost"), [("300", "1"), ("20000", "1"), ("20000", "4000")])
def test_lines_are_numbered_where_they_are_read(spark, tmp_path, size, cost):
    """Several blocks a file and several files a task, blocks without kept lines; no line is shuffled or sorted."""
    want = []
    for name in ("a", "b", "c", "d", "e"):
        rows = [("" if (k // 40) % 2 else "x" * (k % 7)) for k in range(ord(name) % 5 * 90 + 3)]
        put(tmp_path, f"{name}.log", "\n".join(rows))
        numbered = iter(range(1, len(rows) + 1))
        want += [(name, no, next(numbered) if row else None, row) for no, row in enumerate(rows, 1)]
        if not rows[-1]:
            want.pop()
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for key, value in zip(before, (size, cost), strict=True):
            spark.conf.set(key, value)
        for kept_only in (True, False):
            df = read_numbered_lines(spark, str(tmp_path), kept_only=kept_only)
            got = [(r["source"][-5], r["line_no"], r["n"], r["line"]) for r in df.collect()]
            assert sorted(map(repr, got)) == sorted(repr(w) for w in want if w[2] or not kept_only)
            plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
            moved = re.findall(r"\(\d+\) (?:Exchange|Sort|Window)\b.*\nInput \[\d+\]: (.*)", plan)
            assert moved and not any("line#" in x or "value#" in x for x in moved)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_encodings(spark, tmp_path):
    log = "2031-03-09T08:00:05Z ERROR burst 1\n2031-03-09T08:00:06Z ERROR burst 2\n"
    put(tmp_path, "wide.log", codecs.BOM_UTF16_LE + log.encode("utf-16-le"))
    put(tmp_path, "mark.log", codecs.BOM_UTF8 + log.encode())
    put(tmp_path, "bare.log", log)
    texts = lines.read_text_files(spark, str(tmp_path))
    assert rows_of(texts, "text") == [(log,)] * 3
    counts = tr.pattern_counts(lines.lines_from_text(texts))
    assert rows_of(counts, "count") == [(2,)] * 3
    marked = lines.read_numbered_lines(spark, str(tmp_path / "mark.log"))
    assert rows_of(marked, "line_no", "line")[0] == (1, log.split("\n")[0])


def test_missing_path_fails(spark, tmp_path):
    with pytest.raises(Exception):
        lines.read_log_lines(spark, str(tmp_path / "none.log")).count()


CSV = 'id, name ,email,age\n1,"Ines, Roy",ines@mail.test,31\n\n1,"Ines, Roy",ines@mail.test,31\n2,Otto\n'


def test_csv_dataset_and_clean_copy(spark, tmp_path):
    path = put(tmp_path, "in/data.csv", CSV)
    df = datasets.read_dataset(spark, path)
    assert rows_of(df, "n", "id", "name", "email", "age") == [
        (1, "1", "Ines, Roy", "ines@mail.test", "31"), (2, "1", "Ines, Roy", "ines@mail.test", "31"), (3, "2", "Otto", "", ""),
    ]
    found = cl.dataset_findings(df)
    out = str(tmp_path / "clean")
    sinks.write_clean(cl.clean_rows(df, found), out)
    again = spark.read.option("header", True).csv(out)
    assert again.columns == ["id", "name", "email", "age"] and again.count() == 1
    assert open(path, encoding="utf8").read() == CSV
    with pytest.raises(Exception):
        sinks.write_clean(df, out)


def test_json_datasets(spark, tmp_path):
    rows = [{"id": "1", "title": "T", "pay": {"min": 1, "max": -2}}, {"id": "2"}, {"id": "1", "title": "T", "pay": {"min": 1, "max": -2}}]
    array = put(tmp_path, "a/data.json", json.dumps(rows))
    listed = put(tmp_path, "b/data.jsonl", "talk\n" + "\n".join(map(json.dumps, rows)) + "\n")
    for path in (array, listed):
        df = datasets.read_dataset(spark, path)
        assert rows_of(df, "n", "id") == [(1, "1"), (2, "2"), (3, "1")]
        assert {r["n"]: set(r["fields"]) for r in df.collect()} == {1: {"id", "title", "pay"}, 2: {"id"}, 3: {"id", "title", "pay"}}
        assert rows_of(cl.nested_out_of_range(df), "row", "key") == [(1, "pay.max"), (3, "pay.max")]
        assert rows_of(cl.exact_dupe(df), "row") == [(3,)]
    sinks.write_clean(datasets.read_dataset(spark, listed).filter("n = 2"), str(tmp_path / "out"), "jsonl")
    assert [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "out")).collect()] == [{"id": "2"}]
    bad = put(tmp_path, "c/data.json", '{"id": 1}')
    with pytest.raises(Exception, match="must be an array"):
        datasets.read_dataset(spark, bad).collect()


def odd_objects(seed, count):
    """Objects whose strings hold quotes, braces, brackets, backslashes and wide characters, and whose values nest."""
    rng = random.Random(seed)
    texts = ["}", "{", '"', "\\", '\\"', "},{", "[]", "é", "\U0001f600", "a", " ", ",", ":", "\n", "\\\\", "]", '{"x": 1}']

    def value(depth):
        pick = rng.randrange(7 if depth < 3 else 4)
        if pick < 3:
            return "".join(rng.choices(texts, k=rng.randrange(6)))
        return [rng.randrange(99), None, {f"k{k}": value(depth + 1) for k in range(rng.randrange(3))}, [value(depth + 1) for _ in range(rng.randrange(3))], True, 1.5][pick - 3 if pick < 7 else 0]

    return [{"id": str(k), **{f"v{j}": value(0) for j in range(rng.randrange(4))}} for k in range(count)]


@pytest.fixture
def small_blocks(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def use(size, cost="1"):
        for key, given in zip(before, (size, cost), strict=True):
            spark.conf.set(key, given)

    yield use
    for key, given in before.items():
        spark.conf.set(key, given)


@pytest.mark.parametrize(("size", "cost"), [("40", "1"), ("700", "1"), ("5000", "100"), ("10000000", "1")])
def test_json_arrays_by_byte_ranges(spark, tmp_path, small_blocks, size, cost):
    """Arrays without line ends, with many, with a mark, of one object and of none: the objects of every file, in order."""
    rows = odd_objects(int(size), 60 if size == "40" else 400)
    files = {"a": (rows, json.dumps(rows)), "b": (rows[:50], json.dumps(rows[:50], indent=2, ensure_ascii=False) + "\n \n"), "c": (rows[:1], " [" + json.dumps(rows[0]) + "]")}
    files |= {"d": ([], "[\n]"), "e": (rows[:9], "\ufeff" + json.dumps(rows[:9]))}
    for name, (_, text) in files.items():
        put(tmp_path, f"{name}.json", text)
    put(tmp_path, "w.json", codecs.BOM_UTF16_LE + json.dumps(rows[:7]).encode("utf-16-le"))
    small_blocks(size, cost)
    got = {}
    for r in json_ranges.read_json_objects(spark, str(tmp_path)).collect():
        got.setdefault(r["source"][-6], []).append((r["n"], json.loads(r["object"])))
    want = {name: list(enumerate(part, 1)) for name, (part, _) in files.items() if part} | {"w": list(enumerate(rows[:7], 1))}
    assert {name: sorted(found, key=lambda x: x[0]) for name, found in got.items()} == want
    schema = T.StructType([T.StructField("id", T.StringType())])
    assert rows_of(datasets.read_json_dataset(spark, str(tmp_path / "a.json"), schema), "n", "id") == [(k, r["id"]) for k, r in enumerate(rows, 1)]


def test_one_line_arrays_are_read_by_many_tasks(spark, tmp_path, small_blocks):
    """One file without a line end: tasks share it, and only objects on the edges of blocks are shuffled."""
    path = put(tmp_path, "a.json", json.dumps([{"id": k, "text": "x" * 90} for k in range(3_000)]))
    small_blocks("20000")
    df = json_ranges.read_json_objects(spark, path)
    files = spark.read.option("lineSep", "}").text(path)
    tasks = files.rdd.getNumPartitions()
    assert tasks > 10
    assert df.count() == 3_000
    shape = "source string, n long, block long, object binary"
    raw = files.selectExpr("_metadata.file_path AS source", "_metadata.file_block_start AS block", "cast(value AS binary) AS value")
    states = json_ranges.block_states(raw.mapInArrow(json_ranges._summaries, json_ranges._SUMMARY))
    parts = raw.join(F.broadcast(states), ["source", "block"]).mapInArrow(json_ranges._cut(True), shape)
    assert 0 < parts.count() <= 2 * tasks


BROKEN = [
    " ", "{}", '{"id": 1}', "null", '"[{}]"', "[", "[{}", "[{},", '[{"a": 1}, {"b": 2}', "[{}]]", "[{}] [{}]", "[{}] x", "x [{}]", "[{} {}]", "[{},]", "[,{}]", "[{},,{}]",
    "[1, {}]", "[{}, 2]", '["a"]', "[null]", "[[{}]]", '[{"a": "x}]', '[{"a": [1}]', '[{"a": 1]]', "[{}}", "[{]}]", '[{"a"}]', "[{a: }]", '[{"a": 1} "b"]', "]", "}{",
]


@pytest.mark.parametrize(("size", "every"), [("3", 1), ("10000000", 5)])
def test_broken_arrays_are_errors(spark, tmp_path, small_blocks, size, every):
    small_blocks(size)
    schema = T.StructType([T.StructField("id", T.StringType())])
    passed = []
    for k, text in enumerate(BROKEN[::every]):
        path = put(tmp_path, f"{k}/x.json", text)
        try:
            datasets.read_json_dataset(spark, path, schema).collect()
            passed.append(text)
        except Exception as error:
            assert "must be an array" in str(error) or "broken JSON" in str(error), (text, str(error)[:300])
    assert passed == []


def test_corpus(spark, tmp_path):
    put(tmp_path, "shop/oven.md", "the oven bakes bread")
    put(tmp_path, "shop/deep/boat.TXT", "the boat sails")
    put(tmp_path, "node_modules/x.md", "skip")
    put(tmp_path, "deep/archive/x.md", "skip")
    put(tmp_path, "photo.png", "skip")
    put(tmp_path, "plain", "skip")
    docs = corpus.read_corpus(spark, str(tmp_path))
    assert rows_of(docs, "doc") == [("shop/deep/boat.TXT",), ("shop/oven.md",)]
    queries = spark.createDataFrame([("q", "boat")], "query string, text string")
    assert rows_of(bm25_topk(build_index(docs), queries), "doc") == [("shop/deep/boat.TXT",)]


def test_eval_suite_and_baseline(spark, tmp_path):
    checks = [{"name": "short", "kind": "maxLines", "value": 2}, {"kind": "regex", "value": "^ok", "flags": "i"}]
    cases = put(tmp_path, "cases.json", json.dumps({"cases": [{"id": "c1", "checks": checks}]}))
    answers = put(tmp_path, "answers.json", json.dumps({"answers": [{"case": "c1", "run": i, "text": t} for i, t in enumerate(["OK", "no", "ok\na\nb"])]}))
    case_df, answer_df = corpus.read_eval_suite(spark, cases, answers)
    gate = pass_gate(score_answers(answer_df, case_df))
    assert rows_of(gate, "n", "pass", "gate") == [(3, 1, "FAIL")]
    sinks.save_baseline(gate, str(tmp_path / "base"))
    assert rows_of(spark.read.parquet(str(tmp_path / "base")), "suite", "n", "pass") == [("", 3, 1)]


def test_judge_replies(spark, tmp_path):
    body = "# x\n## Result\nnoise <task_result>\n VERDICT: PASS\nnode x\n</task_result> tail"
    for i, (name, text) in enumerate([("2-judge-a.md", body), ("1-judge.md", body), ("3-judge.md", "## Result\nnone"), ("notes.md", body), ("x1-judge.md", body)]):
        os.utime(put(tmp_path, name, text), (1_900_000_000 + i, 1_900_000_000 + i))
    got = corpus.read_judge_replies(spark, str(tmp_path)).orderBy("modified", "reply").collect()
    assert [(r["reply"], r["text"]) for r in got] == [("2-judge-a.md", "VERDICT: PASS\nnode x"), ("1-judge.md", "VERDICT: PASS\nnode x")]


def test_known_ids(spark, tmp_path):
    array = put(tmp_path, "a.json", '["bt-1", "bt-2"]')
    keys = put(tmp_path, "b.json", '{"bt-3": {"x": 1}}')
    broken = put(tmp_path, "c.json", "nope")
    assert rows_of(corpus.read_known(spark, array), "id") == [("bt-1",), ("bt-2",)]
    assert rows_of(corpus.read_known(spark, keys), "id") == [("bt-3",)]
    assert corpus.read_known(spark, broken).count() == 0
    sinks.save_known(corpus.read_known(spark, array), str(tmp_path / "known"))
    assert spark.read.parquet(str(tmp_path / "known")).count() == 2


def test_findings_are_written_as_json(spark, tmp_path):
    df = datasets.read_dataset(spark, put(tmp_path, "in/data.csv", CSV))
    sinks.write_findings(union_findings([cl.missing_field(df)]), str(tmp_path / "found"))
    assert spark.read.json(str(tmp_path / "found")).count() == 1


def test_csv_headers_with_blanks_and_other_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,first name\n1,Ann\n2\n")
    got = datasets.read_csv_dataset(spark, str(tmp_path)).orderBy("n").collect()
    assert [(r["id"], r["first name"]) for r in got] == [("1", "Ann"), ("2", "")]
    (tmp_path / "b.csv").write_text("first name,id\nBob,3\n")
    with pytest.raises(Exception, match="another header"):
        datasets.read_csv_dataset(spark, str(tmp_path)).collect()


def test_broken_json_lines_are_an_error(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1"}\n{"id": \n')
    with pytest.raises(Exception, match="broken JSON in row 2"):
        datasets.read_jsonl_dataset(spark, str(tmp_path)).collect()


def test_utf16_logs_are_an_error(spark, tmp_path):
    (tmp_path / "a.log").write_bytes("one\ntwo".encode("utf-16"))
    with pytest.raises(Exception, match="not UTF-8"):
        read_numbered_lines(spark, str(tmp_path)).collect()


def test_clean_rows_are_written_in_order(spark, tmp_path):
    rows = [("s", n, f"r{n}") for n in range(200)]
    df = spark.createDataFrame(rows[::-1], "source string, n long, id string").repartition(7)
    sinks.write_clean(df, str(tmp_path / "out"), "csv")
    parts = sorted((tmp_path / "out").glob("part-*.csv"))
    assert [x for p in parts for x in p.read_text().split()[1:]] == [r[2] for r in rows]


def test_corpus_takes_large_files_and_odd_folders(spark, tmp_path):
    root = tmp_path / "docs"
    (root / "docs").mkdir(parents=True)
    (root / "docs" / "big.txt").write_text("x" * 400_000)
    got = corpus.read_corpus(spark, str(root)).collect()
    assert [(r["doc"], len(r["text"])) for r in got] == [("docs/big.txt", 400_000)]
    assert [(r["doc"], r["text"]) for r in corpus.read_corpus(spark, str(root), max_bytes=10).collect()] == [("docs/big.txt", None)]


def test_campaign_files_must_be_json(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "campaign.json").write_text('{"utm_source": "a"} junk')
    got = read_campaigns(spark, str(tmp_path))
    assert got.campaigns.first()["fields"] is None and got.sales.collect() == []


def test_checkpoints_need_a_shared_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from sievelight.plans import session

    def fake(master):
        made = []
        conf = SimpleNamespace(get=lambda *_: None)
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, getConf=lambda: conf, setCheckpointDir=made.append)
        return SimpleNamespace(sparkContext=context, conf=conf), made

    local, made = fake("local[2]")
    assert session.ensure_checkpoint_dir(local) == made[0]
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="share"):
            session.ensure_checkpoint_dir(fake(master)[0])
