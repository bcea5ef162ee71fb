import random

import pytest
from helpers import details, kinds_at, rows_of
from pyspark.sql import functions as F

from sievelight.operators import cleaning as cl

COLUMNS = ["id", "name", "email", "age"]
PLANTED = [
    ("1", "Ines Roy", "ines@mail.test", "31"),
    ("1", "ines  ROY", "ines@mail.test", "31"),
    ("3", "Ines R.", "INES@mail.test", "31"),
    ("4", " ", "otto@mail.test", "44"),
    ("5", "Uma Lind", "uma-at-mail", "29"),
    ("6", "Max Berg", "max@mail.test", "400"),
    ("7", "Lea Holm", "lea@mail.test", "120"),
]


def dataset(spark, rows, columns=COLUMNS, source="d"):
    shape = "source string, n long, " + ", ".join(f"{c} string" for c in columns)
    return spark.createDataFrame([(source, i, *r) for i, r in enumerate(rows, 1)], shape)


def test_planted_rows(spark):
    df = dataset(spark, PLANTED)
    found = cl.dataset_findings(df)
    assert kinds_at(found) == {
        "exact-dupe": [2],
        "near-dupe": [3],
        "missing-field": [4],
        "bad-email": [5],
        "out-of-range": [6],
    }
    text = details(found)
    assert "Ines" not in text and "@" not in text
    assert rows_of(cl.clean_rows(df, found), "n") == [(1,), (7,)]
    assert rows_of(cl.clean_rows(df, found, keep_near=True), "n") == [(1,), (3,), (7,)]


def test_clean_rows_are_silent(spark):
    rows = [("1", "A", "a@mail.test", "0"), ("2", "B", "b@mail.test", "120"), ("3", "C", "c@mail.test", "")]
    assert cl.dataset_findings(dataset(spark, rows)).count() == 0


def test_age_edges(spark):
    rows = [(str(i), f"N{i}", f"n{i}@mail.test", a) for i, a in enumerate(["0", "120", "121", "-1", "x", "0x10", "12d"])]
    assert kinds_at(cl.out_of_range(dataset(spark, rows))) == {"out-of-range": [3, 4, 5, 7]}


def test_absent_column_is_missing_in_every_row(spark):
    df = dataset(spark, [("1", "A"), ("2", "B")], ["id", "name"])
    assert kinds_at(cl.missing_field(df)) == {"missing-field": [1, 2]}


def test_nested_limits(spark):
    shape = "source string, n long, id string, pay struct<min: double, max: double>"
    rows = [("d", 1, "1", (1.0, 2.0)), ("d", 2, "2", (-1.0, None)), ("d", 3, "3", None), ("d", 4, "4", (-5.0, -6.0))]
    found = cl.nested_out_of_range(spark.createDataFrame(rows, shape))
    assert rows_of(found, "row", "key") == [(2, "pay.min"), (4, "pay.max"), (4, "pay.min")]


def test_near_dupe_prefers_company_and_title(spark):
    columns = ["id", "company", "title", "email", "name"]
    rows = [
        ("1", "Acorn", "Baker", "a@mail.test", "A"),
        ("2", "Birch", "Cook", "b@mail.test", "B"),
        ("3", "ACORN", "baker!", "b@mail.test", "C"),
        ("4", "Cedar", "Smith", "", "D"),
        ("5", "Cedar", "Other", "", "d"),
    ]
    found = cl.near_dupe(dataset(spark, rows, columns))
    assert rows_of(found, "row", "key") == [(3, "1"), (5, "4")]
    assert "company" in found.filter("row = 3").first()["detail"]


def test_map_rows_tell_absent_from_empty(spark):
    shape = "source string, n long, fields map<string,string>"
    rows = [("d", 1, {"a": "1", "b": ""}), ("d", 2, {"a": "1"}), ("d", 3, {"b": "", "a": "1"})]
    assert kinds_at(cl.exact_dupe(spark.createDataFrame(rows, shape))) == {"exact-dupe": [3]}


@pytest.mark.parametrize("partitions", [1, 4, 32])
def test_duplicates_equal_brute_force_with_a_hot_key(spark, partitions):
    rng = random.Random(11)
    rows = [("x", "y") if rng.random() < 0.4 else (str(rng.randrange(60)), str(rng.randrange(4))) for _ in range(400)]
    data = [(s, n, *r) for s in ("p", "q") for n, r in enumerate(rows, 1)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "source string, n long, name string, title string").repartition(partitions)
    first, near_first, exact, near = {}, {}, [], []
    for n, r in enumerate(rows, 1):
        if r in first:
            exact.append((n, str(first[r])))
            continue
        first[r] = n
        if r[0] in near_first:
            near.append((n, str(near_first[r[0]])))
        near_first.setdefault(r[0], n)
    assert rows_of(cl.exact_dupe(df), "source", "row", "key") == sorted((s, *e) for s in "pq" for e in exact)
    assert rows_of(cl.near_dupe(df), "source", "row", "key") == sorted((s, *e) for s in "pq" for e in near)


def test_duplicates_by_another_order_column(spark):
    rows = [("s", 3, "a", "x"), ("s", 1, "a", "x"), ("s", 2, "b", "y")]
    df = spark.createDataFrame(rows, "source string, seq long, id string, email string")
    assert [(r["row"], r["key"]) for r in cl.exact_dupe(df, order="seq").collect()] == [(3, "1")]
    assert cl.near_dupe(df, order="seq").collect() == []
    keys = F.array(F.struct(F.lit("any tag").alias("tag"), F.lit("k").alias("key")))
    got = cl.near_dupe(df, keys, order="seq").collect()
    assert [(r["row"], "any tag" in r["detail"]) for r in got] == [(2, True)]
