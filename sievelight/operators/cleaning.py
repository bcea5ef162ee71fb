"""Dataset constraints and duplicates: rows are `source, n` plus data columns, `n` being the row order.

A `fields` map column, where present, keeps which keys a row really had; otherwise all data columns count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelight.functions.compat import number, regex, trim
from sievelight.functions.text import filled, norm_text
from sievelight.operators.findings import as_findings, from_hits, hit, hits, text, union_findings
from sievelight.plans.session import stored
from sievelight.plans.skew import attach_group_first
from sievelight.plans.spread import explode_once

# Default rules.
REQUIRED = ("id", "name", "email")
EMAIL_SHAPE = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
AGE_RANGE = (0, 120)
PAY_FIELDS = ("pay.min", "pay.max")
NEAR_KEY_FIELDS = {"ct": '"company"+"title"', "em": '"email"', "nm": '"name"'}

ORDER_COLUMNS = ("source", "n", "fields")


def column(df: DataFrame, name: str) -> Column:
    """A data column, NULL where the dataset does not have it."""
    return F.col(name) if name.split(".")[0] in df.columns else F.lit(None).cast("string")


def _missing_checks(df: DataFrame, required: Sequence[str]) -> list:
    row = F.col("n")
    return [
        (
            ~filled(column(df, f).cast("string")),
            hit("missing-field", text("row ", row, f' is missing field "{f}"'), row, F.lit(f)),
        )
        for f in required
    ]


def _email_checks(df: DataFrame, name: str) -> list:
    value, row = column(df, name).cast("string"), F.col("n")
    wrong = filled(value) & ~trim(value).rlike(regex(EMAIL_SHAPE))
    return [(wrong, hit("bad-email", text("row ", row, f' has a bad email in field "{name}"'), row, F.lit(name)))]


def _range_checks(df: DataFrame, name: str, lo: float | None, hi: float | None) -> list:
    value, row = column(df, name).cast("string"), F.col("n")
    wrong = filled(value) & _outside(value, lo, hi)
    return [(wrong, hit("out-of-range", text("row ", row, f' has field "{name}" outside its range'), row, F.lit(name)))]


def _nested_checks(df: DataFrame, fields: Sequence[str], lo: float) -> list:
    checks, row = [], F.col("n")
    for name in fields:
        value = column(df, name).cast("string")
        found = hit("out-of-range", text("row ", row, f' has field "{name}" outside range'), row, F.lit(name))
        checks.append((value.isNotNull() & _outside(value, lo, None), found))
    return checks


def missing_field(df: DataFrame, required: Sequence[str] = REQUIRED) -> DataFrame:
    """One finding per empty required field of a row."""
    return from_hits(df, hits(*_missing_checks(df, required)))


def bad_email(df: DataFrame, column_name: str = "email") -> DataFrame:
    return from_hits(df, hits(*_email_checks(df, column_name)))


def _outside(value: Column, lo: float | None, hi: float | None) -> Column:
    """Not a finite number, or beyond a limit."""
    parsed = number(value)
    beyond = parsed.isNull()
    if lo is not None:
        beyond = beyond | (parsed < lo)
    if hi is not None:
        beyond = beyond | (parsed > hi)
    return F.coalesce(beyond | (F.abs(parsed) == float("inf")) | F.isnan(parsed), F.lit(True))


def out_of_range(
    df: DataFrame, column_name: str = "age", lo: float | None = AGE_RANGE[0], hi: float | None = AGE_RANGE[1]
) -> DataFrame:
    return from_hits(df, hits(*_range_checks(df, column_name, lo, hi)))


def nested_out_of_range(df: DataFrame, fields: Sequence[str] = PAY_FIELDS, lo: float = 0) -> DataFrame:
    """The same for fields inside a struct; absent ones pass."""
    return from_hits(df, hits(*_nested_checks(df, fields, lo)))


def _key_hash(*parts: Column) -> Column:
    """Never NULL, and typed so: joins then add no null test that would compute the key a second time."""
    body = F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)]))
    return F.coalesce(F.unhex(F.sha2(body, 256)), F.lit(b""))


def exact_key(df: DataFrame, order: str = "n") -> Column:
    """Digest of the row's source and its sorted (name, normalised value) pairs, the order column excepted."""
    if "fields" in df.columns:
        pairs = F.array_sort(F.map_entries("fields"))
        return _key_hash(F.col("source"), F.transform(pairs, lambda p: F.array(p["key"], norm_text(p["value"]))))
    cells = []
    for field in sorted(df.schema.fields, key=lambda f: f.name):
        if field.name not in (*ORDER_COLUMNS, order):
            nested = isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType))
            cells.append(norm_text(F.to_json(field.name) if nested else F.col(field.name)))
    return _key_hash(F.col("source"), F.array(*cells))


def near_keys(df: DataFrame, keep_all_scripts: bool = False) -> Column:
    """Tagged keys of a row in order of preference: company and title, then email, or name without an email."""

    def norm(name: str) -> Column:
        return norm_text(column(df, name), keep_all_scripts)

    def tagged(tag: str, key: Column) -> Column:
        return F.struct(F.lit(tag).alias("tag"), key.alias("key"))

    company, title, email, name = (filled(column(df, c)) for c in ("company", "title", "email", "name"))
    keys = F.array(
        F.when(company & title, tagged("ct", F.concat(norm("company"), F.lit("|"), norm("title")))),
        F.when(email, tagged("em", norm("email"))).when(name, tagged("nm", norm("name"))),
    )
    return F.filter(keys, lambda k: k.isNotNull())


def exact_dupe(df: DataFrame, order: str = "n") -> DataFrame:
    """Later rows equal to an earlier row of their source; the finding refers to the first one."""
    return _exact_of(df.select("source", F.col(order).alias("n"), exact_key(df, order).alias("key")))


def _exact_of(keyed: DataFrame) -> DataFrame:
    """Findings of `source, n, key`."""
    later = attach_group_first(keyed, "key").filter(F.col("first_n") < F.col("n"))
    return as_findings(
        later,
        "exact-dupe",
        text("row ", F.col("n"), " is an exact dupe of row ", F.col("first_n")),
        F.col("n"),
        F.col("first_n"),
    )


def near_dupe(df: DataFrame, keys: Column | None = None, order: str = "n") -> DataFrame:
    """Rows that are no exact dupes but share a near key with an earlier such row, once per row.

    `keys` is an array of struct(tag, key) in order of preference; the tag is what the finding names. Rows that are near dupes themselves still
    lend their other keys, so the lowest row per key among the non-exact rows is the one referred to.
    """
    return _near_of(_keyed(df, keys, order))


def _keyed(df: DataFrame, keys: Column | None = None, order: str = "n") -> DataFrame:
    """`source, n, key, keys`: the exact key and the near keys of every row."""
    near = near_keys(df) if keys is None else keys
    return df.select("source", F.col(order).alias("n"), exact_key(df, order).alias("key"), near.alias("keys"))


def _near_of(keyed: DataFrame) -> DataFrame:
    """Findings of `source, n, key, keys`."""
    # The lowest row per exact key is what survives the exact check; row numbers are unique, so no key is hot here.
    kept = keyed.groupBy("source", "key").agg(F.min("n").alias("n")).select("source", "n")
    tagged = (
        keyed.select("source", "n", "keys")
        .join(kept, ["source", "n"], "left_semi")
        .transform(lambda rows: explode_once(rows, F.col("keys"), "tagged", "source", "n", position="position"))
        .withColumn("tag", F.col("tagged.tag"))
        .withColumn("key", _key_hash(F.col("source"), F.col("tagged.tag"), F.col("tagged.key")))
        .drop("tagged")
    )
    shared = attach_group_first(tagged, "key").filter(F.col("first_n") < F.col("n"))
    once = shared.groupBy("source", "n").agg(F.min(F.struct("position", "first_n", "tag")).alias("hit"))
    fields = F.col("hit.tag")
    for tag, name in NEAR_KEY_FIELDS.items():
        fields = F.when(F.col("hit.tag") == tag, name).otherwise(fields)
    return as_findings(
        once,
        "near-dupe",
        text("row ", F.col("n"), " is a near-dupe of row ", F.col("hit.first_n"), " (same ", fields, ")"),
        F.col("n"),
        F.col("hit.first_n"),
    )


def dataset_findings(
    df: DataFrame,
    required: Sequence[str] = REQUIRED,
    check_email: bool = True,
    check_age: bool = True,
    check_pay: bool = False,
    age_range: tuple[float | None, float | None] = AGE_RANGE,
    pay_fields: Sequence[str] = PAY_FIELDS,
) -> DataFrame:
    """All checks, those within a row in one scan. Details name row numbers and fields, never values."""
    checks = _missing_checks(df, required)
    if check_email:
        checks += _email_checks(df, "email")
    if check_age:
        checks += _range_checks(df, "age", *age_range)
    if check_pay:
        checks += _nested_checks(df, pay_fields, 0)
    # Keys of both sorts are made in one pass and kept, since both searches for duplicates read them more than once.
    keyed = stored(_keyed(df))
    return union_findings([from_hits(df, hits(*checks)), _exact_of(keyed.drop("keys")), _near_of(keyed)])


def clean_rows(df: DataFrame, findings: DataFrame, keep_near: bool = False) -> DataFrame:
    """Rows without any finding; `keep_near` lets near dupes stay."""
    if keep_near:
        findings = findings.filter(F.col("kind") != "near-dupe")
    bad = findings.select("source", F.col("row").alias("n")).distinct()
    return df.join(bad, ["source", "n"], "left_anti")
