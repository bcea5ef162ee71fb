"""Small builders shared by the tests."""

from datetime import datetime, timedelta, timezone

START = datetime(2031, 3, 9, 8, 0, tzinfo=timezone.utc)


def stamp(seconds):
    at = START + timedelta(milliseconds=round(seconds * 1000))
    return at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"


def text_frame(spark, texts):
    """`source, text` from a dict or a single text."""
    rows = list(texts.items()) if isinstance(texts, dict) else [("log", texts)]
    return spark.createDataFrame(rows, "source string, text string")


def kinds_at(findings):
    """{kind: sorted rows} of a findings table."""
    out = {}
    for r in findings.collect():
        out.setdefault(r["kind"], []).append(r["row"])
    return {k: sorted(v, key=lambda x: (x is None, x)) for k, v in out.items()}


def in_order(rows):
    """Sorted rows, missing values last."""
    return sorted(rows, key=lambda row: [(x is None, 0 if x is None else x) for x in row])


def rows_of(df, *columns):
    return in_order(tuple(r[c] for c in columns) for r in df.collect())


def details(findings):
    return " | ".join(r["detail"] for r in findings.collect())
