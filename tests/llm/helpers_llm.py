"""Small hostile tables: nulls, empty and very long texts, ties, repeated rows, extra columns with clashing names."""

import random

from pyspark.sql import functions as F

WORDS = "ash bay cod dew elm fig gum hay ivy jam kit log map nut oak pea rye sea tin urn vow wax yew zip".split()
CLASHING = ("doc", "size", "h", "pos", "comp", "text_", "score", "ids", "word", "n", "host", "html_", "start", "ranges", "runs", "class", "count")


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(words))


def documents(spark, rows):
    """A documents table of (doc_id, text) with every other column null and columns of clashing names."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("lang", "source", *CLASHING):
        df = df.withColumn(name, F.lit(None).cast("string"))
    return df.withColumn("n_chars", F.length("text").cast("long"))


def hostile_rows():
    base = prose(1, 60).split()
    edited = [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in (5, 30, 55)]
    far = [" ".join("other" + str(k) if i % 4 == 0 else w for i, w in enumerate(base)) for k in range(2)]
    texts = [" ".join(base), *edited, *far, " ".join(base), " ".join(base).upper(), None, "", " \n\t ", "one", "one", "one two three four"]
    texts += ["x" * 5_000, "ab " * 3_000, prose(2, 4_000), prose(3, 20), prose(3, 21), "é ß ñ " * 30, "a b c d e", "a b c d e f"]
    return [(k * 3 + 1, t) for k, t in enumerate(texts)]
