"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation says how far to trust each."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.llm.hashing import ngram_hashes, slices, utf8, word_lists
from sievelight.plans.session import stored

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
COUNTS = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_upper n_lower n_bars".split()
SCHEMA = "doc_key long, " + ", ".join(f"{c} long" for c in COUNTS)


def repeated_words(grams: np.ndarray, window: int) -> int:
    """Words in windows whose value occurs twice or more, the first occurrence included."""
    ordered = np.sort(grams)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(grams, twice))
    edges = np.zeros(len(grams) + window, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(edges)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        texts = utf8(batch.column("text"))
        words, offsets = word_lists(texts, lower=False)
        grams = ngram_hashes(words, WINDOW)
        rows = []
        for text, start, end in zip(texts, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            by_byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
            blanks = int(by_byte[9:14].sum() + by_byte[32])
            lines = [x for x in text.split(b"\n") if x.split(None, 1)]
            rows.append((
                end - start,
                int(by_byte[:128].sum() + by_byte[192:].sum()) - blanks,
                int(by_byte[list(SYMBOLS)].sum()),
                len(lines) - len(set(lines)),
                repeated_words(grams[start : end - WINDOW + 1], WINDOW) if end - start > WINDOW else 0,
                len(lines),
                int(by_byte[65:91].sum()),
                int(by_byte[97:123].sum()),
                int(by_byte[124]),
            ))
        columns = np.array(rows, np.int64).reshape(-1, len(COUNTS)).T
        yield pa.RecordBatch.from_arrays([batch.column("doc_key"), *map(pa.array, columns)], ["doc_key", *COUNTS])


def text_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_key` and the counts of every whole text; a null text counts as empty. One row per row of `docs`."""
    return docs.select(F.col(key).cast("long").alias("doc_key"), F.col(text).alias("text")).mapInArrow(_count, SCHEMA)


def _vote(good: Column, bad: Column) -> Column:
    """1 for good, -1 for bad, 0 where the rule has no opinion."""
    return F.when(good, 1).when(bad, -1).otherwise(0)


def default_rules() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    mean, symbols, bars = F.col("word_chars") / words, (F.col("n_symbols") - F.col("n_bars")) / words, F.col("n_bars") / words
    again, same = F.col("n_repeat_words") / words, F.col("n_dup_lines") / lines
    shout = F.col("n_upper") / F.greatest(F.col("n_upper") + F.col("n_lower"), F.lit(1))
    return {
        "length": _vote(F.col("n_words") >= 60, F.col("n_words") < 20),
        "word_length": _vote((mean >= 3) & (mean <= 9), (mean < 2) | (mean > 12)),
        "symbols": _vote(symbols < 0.05, symbols > 0.25),
        "repeats": _vote(again < 0.3, again > 0.5),
        "lines": _vote(same < 0.4, same > 0.6),
        "capitals": _vote(shout < 0.2, shout > 0.5),
        "tables": _vote(bars < 0.02, bars > 0.2),
    }


#: How a rule that knows nothing yet is taken to vote (bad, abstain, good) on good and on bad texts.
ASSUMED = np.array([[0.005, 0.055, 0.94], [0.25, 0.05, 0.70]])


def fit_label_model(votes: np.ndarray, counts: np.ndarray, rounds: int = 100, share: float = 0.8, weight: float = 0.2, alarm: float = 0.003) -> np.ndarray:
    """Posterior probability of good for each vote pattern, by expectation-maximisation over all patterns' counts.

    votes: patterns x rules of 1, -1 and 0. Given the class, rules vote on their own. A rule's accuracy is a table: how
    often it votes bad, abstains and votes good on texts of either class. It starts from ASSUMED, which stays in with a
    `weight` in proportion to all texts; that keeps the classes from changing places and is the same at every size.
    Rules of default quality filters are written not to hit good texts, so at most `alarm` of those draw a bad vote;
    without that bound a fault that comes alone would pass as one more kind of good text.
    """
    if not len(votes):
        return np.empty(0)
    cast = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    held = weight * counts.sum() * ASSUMED[:, None, :]
    tables, shares = np.repeat(ASSUMED[:, None, :], votes.shape[1], axis=1), np.array([share, 1 - share])
    for _ in range(rounds):
        logs = np.log(shares) + np.einsum("prv,crv->pc", cast, np.log(tables))
        posterior = np.exp(logs - np.logaddexp(logs[:, :1], logs[:, 1:]))
        weighed = counts[:, None] * posterior
        tables = np.einsum("pc,prv->crv", weighed, cast) + held
        tables = tables / tables.sum(axis=2, keepdims=True)
        tables[0, :, 0] = np.minimum(tables[0, :, 0], alarm)
        shares = weighed.sum(axis=0) / counts.sum() + weight * np.array([share, 1 - share])
        shares = shares / shares.sum()
    return posterior[:, 0]


def quality_posteriors(counts: DataFrame, rules: Mapping[str, Column] | None = None, rounds: int = 100) -> DataFrame:
    """`counts` with the vote of each rule (`vote_<name>`) and `p_good`, the posterior probability of good quality.

    What reaches the driver is a count per pattern of votes, at most 3 to the number of rules; all rows are counted.
    """
    rules = dict(rules or default_rules())
    names = [f"vote_{r}" for r in rules]
    voted = counts.withColumns({f"vote_{r}": v.cast("int") for r, v in rules.items()})
    rows = voted.groupBy(*names).agg(F.count("*").alias("rows_")).orderBy(*names).collect()
    votes = np.array([r[:-1] for r in rows], int).reshape(-1, len(names))
    posterior = fit_label_model(votes, np.array([r[-1] for r in rows], float), rounds)
    patterns = counts.sparkSession.createDataFrame(
        [(*map(int, v), float(p)) for v, p in zip(votes, posterior, strict=True)], ", ".join(f"{n} int" for n in names) + ", p_good double"
    )
    return voted.join(F.broadcast(patterns), names)


def quality_verdicts(
    docs: DataFrame, rules: Mapping[str, Column] | None = None, bound: float = 0.5, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: `doc_id`, the counts, votes, `p_good`, `base_failed` and `kept`.

    base_failed: under 20 words, or over 30 of 100 words in windows of eight that repeat. kept: not base_failed, and
    the posterior reaches `bound`. A null or empty text has no words and fails. Repeated rows are judged each.
    """
    counts = stored(text_counts(docs, key, text))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        quality_posteriors(counts, rules)
        .withColumnRenamed("doc_key", "doc_id")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("p_good") >= bound))
    )
