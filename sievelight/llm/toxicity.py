"""Toxicity by multiple-instance learning: documents carry labels, sentences carry scores, noisy-or joins the two."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm.hashing import slices

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")

#: Labelled documents that a model is fitted on, at most, and words that it gives weights to, at most.
SAMPLE_DOCS = 12_000
VOCABULARY = 2_000

#: What a sentence's words must add to the bias for it to count by itself.
EVIDENCE = 0.5

#: Sentences without evidence that count, at most; a fitted bias is so low that all of them together score below 0.2.
PLAIN = 32
HIGHEST_BIAS = float(np.log(0.2 / PLAIN))


@dataclass
class ToxicityModel:
    """Weights of words in a sentence, and the bias of a sentence."""

    bias: float = -9.0
    weights: dict[str, float] = field(default_factory=dict)


def sentences(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """Start, end and lower-cased words of each sentence that has words."""
    for m in SENTENCE.finditer(text):
        if words := WORD.findall(m.group().lower()):
            yield m.start(), m.end(), words


def score_text(text: str | None, model: ToxicityModel, offending: float = 0.5) -> tuple[float, list[tuple[int, int, float]]]:
    """Noisy-or over the sentences, and those whose own score reaches `offending` as (start, end, score).

    A sentence whose words add less than EVIDENCE to the bias counts as one without known words, and of those PLAIN count
    at most, however many there are: a text isn't toxic for being long.
    """
    weights, known = model.weights, model.weights.keys()
    clean, found, plain = 0.0, [], 0
    for start, end, words in sentences(text or ""):
        if known.isdisjoint(words) or (said := sum(weights[w] for w in sorted(known & set(words)))) < EVIDENCE:
            plain += 1
            continue
        p = 1 / (1 + np.exp(-min(max(model.bias + said, -30.0), 30.0)))
        clean += np.log1p(-p)
        if p >= offending:
            found.append((start, end, float(p)))
    clean += min(plain, PLAIN) * np.log1p(-1 / (1 + np.exp(-model.bias)))
    return float(-np.expm1(clean)), found


def toxicity_scores(
    docs: DataFrame, model: ToxicityModel, keep: Sequence[str] = ("doc_id",), text: str = "text", offending: float = 0.5
) -> DataFrame:
    """The columns `keep` of every row, `score` and `offending` (start, end, score of each offending sentence, in code points).

    Whole texts are scored. A null text, or one without words, scores 0 and has no offending sentence. Rows keep their
    repeats; columns of `docs` that are not named in `keep` do no harm, whatever their names. A text that is kept goes to
    the tasks' Python once, not as a column to score besides.
    """
    scored = text if text in keep else "_text"
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, scored):
            made = [score_text(t, model, offending) for t in batch.column(scored).to_pylist()]
            found = [[{"start": a, "end": b, "score": p} for a, b, p in x] for _, x in made]
            added = [pa.array([s for s, _ in made], pa.float64()), pa.array(found, spans)]
            yield pa.RecordBatch.from_arrays(batch.columns[: len(keep)] + added, [*keep, "score", "offending"])

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    schema += ", score double, offending array<struct<start:int,end:int,score:double>>"
    sent = docs.select(*keep) if text in keep else docs.select(*keep, F.col(text).alias(scored))
    return sent.mapInArrow(run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_DOCS) -> DataFrame:
    """`text, toxic` of at most `limit` labelled documents, chosen by a hash of the id; equal texts once, with their mean label."""
    chosen = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "toxic")
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(limit)
    met = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    return met.groupBy("text").agg(F.avg("toxic").alias("toxic"))


def _sample_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            words = sorted({w for _, _, ws in sentences(text) for w in ws})
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([toxic] * len(words), pa.float64())], ["word", "toxic"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS, vocabulary: int = VOCABULARY, least: int = 5) -> ToxicityModel:
    """A model from the labels of whole documents.

    The sample is at most `sample` documents. Spark counts its words and keeps the `vocabulary` words that toxic and
    other documents tell apart best; the driver gets those words' places in sentences only, and fits word weights so
    that the noisy-or of a document's sentences meets its label. Without labels of both kinds the model scores all low.
    """
    taught = labelled_sample(docs, labels, sample)
    totals = taught.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0.0))).first()
    total, toxic = float(totals[0]), float(totals[1])
    if not 0 < toxic < total:
        return ToxicityModel()
    words = taught.mapInArrow(_sample_words, "word string, toxic double").groupBy("word")
    rate = toxic / total
    words = words.agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).filter(F.col("n") >= least)
    expected = F.col("n") * rate
    told = (F.col("bad") - expected) / F.sqrt(expected * (1 - rate) * (1 - F.col("n") / (total + 1)))
    best = words.withColumn("told", told).filter("abs(told) >= 3").orderBy(F.abs("told").desc(), "word").limit(vocabulary).collect()
    index = {r["word"]: k for k, r in enumerate(best)}

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                bags = [sorted({index[w] for w in ws if w in index}) for _, _, ws in sentences(text)]
                rows.append((label, sum(not b for b in bags), [b for b in bags if b]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.list_(pa.int32())))],
                ["toxic", "plain", "bags"],
            )

    rows = taught.mapInArrow(places, "toxic double, plain long, bags array<array<int>>").collect()
    weights, bias = _fit([(r[0], r[1], r[2]) for r in rows], len(index), np.array([r["told"] for r in best]))
    return ToxicityModel(bias, {w: float(weights[k]) for w, k in index.items() if abs(weights[k]) > 0.05})


def _fit(rows: list, size: int, told: np.ndarray, steps: int = 400, rate: float = 0.1, ridge: float = 0.02) -> tuple[np.ndarray, float]:
    """Word weights and bias that lessen the log loss of noisy-or documents, by Adam from the words' own contrast.

    As in scoring, PLAIN of a document's sentences without evidence count at most.
    """
    rows = sorted(rows, key=lambda r: (r[0], r[1], r[2]))
    label, plain = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    bags = [(d, b) for d, r in enumerate(rows) for b in r[2]]
    doc_of = np.array([d for d, _ in bags], int)
    at = np.repeat(np.arange(len(bags)), [len(b) for _, b in bags])
    word = np.array([w for _, b in bags for w in b], int)
    theta = np.concatenate([np.clip(told / 4, -2, 4), [-7.0]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        said = np.bincount(at, theta[word], len(bags))
        z, told_by = said + theta[-1], said >= EVIDENCE
        rest = np.minimum(plain + np.bincount(doc_of[~told_by], minlength=len(rows)), PLAIN)
        p, p0 = 1 / (1 + np.exp(-np.clip(z, -30, 30))), 1 / (1 + np.exp(-theta[-1]))
        clean = np.bincount(doc_of, told_by * np.log1p(-np.minimum(p, 1 - 1e-12)), len(rows)) + rest * np.log1p(-p0)
        toxic = np.clip(-np.expm1(clean), 1e-9, 1)
        pull = (1 - label) - label * (1 - toxic) / toxic
        slope = pull[doc_of] * p * told_by
        grad = np.append(np.bincount(word, slope[at], size), slope.sum() + (pull * rest).sum() * p0) / len(rows)
        grad[:-1] += ridge * theta[:-1] / len(rows)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        theta[-1] = min(theta[-1], HIGHEST_BIAS)
    return theta[:-1], float(theta[-1])
