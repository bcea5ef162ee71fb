"""Quality by Bradley-Terry ranking: preference pairs teach a strength over features, a quantile of all strengths is the bar."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.llm.hashing import slices, utf8
from sievelight.plans.session import stored

#: Labelled documents that preference pairs are made of, at most, and partners that each of them meets.
SAMPLE_DOCS, PARTNERS = 20_000, 8

#: Bins of the distribution of strengths over all documents, and the strengths between which they lie.
BINS, REACH = 20_000, 100.0

#: How far from the mean, in standard deviations, a feature still counts.
WIDEST = 8.0

#: Chance of a document at the bar to win against the reference.
AT_BAR = 0.3

FEATURES = (
    "words", "word_length", "longest_word", "line_length", "sentence_marks", "capitals", "digits", "marks", "top_mark", "not_ascii",
    "words_in_capitals", "marked_words", "distinct_words", "top_word", "repeated_pairs", "repeated_lines", "packed",
)

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_MARK = (_BYTES > 32) & (_BYTES < 127) & ~_DIGIT & ~_UPPER & ~((_BYTES >= 97) & (_BYTES <= 122))
_INSIDE = (_BYTES >= 128) & (_BYTES < 192)
_MARKS = bytes(_BYTES[_MARK].tolist())


def measures(data: bytes) -> list[float]:
    """The features of a whole text; zeros for one without words."""
    words = data.lower().split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    chars = float(seen[~_INSIDE].sum())
    lines = [line for line in data.split(b"\n") if line.strip()]
    often = Counter(words)
    marks = seen[_MARK]
    return [
        np.log1p(n),
        np.log1p(chars / n),
        np.log1p(max(map(len, often))),
        np.log1p(chars / len(lines)),
        seen[[33, 46, 63]].sum() / n,
        seen[_UPPER].sum() / chars,
        seen[_DIGIT].sum() / chars,
        marks.sum() / chars,
        marks.max() / chars,
        (seen[128:].sum() - seen[_INSIDE].sum()) / chars,
        sum(map(bytes.isupper, data.split())) / n,
        sum(k for w, k in often.items() if len(w) - len(w.rstrip(_MARKS)) > 1) / n,
        len(often) / n,
        max(often.values()) / n,
        1 - len(set(zip(words, words[1:], strict=False))) / (n - 1) if n > 1 else 0.0,
        1 - len(set(lines)) / len(lines),
        min(2.0, len(zlib.compress(data, 1)) / len(data)),
    ]


def document_features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` and the FEATURES of every row, of whole texts; a null text has the features of an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            made = np.array([measures(t) for t in utf8(batch.column("_text"))], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, made.T)], [key, *FEATURES])

    schema = f"`{key}` {dict(docs.dtypes)[key]}, " + ", ".join(f"{c} double" for c in FEATURES)
    return docs.select(key, F.col(text).alias("_text")).mapInArrow(run, schema)


@dataclass(frozen=True)
class Ranking:
    """How features make a strength, and the bar: the strength below which the share `rejected` of all documents lies."""

    names: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    weights: tuple[float, ...]
    bar: float | None = None
    rejected: float = 0.0

    def standard(self) -> list[Column]:
        """Features in standard deviations from the mean of all documents."""
        return [
            F.greatest(F.lit(-WIDEST), F.least(F.lit(WIDEST), (F.col(c) - m) / s)).alias(c)
            for c, m, s in zip(self.names, self.means, self.scales, strict=True)
        ]

    def strength(self) -> Column:
        return sum((z * w for z, w in zip(self.standard(), self.weights, strict=True)), F.lit(0.0))

    def bin(self) -> Column:
        """The place of the strength in BINS bins from -REACH to REACH; strengths beyond are in the outer bins."""
        held = F.least(F.lit(REACH), F.greatest(F.lit(-REACH), self.strength()))
        return F.least(F.lit(BINS - 1), F.floor((held + REACH) * (BINS / (2 * REACH)))).cast("int")

    def score(self) -> Column:
        """The chance to win against a reference document, against which one at the bar wins with AT_BAR; 0.5 without a bar."""
        if self.bar is None:
            return F.lit(0.5)
        lead = self.strength() - self.bar + float(np.log(AT_BAR / (1 - AT_BAR)))
        return 1 / (1 + F.exp(-lead))


def standardised(features: DataFrame, names: tuple[str, ...] = FEATURES) -> Ranking:
    """A ranking without weights, with mean and spread of every feature over all rows."""
    got = features.agg(*[F.avg(c) for c in names], *[F.stddev_pop(c) for c in names]).first()
    means, spreads = got[: len(names)], got[len(names) :]
    # The last digits of a distributed sum depend on its order.
    scales = tuple(round(s, 9) if s and s > 1e-6 else 1.0 for s in spreads)
    return Ranking(tuple(names), tuple(round(m or 0.0, 9) for m in means), scales, (0.0,) * len(names))


def label_pairs(labels: DataFrame, key: str = "doc_id", label: str = "label", limit: int = SAMPLE_DOCS, partners: int = PARTNERS) -> DataFrame:
    """`winner, loser`: pairs of keys with label 1 and 0, in proportion to the labelled documents.

    At most `limit` documents take part, chosen by a hash of the key. Each meets `partners` of the other kind, chosen by a
    hash as well. A key labelled both ways, a null key and other labels teach nothing.
    """
    clear = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("id"))
    clear = clear.agg(F.min(label).alias("low"), F.max(label).alias("kind")).filter("low = kind").select("id", "kind")
    chosen = clear.orderBy(F.xxhash64("id"), "id").limit(limit)
    # Numbers within a kind: one short sort, of at most `limit` rows.
    kinds = {k: chosen.filter(F.col("kind") == k).select(F.array_sort(F.collect_list(F.struct(F.xxhash64("id").alias("h"), "id"))).alias("all")) for k in (0, 1)}
    sides = {k: df.select(F.posexplode("all").alias("at", "x"), F.size("all").alias("n")).select("at", "n", F.col("x.id").alias("id")) for k, df in kinds.items()}

    def meet(mine: int) -> DataFrame:
        others = sides[1 - mine].select("at", F.col("id").alias("other"))
        count = F.broadcast(sides[1 - mine].select(F.col("n").alias("others")).limit(1))
        asks = sides[mine].join(count, F.col("others") > 0).select("id", "others", F.explode(F.sequence(F.lit(1), F.lit(partners))).alias("k"))
        asks = asks.select("id", F.pmod(F.xxhash64("id", "k"), F.col("others")).cast("int").alias("at"))
        met = asks.join(others, "at")
        return met.select(F.col("id" if mine else "other").alias("winner"), F.col("other" if mine else "id").alias("loser"))

    return meet(1).unionByName(meet(0)).distinct()


def pair_differences(features: DataFrame, pairs: DataFrame, ranking: Ranking, key: str = "doc_id") -> DataFrame:
    """Standardised features of the winner less those of the loser, one row per pair. Rows of a repeated key count once."""
    names = list(ranking.names)
    involved = pairs.select(F.col("winner").alias(key)).union(pairs.select("loser")).distinct()
    known = features.join(involved, key, "left_semi").groupBy(key).agg(F.min(F.struct(*names)).alias("x"))
    known = known.select(F.col(key).alias("id"), "x.*").select("id", *ranking.standard())
    win, lose = (known.select(F.col("id").alias(side), F.struct(*names).alias(side[0])) for side in ("winner", "loser"))
    return pairs.join(win, "winner").join(lose, "loser").select(*[(F.col(f"w.{c}") - F.col(f"l.{c}")).alias(c) for c in names])


def fit_ranking(differences: DataFrame, ranking: Ranking, ridge: float = 1e-4, rounds: int = 25) -> Ranking:
    """Weights that lessen the logistic loss of the pairs, by Newton's method.

    Each round is one job over the pairs: every partition sums its gradient and curvature, and only those sums, whose
    size is the square of the number of features, reach the driver. `ridge`, per pair, bounds the weights where the
    pairs can be told apart completely. Without pairs the weights are 0.
    """
    names = list(ranking.names)
    size = len(names)
    pairs = stored(differences.select(*names))
    weights = np.zeros(size)

    for _ in range(rounds):
        held = weights.copy()

        def sums(batches: Iterator[pa.RecordBatch], held: np.ndarray = held) -> Iterator[pa.RecordBatch]:
            count, slope, curve = 0, np.zeros(size), np.zeros((size, size))
            for batch in batches:
                x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
                lost = 1 / (1 + np.exp(np.clip(x @ held, -500, 500)))
                count += len(x)
                slope += x.T @ lost
                curve += (x * (lost * (1 - lost))[:, None]).T @ x
            yield pa.RecordBatch.from_arrays([pa.array([count]), pa.array([slope.tolist()]), pa.array([curve.ravel().tolist()])], ["count", "slope", "curve"])

        parts = pairs.mapInArrow(sums, "count long, slope array<double>, curve array<double>").collect()
        count = sum(p["count"] for p in parts)
        if not count:
            return ranking
        slope = np.sum([p["slope"] for p in parts], axis=0) - ridge * count * weights
        curve = np.sum([p["curve"] for p in parts], axis=0).reshape(size, size) + ridge * count * np.eye(size)
        step = np.linalg.solve(curve, slope)
        weights = weights + step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-7:
            break
    return replace(ranking, weights=tuple(round(float(w), 6) for w in weights))


def strength_counts(features: DataFrame, ranking: Ranking) -> np.ndarray:
    """How many of all rows have a strength in each bin."""
    rows = features.groupBy(ranking.bin().alias("bin")).count().collect()
    counts = np.zeros(BINS, np.int64)
    counts[[r["bin"] for r in rows]] = [r["count"] for r in rows]
    return counts


def bar_at(ranking: Ranking, counts: np.ndarray, quantile: float) -> Ranking:
    """The ranking with its bar at a quantile of all strengths, to the width of a bin; in the middle of a stretch without any."""
    if not counts.sum():
        return ranking
    below = np.append(0, np.cumsum(counts)) / counts.sum()
    edges = np.flatnonzero(below == below[np.searchsorted(below, min(quantile, below[-1]), "left")])
    return replace(ranking, bar=float(edges[len(edges) // 2]) * 2 * REACH / BINS - REACH, rejected=float(below[edges[0]]))


def learned_quantile(features: DataFrame, labels: DataFrame, ranking: Ranking, counts: np.ndarray, key: str = "doc_id", label: str = "label") -> float:
    """The quantile of all strengths that parts documents of label 0 and 1 with the fewest errors; the middle one of equals.

    What reaches the driver is a count per bin and label.
    """
    told = labels.filter(F.col(label).isin(0, 1)).groupBy(key).agg(F.min(label).alias("low"), F.max(label).alias("kind")).filter("low = kind")
    met = features.groupBy(key, ranking.bin().alias("bin")).agg(F.count("*").alias("n")).join(told, key)
    sides = np.zeros((2, BINS), np.int64)
    for r in met.groupBy("bin", "kind").agg(F.sum("n").alias("n")).collect():
        sides[int(r["kind"]), r["bin"]] = r["n"]
    lost = np.append(0, np.cumsum(sides[1]))
    kept = sides[0].sum() - np.append(0, np.cumsum(sides[0]))
    errors = lost + kept
    best = np.flatnonzero(errors == errors.min())
    # Edges of one stretch without labelled documents are equal; its middle is as far from both sides as can be.
    stretch = max(np.split(best, np.flatnonzero(np.diff(best) > 1) + 1), key=len)
    edge = int(stretch[len(stretch) // 2])
    return float(np.append(0, np.cumsum(counts))[edge] / max(1, counts.sum()))


def fit_quality_ranking(
    features: DataFrame, labels: DataFrame, quantile: float | None = None, key: str = "doc_id", label: str = "label", limit: int = SAMPLE_DOCS, partners: int = PARTNERS
) -> Ranking:
    """A ranking of documents by what labels of good (1) and bad (0) ones prefer, with its bar.

    The bar is the `quantile` of all documents' strengths; without one it is the quantile that parts the labelled documents
    best. Without labels of both kinds there is neither weight nor bar, and every document scores 0.5.
    """
    labels = stored(labels.select(key, label))
    ranking = standardised(features)
    pairs = stored(label_pairs(labels, key, label, limit, partners))
    if pairs.isEmpty():
        return ranking
    ranking = fit_ranking(pair_differences(features, pairs, ranking, key), ranking)
    counts = strength_counts(features, ranking)
    return bar_at(ranking, counts, learned_quantile(features, labels, ranking, counts, key, label) if quantile is None else quantile)


def ranked_documents(features: DataFrame, ranking: Ranking, key: str = "doc_id") -> DataFrame:
    """`key, strength, score, kept` of every row; kept: the strength reaches the bar, and so the score AT_BAR."""
    scored = features.select(key, ranking.strength().alias("strength"), ranking.score().alias("score"))
    return scored.withColumn("kept", F.col("score") >= AT_BAR)
