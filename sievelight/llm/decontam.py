"""Benchmark decontamination: an inverted index of test items, queried by every training passage with block-max pruning."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm.hashing import slices
from sievelight.plans.session import stored

#: Test items that one index holds; a larger benchmark goes over the documents in several blocks of items.
INDEX_ITEMS = 20_000

#: Items whose postings share a maximum.
BLOCK_ITEMS = 32

#: Bytes of text that are searched at a time. Every word meets the postings of its term, which take a hundred times its bytes.
SEARCH_BYTES = 128 << 10

_PLAIN = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
_SENTENCE = re.compile(r"[^.!?\n]+")


def tokens(text: str) -> list[bytes]:
    """Lower-cased words; ASCII punctuation and blanks part them."""
    return text.lower().encode("utf-8", "replace").translate(_PLAIN).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """Words of an item's question and of its answer: its last sentence, or the last third of a single sentence."""
    said = [w for s in _SENTENCE.findall(text) if (w := tokens(s))]
    if len(said) > 1:
        return list(chain.from_iterable(said[:-1])), said[-1]
    words = said[0] if said else []
    cut = len(words) - len(words) // 3
    return words[:cut], words[cut:]


@dataclass
class ItemStats:
    """What BM25 and passages need of the whole benchmark: items and their words in all, words of the longest, items by term."""

    count: int
    words: int
    longest: int
    df: dict[bytes, int]


@dataclass
class ItemIndex:
    """Postings by term with BM25 impacts, the greatest impact per block of items, and what pruning needs.

    needed: the score at which an item is retrieved. essential: terms without which no passage can reach any item.
    """

    ids: list
    terms: dict[bytes, int]
    starts: np.ndarray
    items: np.ndarray
    impacts: np.ndarray
    block_starts: np.ndarray
    blocks: np.ndarray
    block_impacts: np.ndarray
    needed: np.ndarray
    block_needed: np.ndarray
    essential: np.ndarray
    parts: list[tuple[list, list]]
    longest: int


def build_index(
    rows: Sequence[tuple[int, str | None]], share: float = 0.6, k1: float = 1.2, b: float = 0.75, stats: ItemStats | None = None
) -> ItemIndex:
    """An index of (id, text) items. An item is retrieved at `share` of the score that its own words would get.

    `stats` are those of the benchmark that the items are a block of; without them the items are the whole benchmark.
    Terms are numbered in order, so that scores are summed in one order and don't depend on the block.
    """
    rows = sorted((i, t) for i, t in rows if i is not None and t and tokens(t))
    words = [tokens(t) for _, t in rows]
    terms = {w: k for k, w in enumerate(sorted(set(chain.from_iterable(words))))}
    count, size = len(rows), len(terms)
    item, term, tf = [], [], []
    for k, ws in enumerate(words):
        ids, n = np.unique([terms[w] for w in ws], return_counts=True)
        item += [k] * len(ids)
        term += ids.tolist()
        tf += n.tolist()
    item, term, tf = np.array(item, np.int64), np.array(term, np.int64), np.array(tf, float)
    stats = stats or ItemStats(count, sum(map(len, words)), max(map(len, words), default=1), dict(zip(terms, np.bincount(term, minlength=size).tolist(), strict=True)))
    df, mean = np.array([stats.df[w] for w in terms], np.int64), stats.words / max(stats.count, 1)
    length = np.array([len(ws) for ws in words], float)
    idf = np.log(1 + (stats.count - df + 0.5) / (df + 0.5))
    impact = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[item] / mean)) if count else np.empty(0)
    needed = share * np.bincount(item, impact, count)
    # An item's essential terms: its greatest impacts, until what is left can't reach what it needs.
    order = np.lexsort((impact, item))
    rest = np.cumsum(impact[order])
    first = np.searchsorted(item[order], np.arange(count))
    rest = rest - np.concatenate([[0.0], rest])[first][item[order]]
    essential = np.zeros(size, bool)
    essential[term[order][rest >= needed[item[order]] - 1e-9]] = True

    by_term = np.lexsort((item, term))
    item, term, impact = item[by_term], term[by_term], impact[by_term]
    starts = np.searchsorted(term, np.arange(size + 1))
    block = term * (count // BLOCK_ITEMS + 1) + item // BLOCK_ITEMS
    at = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.empty(0, np.int64)
    most = np.maximum.reduceat(impact, at) if len(at) else np.empty(0)
    low = np.full(count // BLOCK_ITEMS + 1, np.inf)
    np.minimum.at(low, np.arange(count) // BLOCK_ITEMS, needed)
    return ItemIndex(
        [i for i, _ in rows], terms, starts, item, impact, np.searchsorted(term[at], np.arange(size + 1)), item[at] // BLOCK_ITEMS, most,
        needed, low, essential, [question_and_answer(t) for _, t in rows], stats.longest,
    )


def _spread(starts: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each term, the places of its postings: (which term, which posting)."""
    sizes = starts[terms + 1] - starts[terms]
    which = np.repeat(np.arange(len(terms)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[terms][which]


def search(index: ItemIndex, ids: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, item, score) of all that reach what the item needs. ids, passages: term and passage of each token.

    A passage without an essential term can't reach any item. For the others the sums of block maxima bound the scores
    of all items in a block; postings are scored in the blocks whose bound reaches the least need only.
    """
    known = ids >= 0
    ids, passages = ids[known], passages[known]
    count = int(passages.max()) + 1 if len(passages) else 0
    able = np.zeros(count, bool)
    able[passages[index.essential[ids]]] = True
    open_ = able[passages]
    pairs = np.unique(passages[open_] * len(index.terms) + ids[open_])
    passages, ids = pairs // max(len(index.terms), 1), pairs % max(len(index.terms), 1)
    number, passages = np.unique(passages, return_inverse=True)
    n_blocks = len(index.block_needed)
    which, posting = _spread(index.block_starts, ids)
    bound = np.bincount(passages[which] * n_blocks + index.blocks[posting], index.block_impacts[posting], len(number) * n_blocks)
    alive = bound.reshape(len(number), n_blocks) >= index.block_needed - 1e-9
    some = alive.any(axis=1)[passages]
    passages, ids = passages[some], ids[some]
    which, posting = _spread(index.starts, ids)
    in_block = alive[passages[which], index.items[posting] // BLOCK_ITEMS]
    which, posting = which[in_block], posting[in_block]
    met, at = np.unique(passages[which] * len(index.ids) + index.items[posting], return_inverse=True)
    score = np.bincount(at, index.impacts[posting], len(met))
    item = met % max(len(index.ids), 1)
    good = score >= index.needed[item] - 1e-9
    return number[met[good] // max(len(index.ids), 1)], item[good], score[good]


def _grams(words: list, n: int) -> set:
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}


def overlap(part: list, words: list, n: int = 3) -> float:
    """Share of the part's word n-grams that a passage holds; a part of fewer words is one n-gram, an empty one is held."""
    n = min(n, len(part))
    mine = _grams(part, n) if n else set()
    return len(mine & _grams(words, n)) / len(mine) if mine else 1.0


def _hits(texts: list[str | None], index: ItemIndex) -> Iterator[tuple[int, int, float, float, float]]:
    """(text, item, score, question overlap, answer overlap): for each text and item the passages that no other is above in both overlaps."""
    words = [tokens(t or "") for t in texts]
    stride = index.longest
    sizes = np.array([len(w) for w in words])
    ids = np.fromiter(map(index.terms.get, chain.from_iterable(words), repeat(-1)), np.int64, int(sizes.sum()))
    # A passage is two strides long and starts at every stride, so it holds any place where an item may stand.
    steps = np.maximum(1, -(-sizes // stride) - 1)
    first = np.cumsum(steps) - steps
    doc = np.repeat(np.arange(len(words)), sizes)
    step = (np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) // stride
    here, before = step < steps[doc], step > 0
    passage, item, score = search(index, np.concatenate([ids[here], ids[before]]), np.concatenate([(first[doc] + step)[here], (first[doc] + step - 1)[before]]))
    doc_of = np.searchsorted(first, passage, side="right") - 1
    found: dict[tuple[int, int], dict[tuple[float, float], float]] = {}
    for d, p, k, s in zip(doc_of.tolist(), passage.tolist(), item.tolist(), score.tolist(), strict=True):
        start = (p - int(first[d])) * stride
        read = words[d][start : start + 2 * stride]
        here_ = tuple(overlap(part, read) for part in index.parts[k])
        known = found.setdefault((d, k), {})
        known[here_] = max(known.get(here_, s), s)
    for (d, k), known in sorted(found.items()):
        most = -1.0
        for q, a in sorted(known, reverse=True):
            if a > most:
                most = a
                yield d, k, known[q, a], q, a


def _batch_hits(batches: Iterator[pa.RecordBatch], index: ItemIndex) -> Iterator[pa.RecordBatch]:
    """`doc_id, item_id, score, question_overlap, answer_overlap` of batches of doc_id and text."""
    names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
    for batch in slices(batches, "text", limit=SEARCH_BYTES):
        ids = batch.column("doc_id").to_pylist()
        out = [(ids[d], index.ids[k], s, q, a) for d, k, s, q, a in _hits(batch.column("text").to_pylist(), index)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`item_id, words, terms` of items that have words."""
    for batch in slices(batches, "text"):
        said = [tokens(t or "") for t in batch.column("text").to_pylist()]
        made = [(i, len(ws), sorted(set(ws))) for i, ws in zip(batch.column("item_id").to_pylist(), said, strict=True) if ws]
        types = [pa.int64(), pa.int64(), pa.list_(pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate(types)], ["item_id", "words", "terms"])


def benchmark_hits(
    docs: DataFrame, items: DataFrame, share: float = 0.6, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text", index_items: int = INDEX_ITEMS,
) -> DataFrame:
    """`doc_id, item_id, score, question_overlap, answer_overlap, passages`: every document and item above the item's threshold.

    The overlaps are those of the passage with the greatest sum; `passages` has, as structs of score and overlaps, all
    that no other passage is above in both, so that thresholds on both can be held against every passage.
    Passages of whole texts are queries, items the indexed side. An index holds at most `index_items` items, ordered by
    id; each block of items is one pass over the documents, and its index is what reaches the driver at a time. Scores
    are BM25 over all items: their number, mean length and counts by term are taken before blocks are cut, and passages
    are as long as the longest of all items asks for, so `index_items` doesn't change the rows. Null and empty texts give nothing on either side; an item's repeated rows
    count once; rows that share a document id are passages of one document.
    """
    items = items.select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL")
    items = items.groupBy("item_id").agg(F.min("text").alias("text"))
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"

    def one_block(rows: list, stats: ItemStats | None = None) -> DataFrame:
        index = build_index([(r["item_id"], r["text"]) for r in rows], share, stats=stats)

        return docs.mapInArrow(lambda batches: _batch_hits(batches, index), schema)

    rows = items.orderBy("item_id").limit(index_items + 1).collect()
    if not rows:
        made = docs.sparkSession.createDataFrame([], schema)
    elif len(rows) <= index_items:
        made = one_block(rows)
    else:
        items = stored(items)
        terms = stored(items.mapInArrow(_item_terms, "item_id long, words long, terms array<binary>"))
        total = terms.agg(F.count("*"), F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.max("words"), F.lit(1))).first()
        df = stored(terms.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")))
        made, rows = None, rows[:index_items]
        while rows:
            # Of the terms only those of the block reach the driver.
            here = terms.filter(F.col("item_id").between(rows[0]["item_id"], rows[-1]["item_id"])).select(F.explode("terms").alias("term")).distinct()
            known = {bytes(r["term"]): r["n"] for r in df.join(here, "term").collect()}
            hits = one_block(rows, ItemStats(total[0], total[1], total[2], known))
            made = hits if made is None else made.unionByName(hits)
            rows = items.filter(F.col("item_id") > rows[-1]["item_id"]).orderBy("item_id").limit(index_items).collect()
    # Overlaps are fractions of an item's n-grams, so few pairs of them are left per document and item, however many rows share an id.
    made = made.groupBy("doc_id", "item_id", "question_overlap", "answer_overlap").agg(F.max("score").alias("score"))
    passage = F.struct("score", "question_overlap", "answer_overlap")
    best = F.max(F.struct((F.col("question_overlap") + F.col("answer_overlap")).alias("sum"), "score", "question_overlap", "answer_overlap"))
    made = made.groupBy("doc_id", "item_id").agg(best.alias("best"), F.collect_list(passage).alias("passages"))
    return made.select("doc_id", "item_id", "best.score", "best.question_overlap", "best.answer_overlap", "passages")


def contaminated(hits: DataFrame, question: float = 0.6, answer: float = 0.6) -> DataFrame:
    """Hits with a passage that holds both question and answer, with the figures of the one of them with the greatest sum."""
    fit = F.filter("passages", lambda p: (p["question_overlap"] >= question) & (p["answer_overlap"] >= answer))
    ranked = F.transform(fit, lambda p: F.struct((p["question_overlap"] + p["answer_overlap"]).alias("sum"), p["score"].alias("score"), p["question_overlap"].alias("q"), p["answer_overlap"].alias("a")))
    told = hits.withColumn("_best", F.array_max(ranked)).filter("_best IS NOT NULL")
    return told.select("doc_id", "item_id", "_best.score", F.col("_best.q").alias("question_overlap"), F.col("_best.a").alias("answer_overlap"))
