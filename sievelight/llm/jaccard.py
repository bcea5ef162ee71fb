"""Jaccard join of word n-gram sets: rare-first prefixes, length, positional and suffix filters, each pair verified once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.llm.graph import connected_components
from sievelight.llm.hashing import shingle_sets, slices, utf8
from sievelight.plans.session import stored
from sievelight.plans.sizing import broadcast_if_small, is_small

#: Classes of n-gram hashes by whose document counts n-grams are ordered, and classes of the suffix filter.
ORDER_BITS = 17
SUFFIX_CLASSES = 128

#: Rounds that link documents to a few partners each, so that few pairs are left between components.
ROUNDS = 3
GROUP = 8

#: Last of the eight parts of the hash range that each share of the n-grams reaches (see `_possible` and `_partnered`).
SHARES = (2, 8)

#: Shared n-grams that are looked up in a bitmap of 2^BITMAP_ROW_BITS rows of 64 bits; more of them meet the rows in a shuffle join.
KEYS = 4_000_000
BITMAP_ROW_BITS = 20


def _ceil(value: str, by: str) -> str:
    return f"(({value}) + {by} - 1) div {by}"


def class_counts(docs: DataFrame, n: int) -> DataFrame:
    """`class, count`: document counts of n-grams by the top bits of their hash, over all documents.

    The table has a fixed size. It gives all documents one order of n-grams, the commonest last; n-grams that share a
    class with a common one come late too, which costs time but loses no pair, as any common order is exact.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << ORDER_BITS, np.int64)
        for batch in slices(batches, "text"):
            sets = list(shingle_sets(utf8(batch.column("text")), n))
            total += np.bincount((np.concatenate(sets) >> np.uint64(64 - ORDER_BITS)).astype(np.int64), minlength=1 << ORDER_BITS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["class", "count"])

    return docs.select("text").mapInArrow(count, "class int, count long").groupBy("class").agg(F.sum("count").alias("count"))


def _digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _share_of(grams: np.ndarray) -> np.ndarray:
    """The share of each n-gram, by three bits of its hash that order and classes don't use."""
    return np.searchsorted(SHARES, (grams >> np.uint64(32) & np.uint64(7)).astype(np.int64), "right")


def _facts(docs: DataFrame, n: int, percent: int, order: np.ndarray | None) -> DataFrame:
    """`doc, size, set_key, prefix, shares`: set size, a digest of the set, its rarest n-grams, of which a partner shares one
    (null without an order), and its n-grams by share."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            keys, prefixes, sizes, shares = [], [], [], []
            for grams in shingle_sets(utf8(batch.column("text")), n):
                size = len(grams)
                keep = size + (-percent * size // 100) + 1 if size else 0
                if order is None:
                    prefixes.append(None)
                else:
                    late = order[(grams >> np.uint64(64 - ORDER_BITS)).astype(np.int64)]
                    prefixes.append(grams[np.argsort(late, kind="stable")[:keep]].view(np.int64))
                keys.append(_digest(grams) if size else None)
                sizes.append(size)
                shares.append(np.bincount(_share_of(grams), minlength=len(SHARES)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), *(pa.array(x, pa.list_(pa.int64())) for x in (prefixes, shares))],
                ["doc", "size", "set_key", "prefix", "shares"],
            )

    return docs.select("doc", "text").mapInArrow(make, "doc long, size long, set_key binary, prefix array<long>, shares array<long>")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """`doc, grams`: whole sets."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [g.tobytes() for g in shingle_sets(utf8(batch.column("text")), n)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(sets, pa.binary())], ["doc", "grams"])

    return docs.select("doc", "text").mapInArrow(make, "doc long, grams binary")


def _classes(docs: DataFrame, n: int) -> DataFrame:
    """`doc, classes`: counts of a set by class, null where a count could pass 16 bits."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            kinds = [
                np.bincount((g % np.uint64(SUFFIX_CLASSES)).astype(np.int64), minlength=SUFFIX_CLASSES)
                for g in shingle_sets(utf8(batch.column("text")), n)
            ]
            packed = [k.astype(np.uint16).tobytes() if k.max() < 1 << 16 else None for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(packed, pa.binary())], ["doc", "classes"])

    return docs.select("doc", "text").mapInArrow(make, "doc long, classes binary")


def _both(pairs: DataFrame, of: DataFrame, column: str) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(of.select(F.col("doc").alias(side), F.col(column).alias(f"{column}_{side}")), side)
    return pairs.select("a", "b", f"{column}_a", f"{column}_b")


def suffix_filter(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose class counts allow the overlap they need: it is at most the sum of the lesser counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "classes_a", "classes_b"):
            sides = [np.frombuffer(b"".join(x or b"\xff" * 2 * SUFFIX_CLASSES for x in batch.column(c).to_pylist()), np.uint16).reshape(-1, SUFFIX_CLASSES).astype(np.int64) for c in ("classes_a", "classes_b")]
            most, total = np.minimum(*sides).sum(axis=1), sides[0].sum(axis=1) + sides[1].sum(axis=1)
            unknown = pc_null(batch.column("classes_a")) | pc_null(batch.column("classes_b"))
            keep = pa.array(unknown | (100 * most >= percent * (total - most)))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return _both(pairs, classes, "classes").mapInArrow(run, "a long, b long")


def pc_null(column: pa.Array) -> np.ndarray:
    return column.is_null().to_numpy(zero_copy_only=False)


def verified(pairs: DataFrame, docs: DataFrame, percent: int, n: int) -> DataFrame:
    """Pairs whose sets meet the threshold: 100 * common >= percent * all. Only sets of documents in a pair are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "grams_a", "grams_b"):
            keep = []
            for x, y in zip(batch.column("grams_a").to_pylist(), batch.column("grams_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct())
    sets = stored(_sets(docs.join(broadcast_if_small(wanted), "doc", "left_semi"), n).dropDuplicates(["doc"]))
    return stored(_both(pairs, sets, "grams").mapInArrow(run, "a long, b long"))


def _later(x: str, y: str) -> Column:
    """Partners are ordered by size, then by id."""
    return F.expr(f"{x}.size < {y}.size OR ({x}.size = {y}.size AND {x}.doc < {y}.doc)")


def _fits(x: str, y: str, percent: int) -> Column:
    """Length filter, and positional filter: what follows the shared n-gram on either side must be enough."""
    need = _ceil(f"{percent} * ({x}.size + {y}.size)", str(100 + percent))
    return F.expr(
        f"100 * least({x}.size, {y}.size) >= {percent} * greatest({x}.size, {y}.size) AND 1 + least({x}.size - 1 - {x}.pos, {y}.size - 1 - {y}.pos) >= {need}"
    )


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows of n-grams that documents of different components share."""
    spans = rows.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n_rows"))
    return rows.join(spans.filter("lo < hi").select("h", "n_rows"), "h")


def _among(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose `h` is one of `keys` (h, distinct).

    Few keys are broadcast. More of them, up to KEYS, would fill the driver at 50 bytes each: they set bits in a table of
    fixed size, which is broadcast in their stead, and only rows whose bit is set meet the keys in a shuffle join. Beyond
    KEYS most bits would be set, and all rows go to that join. It is an inner join, as the optimizer would move a semi
    join of the keys below the one with the bits, where no row has left yet.
    """
    keys = stored(keys)
    if is_small(keys):
        return rows.join(F.broadcast(keys), "h", "left_semi")
    if is_small(keys, KEYS):
        row, bit = F.shiftrightunsigned("h", 64 - BITMAP_ROW_BITS), F.expr("shiftleft(1L, cast(h & 63 AS int))")
        bits = stored(keys.groupBy(row.alias("_row")).agg(F.bit_or(bit).alias("_bits")))
        met = rows.withColumn("_row", row).join(F.broadcast(bits), "_row").filter(F.col("_bits").bitwiseAND(bit) != 0)
        return met.join(keys, "h").select(*rows.columns)
    return rows.join(keys, "h", "left_semi")


def _grams(docs: DataFrame, n: int, share: int) -> DataFrame:
    """`doc, comp, h`: the n-grams of one share. Without a column `comp`, a number that goes with the set stands for it."""
    placed = "comp" in docs.columns

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            whole = list(shingle_sets(utf8(batch.column("text")), n))
            sets = [g[_share_of(g) == share].view(np.int64) for g in whole]
            sizes = [len(g) for g in sets]
            of = batch.column("comp").to_numpy() if placed else np.array([int.from_bytes(_digest(g)[:8], "big", signed=True) for g in whole], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), pa.array(np.repeat(of, sizes)), pa.array(np.concatenate(sets))],
                ["doc", "comp", "h"],
            )

    return docs.select("doc", "text", *["comp"] * placed).mapInArrow(make, "doc long, comp long, h long")


def _met(grams: DataFrame) -> DataFrame:
    """`doc, met`: how many of its rows in `grams` have an `h` that another `comp` has too."""
    spans = grams.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("h")
    return stored(_among(grams.select("doc", "h"), spans).groupBy("doc").agg(F.count("*").alias("met")))


def _common(rows: DataFrame, docs: DataFrame, n: int, share: int) -> DataFrame:
    """`doc, met`: how many n-grams of one share a document has that also occur in another component, of all documents in `rows`.

    Those of several rows with one id are added up, so there it is the most that it can be.
    """
    members = stored(rows.select("doc", "comp").distinct())
    return _met(_grams(docs.join(broadcast_if_small(members), "doc").select("doc", "text", "comp"), n, share))


def _still(rows: DataFrame, met: DataFrame, share: int, percent: int) -> DataFrame:
    """`rows` of documents that can have a partner, once the n-grams of `share` that they met are known; see `_possible`."""
    own = F.get("shares", share) - F.coalesce("met", F.lit(0))
    rows = rows.join(broadcast_if_small(met), "doc", "left").withColumn("common", F.col("common") - F.greatest(own, F.lit(0))).drop("met")
    return stored(rows.filter(f"100 * common >= {percent} * size"))


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """`doc, text` of the rows with one of the ids; a bitmap spares rows without one the shuffle (see `_among`)."""
    keyed = docs.select(F.xxhash64("doc").alias("h"), "doc", "text")
    return _among(keyed, ids.select(F.xxhash64("doc").alias("h")).distinct()).select("doc", "text")


def _partnered(rows: DataFrame, docs: DataFrame, percent: int, n: int) -> DataFrame:
    """`rows` of documents that can have a partner with another set; as `_possible`, but over all documents, before any are linked."""
    rows = rows.withColumn("common", F.col("size"))
    for share in range(len(SHARES)):
        among = _texts_of(docs, rows.select("doc")) if share else docs
        rows = _still(rows, _met(_grams(among, n, share)), share, percent)
    return rows


def _possible(rows: DataFrame, docs: DataFrame, percent: int, n: int) -> DataFrame:
    """`rows` of documents that can have a partner in another component, with `common`: the most that they share with one.

    No partner can share more than the n-grams that any other component has, so a document whose own n-grams are many is
    known to have none before any pair is made. N-grams are looked at share by share. Those of later shares count as
    shared, so a document leaves as soon as its own ones are too many, and with it leave its other n-grams: a first share
    of a quarter is all that is needed of a document of which less than a fifth is shared, at 80 percent. A partner of a
    document never leaves before it, since what the two share is not their own.
    """
    rows = rows.withColumn("common", F.col("size"))
    for share in range(len(SHARES)):
        rows = _still(rows, _common(rows, docs, n, share), share, percent)
    return stored(_mixed(rows.drop("n_rows")))


def _to_pivots(rows: DataFrame, group: list[Column], first: Column, percent: int) -> DataFrame:
    """One pair per row at most: with the pivot of its group, which is the row with the least `first`."""
    rows = rows.withColumns({f"g{k}": g for k, g in enumerate(group)})
    names = ["h", *[f"g{k}" for k in range(len(group))]]
    pivots = rows.groupBy(*names).agg(F.min(F.struct(first.alias("first"), "doc", "size", "pos", "comp")).alias("p"))
    pivots = pivots.select(*names, "p.doc", "p.size", "p.pos", "p.comp")
    met = rows.alias("x").join(pivots.alias("y"), names).filter("x.doc != y.doc AND x.comp != y.comp").filter(_fits("x", "y", percent))
    return met.select(F.expr("least(x.doc, y.doc)").alias("a"), F.expr("greatest(x.doc, y.doc)").alias("b")).distinct()


def _merged(rows: DataFrame, comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """`doc, comp` for linked documents, after joining components that `links` connect."""
    if comps is None:
        return stored(connected_components(links).select(F.col("node").alias("doc"), F.col("component").alias("comp")))
    ends = links
    for side in ("a", "b"):
        of = comps.select(F.col("doc").alias(side), F.col("comp").alias(f"c{side}"))
        ends = ends.join(of, side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
    joined = connected_components(ends, "ca", "cb").select(F.col("node").alias("comp"), F.col("component").alias("to"))
    known = comps.unionByName(links.select(F.explode(F.array("a", "b")).alias("doc")).withColumn("comp", F.col("doc")).join(comps, "doc", "left_anti")).distinct()
    return stored(known.join(joined, "comp", "left").select("doc", F.coalesce("to", "comp").alias("comp")))


def jaccard_components(docs: DataFrame, percent: int = 80, n: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id, n_shingles, component_id` for every row: set size, and the smallest id reachable by links, its own included.

    Two documents link when 100 * common n-grams >= percent * all n-grams of the two. Copies of one set are one class,
    whose smallest id stands for it. First, a document's n-grams that another set has are counted; one with too many of
    its own has no partner and takes no part in what follows (see `_partnered`). A class that is left puts its rarest
    n-grams up for the join, so many that a partner must share one. Documents first meet one partner per shared n-gram: the one that shares most, then, in a few rounds, one of a
    random group of eight. What those pairs connect is one component; last, every pair left that shares a prefix n-gram
    and lies in two components goes through all filters and is verified. So a group of thousands of near copies is
    connected by few pairs, and no link between components is lost. Before that last join, n-grams that any other component
    has are counted again: no partner there can share more (see `_possible`).

    A null or empty text, or one of blanks only, has no n-grams and is its own component; fewer than `n` words are one
    n-gram. Rows that share an id share a component. Other columns don't matter.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    facts = stored(_facts(docs, n, percent, None).drop("prefix"))
    firsts = stored(facts.filter("set_key IS NOT NULL AND doc IS NOT NULL").groupBy("set_key").agg(F.min("doc").alias("doc")))
    short = f"size - {_ceil(f'2 * {percent} * size', str(100 + percent))} + 1"
    left = _partnered(facts.join(firsts, ["set_key", "doc"], "left_semi"), docs, percent, n).select("set_key", "doc")
    docs = stored(_texts_of(docs, left))
    order = np.zeros(1 << ORDER_BITS, np.int64)
    counted = class_counts(docs, n).toArrow()
    order[counted["class"].to_numpy()] = counted["count"].to_numpy()
    rows = _facts(docs, n, percent, order).join(broadcast_if_small(left), ["set_key", "doc"], "left_semi")
    rows = rows.select("doc", "size", "shares", F.posexplode("prefix").alias("pos", "h"))
    rows = rows.withColumn("pos", F.col("pos").cast("long")).withColumn("early", F.expr(f"pos < {short}"))
    held = rows.groupBy("h").agg(F.count("*").alias("c"), F.max("early").alias("e")).filter("c > 1 AND e")
    shared = stored(_among(rows, held.select("h")))

    wanted = stored(shared.groupBy("doc").agg(F.count("*").alias("share")))
    classes = stored(_classes(docs.join(broadcast_if_small(wanted.select("doc")), "doc", "left_semi"), n).dropDuplicates(["doc"]))
    alone = shared.withColumn("comp", F.col("doc")).join(wanted, "doc")
    band = F.floor(F.log("size") / F.log(F.lit(100 / percent)))
    tested = stored(_to_pivots(alone, [band], -F.col("share"), percent))
    links = verified(stored(suffix_filter(tested, classes, percent)), docs, percent, n)
    comps = _merged(shared, None, links)
    for turn in range(ROUNDS):
        placed = shared.join(comps, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
        some = F.pmod(F.xxhash64("doc", F.lit(turn)), F.greatest(F.lit(1).cast("long"), F.expr(f"n_rows div {GROUP}")))
        pairs = _to_pivots(_mixed(placed), [band, some], F.xxhash64("doc", F.lit(turn), F.lit(1)), percent)
        pairs = stored(suffix_filter(pairs.join(tested, ["a", "b"], "left_anti"), classes, percent))
        links = verified(pairs, docs, percent, n)
        tested = tested.unionByName(pairs)
        comps = _merged(shared, comps, links)
    placed = shared.join(comps, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
    placed = _possible(stored(_mixed(placed)), docs, percent, n)
    x, y = placed.filter("early").alias("x"), placed.alias("y")
    enough = F.expr(f"least(x.common, y.common) >= {_ceil(f'{percent} * (x.size + y.size)', str(100 + percent))}")
    met = x.join(y, F.expr("x.h = y.h AND x.comp != y.comp") & _later("x", "y") & _fits("x", "y", percent) & enough)
    pairs = met.select(F.expr("least(x.doc, y.doc)").alias("a"), F.expr("greatest(x.doc, y.doc)").alias("b")).distinct()
    pairs = stored(suffix_filter(pairs.join(tested, ["a", "b"], "left_anti"), classes, percent))
    comps = _merged(shared, comps, verified(pairs, docs, percent, n))

    classes = firsts.join(comps, "doc", "left").select("set_key", F.coalesce("comp", "doc").alias("component_id"))
    named = facts.select("doc", "size", "set_key").join(classes, "set_key", "left")
    return named.select(F.col("doc").alias("doc_id"), F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id"))
