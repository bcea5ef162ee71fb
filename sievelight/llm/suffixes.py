"""Repeated byte strings by a depth-limited radix sort of sampled suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm.hashing import ByteHasher, utf8
from sievelight.plans.session import stored
from sievelight.plans.sizing import broadcast_if_small

#: Bytes handled at a time; a longer text is cut with an overlap of a window, which cuts runs but loses no window.
PIECE = 1 << 20
_LOW = np.uint64(PIECE - 1)

#: First digit of a suffix, in bytes, and windows that share one unit of the third digit.
SEED = 48
BLOCK = 8

#: Long hash keys that fit a broadcast, at 8 bytes each.
KEYS = 4_000_000


def _pieces(docs: list, texts: list[bytes], window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, start of each text, doc of each, byte position of each) for short texts together and long ones in parts."""
    parts = []
    for doc, text in zip(docs, texts, strict=True):
        if len(text) >= window:
            parts += [(doc, at, text[at : at + PIECE]) for at in range(0, len(text) - window + 1, PIECE - window + 1)]
    start = 0
    while start < len(parts):
        end, size = start, 0
        while end < len(parts) and (end == start or size + len(parts[end][2]) <= PIECE):
            size += len(parts[end][2])
            end += 1
        some = parts[start:end]
        offsets = np.zeros(len(some) + 1, np.int64)
        np.cumsum([len(p[2]) for p in some], out=offsets[1:])
        yield np.frombuffer(b"".join(p[2] for p in some), np.uint8), offsets, np.array([p[0] for p in some]), np.array([p[1] for p in some])
        start = end


def _seeded_runs(data: np.ndarray, offsets: np.ndarray, sums: np.ndarray, hasher: ByteHasher, window: int):
    """Runs of windows that share a seed: first window, number of windows, place of the seed.

    The seed of a window is its substring of SEED bytes with the least hash, the leftmost of equals. It depends on the
    window's bytes only, so equal windows have equal seeds at equal offsets.
    """
    seeds = np.arange(len(data) - SEED + 1)
    least = (hasher.between(sums, seeds, seeds + SEED) & ~_LOW) | seeds.astype(np.uint64)
    wide, size = window - SEED + 1, 1
    while 2 * size <= wide:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if wide > size:
        least = np.minimum(least[: len(least) - wide + size], least[wide - size :])
    inside = np.zeros(len(data) + 1, np.int64)
    np.add.at(inside, offsets[:-1], 1)
    np.add.at(inside, offsets[1:] - window + 1, -1)
    windows = np.flatnonzero(np.cumsum(inside)[: len(least)])
    seed = (least[windows] & _LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (seed[1:] != seed[:-1]) | (windows[1:] != windows[:-1] + 1)]))
    return windows[first], np.diff(np.append(first, len(windows))), seed[first]


def _runs(docs: DataFrame, window: int, seeds_only: bool) -> DataFrame:
    """Every run of windows: h1 the seed's hash, h2 the hash of the bytes that its windows span, doc, pos, windows, seed.

    With `seeds_only`, `h1, n`: how often each seed occurs in a piece.
    """
    names = ["h1", "n"] if seeds_only else ["h1", "h2", "doc", "pos", "windows", "seed"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ByteHasher(PIECE)
        for batch in batches:
            for data, offsets, ids, at in _pieces(batch.column("doc").to_pylist(), utf8(batch.column("text")), window):
                sums = hasher.prefix(data)
                start, count, seed = _seeded_runs(data, offsets, sums, hasher, window)
                h1 = hasher.between(sums, seed, seed + SEED)
                if seeds_only:
                    out = np.unique(h1, return_counts=True)
                else:
                    part = np.searchsorted(offsets, start, side="right") - 1
                    move = at[part] - offsets[part]
                    out = h1, hasher.between(sums, start, start + count - 1 + window), ids[part], start + move, count, seed + move
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in out], names)

    return docs.select("doc", "text").mapInArrow(make, ", ".join(f"{n} long" for n in names))


def _near(runs: list[dict], window: int) -> Iterator[tuple[int, list[dict]]]:
    """Runs of one text in groups that lie within a piece of it, with the piece's first byte."""
    some: list[dict] = []
    for r in sorted(runs, key=lambda r: r["pos"]):
        if some and r["pos"] + r["windows"] - 1 + window > some[0]["pos"] + PIECE:
            yield some[0]["pos"], some
            some = []
        some.append(r)
    if some:
        yield some[0]["pos"], some


def _windows(docs: DataFrame, runs: DataFrame, window: int) -> DataFrame:
    """`core, doc, start, hashes` for every block of windows of the runs, which are collected per document.

    Windows of a run are cut into blocks of BLOCK by their distance from the seed. `core` is the hash of the bytes that
    all windows of a whole block share, `hashes` those of the windows that are there, from `start`.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ByteHasher(PIECE)
        for batch in batches:
            out = []
            for doc, text, found in zip(batch.column("doc").to_pylist(), utf8(batch.column("text")), batch.column("runs").to_pylist(), strict=True):
                for base, some in _near(found, window):
                    pos, count, seed = (np.array([r[c] for r in some], np.int64) for c in ("pos", "windows", "seed"))
                    data = np.frombuffer(text[base : int((pos + count).max()) - 1 + window], np.uint8)
                    sums = hasher.prefix(data)
                    of = np.repeat(np.arange(len(some)), count)
                    start = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + (pos - base)[of]
                    block = (seed - base)[of] - start
                    block //= BLOCK
                    first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (block[1:] != block[:-1])]))
                    last = (seed - base)[of[first]] - block[first] * BLOCK
                    core = hasher.between(sums, last, last - BLOCK + 1 + window)
                    out.append((core, np.full(len(first), doc), start[first] + base, np.diff(np.append(first, len(of))), hasher.between(sums, start, start + window)))
            if out:
                core, ids, start, sizes, hashes = (np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True))
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes))
                yield pa.RecordBatch.from_arrays([pa.array(core), pa.array(ids), pa.array(start), lists], ["core", "doc", "start", "hashes"])

    per_doc = runs.groupBy("doc").agg(F.collect_list(F.struct("pos", "windows", "seed")).alias("runs"))
    chosen = docs.join(broadcast_if_small(per_doc.select("doc")), "doc", "left_semi").join(per_doc, "doc")
    return chosen.select("doc", "text", "runs").mapInArrow(make, "core long, doc long, start long, hashes array<long>")


def _not_first(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys occur at an earlier (doc, pos)."""
    firsts = rows.groupBy(*keys).agg(F.min(F.struct("doc", "pos")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    return rows.join(firsts.drop("n"), keys).filter("doc != first.doc OR pos != first.pos")


def repeated_ranges(docs: DataFrame, window: int = 100) -> DataFrame:
    """`doc, start, end`: byte ranges of `docs` (doc, text) that windows cover which also start earlier; ranges may overlap.

    Suffixes are compared through `window` bytes only, most significant digit first, and a digit's groups of one leave:
    the seed of a window; the bytes that a run of windows with one seed spans; the bytes that eight neighbouring windows
    share; the window. Runs that agree on the second digit agree on all their windows, so all but their first are
    repeats at once, and only that first goes on to later digits, where runs with one seed and different spans meet.
    """
    seeds = _runs(docs, window, True).groupBy("h1").agg(F.sum("n").alias("n")).filter("n > 1").select("h1")
    runs = stored(_runs(docs, window, False).join(broadcast_if_small(stored(seeds), KEYS), "h1", "left_semi"))
    groups = runs.groupBy("h1", "h2").agg(F.min(F.struct("doc", "pos", "windows", "seed")).alias("first"), F.count("*").alias("n"))
    groups = stored(groups)
    known = groups.filter("n > 1").select("h1", "h2", "first.doc", "first.pos").alias("f")
    later = runs.alias("r").join(known, ["h1", "h2"]).filter("r.doc != f.doc OR r.pos != f.pos")
    whole = later.select("r.doc", F.col("r.pos").alias("start"), (F.col("r.pos") + F.col("windows") - 1 + window).alias("end"))
    mixed = groups.groupBy("h1").agg(F.count("*").alias("n")).filter("n > 1").select("h1")
    mixed = groups.join(broadcast_if_small(stored(mixed), KEYS), "h1", "left_semi").select("first.*")
    blocks = stored(_windows(docs, mixed, window))
    cores = blocks.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1").select("core")
    left = blocks.join(broadcast_if_small(stored(cores), KEYS), "core", "left_semi")
    left = left.select("doc", F.posexplode("hashes").alias("at", "h"), "start").select("h", "doc", (F.col("start") + F.col("at")).alias("pos"))
    single = _not_first(left, ["h"]).select("doc", F.col("pos").alias("start"), (F.col("pos") + window).alias("end"))
    return whole.unionByName(single)


def _merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def suffix_dedup(
    docs: DataFrame, window: int = 100, key: str = "doc_id", text: str = "text", with_text: bool = False, keep: Sequence[str] = ()
) -> DataFrame:
    """One row per row of `docs`: `doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`, `kept` with `with_text`, columns `keep`.

    Texts are UTF-8 bytes; a byte goes if a string of `window` bytes that covers it also starts earlier, in a smaller id
    or before in the same text. Strings are those of the input. `spans` are the maximal removed runs, `kept` is the rest
    (broken characters at a cut become U+FFFD). Whole copies are found by their digest first and go entirely, if they
    hold a window; only first texts are compared further. A null text is empty. Rows that share an id share the ranges
    that either has, which is why ids should be unique; other columns don't matter. A row with a null id takes part with
    a number from the hash of its text, greater than any id below 2^62, and comes out with a null id: it loses what
    texts with ids hold, and equal texts without ids count as one and keep or lose the same.
    """
    extra = {c: kind for c, kind in docs.dtypes if c in keep}
    number = F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)
    id_ = F.col(key).cast("long")
    docs = docs.select(F.coalesce(id_, number).alias("doc"), F.col(text).alias("text"), id_.isNull().alias("_none"), *extra)
    digests = stored(docs.select("doc", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest")))
    firsts = digests.groupBy("digest").agg(F.min("doc").alias("doc"))
    copies = stored(digests.join(firsts, ["digest", "doc"], "left_anti").select("doc").distinct())
    different = docs.join(broadcast_if_small(copies), "doc", "left_anti")
    ranges = repeated_ranges(different, window).groupBy("doc").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    ranges = ranges.unionByName(copies.select("doc", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(-1).cast("long").alias("end"))).alias("ranges")))

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
    kinds = ["long", "long", "long", "long", "string", "array<struct<start:long,end:long>>"]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, rest = [], []
            ids = [None if none else doc for doc, none in zip(batch.column("doc").to_pylist(), batch.column("_none").to_pylist(), strict=True)]
            for doc, data, found in zip(ids, utf8(batch.column("text")), batch.column("ranges").to_pylist(), strict=True):
                # A copy's range runs to its end; one shorter than a window has none.
                spans = [(x["start"], len(data) if x["end"] < 0 else x["end"]) for x in found or [] if x["end"] >= 0 or len(data) >= window]
                spans = _merge(spans)
                edges = [0, *[e for s in spans for e in s], len(data)]
                kept = b"".join(data[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))
                rows.append((doc, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in spans]))
                rest.append(kept.decode("utf-8", "replace"))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = [pa.int64()] * 4 + [pa.string(), span]
            out = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            out += [pa.array(rest, pa.string())] * with_text + [batch.column(c) for c in extra]
            yield pa.RecordBatch.from_arrays(out, names + ["kept"] * with_text + list(extra))

    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)) + ", kept string" * with_text
    schema += "".join(f", `{c}` {kind}" for c, kind in extra.items())
    # Only texts that lose something move to where their ranges are.
    ranges = stored(ranges)
    touched = broadcast_if_small(ranges.select("doc"))
    met = docs.join(touched, "doc", "left_semi").join(ranges, "doc").select("doc", "text", "ranges", "_none", *extra)
    rest_ = docs.join(touched, "doc", "left_anti").withColumn("ranges", F.lit(None).cast(ranges.schema["ranges"].dataType))
    return met.unionByName(rest_.select("doc", "text", "ranges", "_none", *extra)).mapInArrow(make, schema)
