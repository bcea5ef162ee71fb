"""JSON arrays of objects in files of any size, cut into their objects by byte ranges.

A file is read in pieces that end with a closing brace, so that Spark splits it anywhere, with or without line ends. Where
a block lies in the array is not known to the task that reads it. It scans the block once as if it began outside a string
and once as if inside, and tells for both how the depth changes and, per depth, how many objects begin. Going through a
file's blocks in order, each one's true state follows from those before it. With that state a second scan cuts the objects.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievelight.sources.lines import BLOCKS, read_text_files

NOT_ARRAY = "json dataset must be an array"

# What a byte outside of strings is: a bracket or comma, or anything else.
OTHER, OPEN, CLOSE, OPEN_LIST, CLOSE_LIST, COMMA = range(6)
KIND = np.zeros(256, np.int8)
KIND[np.frombuffer(b"{}[],", np.uint8)] = [OPEN, CLOSE, OPEN_LIST, CLOSE_LIST, COMMA]
STEP = np.array([0, 1, -1, 1, -1, 0])
SPACE = np.zeros(256, bool)
SPACE[np.frombuffer(b" \t\r\n", np.uint8)] = True

# What may follow what in the array itself: start, its brackets, objects, commas.
START, FIRST, OBJECT, BETWEEN, LAST, WRONG, UNSEEN = range(7)
FOLLOWS = np.zeros((7, 7), bool)
for _one, _next in ((START, FIRST), (FIRST, OBJECT), (FIRST, LAST), (OBJECT, BETWEEN), (OBJECT, LAST), (BETWEEN, OBJECT)):
    FOLLOWS[_one, _next] = True
#: The meaning of each kind at depth 0 and inside the array; an object's closing brace has none.
OUTSIDE = np.array([WRONG, WRONG, WRONG, FIRST, LAST, WRONG])
WITHIN = np.array([WRONG, OBJECT, UNSEEN, WRONG, WRONG, BETWEEN])

_DEPTHS = "array<struct<depth:int,objects:long,last:int>>"
_SUMMARY = f"source string, block long, wide boolean, quotes long, change array<long>, depths array<{_DEPTHS}>"


def structure(data: bytes, inside: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """Place, kind and depth of every byte that counts, change of depth, and 1 if the text ends inside a string.

    Strings count with their first quote only. The depth is that around the byte, brackets belonging to what is
    around them. What a backslash does ends with the next byte, so nothing but `inside` is carried into a text that
    begins with a brace.
    """
    a = np.frombuffer(data, np.uint8)
    quote, slash = a == 34, a == 92
    if slash.any():
        at = np.arange(len(a))
        plain = np.maximum.accumulate(np.where(slash, -1, at))
        quote &= np.append(0, (at - plain)[:-1]) % 2 == 0
    within = (np.cumsum(quote, dtype=np.uint8) + np.uint8(inside)) & 1
    places = np.flatnonzero(~SPACE[a] & (quote == within.astype(bool)))
    kind = KIND[a[places]]
    step = STEP[kind]
    after = np.cumsum(step)
    return places, kind, after - (step > 0), int(step.sum()), int(within[-1]) if len(a) else inside


def _meanings(kind: np.ndarray, depth: np.ndarray, array: int) -> np.ndarray:
    """What each byte means if the array's objects are at depth `array`; UNSEEN for those inside of objects."""
    said = np.where(depth == array, WITHIN[kind], UNSEEN)
    said = np.where(depth == array - 1, OUTSIDE[kind], said)
    return np.where(depth < array - 1, WRONG, said)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch, bytes]]:
    """The text of each file block, batch by batch: its file and place, its rows, and their text with the braces between."""
    before = None
    for batch in batches:
        files, blocks = batch.column("source").dictionary_encode(), batch.column("block").to_numpy()
        turns = np.flatnonzero((np.diff(files.indices.to_numpy()) != 0) | (np.diff(blocks) != 0)) + 1
        for start, end in zip([0, *turns], [*turns, batch.num_rows], strict=True):
            if end > start:
                rows = batch.slice(start, end - start)
                key = (rows.column("source")[0].as_py(), int(blocks[start]))
                text = b"}".join(rows.column("value").to_pylist())
                if key != before and key[1] == 0:
                    text = text.removeprefix(b"\xef\xbb\xbf")
                else:
                    text = b"}" + text
                yield key, rows, text
                before = key


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per file block: what it does to a reader that comes to it outside and inside of a string."""
    key, sides, wide = None, [], False

    def told() -> pa.RecordBatch:
        depths = [[{"depth": d, "objects": n, "last": s} for d, (n, s) in sorted(side["depths"].items())] for side in sides]
        row = {"source": key[0], "block": key[1], "wide": wide, "quotes": sides[0]["inside"], "change": [s["depth"] for s in sides], "depths": depths}
        entry = pa.list_(pa.struct([("depth", pa.int32()), ("objects", pa.int64()), ("last", pa.int32())]))
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.list_(entry)]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), kinds, strict=True)], list(row))

    for at, _, text in _chunks(batches):
        if at != key:
            if key:
                yield told()
            key, sides, wide = at, [{"inside": k, "depth": 0, "depths": {}} for k in (0, 1)], at[1] == 0 and text[:2] == b"\xff\xfe"
        for side in sides:
            _, kind, depth, change, side["inside"] = structure(text, side["inside"])
            depth = depth + side["depth"]
            for array in range(int(depth.min(initial=0)), int(depth.max(initial=0)) + 2):
                said = _meanings(kind, depth, array)
                said = said[said != UNSEEN]
                if len(said):
                    objects = side["depths"].get(array, (0, 0))[0]
                    side["depths"][array] = (objects + int((said == OBJECT).sum()), int(said[-1]))
            side["depth"] += change
    if key:
        yield told()


def block_states(blocks: DataFrame) -> DataFrame:
    """`source, block, inside, depth, objects, last`: where in the array each block begins; a broken array is an error."""
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    def sum_before(value: Column) -> Column:
        return F.coalesce(F.sum(value).over(before), F.lit(0))

    blocks = blocks.withColumn("wide", F.max("wide").over(Window.partitionBy("source"))).filter("NOT wide")
    out = blocks.withColumn("inside", (sum_before(F.col("quotes")) % 2).cast("int"))
    out = out.withColumn("depth", sum_before(F.get("change", F.col("inside"))).cast("int"))
    here = F.filter(F.get("depths", F.col("inside")), lambda x: x["depth"] == 1 - F.col("depth"))
    out = out.withColumn("here", F.get(here, F.lit(0)))
    out = out.withColumn("objects", sum_before(F.coalesce(F.col("here.objects"), F.lit(0))))
    out = out.withColumn("last", F.coalesce(F.last("here.last", True).over(before), F.lit(START)))
    ends = F.lead("block").over(Window.partitionBy("source").orderBy("block")).isNull()
    whole = ((F.col("inside") + F.col("quotes")) % 2 == 0) & (F.col("depth") + F.get("change", F.col("inside")) == 0)
    whole = whole & (F.coalesce(F.col("here.last"), F.col("last")) == LAST)
    wrong = F.raise_error(F.concat(F.lit(f"{NOT_ARRAY}: "), F.col("source"))).cast("boolean")
    # Part of a filter, so that it is looked at whichever columns are asked for.
    out = out.withColumn("ends", ends & ~whole).filter(F.when(F.col("ends"), wrong).otherwise(F.lit(True)))
    return out.select("source", "block", "inside", "depth", "objects", "last")


def _cut(fragments: bool):
    """Objects that lie inside a block, or, with `fragments`, what a block holds of others: `source, n, block, object`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, depth, objects, last = None, 0, 0, 0, START
        # Bytes of the object that is open, and whether it began in an earlier block.
        parts: list[bytes] = []
        earlier = False

        def rows_of(found: list[tuple[int, bytes]]) -> pa.RecordBatch:
            n, texts = zip(*found, strict=True)
            columns = [pa.array([key[0]] * len(n)), pa.array(n, pa.int64()), pa.array([key[1]] * len(n), pa.int64()), pa.array(texts, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["source", "n", "block", "object"])

        for at, rows, text in _chunks(batches):
            if at != key:
                if fragments and depth > 1 and parts:
                    yield rows_of([(objects, b"".join(parts))])
                key, parts = at, []
                inside, depth, objects, last = (rows.column(c)[0].as_py() for c in ("inside", "depth", "objects", "last"))
                earlier = depth > 1
            places, kind, around, change, inside = structure(text, inside)
            around = around + depth
            said = _meanings(kind, around, 1)
            said = np.append(last, said[said != UNSEEN])
            if not FOLLOWS[said[:-1], said[1:]].all():
                raise ValueError(f"{NOT_ARRAY}: {key[0]}")
            last = int(said[-1])
            starts = places[(kind == OPEN) & (around == 1)]
            ends = places[(kind == CLOSE) & (around == 1)] + 1
            found = []
            if depth > 1:
                parts.append(text[: ends[0]] if len(ends) else text)
                if len(ends):
                    if earlier == fragments:
                        found.append((objects, b"".join(parts)))
                    parts, earlier, ends = [], False, ends[1:]
            if not fragments:
                found += [(objects + k + 1, text[s:e]) for k, (s, e) in enumerate(zip(starts, ends, strict=False))]
            if len(starts) > len(ends):
                parts, earlier = [text[starts[-1] :]], False
            objects, depth = objects + len(starts), depth + change
            if found:
                yield rows_of(found)
        if fragments and depth > 1 and parts:
            yield rows_of([(objects, b"".join(parts))])

    return run


def read_json_objects(spark: SparkSession, path: str) -> DataFrame:
    """`source, n, object`: the text of each object of each file, which must be one array of objects.

    Files are UTF-8 with or without a mark, and of any size; only objects that lie across the edge of a file block are
    shuffled. Files that start with a UTF-16 mark are read whole. Spark's readers skip files without bytes, so those have no
    objects and are no error.
    """
    files = spark.read.option("lineSep", "}").option("recursiveFileLookup", "true").text(path)
    raw = files.select(
        F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"), F.monotonically_increasing_id().alias("_at")
    )
    blocks = raw.drop("_at").mapInArrow(_summaries, _SUMMARY)
    states = block_states(blocks)
    if len(files.inputFiles()) + files.rdd.getNumPartitions() <= BLOCKS:
        # A broadcast leaves the pieces of a block in their order.
        rows = raw.join(F.broadcast(states), ["source", "block"])
    else:
        rows = raw.join(states, ["source", "block"]).repartition("source", "block").sortWithinPartitions("source", "block", "_at")
    rows = rows.drop("_at")
    shape = "source string, n long, block long, object binary"
    inner = rows.mapInArrow(_cut(False), shape).select("source", "n", F.col("object").cast("string").alias("object"))
    parts = rows.mapInArrow(_cut(True), shape).groupBy("source", "n").agg(F.array_sort(F.collect_list(F.struct("block", "object"))).alias("all"))
    joined = F.array_join(F.transform("all", lambda x: x["object"].cast("string")), "")
    out = inner.unionByName(parts.select("source", "n", joined.alias("object")))
    return out.unionByName(_wide_objects(spark, path, blocks))


def _wide_objects(spark: SparkSession, path: str, blocks: DataFrame) -> DataFrame:
    """The objects of UTF-16 files, each read whole."""
    wide = blocks.filter("wide").select("source").distinct()
    texts = read_text_files(spark, path).join(wide, "source", "left_semi").select("source", "text")
    objects = F.from_json("text", "array<string>")
    checked = F.when(F.trim("text").startswith("[") & objects.isNotNull(), objects)
    checked = F.coalesce(checked, F.raise_error(F.lit(NOT_ARRAY)).cast("array<string>"))
    return texts.select("source", F.posexplode(checked).alias("at", "object")).select("source", (F.col("at") + 1).cast("long").alias("n"), "object")
