"""Sharding along a Hilbert curve through metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIMS = 3


def _tables() -> tuple[list[int], list[int]]:
    """Entry corner and axis of each cell of the curve's first level, by the rule of the Gray code."""
    gray = [w ^ (w >> 1) for w in range(1 << DIMS)]
    ones = [next(k for k in range(DIMS + 1) if not w >> k & 1) for w in range(1 << DIMS)]
    entry = [0 if w == 0 else gray[(w - 1) // 2 * 2] for w in range(1 << DIMS)]
    axis = [0 if w == 0 else ones[w - 1 + w % 2] % DIMS for w in range(1 << DIMS)]
    return entry, axis


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """Index along a Hilbert curve of three whole numbers of `bits` bits, as a long.

    One fold over the bit levels from the top. The state is the index so far, the corner where the curve enters the
    present cell and its main axis; each level undoes that rotation, reads its cell from the Gray code and goes on.
    """
    entry, axis = (F.array(*[F.lit(v) for v in t]) for t in _tables())
    x, y, z = [a.cast("int") for a in axes]

    def bit(value: Column, level: Column) -> Column:
        return F.call_function("shiftright", value, level).bitwiseAND(1)

    def turned(value: Column, by: Column) -> Column:
        """`value` of three bits rotated left by 0 to 3."""
        both = F.call_function("shiftleft", value, by)
        return both.bitwiseOR(F.shiftright(both, DIMS)).bitwiseAND(7)

    def step(state: Column, level: Column) -> Column:
        cell = bit(x, level) + bit(y, level) * 2 + bit(z, level) * 4
        cell = turned(cell.bitwiseXOR(state["e"]), F.pmod(F.lit(2 * DIMS) - state["d"] - 1, F.lit(DIMS)))
        w = cell.bitwiseXOR(F.shiftright(cell, 1)).bitwiseXOR(F.shiftright(cell, 2))
        return F.struct(
            (state["h"] * 8 + w).alias("h"),
            state["e"].bitwiseXOR(turned(F.get(entry, w), F.pmod(state["d"] + 1, F.lit(DIMS)))).alias("e"),
            F.pmod(state["d"] + F.get(axis, w) + 1, F.lit(DIMS)).alias("d"),
        )

    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("e"), F.lit(0).alias("d"))
    return F.aggregate(F.array(*[F.lit(k) for k in range(bits - 1, -1, -1)]), start, step, lambda s: s["h"])


def hilbert_shards(
    docs: DataFrame, axes: list[Column], shards: int, key: str, bits: int = 4, splits: int = 1024
) -> DataFrame:
    """All columns of `docs` and curve, shard, slot: rows in curve order, cut into `shards` runs at most one row apart.

    `axes` are three columns of whole numbers from 0 to 2**bits - 1. Rows of a curve cell are ordered by a hash class of
    `key` and then by `key`, so a cell that holds a third of all rows is `splits` groups. Only counts are carried: rows
    by cell and class, and sums over at most 8**bits cells. Slots count from 0 without gaps in a shard. Rows of one key
    follow each other in an order of their own; a null key comes first; no rows give no shards.
    """
    where = docs.withColumn("curve", hilbert_index(axes, bits)).withColumn(
        "_part", F.pmod(F.xxhash64(key), F.lit(splits)).cast("int")
    )
    counts = where.groupBy("curve", "_part").agg(F.count("*").alias("_rows"))
    cells = counts.groupBy("curve").agg(F.sum("_rows").alias("_cell"))
    before = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        "curve",
        F.coalesce(F.sum("_cell").over(before), F.lit(0)).alias("_before"),
        F.sum("_cell").over(Window.partitionBy()).alias("_total"),
    )
    inside = Window.partitionBy("curve").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("curve", "_part", F.coalesce(F.sum("_rows").over(inside), F.lit(0)).alias("_inside"))
    starts = counts.join(cells, "curve").select("curve", "_part", (F.col("_before") + F.col("_inside")).alias("_start"), "_total")
    place = F.row_number().over(Window.partitionBy("curve", "_part").orderBy(key, *_ties(docs, key)))
    ranked = where.withColumn("_place", place).join(starts, ["curve", "_part"])
    ranked = ranked.withColumn("_rank", F.col("_start") + F.col("_place") - 1)
    ranked = ranked.withColumn("shard", F.expr(f"_rank * {shards} div _total").cast("int"))
    slot = F.col("_rank") - F.expr(f"(shard * _total + {shards - 1}) div {shards}")
    return ranked.select(*docs.columns, "curve", "shard", slot.alias("slot"))


def _ties(docs: DataFrame, key: str) -> list[str]:
    """The other plain columns, so that rows of one key have an order of their own."""
    plain = ("string", "bigint", "int", "double", "boolean")
    return [c for c, kind in docs.dtypes if c != key and kind in plain]


def log_class(value: Column, top: int) -> Column:
    """0 to `top`: a number's binary order of magnitude, larger ones counting as the top."""
    return F.least(F.floor(F.log2(F.greatest(value, F.lit(1)))), F.lit(top)).cast("int")


def hash_class(value: Column, count: int) -> Column:
    """0 to `count` - 1 for a name; null counts as a name of its own."""
    return F.pmod(F.crc32(F.coalesce(value, F.lit("")).cast("binary")), F.lit(count)).cast("int")
