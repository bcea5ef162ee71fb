"""A Merkle manifest of a dataset: a tree per group, a tree over the groups, and a proof per row by pointer jumping."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.plans.blocks import global_rank
from sievelight.plans.session import stored
from sievelight.plans.sizing import is_small
from sievelight.plans.skew import lookup

#: Children of a node, and levels that are built in one group: it holds ARITY ** BAND digests at most.
ARITY, BAND = 3, 6
#: The tree over the groups' roots.
TOP = -1
#: Rows of a table of 32-byte digests and proof segments that may be broadcast.
SMALL = 100_000

STEP = "array<struct<left:binary,right:binary>>"
_NODE = ("tree", "level", "pos")


def field(value: Column) -> Column:
    """A value as it enters a digest: `-` if null, else its UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 of all fields of a row, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(field, fields)), 256))


def hex_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _joined(digests: Column) -> Column:
    """Bytes of several digests, one after the other."""
    return F.aggregate(digests, F.lit(b""), lambda all_, one: F.concat(all_, one))


def _parent(digests: Column) -> Column:
    return F.unhex(F.sha2(hex_of(_joined(digests)), 256))


def _above(digests: Column) -> Column:
    """The parents of a level, run by run."""
    return F.transform(F.sequence(F.lit(1), F.size(digests), F.lit(ARITY)), lambda at: _parent(F.slice(digests, at, ARITY)))


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(steps, leaf, lambda seen, s: F.unhex(F.sha2(F.concat(hex_of(s["left"]), hex_of(seen), hex_of(s["right"])), 256)))


def proof_digest(steps: Column) -> Column:
    """SHA-256 over the hex of all siblings, from the leaf's to the root's, as hex."""
    return F.sha2(hex_of(F.aggregate(steps, F.lit(b""), lambda all_, s: F.concat(all_, s["left"], s["right"]))), 256)


def _height(n: Column) -> Column:
    """Levels above `n` leaves: the least h with ARITY ** h >= n."""
    return F.size(F.filter(F.array(*[F.lit(ARITY**k).cast("long") for k in range(39)]), lambda p: p < n))


def _bands(nodes: DataFrame) -> list[DataFrame]:
    """The levels of all trees: tables of `tree, height, base, block, levels, rows`.

    nodes: `tree, height, pos, digest, row`. A group holds the nodes of `ARITY ** BAND` neighbours and makes BAND levels of
    them, so a tree of any height takes a shuffle per BAND levels and no group grows with the data.
    """
    out, base = [], 0
    while True:
        size = ARITY**BAND
        met = nodes.groupBy("tree", "height", F.floor(F.col("pos") / size).alias("block")).agg(
            F.array_sort(F.collect_list(F.struct("pos", "digest", "row"))).alias("nodes")
        )
        met = met.select("tree", "height", F.lit(base).alias("base"), "block", F.transform("nodes", lambda x: x["digest"]).alias("l0"), F.transform("nodes", lambda x: x["row"]).alias("rows"))
        for k in range(BAND):
            met = met.withColumn(f"l{k + 1}", F.when(F.col("height") > base + k, _above(F.col(f"l{k}"))))
        levels = F.filter(F.array(*[f"l{k}" for k in range(BAND + 1)]), lambda x: x.isNotNull())
        out.append(stored(met.select("tree", "height", "base", "block", levels.alias("levels"), "rows")))
        base += BAND
        rising = out[-1].filter(F.col("height") > base)
        if rising.isEmpty():
            return out
        nodes = rising.select("tree", "height", F.col("block").alias("pos"), F.get("levels", F.lit(BAND))[0].alias("digest"), F.lit(None).cast(nodes.schema["row"].dataType).alias("row"))


def _roots(bands: list[DataFrame]) -> DataFrame:
    """`tree, digest` of each tree."""
    done = [
        b.filter((F.col("height") <= F.col("base") + BAND) & (F.col("height") >= F.col("base"))).select("tree", F.get("levels", F.col("height") - F.col("base"))[0].alias("digest"))
        for b in bands
    ]
    return reduce(DataFrame.unionByName, done)


def _step(digests: Column, i: Column) -> Column:
    """What stands left and right of the digest at place `i` in its run."""
    at, last = i % ARITY, F.least(F.size(digests), i - i % ARITY + ARITY)
    return F.struct(_joined(F.slice(digests, i - at + 1, at)).alias("left"), _joined(F.slice(digests, i + 2, last - i - 1)).alias("right"))


def _level_nodes(k: int, leaves: bool) -> Column:
    """The nodes of a band's level `k` as structs; NULL where the tree does not reach above that level."""
    digests, level, tree, height = F.get("levels", F.lit(k)), F.col("base") + k, F.col("tree"), F.col("height")
    rises = level < height
    to_top = (tree != TOP) & (level + 1 >= height)

    def node(digest: Column, i: Column) -> Column:
        pos = F.col("block") * F.lit(ARITY ** (BAND - k)).cast("long") + i
        return F.struct(
            tree.alias("tree"),
            level.alias("level"),
            pos.alias("pos"),
            F.when(to_top, TOP).otherwise(tree).cast("long").alias("up_tree"),
            F.when(to_top, 0).otherwise(level + 1).cast("int").alias("up_level"),
            F.when(to_top, tree).otherwise(F.floor(pos / ARITY)).cast("long").alias("up_pos"),
            F.when(rises, F.array(_step(digests, i))).otherwise(F.array().cast(STEP)).alias("steps"),
            *([F.get("rows", i).alias("row")] if leaves else []),
        )

    return F.when(rises | F.lit(leaves), F.transform(digests, node))


def _segments(bands: list[DataFrame], leaves: bool) -> DataFrame:
    """Nodes with the step to their parent: `tree, level, pos, up_tree, up_level, up_pos, steps`, and `row` if for leaves only.

    The root of a group's tree is the leaf of the top tree with the group's number. A leaf that is its tree's root stands
    for that node and has no step yet. The root of the top tree is no row.
    """
    made = []
    for band in bands[:1] if leaves else bands:
        nodes = F.array(*[_level_nodes(k, leaves) for k in ([0] if leaves else range(BAND))])
        made.append(band.select(F.explode(F.flatten(F.filter(nodes, lambda x: x.isNotNull()))).alias("x")).select("x.*"))
    return reduce(DataFrame.unionByName, made)


def _jump(nodes: DataFrame, inner: DataFrame) -> DataFrame:
    """Every node's pointer goes on to where its ancestor points, and the ancestor's segment is appended.

    Nodes whose ancestor is the root stay as they are. The ancestors are broadcast if counted to be few; else a node has
    few descendants per key, or is hot and its row is broadcast alone.
    """
    seen = inner.select(*[F.col(c).alias(f"up_{c}") for c in _NODE], *[F.col(f"up_{c}").alias(f"next_{c}") for c in _NODE], F.col("steps").alias("more"))
    on = [f"up_{c}" for c in _NODE]
    out = nodes.join(F.broadcast(seen), on, "left") if is_small(inner, SMALL) else nodes.join(seen, on, "left")
    known = F.col("next_tree").isNotNull()
    moved = [F.when(known, F.col(f"next_{c}")).otherwise(F.col(f"up_{c}")).alias(f"up_{c}") for c in _NODE]
    steps = F.when(known, F.concat("steps", "more")).otherwise(F.col("steps")).alias("steps")
    kept = [c for c in nodes.columns if c not in (*on, "steps")]
    return out.select(*kept, *moved, steps)


def _proofs(leaves: DataFrame, inner: DataFrame, longest: int) -> DataFrame:
    """`row, tree, steps`: each leaf's segment up to the root, by as many jumps as double the distance beyond `longest`.

    After k jumps pointers span 2 ** k levels. Inside a group's tree only nodes at multiples of that are still pointed to, so
    the table of ancestors shrinks with every jump; the top tree, which groups of all heights meet, stays whole.
    """
    reach = 1
    while reach <= longest:
        leaves = _jump(leaves, inner)
        needed = inner.filter((F.col("tree") == TOP) | (F.col("level") % (2 * reach) == 0))
        inner, reach = stored(_jump(needed, inner)), 2 * reach
    return leaves.select("row", "tree", "steps")


def merkle_proofs(rows: DataFrame, group: str = "source", key: str = "doc_id", digest: str = "leaf", keep: Sequence[str] = ()) -> DataFrame:
    """`group, key, digest`, the columns `keep`, `subroot`, `root` (32 bytes each) and `steps`, one row per row.

    rows: one 32-byte digest each. Rows of a group become leaves in the order of `key`, nulls first, equal keys by digest; runs
    of ARITY neighbours (the last may be shorter) become their parent until one node is left, the group's root. Groups in
    the order of their name, null first, are the leaves of one more tree. `steps` holds, per level from leaf to root, the
    digests left and right of the node in its run, one after the other. Repeated rows are leaves each. No rows give none.
    """
    named = [group, key, digest, *keep]
    source = rows.select(F.col(group).alias("_group"), F.col(key).alias("_key"), F.col(digest).alias("_digest"), F.struct(*named).alias("row"))
    # Equal rows may be many: the last sort column scatters them, and which is which makes no difference.
    placed = stored(global_rank(source.withColumn("_tie", F.monotonically_increasing_id()), ["_group", "_key", "_digest", "_tie"], "_rank"))
    facts = placed.groupBy("_group").agg(F.min("_rank").alias("_from"), F.count("*").alias("_n"))
    facts = stored(global_rank(facts, ["_from"], "tree").withColumn("height", _height(F.col("_n"))))
    sizes = facts.agg(F.count("*"), F.max("height")).first()
    groups, tallest = sizes[0], sizes[1] or 0
    top_height = next(h for h in range(64) if ARITY**h >= groups)

    keyed = facts.select(F.coalesce(F.concat(F.lit("="), F.col("_group").cast("string")), F.lit("-")).alias("_name"), "_from", "tree", "height")
    named_rows = placed.withColumn("_name", F.coalesce(F.concat(F.lit("="), F.col("_group").cast("string")), F.lit("-")))
    few = groups <= SMALL
    met = named_rows.join(F.broadcast(keyed), "_name") if few else lookup(named_rows, keyed, ["_name"])
    nodes = met.select("tree", "height", (F.col("_rank") - F.col("_from")).alias("pos"), F.col("_digest").alias("digest"), "row")
    bands = _bands(nodes)
    subroots = stored(_roots(bands))
    none = F.lit(None).cast("string").alias("row")
    top = _bands(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(top_height).alias("height"), F.col("tree").alias("pos"), "digest", none))
    root = _roots(top).first()
    inner = _segments(bands, False).unionByName(_segments(top, False))
    # Leaves are no ancestors, apart from the top tree's.
    inner = stored(inner.filter((F.col("tree") == TOP) | (F.col("level") > 0)))
    proofs = _proofs(_segments(bands, True), inner, tallest + top_height)
    subroots = subroots.select("tree", F.col("digest").alias("subroot"))
    out = proofs.join(F.broadcast(subroots), "tree") if few else lookup(proofs, subroots, ["tree"])
    return out.select("row.*", "subroot", F.lit(bytes(root["digest"]) if root else None).cast("binary").alias("root"), "steps")
