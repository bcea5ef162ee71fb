"""SentencePiece encoding and decoding over a relational lattice of the distinct words."""

from __future__ import annotations

import heapq
import sys
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from sievelight.llm.hashing import StretchHasher, mix, slices
from sievelight.plans.session import stored

SPACE = "▁"
UNKNOWN = -1

#: Commonest stretches whose encodings every task holds; all others meet theirs in a join.
HOT_WORDS = 300_000

#: Distinct stretches that a task counts before it hands them on.
REMEMBERED = 300_000

#: Characters of a stretch that goes through the table; a longer one is encoded where it stands.
LONG = 128

#: Characters of a stretch whose merges need no heap.
SHORT = 32


@dataclass
class PieceModel:
    """What encoding needs of a model file: its pieces with scores, its kind, and how blanks and unknown characters go."""

    kind: str
    pieces: list[tuple[int, str, float]]
    byte_ids: list[int]
    unknown_id: int
    unknown_score: float
    prefix: bool
    longest: int
    joined: frozenset[str]


def load_model(path: str) -> PieceModel:
    """The model of a SentencePiece file, `bpe` or `unigram`.

    Texts must go in unchanged but for blanks: a file with a normalisation table, removal of extra blanks or pieces that
    hold a blank after another character raises an error, and so does one of another kind.
    """
    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    kind = {1: "unigram", 2: "bpe"}.get(proto.trainer_spec.model_type)
    kinds = type(proto.pieces[0])
    normal = [(k, p.piece, p.score) for k, p in enumerate(proto.pieces) if p.type == kinds.NORMAL]
    special = [p.piece for p in proto.pieces if p.type in (kinds.USER_DEFINED,)]
    rules = proto.normalizer_spec
    if kind is None or special or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
        raise ValueError(f"a model of a kind, pieces or normalisation that is not handled: {path}")
    if any(SPACE in p.lstrip(SPACE) for _, p, _ in normal):
        raise ValueError("pieces with a blank after another character join words; they are not handled")
    bytes_ = {p.piece: k for k, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
    return PieceModel(
        kind, normal, [bytes_[f"<0x{b:02X}>"] for b in range(256)] if bytes_ else [], next(k for k, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN),
        min(s for _, _, s in normal) - 10.0, rules.add_dummy_prefix, max(len(p) for _, p, _ in normal), frozenset(a + b for _, p, _ in normal for a, b in zip(p, p[1:])),
    )


class Cutter:
    """Cuts texts between characters that are neighbours in no piece, so that no piece crosses a cut.

    Joined together, the stretches of a text are the text with each blank written as U+2581, after the model's prefix.
    """

    def __init__(self, model: PieceModel):
        letters = sorted(set("".join(model.joined)))
        self.prefix = SPACE if model.prefix else ""
        self.code = np.zeros(sys.maxunicode + 1, np.uint16)
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        self.joined = np.zeros(self.width * self.width, bool)
        self.joined[[int(self.code[ord(a)]) * self.width + int(self.code[ord(b)]) for a, b in model.joined]] = True

    def cut(self, texts: list[str | None]) -> tuple[list[bytes], np.ndarray]:
        """All stretches of all texts as UTF-8, and where each text's begin; a null or empty text has none.

        A byte that UTF-8 never has is put before each stretch, and the bytes are split there: a common stretch costs
        little more than its characters.
        """
        written = [self.prefix + t.replace(" ", SPACE) if t else "" for t in texts]
        whole = "".join(written)
        starts = np.cumsum([0, *map(len, written)])
        if not whole:
            return [], np.zeros(len(texts) + 1, np.int64)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        code = self.code[points].astype(np.int32)
        cuts = np.ones(len(whole), bool)
        cuts[1:] = ~self.joined[code[:-1] * self.width + code[1:]]
        cuts[starts[:-1][starts[:-1] < len(whole)]] = True
        at = np.flatnonzero(cuts)
        data = np.frombuffer(whole.encode(), np.uint8)
        first_bytes = np.flatnonzero((data & 0xC0) != 0x80)[at]
        marked = np.insert(data, first_bytes[1:], 0xFF).tobytes()
        return marked.split(b"\xff"), np.searchsorted(at, starts)


def is_long(stretch: bytes) -> bool:
    return len(stretch) > LONG and len(stretch.decode()) > LONG


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))


def stretch_counts(docs: DataFrame, model: PieceModel) -> DataFrame:
    """`word, n` of all stretches of up to LONG characters of `docs` (doc_id, text).

    Tasks count first and hand on what they have counted, at the latest when they remember REMEMBERED stretches.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        cutter = Cutter(model)

        def counted() -> pa.RecordBatch:
            short = [(s, n) for s, n in seen.items() if not is_long(s)]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in short], pa.binary()).cast(pa.string()), pa.array([n for _, n in short], pa.int64())], ["word", "n"])

        for batch in slices(batches, "text", limit=2 << 20):
            seen.update(cutter.cut(batch.column("text").to_pylist())[0])
            if len(seen) > REMEMBERED:
                yield counted()
        yield counted()

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _viterbi(edges: Column, length: Column) -> Column:
    """Spans of the best path: a fold over the end positions keeps the best (score, -start, id) of each.

    Of equal scores the longer last piece wins.
    """

    def best_to(state: Column, end: Column) -> Column:
        here = F.filter(edges, lambda e: e["end"] == end)
        paths = F.transform(here, lambda e: F.struct((F.get(state, e["start"])["score"] + e["score"]).alias("score"), (-e["start"]).alias("back"), e["id"].alias("id")))
        return F.concat(state, F.array(F.array_max(paths)))

    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("back"), F.lit(0).alias("id")))
    best = F.aggregate(F.sequence(F.lit(1), length), start, best_to)
    ends = F.reverse(F.sequence(F.lit(1), length))

    def step(state: Column, end: Column) -> Column:
        def back(node: Column) -> Column:
            span = F.array(F.struct((-node["back"]).alias("start"), end.alias("end"), node["id"].alias("id")))
            return F.struct((-node["back"]).alias("at"), F.concat(span, state["spans"]).alias("spans"), state["best"].alias("best"))

        return F.when(state["at"] == end, _let(F.get(state["best"], end), back)).otherwise(state)

    none = F.array().cast("array<struct<start:int,end:int,id:int>>")
    return F.aggregate(ends, F.struct(length.alias("at"), none.alias("spans"), best.alias("best")), step, lambda s: s["spans"])


def merged_pieces(stretch: str, scores: dict[str, float]) -> list[str]:
    """What is left of a stretch when neighbours merge that make up a piece of `scores`, as `merged_spans` merges them.

    Only edges that a merge asks for are looked up, and all scores are looked at for each merge: for short stretches.
    """
    none, get, parts = float("-inf"), scores.get, list(stretch)
    found = [get(x + y, none) for x, y in zip(parts, parts[1:])]
    while found and (best := max(found)) > none:
        k = found.index(best)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
        del found[k]
        if k < len(found):
            found[k] = get(parts[k] + parts[k + 1], none)
        if k:
            found[k - 1] = get(parts[k - 1] + parts[k], none)
    return parts


def merged_spans(size: int, edges: dict[tuple[int, int], float]) -> list[tuple[int, int]]:
    """Spans left when neighbours merge, best edge first, the leftmost of equals, until no two neighbours make up an edge.

    Merges wait in a heap, so a long stretch costs little more than a short one per character.
    """
    after, before = list(range(1, size + 2)), list(range(-1, size + 1))
    heap: list[tuple[float, int, int, int]] = []

    def offer(start: int) -> None:
        middle = after[start]
        if middle < size and (score := edges.get((start, after[middle]))) is not None:
            heapq.heappush(heap, (-score, start, middle, after[middle]))

    for start in range(size - 1):
        offer(start)
    while heap:
        _, start, middle, end = heapq.heappop(heap)
        if after[start] != middle or after[middle] != end:
            continue
        after[start], after[middle], before[end] = end, 0, start
        offer(start)
        if start > 0:
            offer(before[start])
    out, start = [], 0
    while start < size:
        out.append((start, after[start]))
        start = after[start]
    return out


def best_spans(size: int, edges: dict[tuple[int, int], float], longest: int, unknown: float) -> list[tuple[int, int]]:
    """The path of the greatest sum of scores, one character without an edge costing `unknown`; of equals, the longer last piece."""
    best, back = [0.0] + [0.0] * size, [0] * (size + 1)
    for end in range(1, size + 1):
        paths = [(best[a] + edges.get((a, end), unknown if a == end - 1 else float("-inf")), -a) for a in range(max(0, end - longest), end)]
        best[end], back[end] = max(paths)[0], -max(paths)[1]
    out, end = [], size
    while end:
        out.append((back[end], end))
        end = back[end]
    return out[::-1]


class Lattice:
    """The edges of stretches over the piece table, and their fold: for BPE models, and for stretches too long to be rows."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.table = {p: (k, s) for k, p, s in model.pieces}
        self.scores = {p: s for p, (_, s) in self.table.items() if len(p) > 1}
        self.heads = {p[:k] for p in self.table for k in range(2, len(p))}

    def edges(self, word: str) -> dict[tuple[int, int], float]:
        """Scores of all pieces of two characters and more, by the places that they span."""
        out, size, longest = {}, len(word), self.model.longest
        for a in range(size - 1):
            for b in range(a + 2, min(a + longest, size) + 1):
                piece = word[a:b]
                found = self.table.get(piece)
                if found is not None:
                    out[a, b] = found[1]
                if piece not in self.heads:
                    break
        return out

    def encode(self, word: str) -> list[int]:
        """Ids of the fold's spans; a character without a piece is its UTF-8 bytes, or the unknown id."""
        model = self.model
        if model.kind == "bpe" and len(word) <= SHORT:
            parts = merged_pieces(word, self.scores)
        else:
            edges = self.edges(word)
            if model.kind == "bpe":
                spans = merged_spans(len(word), edges)
            else:
                edges |= {(k, k + 1): self.table[c][1] for k, c in enumerate(word) if c in self.table}
                spans = best_spans(len(word), edges, model.longest, model.unknown_score)
            parts = [word[a:b] for a, b in spans]
        out: list[int] = []
        for part in parts:
            found = self.table.get(part)
            if found is not None:
                out.append(found[0])
            else:
                out += [model.byte_ids[x] for x in part.encode()] if model.byte_ids else [model.unknown_id]
        return out


def _ids(word: Column, spans: Column, model: PieceModel) -> Column:
    """Ids of the spans; a character without a piece is its UTF-8 bytes, or the unknown id where the model has no byte pieces."""
    if not model.byte_ids:
        return F.transform(spans, lambda s: F.when(s["id"] == UNKNOWN, model.unknown_id).otherwise(s["id"]))
    table = F.array(*[F.lit(i) for i in model.byte_ids])

    def ids(s: Column) -> Column:
        code = F.hex(F.substring(word, s["start"] + 1, F.lit(1)).cast("binary"))
        pairs = F.sequence(F.lit(1), F.length(code), F.lit(2))
        return F.transform(pairs, lambda k: F.get(table, F.conv(F.substring(code, k, F.lit(2)), 16, 10).cast("int")))

    return F.flatten(F.transform(spans, lambda s: F.when(s["id"] == UNKNOWN, ids(s)).otherwise(F.array(s["id"]))))


def encode_stretches(words: DataFrame, model: PieceModel) -> DataFrame:
    """`word, n, ids` for a table of distinct stretches with counts.

    For unigram models the lattice is a table: every substring of up to the longest piece's length meets the piece
    table, which is as large as the model's vocabulary and is broadcast; edges stay in the partition of their stretch,
    where they are grouped, so nothing moves; a single character always has an edge; and Viterbi is a Spark aggregate.

    BPE models score pieces by rank and mean merges in the order of rank, which is another fold: the best path is not
    what they encode to. Its state changes in the middle, which costs a Spark aggregate ten times as much, so stretches
    of BPE models are looked up and folded in their tasks, in Arrow batches.
    """
    if model.kind == "bpe":

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(model)
            for batch in batches:
                ids = [lattice.encode(w) for w in batch.column("word").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(ids, pa.list_(pa.int32()))], ["word", "n", "ids"])

        return words.filter("word != ''").select("word", "n").mapInArrow(fold, "word string, n long, ids array<int>")
    schema = "piece string, id int, score double"
    table = words.sparkSession.createDataFrame([(p, k, float(s)) for k, p, s in model.pieces], schema)
    length = F.length("word")
    starts = F.sequence(F.lit(0), length - 1)

    def from_(start: Column) -> Column:
        sizes = F.sequence(F.lit(1), F.least(F.lit(model.longest), length - start))
        return F.transform(sizes, lambda n: F.struct(start.alias("start"), (start + n).alias("end"), F.substring(F.col("word"), start + 1, n).alias("piece")))

    cut = words.filter("word != ''").select("word", "n", F.explode(F.flatten(F.transform(starts, from_))).alias("s")).select("word", "n", "s.*")
    met = cut.join(F.broadcast(table), "piece", "left").filter("id IS NOT NULL OR end - start = 1")
    edge = F.struct("end", "start", F.coalesce("id", F.lit(UNKNOWN)).alias("id"), F.coalesce("score", F.lit(model.unknown_score)).alias("score"))
    lattice = met.groupBy("word").agg(F.max("n").alias("n"), F.collect_list(edge).alias("edges"))
    return lattice.select("word", "n", _ids(F.col("word"), _viterbi(F.col("edges"), length), model).alias("ids"))


def encoded_segments(docs: DataFrame, dictionary: DataFrame, model: PieceModel, key: str = "doc_id", text: str = "text", hot_words: int = HOT_WORDS) -> DataFrame:
    """`doc_id, segment, ids`: the encoded documents in segments; joined in order of `segment` they are a document's ids.

    The commonest stretches, `hot_words` at most, are at hand in every task, which writes runs of them as one segment
    each. Every other stretch is a segment of its own and gets its ids from a join, where no stretch is common. Texts
    and runs are not shuffled. An empty or null text has no segments, nor has a row with a null id. Rows that share an
    id mix their segments, so ids must be unique.
    """
    docs = _texts(docs, key, text).filter("doc_id IS NOT NULL")
    hot = dictionary.orderBy(F.col("n").desc(), "word").limit(hot_words).select("word", "ids").toArrow()
    ids = hot.column("ids").combine_chunks()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))]).astype(np.int64)
    hot = docs.sparkSession.sparkContext.broadcast((hot.column("word").to_pylist(), ends, ids.flatten().to_numpy()))

    def segments(common: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(model)
            words, ends, flat = hot.value
            place = {w.encode(): k for k, w in enumerate(words)}
            cutter = Cutter(model)
            for batch in slices(batches, "text", limit=512 << 10):
                found, first = cutter.cut(batch.column("text").to_pylist())
                at = np.fromiter(map(place.get, found, repeat(-1)), np.int64, len(found))
                # Stretches too long for the table are encoded here and count as being at hand.
                long_ = [k for k in np.flatnonzero(at < 0).tolist() if is_long(found[k])]
                own = [np.array(lattice.encode(found[k].decode()), flat.dtype) for k in long_]
                bounds, all_ids = ends, flat
                if own:
                    at[long_] = len(ends) - 1 + np.arange(len(own))
                    bounds = np.concatenate([ends, ends[-1] + np.cumsum([len(x) for x in own])])
                    all_ids = np.concatenate([flat, *own])
                doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
                rare = at < 0
                # A segment begins at a document's first stretch, at a rare one, and after one.
                begins = rare.copy()
                begins[1:] |= rare[:-1] | (doc[1:] != doc[:-1])
                begins[:1] = True
                number = np.cumsum(begins) - 1
                head = np.flatnonzero(begins)
                first_of = np.full(len(first), len(head))
                np.minimum.at(first_of, doc[head], np.arange(len(head)))
                segment = np.arange(len(head)) - first_of[doc[head]]
                names = batch.column("doc_id").to_numpy(zero_copy_only=False)
                if common:
                    kept = np.flatnonzero(~rare)
                    sizes = (bounds[1:] - bounds[:-1])[at[kept]]
                    total = np.cumsum(sizes)
                    where = np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - sizes, sizes) + np.repeat(bounds[at[kept]], sizes)
                    runs = np.flatnonzero(~rare[head])
                    per_run = np.bincount(number[kept], sizes, len(head))[runs].astype(np.int64)
                    value = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_run)]).astype(np.int32)), pa.array(all_ids[where].astype(np.int32)))
                else:
                    runs = np.flatnonzero(rare[head])
                    value = pa.array([found[k] for k in head[runs].tolist()], pa.binary()).cast(pa.string())
                columns = [pa.array(names[doc[head[runs]]]), pa.array(segment[runs].astype(np.int64)), value]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "segment", "ids" if common else "word"])

        return run

    runs = docs.mapInArrow(segments(True), "doc_id long, segment long, ids array<int>")
    rare = docs.mapInArrow(segments(False), "doc_id long, segment long, word string")
    return runs.unionByName(rare.join(dictionary.select("word", "ids"), "word").drop("word"))


def build_dictionary(docs: DataFrame, model: PieceModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`word, n, ids` for every distinct stretch of the documents, in a table in the shared folder."""
    return stored(encode_stretches(stretch_counts(_texts(docs, key, text), model), model))


def decoded(ids: Column, pieces: Column, model: PieceModel) -> Column:
    """The text of an array of ids: pieces side by side, byte pieces as the UTF-8 they make up, U+2581 as blanks.

    `pieces` is an array of the piece of each id, as UTF-8 in hexadecimal; the prefix, if any, is still there.
    """
    return F.translate(F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "")), "utf-8"), SPACE, " ")


def piece_table(spark: SparkSession, model: PieceModel) -> Column:
    """The pieces of all ids in hexadecimal, by id, as one array literal's worth of a one-row table."""
    size = 1 + max([k for k, _, _ in model.pieces] + model.byte_ids)
    names = [""] * size
    for k, p, _ in model.pieces:
        names[k] = p.encode().hex()
    for b, k in enumerate(model.byte_ids):
        names[k] = f"{b:02x}"
    return spark.createDataFrame([(names,)], "pieces array<string>")


def round_trip(dictionary: DataFrame, model: PieceModel) -> DataFrame:
    """`dictionary` with `same`: whether a word's ids decode to the word. The piece table is one broadcast row."""
    pieces = F.broadcast(piece_table(dictionary.sparkSession, model))
    both = dictionary.join(pieces, F.lit(True), "left")
    return both.withColumn("same", decoded(F.col("ids"), F.col("pieces"), model) == F.translate("word", SPACE, " ")).drop("pieces")


def assembled(segments: DataFrame) -> DataFrame:
    """`doc_id, ids`: one array per document. A document's segments meet in one task, as its text did."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("segment", "ids"))), lambda s: s["ids"])
    return segments.groupBy("doc_id").agg(F.flatten(ordered).alias("ids"))


def decode_documents(encoded: DataFrame, model: PieceModel) -> DataFrame:
    """`doc_id, text` of a table of `doc_id, ids`; what bytes don't make up UTF-8 becomes U+FFFD."""
    names = piece_table(encoded.sparkSession, model).first()["pieces"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = [bytes.fromhex(p) for p in names]
        for batch in batches:
            made = [b"".join(map(pieces.__getitem__, ids or [])).decode("utf-8", "replace").replace(SPACE, " ") for ids in batch.column("ids").to_pylist()]
            made = [t[1:] if model.prefix and t.startswith(" ") else t for t in made]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def _in_parts(batch: pa.RecordBatch, limit: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The rows of a batch of segments in pieces of at most `limit` ids; a longer segment is a piece of its own."""
    sizes = np.diff(batch.column("ids").offsets.to_numpy())
    start = total = 0
    for at, size in enumerate(sizes.tolist()):
        if at > start and total + size > limit:
            yield batch.slice(start, at - start)
            start, total = at, 0
        total += size
    if len(sizes) > start:
        yield batch.slice(start)


def _hashed(strings: pa.Array, hasher: StretchHasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters, hash, power) of strings or binary strings of UTF-8."""
    ends = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    chars = pc.utf8_length(strings.view(pa.string())).cast(pa.int64()).to_numpy(zero_copy_only=False)
    return chars, *hasher(np.frombuffer(strings.buffers()[2] or b"", np.uint8), ends)


def document_digests(docs: DataFrame, segments: DataFrame, model: PieceModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id, n_tokens, n_decoded, ids_digest, whole`, one row per document.

    Every segment is decoded in its task, where its characters are counted and its bytes hashed; the hashes of a
    document's segments, in order of `segment`, make up that of its decoded text, prefix included. n_decoded counts its
    characters. `whole` says that it equals the text, whose own hash is made where the text is read: no text and no
    decoded text moves (see StretchHasher). Decoding writes U+2581 as a blank, so a text's own U+2581 counts as one. A
    segment holds whole characters. ids_digest mixes every id with its segment and place. A text without characters has no tokens. Rows
    with a null id have no segments: each is encoded and decoded where it stands, as one segment.
    """
    names = [b""] * (1 + max([k for k, _, _ in model.pieces] + model.byte_ids))
    for k, p, _ in model.pieces:
        names[k] = p.replace(SPACE, " ").encode()
    for b, k in enumerate(model.byte_ids):
        names[k] = bytes([b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, hasher = pa.array(names, pa.binary()), StretchHasher()
        for batch in (part for whole in batches for part in _in_parts(whole)):
            column = batch.column("ids")
            sizes = np.diff(column.offsets.to_numpy())
            ids, first = column.flatten().to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])
            place = np.arange(len(ids)) - np.repeat(first[:-1], sizes)
            segment = np.repeat(batch.column("segment").to_numpy(), sizes)
            mixed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(((segment << 40) + (place << 17) + ids).astype(np.uint64)))])
            # The pieces of all ids side by side in one buffer are the decoded bytes; a segment is a stretch of them.
            taken = pa.concat_arrays([pieces.take(pa.array(ids)), pa.array([b""], pa.binary())])
            ends = np.frombuffer(taken.buffers()[1], np.int32)[first].astype(np.int32)
            bytes_ = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), taken.buffers()[2]])
            if model.byte_ids and (ids == model.byte_ids[SPACE.encode()[0]]).any():
                bytes_ = pc.replace_substring(bytes_, SPACE.encode(), b" ")
            chars, hashes, powers = _hashed(bytes_, hasher)
            out = [pa.array(sizes.astype(np.int64)), pa.array((mixed[first[1:]] - mixed[first[:-1]]).astype(np.uint64).view(np.int64)), *map(pa.array, (chars, hashes, powers))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("segment"), *out], ["doc_id", "segment", "n_tokens", "ids_digest", "n_decoded", "hash", "power"])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = StretchHasher()
        for batch in slices(batches, "text", limit=256 << 10):
            said = batch.column("text")
            said = pc.replace_substring(said, SPACE, " ") if pc.any(pc.match_substring(said, SPACE)).as_py() else said
            written = pc.binary_join_element_wise(" " * model.prefix, said, "")
            _, hashes, _ = _hashed(written.fill_null(""), hasher)
            none = pc.equal(pc.binary_length(said).fill_null(0), 0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(hashes, mask=none)], ["doc_id", "hash"])

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, lattice, known = Cutter(model), Lattice(model), {}
        for batch in slices(batches, "text", limit=2 << 20):
            out = []
            for said in batch.column("text").to_pylist():
                ids: list[int] = []
                for word in cutter.cut([said])[0]:
                    if word not in known:
                        known[word] = lattice.encode(word.decode())
                    ids += known[word]
                got = b"".join(map(names.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
                mixed = mix(((np.arange(len(ids)) << 17) + np.array(ids, np.int64)).astype(np.uint64)).sum(dtype=np.uint64)
                out.append((None, len(ids), len(got), int(mixed.view(np.int64)), got == (" " * model.prefix + said.replace(SPACE, " ") if said else "")))
                if len(known) > REMEMBERED:
                    known.clear()
            types = [pa.int64()] * 4 + [pa.bool_()]
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_decoded", "ids_digest", "whole"])

    nameless = docs.filter(F.col(key).isNull()).select(F.col(text).alias("text")).mapInArrow(alone, "doc_id long, n_tokens long, n_decoded long, ids_digest long, whole boolean")
    docs = docs.filter(F.col(key).isNotNull())
    schema = "doc_id long, segment long, n_tokens long, ids_digest long, n_decoded long, hash long, power long"
    each = segments.select("doc_id", "segment", "ids").mapInArrow(run, schema).groupBy("doc_id")
    each = each.agg(
        F.sum("n_tokens").alias("n_tokens"), F.sum("n_decoded").alias("n_decoded"), F.bit_xor("ids_digest").alias("ids_digest"),
        F.collect_list(F.struct("segment", "hash", "power")).alias("_parts"),
    )
    got = StretchHasher.joined(F.array_sort("_parts"))
    each = each.select("doc_id", "n_tokens", "n_decoded", "ids_digest", got.alias("_both"))
    each = each.select("doc_id", "n_tokens", "n_decoded", "ids_digest", F.shiftleft("_both.h0", 31).bitwiseOR(F.col("_both.h1")).alias("_got"))
    texts = _texts(docs, key, text).mapInArrow(told, "doc_id long, hash long").withColumnRenamed("hash", "_want").join(each, "doc_id", "left")
    texts = texts.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_tokens", "n_decoded", "ids_digest")})
    return texts.select("doc_id", "n_tokens", "n_decoded", "ids_digest", F.col("_got").eqNullSafe(F.col("_want")).alias("whole")).unionByName(nameless)


def library(path: str) -> sentencepiece.SentencePieceProcessor:
    """The tokenizer library's own processor for a model file, to hold results against."""
    return sentencepiece.SentencePieceProcessor(model_file=path)
