"""Fill-in-middle by block rotation inside one buffer per text, and the exact way back."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm.hashing import slices, utf8

#: Bytes that part words: the space, and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Marks(NamedTuple):
    """The sentinels in front of prefix, suffix and middle. None may begin inside another or lie across its edge."""

    prefix: bytes = b"<P>"
    suffix: bytes = b"<S>"
    middle: bytes = b"<M>"


def unit_ends(data: bytes) -> np.ndarray:
    """Where each unit of a text ends: a word with the space before it; space at the end of the text is a unit of its own."""
    space = SPACE[np.frombuffer(data, np.uint8)]
    ends = np.flatnonzero(~space & np.append(space[1:], True)) + 1
    return np.append(ends, len(data)) if len(data) and space[-1] else ends


def draws(seed: int, key: int | None) -> tuple[int, int, int, int]:
    """Four 32-bit numbers that follow from seed and key alone; a null key reads as empty text."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4))


def reverse(buffer: bytearray, start: int, end: int) -> None:
    buffer[start:end] = buffer[start:end][::-1]


def rotate(buffer: bytearray, start: int, cut: int, end: int) -> None:
    """Exchanges the neighbours [start, cut) and [cut, end) by three reversals; the buffer keeps its length."""
    reverse(buffer, start, cut)
    reverse(buffer, cut, end)
    reverse(buffer, start, end)


def to_middle(data: bytes, first: int, second: int, form: str, marks: Marks) -> bytearray:
    """Prefix, middle and suffix (cut at `first` and `second`) with sentinels, the middle moved to the end.

    The buffer starts as prefix, middle, suffix, each behind its sentinel. `psm` exchanges middle and suffix; `spm`
    exchanges the suffix with all before it.
    """
    buffer = bytearray(data)
    buffer[second:second] = marks.suffix
    buffer[first:first] = marks.middle
    buffer[0:0] = marks.prefix
    middle = len(marks.prefix) + first
    suffix = middle + len(marks.middle) + second - first
    rotate(buffer, middle if form == "psm" else 0, suffix, len(buffer))
    return buffer


def from_middle(output: bytes, form: str, marks: Marks) -> bytes:
    """The text again, from the output and its form: the rotation is turned back and the sentinels are cut out."""
    if form == "plain":
        return output
    buffer = bytearray(output)
    middle = buffer.index(marks.middle)
    if form == "psm":
        start = buffer.index(marks.suffix)
        rotate(buffer, start, middle, len(buffer))
    else:
        rotate(buffer, 0, buffer.index(marks.prefix), len(buffer))
    for mark in (marks.suffix, marks.middle, marks.prefix):
        at = buffer.index(mark)
        del buffer[at : at + len(mark)]
    return bytes(buffer)


def code_points(data: bytes) -> int:
    return int(np.count_nonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80))


def transform_text(data: bytes, key: int | None, seed: int, share: int, spm_share: int, marks: Marks) -> tuple:
    """n, form, prefix_chars, middle_chars and output of one text."""
    ends = unit_ends(data)
    n = len(ends)
    h1, h2, h3, h4 = draws(seed, key)
    if not data or h3 % 100 >= share or any(m in data for m in marks):
        return n, "plain", None, None, data
    few, many = sorted((h1 % (n + 1), h2 % (n + 1)))
    first, second = (int(ends[k - 1]) if k else 0 for k in (few, many))
    form = "spm" if h4 % 100 < spm_share else "psm"
    return n, form, code_points(data[:first]), code_points(data[first:second]), bytes(to_middle(data, first, second, form, marks))


def fill_in_middle(
    docs: DataFrame, key: str = "doc_id", text: str = "text", keep: Sequence[str] = (), seed: int = 42, share: int = 50, spm_share: int = 80, marks: Marks = Marks(),
    restored: bool = False,
) -> DataFrame:
    """`key`, the columns `keep`, `n`, `form`, `prefix_chars`, `middle_chars` and `output` of every row.

    Whole texts are cut into `n` units at two places that seed and key decide. Of 100 texts `share` are transformed, of
    those `spm_share` with the suffix first (spm), others with the prefix first (psm); the rest stays as it is (plain),
    and so do null and empty texts, whose output is empty, and texts with a sentinel in them. Rows of one id have the
    same draws and are transformed each; a null id reads as empty text. Columns of `docs` not named do no harm. With
    `restored` each output is turned back where it was made, as `restore_text` does, which saves a second pass of Python.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            ids, texts = batch.column("_key").to_pylist(), utf8(batch.column("_text"))
            made = [transform_text(t, k, seed, share, spm_share, marks) for k, t in zip(ids, texts, strict=True)]
            n, form, before, middle, output = zip(*made, strict=True)
            added = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary())]
            if restored:
                added.append(pa.array([from_middle(o, f, marks) for o, f in zip(output, form, strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + added, [*names, *made_names])

    names = [key, *keep]
    made_names = ["n", "form", "prefix_chars", "middle_chars", "output", *(["restored"] if restored else [])]
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", n long, form string, prefix_chars long, middle_chars long, output binary"
    schema += ", restored binary" if restored else ""
    rows = docs.select(*names, F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, schema)
    return rows.withColumns({c: F.col(c).cast("string") for c in made_names[4:]})


def restore_text(rows: DataFrame, keep: Sequence[str] = ("doc_id",), output: str = "output", form: str = "form", marks: Marks = Marks()) -> DataFrame:
    """The columns `keep` and `restored`, the text that each `output` came from. A null output gives empty text, a null form is plain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_output"):
            outputs, forms = utf8(batch.column("_output")), batch.column("_form").to_pylist()
            back = [from_middle(o, f or "plain", marks) for o, f in zip(outputs, forms, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(back, pa.binary())], [*keep, "restored"])

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", restored binary"
    made = rows.select(*keep, F.col(output).alias("_output"), F.col(form).alias("_form")).mapInArrow(run, schema)
    return made.withColumn("restored", F.col("restored").cast("string"))
