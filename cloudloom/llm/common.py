"""What the text operators share: staged tables, bounded slices of Arrow batches, hashed words."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..staging import shared_dir as shared_dir
from ..staging import shipped
from ..staging import staged as staged

#: Bytes of text that one step of numpy work takes at once (its temporaries are some 60 times as large).
SLICE_BYTES = 1 << 18
#: Words of more bytes are hashed one by one.
LONG_WORD = 1 << 12
#: Rows of an Arrow batch at most: with whole texts in it, a batch of Spark's default of 10,000 rows is too large.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """df.mapInArrow with this package on the executors, and whole texts in batches of BATCH_ROWS at most."""
    shipped(df.sparkSession)
    if int(df.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return df.mapInArrow(run, schema)


def grouped(df: DataFrame, key: str, run: Callable, schema: str) -> DataFrame:
    """df.groupBy(key).applyInArrow with this package on the executors."""
    shipped(df.sparkSession)
    return df.groupBy(key).applyInArrow(run, schema)


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The rows of batch in order, cut so that the text column of each part has about SLICE_BYTES bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // SLICE_BYTES
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)]):
        if b > a:
            yield batch.slice(a, b - a)


class Piece(NamedTuple):
    """Rows and their words, or a part of one long text. A part but the first begins with the `again` last words of the
    part before; `first` is the place in the text of its first word, `byte` that of its first byte; `last` is false while
    more parts follow."""

    rows: pa.RecordBatch
    words: "Words"
    is_part: bool = False
    first: int = 0
    again: int = 0
    last: bool = True
    byte: int = 0


def pieces(batch: pa.RecordBatch, text: int, overlap: int) -> Iterator[Piece]:
    """The rows of batch in order, some SLICE_BYTES of text at a time. A text of more than twice that size comes alone,
    in parts cut between words that have `overlap` words in common (all of a part, if it has fewer)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    a = 0
    for long in [*np.flatnonzero(sizes > 2 * SLICE_BYTES).tolist(), len(sizes)]:
        if long > a:
            for part in slices(batch.slice(a, long - a), text):
                yield Piece(part, Words(part.column(text)))
        if long < len(sizes):
            row = batch.slice(long, 1)
            data = np.frombuffer(row.column(text)[0].as_buffer(), np.uint8)
            start = end = first = again = 0
            while end < len(data):
                end = _separator(data, end + SLICE_BYTES)
                words = Words(pa.LargeStringArray.from_buffers(1, pa.py_buffer(np.array([0, end - start])), pa.py_buffer(data[start:end])))
                yield Piece(row, words, True, first, again, end == len(data), start)
                n = len(words.starts)
                again = min(overlap, n)
                first += n - again
                start = start + int(words.starts[n - again]) if again else end
        a = long + 1


def _separator(data: np.ndarray, at: int) -> int:
    """The first separator from there on, or the end."""
    while at < len(data):
        found = np.flatnonzero(_SEPARATES[data[at : at + SLICE_BYTES]])
        if len(found):
            return at + int(found[0])
        at += SLICE_BYTES
    return len(data)


# Words are runs of bytes other than these (fixed values of the word rule; all are ASCII, so UTF-8 bytes will do).
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_SEPARATES = np.zeros(256, bool)
_SEPARATES[list(SEPARATORS)] = True
_SEED = np.random.default_rng(20240229)
_BASES = [int(x) | 1 for x in _SEED.integers(1 << 62, 1 << 63, 2, dtype=np.uint64)]
_BYTE_VALUES = _SEED.integers(0, 1 << 64, (2, 256), dtype=np.uint64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. n-1 of the lane's base modulo 2^64, and of its inverse."""
    if lane not in _POWERS or len(_POWERS[lane][0]) < n:
        both = []
        for base in (_BASES[lane], pow(_BASES[lane], -1, 1 << 64)):
            p = np.full(max(n, 1 << 16), base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[lane] = tuple(both)
    return tuple(p[:n] for p in _POWERS[lane])


def runs(values: np.ndarray, starts: np.ndarray, stops: np.ndarray, lane: int = 0) -> np.ndarray:
    """Rabin-Karp: polynomial hashes of values[start:stop], each in constant time from prefix sums."""
    up, down = powers(lane, len(values) + 1)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=prefix[1:])
    return mix((prefix[stops] - prefix[starts]) * down[starts])


class Words:
    """The words of a string column. starts, stops: byte ranges in data; first: index of each row's first word, and the end."""

    def __init__(self, column: pa.Array, fold_case: bool = False):
        column = pc.fill_null(column, "").cast(pa.large_string())
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        self.data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        self.rows = at - at[0]
        n = len(self.data)
        if fold_case and n:
            upper = (self.data >= 65) & (self.data <= 90)
            self.data = self.data + upper.astype(np.uint8) * np.uint8(32)
        inside = ~_SEPARATES[self.data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        at = self.rows[:-1][self.rows[:-1] < n]
        begins[at] = inside[at]
        at = self.rows[1:][self.rows[1:] > 0] - 1
        ends[at] = inside[at]
        self.starts, self.stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, self.rows)
        self.counts = np.diff(self.first)

    def hashes(self, lane: int = 0) -> np.ndarray:
        """A hash of each word; SLICE_BYTES bytes at a time, however long the words are."""
        out = np.empty(len(self.starts), np.uint64)
        a = 0
        for long in [*np.flatnonzero(self.stops - self.starts > LONG_WORD).tolist(), len(out)]:
            while a < long:
                b = min(max(int(np.searchsorted(self.stops, self.starts[a] + SLICE_BYTES, "right")), a + 1), long)
                at, to = self.starts[a], self.stops[b - 1]
                out[a:b] = runs(_BYTE_VALUES[lane][self.data[at:to]], self.starts[a:b] - at, self.stops[a:b] - at, lane)
                a = b
            if long < len(out):
                word = hashlib.blake2b(self.data[self.starts[long] : self.stops[long]], digest_size=8, key=b"%d" % lane)
                out[long] = int.from_bytes(word.digest(), "little")
            a = long + 1
        return out

    def joined(self, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The kept words (all, if none are named) of each row, joined by one space: the bytes, and each row's range in them."""
        row = np.repeat(np.arange(len(self.counts)), self.counts)
        starts, stops = self.starts, self.stops
        if kept is not None:
            row, starts, stops = row[kept], starts[kept], stops[kept]
        step = np.zeros(len(self.data) + 1, np.int8)
        step[starts] += 1
        step[stops] -= 1
        inside = np.cumsum(step[:-1], dtype=np.int8) > 0
        blank = starts[1:][row[1:] == row[:-1]] - 1  # what stands before a word that isn't its row's first is a separator
        data = self.data.copy()
        data[blank] = 0x20
        inside[blank] = True
        return data[inside], np.concatenate([[0], np.cumsum(inside)])[self.rows]

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all windows of size words within one row: the row, the place in the row, the index of the first word."""
        n = np.maximum(self.counts - size + 1, 0)
        row = np.repeat(np.arange(len(n)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return row, place, self.first[row] + place


class Joined:
    """The kept words of one text, which comes in parts, joined by one space: their digest and, if wanted, text."""

    def __init__(self, empty_hash: "hashlib._Hash", with_text: bool = False):
        self.hash, self.with_text = empty_hash, with_text
        self.begun, self.parts = False, []

    def add(self, words: bytes) -> None:
        if words:
            words = b" " + words if self.begun else words
            self.begun = True
            self.hash.update(words)
            if self.with_text:
                self.parts.append(words)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
