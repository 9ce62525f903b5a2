"""Operator 5, removal of word windows that repeat across documents.

Every window of `size` consecutive words has a Rabin-Karp hash (two 64-bit lanes), rolled in numpy. Spark counts the
windows: the least doc_id of each is found, and windows that start in a later document are merged into maximal
removal intervals.

Only windows that can repeat are shuffled. The words of a window hold one least-hashed run of `anchor` words; equal
windows have equal runs, so a window whose run occurs in no other document repeats nowhere. Documents without a
shared run, and documents whose whole word sequence has an earlier copy, are decided without their windows.

A long text is worked on in overlapping parts, so memory is bounded by the part. A null text has no words; texts under
`size` words lose nothing; rows of one doc_id, with equal or different texts, are each judged against smaller doc_ids
only; null doc_ids neither lose nor cause losses. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Joined, Words, mapped, mix, pieces, runs, signed, staged, table

WINDOW = 50
ANCHOR = 8


def window_minima(values: np.ndarray, row: np.ndarray, span: int) -> np.ndarray:
    """For each i the index of the least of values[i : i + span], the first of equals; the caller keeps to one row.

    Blocks of span values: the least from each place to its block's end, and from each block's start to the place."""
    n = len(values)
    if not n:
        return np.zeros(0, np.int64)
    size = -(-n // span) * span
    place = np.arange(size)
    v = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    v[:n] = values

    def prefix_least(block: np.ndarray, where: np.ndarray) -> np.ndarray:
        least = np.minimum.accumulate(block, axis=1)
        fresh = np.ones(block.shape, bool)
        fresh[:, 1:] = block[:, 1:] < least[:, :-1]
        at = np.maximum.accumulate(np.where(fresh, np.arange(span), 0), axis=1)
        return np.take_along_axis(where, at, axis=1)

    def suffix_least(block: np.ndarray, where: np.ndarray) -> np.ndarray:
        back, w = block[:, ::-1], where[:, ::-1]
        least = np.minimum.accumulate(back, axis=1)
        fresh = np.ones(block.shape, bool)
        fresh[:, 1:] = back[:, 1:] <= least[:, :-1]
        at = np.maximum.accumulate(np.where(fresh, np.arange(span), 0), axis=1)
        return np.take_along_axis(w, at, axis=1)[:, ::-1]

    blocks, where = v.reshape(-1, span), place.reshape(-1, span)
    left, right = suffix_least(blocks, where).reshape(-1), prefix_least(blocks, where).reshape(-1)
    end = np.minimum(np.arange(n) + span - 1, size - 1)
    a, b = left[:n], right[end]
    return np.where(v[a] <= v[b], a, b)


class Windowed:
    """Hashed words, their windows, and each window's anchor."""

    def __init__(self, words: Words):
        self.words = words
        self.hashes = [words.hashes(k) for k in (0, 1)]
        self.row, self.place, self.at = words.windows(WINDOW)
        first = np.arange(max(len(self.hashes[0]) - ANCHOR + 1, 0))
        found = runs(self.hashes[0], first, first + ANCHOR)
        least = window_minima(mix(found), first, WINDOW - ANCHOR + 1)
        self.anchor = found[least[self.at]] if len(self.at) else np.zeros(0, np.uint64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, anchor)."""
        new = np.ones(len(self.row), bool)
        new[1:] = (self.row[1:] != self.row[:-1]) | (self.anchor[1:] != self.anchor[:-1])
        row, anchor = self.row[new], self.anchor[new]
        order = np.lexsort((anchor, row))
        row, anchor = row[order], anchor[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])
        return row[new], anchor[new]


_SUMMARY = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64()), ("whole", pa.binary()), ("anchors", pa.list_(pa.int64()))])


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        whole, n, found = Joined(hashlib.sha256()), 0, []
        for part, words, is_part, _, again, last, _ in pieces(batch, 2, WINDOW - 1):
            row, anchor = Windowed(words).anchors()
            if not is_part:
                data, at = words.joined()
                sha = [hashlib.sha256(data[a:b]).digest() for a, b in zip(at, at[1:])]
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)), pa.int32()), pa.array(signed(anchor)))
                counts = pa.array(words.counts, pa.int64())
            else:
                kept = np.arange(len(words.starts)) >= again
                whole.add(words.joined(kept)[0].tobytes())
                n += int(kept.sum())
                found.append(anchor)
                if not last:
                    continue
                sha, counts, lists = [whole.hash.digest()], pa.array([n], pa.int64()), pa.array([signed(np.unique(np.concatenate(found)))], pa.list_(pa.int64()))
                whole, n, found = Joined(hashlib.sha256()), 0, []
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), counts, pa.array(sha, pa.binary()), lists], schema=_SUMMARY)


_WINDOWS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("h0", pa.int64()), ("h1", pa.int64()), ("place", pa.int32()), ("later", pa.bool_())])


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows whose anchor is shared; later: an earlier document has the anchor too."""
    for batch in batches:
        for part, words, _, begin, _, _, _ in pieces(batch, 2, WINDOW - 1):
            w = Windowed(words)
            shared = part.column(3)
            row = np.repeat(np.arange(part.num_rows), pa.compute.list_value_length(shared).to_numpy(zero_copy_only=False))
            flat = shared.flatten()
            anchor = flat.field("anchor").to_numpy(zero_copy_only=False).view(np.uint64)
            later = flat.field("later").to_numpy(zero_copy_only=False)
            # within a row, anchors are few and distinct: (row, anchor) as one sortable key
            key = mix(anchor) + row.astype(np.uint64)
            order = np.argsort(key)
            key, later = key[order], later[order]
            own = mix(w.anchor) + w.row.astype(np.uint64)
            at = np.minimum(np.searchsorted(key, own), max(len(key) - 1, 0))
            hit = key[at] == own if len(key) else np.zeros(len(own), bool)
            first = w.at[hit]
            h = [pa.array(signed(runs(w.hashes[k], first, first + WINDOW, k))) for k in (0, 1)]
            of = pa.array(w.row[hit])
            yield pa.RecordBatch.from_arrays([part.column(0).take(of), part.column(1).take(of), *h, pa.array(begin + w.place[hit], pa.int32()), pa.array(later[at[hit]])], schema=_WINDOWS)


_KEPT = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))])


def merge(starts: np.ndarray, size: int) -> np.ndarray:
    """Maximal intervals (start, stop) of words that windows at starts cover."""
    starts = np.sort(starts)
    first = np.ones(len(starts), bool)
    first[1:] = starts[1:] > starts[:-1] + size
    last = np.append(first[1:], True)
    return np.stack([starts[first], starts[last] + size], axis=1)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = Joined(hashlib.sha256(), True)
        for part, words, _, begin, again, last, _ in pieces(batch, 2, WINDOW - 1):
            cuts = [merge(x.values.to_numpy(), WINDOW) for x in part.column(3)]
            step = np.zeros(len(words.starts) + 1, np.int32)
            for row, cut in enumerate(cuts):
                a, b = words.first[row], words.first[row + 1]
                np.add.at(step, np.clip(cut[:, 0] - begin + a, a, b), 1)
                np.add.at(step, np.clip(cut[:, 1] - begin + a, a, b), -1)
            kept = np.cumsum(step[:-1]) == 0
            kept[:again] = False
            data, at = words.joined(kept)
            out = []
            for row, cut in enumerate(cuts):
                text.add(data[at[row] : at[row + 1]].tobytes())
                if last:
                    out.append({"doc_id": part.column(0)[row].as_py(), "key": part.column(1)[row].as_py(), "n_removed": int((cut[:, 1] - cut[:, 0]).sum()), "kept_sha256": text.hash.hexdigest(), "kept_text": b"".join(text.parts).decode(), "removed": [{"start": a, "stop": b} for a, b in cut.tolist()]})
                    text = Joined(hashlib.sha256(), True)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_KEPT)


def repeated_passages(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(all, cut). all: doc_id, n_words, n_removed, kept_sha256 of each row of docs. cut: doc_id, n_removed, kept_sha256,
    kept_text, removed (intervals of words) of the documents that lose words and aren't later copies of a whole document."""
    # rows are known by doc_id and a hash of their text: rows of one doc_id may have different texts
    named = docs.select("doc_id", F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    summary = staged(mapped(named, _summarise, "doc_id long, key long, n_words long, whole binary, anchors array<long>"), "summary")
    long = summary.filter(F.col("doc_id").isNotNull() & (F.col("n_words") >= WINDOW))
    # owners are staged before they are joined to the same rows: both sides are then shuffled, so that a large group can be split
    originals = staged(long.groupBy("whole").agg(F.min("doc_id").alias("first")), "originals")
    first = staged(long.select("doc_id", "key", "whole").join(originals, "whole").filter("doc_id = first").select("doc_id", "key").distinct(), "firsts")

    anchors = long.select("doc_id", "key", F.explode("anchors").alias("anchor"))
    owners = staged(anchors.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("anchor", "lo"), "owners")
    shared = anchors.join(first, ["doc_id", "key"], "left_semi").join(owners, "anchor").select("doc_id", "key", F.struct("anchor", (F.col("doc_id") > F.col("lo")).alias("later")).alias("s"))
    shared = shared.groupBy("doc_id", "key").agg(F.collect_set("s").alias("shared"))
    touched = staged(named.join(shared, ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]), "touched")

    windows = staged(mapped(touched.select("doc_id", "key", "text", "shared"), _emit, "doc_id long, key long, h0 long, h1 long, place int, later boolean"), "windows")
    owner = staged(windows.groupBy("h0", "h1").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("h0", "h1", "lo"), "owner")
    hits = windows.filter("later").join(owner, ["h0", "h1"]).filter("doc_id > lo").groupBy("doc_id", "key").agg(F.collect_set("place").alias("places"))
    cut = touched.select("doc_id", "key", "text").join(hits, ["doc_id", "key"])
    cut = staged(mapped(cut, _remove, "doc_id long, key long, n_removed long, kept_sha256 string, kept_text string, removed array<struct<start:int,stop:int>>"), "cut")

    marks = first.withColumn("is_first", F.lit(True)).join(cut.select("doc_id", "key", "n_removed", "kept_sha256"), ["doc_id", "key"], "left")
    out = summary.select("doc_id", "key", "n_words", "whole").join(marks, ["doc_id", "key"], "left")
    copy = F.col("is_first").isNull() & (F.col("n_words") >= WINDOW) & F.col("doc_id").isNotNull()
    out = out.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("whole")))).alias("kept_sha256"),
    )
    return out, cut.drop("key")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))[0]
