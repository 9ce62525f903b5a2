"""Operator 12, importance resampling of documents towards a target distribution of hashed word n-grams.

Words are runs of bytes other than ASCII characters that are no digit or lower-case letter (after A-Z became a-z);
features are all runs of one and two words, joined by one space; a feature's bucket is its CRC-32 modulo BUCKETS.

External sort-count: Spark tasks write the buckets of all features as packed uint16 streams, with the offset of each
document, to the shared folder. A second pass sorts each stream and run-length encodes it; runs are added up by task,
then by Spark (BUCKETS rows at most reach the driver, whatever the corpus). The gains of the buckets are a table of
BUCKETS numbers; a third pass gathers them along the streams, and np.add.reduceat sums them by document.

Ranks are gapless numbers in the order (falling score, doc_id), from one range-partitioned sort and the sizes of its
partitions, so a hot source or weight only makes its partition one of several.

A null text has no words, as a text without any: no features, weight 0. Texts are taken whole, however long. Ties go to
the smaller doc_id; repeated rows are rows of their own, with ranks of their own. A null doc_id is hashed as an empty
one and comes last of equals. An empty table gives an empty result, an empty target gives gains of rarity alone;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, slices, staged, table

BUCKETS = 10_000
#: Documents of fewer words are not drawn.
MIN_WORDS = 20
#: Of those with as many, so many in a hundred are drawn.
PERCENT = 25
SEED = 7

# Bytes of words (fixed values of the word rule): digits, lower-case letters, and all of non-ASCII characters.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[0x30:0x3A] = _IN_WORD[0x61:0x7B] = _IN_WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _crc_table() -> np.ndarray:
    """CRC-32 of each byte: eight steps of division by its polynomial, bits reversed."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


def crc_on(state: np.ndarray, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """CRC states after data[start:stop] each; the n-th bytes of all that have one are taken in one step."""
    state, order = state.copy(), np.argsort(start - stop, kind="stable")  # longest first
    size = (stop - start)[order]
    at, s = start[order], state[order]
    n, live = 0, len(size)
    while live:
        live = int(np.searchsorted(-size, -n, "left"))  # those of more than n bytes
        if not live:
            break
        if live == 1:  # one long word is left: bytes one by one, in Python integers
            c = int(s[0])
            for b in data[at[0] + n : at[0] + size[0]].tolist():
                c = int(_CRC[(c ^ b) & 255]) ^ (c >> 8)
            s[0] = c
            break
        v = s[:live]
        s[:live] = _CRC[(v ^ data[at[:live] + n]) & np.uint32(255)] ^ (v >> np.uint32(8))
        n += 1
    state[order] = s
    return state


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words of each text, buckets of its features: of its words in order, then of its pairs of words in order), texts
    one after the other."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    rows = at - at[0]
    data = _LOWER[raw]
    edge = np.zeros(len(data) + 1, bool)
    edge[rows] = True
    inside = _IN_WORD[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    stop = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(start, rows)
    words = np.diff(first)
    one = crc_on(np.full(len(start), 0xFFFFFFFF, np.uint32), data, start, stop)
    # a pair goes on from the state after its first word: a space, then the second word
    paired = np.ones(max(len(start) - 1, 0), bool)
    paired[first[1:-1][(first[1:-1] > 0) & (first[1:-1] < len(start))] - 1] = False
    left = np.flatnonzero(paired)
    state = _CRC[(one[left] ^ np.uint32(0x20)) & np.uint32(255)] ^ (one[left] >> np.uint32(8))
    two = crc_on(state, data, start[left + 1], stop[left + 1])
    own, pairs = np.repeat(np.arange(len(words)), words), np.repeat(np.arange(len(words)), np.maximum(words - 1, 0))
    order = np.argsort(np.concatenate([2 * own, 2 * pairs + 1]), kind="stable")
    return words, ((~np.concatenate([one, two])[order]) % np.uint32(BUCKETS)).astype(np.uint16)


_STREAMS = pa.schema([("ids", pa.list_(pa.int64())), ("words", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("stream", pa.binary())])
_STREAMS_SQL = "ids array<long>, words array<long>, offsets array<long>, stream binary"


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each slice of rows (id, text): its documents, their words, where their features begin (and the end), the features."""
    for batch in batches:
        for part in slices(batch, 1):
            words, stream = features(part.column(1))
            offsets = np.concatenate([[0], np.cumsum(words + np.maximum(words - 1, 0))])
            row = [[part.column(0).to_pylist()], [words], [offsets], [pa.compress(stream.astype("<u2").tobytes(), "zstd", asbytes=True)]]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, _STREAMS)], schema=_STREAMS)


def _stream(row: dict) -> np.ndarray:
    n = row["offsets"][-1]
    return np.frombuffer(pa.decompress(row["stream"], 2 * n, "zstd"), "<u2") if n else np.zeros(0, np.uint16)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def run_lengths(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a stream in order, and how often each occurs: sorted, then run-length encoded."""
    s = np.sort(stream)
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
    return s[first], np.diff(np.append(first, len(s)))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for row in _rows(batches):
        value, n = run_lengths(_stream(row))
        total[value] += n
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found])], names=["bucket", "n"])


def streams(rows: DataFrame, id_: str, text: str, label: str) -> DataFrame:
    return staged(mapped(rows.select(F.col(id_).alias("id"), F.col(text).alias("text")), _streams, _STREAMS_SQL), label)


def counts(streams_: DataFrame) -> DataFrame:
    """bucket, n: how many features fall in each bucket."""
    return mapped(streams_.select("offsets", "stream"), _counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: dict[int, int], target: dict[int, int]) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares in target and corpus, rounded down."""
    s, t = sum(corpus.values()), sum(target.values())
    ratio = lambda b: float(target.get(b, 0) + 1) * float(s + BUCKETS) / (float(corpus.get(b, 0) + 1) * float(t + BUCKETS))
    return np.array([math.floor(1000 * math.log(ratio(b))) for b in range(BUCKETS)], np.int64)


def _weights(gain: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            at = np.array(row["offsets"], np.int64)
            n, total = np.diff(at), np.zeros(len(at) - 1, np.int64)
            some = n > 0
            if some.any():  # the features of documents without any take no room, so these are the bounds of the others
                total[some] = np.add.reduceat(gain[_stream(row)], at[:-1][some])
            columns = [pa.array(row["ids"], pa.int64()), pa.array(row["words"], pa.int64()), pa.array(n), pa.array(total // np.maximum(n, 1))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    return run


def noise(doc_id: Column) -> Column:
    """Thousandths of Gumbel noise, rounded down, from the first 32 bits of the hash of the doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, most: int) -> DataFrame:
    """rows (doc_id, score, ..) with rank: 1, 2, .. in the order (falling score, doc_id) up to most, else null."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    placed = staged(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumns({"part": F.shiftright("at", 33), "line": F.col("at").bitwiseAND((1 << 33) - 1)})
    before, offsets = 0, []
    for r in sorted(placed.groupBy("part").count().collect()):  # a row for each partition
        offsets.append((r["part"], before))
        before += r["count"]
    offset = rows.sparkSession.createDataFrame(offsets, "part long, before long")
    rank = F.col("before") + F.col("line") + 1
    return placed.join(F.broadcast(offset), "part").withColumn("rank", F.when(rank <= most, rank)).drop("at", "part", "line", "before")


def resampled(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank: a row for each row of docs. Of the documents of MIN_WORDS words or
    more, percent in a hundred are drawn without replacement, by weight plus noise; the others have no rank."""
    corpus = streams(docs, "doc_id", text, "streams")
    aim = streams(target.withColumn(" none", F.lit(None).cast("long")), " none", target_text, "target-streams")
    # BUCKETS rows each at most
    gain = gains(*({r["bucket"]: r["n"] for r in counts(x).collect()} for x in (corpus, aim)))
    weighed = mapped(corpus, _weights(gain), "doc_id long, n_words long, n_features long, weight long")
    scored = staged(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"))), "scored")
    able = F.col("n_words") >= MIN_WORDS
    drawn = ranked(scored.filter(able), percent * scored.filter(able).count() // 100)
    return drawn.union(scored.filter(~able).withColumn("rank", F.lit(None).cast("long")))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")
