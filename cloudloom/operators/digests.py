"""Digests over the rows of a group in their order, packed binary fields, and seeds derived from digests.

Rows are dealt by group and sorted within partitions; a task streams them through one hash after the other, so it holds a
batch of rows, never a group. (SHA-256 goes over a group's bytes one after the other, so one task reads a group.)"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions.columns import col
from ..sources.views import POINTS_SQL, cloud, points, universe
from ..staging import shipped

NPY_VERSION = (1, 0)


def little_endian(c: str | Column, size: int) -> Column:
    """The lowest `size` bytes (8 at most) of a whole number, lowest first."""
    digits = F.lpad(F.hex(col(c).cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * j, 2) for j in range(size)]))


def _reversed_hex(digits: Column, first: int, size: int) -> Column:
    """Of a text of hexadecimal digits the bytes from the first on, last first."""
    return F.concat(*[F.substring(digits, 2 * (first + j) + 1, 2) for j in reversed(range(size))])


def derived_u64(seed: Column, domain: str, *parts: Column) -> Column:
    """The first 8 bytes, lowest first, of the SHA-256 of a seed (8 bytes), a domain and further bytes: decimal(20,0)."""
    digest = F.sha2(F.concat(little_endian(seed, 8), F.lit(domain.encode()), *parts), 256)
    return F.conv(_reversed_hex(digest, 0, 8), 16, 10).cast("decimal(20,0)")


def derived_u128(*parts: Column) -> Column:
    """The first 16 bytes, lowest first, of the SHA-256 of bytes, as 32 hexadecimal digits (no decimal holds them)."""
    return _reversed_hex(F.sha2(F.concat(*parts), 256), 0, 16)


def view_seed(seed: Column, shape: Column, view: Column) -> Column:
    """The seed of a view's stream; view 0 has that of the shape."""
    own = derived_u64(seed, "\0surface-cache-sampling-v1\0", shape.cast("binary"))
    more = derived_u64(seed, "\0surface-cache-view-v2\0", shape.cast("binary"), F.lit(b"\0"), little_endian(view, 8))
    return F.when(view == 0, own).otherwise(more)


def ordered_digest(rows: DataFrame, group: str, order: list[str], pack: Callable[[pa.RecordBatch], tuple[np.ndarray | pa.Buffer, np.ndarray]], head: str | None = None) -> DataFrame:
    """group, n, sha256: over the bytes that pack makes of each row, in order of `order`. pack gives all bytes of a batch and
    where each row's begin (and the end). head: a binary column whose bytes come first, alike for a group."""
    shipped(rows.sparkSession)
    kind = rows.schema[group].dataType.simpleString()
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumnRenamed(group, "_group").repartition(parts, "_group").sortWithinPartitions("_group", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest, n = None, None, 0

        def ended() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([held[0]], batch.column("_group").type), pa.array([n]), pa.array([digest.hexdigest()])], names=["_group", "n", "sha256"])

        for batch in batches:
            data, at = pack(batch)
            data, names = memoryview(data), batch.column("_group").to_pylist()
            first = [j for j in range(len(names)) if not j or names[j] != names[j - 1]]
            for a, b in zip(first, [*first[1:], len(names)]):
                if held is None or held[0] != names[a]:
                    if held is not None:
                        yield ended()
                    held, digest, n = (names[a],), hashlib.sha256(), 0
                    if head:
                        digest.update(batch.column(head)[a].as_py())
                digest.update(data[at[a] : at[b]])
                n += b - a
        if held is not None:
            yield ended()

    return rows.mapInArrow(run, f"_group {kind}, n long, sha256 string").withColumnRenamed("_group", group)


def of_text(column: str) -> Callable:
    """Packs a text column as it is."""

    def pack(batch: pa.RecordBatch) -> tuple[pa.Buffer, np.ndarray]:
        c = pc.fill_null(batch.column(column), "").cast(pa.large_string())
        _, offsets, data = c.buffers()
        at = np.frombuffer(offsets, np.int64)[c.offset : c.offset + len(c) + 1]
        return data if data is not None else pa.py_buffer(b""), at

    return pack


def of_numbers(columns: list[str], kind: str) -> Callable:
    """Packs number columns row by row, as numpy's type code says (<f4, <i8, ..)."""

    def pack(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        data = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns], axis=1).astype(kind)
        return data.view(np.uint8).reshape(-1), np.arange(len(data) + 1) * data.strides[0]

    return pack


def npy_head(n: Column, width: int) -> Column:
    """The header of an NPY file of n rows of so many float32: padded with blanks so that the data begins at a multiple of 64."""
    text = F.concat(F.lit("{'descr': '<f4', 'fortran_order': False, 'shape': ("), n.cast("string"), F.lit(f", {width}), }}"))
    size = F.ceil((F.length(text) + 11) / 64) * 64 - 10  # of the text, its padding and the line's end, after ten bytes
    padded = F.concat(F.rpad(text, (size - 1).cast("int"), " "), F.lit("\n"))
    return F.concat(F.lit(b"\x93NUMPY" + bytes(NPY_VERSION)), little_endian(size, 2), padded.cast("binary"))


def cloud_digests(clouds: DataFrame) -> DataFrame:
    """k, n, sha256: of the NPY payload (N, 3) float32 of each cloud (k, i, x, y, z), as its file has it."""
    n = clouds.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("head", npy_head(F.col("n"), 3)).drop("n")
    rows = clouds.select("k", "i", *[F.col(a).cast("float").alias(a) for a in "xyz"]).join(n, "k")
    return ordered_digest(rows, "k", ["i"], of_numbers(["x", "y", "z"], "<f4"), head="head")


def _hex_sql(c: str, size: int) -> str:
    """Bytes of a number, lowest first, as hexadecimal digits."""
    return "concat(" + ", ".join(f"printf('%02x', ({c} >> {8 * j}) & 255)" for j in range(size)) + ")"


#: The bits of a float32: sign, exponent and fraction of what isn't zero (no given coordinate is so small as to be denormal).
_BITS_SQL = "CASE WHEN {v} = 0 THEN 0 ELSE (CASE WHEN {v} < 0 THEN 2147483648 ELSE 0 END) + (({e}) + 127) * 8388608 + CAST((abs({v}) / pow(2.0, {e}) - 1) * 8388608 AS BIGINT) END"


def _float_bits_sql(c: str) -> str:
    v = f"CAST(CAST({c} AS FLOAT) AS DOUBLE)"
    e = f"CAST(floor(log2(abs({v}))) AS BIGINT)"
    fixed = f"({e} + CASE WHEN abs({v}) >= pow(2.0, {e} + 1) THEN 1 WHEN abs({v}) < pow(2.0, {e}) THEN -1 ELSE 0 END)"
    return _BITS_SQL.format(v=v, e=fixed)


@query(
    f"WITH {POINTS_SQL}, b AS (SELECT k, i, " + ", ".join(f"{_float_bits_sql('c' + a)} AS v{a}" for a in "xyz") + " FROM pts), "
    f"h AS (SELECT k, count(*) AS n, string_agg({_hex_sql('vx', 4)} || {_hex_sql('vy', 4)} || {_hex_sql('vz', 4)}, '' ORDER BY i) AS body FROM b GROUP BY k), "
    "t AS (SELECT k, n, body, '{''descr'': ''<f4'', ''fortran_order'': False, ''shape'': (' || n || ', 3), }' AS head FROM h), "
    "s AS (SELECT *, CAST(ceil((length(head) + 11) / 64.0) * 64 - 10 AS BIGINT) AS size FROM t) "
    f"SELECT k, n, sha256(unhex('934e554d50590100' || {_hex_sql('size', 2)} || hex(encode(rpad(head, CAST(size - 1 AS INTEGER), ' ') || chr(10))) || body)) AS sha256 FROM s"
)
def cloud_npy_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of each cloud's NPY payload."""
    return cloud_digests(cloud(points(spark, sf_dir), "c"))


@query("SELECT p_brand AS synset, count(*) AS n, sha256(string_agg(p_partkey || chr(10), '' ORDER BY p_partkey)) AS sha256 FROM part GROUP BY p_brand")
def ids_digest_by_synset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of each category's ids in order, a line each."""
    rows = universe(spark, sf_dir).withColumn("line", F.concat(F.col("id").cast("string"), F.lit("\n")))
    return ordered_digest(rows, "synset", ["id"], of_text("line"))


def _u64_sql(digest: str) -> str:
    pairs = " || ".join(f"substr({digest}, {2 * j + 1}, 2)" for j in reversed(range(8)))
    return f"CAST(CAST('0x' || {pairs} AS UBIGINT) AS DECIMAL(20, 0))"


_LE8 = _hex_sql("{0}", 8)


@query(f"""WITH u AS (SELECT p_partkey AS id, CAST(p_partkey % 3 AS BIGINT) AS view, CAST(20260819 AS BIGINT) AS seed FROM part),
d AS (SELECT id, view, sha256(unhex({_LE8.format('seed')} || hex(encode(chr(0) || 'surface-cache-sampling-v1' || chr(0) || id)))) AS own,
  sha256(unhex({_LE8.format('seed')} || hex(encode(chr(0) || 'surface-cache-view-v2' || chr(0) || id || chr(0))) || {_LE8.format('view')})) AS more,
  sha256(unhex({_LE8.format('seed')} || {_LE8.format('view')} || hex(encode(CAST(id AS VARCHAR))))) AS wide FROM u)
SELECT id, view, CASE WHEN view = 0 THEN {_u64_sql('own')} ELSE {_u64_sql('more')} END AS seed, {' || '.join(f'substr(wide, {2 * j + 1}, 2)' for j in reversed(range(16)))} AS wide FROM d""")
def view_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds of 64 bits by shape and view, and of 128 bits, from packed little-endian fields."""
    u = universe(spark, sf_dir).select("id", (F.col("id") % 3).alias("view"), F.lit(20260819).cast("long").alias("seed"))
    text = F.col("id").cast("string")
    wide = derived_u128(little_endian("seed", 8), little_endian("view", 8), text.cast("binary"))
    return u.select("id", "view", view_seed(F.col("seed"), text, F.col("view")).alias("seed"), wide.alias("wide"))
