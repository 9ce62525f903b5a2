"""Draws of numpy's PCG64 streams, the same under any partitioning: each part of a stream starts at its own place by jumping
ahead, and permutations are one task each."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..operators.digests import derived_u128, little_endian
from ..sources.views import cloud, points, read
from ..staging import shipped

#: Points whose noise one task draws at once.
CHUNK = 4096
#: Domains of derived seeds (fixed values).
NOISE_DOMAIN = b"pcdenoise:pgd2-noisy-cache-v1\0"


def at(seed: int, draws: int) -> np.random.Generator:
    """The generator of a seed after so many draws of 64 bits."""
    return np.random.Generator(np.random.PCG64(seed).advance(draws))


def noise_seed(base: int, epoch: int, name: str = "id") -> "F.Column":
    """Hexadecimal digits of the 128-bit seed of a cloud's noise in an epoch."""
    text = F.col(name).cast("string")
    return derived_u128(F.lit(NOISE_DOMAIN), little_endian(F.lit(base), 8), little_endian(F.lit(epoch), 8), little_endian(F.octet_length(text), 8), text.cast("binary"))


def laplace_noise(clouds: DataFrame, seeds: DataFrame, low: float, high: float) -> DataFrame:
    """k, i, x, y, z as float32, scale: what one generator a cloud (seeds: k, seed as hexadecimal digits) gives that first draws
    the scale from [low, high) and then a Laplace number for each coordinate, point by point. i counts from 0 without gaps.

    A Laplace number takes one draw of 64 bits (zero is drawn again; that has a chance of 2^-53 and ends the agreement), so
    the stream of a chunk of points begins at a known place."""

    def draw(t: pa.Table) -> pa.Table:
        t = t.sort_by("i")
        seed, i = int(t.column("seed")[0].as_py(), 16), t.column("i").to_numpy()
        scale = float(at(seed, 0).uniform(low, high))
        first = int(i[0]) // CHUNK * CHUNK
        noise = at(seed, 1 + 3 * first).laplace(0.0, scale, (int(i[-1]) + 1 - first, 3))[i - first]
        clean = np.stack([t.column(a).to_numpy() for a in "xyz"], axis=1).astype(np.float32)
        noisy = (clean.astype(np.float64) + noise).astype(np.float32)
        return t.select(["k", "i"]).append_column("x", [noisy[:, 0]]).append_column("y", [noisy[:, 1]]).append_column("z", [noisy[:, 2]]).append_column("scale", [np.full(len(i), scale)])

    shipped(clouds.sparkSession)
    kinds = {c: clouds.schema[c].dataType.simpleString() for c in ("k", "i")}
    chunks = clouds.select("k", "i", *"xyz").join(seeds.select("k", "seed"), "k").withColumn("chunk", F.expr(f"i div {CHUNK}"))
    return chunks.groupBy("k", "chunk").applyInArrow(draw, f"k {kinds['k']}, i {kinds['i']}, x float, y float, z float, scale double")


def permutation_seed(domain: bytes, seed: int, epoch: int) -> int:
    return int.from_bytes(hashlib.sha256(domain + seed.to_bytes(8, "little") + epoch.to_bytes(8, "little")).digest()[:16], "little")


def epoch_permutations(epochs: DataFrame, count: int, seed: int, domain: bytes) -> DataFrame:
    """epoch, position, item: the permutation of `count` items that each epoch's generator gives. Epochs go side by side; a task
    holds one permutation, as every swap needs those before."""

    def permute(t: pa.Table) -> pa.Table:
        epoch = t.column("epoch")[0].as_py()
        items = np.random.default_rng(permutation_seed(domain, seed, epoch)).permutation(count)
        return pa.table({"epoch": np.full(count, epoch), "position": np.arange(count), "item": items})

    shipped(epochs.sparkSession)
    return epochs.select(F.col("epoch").cast("long")).distinct().groupBy("epoch").applyInArrow(permute, "epoch long, position long, item long")


@query()
def laplace_stream_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each clean cloud with the noise of its generator's stream in epoch 1."""
    c = cloud(points(spark, sf_dir), "c")
    seeds = c.select("k").distinct().select("k", noise_seed(20260813, 1, "k").alias("seed"))
    return laplace_noise(c, seeds, 0.005, 0.02)


@query()
def epoch_permutation_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The permutation of all parts in each epoch that the log has, of the first hundred."""
    e = read(spark, sf_dir, "events").select(F.expr("event_id div 500").alias("epoch")).filter("epoch < 100")
    return epoch_permutations(e, read(spark, sf_dir, "part").count(), 20260726, b"cloudloom:epoch-permutation\0")
