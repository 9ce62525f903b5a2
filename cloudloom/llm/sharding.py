"""Operator 8, sharding by minimax contiguous partition.

Groups of equal texts are atoms, in the order of their least doc_id. The smallest shard capacity for which greedy
filling needs no more than n shards is found by binary search, and the sequence is cut there. The search runs over
sums by range of group ids; ranges in which a cut falls are subdivided by further Spark aggregations until each cut is
between two groups, so what reaches the driver is bounded for any sizes and the result is exact.

Slots are gapless numbers within a shard in the order (group, doc_id), from one range-partitioned sort and the sizes
of its partitions. Null texts are one group (size 1 each, CRC 0), apart from empty texts; repeated rows get slots of
their own; null doc_ids come first in their group. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

SHARDS = 8
#: Ranges that one aggregation makes of each range that is subdivided.
FANOUT = 1024


def fluid_cuts(sums: list[int], single: list[bool], capacity: int) -> list[tuple[int, int]]:
    """Where greedy filling up to capacity ends each shard but the last, as (bytes before the cut, atom at the cut), if
    atoms of several groups could be cut anywhere. No true cut lies further. sums: bytes before each atom, and of all."""
    cuts, at = [], 0
    while at + capacity < sums[-1]:
        at += capacity
        i = bisect_right(sums, at) - 1
        if single[i]:
            at = sums[i]
        cuts.append((at, i))
    return cuts


def shard_starts(groups: DataFrame, shards: int) -> list[int]:
    """Ids of the groups with which shards 1, 2, .. begin. groups: gid (unique), bytes (1 at least).

    The sequence is held as atoms: runs of ids with their sum. The least capacity that would do if atoms could be cut
    anywhere bounds the true one from below. While a cut of that filling falls inside an atom of several groups, these
    atoms (one for each cut at most) are subdivided by one aggregation; when none does, the filling is the true one.
    So a round brings (shards - 1) x FANOUT rows to the driver at most, however unlike the groups are in size."""
    span = groups.agg(F.min("gid").alias("a"), F.max("gid").alias("b"), F.sum("bytes").alias("s"), F.max("bytes").alias("m")).first()
    if span["a"] is None:
        return []
    total = span["s"]
    low = max(span["m"], -(-total // shards))  # no shard is under the largest group, nor all under the mean
    atoms = [(span["a"], span["b"] + 1, total, span["b"] == span["a"])]  # first id, end, bytes, is one group
    while True:
        sums, single = [0], [x[3] for x in atoms]
        for x in atoms:
            sums.append(sums[-1] + x[2])
        high = total
        while low < high:
            middle = (low + high) // 2
            if len(fluid_cuts(sums, single, middle)) < shards:
                high = middle
            else:
                low = middle + 1
        cuts = fluid_cuts(sums, single, low)
        split = sorted({i for at, i in cuts if at > sums[i]})
        if not split:
            return [atoms[i][0] for _, i in cuts]
        edge, width = F.lit(None).cast("long"), F.lit(None).cast("long")
        for i in split:
            a, b = atoms[i][:2]
            inside = (F.col("gid") >= a) & (F.col("gid") < b)
            edge, width = F.when(inside, a).otherwise(edge), F.when(inside, -(-(b - a) // FANOUT)).otherwise(width)
        near = (F.col("gid") >= atoms[split[0]][0]) & (F.col("gid") < atoms[split[-1]][1])
        cell = groups.filter(near).withColumns({"edge": edge, "width": width}).filter("edge is not null")
        cell = cell.withColumn("cell", F.col("edge") + F.expr("(gid - edge) div width") * F.col("width"))
        found = cell.groupBy("cell").agg(F.sum("bytes").alias("s"), F.count(F.lit(1)).alias("n"), F.min("gid").alias("a"), F.max("gid").alias("b")).collect()
        kept = [x for i, x in enumerate(atoms) if i not in split]
        atoms = sorted(kept + [(r["a"], r["b"] + 1, r["s"], r["n"] == 1) for r in found])


def minimax_shards(docs: DataFrame, shards: int = SHARDS, text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, gid (least doc_id of its group): a row for each row of docs."""
    body = F.col(text)
    row = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length(body), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(body.cast("binary"), 256)).alias("print"),
    )
    rows = staged(row.withColumn("print", F.coalesce("print", F.lit(b""))), "prints")
    groups = rows.groupBy("print").agg(F.min("doc_id").alias("gid"), F.sum("size").alias("bytes"))
    # a group without any doc_id comes first; several such groups are told apart by nothing, so they are one atom
    groups = staged(groups.withColumn("gid", F.coalesce("gid", F.lit(-(1 << 62)))), "groups")
    atoms = groups.groupBy("gid").agg(F.sum("bytes").alias("bytes"))
    starts = shard_starts(atoms, shards)
    shard = F.lit(0)
    for s in starts:
        shard = shard + (F.col("gid") >= s).cast("int")
    dealt = staged(rows.join(groups.select("print", "gid"), "print").withColumn("shard", shard).drop("print"), "dealt")
    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.repartitionByRange(parts, "gid", "doc_id", "text_crc32").sortWithinPartitions("gid", "doc_id", "text_crc32", "size")
    placed = staged(ordered.withColumn("at", F.monotonically_increasing_id()), "placed")
    placed = placed.withColumns({"part": F.shiftright("at", 33), "line": F.col("at").bitwiseAND((1 << 33) - 1)})
    # a row for each partition and shard in it: partitions + shards rows in all
    pieces = sorted(placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("a")).collect(), key=lambda r: (r["shard"], r["part"]))
    offsets, before = [], {}
    for r in pieces:
        offsets.append((r["shard"], r["part"], before.get(r["shard"], 0) - r["a"]))
        before[r["shard"]] = before.get(r["shard"], 0) + r["n"]
    offset = docs.sparkSession.createDataFrame(offsets, "shard int, part long, offset long")
    out = placed.join(F.broadcast(offset), ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("line") + F.col("offset")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "gid")


def op8_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minimax_shards(table(spark, sf_dir, "documents"))
