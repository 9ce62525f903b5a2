"""Operator 4, near duplicates by DartMinHash.

Elements are five-word shingles, weighted by how often they occur (or by 1). Each unit of an element's weight is a
region into which hashed darts fall as a Poisson process in rank; the earliest dart of each coordinate makes the
signature, and two signatures agree in a coordinate with probability equal to the weighted Jaccard similarity.
Signatures are cut into bands; texts that share a band are candidates; links are candidates whose exact similarity is
0.8 or more; classes are the connected components.

Equal word sequences are collapsed first. Within a band's bucket no all-pairs list is made: pivots are compared to
all members, and members of one class are not compared again. The texts of buckets that still hold several classes are
put into other buckets by their rarest shingles (a prefix filter, exact); buckets in which the pairs left are checked to
be linear in their size are then compared pair by pair, the others with more and more pivots. So no candidate link is
lost. A bucket of many texts is dealt over several tasks by a salt, and what it is compared with is sent to each.

Texts of one to four words are one shingle. Texts without words, null texts and rows with null doc_id are alone in
their class. Repeated rows share a class. Where rows of one doc_id have different texts, the text with the least
fingerprint is compared, and all rows of the doc_id get its class. An empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Joined, mapped, mix, pieces, runs, signed, staged, table

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
#: Pairs left to compare, for each text of a bucket, from which on more pivots are taken instead.
PAIRS_A_ROW = 64
#: Texts of a bucket that one task takes.
SALT_ROWS = 256
#: Ids of texts with a bucket in common (some 30 bytes each) up to which they are broadcast; beyond, texts are shuffled.
BROADCAST_IDS = 500_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Elements into which darts are thrown at once.
_AT_ONCE = 1 << 17


def weighed(row: np.ndarray, value: np.ndarray, weights: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by row and hash: row, hash and weight of each distinct shingle."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(row)))
    return row[at], value[at], count if weights == "count" else np.ones(len(at), np.int64)


def shingled(batch: pa.RecordBatch, text: int, weights: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, tuple[np.ndarray, ...]]]:
    """Rows of batch, the fingerprints (two numbers each) of their words, and their weighed shingles."""
    empty = hashlib.blake2b(digest_size=16)
    whole, found, few = Joined(empty.copy()), [], np.zeros(0, np.uint64)
    for part, words, is_part, _, again, last, _ in pieces(batch, text, SHINGLE - 1):
        h = words.hashes()
        row, _, at = words.windows(SHINGLE)
        value = runs(h, at, at + SHINGLE)
        if not is_part:
            short = np.flatnonzero((words.counts > 0) & (words.counts < SHINGLE))
            row = np.concatenate([row, short])
            value = np.concatenate([value, runs(h, words.first[short], words.first[short + 1])])
            data, at = words.joined()
            prints = [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(at, at[1:])]
        else:  # one text in parts
            whole.add(words.joined(np.arange(len(h)) >= again)[0].tobytes())
            found.append(value)
            few = np.concatenate([few, h[again:]])[:SHINGLE]
            if not last:
                continue
            value = np.concatenate(found)
            if 0 < len(few) < SHINGLE:
                value = runs(few, np.array([0]), np.array([len(few)]))
            row, prints = np.zeros(len(value), np.int64), [whole.hash.digest()]
            whole, found, few = Joined(empty.copy()), [], few[:0]
        yield part, np.frombuffer(b"".join(prints), np.int64).reshape(-1, 2), weighed(row, value, weights)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def dart_signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n_rows: int, k: int) -> np.ndarray:
    """n_rows x k: the earliest dart of each coordinate; rows without elements stay 0. Weights may be fractions."""
    best = np.zeros((n_rows, k), np.uint64)
    total = np.bincount(row, weight, n_rows)
    # expected darts that fill all k coordinates, most likely
    limit = np.divide(k * math.log(k) + 2 * k, total, out=np.zeros(n_rows), where=total > 0)
    cells = np.ceil(weight).astype(np.int64)
    row, element, weight = np.repeat(row, cells), np.repeat(element, cells), np.repeat(weight, cells)
    cell = np.arange(len(row)) - np.repeat(np.cumsum(cells) - cells, cells)
    key = mix(element + cell.astype(np.uint64) * _STEP)
    while len(row):
        found: list[tuple[np.ndarray, ...]] = []
        for a in range(0, len(row), _AT_ONCE):
            at, dart = np.arange(a, min(a + _AT_ONCE, len(row))), key[a : a + _AT_ONCE]
            rank = np.zeros(len(at))
            while len(at):
                dart = mix(dart + _STEP)
                rank = rank - np.log(_uniform(dart))
                near = rank <= limit[row[at]]
                at, dart, rank = at[near], dart[near], rank[near]
                own = mix(dart ^ np.uint64(0xA5A5A5A5A5A5A5A5))
                hit = cell[at] + _uniform(mix(own)) <= weight[at]
                found.append((row[at][hit], (own % np.uint64(k)).astype(np.int64)[hit], rank[hit], own[hit]))
        r, c, rank, own = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((rank, r * k + c))
        slot = (r * k + c)[order]
        first = np.ones(len(slot), bool)
        first[1:] = slot[1:] != slot[:-1]
        full = np.bincount(slot[first] // k, minlength=n_rows) == k
        keep = first & full[slot // k]
        best.reshape(-1)[slot[keep]] = own[order][keep]
        again = ~full[row]  # a coordinate is empty: further darts are needed
        row, key, cell, weight = row[again], key[again], cell[again], weight[again]
        limit = limit * 2
    return best


_SIGNED = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("f0", pa.int64()), ("f1", pa.int64()), ("n_shingles", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _sign(weights: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, prints, (row, value, weight) in shingled(batch, 2, weights):
                sig = dart_signatures(row, value, weight, part.num_rows, BANDS * ROWS)
                flat = sig.reshape(-1)
                at = np.arange(0, flat.size, ROWS)
                band = runs(flat, at, at + ROWS) + np.tile(np.arange(BANDS, dtype=np.uint64), part.num_rows) * _STEP
                n = np.bincount(row, weight, part.num_rows).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]), pa.int32()), pa.array(signed(mix(band)).reshape(-1, BANDS)[n > 0].reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(prints[:, k]) for k in (0, 1)), pa.array(n), lists], schema=_SIGNED)

    return run


_ELEMENTS = pa.schema([("rep", pa.int64()), ("elements", pa.list_(pa.int64()))])


def _elements(weights: str):
    """The shingles of each text as a set: one that weighs several units is as many elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, (row, value, weight) in shingled(batch, 1, weights):
                copy = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
                row, value = np.repeat(row, weight), np.repeat(value, weight)
                value = np.where(copy > 0, mix(value + copy.astype(np.uint64) * _STEP), value)
                at = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(at, pa.array(signed(value)))], schema=_ELEMENTS)

    return run


def verified(pairs: DataFrame, elements: DataFrame) -> DataFrame:
    """a, b, similarity of the distinct pairs whose similarity is high enough."""
    pairs = pairs.select("a", "b").distinct()
    for side in ("a", "b"):
        pairs = pairs.join(elements.select(F.col("rep").alias(side), F.col("elements").alias(f"s_{side}")), side)
    both = pairs.select("a", "b", F.size(F.array_intersect("s_a", "s_b")).alias("n"), F.size("s_a").alias("n_a"), F.size("s_b").alias("n_b"))
    kept = both.withColumn("similarity", F.col("n") / (F.col("n_a") + F.col("n_b") - F.col("n"))).filter(F.col("similarity") >= SIMILARITY - 1e-12)
    return staged(kept.select("a", "b", "similarity"), "links")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """node, label (its component's least node) for each node of the edges a, b.

    Each round points every node to its least neighbour, follows that pointer once more, and contracts the edges;
    the nodes with edges at least halve."""
    spark = edges.sparkSession
    out = None
    edges = staged(edges.select("a", "b").filter("a != b").distinct(), label)
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to"))
        least = staged(least, label)
        hop = least.select(F.col("node").alias("to"), F.col("to").alias("hop"))
        least = staged(least.join(hop, "to", "left").select("node", F.coalesce("hop", "to").alias("to")), label)
        if out is None:
            out = least.select("node", F.col("to").alias("label"))
        else:
            step = least.select(F.col("node").alias("label"), "to")
            out = out.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        out = staged(out, label)
        for side in ("a", "b"):
            edges = edges.join(least.select(F.col("node").alias(side), F.col("to").alias(f"to_{side}")), side)
        edges = staged(edges.select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).filter("a != b").distinct(), label)
    return out if out is not None else spark.createDataFrame([], "node long, label long")


def salted(members: DataFrame, texts: str) -> DataFrame:
    """members with salts, the number of tasks over which its bucket of so many texts is dealt, and its own salt."""
    salts = F.ceil(F.col(texts) / SALT_ROWS).cast("int")
    return members.withColumn("salts", salts).withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int"))


def over_salts(df: DataFrame) -> DataFrame:
    """Each row for every salt of its bucket."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")


def still_open(members: DataFrame) -> DataFrame | None:
    """Of members (bucket, rep, score, n, place, label, salts, salt) those whose bucket holds several labels, if any, with the
    bucket's most common label (main), and whether so few pairs of unlike label are left that all can be compared (small)."""
    members = staged(members.select("bucket", "rep", "score", "n", "place", "label", "salts", "salt"), "members")
    parts = members.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("c"), F.max("salts").alias("salts"))
    buckets = parts.groupBy("bucket").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("cc"), F.max_by("label", "c").alias("main"), F.max("salts").alias("salts"))
    pairs = (F.col("c") * F.col("c") - F.col("cc")) / 2
    buckets = staged(buckets.filter(pairs > 0).select("bucket", "main", "salts", (pairs <= PAIRS_A_ROW * F.col("c")).alias("small")), "open")
    if buckets.isEmpty():
        return None
    return staged(members.join(over_salts(buckets), ["bucket", "salt"]), "untested")


def side_of(members: DataFrame, r: str, *more: str) -> DataFrame:
    return members.select("bucket", *more, F.col("rep").alias(r), *[F.col(c).alias(f"{c}_{r}") for c in ("label", "n", "place")])


def may_link() -> Column:
    """Unlike labels, and room for enough common elements if this is the first one common to both, in places of one order."""
    common = 1 + F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    return (F.col("label_a") != F.col("label_b")) & (common >= SIMILARITY / (1 + SIMILARITY) * (F.col("n_a") + F.col("n_b")) - 1e-6)


def candidates(untested: DataFrame, pivots: int) -> tuple[DataFrame, DataFrame]:
    """(a, b to compare; bucket, rep of the members that need no more comparing). In small buckets every text that isn't of
    the main label is compared with all of another label; in the others, the first few texts are compared with all."""
    small, large = untested.filter("small"), untested.filter("not small")
    of_all = over_salts(side_of(small.filter("label != main"), "a", "salts")).join(side_of(small, "b", "main", "salt"), ["bucket", "salt"])
    of_all = of_all.filter(((F.col("a") < F.col("b")) | (F.col("label_b") == F.col("main"))) & may_link())
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("score"), "rep"))
    pivot = staged(large.withColumn("nth", place).filter(F.col("nth") <= pivots), "pivots")
    of_pivots = over_salts(side_of(pivot, "a", "salts")).join(side_of(large, "b", "salt"), ["bucket", "salt"]).filter((F.col("a") != F.col("b")) & may_link())
    pairs = of_all.select("a", "b").union(of_pivots.select("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs, small.select("bucket", "rep").union(pivot.select("bucket", "rep"))


def rare_buckets(members: DataFrame, elements: DataFrame) -> DataFrame:
    """Other buckets for the same texts: sets with a similarity of at least s share one of their n - ceil(s n) + 1 rarest
    elements, in an order common to all. This loses no link, and a passage that many texts share makes no bucket."""
    labels = members.select("rep", "label").distinct()
    own = elements.join(labels, "rep").select("rep", "label", F.size("elements").cast("long").alias("n"), F.explode("elements").alias("bucket"))
    # both are staged before they are joined to the same rows, so that a frequent element's join can be split
    spread = staged(own.groupBy("bucket").agg(F.count(F.lit(1)).alias("texts")), "spread")
    order = Window.partitionBy("rep").orderBy("texts", "bucket")
    ranked = own.join(spread, "bucket").withColumn("place", F.row_number().over(order))
    rare = ranked.filter((F.col("place") <= F.col("n") - F.ceil(SIMILARITY * F.col("n") - 1e-9) + 1) & (F.col("texts") > 1))
    rare = staged(salted(rare.select("bucket", "rep", F.col("texts").alias("score"), "n", "place", "label"), "score"), "rare")
    # nor can it link where even the shortest text of the bucket has too many elements of its own before this one
    shortest = staged(rare.groupBy("bucket").agg(F.min("n").alias("least"), F.max("salts").alias("salts")), "shortest")
    room = 1 + F.col("n") - F.col("place") >= SIMILARITY / (1 + SIMILARITY) * (F.col("n") + F.greatest("least", F.ceil(SIMILARITY * F.col("n") - 1e-6))) - 1e-6
    return rare.join(over_salts(shortest), ["bucket", "salt"]).filter(room).drop("least")


def near_duplicates(docs: DataFrame, text: str = "text", weights: str = "count") -> DataFrame:
    """doc_id, class_id (least doc_id of its class), copy_of (least doc_id with the same words): a row for each row of docs.

    weights: "count" lets a shingle weigh as often as it occurs; "set" compares sets of shingles."""
    named = docs.select("doc_id", F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    schema = "doc_id long, key long, f0 long, f1 long, n_shingles long, bands array<long>"
    signed_docs = staged(mapped(named.filter("doc_id is not null"), _sign(weights), schema), "signatures")
    worded = signed_docs.filter("n_shingles > 0")
    # staged before it is joined to the same rows: both sides are then shuffled, so that a large group can be split
    prints = staged(worded.groupBy("f0", "f1").agg(F.min("doc_id").alias("rep")), "prints")
    member = worded.select("doc_id", "f0", "f1").join(prints, ["f0", "f1"]).select("doc_id", "rep")
    member = staged(member.unionByName(signed_docs.filter("n_shingles = 0").select("doc_id", F.col("doc_id").alias("rep"))), "members")

    chief = prints.groupBy(F.col("rep").alias("doc_id")).agg(F.min("f0").alias("f0"))
    reps = worded.join(chief, ["doc_id", "f0"], "left_semi").dropDuplicates(["doc_id"])
    banded = reps.select(F.explode("bands").alias("bucket"), F.col("doc_id").alias("rep"), "key", "n_shingles")
    sizes = staged(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1"), "sizes")
    crowded = staged(banded.join(sizes, "bucket"), "crowded")
    # what shares the most buckets with the most texts is likely the original of a group of copies: it is a pivot first
    scored = crowded.join(crowded.groupBy("rep").agg(F.sum("texts").alias("score")), "rep")
    buckets = staged(salted(scored, "texts").select("bucket", "rep", "score", F.col("n_shingles").alias("n"), F.lit(1).alias("place"), "salts", "salt"), "buckets")
    wanted = staged(crowded.select(F.col("rep").alias("doc_id"), "key").distinct(), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    chosen = named.join(wanted, ["doc_id", "key"], "left_semi").dropDuplicates(["doc_id"])
    elements = staged(mapped(chosen.select("doc_id", "text"), _elements(weights), "rep long, elements array<long>"), "elements")

    links, classes = None, None
    untested = buckets.withColumns({"label": F.col("rep"), "main": F.lit(None).cast("long"), "small": F.lit(False)})
    pivots, refined = 1, False
    while untested is not None:
        pairs, tested = candidates(untested, pivots)
        found = verified(pairs, elements).select("a", "b")
        links = found if links is None else links.union(found)
        classes = components(links)
        rest = untested.join(tested, ["bucket", "rep"], "left_anti").drop("label").join(classes.select(F.col("node").alias("rep"), "label"), "rep", "left")
        untested = still_open(rest.withColumn("label", F.coalesce("label", "rep")))
        if refined:
            pivots *= 8
        elif untested is not None:
            untested, refined = still_open(rare_buckets(untested, elements)), True
    out = member.join(classes.select(F.col("node").alias("rep"), F.col("label")), "rep", "left").select("doc_id", F.coalesce("label", "rep").alias("class_id"), F.col("rep").alias("copy_of"))
    nameless = docs.filter("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("copy_of"))
    return out.unionByName(nameless)


def keep_one(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs, one for each class: that of the least doc_id (of several rows with it, the first in the order of
    text and the hash of all columns). Rows without doc_id stay; so does a row of each text without words."""
    classes = near_duplicates(docs, text)
    first = classes.filter("doc_id = class_id").select("doc_id").distinct()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    row = docs.join(first, "doc_id", "left_semi").select(F.col("doc_id").alias("_id"), F.struct(*columns).alias("_row"))
    nth = F.row_number().over(Window.partitionBy("_id").orderBy(F.col(f"_row.`{text}`"), F.xxhash64("_row")))
    kept = row.withColumn("_nth", nth).filter("_nth = 1").select("_row.*")
    return kept.unionByName(docs.filter("doc_id is null").select(*columns))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
