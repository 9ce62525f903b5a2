"""Operators 6 and 10: byte-pair encoding by two methods, each with the vocabulary file of a public tokenizer.

Texts are cut into units that no merge crosses (white space with the run that follows it, or runs alone); what a unit
encodes to is remembered by each Python worker, up to a bound, since words recur. Special strings inside texts become
their own tokens, as the tokenizers library does by default. A null text is an empty text: no tokens. Very long texts
are taken whole; repeated rows give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, slices, table

#: Units that a Python worker remembers (some 100 to 300 bytes each).
REMEMBERED = 600_000
# White space as the library's patterns have it (fixed values).
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# The patterns of the two files (fixed values): what they cut units into.
BYTE_PATTERN = public_tokenizers.PATTERN
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def compiled(pattern: str) -> regex.Pattern:
    """The pattern with the library's white space. Letters and numbers are those of the regex module, whose Unicode
    tables also know letters that were added after the library's."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte: itself where printable, else those from U+0100 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """A tokenizers .json file with a BPE model over byte letters. rank: a pair of ids, as first << 20 | second, to
    merge order << 20 | id of the two together."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.tokens = {i: t for t, i in (self.ids | self.specials).items()}
        self.rank: dict[int, int] = {}
        for order, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault(self.ids[a] << 20 | self.ids[b], order << 20 | self.ids[a + b])
        letters = byte_letters()
        self.letter_ids = [self.ids[letters[b]] for b in range(256)]
        self.last_ids = [self.ids[letters[b] + self.suffix] for b in range(256)] if self.suffix else self.letter_ids

    def symbols(self, word: bytes) -> list[int]:
        """Initial ids: one for each byte; the last may carry the end-of-word mark."""
        out = [self.letter_ids[b] for b in word]
        out[-1] = self.last_ids[word[-1]]
        return out


@lru_cache(maxsize=8)
def vocabulary(name: str) -> Vocabulary:
    return Vocabulary(public_tokenizers.path(name) if "/" not in name else name)


def merges_made(ids: list[int], rank: dict[int, int]) -> int:
    """How many merges byte-pair encoding makes of ids.

    Places are a linked list; a heap holds (order of the pair's merge, place). The least is popped; an entry whose
    pair has changed meanwhile is skipped."""
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        r = rank.get(ids[i] << 20 | ids[i + 1])
        if r is not None:
            heap.append((r >> 20) << 32 | i)
    heapq.heapify(heap)
    made = 0
    while heap:
        top = heapq.heappop(heap)
        i = top & 0xFFFFFFFF
        j = after[i]
        if ids[i] < 0 or j >= n:
            continue
        r = rank.get(ids[i] << 20 | ids[j])
        if r is None or r >> 20 != top >> 32:
            continue
        made += 1
        ids[i], ids[j] = r & 0xFFFFF, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            r = rank.get(ids[i] << 20 | ids[k])
            if r is not None:
                heapq.heappush(heap, (r >> 20) << 32 | i)
        h = before[i]
        if h >= 0:
            r = rank.get(ids[h] << 20 | ids[i])
            if r is not None:
                heapq.heappush(heap, (r >> 20) << 32 | h)
    return made


class Counts(dict):
    """Unit -> number of tokens, filled in when missing."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.pattern = vocab, compiled(BYTE_PATTERN)

    def __missing__(self, unit: str) -> int:
        n = 0
        for piece in self.pattern.findall(unit):
            word = piece.encode()
            n += len(word) - (merges_made(self.vocab.symbols(word), self.vocab.rank) if len(word) > 1 else 0)
        if len(self) >= REMEMBERED:
            self.clear()
        self[unit] = n
        return n


_UNITS = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")


@lru_cache(maxsize=2)
def known_counts(name: str) -> Counts:
    """A Python worker's own."""
    return Counts(vocabulary(name))



def count_tokens(text: str, counts: Counts) -> int:
    vocab = counts.vocab
    parts = vocab.cut.split(text) if vocab.cut and any(s in text for s in vocab.specials) else [text]
    return sum(1 if i % 2 else sum(map(counts.__getitem__, _UNITS.findall(p))) for i, p in enumerate(parts))


_COUNTED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def _count(name: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = known_counts(name)
        for batch in batches:
            for part in slices(batch, 1):
                texts = [x or "" for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array([count_tokens(x, counts) for x in texts], pa.int64())], schema=_COUNTED)

    return run


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 512, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. tokenizer: a name in public_tokenizers, or a path on every executor."""
    out = mapped(docs.select("doc_id", F.col(text).alias("text")), _count(tokenizer), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def merge_rounds(words: list[list[int]], pairs: np.ndarray, values: np.ndarray) -> list[np.ndarray]:
    """Byte-pair encoding of many words at once.

    The symbols of all words are one flat array. In a round each adjacent pair within a word is looked up by binary
    search in the sorted pair keys; each word's lowest-ranked pair, wherever it occurs in the word, left to right,
    is merged; words without a pair are done. values: merge order << 20 | new id."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
    lengths = np.array([len(w) for w in words])
    flat = np.fromiter((x for w in words for x in w), np.int64, lengths.sum())
    owner = np.repeat(np.arange(len(words)), lengths)
    none = np.iinfo(np.int64).max
    while len(flat):
        key = flat[:-1] << 20 | flat[1:]
        at = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
        value = np.where((pairs[at] == key) & (owner[:-1] == owner[1:]), values[at], none)
        value = np.append(value, none)
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        least = np.minimum.reduceat(value, first)
        size = np.diff(np.append(first, len(flat)))
        best = np.repeat(least, size)
        hit = (value == best) & (best != none)
        # of overlapping equal pairs (a a a) every second one is merged: places in a run of hits, from its start
        place = np.arange(len(flat))
        start = hit & ~np.append(False, hit[:-1])
        run = place - np.maximum.accumulate(np.where(start, place, 0))
        hit &= run % 2 == 0
        flat = np.where(hit, value & 0xFFFFF, flat)
        keep = ~np.append(False, hit[:-1])
        done = np.repeat(least == none, size)
        for a, n in zip(first[least == none].tolist(), size[least == none].tolist()):
            out[owner[a]] = flat[a : a + n]
        keep &= ~done
        flat, owner = flat[keep], owner[keep]
    return out


class Codes(dict):
    """Unit -> (number of tokens, ids as text, tokens as text)."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.pattern = vocab, compiled(WORD_PATTERN)
        keys = np.array(list(vocab.rank), np.int64)
        order = np.argsort(keys)
        self.pairs, self.values = keys[order], np.array(list(vocab.rank.values()), np.int64)[order]

    def learn(self, units: set[str]) -> None:
        """Encodes the units that aren't known yet, all together."""
        new = [u for u in units if u not in self]
        if len(self) + len(new) > REMEMBERED:
            self.clear()
            new = list(units)
        pieces = [self.pattern.findall(u) for u in new]
        words = [self.vocab.symbols(p.encode()) for ps in pieces for p in ps]
        coded = iter(merge_rounds(words, self.pairs, self.values) if words else [])
        tokens = self.vocab.tokens
        for u, ps in zip(new, pieces):
            ids = [i for _ in ps for i in next(coded).tolist()]
            self[u] = (len(ids), " ".join(map(str, ids)), " ".join([tokens[i] for i in ids]))


@lru_cache(maxsize=2)
def known_codes(name: str) -> Codes:
    """A Python worker's own."""
    return Codes(vocabulary(name))


_RUNS = re.compile(f"[^{_SPACE}]+")


def normal(text: str) -> str:
    """NFC, then lower case letter by letter (so no final sigma)."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


_ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.string()), ("decoded", pa.string())])


def _encode(name: str, with_ids: bool, with_decoded: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = known_codes(name)
        vocab = codes.vocab
        specials = {s: (1, str(i), s) for s, i in vocab.specials.items()}
        for batch in batches:
            for part in slices(batch, 1):
                rows: list[list[tuple[bool, str]]] = []  # is a special string, unit
                for text in part.column(1).to_pylist():
                    pieces = vocab.cut.split(text or "") if vocab.cut else [text or ""]
                    rows.append([(i % 2 == 1, u) for i, p in enumerate(pieces) for u in ([p] if i % 2 else _RUNS.findall(normal(p)))])
                # lower-casing may make a special string of a run: that is a unit like others
                codes.learn({u for r in rows for special, u in r if not special})
                found = [[specials[u] if special else codes[u] for special, u in r] for r in rows]
                # a unit may hold no token at all (then its texts are empty)
                ids = [" ".join([c[1] for c in r if c[0]]) for r in found]
                decoded = [" ".join([c[2] for c in r if c[0]]) for r in found]
                digest = [[hashlib.sha256(x.encode()).hexdigest() for x in xs] for xs in (ids, decoded)]
                empty = [None] * len(rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([sum(c[0] for c in r) for r in found], pa.int64()), *map(pa.array, digest), pa.array(ids if with_ids else empty, pa.string()), pa.array(decoded if with_decoded else empty, pa.string())], schema=_ENCODED)

    return run


def encode(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", text: str = "text", with_ids: bool = True, with_decoded: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, where wanted, ids (array) and decoded (text)."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids string, decoded string"
    out = mapped(docs.select("doc_id", F.col(text).alias("text")), _encode(tokenizer, with_ids, with_decoded), schema)
    out = out.drop(*["ids"] * (not with_ids), *["decoded"] * (not with_decoded))
    if not with_ids:
        return out
    return out.withColumn("ids", F.when(F.col("ids") == "", F.array().cast("array<int>")).otherwise(F.split("ids", " ").cast("array<int>")))


def decode(encoded: DataFrame, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """doc_id, decoded: the tokens of ids, joined as the library does it without a decoder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary(tokenizer).tokens
        for batch in batches:
            texts = [" ".join([tokens[i] for i in ids or ()]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return mapped(encoded.select("doc_id", "ids"), run, "doc_id long, decoded string")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), with_ids=False, with_decoded=False)
