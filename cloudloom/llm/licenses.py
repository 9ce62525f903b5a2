"""Operator 9, license scans: winnowed fingerprints of templates pick candidates, banded alignment measures them.

Templates are cut into words (letters and digits, lower case). Runs of words are hashed: of a short template all pairs
of neighbours are kept, of a longer one the least of each few consecutive three-word hashes (winnowing), in an inverted
index (hash -> template, place). A document's runs are looked up in the index. Where the words around a hit hold enough
of the template's words, template and document are aligned by edit distance in a band about the hit's diagonal; the
words that match give coverage and span. Of findings that overlap, the one with the most matched words stands, so a
license's own version, and the whole text before a notice in it, is what is reported.

Templates are a parameter (a dict, or a table with license and text) with a bound, MAX_TEMPLATE_WORDS in all, that is
checked. Null or empty texts, and texts without hits, have no rows. A license that occurs several times gives a row for
each place, so do repeated rows; null doc_ids stay null. Very long texts are worked on in overlapping parts. Spans count
code points, end exclusive. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, mapped, pieces, runs, table
from .license_texts import NOTICES, WHOLE

#: Templates of up to SHORT words are found by any pair of their words, longer ones by winnowed runs of GRAM words.
SHORT, PAIR, GRAM, GUARANTEE = 40, 2, 3, 4
#: How far an alignment may leave its diagonal: so many words, and a tenth of the template.
BAND = 8
MIN_COVERAGE = 0.7
MAX_TEMPLATE_WORDS = 1_000_000
TEMPLATES = WHOLE | NOTICES
_WORD = re.compile(r"[a-z0-9]+")
_ASCII_LOWER = {i: i + 32 for i in range(65, 91)}
#: Each byte as it is read: letters in lower case, digits, and a blank for all else.
_READ = np.array([b if 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint8)


def words_with_spans(text: str) -> list[tuple[str, int, int]]:
    return [(m[0], m.start(), m.end()) for m in _WORD.finditer(text.translate(_ASCII_LOWER))]


def cleaned(texts: pa.Array) -> pa.Array:
    """The texts, byte for byte, as words of letters and digits between blanks."""
    column = pa.compute.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return pa.LargeStringArray.from_buffers(len(column), pa.py_buffer((at - at[0]).tobytes()), pa.py_buffer(_READ[raw].tobytes()))


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places kept: the last of the least hashes of each window of consecutive hashes (all, if there are fewer)."""
    if len(hashes) <= window:
        return np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))]) if len(hashes) else np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(np.arange(len(view)) + window - 1 - np.argmin(view[:, ::-1], axis=1))


def band_of(n: int) -> int:
    return max(BAND, n // 10)


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """Words matched, and the first and one past the last matched word of text, in the best alignment of template with
    text[shift - band : shift + len(template) + band], off the diagonal by at most band (least edits, then most matches;
    ends of text are free). Words are numbers; those under 0 match nothing."""
    n, width = len(template), 2 * band + 1
    window = np.full(n + 2 * band, -1, np.int64)
    low = shift - band
    a, b = max(low, 0), min(low + len(window), len(text))
    if a < b:
        window[a - low : b - low] = text[a:b]
    equal = np.lib.stride_tricks.sliding_window_view(window, width)[:n] == template[:, None]
    edit = n + 1  # an edit outweighs all matches
    step, ramp = np.where(equal, -1, edit), np.arange(width) * edit
    cost, over = np.zeros(width, np.int64), np.full(1, 4 * edit * edit)
    moves = np.empty((n, width), np.uint8)
    for i in range(n):
        along, drop = cost + step[i], np.concatenate([cost[1:], over]) + edit
        best = np.minimum(along, drop)
        cost = np.minimum.accumulate(best - ramp) + ramp
        moves[i] = np.where(cost < best, 2, along > drop)
    k, i, first, end, matched = int(cost.argmin()), n - 1, -1, -1, 0
    while i >= 0:
        move = moves[i, k]
        if move == 2:  # a word of the text that the template hasn't
            k -= 1
        else:
            if move == 0 and equal[i, k]:
                first, matched = low + i + k, matched + 1
                end = first + 1 if end < 0 else end
            k += int(move)  # 1: a word of the template that the text hasn't
            i -= 1
    return matched, first, end


class Index:
    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        texts = Words(cleaned(pa.array([templates[k] for k in self.names], pa.string())))
        if len(texts.starts) > MAX_TEMPLATE_WORDS:
            raise ValueError("the templates have more words than their bound")
        h = texts.hashes()
        self.known = np.unique(h)
        ids = np.searchsorted(self.known, h)
        self.words = [ids[a:b] for a, b in zip(texts.first, texts.first[1:])]
        self.least = np.array([np.ceil(MIN_COVERAGE * len(w) - 1e-9) for w in self.words])
        self.of_template = np.zeros((len(self.known) + 1, len(self.names)), bool)  # the last row: words of no template
        found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for t, (a, b) in enumerate(zip(texts.first, texts.first[1:])):
            self.of_template[ids[a:b], t] = True
            size = min(PAIR if b - a <= SHORT else GRAM, b - a)
            if size:
                gram = runs(h, np.arange(a, b - size + 1), np.arange(a, b - size + 1) + size)
                places = np.arange(len(gram)) if b - a <= SHORT else winnow(gram, GUARANTEE)
                found[size] += [(int(gram[k]), t, int(k)) for k in places]
        self.grams = {}  # size -> hashes, sorted, with template and place of each
        for size, rows in found.items():
            rows.sort()
            self.grams[size] = (np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
        #: Words that two parts of a long text must have in common, so that each occurrence is whole in one of them.
        self.reach = max((len(w) + 4 * band_of(len(w)) for w in self.words), default=0)

    def hits(self, words: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (row, template, place in the row where the template would begin)."""
        out = []
        for size, (grams, template, at) in self.grams.items():
            row, place, first = words.windows(size)
            gram = runs(h, first, first + size)
            a, b = np.searchsorted(grams, gram, "left"), np.searchsorted(grams, gram, "right")
            met = np.flatnonzero(b > a)
            n = (b - a)[met]
            entry = np.repeat(a[met], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            # one number each: rows are few, and places in a row fewer than words in a part
            out.append((template[entry] << 24 | np.repeat(row[met], n)) << 28 | np.repeat(place[met], n) - at[entry] + (1 << 27))
        key = np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)
        return key >> 28 & (1 << 24) - 1, key >> 52, (key & (1 << 28) - 1) - (1 << 27)

    def find(self, words: Words) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, template, first word, end, words matched) of what is covered enough; words are counted in the row."""
        h = words.hashes()
        ids = np.searchsorted(self.known, h)
        ids[self.known[np.minimum(ids, len(self.known) - 1)] != h] = len(self.known)
        row, template, shift = self.hits(words, h)
        for t in np.unique(template).tolist():
            n, band = len(self.words[t]), band_of(len(self.words[t]))
            mine = template == t
            r, s = row[mine], shift[mine]
            have = np.concatenate([[0], np.cumsum(self.of_template[ids, t])])
            low = np.clip(words.first[r] + s - band, words.first[r], words.first[r + 1])
            high = np.clip(words.first[r] + s + n + band, words.first[r], words.first[r + 1])
            enough = have[high] - have[low] >= self.least[t]
            done = (-1, 0)
            for i, k in zip(r[enough].tolist(), s[enough].tolist()):
                if done[0] == i and k - done[1] <= band // 4:
                    continue  # that alignment's band holds this diagonal
                done = (i, k)
                text = ids[words.first[i] : words.first[i + 1]]
                matched, a, b = align(self.words[t], np.where(text < len(self.known), text, -1), k, band)
                if matched >= self.least[t]:
                    yield i, t, a, b, matched


def chosen(found: list[tuple]) -> list[tuple]:
    """Of (words matched, coverage, name, start, stop), those with the most words that don't overlap each other."""
    out: list[tuple] = []
    for x in sorted(set(found), key=lambda x: (-x[0], -x[1], x[2:])):
        if all(x[4] <= y[3] or y[4] <= x[3] for y in out):
            out.append(x)
    return sorted(out, key=lambda x: x[3:])


_FOUND = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("matched_words", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])


def _scan(templates: dict[str, str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        for batch in batches:
            both = pa.RecordBatch.from_arrays([batch.column(0), cleaned(batch.column(1)), batch.column(1)], names=["doc_id", "clean", "text"])
            found: dict[int, list[tuple]] = defaultdict(list)
            for p in pieces(both, 1, index.reach):
                w = p.words
                for row, t, a, b, matched in index.find(w):
                    start, stop = w.starts[w.first[row] + a], w.stops[w.first[row] + b - 1]
                    byte = p.byte - int(w.rows[row])
                    found[row].append((matched, matched / len(index.words[t]), index.names[t], byte + int(start), byte + int(stop)))
                if not p.last:
                    continue
                out = []
                for row, rows in sorted(found.items()):
                    raw = p.rows.column(2)[row].as_buffer().to_pybytes()
                    for matched, coverage, name, a, b in chosen(rows):
                        start = len(raw[:a].decode())
                        out.append({"doc_id": p.rows.column(0)[row].as_py(), "license": name, "coverage": coverage, "matched_words": matched, "start": start, "stop": start + len(raw[a:b].decode())})
                found.clear()
                yield pa.RecordBatch.from_pylist(out, schema=_FOUND)

    return run


def license_scan(docs: DataFrame, templates: dict[str, str] | DataFrame | None = None, text: str = "text") -> DataFrame:
    """A row for each place of each license: doc_id, license, coverage, matched_words, start, stop."""
    if isinstance(templates, DataFrame):
        rows = templates.filter("license is not null and text is not null").select("license", "text")
        if (rows.agg(F.sum(F.length("text"))).first()[0] or 0) > 12 * MAX_TEMPLATE_WORDS:
            raise ValueError("the templates have more words than their bound")
        templates = {r.license: r.text for r in rows.collect()}  # bounded by the line above
    return mapped(docs.select("doc_id", F.col(text).alias("text")), _scan(templates or TEMPLATES), "doc_id long, license string, coverage double, matched_words long, start long, stop long")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
