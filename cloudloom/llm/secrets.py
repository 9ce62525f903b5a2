"""Operator 2, secret scans: patterns, and a character convolutional network in numpy over every other candidate.

Candidates are all runs of credential characters of the least length, less the spans of the patterns. The network sees the characters of a candidate
(in pieces, so whole) and of its context, marked as inside or outside; it is trained on labelled findings, its scores
are calibrated on held-out ones (Platt), and the threshold is the highest that keeps the recall asked for there (high, as
forms that were not written are met less surely), over what a scan of their texts finds: a finding that no candidate covers has score 0. The spans of the patterns stay as they are; the network's spans (kind `model`) are added where they don't overlap them.

Labelled findings: a DataFrame (text, start, stop, is_secret), of which at most MAX_FINDINGS rows are fitted, or, by
default, findings written by a seeded generator. Null or empty texts have no spans; null doc_ids stay null; spans count code points; very long
texts are scanned whole; repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, slices, table

# The patterns of the three base kinds (fixed values), and the least length of what counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "model")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=~-])[A-Za-z0-9+/_=~.-]{16,}")
LEAST = 16
MAX_FINDINGS = 20_000
RECALL = 0.993

_LEFT, _CORE, _RIGHT, _TAPS, _FILTERS = 20, 40, 8, 5, 24
_WIDTH = _LEFT + _CORE + _RIGHT


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def candidates(text: str, taken: list[tuple[int, int, str]] | tuple = ()) -> list[tuple[int, int]]:
    """Runs of LEAST characters at least, cut at the taken spans, without dots at the end."""
    found = []
    for m in CANDIDATE.finditer(text):
        at = m.start()
        for a, b in [*sorted((s, e) for s, e, _ in taken if s < m.end() and m.start() < e), (m.end(), m.end())]:
            value = text[at : max(a, at)]
            value = value.rstrip(".-=") or value
            if len(value) >= LEAST:
                found.append((at, at + len(value)))
            at = max(at, b)
    return found


def covering(text: str, start: int, stop: int, taken: list[tuple[int, int, str]]) -> tuple[int, int] | None:
    """The candidate that holds a finding (but for what is cut off its end)."""
    return next(((a, b) for a, b in candidates(text, taken) if a <= start < b and not text[b:stop].strip(".-=")), None)


def features(text: str, start: int, stop: int) -> list[np.ndarray]:
    """Codes of the pieces of a candidate: 0 is none, then context and inside characters."""

    def codes(part: str, shift: int) -> list[int]:
        return [(ord(c) - 31 if 32 <= ord(c) < 127 else 96) + shift for c in part]

    left, right = text[max(start - _LEFT, 0) : start], text[stop : stop + _RIGHT]
    out = []
    for a in range(start, stop, _CORE):
        core = text[a : min(a + _CORE, stop)]
        row = np.zeros(_WIDTH, np.int64)
        row[_LEFT - len(left) : _LEFT] = codes(left, 0)
        row[_LEFT : _LEFT + len(core)] = codes(core, 97)
        row[_LEFT + len(core) : _LEFT + len(core) + len(right)] = codes(right, 0)
        out.append(row)
    return out


class CharNet:
    """Embedding and convolution in one table a tap, ReLU, greatest and mean value of each filter, a logistic unit."""

    def __init__(self, seed: int = 7):
        g = np.random.default_rng(seed)
        self.p = {"taps": g.normal(0, 0.15, (_TAPS, 200, _FILTERS)), "bias": np.zeros(_FILTERS), "out": g.normal(0, 0.2, 2 * _FILTERS), "off": np.zeros(1)}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        n = x.shape[1] - _TAPS + 1
        z = self.p["bias"] + sum(self.p["taps"][k][x[:, k : k + n]] for k in range(_TAPS))
        a = np.maximum(z, 0)
        top = a.argmax(1)
        pooled = np.concatenate([np.take_along_axis(a, top[:, None], 1)[:, 0], a.mean(1)], 1)
        return pooled @ self.p["out"] + self.p["off"], (z, top, pooled, n)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 16, batch: int = 128, rate: float = 4e-3, seed: int = 11) -> None:
        """Adam, the rate falling to a tenth."""
        g = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = g.permutation(len(x))
            for at in range(0, len(x), batch):
                i = order[at : at + batch]
                logit, (z, top, pooled, n) = self.forward(x[i])
                d = (1 / (1 + np.exp(-logit)) - y[i]) / len(i)
                grad = {"out": pooled.T @ d, "off": np.array([d.sum()])}
                dp = d[:, None] * self.p["out"]
                dz = np.repeat(dp[:, None, _FILTERS:] / n, n, 1)
                np.put_along_axis(dz, top[:, None], np.take_along_axis(dz, top[:, None], 1) + dp[:, None, :_FILTERS], 1)
                dz *= z > 0
                grad["bias"] = dz.sum((0, 1))
                taps = np.zeros_like(self.p["taps"])
                for k in range(_TAPS):
                    code = x[i][:, k : k + n].reshape(-1)
                    by_code = np.argsort(code, kind="stable")
                    first = np.flatnonzero(np.diff(code[by_code], prepend=-1))
                    taps[k, code[by_code[first]]] = np.add.reduceat(dz.reshape(-1, _FILTERS)[by_code], first)
                grad["taps"] = taps
                step += 1
                for k, gk in grad.items():
                    m[k] = 0.9 * m[k] + 0.1 * gk
                    v2[k] = 0.99 * v2[k] + 0.01 * gk * gk
                    self.p[k] = self.p[k] - rate * (1 - 0.9 * epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling."""
        logit = self.forward(x)[0]
        for _ in range(500):
            p = 1 / (1 + np.exp(-(self.scale * logit + self.shift)))
            self.scale -= 0.05 * float(((p - y) * logit).mean())
            self.shift -= 0.05 * float((p - y).mean())

    def set_threshold(self, findings: list[tuple[str, int, int]], recall: float) -> None:
        """The highest threshold with which scans of the texts find this share of the secrets. If even all candidates
        are too few for it, that of the least candidate that is a secret."""
        found = []
        for text, start, stop in findings:
            taken = base_spans(text)
            span = covering(text, start, stop, taken)
            by_pattern = any(s < stop and start < e for s, e, _ in taken)
            found.append(1.0 if by_pattern else float(self.scores(np.array(features(text, *span))).max()) if span else 0.0)
        found.sort()
        self.threshold = found[int(np.floor((1 - recall) * len(found)))] or min((p for p in found if p), default=0.5)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.forward(x)[0] + self.shift)))


_ONSETS = "b bl br c ch cl d dr f fl fr g gl gr h j k kn kr l m n p pf pl pr qu r s sch schl sh sp st str t th tr v w wh z zw".split()
_RIMES = "a e i o u an en in on un er ar or al el ation ing ung ent est os ie ei au ou ea is us at it em ik eur ment".split()
_CODAS = "ch ck ct ft ld lf lk ll lt mm mp nd ng nk nn ns nt pf pp pt rb rd rg rk rl rm rn rs rt sch ss st tt tz x".split()
_ENDS = "able ble ed est heit ing isch keit lich ly ment ness schaft tion ung zione".split()


def written_findings(n: int = 15_000, seed: int = 5, forms: Callable[[int], bool] = lambda k: True) -> list[tuple[str, int, int, int]]:
    """Findings (text, start, stop, is_secret) in the forms that credentials and harmless strings usually have; of the
    secret forms only those of the wanted numbers."""
    g = np.random.default_rng(seed)
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def draw(letters: str, k: int) -> str:
        return "".join(g.choice(list(letters), k))

    def words(k: int) -> str:
        return " ".join(draw(low, int(g.integers(2, 9))) for _ in range(k))

    def term(k: int) -> str:
        """A long word as languages have them, of k syllables; in some, consonants and endings pile up."""
        heavy = g.random() * 0.7
        parts = [str(g.choice(_ONSETS)) + str(g.choice(_RIMES)) + (str(g.choice(_CODAS)) if g.random() < heavy else "") for _ in range(k)]
        return "".join(str(g.choice(_ENDS)) if i and g.random() < heavy / 2 else x for i, x in enumerate(parts))

    def some(letters: str) -> str:
        """Part of an alphabet, with digits: keys of any make, beside those of the forms that are known."""
        return "".join(g.permutation(list(letters))[: size(8, 30)]) + "".join(g.permutation(list(dig))[: size(4, 11)])

    def terms(a: int, b: int) -> list[str]:
        return [term(size(2, 4)) for _ in range(size(a, b))]

    hexa, b62, b64 = dig + "abcdef", low + up + dig, low + up + dig + "+/"
    size = lambda a, b: int(g.integers(a, b))
    secret = [
        lambda: "ghp_" + draw(b62, 36), lambda: "sk_live_" + draw(b62, size(20, 30)), lambda: "xoxb-" + draw(dig, 11) + "-" + draw(b62, 24),
        lambda: draw(b62, size(20, 48)), lambda: draw(b64, size(30, 44)) + "=", lambda: "eyJ" + draw(b62, 20) + "." + draw(b62, 40) + "." + draw(b62 + "_-", 30),
        lambda: draw(hexa, size(20, 31)), lambda: "AIza" + draw(b62 + "_-", 35), lambda: draw(low + dig, size(18, 30)),
        lambda: draw(b62, size(16, 24)), lambda: draw(low + up, size(16, 40)), lambda: draw(b64, 40), lambda: draw(up + dig, size(20, 40)),
        lambda: draw(some(low), size(16, 48)), lambda: draw(some(up), size(16, 48)), lambda: draw(some(low + up), size(16, 48)),
        lambda: draw(low, size(2, 6)) + str(g.choice(list("-_."))) + draw((hexa, low + dig, b62)[size(0, 3)], size(16, 40)),
        lambda: str(g.choice(list("-_."))).join([draw((dig, low, b62)[size(0, 3)], size(4, 14)) for _ in range(size(1, 4))] + [draw((hexa, low + dig, b62)[size(0, 3)], size(16, 32))]),
        lambda: draw((b62, b64)[size(0, 2)], size(14, 28)) + (term(size(2, 4)), term(size(2, 4)).upper())[size(0, 2)] + draw(b62, size(0, 6)),
    ]
    secret = [f for k, f in enumerate(secret) if forms(k)]
    harmless = [
        lambda: draw(low, size(5, 9)) + "-" + draw(low, size(4, 9)) + "-" + draw(dig, 4) + "-" + draw(low, 6), lambda: "20" + draw(dig, 2) + "-" + draw(dig, 2) + "-" + draw(dig, 2) + "T" + draw(dig, 2) + "-" + draw(dig, 2) + "Z",
        lambda: "www." + draw(low, 8) + ".com/" + draw(low, 6) + "/" + draw(dig, 4), lambda: draw(up, 2) + draw(dig, size(14, 22)), lambda: draw(low, 8) + "." + draw(low, 7) + draw(dig, 2) + ".example.com",
        lambda: draw(low, 7) + "_" + draw(low, 6) + "_v" + draw(dig, 2) + ".tar.gz", lambda: draw(dig, 4) + "-" + draw(dig, 4) + "-" + draw(dig, 4) + "-" + draw(dig, 3) + draw(low, 1), lambda: "/".join(draw(low, size(3, 8)) for _ in range(4)) + "/" + draw(dig, 2),
        lambda: term(size(7, 14)), lambda: term(size(7, 14)).capitalize(), lambda: "_".join(terms(3, 6)), lambda: "-".join(terms(3, 6)), lambda: "/".join(terms(3, 7)),
        lambda: term(2) + "".join(x.capitalize() for x in terms(3, 6)), lambda: "_".join(terms(3, 6)).upper(), lambda: ".".join(terms(3, 6)), lambda: term(size(7, 12)).upper(), lambda: term(size(7, 10)), lambda: draw(dig, size(16, 24)), lambda: term(size(6, 10)) + draw(dig, size(1, 5)), lambda: str(g.choice(list("-=_.~+/"))) * size(16, 60),
    ]
    before = ["", "key: ", "export KEY=", 'auth = "', "Authorization: Bearer ", "use ", "", ""]
    out = []
    for i in range(n):
        kind = i % 2
        value = (secret if kind else harmless)[size(0, len(secret if kind else harmless))]()
        lead = words(size(0, 6)) + " " + (before[size(0, 8)] if kind else before[(0, 5, 6, 7)[size(0, 4)]])
        out.append((lead + value + ["", " ", '"', ". "][size(0, 4)] + words(size(0, 4)), len(lead), len(lead) + len(value), kind))
    return out


@lru_cache(maxsize=2)
def default_net() -> CharNet:
    return train(written_findings())


def train(findings: list[tuple[str, int, int, int]], recall: float = RECALL) -> CharNet:
    """Fits on two thirds of the findings and calibrates on the rest."""
    rows = []
    for i, (t, a, b, y) in enumerate(findings[:MAX_FINDINGS]):
        for span in {(a, b), covering(t, a, b, base_spans(t)) or (a, b)}:
            rows += [(x, y, i // 2 % 3 == 0) for x in features(t, *span)]
    x, y, held = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float), np.array([r[2] for r in rows])
    net = CharNet()
    net.fit(x[~held], y[~held])
    net.calibrate(x[held], y[held])
    net.set_threshold([(t, a, b) for i, (t, a, b, y) in enumerate(findings[:MAX_FINDINGS]) if y and i // 2 % 3 == 0], recall)
    return net


def model_spans(texts: list[str], taken: list[list[tuple[int, int, str]]], net: CharNet) -> list[list[tuple[int, int, str]]]:
    """The candidates of each text that the net takes for secrets and that overlap none of its taken spans."""
    rows, owner = [], []
    for i, text in enumerate(texts):
        for a, b in candidates(text, taken[i]):
            for x in features(text, a, b):
                rows.append(x)
                owner.append((i, a, b))
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    best: dict[tuple[int, int, int], float] = {}
    for at in range(0, len(rows), 1024):
        for key, p in zip(owner[at : at + 1024], net.scores(np.array(rows[at : at + 1024])).tolist()):
            best[key] = max(best.get(key, 0.0), p)
    for (i, a, b), p in best.items():
        if p >= net.threshold:
            out[i].append((a, b, "model"))
    return out


def ordered(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "<SECRET>") -> str:
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in ordered(spans))


def _scan(net: CharNet, with_text: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                texts = [x or "" for x in part.column(1).to_pylist()]
                base = [base_spans(t) for t in texts]
                every = [b + m for b, m in zip(base, model_spans(texts, base, net))]
                counts = [pa.array([sum(s[2] == k for s in b) for b in base], pa.int64()) for k in KINDS[:3]]
                digest = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base])
                columns = [part.column(0), *counts, digest, pa.array([joined(s) for s in every]), pa.array([sum(s[2] == "model" for s in m) for m in every], pa.int64())]
                names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model"]
                if with_text:
                    columns.append(pa.array([redact(t, s) if s else t for t, s in zip(texts, every)], pa.string()))
                    names.append("redacted")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def secret_scan(docs: DataFrame, text: str = "text", findings: DataFrame | None = None, with_text: bool = False) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_model and, if with_text, redacted."""
    if findings is None:
        net = default_net()
    else:
        net = train([tuple(r) for r in findings.select("text", "start", "stop", F.col("is_secret").cast("int")).limit(MAX_FINDINGS).collect()])
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long" + ", redacted string" * with_text
    return mapped(docs.select("doc_id", F.col(text).alias("text")), _scan(net, with_text), schema)


def redacted(docs: DataFrame) -> DataFrame:
    """docs, each secret in text replaced by a mark and n_chars, if there, counted anew; null texts stay null."""
    net = default_net()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index("text")
            for part in slices(batch, k):
                texts = part.column(k).to_pylist()
                base = [base_spans(t or "") for t in texts]
                model = model_spans([t or "" for t in texts], base, net)
                new = pa.array([t if t is None else redact(t, b + m) for t, b, m in zip(texts, base, model)], part.schema.field(k).type)
                yield part.set_column(k, part.schema.field(k), new)

    out = mapped(docs, run, docs.schema)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))
