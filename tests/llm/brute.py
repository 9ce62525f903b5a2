"""Plain versions of operators, a document at a time, that the tests hold the Spark versions against."""

import math
import re
from collections import Counter

import regex

from cloudloom.llm import decontaminate as D
from cloudloom.llm import secrets
from cloudloom.llm.secrets import KINDS

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secret_spans(text):
    text = text or ""
    out = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    out += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


def net_score(net, text, a, b, start, stop):
    """Of the piece text[a:b] of the candidate text[start:stop]: 20 characters before it, 40 of it, 8 after."""
    code = lambda c: ord(c) - 31 if 32 <= ord(c) < 127 else 96
    left, core, right = text[max(start - 20, 0) : start], text[a:b], text[stop : stop + 8]
    row = [0] * (20 - len(left)) + [code(c) for c in left] + [code(c) + 97 for c in core] + [code(c) for c in right]
    row += [0] * (68 - len(row))
    p = net.p
    total = float(p["off"][0])
    for f in range(len(p["bias"])):
        values = [max(p["bias"][f] + sum(p["taps"][k][row[i + k]][f] for k in range(5)), 0.0) for i in range(64)]
        total += max(values) * p["out"][f] + sum(values) / 64 * p["out"][len(p["bias"]) + f]
    return 1 / (1 + math.exp(-(net.scale * total + net.shift)))


def canonical(text):
    text = text.replace("\x01", " ").replace("\x02", " ")
    text = regex.sub(r"(\p{Lu}(?<=\p{Ll}[,;]? \p{Lu})[\p{L}'-]+)", "\x01name\x02\\1", text)
    if re.search("[0-9]", text):
        text = re.sub(rf"(?i)(?<=[0-9])( ?)({D._UNITS})\b", "\\1\x01unit\x02\\2", text)
        text = re.sub(r"([0-9]+(?:[.,:/][0-9]+)*)", "\x01num\x02\\1", text)
    for c in D._BLANKS + D._PUNCTUATION:
        text = text.replace(c, " ")
    return [w for w in text.lower().split(" ") if w]


def contaminated(docs, items):
    """doc_id -> (sorted item ids, best item, its covered words) by comparing every document window by window."""
    kinds = lambda w: tuple(x.split("\x02")[0] for x in w)
    out = {}
    index = {}
    for item, text in items:
        w = canonical(text)
        size = min(len(w), D.WINDOW)
        if len(w) >= D.MIN_ITEM:
            for i in range(len(w) - size + 1):
                own = w[i : i + size]
                if sum("\x02" not in x for x in own) >= D.MIN_PLAIN:
                    index.setdefault(kinds(own), []).append((item, len(w), i, own))
    for doc, text in docs:
        w, runs = canonical(text or ""), {}
        for size in range(D.MIN_ITEM, D.WINDOW + 1):
            for i in range(len(w) - size + 1):
                for item, n, j, own in index.get(kinds(w[i : i + size]), ()):
                    run = runs.setdefault((item, n, i - j), (set(), set()))
                    run[0].update(range(j, j + size))
                    run[1].update((a, b) for a, b in zip(own, w[i : i + size]) if "\x02" in a)
        covered = {}
        for (item, n, _), (words, slots) in runs.items():
            if len({a for a, _ in slots}) == len(slots):
                covered.setdefault((item, n), set()).update(words)
        hits = {item: (len(c) / n, len(c)) for (item, n), c in covered.items() if len(c) >= D.MIN_COVERAGE * n or len(c) >= D.SPAN_WORDS}
        if hits:
            best = max(hits, key=lambda k: (hits[k][0], -k))
            out[doc] = (sorted(hits), best, hits[best][1])
    return out


def classes(texts, size, least):
    """doc_id -> least doc_id of its class: texts whose counted word windows have a weighted Jaccard similarity of least."""
    bags = {}
    for i, text in texts.items():
        w = text.split()
        bags[i] = Counter(tuple(w[k : k + size]) for k in range(max(len(w) - size + 1, 1)))
    label = {i: i for i in texts}
    for a in texts:
        for b in texts:
            if a < b and label[a] != label[b] and (bags[a] & bags[b]).total() >= least * (bags[a] | bags[b]).total() - 1e-9:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {i: new if x == old else x for i, x in label.items()}
    return label


def shards(sizes, n):
    """Least greatest shard over all ways to cut sizes into n runs, by dynamic programming."""
    sums = [0]
    for s in sizes:
        sums.append(sums[-1] + s)
    best = [sums[i] for i in range(len(sums))]
    for _ in range(n - 1):
        best = [min(max(best[j], sums[i] - sums[j]) for j in range(i + 1)) for i in range(len(sums))]
    return best[-1]


def held_out_recall(part: int, groups: int = 6) -> list[tuple[int, float]]:
    """(form, recall of scans) of the forms of secrets left out of the training: those of this remainder."""
    net, out = secrets.train(secrets.written_findings(forms=lambda k: k % groups != part)), []
    for form in range(part, 19, groups):
        hit = []
        for text, start, stop, is_secret in secrets.written_findings(400, seed=98, forms=lambda k: k == form):  # noqa: B023
            if is_secret:
                base = secrets.base_spans(text)
                hit.append(any(a < stop and start < b for a, b, _ in base + secrets.model_spans([text], [base], net)[0]))
        out.append((form, sum(hit) / len(hit)))
    return out
