"""Personal data: base patterns, and a skip-chain conditional random field that adds mentions which the patterns miss.

Base kinds are email, ip, card (Luhn) and phone. The field's nodes are the base spans and weak candidates (tokens around '@', runs of six
or more digits with separators). Neighbouring nodes of a document form a chain. All nodes of one form (the same digits or the same last
eight, the same part before '@'), however distant, share potentials: each has a skip edge to the form's hub, a hidden node without
evidence of its own, so a label reaches every mention of a form in two steps and edges grow with the mentions, not with their pairs.
Unary, chain and skip potentials are fitted by pseudo-likelihood on a bounded sample of documents, where base spans give the labels,
decisive features are left out at random, and a hub stands at the commonest kind of the other mentions, so that the links learn to carry
a label. Base nodes are held at their kind; loopy belief propagation over a whole batch of documents gives the others' beliefs. Weak
candidates believed to be of a kind (over one half) are added, clear of base spans. Time is linear in the text, however long.

Positions are code points, ends exclusive. n_email, n_ip, n_card and n_phone count base spans. Null texts count as empty. Null ids and
repeated rows stay as they are; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
#: Documents, and nodes of them, that potentials are fitted on at most; whole documents, those with more nodes than are left are passed over.
SAMPLE_DOCS, SAMPLE_NODES = 2000, 40_000
ROUNDS, DAMPING, BELIEF = 25, 0.5, 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match never starts inside a run of digits, since the one before takes all of it.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AFTER_AT = re.compile(r"@[A-Za-z0-9.-]*")
_NUMBER = re.compile(r"[0-9](?:[\x20().-]{0,2}[0-9]){5,}")
_QUAD = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_FOURS = re.compile(r"[0-9]{4}(?:[ -][0-9]{4}){2,}")
_ANY = re.compile("[@0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        n = n if k % 2 == 0 else 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _left_run(text: str, at: int, least: int) -> int:
    while at > least and text[at - 1] in _LOCAL:
        at -= 1
    return at


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind, then start."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        if (m := _DOMAIN.match(text, at)) and (start := _left_run(text, at, last)) < at:
            out.append((0, start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    out += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


FEATURES = ("at", "domain", "plus", "bracket", "space", "dash", "dot", "quad", "small quad", "fours", "luhn", "letter", *(f"{n} digits" for n in range(20)), "more digits")
#: Features that settle a kind by themselves; left out at random when fitting.
DECISIVE = tuple(FEATURES.index(n) for n in ("domain", "plus", "small quad", "luhn"))


def features(s: str) -> list[float]:
    d = _digits(s)
    quad = bool(_QUAD.fullmatch(s))
    size = [0.0] * 21
    size[min(len(d), 20)] = 1.0
    own = ("@" in s, bool(_DOMAIN.search(s)), "+" in s, "(" in s, " " in s, "-" in s, "." in s, quad, quad and all(len(p) <= 3 and int(p) <= 255 for p in s.split(".")), bool(_FOURS.fullmatch(s)), 13 <= len(d) <= 19 and luhn(d), any(c.isalpha() for c in s))
    return [*map(float, own), *size]


def forms(s: str) -> list[str]:
    """What a node shares with others that mean the same."""
    if "@" in s:
        name = s.partition("@")[0].lower()
        return [s.lower().rstrip("."), *(["@" + name] if len(name) >= 3 else [])]
    d = _digits(s)
    return [d, *(["#" + d[-8:]] if len(d) > 8 else [])]


def _around_at(text: str) -> list[tuple[int, int]]:
    """Runs around each '@', leftmost and clear of one another; each character is looked at once."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        start, end = _left_run(text, at, last), _AFTER_AT.match(text, at).end()
        out.append((start, end))
        last = end
        at = text.find("@", end)
    return out


def nodes(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, label) by start: base spans with their label, weak candidates clear of them with 0."""
    found = [(a, e, k + 1) for k, a, e in base]
    weak = [(a, e) for a, e in _around_at(text) if e - a > 3]
    weak += [(a - (a > 0 and text[a - 1] in "+("), e) for a, e in (m.span() for m in _NUMBER.finditer(text))]
    taken = sorted((a, e) for a, e, _ in found)
    starts, furthest = [a for a, _ in taken], list(accumulate((e for _, e in taken), max))
    for a, e in sorted(weak):
        k = bisect_left(starts, e)
        if not k or furthest[k - 1] <= a:
            found.append((a, e, 0))
    out: list[tuple[int, int, int]] = []
    for n in sorted(found, key=lambda x: (x[0], -x[2])):
        if n[2] or not out or n[0] >= out[-1][1]:
            out.append(n)
    return out


class Graph:
    """Nodes of a batch of documents with chain edges, and skip edges (node, hub) for forms that occur more than once."""

    def __init__(self, docs: list[tuple[str, list[tuple[int, int, int]]]]):
        x, y, chain, skip = [], [], [], []
        self.where: list[tuple[int, int, int]] = []
        self.hubs = 0
        for d, (text, found) in enumerate(docs):
            of: dict[str, list[int]] = {}
            for k, (a, e, label) in enumerate(found):
                i, s = len(x), text[a:e]
                x.append(features(s))
                y.append(label)
                self.where.append((d, a, e))
                if k:
                    chain.append((i - 1, i))
                for f in dict.fromkeys(forms(s)):
                    of.setdefault(f, []).append(i)
            for group in dict.fromkeys(tuple(g) for g in of.values() if len(g) > 1):
                skip += [(i, self.hubs) for i in group]
                self.hubs += 1
        self.x, self.y = np.array(x).reshape(-1, len(FEATURES)), np.array(y, np.int64)
        self.chain, self.skip = (np.array(e, np.int64).reshape(-1, 2) for e in (chain, skip))

    def others(self) -> np.ndarray:
        """For each skip edge the commonest kind among the hub's other mentions; 0 if none has a kind."""
        node, hub = self.skip.T
        n = len(LABELS)
        count = np.bincount(hub * n + self.y[node], minlength=self.hubs * n).reshape(-1, n)[hub]
        count[np.arange(len(node)), self.y[node]] -= 1
        kinds = count[:, 1:]
        return np.where(kinds.sum(1) > 0, kinds.argmax(1) + 1, 0)


class Field:
    """Potentials of the field: unary weights and bias, chain and skip tables (log scale)."""

    def __init__(self) -> None:
        n = len(LABELS)
        self.w, self.b, self.chain, self.skip = np.zeros((len(FEATURES), n)), np.zeros(n), np.zeros((n, n)), np.zeros((n, n))

    def fit(self, g: Graph, steps: int = 300, rate: float = 0.05, ridge: float = 1e-3, seed: int = 7) -> Field:
        """Maximum pseudo-likelihood by Adam; each step leaves decisive features out of half the nodes."""
        if not len(g.y):
            return self
        rng, n = np.random.default_rng(seed), len(LABELS)
        one = np.eye(n)
        params = [self.w, self.b, self.chain, self.skip]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        left, right = g.chain.T
        node, other = g.skip[:, 0], g.others()
        for t in range(1, steps + 1):
            x = g.x.copy()
            x[np.ix_(rng.random(len(x)) < 0.5, DECISIVE)] = 0
            z = x @ self.w + self.b
            np.add.at(z, right, self.chain[g.y[left]])
            np.add.at(z, left, self.chain[:, g.y[right]].T)
            np.add.at(z, node, self.skip[other])
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            d = (p - one[g.y]) / len(x)
            chain = one[g.y[left]].T @ d[right] + d[left].T @ one[g.y[right]]
            skip = one[other].T @ d[node]
            grads = [x.T @ d + ridge * self.w, d.sum(0), chain + ridge * self.chain, (skip + skip.T) / 2 + ridge * self.skip]
            for k, (q, grad) in enumerate(zip(params, grads, strict=True)):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.99 * v[k] + 0.01 * grad * grad
                q -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
        return self

    def beliefs(self, g: Graph) -> np.ndarray:
        """Loopy sum-product; nodes with a label other than 0 are held at it."""
        own = g.x @ self.w + self.b
        held = g.y > 0
        own[held] = -50.0
        own[held, g.y[held]] = 0.0
        real = len(own)
        own = np.concatenate([own, np.zeros((g.hubs, len(LABELS)))])
        edges = np.concatenate([g.chain, g.skip + np.array([0, real])])
        tables = np.concatenate([np.broadcast_to(t, (len(e), *t.shape)) for t, e in ((self.chain, g.chain), (self.skip, g.skip))])
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        tables = np.concatenate([tables, tables.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        message = np.zeros((len(source), len(LABELS)))
        for _ in range(ROUNDS):
            total = own.copy()
            np.add.at(total, target, message)
            out = total[source] - message[back]
            joint = out[:, :, None] + tables
            top = joint.max(1, keepdims=True)
            new = np.log(np.exp(joint - top).sum(1)) + top[:, 0]
            new -= new.max(1, keepdims=True)
            change = np.abs(new - message).max(initial=0.0)
            message = DAMPING * message + (1 - DAMPING) * new
            if change < 1e-3:
                break
        total = own.copy()
        np.add.at(total, target, message)
        p = np.exp(total - total.max(1, keepdims=True))[:real]
        return p / p.sum(1, keepdims=True)


def find(texts: list[str], field: Field) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each text its base spans and the spans that the field adds."""
    base = [base_spans(t) if _ANY.search(t) else [] for t in texts]
    added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    some = [(d, nodes(t, base[d])) for d, t in enumerate(texts) if _ANY.search(t)]
    some = [(d, f) for d, f in some if any(not label for _, _, label in f)]
    if some:
        graph = Graph([(texts[d], f) for d, f in some])
        belief = field.beliefs(graph)
        best = belief.argmax(1)
        for i in np.flatnonzero((graph.y == 0) & (best > 0) & (belief.max(1) > BELIEF)).tolist():
            d, a, e = graph.where[i]
            added[some[d][0]].append((int(best[i]) - 1, a, e))
    return list(zip(base, added, strict=True))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{e}" for k, a, e in sorted(spans))


def fit(docs: DataFrame, text_col: str = "text", most_docs: int = SAMPLE_DOCS, most_nodes: int = SAMPLE_NODES) -> Field:
    """The field fitted on the documents with the least hashes of their texts, each text once, and at most so many nodes of them."""
    some = docs.select(F.col(text_col).alias("t")).filter(F.col("t").rlike("@|[0-9]{2}")).withColumn("h", F.xxhash64("t"))
    least = some.select("h").distinct().orderBy("h").limit(most_docs)
    sample = some.join(F.broadcast(least), "h").dropDuplicates(["h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 0):
                found = [(h, k, t[a:e], label) for t, h in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, (a, e, label) in enumerate(nodes(t, base_spans(t)))]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*found, strict=True) if found else [()] * 4, (pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["h", "k", "s", "label"])

    found = cut(sample.select("t", "h").mapInArrow(run, "h long, k long, s string, label long"))
    chosen, left = [], most_nodes
    for r in found.groupBy("h").count().orderBy("h").collect():  # a row for each of the sample's documents
        if r["count"] <= left:
            chosen.append((r["h"],))
            left -= r["count"]
    by_doc: dict[int, list] = {}
    for r in found.join(F.broadcast(docs.sparkSession.createDataFrame(chosen, "h long")), "h").orderBy("h", "k").collect():
        by_doc.setdefault(r["h"], []).append((r["s"], r["label"]))
    laid = []
    for found in by_doc.values():
        text, spans = "", []
        for s, label in found:
            spans.append((len(text), len(text) + len(s), label))
            text += s
        laid.append((text, spans))
    return Field().fit(Graph(laid))


def pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """One row per document: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    model = docs.sparkSession.sparkContext.broadcast(field or fit(docs, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                found = find([t or "" for t in batch.column(1).to_pylist()], model.value)
                columns = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in range(len(KINDS))]
                columns.append(pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string()))
                columns.append(pa.array([joined(base + added) for base, added in found], pa.string()))
                columns.append(pa.array([len(added) for _, added in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first that starts."""
    out, at = [], 0
    for k, a, e in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k]}]"]
            at = e
        else:
            at = max(at, e)
    return "".join([*out, text[at:]])


def _mask_batches(batches: Iterator[pa.RecordBatch], at: int, model) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, at):
            texts = batch.column(at).to_pylist()
            found = find([t or "" for t in texts], model.value)
            new = pa.array([t if t is None else mask(t, base + added) for t, (base, added) in zip(texts, found, strict=True)], pa.string())
            yield batch.set_column(at, batch.schema.field(at), new)


def masked(docs: DataFrame, text_col: str = "text", field: Field | None = None) -> DataFrame:
    """The documents, with all their columns, with personal data masked in the text; null texts stay null."""
    model = docs.sparkSession.sparkContext.broadcast(field or fit(docs, text_col))
    return docs.mapInArrow(partial(_mask_batches, at=docs.columns.index(text_col), model=model), docs.schema)
