"""Personal data by patterns and a skip-chain conditional random field.

The patterns give the base spans. The field's nodes are the tokens with a digit or an at sign (any other token is taken to be
plain text); nodes next to each other in the text are linked, and so are the nearest occurrences of the same or a similar
token anywhere in the document. Loopy message passing over both kinds of links gives each node's label; nodes with a
label, outside base spans, become further spans.

What a pattern has found is evidence at its own nodes. Weights are fitted piecewise on the base spans of a bounded sample,
half of them hidden: a hidden mention shows its shape only, and counts once as itself and once as plain text. So shape
never decides: a node outside base spans gets a label where links to others, mostly to distant mentions of the same
number or address that a pattern has found, say so.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lens.llm.common import byte_set, plain, rows_of, small_batches, table, utf8

KINDS = ("email", "ip", "card", "phone")
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
#: The field is fitted on at most so many documents, of those that have at most so many nodes.
FIT_DOCS, FIT_NODES = 2000, 256
ROUNDS, STILL, SURE = 30, 1e-4, 0.6
#: So many pairs of similar tokens with the same label, for each label, are taken as seen before any.
SAME = 9

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_GROUPS = re.compile(r"[0-9]+(?:[ -][0-9]+)*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NODE = re.compile(r"\S+")
_TRIM = " \t\r\n.,;:!?\"'<>[]{}"
_MARKS = byte_set(range(0x30, 0x3A), b"@")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, 0, m.end()
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each pattern, in steps that stay in proportion to the text's length."""
    found = list(_emails(text))
    for m in _DOTTED.finditer(text):
        if m[0].count(".") >= 3:
            parts, place = m[0].split("."), m.start()
            for k in range(0, len(parts) - 3, 4):
                size = sum(map(len, parts[k : k + 4])) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts[k : k + 4]):
                    found.append((place, 1, place + size))
                place += size + 1
    for m in _GROUPS.finditer(text):
        if 14 <= m.end() - m.start() and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(found)


# Features of a node, by place in the list.
_CUES = (re.compile(r"(?i)e?-?mail|contact|write"), re.compile(r"(?i)^ip|host|server|addr"), re.compile(r"(?i)card|visa|account|credit"), re.compile(r"(?i)phone|tel|call|fax|mobil"))
#: The last features: what a base span says of a node (one for each kind), and before them those that look at other tokens.
N_SHAPES, N_AROUND = 14, 6
N_FEATURES = N_SHAPES + N_AROUND + len(KINDS)


def _features(token: str, before: str, linked: bool) -> int:
    n = len(_digits(token))
    tests = [
        True, "@" in token, "(" in token or ")" in token, n == 0, 1 <= n <= 2, 3 <= n <= 4, 5 <= n <= 9, 10 <= n <= 13, 14 <= n <= 19, n >= 20,
        n == len(token), "-" in token, any(c.isalpha() for c in token), "." in token, before.endswith((":", "=")), linked, *(bool(c.search(before)) for c in _CUES),
    ]
    return sum(1 << k for k, x in enumerate(tests) if x)


def _told(features: list[int], labels: list[int]) -> list[int]:
    """The features with what the base spans say."""
    return [f | 1 << N_SHAPES + N_AROUND + y - 1 if y else f for f, y in zip(features, labels, strict=True)]


def _similar(token: str) -> str:
    """Tokens with the same of this are linked: the last digits of long numbers, else all letters and digits."""
    d = _digits(token)
    return d[-7:] if len(d) >= 7 else "".join(c for c in token.lower() if c.isalnum())


def nodes_of(text: str) -> tuple[list[tuple[int, int]], list[int], list[bool], list[str]]:
    """Places, features, whether the node follows on the one before it, and keys of a text's nodes."""
    places, features, linked, keys, before, last = [], [], [], [], "", -2
    for k, m in enumerate(_NODE.finditer(text)):
        raw = m[0]
        if not any(c in "0123456789@" for c in raw):
            before = raw
            continue
        left = len(raw) - len(raw.lstrip(_TRIM))
        token = raw.strip(_TRIM)
        places.append((m.start() + left, m.start() + left + len(token)))
        linked.append(last == k - 1)
        features.append(_features(token, before, linked[-1]))
        keys.append(_similar(token))
        before, last = raw, k
    return places, features, linked, keys


def _labels(places: list[tuple[int, int]], base: list[Span]) -> list[int]:
    """0, or 1 and up for the kind of the first base span that a node touches."""
    out, starts = [0] * len(places), np.array([a for a, _ in places])
    for start, kind, end in reversed(base):
        for k in range(max(0, int(np.searchsorted(starts, start)) - 1), int(np.searchsorted(starts, end))):
            if places[k][1] > start:
                out[k] = kind + 1
    return out


def _pairs(keys: list, rows: list[int] | None = None) -> list[tuple[int, int]]:
    """The nearest earlier node with the same key, for each that has one."""
    last: dict = {}
    out = []
    for k, key in enumerate(keys):
        key = key if rows is None else (rows[k], key)
        if key in last:
            out.append((last[key], k))
        last[key] = k
    return out


def _design(features: np.ndarray) -> np.ndarray:
    return ((features[:, None] >> np.arange(N_FEATURES)) & 1).astype(np.float64)


def fit(samples: list[tuple[list[int], list[int], list[bool], list[str]]]) -> dict[str, np.ndarray]:
    """Weights from (features, labels, linked, keys) of documents: each factor by itself. Node weights by multinomial
    regression with half of the mentions hidden, link weights by how much more often two linked nodes have their labels than
    chance has it."""
    n, rng = len(KINDS) + 1, np.random.default_rng(1)
    weights, links = np.zeros((N_FEATURES, n)), [np.ones((n, n)), 1 + SAME * np.eye(n)]
    seen: list[tuple[int, int]] = []
    for features, labels, linked, _ in sorted(samples, key=lambda s: (s[3], s[0])):
        hidden = False
        for k, (f, y) in enumerate(zip(features, labels, strict=True)):
            if not (k and y and linked[k] and labels[k - 1] == y):  # a mention begins
                hidden = bool(y) and rng.random() < 0.5
            if hidden:
                f &= (1 << N_SHAPES) - 1
                seen += [(f, y), (f, 0)]
            else:
                seen.append((_told([f], [y])[0], y))
    features, labels = np.array(seen, np.int64).reshape(-1, 2).T
    if len(labels):
        distinct, inverse, counts = np.unique(np.stack([features, labels], 1), axis=0, return_inverse=True, return_counts=True)
        x, y, share = _design(distinct[:, 0]), np.eye(n)[distinct[:, 1]], counts[:, None] / len(labels)
        step = np.zeros_like(weights)
        for _ in range(400):
            p = np.exp(x @ weights - (x @ weights).max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            step = 0.9 * step - 2.0 * (x.T @ (share * (p - y)) + 1e-4 * weights)
            weights += step
    for _, ys, linked, keys in samples:
        for k in range(1, len(ys)):
            if linked[k]:
                links[0][ys[k - 1], ys[k]] += 1
        for a, b in _pairs(keys):
            links[1][ys[a], ys[b]] += 1
    chance = lambda t: t.sum(1, keepdims=True) * t.sum(0, keepdims=True) / t.sum()
    return {"node": weights, "chain": np.log(links[0] / chance(links[0])), "skip": np.log(links[1] / chance(links[1]))}


def _scores(model: dict[str, np.ndarray], features: np.ndarray) -> np.ndarray:
    """Scores of each node's labels by itself. Where no pattern has found anything, none is better than plain text."""
    out = _design(features) @ model["node"]
    return np.where((features >> (N_SHAPES + N_AROUND) == 0)[:, None], np.minimum(out, out[:, :1]), out)


def marginals(model: dict[str, np.ndarray], features: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """Label probabilities of all nodes by loopy message passing, all links at once in each round."""
    scores = _scores(model, features)
    edges = np.concatenate([chain, skip]).astype(np.int64).reshape(-1, 2)
    table_ = np.concatenate([np.repeat(model["chain"][None], len(chain), 0), np.repeat(model["skip"][None], len(skip), 0)])
    source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    factor = np.concatenate([table_, table_.transpose(0, 2, 1)])
    messages = np.zeros((len(source), scores.shape[1]))
    m = len(edges)
    back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    total = scores.copy()
    for _ in range(ROUNDS if m else 0):
        without = total[source] - messages[back]
        joint = without[:, :, None] + factor
        top = joint.max(1)
        new = top + np.log(np.exp(joint - top[:, None, :]).sum(1))
        new -= new.max(1, keepdims=True)
        messages, before = 0.5 * messages + 0.5 * new, messages
        total = scores.copy()
        np.add.at(total, target, messages)
        if np.abs(messages - before).max() < STILL:
            break
    p = np.exp(total - total.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _added(places: list[tuple[int, int]], linked: list[bool], p: np.ndarray, base: list[Span]) -> list[Span]:
    """Runs of linked nodes with the same label, outside base spans."""
    out: list[Span] = []
    label = np.where(p.max(1) >= SURE, p.argmax(1), 0)
    free, run, ends = 0, False, []
    for start, _, end in base:
        if ends and start <= ends[-1][1]:
            ends[-1] = (ends[-1][0], max(end, ends[-1][1]))
        else:
            ends.append((start, end))
    for k, (a, b) in enumerate(places):
        while free < len(ends) and ends[free][1] <= a:  # merged, so in order of their ends too
            free += 1
        covered = free < len(ends) and ends[free][0] < b
        if label[k] and not covered and a < b:
            if run and linked[k] and out[-1][1] == label[k] - 1:
                out[-1] = (out[-1][0], out[-1][1], b)
            else:
                out.append((a, int(label[k]) - 1, b))
            run = True
        else:
            run = False
    return out


def find(model: dict[str, np.ndarray], texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text; all texts' nodes pass messages in the same rounds."""
    bases, nodes, features, chain, skip = [], [], [], [], []
    for text in texts:
        base, (places, own, linked, keys), first = base_spans(text), nodes_of(text), len(features)
        bases.append(base)
        nodes.append((first, places, linked))
        features += _told(own, _labels(places, base))
        chain += [(first + k - 1, first + k) for k, x in enumerate(linked) if x]
        skip += [(first + a, first + b) for a, b in _pairs(keys)]
    p = marginals(model, np.array(features, np.int64), np.array(chain).reshape(-1, 2), np.array(skip).reshape(-1, 2))
    out = []
    for base, (first, places, linked) in zip(bases, nodes, strict=True):
        out.append((base, sorted(base + _added(places, linked, p[first : first + len(places)], base))))
    return out


def written(found: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in found)


def sample(docs: DataFrame) -> list:
    """Nodes, with the labels that the base spans give them, of FIT_DOCS documents that have any, by least hash. Those with more
    than FIT_NODES are left out as a whole."""
    schema = "rank long, features array<long>, labels array<int>, linked array<boolean>, keys array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {x: [] for x in ("features", "labels", "linked", "keys")}
            for text in batch.column(1).to_pylist():
                places, features, linked, keys = nodes_of(text)
                values_of = (features, _labels(places, base_spans(text)), linked, keys)
                for name, values in zip(rows, values_of, strict=True):
                    rows[name].append(values if len(places) <= FIT_NODES else [])
            types = (pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(rows.values(), types, strict=True))], ["rank", *rows])

    some = docs.where(F.col("text").rlike("[0-9@]")).select(F.xxhash64("text").alias("rank"), "text")
    least = some.select("rank").distinct().orderBy("rank").limit(FIT_DOCS).agg(F.max("rank")).first()[0]
    if least is None:
        return []
    return [tuple(r)[1:] for r in some.where(F.col("rank") <= least).dropDuplicates(["rank"]).mapInArrow(run, schema).collect()]


def personal_data(docs: DataFrame, model: dict[str, np.ndarray] | None = None) -> DataFrame:
    """A row for each row of docs (doc_id, text): how many base spans of each kind, a digest of them, and all spans as
    kind:start:end in code points.

    Null texts count as empty; a null doc_id stays null; equal rows each get a row; an empty table gives none; further
    columns are ignored. Without a model, one is fitted on a sample of docs.
    """
    small_batches(docs.sparkSession)
    docs = plain(docs, "doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(sample(docs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            data, at = utf8(batch.column(1))
            n = batch.num_rows
            has = np.unique(rows_of(np.flatnonzero(_MARKS[data]), at))
            counts, sha, spans = np.zeros((len(KINDS), n), np.int64), [nothing] * n, [""] * n
            for row, (base, all_) in zip(has.tolist(), find(shared.value, batch.column(1).take(pa.array(has)).to_pylist()), strict=True):
                for _, kind, _ in base:
                    counts[kind, row] += 1
                sha[row], spans[row] = hashlib.sha256(written(base).encode()).hexdigest(), written(all_)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c) for c in counts), pa.array(sha), pa.array(spans)], names)

    return docs.mapInArrow(run, SCHEMA)


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


QUERIES = {"op1_personal_data": op1_personal_data}
SQL: dict[str, str] = {}
