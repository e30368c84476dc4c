"""Personal data by a skip-chain conditional random field.

The nodes of a document are its mentions: what the patterns of the four kinds match, and runs of
digits or spelled-out addresses that could be the same written another way. Labels are the
kinds and "other". Each mention has a potential of its shape, neighbours along the text share
one, and so do distant mentions that repeat each other: the same last digits, the same address.
Such repeats form a chain per key, so a thing mentioned n times takes n - 1 links. Pattern matches
are observed; loopy belief propagation carries their labels to the other mentions, and those
that end as a kind are added to the matches. Potentials are logarithms of smoothed counts over
all documents, aggregated by Spark. The counts are as many as there are shapes: marks come from
a few characters and digits are counted to 20, so their number has a bound whatever the input.
"""

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
ROUNDS = 12

_LOCAL = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-".decode())
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Possessive and anchored where no other way to match exists, hence linear in the text.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NUMBER = re.compile(r"[0-9(](?:[ ().-]{0,2}[0-9]){6,24}(?![0-9])")
_SPELLED = re.compile(
    r"[A-Za-z0-9._%+-]{1,64}\s?(?:\(at\)|\[at\]| at )\s?[A-Za-z0-9-]{1,63}"
    r"(?:\s?(?:\(dot\)|\[dot\]| dot |\.)\s?[A-Za-z0-9-]{1,63})+"
)
_SIGN = re.compile(r"\s?(?:\(at\)|\[at\]| at )\s?")
_DOT = re.compile(r"\s?(?:\(dot\)|\[dot\]| dot )\s?")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ to the left, so that long words without one cost nothing."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
            free = host.end()
        at = text.find("@", max(at + 1, free))


def _digits(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches, ordered."""
    out = [(s, 0, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [
            (m.start(), 3, m.end()) for m in _PHONE.finditer(text)
            if 10 <= len(_digits(m.group())) <= 15
        ]
    return sorted(out)


@dataclass
class Mentions:
    """Of one document, in order of their starts. ``labels`` is -1 where none is observed."""

    spans: list[tuple[int, int]]
    labels: list[int]
    shapes: list[str]
    keys: list[str]


def mentions(text: str, base: list[tuple[int, int, int]]) -> Mentions:
    found = [(s, e, k) for s, k, e in base]
    for pattern in (_NUMBER, _SPELLED):
        for m in pattern.finditer(text):
            if not any(s < m.end() and m.start() < e for s, e, _ in _around(found, m.start(), len(base))):
                found.append((m.start(), m.end(), -1))
    found.sort()
    out = Mentions([], [], [], [])
    for s, e, label in found:
        words = text[s:e]
        digits, address = _digits(words), label == 0 or (label < 0 and _SIGN.search(words))
        out.spans.append((s, e))
        out.labels.append(label)
        if address:
            out.shapes.append("@" if label == 0 else "at")
            out.keys.append("@" + _DOT.sub(".", _SIGN.sub("@", words)).lower())
        else:
            marks = "".join(sorted({c for c in words if not c.isdigit()}))
            out.shapes.append(f"{min(len(digits), 20)}{marks}")
            out.keys.append(digits[-7:] if len(digits) >= 7 else f"{s}:{e}")
    return out


def _around(found: list, start: int, count: int) -> list:
    """The pattern matches that may overlap a span from ``start``."""
    low, high = 0, count
    while low < high:
        middle = (low + high) // 2
        if found[middle][0] <= start:
            low = middle + 1
        else:
            high = middle
    return found[max(0, low - 4) : low + 4]


def _skips(keys: list[str]) -> list[tuple[int, int]]:
    last: dict[str, int] = {}
    out = []
    for i, key in enumerate(keys):
        if key in last:
            out.append((last[key], i))
        last[key] = i
    return out


@dataclass
class Potentials:
    shape: dict[str, np.ndarray]
    unseen: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def _counted(text: str) -> Counter:
    """Shapes by label, labels of neighbours and whether repeats of pattern matches agree."""
    base = base_spans(text)
    found = mentions(text, base)
    labels = [OTHER if x < 0 else x for x in found.labels]
    out = Counter((f"shape {s}", label) for s, label in zip(found.shapes, labels))
    out.update((f"chain {a}", b) for a, b in zip(labels, labels[1:]))
    out.update(
        ("skip", int(labels[a] == labels[b]))
        for a, b in _skips(found.keys) if found.labels[a] >= 0 and found.labels[b] >= 0
    )
    return out


def potentials(docs: DataFrame) -> Potentials:
    """From all documents, null ids and repeated rows too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counter()
        for batch in batches:
            for text in batch.column("text"):
                total.update(_counted(text.as_py() or ""))
        yield pa.RecordBatch.from_pydict({
            "what": pa.array([w for w, _ in total], pa.string()),
            "label": pa.array([x for _, x in total], pa.int32()),
            "n": pa.array(list(total.values()), pa.int64()),
        })

    counted = docs.select("text").mapInArrow(run, "what string, label int, n long")
    shape, chain, skip = {}, np.ones((OTHER + 1, OTHER + 1)), np.ones(2)
    for what, label, n in counted.groupBy("what", "label").agg(F.sum("n")).collect():
        kind, _, rest = what.partition(" ")
        if kind == "shape":
            shape.setdefault(rest, np.full(OTHER + 1, 0.2))[label] += n
        elif kind == "chain":
            chain[int(rest), label] += n
        else:
            skip[label] += n
    floor = np.log(0.05)  # what the patterns don't say is not certain
    logs = {s: np.maximum(np.log(c / c.sum()), floor) for s, c in shape.items()}
    joint = chain / chain.sum()
    lift = np.log(joint / np.outer(joint.sum(1), joint.sum(0)))
    agree = np.clip(np.log(skip[1] / skip[0]), 3.0, 8.0)
    unseen = np.full(OTHER + 1, floor)
    unseen[OTHER] = 0.0
    return Potentials(logs, unseen, np.clip(lift, -0.5, 0.5), agree * np.eye(OTHER + 1))


def infer(found: Mentions, model: Potentials, rounds: int = ROUNDS) -> np.ndarray:
    """Most probable label of each mention by loopy belief propagation in log space."""
    n, kinds = len(found.spans), OTHER + 1
    own = np.array([
        np.where(np.arange(kinds) == x, 0.0, -60.0) if x >= 0 else model.shape.get(s, model.unseen)
        for x, s in zip(found.labels, found.shapes)
    ]).reshape(n, kinds)
    skips = _skips(found.keys)
    pairs = [*zip(range(n - 1), range(1, n)), *skips]
    if not pairs:
        return own.argmax(axis=1)
    a, b = np.array(pairs).T
    forward = np.stack([model.chain] * (n - 1) + [model.skip] * len(skips))
    source, target = np.concatenate((a, b)), np.concatenate((b, a))
    weights = np.concatenate((forward, forward.transpose(0, 2, 1)))
    back = np.concatenate((np.arange(len(a)) + len(a), np.arange(len(a))))
    sent = np.zeros((len(source), kinds))
    for _ in range(rounds):
        belief = own.copy()
        np.add.at(belief, target, sent)
        out = (belief[source] - sent[back])[:, :, None] + weights
        top = out.max(axis=1)
        new = top + np.log(np.exp(out - top[:, None, :]).sum(axis=1))
        new -= new.max(axis=1, keepdims=True)
        sent = 0.5 * (sent + new)
    belief = own.copy()
    np.add.at(belief, target, sent)
    return belief.argmax(axis=1)


def all_spans(text: str, model: Potentials) -> tuple[list, list]:
    """(pattern matches, matches and added spans), both (start, kind, end) in order."""
    base = base_spans(text)
    found = mentions(text, base)
    if len(found.spans) == len(base):
        return base, base
    labels = infer(found, model)
    added = [
        (s, int(k), e) for (s, e), k, seen in zip(found.spans, labels, found.labels)
        if seen < 0 and k != OTHER
    ]
    return base, sorted(base + added)


def personal_data(docs: DataFrame, model: Potentials) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, base and spans, two arrays of (start,
    kind, end) by start, then kind (its place in ``KINDS``), in code points, the end exclusive.

    ``base`` are the pattern matches, all of them also in ``spans``. Null and empty texts have
    none. Null ids and repeated rows stay. Other columns are not read; an empty table gives an
    empty result.
    """
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def listed(spans):
            return [{"start": s, "kind": k, "end": e} for s, k, e in spans]

        for batch in batches:
            both = [all_spans(t.as_py() or "", model) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([listed(b) for b, _ in both], span),
                    pa.array([listed(s) for _, s in both], span),
                ],
                ["doc_id", "base", "spans"],
            )

    kind = "array<struct<start:int,kind:int,end:int>>"
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, f"doc_id long, base {kind}, spans {kind}")
