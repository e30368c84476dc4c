"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages and only the bag has a label. Every passage is encoded by a
layer over its character and word statistics; gated attention (a tanh layer times a sigmoid
layer) gives each passage a weight; the weighted mean of the codes, one vector per document, is
scored. All layers are learned together from document labels by gradient descent, on all passages
of at most ``SAMPLE`` documents. Scores read every passage of every text.

The driver holds 274 bytes a passage while it learns, 43 kB for a text of 20,000 words; steps
add up the gradients of batches of whole documents, so that the rest does not grow with the
passages.
"""

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxtally.llm.common import fold

SAMPLE = 6000
WORDS = 128
#: Passages whose gradients are computed at a time.
BATCH = 1 << 16
CODE = 16
GATE = 12
EPOCHS = 250
RATE = 0.02
_FEATURES = 128 + 9


def _statistics(words: list[bytes]) -> np.ndarray:
    """Of one passage: shares of characters, then shapes and repetition of words."""
    out = np.zeros(_FEATURES, np.float32)
    if not words:
        return out
    text, n = b" ".join(words), len(words)
    octets = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    out[:128] = np.sqrt(octets[:128] / len(text))
    different = len(set(words))
    out[128:] = (
        octets[128:].sum() / len(text), np.log(len(text) / n) / 4, different / n,
        sum(map(operator.eq, words, words[1:])) / n, sum(map(bytes.isupper, words)) / n,
        sum(map(bytes.isalpha, words)) / n, octets[65:91].sum() / len(text), np.log1p(n) / 5,
        len(set(words[::2])) / ((n + 1) // 2),
    )
    return out


def passages(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """A row of statistics for each run of ``words`` words, one for no words at all."""
    tokens = (text or b"").split()
    starts = range(0, max(1, len(tokens)), words)
    return np.stack([_statistics(tokens[s : s + words]) for s in starts])


@dataclass
class Attention:
    """Layers of the model; ``mean`` and ``scale`` bring statistics to one size."""

    mean: np.ndarray
    scale: np.ndarray
    layers: dict[str, np.ndarray]

    def forward(self, rows: np.ndarray, starts: np.ndarray):
        """Scores of bags whose passages are ``rows`` from each of ``starts`` on, and the steps."""
        p = self.layers
        x = (rows - self.mean) / self.scale
        code = np.tanh(x @ p["A"] + p["a"])
        tanh = np.tanh(code @ p["V"])
        gate = 1 / (1 + np.exp(-np.clip(code @ p["U"], -30, 30)))
        energy = (tanh * gate) @ p["w"]
        bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(rows))))
        energy = np.exp(energy - np.maximum.reduceat(energy, starts)[bag])
        share = energy / np.add.reduceat(energy, starts)[bag]
        mixed = np.add.reduceat(share[:, None] * code, starts)
        score = 1 / (1 + np.exp(-np.clip(mixed @ p["c"] + p["b"], -30, 30)))
        return score, (x, code, tanh, gate, share, mixed, bag)

    def gradients(self, rows: np.ndarray, starts: np.ndarray, labels: np.ndarray):
        p = self.layers
        score, (x, code, tanh, gate, share, mixed, bag) = self.forward(rows, starts)
        error = (score - labels) / len(labels)
        into_mixed = error[:, None] * p["c"]
        along = (code * into_mixed[bag]).sum(axis=1)
        mean = np.add.reduceat(share * along, starts)
        into_energy = share * (along - mean[bag])
        into_tanh = into_energy[:, None] * p["w"] * gate * (1 - tanh**2)
        into_gate = into_energy[:, None] * p["w"] * tanh * gate * (1 - gate)
        into_code = share[:, None] * into_mixed[bag] + into_tanh @ p["V"].T + into_gate @ p["U"].T
        into_code *= 1 - code**2
        return {
            "c": mixed.T @ error, "b": error.sum(keepdims=True), "w": (tanh * gate).T @ into_energy,
            "V": code.T @ into_tanh, "U": code.T @ into_gate, "A": x.T @ into_code,
            "a": into_code.sum(axis=0),
        }


def _batches(bags: list[np.ndarray], most: int) -> list[slice]:
    """Cuts ``bags`` into runs of at most ``most`` passages; a larger bag is a run of its own."""
    out, start, held = [], 0, 0
    for i, bag in enumerate(bags):
        if i > start and held + len(bag) > most:
            out.append(slice(start, i))
            start, held = i, 0
        held += len(bag)
    return [*out, slice(start, len(bags))]


def learn(
    bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7, batch: int = BATCH
) -> Attention:
    """By Adam over all bags at once, whose gradients are added up in batches of at most ``batch``
    passages. Without both labels the score is the smoothed share of label 1 for every text."""
    draw = np.random.default_rng(seed)
    bags = bags or [np.zeros((1, _FEATURES), np.float32)]
    cuts = _batches(bags, batch)

    def read(cut: slice) -> np.ndarray:
        return np.concatenate(bags[cut]).astype(np.float32)

    parts = [read(cuts[0])] if len(cuts) == 1 else None  # several are read again at each step
    sizes = [np.array([len(b) for b in bags[cut]]) for cut in cuts]
    starts = [np.cumsum(n) - n for n in sizes]
    count = sum(int(n.sum()) for n in sizes)
    mean = sum(rows.sum(axis=0, dtype=float) for rows in parts or map(read, cuts)) / count
    square = sum(((rows - mean) ** 2).sum(axis=0) for rows in parts or map(read, cuts)) / count
    layers = {
        "A": draw.normal(0, 1 / np.sqrt(_FEATURES), (_FEATURES, CODE)), "a": np.zeros(CODE),
        "V": draw.normal(0, 0.5, (CODE, GATE)), "U": draw.normal(0, 0.5, (CODE, GATE)),
        "w": draw.normal(0, 0.5, GATE), "c": draw.normal(0, 0.5, CODE), "b": np.zeros(1),
    }
    layers = {k: v.astype(np.float32) for k, v in layers.items()}
    scale = np.maximum(np.sqrt(square), 0.02)
    model = Attention(mean.astype(np.float32), scale.astype(np.float32), layers)
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        layers["c"][:], layers["b"][:] = 0, np.log(share / (1 - share))
        return model
    first = {k: np.zeros_like(v) for k, v in layers.items()}
    second = {k: np.zeros_like(v) for k, v in layers.items()}
    for step in range(1, epochs + 1):
        total = {k: 1e-4 * layers[k] for k in layers}
        for cut, at, rows in zip(cuts, starts, parts or map(read, cuts)):
            share = len(at) / len(labels)
            for k, g in model.gradients(rows, at, labels[cut]).items():
                total[k] += np.float32(share) * g
        for k, g in total.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            size = np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8
            layers[k] -= (RATE * first[k] / (1 - 0.9**step) / size).astype(np.float32)
    return model


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, sample: int
) -> DataFrame:
    """(doc_id, text, label) of the ``sample`` labelled documents with the least hashes of their
    ids among those with crc32(doc_id as text) mod ``folds`` other than ``held``. Rows without id
    or label are left out; of several labels the largest counts."""
    usable = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(
        F.col("label").isNotNull() & (fold(F.col("doc_id"), folds) != held)
    )
    chosen = (
        usable.groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    # ``sample`` ids and labels at most
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0,
    sample: int = SAMPLE,
) -> Attention:
    """The model of ``labels`` (doc_id, ``label`` 0 or 1) over ``docs`` (doc_id, text), from all
    passages of the ``labelled_sample``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [passages(t.as_py()).astype("<f2").tobytes() for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.binary())],
                ["doc_id", "label", "rows"],
            )

    rows = labelled_sample(docs, labels, label, folds, held, sample).select(
        F.col("doc_id").cast("long"), "label", F.col("text").cast("binary").alias("_text")
    )
    found = rows.mapInArrow(run, "doc_id long, label int, rows binary").collect()
    found = sorted(found, key=lambda r: (r.doc_id, bytes(r.rows)))
    bags = [np.frombuffer(r.rows, "<f2").reshape(-1, _FEATURES) for r in found]
    return learn(bags, np.array([min(1, max(0, r.label)) for r in found], np.float32))


def scored(docs: DataFrame, model: Attention) -> DataFrame:
    """(doc_id, score) of every row of ``docs`` (doc_id, text), from its whole text; null and
    empty texts are one passage without words. Null ids and repeated rows stay, other columns
    are not read, an empty table gives an empty result."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for text in batch.column("_text"):
                score, _ = model.forward(passages(text.as_py()), np.zeros(1, np.int64))
                scores.append(float(score[0]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"]
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("_text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def kept(docs: DataFrame, model: Attention, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, all columns as they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = docs_columns.index("text")
        for batch in batches:
            scores = [
                model.forward(passages(None if t is None else t.encode()), np.zeros(1, np.int64))[0][0]
                for t in batch.column(at).to_pylist()
            ]
            yield batch.filter(pa.array([bool(s >= threshold) for s in scores], pa.bool_()))

    docs_columns = docs.columns
    return docs.mapInArrow(run, docs.schema)


def predictions(scores: DataFrame, folds: int, held: int, threshold: float = 0.3) -> DataFrame:
    """``scores`` with held_out and predicted."""
    return scores.select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
