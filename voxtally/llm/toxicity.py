"""Toxicity by a weighted finite-state pattern grammar.

Five transducers read the tokens of a clause and write marks: insults (a trie of word beginnings
whose final states carry learned weights), threats, targets, negations and reported speech (the
last four from short word lists). Their composition reads the marks of a clause from left to
right; its state says whether a target, a negation within reach or a reporting verb or an open
quotation stands before. An insult or threat then leaves by one of the arcs plain, targeted,
negated or reported, each with its own weight, so it is matched clauses that are scored, never words
by themselves. The word beginnings and their weights come from document labels by grouped counts;
the arc weights by logistic regression over the arcs that labelled documents leave by. Both
learn from at most ``SAMPLE`` labelled documents; scores read whole texts.
"""

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxtally.llm.quality import labelled_sample

SAMPLE = 20_000
#: Most beginnings that the trie takes, those with the largest weights.
ARCS = 5_000
SHORTEST, LONGEST = 3, 12
#: Tokens that a negation reaches over.
REACH = 3
END = "\0"

TARGETS = frozenset(
    "you your yours yourself he him she her they them their these those people everyone "
    "du dich dir dein ihr euch euer sie ihnen tu te toi ton vous votre ils elles "
    "tú ti tu usted ustedes vosotros ellos ellas".split()
)
NEGATIONS = frozenset(
    "not no never nobody neither nor isn't aren't don't doesn't wasn't nicht kein keine keinen "
    "nie niemals ne pas jamais non nunca jamás ni".split()
)
REPORTS = frozenset(
    "said says say saying called calls wrote writes reported reports quoted quote sagte sagt "
    "nannte schrieb dit disait appelé écrit dijo dice llamó escribió".split()
)
THREATS = frozenset(
    "kill hurt destroy beat stab shoot burn murder töten umbringen schlagen verletzen tuer "
    "frapper brûler détruire matar golpear quemar destruir".split()
)
QUOTES = "\"“”«»„"
#: The arcs an insult or a threat can leave by, and what they are together.
WAYS = ("plain", "targeted", "negated", "reported")
FEATURES = tuple(f"{w} {x}" for x in ("insult", "threat") for w in WAYS) + (
    "strongest", "clauses", "density", "length",
)

_CLAUSE = re.compile(r"(?<![.!?;:\n])[.!?;:\n]++(?=\s|$)|\n")
_TOKEN = re.compile(rf"[{QUOTES}]|[^\W_]+(?:['’][^\W_]+)*")


def clauses(text: str) -> Iterator[list[str]]:
    """Lower-cased words and quotation marks of each clause that has any."""
    for part in _CLAUSE.split(text.lower()):
        tokens = _TOKEN.findall(part)
        if tokens:
            yield tokens


def beginnings(word: str) -> list[str]:
    """What the trie may accept of a word: its beginnings, and the whole word with an end."""
    return [word[:n] for n in range(SHORTEST, min(len(word), LONGEST) + 1)] + [word + END]


@dataclass
class Grammar:
    """``insults``: weights of the trie's final states. ``arcs``: weight of each feature,
    ``mean`` and ``scale`` their sizes, ``bias`` that of no match."""

    insults: dict[str, float]
    arcs: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    bias: float

    def insult(self, word: str) -> float:
        """The largest weight of a final state on the word's way through the trie."""
        weights = self.insults
        return max([weights.get(b, 0.0) for b in beginnings(word)])

    def marks(self, text: str, known: dict[str, float]) -> np.ndarray:
        """The features of one text."""
        out = np.zeros(len(FEATURES))
        size, matched = 0, 0
        for tokens in clauses(text):
            size += len(tokens)
            left = 0.0
            targeted, reported, quoted, negated = False, False, False, 0
            targets = not TARGETS.isdisjoint(tokens)
            for token in tokens:
                weight = known.get(token)
                if weight is None:
                    weight = known[token] = self.insult(token)
                threat = token in THREATS
                if weight > 0 or threat:
                    way = (
                        3 if reported or quoted else 2 if negated > 0
                        else 1 if targeted or targets else 0
                    )
                    out[way + 4 * (weight <= 0)] += weight if weight > 0 else 1.0
                    left = max(left, weight)
                negated -= 1
                if token in QUOTES:
                    quoted = not quoted
                elif token in NEGATIONS:
                    negated = REACH
                elif token in REPORTS:
                    reported = True
                elif token in TARGETS:
                    targeted = True
            out[8] = max(out[8], left)
            matched += left > 0
        out[9] = matched
        out[10] = out[:4].sum() / max(1, size) ** 0.5
        out[11] = size
        out[:8] = np.log1p(out[:8])
        out[9:12] = np.log1p(out[9:12])
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.arcs + self.bias, -30, 30)))


def insult_arcs(sample: DataFrame, arcs: int = ARCS) -> dict[str, float]:
    """Beginnings of words that toxic documents have much oftener than others, with the
    logarithm of how much. Kept are those that chance does not explain among all
    beginnings counted and that a shorter one does not explain as well."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = (Counter(), Counter())
            for text, label in zip(batch.column("text"), batch.column("label").to_pylist()):
                words = {w for tokens in clauses(text.as_py() or "") for w in tokens}
                seen[label > 0].update({b for w in words for b in beginnings(w)})
            keys = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.string()), pa.array([seen[1][k] for k in keys], pa.int64()),
                    pa.array([seen[0][k] for k in keys], pa.int64()),
                ],
                ["beginning", "toxic", "clean"],
            )

    toxic, clean = sample.agg(
        F.count_if(F.col("label") > 0), F.count_if(F.col("label") <= 0)
    ).first()
    if not toxic or not clean:
        return {}
    share = toxic / (toxic + clean)
    counted = (
        sample.select("text", "label").mapInArrow(run, "beginning string, toxic long, clean long")
        .groupBy("beginning").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
        .filter("t + c > 1")
    )
    n, part = F.col("t") + F.col("c"), F.col("t") / (F.col("t") + F.col("c"))

    def surprise(p, q):
        return F.when(p > 0, p * F.log(p / q)).otherwise(0.0)

    gain = n * (surprise(part, F.lit(share)) + surprise(1 - part, F.lit(1 - share)))
    weight = F.log((F.col("t") + 2 * share) / (F.col("c") + 2 * (1 - share))) - float(np.log(share / (1 - share)))
    # Chernoff: a share of toxic documents this large comes by chance in fewer than one in
    # 20 samples for any of some e^11 (60,000) beginnings.
    found = (
        counted.withColumn("gain", gain).withColumn("w", weight)
        .filter((part > share) & (F.col("gain") > 14.0) & (F.col("w") > 1.5))
        .orderBy(F.desc("w"), "beginning").limit(arcs).collect()
    )
    kept: dict[str, float] = {}
    for row in sorted(found, key=lambda r: (len(r.beginning), r.beginning)):
        shorter = max([kept.get(row.beginning[:i], 0.0) for i in range(1, len(row.beginning))], default=0.0)
        if row.w > shorter + 0.3:
            kept[row.beginning] = row.w
    return kept


def _features(rows: DataFrame, grammar: Grammar, columns: list[str]) -> DataFrame:
    """``columns`` of ``rows`` and their texts' features."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            if len(known) > 500_000:
                known.clear()
            marks = [grammar.marks(t.as_py() or "", known) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in columns),
                    pa.array([m.tolist() for m in marks], pa.list_(pa.float64())),
                ],
                [*columns, "features"],
            )

    kinds = {"doc_id": "doc_id long", "label": "label int"}
    schema = ", ".join([*(kinds[c] for c in columns), "features array<double>"])
    read = rows.select("text", *[F.col(c).cast(kinds[c].split()[1]).alias(c) for c in columns])
    return read.mapInArrow(run, schema)


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 40, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Newton's method with a ridge on all weights but the bias."""
    x = np.column_stack((x, np.ones(len(x))))
    weights, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (p - y) + penalty * weights
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    return weights[:-1], float(weights[-1])


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, held: int = 2,
    sample: int = SAMPLE,
) -> Grammar:
    """The grammar of ``labels`` (doc_id, ``label`` 0 or 1) over ``docs`` (doc_id, text). With one
    label only, every score is the smoothed share of label 1."""
    rows = labelled_sample(docs, labels, label, folds, held, sample)
    size = len(FEATURES)
    grammar = Grammar(insult_arcs(rows), np.zeros(size), np.zeros(size), np.ones(size), 0.0)
    found = _features(rows, grammar, ["doc_id", "label"]).collect()
    y = np.array([float(r.label > 0) for r in found])
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        grammar.bias = float(np.log(share / (1 - share)))
        return grammar
    x = np.array([r.features for r in found])
    grammar.mean, grammar.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 0.05)
    grammar.arcs, grammar.bias = _logistic((x - grammar.mean) / grammar.scale, y)
    return grammar


def scored(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """(doc_id, score, features) of every row of ``docs`` (doc_id, text), from its whole text;
    ``features`` are those named in ``FEATURES``. Null texts are empty; null ids and repeated rows
    stay, other columns are not read, an empty table gives an empty result."""
    found = _features(docs.select("doc_id", "text"), grammar, ["doc_id"])
    x = [
        (F.get("features", F.lit(i)) - float(m)) / float(s) * float(w)
        for i, (m, s, w) in enumerate(zip(grammar.mean, grammar.scale, grammar.arcs))
    ]
    total = sum(x[1:], x[0]) + grammar.bias
    bounded = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))
    return found.select("doc_id", (1 / (1 + F.exp(-bounded))).alias("score"), "features")
