"""Language-model scores by a weighted backoff automaton.

States are contexts (the last words read, at most ``order`` - 1 of them, and the empty one),
arcs are the n-grams of the training texts. From a state with context h the arc for w weighs
log10 of (c(hw) + m * p(w | h')) / (c(h) + m), where h' is h without its oldest word; where there
is no such arc, the failure arc to h' weighs log10 of m / (c(h) + m) and w is read from there.
With m > 0 the weights of what can follow a state add up to one. The empty state reads any token
with the add-0.1 base probability. A text is read once from left to right.

The model grows with the corpus, so nobody holds it whole. Documents are dealt to blocks; each
block asks for the training counts of its own different n-grams, by 64-bit keys that are packed
and sent to buckets by range; a bucket adds up what all blocks trained and answers each block in
the order of its question, so answers need no keys. A block then has exactly the part of the
automaton that its texts walk through. Keys spread evenly whatever the words are: a very
frequent n-gram comes once from each block, with its count.

Two n-grams share a key with a probability of about n^2 / 2^65 for n different ones: 10^-6 for ten
million, a few pairs for ten billion.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from voxtally.llm.common import fold

ORDER = 2
#: Most bytes of text in a block, about.
BLOCK_BYTES = 10 << 20
#: Words that a worker remembers while it counts.
WORDS = 1 << 20
ADDED = 0.1
#: Pseudo-counts that a context gives to its shorter one.
MASS = 16.0
_START, _END = b" ", b""  # neither is ever a word


def _mix(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A key for ``word`` after the n-gram with the key ``context``."""
    x = context * np.uint64(0x9E3779B97F4A7C15) + word
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Numbers(dict):
    """Words numbered as they come; the end token is 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Reader:
    """Turns texts into word hashes, or into numbers of words by which ``hashes`` has these."""

    def __init__(self):
        self.known = _Numbers({_END: 0})
        self.end, self.start = xxhash.xxh64_intdigest(_END), xxhash.xxh64_intdigest(_START)

    def __call__(self, text: bytes | None) -> np.ndarray:
        numbers = self.numbers(text)
        return self.hashes()[numbers]

    def numbers(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()
        words.append(_END)
        return np.fromiter(map(self.known.__getitem__, words), np.int32, len(words))

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, self.known), np.uint64, len(self.known))


class Block:
    """The tokens of some documents and the keys of their n-grams."""

    def __init__(self, texts, order: int):
        read = Reader()
        parts = [read.numbers(t.as_py()) for t in texts]
        table = read.hashes()
        read.known.clear()
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        numbers = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        words = table[numbers]
        del parts
        self.starts = np.cumsum(sizes) - sizes
        self.sizes, self.order = sizes, order
        place = (np.arange(len(words)) - np.repeat(self.starts, sizes)).astype(np.int32)
        zero = np.zeros(1, np.uint64)
        self.start_key = _mix(zero, np.array([read.start], np.uint64))
        single = _mix(zero, table if len(numbers) else table[:0])
        grams = [single[numbers]]
        self.has = [np.ones(len(words), bool)]
        for n in range(2, order + 1):
            before = np.concatenate((zero, grams[-1][:-1]))
            if n == 2:
                before[place == 0] = self.start_key[0]
            grams.append(_mix(before, words))
            self.has.append(place >= n - 2)
        # Single words are different already; only longer n-grams are put in order, each length by itself.
        different, places = [single], [numbers]
        for n in range(1, order):
            keys, at = np.unique(grams[n][self.has[n]], return_inverse=True)
            different.append(keys)
            places.append(at.astype(np.int32))  # a block has fewer keys than that by far
        del grams, words, place
        self.keys, at = np.unique(np.concatenate([*different, self.start_key]), return_inverse=True)
        at = at.astype(np.int32)
        ends = np.cumsum([0, *map(len, different)])
        self.at = np.concatenate([*(at[e : e + len(d)][p] for e, d, p in zip(ends, different, places)), at[-1:]])

    def trained(self, learn: np.ndarray) -> np.ndarray:
        """How often each key occurs in the documents to learn from."""
        learned = np.repeat(learn, self.sizes)
        weights = np.concatenate([*(learned[h] for h in self.has), [learn.sum()]])
        return np.bincount(self.at, weights, len(self.keys)).astype(np.int64)

    def cuts(self, buckets: int) -> np.ndarray:
        """Where the keys of each bucket begin; the last number is their end."""
        bounds = [(b << 64) // buckets for b in range(1, buckets)]
        inner = np.searchsorted(self.keys, np.array(bounds, np.uint64))
        return np.concatenate(([0], inner, [len(self.keys)]))

    def walk(self, counts: np.ndarray, total: int, different: int, mass: float):
        """Per document: known tokens, base score and score. ``counts`` has the training count of
        each of ``keys``."""
        found = counts[self.at].astype(np.float64)
        read = np.split(found[:-1], np.cumsum([h.sum() for h in self.has])[:-1])
        start = found[-1]
        base = np.log10((read[0] + ADDED) / (total + ADDED * (different + 1)))
        weight, context = base.copy(), read[0]
        for n in range(2, self.order + 1):
            here = np.flatnonzero(self.has[n - 1])
            # What was read up to the token before, as long as the context is.
            before = np.zeros(len(base))
            before[1:] = context[:-1]
            if n == 2:
                before[self.starts] = start
            state = before[here] + mass
            del before
            lower = weight[here]
            arc = np.log10((read[n - 1] + mass * 10.0**lower) / state)
            failure = np.log10(mass / state)
            weight[here] = np.where(read[n - 1] > 0, arc, failure + lower)
            context = np.zeros(len(base))
            context[here] = read[n - 1]
        if not len(base):
            return np.zeros(0, np.int64), base, base
        known = np.add.reduceat((read[0] > 0).astype(np.int64), self.starts)
        return known, np.add.reduceat(base, self.starts), np.add.reduceat(weight, self.starts)


def _pack(numbers: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers, byte by byte of equal weight, compressed."""
    octets = numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(octets).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    octets = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(octets.T).view("<u8").reshape(-1)


def token_totals(rows: DataFrame) -> tuple[int, int]:
    """(N, V): tokens and different tokens of the rows (_text, _learn) to learn from."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader()
        for batch in batches:
            parts = [read.numbers(t.as_py()) for t in batch.column("_text")]
            counts = np.bincount(np.concatenate(parts or [np.zeros(0, np.int32)]), minlength=len(read.known))
            words, counts = read.hashes()[counts > 0], counts[counts > 0]
            if len(read.known) > WORDS:
                read = Reader()
            yield pa.RecordBatch.from_arrays(
                [pa.array(words.view(np.int64)), pa.array(counts.astype(np.int64))], ["word", "n"]
            )

    counted = rows.filter("_learn").select("_text").mapInArrow(run, "word long, n long")
    totals = counted.groupBy("word").agg(F.sum("n").alias("n")).agg(F.sum("n"), F.count("n")).first()
    return int(totals[0] or 0), int(totals[1])


def scored(
    docs: DataFrame, folds: int = 10, order: int = ORDER, mass: float = MASS,
    blocks: int | None = None,
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score.

    Words are split at ASCII white space after lower-casing A-Z and followed by one end token.
    The model learns from the documents whose crc32(doc_id as text) modulo ``folds`` is not 0
    and from those with a null id; the others are held out. Null and empty texts are the end
    token alone. Repeated rows count each. Without any row to learn from every token has the
    base probability of an unknown one. Other columns are not read; an empty table gives an
    empty result. A worker holds one block's tokens at a time, or the keys that all blocks have in
    one bucket. There are so many blocks that none has more than about ``BLOCK_BYTES`` of text, and
    half as many buckets; at least as many buckets as the session has shuffle partitions.
    """
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if blocks is None:
        size = docs.agg(F.sum(F.octet_length(F.col("text").cast("binary")))).first()[0] or 0
        blocks = max(2 * buckets, -(-size // BLOCK_BYTES))
        buckets = max(buckets, blocks // 2)
    rows = docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("_text"),
        (F.coalesce(fold(F.col("doc_id"), folds), F.lit(-1)) != 0).alias("_learn"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("_block"),
    )
    total, different = token_totals(rows)

    def ask(block: pa.Table) -> pa.Table:
        own = Block(block.column("_text"), order)
        trained = own.trained(block.column("_learn").to_numpy())
        cuts, number = own.cuts(buckets), block.column("_block")[0].as_py()
        spans = [(b, s, e) for b, (s, e) in enumerate(zip(cuts, cuts[1:])) if s < e]
        return pa.table({
            "bucket": pa.array([b for b, _, _ in spans], pa.int32()),
            "_block": pa.array([number] * len(spans), pa.int32()),
            "keys": [_pack(np.diff(own.keys[s:e], prepend=np.uint64(0))) for _, s, e in spans],
            "counts": [_pack(trained[s:e]) for _, s, e in spans],
        })

    def answer(bucket: pa.Table) -> pa.Table:
        keys = [np.cumsum(_unpack(k.as_py()), dtype=np.uint64) for k in bucket.column("keys")]
        counts = [_unpack(c.as_py()) for c in bucket.column("counts")]
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(at, np.concatenate(counts)).astype(np.int64)[at]
        ends = np.cumsum([len(k) for k in keys])
        return pa.table({
            "_block": bucket.column("_block"), "bucket": bucket.column("bucket"),
            "counts": [_pack(sums[e - len(k) : e]) for k, e in zip(keys, ends)],
        })

    def score(block: pa.Table, answers: pa.Table) -> pa.Table:
        own = Block(block.column("_text"), order)
        by_bucket = dict(zip(answers.column("bucket").to_pylist(), answers.column("counts")))
        parts = [_unpack(by_bucket[b].as_py()) for b in sorted(by_bucket)]
        counts = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        known, base, weight = own.walk(counts, total, different, mass)
        return pa.table({
            "doc_id": block.column("doc_id"),
            "held_out": pa.array(~block.column("_learn").to_numpy()),
            "n_tokens": own.sizes, "n_known": known,
            "train_tokens": np.full(len(own.sizes), total),
            "base_score": base, "score": weight,
        })

    asked = rows.groupBy("_block").applyInArrow(ask, "bucket int, _block int, keys binary, counts binary")
    answers = asked.groupBy("bucket").applyInArrow(answer, "_block int, bucket int, counts binary")
    return rows.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(
        score,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double",
    )
