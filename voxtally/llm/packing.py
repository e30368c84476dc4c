"""Best-fit packing of documents into token sequences, in bulk-synchronous rounds.

Documents become pieces of at most ``capacity`` tokens. A round takes all pieces of one
length, longest first, and the gaps sorted by size: the pieces sweep the gaps from their
successor (the smallest gap that holds one) upwards, pieces of equal length settle by rank who
gets which gap, the gaps shrink, and the next round follows. What finds no gap opens sequences.
The outcome is that of best-fit decreasing, one piece after the other.

Lengths and gaps are whole numbers up to ``capacity``, so a range of equal size is one class and
pieces or sequences of a class differ by rank only. Hence the rounds need the *number* of pieces
of each length: at most ``capacity`` counts from a distributed aggregate, whatever the input.
Every round's moves are runs "pieces a to b of this length go to sequences s onwards, k in each,
from offset o"; all of them, a few per round, are then applied to the rows in one pass by rank.
Ranks within a length are counted within parts of it and shifted by the parts' totals, as one
length may hold a third of all pieces.
"""

import sys
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from voxtally.sources.checkpoints import settle

CAPACITY = 4096
END = 1
#: Words, and parts of words, that a worker remembers with their ids; then it starts afresh.
REMEMBERED = 500_000

_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Characters whose normal form and lower case are sure to act on each alone.
_PLAIN = regex.compile(r"[!-;=-~À-ÖØ-öø-ÿ]+")
#: Byte-level vocabularies write visible bytes as themselves, the others from 256 on.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b) for b in _VISIBLE} | {
    b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(_VISIBLE))
}


class WordIds:
    """Token ids of whole texts, put together from the ids of their words.

    The vocabulary's rules never join what white space parts, so a text's ids are those of its
    words in a row, and a word is looked up after its first time. A word of plain letters and
    signs is cut by the vocabulary's own pattern and goes straight to the merges; any other is
    encoded by the tokenizer as it is.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def __call__(self, text: bytes) -> bytes:
        """Ids of a text in UTF-8 as little-endian unsigned 32-bit numbers."""
        words = text.split()  # ASCII white space
        ids = list(map(self.known.get, words))
        if None in ids:
            if len(self.known) > REMEMBERED:
                self.known = {}
            if len(self.parts) > REMEMBERED:
                self.parts = {}
            for i, known in enumerate(ids):
                if known is None:
                    word = words[i]
                    ids[i] = self.known.get(word) or self.known.setdefault(word, self._word(word))
        return b"".join(ids)

    def _word(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters alone are one part
            return self._remembered(word.decode().lower())
        chars = word.decode("utf-8")
        if not _PLAIN.fullmatch(chars):
            return _packed(self.tokenizer.encode(chars, add_special_tokens=False).ids)
        return b"".join([self._remembered(p) for p in _PIECE.findall(chars.lower())])

    def _remembered(self, part: str) -> bytes:
        return self.parts.get(part) or self.parts.setdefault(part, self._part(part))

    def _part(self, part: str) -> bytes:
        written = part if part.isascii() else "".join([_BYTES[b] for b in part.encode()])
        return _packed([t.id for t in self.tokenizer.model.tokenize(written)])


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def _encoder(path: str) -> WordIds:
    """The worker's own, kept from task to task."""
    kept = sys.modules.setdefault("_kept_by_worker", ModuleType("_kept_by_worker")).__dict__
    return kept.get(path) or kept.setdefault(path, WordIds(path))


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids and ``end``, cut every
    ``capacity`` ids. ``vocabulary`` is a tokenizer file that every executor has."""
    tail = _packed([end])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary)
        step = 4 * capacity
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), []
            for doc_id, text in zip(ids, batch.column("_text")):
                data = encode(text.as_py() or b"") + tail
                rows += [
                    (doc_id, at // step, at // 4, len(part) // 4, zlib.crc32(part))
                    for at in range(0, len(data), step) for part in (data[at : at + step],)
                ]
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("_text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def moves(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs (length, first rank, first sequence, pieces in each, offset), ordered; ``counts``
    has the number of pieces of each length."""
    gaps: list[int] = []  # sizes with open sequences, ascending
    open_: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, how many)
    out, sequences = [], 0

    def keep(gap: int, first: int, many: int) -> None:
        if gap and many:
            if gap not in open_:
                insort(gaps, gap)
                open_[gap] = []
            open_[gap].append((first, many))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, many = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap], gaps[at]
            else:
                gap, first, many = capacity, sequences, -(-left // (capacity // length))
                sequences += many
            each = gap // length
            full = min(many, left // each)
            if full:
                out.append((length, rank, first, each, capacity - gap))
                keep(gap - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < many and left and left < each:
                out.append((length, rank, first + full, left, capacity - gap))
                keep(gap - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            keep(gap, first + full, many - full)
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with _rank, 0 onwards within each length."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    sizes = dealt.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    order = Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")
    return (
        dealt.withColumn("_row", F.row_number().over(order))
        .join(shifts, ["length", "_part"])
        .withColumn("_rank", F.col("_row") - 1 + F.col("_shift"))
        .drop("_part", "_row", "_shift")
    )


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32,
    sequence_id, offset.

    Sequences are filled without holes from offset 0. A null or empty text is the end id
    alone. Null and repeated ids are documents like others. Other columns are not read; an
    empty table gives an empty result.
    """
    cut = settle(pieces(docs, vocabulary, capacity, end))
    counts = dict(cut.groupBy("length").agg(F.count(F.lit(1))).toLocalIterator())  # <= capacity
    plan = moves({int(k): int(v) for k, v in counts.items()}, capacity)
    shift = 1 << 40  # more pieces of one length than that are out of reach
    starts = plan[:, 0] * shift + plan[:, 1]
    fields = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "_rank"))
            move = plan[np.searchsorted(starts, length * shift + rank, "right") - 1]
            nth = rank - move[:, 1]
            sequence, place = move[:, 2] + nth // move[:, 3], move[:, 4] + nth % move[:, 3] * length
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in fields), pa.array(sequence), pa.array(place)],
                [*fields, "sequence_id", "offset"],
            )

    schema = (
        "doc_id long, piece int, start long, length long, ids_crc32 long, "
        "sequence_id long, offset long"
    )
    return ranked(cut).mapInArrow(run, schema)
