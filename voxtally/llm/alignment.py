"""Tokens of two vocabularies over the same text, linked where they end together, with how often
each pair of ids is linked in the whole corpus.

Counting is external. Workers collect a record for every link (B's id, A's id, document), sort them
by pair when a buffer is full, and write each radix of B's ids as its own run of zstd blocks. Runs of
neighbouring input partitions make a unit, whose size does not grow with the input, however
frequent a pair is. The runs of a unit are merged by a heap, block by block, into one run of counts;
units are merged together until a radix has few runs; the last merge goes through the pairs in order
of B's id, so that an id's highest count is known when the next id begins. The totals, whose number
the vocabularies bound, go back to every unit, where the runs are read again in the same order and
each document gets its share.
"""

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark import TaskContext
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame, functions as F

from voxtally.llm.byte_bpe import LONGEST, Vocabulary, chunks, kept_by_worker, utf8_texts, valid
from voxtally.llm.packing import _BYTES
from voxtally.sources.checkpoints import settle

#: Radixes of B's ids, input partitions in a unit, runs merged at a time.
RADIXES, PARTITIONS, FAN = 8, 4, 16
#: Links that a worker collects before it sorts them, records in a block, bytes encoded at a time.
BUFFER, BLOCK, CHUNK = 1 << 19, 1 << 14, 1 << 18
#: Words that a worker remembers for each vocabulary; then it starts afresh.
REMEMBERED = 200_000

BLOCKS = "radix int, unit int, part int, run int, block int, data binary"
DOCUMENT = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long"


class Pair:
    """The two vocabularies: A, byte-level, and B, of pieces with bytes for the rest.

    Both are read word by word, each word remembered. A's rules join what its pattern keeps together
    and rank a merge by the id that it makes. B's pieces have no space after another character, so no
    rule of B joins across the start of a run of spaces.
    """

    def __init__(self, path_a: str, path_b: str):
        with open(path_a, encoding="utf-8") as file:
            model = json.load(file)["model"]
        written = {c: b for b, c in _BYTES.items()}
        made = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        tokens = [*written, *("".join(m) for m in made)]
        ranks = {bytes(written[c] for c in t): model["vocab"][t] for t in tokens}
        library = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a = Vocabulary(ranks, REMEMBERED, library._encode_single_piece)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = [b""] * (max(self.a.ranks.values()) + 1)
        for token, i in self.a.ranks.items():
            self.bytes_a[i] = token
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.whole = any(b" " in t.lstrip(b" ") for t in self.bytes_b)  # then words say nothing
        self.known_b: dict[bytes, bytes] = {}
        self.sizes_a, self.sizes_b = (
            np.fromiter(map(len, every), np.int64, len(every)) for every in (self.bytes_a, self.bytes_b)
        )
        # An id inside its part of a group and the last there: A's "7," and "7|", B's "7," and "7;".
        self.digits = [b"%d%s" % (i, end) for i in range(len(self.bytes_a)) for end in (b",", b"|")]
        self.digits += [b"%d%s" % (i, end) for i in range(len(self.bytes_b)) for end in (b",", b";")]

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def _encode_b(self, text: bytes) -> np.ndarray:
        """Ids of a text that starts with the space that B adds itself; none if a word's tokens do not
        have the word's bytes."""
        words = [text] if self.whole else _WORDS.findall(text)
        found = list(map(self.known_b.get, words))
        if None in found:
            if len(self.known_b) > REMEMBERED:
                self.known_b = {}
            new = [i for i, known in enumerate(found) if known is None]
            coded = self.b.encode([words[i][1:].decode() for i in new], num_threads=1)
            for i, ids in zip(new, coded):
                if words[i] == b" ":  # at the end of a text; B adds no space to nothing
                    ids = [self.b.piece_to_id("▁")]
                same = b"".join(map(self.bytes_b.__getitem__, ids)) == words[i]
                found[i] = array("I", ids).tobytes() if same else b""
                if len(words[i]) <= LONGEST:
                    self.known_b[words[i]] = found[i]
        return np.frombuffer(b"".join(found), "<u4").astype(np.int64) if all(found) else _NONE

    def encode(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids by A of space and text, and by B of the text, for each of ``texts``; none where the
        text is empty or the bytes of either side's tokens are not those of space and text."""
        wanted = [b" " + t for t in texts]
        ids, many = self.a.encode(wanted)
        ids, ends = ids.astype(np.int64), np.cumsum(many).tolist()
        for text, want, start, end in zip(texts, wanted, [0, *ends], ends, strict=False):
            b = self._encode_b(want) if text else _NONE  # A's merges only part the bytes they are given
            yield (ids[start:end] if len(b) else _NONE), b


#: A run of spaces and the characters up to the next.
_WORDS = re.compile(rb" +[^ ]*")
_NONE = np.zeros(0, np.int64)


class Aligned:
    """Ids of both sides of one text, ``group_a`` and ``group_b`` of each token, and the places
    ``link_a`` and ``link_b`` of the tokens that end together. No token is without bytes, so just
    one of each side ends where a group does."""

    def __init__(self, pair: Pair, a: np.ndarray, b: np.ndarray):
        self.pair, self.a, self.b = pair, a, b
        ends_a, ends_b = np.cumsum(pair.sizes_a[a]), np.cumsum(pair.sizes_b[b])
        at = np.searchsorted(ends_b, ends_a)
        hit = ends_b[at] == ends_a if len(a) else np.zeros(0, bool)
        self.link_a, self.link_b = np.flatnonzero(hit), at[hit]
        common = ends_a[hit]
        self.group_a, self.group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)

    def written(self) -> bytes:
        """The groups as ``a1,a2|b1;a3|b2,b3``."""
        code_a, code_b = 2 * self.a, 2 * (self.b + len(self.pair.bytes_a))
        code_a[self.link_a] += 1
        code_b[self.link_b] += 1
        order = np.argsort(np.concatenate([2 * self.group_a, 2 * self.group_b + 1]), kind="stable")
        codes = np.concatenate([code_a, code_b])[order]
        return b"".join(map(self.pair.digits.__getitem__, codes.tolist()))[:-1]

    def pairs(self) -> np.ndarray:
        """B's id and A's id of each link in one number, B's first."""
        return self.b[self.link_b] << 32 | self.a[self.link_a]


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of numbers, each byte's place by itself, as one zstd frame with their lengths."""
    head = np.array([len(columns), *(len(c) << 4 | c.itemsize for c in columns)], "<i8").tobytes()
    body = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns]
    return zstandard.compress(head + b"".join(body))


def _unpacked(frame: bytes) -> list[np.ndarray]:
    data = zstandard.decompress(frame)
    many = int(np.frombuffer(data, "<i8", 1)[0])
    at, out = 8 * (many + 1), []
    for size in np.frombuffer(data, "<i8", many, 8).tolist():
        rows, width = size >> 4, size & 15
        bytes_ = np.frombuffer(data, np.uint8, rows * width, at).reshape(width, rows).T
        out.append(np.ascontiguousarray(bytes_).view(f"<i{width}").ravel())
        at += rows * width
    return out


def _runs(pairs: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(radix, block, frame) of links in the order of their rows: pair, records of the pair; row and
    number of links of each record."""
    order = np.argsort(pairs, kind="stable")
    pairs, rows = pairs[order], rows[order]
    new = np.append(True, (pairs[1:] != pairs[:-1]) | (rows[1:] != rows[:-1]))
    starts = np.flatnonzero(new)
    pairs, rows, many = pairs[starts], rows[starts], np.diff(np.append(starts, len(new)))
    radix = (pairs >> 32) % RADIXES
    for r in range(RADIXES):
        own = np.flatnonzero(radix == r)
        for k, at in enumerate(range(0, len(own), BLOCK)):
            block = own[at : at + BLOCK]
            pair, records = np.unique(pairs[block], return_counts=True)
            yield r, k, _packed(pair, records.astype("<i4"), rows[block].astype("<i4"), many[block].astype("<i4"))


def _read(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Both what is known of each document by itself and the runs of its links, in rows of two kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = kept_by_worker(("pair", path_a, path_b), lambda: Pair(path_a, path_b))
        part = TaskContext.get().partitionId()
        row = held = flushed = 0
        pairs, rows = [], []

        def flush() -> pa.RecordBatch:
            nonlocal held, flushed, pairs, rows
            found = [
                {"radix": r, "unit": part // PARTITIONS, "part": part, "run": flushed, "block": k, "data": data}
                for r, k, data in _runs(np.concatenate(pairs), np.concatenate(rows))
            ]
            held, flushed, pairs, rows = 0, flushed + 1, [], []
            return pa.RecordBatch.from_pylist(found, kinds)

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            texts = [valid(t.as_py()) for t in batch.column("_text")]
            for start, stop in chunks(list(map(len, texts)), CHUNK):
                out = []
                for doc_id, (a, b) in zip(ids[start:stop], pair.encode(texts[start:stop])):
                    aligned = Aligned(pair, a, b)
                    links = aligned.pairs()
                    groups = hashlib.sha256(aligned.written()).hexdigest() if len(a) else ""
                    out.append({
                        "row": part << 32 | row, "doc_id": doc_id, "n_a": len(a), "n_b": len(b),
                        "n_groups": len(links), "n_links": len(links), "groups_sha256": groups,
                    })
                    if len(links):
                        pairs.append(links)
                        rows.append(np.full(len(links), row))
                        held += len(links)
                    row += 1
                    if held >= BUFFER:
                        yield flush()
                yield pa.RecordBatch.from_pylist(out, kinds)
        if held:
            yield flush()

    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    schema = f"{DOCUMENT}, groups_sha256 string, {BLOCKS}"
    kinds = pa.schema([(name, types[kind]) for name, kind in (c.split() for c in schema.split(", "))])
    return utf8_texts(docs).mapInArrow(run, schema)


def _by_key(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Groups of neighbouring rows with the same ``key``."""
    rows = (row for batch in batches for row in batch.to_pylist())
    return groupby(rows, lambda r: tuple(r[k] for k in key))


def _counted(frames: list[bytes]) -> Iterator[tuple[int, int]]:
    """(pair, links) of a run, whose blocks are opened one after the other. A block of links has
    the records of each pair; a block of counts has a number for each."""
    for frame in frames:
        pair, many, *rest = _unpacked(frame)
        if rest:
            many = np.add.reduceat(rest[1].astype(np.int64), np.cumsum(many) - many)
        yield from zip(pair.tolist(), many.tolist())


def _merged(runs: list[list[bytes]]) -> Iterator[tuple[int, int]]:
    """(pair, links) of all ``runs``, ascending, each pair once."""
    ordered = heapq.merge(*map(_counted, runs))
    for pair, same in groupby(ordered, lambda x: x[0]):
        yield pair, sum(n for _, n in same)


def _with_best(counts: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """(pair, links, whether no other pair of the same B id has more)."""
    for _, same in groupby(counts, lambda x: x[0] >> 32):
        same = list(same)  # at most as many as A has ids
        most = max(n for _, n in same)
        yield from ((pair, n, int(n == most)) for pair, n in same)


def _grouped(blocks: DataFrame) -> DataFrame:
    """The blocks of a radix and unit together, in the order in which they were written."""
    return blocks.repartition("radix", "unit").sortWithinPartitions("radix", "unit", "part", "run", "block")


def _merge(blocks: DataFrame, fan: int | None) -> DataFrame:
    """A run of counts for each radix and unit; then ``fan`` units become one, or are the totals of
    the radix (with the mark of the highest) if ``fan`` is None."""
    names = [c.split()[0] for c in BLOCKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (radix, unit), rows in _by_key(batches, ["radix", "unit"]):
            runs = [[r["data"] for r in own] for _, own in groupby(rows, lambda r: (r["part"], r["run"]))]
            counts = _merged(runs) if fan else _with_best(_merged(runs))
            at, block = (unit // fan, unit) if fan else (0, 0), 0
            while found := list(islice(counts, BLOCK)):
                columns = np.array(found, "<i8").T
                frame = _packed(*columns)
                row = [radix, at[0], at[1], 0, block, frame]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([x], pa.int32()) for x in row[:-1]), pa.array([frame], pa.binary())], names
                )
                block += 1

    return _grouped(blocks).mapInArrow(run, BLOCKS)


def _totals(blocks: DataFrame, units: int) -> DataFrame:
    """Blocks of (pair, links, best) of the whole corpus: the counts of each unit, then of ``FAN``
    units together until a radix has one unit of at most ``FAN`` runs."""
    counts = settle(_merge(blocks, FAN))
    units = -(-units // FAN)
    while units > 1:
        counts = settle(_merge(counts, FAN))
        units = -(-units // FAN)
    return settle(_merge(counts, None))


def _shares(blocks: DataFrame, totals: DataFrame, units: int) -> DataFrame:
    """(row, n_best, count_sum) of the links of each document in each radix."""
    every = F.explode(F.sequence(F.lit(0), F.lit(units - 1)))
    known = totals.select("radix", every.alias("unit"), F.lit(-1).alias("part"), "run", "block", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_key(batches, ["radix", "unit"]):
            whole, table = [], None
            for part, own in groupby(rows, lambda r: r["part"]):
                if part < 0:
                    whole = [_unpacked(r["data"]) for r in own]
                    table = [np.concatenate(c) for c in zip(*whole)]
                    continue
                rows_, best, total = [], [], []
                for r in own:
                    pair, records, row, many = _unpacked(r["data"])
                    at = np.repeat(np.searchsorted(table[0], pair), records)
                    rows_.append(row)
                    best.append(many * table[2][at])
                    total.append(many * table[1][at])
                row, at = np.unique(np.concatenate(rows_), return_inverse=True)
                out = np.zeros((2, len(row)), np.int64)
                np.add.at(out[0], at, np.concatenate(best))
                np.add.at(out[1], at, np.concatenate(total))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part << 32 | row.astype(np.int64)), pa.array(out[0]), pa.array(out[1])],
                    ["row", "n_best", "count_sum"],
                )

    return _grouped(blocks.unionByName(known)).mapInArrow(run, "row long, n_best long, count_sum long")


def groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, groups: the groups of each text of ``docs`` (doc_id, text) as ``a1,a2|b1;a3|b2,b3``,
    empty where the text has no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = kept_by_worker(("pair", path_a, path_b), lambda: Pair(path_a, path_b))
        for batch in batches:
            texts = [valid(t.as_py()) for t in batch.column("_text")]
            for start, stop in chunks(list(map(len, texts)), CHUNK):
                out = [Aligned(pair, a, b).written().decode() for a, b in pair.encode(texts[start:stop])]
                ids = batch.column("doc_id").slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.string())], ["doc_id", "groups"])

    return utf8_texts(docs).mapInArrow(run, "doc_id long, groups string")


def alignment(docs: DataFrame, path_a: str, path_b: str) -> tuple[DataFrame, DataFrame]:
    """Two tables for ``docs`` (doc_id, text), read by the vocabularies at ``path_a`` (byte-level) and
    ``path_b`` (pieces), which every executor has.

    The first has a row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and
    groups_sha256 (of ``groups``; empty without tokens). The second has a row for each pair of ids
    that is linked anywhere: b_id, a_id, links, best.

    A null or empty text, and one that the tokens of either side do not give back byte by byte, has
    no tokens: zeros. Bytes that are no UTF-8 count as U+FFFD. Null and repeated ids are documents
    like others, repeated texts count each time, other columns are not read, an empty table gives two
    empty results.
    """
    read = settle(_read(docs, path_a, path_b))
    documents = read.filter("row IS NOT NULL").select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    blocks = read.filter("data IS NOT NULL").select("radix", "unit", "part", "run", "block", "data")
    units = 1 + (blocks.agg(F.max("unit")).first()[0] or 0)
    totals = _totals(blocks, units)
    shares = _shares(blocks, totals, units).groupBy("row").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")
    )
    result = documents.join(shares.hint("merge"), "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256",
    )
    return result, _pairs(totals)


def _pairs(totals: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for frame in batch.column("data"):
                pair, links, best = _unpacked(frame.as_py())
                columns = [pair >> 32, pair & 0xFFFFFFFF, links, best.astype(bool)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["b_id", "a_id", "links", "best"])

    return totals.select("data").mapInArrow(run, "b_id long, a_id long, links long, best boolean")
