"""Byte-level BPE, text to ids and back, with the cuts before merging found by array operations.

The cuts are those of the usual pattern of rank files: contractions, an optional space before
letters, numbers or other signs, and white space that leaves its last character to what follows.
A character's class, and for white space and apostrophes a look at what comes next, makes it one
of few symbols; a symbol is a function from the scanner's state to its next state. Functions
compose associatively, so a text is scanned in blocks side by side: each block's function first,
then the state at each block's start by a prefix scan over the functions, then the states within.
A piece starts where the state says so. Pieces are looked up among those merged before, and merged
by rank otherwise. Token starts are kept as byte offsets, which is where decoding puts the bytes.
"""

import base64
import heapq
import sys
from array import array
from collections.abc import Callable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F

#: Pieces that a worker remembers with their ids, and the longest of them; then it starts afresh.
REMEMBERED, LONGEST = 200_000, 64
#: Characters scanned at a time (a longer text is scanned whole), and characters in a block.
CHUNK, BLOCK = 1 << 18, 256
#: Rows decoded at a time.
ROWS = 256

# Symbols. White space is LAST_* before other characters and INNER before white space or the end;
# an apostrophe is SHORT or LONG where letters of a contraction follow, and SIGN elsewhere.
SIGN, LETTER, NUMBER, LAST_SPACE, LAST_WHITE, INNER, SHORT, LONG = range(8)
FIRST = 8  # added for the first character of a text
NOTHING = 16  # fills the last block
# States: what the last character belongs to. OPEN: a piece that has ended.
OPEN, LETTERS, NUMBERS, SIGNS, WHITE, SPACE, ONE_LEFT, TWO_LEFT = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, whether a piece starts here)."""
    if symbol == NOTHING:
        return state, False
    if symbol >= FIRST:
        return _step(OPEN, symbol - FIRST)[0], True
    if symbol == LETTER and state in (ONE_LEFT, TWO_LEFT):
        return (OPEN if state == ONE_LEFT else ONE_LEFT), False
    if symbol in (SHORT, LONG) and state not in (SIGNS, SPACE):
        return (ONE_LEFT if symbol == SHORT else TWO_LEFT), True
    if symbol in (LAST_SPACE, LAST_WHITE):
        return (SPACE if symbol == LAST_SPACE else OPEN), True
    run = {LETTER: LETTERS, NUMBER: NUMBERS, INNER: WHITE}.get(symbol, SIGNS)
    return run, state != run and (state != SPACE or run == WHITE)


_TABLE = [[_step(state, symbol) for state in range(8)] for symbol in range(17)]
_NEXT = np.array([[to for to, _ in row] for row in _TABLE], np.uint8)
_STARTS = np.array([[starts for _, starts in row] for row in _TABLE])


def _closed(functions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All functions that these compose to, the place of each of these among them, and the place
    of "g after f" at [g, f]."""
    known = {tuple(f): i for i, f in enumerate(dict.fromkeys(map(tuple, functions.tolist())))}
    todo = list(known)
    for f in todo:  # grows meanwhile
        for g in functions.tolist():
            both = tuple(g[s] for s in f)
            if both not in known:
                known[both] = len(known)
                todo.append(both)
    after = [[known[tuple(g[s] for s in f)] for f in known] for g in known]
    return np.array(list(known), np.uint8), np.array([known[tuple(f)] for f in functions.tolist()]), np.array(after)


_FUNCTIONS, _PLACE, _AFTER = _closed(_NEXT)


def character_classes() -> np.ndarray:
    """SIGN, LETTER, NUMBER or INNER (white space) for each code point, as the library that the
    vocabularies are made for sees it: its versions differ in the code points they know."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.zeros(0x110000, np.uint8)
    for symbol, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (INNER, r"\s")):
        single = {bytes([i]): i for i in range(256)}
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        table[_code_points(bytes(probe.encode_ordinary(every)).decode())] = symbol
    return table


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def symbols(points: np.ndarray, firsts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The symbol of each character; ``firsts`` are the places where (non-empty) texts start."""
    out = classes[points]
    white = out == INNER
    goes_on = np.append(white[1:], True)
    goes_on[firsts[1:] - 1] = True  # at the end of a text as before more white space
    last = white & ~goes_on
    out[last] = np.where(points[last] == 0x20, LAST_SPACE, LAST_WHITE)

    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        ends = np.append(firsts[1:], len(points))
        room = ends[np.searchsorted(firsts, quotes, "right") - 1] - quotes
        after = np.append(points, np.zeros(2, points.dtype))
        one, two = np.where(room > 1, after[quotes + 1], 0), np.where(room > 2, after[quotes + 2], 0)
        out[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        for a, b in ("re", "ve", "ll"):
            out[quotes[(one == ord(a)) & (two == ord(b))]] = LONG
    out[firsts] += FIRST
    return out


def piece_starts(read: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Places in ``read`` (symbols) where pieces start."""
    many = -(-len(read) // block)
    dealt = np.full(many * block, NOTHING, np.uint8)
    dealt[: len(read)] = read
    dealt = np.ascontiguousarray(dealt.reshape(many, block).T)  # a row has the same place of all blocks

    after = _AFTER.astype(np.uint16).ravel()
    rows = (_PLACE * len(_FUNCTIONS)).astype(np.uint16)[dealt]
    whole = _PLACE[dealt[0]].astype(np.uint16)
    for row in rows[1:]:
        whole = after[row + whole]
    width = 1
    while width < many:  # prefix scan: each takes the function of as many blocks before it
        whole[width:] = after[whole[width:] * np.uint16(len(_FUNCTIONS)) + whole[:-width]]
        width *= 2
    state = np.append(np.uint8(OPEN), _FUNCTIONS[whole[:-1], OPEN])

    cells = dealt.astype(np.uint16) * np.uint16(8)
    to = _NEXT.astype(np.uint16).ravel()
    state = state.astype(np.uint16)
    for row in cells:
        row += state
        state = to[row]
    return np.flatnonzero(_STARTS.ravel()[cells].T.ravel()[: len(read)])


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: the neighbours of least rank are joined, the leftmost first, while any can be."""
    if piece in ranks:
        return [ranks[piece]]
    bounds = _bounds(piece, ranks) if len(piece) <= LONGEST else _bounds_of_long(piece, ranks)
    return [ranks[piece[a:b]] for a, b in zip(bounds, bounds[1:])]


def _bounds(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Where the parts of a merged piece begin, and its end; each step looks at all neighbours."""
    n, none, rank = len(piece), len(ranks) + (1 << 32), ranks.get
    bounds = list(range(n + 1))
    joined = [rank(piece[i : i + 2], none) for i in range(n - 1)]  # ranks of part and next part
    while joined and (least := min(joined)) != none:
        i = joined.index(least)
        del bounds[i + 1], joined[i]
        if i < len(joined):
            joined[i] = rank(piece[bounds[i] : bounds[i + 2]], none)
        if i:
            joined[i - 1] = rank(piece[bounds[i - 1] : bounds[i + 1]], none)
    return bounds


def _bounds_of_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap of neighbours, whose steps do not take longer in longer pieces."""
    n = len(piece)
    ends, before = [*range(1, n + 1), 0], list(range(-1, n + 1))  # an end of 0: no part starts here

    def pair(start: int, stop: int) -> list[tuple[int, int, int]]:
        rank = ranks.get(piece[start:stop])
        return [] if rank is None else [(rank, start, stop)]

    heap = [p for i in range(n - 1) for p in pair(i, i + 2)]
    heapq.heapify(heap)
    while heap:
        _, start, stop = heapq.heappop(heap)
        middle = ends[start]
        if not 0 < middle < n or ends[middle] != stop:
            continue  # one of the two has been joined with another
        ends[start], ends[middle], before[stop] = stop, 0, start
        for p in pair(start, ends[stop]) if stop < n else []:
            heapq.heappush(heap, p)
        for p in pair(before[start], stop) if start else []:
            heapq.heappush(heap, p)
    return [i for i in range(n) if ends[i]] + [n]


def rank_file(path: str) -> dict[bytes, int]:
    """Tokens and their ids, which are their ranks too: a token in base 64 and its id on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}


class Vocabulary:
    """Ranks of tokens, the class of each character and the pieces met so far, at most ``remembered``.
    ``merged`` gives the ids of a piece met for the first time, by ``merge`` if not given."""

    def __init__(
        self, ranks: dict[bytes, int], remembered: int = REMEMBERED,
        merged: Callable[[bytes], list[int]] | None = None,
    ):
        self.ranks, self.remembered = ranks, remembered
        self.merged = merged or (lambda piece: merge(piece, ranks))
        self.classes = character_classes()
        self.bytes = TokenBytes({i: t for t, i in self.ranks.items()})
        self.known: dict[bytes, bytes] = {}

    def cuts(self, texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The texts in a row, byte offsets where their pieces start, and the number of pieces of each."""
        data = b"".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.cumsum(sizes) - sizes
        points = _code_points(data.decode("utf-8"))
        if not len(points):
            return data, np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        width = 1 + (points > 0x7F).astype(np.uint8) + (points > 0x7FF) + (points > 0xFFFF)
        at = np.cumsum(width, dtype=np.int64) - width
        firsts = np.searchsorted(at, starts[sizes > 0])
        pieces = at[piece_starts(symbols(points, firsts, self.classes))]
        bounds = np.searchsorted(pieces, np.append(starts, len(data)))
        return data, pieces, np.diff(bounds)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each."""
        data, starts, pieces = self.cuts(texts)
        bounds = [*starts.tolist(), len(data)]
        parts = [data[a:b] for a, b in zip(bounds, bounds[1:])]
        if len(self.known) > self.remembered:
            self.known = {}
        found = list(map(self.known.get, parts))
        if None in found:
            for i, known in enumerate(found):
                if known is None:
                    found[i] = self.known.get(parts[i]) or self._new(parts[i])
        many = np.fromiter(map(len, found), np.int64, len(found)) // 4
        upto = np.append(0, np.cumsum(many))[np.append(0, np.cumsum(pieces))]
        return np.frombuffer(b"".join(found), "<u4"), np.diff(upto)

    def _new(self, piece: bytes) -> bytes:
        ids = array("I", self.merged(piece)).tobytes()
        if len(piece) <= LONGEST:
            self.known[piece] = ids
        return ids


class TokenBytes:
    """The bytes of each id, one after the other in one array."""

    def __init__(self, tokens: dict[int, bytes]):
        every = [tokens.get(i, b"") for i in range(max(tokens, default=-1) + 1)]
        self.sizes = np.fromiter(map(len, every), np.int64, len(every))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(every), np.uint8)

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> bytes:
        """The text of ``ids`` whose bytes belong at ``starts``."""
        sizes = self.sizes[ids]
        shift = np.repeat(self.starts[ids] - starts, sizes)
        place = np.repeat(starts, sizes) + _within(sizes)
        out = np.zeros(int((starts + sizes).max(initial=0)), np.uint8)
        out[place] = self.data[place + shift]
        return out.tobytes()


def _within(sizes: np.ndarray) -> np.ndarray:
    """0 onwards for each of ``sizes``."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def kept_by_worker(key: tuple, make):
    """What ``make`` made at the first call of this worker; it stays from task to task."""
    kept = sys.modules.setdefault("_kept_by_worker", ModuleType("_kept_by_worker")).__dict__
    return kept[key] if key in kept else kept.setdefault(key, make())


def chunks(sizes: list[int], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` together, or of one row that has more."""
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def utf8_texts(docs: DataFrame) -> DataFrame:
    """doc_id, _text: the text in UTF-8, empty for null."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long"), text.alias("_text"))


def valid(text: bytes) -> bytes:
    """The text itself, or with U+FFFD where it is no UTF-8."""
    try:
        text.decode("utf-8")
        return text
    except UnicodeDecodeError:
        return text.decode("utf-8", "replace").encode()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, starts: the ids of each whole text of ``docs`` (doc_id, text) by the rank file at
    ``path``, which every executor has, and the byte at which each id's bytes start.

    A null text is empty and has no ids; bytes that are no UTF-8 count as U+FFFD. Rows are encoded
    one by one: null and repeated ids and rows stay as they are, other columns are not read, an
    empty table gives an empty result. Special tokens in a text are plain text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = kept_by_worker(("ranks", path), lambda: Vocabulary(rank_file(path)))
        for batch in batches:
            texts = [valid(t.as_py()) for t in batch.column("_text")]
            for a, b in chunks(list(map(len, texts))):
                ids, many = vocabulary.encode(texts[a:b])
                sizes = vocabulary.bytes.sizes[ids]
                at = np.cumsum(sizes) - sizes
                upto = np.append(0, np.cumsum(many))
                bytes_before = np.cumsum([0, *map(len, texts[a : b - 1])])
                at -= np.repeat(bytes_before, many)
                offsets = pa.array(upto, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32))),
                        pa.ListArray.from_arrays(offsets, pa.array(at.astype(np.int32))),
                    ],
                    ["doc_id", "ids", "starts"],
                )

    return utf8_texts(docs).mapInArrow(run, "doc_id long, ids array<int>, starts array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (ids, starts and any others) with ``decoded``, the bytes of the ids at their starts;
    no ids, or null, give no bytes."""
    schema = f"{encoded._jdf.schema().toDDL()}, decoded binary" if encoded.columns else "decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = kept_by_worker(("ranks", path), lambda: Vocabulary(rank_file(path)))
        for batch in batches:
            for part in (batch.slice(i, ROWS) for i in range(0, len(batch), ROWS)):
                texts = [
                    vocabulary.bytes.decode(*(
                        np.asarray(cell.values if cell.is_valid else [], np.int64) for cell in cells
                    ))
                    for cells in zip(part.column("ids"), part.column("starts"))
                ]
                yield part.append_column("decoded", pa.array(texts, pa.binary()))

    return encoded.mapInArrow(run, schema)
