"""Vectors compressed to codes: equal parts, a codebook for each, and the nearest entry's index.

All arithmetic decides on whole numbers: components are floor(scale * x), codebook entries are
floored means, distances are integers. A round assigns every part to its nearest entry and replaces
the entries by the means of what they got; workers add up their rows, Spark adds up the workers'
sums, and only sums and counts of the entries, whose number the parameters fix, reach the driver.

The nearest entry is found by a tree of split points (GNAT). A node picks entries far apart as split
points and gives every other entry to its nearest one; it keeps, for each split point and each of
these groups, the least and greatest distance from the point to the group's entries. When a query's
distance to a split point differs from that range by more than the best distance so far, the whole
group is out: by the triangle inequality each of its entries is farther than the best. Distances are
rounded against leaving out and the difference has to be greater, so an entry at the best distance
is always looked at, and integers decide between equals.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxtally.llm.common import spare
from voxtally.operators.joins import lookup_join
from voxtally.sources.checkpoints import settle

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Split points of a node, and entries that are compared one by one instead of split.
ARITY, LEAF = 4, 3
#: Room for the rounding of a square root of an integer below 2^63 and of one subtraction.
SLACK = 2.0**-48


def _down(x):
    return x * (1 - SLACK)


def _up(x):
    return x * (1 + SLACK)


def _squared(rows: np.ndarray, entry: np.ndarray) -> np.ndarray:
    away = rows - entry
    return np.einsum("ij,ij->i", away, away)


class Tree:
    """Nearest entries of a codebook (entries x width, integers); ties go to the lower index."""

    def __init__(self, entries: np.ndarray, arity: int = ARITY, leaf: int = LEAF):
        self.entries = np.asarray(entries, np.int64)
        self.compared = 0  # distances computed so far
        self.root = self._node(np.arange(len(self.entries)), arity, leaf)

    def _node(self, members: np.ndarray, arity: int, leaf: int):
        """(split points, least and greatest distances [point, group], children); a leaf has no
        groups beside its points. A group holds its own split point too."""
        if len(members) <= max(leaf, 1):
            return members, None, None, [None] * len(members)
        splits, nearest = [0], _squared(self.entries[members], self.entries[members[0]])
        while len(splits) < min(max(arity, 2), len(members)) and nearest.max() > 0:
            splits.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, _squared(self.entries[members], self.entries[members[splits[-1]]]))
        if len(splits) == 1:  # all alike: the lowest index wins every tie
            return members[:1], None, None, [None]
        away = np.stack([_squared(self.entries[members], self.entries[members[s]]) for s in splits])
        owner = away.argmin(0)
        owner[splits] = np.arange(len(splits))
        root = np.sqrt(away.astype(np.float64))
        groups = [owner == g for g in range(len(splits))]
        least = _down(np.stack([root[:, g].min(1) for g in groups], 1))
        most = _up(np.stack([root[:, g].max(1) for g in groups], 1))
        rest = [g & ~np.isin(np.arange(len(members)), splits) for g in groups]
        children = [self._node(members[r], arity, leaf) if r.any() else None for r in rest]
        return members[splits], least, most, children

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each row's nearest entry."""
        rows = np.asarray(rows, np.int64)
        best = np.full(len(rows), np.iinfo(np.int64).max)
        index = np.full(len(rows), len(self.entries))
        if len(rows):
            self._search(self.root, rows, np.arange(len(rows)), best, index)
        return index, best

    def _search(self, node, rows, at, best, index) -> None:
        points, least, most, children = node
        alive = np.ones((len(at), len(points)), bool)
        known = np.full((len(at), len(points)), np.nan)  # distances to split points
        for i, point in enumerate(points):
            asked = np.flatnonzero(alive[:, i])
            away = _squared(rows[at[asked]], self.entries[point])
            self.compared += len(asked)
            own = at[asked]
            better = (away < best[own]) | ((away == best[own]) & (point < index[own]))
            best[own[better]], index[own[better]] = away[better], point
            if least is not None:
                known[asked, i] = np.sqrt(away.astype(np.float64))
                self._leave_out(i, asked, at, alive, known, best, least, most)
        if least is None:
            return
        for i in range(len(points)):  # once more, now that the best is better known
            self._leave_out(i, np.flatnonzero(~np.isnan(known[:, i])), at, alive, known, best, least, most)
        for g, child in enumerate(children):
            left = alive[:, g]
            if child is not None and left.any():
                self._search(child, rows, at[left], best, index)

    @staticmethod
    def _leave_out(i, asked, at, alive, known, best, least, most) -> None:
        """Drops the groups that the distances to split point ``i`` show to be too far."""
        away, radius = known[asked, i, None], _up(np.sqrt(best[at[asked]].astype(np.float64)))[:, None]
        beyond = np.maximum(_down(away) - most[i], least[i] - _up(away))
        alive[asked] &= ~(_down(beyond) > radius)


def limit(width: int) -> int:
    """Components go up to this in size, so that a vector's squared distances fit a 64-bit integer."""
    return 1 << int((62 - np.log2(max(width, 1))) // 2 - 1)


def whole_numbers(vectors: DataFrame, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """vec_id, label, _v: the vectors of ``vectors`` (vec_id, embedding, label) as integers, computed once.

    Dropped are vectors that are null, hold a null, a NaN or an infinity, cannot be cut into equal
    parts, or are of another length than the one with the smallest vec_id of those left.
    """
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("_x"))
    bad = F.exists("_x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("_x").isNotNull() & (F.size("_x") > 0) & (F.size("_x") % parts == 0) & ~bad)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "_x").select(F.size("_x")).first()
    width = first[0] if first else 0
    most = float(limit(width))
    floored = F.transform("_x", lambda x: F.floor(F.least(F.greatest(x * float(scale), F.lit(-most)), F.lit(most))))
    return settle(rows.filter(F.size("_x") == width).select("vec_id", "label", floored.alias("_v")))


def _matrix(column: pa.Array) -> np.ndarray:
    values = np.asarray(column.flatten(), np.int64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _cut(matrix: np.ndarray, parts: int) -> list[np.ndarray]:
    return [np.ascontiguousarray(p) for p in np.split(matrix, parts, axis=1)]


def improved(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks after one round: each entry the floored mean of the parts nearest to it."""
    entries, width = books[0].shape
    cells = entries * (width + 1)  # of a part: sums of the entries' components, then a count

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Tree(b) for b in books]
        sums = np.zeros((len(books), entries, width + 1), np.int64)
        for batch in batches:
            if len(batch):
                for p, part in enumerate(_cut(_matrix(batch.column(0)), len(books))):
                    index, _ = trees[p].nearest(part)
                    np.add.at(sums[p], index, np.column_stack([part, np.ones(len(part), np.int64)]))
        cell = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(sums.ravel()[cell])], ["cell", "n"])

    got = rows.select("_v").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    sums = np.zeros(len(books) * cells, np.int64)
    for r in got.collect():  # at most a row for each component of the codebooks
        sums[r.cell] = r.n
    sums = sums.reshape(len(books), entries, width + 1)
    count = sums[:, :, -1:]
    means = np.floor_divide(sums[:, :, :-1], np.maximum(count, 1))
    return [np.where(count[p] > 0, means[p], books[p]) for p in range(len(books))]


def codebooks(
    rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> list[np.ndarray]:
    """A codebook (entries x width) for each part of ``rows`` (vec_id, _v), begun with the vectors of
    the smallest vec_ids (nulls last, equal ids by vector); fewer vectors make fewer entries."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "_v").limit(entries).select("_v").collect()
    if not first:
        return []
    books = _cut(np.array([r[0] for r in first], np.int64), parts)
    for _ in range(rounds):
        books = improved(rows, books)
    return books


def coded(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code (array of entry indexes), error (squared distances over all parts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Tree(b) for b in books]
        for batch in batches:
            if len(batch):
                parts = _cut(_matrix(batch.column("_v")), len(books))
                found = [t.nearest(p) for t, p in zip(trees, parts)]
                code = np.stack([index for index, _ in found], 1).astype(np.int32)
                error = np.sum([away for _, away in found], axis=0)
                offsets = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * len(books))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id"), batch.column("label"),
                        pa.ListArray.from_arrays(offsets, pa.array(code.ravel())), pa.array(error, pa.int64()),
                    ],
                    ["vec_id", "label", "code", "error"],
                )

    kinds = dict(rows.dtypes)
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code array<int>, error long"
    return rows.select("vec_id", "label", "_v").mapInArrow(run, schema)


def vector_codes(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error, label_error) of the vectors that ``whole_numbers`` keeps, and the
    codebooks. ``label_error`` sums the errors of equal labels, null labels together.

    Repeated rows count as often as they occur, null ids come last among the first vectors, other
    columns are not read, an empty table gives no rows and no codebooks. Components beyond
    ``limit(width)`` (2^27 for 64 components) are set to it, label errors beyond a long to the greatest.
    """
    rows = whole_numbers(vectors.select("vec_id", "embedding", "label"), parts, scale)
    books = codebooks(rows, parts, entries, rounds)
    codes = settle(coded(rows, books))
    key = spare(codes, "_label")
    same = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null"))
    codes = codes.withColumn(key, same)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)"))
    sums = codes.groupBy(key).agg(total.cast("long").alias("label_error"))
    return lookup_join(codes, sums, key).drop(key), books
