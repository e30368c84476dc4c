"""SimHash near-duplicates by covering locality-sensitive hashing.

Bit i of a fingerprint carries a vector u(i) of radius + 1 bits that is not zero; the mask of
a vector v holds the bits with <u(i), v> odd. Up to ``radius`` differing bits span at most
``radius`` dimensions, so some v other than zero is orthogonal to all of them, and under the
mask of that v the two fingerprints are equal: every pair within the radius meets in at least
one of the 2^(radius+1) - 1 tables, whatever the data. A radius of 4 takes 31 tables of masks
with 32 to 34 bits.

Equal fingerprints are one node from the start, so copies cost nothing. A bucket of two is its
own pair. Larger buckets are cut into blocks by a hash, every two blocks of a bucket meet in
one bounded group, and such a group gives at most one link per fingerprint (a spanning forest
of the pairs within the radius) rather than its pairs.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from voxtally.llm.common import by_row, row_key
from voxtally.llm.components import components
from voxtally.sources.checkpoints import settle

BITS = 64
SEED = 42
WORDS = 4
RADIUS = 4
#: Fingerprints of one block of a large bucket.
BLOCK = 1024


def masks(radius: int = RADIUS) -> list[int]:
    """The covering masks, as signed 64-bit numbers."""
    vectors = (1 << (radius + 1)) - 1
    out = []
    for v in range(1, vectors + 1):
        mask = sum(1 << i for i in range(BITS) if ((i % vectors + 1) & v).bit_count() % 2)
        out.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    return out


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """Of one text in UTF-8, as a signed number. Zero for no words; a text with fewer than
    ``words`` words is one shingle."""
    tokens = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(0, len(tokens) - words)
    spans = zip(starts[: last + 1].tolist(), ends[min(words, len(tokens)) - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in spans), "<u8", last + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        octets = hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(set_bits.view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fingerprint long) of every row of ``docs``, and the long columns ``also``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text")
            prints = [fingerprint(t.as_py(), words) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, carried), pa.array(prints, pa.int64())], [*carried, "fingerprint"]
            )

    carried = ["doc_id", *also]
    rows = docs.select(
        F.col("doc_id").cast("long"), *also, F.col("text").cast("binary").alias("_text")
    )
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in [*carried, "fingerprint"]))


def _forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A star for each group of ``values`` (sorted) connected by pairs within ``radius`` bits."""
    todo, out = values.view(np.uint64), []
    while len(todo):
        # Breadth first from the smallest value left; each row is compared with what is left.
        root, todo = todo[0], todo[1:]
        queue = [root]
        while queue and len(todo):
            near = np.bitwise_count(todo ^ queue.pop()) <= radius
            if near.any():
                found = todo[near]
                out += [(int(x), int(root)) for x in found.view(np.int64)]
                queue.extend(found)
                todo = todo[~near]
    signed = np.array([b for _, b in out], np.uint64).view(np.int64)
    return [(a, int(b)) for (a, _), b in zip(out, signed)]


def _bucket_links(members: DataFrame, radius: int) -> DataFrame:
    """Links within the groups (table, key, p, q) of ``members``, which lie together and sorted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        links: list[tuple[int, int]] = []

        def close() -> None:
            if group is not None:
                links.extend(_forest(np.unique(np.concatenate(held)), radius))

        def block() -> pa.RecordBatch:
            ends = [pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)]
            links.clear()
            return pa.RecordBatch.from_arrays(ends, ["a", "b"])

        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("table", "key", "p", "q")])
            values = np.asarray(batch.column("fingerprint"))
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            edges = [0, *cuts.tolist(), len(values)]
            for s, e in zip(edges, edges[1:]):
                if s == e:
                    continue
                here = tuple(keys[:, s].tolist())
                if here != group:
                    close()
                    group, held = here, []
                held.append(values[s:e])
            if len(links) > 50_000:
                yield block()
        close()
        yield block()

    return members.mapInArrow(run, "a long, b long")


def links(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the different values of ``prints.fingerprint`` that connect exactly
    what the pairs within ``radius`` bits connect."""
    nodes = prints.select("fingerprint").distinct()
    covered = nodes.select(
        "fingerprint",
        F.explode(F.array(*[
            F.struct(F.lit(i).cast("short").alias("table"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("key"))
            for i, m in enumerate(masks(radius))
        ])).alias("_t"),
    ).select("fingerprint", "_t.table", "_t.key")
    shared = settle(
        covered.groupBy("table", "key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("fingerprint").alias("a"), F.max("fingerprint").alias("b"))
        .filter("n > 1")
    )
    pairs = shared.filter("n = 2").filter(distance(F.col("a"), F.col("b")) <= radius).select("a", "b")
    # The same join at every size: few buckets of a small input would be broadcast.
    large = shared.filter("n > 2").select(
        "table", "key", F.ceil(F.col("n") / block).cast("int").alias("_blocks")
    ).hint("merge")
    own = F.pmod(F.xxhash64("fingerprint"), F.col("_blocks")).cast("int")
    members = (
        covered.join(large, ["table", "key"]).withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select(
            "table", "key", F.least("_own", "_other").alias("p"), F.greatest("_own", "_other").alias("q"),
            "fingerprint",
        )
        .repartition("table", "key", "p", "q")
        .sortWithinPartitions("table", "key", "p", "q", "fingerprint")
    )
    return pairs.union(_bucket_links(members, radius)).distinct()


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _grouped(
    docs: DataFrame, words: int, radius: int, block: int, also: tuple[str, ...] = ()
) -> DataFrame:
    """``fingerprints`` with component_id."""
    prints = settle(fingerprints(docs, words, also))
    nodes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("_first"))
    roots = components(links(prints, radius, block)).withColumnRenamed("node", "fingerprint")
    rooted = nodes.join(roots, "fingerprint", "left").withColumn(
        "root", F.coalesce("root", "fingerprint")
    )
    named = settle(rooted.groupBy("root").agg(F.min("_first").alias("component_id")))
    ids = settle(rooted.select("fingerprint", "root").join(named, "root").drop("root"))
    return prints.join(ids, "fingerprint")


def near_groups(
    docs: DataFrame, words: int = WORDS, radius: int = RADIUS, block: int = BLOCK
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hex digits),
    component_id, the smallest doc_id reached by links of at most ``radius`` differing bits.

    Texts without words, null ones too, have fingerprint zero and link like any other. Null
    ids get a component but never name one (null where a component has no other). Repeated
    rows stay. Other columns are not read; an empty table gives an empty result.
    """
    return _grouped(docs, words, radius, block).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of their component. Rows without id stay
    only where their component has no id at all, repeated ids of a component together."""
    keyed = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("_row"), "text")
    groups = _grouped(keyed, words, radius, BLOCK, ("_row",))
    own = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return by_row(docs, groups.filter(own), "left_semi")
