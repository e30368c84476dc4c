"""Records that may hold line breaks, or nothing but commas between them, from files read in splits.

A split does not know whether it begins inside a record. What it can tell is a function: for each
state in which it may begin, the state in which it ends. A first pass computes this function for each
split; composing them along a file gives the state at the start of each split. A second pass then
cuts records. Those that lie within a split go on at once; of the others each split gives the part that
it has, and only these parts, two for a split, are shuffled and put together. The driver holds a few
numbers for each split, of which it plans the scan anyway.

A CSV is read by lines: the state is whether a quoted cell is open. A JSON file is read in chunks that
end with a closing brace, wherever line breaks are: the state is whether a string is open, and how
many braces are.
"""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

#: Lines or chunks, bytes of them, and bytes of records, that a worker has as Python's strings at a time.
LINES, PART_BYTES, HELD_BYTES = 1024, 1 << 20, 4 << 20

#: file and first byte of a split; nth record of the split; what there is of it. A part that goes on
#: in the next split is open at its end, one that began in an earlier split at its start.
RECORDS = "file long, start long, nth long, record string, open_start boolean, open_end boolean"

# A cell and the comma after it; the group is empty if a quoted cell is not closed in this line.
_CELL = re.compile(r'(?:"(?:[^"]|"")*+(?P<closed>"|$)[^,]*+|[^,]*+)(?:,|$)')
_STRING = re.compile(r'"(?:[^"\\]|\\.)*+("|\\?$)', re.DOTALL)


class CsvLines:
    """Lines of a CSV. The state is whether a quoted cell is open; quotes inside of unquoted cells
    are characters like others. Empty lines between records are none. Where a file's first line ends
    with a carriage return, line breaks within cells lose theirs."""

    sep = "\n"
    states = (0, 1)

    @staticmethod
    def after(state: int, line: str) -> int:
        """The state after a line that begins in ``state``."""
        if '"' not in line:
            return state
        line = '"' + line if state else line
        at = 0
        while at < len(line):
            cell = _CELL.match(line, at)
            if cell["closed"] == "":
                return 1
            at = cell.end()
        return 0

    @classmethod
    def read(cls, state: int, line: str, last: bool, returns: bool) -> tuple[int, str, bool, list[str]]:
        """(next state, text that belongs to the open record or opens one, whether that record has
        ended, other records)."""
        then = cls.after(state, line)
        if not state and not then and line in ("", "\r"):
            return then, "", True, []
        if then:
            return then, (line.removesuffix("\r") if returns else line) + "\n", False, []
        return then, line.removesuffix("\r"), True, []


class JsonChunks:
    """Chunks of a JSON file, each without the closing brace that ends it. The state is twice the
    number of open braces, and one more in a string. Records are the outermost objects; what else
    stands between them, commas and brackets aside, is a record that is none."""

    sep = "}"
    states = (0, 1)  # the number of braces is added up

    @staticmethod
    def _bare(state: int, chunk: str) -> tuple[str, int]:
        """The chunk with strings blanked, and whether it ends within one."""
        ends = 0

        def blank(found: re.Match) -> str:
            nonlocal ends
            ends = found[1] != '"'
            return " " * len(found[0])

        bare = _STRING.sub(blank, '"' + chunk if state & 1 else chunk)
        return (bare[1:] if state & 1 else bare), int(ends)

    @classmethod
    def after(cls, state: int, chunk: str) -> int:
        bare, inside = cls._bare(state, chunk)
        return (state >> 1 << 1) + 2 * (bare.count("{") - (not inside)) + inside

    @classmethod
    def read(cls, state: int, chunk: str, last: bool, returns: bool) -> tuple[int, str, bool, list[str]]:
        bare, inside = cls._bare(state, chunk)
        ended = not (inside or last)
        depth = (state >> 1) + bare.count("{")
        whole, others, at = chunk + ("" if last else "}"), [], 0
        if state < 2:  # no object is open; a string may be, which is then an element by itself
            at = bare.find("{")
            before, at = (chunk, len(whole)) if at < 0 else (chunk[:at], at)
            others = [x for x in (p.strip(" \t\r\n[]") for p in before.split(",")) if x]
        depth = max(depth - ended, 0)
        return 2 * depth + inside, whole[at:], ended and not depth, others


def _pieces(spark: SparkSession, path: str, kind) -> DataFrame:
    """file, start, size, path, value: the lines or chunks of all files, in order within a split."""
    return spark.read.text(path, lineSep=kind.sep).select(
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_path").alias("path"), "value",
    )


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in parts of at most ``LINES`` and about ``PART_BYTES``."""
    for batch in batches:
        if len(batch):
            rows = max(1, min(LINES, len(batch) * PART_BYTES // max(1, batch.nbytes)))
            yield from (batch.slice(i, rows) for i in range(0, len(batch), rows))


def _splits(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[bool, tuple, list]]:
    """(whether another split begins, (file, start), values of ``names``) for runs of rows of a split."""
    last = None
    for batch in batches:
        keys = list(zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()))
        at = 0
        while at < len(keys):
            end = at + 1
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            yield keys[at] != last, keys[at], [batch.column(n).slice(at, end - at).to_pylist() for n in names]
            last, at = keys[at], end


def split_states(spark: SparkSession, path: str, kind) -> dict[tuple[int, int], tuple[int, bool, bool, int]]:
    """For each split of the files at ``path``: the state at its start, whether the last piece of its
    file is in it and lacks the separator, whether the file's first piece ends with a carriage return,
    and the file's place among all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summary():
            columns = [[x] for x in (*key, *ends, read, returns)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        names, key = ["file", "start", "from0", "from1", "bytes", "returns"], None
        for new, now, (values,) in _splits(_parts(batches), "value"):
            if new:
                if key is not None:
                    yield summary()
                key, ends, read, returns = now, kind.states, 0, int(values[0].endswith("\r"))
            for value in values:
                ends = tuple(kind.after(state, value) for state in ends)
                read += len(value.encode()) + 1
        if key is not None:
            yield summary()

    pieces = _pieces(spark, path, kind)
    found = pieces.select("file", "start", "value").mapInArrow(
        run, "file long, start long, from0 long, from1 long, bytes long, returns long"
    ).collect()
    files = {r["file"]: r for r in pieces.groupBy("file").agg(F.min("path").alias("path"), F.min("size").alias("size")).collect()}
    place = {f: i for i, f in enumerate(sorted(files, key=lambda f: files[f]["path"]))}
    states, state, read, returns = {}, {}, {}, {}
    for r in sorted(found, key=lambda r: (r["file"], r["start"])):
        file, now = r["file"], state.get(r["file"], 0)
        read[file] = read.get(file, 0) + r["bytes"]
        returns.setdefault(file, bool(r["returns"]))
        states[file, r["start"]] = (now, read[file] > files[file]["size"], returns[file], place[file])
        # Open braces before the split change nothing but the number of open braces after it.
        state[file] = max((now >> 1 << 1) + r["from1" if now & 1 else "from0"], 0)
    return states


def _cut(spark: SparkSession, path: str, kind, states: dict) -> DataFrame:
    """``RECORDS`` of the files at ``path``, whole ones and parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        names = [c.split()[0] for c in RECORDS.split(", ")]
        types = [pa.int64()] * 3 + [pa.string(), pa.bool_(), pa.bool_()]

        def full():
            if not rows:
                return pa.RecordBatch.from_arrays([pa.array([], t) for t in types], names)
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
            rows.clear()
            return out

        key, state, parts, nth, began = None, 0, [], 0, False
        for new, now, (values, following) in _splits(_looked_ahead(_parts(batches)), "value", "last"):
            if new:
                if parts:
                    rows.append((*key, nth, "".join(parts), began, True))
                key, parts, nth = now, [], 0
                state, unended, returns, _ = states[now]
                began = state > 0  # a record of an earlier split goes on
            for value, last in zip(values, following):
                if len(rows) >= 4096 or held >= HELD_BYTES:
                    yield full()
                    held = 0
                was, held = state, held + len(value)
                state, text, ended, others = kind.read(state, value, last and unended, returns)
                for other in others:
                    rows.append((*key, nth, other, False, False))
                    nth += 1
                if text or (was and ended):
                    parts.append(text)
                if ended and parts:
                    rows.append((*key, nth, "".join(parts), began, False))
                    parts, nth = [], nth + (not began)  # only records that begin here have a number
                if ended:
                    began = False
        if parts:
            rows.append((*key, nth, "".join(parts), began, True))
        if rows:
            yield full()

    return _pieces(spark, path, kind).select("file", "start", "value").mapInArrow(run, RECORDS)


def _looked_ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches with ``last``: whether no other row of the same split follows."""
    held = None
    for batch in batches:
        if held is not None:
            yield _marked(held, batch)
        held = batch
    if held is not None:
        yield _marked(held, None)


def _marked(batch: pa.RecordBatch, after: pa.RecordBatch | None) -> pa.RecordBatch:
    keys = list(zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()))
    keys.append((after.column("file")[0].as_py(), after.column("start")[0].as_py()) if after is not None else None)
    return batch.append_column("last", pa.array([a != b for a, b in zip(keys, keys[1:])]))


def records(spark: SparkSession, path: str, kind) -> DataFrame:
    """``(file, start, nth, record)`` of all files at ``path``: each record once, with its place: the
    file's among all, the first byte of the split in which it begins, and its number there."""
    states = split_states(spark, path, kind)
    cut = _cut(spark, path, kind, states)
    place = spark.createDataFrame(
        sorted({(f, p) for (f, _), (*_, p) in states.items()}), "file long, place long"
    )
    whole = cut.filter("NOT open_start AND NOT open_end").select("file", "start", "nth", "record")
    parts = cut.filter("open_start OR open_end")
    # An open end begins a record unless the record has been open before.
    order = Window.partitionBy("file").orderBy("start", "nth", F.desc("open_start"))
    chains = parts.withColumn("_chain", F.sum(F.when(F.col("open_start"), 0).otherwise(1)).over(order))
    joined = chains.groupBy("file", "_chain").agg(
        F.sort_array(F.collect_list(F.struct("start", "nth", "record"))).alias("_p")
    ).select(
        "file", F.col("_p")[0]["start"].alias("start"), F.col("_p")[0]["nth"].alias("nth"),
        F.array_join("_p.record", "").alias("record"),
    )
    every = whole.unionByName(joined)
    return every.join(F.broadcast(place), "file").select(  # a row for each file
        F.col("place").alias("file"), "start", "nth", "record"
    )


def numbered(found: DataFrame, name: str = "pos") -> DataFrame:
    """Replaces the place of ``records`` by 0, 1, 2, ... in the order of the files."""
    sizes = found.groupBy("file", "start").agg(F.count(F.lit(1)).alias("_n"), F.min("nth").alias("_least"))
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)  # of the splits
    offsets = sizes.select(
        "file", "start", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_least")).alias("_base")
    )
    return found.join(offsets, ["file", "start"]).withColumn(
        name, F.col("_base") + F.col("nth")
    ).drop("file", "start", "nth", "_base")
