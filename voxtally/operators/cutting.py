"""Words of scripts that are written without spaces: a word list learned from the texts themselves, and
the most probable way to cut a run of characters into words.

A run's substrings of up to ``LONGEST`` characters are candidates. A candidate of several characters
is a word if it occurs often enough, sticks together (each way to part it is much rarer than the
whole would be by chance), and is free on both sides (the entropy of the characters before and after
it). Single characters are words anyway. All of this is grouped aggregation over the distinct runs,
weighed by how often they occur. A run is cut where the product of its words' shares is largest.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from voxtally.functions.text import tokens
from voxtally.operators.joins import lookup_join
from voxtally.sources.checkpoints import settle

HAN = r"\p{IsHan}+"
LONGEST, LEAST, COHESION, FREEDOM = 4, 3, 1.5, 0.6
#: Numbers that decide are compared to so many decimals, so that the order of a sum does not matter.
DECIMALS = 6


def runs(df: DataFrame, text: str = "text", pattern: str = HAN) -> DataFrame:
    """``(run, n)``: the distinct runs of characters of ``pattern`` in lower-cased texts."""
    found = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))
    return df.select(F.explode(found).alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("n"))


def _substrings(longest: int) -> Column:
    """``array<struct<start, size, gram, left, right>>`` of the characters in ``_chars``."""
    chars = F.col("_chars")

    def at(i: Column, size: Column) -> Column:
        return F.struct(
            i.alias("start"), size.alias("size"), F.array_join(F.slice(chars, i + 1, size), "").alias("gram"),
            F.when(i > 0, F.get(chars, i - 1)).otherwise("").alias("left"),
            F.coalesce(F.get(chars, i + size), F.lit("")).alias("right"),
        )

    sizes = F.sequence(F.lit(1), F.lit(longest))
    every = F.transform(F.sequence(F.lit(0), F.size(chars) - 1), lambda i: F.transform(
        F.filter(sizes, lambda k: i + k <= F.size(chars)), lambda k: at(i, k)
    ))
    return F.flatten(every)


def _entropy(counted: DataFrame, side: str, name: str) -> DataFrame:
    by_side = counted.groupBy("gram", side).agg(F.sum("n").cast("double").alias("n"))
    total = F.sum("n")
    return by_side.groupBy("gram").agg(
        F.round(F.log(total) - F.sum(F.col("n") * F.log("n")) / total, DECIMALS).alias(name)
    )


def learn_words(
    found: DataFrame, longest: int = LONGEST, least: int = LEAST, cohesion: float = COHESION,
    freedom: float = FREEDOM,
) -> DataFrame:
    """``(word, n, weight)`` from ``runs``: weight is the logarithm of the word's share of all kept
    words. Empty runs give none."""
    chars = found.filter("run <> ''").select("n", F.split("run", "").alias("_chars"))
    counted = settle(
        chars.select("n", F.inline(_substrings(longest))).groupBy("gram", "left", "right").agg(F.sum("n").alias("n"))
    )
    counts = settle(counted.groupBy("gram").agg(F.sum("n").alias("n")))
    total = counts.filter(F.length("gram") == 1).agg(F.sum("n").cast("double").alias("t")).first()["t"] or 1.0
    free = (
        counts.filter((F.length("gram") > 1) & (F.col("n") >= least))
        .join(_entropy(counted, "left", "before"), "gram").join(_entropy(counted, "right", "after"), "gram")
        .filter(F.least("before", "after") >= freedom).select("gram", "n")
    )
    cuts = F.sequence(F.lit(1), F.length("gram") - 1)
    parted = free.withColumn("_at", F.explode(cuts)).select(
        "gram", "n", F.substr("gram", F.lit(1), "_at").alias("a"), F.substr("gram", F.col("_at") + 1).alias("b")
    )
    sides = [counts.select(F.col("gram").alias(s), F.col("n").cast("double").alias(f"n{s}")) for s in "ab"]
    parted = lookup_join(lookup_join(parted, sides[0], "a"), sides[1], "b")
    sticks = F.round(F.min(F.log(F.col("n") * F.lit(total) / (F.col("na") * F.col("nb")))), DECIMALS)
    words = parted.groupBy("gram", "n").agg(sticks.alias("c")).filter(F.col("c") >= cohesion).select("gram", "n")
    kept = settle(words.unionByName(counts.filter(F.length("gram") == 1)))
    share = kept.agg(F.sum("n").cast("double").alias("t")).first()["t"] or 1.0
    return kept.select(
        F.col("gram").alias("word"), "n", F.round(F.log(F.col("n") / F.lit(share)), DECIMALS).alias("weight")
    )


def best_cut(run: str, weights: dict[tuple[int, int], float], unknown: float) -> list[str]:
    """The cut of ``run`` whose weights ((start, size) -> weight) have the greatest sum; a character
    without one weighs ``unknown``. Among equal sums, longer last words."""
    best, back = [0.0], [0]
    longest = max([size for _, size in weights], default=1)
    for end in range(1, len(run) + 1):
        top, size_of = float("-inf"), 1
        for size in range(min(longest, end), 0, -1):
            weight = weights.get((end - size, size), unknown if size == 1 else None)
            if weight is not None and best[end - size] + weight > top:
                top, size_of = best[end - size] + weight, size
        best.append(top)
        back.append(size_of)
    words, end = [], len(run)
    while end:
        words.append(run[end - back[end] : end])
        end -= back[end]
    return words[::-1]


def cut_runs(found: DataFrame, words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """``(run, words)`` for the distinct ``run`` of ``found``. Substrings meet the word list in a join, so
    it may be of any size; a run's own substrings come together again to be cut."""
    unknown = (words.agg(F.min("weight").alias("w")).first()["w"] or 0.0) - 1.0
    places = found.filter("run <> ''").select("run").distinct().withColumn("_chars", F.split("run", "")).select(
        "run", F.inline(_substrings(longest))
    ).select("run", "start", "size", F.col("gram").alias("word"))
    known = lookup_join(places, words.select("word", "weight"), "word", "left")
    whole = known.groupBy("run").agg(
        F.collect_list(F.when(F.col("weight").isNotNull(), F.struct("start", "size", "weight"))).alias("places")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [
                best_cut(r, {(p["start"], p["size"]): p["weight"] for p in places}, unknown)
                for r, places in zip(batch.column("run").to_pylist(), batch.column("places").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([batch.column("run"), pa.array(cut, pa.list_(pa.string()))], ["run", "words"])

    return whole.mapInArrow(run, "run string, words array<string>")


def with_cut_tokens(df: DataFrame, id_: str, words: DataFrame, text: str = "text", pattern: str = HAN) -> DataFrame:
    """Adds ``tokens``, those of ``labelling.with_tokens`` with runs of ``pattern`` cut into words. Ids
    are unique. Texts without such a run take no part in the joins."""
    lowered = F.lower(text)
    has_run = F.coalesce(lowered.rlike(pattern), F.lit(False))
    plain = df.filter(~has_run).withColumn("tokens", tokens(F.col(text)))
    rows = df.filter(has_run)
    other = pattern.removesuffix("+")
    either = F.lit(rf"{pattern}|(?:(?!{other})[\p{{L}}\p{{M}}])+")
    pieces = rows.select(id_, F.posexplode(F.regexp_extract_all(lowered, either, F.lit(0))).alias("_at", "run"))
    cut = cut_runs(pieces.filter(F.col("run").rlike(pattern)), words)
    read = lookup_join(pieces, cut, "run", "left").select(
        id_, "_at", F.coalesce("words", F.array("run")).alias("_w")
    )
    joined = read.groupBy(id_).agg(F.sort_array(F.collect_list(F.struct("_at", "_w"))).alias("_t")).select(
        id_, F.flatten("_t._w").alias("tokens")
    )
    return plain.unionByName(rows.join(joined, id_))
