"""Connected components of a table of links."""

from pyspark.sql import DataFrame, functions as F

from voxtally.sources.checkpoints import settle


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node it reaches.

    Alternating star contraction: every node hangs its larger neighbours, then itself and its
    smaller ones, on the smallest node it sees, until nothing changes. The number of rounds
    grows with the logarithm of the longest chain. A node with very many links is aggregated
    before the shuffle and joined by skew-split merge joins. Self links and repeated links do
    no harm; null ends are dropped.
    """
    stars = settle(
        links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
        .filter("node > root").distinct()
    )
    state = _state(stars)
    while True:
        stars = settle(_small_star(_large_star(stars)))
        state, before = _state(stars), state
        if state == before:
            break
    roots = stars.select("root").distinct()
    return stars.union(roots.select("root", "root"))


def _state(stars: DataFrame) -> tuple:
    mixed = F.xxhash64("node", "root").cast("decimal(38,0)")
    return tuple(stars.agg(F.count(F.lit(1)), F.sum(mixed)).first())


def _large_star(stars: DataFrame) -> DataFrame:
    """Neighbours larger than a node go to the smallest of the node and its neighbours."""
    both = stars.select(F.col("node").alias("u"), F.col("root").alias("v")).union(
        stars.select("root", "node")
    )
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return (
        both.filter("v > u").join(least, "u")
        .select(F.col("v").alias("node"), F.col("m").alias("root")).distinct()
    )


def _small_star(stars: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the smallest of them."""
    least = stars.groupBy("node").agg(F.min("root").alias("m"))
    moved = stars.join(least, "node").select(F.col("root").alias("node"), F.col("m").alias("root"))
    return (
        moved.filter("node > root")
        .union(least.select("node", "m")).distinct()
    )
