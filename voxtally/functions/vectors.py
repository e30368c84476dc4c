"""Dense vectors as ``array<double>`` columns."""

from pyspark.sql import Column, functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, p: s + p
    )


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """Scaled to length 1; a zero vector stays as it is."""
    return F.transform(
        F.array(F.struct(v.alias("v"), norm(v).alias("n"))),
        lambda s: F.when(s["n"] == 0, s["v"]).otherwise(F.transform(s["v"], lambda x: x / s["n"])),
    )[0]


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    length = norm(a) * norm(b)
    return F.when(length == 0, 0.0).otherwise(dot(a, b) / length)


def softmax(scores: Column) -> Column:
    weights = F.transform(scores, F.exp)
    return F.transform(
        F.array(F.struct(
            weights.alias("w"), F.aggregate(weights, F.lit(0.0), lambda s, x: s + x).alias("t")
        )),
        lambda s: F.transform(s["w"], lambda x: x / s["t"]),
    )[0]
