"""Text helpers: stripping, tokens, per-row term counts, sentences."""

from pyspark.sql import Column, functions as F

# White space as Python's str.strip() sees it: Unicode White_Space plus U+001C..U+001F.
_BLANK = r"[\s\x1c-\x1f]"
_EDGES = rf"(?U)^{_BLANK}+|{_BLANK}+\z"
TOKEN = r"[\p{L}\p{M}]+"
NO_TOKEN = r"[^\p{L}\p{M}]+"
SENTENCE_END = r"[.!?。！？।\n]+"


def strip(c: Column) -> Column:
    # Most texts have clean ends: looking at two characters spares the pass over the rest.
    ends = F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1))
    return F.when(ends.rlike(f"(?U){_BLANK}"), F.regexp_replace(c, _EDGES, "")).otherwise(c)


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and combining marks, in text order."""
    return F.array_remove(F.split(F.lower(c), NO_TOKEN), "")


def bind(value: Column, use) -> Column:
    """``use(value)`` with value computed once, although use() may mention it in lambdas."""
    return F.transform(F.array(value), use)[0]


def term_counts(terms: Column) -> Column:
    """``array<struct<term, tf>>`` of one row's terms, sorted by term.

    Runs of equal neighbours in the sorted array are the counts, so the
    per-document counting needs no explode and no shuffle.
    """

    def runs(s):
        starts = F.filter(
            F.sequence(F.lit(1), F.size(s)),
            lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)),
        )
        return F.when(F.size(s) > 0, bind(starts, lambda st: F.transform(
            st,
            lambda i, k: F.struct(
                F.get(s, i - 1).alias("term"),
                (F.coalesce(F.get(st, k + 1), F.size(s) + 1) - i).alias("tf"),
            ),
        ))).otherwise(F.array().cast("array<struct<term:string,tf:int>>"))

    return bind(F.sort_array(terms), runs)


def sentences(c: Column) -> Column:
    """Sentences without their end marks; pieces without a letter are left out."""
    pieces = F.transform(F.split(c, SENTENCE_END), lambda s: F.trim(s))
    return F.filter(pieces, lambda s: s.rlike(r"\p{L}"))


def compact(*items: Column) -> Column:
    """The non-null items, in order."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def quoted(values) -> str:
    """Values as a comma-separated list of SQL literals."""

    def literal(v):
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return f"{v!r}D" if isinstance(v, float) else str(v)

    return ", ".join(literal(v) for v in values)


# Long literal lists are given as SQL text: one expression instead of one object per value.


def strings(values) -> Column:
    return F.expr(f"array({quoted(values)})") if values else F.expr("cast(array() as array<string>)")


def literal_map(d: dict) -> Column:
    return F.expr(f"map({quoted(x for kv in d.items() for x in kv)})")
