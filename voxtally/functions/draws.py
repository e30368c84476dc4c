"""Repeatable draws: whole-number arithmetic on an id, the same in any SQL engine."""

from pyspark.sql import Column, functions as F

from voxtally.functions.text import strings


def draw(id_: str, k: int, p: int, m: int) -> Column:
    """A value from 0 to m-1 from a column of ids: ``(((id + 1) * p) % 1000003 + k) % m``."""
    return F.expr(f"cast(((({id_} + 1) * {p}L) % 1000003 + {k}) % {m} as int)")


def hashed(id_: str, node: str, m: int) -> Column:
    """A value from 0 to m-1 from the first 60 bits of the MD5 hash of a column of ids and the name of
    what is drawn: no two draws go together, and none repeats after any number of ids."""
    bits = f"conv(substring(md5(concat(cast({id_} as string), '/{node}')), 1, 15), 16, 10)"
    return F.expr(f"cast(cast({bits} as bigint) % {m} as int)")


def pick(values: list[str], index: Column) -> Column:
    """The value at an index, null past the end."""
    return F.get(strings(values), index)


def weighted(percent: dict[str, int], drawn: Column) -> Column:
    """Category of a draw from 0 to 99 by cumulative percentages."""
    chosen, upto = None, 0
    for name, share in percent.items():
        upto += share
        chosen = (F if chosen is None else chosen).when(drawn < upto, name)
    return chosen
