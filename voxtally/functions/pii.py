"""Masking expressions. ``(?U)`` gives \\b, \\d and \\s their Unicode meaning."""

import sys
import unicodedata

from pyspark.sql import Column, functions as F

from voxtally import constants as K
from voxtally.functions.text import literal_map

_CARD_RUN = r"(?U)\b(\d{13,19})\b"
# Every decimal digit of another script, and what it is worth.
_FOREIGN = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.decimal(c, None) is not None]
_WORTH = "".join(str(unicodedata.decimal(c)) for c in _FOREIGN)
_IBAN_RUN = r"(?U)\b([A-Z]{2}\d{2}[A-Z0-9]{11,30})\b"


def placeholder(entity: Column) -> Column:
    """The mask of an entity name; a name without one gives ``[NAME]``."""
    return F.coalesce(
        F.try_element_at(literal_map(K.PLACEHOLDERS), entity),
        F.concat(F.lit("["), entity, F.lit("]")),
    )


def mask_email(c: Column) -> Column:
    # Without an @ the pattern cannot match; the plain search is much cheaper.
    masked = F.regexp_replace(c, "(?U)" + K.EMAIL_PATTERN, K.PLACEHOLDERS["EMAIL"])
    return F.when(F.contains(c, F.lit("@")), masked).otherwise(c)


def mask_phone(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)" + K.PHONE_PATTERN, K.PLACEHOLDERS["PHONE"])


def mask_person(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)" + K.PERSON_PATTERN, K.PLACEHOLDERS["PERSON"])


def ascii_digits(run: Column) -> Column:
    """Digits of any script as 0 to 9."""
    return F.translate(run, "".join(_FOREIGN), _WORTH)


def _digits(run: Column) -> Column:
    return F.transform(F.split(ascii_digits(run), ""), lambda ch: ch.try_cast("int"))


def passes_luhn(run: Column) -> Column:
    """Check digit of a run of digits: double every second one from the right."""
    weighted = F.transform(
        F.reverse(_digits(run)),
        lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2),
    )
    total = F.aggregate(weighted, F.lit(0), lambda a, d: a + d)
    return F.coalesce(total % 10 == 0, F.lit(False))


def passes_mod97(run: Column) -> Column:
    """IBAN check: move four characters to the end, letters are 10..35, remainder is 1."""
    run = ascii_digits(run)
    moved = F.concat(F.substring(run, 5, 30), F.substring(run, 1, 4))
    values = F.transform(
        F.split(moved, ""),
        lambda ch: F.when(ch.rlike("[0-9]"), F.ascii(ch) - 48).otherwise(F.ascii(ch) - 55),
    )
    rest = F.aggregate(
        values, F.lit(0), lambda a, v: F.when(v > 9, a * 100 + v).otherwise(a * 10 + v) % 97
    )
    return rest == 1


def card_runs(c: Column) -> Column:
    """Distinct 13 to 19 digit runs with a right check digit, in text order."""
    return _checked_runs(c, _CARD_RUN, passes_luhn)


def iban_runs(c: Column) -> Column:
    return _checked_runs(c, _IBAN_RUN, passes_mod97)


def _checked_runs(c, pattern, passes):
    # Lambdas are interpreted, so only rows with a candidate run reach them.
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)))
    return F.when(c.rlike(pattern), F.filter(found, passes)).otherwise(
        F.array().cast("array<string>")
    )


def mask_runs(c: Column, runs: Column, mask: str) -> Column:
    """Each run replaced where it stands as a word of its own, not inside a longer one."""

    def replaced(t, run):
        return F.regexp_replace(t, F.concat(F.lit(r"(?U)\b"), run, F.lit(r"\b")), F.lit(mask))

    return F.when(F.size(runs) > 0, F.aggregate(runs, c, replaced)).otherwise(c)


def mask_card(c: Column) -> Column:
    return mask_runs(c, card_runs(c), K.PLACEHOLDERS["CREDIT_CARD"])


def mask_iban(c: Column) -> Column:
    return mask_runs(c, iban_runs(c), K.PLACEHOLDERS["IBAN_CODE"])
