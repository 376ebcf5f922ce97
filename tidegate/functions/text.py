"""Text expressions: cleaning of cells, spelling keys, re-spelling, canonical text."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidegate import constants as K


def normalised_cell(c: Column) -> Column:
    """Strip; '?' and empty text become NULL; NULL stays NULL."""
    stripped = F.trim(c)
    return F.when(~stripped.isin(*K.MISSING_MARKS), stripped)


def norm_key(c: Column) -> Column:
    """Spelling key: lower case, ASCII letters and digits only.

    A label with no such character has no key (NULL): labels in other scripts would otherwise
    all share the empty key and be merged into one category.
    """
    key = F.regexp_replace(F.lower(c), K.NORM_KEY_PATTERN, "")
    return F.when(key != "", key)


def respelled(c: Column, variant: Column) -> Column:
    """One of four clerk spellings chosen by ``variant`` (0..3)."""
    return (
        F.when(variant == 0, F.lower(c))
        .when(variant == 1, F.upper(c))
        .when(variant == 2, F.replace(c, F.lit("-"), F.lit(" ")))
        .otherwise(F.replace(F.lower(c), F.lit("-"), F.lit(" ")))
    )


def plain_number(v: Column) -> Column:
    """Integer-valued doubles print without a fraction."""
    return F.when(v == F.floor(v), F.floor(v).cast("bigint").cast("string")).otherwise(v.cast("string"))


def is_magic_code(v: Column) -> Column:
    """All nines (at least two, sign and fraction ignored) or one of the magic negatives."""
    nines = F.floor(F.abs(v)).try_cast("bigint").cast("string").rlike(K.NINES_PATTERN)
    return F.coalesce(nines, F.lit(False)) | v.isin(*[float(x) for x in K.MAGIC_NEGATIVES])
