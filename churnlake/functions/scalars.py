"""Scalar builders for record normalisation, hashing and packing."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fields

# White space at the ends of a text, Unicode separators included; the same pattern serves the oracles.
WHITE_ENDS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def flag(c: Column, ones: Iterable[str] = tuple(fields.FLAG_ONE)) -> Column:
    """Flag text to 0/1; the match is case-exact, and anything unknown or null is 0.

    Cast numeric or boolean columns with :func:`flag_number` instead.
    """
    return F.when(c.isin(*ones), F.lit(1)).otherwise(F.lit(0))


def flag_number(c: Column) -> Column:
    """Numeric or boolean flag to 0/1; any value but one is 0."""
    return F.when(c.cast("double") == 1.0, F.lit(1)).otherwise(F.lit(0))


def fraction(c: Column) -> Column:
    """Text to double, null where it does not parse or is not a number."""
    return nan_to_null(c.try_cast("double"))


def whole(c: Column) -> Column:
    """Text to a long by truncation; null, unparsable, infinite and out of range are 0."""
    return F.coalesce(nan_to_null(c.try_cast("double")).try_cast("bigint"), F.lit(0))


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, WHITE_ENDS, "")


def category(c: Column) -> Column:
    """Trimmed lower-case category; blanks and the words for a missing value are null."""
    text = F.when(c.isin("nan", "None"), F.lit("")).otherwise(c)
    return F.nullif(F.lower(stripped(text)), F.lit(""))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def target(c: Column) -> Column:
    """Target text to 0/1 after trimming; unknown and null are 0."""
    return F.when(stripped(c).isin(*fields.TARGET_ONE), F.lit(1)).otherwise(F.lit(0))


def clip(c: Column, lo: Column, hi: Column) -> Column:
    """Clamp to ``[lo, hi]``; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, hi), lo))


def choice_flags(choices: Mapping[str, Mapping[str, str]]) -> list[Column]:
    """One 0/1 column per form choice; an unknown or null choice sets none of its flags."""
    return [
        F.when(F.col(source) == value, F.lit(1)).otherwise(F.lit(0)).alias(name)
        for source, mapping in choices.items()
        for value, name in mapping.items()
    ]


def spread(seed: int | str, *ids: Column) -> Column:
    """An evenly spread text key that depends only on the seed and the ids."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[i.cast("string") for i in ids]))


def fraction_of(key: Column) -> Column:
    """The leading 32 bits of a hex key as a number in [0, 1)."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def fingerprint(c: Iterable[Column]) -> Column:
    """Order-insensitive content hash of a table: the sum of a 60-bit prefix of each row's MD5.

    Every value is hashed behind its length and a null as ``n``, so that different rows never read alike.
    """
    texts = [x.cast("string") for x in c]
    sized = [F.coalesce(F.concat(F.char_length(t).cast("string"), F.lit(":"), t), F.lit("n")) for t in texts]
    row = F.md5(F.concat(*sized))
    return F.sum(F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(20,0)"))


def batch_id(ts: Column) -> Column:
    return F.concat(F.lit("BATCH_"), F.date_format(ts, "yyyyMMdd_HHmmss"))


def pack(names: Iterable[str]) -> Column:
    """The named columns as one JSON object, names in the given order, null fields kept."""
    return F.to_json(F.struct(*[F.col(n) for n in names]), {"ignoreNullFields": "false"})


def unpack(c: Column, names: Iterable[str]) -> list[Column]:
    """The named numbers of a JSON object; absent names are null."""
    parsed = F.from_json(c, "map<string,double>")
    return [F.element_at(parsed, F.lit(n)).alias(n) for n in names]


def r6(c: Column) -> Column:
    """Six decimals, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)
