"""Exact duplicates: two-pass Bloom filtering in DataFrame functions only.

Pass one counts, for two hash slots of every text's SHA-256, how often each slot is hit; the slots hit at
least twice are packed into bitmaps and form the filter of possibly repeated texts.  Pass two reads the
digests again beside the broadcast filter.  Rows whose slots are not both set are alone and pass straight
through; only the others shuffle, as digests, to be grouped exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .scan import id_and_text

MAP_BITS = 32768  # of one bitmap of bitmap_construct_agg
MAX_FILTER_BITS = 1 << 28  # 32 MB: bounds what is broadcast
BITS_PER_ROW = 16
HOT_SHARE = 4096  # a group above 1 / HOT_SHARE of all rows is joined by broadcast; there are at most so many


def _slots(digest: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(digest, F.lit(seed)), F.lit(bits)) for seed in (1, 2)]


def repeat_filter(digests: DataFrame, bits: int) -> DataFrame:
    """Bitmaps ``(map_no, map)`` of the slots that at least two rows hit; at most ``bits / MAP_BITS`` rows."""
    slot = F.explode(F.array_distinct(F.array(*_slots(F.col("sha"), bits)))).alias("slot")
    twice = digests.select(slot).groupBy("slot").count().where("count >= 2")
    return twice.groupBy(F.expr(f"slot div {MAP_BITS}").alias("map_no")).agg(
        F.bitmap_construct_agg(F.pmod("slot", F.lit(MAP_BITS))).alias("map")
    )


def may_repeat(digests: DataFrame, filter_maps: DataFrame, bits: int) -> DataFrame:
    """Add ``may_repeat``: whether both slots of the row are set in the filter."""
    out = digests
    for i, slot in enumerate(_slots(F.col("sha"), bits)):
        maps = filter_maps.select(F.col("map_no").alias(f"map_no_{i}"), F.col("map").alias(f"map_{i}"))
        out = out.withColumn(f"slot_{i}", slot).join(
            F.broadcast(maps), F.expr(f"slot_{i} div {MAP_BITS} = map_no_{i}"), "left"
        )
    byte = "cast(conv(hex(substring(map_{0}, cast(slot_{0} % 32768 div 8 as int) + 1, 1)), 16, 10) as bigint)"
    bit = "coalesce(getbit(" + byte + ", cast(slot_{0} % 8 as int)) = 1, false)"
    return out.select(*digests.columns, F.expr(f"{bit.format(0)} and {bit.format(1)}").alias("may_repeat"))


def join_to_groups(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Rows with the columns of their group, from a written table with one row per ``key`` and its ``group_size``.

    Groups above a 4096th of all rows, of which there are at most 4096, are joined by broadcast, so that no key with
    many rows is shuffled to one task.
    """
    limit = max(1, (groups.agg(F.sum("group_size")).first()[0] or 0) // HOT_SHARE)
    hot, cool = groups.where(F.col("group_size") > limit), groups.where(F.col("group_size") <= limit)
    hot_rows = rows.join(F.broadcast(hot), key)
    cool_rows = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cool, key)
    return hot_rows.unionByName(cool_rows.select(*hot_rows.columns))


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_filter_bits: int = MAX_FILTER_BITS
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their bytes are; the largest id of a group stays.  A null text is empty.  A null id is
    never the one that stays unless all ids of its group are null, and then ``kept`` is false.  Repeated rows count
    each and, having one id, are kept or dropped together.  An empty table gives no rows.

    The filter has 16 bits a row up to ``max_filter_bits``.  Beyond that it fills up: more rows shuffle, as 32-byte
    digests, and results stay the same.
    """
    digests = stage(
        id_and_text(docs, id_col, text_col).select("doc_id", F.unhex(F.sha2("text", 256)).alias("sha")), "digests"
    )
    rows = digests.count()
    bits = min(max_filter_bits, max(MAP_BITS, 1 << (BITS_PER_ROW * max(rows, 1) - 1).bit_length()))
    flagged = stage(may_repeat(digests, repeat_filter(digests, bits), bits), "flagged")
    alone = flagged.where(~F.col("may_repeat")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), "sha"
    )
    maybe = flagged.where("may_repeat").select("doc_id", "sha")
    groups = stage(
        maybe.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups"
    )
    grouped = join_to_groups(maybe, groups, "sha")
    columns = ["doc_id", "keep_id", "group_size", "sha"]
    return (
        alone.unionByName(grouped.select(*columns))
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )
    )
