"""Small pieces that several operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a key bitmap by the count of keys, eight a key, within these bounds: a broadcast of 128 KB to 32 MB. Beyond
#: 33 million keys the map fills, and ever more rows pass that a join then sorts out.
LEAST_BITS, MOST_BITS = 20, 28
_PER_ROW = 15  # bitmap_construct_agg holds 2**15 bits a row


def split_by_keys(df: DataFrame, keys: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be in keys, rows whose key is not): no key of keys is missed.

    The keys are put into a bitmap of bounded size; a fuller bitmap only lets more rows through,
    which a join has to sort out afterwards. keys are counted, so they should stand written.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, (8 * keys.count()).bit_length()))
    slot = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << bits))
    rows = keys.select(F.shiftright(slot, _PER_ROW).alias("_bitmap_row"), slot.bitwiseAND((1 << _PER_ROW) - 1).alias("_bitmap_at"))
    rows = rows.groupBy("_bitmap_row").agg(F.bitmap_construct_agg("_bitmap_at").alias("_bitmap"))
    at = slot.bitwiseAND((1 << _PER_ROW) - 1)
    byte = F.conv(F.hex(F.substring("_bitmap", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.shiftright(byte, 0).bitwiseAND(F.pow(F.lit(2), at.bitwiseAND(7)).cast("int")) > 0, F.lit(False))
    joined = df.join(F.broadcast(rows), F.shiftright(slot, _PER_ROW) == F.col("_bitmap_row"), "left").withColumn("_bitmap_hit", hit)
    return joined.where("_bitmap_hit").select(*df.columns), joined.where("NOT _bitmap_hit").select(*df.columns)
