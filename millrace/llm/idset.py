"""A bitmap of document ids of fixed size, to leave texts that a join cannot need out of its shuffle."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the bitmap, whatever the number of ids: 1 MB.
BITS = 1 << 23


def slot(doc_id: Column | str = "doc_id") -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(BITS))


def bitmap(ids: DataFrame, column: str = "doc_id") -> np.ndarray:
    """Bits of the slots of all ids. Some ids share a slot, so a set bit only says "perhaps"."""
    at = slot(column) + 1
    parts = ids.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros(BITS // 8, dtype=np.uint8)
    for p in parts:  # at most BITS / 32768 rows
        held = np.frombuffer(bytes(p["bits"]), dtype=np.uint8)
        begin = (p["part"] - 1) * 4096
        out[begin : begin + len(held)] = held
    return out


def perhaps(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1
