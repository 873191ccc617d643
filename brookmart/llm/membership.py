"""A bit map of 64-bit ids: small enough to send to every task whatever the table's size.

A set bit means that an id may be in the set. The map has a fixed number of bits, so with
many ids more rows pass it in vain; users join the rest exactly afterwards.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 24


def bitmap(ids: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """Bits of the ids in ``column`` (long), as 64-bit words; at most ``bits / 64`` rows reach the driver."""
    at = F.pmod(F.col(column), F.lit(bits))
    words = ids.groupBy(F.shiftright(at, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod({column}, {bits}) & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def maybe_in(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether each id may be in the set."""
    at = ids.view(np.uint64) % np.uint64(len(bits) * 64)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0
