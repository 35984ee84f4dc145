"""Counter-based pseudo-random draws.

A draw is a pure function of its keys, so a lost partition recomputes to the
same value, and any engine with md5 gives the same integers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 1 << 28


def draw_int(seed: int | str, *keys) -> Column:
    """Integer in [0, 2^28) from md5 of 'seed_key1_key2...'."""
    parts = [F.lit(str(seed))] + [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("_", *parts)), 1, 7), 16, 10).cast("long")


def draw_below(n, seed, *keys) -> Column:
    """Integer in [0, n)."""
    return F.pmod(draw_int(seed, *keys), (F.col(n) if isinstance(n, str) else n).cast("long"))


def draw_unit(seed, *keys) -> Column:
    """Double in [0, 1)."""
    return draw_int(seed, *keys) / F.lit(float(SPAN))


def draw_normal(seed, *keys) -> Column:
    """Standard normal by Box-Muller from two unit draws."""
    u = draw_unit(f"{seed}a", *keys)
    v = draw_unit(f"{seed}b", *keys)
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u)) * F.cos(F.lit(2 * math.pi) * v)
