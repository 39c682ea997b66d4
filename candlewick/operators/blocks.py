"""All pairs of symbols as pairs of blocks: a symbol's values travel once for each block of partners, not for each partner."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_SYMBOLS = 64
#: Pairs whose values a kernel holds at once.
PAIRS = 512


def block_pairs(series: DataFrame, keys: list[str], blocks: int | None = None) -> DataFrame:
    """``keys``, same, lo, parts: for each two blocks of symbols, and each block with itself (``same``), the symbols of both.

    ``series`` has ``keys``, symbol and p, an array. Symbols are dealt to blocks of some BLOCK_SYMBOLS by hash. ``parts``
    is a list of structs own (the symbol's block), symbol, p; ``lo`` is the lesser of the two blocks.
    """
    if blocks is None:
        sizes = series.groupBy(*keys).agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SYMBOLS), F.lit(1)).cast("bigint").alias("blocks"))
        dealt = series.join(sizes, keys) if keys else series.crossJoin(F.broadcast(sizes))
    else:
        dealt = series.withColumn("blocks", F.lit(blocks).cast("bigint"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("symbol"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    both = dealt.groupBy(*keys, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    return both.agg(F.collect_list(F.struct("own", "symbol", "p")).alias("parts")).select(*keys, (F.col("lo") == F.col("hi")).alias("same"), "lo", "parts")


def pairs_of(part: pa.StructArray, same: bool, lo: int, steps: int | None = None) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Names, values (symbols by steps) and the places of the pairs' first and second symbols, in the order of names.

    With ``steps``, p is a list of structs i, v: the values of some of the steps; the others are NaN.
    """
    own, names, p = part.field("own").to_numpy(zero_copy_only=False), part.field("symbol").to_pylist(), part.field("p")
    if steps is None:
        z = p.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(names), -1) if len(names) else np.zeros((0, 0))
    else:
        z = np.full((len(names), steps), np.nan)
        sizes, held = p.value_lengths().to_numpy(zero_copy_only=False), p.flatten()
        z[np.repeat(np.arange(len(names)), sizes), held.field("i").to_numpy(zero_copy_only=False)] = held.field("v").to_numpy(zero_copy_only=False)
    order = np.array(sorted(range(len(names)), key=names.__getitem__), np.int64)
    names, z, own = [names[k] for k in order], z[order], own[order]
    i, j = np.triu_indices(len(names), 1)
    if not same:
        apart = (own[i] == lo) != (own[j] == lo)
        i, j = i[apart], j[apart]
    return names, z, i, j
