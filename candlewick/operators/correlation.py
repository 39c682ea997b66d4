"""Correlation of all pairs: matrices over several windows in one pass, rolling frames, sub-matrices, diagnostics.

Moments are population moments over the steps where both symbols have a value; a pair with fewer than two such steps, or
with a constant side, has correlation 0. Pairs are in the order of the symbols' names, and within a market.

``matrix`` takes two blocks of symbols at a time and has all their moments from a few matrix products; ``joined`` has the
same moments from a join on the step, and serves to check them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import at, hours, safe_div, step_index, triangle_index
from .blocks import block_pairs, pairs_of
from .moments import FRAME_STEPS, sliding
from .scope import scoped


def pairs(values: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys``, start_time, symbol1, symbol2, x, y where both symbols of a pair have a value.

    An equi-join on the step, so each step's pairs are made where its values meet.
    """
    on = [*scoped(values, keys), "start_time"]
    some = values.where("value is not null")
    a = some.select(*on, F.col("symbol").alias("symbol1"), F.col("value").alias("x"))
    b = some.select(*on, F.col("symbol").alias("symbol2"), F.col("value").alias("y"))
    return a.join(b, on).where("symbol1 < symbol2")


def all_pairs(values: DataFrame, keys: list[str] | None = None, blocks: int | None = None) -> DataFrame:
    """Each pair of symbols once, whether or not they ever meet; made by blocks of symbols."""
    keys = scoped(values, keys)
    names = values.select(*keys, "symbol").distinct().withColumn("p", F.array().cast("array<double>"))
    rows = block_pairs(names, keys, blocks).select(*keys, "same", "lo", "parts", F.explode("parts").alias("a"))
    rows = rows.select(*keys, "same", "lo", "a", F.explode("parts").alias("b")).where(F.col("a.symbol") < F.col("b.symbol"))
    rows = rows.where(F.col("same") | ((F.col("a.own") == F.col("lo")) != (F.col("b.own") == F.col("lo"))))
    return rows.select(*keys, F.col("a.symbol").alias("symbol1"), F.col("b.symbol").alias("symbol2"))


def pearson(n: Column, covar: Column, var_x: Column, var_y: Column) -> Column:
    ok = (n > 1) & (var_x * var_y > 0)
    return safe_div(covar, F.sqrt(F.greatest(var_x * var_y, F.lit(0.0))), ok)


def _moments(inside: Column | None = None) -> dict[str, Column]:
    x, y = (F.when(inside, F.col(c)) if inside is not None else F.col(c) for c in ("x", "y"))
    return {"n": F.count(x), "covar": F.covar_pop(x, y), "var_x": F.var_pop(x), "var_y": F.var_pop(y)}


def _products(keys: list[str], windows: list[int], steps: list[int]):
    """Moments and correlation of all pairs of two blocks of symbols, for each window; ``steps`` are the windows' lengths."""
    names = [*keys, "hours", "symbol1", "symbol2", "n", "correlation"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                symbols, z, i, j = pairs_of(batch.column("parts")[k].values, batch.column("same")[k].as_py(), batch.column("lo")[k].as_py(), max(steps))
                if not len(i):
                    continue
                one, two = pa.array([symbols[x] for x in i]), pa.array([symbols[x] for x in j])
                # Steps at which no symbol has a value add nothing.
                used = np.flatnonzero(np.isfinite(z).any(0))
                z = z[:, used]
                for w, length in zip(windows, steps):
                    v = z[:, np.searchsorted(used, max(steps) - length) :]
                    m = np.isfinite(v)
                    # Centred by the symbol, so that the sums of products keep their digits.
                    count = np.maximum(m.sum(1, keepdims=True), 1)
                    v = np.where(m, v, 0.0)
                    v = np.where(m, v - v.sum(1, keepdims=True) / count, 0.0)
                    m = m.astype(float)
                    n, s, q, x = m @ m.T, v @ m.T, (v * v) @ m.T, v @ v.T
                    n, sx, sy, sxx, syy, sxy = n[i, j], s[i, j], s[j, i], q[i, j], q[j, i], x[i, j]
                    ok = n > 1
                    d = np.where(ok, n, 1.0)
                    # What rounding leaves of a constant side is no variance.
                    var = [np.where(a / d - (b / d) ** 2 > 1e-12 * a / d, a / d - (b / d) ** 2, 0.0) for a, b in ((sxx, sx), (syy, sy))]
                    ok &= var[0] * var[1] > 0
                    c = np.where(ok, (sxy / d - sx * sy / d**2) / np.sqrt(np.where(ok, var[0] * var[1], 1.0)), 0.0)
                    of = [pa.array([batch.column(c_)[k].as_py()] * len(i), pa.string()) for c_ in keys]
                    yield pa.RecordBatch.from_arrays([*of, pa.array(np.full(len(i), w, np.int32)), one, two, pa.array(n.astype(np.int64)), pa.array(c)], names)

    return run


def matrix(values: DataFrame, as_of: str | Column, windows: list[int], keys: list[str] | None = None, unit: str = "minute", blocks: int | None = None) -> DataFrame:
    """``keys``, hours, symbol1, symbol2, n, correlation for all windows that end before ``as_of``, every pair of symbols once.

    A symbol is one row with its values in the longest window, by steps of ``unit``; of values that share a step one counts.
    ``keys`` hold strings.
    """
    keys = scoped(values, keys)
    start, seconds = at(as_of) - hours(max(windows)), {"minute": 60, "hour": 3600}[unit]
    inside = (F.col("start_time") >= start) & (F.col("start_time") < at(as_of)) & F.col("value").isNotNull()
    value = F.struct(step_index(F.col("start_time"), start, seconds).cast("int").alias("i"), F.col("value").cast("double").alias("v"))
    row = values.groupBy(*keys, "symbol").agg(F.collect_list(F.when(inside, value)).alias("p"))
    schema = ", ".join([*[f"{c} string" for c in keys], "hours int, symbol1 string, symbol2 string, n bigint, correlation double"])
    return block_pairs(row, keys, blocks).mapInArrow(_products(keys, windows, [w * 3600 // seconds for w in windows]), schema)


def joined(values: DataFrame, as_of: str | Column, window: int, keys: list[str] | None = None) -> DataFrame:
    """``keys``, symbol1, symbol2, n, correlation of one window by Spark's own moments over a join on the step.

    For pairs that meet in two steps at least.
    """
    keys, m = scoped(values, keys), _moments()
    kept = values.where((F.col("start_time") >= at(as_of) - hours(window)) & (F.col("start_time") < at(as_of)))
    return pairs(kept, keys).groupBy(*keys, "symbol1", "symbol2").agg(m["n"].alias("n"), pearson(m["n"], m["covar"], m["var_x"], m["var_y"]).alias("correlation")).where("n > 1")


def drift(long: DataFrame, values: DataFrame, as_of: str | Column, window: int, keys: list[str] | None = None, tolerance: float = 0.2) -> DataFrame:
    """``keys``, symbol1, symbol2, correlation, independent, difference, drifted: a matrix held against ``joined``.

    A pair has drifted if the two differ by more than ``tolerance`` or the matrix's value is over 1.000001.
    """
    keys = scoped(values, keys)
    mine = long.where(F.col("hours") == window).select(*keys, "symbol1", "symbol2", "correlation")
    other = joined(values, as_of, window, keys).select(*keys, "symbol1", "symbol2", F.col("correlation").alias("independent"))
    gap = F.abs(F.col("correlation") - F.col("independent"))
    return mine.join(other, [*keys, "symbol1", "symbol2"]).withColumn("difference", gap).withColumn("drifted", (F.col("difference") > tolerance) | (F.abs("correlation") > 1.000001))


def diagnostics(values: DataFrame) -> DataFrame:
    """n, means, variances, covariance, denominator and correlation of each pair, with a flag for impossible ones."""
    m, keys = _moments(), [*scoped(values, None), "symbol1", "symbol2"]
    found = pairs(values).groupBy(*keys).agg(m["n"].alias("n"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"), *[m[k].alias(k) for k in ("var_x", "var_y", "covar")])
    out = all_pairs(values).join(found, keys, "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint" if c == "n" else "double") for c in found.columns[len(keys):]})
    out = out.withColumn("denominator", F.sqrt(F.greatest(F.col("var_x") * F.col("var_y"), F.lit(0.0))))
    out = out.withColumn("correlation", pearson(*(F.col(c) for c in ("n", "covar", "var_x", "var_y"))))
    return out.withColumn("valid", (F.abs("correlation") <= 1.000001) & (F.col("var_x") >= -1e-9) & (F.col("var_y") >= -1e-9))


def rolling(gridded: DataFrame, window_steps: int, keys: list[str] | None = None) -> DataFrame:
    """``keys``, symbol1, symbol2, start_time, n, correlation over the last ``window_steps`` steps of the dense grid.

    ``gridded`` has symbol, start_time, value on all steps; gaps count as steps.
    """
    keys = scoped(gridded, keys)
    on = [*keys, "start_time"]
    a = gridded.select(*on, F.col("symbol").alias("symbol1"), F.col("value").alias("x"))
    b = gridded.select(*on, F.col("symbol").alias("symbol2"), F.col("value").alias("y"))
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    joined = a.join(b, on).where("symbol1 < symbol2").select(*keys, "symbol1", "symbol2", "start_time", F.when(both, F.col("x")).alias("x"), F.when(both, F.col("y")).alias("y"))
    by = Window.partitionBy(*keys, "symbol1", "symbol2").orderBy("start_time")
    out = [*keys, "symbol1", "symbol2", "start_time", "n", "correlation"]
    if window_steps <= FRAME_STEPS:
        frame = by.rowsBetween(-(window_steps - 1), 0)
        m = {k: v.over(frame) for k, v in _moments().items()}
        return joined.withColumns(m).withColumn("correlation", pearson(*(F.col(c) for c in ("n", "covar", "var_x", "var_y")))).select(*out)
    c = sliding(joined, [*keys, "symbol1", "symbol2"], window_steps, ["x", "y"])
    return c.withColumn("correlation", pearson(*(F.col(k) for k in ("n", "covar", "var_x", "var_y")))).select(*out)


def triangle(long: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys``, symbols, values: the flat strict upper triangle, row-major."""
    keys = keys or []
    packed = long.groupBy(*keys).agg(
        F.array_sort(F.array_union(F.collect_set("symbol1"), F.collect_set("symbol2"))).alias("symbols"),
        F.array_sort(F.collect_list(F.struct("symbol1", "symbol2", "correlation"))).alias("p"),
    )
    return packed.select(*keys, "symbols", F.col("p.correlation").alias("values"))


def submatrix(long: DataFrame, requested: list[str], digits: int = 3) -> DataFrame:
    """place, symbol1, symbol2, correlation for the requested symbols in their order, each once, unknown ones dropped.

    If none is known the whole matrix is returned; one known symbol has no pairs. ``place`` is the flat index.
    """
    asked = F.array(*[F.lit(s) for s in dict.fromkeys(requested)]).cast("array<string>")
    # The symbols of a matrix are a dimension: its square is the matrix.
    names = all_symbols(long).withColumn("i", F.nullif(F.array_position(asked, F.col("symbol")), F.lit(0)))
    whole = Window.partitionBy()
    names = names.withColumn("any", F.max("i").over(whole).isNotNull()).where(F.col("i").isNotNull() | ~F.col("any"))
    chosen = names.select("symbol", (F.row_number().over(Window.orderBy("i", "symbol")) - 1).cast("bigint").alias("i"), F.count(F.lit(1)).over(whole).alias("n"))
    both = long.select(F.col("symbol1").alias("s1"), F.col("symbol2").alias("s2"), "correlation")
    found = both.join(chosen.select(F.col("symbol").alias("s1"), F.col("i").alias("i1"), "n"), "s1").join(chosen.select(F.col("symbol").alias("s2"), F.col("i").alias("i2")), "s2")
    swap = F.col("i1") > F.col("i2")
    return found.select(
        triangle_index(F.col("i1"), F.col("i2"), F.col("n")).alias("place"),
        F.when(swap, F.col("s2")).otherwise(F.col("s1")).alias("symbol1"),
        F.when(swap, F.col("s1")).otherwise(F.col("s2")).alias("symbol2"),
        (F.round("correlation", digits) + F.lit(0.0)).alias("correlation"),
    )


def all_symbols(long: DataFrame) -> DataFrame:
    return long.select(F.explode(F.array("symbol1", "symbol2")).alias("symbol")).distinct()
