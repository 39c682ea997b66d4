"""z-scores of the last value in a window, as snapshots, rolling frames, the matrix and the heat map.

Only values that are present count. Fewer than two, or a variance of at most 1e-9, give 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MEASURES
from ..functions.scalar import at, hours, safe_div
from .moments import FRAME_STEPS, last_value, sliding
from .scope import series

LEAST_VARIANCE = 1e-9
MOST = 50


def score(n: Column, mean: Column, variance: Column, current: Column) -> Column:
    return safe_div(current - mean, F.sqrt(F.greatest(variance, F.lit(0.0))), (n >= 2) & (variance > LEAST_VARIANCE))


def snapshot(long: DataFrame, as_of: str | Column, windows: list[int]) -> DataFrame:
    """symbol, measure, hours, n, mean, std, current, z for each window that ends before ``as_of``, in one pass."""
    kept = long.where((F.col("start_time") >= at(as_of) - hours(max(windows))) & (F.col("start_time") < at(as_of)) & F.col("value").isNotNull())
    aggs = []
    for w in windows:
        v = F.when(F.col("start_time") >= at(as_of) - hours(w), F.col("value"))
        state = {"n": F.count(v), "mean": F.avg(v), "variance": F.var_pop(v), "current": F.max_by(v, F.when(v.isNotNull(), F.col("start_time")))}
        aggs.append(F.struct(F.lit(w).alias("hours"), *[x.alias(k) for k, x in state.items()]))
    keys = [*series(long), "measure"]
    rows = kept.groupBy(*keys).agg(F.array(*aggs).alias("w")).select(*keys, F.explode("w").alias("w")).where("w.n > 0")
    z = score(*(F.col(f"w.{c}") for c in ("n", "mean", "variance", "current")))
    return rows.select(*keys, "w.hours", "w.n", "w.mean", F.sqrt(F.greatest("w.variance", F.lit(0.0))).alias("std"), "w.current", z.alias("z"))


def rolling(gridded: DataFrame, window_steps: int, keys: list[str] | None = None) -> DataFrame:
    """``gridded`` with n and z over the last ``window_steps`` steps at each step; see ``moments`` for how."""
    keys = keys or series(gridded)
    if window_steps <= FRAME_STEPS:
        frame = Window.partitionBy(*keys).orderBy("start_time").rowsBetween(-(window_steps - 1), 0)
        v = F.col("value")
        c = gridded.withColumns({"n": F.count(v).over(frame), "__mean": F.avg(v).over(frame), "__var": F.var_pop(v).over(frame), "__current": F.last(v, True).over(frame)})
        return c.withColumn("z", F.coalesce(score(*(F.col(k) for k in ("n", "__mean", "__var", "__current"))), F.lit(0.0))).select(*gridded.columns, "n", "z")
    c = last_value(sliding(gridded, keys, window_steps, ["value"]), keys, window_steps, "value", "current")
    z = F.coalesce(score(F.col("n"), F.col("mean_value"), F.col("var_value"), F.col("current") - F.col("shift_value")), F.lit(0.0))
    return c.withColumn("z", z).select(*gridded.columns, "n", "z")


def drifting(values: list[float | None], window_steps: int) -> list[tuple[int, float]]:
    """n and z of one symbol's steps under the count-drifting update, as a fold.

    A new value replaces the one a window earlier only if both are there; without the old one the count grows, without a
    new one nothing leaves.
    """
    n, mean, m2, current, out = 0, 0.0, 0.0, None, []
    for t, new in enumerate(values):
        old = values[t - window_steps] if t >= window_steps else None
        if new is not None:
            if old is not None and n:
                before = mean
                mean += (new - old) / n
                m2 += (new - old) * (new - mean + old - before)
            else:
                n += 1
                before = mean
                mean += (new - before) / n
                m2 += (new - before) * (new - mean)
            current = new
        var = max(m2 / n, 0.0) if n else 0.0
        out.append((n, (current - mean) / var**0.5 if n >= 2 and var > LEAST_VARIANCE else 0.0))
    return out


def rolling_compat(gridded: DataFrame, window_steps: int) -> DataFrame:
    """symbol, start_time, n, z under the count-drifting update; a symbol's steps are one group."""
    import pandas as pd

    keys = series(gridded)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("start_time")
        found = drifting([None if pd.isna(v) else float(v) for v in group["value"]], window_steps)
        return pd.DataFrame({**{c: group[c] for c in keys}, "start_time": group["start_time"], "n": [x[0] for x in found], "z": [x[1] for x in found]})

    names = ", ".join(f"{c} string" for c in keys)
    return gridded.select(*keys, "start_time", "value").groupBy(*keys).applyInPandas(run, f"{names}, start_time timestamp_ntz, n bigint, z double")


def integrity(gridded: DataFrame, window_steps: int) -> DataFrame:
    """Per symbol: steps without a new value, values added without an old one, values that replaced an old one."""
    old = F.lag("value", window_steps).over(Window.partitionBy(*series(gridded)).orderBy("start_time"))
    rows = gridded.withColumn("old", old)
    return rows.groupBy(*series(gridded)).agg(
        F.count_if(F.col("value").isNull()).alias("missing_new"),
        F.count_if(F.col("value").isNotNull() & F.col("old").isNull()).alias("added_without_old"),
        F.count_if(F.col("value").isNotNull() & F.col("old").isNotNull()).alias("updated_with_old"),
    )


def matrix(scores: DataFrame, hours_: int, x: str, y: str, z: str | None = None, symbols: list[str] | None = None, digits: int = 3) -> DataFrame:
    """symbol and its point of two or three measures, in the order asked for."""
    axes = [x, y, *([z] if z else [])]
    wide = scores.where(F.col("hours") == hours_).groupBy(*series(scores)).agg(*[F.max(F.when(F.col("measure") == m, F.col("z"))).alias(f"a{i}") for i, m in enumerate(axes)])
    point = F.array(*[F.round(f"a{i}", digits) + F.lit(0.0) for i in range(len(axes))])
    out = wide.select(*series(scores), point.alias("point"))
    if symbols is None:
        return out
    asked = F.array(*[F.lit(s) for s in dict.fromkeys(symbols)]) if symbols else F.array().cast("array<string>")
    return out.withColumn("place", F.array_position(asked, F.col("symbol"))).where("place > 0").orderBy("place").drop("place")


def heatmap(history: DataFrame, measure: str, hours_: int, symbols: list[str], digits: int = 3) -> DataFrame:
    """y (symbol's place), x (time's place), time, symbol, value: each symbol at each time; null where it has no record.

    Symbols without any record have no row of the picture. Times that follow each other and read alike are one place, also
    of different days; of a symbol's records in one place the last by ``calculated_at`` counts.
    """
    kept = history.where((F.col("hours") == hours_) & F.col("symbol").isin(symbols)).withColumn("time", F.date_format("calculated_at", "HH:mm"))
    slot = F.date_trunc("minute", "calculated_at").cast("timestamp_ntz")
    cells = kept.groupBy(slot.alias("slot"), "time", "symbol").agg(F.max_by(F.struct("calculated_at", measure), "calculated_at").alias("last"))
    # The two axes of one picture: numbering them is a window over an axis alone.
    by_slot = Window.orderBy("slot")
    slots = cells.select("slot", "time").distinct().withColumn("next", F.coalesce((F.lag("time").over(by_slot) != F.col("time")).cast("int"), F.lit(0)))
    slots = slots.withColumn("x", F.sum("next").over(by_slot).cast("int"))
    cells = cells.join(slots.select("slot", "x"), "slot").groupBy("x", "time", "symbol").agg(F.max_by(F.col("last")[measure], F.col("last")["calculated_at"]).alias("value"))
    x = cells.select("x", "time").distinct()
    asked = F.array(*[F.lit(s) for s in dict.fromkeys(symbols)]).cast("array<string>")
    y = cells.select("symbol").distinct().withColumn("y", F.row_number().over(Window.orderBy(F.array_position(asked, F.col("symbol")))) - 1)
    axes = y.agg(F.collect_list(F.struct("y", "symbol")).alias("s"))
    rows = x.crossJoin(F.broadcast(axes)).select("time", "x", F.explode("s").alias("s")).select("time", "x", "s.y", "s.symbol")
    return rows.join(cells.drop("time"), ["x", "symbol"], "left").select("y", "x", "time", "symbol", (F.round("value", digits) + F.lit(0.0)).alias("value"))


def drift(rolled: DataFrame, long: DataFrame, as_of: str | Column, window: int, measure: str = "price", tolerance: float = 0.25) -> DataFrame:
    """symbol, z, independent, drifted, valid: the last step of a rolling frame held against a snapshot of the same window.

    No z-score of real candles is beyond MOST, so such a one isn't valid.
    """
    keys = series(rolled)
    last = rolled.groupBy(*keys).agg(F.max_by("z", "start_time").alias("z"))
    other = snapshot(long.where(F.col("measure") == measure), as_of, [window]).select(*keys, F.col("z").alias("independent"))
    return last.join(other, keys).withColumn("drifted", F.abs(F.col("z") - F.col("independent")) > tolerance).withColumn("valid", F.abs("z") <= MOST)


def history_rows(scores: DataFrame, calculated_at: str | Column, symbols: DataFrame | None = None) -> DataFrame:
    """The history's form of a snapshot: a row for each symbol and window with the z-scores of its measures, 0 where one is absent.

    With the symbol dimension ``symbols`` (symbol and its market), symbols that it lacks are left out.
    """
    keys = [*series(scores), "hours"]
    one = lambda m: F.coalesce(F.max(F.when(F.col("measure") == m, F.col("z"))), F.lit(0.0)).alias(m)
    rows = scores.groupBy(*keys).agg(*[one(m) for m in MEASURES]).withColumn("calculated_at", at(calculated_at))
    return rows.join(symbols.select(*series(symbols)).distinct(), series(symbols), "left_semi") if symbols is not None else rows
