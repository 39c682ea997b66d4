"""Moments of sliding windows without running sums that are subtracted.

The steps of a series are cut into blocks of the window's length. A window is then the end of one block and the beginning
of the next, so its moments are those of a suffix and of a prefix, each grown value by value, and merged. No value is ever
taken away, so nothing of one that has left is kept by rounding; values count from the first of their block, so large ones
that differ little keep their digits. A step costs the same whatever the window's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Frames of up to so many steps are aggregated anew for each row; longer ones come from two parts.
FRAME_STEPS = 240


def _merged(a: Column, b: Column, values: list[str]) -> dict[str, Column]:
    """Of the later part ``b``, and of ``a`` before it where there is one; means count from the shift of ``b``."""
    na = F.coalesce(a["n"], F.lit(0))
    n = na + b["n"]
    share = F.when(n > 0, n)
    # From the mean of a to that of b; a part without values has none.
    gap = {v: F.when((na > 0) & (b["n"] > 0), b[f"mean_{v}"] - a[f"mean_{v}"] + (b[f"shift_{v}"] - a[f"shift_{v}"])).otherwise(0.0) for v in values}
    mean = {v: F.when(b["n"] > 0, b[f"mean_{v}"] - gap[v] * na / share).otherwise(a[f"mean_{v}"] + a[f"shift_{v}"] - F.coalesce(b[f"shift_{v}"], F.lit(0.0))) for v in values}
    both = lambda c, x, y: (F.coalesce(a[c], F.lit(0.0)) + F.coalesce(b[c], F.lit(0.0)) + gap[x] * gap[y] * na * b["n"] / share) / share
    out = {"n": n} | {f"shift_{v}": F.coalesce(b[f"shift_{v}"], F.lit(0.0)) for v in values} | {f"mean_{v}": mean[v] for v in values} | {f"var_{v}": both(f"m2_{v}", v, v) for v in values}
    return out | ({"covar": both("c", *values)} if len(values) == 2 else {})


def sliding(rows: DataFrame, keys: list[str], steps: int, values: list[str]) -> DataFrame:
    """``rows`` with n and, of each of one or two ``values``, mean, var and shift over the last ``steps`` rows, and covar.

    Rows are a series' steps by start_time, each there once. A step counts if all ``values`` have one. Means count from the
    shift, so that the mean is their sum; moments are population moments, null without values.
    """
    by, own = Window.partitionBy(*keys).orderBy("start_time"), Window.partitionBy(*keys, "__block")
    run = (Window.unboundedPreceding, Window.currentRow)
    there = F.lit(True)
    for v in values:
        there = there & F.col(v).isNotNull()
    each = rows.withColumn("__at", F.row_number().over(by) - 1).withColumn("__block", F.floor(F.col("__at") / steps))
    whole = own.orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    each = each.withColumns({f"__shift_{v}": F.first(F.when(there, F.col(v).cast("double")), True).over(whole) for v in values})
    x = {v: F.when(there, F.col(v) - F.col(f"__shift_{v}")) for v in values}

    def part(w) -> Column:
        n = F.count(F.when(there, 1)).over(w)
        cols = [n.alias("n")]
        for v in values:
            cols += [F.col(f"__shift_{v}").alias(f"shift_{v}"), F.avg(x[v]).over(w).alias(f"mean_{v}"), (F.var_pop(x[v]).over(w) * n).alias(f"m2_{v}")]
        return F.struct(*cols, *([(F.covar_pop(*x.values()).over(w) * n).alias("c")] if len(values) == 2 else []))

    each = each.withColumn("__head", part(own.orderBy("__at").rowsBetween(*run))).withColumn("__tail", part(own.orderBy(F.desc("__at")).rowsBetween(*run)))
    # The window of a block's last step is the block.
    before = F.when(F.col("__at") % steps != steps - 1, F.lag("__tail", steps - 1).over(by)) if steps > 1 else F.lit(None).cast(each.schema["__tail"].dataType)
    each = each.withColumn("__tail", before)
    return each.select(*rows.columns, *[c.alias(k) for k, c in _merged(F.col("__tail"), F.col("__head"), values).items()])


def last_value(rows: DataFrame, keys: list[str], steps: int, value: str, name: str) -> DataFrame:
    """``rows`` with the last value among the last ``steps`` rows that have one."""
    by = Window.partitionBy(*keys).orderBy("start_time").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = F.row_number().over(Window.partitionBy(*keys).orderBy("start_time"))
    each = rows.withColumn("__at", at).withColumn("__last", F.last(F.when(F.col(value).isNotNull(), F.struct("__at", F.col(value).alias("v"))), True).over(by))
    return each.withColumn(name, F.when(F.col("__at") - F.col("__last")["__at"] < steps, F.col("__last")["v"])).drop("__at", "__last")
