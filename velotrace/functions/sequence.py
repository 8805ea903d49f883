"""Operations on ordered rows of a group: islands, sessions, sign changes, heading cleaning, smoothing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PI = math.pi


def ordered(keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)


def island(mask: Column, keys: list[str], order: str) -> Column:
    """For rows where mask holds, a number that is equal within a run of consecutive such rows of the group. Other rows: filter them out."""
    w = ordered(keys, order)
    return F.row_number().over(w) - F.sum(mask.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))


def session(order: str, keys: list[str], gap: int) -> Column:
    """Running number of a session: a new one begins where the step from the previous row exceeds `gap`."""
    w = ordered(keys, order)
    return F.sum((F.col(order) - F.lag(order).over(w) > gap).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))


def sign(x: Column) -> Column:
    return F.signum(x).cast("int")


def flips_after(x: Column, keys: list[str], order: str) -> Column:
    """True on the row before a sign change; zero counts as positive."""
    s = F.when(x < 0, -1).otherwise(1)
    return F.coalesce(F.lead(s).over(ordered(keys, order)) != s, F.lit(False))


def falls_through_zero(x: Column, keys: list[str], order: str) -> Column:
    """True on the first strictly negative row after a strictly positive one."""
    return F.coalesce((F.lag(x).over(ordered(keys, order)) > 0) & (x < 0), F.lit(False))


def sign_persists(x: Column, keys: list[str], order: str, k: int) -> Column:
    """True if the next rows, up to k, exist and have one sign."""
    w = ordered(keys, order).rowsBetween(1, k)
    return F.coalesce(F.min(sign(x)).over(w) == F.max(sign(x)).over(w), F.lit(False))


def clean_heading(h: str, keys: list[str], order: str) -> tuple[list[tuple[str, Column]], Column]:
    """Steps (name, column) to add in turn, and the cleaned heading: unwrapped, near the median of its first half, without jumps of pi.

    The sequential correction has a closed form: the anchored first value plus the running sum of steps, each less
    its nearest multiple of pi.
    """
    w = ordered(keys, order)
    run, whole = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    d, u, at, n = f"__d_{h}", f"__u_{h}", f"__at_{h}", f"__n_{h}"
    steps = [
        (d, F.coalesce(F.col(h) - F.lag(h).over(w), F.lit(0.0))),
        (at, F.row_number().over(w) - 1),
        (n, F.count(F.lit(1)).over(whole)),
        (u, F.first(h).over(run) + F.sum(F.col(d) - F.rint(F.col(d) / (2 * PI)) * (2 * PI)).over(run)),
        (f"__m_{h}", F.percentile(F.when(F.col(at) < F.greatest(F.lit(25), F.floor(F.col(n) / 2)), F.col(u)), 0.5).over(whole)),
        (f"__c_{h}", F.sum(F.col(d) - F.rint(F.col(d) / PI) * PI).over(run)),
        (f"__f_{h}", F.first(h).over(run)),
    ]
    first, median = F.col(f"__f_{h}"), F.col(f"__m_{h}")
    return steps, first - F.rint((first - median) / PI) * PI + F.col(f"__c_{h}")


def add_clean_heading(df: DataFrame, h: str, name: str, keys: list[str], order: str) -> DataFrame:
    steps, out = clean_heading(h, keys, order)
    for c, e in steps:
        df = df.withColumn(c, e)
    return df.withColumn(name, out).drop(*(c for c, _ in steps))


def gaussian_kernel(sigma: float) -> list[float]:
    radius = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (j / sigma) ** 2) for j in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def _smooth_array(xs: Column, kernel: list[float]) -> Column:
    """Convolution with edges reflected about the half sample."""
    r, n = len(kernel) // 2, F.size(xs)
    weights = F.array(*[F.lit(x) for x in kernel])

    def at(j: Column) -> Column:
        m = F.pmod(j, 2 * n)
        return F.get(xs, F.when(m >= n, 2 * n - 1 - m).otherwise(m))

    padded = F.transform(F.sequence(F.lit(-r), n - 1 + r), at)
    # The padded series is bound once by a one-element array, so that it isn't computed for each row.
    return F.flatten(
        F.transform(
            F.array(padded),
            lambda p: F.transform(F.sequence(F.lit(1), F.size(p) - 2 * r), lambda i: F.aggregate(F.zip_with(weights, F.slice(p, i, 2 * r + 1), lambda w, x: w * x), F.lit(0.0), lambda a, b: a + b)),
        )
    )


def smooth(df: DataFrame, signals: dict[str, tuple[str, float]], keys: list[str], order: str, fps: float = 12.5) -> DataFrame:
    """df with new columns {name: (signal, sigma in seconds)}: Gaussian smoothing along each group. One aggregation for all signals; a group is one track's or pair's rows."""
    rest = [c for c in df.columns if c not in keys]
    rows = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, *[c for c in rest if c != order]))).alias("__rows"))
    for name, (signal, sigma) in signals.items():
        rows = rows.withColumn(f"__{name}", _smooth_array(F.col(f"__rows.{signal}"), gaussian_kernel(sigma * fps)))
    zipped = rows.select(*keys, F.inline(F.arrays_zip(F.col("__rows").alias("row"), *[F.col(f"__{name}").alias(name) for name in signals])))
    return zipped.select(*keys, "row.*", *signals)
