"""Data preparation: standardising, distinct with places, runs of integers, equal-width grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean_c and std_c (n - 1) of each column."""
    return df.agg(*(F.avg(c).alias(f"mean_{c}") for c in columns), *(F.stddev_samp(c).alias(f"std_{c}") for c in columns))


def normalize(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with the columns standardised; a constant column becomes 0. The one row of moments is broadcast."""
    stats = moments(df, columns)
    out = df.crossJoin(F.broadcast(stats))
    out = out.withColumns({c: F.when(F.col(f"std_{c}") > 0, (F.col(c) - F.col(f"mean_{c}")) / F.col(f"std_{c}")).otherwise(0.0) for c in columns})
    return out.select(*df.columns)


def unnormalize(df: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    out = df.crossJoin(F.broadcast(stats))
    return out.withColumns({c: F.col(c) * F.col(f"std_{c}") + F.col(f"mean_{c}") for c in columns}).select(*df.columns)


def unique(df: DataFrame, value: str, order: str) -> DataFrame:
    """(value, first_order, n, rank): distinct values with the least order key, counts, and rank from 0. Only the distinct
    values are ranked in one place."""
    groups = df.groupBy(value).agg(F.min(order).alias("first_order"), F.count("*").alias("n"))
    return groups.withColumn("rank", (F.row_number().over(Window.orderBy(value)) - 1).cast("long"))


def continuous_runs(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, left, right): the ends of the run of consecutive integers through each distinct value."""
    order = Window.partitionBy(group).orderBy(value)
    islands = df.select(group, value).distinct().withColumn("_island", F.col(value) - F.row_number().over(order))
    ends = Window.partitionBy(group, "_island")
    return islands.select(group, value, F.min(value).over(ends).alias("left"), F.max(value).over(ends).alias("right"))


def grid_knots(df: DataFrame, columns: list[str], bins: int | None = None, width: float | None = None) -> list[tuple[float, float, int]]:
    """(low, bin width, bins) of each axis: ``bins`` equal bins over the range, or bins of ``width`` over a range widened
    on both sides. A constant axis has one bin of width 1 around its value (of ``width`` in that mode)."""
    if (bins is None) == (width is None):
        raise ValueError("give either bins or width")
    row = df.agg(*(F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")).alias(c) for c in columns)).first()
    out = []
    for c in columns:
        lo, hi = row[c]["lo"], row[c]["hi"]
        if lo is None:
            out.append((0.0, 1.0, 1))
        elif lo == hi:
            w = width or 1.0
            out.append((lo - w / 2, w, 1))
        elif bins:
            out.append((lo, (hi - lo) / bins, bins))
        else:
            n = int(-(-(hi - lo) // width))
            out.append((lo - (n * width - (hi - lo)) / 2, width, n))
    return out


def grid_codes(df: DataFrame, columns: list[str], knots: list[tuple[float, float, int]]) -> DataFrame:
    """df with an integer code_c for each axis: the bin, plus the bins of the axes before; the maximum is in the last bin."""
    offset, out = 0, {}
    for c, (lo, w, n) in zip(columns, knots, strict=True):
        out[f"code_{c}"] = (F.least(F.greatest(F.floor((F.col(c) - lo) / w), F.lit(0)), F.lit(n - 1)) + offset).cast("long")
        offset += n
    return df.withColumns(out)


def grid_histogram(coded: DataFrame, columns: list[str]) -> DataFrame:
    """(axis, code, n) over all axes."""
    axes = F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("axis"), F.col(f"code_{c}").alias("code")) for i, c in enumerate(columns)))).alias("u")
    return coded.select(axes).groupBy("u.axis", "u.code").agg(F.count("*").alias("n"))
