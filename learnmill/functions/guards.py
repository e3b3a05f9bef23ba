"""Checks of inputs that raise ValueError with what is wrong."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def check_columns(df: DataFrame, columns: Sequence[str], numeric: bool = True) -> DataFrame:
    """df, if it has these columns, each a number where that is asked for."""
    kinds = {f.name: f.dataType for f in df.schema}
    missing = [c for c in columns if c not in kinds]
    if missing:
        raise ValueError(f"no columns {missing}")
    if wrong := [c for c in columns if numeric and not isinstance(kinds[c], T.NumericType)]:
        raise ValueError(f"columns {wrong} are no numbers")
    return df


def check_vectors(df: DataFrame, column: str) -> int:
    """The common length of an array column; null arrays are passed over. Raises if lengths differ, or there is none."""
    lengths = df.where(F.col(column).isNotNull()).agg(F.min(F.size(column)).alias("a"), F.max(F.size(column)).alias("z")).first()
    if lengths["a"] is None or lengths["a"] != lengths["z"]:
        raise ValueError(f"arrays in {column} have {lengths['a']} to {lengths['z']} elements")
    return lengths["a"]


def check_sequence(values: object, name: str = "values") -> tuple:
    """values as a tuple; a single value that is no sequence, or a string, raises."""
    if isinstance(values, str) or not isinstance(values, Sequence):
        raise ValueError(f"{name} must be a sequence")
    return tuple(values)


def check_same_length(**sequences: Sequence) -> int:
    """The common length of named sequences."""
    lengths = {k: len(v) for k, v in sequences.items()}
    if len(set(lengths.values())) > 1:
        raise ValueError(f"lengths differ: {lengths}")
    return next(iter(lengths.values()), 0)
