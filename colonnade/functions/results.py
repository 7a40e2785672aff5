"""Small result tables built on the driver from a bounded set of numbers."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def _type(values: list) -> str:
    for v in values:
        if v is None:
            continue
        if isinstance(v, (bool, np.bool_)):
            return "boolean"
        if isinstance(v, (int, np.integer)):
            return "bigint"
        if isinstance(v, (float, np.floating)):
            return "double"
        return "string"
    return "double"


def _plain(v):
    if isinstance(v, np.generic):
        v = v.item()
    if isinstance(v, float) and math.isnan(v):
        return None
    return v


def table_of(spark: SparkSession, rows: Sequence[dict]) -> DataFrame:
    """A DataFrame from dicts with equal keys; NaN becomes null, types come from the first known value."""
    if not rows:
        raise ValueError("no rows")
    names = list(rows[0])
    schema = ", ".join(f"`{n}` {_type([r[n] for r in rows])}" for n in names)
    types = {n: _type([r[n] for r in rows]) for n in names}
    data = [
        tuple(float(r[n]) if types[n] == "double" and _plain(r[n]) is not None else _plain(r[n]) for n in names)
        for r in rows
    ]
    return spark.createDataFrame(data, schema)
