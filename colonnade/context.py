"""Column classes, missing-value normalisation and the dataset context."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def ref(name: str) -> Column:
    """Column by exact name, also when the name holds dots or blanks."""
    return F.col(quoted(name))


def free_names(taken: Iterable[str], *stems: str) -> list[str]:
    """Each stem, lengthened until no column of ``taken`` bears it (case does not matter)."""
    used = {c.lower() for c in taken}
    out = []
    for stem in stems:
        while stem.lower() in used:
            stem += "_"
        used.add(stem.lower())
        out.append(stem)
    return out


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def other_columns(df: DataFrame) -> list[str]:
    """Dates, timestamps and nested columns: neither numeric nor categorical."""
    known = set(numeric_columns(df)) | set(categorical_columns(df))
    return [c for c in df.columns if c not in known]


def normalise_missing(df: DataFrame) -> DataFrame:
    """Turn NaN into null so that every count below treats both as missing."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floats:
        return df
    return df.select(*[F.nanvl(ref(c), F.lit(None)).alias(c) if c in floats else ref(c) for c in df.columns])


def as_text(df: DataFrame, name: str) -> Column:
    """A value as text, equal texts exactly for equal values (negative zero folded, nested values as JSON)."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.when(ref(name).isNotNull(), F.to_json(F.struct(ref(name))))
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return (ref(name) + F.lit(0.0).cast(dtype)).cast("string")
    if isinstance(dtype, T.BinaryType):
        return F.hex(ref(name))
    return ref(name).cast("string")


@dataclass(frozen=True)
class DatasetContext:
    """A table with its column classes; nothing is computed until a report is asked for."""

    df: DataFrame
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    other: tuple[str, ...]

    @classmethod
    def of(cls, df: DataFrame) -> DatasetContext:
        clean = normalise_missing(df)
        return cls(
            clean,
            tuple(numeric_columns(clean)),
            tuple(categorical_columns(clean)),
            tuple(other_columns(clean)),
        )

    def column_types(self) -> DataFrame:
        classes = {c: "numeric" for c in self.numeric} | {c: "categorical" for c in self.categorical}
        rows = [(f.name, f.dataType.simpleString(), classes.get(f.name, "other")) for f in self.df.schema]
        return self.df.sparkSession.createDataFrame(rows, "column string, data_type string, column_class string")
