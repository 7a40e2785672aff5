"""The cleaning plan: chosen steps applied in a fixed order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from colonnade.context import categorical_columns, normalise_missing, numeric_columns
from colonnade.operators import clean, impute, rows


@dataclass(frozen=True)
class CleaningPlan:
    """Steps run as: duplicates, constant, identifier and sparse columns, numbers, categories, outliers.

    ``numeric`` is mean, median, zero, group_mean, group_median, knn or iterative; ``categorical`` is mode, unknown or
    group_mode; ``outliers`` is cap_iqr, remove_iqr, cap_zscore or remove_zscore. None leaves a step out. ``row_id``
    is needed by knn.
    """

    drop_duplicates: bool = False
    drop_constant: bool = False
    drop_ids: bool = False
    max_missing_percent: float = 100.0
    numeric: str | None = None
    categorical: str | None = None
    group: str | None = None
    outliers: str | None = None
    z_threshold: float = 3.0
    neighbors: int = 5
    max_iter: int = 10
    row_id: str | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        df = normalise_missing(df)
        # Constant and identifier columns are those of the table as it came in.
        drop = (rows.flagged_columns(df, "constant") if self.drop_constant else []) + (rows.flagged_columns(df, "possible_id") if self.drop_ids else [])
        if self.drop_duplicates:
            df = rows.distinct_rows(df)
        df = df.drop(*[c for c in drop if c != self.row_id])
        df = rows.drop_missing_columns(df, self.max_missing_percent)
        numbers = [c for c in numeric_columns(df) if c != self.row_id]
        categories = categorical_columns(df)
        df = self._numbers(df, numbers)
        df = self._categories(df, categories)
        return self._outliers(df, numbers)

    def _numbers(self, df: DataFrame, cols: list[str]) -> DataFrame:
        if not self.numeric or not cols:
            return df
        if self.numeric in ("mean", "median", "zero"):
            return clean.impute_numeric(df, self.numeric, cols)
        if self.numeric in ("group_mean", "group_median"):
            if self.group not in df.columns:
                return df
            return clean.impute_group_numeric(df, self.group, self.numeric.removeprefix("group_"), cols)
        if self.numeric == "knn":
            return impute.impute_knn(df, self.row_id, cols, self.neighbors)
        if self.numeric == "iterative":
            return impute.impute_iterative(df, cols, self.max_iter)
        raise ValueError(f"unknown numeric step {self.numeric!r}")

    def _categories(self, df: DataFrame, cols: list[str]) -> DataFrame:
        if not self.categorical or not cols:
            return df
        if self.categorical == "group_mode":
            return clean.impute_group_mode(df, self.group, cols) if self.group in df.columns else df
        return clean.impute_categorical(df, self.categorical, cols)

    def _outliers(self, df: DataFrame, cols: list[str]) -> DataFrame:
        steps = {
            "cap_iqr": lambda: clean.cap_outliers_iqr(df, cols), "remove_iqr": lambda: clean.remove_outliers_iqr(df, cols),
            "cap_zscore": lambda: clean.cap_outliers_zscore(df, cols, self.z_threshold), "remove_zscore": lambda: clean.remove_outliers_zscore(df, cols, self.z_threshold),
        }
        return steps[self.outliers]() if self.outliers and cols else df
