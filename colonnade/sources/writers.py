"""Sinks: the normalised store, CSV exports, report sets, HTML reports and imputed copies."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, SparkSession

from colonnade.context import normalise_missing


def write_store(df: DataFrame, path: str) -> DataFrame:
    """Write zstd Parquet once; an existing store is kept. Returns the stored table."""
    normalise_missing(df).write.mode("ignore").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_reports(reports: dict[str, DataFrame], path: str) -> None:
    """One Parquet directory per report of the set."""
    for name, table in reports.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def read_report(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def write_imputations(df: DataFrame, path: str) -> None:
    """Imputed copies side by side, one directory per ``_imputation``."""
    df.write.mode("overwrite").partitionBy("_imputation").parquet(path)


def render_html(title: str, sections: dict[str, DataFrame], rows: int | None = None) -> str:
    """Plain HTML page of report tables (one row per column, pair or term), every row of them.

    Rows are fetched a partition at a time. ``rows`` is for callers that want a shorter page; a shortened table says so.
    Tables as long as the data belong in ``write_reports``, which writes them beside the page.
    """
    parts = [f"<html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    for name, table in sections.items():
        parts.append(f"<h2>{html.escape(name)}</h2><table border='1'><tr>")
        parts += [f"<th>{html.escape(c)}</th>" for c in table.columns]
        parts.append("</tr>")
        shown = table if rows is None else table.limit(rows)
        for r in shown.toLocalIterator():
            parts.append("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>")
        parts.append("</table>")
        if rows is not None and table.limit(rows + 1).count() > rows:
            parts.append(f"<p>first {rows} rows shown</p>")
    parts.append("</body></html>")
    return "".join(parts)
