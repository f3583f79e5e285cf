"""Sinks for results: CSV files, and CSV or Markdown text of results that a driver can hold."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    """A folder of CSV files, written by the executors."""
    df.write.mode("overwrite").option("header", header).csv(path)


def _shown(df: DataFrame, most: int | None) -> Iterator[Row]:
    """All rows, or the first `most`; one partition at a time comes to the driver."""
    return (df if most is None else df.limit(most)).toLocalIterator()


def csv_text(df: DataFrame, most: int | None = None) -> str:
    """Header and rows, all or at most `most` of them, as text; null is an empty field."""
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(df.columns)
    writer.writerows(_shown(df, most))
    return out.getvalue()


def markdown(df: DataFrame, most: int | None = None) -> str:
    """A Markdown table of all rows, or of at most `most`."""
    cell = lambda x: "" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x).replace("|", "\\|")
    lines = [df.columns, ["-"] * len(df.columns), *[[cell(x) for x in r] for r in _shown(df, most)]]
    return "".join(f"| {' | '.join(x)} |\n" for x in lines)
