"""Markdown tables of small results."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

#: A report table is a few rows; more is a mistake, not a report.
MOST_ROWS = 10_000


def number(v) -> str:
    if v is None:
        return "n/a"
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return str(v)
    if isinstance(v, int):
        return f"{v:,}"
    if math.isnan(v):
        return "n/a"
    if v == 0:
        return "0"
    size = abs(v)
    return f"{v:.1e}" if size < 1e-4 else f"{v:,.4f}" if size < 10 else f"{v:,.1f}"


def markdown(df: DataFrame, index: str | None = None) -> str:
    names = [index, *(c for c in df.columns if c != index)] if index else df.columns
    rows = df.select(*(f"`{n}`" for n in names)).limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows are no report")
    lines = ["| " + " | ".join(["" if index else names[0], *names[1:]]) + " |", "|" + "---|" * len(names)]
    return "\n".join(lines + ["| " + " | ".join([str(r[0]), *(number(v) for v in r[1:])]) + " |" for r in rows])


def report(title: str, intro: str, sections: list[tuple[str, DataFrame, str | None]]) -> str:
    """A report: every section is a named query."""
    parts = [f"# {title}", intro]
    for name, df, index in sections:
        parts += [f"## {name}", markdown(df, index)]
    return "\n\n".join(parts) + "\n"
