"""Column names for intermediate use that a table of any columns cannot clash with."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Each wanted name, with underscores before it until no column of df has it (whatever the case)."""
    held, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in held:
            name = f"_{name}"
        held.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    """The name as an expression, whatever characters it holds."""
    return f"`{name.replace('`', '``')}`"
