"""What the plan modules share: rounding on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame

from helixlake.functions import mathx as m


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """The named columns, or all doubles, rounded half up."""
    own = columns or [f.name for f in df.schema if f.dataType.typeName() == "double"]
    return df.withColumns({c: m.js_round(c, digits) for c in own})


def r(expression: str, name: str | None = None, digits: int = 6) -> str:
    """The same rounding as SQL."""
    scale = f"{10**digits}.0::DOUBLE"
    return f"floor(({expression}) * {scale} + 0.5) / {scale} AS {name or expression}"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """A constant table as a CTE."""

    def lit(x):
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).lower()
        if isinstance(x, (list, tuple)):
            return "[" + ", ".join(map(lit, x)) + "]"
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)

    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(lit, row)) + ')' for row in rows)})"
