"""Helpers shared by the query modules: result canonicalisation and SQL assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canon(df: DataFrame) -> DataFrame:
    """Integers as BIGINT, floating point as DOUBLE rounded to 6 places (and no -0.0)."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), 6) + 0.0
        out.append(c.alias(field.name))
    return df.select(*out)


def sql(body: str, ints: str = "", floats: str = "", texts: str = "", bools: str = "") -> str:
    """Wrap a query so that its column types match :func:`canon`."""
    cols = ([f"CAST({c} AS BIGINT) AS {c}" for c in ints.split()]
            + [f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in floats.split()]
            + [f"CAST({c} AS VARCHAR) AS {c}" for c in texts.split()]
            + [f"CAST({c} AS BOOLEAN) AS {c}" for c in bools.split()])
    return f"SELECT {', '.join(cols)} FROM ({body})"


def with_ctes(ctes: dict[str, str], names: list[str], body: str) -> str:
    """``WITH`` clause holding the named relations and everything they refer to."""
    needed: list[str] = []

    def visit(name: str) -> None:
        if name in needed:
            return
        for other in ctes:
            if other != name and f" {other} " in f" {ctes[name]} ".replace("\n", " ").replace(",", " ").replace(")", " "):
                visit(other)
        needed.append(name)

    for name in names:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({ctes[n]})" for n in needed) + "\n" + body
