"""Small fixed tables (anchors, crosswalks, weights, rules) as typed DataFrames.

They are configuration: their size does not depend on the data. As VALUES relations they
carry a size estimate, so the planner itself decides whether to broadcast them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def sql_literal(value: object) -> str:
    """One literal both Spark SQL and DuckDB read the same way."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return f"CAST({value!r} AS DOUBLE)"
    return "'" + str(value).replace("'", "''") + "'"


def values_sql(rows: list[tuple], columns: list[str], alias: str = "t") -> str:
    """``(VALUES ...) AS alias(columns)`` for either engine."""
    body = ", ".join("(" + ", ".join(sql_literal(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) AS {alias}({', '.join(columns)})"


def config_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows as a DataFrame; ``schema`` is a DDL string such as ``"key string, w double"``."""
    fields = [part.strip().split(None, 1) for part in schema.split(",")]
    names = [name for name, _ in fields]
    picked = ", ".join(f"CAST({name} AS {kind}) AS {name}" for name, kind in fields)
    return spark.sql(f"SELECT {picked} FROM {values_sql(rows, names)}")
