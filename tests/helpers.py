"""Tables from short row literals."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchlens.tables import SCHEMAS, Tables


def table(spark, name, columns, rows):
    """Rows with some of a table's columns; the others are NULL. Column types follow the schema."""
    import re

    parts = re.split(r", (?![^<]*>)", SCHEMAS[name])
    types = {p.split()[0]: p.split()[1] for p in parts}
    ddl = ", ".join(f"{c} {types[c]}" for c in columns)
    df = spark.createDataFrame([tuple(r) for r in rows], ddl)
    return df.select(*[(F.col(c) if c in columns else F.lit(None).cast(types[c]).alias(c)) for c in types])


def tables(spark, **given):
    """``name=(columns, rows)`` for some tables; the rest are empty."""
    made = {n: table(spark, n, *given.get(n, ([next(iter(SCHEMAS[n].split()))], []))) for n in SCHEMAS}
    return Tables(spark, {n: (lambda _t, _d=d: _d) for n, d in made.items()})


def rows(df, *columns):
    df = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in df.collect()), key=str)
