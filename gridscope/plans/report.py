"""A report of an analysis: every cell of its result tables as one line."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridscope.functions.columns import quoted
from gridscope.plans.analyze import Analysis

#: Columns that number the rows of a result table.
NUMBERS = ("seq", "position")
#: Results whose rows grow with the data, or are data.
UNBOUNDED = ("class_distribution", "preview")
#: Facts of the run that no result follows from.
TIMES = ("started_at", "ended_at", "duration_seconds")


def report_lines(spark: SparkSession, analysis: Analysis) -> DataFrame:
    """section, item, seq, name and value for every cell of every bounded result.

    The section is the result's name, with `analysis` for the run itself; the item is the
    row's number, 0 for results of one row; seq and name are the column's. A stage that did
    not run has no result, and so no lines. Numbers with a fraction have six digits of it,
    lists are joined by commas, maps and structs are JSON.
    """
    results = {"analysis": analysis.summary_table(spark).drop(*TIMES), **analysis.tables}
    return reduce(DataFrame.unionByName, [_lines(name, df) for name, df in results.items() if name not in UNBOUNDED])


def _lines(section: str, df: DataFrame) -> DataFrame:
    number = next((F.col(c) for c in NUMBERS if c in df.columns), F.lit(0))
    cells = [
        F.struct(F.lit(seq).alias("seq"), F.lit(f.name).alias("name"), _text(F.col(quoted(f.name)), f.dataType).alias("value"))
        for seq, f in enumerate(df.schema)
        if f.name not in NUMBERS
    ]
    lines = df.select(number.cast("int").alias("item"), F.explode(F.array(*cells)).alias("cell"))
    return lines.select(F.lit(section).alias("section"), "item", "cell.seq", "cell.name", "cell.value")


def _text(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return _number(value)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        return F.array_join(value, ",")
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(value)
    return value.cast("string")


def _number(value: Column) -> Column:
    """Six digits after the point; what has none, such as infinity, as it is."""
    return F.coalesce(value.try_cast("decimal(38,6)").cast("string"), value.cast("string"))
