"""Reading CSV, TSV and Parquet tables."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridscope.functions.columns import json_text, quoted, to_number
from gridscope.functions.tables import local_table

# The texts read as missing, the spellings of booleans, the formats.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
TRUE_TOKENS = ("True", "TRUE", "true")
FALSE_TOKENS = ("False", "FALSE", "false")
SEPARATORS = {"csv": ",", "tsv": "\t"}
FORMATS = (*SEPARATORS, "parquet")

OVERFLOW = "__overflow"


class LoadError(Exception):
    """The table cannot be read."""


class TableNotFound(LoadError, FileNotFoundError):
    """There is nothing at the path."""


class UnsupportedFormat(LoadError):
    """The format is none of csv, tsv and parquet."""


class DuplicateColumns(LoadError):
    """A header names a column twice."""

    def __init__(self, names: list[str]):
        super().__init__("column names occur more than once: " + ", ".join(names))
        self.names = names


def format_of(path: str) -> str:
    return os.path.splitext(path.rstrip("/"))[1].lower().lstrip(".")


def read_table(
    spark: SparkSession,
    path: str,
    format: str | None = None,
    null_tokens: Sequence[str] = NULL_TOKENS,
    infer_dates: bool = False,
    multiline: bool | None = None,
) -> DataFrame:
    """Read a file or a folder of part files; the suffix names the format by default."""
    path = str(path)
    kind = (format or format_of(path)).lower()
    if kind not in FORMATS:
        raise UnsupportedFormat(f"'{kind}' is not one of {', '.join(FORMATS)}")
    try:
        if kind == "parquet":
            return spark.read.parquet(path)
        return _read_delimited(spark, path, SEPARATORS[kind], null_tokens, infer_dates, multiline)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise TableNotFound(f"no such table: {path}") from error
        raise LoadError(f"cannot read {path}: {error}") from error
    except (PySparkException, Py4JJavaError) as error:
        raise LoadError(f"cannot read {path}: {error}") from error


def repeated_names(header: Sequence[str]) -> list[str]:
    """Names that occur more than once after trimming, each once, in order."""
    trimmed = [name.strip() for name in header]
    return list(dict.fromkeys(n for i, n in enumerate(trimmed) if n in trimmed[:i]))


def header_of(spark: SparkSession, path: str, separator: str) -> list[str]:
    """The first record. The CSV reader itself would rename repeated names silently."""
    first = spark.read.csv(path, sep=separator, header=False, quote='"', escape='"').limit(1).first()
    if first is None:
        raise LoadError(f"no columns to read from {path}")
    return [
        "" if name is None else name.lstrip("﻿") if i == 0 else name
        for i, name in enumerate(first)
    ]


def text_facts(spark: SparkSession, path: str, separator: str) -> tuple[bool, list[str]]:
    """Whether a record goes on in the next line, and two of the files' different first lines.

    A record goes on where a quote opens a field and isn't closed in its line; a quote
    inside a field, as in 5" pipe, doesn't. First lines are compared without quotes and
    outer spaces. One pass over the text; a row per file is gathered.
    """
    field = re.escape(separator)
    # Doubled quotes are gone first, so the pattern has no loop over alternatives, which
    # would nest once per character of a long line.
    single = F.replace(F.col("value"), F.lit('""'), F.lit(""))
    open_quote = single.rlike(rf'(?:^|{field})"[^"]*+$')
    lines = spark.read.text(path).select(
        "value", "_metadata.file_path", "_metadata.file_block_start",
        F.monotonically_increasing_id().alias("line"),
    )
    place = F.struct("file_block_start", "line")
    files = lines.groupBy("file_path").agg(
        F.min_by("value", place).alias("head"), F.max(open_quote).alias("open")
    )
    head = F.trim(F.regexp_replace(F.replace("head", F.lit('"'), F.lit("")), "^\ufeff", ""))
    heads = files.groupBy(head.alias("head")).agg(F.max("open").alias("open"))
    facts = heads.agg(F.max("open").alias("open"), F.min("head").alias("low"), F.max("head").alias("high")).first()
    return bool(facts["open"]), [h for h in dict.fromkeys((facts["low"], facts["high"])) if h is not None]


def _read_delimited(
    spark: SparkSession,
    path: str,
    separator: str,
    null_tokens: Sequence[str],
    infer_dates: bool,
    multiline: bool | None,
) -> DataFrame:
    header = header_of(spark, path, separator)
    repeated = repeated_names(header)
    if repeated:
        raise DuplicateColumns(repeated)
    names = [name or f"Unnamed: {i}" for i, name in enumerate(header)]
    if spark.conf.get("spark.sql.caseSensitive") != "true":
        folded = [name.lower() for name in names]
        clash = [name for i, name in enumerate(names) if folded.count(folded[i]) > 1]
        if clash:
            raise LoadError(
                "column names differ only by case: " + ", ".join(clash)
                + "; set spark.sql.caseSensitive=true"
            )
    # Files whose records may span lines cannot be split, so ask first.
    goes_on, heads = text_facts(spark, path, separator)
    if len(heads) > 1:
        raise LoadError(f"the files of {path} have different headers: {heads[0]} and {heads[1]}")
    multiline = goes_on if multiline is None else multiline
    fields = [T.StructField(name, T.StringType()) for name in [*names, OVERFLOW]]
    text = spark.read.csv(
        path, schema=T.StructType(fields), sep=separator, header=True, quote='"', escape='"',
        multiLine=multiline, enforceSchema=True, mode="PERMISSIVE",
    )
    tokens = list(null_tokens)
    cleaned = text.select(
        *[
            F.when(~F.col(quoted(name)).isin(tokens), F.col(quoted(name))).alias(name)
            for name in names
        ],
        OVERFLOW,
    )
    types = vote_types(cleaned, names, infer_dates)
    return cleaned.select(
        *[typed(F.col(quoted(name)), types[name]).alias(name) for name in names]
    )


def vote_types(text: DataFrame, names: Sequence[str], infer_dates: bool) -> dict[str, str]:
    """The first type per column that every value fits, from one aggregate."""
    counts = []
    for i, name in enumerate(names):
        column = F.col(quoted(name))
        counts += [
            F.count(column).alias(f"all{i}"),
            F.count(typed(column, "bigint")).alias(f"bigint{i}"),
            F.count(typed(column, "double")).alias(f"double{i}"),
            F.count(typed(column, "boolean")).alias(f"boolean{i}"),
        ]
        if infer_dates:
            counts.append(F.count(typed(column, "timestamp_ntz")).alias(f"timestamp_ntz{i}"))
    if OVERFLOW in text.columns:
        counts.append(F.count(OVERFLOW).alias(OVERFLOW))
    row = text.agg(*counts).first()
    if OVERFLOW in text.columns and row[OVERFLOW]:
        raise LoadError(f"{row[OVERFLOW]} records have more fields than the header")
    types = {}
    kinds = ["bigint", "double", "boolean", *(["timestamp_ntz"] if infer_dates else [])]
    for i, name in enumerate(names):
        fits = [kind for kind in kinds if row[f"{kind}{i}"] == row[f"all{i}"]]
        # A column without any value reads as numbers, all of them missing.
        empty = row[f"all{i}"] == 0
        types[name] = "double" if empty else (fits or ["string"])[0]
    return types


def typed(column: Column, kind: str) -> Column:
    """A text column as the given type; null where it does not fit."""
    if kind == "bigint":
        return F.when(column.rlike(r"^\s*[+-]?[0-9]+\s*$"), column.try_cast("bigint"))
    if kind == "double":
        return to_number(column, T.StringType())
    if kind == "boolean":
        return F.when(column.isin(*TRUE_TOKENS), True).when(column.isin(*FALSE_TOKENS), False)
    if kind == "timestamp_ntz":
        shaped = column.rlike(r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$")
        return F.when(shaped, column.try_cast("timestamp_ntz"))
    return column


def source_facts(df: DataFrame, path: str, row_count: int | None = None) -> DataFrame:
    """One row: file name, extension, number of rows and columns, column names.

    Rows are counted here unless the caller knows their number.
    """
    name = re.split(r"[/\\]", str(path).rstrip("/\\"))[-1]
    if row_count is None:
        counted = df.agg(F.count(F.lit(1)).alias("row_count"))
    else:
        counted = local_table(df.sparkSession, [(row_count,)], "row_count bigint")
    return counted.select(
        F.lit(name).alias("file_name"),
        F.lit(os.path.splitext(name)[1].lower()).alias("file_extension"),
        "row_count",
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        F.array(*[F.lit(c) for c in df.columns]).cast("array<string>").alias("column_names"),
    )


def preview_rows(df: DataFrame, count: int = 5) -> DataFrame:
    """The `count` smallest rows as JSON, missing values as null.

    Each task keeps only its smallest rows, so nothing is sorted as a whole.
    """
    if count <= 0 or not df.columns:
        return local_table(df.sparkSession, [], "seq int, row_json string")
    sortable = [
        F.col(quoted(f.name)) for f in df.schema
        if not isinstance(f.dataType, (T.MapType, T.VariantType, T.CalendarIntervalType))
    ]
    first = df.orderBy(*sortable).limit(count) if sortable else df.limit(count)
    order = F.struct(*sortable) if sortable else F.lit(0)
    values = []
    for f in first.schema:
        column = F.col(quoted(f.name))
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = json_text(column, f.dataType)
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            column = F.when(~F.isnan(column), column)
        values.append(column.alias(f.name))
    found = first.select(
        F.struct(order.alias("place"), F.to_json(F.struct(*values), {"ignoreNullFields": "false"}).alias("row_json")).alias("row")
    )
    # A limited table may arrive in any order.
    listed = found.agg(F.sort_array(F.collect_list("row")).alias("rows"))
    return listed.select(F.posexplode("rows.row_json").alias("seq", "row_json"))
