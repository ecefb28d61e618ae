"""Column expressions: missing values, grouping keys, numbers, ratios, text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)
NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)

# Strings up to this many bytes are grouped as they are. A longer one is replaced
# by a digest that is itself longer, so the two kinds can never be confused.
LONGEST_PLAIN_KEY = 64
DIGEST_LENGTH = len("sha256:") + 64


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def missing_to_null(column: Column, data_type: T.DataType) -> Column:
    """NaN is a missing value; after this, null is the only one."""
    if isinstance(data_type, FLOATING):
        return F.when(~F.isnan(column), column)
    return column


def positional(df: DataFrame) -> DataFrame:
    """The same table with columns named c0, c1, ... and NaN turned into null.

    Addressing columns by position keeps any header legal: dots, backticks,
    spaces, or names that differ only by case.
    """
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(
        *[missing_to_null(F.col(f.name), f.dataType).alias(f.name) for f in plain.schema]
    )


def atomic(column: Column, data_type: T.DataType) -> Column:
    """A comparable form: nested values become JSON text, binary becomes hex."""
    if isinstance(data_type, T.MapType):
        entries = F.map_entries(column)
        sortable = "map<" not in data_type.valueType.simpleString()
        return F.to_json(F.sort_array(entries) if sortable else entries)
    if isinstance(data_type, NESTED):
        return F.to_json(column)
    if isinstance(data_type, T.BinaryType):
        return F.hex(column)
    if isinstance(data_type, (T.NullType, T.CalendarIntervalType)):
        return column.cast("string")
    return column


def key_family(data_type: T.DataType) -> str:
    """The physical type under which values of this column are grouped."""
    if isinstance(data_type, (*INTEGRAL, T.BooleanType, T.DateType, T.TimestampType)):
        return "bigint"
    if isinstance(data_type, FLOATING):
        return "double"
    if isinstance(data_type, T.TimestampNTZType):
        return "timestamp_ntz"
    return "string"


def grouping_key(column: Column, data_type: T.DataType) -> Column:
    """A short value that is equal exactly when the column values are equal.

    Fixed-width values stay as they are. A long string becomes its SHA-256 and its
    length, so a shuffle on whole documents moves about 80 bytes per row.
    """
    family = key_family(data_type)
    if isinstance(data_type, T.DateType):
        return F.unix_date(column).cast("bigint")
    if isinstance(data_type, T.TimestampType):
        return F.unix_micros(column)
    if family in ("bigint", "double"):
        return column.cast(family)
    if family == "timestamp_ntz":
        return column
    text = atomic(column, data_type).cast("string")
    digest = F.concat(
        F.lit("sha256:"), F.sha2(text, 256), F.length(text).cast("string")
    )
    return F.when(F.octet_length(text) <= LONGEST_PLAIN_KEY, text).otherwise(digest)


def row_digest(keys: list[Column]) -> Column:
    """32 bytes that are equal exactly when all grouping keys are equal, null included.

    Each key goes in with its length, so neighbouring keys can't run into each other.
    """
    texts = [key.cast("string") for key in keys]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("n")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def key_text_length(key: Column) -> Column:
    """Number of characters of the string that a string grouping key stands for."""
    stored = F.substring(key, DIGEST_LENGTH + 1, 20).try_cast("bigint")
    return F.when(F.octet_length(key) <= LONGEST_PLAIN_KEY, F.length(key)).otherwise(stored)


def to_number(column: Column, data_type: T.DataType) -> Column:
    """Number or null; unparsable text is null, surrounding spaces are allowed.

    Spark alone would also take the suffixes of Java literals (10d, 10f) and turn
    an overflowing literal into infinity.
    """
    if isinstance(data_type, (T.NumericType, T.BooleanType)):
        return missing_to_null(column.cast("double"), T.DoubleType())
    text = F.lower(F.trim(column.cast("string")))
    number = text.try_cast("double")
    spelled = text.rlike("^[+-]?inf(inity)?$")
    finite = text.rlike("[0-9.]$") & (F.abs(number) < F.lit(float("inf")))
    return F.when(spelled | finite, number)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Six digits, and 0 when there is nothing to divide by."""
    share = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return F.coalesce(F.round(share, 6), F.lit(0.0))


def json_text(column: Column, data_type: T.DataType) -> Column:
    """Text form of a value for result tables; dates and times as ISO-8601."""
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        stamp = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        return F.regexp_replace(stamp, r"\.000000$", "")
    return atomic(column, data_type).cast("string")


def distinct_messages(messages: list[str]) -> list[str]:
    """Drop repeated messages, keep the first of each."""
    return list(dict.fromkeys(messages))
