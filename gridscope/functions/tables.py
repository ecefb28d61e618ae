"""Handling of small result tables and of large intermediate ones."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def local_table(spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    """A literal table that lives in the plan, so no executor holds it."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    arrow_schema = to_arrow_schema(schema)
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    arrays = [
        pa.array([list(v.items()) if isinstance(v, dict) else v for v in values], type=field.type)
        for values, field in zip(columns, arrow_schema)
    ]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow_schema), schema=schema)


def pin(df: DataFrame) -> DataFrame:
    """Run a small result once and keep its rows as a literal table.

    Only for results whose size the schema bounds (one row per table or per
    column). Later stages then read the rows from the plan, and losing an
    executor never repeats the scan behind them.
    """
    return df.sparkSession.createDataFrame(df.toArrow(), schema=df.schema)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder that every executor reaches, below spark.checkpoint.dir.

    Only a session in one process may do without the setting: it gets a temporary folder.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if base is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="gridscope-")
    return f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder in whatever file system it is; a session that was stopped deletes no more."""
    if spark.sparkContext._jsc is None:
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """A result that is too large for the driver, written once to the shared folder.

    Spark removes the files with its last reference.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_folder(df.sparkSession))
    return df.checkpoint()


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """A large table that several jobs read, as Parquet in a shared folder for as long as needed.

    Column pruning still works on it, and a lost executor costs no recomputation.
    """
    spark = df.sparkSession
    folder = scratch_folder(spark)
    try:
        df.write.parquet(folder)
        yield spark.read.schema(df.schema).parquet(folder)
    finally:
        remove_folder(spark, folder)
