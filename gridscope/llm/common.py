"""What the operators share: reading tables, storing intermediate tables, walking through texts."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: a word is a run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Characters of text that a Python task works on at once; a longer text is one piece by itself.
PIECE_CHARS = 2_000_000


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A given table. Python workers find this package even if the driver runs elsewhere."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors reach, from spark.checkpoint.dir.

    Only a session in one process may do without the setting: it gets a temporary folder.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if folder is None and context.getCheckpointDir() is not None:
        folder = os.path.dirname(context.getCheckpointDir())
    if folder is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="gridscope-llm-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Written once to the shared folder, so no later job or lost executor computes it again.

    Spark removes the files with the table's last reference
    (spark.cleaner.referenceTracking.cleanCheckpoints).
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def row_keys(docs: DataFrame) -> list[Column]:
    """Two hashes of all columns, 128 bits, equal for equal rows; maps count by their JSON text."""
    values = [
        F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString() else F.col(f"`{f.name}`")
        for f in docs.schema
    ]
    # An array and a number in front keep null columns from standing for one another.
    nulls = F.array(*(v.isNull() for v in values))
    return [F.xxhash64(F.lit(seed), nulls, *values) for seed in (1, 2)]


def wrapped(docs: DataFrame) -> DataFrame:
    """Columns row (all columns of docs), key_1 and key_2: no name of docs can clash with a further one."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return docs.select(row.alias("row"), *(k.alias(f"key_{n}") for n, k in enumerate(row_keys(docs), 1)))


def free_name(docs: DataFrame, name: str) -> str:
    """The name, with underscores behind it until no column of docs has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def texts_of(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The two columns an operator works on, as doc_id and text; other columns don't matter."""
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))


def fold_of(column: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % 5


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def edges(df: DataFrame, column: str, parts: int) -> list:
    """Up to parts - 1 values of the column, ascending, that cut it into even ranges.

    Every edge is a value that occurs. The driver gets one value per partition.
    """
    if parts < 2:
        return []
    fractions = [k / parts for k in range(1, parts)]
    row = df.agg(F.percentile_approx(column, F.array(*map(F.lit, fractions)), F.lit(50 * parts)).alias("edges")).first()
    return sorted(set(row["edges"] or []))


def range_of(column: Column, cuts: list, ascending: bool = True) -> Column:
    """The range a value falls in: 0 for the first; nulls in the first (ascending) or last."""
    if not cuts:
        return F.lit(0)
    # Descending, a range begins with its cut, as ascending.
    passed = F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut <= column if ascending else column <= cut)
    return F.when(column.isNull(), F.lit(0 if ascending else len(cuts))).otherwise(F.size(passed))


def pieces(batches: Iterator[pa.RecordBatch], limit: int = PIECE_CHARS) -> Iterator[list[tuple]]:
    """Rows of Arrow batches as tuples, in lists whose texts (the last column) add up to about limit.

    The last column must be text; null becomes empty.
    """
    rows, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for row in zip(*(c.to_pylist() for c in part.columns)):
                text = row[-1] or ""
                rows.append((*row[:-1], text))
                size += len(text)
                if size >= limit:
                    yield rows
                    rows, size = [], 0
    if rows:
        yield rows


def records(names_types: dict[str, pa.DataType], columns: list) -> pa.RecordBatch:
    """An Arrow batch from columns in the order of the names."""
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=t) for c, t in zip(columns, names_types.values())], names=list(names_types)
    )
