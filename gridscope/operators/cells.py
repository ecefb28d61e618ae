"""Predictions of a forest, one per cell that its cuts make instead of one per row.

Rows on the same side of every cut have the same prediction, however many trees look at them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridscope.functions.tables import kept, remove_folder, scratch_folder
from gridscope.operators.boosting import Bins, _find_package

#: Rows per cell from which cells are worth a join.
ROWS_PER_CELL = 4
#: Cuts of all features up to which rows are coded; there are at most 31 per feature.
MOST_CUTS = 100_000


def forest_cuts(forest, features: int) -> list[list[float]]:
    """The cuts of all trees per feature: rows up to a cut go left."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    folder = scratch_folder(spark)
    try:
        forest.write().save(folder)
        nodes = spark.read.parquet(f"{folder}/data").select("nodeData.split.*").filter("featureIndex >= 0")
        # A split of a number is its threshold; of a category, as which Spark takes one-hot
        # slots, the categories that go left: each value of it is a cell of its own.
        threshold, last = F.col("leftCategoriesOrThreshold")[0], F.col("numCategories") - 1
        cut = F.when(F.col("numCategories") < 0, F.array(threshold)).otherwise(F.sequence(F.lit(0), last).cast("array<double>"))
        found = nodes.select("featureIndex", F.explode(cut).alias("cut")).distinct().limit(MOST_CUTS + 1).collect()
    finally:
        remove_folder(spark, folder)
    if len(found) > MOST_CUTS:
        return []
    cuts: list[list[float]] = [[] for _ in range(features)]
    for row in found:
        cuts[row["featureIndex"]].append(row["cut"])
    return [sorted(c) for c in cuts]


def predicted_by_cells(forest, rows: DataFrame, vector: str, others: list[str], outputs: list[str]) -> Iterator[DataFrame]:
    """The columns `others` of rows with the forest's `outputs`; yielded once, files are removed after.

    Rows are coded by the cuts, the distinct codes are predicted, and joined to the rows. Where
    most rows have a cell of their own, rows are predicted as they are.
    """
    features, spark = forest.numFeatures, rows.sparkSession
    _find_package(spark)
    cuts = forest_cuts(forest, features)
    used = [f for f, c in enumerate(cuts) if c]
    if not used:
        yield forest.transform(rows).select(*others, *outputs)
        return
    bins = Bins([cuts[f] for f in used], [0] * len(used))
    kind = bins.codes(np.empty((0, len(used)))).dtype
    names = ["_cell", *(f"_other{i}" for i in range(len(others)))]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.asarray(batch.column(0).flatten(), np.float64).reshape(batch.num_rows, len(used))
            codes = np.ascontiguousarray(bins.codes(flat).T)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.dtype.itemsize * len(used)), len(codes), [None, pa.py_buffer(codes)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([packed, *batch.columns[1:]], names=names)

    # A value of each cell: the cut it ends at, or anything above the last.
    ends = [np.append(c, np.inf) for c in bins.cuts]

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column(0).to_pylist()), kind).reshape(batch.num_rows, len(used))
            out = np.zeros((batch.num_rows, features))
            for at, f in enumerate(used):
                out[:, f] = ends[at][codes[:, at]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(out), pa.list_(pa.float64()))], names=["_cell", "_values"])

    whole = vector_to_array(vector)
    told = rows.select(F.array(*[whole[f] for f in used]).alias("_cell"), *[F.col(c).alias(n) for c, n in zip(others, names[1:])])
    schema = ", ".join(["_cell binary", *(f"{n} {rows.schema[c].dataType.simpleString()}" for c, n in zip(others, names[1:]))])
    with kept(told.mapInArrow(coded, schema)) as told:
        total = told.count()
        with kept(told.select("_cell").distinct()) as cells:
            if cells.count() * ROWS_PER_CELL > total:
                yield forest.transform(rows).select(*others, *outputs)
                return
            # Cells are few and short, and hundreds of trees look at each.
            cells = cells.repartition(max(1, spark.sparkContext.defaultParallelism))
            found = forest.transform(cells.mapInArrow(values, "_cell binary, _values array<double>").withColumn(vector, array_to_vector("_values")))
            with kept(found.select("_cell", *outputs)) as found:
                yield told.join(found, "_cell").select(*[F.col(n).alias(c) for c, n in zip(others, names[1:])], *outputs)
