"""Target statistics of categories, learned in an order so that no row sees its own label.

A category stands for the mean label of its rows, drawn towards the mean of all. For a
training row only the rows of earlier hash buckets count; for others, all training rows do.
The statistics are a table of (feature, value), joined to the rows and saved as Parquet with
the model, so any number of categories is no matter of the driver.
"""

from __future__ import annotations

import weakref

from pyspark.ml import Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridscope.functions.tables import remove_folder, scratch_folder
from gridscope.operators.boosting import Scale

#: Steps of the order: a row learns from about all but a 64th of the rows before it.
BUCKETS = 64
#: Rows of the mean of all that every statistic begins with.
PRIOR_ROWS = 1.0


class _Writer(MLWriter):
    def __init__(self, instance: TargetStatisticsModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.table.write.parquet(f"{path}/statistics")


class _Reader(MLReader):
    def load(self, path: str) -> TargetStatisticsModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = TargetStatisticsModel([], [], self.sparkSession.read.parquet(f"{path}/statistics"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class TargetStatisticsModel(Model, MLWritable, MLReadable):
    """Adds the columns `__stat_<category>_<output>` to rows with the categories' columns.

    table: (feature, value, statistics array<double>). Values it lacks, and missing ones, have
    the mean of all.
    """

    inputCols = Param(Params._dummy(), "inputCols", "columns of categories", TypeConverters.toListString)
    prior = Param(Params._dummy(), "prior", "means of all rows", TypeConverters.toListFloat)

    def __init__(self, inputCols: list[str], prior: list[float], table: DataFrame):
        super().__init__()
        self._set(inputCols=inputCols, prior=prior)
        self.table = table

    @property
    def outputCols(self) -> list[str]:
        outputs = len(self.getOrDefault(self.prior))
        return [f"__stat_{i}_{k}" for i in range(len(self.getOrDefault(self.inputCols))) for k in range(outputs)]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        prior, found = self.getOrDefault(self.prior), dataset
        for i, name in enumerate(self.getOrDefault(self.inputCols)):
            own = self.table.where(F.col("feature") == i).select(F.col("value").alias(f"__value_{i}"), F.col("statistics").alias(f"__all_{i}"))
            found = found.join(own, F.col(name) == F.col(f"__value_{i}"), "left").drop(f"__value_{i}")
            found = found.withColumns({f"__stat_{i}_{k}": F.coalesce(F.col(f"__all_{i}")[k], F.lit(p)) for k, p in enumerate(prior)}).drop(f"__all_{i}")
        return found

    def write(self) -> _Writer:
        return _Writer(self)

    @classmethod
    def read(cls) -> _Reader:
        return _Reader()


def order_bucket(*columns: Column) -> Column:
    """The step of the order that a row is in, from a hash of the columns."""
    return F.pmod(F.xxhash64(F.lit("order"), *columns), F.lit(BUCKETS)).cast("int")


def fit_target_statistics(train: DataFrame, inputs: list[str], label: str, classes: int, bucket: str) -> tuple[TargetStatisticsModel, DataFrame]:
    """The model of all training rows, and the rows with the statistics of those before them.

    classes: 0 for a number as label, else the number of classes; more than two have one
    statistic each. One grouped aggregate counts (feature, value, bucket); a value's buckets
    are added up, and rows are joined by value and bucket, so a frequent value is dealt out
    over BUCKETS keys. Labels are added as whole numbers: no order of rows matters.
    """
    spark = train.sparkSession
    if classes:
        outputs = [(F.col(label) == k).cast("long") for k in (range(classes) if classes > 2 else (1,))]
        scale, low = 1.0, 0.0
    else:
        told = train.agg(F.count(F.lit(1)).alias("n"), F.min(label).alias("low"), F.max(label).alias("high")).first()
        low = told["low"]
        scale = Scale.of(told["n"], told["high"] - low, 0).first
        outputs = [F.round((F.col(label) - F.lit(low)) * scale).cast("long")]
    sums = [f"s{k}" for k in range(len(outputs))]
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(c).alias("value")) for i, c in enumerate(inputs)])).alias("of")
    said = train.select(F.col(bucket).alias("bucket"), values, *[o.alias(s) for o, s in zip(outputs, sums)])
    counted = said.groupBy("of.feature", "of.value", "bucket").agg(F.count(F.lit(1)).alias("n"), *[F.sum(s).alias(s) for s in sums])
    all_ = train.agg(F.count(F.lit(1)).alias("n"), *[F.sum(o).alias(s) for o, s in zip(outputs, sums)]).first()
    prior = [low + all_[s] / scale / all_["n"] for s in sums]

    def statistic(n: Column, total: list[Column]) -> Column:
        return F.array(*[(F.lit(low) * n + t / F.lit(scale) + F.lit(p * PRIOR_ROWS)) / (n + PRIOR_ROWS) for t, p in zip(total, prior)])

    earlier = Window.partitionBy("feature", "value").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    folder = scratch_folder(spark)
    before = [F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("n", *sums)]
    counted.select("feature", "value", "bucket", "n", *sums, *before).write.parquet(f"{folder}/counts")
    counted = spark.read.parquet(f"{folder}/counts")
    whole = counted.groupBy("feature", "value").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in sums])
    whole.select("feature", "value", statistic(F.col("n"), [F.col(s) for s in sums]).alias("statistics")).write.parquet(f"{folder}/all")
    model = TargetStatisticsModel(inputs, prior, spark.read.parquet(f"{folder}/all"))
    weakref.finalize(model, remove_folder, spark, folder)
    rows = train
    ordered = counted.select("feature", F.col("value").alias("__value"), F.col("bucket").alias("__step"), statistic(F.col("n_before"), [F.col(f"{s}_before") for s in sums]).alias("__before"))
    for i, name in enumerate(inputs):
        own = ordered.where(F.col("feature") == i).drop("feature")
        rows = rows.join(own, (F.col(name) == F.col("__value")) & (F.col(bucket) == F.col("__step")))
        rows = rows.withColumns({f"__stat_{i}_{k}": F.col("__before")[k] for k in range(len(outputs))}).drop("__value", "__step", "__before")
    return model, rows
