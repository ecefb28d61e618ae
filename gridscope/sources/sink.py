"""Writing result tables."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame


def write_results(
    tables: dict[str, DataFrame],
    folder: str,
    run_id: str,
    format: str = "parquet",
    mode: str = "overwrite",
) -> tuple[list[str], list[str]]:
    """Write each result table to `name/run_id=...`; returns the tables' paths and warnings.

    Writing a run again replaces all it wrote before, with an empty table too, and leaves
    other runs alone. An empty table is one file with its schema, so it can be read.
    A failed write becomes a warning, so results stay usable without their files.
    """
    paths, warnings = [], []
    for name, table in tables.items():
        path = f"{folder.rstrip('/')}/{name}"
        try:
            # A range of no rows may have no partition, and then no file with a schema.
            if table.isEmpty():
                table = table.limit(0).repartition(1)
            # The folder name carries the run id.
            table.drop("run_id").write.mode(mode).format(format).save(f"{path}/run_id={run_id}")
            paths.append(path)
        except (PySparkException, OSError, ValueError) as error:
            warnings.append(f"{name} could not be written: {error}")
    return paths, warnings
