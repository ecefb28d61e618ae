"""Stages leave columns of any name as they were, whatever names they work with themselves."""

import pytest
from pyspark.sql import functions as F

from corpus_pipeline import STAGES

from ..conftest import DATA

NAMES = (
    "toxicity", "_row", "_id", "_key", "size", "target", "taken", "segments", "part", "row", "key", "key_1", "node", "some", "whole",
    "_source", "_order", "_keep", "group", "pick", "kept", "distance", "score", "evidence", "id", "first", "root",
)


@pytest.mark.parametrize("stage", STAGES[:4], ids=lambda s: s[0])
def test_values_come_back(spark, table, folder, stage):
    docs = table("documents").withColumns({n: F.concat(F.lit(f"{n} "), F.col("doc_id")) for n in NAMES})
    plain = sorted((tuple(r) for r in stage[1](spark, table("documents"), DATA).collect()), key=repr)
    found = stage[1](spark, docs, DATA)
    assert found.columns == docs.columns
    rows = [tuple(r) for r in found.collect()]
    width = len(docs.columns) - len(NAMES)
    assert sorted((r[:width] for r in rows), key=repr) == plain
    assert all(list(r[width:]) == [f"{n} {r[0]}" for n in NAMES] for r in rows)
