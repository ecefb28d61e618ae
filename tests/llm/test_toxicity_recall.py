"""The recall of held-out toxic documents that the README states."""

from gridscope.llm.queries import op6_nearest_toxic

DATA = "/root/testdata/sf0.01"


def test_held_out_recall(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").filter("toxic = 1")
    held = op6_nearest_toxic(spark, DATA).filter("held_out").join(labels, "doc_id").select("predicted").collect()
    assert len(held) == 6 and sum(r["predicted"] for r in held) >= 4
