"""The test tables: declared columns, and the inputs the queries share."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

# Column names and Spark types of the given tables.
COLUMNS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
# Documents with their labels; most documents have none, so cells are missing.
COLUMNS["doclab"] = COLUMNS["documents"] + ", quality int, toxic int"
# Only the two label columns: most rows are missing altogether.
COLUMNS["doclab_labels"] = "quality int, toxic int"
# Lines with a band of their quantity and a size that mostly follows from it.
COLUMNS["banded"] = (
    "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, band string, size string"
)

# Events with a boolean, a constant and an empty column.
COLUMNS["flagged"] = "event_id bigint, event_type string, is_large boolean, fixed string, nothing double"
# Tables that validation rejects: only missing cells, a single row, no row.
COLUMNS["hollow"] = "a int, b string"
COLUMNS["single"] = "n bigint, m string"
COLUMNS["vacant"] = COLUMNS["customer"]

# Derived tables: the SQL, which Spark and DuckDB both understand.
SOURCES = {
    "doclab": "SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)",
    "doclab_labels": "SELECT l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)",
    "banded": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
    "concat('b', CAST(CAST(floor(l_quantity / 10) AS INT) AS VARCHAR(9))) AS band, "
    "CASE WHEN l_quantity + 20 * l_discount > 30 THEN 'high' ELSE 'low' END AS size FROM lineitem",
    "flagged": "SELECT event_id, event_type, value > 50 AS is_large, 'x' AS fixed, "
    "CAST(NULL AS DOUBLE) AS nothing FROM events",
    "hollow": "SELECT CAST(NULL AS INT) AS a, CAST(NULL AS VARCHAR(9)) AS b FROM events",
    "single": "SELECT count(*) AS n, max(event_type) AS m FROM events",
    "vacant": "SELECT * FROM customer WHERE c_acctbal < -1e30",
}
# The given tables that each of them reads.
INPUTS = {
    "doclab": ("documents", "labels"), "doclab_labels": ("documents", "labels"), "banded": ("lineitem",),
    "flagged": ("events",), "hollow": ("events",), "single": ("events",), "vacant": ("customer",),
}


def columns(table: str) -> list[tuple[str, str]]:
    return [tuple(part.strip().split(" ")) for part in COLUMNS[table].split(",")]


def source_sql(table: str) -> str:
    return SOURCES.get(table, f"SELECT * FROM {table}")


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    if table in SOURCES:
        given = {name: load(spark, folder, name) for name in INPUTS[table]}
        sql = SOURCES[table]
        for name in given:
            sql = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", sql)
        return spark.sql(sql, **given)
    return spark.read.parquet(os.path.join(folder, f"{table}.parquet"))
