import os

import pytest

from gridscope.sources.reader import (
    DuplicateColumns,
    LoadError,
    TableNotFound,
    UnsupportedFormat,
    preview_rows,
    read_table,
    source_facts,
)
from gridscope.sources.sink import write_results


def write(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as out:
        out.write(text)
    return path


def test_csv(spark, folder):
    df = read_table(spark, write(folder, "a.csv", "age,income\n20,100\n30,200\n40,300\n"))
    assert df.dtypes == [("age", "bigint"), ("income", "bigint")]
    assert sorted(map(tuple, df.collect())) == [(20, 100), (30, 200), (40, 300)]


def test_tsv(spark, folder):
    df = read_table(spark, write(folder, "a.tsv", "city\tsales\nOslo\t1\nRome, IT\t2\n"))
    assert df.dtypes == [("city", "string"), ("sales", "bigint")]
    assert {r.city for r in df.collect()} == {"Oslo", "Rome, IT"}


def test_parquet_file_and_folder(spark, folder, frame):
    path = os.path.join(folder, "a.parquet")
    frame("score double, label int", (0.5, 1), (0.25, 0), (1.0, 1)).repartition(2).write.parquet(path)
    df = read_table(spark, path)
    assert df.count() == 3 and df.columns == ["score", "label"]


@pytest.mark.parametrize(
    "name, header, repeated",
    [
        ("a.csv", "age,age,income", ["age"]),
        ("a.tsv", "name\tname\tlabel", ["name"]),
        ("b.csv", "a,b,a,a,c", ["a"]),
        ("c.csv", " age , income , age ", ["age"]),
    ],
)
def test_repeated_header(spark, folder, name, header, repeated):
    path = write(folder, name, header + "\n" + header.replace("a", "1") + "\n")
    with pytest.raises(DuplicateColumns) as caught:
        read_table(spark, path)
    assert caught.value.names == repeated


def test_load_errors_are_distinct(spark, folder):
    with pytest.raises(TableNotFound):
        read_table(spark, os.path.join(folder, "none.csv"))
    with pytest.raises(FileNotFoundError):
        read_table(spark, os.path.join(folder, "none.parquet"))
    with pytest.raises(UnsupportedFormat):
        read_table(spark, write(folder, "a.txt", "a\n1\n"))
    with pytest.raises(LoadError):
        read_table(spark, write(folder, "bad.parquet", "no parquet"))
    with pytest.raises(LoadError):
        read_table(spark, write(folder, "empty.csv", ""))


def test_null_tokens_and_types(spark, folder):
    path = write(
        folder, "a.csv",
        "num,whole,text,day,flag,mixed,none\n"
        "1.5,1,x,2024-01-01,True,1,NA\n"
        "NA,null,,2024-01-02,False,x,\n"
        "\n"
        "3e2,3,NULL,2024-01-03,,2,nan\n",
    )
    df = read_table(spark, path)
    assert [t for _, t in df.dtypes] == [
        "double", "bigint", "string", "string", "boolean", "string", "double",
    ]
    rows = df.collect()
    assert len(rows) == 3
    missing = {c: sum(r[c] is None for r in rows) for c in df.columns}
    assert missing == {"num": 1, "whole": 1, "text": 2, "day": 0, "flag": 1, "mixed": 0, "none": 3}
    assert dict(read_table(spark, path, infer_dates=True).dtypes)["day"] == "timestamp_ntz"


def test_booleans_are_not_guessed_from_digits(spark, folder):
    df = read_table(spark, write(folder, "a.csv", "a,b,c\n1,t,yes\n0,f,no\n"))
    assert [t for _, t in df.dtypes] == ["bigint", "string", "string"]


def test_quoted_line_breaks(spark, folder):
    text = 'id,text\n1,"one\ntwo"\n2,"say ""hi"", please"\n'
    rows = read_table(spark, write(folder, "a.csv", text)).collect()
    assert sorted(map(tuple, rows)) == [(1, "one\ntwo"), (2, 'say "hi", please')]


def test_too_many_fields(spark, folder):
    with pytest.raises(LoadError):
        read_table(spark, write(folder, "a.csv", "a,b\n1,2\n1,2,3\n"))


def test_names_that_differ_by_case(spark, folder):
    path = write(folder, "a.csv", "Age,age\n1,2\n")
    with pytest.raises(LoadError):
        read_table(spark, path)
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        assert read_table(spark, path).columns == ["Age", "age"]
    finally:
        spark.conf.set("spark.sql.caseSensitive", "false")


def test_byte_order_mark_and_odd_names(spark, folder):
    df = read_table(spark, write(folder, "a.csv", "﻿a.b,`c,\n1,2,3\n"))
    assert df.columns == ["a.b", "`c", "Unnamed: 2"]
    assert tuple(df.first()) == (1, 2, 3)


def test_source_facts_and_preview(spark, frame):
    df = frame("b string, x double", ("q", 2.0), ("p", float("nan")), ("r", 1.0))
    row = source_facts(df, "/some/where/File.CSV").first()
    assert tuple(row) == ("File.CSV", ".csv", 3, 2, ["b", "x"])
    lines = [r.row_json for r in preview_rows(df, 2).orderBy("seq").collect()]
    assert lines == ['{"b":"p","x":null}', '{"b":"q","x":2.0}']
    assert preview_rows(df, 0).count() == 0


def test_write_results(spark, folder, frame):
    tables = {"one": frame("a int", 1, 2), "two": frame("b string", "x")}
    paths, warnings = write_results(tables, folder, "r1")
    write_results(tables, folder, "r2")
    write_results(tables, folder, "r2")
    assert not warnings and len(paths) == 2
    back = spark.read.parquet(os.path.join(folder, "one"))
    assert back.groupBy("run_id").count().count() == 2 and back.count() == 4
    _, warnings = write_results({"one": tables["one"]}, folder, "r1", mode="error")
    assert len(warnings) == 1
