"""Each stage against plain Python on what the stage before it kept."""

from collections import Counter, defaultdict

import corpus_pipeline
from corpus_pipeline import STAGES, run

from ..conftest import DATA
from .test_mixing import WORD
from .test_outliers import plain_statistics
from .test_similar import plain_kept


def test_stages(spark, table, folder):
    docs, kept = table("documents"), []
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, DATA).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        kept.append(docs)
        if k < 4:
            assert docs.columns == table("documents").columns
    assert corpus_pipeline.ORACLE_SQL is None
    first = {r["doc_id"]: r for r in table("documents").collect()}
    clean, good, single = ({r["doc_id"]: r for r in d.collect()} for d in kept[:3])
    assert all(r == first[k] for part in (clean, good, single) for k, r in part.items())

    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in table("labels").collect()}
    not_toxic = [d for d, (_, t) in labels.items() if t == 0]
    assert sum(d in clean for d in not_toxic) >= 0.98 * len(not_toxic)
    assert sum(d in clean for d, (_, t) in labels.items() if t == 1) <= sum(t == 1 for _, t in labels.values())

    for d, r in clean.items():
        n, *_, again = plain_statistics(r["text"])
        if n < 10 or 100 * again > 20 * n:
            assert d not in good
    assert {d for d, (q, _) in labels.items() if q == 1 and d in clean and plain_statistics(clean[d]["text"])[0] >= 10} - set(good) == set()

    assert set(single) == plain_kept([(d, r["text"]) for d, r in good.items()])[0]

    mixed, size, taken = kept[3].collect(), defaultdict(int), defaultdict(int)
    for r in single.values():
        size[r["source"]] += len(WORD.findall(r["text"]))
    for r in mixed:
        taken[r["source"]] += len(WORD.findall(r["text"]))
        assert r["text"] in single[r["doc_id"]]["text"]
    assert abs(sum(taken.values()) - sum(size.values())) < 0.02 * sum(size.values())
    assert all(taken[s] <= 3 * size[s] for s in size)

    assert kept[4].agg({"length": "sum"}).first()[0] > 0
    whole = [r for r in mixed if Counter(m["doc_id"] for m in mixed)[r["doc_id"]] == 1]
    ids = {r["doc_id"] for r in whole}
    rows = [r for r in kept[4].collect()]
    sequences = {r["sequence_id"] for r in rows}
    assert len(sequences) <= 1 + 1.03 * sum(r["length"] for r in rows) / 2048
    pieces = defaultdict(list)
    for r in rows:
        if r["doc_id"] in ids:
            pieces[r["doc_id"]].append(r)
    assert set(pieces) == ids
    per_sequence = defaultdict(list)
    for r in rows:
        per_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in per_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def test_run(spark, table):
    rows = run(spark, DATA)
    assert {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(rows.columns)
    assert rows.count() > 0


def test_empty_tables(spark, table, folder):
    docs = table("documents").limit(0)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, DATA).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        assert docs.count() == 0


def test_python_workers_get_small_batches(spark, table):
    setting = corpus_pipeline.BATCH_SETTING
    before = spark.conf.get(setting)
    try:
        for given, want in (("10000", "1000"), ("0", "1000"), ("300", "300")):
            for _, stage in STAGES[1:]:
                spark.conf.set(setting, given)
                stage(spark, table("documents").limit(1), DATA)
                assert spark.conf.get(setting) == want
    finally:
        spark.conf.set(setting, before)


def test_shuffle_files_go_with_their_query(spark, table):
    setting = corpus_pipeline.CLEANUP_SETTING
    spark.conf.unset(setting)
    try:
        for _, stage in STAGES[1:]:
            stage(spark, table("documents").limit(1), DATA)
            assert spark.conf.get(setting) == "true"
            spark.conf.unset(setting)
        run(spark, DATA)
        assert spark.conf.get(setting, "false") == "false"
    finally:
        spark.conf.unset(setting)
