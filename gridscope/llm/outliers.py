"""Robust multivariate outliers among documents: minimum-covariance-determinant estimates.

Each document gets a vector of transformed statistics. Per language and source, the centre
and scatter of the three quarters of the documents that lie closest together are estimated
(concentration steps from several starts, the smallest determinant wins, then one
reweighting), and documents far from it by Mahalanobis distance are rejected.

Statistics are whole numbers after a fixed scaling, and only their sums and sums of products
are gathered, so an estimate doesn't depend on the order of rows. A step is one aggregation:
documents are binned by distance, and a group's bins up to three quarters of its documents
give the next estimate. No group is gathered in one task, however large.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridscope.llm.common import WORD, pieces, records, stored

#: Share of a group's documents that an estimate rests on.
CORE = 0.75
#: Documents that a group needs for an estimate of its own.
LEAST_DOCUMENTS = 50
#: Beyond this share of the chi-square law a document is rejected.
REJECTED_BEYOND = 0.999
REWEIGHTED_WITHIN = 0.975
STARTS = 5
START_DOCUMENTS = 20
STEPS_ALL, STEPS_BEST = 2, 6
SCALE = 1024
#: Standard deviations that a statistic has at least: word length, symbols, equal lines, repeats.
LEAST_DEVIATION = (0.06, 0.7, 0.06, 0.06)
BINS_PER_OCTAVE = 32
#: Up to so many groups their estimates are sent to every task (about 200 bytes each).
BROADCAST_GROUPS = 10_000
SYMBOLS = "#*$%&|<>"
_P = len(LEAST_DEVIATION)
_PAIRS = [(i, j) for i in range(_P) for j in range(i, _P)]
_SUMS = [*(f"s{i}" for i in range(_P)), *(f"s{i}{j}" for i, j in _PAIRS)]
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_BLANK = " \t\n\x0b\x0c\r"


def chi_square_share(x: float, freedom: int) -> float:
    """Chi-square distribution function for an even number of degrees of freedom."""
    half = x / 2
    return 1 - math.exp(-half) * sum(half**k / math.factorial(k) for k in range(freedom // 2))


def chi_square_value(share: float, freedom: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_share(middle, freedom) < share else (low, middle)
    return low


def consistency(share: float) -> float:
    """What the scatter of the closest share of a normal sample has to be multiplied by."""
    return share / chi_square_share(chi_square_value(share, _P), _P + 2)


def repeated_words(texts: list[list[str]], width: int = 5) -> np.ndarray:
    """Words of each text that lie in a window of `width` words that its text has twice or more."""
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = list(chain.from_iterable(texts))
    n = len(flat)
    out = np.zeros(len(texts), np.int64)
    if n < width:
        return out
    names: dict[str, int] = {}
    codes = np.fromiter(map(names.setdefault, flat, range(n)), np.int64, n)
    # Windows of 1, 2, 3, ... words, numbered anew each time: equal numbers, equal words.
    window = codes
    for k in range(1, width):
        window = pd.factorize(window[:-1] * n + codes[k:])[0]
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = owner[: n - width + 1] == owner[width - 1 :]
    starts = np.flatnonzero(inside)
    if not len(starts):
        return out
    kinds = pd.factorize(owner[starts] * n + window[starts])[0]
    again = starts[np.bincount(kinds)[kinds] > 1]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + width, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(owner[covered], minlength=len(texts))


def text_statistics(docs: DataFrame, keys: list[Column], key_schema: str, text_column: str = "text") -> DataFrame:
    """The key columns (longs or strings), and n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words and n_lines of each whole text; a null text has none."""
    names = [part.split(" ")[0] for part in key_schema.split(", ")]
    arrow = {name: pa.int64() if part.endswith(" long") else pa.string() for name, part in zip(names, key_schema.split(", "))}
    kinds = arrow | dict.fromkeys(_COUNTS, pa.int64())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(WORD).findall
        for some in pieces(batches):
            words = [find(text) for *_, text in some]
            out = []
            for (*key, text), own, again in zip(some, words, repeated_words(words).tolist()):
                lines = [line for line in text.split("\n") if line.strip(_BLANK)]
                symbols = sum(map(text.count, SYMBOLS))
                out.append((*key, len(own), sum(map(len, own)), symbols, len(lines) - len(set(lines)), again, len(lines)))
            yield records(kinds, list(zip(*out)))

    rows = docs.select(*(k.alias(n) for k, n in zip(keys, names)), F.col(text_column).alias("_text"))
    return rows.mapInArrow(count, f"{key_schema}, " + ", ".join(f"{c} long" for c in _COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _vector() -> list[Column]:
    """The transformed statistics, scaled to whole numbers; short texts lean to the usual."""
    n, chars, lines = F.col("n_words"), F.col("word_chars"), F.col("n_lines")
    values = (
        F.log((chars + 250) / (n + 50)),
        F.log1p(1000 * F.col("n_symbols") / (chars + 100)),
        F.col("n_dup_lines") / (lines + 5),
        F.col("n_repeat_words") / (n + 20),
    )
    return [F.round(v * SCALE).cast("long").alias(f"x{i}") for i, v in enumerate(values)]


def _estimates(sums: DataFrame, share: float) -> DataFrame:
    """(group, start, n, centre, inverse, log_det) from sums of the vectors."""
    factor, least = consistency(share) if share < 1 else 1.0, np.diag(np.square(LEAST_DEVIATION))

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            n = part["n"].to_numpy(np.float64)
            centre = part[_SUMS[:_P]].to_numpy(np.float64) / n[:, None] / SCALE
            scatter = np.zeros((len(part), _P, _P))
            for i, j in _PAIRS:
                # Whole-number sums are exact; the division comes last.
                scatter[:, i, j] = scatter[:, j, i] = part[f"s{i}{j}"].to_numpy(np.float64) / n / SCALE**2 - centre[:, i] * centre[:, j]
            scatter = scatter * factor + least
            inverse = np.linalg.inv(scatter)
            flat = np.stack([inverse[:, i, j] * (1 if i == j else 2) for i, j in _PAIRS], axis=1)
            yield pd.DataFrame(
                {"group": part["group"], "start": part["start"], "centre": list(centre), "inverse": list(flat), "log_det": np.linalg.slogdet(scatter)[1]}
            )

    return sums.mapInPandas(solve, "group string, start int, centre array<double>, inverse array<double>, log_det double")


def _totals() -> list[Column]:
    x = [F.col(f"x{i}") for i in range(_P)]
    return [F.count(F.lit(1)).alias("n"), *(F.sum(x[i]).alias(f"s{i}") for i in range(_P)), *(F.sum(x[i] * x[j]).alias(f"s{i}{j}") for i, j in _PAIRS)]


def _with_distance(rows: DataFrame, estimates: DataFrame, small: bool, how: str = "inner") -> DataFrame:
    """Rows by the estimates of their group, with the squared Mahalanobis distance."""
    joined = rows.join(F.broadcast(estimates) if small else estimates, "group", how)
    away = [F.col(f"x{i}") / SCALE - F.col("centre")[i] for i in range(_P)]
    terms = [F.col("inverse")[k] * away[i] * away[j] for k, (i, j) in enumerate(_PAIRS)]
    return joined.withColumn("distance", sum(terms[1:], terms[0])).drop("centre", "inverse")


def _concentrated(rows: DataFrame, estimates: DataFrame, small: bool) -> DataFrame:
    """One concentration step of all groups and starts."""
    bin_ = F.floor(F.log2(F.greatest("distance", F.lit(2.0**-30))) * BINS_PER_OCTAVE).cast("int").alias("bin")
    binned = _with_distance(rows, estimates, small).groupBy("group", "start", bin_).agg(*_totals())
    line = Window.partitionBy("group", "start")
    before = F.sum("n").over(line.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    binned = binned.withColumn("_before", before).withColumn("_all", F.sum("n").over(line))
    core = binned.filter(F.col("_before") < CORE * F.col("_all"))
    return _estimates(core.groupBy("group", "start").agg(F.sum("n").alias("n"), *(F.sum(s).alias(s) for s in _SUMS)), CORE)


def robust_estimates(rows: DataFrame, small: bool) -> DataFrame:
    """(group, centre, inverse) of rows (group, pick, x0, ...): the reweighted estimates.

    Starts are the whole group and disjoint hash-chosen sets of about START_DOCUMENTS;
    every step after that goes over all rows.
    """
    sizes = rows.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
    dealt = rows.join(F.broadcast(sizes) if small else sizes, "group")
    deal = F.pmod("pick", F.ceil(F.col("size") / START_DOCUMENTS)).cast("int")
    starts = F.explode(F.array_compact(F.array(F.lit(0), F.when(deal < STARTS - 1, deal + 1)))).alias("start")
    now = stored(_estimates(dealt.select("*", starts).groupBy("group", "start").agg(*_totals()), 1.0))
    for step in range(STEPS_ALL + STEPS_BEST):
        if step == STEPS_ALL:
            now = now.groupBy("group").agg(F.min_by(F.struct("start", "centre", "inverse", "log_det"), F.struct("log_det", "start")).alias("best")).select("group", "best.*")
        now = stored(_concentrated(rows, now, small))
    near = _with_distance(rows, now, small).filter(F.col("distance") <= chi_square_value(REWEIGHTED_WITHIN, _P))
    return stored(_estimates(near.groupBy("group", "start").agg(*_totals()), REWEIGHTED_WITHIN))


def outlier_verdicts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", source_column: str = "source") -> DataFrame:
    """Per row: doc_id, row_key, the base statistics, base_failed, kept and distance.

    Rows that fail the base rules have no distance and don't enter the estimates. A language
    and source with fewer than LEAST_DOCUMENTS such rows is pooled with the other small ones
    of its language, then with all that are left; if those are still too few, they have no
    estimate and stay. Null language and source are values like others; a null text has no
    words and fails. row_key is a hash of id, text, language and source, equal for equal rows.
    """
    key = F.xxhash64(id_column, text_column, lang_column, source_column)
    keys = [F.col(id_column).cast("long"), key, F.col(lang_column), F.col(source_column)]
    counted = text_statistics(docs, keys, "doc_id long, row_key long, lang string, source string", text_column)
    rows = counted.withColumn("base_failed", base_failed())
    # Keys that are never null and don't run into each other.
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.base64(F.encode(c, "utf-8"))), F.lit(""))
    rows = stored(rows.select("doc_id", "row_key", part("lang").alias("_lang"), part("source").alias("_source"), *_COUNTS, "base_failed"))
    good = rows.filter("NOT base_failed")
    sizes = good.groupBy("_lang", "_source").agg(F.count(F.lit(1)).alias("n")).withColumn("own", F.col("n") >= LEAST_DOCUMENTS)
    rest = F.sum(F.when(~F.col("own"), F.col("n")))
    by_lang = sizes.groupBy("_lang").agg(rest.alias("rest"))
    group = (
        F.when(F.col("own"), F.concat_ws(" ", F.lit("source"), "_lang", "_source"))
        .when(F.col("rest") >= LEAST_DOCUMENTS, F.concat_ws(" ", F.lit("language"), "_lang"))
        .otherwise("all")
    )
    named = stored(sizes.join(by_lang, "_lang").select("_lang", "_source", "n", group.alias("group")))
    facts = named.agg(F.count(F.lit(1)).alias("groups"), F.sum(F.when(F.col("group") == "all", F.col("n"))).alias("left")).first()
    small = facts["groups"] <= BROADCAST_GROUPS
    few = (facts["left"] or 0) < LEAST_DOCUMENTS
    named = named.select("_lang", "_source", "group")
    named = F.broadcast(named) if small else named
    vectors = stored(good.join(named, ["_lang", "_source"]).select("group", F.xxhash64("row_key").alias("pick"), "doc_id", "row_key", *_COUNTS, *_vector()))
    usable = vectors.filter("group != 'all'") if few else vectors
    estimates = robust_estimates(usable.select("group", "pick", *(f"x{i}" for i in range(_P))), small)
    judged = _with_distance(vectors, estimates.drop("start", "log_det"), small, "left")
    far = F.coalesce(F.col("distance") > chi_square_value(REJECTED_BEYOND, _P), F.lit(False))
    out = ["doc_id", "row_key", *_COUNTS]
    judged = judged.select(*out, F.lit(False).alias("base_failed"), (~far).alias("kept"), "distance")
    failed = rows.filter("base_failed").select(*out, "base_failed", F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"))
    return judged.unionByName(failed)


def without_outliers(docs: DataFrame) -> DataFrame:
    """The documents (doc_id, text, lang, source and others) that are kept, unchanged.

    Whatever other names docs has, their values come back as they were; equal rows stay or go
    together. Odd rows are those of outlier_verdicts.
    """
    key = F.xxhash64("doc_id", "text", "lang", "source").alias("key")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key)
    rejected = outlier_verdicts(docs).filter("NOT kept").select(F.col("doc_id").alias("id"), F.col("row_key").alias("key")).distinct()
    same = (rows["key"] == rejected["key"]) & F.col("row.doc_id").cast("long").eqNullSafe(rejected["id"])
    return rows.join(rejected, same, "left_anti").select("row.*")
