"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are all words of the labelled examples, and word beginnings that go with toxicity. A
term weighs its TF-IDF, times how far beyond chance it goes with toxic examples; terms that
don't keep a small share, so every example and every term is in the index. Each posting list
also has the largest weight in each block of examples, so a block whose bound can't reach
the k nearest found so far is never scored. The nearest examples vote with weights that fall
with their distance, and are the evidence for the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscope.llm.common import fold_of, free_name, pieces, records, stored, texts_of, wrapped

#: Labelled rows that are examples, the smallest hashes of their ids: the bound of everything
#: that is held in one place.
MOST_EXAMPLES = 2_000
#: Lengths of word beginnings that are terms if they go with toxicity.
BEGINNINGS = (3, 4, 5, 6, 7)
#: What a term weighs that goes with toxicity no more than chance among all terms would have it.
LEAST_WEIGHT = 0.1
NEIGHBOURS = 15
BLOCK = 64
#: Blocks that are scored first; then all at once whose bounds reach the nearest of these.
FIRST_BLOCKS = 4
#: Cosines are equal up to rounding.
EQUAL = 1e-9
#: Votes of the base rate, and what is added to a distance before it is inverted.
BASE_VOTES, SOFTENING = 1.0, 0.1
HELD_OUT_FOLD = 0
_FIND = re.compile(r"\w+").findall


def beginnings(word: str) -> list[str]:
    """Beginnings of a word, marked with a star."""
    return [f"{word[:n]}*" for n in BEGINNINGS if len(word) >= n]


class TermCounter:
    """Counts the known terms in texts: words by their number, and beginnings, marked with a star."""

    def __init__(self, terms: dict[str, int]):
        self.words = {t: k for t, k in terms.items() if not t.endswith("*")}
        #: Per length the beginnings, without their star, and the shortest parts of all of them.
        self.begun = [(n, {t[:-1]: k for t, k in terms.items() if t.endswith("*") and len(t) == n + 1}) for n in BEGINNINGS]
        self.begun = [(n, table) for n, table in self.begun if table]
        self.least = BEGINNINGS[0]
        self.starts = {t[: self.least] for _, table in self.begun for t in table}

    def _begun(self, words) -> Iterator[tuple[str, int]]:
        """(word, term) for all beginnings of the words that are terms."""
        starts, least = self.starts, self.least
        for word in [w for w in words if w[:least] in starts]:
            for n, table in self.begun:
                if len(word) >= n and word[:n] in table:
                    yield word, table[word[:n]]

    def present(self, text: str | None) -> set[int]:
        """The terms that occur."""
        words = set(_FIND((text or "").lower()))
        found = set(map(self.words.__getitem__, words & self.words.keys()))
        found.update(term for _, term in self._begun(words))
        return found

    def __call__(self, text: str | None) -> dict[int, int]:
        """The number of times each term occurs, ascending by term."""
        counts, number = Counter(_FIND((text or "").lower())), self.words
        hits = {number[w]: n for w, n in counts.items() if w in number}
        for word, term in self._begun(counts):
            hits[term] = hits.get(term, 0) + counts[word]
        return dict(sorted(hits.items()))


def weights(counts: dict[int, int], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms and values of a text: (1 + log tf) * weight, of length one."""
    terms = np.fromiter(counts.keys(), np.int64, len(counts))
    values = (1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))) * weight[terms]
    return terms, values / math.sqrt(float(values @ values)) if len(values) else values


def _spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begins[0], begins[0] + 1, ... sizes[0] times, then the same for the next."""
    ends = sizes.cumsum()
    out = (begins - ends + sizes).repeat(sizes)
    out += np.arange(len(out))
    return out


class BlockMaxIndex:
    """Posting lists by term with the largest weight of each block of examples."""

    def __init__(self, owner: np.ndarray, term: np.ndarray, weight: np.ndarray, examples: int, terms: int):
        """Postings (example, term, weight) in any order."""
        self.size = examples
        self.blocks = -(-examples // BLOCK)
        order = np.lexsort((owner, term))
        term = term[order]
        self.owner, self.weight = owner[order].astype(np.int32), weight[order]
        # Per term: its blocks, where each begins among its postings, and its largest weight.
        block = self.owner // BLOCK
        begins = np.flatnonzero(np.r_[True, (np.diff(block) != 0) | (np.diff(term) != 0)]) if len(block) else np.empty(0, np.int64)
        self.begin = np.append(begins, len(block)).astype(np.int32)
        self.block = block[begins].astype(np.int32)
        self.most = np.maximum.reduceat(self.weight, begins) if len(begins) else np.empty(0)
        self.first_block = np.searchsorted(begins, np.searchsorted(term, np.arange(terms + 1))).astype(np.int32)
        self.scored_blocks = 0

    def nearest(self, terms: np.ndarray, values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Examples and cosines of the k largest cosines above zero and all that equal the last; best first."""
        # take() gives what an index in brackets does, in less time.
        begins = self.first_block.take(terms)
        sizes = self.first_block.take(terms + 1) - begins
        at, value = _spread(begins, sizes), values.repeat(sizes)
        block = self.block.take(at)
        bound = np.bincount(block, value * self.most.take(at), self.blocks)
        line = np.argsort(-bound, kind="stable")
        line = line[bound[line] > 0]
        owners, cosines = [np.empty(0, np.int64)], [np.empty(0)]
        least, done, last = 0.0, 0, FIRST_BLOCKS
        while done < len(line) and bound[line[done]] >= least - EQUAL:
            wanted = np.zeros(self.blocks, bool)
            wanted[line[done:last]] = True
            on = wanted.take(block).nonzero()[0]
            entry = at.take(on)
            first = self.begin.take(entry)
            many = self.begin.take(entry + 1) - first
            posting = _spread(first, many)
            # An example's terms are added up in their order, however its block was reached.
            score = np.bincount(self.owner.take(posting), self.weight.take(posting) * value.take(on).repeat(many), self.size)
            found = score.nonzero()[0]
            owners.append(found)
            cosines.append(score[found])
            all_ = np.concatenate(cosines)
            least = float(np.partition(all_, -k)[-k]) if len(all_) >= k else 0.0
            done, last = min(last, len(line)), max(last, int(np.searchsorted(-bound[line], EQUAL - least, "right")))
        self.scored_blocks += done
        owner, cosine = np.concatenate(owners), np.concatenate(cosines)
        near = np.flatnonzero(cosine >= least - EQUAL)
        near = near[np.lexsort((owner[near], -cosine[near]))]
        return owner[near], cosine[near]


def association(clean: np.ndarray, toxic: np.ndarray, cleans: int, toxics: int) -> np.ndarray:
    """How many standard deviations beyond chance each term goes with toxic examples.

    clean, toxic: the examples of either kind that have the term. What the largest of so many
    chance deviations would be counts as chance.
    """
    if not len(clean) or not cleans or not toxics:
        return np.zeros(len(clean))
    share = (clean + toxic) / (cleans + toxics)
    deviation = np.sqrt(share * (1 - share) * (1 / cleans + 1 / toxics) + 1e-12)
    return np.maximum(0, (toxic / toxics - clean / cleans) / deviation - math.sqrt(2 * math.log(max(2, len(clean)))))


class ToxicityModel:
    """Terms, their weights, and the labelled examples under the index.

    Example i has the id ids[i], the label toxic[i], and sizes[i] of the terms and counts.
    """

    def __init__(
        self, names: dict[str, int], weight: np.ndarray,
        ids: np.ndarray, toxic: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray,
    ):
        self.names, self.weight = names, weight
        owner = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        value = (1 + np.log(counts)) * weight[terms]
        value /= np.sqrt(np.bincount(owner, value * value, len(ids)))[owner]
        # Examples with the same heaviest term stand together, so blocks have telling bounds.
        heaviest = np.full(len(ids), -1, np.int64)
        by_value = np.argsort(value, kind="stable")
        heaviest[owner[by_value]] = terms[by_value]
        order = np.argsort(heaviest, kind="stable")
        place = np.empty(len(ids), np.int32)
        place[order] = np.arange(len(ids), dtype=np.int32)
        self.ids, self.toxic = ids[order], toxic[order]
        self.index = BlockMaxIndex(place[owner], terms, value, len(ids), len(weight))
        # The share of toxic examples, and one half among two more.
        self.base = (int(self.toxic.sum()) + 0.5) / (len(ids) + 2)

    def score(self, counts: dict[int, int]) -> tuple[float, list[tuple[float, int]]]:
        """The score, and the nearest examples (cosine, number), NEIGHBOURS of them.

        All examples as near as the last of them vote.
        """
        if not counts:
            return self.base, []
        near, cosines = self.index.nearest(*weights(counts, self.weight), NEIGHBOURS)
        votes = 1 / (1 - np.minimum(cosines, 1.0) + SOFTENING)
        toxic = float(votes[self.toxic[near] > 0].sum())
        score = (toxic + BASE_VOTES * self.base) / (float(votes.sum()) + BASE_VOTES)
        return score, list(zip(cosines[:NEIGHBOURS].tolist(), near[:NEIGHBOURS].tolist()))


def labelled_examples(docs: DataFrame, labels: DataFrame, most_examples: int, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, toxic, text) of at most most_examples labelled rows outside the held-out fold, one per id.

    labels: (doc_id, toxic); null labels and ids are left out, several labels of an id count
    as their maximum. Of several texts of an id the smallest is taken.
    """
    given = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(fold_of(F.col("doc_id")) != HELD_OUT_FOLD)
    given = given.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_examples)
    # At most most_examples rows of two numbers.
    found = texts_of(docs, id_column, text_column).join(F.broadcast(chosen), "doc_id")
    return stored(found.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min(F.coalesce("text", F.lit(""))).alias("text")))


def fit_toxicity(docs: DataFrame, labels: DataFrame, most_examples: int = MOST_EXAMPLES, id_column: str = "doc_id", text_column: str = "text") -> ToxicityModel:
    """Learn from labelled examples, and count in how many of all texts their terms occur.

    Only the examples' terms and counts reach the driver.
    """
    spark = docs.sparkSession
    examples = labelled_examples(docs, labels, most_examples, id_column, text_column)

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in pieces(batches):
            found: tuple[Counter, Counter] = (Counter(), Counter())
            for _, toxic, text in some:
                words = set(_FIND(text.lower()))
                found[toxic > 0].update(words | {b for w in words for b in beginnings(w)})
            terms = list(found[0].keys() | found[1].keys())
            yield records({"term": pa.string(), "clean": pa.int64(), "toxic": pa.int64()}, [terms, [found[0][t] for t in terms], [found[1][t] for t in terms]])

    sizes = {r["t"]: r["n"] for r in examples.groupBy((F.col("toxic") > 0).alias("t")).agg(F.count(F.lit(1)).alias("n")).collect()}
    counted = examples.mapInArrow(occurrences, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counted = counted.toArrow()
    strength = association(*(counted.column(c).to_numpy() for c in ("clean", "toxic")), sizes.get(False, 0), sizes.get(True, 0))
    chosen = sorted((t, s) for t, s in zip(counted.column("term").to_pylist(), strength.tolist()) if s > 0 or not t.endswith("*"))
    names = {t: k for k, (t, _) in enumerate(chosen)}
    strength = np.array([s for _, s in chosen])
    del counted, chosen
    known = spark.sparkContext.broadcast(names)

    def containing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, found, texts = TermCounter(known.value), np.zeros(len(known.value), np.int64), 0
        for some in pieces(batches):
            texts += len(some)
            for (text,) in some:
                found[list(counter.present(text))] += 1
        on = np.flatnonzero(found)
        # The number of texts goes under term -1.
        yield records({"term": pa.int32(), "n": pa.int64()}, [[-1, *on.tolist()], [texts, *found[on].tolist()]])

    rows = texts_of(docs, id_column, text_column)
    holding = rows.select("text").mapInArrow(containing, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = (holding.column(c).to_numpy() for c in ("term", "n"))
    in_texts = np.zeros(len(names))
    in_texts[term[term >= 0]] = n[term >= 0]
    idf = 1 + np.log((1 + n[term < 0].sum()) / (1 + in_texts))
    weight = idf * (LEAST_WEIGHT + strength)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TermCounter(known.value)
        kinds = {"doc_id": pa.int64(), "toxic": pa.int32(), "terms": pa.list_(pa.int32()), "counts": pa.list_(pa.int64())}
        for some in pieces(batches):
            own = [counter(text) for *_, text in some]
            yield records(kinds, [[r[0] for r in some], [r[1] for r in some], [list(c) for c in own], [list(c.values()) for c in own]])

    found = examples.mapInArrow(vectors, "doc_id long, toxic int, terms array<int>, counts array<long>").toArrow().combine_chunks().sort_by("doc_id")
    lists = [found.column(c).combine_chunks() for c in ("terms", "counts")]
    flat = [np.asarray(x.flatten() if len(x) else []) for x in lists]
    sizes = np.asarray(lists[0].value_lengths() if len(found) else [])
    ids, toxic = (found.column(c).to_numpy() for c in ("doc_id", "toxic"))
    return ToxicityModel(names, weight, ids, (toxic > 0).astype(np.int64), sizes.astype(np.int64), flat[0].astype(np.int32), flat[1].astype(np.int32))


def toxicity_score(spark: SparkSession, model: ToxicityModel, text: Column) -> Column:
    """struct<score double, evidence array<struct<doc_id long, cosine double, toxic int>>>.

    The whole text is read; null counts as empty. Evidence is nearest first.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("score double, evidence array<struct<doc_id: long, cosine: double, toxic: int>>")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        counter = TermCounter(own.names)
        for texts in parts:
            found = [own.score(counter(t)) for t in texts]
            evidence = [[{"doc_id": int(own.ids[i]), "cosine": c, "toxic": int(own.toxic[i])} for c, i in near] for _, near in found]
            yield pd.DataFrame({"score": [s for s, _ in found], "evidence": evidence})

    return score(text)


def toxic_documents(docs: DataFrame, labels: DataFrame, column: str = "toxicity") -> DataFrame:
    """The columns of docs and a struct (score, evidence), named `column`, or with further
    underscores behind it where docs has that name.

    Null and empty texts, and texts that share no term with an example, get the base rate and
    no evidence. Repeated rows count as often as they come in the terms' counts, and get equal
    scores; an example is one row per id. Examples as near as the last of the nearest vote
    too, so no order of ids decides. Without labels, or of one kind only, every term weighs
    its TF-IDF; an empty table gives an empty one. A text of any length is read whole.
    """
    model = fit_toxicity(docs, labels)
    return docs.withColumn(free_name(docs, column), toxicity_score(docs.sparkSession, model, F.col("text")))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with a score below one half, unchanged, whatever names their columns have.

    Scores are those of toxic_documents, odd rows included; no row is merged with an equal one.
    """
    model = fit_toxicity(docs, labels)
    scored = wrapped(docs).select("row", toxicity_score(docs.sparkSession, model, F.col("row.text")).alias("toxicity"))
    return scored.filter(F.col("toxicity.score") < 0.5).select("row.*")
