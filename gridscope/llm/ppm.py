"""Language-model scores by prediction by partial matching (PPM), and a word unigram beside it.

The model is a trie of byte contexts up to five bytes long, held as the counts of all
six-byte strings of the training texts. A byte is predicted in the longest context that
training met; a byte not seen there costs an escape (method D: each distinct byte gives half
an occurrence to the escape) and is looked for in the next shorter context, where the bytes
that the longer one offered are excluded; below the empty context all bytes left are alike.

The probability of a byte depends on its six-byte string only, so one grouped job computes
it for every string of the corpus, and a document's score is a sum over its strings. Strings
and words with at least one 4,000,000th of all occurrences, at most 4,000,000 of each, are
sent to every task; the others are looked up by a join, in which none is frequent.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridscope.llm.common import PIECE_CHARS, fold_of, pieces, records, stored

ORDER = 5
HELD_OUT_FOLD = 1
#: Entries with at least total / FREQUENT occurrences are broadcast: at most FREQUENT of them.
FREQUENT = 4_000_000
#: Characters that are counted at once, and distinct words or strings after which rows leave a task.
COUNTED_CHARS, MOST_COUNTED = 1_000_000, 2_000_000
#: Characters of texts that are scored at once.
SCORED_CHARS = 1_000_000
#: Texts of a portion: a string's 48 bits and a text's number are one number of 63 bits.
TEXT_BITS = 15
MOST_TEXTS = 1 << TEXT_BITS
WORDS, STRINGS, DOCUMENT = 1, 2, 0
END_WORD = b" "


def word_key(word: bytes) -> int:
    """A word's name in the tables: 64 bits of its hash, as a signed number."""
    value = xxhash.xxh64_intdigest(word)
    return value - (1 << 64) if value >> 63 else value


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes], list[list[bytes]]]:
    """Owner and code of each token (the end included), the distinct tokens, and the tokens.

    Bytes are put in lower case for A-Z only, and split by the six characters that part words.
    """
    split = [[*t.encode().lower().split(), END_WORD] for t in texts]
    flat = list(chain.from_iterable(split))
    first: dict[bytes, int] = {}
    at = np.fromiter(map(first.setdefault, flat, range(len(flat))), np.int64, len(flat))
    number = np.empty(len(flat), np.int64)
    number[np.fromiter(first.values(), np.int64, len(first))] = np.arange(len(first))
    return np.repeat(np.arange(len(texts)), [len(s) for s in split]), number[at], list(first), split


def _strings(split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The six-byte string (as a number) of each byte of the texts and of their ends, text by text,
    and how many each text has.

    A text is its words with single spaces; five zero bytes stand before it, one after it.
    """
    joined = [b" ".join(s[:-1]) for s in split]
    sizes = np.array([len(j) + 1 for j in joined], np.int64)
    data = np.frombuffer(b"\0" * ORDER + (b"\0" * (ORDER + 1)).join(joined) + b"\0", np.uint8)
    codes = data[: len(data) - ORDER].astype(np.int64)
    for k in range(1, ORDER + 1):
        codes <<= 8
        codes |= data[k : len(data) - ORDER + k]
    # codes[i] predicts byte i + ORDER; between two texts stand ORDER that predict none.
    spans = np.full((len(split), 2), ORDER, np.int64)
    spans[:, 0] = sizes
    inside = np.repeat(np.tile([True, False], len(split)), spans.reshape(-1))[: len(codes)]
    return codes[inside], sizes


def _portions(split: list[list[bytes]], limit: int = PIECE_CHARS) -> Iterator[slice]:
    """Slices of at most MOST_TEXTS texts with about limit bytes, for what needs memory per byte."""
    first, size = 0, 0
    for k, words in enumerate(split):
        size += sum(map(len, words)) + len(words)
        if size >= limit or k == len(split) - 1 or k - first + 1 == MOST_TEXTS:
            yield slice(first, k + 1)
            first, size = k + 1, 0


def _begins(ordered: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1]]))


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, ascending, and how often each comes; values are put in order."""
    values.sort()
    at = _begins(values)
    return values[at], np.diff(at, append=len(values))


def _added(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two tables of values and counts as one, ascending."""
    values, counts = (np.concatenate(pair) for pair in zip(one, other))
    # Stable sorting merges what is in order already.
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    at = _begins(values)
    return values[at], np.add.reduceat(counts, at) if len(at) else counts


def corpus_counts(docs: DataFrame) -> DataFrame:
    """(kind, key, train, total): occurrences of words and six-byte strings.

    docs: (uid, doc_id, train, text). Words are counted in training texts only.
    """
    kinds = {"kind": pa.int8(), "key": pa.int64(), "train": pa.int64(), "total": pa.int64()}
    none = np.empty(0, np.int64), np.empty(0, np.int64)

    def strings_of(found: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        """From counts of strings times two, plus one in training texts."""
        names, at = found[0] >> 1, _begins(found[0] >> 1)
        sums = [np.add.reduceat(n, at) if len(at) else n for n in (found[1] * (found[0] & 1), found[1])]
        return records(kinds, [np.full(len(at), STRINGS, np.int8), names[at], *sums])

    def words_of(found: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return records(kinds, [np.full(len(found[0]), WORDS, np.int8), found[0], found[1], found[1]])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_words, all_strings = none, none
        for some in pieces(batches, COUNTED_CHARS):
            train = np.array([r[0] for r in some], bool)
            owner, codes, names, split = _words([r[-1] for r in some])
            del some
            seen = np.bincount(codes[train[owner]], minlength=len(names))
            used = np.flatnonzero(seen)
            keys = np.array([word_key(names[i]) for i in used.tolist()], np.int64)
            all_words = _added(all_words, (keys, seen[used]))
            # Only the tokens are needed from here on.
            del owner, codes, names, used, keys, seen
            for part in _portions(split):
                strings, sizes = _strings(split[part])
                strings <<= 1
                strings |= np.repeat(train[part], sizes)
                all_strings = _added(all_strings, _counted(strings))
            if len(all_words[0]) >= MOST_COUNTED:
                yield words_of(all_words)
                all_words = none
            if len(all_strings[0]) >= MOST_COUNTED:
                yield strings_of(all_strings)
                all_strings = none
        yield words_of(all_words)
        yield strings_of(all_strings)

    rows = docs.select("train", "text").mapInArrow(count, "kind byte, key long, train long, total long")
    return rows.groupBy("kind", "key").agg(F.sum("train").alias("train"), F.sum("total").alias("total"))


def _grouped(keys: list[np.ndarray], values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of equal keys, and the sum and the number of positive values of each."""
    code = keys[0]
    for more in keys[1:]:
        code = code * 256 + more
    _, code = np.unique(code, return_inverse=True)
    return code, np.bincount(code, values), np.bincount(code, values > 0)


def string_probabilities(codes: np.ndarray, train: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 probability of the last byte of each six-byte string after the other five.

    codes, train: the distinct strings that share the two bytes before the last, with their training
    counts. pairs[b, s]: training count of byte s after byte b, from all strings.
    """
    s, c1 = codes & 255, (codes >> 8) & 255
    far = [(codes >> shift) & 255 for shift in range(24, 8 * (ORDER + 1), 8)]
    train = train.astype(np.float64)
    # Per level, longest context first: count of the byte, and sum and kinds of the context.
    levels = []
    for context in (far[:k] for k in range(len(far), -1, -1)):
        base = [np.zeros_like(s), *context]
        code, total, _ = _grouped(base, train)
        cell, count, _ = _grouped([*base, s], train)
        # Kinds are cells with a count; each is taken once.
        once = np.zeros(len(count), np.int64)
        once[cell] = code
        kinds = np.bincount(once, count > 0, minlength=len(total))
        levels.append((count[cell], total[code], kinds[code], code, cell))
    row = pairs[c1].astype(np.float64)
    levels.append((row[np.arange(len(s)), s], row.sum(axis=1), (row > 0).sum(axis=1), None, None))
    zero = pairs.sum(axis=0).astype(np.float64)
    levels.append((zero[s], np.full(len(s), zero.sum()), np.full(len(s), (zero > 0).sum()), None, None))

    out = np.zeros(len(s))
    open_ = np.ones(len(s), bool)
    excluded_sum, excluded_kinds = np.zeros(len(s)), np.zeros(len(s))
    for at, (count, total, kinds, code, _) in enumerate(levels):
        rest, left = total - excluded_sum, kinds - excluded_kinds
        asked = open_ & (rest > 0)
        hit = asked & (count > 0)
        out[hit] += np.log10((count[hit] - 0.5) / rest[hit])
        miss = asked & ~hit
        out[miss] += np.log10(left[miss] / 2 / rest[miss])
        open_ &= ~hit
        if at + 1 < len(levels):
            # What the next context counts for bytes that this one offers.
            below = levels[at + 1][0]
            if code is not None:
                cell = levels[at][4]
                first = np.zeros(cell.max() + 1, np.int64)
                first[cell] = np.arange(len(s))
                offered = np.bincount(code[first], np.where(count[first] > 0, below[first], 0.0), minlength=code.max() + 1)[code]
            else:
                offered = (zero[None, :] * (row > 0)).sum(axis=1)
            excluded_sum, excluded_kinds = offered, kinds
    seen = (zero > 0).sum()
    out[open_] -= np.log10(256 - seen)
    return out


def _probabilities(strings: DataFrame) -> DataFrame:
    """(key, total, value): each string's log10 probability.

    Strings are grouped by the two bytes before the last, so a group has the whole trie of
    longer contexts that end in them, as distinct strings, however often they occur. The
    counts of byte pairs, for shorter contexts, are at most 65,536 rows.
    """
    pairs = np.zeros((256, 256), np.int64)
    found = strings.groupBy(F.col("key").bitwiseAND(0xFFFF).alias("pair")).agg(F.sum("train").alias("n")).collect()
    for r in found:
        pairs[r["pair"] >> 8, r["pair"] & 255] = r["n"]

    def solve(group: pa.Table) -> pa.Table:
        value = string_probabilities(group["key"].to_numpy(), group["train"].to_numpy(), pairs)
        return group.select(["key", "total"]).append_column("value", pa.array(value))

    middle = F.shiftright("key", 8).bitwiseAND(0xFFFF).alias("middle")
    return strings.select(middle, "key", "train", "total").groupBy("middle").applyInArrow(solve, "key long, total long, value double")


def _sorted_arrays(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    found = table.select("key", "value").toArrow()
    keys, values = found["key"].to_numpy(), found["value"].to_numpy()
    order = np.argsort(keys)
    return keys[order], values[order]


def _looked_up(keys: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Values of the keys, NaN where the table has none."""
    names, values = table
    if not len(names):
        return np.full(len(keys), np.nan)
    at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
    return np.where(names[at] == keys, values[at], np.nan)


def language_scores(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Texts are read whole, A-Z as a-z; null counts as empty. The model learns from rows
    outside the held-out fold of their id's hash. base_score is the word unigram's, score
    the PPM model's log10 probability of the words with single spaces and the end. Without
    any training text every byte is alike, and the unigram's is zero.
    """
    spark = docs.sparkSession
    fold = fold_of(F.col(id_column))
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col(id_column).cast("long").alias("doc_id"),
        (fold != HELD_OUT_FOLD).alias("train"),
        F.col(text_column).alias("text"),
    )
    counts = stored(corpus_counts(rows))
    facts = {r["kind"]: r for r in counts.groupBy("kind").agg(F.sum("train").alias("n"), F.count(F.lit(1)).alias("v"), F.sum("total").alias("all")).collect()}
    words = facts.get(WORDS) or {"n": 0, "v": 0, "all": 0}
    tokens, scale = words["n"], words["n"] + 0.5 * (words["v"] + 1)
    all_strings = facts[STRINGS]["all"] if STRINGS in facts else 0
    word_table = counts.filter(F.col("kind") == WORDS).select("key", "total", F.col("train").cast("double").alias("value"))
    string_table = stored(_probabilities(counts.filter(F.col("kind") == STRINGS)))
    often = [(word_table, F.col("total") >= tokens / frequent), (string_table, F.col("total") >= all_strings / frequent)]
    shared = spark.sparkContext.broadcast([_sorted_arrays(table.filter(test)) for table, test in often])
    kinds = {
        "uid": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "kind": pa.int8(), "key": pa.int64(), "n": pa.int64(),
        "n_known": pa.int64(), "base": pa.float64(), "score": pa.float64(),
    }

    def rare(uid, keys, n, kind):
        """Rows for the entries that aren't frequent, counted per text."""
        none = np.zeros(len(n))
        return records(
            kinds,
            [uid, pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.bool_()), np.full(len(n), kind, np.int8), keys, n, none.astype(np.int64), none, none],
        )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_often, strings_often = shared.value
        for some in pieces(batches, SCORED_CHARS):
            uid, doc_id, held = (list(c) for c in list(zip(*some))[:3])
            uid, docs_n = np.array(uid, np.int64), len(some)
            owner, codes, names, split = _words([r[-1] for r in some])
            del some
            names = np.array([word_key(w) for w in names], np.int64)
            found = _looked_up(names, words_often)
            known, gain = ~np.isnan(found), np.log10((np.nan_to_num(found) + 0.5) / scale)
            own = known[codes]
            size, met = np.bincount(owner, minlength=docs_n), np.bincount(owner[own], minlength=docs_n)
            base = np.bincount(owner[own], gain[codes[own]], minlength=docs_n)
            which, n = _counted(owner[~own] * len(names) + codes[~own])
            yield rare(uid[which // max(1, len(names))], names[which % max(1, len(names))], n, WORDS)
            del owner, codes, names, found, known, gain, own, which, n
            score = np.zeros(docs_n)
            for part in _portions(split):
                strings, sizes = _strings(split[part])
                strings <<= TEXT_BITS
                strings |= np.repeat(np.arange(len(sizes)), sizes)
                which, n = _counted(strings)
                del strings
                owner, names = (which & (MOST_TEXTS - 1)) + part.start, which >> TEXT_BITS
                # Strings are in order, so each is looked up once.
                at = _begins(names)
                found = np.repeat(_looked_up(names[at], strings_often), np.diff(at, append=len(names)))
                known = ~np.isnan(found)
                score += np.bincount(owner[known], found[known] * n[known], docs_n)
                yield rare(uid[owner[~known]], names[~known], n[~known], STRINGS)
            yield records(kinds, [uid, doc_id, held, np.full(docs_n, DOCUMENT, np.int8), uid, size, met, base, score])

    schema = "uid long, doc_id long, held_out boolean, kind byte, key long, n long, n_known long, base double, score double"
    measured = rows.select("uid", "doc_id", (~F.col("train")).alias("held_out"), "text").mapInArrow(measure, schema)
    tables = [t.filter(~test).select(F.lit(kind).cast("byte").alias("kind"), "key", "value") for kind, (t, test) in zip((WORDS, STRINGS), often)]
    joined = measured.join(tables[0].unionByName(tables[1]), ["kind", "key"], "left")
    is_word, is_string = F.col("kind") == WORDS, F.col("kind") == STRINGS
    seen = F.coalesce("value", F.lit(0.0))
    out = joined.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.sum(F.when(F.col("kind") == DOCUMENT, F.col("n")).otherwise(0)).alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(is_word & (seen > 0), F.col("n")).otherwise(0)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        F.sum(F.col("base") + F.when(is_word, F.col("n") * F.log10((seen + 0.5) / F.lit(float(scale)))).otherwise(0.0)).alias("base_score"),
        F.sum(F.col("score") + F.when(is_string, F.col("n") * F.col("value")).otherwise(0.0)).alias("score"),
    )
    return out.drop("uid")
