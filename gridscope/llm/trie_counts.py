"""Token counts under a unigram vocabulary, computed over a trie of distinct pre-tokens.

The best segmentation of a pre-token maximises the sum of its pieces' log probabilities.
Dynamic programming goes along the trie: a node holds the best score and its number of
pieces for the bytes from the root, so a prefix that many pre-tokens share is scored once.
A terminal stores its pre-token's number of pieces, and the counts of pre-tokens do the rest.

Pieces come from a public rank file; a piece of rank r has probability 1 / (r + 3), divided
by the sum over all pieces (Zipf's law), so nothing is trained. Scores are whole millionths.
"""

from __future__ import annotations

import base64
import math
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridscope.llm.common import pieces, records, texts_of
from gridscope.llm.tokens import tokenizer_file

MILLION = 1_000_000
OFFSET = 3
#: A byte that is no piece by itself counts as one piece of this score.
UNKNOWN = -50 * MILLION
#: Nodes of a worker's trie, about 150 bytes each; a full trie is begun anew.
MOST_NODES = 1_500_000
_WORKER: dict = {}


def piece_scores(path: str) -> dict[bytes, int]:
    """Millionths of the natural log probability of each piece of a rank file."""
    with open(path) as file:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(str.split, filter(str.strip, file))}
    total = math.log(sum(1 / (r + OFFSET) for r in ranks.values()))
    return {piece: -round(MILLION * (math.log(r + OFFSET) + total)) for piece, r in ranks.items()}


class PreTokenTrie:
    """A trie over bytes with forward scores; node 0 is the root."""

    def __init__(self, scores: dict[bytes, int]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best, self.count = array("q", [0]), array("q", [0])
        self.terminal: dict[str, int] = {}

    def add(self, token: str) -> int:
        """The terminal node of a pre-token."""
        data = token.encode()
        child, best, count, scores, longest = self.child, self.best, self.count, self.scores, self.longest
        path = [0]
        for depth, byte in enumerate(data, 1):
            edge = path[-1] << 8 | byte
            node = child.get(edge)
            if node is None:
                node = child[edge] = len(best)
                # Longer last pieces first, so they win ties with as many pieces.
                top = None
                for start in range(max(0, depth - longest), depth):
                    score = scores.get(data[start:depth])
                    if score is None:
                        if start < depth - 1:
                            continue
                        score = UNKNOWN
                    before = path[start]
                    found = (best[before] + score, -count[before] - 1)
                    if top is None or found > top:
                        top = found
                best.append(top[0])
                count.append(-top[1])
            path.append(node)
        self.terminal[token] = path[-1]
        return path[-1]

    def nodes(self, tokens: list[str]) -> np.ndarray:
        """Terminal nodes of distinct pre-tokens."""
        known, add = self.terminal, self.add
        return np.fromiter((known[t] if t in known else add(t) for t in tokens), np.int64, len(tokens))


def worker_trie(path: str) -> PreTokenTrie:
    """The trie of this Python worker, begun anew when it has grown too large."""
    trie = _WORKER.setdefault(path, None) or PreTokenTrie(piece_scores(path))
    _WORKER[path] = trie
    if len(trie.best) > MOST_NODES:
        trie.clear()
    return trie


def _counted(texts: list[str], pattern, path: str):
    """Owner and code of each pre-token, the distinct ones, and their pieces and scores."""
    split = [pattern.findall(t) for t in texts]
    flat = list(chain.from_iterable(split))
    names: dict[str, int] = {}
    codes = np.fromiter(map(names.setdefault, flat, range(len(flat))), np.int64, len(flat))
    codes = np.searchsorted(np.fromiter(names.values(), np.int64, len(names)), codes)
    trie = worker_trie(path)
    nodes = trie.nodes(list(names))
    parts, score = np.array(trie.count, np.int64)[nodes], np.array(trie.best, np.int64)[nodes]
    return np.repeat(np.arange(len(texts)), [len(s) for s in split]), codes, list(names), parts, score


def unigram_token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, n_pretokens, n_distinct, n_tokens and unigram_score (natural log).

    Nothing is shuffled: a task's texts share the trie of its worker. Null and empty texts count
    nothing; texts of any length are read whole; of equally likely cuts the one with
    the fewest pieces is counted. Repeated rows give equal rows, an
    empty table an empty one; columns but id and text don't matter. The pieces' weights follow
    Zipf's law by rank in a public vocabulary; they are not fitted to any text.
    """
    kinds = {"doc_id": pa.int64(), "n_chars": pa.int64(), "n_pretokens": pa.int64(), "n_distinct": pa.int64(), "n_tokens": pa.int64(), "unigram_score": pa.float64()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        import regex

        pattern, path = regex.compile(public_tokenizers.PATTERN), tokenizer_file(vocabulary)
        for some in pieces(batches):
            owner, codes, names, parts, score = _counted([t for _, t in some], pattern, path)
            n = len(some)
            sums = np.zeros((2, n), np.int64)
            np.add.at(sums[0], owner, parts[codes])
            np.add.at(sums[1], owner, score[codes])
            distinct = np.bincount(np.unique(owner * max(1, len(names)) + codes) // max(1, len(names)), minlength=n)
            yield records(kinds, [[d for d, _ in some], [len(t) for _, t in some], np.bincount(owner, minlength=n), distinct, sums[0], sums[1] / MILLION])

    schema = "doc_id long, n_chars long, n_pretokens long, n_distinct long, n_tokens long, unigram_score double"
    return texts_of(docs, id_column, text_column).mapInArrow(count, schema)


def terminal_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", text_column: str = "text") -> DataFrame:
    """(pretoken, occurrences, n_tokens) of all texts: what the terminals of one trie would hold."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        import regex

        pattern, path = regex.compile(public_tokenizers.PATTERN), tokenizer_file(vocabulary)
        for some in pieces(batches):
            _, codes, names, parts, _ = _counted([t for (t,) in some], pattern, path)
            yield records({"pretoken": pa.string(), "occurrences": pa.int64(), "n_tokens": pa.int64()}, [names, np.bincount(codes, minlength=len(names)), parts])

    rows = docs.select(F.col(text_column).alias("text")).mapInArrow(count, "pretoken string, occurrences long, n_tokens long")
    return rows.groupBy("pretoken").agg(F.sum("occurrences").alias("occurrences"), F.first("n_tokens").alias("n_tokens"))
