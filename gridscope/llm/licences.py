"""Licence scans with a generalised suffix automaton of licence words.

The automaton holds all runs of words of all templates. A file streams through it word by
word, which gives for each place the longest run of template words that ends there: the
matching statistics. Short phrases count where they are a suffix of that run. Of a long
template, matches that can't be extended are anchors, and anchors in the same order in file
and template, with small gaps, are chained into spans that cover a share of the template.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridscope.llm.common import pieces
from gridscope.llm.licence_texts import BASE_PHRASES, PHRASES, TEMPLATES

# Fixed value: a word is a run of letters a-z, digits and characters beyond ASCII, here in UTF-8.
WORD = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of an anchor; words between two anchors of a chain, in the file and in the template.
LEAST_ANCHOR, GAP = 4, 20
#: Share of a template that a span must cover.
LEAST_SHARE = 0.6
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_FIND = re.compile(WORD).findall


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z in lower case."""
    return _FIND((text or "").encode().translate(_LOWER))


class SuffixAutomaton:
    """All runs of words (numbers) of several texts, each with the places where it ends."""

    def __init__(self, texts: Sequence[Sequence[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: (text, last word) per state: first those of the state's own, then of all in its class.
        self.ends: list[list[tuple[int, int]]] = [[]]
        for number, text in enumerate(texts):
            last = 0
            for place, word in enumerate(text):
                last = self._extended(last, word)
                self.ends[last].append((number, place))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.ends[self.link[state]] += self.ends[state]
        self.ends[0] = []

    def _state(self, length: int, like: int | None = None) -> int:
        self.next.append({} if like is None else dict(self.next[like]))
        self.link.append(-1 if like is None else self.link[like])
        self.length.append(length)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, state: int, word: int) -> int:
        """The state of exactly the runs that end in `state`'s, one word longer."""
        full = self.next[state][word]
        if self.length[full] == self.length[state] + 1:
            return full
        short = self._state(self.length[state] + 1, full)
        self.link[full] = short
        while state >= 0 and self.next[state].get(word) == full:
            self.next[state][word] = short
            state = self.link[state]
        return short

    def _extended(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new, state = self._state(self.length[last] + 1), last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        self.link[new] = 0 if state < 0 else self._split(state, word)
        return new

    def stream(self, words: Sequence[int]) -> Iterator[tuple[int, int]]:
        """Per word the state and the length of the longest run in some text that ends there."""
        following, link, length = self.next, self.link, self.length
        state = size = 0
        for word in words:
            while state and word not in following[state]:
                state = link[state]
                size = length[state]
            if word in following[state]:
                state = following[state][word]
                size += 1
            else:
                size = 0
            yield state, size


@dataclass(frozen=True)
class Span:
    """A stretch of words [first, last) that covers `covered` words of a template."""

    template: int
    first: int
    last: int
    covered: int


def chained(anchors: list[tuple[int, int, int]], gap: int = GAP) -> list[tuple[int, int, int]]:
    """Spans (first, last, covered) of chains of anchors (file, template, words); best first.

    A chain goes on by anchors that end later in both and begin at most `gap` words behind;
    words that overlap count once. Each anchor is in one chain. Only the anchors of the last
    words of the file are looked at, so the work grows with the anchors.
    """
    anchors = sorted(set(anchors), key=lambda a: (a[0] + a[2], a[1] + a[2], a[2]))
    stops = [a + n for a, _, n in anchors]
    most, before = [n for *_, n in anchors], [-1] * len(anchors)
    for j, (a, b, n) in enumerate(anchors):
        for i in range(bisect_left(stops, a - gap), bisect_left(stops, a + n)):
            c, d, m = anchors[i]
            if d + m >= b + n or b - d - m > gap:
                continue
            more = n - max(0, c + m - a, d + m - b)
            if more > 0 and most[i] + more > most[j]:
                most[j], before[j] = most[i] + more, i
    used, out = [False] * len(anchors), []
    for j in sorted(range(len(anchors)), key=lambda j: (-most[j], j)):
        if used[j]:
            continue
        first, at = j, j
        while at >= 0 and not used[at]:
            used[at], first, at = True, at, before[at]
        out.append((anchors[first][0], stops[j], most[j] - (most[at] if at >= 0 else 0)))
    return out


class LicenceScanner:
    """Phrases and templates of licences under one automaton."""

    def __init__(
        self,
        phrases: Sequence[tuple[str, str, bool]],
        templates: Sequence[tuple[str, str]],
        least_anchor: int = LEAST_ANCHOR,
        gap: int = GAP,
    ):
        self.phrases, self.templates, self.gap = phrases, templates, gap
        said = [words_of(text) for _, text, _ in phrases] + [words_of(text) for _, text in templates]
        self.number: dict[bytes, int] = {}
        numbers = [[self.number.setdefault(w, len(self.number)) for w in words] for words in said]
        self.automaton = machine = SuffixAutomaton(numbers)
        self.sizes = list(map(len, numbers))
        self.least_anchor = least_anchor
        states = range(len(machine.next))
        #: Per state the phrases that are a suffix of its runs, with their words.
        self.ending: list[list[tuple[int, int]]] = [[] for _ in states]
        #: Per state and template the state of the longest suffix that occurs in the template.
        self.within: list[dict[int, int]] = [{} for _ in states]
        whole: dict[int, list[int]] = {}
        for k in range(len(phrases)):
            state = 0
            for word in numbers[k]:
                state = machine.next[state][word]
            whole.setdefault(state, []).append(k)
        for state in sorted(states, key=lambda s: machine.length[s])[1:]:
            above = machine.link[state]
            self.ending[state] = [*self.ending[above], *((k, self.sizes[k]) for k in whole.get(state, ()))]
            own = {text for text, _ in machine.ends[state] if text >= len(phrases)}
            self.within[state] = self.within[above] | dict.fromkeys(own, state)
        #: The least statistic at which something can end.
        self.least = min([least_anchor, *self.sizes[: len(phrases)]])

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[Span], float]:
        """Places (phrase, first word), spans, and the largest covered share of any of them."""
        numbers = np.fromiter(map(self.number.get, words, [-1] * len(words)), np.int64, len(words))
        known = np.concatenate([[0], numbers >= 0, [0]]).astype(np.int8)
        turns = np.flatnonzero(np.diff(known))
        places: list[tuple[int, int]] = []
        anchors: dict[int, list[tuple[int, int, int]]] = {}
        # A word that no template has ends every run, so each run of known words streams by itself.
        for begin, end in zip(turns[::2].tolist(), turns[1::2].tolist()):
            if end - begin >= self.least:
                self._run(numbers[begin:end].tolist(), begin, places, anchors)
        spans, share = [], 1.0 if places else 0.0
        for text in sorted(anchors):
            for first, last, covered in chained(anchors[text], self.gap):
                part = covered / self.sizes[text]
                share = max(share, part)
                spans.append(Span(text - len(self.phrases), first, last, covered))
        return places, spans, share

    def _run(self, numbers: list[int], begin: int, places: list, anchors: dict) -> None:
        machine, ending, within, least = self.automaton, self.ending, self.within, self.least_anchor
        open_: dict[int, tuple[int, int]] = {}
        at = begin - 1
        for at, (state, size) in enumerate(machine.stream(numbers), begin):
            for phrase, n in ending[state]:
                # A state's runs share their suffixes up to its longest one.
                if n <= size:
                    places.append((phrase, at - n + 1))
            now: dict[int, tuple[int, int]] = {}
            if size >= least:
                for text, held in within[state].items():
                    n = size if held == state else machine.length[held]
                    if n >= least:
                        now[text] = (held, n)
            for text, (held, n) in open_.items():
                if now.get(text, (0, 0))[1] != n + 1:
                    self._close(text, held, n, at, anchors)
            open_ = now
        for text, (held, n) in open_.items():
            self._close(text, held, n, at + 1, anchors)

    def _close(self, text: int, held: int, n: int, stop: int, anchors: dict) -> None:
        found = anchors.setdefault(text, [])
        found += [(stop - n, place - n + 1, n) for number, place in self.automaton.ends[held] if number == text]


PLACE = "struct<label: string, first: long, words: long, base: boolean>"
SPAN = "struct<label: string, template: int, first: long, last: long, covered: long, share: double>"


def licence_spans(
    docs: DataFrame,
    base_phrases: Sequence[tuple[str, str]] = BASE_PHRASES,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    least_share: float = LEAST_SHARE,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Per row: doc_id, n_words, places, spans and score.

    places are all places of the phrases (label, first word, words, and whether it is a base
    phrase), by first word; spans are stretches [first, last) of words that cover least_share
    or more of a template, by first word. score is the largest covered share of any template,
    one where a phrase stands. Words count from 0, with A-Z as a-z. Null and empty texts have no
    words, no places and a score of 0; every row is looked at by itself, so repeated rows give
    equal rows, an empty table an empty one, and other columns don't matter. Equal spans of
    two templates are both given. A text of any length is read whole, and nothing is shuffled.
    """
    known = [(label, text, True) for label, text in base_phrases] + [(label, text, False) for label, text in phrases]
    for label, text in (*base_phrases, *phrases, *templates):
        if not words_of(text):
            raise ValueError(f"a phrase or template of {label} has no words")
    place = pa.struct([("label", pa.string()), ("first", pa.int64()), ("words", pa.int64()), ("base", pa.bool_())])
    span = pa.struct([("label", pa.string()), ("template", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("places", pa.list_(place)), ("spans", pa.list_(span)), ("score", pa.float64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = LicenceScanner(known, templates)
        sizes = scanner.sizes[: len(known)]
        for some in pieces(batches):
            out = []
            for doc_id, text in some:
                words = words_of(text)
                places, spans, score = scanner.scan(words)
                found = [{"label": known[k][0], "first": at, "words": sizes[k], "base": known[k][2]} for k, at in sorted(places, key=lambda p: (p[1], p[0]))]
                covered = []
                for s in sorted(spans, key=lambda s: (s.first, s.last, s.template)):
                    share = s.covered / scanner.sizes[len(known) + s.template]
                    if share >= least_share:
                        covered.append({"label": templates[s.template][0], "template": s.template, "first": s.first, "last": s.last, "covered": s.covered, "share": share})
                out.append({"doc_id": doc_id, "n_words": len(words), "places": found, "spans": covered, "score": score})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(scan, f"doc_id long, n_words long, places array<{PLACE}>, spans array<{SPAN}>, score double")


def licence_digest(found: DataFrame) -> DataFrame:
    """licence_spans with counts, ends and comma-joined labels in place of the lists."""
    base = F.filter("places", lambda p: p["base"])
    labels = lambda spans: F.transform(spans, lambda s: s["label"])
    joined = lambda found: F.array_join(F.array_sort(F.array_distinct(found)), ",")
    firsts = F.transform(base, lambda p: p["first"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(firsts).alias("first_word"),
        F.array_max(firsts).alias("last_word"),
        joined(labels(base)).alias("base_labels"),
        joined(F.concat(labels(F.col("places")), labels(F.col("spans")))).alias("labels"),
        "score",
    )
