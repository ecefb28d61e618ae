"""Token ids of whole texts by a public tokenizer, with a memory of the words met before."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np

#: Words that a Python worker remembers with their ids, about 270 bytes each.
REMEMBERED = 1_500_000
#: New parts that are encoded in one text, so the library is asked once for all of them.
JOINED = 64
#: A space that a part may or may not begin with.
_UNSURE = re.compile(r" (?![!-~\w])")
_WORKER: dict = {}


class TextEncoder:
    """Encodes texts as the tokenizers library does, word by word.

    Both vocabularies split a text before a single space that a letter, digit or ASCII
    sign follows, whatever stands before it, and merge only inside such parts. So the ids
    of a text are those of its parts, and each distinct part is encoded once. keep_space:
    whether the space belongs to the part (byte-level vocabularies) or is dropped.
    remembered: distinct parts that are kept; it changes no id.
    """

    def __init__(self, path: str, keep_space: bool, remembered: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.remembered = REMEMBERED if remembered is None else remembered
        self.lead = " " if keep_space else ""
        self.known: dict[str, int] = {}
        self.ids, self.starts = array("I"), array("Q", [0])
        # What tells parts of one text apart: with spaces kept, no id but a part's first begins
        # with one; else a digit is an id by itself, so it may stand between parts without it.
        vocabulary = self.tokenizer.get_vocab()
        first = [k for token, k in vocabulary.items() if token[0] == "\u0120"] if keep_space else [vocabulary.get("0</w>", -1)]
        self.marks = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.marks[[k for k in first if k >= 0]] = True
        self.joins = re.compile(r" [!-~\w][^ ]*" if keep_space else "[^ 0]+").fullmatch if self.marks.any() else lambda part: None

    def parts(self, text: str) -> list[str]:
        """The parts of a text, whose ids follow one another.

        They are named without the space before them; the first part of a text or line, which
        has none, is named with one.
        """
        if "\n" not in text:
            return self._parts(text)
        if not self.lead:
            # Blanks only part words: any run of them is as good as a space.
            text = text.replace("\n", " ").strip(" ")
            while "  " in text:
                text = text.replace("  ", " ")
            return self._parts(text)
        # A line feed between two other characters than blanks is a part by itself.
        first, *lines = text.split("\n")
        out, own = [], first
        for line in lines:
            if own and line and not own[-1].isspace() and not line[0].isspace():
                out += self._parts(own)
                out.append(" \n")
                own = line
            else:
                own += "\n" + line
        return out + self._parts(own)

    def _parts(self, text: str) -> list[str]:
        split = text.split(" ")
        if _UNSURE.search(text):
            joined = split[:1]
            for part in split[1:]:
                if part and not _UNSURE.match(" " + part[0]):
                    joined.append(part)
                else:
                    joined[-1] += " " + part
            split = joined
        if not split[0]:
            return split[1:]
        split[0] = " " + split[0]
        return split

    def _library(self, texts: list[str]) -> Iterator[list[int]]:
        return (e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))

    def _joined(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """_ids of parts that stay apart when they are encoded as one text."""
        mark, end = ("", "") if self.lead else (" 0 ", " 0")
        texts = [mark.join(some[k : k + JOINED]) + end for k in range(0, len(some), JOINED)]
        ids = np.fromiter(chain.from_iterable(self._library(texts)), np.uint32)
        marks = np.flatnonzero(self.marks[ids])
        if self.lead:
            return ids, np.diff(marks, append=len(ids))
        return np.delete(ids, marks), np.diff(marks, prepend=-1) - 1

    def _ids(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """The ids of all parts in a row, how many each has, and the parts in that order."""
        some = [p[1:] if p[0] == " " else self.lead + p for p in parts]
        alike = [bool(self.joins(p)) for p in some]
        ids, sizes = self._joined([p for p, a in zip(some, alike) if a])
        own = list(self._library([p for p, a in zip(some, alike) if not a]))
        ids = np.concatenate([ids, np.fromiter(chain.from_iterable(own), np.uint32)])
        sizes = np.concatenate([sizes, np.array([len(x) for x in own], np.int64)])
        return ids, sizes, [p for a in (True, False) for p, b in zip(parts, alike) if a == b]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        split = [self.parts(t) for t in texts]
        flat = list(chain.from_iterable(split))
        codes = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(codes < 0).tolist()
        new = list(dict.fromkeys([flat[i] for i in missing]))
        kept = len(self.starts) - 1
        # What the memory has no room for is known for these texts only.
        room = max(0, self.remembered - kept)
        ids, starts = self.ids, self.starts
        more: dict[str, int] = {}
        for at in [*range(0, room, 4096), *range(room, len(new), 4096)]:
            if at >= len(new):
                break
            if at == room:
                ids, starts = array("I", ids), array("Q", starts)
            own, sizes, named = self._ids(new[at : min(at + 4096, room if at < room else len(new))])
            more.update(zip(named, range(kept + at, kept + at + len(named))))
            if at < room:
                self.known.update(zip(named, range(kept + at, kept + at + len(named))))
            starts.frombytes((starts[-1] + np.cumsum(sizes)).astype(np.uint64).tobytes())
            ids.frombytes(own.tobytes())
        codes[missing] = [more[flat[i]] for i in missing]
        bounds = np.array(starts, np.int64)
        sizes = (bounds[1:] - bounds[:-1])[codes]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        where = np.arange(total, dtype=np.int64) + np.repeat(bounds[codes] - (ends - sizes), sizes)
        found = np.array(ids, np.uint32)[where]
        cuts = np.concatenate([[0], ends])[np.cumsum([len(p) for p in split])].tolist()
        return [found[a:b] for a, b in zip([0, *cuts], cuts)]


def worker_encoder(path: str, keep_space: bool, remembered: int | None = None) -> TextEncoder:
    """The encoder of this Python worker, made once; it stays as long as the worker."""
    key = (path, keep_space, remembered)
    if key not in _WORKER:
        _WORKER[key] = TextEncoder(path, keep_space, remembered)
    return _WORKER[key]


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary lies; call it where it is read, on the executor."""
    import public_tokenizers

    return public_tokenizers.path(name)
