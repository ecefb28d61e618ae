"""Fill-in-middle examples by displacement scatter.

A text is cut at two line ends into prefix, middle and suffix, which are written in another
order behind marks. In a batch, all texts are one byte buffer: each part has a displacement,
the place of its bytes in the output less that in the input. A difference array holds the
change of the displacement where a part begins; its cumulative sum gives every byte its
shift, and one scatter writes the outputs. The way back finds the marks in the outputs, and
gathers through the same sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gridscope.llm.buffers import byte_pieces, text_array

# The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARK = 3
SEED = 7
#: Percent of the texts that are cut, and percent of those with the suffix in front.
RATE, SUFFIX_FIRST = 100, 50
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Bytes that are moved at once, whatever the length of a text.
CHUNK = 4_000_000


def draws(id_column: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2^32 from the seed and the id; a null id counts as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def marks_at(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where marks begin in the bytes, their letters, and the numbers of the texts they are in."""
    if len(data) < MARK:
        return np.empty(0, np.int64), np.empty(0, np.uint8), np.empty(0, np.int64)
    at = np.flatnonzero((data[:-2] == PREFIX[0]) & (data[2:] == PREFIX[2]))
    letter = data[at + 1]
    known = np.isin(letter, [PREFIX[1], SUFFIX[1], MIDDLE[1]])
    at, letter = at[known], letter[known]
    owner = np.searchsorted(offsets, at, "right") - 1
    inside = at + MARK <= offsets[owner + 1]
    return at[inside], letter[inside], owner[inside]


def moved(data: np.ndarray, begins: np.ndarray, targets: np.ndarray, out: np.ndarray, back: bool = False) -> None:
    """Move the parts that begin at `begins` (ascending, the first at 0) to `targets` in out.

    back: the other way, the parts of out are read at the targets and written to data.
    """
    shifts = targets - begins
    change = np.diff(shifts, prepend=0)
    shift = 0
    for at in range(0, len(data), CHUNK):
        size = min(CHUNK, len(data) - at)
        a, b = np.searchsorted(begins, [at, at + size])
        differences = np.zeros(size, np.int64)
        # Empty parts begin where the next one does; their changes add up.
        np.add.at(differences, begins[a:b] - at, change[a:b])
        differences[0] += shift
        shift = int(differences.sum())
        places = np.cumsum(differences, out=differences)
        places += np.arange(at, at + size)
        if back:
            data[at : at + size] = out[places]
        else:
            out[places] = data[at : at + size]


def filled(data: np.ndarray, offsets: np.ndarray, numbers: np.ndarray, rate: int, suffix_first: int) -> dict[str, np.ndarray]:
    """Examples from texts in one buffer and four drawn numbers per text."""
    count = len(offsets) - 1
    starts, ends = offsets[:-1], offsets[1:]
    feeds = np.flatnonzero(data == 10)
    first_feed, last_feed = np.searchsorted(feeds, starts), np.searchsorted(feeds, ends)
    open_line = (ends > starts) & (data[np.maximum(ends - 1, 0)] != 10) if len(data) else np.zeros(count, bool)
    units = last_feed - first_feed + open_line

    def cut(number: np.ndarray) -> np.ndarray:
        """The byte after so many units."""
        in_feeds = number <= last_feed - first_feed
        after = feeds[np.minimum(first_feed + number - 1, len(feeds) - 1)] + 1 if len(feeds) else ends
        return np.where(number == 0, starts, np.where(in_feeds, after, ends))

    chosen = np.sort(numbers[:, :2] % (units + 1)[:, None], axis=1)
    plain = (ends == starts) | (numbers[:, 2] % 100 >= rate)
    plain[marks_at(data, offsets)[2]] = True
    low = np.where(plain, starts, cut(chosen[:, 0]))
    high = np.where(plain, starts, cut(chosen[:, 1]))
    suffix_leads = ~plain & (numbers[:, 3] % 100 < suffix_first)
    form = np.where(plain, 0, np.where(suffix_leads, 2, 1))
    out_offsets = np.concatenate([[0], np.cumsum(ends - starts + np.where(plain, 0, 3 * MARK))])
    base = out_offsets[:-1]
    prefix, middle, suffix = low - starts, high - low, ends - high
    # A plain text is all suffix, without marks.
    mark = np.where(plain, 0, MARK)
    to_prefix = base + mark + np.where(suffix_leads, suffix + mark, 0)
    to_suffix = base + mark + np.where(suffix_leads | plain, 0, prefix + mark)
    to_middle = base + prefix + suffix + 3 * mark
    out = np.empty(out_offsets[-1], np.uint8)
    begins = np.stack([starts, low, high], axis=1).ravel()
    targets = np.stack([to_prefix, to_middle, to_suffix], axis=1).ravel()
    moved(data, begins, targets, out)
    for places, text in ((to_prefix, PREFIX), (to_suffix, SUFFIX), (to_middle, MIDDLE)):
        for k, byte in enumerate(text):
            out[places[~plain] - MARK + k] = byte
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return {
        "n": units, "form": form, "prefix_chars": heads[low] - heads[starts], "middle_chars": heads[high] - heads[low],
        "output": out, "offsets": out_offsets,
    }


def rebuilt(data: np.ndarray, offsets: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts (bytes, offsets) that examples were made of, from outputs and forms."""
    starts, ends = offsets[:-1], offsets[1:]
    at, letter, owner = marks_at(data, offsets)
    wanted = ~plain[owner]
    at, letter, owner = at[wanted], letter[wanted], owner[wanted]
    behind = np.repeat(starts[:, None], 3, axis=1)
    for k, text in enumerate((PREFIX, MIDDLE, SUFFIX)):
        own = letter == text[1]
        behind[owner[own], k] = at[own] + MARK
    # A part ends where the next mark begins, or with the text.
    order = np.argsort(behind, axis=1, kind="stable")
    ranked = np.take_along_axis(behind, order, axis=1)
    stops = np.concatenate([ranked[:, 1:] - MARK, ends[:, None]], axis=1)
    sizes = np.empty_like(behind)
    np.put_along_axis(sizes, order, stops - ranked, axis=1)
    sizes[plain] = np.stack([np.zeros_like(starts), np.zeros_like(starts), ends - starts], axis=1)[plain]
    text_offsets = np.concatenate([[0], np.cumsum(sizes.sum(axis=1))])
    begins = text_offsets[:-1, None] + np.concatenate([np.zeros((len(starts), 1), np.int64), np.cumsum(sizes, axis=1)[:, :2]], axis=1)
    text = np.empty(text_offsets[-1], np.uint8)
    moved(text, begins.ravel(), behind.ravel(), data, back=True)
    return text, text_offsets


def infilling_examples(
    docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per row: doc_id, n (lines), form, prefix_chars, middle_chars and the output text.

    Lines end after a line feed. Forms are plain (the text itself), psm and spm, by which
    of prefix and suffix comes first. Null and empty texts, and texts with a mark in them,
    are plain; their prefix_chars and middle_chars are null. Draws depend on the seed and the
    id alone, so equal ids are cut by the same numbers and repeated rows give equal rows; a
    null id counts as empty text. An empty table gives an empty one. Other columns don't
    matter. Nothing is shuffled; a text of any length is moved in chunks.
    """
    kinds = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
    names = pa.array([PLAIN, PSM, SPM])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in byte_pieces(batches):
            numbers = np.stack([rows.column(k).to_numpy() for k in range(1, 5)], axis=1)
            found = filled(data, offsets, numbers, rate, suffix_first)
            no_parts = found["form"] == 0
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array(found["n"].astype(np.int64)),
                    names.take(pa.array(found["form"])),
                    *(pa.array(found[c], mask=no_parts) for c in ("prefix_chars", "middle_chars")),
                    text_array(found["output"], found["offsets"]),
                ],
                schema=kinds,
            )

    key = F.col(id_column)
    rows = docs.select(key.cast("long").alias("doc_id"), *(d.alias(f"h{k}") for k, d in enumerate(draws(key, seed))), F.col(text_column).alias("text"))
    return rows.mapInArrow(make, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def with_restored(examples: DataFrame) -> DataFrame:
    """The examples and a column restored: the text rebuilt from output and form alone."""
    order = [c for c in examples.columns if c != "output"]
    rows = examples.select(*order, "output")
    schema = StructType([*rows.schema, StructField("restored", StringType())])

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in byte_pieces(batches):
            plain = np.array(rows.column("form").to_pylist()) == PLAIN
            text = text_array(*rebuilt(data, offsets, plain))
            yield pa.RecordBatch.from_arrays([*rows.columns, text], names=[*rows.schema.names, "restored"])

    return rows.mapInArrow(restore, schema).select(*examples.columns, "restored")
