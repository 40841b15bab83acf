"""Order-preserving packing by dynamic programming.

The documents of a task form one stream of ids in the order they are read. Windows are cut from the
stream so that padding and cut penalties are least: a cut at a document's end is free, one at a
sentence's end costs a little, one inside a sentence more. The least cost of a cut is the minimum
of a sliding range of earlier cuts, kept in a monotone queue.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from anomaloom.llm.hashing import texts_of
from anomaloom.llm.tokens import encoder

#: Costs in padding tokens of a cut at a sentence's end and of one inside a sentence.
SENTENCE_COST = 8
INNER_COST = 64
#: Inside sentences a cut may fall at every so many ids.
INNER_STEP = 32
#: Windows that are planned together; the last, open one goes on to the next plan.
PLANNED_WINDOWS = 256

_PIECES = (
    "row_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


@lru_cache(maxsize=4)
def sentence_ends(tokenizer: str) -> np.ndarray:
    """For every id of a tokenizer, whether its text ends a sentence."""
    vocabulary = encoder(tokenizer).tokenizer.get_vocab(with_added_tokens=True)
    ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
    for token, number in vocabulary.items():
        ends[number] = token.removesuffix("</w>").endswith((".", "!", "?"))
    return ends


def cut_windows(ends: np.ndarray, costs: np.ndarray, length: int) -> list[int]:
    """Indices of the cuts of least total cost; windows hold at most ``length`` ids.

    ``ends`` are the rising places where a cut may fall, ``costs`` their penalties; 0 is a cut, the
    last place is one too. No gap between neighbouring places exceeds ``length``.
    """
    places = [0, *ends.tolist()]
    penalty = [0, *costs.tolist()]
    best = [0] * len(places)
    came = [0] * len(places)
    queue: deque[int] = deque([0])
    for i in range(1, len(places)):
        place = places[i]
        while places[queue[0]] < place - length:
            queue.popleft()
        j = queue[0]
        came[i] = j
        # Padding is length - (place - places[j]); queue entries are ordered by best + place.
        best[i] = best[j] + length - place + places[j] + penalty[i]
        value = best[i] + place
        while queue and best[queue[-1]] + places[queue[-1]] >= value:
            queue.pop()
        queue.append(i)
    cuts = []
    i = len(places) - 1
    while i:
        cuts.append(i - 1)
        i = came[i]
    return cuts[::-1]


def last_windows(left: int, length: int) -> list[int]:
    """Sizes that hold the last ``left`` ids: padded, or split at powers of two where that is cheaper."""
    powers = [1 << bit for bit in range(left.bit_length() - 1, -1, -1) if left >> bit & 1]
    split = INNER_COST * (len(powers) - 1)
    return powers if split < length - left else [left]


@dataclass
class _Stream:
    """Ids that are not packed yet; document ``i`` has the ids between two bounds."""

    ids: list[np.ndarray]
    keys: list[int | None]
    sizes: list[int]  # ids of each document in the stream
    skipped: list[int]  # ids of each document that are packed already
    totals: list[int]  # ids of each whole document
    held: int = 0


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    length: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Pack all documents into sequences of at most ``length`` ids, one row per piece of a document.

    A document is the ids of its whole text and ``end_id`` (null and empty texts: ``end_id`` alone).
    Returns ``row_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, by ``with_ids``,
    ``ids``. Pieces of a sequence lie gapless from offset 0; a document's pieces follow each other.
    Order is kept within a read task, and only its last window is short, so nothing is shuffled.
    A sequence that is no power of two long is to be padded to ``length``.

    Null and repeated ids, ties and other columns change nothing: each row is a document. An empty
    table gives no piece. ``tokenizer`` is the path of a file that every executor has.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), text.cast("binary").alias("body"))
    return rows.mapInArrow(
        _pack(tokenizer, end_id, length, with_ids), _PIECES + (", ids binary" if with_ids else "")
    )


def _pack(tokenizer: str, end_id: int, length: int, with_ids: bool):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, stops = encoder(tokenizer), sentence_ends(tokenizer)
        number = TaskContext.get().partitionId() << 40
        held = _Stream([], [], [], [], [])
        for batch in stream:
            for texts in texts_of(batch["body"], 1 << 20):
                ids, bounds = coder.encode(texts)
                held.ids.append(np.insert(ids, bounds[1:], end_id).astype("<u4"))
                sizes = (np.diff(bounds) + 1).tolist()
                held.keys += batch["row_id"].slice(texts.first, len(texts)).to_pylist()
                held.sizes += sizes
                held.totals += sizes
                held.skipped += [0] * len(sizes)
                held.held += sum(sizes)
                if held.held >= PLANNED_WINDOWS * length:
                    pieces, number, held = _plan(held, stops, length, number, with_ids, last=False)
                    yield pieces
        if held.held:
            yield _plan(held, stops, length, number, with_ids, last=True)[0]

    return run


def _plan(held: _Stream, stops, length: int, number: int, with_ids: bool, last: bool):
    ids = np.concatenate(held.ids)
    bounds = np.concatenate([[0], np.cumsum(held.sizes)])
    cost = np.full(len(ids) + 1, -1, dtype=np.int64)
    cost[INNER_STEP :: INNER_STEP] = INNER_COST
    cost[1:][stops[np.minimum(ids, len(stops) - 1)]] = SENTENCE_COST
    cost[bounds[1:]] = 0
    ends = np.flatnonzero(cost[1:] >= 0) + 1
    cuts = ends[cut_windows(ends, cost[ends], length)]
    # The window up to the end of the stream is open until the stream ends.
    edges = np.concatenate([[0], cuts[:-1]])
    if last:
        tail = last_windows(int(len(ids) - edges[-1]), length)
        edges = np.concatenate([edges, edges[-1] + np.cumsum(tail)])
    packed = int(edges[-1])
    marks = np.union1d(edges, bounds[bounds <= packed])
    low, high = marks[:-1], marks[1:]
    doc = np.searchsorted(bounds, low, side="right") - 1
    window = np.searchsorted(edges, low, side="right") - 1
    raw = memoryview(ids.tobytes())
    parts = [raw[4 * a : 4 * b] for a, b in zip(low.tolist(), high.tolist())]
    keys = pa.array(held.keys, pa.int64())
    columns = {
        "row_id": keys.take(pa.array(doc)),
        "start": pa.array(low - bounds[doc] + np.array(held.skipped, dtype=np.int64)[doc]),
        "length": pa.array(high - low),
        "ids_crc32": pa.array([zlib.crc32(part) for part in parts], pa.int64()),
        "doc_tokens": pa.array(np.array(held.totals, dtype=np.int64)[doc]),
        "sequence_id": pa.array(number + window),
        "offset": pa.array(low - edges[window]),
    }
    if with_ids:
        columns["ids"] = pa.array([bytes(part) for part in parts], pa.binary())
    pieces = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    first = int(np.searchsorted(bounds, packed, side="right")) - 1
    rest = _Stream([ids[packed:]], held.keys[first:], held.sizes[first:], held.skipped[first:], held.totals[first:])
    if rest.sizes:
        done = packed - int(bounds[first])
        rest.sizes[0] -= done
        rest.skipped[0] += done
    rest.held = len(ids) - packed
    return pieces, number + len(edges) - 1, rest
