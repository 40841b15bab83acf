"""Substring dedup on bytes with suffix arrays built by linear grouping.

Every window of ``window`` bytes picks the smallest gram of ``SEED_BYTES`` bytes in it as its seed, so
equal windows have equal seeds; neighbouring windows with one seed form a run. Equal runs of a seed
repeat as a whole. A seed's differing runs go to one task with their bytes; of a more frequent seed the
windows go out by two hashes instead, and equal ones meet in a sorted stream. In a task the bytes are cut into
short blocks at places their content chooses, and a suffix array over the blocks tells for every
block how far the text from it repeats: that settles all windows but those at the edge of a repeat, where
the windows themselves are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from anomaloom.llm.hashing import (
    BASE_A,
    BASE_B,
    BYTES_A,
    BYTES_B,
    U64,
    RangeHashes,
    anchor_runs,
    digest_long,
    gram_hashes,
    mix,
    texts_of,
)
from anomaloom.llm.rows import keyed_texts, same_row, whole_groups, with_splits
from anomaloom.llm.suffix_array import longest_repeats, suffix_array
from anomaloom.session import stage

SEED_BYTES = 32
#: Differing runs of one seed in a task; a more frequent seed is split into window hashes.
SEED_RUNS = 20_000
#: Bytes of pieces, and windows of split seeds, that are collected before they are sent.
PIECE_BYTES = 1 << 26
WINDOWS = 1 << 19
#: A block ends where the hash of its last bytes says so, once in so many bytes.
_BLOCK_BYTES = 48
_BLOCK_LOOK = 8

_KEYS = [("row_id", pa.int64()), ("row_hash", pa.int64())]
_RUNS_ARROW = pa.schema(
    [
        ("seed", pa.int64()),
        ("run", pa.int64()),
        *_KEYS,
        ("start", pa.int32()),
        ("n", pa.int32()),
        ("twice", pa.bool_()),
        ("span", pa.bool_()),
    ]
)
_RUNS = "seed long, run long, row_id long, row_hash long, start int, n int, twice boolean, span boolean"
_SPANS_ARROW = pa.schema([*_KEYS, ("start", pa.int32()), ("n", pa.int32())])
_SPANS = "row_id long, row_hash long, start int, n int"
# Kinds of rows, in the order in which a task reads them: a span that is settled, a window of a split
# seed by its two hashes (task and check), the bytes of a run.
_FOUND, _WINDOW, _PIECE = range(3)
_PIECES_ARROW = pa.schema(
    [
        ("kind", pa.int32()),
        ("task", pa.int64()),
        ("check", pa.int64()),
        *_KEYS,
        ("start", pa.int32()),
        ("n", pa.int32()),
        ("twice", pa.bool_()),
        ("piece", pa.binary()),
    ]
)
_PIECES = (
    "kind int, task long, check long, row_id long, row_hash long, start int, n int, twice boolean, piece binary"
)
_RESULT = "row_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_byte_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 400,
    seed_runs: int = SEED_RUNS,
    with_text: bool = True,
) -> DataFrame:
    """Remove every byte covered by a ``window``-byte string that also starts anywhere else.

    Texts are their UTF-8 bytes; matches never cross documents; overlaps count; strings are judged on
    the input, so all copies of a repeat go. Returns ``row_id`` (the id), ``n_bytes``, ``n_removed``,
    ``n_spans`` (maximal removed runs), ``kept_sha256`` and, by ``with_text``, ``kept`` (the bytes that
    stay, which may end inside a character), one row per input row.

    Null and empty texts have no bytes. Null ids are allowed; rows that share an id are told apart by their
    text, and rows equal in both are copies of each other. An empty table gives an empty result;
    other columns are not read.
    """
    texts = keyed_texts(docs, id_col, text_col)
    runs = texts.mapInArrow(_runs(window), _RUNS)
    route = F.when(F.col("span"), F.xxhash64("row_hash", "start")).otherwise(F.col("seed"))
    matched = runs.repartition(route).sortWithinPartitions("seed", "run").mapInArrow(_match_runs, _RUNS)
    matched = stage(matched, "matched")
    asked = matched.where(~F.col("span"))
    wishes = (
        with_splits(asked, seed_runs)
        .groupBy("row_id", "row_hash")
        .agg(F.collect_set(F.struct("seed", "start", "n", "twice", "splits")).alias("wishes"))
    )
    pieces = (
        wishes.join(texts, same_row(wishes, texts))
        .select(wishes["row_id"], wishes["row_hash"], "wishes", "body")
        .mapInArrow(_pieces(window), _PIECES)
    )
    within = (
        pieces.repartition("task").sortWithinPartitions("kind", "task", "check").mapInArrow(_match_pieces(window), _SPANS)
    )
    spans = matched.where("span").select("row_id", "row_hash", "start", "n").unionByName(within)
    removed = spans.groupBy("row_id", "row_hash").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    whole = texts.join(removed, same_row(texts, removed), "left").select(texts["row_id"], "body", "spans")
    return whole.mapInArrow(_cut(window, with_text), _RESULT + (", kept binary" if with_text else ""))


def _runs(window: int):
    """Runs of every text. Of the equal runs of a batch one goes on, as one that occurs twice."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            parts = []
            for texts in texts_of(batch["body"]):
                symbols = BYTES_A[texts.data]
                text = np.repeat(np.arange(len(texts)), np.diff(texts.bounds))
                grams = gram_hashes(symbols, SEED_BYTES, BASE_A)
                anchor, first, last = anchor_runs(grams, window - SEED_BYTES + 1, texts.bounds[1:] - window, text)
                content = digest_long(RangeHashes(BYTES_B[texts.data], BASE_B).of(first, last + window), texts.data, first, last + window)
                owner = text[first]
                parts.append(
                    (
                        grams[anchor].view(np.int64),
                        content.view(np.int64),
                        owner + texts.first,
                        first - texts.bounds[owner],
                        last - first + 1,
                    )
                )
            if not parts:
                continue
            seed, content, row, start, n = (np.concatenate(column) for column in zip(*parts))
            order = np.lexsort((content, seed))
            seed, content, row, start, n = (column[order] for column in (seed, content, row, start, n))
            again = np.zeros(len(seed), dtype=bool)
            again[1:] = (seed[1:] == seed[:-1]) & (content[1:] == content[:-1])
            twice = again.copy()
            twice[:-1] |= again[1:]
            keys = batch.select(["row_id", "row_hash"]).take(pa.array(row))
            yield _run_batch(keys, seed, content, start, n, twice, again)

    return run


def _run_batch(keys, seed, content, start, n, twice, span) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(seed),
            pa.array(content),
            keys["row_id"],
            keys["row_hash"],
            pa.array(start.astype(np.int32)),
            pa.array(n.astype(np.int32)),
            pa.array(twice),
            pa.array(span),
        ],
        schema=_RUNS_ARROW,
    )


def _match_runs(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by seed and run: spans of runs that occur twice, and one run of each kind that is
    asked for because its seed has other kinds.

    Keeps two rows between batches at most, so a seed of any frequency passes in bounded memory.
    """
    carried: pa.RecordBatch | None = None  # last row, if its run may go on
    held: pa.RecordBatch | None = None  # first kind of the seed, not known to have others yet
    last: tuple[int, int] | None = None
    for batch in _ended(stream):
        final = batch is None
        if not final:
            passed = batch["span"].to_numpy(zero_copy_only=False)
            if passed.any():
                yield batch.filter(batch["span"])
                batch = batch.filter(pa.array(~passed))
            if not batch.num_rows:
                continue
        rows = [part for part in (carried, batch) if part is not None]
        if not rows:
            continue
        batch = pa.concat_batches(rows) if len(rows) > 1 else rows[0]
        carried = None
        seed, content = batch["seed"].to_numpy(), batch["run"].to_numpy()
        same = np.zeros(len(seed), dtype=bool)
        again = np.zeros(len(seed), dtype=bool)
        same[1:] = seed[1:] == seed[:-1]
        again[1:] = same[1:] & (content[1:] == content[:-1])
        if last is not None:
            same[0] = seed[0] == last[0]
            again[0] = same[0] and content[0] == last[1]
        if not final and not again[-1]:
            # The last run may go on in the next batch.
            carried, batch = batch.slice(len(seed) - 1), batch.slice(0, len(seed) - 1)
            next_again = again[1:].copy()
            seed, content, same, again = seed[:-1], content[:-1], same[:-1], again[:-1]
        else:
            next_again = np.concatenate([again[1:], [False]])
        if not batch.num_rows:
            continue
        last = (int(seed[-1]), int(content[-1]))
        twice = batch["twice"].to_numpy(zero_copy_only=False) | again | next_again
        if twice.any():
            yield _marked(batch, twice, span=True)
        kinds = np.flatnonzero(~again)
        if not len(kinds):
            continue
        first_of_seed = ~same[kinds]
        asked = ~first_of_seed
        asked[:-1] |= ~first_of_seed[1:]
        if held is not None and not first_of_seed[0]:
            yield held
        held = None
        if first_of_seed[-1]:
            asked[-1] = False
            held = _row(batch, int(kinds[-1]), bool(twice[kinds[-1]]))
        if asked.any():
            chosen = np.zeros(batch.num_rows, dtype=bool)
            chosen[kinds[asked]] = True
            yield _marked(batch, chosen, span=False, twice=twice)


def _ended(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from stream
    yield None


def _marked(batch: pa.RecordBatch, chosen: np.ndarray, span: bool, twice: np.ndarray | None = None) -> pa.RecordBatch:
    part = batch.filter(pa.array(chosen))
    marks = np.ones(part.num_rows, dtype=bool) if twice is None else twice[chosen]
    return _run_batch(
        part,
        part["seed"].to_numpy(),
        part["run"].to_numpy(),
        part["start"].to_numpy(),
        part["n"].to_numpy(),
        marks,
        np.full(part.num_rows, span),
    )


def _row(batch: pa.RecordBatch, at: int, twice: bool) -> pa.RecordBatch:
    chosen = np.zeros(batch.num_rows, dtype=bool)
    chosen[at] = True
    return _marked(batch, chosen, span=False, twice=np.full(batch.num_rows, twice))


def _pieces(window: int):
    """The bytes of the runs asked for; the hashes of their windows where a seed is split."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            keys = batch.select(["row_id", "row_hash"])
            pieces: list[tuple] = []
            windows: list[tuple] = []
            size = count = 0
            for row, (body, wishes) in enumerate(zip(batch["body"], batch["wishes"])):
                data = body.as_py()
                for wish in wishes.as_py():
                    piece = data[wish["start"] : wish["start"] + wish["n"] + window - 1]
                    if wish["splits"] == 1:
                        pieces.append((wish["seed"], row, wish["start"], wish["twice"], piece))
                        size += len(piece)
                    else:
                        windows.append((row, wish["start"], wish["twice"], *_window_hashes(piece, window)))
                        count += wish["n"]
                    if size >= PIECE_BYTES:
                        yield _piece_batch(keys, pieces)
                        pieces, size = [], 0
                    if count >= WINDOWS:
                        yield from _window_batches(keys, windows)
                        windows, count = [], 0
            if pieces:
                yield _piece_batch(keys, pieces)
            if windows:
                yield from _window_batches(keys, windows)

    return run


def _piece_batch(keys: pa.RecordBatch, pieces: list[tuple]) -> pa.RecordBatch:
    task, row, start, twice, piece = zip(*pieces)
    keys = keys.take(pa.array(row))
    n = len(row)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n, _PIECE, dtype=np.int32)),
            pa.array(task, pa.int64()),
            pa.array(np.zeros(n, dtype=np.int64)),
            keys["row_id"],
            keys["row_hash"],
            pa.array(start, pa.int32()),
            pa.array(np.ones(n, dtype=np.int32)),
            pa.array(twice, pa.bool_()),
            pa.array(piece, pa.binary()),
        ],
        schema=_PIECES_ARROW,
    )


def _window_hashes(piece: bytes, window: int) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(piece, dtype=np.uint8)
    return gram_hashes(BYTES_A[data], window, BASE_A), gram_hashes(BYTES_B[data], window, BASE_B)


def _window_batches(keys: pa.RecordBatch, windows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Of equal windows one goes on, to stand against others; the others are spans already."""
    rows, starts, marks, hashes, checks = zip(*windows)
    sizes = np.array([len(a) for a in hashes])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row, start = np.array(rows)[owner], np.array(starts)[owner] + offset
    a, b = np.concatenate(hashes).view(np.int64), np.concatenate(checks).view(np.int64)
    order = np.lexsort((b, a))
    again = np.zeros(len(order), dtype=bool)
    again[1:] = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
    several = again.copy()
    several[:-1] |= again[1:]
    equal = np.zeros(len(order), dtype=bool)
    equal[order] = several
    twice = np.array(marks)[owner]
    found = np.flatnonzero(equal & ~twice)
    if len(found):
        # Neighbouring windows of one run grow together.
        joined = np.zeros(len(found), dtype=bool)
        joined[1:] = (found[1:] == found[:-1] + 1) & (owner[found][1:] == owner[found][:-1])
        first = np.flatnonzero(~joined)
        n = np.diff(np.concatenate([first, [len(found)]]))
        first = found[first]
        marks_hash = keys["row_hash"].to_numpy()[row[first]].view(U64)
        task = mix(marks_hash + start[first].astype(U64) * U64(BASE_A)).view(np.int64)
        yield _hash_batch(keys, _FOUND, task, np.zeros(len(first), dtype=np.int64), row[first], start[first], n, twice[first])
    on = order[~again]
    ones = np.ones(len(on), dtype=np.int32)
    yield _hash_batch(keys, _WINDOW, a[on], b[on], row[on], start[on], ones, (twice | equal)[on])


def _hash_batch(keys: pa.RecordBatch, kind: int, task, check, row, start, n, twice) -> pa.RecordBatch:
    keys = keys.take(pa.array(row))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(row), kind, dtype=np.int32)),
            pa.array(task),
            pa.array(check),
            keys["row_id"],
            keys["row_hash"],
            pa.array(start.astype(np.int32)),
            pa.array(n.astype(np.int32)),
            pa.array(twice),
            pa.nulls(len(row), pa.binary()),
        ],
        schema=_PIECES_ARROW,
    )


def _match_pieces(window: int):
    """Rows sorted by kind, task and check: found spans, then windows by their hashes, then pieces."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = iter(stream)
        rest: Iterator[pa.RecordBatch] = iter(())
        held: pa.RecordBatch | None = None  # last window, the next may equal it
        known = False  # whether the window before it does
        for batch in stream:
            kinds = batch["kind"].to_numpy()
            low, high = np.searchsorted(kinds, [_WINDOW, _PIECE])
            if low:
                yield batch.slice(0, low).select(_SPANS_ARROW.names)
            if high > low:
                part = batch.slice(low, high - low).select([*_SPANS_ARROW.names, "task", "check", "twice"])
                part = part if held is None else pa.concat_batches([held, part])
                again = _again(part, known)
                yield from _equal_windows(part.slice(0, part.num_rows - 1), again[:-1] | again[1:])
                held, known = part.slice(part.num_rows - 1), bool(again[-1])
            if high < len(kinds):
                rest = chain([batch.slice(high)], stream)
                break
        if held is not None:
            yield from _equal_windows(held, np.array([known]))
        for table in whole_groups(rest, "task", 2_000):
            yield from _match_table(table, window)

    return run


def _again(part: pa.RecordBatch, known: bool) -> np.ndarray:
    """Which windows equal the one before; ``known`` says it of the first."""
    a, b = part["task"].to_numpy(), part["check"].to_numpy()
    return np.concatenate([[known], (a[1:] == a[:-1]) & (b[1:] == b[:-1])])


def _equal_windows(part: pa.RecordBatch, equal: np.ndarray) -> Iterator[pa.RecordBatch]:
    hit = equal & ~part["twice"].to_numpy(zero_copy_only=False)
    if hit.any():
        yield part.select(_SPANS_ARROW.names).filter(pa.array(hit))


def _match_table(table: pa.Table, window: int) -> Iterator[pa.RecordBatch]:
    piece, offset = repeated_windows(table["piece"].to_pylist(), table["task"].to_numpy(), window)
    # Runs that occur twice are spans already; they only stand against the others.
    fresh = ~table["twice"].to_numpy()[piece]
    piece, offset = piece[fresh], offset[fresh]
    if not len(piece):
        return
    grows = np.zeros(len(piece), dtype=bool)
    grows[1:] = (piece[1:] == piece[:-1]) & (offset[1:] == offset[:-1] + 1)
    first = np.flatnonzero(~grows)
    n = np.diff(np.concatenate([first, [len(piece)]]))
    keys = table.select(["row_id", "row_hash"]).take(pa.array(piece[first]))
    start = table["start"].to_numpy()[piece[first]] + offset[first]
    yield from pa.Table.from_arrays(
        [keys["row_id"], keys["row_hash"], pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))],
        schema=_SPANS_ARROW,
    ).to_batches()


def repeated_windows(pieces: list[bytes], task: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """``(piece, offset)`` of the windows that another window of the same task equals, in order."""
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    starts, chosen = _blocks(data, bounds)
    reach = _reach(data, bounds, starts)
    owner = np.repeat(np.arange(len(pieces)), np.maximum(sizes - window + 1, 0))
    count = np.concatenate([[0], np.cumsum(np.maximum(sizes - window + 1, 0))])
    at = bounds[owner] + np.arange(len(owner)) - count[owner]
    end = at + window
    block = np.searchsorted(starts, at, side="right") - 1
    sure = reach[block] >= end
    # Block starts that the window's own content chose; equal windows have the same.
    inner = np.searchsorted(chosen, at + _BLOCK_LOOK, side="left")
    outer = np.searchsorted(chosen, end, side="right") - 1
    has_inner = inner < outer
    if len(chosen):
        first = chosen[np.minimum(inner, len(chosen) - 1)]
        last = chosen[np.maximum(outer, 0)]
        reached = reach[np.searchsorted(starts, first)] >= last
        open_ = sure | ~has_inner | reached
    else:
        open_ = np.ones(len(at), dtype=bool)
    at, end, owner = at[open_], end[open_], owner[open_]
    a = RangeHashes(BYTES_A[data], BASE_A).of(at, end)
    b = RangeHashes(BYTES_B[data], BASE_B).of(at, end)
    # One sort key: windows of different tasks differ anyway, as their seeds do.
    order = np.argsort(a)
    x, y = a[order], b[order]
    same = x[1:] == x[:-1]
    if (same & (y[1:] != y[:-1])).any():
        order = np.lexsort((b, a))
        x, y = a[order], b[order]
        same = x[1:] == x[:-1]
    same &= y[1:] == y[:-1]
    hit = np.zeros(len(at), dtype=bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return owner[hit], at[hit] - bounds[owner[hit]]


def _blocks(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all blocks, and of those that the bytes before them chose inside their piece."""
    looked = gram_hashes(BYTES_A[data], _BLOCK_LOOK, BASE_B)
    chosen = np.flatnonzero(looked < U64((1 << 64) // _BLOCK_BYTES)) + _BLOCK_LOOK
    chosen = chosen[chosen < len(data)]
    piece = np.searchsorted(bounds, chosen, side="right") - 1
    chosen = chosen[chosen - bounds[piece] >= _BLOCK_LOOK]
    return np.union1d(chosen, bounds[:-1]), chosen


def _reach(data: np.ndarray, bounds: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For every block the place up to which the text from it occurs elsewhere too (whole blocks)."""
    ends = np.concatenate([starts[1:], [len(data)]])
    content = RangeHashes(BYTES_B[data], BASE_A).of(starts, ends)
    names = np.unique(content, return_inverse=True)[1]
    # A symbol of its own behind every piece ends all repeats there.
    piece = np.searchsorted(bounds, starts, side="right") - 1
    place = np.arange(len(starts)) + piece
    symbols = np.empty(len(starts) + piece[-1] + 1, dtype=np.int64)
    filled = np.zeros(len(symbols), dtype=bool)
    filled[place] = True
    symbols[place] = names
    symbols[~filled] = len(names) + np.arange(np.count_nonzero(~filled))
    longest = longest_repeats(symbols, suffix_array(symbols))[place]
    return np.concatenate([starts, [len(data)]])[np.arange(len(starts)) + longest]


def _cut(window: int, with_text: bool):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            out: dict[str, list] = {name: [] for name in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
            kept_texts = []
            for body, spans in zip(batch["body"], batch["spans"]):
                data, found = body.as_py(), spans.as_py() or ()
                kept, at, count = [], 0, 0
                # Spans that touch or overlap are one removed run.
                for start, n in sorted((span["start"], span["n"]) for span in found):
                    if start > at or not count:
                        kept.append(data[at:start])
                        count += 1
                    at = max(at, start + n + window - 1)
                kept.append(data[at:])
                stays = b"".join(kept)
                out["n_bytes"].append(len(data))
                out["n_removed"].append(len(data) - len(stays))
                out["n_spans"].append(count)
                out["kept_sha256"].append(hashlib.sha256(stays).hexdigest())
                kept_texts.append(stays)
            columns = [batch["row_id"], *(pa.array(values) for values in out.values())]
            names = ["row_id", *out]
            if with_text:
                columns.append(pa.array(kept_texts, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run
