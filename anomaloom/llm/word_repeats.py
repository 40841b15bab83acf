"""Substring dedup by seed and extend.

Seeds are winnowed anchors: every window of ``window`` words picks its smallest gram of
``SEED_WORDS`` words, so equal windows have equal seeds at equal offsets. The neighbouring windows
that share a seed form a run, the seed extended both ways as far as the threshold looks. Documents
are joined on seeds; equal runs match as a whole, others are matched window by window, and
neighbouring matched windows grow together to maximal repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from anomaloom.llm.hashing import BASE_A, BASE_B, U64, RangeHashes, Texts, anchor_runs, gram_hashes, texts_of
from anomaloom.llm.rows import keyed_texts, same_row, whole_groups, with_splits
from anomaloom.session import stage

SEED_WORDS = 4
#: Differing runs of one seed that a task matches; a more frequent seed is split by window content.
SEED_RUNS = 20_000

_RUN_FIELDS = [
    ("seed", pa.int64()),
    ("run", pa.int64()),
    ("row_id", pa.int64()),
    ("row_hash", pa.int64()),
    ("start", pa.int32()),
    ("n", pa.int32()),
]
_RUNS = "seed long, run long, row_id long, row_hash long, start int, n int, found boolean"
_RUNS_ARROW = pa.schema([*_RUN_FIELDS, ("found", pa.bool_())])
_SPANS = "row_id long, row_hash long, start int, n int"
_SPANS_ARROW = pa.schema(_RUN_FIELDS[2:])
_PIECES = "task long, row_id long, row_hash long, start int, words binary"
_PIECES_ARROW = pa.schema(
    [
        ("task", pa.int64()),
        ("row_id", pa.int64()),
        ("row_hash", pa.int64()),
        ("start", pa.int32()),
        ("words", pa.binary()),
    ]
)
_RESULT = "row_id long, n_words long, n_removed long, kept_sha256 string"


def remove_word_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 20,
    seed_runs: int = SEED_RUNS,
    with_text: bool = True,
) -> DataFrame:
    """Remove every word covered by a window of ``window`` words that also starts earlier.

    Earlier means a smaller id, or an earlier word of the same document; windows are judged on the
    input. Returns ``row_id`` (the id), ``n_words``, ``n_removed``, ``kept_sha256`` and, by ``with_text``,
    ``kept``: the words that stay, joined by one blank, whose UTF-8 bytes are hashed. One row per input row.

    Words are runs of characters other than blank, tab, LF, VT, FF and CR, taken unchanged. Null and
    empty texts have no words. Rows without an id come first; rows that share an id are ordered by
    a hash of their text; rows equal in both count as one, and each is judged as that one. An empty
    table gives an empty result; other columns are not read.
    """
    texts = keyed_texts(docs, id_col, text_col)
    runs = texts.mapInArrow(_runs(window), _RUNS)
    # Spans that are settled already travel along by their row.
    route = F.when(F.col("found"), F.xxhash64("row_hash", "start")).otherwise(F.col("seed"))
    matched = (
        runs.repartition(route)
        .sortWithinPartitions("seed", "run", F.col("row_id").asc_nulls_first(), "row_hash", "start")
        .mapInArrow(_match_runs, _RUNS)
    )
    matched = stage(matched, "matched")
    asked = matched.where(~F.col("found"))
    wishes = (
        with_splits(asked, seed_runs)
        .groupBy("row_id", "row_hash")
        .agg(F.collect_set(F.struct("seed", "start", "n", "splits")).alias("wishes"))
    )
    pieces = (
        wishes.join(texts, same_row(wishes, texts))
        .select(wishes["row_id"], wishes["row_hash"], "wishes", "body")
        .mapInArrow(_pieces(window), _PIECES)
    )
    extended = (
        pieces.repartition("task").sortWithinPartitions("task").mapInArrow(_match_windows(window), _SPANS)
    )
    spans = matched.where("found").select("row_id", "row_hash", "start", "n").unionByName(extended)
    removed = spans.groupBy("row_id", "row_hash").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    whole = texts.join(removed, same_row(texts, removed), "left").select(texts["row_id"], "body", "spans")
    return whole.mapInArrow(_cut(window, with_text), _RESULT + (", kept string" if with_text else ""))


def _word_bounds(text: np.ndarray, count: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.bincount(text, minlength=count))])


def _text_runs(texts: Texts, window: int) -> tuple[np.ndarray, ...]:
    """Seed hash, run hash, text, start and length of the runs of some texts."""
    starts, ends, text = texts.words()
    hashes = texts.word_hashes(starts, ends, lower=False)
    bounds = _word_bounds(text, len(texts))
    grams = gram_hashes(hashes, SEED_WORDS, BASE_A)
    anchor, first, last = anchor_runs(grams, window - SEED_WORDS + 1, bounds[1:] - window, text)
    run = RangeHashes(hashes, BASE_B).of(first, last + window)
    return grams[anchor], run, text[first], first - bounds[text[first]], last - first + 1


def _order(*keys: np.ndarray) -> np.ndarray:
    return np.lexsort(keys[::-1])


def _runs(window: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            parts = []
            for texts in texts_of(batch["body"]):
                seed, content, text, start, n = _text_runs(texts, window)
                parts.append((seed.view(np.int64), content.view(np.int64), text + texts.first, start, n))
            if not parts:
                continue
            seed, content, row, start, n = (np.concatenate(column) for column in zip(*parts))
            ids, has_id, marks = _keys(batch)
            order = _order(seed, content, has_id[row], ids[row], marks[row], start)
            seed, content, row, start, n = (column[order] for column in (seed, content, row, start, n))
            # Of the equal runs of a batch the earliest goes on; the others are settled here.
            same = np.zeros(len(seed), dtype=bool)
            same[1:] = (seed[1:] == seed[:-1]) & (content[1:] == content[:-1])
            twin = _twins(same, has_id[row], ids[row], marks[row], start)
            keys = batch.select(["row_id", "row_hash"]).take(pa.array(row[~twin]))
            yield _run_batch(keys, *(column[~twin] for column in (seed, content, start, n, same)))

    return run


def _twins(same: np.ndarray, *occurrence: np.ndarray) -> np.ndarray:
    """Rows that are one occurrence with the first row of their content, read from an equal row.

    ``same`` tells which rows have the content of the row before.
    """
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(same)))) if len(same) else same.astype(np.int64)
    twin = same.copy()
    for column in occurrence:
        twin &= column == column[head]
    return twin


def _keys(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = batch["row_id"]
    return ids.fill_null(0).to_numpy(), np.asarray(ids.is_valid()), batch["row_hash"].to_numpy()


def _run_batch(keys, seed, content, start, n, found) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(seed),
            pa.array(content),
            keys["row_id"],
            keys["row_hash"],
            pa.array(start.astype(np.int32)),
            pa.array(n.astype(np.int32)),
            pa.array(found),
        ],
        schema=_RUNS_ARROW,
    )


def _match_runs(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by seed and run: later equal runs are found, first ones asked if the seed has others.

    Keeps one row between batches, so a seed of any frequency passes in bounded memory.
    """
    held: pa.RecordBatch | None = None  # first run of the seed, not known to have others yet
    last: tuple[int, int] | None = None
    head: tuple | None = None  # occurrence that opened the last run
    for batch in stream:
        passed = batch["found"].to_numpy(zero_copy_only=False)
        if passed.any():
            yield batch.filter(batch["found"])
            batch = batch.filter(pa.array(~passed))
        if not batch.num_rows:
            continue
        seed, content = batch["seed"].to_numpy(), batch["run"].to_numpy()
        same_seed = np.zeros(len(seed), dtype=bool)
        again = np.zeros(len(seed), dtype=bool)
        same_seed[1:] = seed[1:] == seed[:-1]
        again[1:] = same_seed[1:] & (content[1:] == content[:-1])
        if last is not None:
            same_seed[0] = seed[0] == last[0]
            again[0] = same_seed[0] and content[0] == last[1]
        last = (int(seed[-1]), int(content[-1]))
        ids, has_id, marks = _keys(batch)
        places = (has_id, ids, marks, batch["start"].to_numpy())
        opened = np.flatnonzero(again[: int(np.argmin(again))] if not again.all() else again)
        twin = _twins(again, *places)
        for i in opened:  # rows that go on with the run of the batch before
            twin[i] = tuple(place[i] for place in places) == head
        if not again.all():
            first = int(np.flatnonzero(~again)[-1])
            head = tuple(place[first] for place in places)
        found = again & ~twin
        if found.any():
            keep = batch.filter(pa.array(found))
            yield _run_batch(
                keep,
                keep["seed"].to_numpy(),
                keep["run"].to_numpy(),
                keep["start"].to_numpy(),
                keep["n"].to_numpy(),
                np.ones(keep.num_rows, dtype=bool),
            )
        classes = np.flatnonzero(~again)
        if not len(classes):
            continue
        heads = ~same_seed[classes]
        # A class is asked if it is not the first of its seed, or the next class has the same seed.
        asked = ~heads
        asked[:-1] |= ~heads[1:]
        if held is not None and not heads[0]:
            yield held
            held = None
        if heads[-1]:
            asked[-1] = False
            held = batch.slice(int(classes[-1]), 1)
        elif held is not None:
            held = None
        if asked.any():
            yield batch.take(pa.array(classes[asked]))


def _pieces(window: int):
    """The words (as hashes) of the runs asked for; windows one by one where a seed is split."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            columns: dict[str, list] = {field.name: [] for field in _PIECES_ARROW}
            wishes = batch["wishes"]
            for texts in texts_of(batch["body"]):
                starts, ends, text = texts.words()
                hashes = texts.word_hashes(starts, ends, lower=False)
                bounds = _word_bounds(text, len(texts))
                for i in range(len(texts)):
                    row = texts.first + i
                    for wish in wishes[row].as_py():
                        at, n = int(bounds[i]) + wish["start"], wish["n"]
                        words = hashes[at : at + n + window - 1]
                        for task, offset, part in _tasks(wish["seed"], wish["splits"], words, window):
                            columns["task"].append(task)
                            columns["row_id"].append(row)
                            columns["start"].append(wish["start"] + offset)
                            columns["words"].append(part.tobytes())
            if columns["task"]:
                keys = batch.select(["row_id", "row_hash"]).take(pa.array(columns["row_id"]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(columns["task"], pa.int64()),
                        keys["row_id"],
                        keys["row_hash"],
                        pa.array(columns["start"], pa.int32()),
                        pa.array(columns["words"], pa.binary()),
                    ],
                    schema=_PIECES_ARROW,
                )

    return run


def _tasks(seed: int, splits: int, words: np.ndarray, window: int) -> Iterator[tuple[int, int, np.ndarray]]:
    if splits == 1:
        yield seed, 0, words
        return
    for offset, content in enumerate(gram_hashes(words, window, BASE_A)):
        task = (seed + int(content % U64(splits)) * BASE_A) % (1 << 64)
        yield int(np.uint64(task).astype(np.int64)), offset, words[offset : offset + window]


def _match_windows(window: int):
    """Windows of a seed whose content starts earlier too, as spans."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(stream, "task", 5_000):
            words = table["words"].to_pylist()
            sizes = np.array([len(w) // 8 for w in words], dtype=np.int64)
            raw = np.frombuffer(b"".join(words), dtype=U64)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            piece = np.repeat(np.arange(len(sizes)), sizes)
            grams, check = gram_hashes(raw, window, BASE_A), gram_hashes(raw, window, BASE_B)
            at = np.flatnonzero(np.arange(len(grams)) <= bounds[1:][piece[: len(grams)]] - window)
            owner = piece[at]
            start = table["start"].to_numpy()[owner] + (at - bounds[owner])
            ids, has_id, marks = _keys(table)
            order = _order(grams[at], check[at], has_id[owner], ids[owner], marks[owner], start)
            a, b = grams[at][order], check[at][order]
            same = np.zeros(len(order), dtype=bool)
            same[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
            own = owner[order]
            hit = order[same & ~_twins(same, has_id[own], ids[own], marks[own], start[order])]
            if len(hit):
                # Neighbouring windows of one piece grow together.
                hit.sort()
                joined = np.zeros(len(hit), dtype=bool)
                joined[1:] = (at[hit][1:] == at[hit][:-1] + 1) & (owner[hit][1:] == owner[hit][:-1])
                first = np.flatnonzero(~joined)
                n = np.diff(np.concatenate([first, [len(hit)]]))
                keys = table.select(["row_id", "row_hash"]).take(pa.array(owner[hit[first]]))
                yield from pa.Table.from_arrays(
                    [
                        keys["row_id"],
                        keys["row_hash"],
                        pa.array(start[hit[first]].astype(np.int32)),
                        pa.array(n.astype(np.int32)),
                    ],
                    schema=_SPANS_ARROW,
                ).to_batches()

    return run


def _cut(window: int, with_text: bool):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": []}
            if with_text:
                out["kept"] = []
            spans = batch["spans"].to_pylist()
            for texts in texts_of(batch["body"]):
                starts, ends, text = texts.words()
                bounds = _word_bounds(text, len(texts))
                for i in range(len(texts)):
                    low, high = bounds[i], bounds[i + 1]
                    gone = np.zeros(high - low + 1, dtype=np.int64)
                    for span in spans[texts.first + i] or ():
                        gone[span["start"]] += 1
                        gone[min(span["start"] + span["n"] + window - 1, high - low)] -= 1
                    stay = np.flatnonzero(np.cumsum(gone[:-1]) == 0) + low
                    data = texts.data[texts.bounds[i] : texts.bounds[i + 1]].tobytes()
                    if len(stay) == high - low:
                        kept = b" ".join(data.split())
                    else:
                        base = int(texts.bounds[i])
                        kept = b" ".join(
                            data[a:b] for a, b in zip((starts[stay] - base).tolist(), (ends[stay] - base).tolist())
                        )
                    out["n_words"].append(int(high - low))
                    out["n_removed"].append(int(high - low - len(stay)))
                    out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                    if with_text:
                        out["kept"].append(kept.decode())
            yield pa.RecordBatch.from_arrays(
                [batch["row_id"], *(pa.array(values) for values in out.values())], names=["row_id", *out]
            )

    return run
