"""Spelling variants of a corpus vocabulary by reduced-alphabet generation.

The letters of a word are hashed to a few symbols. Two words that differ by one edit have reduced words
that differ by at most one, so the full one-edit neighbourhood of every reduced word is generated and
joined with the reduced vocabulary; the words behind a joined pair are verified letter by letter.
Neighbourhoods are made as keys from running sums, never as strings, so a word may be of any length.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from anomaloom.session import stage

U64 = np.uint64
#: Letters of a word and occurrences in the corpus, at least.
LEAST_LETTERS = 6
LEAST_USES = 5
#: How many times as frequent a word's form must be.
FORM_FACTOR = 5
#: One in so many runs of a document loses a letter.
DAMAGE = 199
#: Distinct words that a task holds before it passes their counts on.
_HELD_WORDS = 400_000
_SLICE = 1 << 20
#: Neighbours that are laid out at a time.
_LAID_OUT = 1 << 21

# Latin-1 letters of runs: A-Z becomes a-z, U+00C0 to U+00FF stay, all else separates.
_RUN_BYTES = bytes(
    byte + 32 if 65 <= byte <= 90 else byte if 97 <= byte <= 122 or byte >= 0xC0 else 32 for byte in range(256)
)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def runs_of(text: str) -> Iterator[list[bytes]]:
    """The letter runs of a text as Latin-1 bytes (one per letter), in lists of bounded size."""
    # A character beyond Latin-1 turns to a question mark, which separates as the character does.
    plain = text.encode("latin-1", "replace").translate(_RUN_BYTES)
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + _SLICE)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def _damaged(run: bytes, start: int) -> bytes:
    """The run with a letter less where its checksum asks for it; ``start`` is that of the id's prefix."""
    mark = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if mark % DAMAGE:
        return run
    at = mark % len(run)
    return run[:at] + run[at + 1 :]


def _count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[bytes, int] = {}
    for batch in stream:
        for name, text in zip(batch["name"].to_pylist(), batch["text"]):
            start = zlib.crc32(f"{name}:".encode())
            for runs in runs_of(text.as_py()):
                for run, uses in Counter(runs).items():
                    if len(run) >= LEAST_LETTERS:
                        word = _damaged(run, start)
                        held[word] = held.get(word, 0) + uses
                if len(held) >= _HELD_WORDS:
                    yield _written(held)
                    held = {}
    yield _written(held)


def _written(held: dict[bytes, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())],
        names=["word", "n"],
    )


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n`` of all words with enough letters and occurrences; counts are combined in the tasks."""
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    parts = rows.mapInArrow(_count, "word string, n long")
    counted = parts.where(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= LEAST_USES)


def symbols_for(words: int) -> int:
    """Symbols of the reduced alphabet: as many as keep the words of one reduced word few."""
    return max(4, math.ceil(words**0.2))


def reduced(word: bytes, symbols: int) -> np.ndarray:
    """Symbols (from 1) of the letters of a Latin-1 word."""
    return np.frombuffer(word, dtype=np.uint8).astype(U64) % U64(symbols) + U64(1)


def _powers(size: int) -> np.ndarray:
    table = np.full(size, _BASE, dtype=U64)
    table[0] = 1
    return np.multiply.accumulate(table)


def _mixed(sums: np.ndarray, length: int) -> np.ndarray:
    """Keys of reduced words of ``length`` symbols from their sums; equal words have equal keys."""
    sums = (sums ^ (sums >> U64(29))) * U64(0xBF58476D1CE4E5B9) + U64(length)
    return (sums ^ (sums >> U64(32))).view(np.int64)


def own_key(word: np.ndarray) -> int:
    return int(_mixed(np.sum(word * _powers(len(word)), keepdims=True), len(word))[0])


def neighbourhood(word: np.ndarray, symbols: int) -> Iterator[np.ndarray]:
    """Keys of the reduced word itself and of all with one symbol replaced, deleted or inserted.

    In arrays of bounded size; keys are distinct within an array.
    """
    length = len(word)
    powers = _powers(length + 1)
    before = np.zeros(length + 1, dtype=U64)
    np.cumsum(word * powers[:length], out=before[1:])
    whole = before[-1]
    yield _mixed(np.array([whole], dtype=U64), length)
    letters = np.arange(1, symbols + 1, dtype=U64)
    step = max(1, _LAID_OUT // symbols)
    for low in range(0, length + 1, step):
        at = np.arange(low, min(length + 1, low + step))
        inside = at[at < length]
        left, rest = before[inside], whole - before[inside + 1]
        place = powers[at][:, None] * letters
        replaced = (left + rest)[:, None] + place[: len(inside)]
        inserted = (before[at] + (whole - before[at]) * U64(_BASE))[:, None] + place
        yield np.unique(
            np.concatenate(
                [
                    _mixed(left + rest * U64(_INVERSE), length - 1),
                    _mixed(replaced.ravel(), length),
                    _mixed(inserted.ravel(), length + 1),
                ]
            )
        )


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The vocabulary with the near words, the form and the root of every word.

    Returns ``word, form, root, n, n_near, form_n``. Two words are near if one letter replaced, deleted
    or inserted turns one into the other. The form is the most frequent near word (ties: the first in
    code-point order) if it is ``FORM_FACTOR`` times as frequent or more, else null. The root is the last
    form of the chain that starts at the word.

    A null or empty text has no words, a null id counts as '' in the checksums, equal rows count as
    often as they occur, texts are cut slice by slice (a run is never cut), an empty table gives an
    empty result, and other columns are not read. No near word is capped or left out.
    """
    words = stage(vocabulary(docs, id_col, text_col), "vocabulary")
    total = words.agg(F.count("*").alias("words"), F.max("n").alias("most")).first()
    symbols = symbols_for(total["words"])
    keyed = stage(words.mapInArrow(_keyed(symbols), "word string, n long, key long, short binary"), "reduced")
    # A key stands for one reduced word or, by chance, for several: all of them are expanded.
    shorts = keyed.select("key", "short").distinct()
    spread = shorts.mapInArrow(_spread(symbols), "key long, near_key long")
    known = shorts.select(F.col("key").alias("near_key")).distinct()
    met = spread.join(known, "near_key").distinct()
    left = keyed.select("key", "word", "n")
    right = keyed.select(F.col("key").alias("near_key"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    candidates = left.join(met, "key").join(right, "near_key").where(F.col("word") != F.col("near"))
    near = candidates.where(F.levenshtein("word", "near", 1) == 1)
    best = F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near")))
    formed = near.groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    is_form = -F.col("best.rank") >= FORM_FACTOR * F.col("n")
    found = stage(
        formed.select(
            "word",
            "n_near",
            F.when(is_form, F.col("best.near")).alias("form"),
            F.when(is_form, -F.col("best.rank")).alias("form_n"),
        ),
        "near-words",
    )
    roots = _roots(found.where(F.col("form").isNotNull()).select("word", "form"), total["most"] or 1)
    return (
        words.join(found, "word", "left")
        .join(roots, "word", "left")
        .select(
            "word",
            "form",
            F.coalesce("root", "word").alias("root"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            "form_n",
        )
    )


def _keyed(symbols: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            shorts = [reduced(word.encode("latin-1"), symbols) for word in batch["word"].to_pylist()]
            keys = pa.array([own_key(short) for short in shorts], pa.int64())
            body = pa.array([short.astype(np.uint8).tobytes() for short in shorts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["word"], batch["n"], keys, body], names=["word", "n", "key", "short"])

    return run


def _spread(symbols: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            held, rows = [], 0
            for key, short in zip(batch["key"].to_pylist(), batch["short"]):
                word = np.frombuffer(short.as_py(), dtype=np.uint8).astype(U64)
                for near in neighbourhood(word, symbols):
                    held.append((key, near))
                    rows += len(near)
                    if rows >= _LAID_OUT:
                        yield _laid_out(held)
                        held, rows = [], 0
            if held:
                yield _laid_out(held)

    return run


def _laid_out(held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    keys = np.repeat(np.array([key for key, _ in held], dtype=np.int64), [len(near) for _, near in held])
    return pa.RecordBatch.from_arrays(
        [pa.array(keys), pa.array(np.concatenate([near for _, near in held]))], names=["key", "near_key"]
    )


def _roots(forms: DataFrame, most: int) -> DataFrame:
    """Last form of every chain, by doubling: a form is ``FORM_FACTOR`` times as frequent as its word."""
    links = forms.select("word", F.col("form").alias("root"))
    length = max(1, math.ceil(math.log(max(most, 2), FORM_FACTOR)))
    for _ in range(math.ceil(math.log2(length)) + 1):
        further = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = stage(
            links.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots"
        )
    return links
