"""Byte-level BPE encoding and decoding by a rank table, with a segment tree per piece.

A piece's bytes are the leaves of a segment tree; a live leaf holds the rank of the pair that starts
there, with its place in the low bits, so the root is the leftmost pair of the smallest rank. A merge
updates the merged leaf, the one it takes in and the live neighbour before it: three paths to the root.
Trees of short pieces are laid out side by side and take their merges together.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: Pieces whose ids a worker keeps, and their length at most; a longer one is encoded each time.
_KEPT = 400_000
_KEPT_LENGTH = 64
#: Characters that are encoded at a time.
_SLICE = 1 << 21
#: Bytes of a piece whose tree is laid out beside others, and leaves that are laid out at a time.
_SHORT = 64
_LEAVES = 1 << 20
_NONE = 1 << 62
# The blanks of the pattern.
_BLANKS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# No piece holds a blank behind another character, so a text may be cut before every such blank.
_BORDER = re.compile(f"[^{_BLANKS}](?=[{_BLANKS}])")


def _latin_pattern(pattern: str) -> re.Pattern | None:
    """The pattern for texts within Latin-1, its classes of characters written out; None if it has others."""

    def listed(kinds: str) -> str:
        return "".join(f"\\x{c:02x}" for c in range(256) if unicodedata.category(chr(c))[0] == kinds)

    classes = {r"\p{L}": listed("L"), r"\p{N}": listed("N"), r"\s": r"\t-\r \x85\xa0"}
    parts = re.split(r"(\[[^\]]*\])", pattern)
    for i, part in enumerate(parts):
        for name, members in classes.items():
            part = part.replace(name, members if i % 2 else f"[{members}]")
        parts[i] = part.replace(r"\S", f"[^{classes[chr(92) + 's']}]")
    plain = "".join(parts)
    return None if re.search(r"\\[pPwWdDS]", plain) else re.compile(plain)


class BytePairs:
    """Encoder and decoder of one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.latin_pattern = _latin_pattern(pattern)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.decimals = {rank: str(rank) for rank in ranks.values()}
        self.parts: dict[str, tuple[int, ...]] = {}
        self.pairs, self.pair_ranks = self._pair_table()
        self.byte_ids = np.array([ranks[bytes([byte])] for byte in range(256)], dtype=np.int64)

    def _pair_table(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all pairs of tokens that make a token, ascending, and the ranks of those."""
        ranks = self.ranks
        self.width = max(ranks.values()) + 1
        found = {
            ranks[token[:i]] * self.width + ranks[token[i:]]: rank
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        }
        keys = np.array([*sorted(found), _NONE], dtype=np.int64)
        return keys, np.array([*(found[key] for key in keys[:-1].tolist()), 0], dtype=np.int64)

    def ids(self, piece: bytes) -> list[int]:
        """Ids of a piece: its own rank, or what merging leaves."""
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.merged(piece)

    def merged(self, piece: bytes) -> list[int]:
        ranks, n = self.ranks, len(piece)
        if not n:
            return []
        size = 1 << max(1, (n - 1).bit_length())
        shift = size.bit_length()
        mask = (1 << shift) - 1
        none = _NONE
        tree = [none] * (2 * size)
        for i in range(n - 1):
            rank = ranks.get(piece[i : i + 2])
            if rank is not None:
                tree[size + i] = rank << shift | i
        for node in range(size - 1, 0, -1):
            left, right = tree[2 * node], tree[2 * node + 1]
            tree[node] = left if left < right else right
        # ``after[i]`` is where the part at i ends and the next one starts; ``before`` leads back.
        after = list(range(1, n + 1))
        before = list(range(-1, n))

        def put(place: int, value: int) -> None:
            node = size + place
            tree[node] = value
            while node > 1:
                other = tree[node ^ 1]
                if other < value:
                    value = other
                node >>= 1
                if tree[node] == value:
                    return
                tree[node] = value

        def pair(place: int) -> int:
            middle = after[place]
            if middle >= n:
                return none
            rank = ranks.get(piece[place : after[middle]])
            return none if rank is None else rank << shift | place

        while tree[1] != none:
            at = tree[1] & mask
            gone = after[at]
            end = after[gone]
            after[at] = end
            if end < n:
                before[end] = at
            put(gone, none)
            put(at, pair(at))
            if at:
                put(before[at], pair(before[at]))
        found, at = [], 0
        while at < n:
            found.append(ranks[piece[at : after[at]]])
            at = after[at]
        return found

    def merged_together(self, pieces: list[bytes]) -> list[list[int]]:
        """As :meth:`merged` for many pieces of at most ``_SHORT`` bytes, trees of one size together."""
        out: list[list[int]] = [[] for _ in pieces]
        lengths = np.array([len(piece) for piece in pieces], dtype=np.int64)
        size = 2
        while size <= _SHORT:
            of_size = np.flatnonzero((lengths <= size) & (lengths > (size // 2 if size > 2 else 0)))
            for low in range(0, len(of_size), _LEAVES // size):
                chosen = of_size[low : low + _LEAVES // size]
                flat, bounds = self._merge_trees([pieces[i] for i in chosen], lengths[chosen], size)
                for i, start, end in zip(chosen.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                    out[i] = flat[start:end]
            size *= 2
        return out

    def _merge_trees(self, pieces: list[bytes], n: np.ndarray, size: int) -> tuple[list[int], np.ndarray]:
        count, shift = len(pieces), size.bit_length()
        places = np.arange(size)
        ids = self.byte_ids[np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), dtype=np.uint8)]
        ids = ids.reshape(count, size)
        after = np.repeat(places[None, :] + 1, count, axis=0)
        before = np.repeat(np.arange(-1, size)[None, :], count, axis=0)
        live = places < n[:, None]
        tree = np.full((count, 2 * size), _NONE, dtype=np.int64)
        ranks = self._ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(count, size - 1)
        paired = live[:, 1:] & (ranks >= 0)
        tree[:, size:-1][paired] = (ranks << shift | places[:-1])[paired]
        level = size
        while level > 1:
            np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2], out=tree[:, level // 2 : level])
            level //= 2

        def put(rows: np.ndarray, place: np.ndarray, values: np.ndarray | int) -> None:
            node = size + place
            tree[rows, node] = values
            for _ in range(shift - 1):
                node >>= 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        def pair(rows: np.ndarray, place: np.ndarray) -> np.ndarray:
            middle = after[rows, place]
            inside = middle < n[rows]
            rank = self._ranks(ids[rows, place], ids[rows, np.where(inside, middle, 0)])
            return np.where(inside & (rank >= 0), rank << shift | place, _NONE)

        rows = np.flatnonzero(tree[:, 1] != _NONE)
        while len(rows):
            least = tree[rows, 1]
            at = least & (2 * size - 1)
            gone = after[rows, at]
            end = after[rows, gone]
            ids[rows, at] = least >> shift
            live[rows, gone] = False
            after[rows, at] = end
            before[rows, end] = at
            put(rows, gone, _NONE)
            put(rows, at, pair(rows, at))
            inner = at > 0
            held, previous = rows[inner], before[rows, at][inner]
            put(held, previous, pair(held, previous))
            rows = rows[tree[rows, 1] != _NONE]
        return ids[live].tolist(), np.concatenate([[0], np.cumsum(live.sum(axis=1))])

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of every pair of tokens, -1 where they make none."""
        keys = left * self.width + right
        at = np.searchsorted(self.pairs, keys)
        return np.where(self.pairs[at] == keys, self.pair_ranks[at], -1)

    def encode_texts(self, texts: Iterable[str]) -> Iterator[tuple[int, list[int]]]:
        """``(number of the text, ids)`` for every slice of the texts, in order."""
        held, room = [], _SLICE
        for number, text in enumerate(texts):
            at, size = 0, len(text)
            while at < size:
                border = _BORDER.search(text, at + _SLICE) if at + _SLICE < size else None
                end = border.end() if border else size
                held.append((number, self.pieces(text, at, end)))
                room -= end - at
                at = end
                if room <= 0:
                    yield from self._encode(held)
                    held, room = [], _SLICE
        yield from self._encode(held)

    def pieces(self, text: str, start: int, end: int) -> list[str]:
        """The pieces of a slice that ends where the pattern cuts."""
        if self.latin_pattern is not None and _is_latin(text[start:end]):
            return self.latin_pattern.findall(text, start, end)
        return self.pattern.findall(text, start, end)

    def _encode(self, held: list[tuple[int, list[str]]]) -> Iterator[tuple[int, list[int]]]:
        if len(self.parts) >= _KEPT:
            self.parts.clear()
        parts = self.parts
        new = {piece for _, cut in held for piece in cut if piece not in parts}
        self._learn(new)
        for number, cut in held:
            yield number, list(chain.from_iterable(map(parts.__getitem__, cut)))
        for piece in new:
            if len(piece) > _KEPT_LENGTH:
                del parts[piece]

    def _learn(self, pieces: Iterable[str]) -> None:
        short: dict[bytes, str] = {}
        for piece in pieces:
            raw = piece.encode()
            if raw in self.ranks or len(raw) > _SHORT:
                self.parts[piece] = tuple(self.ids(raw))
            else:
                short[raw] = piece
        for piece, ids in zip(short.values(), self.merged_together(list(short))):
            self.parts[piece] = tuple(ids)

    def encode(self, text: str) -> list[int]:
        return [i for _, ids in self.encode_texts([text]) for i in ids]

    def written(self, ids: list[int]) -> str:
        """Decimal ids joined by a blank."""
        return " ".join(map(self.decimals.__getitem__, ids))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank of every token; a line holds the token in base 64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> BytePairs:
    """The encoder of a worker process; tasks that follow in the process find its pieces."""
    return BytePairs(read_ranks(path), pattern)


_DIGESTS = "row_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_digests(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Number and digest of the ids of every whole text, and digest of the bytes they decode to.

    Returns ``row_id`` (the id), ``n_tokens``, ``ids_sha256`` (decimal ids joined by a blank) and
    ``decoded_sha256``, one row per input row, without a shuffle. ``path`` is a rank file that every
    executor can read. Null and empty texts have no ids. A text of any length is encoded slice by slice,
    cut where the pattern cuts in any case. Null and repeated ids, equal rows, other columns and empty
    tables change nothing.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = encoder(path, pattern)
        for batch in stream:
            rows = batch.num_rows
            counts = [0] * rows
            written, decoded = ([hashlib.sha256() for _ in range(rows)] for _ in range(2))
            for number, ids in pairs.encode_texts(text.as_py() for text in batch["text"]):
                written[number].update((" " * bool(counts[number]) + pairs.written(ids)).encode())
                decoded[number].update(pairs.decode(ids))
                counts[number] += len(ids)
            yield pa.RecordBatch.from_arrays(
                [batch["row_id"], pa.array(counts, pa.int64()), *(pa.array([d.hexdigest() for d in digests]) for digests in (written, decoded))],
                names=["row_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, _DIGESTS)


def encode_ids(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row_id, ids``: the ids of every whole text, for use as they are; cases as in :func:`encode_digests`."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = encoder(path, pattern)
        for batch in stream:
            lists: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for number, ids in pairs.encode_texts(text.as_py() for text in batch["text"]):
                lists[number] += ids
            column = pa.array(lists, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch["row_id"], column], names=["row_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "row_id long, ids array<int>")


def decode_ids(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """``row_id, body``: the bytes of every row's ``ids``; null ids give a null."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = encoder(path, pattern)
        for batch in stream:
            body = [None if ids is None else pairs.decode(ids) for ids in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["row_id"], pa.array(body, pa.binary())], names=["row_id", "body"])

    return rows.select("row_id", "ids").mapInArrow(run, "row_id long, body binary")
