"""Token ids of whole texts by a public tokenizer, equal to encoding each text in one call.

A byte-pair tokenizer splits a text before it merges, and never merges across a split. So a text
is cut at places where the tokenizer splits in any case, every distinct piece is encoded once, and
ids are gathered by piece. Texts where a cut could change the ids (special strings, white space
beyond ASCII) are encoded whole.
"""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache

import numpy as np

from anomaloom.llm.hashing import BASE_B, BYTES_A, U64, RangeHashes, Texts, digest_long

_SLOTS = 1 << 20
_POOL_IDS = 8 << 20
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {byte: chr(byte) for byte in plain}
    others = (byte for byte in range(256) if byte not in letters)
    return {**letters, **{byte: chr(256 + i) for i, byte in enumerate(others)}}


_LETTERS = _byte_letters()


class TokenIds:
    """Encoder of one tokenizer file, with a bounded store of pieces it has seen."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # Tokenizers without a normaliser keep white space; the others here drop it and case.
        self.keeps_space = self.tokenizer.normalizer is None
        self.keys = np.zeros(_SLOTS, dtype=U64)
        self.at = np.zeros(_SLOTS, dtype=np.int64)
        self.size = np.zeros(_SLOTS, dtype=np.int64)
        self.pool = np.zeros(_POOL_IDS, dtype=np.uint32)
        self.used = 0
        self.parts: dict[str, list[int]] = {}

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the bounds that cut them into texts."""
        if not len(texts.data):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(texts) + 1, dtype=np.int64)
        starts, ends, text = self._pieces(texts)
        odd = _irregular(texts)
        keep = ~odd[text]
        starts, ends, text = starts[keep], ends[keep], text[keep]
        ids, bounds = self._gather(texts, starts, ends, text)
        if not odd.any():
            return ids, bounds
        whole = []
        for i in range(len(texts)):
            if odd[i]:
                raw = texts.data[texts.bounds[i] : texts.bounds[i + 1]].tobytes().decode()
                whole.append(np.array(self.tokenizer.encode(raw, add_special_tokens=False).ids, dtype=np.uint32))
            else:
                whole.append(ids[bounds[i] : bounds[i + 1]])
        return np.concatenate(whole), np.concatenate([[0], np.cumsum([len(w) for w in whole])])

    def _pieces(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.keeps_space:
            return texts.words()
        data, n = texts.data, len(texts.data)
        space = ((data >= 9) & (data <= 13)) | (data == 32)
        opens = np.zeros(n + 1, dtype=bool)
        opens[texts.bounds] = True
        last = np.zeros(n, dtype=bool)  # the last white space before a word
        last[:-1] = space[:-1] & ~space[1:] & ~opens[1:-1]
        cut = opens[:-1].copy()
        cut[1:] |= space[1:] & ~space[:-1]
        cut |= last
        # A blank goes with the word after it; other white space does not.
        cut[1:] |= ~space[1:] & space[:-1] & (data[:-1] != 32)
        starts = np.flatnonzero(cut)
        ends = np.concatenate([starts[1:], [n]])
        return starts, ends, np.searchsorted(texts.bounds, starts, side="right") - 1

    def _gather(self, texts: Texts, starts, ends, text) -> tuple[np.ndarray, np.ndarray]:
        hashes = digest_long(RangeHashes(BYTES_A[texts.data], BASE_B).of(starts, ends), texts.data, starts, ends)
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at, size, pool = self._look_up(texts, distinct, starts[first], ends[first])
        lengths = size[back]
        total = np.concatenate([[0], np.cumsum(lengths)])
        index = np.repeat(at[back] - total[:-1], lengths) + np.arange(total[-1])
        per_text = np.bincount(text, weights=lengths, minlength=len(texts)).astype(np.int64)
        return pool[index], np.concatenate([[0], np.cumsum(per_text)])

    def _look_up(self, texts: Texts, distinct, starts, ends) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slots = (distinct >> U64(64 - 20)).astype(np.int64)
        at, size = self.at[slots], self.size[slots]
        missing = np.flatnonzero(self.keys[slots] != distinct)
        if not len(missing):
            return at, size, self.pool
        raw = texts.data.tobytes()
        new = [self._ids(raw[s:e].decode()) for s, e in zip(starts[missing].tolist(), ends[missing].tolist())]
        sizes = np.array([len(ids) for ids in new], dtype=np.int64)
        flat = np.fromiter((i for ids in new for i in ids), dtype=np.uint32, count=int(sizes.sum()))
        places = self.used + np.concatenate([[0], np.cumsum(sizes)[:-1]])
        at[missing], size[missing] = places, sizes
        if self.used + len(flat) > _POOL_IDS:
            # The store is full: this call's pieces lie behind it, and it starts anew after the call.
            used, self.used = self.used, 0
            self.keys[:] = 0
            return at, size, np.concatenate([self.pool[:used], flat])
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        kept = slots[missing]
        self.keys[kept], self.at[kept], self.size[kept] = distinct[missing], places, sizes
        return at, size, self.pool

    def _ids(self, piece: str) -> list[int]:
        """Ids of a piece: by the model alone where it is a word and marks, else by the whole tokenizer."""
        blank = " " if self.keeps_space and piece[:1] == " " else ""
        body = piece[len(blank) :]
        word = body.rstrip(_MARKS)
        marks = body[len(word) :]
        if not word.isalpha() or (not self.keeps_space and not _plain(word)):
            return self.tokenizer.encode(piece, add_special_tokens=False).ids
        found = self._part(blank + (word if self.keeps_space else word.lower()))
        return found + self._part(marks) if marks else found

    def _part(self, part: str) -> list[int]:
        ids = self.parts.get(part)
        if ids is None:
            letters = part if part.isascii() and part[0] != " " else "".join(map(_LETTERS.get, part.encode()))
            ids = [token.id for token in self.model.tokenize(letters)]
            if len(self.parts) >= 200_000:
                self.parts.clear()
            self.parts[part] = ids
        return ids


def _plain(word: str) -> bool:
    """Lower case is the same by letter and by word, and composition changes nothing."""
    return word.isascii() or (max(word) < "İ" and unicodedata.is_normalized("NFC", word))


def _irregular(texts: Texts) -> np.ndarray:
    """Texts with white space beyond ASCII or what may be a special string."""
    data = texts.data
    padded = np.concatenate([data, np.zeros(2, dtype=np.uint8)])
    b, c = padded[1:-1], padded[2:]
    lead = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3) | (data == 0x3C))
    a, b, c = data[lead], b[lead], c[lead]
    odd = (a == 0x3C) & (b == 0x7C)
    odd |= (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    odd |= (a == 0xE1) & (b == 0x9A)
    odd |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    odd |= (a == 0xE2) & (b == 0x81) & (c == 0x9F)
    odd |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
    found = np.zeros(len(texts), dtype=bool)
    found[np.searchsorted(texts.bounds, lead[odd], side="right") - 1] = True
    return found


@lru_cache(maxsize=4)
def encoder(path: str) -> TokenIds:
    """The encoder of a worker process; tasks that follow in the process find its pieces."""
    return TokenIds(path)
