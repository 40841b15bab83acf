"""Secret scans by assignment-aware lexing.

Three fixed patterns give the base findings. Beside them, assignments of source and configuration
syntax are read as name-literal pairs, constants are carried to the names they are assigned to later,
and a literal is reported when a sensitive name receives it and it looks like a credential.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import accumulate
from string import ascii_lowercase, ascii_uppercase, digits

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# The base patterns, in the order in which findings of equal start are listed.
KINDS = ("assign", "access", "hex", "name")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
_ASSIGN_LEAST = 6
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_ACCESS_LEAST = 20
_HEX = re.compile(r"[0-9a-f]{24,}")
_ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")

# A name, perhaps with its type, and the operator behind it. Names, blanks and literals are taken
# possessively, so that text of any length is read once.
_TARGET = re.compile(
    r"""(?<![\w.$-])([A-Za-z_$][\w.$-]*+)["']?\]?[ \t]*+"""
    r"""(?::[ \t]*+[A-Za-z_][\w.<>\[\]]*+[ \t]*+(?==[^=])|)(:=|=>|=(?!=)|:(?![:/]))[ \t]*+""",
    re.ASCII,
)
_TERM = re.compile(
    r'''[A-Za-z]{0,2}"((?:[^"\\\n]|\\.)*+)"'''
    r"""|[A-Za-z]{0,2}'((?:[^'\\\n]|\\.)*+)'"""
    r"""|([^\s"',;(){}<>\[\]#])""",
    re.ASCII,
)
_BARE = re.compile(r"""[^\s"',;(){}<>\[\]#]++""", re.ASCII)
_PLUS = re.compile(r"[ \t]*+(?:\+|\.\.)[ \t]*+")
_REFERENCE = re.compile(r"\$\{?([A-Za-z_]\w*+)\}?|\{([A-Za-z_]\w*+)\}", re.ASCII)
_NAME_LIKE = re.compile(r"[\w.$-]++", re.ASCII)
#: Inside a bare value, values of further targets start behind these.
_OPERATOR_ENDS = re.compile(r"[=:]")
_NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_IDENTIFIER = re.compile(r"[A-Za-z_$][\w.$]*", re.ASCII)

# Parts of names, and how strongly they say that the value is secret.
_SENSITIVE = {
    "password": 2.0, "passwd": 2.0, "pwd": 2.0, "passphrase": 2.0, "passcode": 2.0, "secret": 2.0, "token": 2.0,
    "apikey": 2.0, "credential": 2.0, "credentials": 2.0, "bearer": 1.5, "authorization": 1.5, "auth": 1.0,
    "private": 1.0, "access": 1.0, "api": 1.0, "signing": 1.0, "encryption": 1.0, "client": 0.5, "account": 0.5,
    "key": 1.0, "salt": 1.0, "cert": 0.5, "session": 0.5, "pass": 1.5,
}
_PLACEHOLDERS = {
    "example", "changeme", "placeholder", "password", "secret", "token", "none", "null", "true", "false",
    "undefined", "redacted", "default", "string", "your", "xxx", "todo", "env", "test",
}
_LETTERS = re.compile(r"[a-z]+")
_KIND_OF = {c: kind for kind, group in enumerate((ascii_lowercase, ascii_uppercase, digits)) for c in group}
#: Least score (name plus literal) of a reported literal.
LEAST_SCORE = 3.5


_LONGEST_PLACEHOLDER = max(map(len, _PLACEHOLDERS))
#: Length from which letter counts are scaled down; only their ratios matter then.
_HUGE = 1e150


@dataclass
class Summary:
    """What the score of a text asks for, so that texts can be joined without writing them out.

    ``head`` and ``tail`` are the letters (a-z, after lower-casing) at both ends, cut a little above the
    longest placeholder; ``whole`` says that the text is nothing else.
    """

    size: float
    counts: dict[str, float] | None  # None: there are blanks
    first: str
    head: str
    tail: str
    whole: bool
    placeholder: bool

    @classmethod
    def of(cls, text: str) -> Summary:
        lowered = text.lower()
        words = [(m.start(), m.end(), m[0]) for m in _LETTERS.finditer(lowered)]
        head = words[0][2] if words and words[0][0] == 0 else ""
        tail = words[-1][2] if words and words[-1][1] == len(lowered) else ""
        inner = words[bool(head) : len(words) - bool(tail)]
        counts = None if any(c.isspace() for c in text) else {c: float(n) for c, n in Counter(text).items()}
        known = any(word in _PLACEHOLDERS for _, _, word in inner)
        return cls(float(len(text)), counts, text[:1], _cut(head), _cut(tail), len(head) == len(lowered), known)

    def extend(self, other: Summary) -> None:
        """Append a text."""
        if self.counts is None or other.counts is None:
            self.counts = None
        else:
            for c, n in other.counts.items():
                self.counts[c] = self.counts.get(c, 0.0) + n
        self.size += other.size
        if self.size > _HUGE and self.counts is not None:
            self.size /= _HUGE
            self.counts = {c: n / _HUGE for c, n in self.counts.items()}
            self.size = max(self.size, 1e9 * len(self.counts))
        self.placeholder |= other.placeholder
        if self.whole and other.whole:
            self.head = self.tail = _cut(self.head + other.head)
        elif self.whole:
            self.head, self.tail, self.whole = _cut(self.head + other.head), other.tail, False
        elif other.whole:
            self.tail = _cut(self.tail + other.head)
        else:
            self.placeholder |= self.tail + other.head in _PLACEHOLDERS
            self.tail = other.tail

    def copy(self) -> Summary:
        return replace(self, counts=None if self.counts is None else dict(self.counts))

    def score(self) -> float:
        """From 0 (a word, a placeholder, too short) to 3 (long and random)."""
        if self.size < 6 or self.counts is None or self.first in "<$%{" or len(self.counts) < 5:
            return 0.0
        if self.placeholder or self.head in _PLACEHOLDERS or self.tail in _PLACEHOLDERS:
            return 0.0
        entropy = -sum(n / self.size * math.log2(n / self.size) for n in self.counts.values() if n)
        kinds = len({_KIND_OF.get(c, 3) for c in self.counts})
        varied = 0.5 * (entropy >= 2.5) + 0.5 * (entropy >= 3.0)
        mixed = 1.0 * (kinds >= 2) + 0.5 * (kinds >= 3)
        return min(3.0, varied + mixed + 0.5 * (self.size >= 12))


def _cut(letters: str) -> str:
    return letters[: _LONGEST_PLACEHOLDER + 2]


class Value:
    """The value of a name: a place in the source, or a concatenation of values that others may share.

    Joining values looks at their summaries alone, so a constant that is doubled line by line stays small.
    """

    __slots__ = ("source", "place", "parts", "known_score", "_summary")

    def __init__(self, source: str, place: tuple[int, int] | None, parts: tuple[Value, ...] = (), score: float | None = None):
        self.source, self.place, self.parts, self.known_score = source, place, parts, score
        self._summary: Summary | None = None
        if parts:
            total = parts[0].summary.copy()
            for part in parts[1:]:
                total.extend(part.summary)
            self._summary = total

    @property
    def summary(self) -> Summary:
        if self._summary is None:
            self._summary = Summary.of(self.source[self.place[0] : self.place[1]])
        return self._summary

    def score(self) -> float:
        if self.known_score is None:
            self.known_score = self.summary.score()
        return self.known_score

    def places(self, seen: set[int]) -> Iterator[tuple[int, int]]:
        """Places of the literals it is built from, without values in ``seen``, which gets those passed."""
        waiting = [self]
        while waiting:
            value = waiting.pop()
            if id(value) in seen:
                continue
            seen.add(id(value))
            if value.place is not None:
                yield value.place
            waiting += reversed(value.parts)

    @property
    def text(self) -> str:
        """The value written out."""
        if self.place is not None:
            return self.source[self.place[0] : self.place[1]]
        return "".join(part.text for part in self.parts)


def _joined(source: str, parts: list[Value]) -> Value:
    return parts[0] if len(parts) == 1 else Value(source, None, tuple(parts))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the base findings, in order; places count code points."""
    found = []
    lowered = text.lower()
    if any(word in lowered for word in _ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= _ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def name_score(name: str) -> float:
    parts = [part.lower() for part in _NAME_PARTS.findall(name)]
    return min(3.0, sum(_SENSITIVE.get(part, 0.0) for part in parts))


def assignments(text: str) -> Iterator[tuple[str, Value]]:
    """Name-value pairs in the order of the text, constants put in for the names that stand for them."""
    lexer = _Lexer(text)
    for target in _TARGET.finditer(text):
        value = lexer.value(target.end())
        if value is not None:
            name = target[1]
            lexer.known[name] = value
            yield name, value


class _Lexer:
    """Reads the values of one text. What is read once is shared: a literal inside a concatenation or a
    bare value inside another one is not read again."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.known: dict[str, Value] = {}
        self.chains: dict[int, Value | None] = {}  # values by the place where they start
        self.bare: list[tuple[int, int]] = []
        self.inner: dict[int, float] = {}  # scores of what follows an operator inside a bare value

    def value(self, at: int) -> Value | None:
        """The literal, constant or concatenation that starts at ``at``."""
        starts, terms = [], []
        rest: Value | None = None
        while True:
            if at in self.chains:
                rest = self.chains[at]
                break
            term = _TERM.match(self.text, at)
            if term is None:
                break
            starts.append(at)
            if term[3] is None:
                end = term.end()
                terms.append(self._quoted(*term.span(1 if term[1] is not None else 2)))
            else:
                end = self._bare_end(at)
                terms.append(self._word(at, end))
            plus = _PLUS.match(self.text, end)
            if plus is None:
                break
            at = plus.end()
        # Joined from the last term, so that a target inside a chain finds the rest of it.
        for start, term in zip(reversed(starts), reversed(terms)):
            parts = [part for part in (term, rest) if part is not None]
            rest = _joined(self.text, parts) if parts else None
            self.chains[start] = rest
        return rest

    def _bare_end(self, at: int) -> int:
        """End of the bare value at ``at``: one that starts inside another ends where that does."""
        place = bisect.bisect_right(self.bare, (at, len(self.text)))
        if place and at < self.bare[place - 1][1]:
            return self.bare[place - 1][1]
        end = _BARE.match(self.text, at).end()
        self.bare.insert(place, (at, end))
        self._score_inner(at, end)
        return end

    def _score_inner(self, start: int, end: int) -> None:
        """Scores of the values that targets inside a bare value get, from the last one on."""
        cuts = [m.end() for m in _OPERATOR_ENDS.finditer(self.text, start, end) if m.end() < end]
        total: Summary | None = None
        for low, high in zip(reversed(cuts), [end, *reversed(cuts[1:])]):
            piece = Summary.of(self.text[low:high])
            if total is None:
                total = piece
            else:
                # No word reaches over an operator, so the order of the pieces matters for the ends alone.
                total.extend(piece)
                total.first, total.head = piece.first, piece.head
            self.inner[low] = total.score()

    def _word(self, start: int, end: int) -> Value:
        """A bare value: the name of a known constant, or a literal."""
        like = _NAME_LIKE.match(self.text, start, end)
        if like is not None and like.end() == end:
            word = like[0]
            if word in self.known and _IDENTIFIER.fullmatch(word):
                return self.known[word]
            if word.startswith("$") and word.strip("$") in self.known:
                return self.known[word.strip("$")]
        return Value(self.text, (start, end), score=self.inner.get(start))

    def _quoted(self, start: int, end: int) -> Value | None:
        """A quoted literal; references in it to known names are put in."""
        parts, at = [], start
        for ref in _REFERENCE.finditer(self.text, start, end):
            value = self.known.get(ref[1] or ref[2])
            if value is not None:
                if at < ref.start():
                    parts.append(Value(self.text, (at, ref.start())))
                parts.append(value)
                at = ref.end()
        if at < end:
            parts.append(Value(self.text, (at, end)))
        return _joined(self.text, parts) if parts else None


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base findings, and all findings: those of the lexer are added where no base finding covers them."""
    base = base_spans(text)
    if "=" not in text and ":" not in text:
        return base, base
    starts = [low for low, _, _ in base]
    reach = list(accumulate((high for _, _, high in base), max))
    added = set()
    seen: set[int] = set()
    kept = []  # values stay alive while their ids are in ``seen``
    for name, value in assignments(text):
        sensitive = name_score(name)
        if sensitive < 1.0:
            continue
        literal = value.score()
        if not literal or sensitive + literal < LEAST_SCORE:
            continue
        kept.append(value)
        for start, end in value.places(seen):
            before = bisect.bisect_right(starts, start)
            if not before or reach[before - 1] < end:
                added.add((start, 3, end))
    return base, sorted([*base, *added])


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


_RESULT = "row_id long, n_assign long, n_access long, n_hex long, n_name long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Findings of every whole text, one row per input row; nothing is shuffled.

    Returns ``row_id`` (the id), counts per kind (``n_name``: added by the lexer), ``spans``
    (``kind:start:end`` by start, then kind; code points, end exclusive; joined by commas) and
    ``base_sha256`` of the same list of base findings. Null and empty texts have none. Null and repeated
    ids, equal rows, other columns and empty tables change nothing. Names, literals and concatenations may
    be of any length; the time grows with the text, also where constants are made of constants.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    return rows.mapInArrow(_scan, _RESULT)


def _scan(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        counts: list[list[int]] = [[], [], [], []]
        digests, lists = [], []
        for text in batch["body"]:
            base, spans = all_spans(text.as_py())
            for kind in range(4):
                counts[kind].append(sum(1 for span in spans if span[1] == kind))
            digests.append(hashlib.sha256(written(base).encode()).hexdigest())
            lists.append(written(spans))
        yield pa.RecordBatch.from_arrays(
            [batch["row_id"], *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array(lists)],
            names=["row_id", "n_assign", "n_access", "n_hex", "n_name", "base_sha256", "spans"],
        )


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every finding replaced by ``mark``; rows and other columns stay as they are.

    A null text stays null, an empty one empty; equal rows stay equal, an empty table stays empty. Texts
    of any length are read whole.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts = [None if text is None else redacted(text, mark) for text in batch[text_col].to_pylist()]
            place = batch.schema.get_field_index(text_col)
            columns = [pa.array(texts, pa.string()) if i == place else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def redacted(text: str, mark: str) -> str:
    parts, at = [], 0
    for start, _, end in all_spans(text)[1]:
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])
