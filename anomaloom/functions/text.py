"""String and token-array expressions for log lines and identifiers."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

# --- fixed values ---------------------------------------------------------------------------
SEQUENCE_TOKEN = r"[A-Za-z0-9_:\-/\.]+"
EVENT_ID = r"\b[eE]\d+\b"

# Raw log wording -> event id; the first entry that is found in the line wins.
LINE_TEMPLATES = (
    (r"allocate\s+blk_", "e5"),
    (r"receiving\s+block", "e26"),
    (r"packetresponder.*success", "e11"),
    (r"completefile", "e9"),
    (r"addstoredblock", "e21"),
    (r"state change.*active", "e23"),
    (r"writeblock", "e22"),
    (r"finalized block", "e3"),
    (r"slow blockreceiver", "e1"),
    (r"checksum mismatch", "e17"),
    (r"failed to write packet|broken pipe", "e19"),
    (r"invalidateblocks|corrupt replica", "e24"),
    (r"missing\s+\d+\s+replicas", "e29"),
    (r"replicate\s+blk_.*\s+to\s+", "e13"),
)
# --------------------------------------------------------------------------------------------

# Blank space that is taken off the ends of a cell: all Unicode space, and the four separators.
_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(code) for code in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
# Line ends inside what the text reader already hands over as one line.
_INNER_LINE_END = r"[\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def strip(col: Column) -> Column:
    """Remove blank space, Unicode included, at both ends."""
    return F.btrim(col, F.lit(_SPACE))


def strip_quoted(col: Column) -> Column:
    """Blank space, then double quotes, then single quotes off both ends; null becomes ''."""
    bare = strip(F.coalesce(col.cast("string"), F.lit("")))
    return F.btrim(F.btrim(bare, F.lit('"')), F.lit("'"))


normalize_block_id = strip_quoted
normalize_label = strip_quoted


def tokenize_sequence(col: Column) -> Column:
    """Lower-case tokens of an event-sequence cell."""
    found = F.regexp_extract_all(F.coalesce(col.cast("string"), F.lit("")), F.lit(SEQUENCE_TOKEN), F.lit(0))
    # Lower-cased as one string: tokens hold no blanks, and array functions beat a lambda per token.
    return F.array_remove(F.split(F.lower(F.array_join(found, " ")), " ", -1), "")


def extract_event_ids(line: Column) -> Column:
    """Explicit event ids in a line, lower-case, in order of appearance."""
    found = F.regexp_extract_all(line, F.lit("(?U)" + EVENT_ID), F.lit(0))
    return F.transform(found, F.lower)


def infer_event_from_template(line: Column) -> Column:
    """Event id of the first known wording in the line, letter case aside; null if there is none."""
    return F.coalesce(
        *(F.when(line.rlike("(?idU)" + pattern), F.lit(event)) for pattern, event in LINE_TEMPLATES)
    )


def infer_event_from_ascii(lowered: Column) -> Column:
    """The same for a lower-cased line of ASCII letters: a plain substring search decides most
    templates, and the pattern is tried only on lines that hold its longest word."""
    return F.coalesce(*(F.when(_holds(lowered, pattern), F.lit(event)) for pattern, event in LINE_TEMPLATES))


def _holds(lowered: Column, pattern: str) -> Column:
    tests = []
    for alternative in pattern.split("|"):
        words = re.split(r"\\[sd]\+|\.\*", alternative)
        found = lowered.contains(max(words, key=len))
        tests.append(found if words == [alternative] else found & lowered.rlike("(?d)" + alternative))
    return reduce(lambda left, right: left | right, tests)


def is_ascii(col: Column) -> Column:
    return F.length(col) == F.octet_length(col)


def split_lines(text: Column) -> Column:
    """Lines of a multi-line text; a final line end opens no extra line."""
    return _without_last_blank(F.split(F.coalesce(text, F.lit("")), _LINE_END, -1))


def split_inner_lines(line: Column) -> Column:
    return F.split(line, _INNER_LINE_END, -1)


def _without_last_blank(parts: Column) -> Column:
    blank_end = F.element_at(parts, -1) == ""
    return F.when(blank_end, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def split_events(sequence: Column) -> Column:
    """Event tokens of a blank- or comma-separated string."""
    return F.filter(F.split(F.translate(sequence, ",", " "), r"(?U)\s+"), lambda token: token != "")


def tokens_from_sequence(event_names: Column, event_sequence: Column) -> Column:
    """The event list where there is one, else the split string, else an empty array."""
    return F.coalesce(event_names, split_events(event_sequence), F.array().cast("array<string>"))


def token_case(tokens: Column, upper: bool) -> Column:
    return F.transform(tokens, F.upper if upper else F.lower)


def normalize_events(tokens: Column) -> Column:
    """Trimmed upper-case event names without blanks."""
    return F.filter(F.transform(tokens, lambda token: F.upper(strip(token))), lambda token: token != "")


def contains_any(col: Column, words) -> Column:
    return reduce(lambda left, right: left | right, (col.contains(word) for word in words))


# --- rendering of values inside prompts ------------------------------------------------------


def quoted(col: Column) -> Column:
    """A string in single quotes, in double ones where it holds only single quotes."""
    escaped = F.replace(col, F.lit("\\"), F.lit("\\\\"))
    double = col.contains("'") & ~col.contains('"')
    return F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )


def quoted_list(tokens: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(tokens, quoted), ", "), F.lit("]"))


def shortest_decimal(col: Column) -> Column:
    """A double from 0 to 1 in its shortest form: plain down to 0.0001, 1e-05 style below."""
    text = col.cast("string")
    digits = F.regexp_replace(F.regexp_extract(text, r"^(\d)\.(\d+)E", 2), r"^0$", "")
    lead = F.regexp_extract(text, r"^(\d)\.", 1)
    tail = F.when(digits == "", lead).otherwise(F.concat(lead, F.lit("."), digits))
    power = F.lpad(F.regexp_extract(text, r"E-(\d+)$", 1), 2, "0")
    return (
        F.when(~text.contains("E"), text)
        .when(col >= 1e-4, F.concat(F.lit("0.000"), lead, digits))
        .otherwise(F.concat(tail, F.lit("e-"), power))
    )
