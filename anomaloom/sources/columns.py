"""Look-up of columns under their aliases."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

# --- fixed values ---------------------------------------------------------------------------
BLOCK_COLUMNS = ("BlockId", "block_id", "blk_id", "blkid")
SEQUENCE_COLUMNS = ("EventSequence", "event_sequence", "events", "sequence", "Features")
BLOCK_LABEL_COLUMNS = ("Label", "anomaly", "is_anomaly", "class")
FLOW_LABEL_COLUMNS = ("Label", "Attack", "Class")
FEATURE_KEYS = ("features", "inputs")
LABEL_KEYS = ("labels", "targets")
# --------------------------------------------------------------------------------------------


def fold(name: str) -> str:
    return name.strip().lower()


def resolve_column(columns: Sequence[str], candidates: Iterable[str]) -> str | None:
    """First candidate that exists, blanks and case aside; of columns that fold alike the last."""
    position = {fold(name): at for at, name in enumerate(columns)}
    hits = [columns[position[fold(name)]] for name in candidates if fold(name) in position]
    return hits[0] if hits else None


def require_column(columns: Sequence[str], candidates: Sequence[str], source: str) -> str:
    found = resolve_column(columns, candidates)
    if found is None:
        raise KeyError(f"{source} has none of {', '.join(candidates)}; columns: {', '.join(columns)}")
    return found


def resolve_key(columns: Sequence[str], preferred: str, alternatives: Sequence[str], source: str) -> str:
    """Exact name, else the first alternative that exists."""
    hits = [name for name in (preferred, *alternatives) if name in columns]
    if not hits:
        raise KeyError(f"{source} has neither {preferred} nor {', '.join(alternatives)}")
    return hits[0]
