"""Token-id files with a minimal perfect hash index.

A file set is a Parquet folder in id order. A row of it is a shard: the raw ids of some documents (32
bits, little endian), their offsets, and an index from document key to place that keeps no keys,
only a fingerprint each. The index hashes keys level by level into bit arrays; a key that is alone at
its bit stays there, others go to the next level, and the rank of the bit is the key's place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from anomaloom.llm.hashing import BASE_A, BASE_B, U64, mix, texts_of
from anomaloom.llm.tokens import encoder

#: Ids after which a shard is closed; a longer document makes a longer shard.
SHARD_IDS = 1 << 18
_LEVELS = 24
_SHARD_BITS = 24

_SHARDS = (
    "shard long, n_docs long, n_ids long, least_key long, most_key long, keys binary, has_key binary, "
    "offsets binary, payload binary, level_sizes binary, bits binary, ranks binary, late binary, "
    "fingerprints binary, places binary"
)
_SHARDS_ARROW = pa.schema(
    [(n, pa.int64()) for n in ("shard", "n_docs", "n_ids", "least_key", "most_key")]
    + [
        (n, pa.binary())
        for n in (
            "keys",
            "has_key",
            "offsets",
            "payload",
            "level_sizes",
            "bits",
            "ranks",
            "late",
            "fingerprints",
            "places",
        )
    ]
)


class KeyIndex:
    """Minimal perfect hash of distinct keys, with a 32-bit fingerprint and a place per key."""

    def __init__(self, sizes, bits, ranks, late, fingerprints, places) -> None:
        self.sizes, self.bits, self.ranks, self.late = sizes, bits, ranks, late
        self.fingerprints, self.places = fingerprints, places

    @classmethod
    def build(cls, keys: np.ndarray, places: np.ndarray) -> KeyIndex:
        sizes, arrays = [], []
        rest = keys
        for level in range(_LEVELS):
            if not len(rest):
                break
            size = max(64, -(-2 * len(rest) // 64) * 64)
            position = _position(rest, level, size)
            count = np.bincount(position, minlength=size)
            sizes.append(size)
            arrays.append(count == 1)
            rest = rest[count[position] > 1]
        flags = np.concatenate(arrays) if arrays else np.zeros(0, dtype=bool)
        bits = np.packbits(flags, bitorder="little").view(U64)
        counts = np.bitwise_count(bits).astype(np.int64)
        ranks = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        made = cls(np.array(sizes, dtype=np.int64), bits, ranks, np.sort(rest), None, None)
        slot = made.slots(keys)
        made.fingerprints = np.zeros(len(keys), dtype=np.uint32)
        made.places = np.zeros(len(keys), dtype=np.int64)
        made.fingerprints[slot] = _fingerprint(keys)
        made.places[slot] = places
        return made

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The number of every key, -1 for some that were never added."""
        found = np.full(len(keys), -1, dtype=np.int64)
        base = 0
        for level, size in enumerate(self.sizes.tolist()):
            open_ = np.flatnonzero(found < 0)
            if not len(open_):
                break
            at = base + _position(keys[open_], level, size)
            word, bit = at >> 6, (at & 63).astype(U64)
            there = (self.bits[word] >> bit) & U64(1) == 1
            below = np.bitwise_count(self.bits[word] & ((U64(1) << bit) - U64(1))).astype(np.int64)
            found[open_[there]] = (self.ranks[word] + below)[there]
            base += size
        if len(self.late):
            open_ = np.flatnonzero(found < 0)
            spot = np.minimum(np.searchsorted(self.late, keys[open_]), len(self.late) - 1)
            there = self.late[spot] == keys[open_]
            found[open_[there]] = self.ranks[-1] + spot[there]
        return found

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of every key, -1 where the fingerprint says it was never added."""
        slot = self.slots(keys)
        known = slot >= 0
        known[known] = self.fingerprints[slot[known]] == _fingerprint(keys[known])
        place = np.full(len(keys), -1, dtype=np.int64)
        place[known] = self.places[slot[known]]
        return place


def _position(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    spread = mix(keys.view(U64) + U64((level + 1) * BASE_B % (1 << 64)))
    return (((spread >> U64(32)) * U64(size)) >> U64(32)).astype(np.int64)


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(U64) ^ U64(BASE_A)) >> U64(32)).astype(np.uint32)


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_ids: int = SHARD_IDS,
) -> None:
    """Encode every text, append ``end_id`` and write shards in rising id order.

    ``tokenizer`` is the path of a tokenizer file that every executor has. Null and empty texts have the
    end id only. Rows without an id come first and are not in the index; rows that share an id are
    ordered by a hash of their text and the index leads to the first of a shard. An empty table
    writes an empty file set; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("key"), text.cast("binary").alias("body"))
    order = [F.col("key").asc_nulls_first(), F.xxhash64("body")]
    (
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(_shards(tokenizer, end_id, shard_ids), _SHARDS)
        .write.option("compression", "zstd")
        .parquet(folder)
    )


def _shards(tokenizer: str, end_id: int, shard_ids: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        number = TaskContext.get().partitionId() << _SHARD_BITS
        keys: list[pa.Array] = []
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        total = 0
        for batch in stream:
            for texts in texts_of(batch["body"], shard_ids * 2):
                found, bounds = coder.encode(texts)
                count = np.diff(bounds)
                ids.append(np.insert(found, bounds[1:], end_id).astype("<u4"))
                sizes.append(count + 1)
                keys.append(batch["key"].slice(texts.first, len(texts)))
                total += len(ids[-1])
                if total >= shard_ids:
                    yield _shard(number, pa.concat_arrays(keys), np.concatenate(ids), np.concatenate(sizes))
                    number, keys, ids, sizes, total = number + 1, [], [], [], 0
        if keys:
            yield _shard(number, pa.concat_arrays(keys), np.concatenate(ids), np.concatenate(sizes))

    return run


def _shard(number: int, keys: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    has_key = np.asarray(keys.is_valid())
    plain = keys.fill_null(0).to_numpy()
    known = np.flatnonzero(has_key)
    distinct, first = np.unique(plain[known], return_index=True)
    index = KeyIndex.build(distinct, known[first])
    values = {
        "shard": number,
        "n_docs": len(sizes),
        "n_ids": len(ids),
        "least_key": int(distinct[0]) if len(distinct) else None,
        "most_key": int(distinct[-1]) if len(distinct) else None,
        "keys": plain.astype("<i8").tobytes(),
        "has_key": has_key.astype(np.uint8).tobytes(),
        "offsets": np.concatenate([[0], np.cumsum(sizes)]).astype("<i8").tobytes(),
        "payload": ids.tobytes(),
        "level_sizes": index.sizes.astype("<i8").tobytes(),
        "bits": index.bits.astype("<u8").tobytes(),
        "ranks": index.ranks.astype("<i8").tobytes(),
        "late": index.late.astype("<i8").tobytes(),
        "fingerprints": index.fingerprints.astype("<u4").tobytes(),
        "places": index.places.astype("<i8").tobytes(),
    }
    return pa.RecordBatch.from_arrays([pa.array([values[f.name]], f.type) for f in _SHARDS_ARROW], schema=_SHARDS_ARROW)


def _index_of(shard: dict) -> KeyIndex:
    return KeyIndex(
        np.frombuffer(shard["level_sizes"], "<i8"),
        np.frombuffer(shard["bits"], "<u8"),
        np.frombuffer(shard["ranks"], "<i8"),
        np.frombuffer(shard["late"], "<i8"),
        np.frombuffer(shard["fingerprints"], "<u4"),
        np.frombuffer(shard["places"], "<i8"),
    )


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Every document of a file set, reached through the index by its key.

    Returns ``row_id, start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32`` and, by
    ``with_ids``, ``ids`` (binary). A key that the index does not lead back to its own place
    raises an error: the file is damaged.
    """
    shards = spark.read.schema(_SHARDS).parquet(folder)
    schema = "shard long, row_id long, at long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    found = shards.mapInArrow(_documents(with_ids), schema)
    return found.join(shard_starts(shards), "shard").select(
        "row_id", (F.col("at") + F.col("before")).alias("start"), *found.columns[3:]
    )


def shard_starts(shards: DataFrame) -> DataFrame:
    """``shard, before``: ids of all earlier shards; summed by write task first, then inside each."""
    sizes = shards.select("shard", "n_ids", F.shiftright("shard", _SHARD_BITS).alias("task"))
    tasks = sizes.groupBy("task").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select("task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("task").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return (
        sizes.withColumn("inner", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
        .join(tasks, "task")
        .select("shard", (F.col("base") + F.col("inner")).alias("before"))
    )


def _documents(with_ids: bool):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for row in range(batch.num_rows):
                shard = {name: batch[name][row].as_py() for name in batch.schema.names}
                keys = np.frombuffer(shard["keys"], "<i8")
                has_key = np.frombuffer(shard["has_key"], np.uint8).astype(bool)
                offsets = np.frombuffer(shard["offsets"], "<i8")
                place = np.arange(len(keys))
                found = _index_of(shard).find(keys[has_key])
                # Rows that share a key follow each other; the index leads to the first.
                own = place[has_key]
                again = np.zeros(len(own), dtype=np.int64)
                again[1:] = keys[has_key][1:] == keys[has_key][:-1]
                run_start = np.maximum.accumulate(np.where(again == 0, np.arange(len(own)), 0)) if len(own) else again
                if (found < 0).any() or (found + (np.arange(len(own)) - run_start) != own).any():
                    raise ValueError(f"index of shard {shard['shard']} does not match its documents")
                place[has_key] = found + (np.arange(len(own)) - run_start)
                payload = memoryview(shard["payload"])
                low, high = offsets[place], offsets[place + 1]
                columns = [
                    pa.array(np.full(len(keys), shard["shard"])),
                    pa.array(keys, mask=~has_key),
                    pa.array(low),
                    pa.array(high - low),
                    pa.array([zlib.crc32(payload[4 * a : 4 * b]) for a, b in zip(low.tolist(), high.tolist())], pa.int64()),
                ]
                names = ["shard", "row_id", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([bytes(payload[4 * a : 4 * b]) for a, b in zip(low.tolist(), high.tolist())]))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def look_up(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """``key, ids`` of the wanted keys (a table with ``key``) that the file set holds.

    Keys go to the shards whose key range has them: ranges and keys meet in equal steps of the key
    space, about one per shard. Each shard answers by its index.
    """
    shards = spark.read.schema(_SHARDS).parquet(folder)
    ranges = shards.where(F.col("least_key").isNotNull()).select("shard", "least_key", "most_key")
    low, high, count = ranges.agg(F.min("least_key"), F.max("most_key"), F.count(F.lit(1))).first()
    step = max(1, ((high or 0) - (low or 0)) // max(count, 1))

    def cell(column: str):
        return F.floor((F.col(column) - F.lit(low or 0)) / F.lit(step))

    spread = ranges.withColumn("cell", F.explode(F.sequence(cell("least_key"), cell("most_key"))))
    asked = keys.where(F.col("key").between(low or 0, high or 0)).select("key").distinct().withColumn("cell", cell("key"))
    routed = (
        asked.join(spread, "cell")
        .where(F.col("key").between(F.col("least_key"), F.col("most_key")))
        .groupBy("shard")
        .agg(F.collect_list("key").alias("asked"))
    )
    return shards.join(routed, "shard").mapInArrow(_answers, "key long, ids binary")


def _answers(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        for row in range(batch.num_rows):
            shard = {name: batch[name][row].as_py() for name in batch.schema.names}
            asked = np.array(shard["asked"], dtype=np.int64)
            place = _index_of(shard).find(asked)
            offsets = np.frombuffer(shard["offsets"], "<i8")
            asked, place = asked[place >= 0], place[place >= 0]
            ids = [shard["payload"][4 * offsets[p] : 4 * offsets[p + 1]] for p in place]
            yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(ids, pa.binary())], names=["key", "ids"])
