"""Vocabulary and encoding of token arrays."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from anomaloom.functions.numeric import last_items, left_pad
from anomaloom.operators.joins import lookup_join
from anomaloom.session import stage
from anomaloom.sources.datasets import PAD, PAD_ID, UNK, UNK_ID

SHOWN_TOKENS = 20
# Entries and characters up to which a vocabulary is put into the expression itself. A larger one is
# joined; the results are the same.
LITERAL_ENTRIES = 20_000
LITERAL_CHARACTERS = 1_000_000
_WHOLE = ("byte", "short", "integer", "long")
# More places than an array has, and a number below all 64-bit keys.
_PLACES, _BEFORE_ALL = 2**31, str(-(2**63) - 1)


def check_vocab_limits(sequence_length: int, max_vocab: int, min_frequency: int) -> None:
    if sequence_length <= 0:
        raise ValueError("sequence length must be positive")
    if max_vocab < 2:
        raise ValueError("the vocabulary needs at least its two special tokens")
    if min_frequency <= 0:
        raise ValueError("minimum token frequency must be at least 1")


def token_counts(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``token, n``: how often each token occurs."""
    return df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def first_places(
    df: DataFrame, key: Sequence[str], wanted: DataFrame, tokens: str = "tokens", entries: int = LITERAL_ENTRIES
) -> DataFrame:
    """``token, first_at``: smallest (key, position) of the ``wanted`` tokens, in a form that sorts as the
    pair does, null keys first.

    The place by one key of whole numbers is a number, which a hash aggregate takes; a struct is sorted.
    Tokens are never shuffled one by one: a small table of wanted ones goes to the tasks, for a larger
    one the places of all tokens are combined in the tasks first.
    """
    exploded = df.select(*key, F.posexplode(tokens).alias("pos", "token"))
    place = F.struct(*key, "pos")
    if len(key) == 1 and df.schema[key[0]].dataType.typeName() in _WHOLE:
        whole = F.coalesce(F.col(key[0]).cast("decimal(20,0)"), F.lit(_BEFORE_ALL).cast("decimal(20,0)"))
        place = (whole * F.lit(_PLACES).cast("decimal(10,0)") + F.col("pos").cast("decimal(10,0)")).cast("decimal(38,0)")
    first_at = F.min(place).alias("first_at")
    wanted = wanted.select("token")
    count, characters = _extent(wanted)
    if count > entries or characters > LITERAL_CHARACTERS:
        return lookup_join(exploded.groupBy("token").agg(first_at), wanted, ["token"], "left_semi")
    kept = lookup_join(exploded, F.broadcast(wanted), ["token"], "left_semi")
    return kept.groupBy("token").agg(first_at)


def build_vocab(
    df: DataFrame, key: Sequence[str], tokens: str = "tokens", max_vocab: int = 8192, min_frequency: int = 2
) -> DataFrame:
    """``token, token_id``: the most frequent tokens from id 2 on, ties by first occurrence in key
    order, after the two special tokens.

    Counting is one hash aggregate. Places, which sort, are looked up only for tokens that share
    their count with another token in reach of the vocabulary.
    """
    check_vocab_limits(1, max_vocab, min_frequency)
    room = max_vocab - 2
    counted = stage(token_counts(df, tokens).where(F.col("n") >= min_frequency), "tokens")
    least = counted.orderBy(F.desc("n")).limit(room).agg(F.min("n")).first()[0]
    reached = counted.where(F.col("n") >= F.lit(least))
    shared = reached.groupBy("n").agg(F.count(F.lit(1)).alias("tokens")).where(F.col("tokens") > 1)
    tied = reached.join(shared.select("n"), "n", "left_semi")
    placed = reached.join(first_places(df, key, tied, tokens), "token", "left")
    ranking = (F.desc("n"), F.asc("first_at"))
    # A bounded result (max_vocab rows), numbered in one small task.
    top = placed.orderBy(*ranking).limit(room)
    numbered = top.select(
        "token", (F.row_number().over(Window.orderBy(*ranking)) + 1).cast("int").alias("token_id")
    )
    special = df.sparkSession.createDataFrame(
        [(PAD, PAD_ID), (UNK, UNK_ID)], "token string, token_id int"
    )
    return stage(special.unionByName(numbered), "vocab")


def _extent(table: DataFrame) -> tuple[int, int]:
    """Number of tokens and of their characters."""
    return tuple(table.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("token")), F.lit(0))).first())


def vocab_lookup(vocab: DataFrame, entries: int = LITERAL_ENTRIES) -> Callable[[Column], Column] | None:
    """Token -> id (null if unknown) as an expression, or None for a large vocabulary.

    The SQL map look-up scans its entries, so the entries are spread over small maps by hash.
    """
    count, characters = _extent(vocab)
    if count > entries or characters > LITERAL_CHARACTERS:
        return None
    shelves = max(1, count // 4)
    maps: list[dict[str, int]] = [{} for _ in range(shelves)]
    for row in vocab.select("token", "token_id", F.hash("token").alias("h")).collect():
        maps[row.h % shelves][row.token] = row.token_id
    table = F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")
    return lambda token: F.get(table, F.pmod(F.hash(token), F.lit(shelves)))[token]


def unknown_id(vocab: DataFrame) -> int:
    """Id of unknown tokens: the vocabulary's own, else 1."""
    row = vocab.where(F.col("token") == UNK).select("token_id").first()
    return UNK_ID if row is None else row["token_id"]


def encode_tokens(
    df: DataFrame,
    vocab: DataFrame,
    length: int,
    tokens: str = "tokens",
    output: str = "token_ids",
    key: Sequence[str] = (),
    literal_entries: int = LITERAL_ENTRIES,
) -> DataFrame:
    """Ids of the last ``length`` tokens, unknown ones the id of ``<UNK>``, zeros in front; a null array
    gives null. Rows may be equal; ``key`` is not needed and kept for callers that pass it.

    Without a shuffle where the vocabulary is small enough; otherwise by a look-up join of the
    tokens, regrouped by row.
    """
    check_vocab_limits(length, 2, 1)
    unk = F.lit(unknown_id(vocab))
    lookup = vocab_lookup(vocab, literal_entries)
    if lookup is not None:
        ids = F.transform(last_items(F.col(tokens), length), lambda token: F.coalesce(lookup(token), unk))
        return df.withColumn(output, left_pad(ids, length, F.lit(PAD_ID)))
    rows, found = _looked_up(df.withColumn("__tail", last_items(F.col(tokens), length)), vocab, "__tail")
    item = F.struct("pos", F.coalesce("token_id", unk).alias("id"))
    ids = found.groupBy("__row").agg(F.sort_array(F.collect_list(item)).alias("__ids"))
    # The tails are not shipped again, only whether there is one.
    rows = rows.withColumn("__whole", F.col("__tail").isNotNull()).drop("__tail")
    joined = rows.join(ids, "__row", "left").withColumn("__found", F.coalesce(F.col("__ids.id"), F.array().cast("array<int>")))
    padded = left_pad(F.col("__found"), length, F.lit(PAD_ID))
    return joined.withColumn(output, F.when(F.col("__whole"), padded)).select(*df.columns, output)


def _looked_up(df: DataFrame, vocab: DataFrame, tokens: str) -> tuple[DataFrame, DataFrame]:
    """The rows with a number of their own, and their tokens one by one with ids (null if unknown).

    The numbered rows are written down, since both results must see the same numbers.
    """
    rows = stage(df.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    exploded = rows.select("__row", F.posexplode(tokens).alias("pos", "token"))
    return rows, lookup_join(exploded, vocab, ["token"])


def unknown_tokens(
    df: DataFrame,
    vocab: DataFrame,
    tokens: str = "tokens",
    key: Sequence[str] = (),
    literal_entries: int = LITERAL_ENTRIES,
) -> DataFrame:
    """Add known and unknown token counts, the first unknown tokens and the last tokens; all null for a
    null array. Rows may be equal; ``key`` is not needed and kept for callers that pass it."""
    lookup = vocab_lookup(vocab, literal_entries)
    if lookup is not None:
        marked = df.withColumn("__unknown", F.filter(tokens, lambda token: lookup(token).isNull()))
    else:
        rows, found = _looked_up(df, vocab, tokens)
        missing = found.where(F.col("token_id").isNull()).groupBy("__row").agg(
            F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("__items")
        )
        none = F.array().cast("array<string>")
        marked = rows.join(missing, "__row", "left").withColumn(
            "__unknown", F.when(F.col(tokens).isNotNull(), F.coalesce(F.col("__items.token"), none))
        )
    size = F.when(F.col(tokens).isNotNull(), F.size(tokens))
    unknown = F.when(F.col(tokens).isNotNull(), F.size("__unknown"))
    return marked.select(
        *df.columns,
        size.alias("event_token_count"),
        (size - unknown).alias("known_event_count"),
        unknown.alias("unknown_event_count"),
        F.slice("__unknown", 1, SHOWN_TOKENS).alias("unknown_event_tokens"),
        last_items(F.col(tokens), SHOWN_TOKENS).alias("event_tokens_tail"),
    )


def infer_vocab_size(df: DataFrame, token_ids: str = "token_ids") -> DataFrame:
    """``vocab_size``: largest id + 1, at least 2."""
    return df.agg((F.greatest(F.coalesce(F.max(F.array_max(token_ids)), F.lit(1)), F.lit(1)) + 1).alias("vocab_size"))
