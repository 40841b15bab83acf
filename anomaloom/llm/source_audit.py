"""Source divergence audit: how far the term distributions of a language's sources lie apart.

Term counts are combined per (language, source) in the tasks that read the texts. For a block of the
kept terms of a language every source has indicator columns, one per count level that occurs. The
product of these columns with their transpose holds all joint tables of two sources: how many terms
have level a in one and level b in the other. Shares follow from levels, so a joint table prices the
distance of its pair. Blocks are priced by themselves and added up, all in whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window

from anomaloom.session import stage

#: Documents of a language that a kept term is in, at least.
LEAST_DOCUMENTS = 30
#: Added to every count.
PRIOR = 5
#: Shares are whole parts of this number.
UNIT = 1_000_000_000
#: Terms of a block: bounds the levels a source can have in it.
BLOCK_TERMS = 256
#: Sources of a strip; a task multiplies two strips.
STRIP_SOURCES = 32
#: Distinct terms that a task holds before it passes their counts on.
_HELD_TERMS = 400_000
#: Bytes of a text that are cut into terms at a time.
_SLICE = 1 << 20

# A-Z becomes a-z; every other byte below 0x80 separates; bytes from 0x80 on belong to a term.
_TERM_BYTES = bytes(
    byte + 32 if 65 <= byte <= 90 else byte if 97 <= byte <= 122 or byte >= 128 else 32 for byte in range(256)
)


def terms_of(body: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, in lists of bounded size."""
    plain = body.translate(_TERM_BYTES)
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + _SLICE)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def _count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of the terms per group; a null term counts the group's documents."""
    uses: dict[tuple, Counter] = {}
    spread: dict[tuple, Counter] = {}
    held = 0
    for batch in stream:
        groups = zip(batch["lang"].to_pylist(), batch["source"].to_pylist())
        for group, body in zip(groups, batch["body"]):
            use, docs = uses.setdefault(group, Counter()), spread.setdefault(group, Counter())
            before = len(use)
            seen: set[bytes] = set()
            for terms in terms_of(body.as_py()):
                use.update(terms)
                seen.update(terms)
            docs.update(seen)
            docs[None] += 1
            held += len(use) - before
            if held >= _HELD_TERMS:
                yield from _written(uses, spread)
                uses, spread, held = {}, {}, 0
    yield from _written(uses, spread)


def _written(uses: dict[tuple, Counter], spread: dict[tuple, Counter]) -> Iterator[pa.RecordBatch]:
    for (lang, source), docs in spread.items():
        use = uses[lang, source]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * len(docs), pa.string()),
                pa.array([source] * len(docs), pa.string()),
                pa.array([None if term is None else term.decode() for term in docs], pa.string()),
                pa.array([use.get(term, 0) for term in docs], pa.int64()),
                pa.array(list(docs.values()), pa.int64()),
            ],
            names=["lang", "source", "term", "n", "docs"],
        )


def term_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """``lang, source, term, n, docs`` of every group's terms, and a row without term per group."""
    rows = docs.select(
        F.coalesce(F.col(lang_col), F.lit("")).alias("lang"),
        F.coalesce(F.col(source_col), F.lit("")).alias("source"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"),
    )
    parts = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, size: Column, vocabulary: Column) -> Column:
    """Share of a count among ``size`` of ``vocabulary`` terms, in whole parts of ``UNIT`` and never 0."""
    above = (count + PRIOR).cast("decimal(27,0)") * F.lit(UNIT).cast("decimal(10,0)")
    below = (size + PRIOR * vocabulary).cast("decimal(20,0)")
    # The remainder is taken off first, so that the quotient is a whole number.
    return ((above - above % below) / below).cast("long") + 1


def audit_sources(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least_documents: int = LEAST_DOCUMENTS,
    most_terms: int = 50,
) -> DataFrame:
    """Distances of a language's sources, and the terms that mark each source.

    Returns ``lang, source, part, item, value, rank``. Part ``pair``: for every other source of the
    language the sum, over its kept terms, of the distance of both shares. Part ``term``: the
    ``most_terms`` kept terms whose share in the source lies furthest above that in the language. Ranks
    are by value descending, then item.

    A null text, language or source counts as ''. A source whose texts have no terms (empty texts) takes
    part with counts of 0; a language without kept terms has pairs of value 0. Equal rows count as often
    as they occur, a text of any length is cut into terms slice by slice, an empty table gives an empty
    result, and other columns are not read. Every kept term and every source is covered.
    """
    counts = stage(term_counts(docs, text_col, lang_col, source_col), "terms")
    groups = counts.where(F.col("term").isNull()).select("lang", "source")
    spread = counts.where(F.col("term").isNotNull()).groupBy("lang", "term")
    lang_terms = spread.agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    kept = stage(lang_terms.where(F.col("docs") >= least_documents).select("lang", "term", "lang_n"), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("vocabulary"), F.sum("lang_n").alias("lang_size"))
    uses = stage(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "kept-counts")
    sizes = uses.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    sized = stage(
        groups.join(langs, "lang", "left")
        .join(sizes, ["lang", "source"], "left")
        .select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("size", "vocabulary", "lang_size"))),
        "groups",
    )
    return _pairs(kept, uses, sized).unionByName(_marks(uses, sized, most_terms))


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def _marks(uses: DataFrame, sized: DataFrame, most_terms: int) -> DataFrame:
    """Terms of a source above their language; the row limit is applied before the shuffle as well."""
    rows = uses.join(sized, ["lang", "source"]).select(
        "lang",
        "source",
        F.lit("term").alias("part"),
        F.col("term").alias("item"),
        (
            share(F.col("n"), F.col("size"), F.col("vocabulary"))
            - share(F.col("lang_n"), F.col("lang_size"), F.col("vocabulary"))
        ).alias("value"),
    )
    return _ranked(rows.where(F.col("value") > 0)).where(F.col("rank") <= most_terms)


def _pairs(kept: DataFrame, uses: DataFrame, sized: DataFrame) -> DataFrame:
    per_lang = sized.groupBy("lang").agg(
        F.first("vocabulary").alias("vocabulary"), F.count("*").alias("sources")
    )
    cuts = per_lang.select(
        "lang",
        F.ceil(F.col("vocabulary") / BLOCK_TERMS).cast("long").alias("blocks"),
        F.ceil(F.col("sources") / STRIP_SOURCES).cast("long").alias("strips"),
    )
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block")
    # Every source is in every block of its language, with the number of the block's terms.
    blocks = kept.join(cuts, "lang").select("lang", block).groupBy("lang", "block").agg(F.count("*").alias("terms"))
    present = (
        sized.join(cuts, "lang")
        .join(blocks, "lang")
        .select("lang", "source", "block", "strips", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), "terms", "size", "vocabulary")
    )
    used = uses.join(cuts, "lang").select(
        "lang", "source", block, "strips", "term", "n", *(F.lit(0).cast("long").alias(c) for c in ("terms", "size", "vocabulary"))
    )
    strip = F.pmod(F.xxhash64("source"), F.col("strips"))
    dealt = (
        used.unionByName(present)
        .withColumn("strip", strip)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("strips") - 1)))
        .withColumns({"low": F.least("strip", "other"), "high": F.greatest("strip", "other")})
        .drop("strips", "other")
    )
    priced = dealt.groupBy("lang", "block", "low", "high").applyInArrow(
        _price, "lang string, source string, item string, value long"
    )
    sums = priced.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    others = sized.select("lang", F.col("source").alias("item"))
    named = sized.select("lang", "source").join(others, "lang").where(F.col("source") != F.col("item"))
    values = named.join(sums, ["lang", "source", "item"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value")
    )
    return _ranked(values)


def _price(table: pa.Table) -> pa.Table:
    """Distances of two strips of sources over the terms of one block, by products of level columns."""
    table = table.combine_chunks()
    marks = table.filter(table["term"].is_null())
    uses = table.filter(table["term"].is_valid())
    names = marks["source"].to_pylist()
    place = {name: k for k, name in enumerate(names)}
    low, high = table["low"][0].as_py(), table["high"][0].as_py()
    strips = marks["strip"].to_numpy()
    terms = uses["term"].combine_chunks().dictionary_encode().indices.to_numpy() if len(uses) else np.zeros(0, np.int64)
    # A term of the block that none of these sources has is a row of zeros.
    counts = np.zeros((marks["terms"][0].as_py(), len(names)), dtype=np.int64)
    counts[terms, [place[name] for name in uses["source"].to_pylist()]] = uses["n"].to_numpy()

    columns, shares = [], []
    for k, (size, vocabulary) in enumerate(zip(marks["size"].to_pylist(), marks["vocabulary"].to_pylist())):
        levels, at = np.unique(counts[:, k], return_inverse=True)
        columns.append((at[:, None] == np.arange(len(levels))).astype(np.float32))
        below = size + PRIOR * vocabulary
        shares.append(np.array([1 + UNIT * (level + PRIOR) // below for level in levels.tolist()], dtype=np.int64))

    left, right = np.flatnonzero(strips == low), np.flatnonzero(strips == high)
    pairs: list[tuple[int, int, int]] = []
    if len(left) and len(right):
        stacked = np.hstack([columns[k] for k in right])
        prices = np.concatenate([shares[k] for k in right])
        bounds = np.cumsum([0, *(len(shares[k]) for k in right[:-1])])
        for k in left.tolist():
            # Counts of at most a block's terms: whole numbers of 32-bit floats.
            joint = (columns[k].T @ stacked).astype(np.int64)
            cost = (joint * np.abs(shares[k][:, None] - prices[None, :])).sum(axis=0)
            for other, value in zip(right.tolist(), np.add.reduceat(cost, bounds).tolist()):
                if other != k:
                    pairs.append((k, other, value))
                    if low != high:
                        pairs.append((other, k, value))
    return pa.table(
        {
            "lang": pa.array([table["lang"][0].as_py()] * len(pairs), pa.string()),
            "source": pa.array([names[a] for a, _, _ in pairs], pa.string()),
            "item": pa.array([names[b] for _, b, _ in pairs], pa.string()),
            "value": pa.array([value for _, _, value in pairs], pa.int64()),
        }
    )
