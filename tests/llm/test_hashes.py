"""Texts on which polynomial hashes agree: no operator may take two of them for one."""

import numpy as np
import pyarrow as pa
import pytest

from anomaloom.llm.byte_repeats import remove_byte_repeats
from anomaloom.llm.hashing import texts_of
from anomaloom.llm.jaccard_join import jaccard_join
from anomaloom.llm.queries import tokenizer_file
from anomaloom.llm.tokens import TokenIds
from anomaloom.llm.word_repeats import remove_word_repeats


def twins(size, letters="ab"):
    """The Thue-Morse word of ``size`` letters and its complement."""
    bits = [bin(i).count("1") % 2 for i in range(size)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")


@pytest.mark.parametrize("size", [256, 512, 1024, 8192])
def test_words(size):
    for letters in ("ab", "AB", "xq"):
        pair = pa.array([text.encode() for text in twins(size, letters)], pa.binary())
        for part in texts_of(pair):
            starts, ends, _ = part.words()
            for lower in (False, True):
                assert len(set(part.word_hashes(starts, ends, lower).tolist())) == 2


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_ids(name):
    coder = TokenIds(tokenizer_file(name))
    texts = [f"{a} {b}" for a, b in map(twins, (512, 1024, 4096))]
    for part in texts_of(pa.array([t.encode() for t in texts], pa.binary())):
        ids, bounds = coder.encode(part)
        for i, text in enumerate(texts):
            whole = coder.tokenizer.encode(text, add_special_tokens=False).ids
            assert np.array_equal(ids[bounds[i] : bounds[i + 1]], whole)


def test_repeats_and_joins(spark):
    a, b = twins(1024)
    head = " ".join(["same"] * 19)
    cut = remove_word_repeats(frame(spark, [f"{head} {a}", f"{head} {b}"]), window=20)
    assert [row["n_removed"] for row in cut.collect()] == [0, 0]
    joined = jaccard_join(frame(spark, [a, b]), shingle=3, percent=90)
    assert [row["n_links"] for row in joined.collect()] == [0, 0]
    for size in (512, 1024, 4096):
        texts = list(twins(size))
        found = remove_byte_repeats(frame(spark, texts), window=400)
        assert {row["row_id"]: row["n_removed"] for row in found.collect()} == dict(enumerate(covered(texts, 400), 1))


def covered(texts, window):
    spots = {}
    for k, text in enumerate(texts):
        for i in range(len(text) - window + 1):
            spots.setdefault(text[i : i + window], []).append((k, i))
    gone = [set() for _ in texts]
    for places in spots.values():
        if len(places) > 1:
            for k, i in places:
                gone[k].update(range(i, i + window))
    return [len(g) for g in gone]
