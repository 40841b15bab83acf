"""Source audit, spelling variants and byte pairs against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from anomaloom.llm import source_audit, spelling
from anomaloom.llm.byte_pairs import decode_ids, encode_digests, encode_ids, encoder, read_ranks
from anomaloom.llm.source_audit import audit_sources
from anomaloom.llm.spelling import neighbourhood, own_key, reduced, spelling_variants
from odd import CLASHING, frame, odd_rows, unnamed_rows

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def audit_plainly(rows, least, most):
    docs = [
        (lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER)))
        for text, lang, source in rows
    ]
    found = []
    for lang in {lang for lang, _, _ in docs}:
        here = [(source, terms) for of, source, terms in docs if of == lang]
        spread = Counter(term for _, terms in here for term in set(terms))
        kept = [term for term, n in spread.items() if n >= least]
        counts = {source: Counter() for source, _ in here}
        for source, terms in here:
            counts[source].update(term for term in terms if spread[term] >= least)
        total = sum(counts.values(), Counter())

        def share(count):
            size = sum(count.values())
            return {t: 1 + 1_000_000_000 * (count[t] + 5) // (size + 5 * len(kept)) for t in kept}

        shares, whole = {source: share(count) for source, count in counts.items()}, share(total)
        for source, p in shares.items():
            pairs = [(-sum(abs(p[t] - q[t]) for t in kept), other) for other, q in shares.items() if other != source]
            terms = [(whole[t] - p[t], t) for t in kept if counts[source][t] and p[t] > whole[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:most])):
                found += [(lang, source, part, item, -value, k + 1) for k, (value, item) in enumerate(items)]
    return sorted(found)


def audit_frame(spark, rows):
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    return df.select("*", *(F.lit("clash").alias(name) for name in (*CLASHING, "term", "docs", "size", "block", "strip", "part", "item")))


def audit_rows(docs=240, seed=3):
    rng = random.Random(seed)
    rows = []
    for _ in range(docs):
        source = rng.choice(["hot", "hot", "s1", "s2", "s3", None, ""])
        bag = [f"t{'abcdefghijklmnop'[min(15, int(rng.expovariate(0.2 if source == 'hot' else 0.4)))]}É" for _ in range(rng.randrange(1, 60))]
        rows.append((" ".join(bag) + rng.choice(["", " THE the", "\n日本 42"]), rng.choice(["x", "x", "y", None]), source))
    return [*rows, *rows[:20], (None, "x", "empty"), ("1 2 3", "void", "a"), ("", "void", "b"), ("word " * 9, None, "b")]


@pytest.mark.parametrize("block,strip,held", [(256, 32, 400_000), (4, 2, 5)])
def test_audit(spark, monkeypatch, block, strip, held):
    monkeypatch.setattr(source_audit, "BLOCK_TERMS", block)
    monkeypatch.setattr(source_audit, "STRIP_SOURCES", strip)
    monkeypatch.setattr(source_audit, "_HELD_TERMS", held)
    rows = audit_rows()
    found = audit_sources(audit_frame(spark, rows), least_documents=10, most_terms=4)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == audit_plainly(rows, 10, 4)


def test_audit_of_nothing_and_of_long_texts(spark, monkeypatch):
    assert audit_sources(audit_frame(spark, [])).count() == 0
    monkeypatch.setattr(source_audit, "_SLICE", 100)
    rows = [("a" * 5000 + " b c" * 30_000, "x", "one"), ("b c " * 10, "x", "two"), (None, None, None)]
    found = audit_sources(audit_frame(spark, rows), least_documents=1)
    assert sorted(map(tuple, found.collect())) == audit_plainly(rows, 1, 50)


def test_audit_of_large_counts(spark):
    df = spark.createDataFrame([(3 * 10**15, 7 * 10**15, 1000)], "n long, size long, v long")
    found = df.select(source_audit.share(F.col("n"), F.col("size"), F.col("v"))).first()[0]
    assert found == 1 + 10**9 * (3 * 10**15 + 5) // (7 * 10**15 + 5000)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def spell_plainly(rows):
    counts = Counter()
    for name, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            mark = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if mark % 199 == 0:
                at = mark % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    links = defaultdict(list)
    for a, b in itertools.combinations(words, 2):
        if abs(len(a) - len(b)) < 2 and near(a, b):
            links[a].append(b)
            links[b].append(a)
    form = {}
    for word, n in words.items():
        best = min(links[word], key=lambda w: (-words[w], w), default=None)
        form[word] = best if best is not None and words[best] >= 5 * n else None
    found = []
    for word, n in words.items():
        root = word
        while form[root] is not None:
            root = form[root]
        found.append((word, form[word], root, n, len(links[word]), words.get(form[word])))
    return sorted(found, key=str)


def spell_rows(seed=5):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdéß") for _ in range(rng.randrange(6, 9))) for _ in range(25)] + ["Straßen", "x" * 9]
    rows = []
    for i in range(300):
        bag = []
        for _ in range(40):
            word = base[min(len(base) - 1, int(rng.expovariate(0.15)))]
            if rng.random() < 0.2:
                at = rng.randrange(len(word))
                word = rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice("abÉ") + word[at:], word[:at] + "c" + word[at + 1 :]])
            bag.append(word)
        rows.append((rng.choice([i, i, None, 7]), rng.choice([" ", "\n", "—", "日"]).join(bag)))
    return [*rows, *rows[:3], (1, None), (2, ""), (3, "short"), (4, "12 34"), *((8, f"{'chain' + 'z' * k} " * 6 ** k) for k in (1, 2, 3, 4))]


def test_spelling(spark, monkeypatch):
    monkeypatch.setattr(spelling, "_HELD_WORDS", 50)
    monkeypatch.setattr(spelling, "_LAID_OUT", 64)
    rows = spell_rows()
    found = spelling_variants(frame(spark, rows))
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    plain = spell_plainly(rows)
    assert sorted(map(tuple, found.collect()), key=str) == plain
    assert sum(row[1] is not None for row in plain) > 10 and any(row[1] not in (None, row[2]) for row in plain)


def test_spelling_of_nothing_and_of_long_words(spark):
    assert spelling_variants(frame(spark, [])).count() == 0
    long = "".join(random.Random(2).choices("abcdefgh", k=20_000))
    rows = [(1, f"{long} " * 30), (2, f"{long[:9_000]}{long[9_001:]} " * 5), (3, f"{long[:500]}z{long[501:]} " * 6)]
    found = spelling_variants(frame(spark, rows)).collect()
    assert sorted((row["n"], row["n_near"], row["form"] == long) for row in found) == [(5, 1, True), (6, 1, True), (30, 2, False)]


@settings(max_examples=100, deadline=None)
@given(st.text("abcdefghij", min_size=6, max_size=12), st.integers(0, 11), st.sampled_from("abcdefghijkéz"), st.integers(0, 2))
def test_neighbourhood_reaches_every_edit(word, at, letter, kind):
    at = min(at, len(word) - 1)
    other = word[:at] + (letter if kind < 2 else "") + word[at + (kind > 0) :]
    for symbols in (4, 7):
        mine = set(itertools.chain(*(keys.tolist() for keys in neighbourhood(reduced(word.encode("latin-1"), symbols), symbols))))
        assert own_key(reduced(other.encode("latin-1"), symbols)) in mine
        assert len(mine) <= 1 + len(word) * symbols + (len(word) + 1) * symbols + len(word)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})


def digest(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def byte_pair_rows():
    rng = random.Random(4)
    blanks = ["  a\x1c b\x85c  d \n\n e　", "tail   ", "  x", "it's We'LL 'd x've", "١٢٣ ²x ⅷ 一二三", "<|endoftext|>"]
    junk = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x250), rng.randrange(0x4E00, 0x4F00), 0x1F600, 10, 32])) for _ in range(400)) for _ in range(30)]
    long = ["ab" * 3000, " " * 5000, "é" * 3000, "".join(rng.choice("abcd") for _ in range(5000)), "y" * 63, "y" * 64, "y" * 65]
    return [*odd_rows(), *unnamed_rows(), *((100 + i, t) for i, t in enumerate([*blanks, *junk, *long]))]


@pytest.mark.parametrize("slice_of,kept", [(1 << 21, 400_000), (50, 20)])
def test_byte_pairs(spark, reference, monkeypatch, slice_of, kept):
    from anomaloom.llm import byte_pairs

    monkeypatch.setattr(byte_pairs, "_SLICE", slice_of)
    monkeypatch.setattr(byte_pairs, "_KEPT", kept)
    pairs = byte_pairs.BytePairs(read_ranks(RANKS), public_tokenizers.PATTERN)
    for _, text in byte_pair_rows():
        ids = pairs.encode(text or "")
        assert ids == reference.encode_ordinary(text or "")
        assert pairs.decode(ids) == (text or "").encode()


def test_byte_pairs_on_spark(spark, reference):
    rows = byte_pair_rows()
    wanted = []
    for name, text in rows:
        ids = reference.encode_ordinary(text or "")
        wanted.append((name, len(ids), digest(" ".join(map(str, ids))), digest(text or "")))
    found = encode_digests(frame(spark, rows), RANKS, public_tokenizers.PATTERN)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(wanted, key=str)
    assert encode_digests(frame(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_byte_pairs_round_trip(spark):
    rows = byte_pair_rows()
    ids = encode_ids(frame(spark, rows), RANKS, public_tokenizers.PATTERN)
    back = decode_ids(ids, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((row[0], bytes(row[1])) for row in back if row[0]) == sorted((n, (t or "").encode()) for n, t in rows if n)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=64), min_size=1, max_size=20))
def test_trees_side_by_side_equal_single_ones(pieces):
    pairs = encoder(RANKS, public_tokenizers.PATTERN)
    assert pairs.merged_together(pieces) == [pairs.merged(piece) for piece in pieces]
    for piece in pieces:
        parts = [bytes([b]) for b in piece]
        while True:
            ranked = [(pairs.ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            if not ranked or min(ranked)[0] == 1 << 40:
                break
            i = min(ranked)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert pairs.merged(piece) == [pairs.ranks[part] for part in parts]
