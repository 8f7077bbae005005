"""Packing against the tokenizers library, the definition of sum-of-squares placement, and what a packing must be."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import packing
from tests.llm.test_operators import ODD, docs


def library_ids(words, text):
    return np.array(words.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


SAMPLES = ["Hello <|endoftext|> x", "a  <|endoftext|>y", " \n\n x  y z éé 123's 'S don't DON'T", "x\x1cy \x85 z \x0bq", "日本語 текст", "W̊ ẘ Å “,é,” a…b ...it's'", "\x00\x01é \x7f,é", "'space \"'s 'RE're 'rest", "İ K ſ ﬁ Ŀ ŉ ß", " ́a", "#'tis ''s <|", *[t or "" for t in ODD]]


@pytest.mark.parametrize("text", SAMPLES)
def test_ids_are_the_librarys(text):
    words = packing.word_ids()
    for _ in range(2):  # learned, then from the memo
        assert words.packed(text.encode()) == library_ids(words, text)


def test_ids_of_all_characters():
    words = packing.word_ids()
    for start in range(0, 0x30000, 512):
        text = "".join(f"a{chr(c)} {chr(c)}{chr(c)}1,{chr(c)}.' " for c in range(start, start + 512) if not 0xD800 <= c < 0xE000)
        assert words.packed(text.encode()) == library_ids(words, text), hex(start)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=4))
def test_ids_of_any_texts(texts):
    words = packing.word_ids()
    assert words.packed_all([t.encode() for t in texts]) == [library_ids(words, t) for t in texts]


def test_memo_changes_over(monkeypatch):
    monkeypatch.setattr(packing, "MEMO_WORDS", 50)
    words, rng = packing.WordIds(), random.Random(3)
    for _ in range(40):
        text = " ".join(rng.choice("abcdeé") * rng.randint(1, 20) for _ in range(30))
        assert words.packed(text.encode()) == library_ids(words, text)
        assert len(words.memo) <= 50


def best_level(counts, size, length):
    """The definition: try every level and sum the squares."""
    tried = []
    for level in range(length - size + 1):
        if level and not counts[level]:
            continue
        after = counts.copy()
        after[level] -= level > 0
        if level + size < length:
            after[level + size] += 1
        tried.append(((after[1:] ** 2).sum(), -level))
    return -min(tried)[1]


@pytest.mark.parametrize("length", [8, 16, 31])
@pytest.mark.parametrize("most_open", [1, 4, 1000])
def test_windows(length, most_open):
    rng, made, texts = random.Random(length), [], {}
    packer = packing.Packer(lambda *piece: made.append(piece), length, 0, most_open)
    for d in range(300):
        size = rng.choice([1, 2, 3, 5, 7, length - 1, length, length + 1, 3 * length + 2])
        texts[d] = (np.arange(size, dtype="<u4") + 1000 * d).tobytes()
        if size % length:
            assert packer.level_for(size % length) == best_level(packer.counts, size % length, length)
        packer.add(d, texts[d])
        assert packer.n_open == packer.counts.sum() == sum(map(len, packer.levels)) <= most_open
    packer.fill()
    check_pieces([(d, start, ids, sequence, offset) for (d, start, ids), sequence, offset in made], texts, length, 4 if most_open > 4 else None)


def check_pieces(pieces, texts, length, short=None):
    """Every id lies in one piece; sequences have no gaps and are full, or of a power-of-two length."""
    by_document, by_sequence = defaultdict(list), defaultdict(list)
    for d, start, ids, sequence, offset in pieces:
        by_document[d].append((start, ids))
        by_sequence[sequence].append((offset, len(ids) // 4))
    assert set(by_document) == set(texts)
    for d, parts in by_document.items():
        at = 0
        for start, ids in sorted(parts):
            assert start == at and ids
            at += len(ids) // 4
        assert b"".join(ids for _, ids in sorted(parts)) == texts[d]
    sizes = []
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == length or at & (at - 1) == 0 and at < length
        sizes.append(at)
    if short is not None:
        assert sum(s < length for s in sizes) <= short


def test_pack(spark):
    texts = [*ODD, *SAMPLES, *["some words of middling length " * k for k in range(60)]]
    df = docs(spark, texts).repartition(2)
    words = packing.word_ids()
    whole = {i: library_ids(words, t or "") + b"\x01\0\0\0" for i, t in enumerate(texts)}
    rows = packing.pack(df).collect()
    pieces = []
    for r in rows:
        ids = whole[r.doc_id][4 * r.start : 4 * (r.start + r.length)]
        assert (zlib.crc32(ids), len(whole[r.doc_id]) // 4) == (r.ids_crc32, r.doc_tokens)
        pieces.append((r.doc_id, r.start, ids, r.sequence_id, r.offset))
    check_pieces(pieces, whole, packing.LENGTH, 22)
    assert rows == packing.pack(df).collect()


def test_pack_odd_tables(spark):
    df = docs(spark, ["same", "same", None], [7, 7, None])
    assert sorted((r.doc_id or -1, r.start, r.length, r.doc_tokens) for r in packing.pack(df.coalesce(1)).collect()) == [(-1, 0, 1, 1), (7, 0, 2, 2), (7, 0, 2, 2)]
    assert packing.pack(df.limit(0)).count() == 0
    named = df.selectExpr("cast(doc_id as string) AS `a.b`", "text AS `start`", "text AS offset")
    assert packing.pack(named, "a.b", "start").columns == ["a.b", *packing.NUMBERS]
