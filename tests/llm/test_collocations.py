"""Collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestar.llm import collocations as co
from tests.llm.test_operators import ODD, docs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=30, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) from (lang, text)."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts[lang].update(tuple(words[i : i + n]) for n in range(1, 5) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if a >= least}
        inside = Counter()
        for p, a in found.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    inside[p[i : i + n]] = max(inside[p[i : i + n]], a)
        kept = []
        for p, a in found.items():
            if len(p) > 1 and 100 * inside[p] < 80 * a:
                score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, totals[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def frame(spark, rows):
    return docs(spark, [t for _, t in rows], None, [g for g, _ in rows])


def sentences(rng, n, words):
    """Text of a few common phrases among rarer words."""
    made = []
    for _ in range(n):
        made.append(rng.choice(["new york city", "New York", "in the new house of", "a a a a a", "the of", " ".join(rng.choices(words, k=rng.randint(1, 6)))]))
    return "".join(m + rng.choice([" ", "  ", "\t", ". ", ",", "!\n", " \x0b", "? "]) for m in made)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(12)] + ["é", "Éa", "don't", "\x85x", "x\xa0y", "-"]
    some = [(rng.choice(["en", "en", "de", None, "und", ""]), sentences(rng, rng.randint(0, 120), words)) for _ in range(150)]
    return some + [("en", t) for t in ODD] + [("de", some[0][1])] * 40 + [("en", "one two three four five. " * 200)]


def test_against_counting(spark, rows):
    got = co.collocations(frame(spark, rows).repartition(3))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows)


@pytest.mark.parametrize("budget", [40, 300, 3000])
def test_split_prefixes(spark, rows, monkeypatch, budget):
    """Prefixes that don't fit a group are split by another word, up to whole suffixes, and their counts put together again."""
    seen = []
    whole = co.vertical_partition
    monkeypatch.setattr(co, "GROUP_SUFFIXES", budget)
    monkeypatch.setattr(co, "CHUNK_WORDS", 2000)
    monkeypatch.setattr(co, "COMMON", budget // 30)
    monkeypatch.setattr(co, "vertical_partition", lambda *a: seen.append(whole(*a)) or seen[-1])
    assert sorted(map(tuple, co.collocations(frame(spark, rows).repartition(2)).collect())) == brute(rows)
    assert len(seen[0].large) == 3 if budget == 40 else seen[0].large
    assert seen[0].group_of.max() > 3


def test_shared_hashes_take_another_seed(spark, rows, monkeypatch):
    real = co.chunks
    seeds = []

    def weak(df, lang, text, seed):
        seeds.append(seed)
        held = real(df, lang, text, seed)
        if seed:
            return held
        return held.withColumn("hashes", co.F.expr("cast(repeat('12345678', cast(length(hashes) / 8 as int)) as binary)"))

    monkeypatch.setattr(co, "chunks", weak)
    assert sorted(map(tuple, co.collocations(frame(spark, rows)).collect())) == brute(rows)
    assert seeds == [0, 1]


def test_top_and_ties(spark, monkeypatch):
    texts = [("en", f"b{i} a{i}. " * 30 + f"a{i} c{i}! " * 30) for i in range(40)]
    got = co.collocations(frame(spark, texts), top=10).collect()
    assert [tuple(r) for r in got] and sorted(map(tuple, got)) == brute(texts, top=10)


def test_nothing(spark):
    assert co.collocations(frame(spark, [("en", "x")]).limit(0)).count() == 0
    assert co.collocations(frame(spark, [(None, None), ("en", ""), ("en", "too few words here")])).count() == 0


def test_filter_says_yes_to_all_its_words(spark):
    hashes = np.random.default_rng(0).integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    words = spark.createDataFrame([(int(h),) for h in hashes[:2000].view(np.int64)], "h long")
    keep = co.Filter(words, 2000)
    assert keep(hashes[:2000]).all() and keep(hashes[2000:]).mean() < 0.1


def test_common_words_are_bounded(spark, monkeypatch):
    words = spark.createDataFrame([(i, n) for i, n in enumerate([1000, 900, 40, 40, 40, 39, 31])], "h long, n long")
    for most, want in ((0, []), (1, [0]), (2, [0, 1]), (4, [0, 1]), (5, [0, 1, 2, 3, 4]), (6, [0, 1, 2, 3, 4, 5]), (99, [0, 1, 2, 3, 4, 5, 6])):
        monkeypatch.setattr(co, "COMMON", most)
        assert co.most_common(words).tolist() == want


def test_big_counts_score_exactly(spark):
    a, left, right = 5 * 10**12 + 1, 7 * 10**12, 9 * 10**12 + 7
    found = spark.createDataFrame([(1, 2, 0, 0, a, 2)], "k1 long, k2 long, k3 long, k4 long, a long, depth int")
    words = spark.createDataFrame([(1, left), (2, right)], "h long, n long")
    assert co.scored(found, words).first().score == 2_000_000 * a // (left + right)
