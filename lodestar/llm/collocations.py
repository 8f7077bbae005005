"""Collocations of two to four words by vertically partitioned suffix trees.

Texts are read once into chunks of word numbers in the shared folder. Words are known by a hash of
language and word; a second hash beside it in the table of their counts shows that no two share one. A suffix is the up to
four words from a place to the end of its piece; it ends before a word that is too rare to be in any
candidate. Prefixes of suffixes are counted a word longer at a time wherever a prefix has more
occurrences than fit the memory of a task, so that what remains are prefixes of one to four words,
none too large, and these are grouped up to that memory. Each chunk sends its distinct suffixes,
with counts, to the groups; a group sorts its suffixes into a subtree of depth four, sums the leaves
below every node, and gives out the nodes that occur often enough. Nodes above a prefix that was
split over groups are summed once more. Cuts and containment are joins of the frequent phrases.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.columns import cut, remove, shared_dir, small_batches

LEAST = 30
DEPTH = 4
TOP = 2000
SCALE = 2_000_000
#: A candidate goes if a longer one around it has at least this share, in hundredths, of its count.
COVERED = 80
#: Words of a chunk, and suffixes of a group, that a task holds.
CHUNK_WORDS = 1 << 21
GROUP_SUFFIXES = 1 << 22
#: Buckets of prefixes for each group that they are gathered into.
SPREAD = 8
#: The most frequent words, 512 KB of hashes, have numbers that all tasks know; others are sent with their hashes.
COMMON = 1 << 16
#: The filter of frequent words has at most 2^27 bits, 16 MB; words that share a bit with one are counted for nothing.
FILTER_BITS = 27
KEYS = ("k1", "k2", "k3", "k4")
NO_LANGUAGE = "und"
#: Piece ends become full stops; A-Z become a-z.
ENDS = bytes(46 if b in b".,;:!?\n\v\f\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))


def pieces(text: bytes | None) -> list[bytes]:
    """The text's words, with a full stop between pieces."""
    return (text or b"").translate(ENDS).replace(b".", b" . ").split()


class _Numbers(dict):
    """Numbers for the words of one language, from 1 on over all languages of a chunk; a full stop is 0."""

    def __init__(self, lang: int, words: list):
        super().__init__({b".": 0})
        self.lang, self.words = lang, words

    def __missing__(self, word: bytes) -> int:
        self.words.append((self.lang, word))
        self[word] = len(self.words)
        return len(self.words)


CHUNK = "langs array<string>, lang_of binary, words binary, hashes binary, checks binary, counts binary, places binary"


def chunks(df: DataFrame, lang: str, text: str, seed: int) -> DataFrame:
    """Numbered words of about ``CHUNK_WORDS`` words of text a row, with the words, their languages, hashes and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos, words, langs, held, size = {}, [], [], [], 0

        def made() -> pa.RecordBatch:
            places = np.concatenate(held)
            counts = np.bincount(places, minlength=len(words) + 1)[1:]
            tags = [g.encode() + b"\0" for g in langs]
            hashes = np.array([xxhash.xxh64_intdigest(tags[g] + w, seed) or 1 for g, w in words], np.uint64)
            checks = np.array([xxhash.xxh32_intdigest(tags[g] + w, seed) for g, w in words], np.uint32)
            row = [langs, np.array([g for g, _ in words], np.uint32).tobytes(), b"\n".join(w for _, w in words), hashes.tobytes(), checks.tobytes(), counts.astype(np.uint32).tobytes(), places.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.list_(pa.string())), *[pa.array([v], pa.binary()) for v in row[1:]]], ["langs", "lang_of", "words", "hashes", "checks", "counts", "places"])

        for batch in batches:
            for g, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                g = NO_LANGUAGE if g is None else g
                if g not in memos:
                    memos[g] = _Numbers(len(langs), words)
                    langs.append(g)
                own = pieces(t)
                held += [np.fromiter(map(memos[g].__getitem__, own), np.uint32, len(own)), np.zeros(1, np.uint32)]
                size += len(own) + 1
                if size >= CHUNK_WORDS:
                    yield made()
                    memos, words, langs, held, size = {}, [], [], [], 0
        if words:
            yield made()

    return df.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, CHUNK)


def _uint(column: pa.Array, i: int, kind=np.uint32) -> np.ndarray:
    return np.frombuffer(column[i].as_buffer(), kind)


def word_counts(held: DataFrame) -> DataFrame:
    """(h, other, lang, n) of every chunk's words; ``other`` is a second hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                langs = pa.DictionaryArray.from_arrays(pa.array(_uint(batch.column(1), i).astype(np.int32)), pa.array(batch.column(0)[i].as_py(), pa.string())).dictionary_decode()
                yield pa.RecordBatch.from_arrays([pa.array(_uint(batch.column(2), i, np.int64)), pa.array(_uint(batch.column(3), i, np.int32)), langs, pa.array(_uint(batch.column(4), i).astype(np.int64))], ["h", "other", "lang", "n"])

    return held.select("langs", "lang_of", "hashes", "checks", "counts").mapInArrow(run, "h bigint, other int, lang string, n bigint")


def spelled(held: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, word) of the words whose hashes are in ``wanted``, read off the chunks."""
    keep = Filter(wanted, wanted.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                hashes = _uint(batch.column(1), i, np.uint64)
                at = np.flatnonzero(keep(hashes))
                words = batch.column(0)[i].as_py().split(b"\n") if len(at) else []
                yield pa.RecordBatch.from_arrays([pa.array(hashes[at].view(np.int64)), pa.array([words[j].decode() for j in at], pa.string())], ["h", "word"])

    return held.select("words", "hashes").mapInArrow(run, "h bigint, word string").join(wanted, "h", "left_semi").distinct()


def language_totals(held: DataFrame) -> DataFrame:
    """(lang, n): all word occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                langs = batch.column(0)[i].as_py()
                n = np.zeros(len(langs), np.int64)
                np.add.at(n, _uint(batch.column(1), i), _uint(batch.column(2), i).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(n)], ["lang", "n"])

    return held.select("langs", "lang_of", "counts").mapInArrow(run, "lang string, n bigint").groupBy("lang").agg(F.sum("n").alias("n"))


class Filter:
    """The frequent words' hashes as a bitmap of bounded size; says yes to all of them, and to few others."""

    def __init__(self, words: DataFrame, n_words: int):
        self.bits = min(FILTER_BITS, max(15, (32 * max(n_words, 1)).bit_length()))
        at = F.shiftrightunsigned("h", 64 - self.bits)
        slices = words.groupBy(F.shiftright(at, 15).alias("slice")).agg(F.bitmap_construct_agg(at.bitwiseAND(32767)).alias("bits")).collect()
        self.map = np.zeros(1 << (self.bits - 3), np.uint8)
        for r in slices:  # 4 KB each, at most 4,096 of them
            self.map[4096 * r["slice"] :][:4096] = np.frombuffer(r["bits"], np.uint8)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - self.bits)
        return (self.map[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def suffixes(places: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Rows of up to ``DEPTH`` word numbers, 0 beyond their end: the suffixes of at least two words that can be in candidates."""
    own = np.where(frequent[places], places, 0)
    padded = np.concatenate([own, np.zeros(DEPTH, own.dtype)])
    rows = np.empty((len(own), DEPTH), np.uint32)
    going = np.ones(len(own), bool)
    for d in range(DEPTH):
        here = padded[d : d + len(own)]
        going = going & (here != 0)
        rows[:, d] = np.where(going, here, 0)
    return rows[rows[:, 1] != 0]


def prefix_key(hashes: np.ndarray, depth: int) -> np.ndarray:
    """A number for the first ``depth`` words of each row of hashes; what shares one is only kept together."""
    key = hashes[:, 0]
    for d in range(1, depth):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + hashes[:, d]
        key = (key ^ (key >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return key


def among(keys: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted array ``held``."""
    if not len(held):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
    return held[at] == keys


class Partition:
    """Prefixes that are split by another word (``large``, by depth), and the group of every bucket of the others.

    What it holds is bounded by the number of groups: prefixes with more occurrences than a group, and buckets.
    """

    def __init__(self, large: list[np.ndarray], bits: int, group_of: np.ndarray):
        self.large, self.bits, self.group_of = large, bits, group_of

    def groups(self, hashes: np.ndarray) -> np.ndarray:
        """The group of each row's shortest prefix that isn't split."""
        key, split = hashes[:, 0], np.ones(len(hashes), bool)
        for depth, large in enumerate(self.large, 1):
            split = split & among(prefix_key(hashes, depth), large)
            if not split.any():
                break
            key = np.where(split, prefix_key(hashes, depth + 1), key)
        return self.group_of[key >> np.uint64(64 - self.bits)]

    def spread(self, hashes: np.ndarray, depth: int) -> np.ndarray:
        """Which rows' first ``depth`` words lie in more than one group."""
        split = np.ones(len(hashes), bool)
        for d in range(1, depth + 1):
            split = split & (among(prefix_key(hashes, d), self.large[d - 1]) if d <= len(self.large) else False)
        return split


def _chunk_suffixes(batch: pa.RecordBatch, i: int, keep: Filter) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's hashes, by number, and suffixes."""
    hashes = np.concatenate([np.zeros(1, np.uint64), _uint(batch.column(0), i, np.uint64)])
    frequent = keep(hashes)
    frequent[0] = False
    return hashes, suffixes(_uint(batch.column(1), i), frequent)


def prefix_counts(held: DataFrame, keep: Filter, large: list[np.ndarray]) -> DataFrame:
    """(h, n) of prefixes one word longer than the last of ``large``, below those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                hashes, rows = _chunk_suffixes(batch, i, keep)
                for depth, known in enumerate(large, 1):
                    rows = rows[among(prefix_key(hashes[rows[:, :depth]], depth), known)]
                keys, n = np.unique(prefix_key(hashes[rows[:, : len(large) + 1]], len(large) + 1), return_counts=True)
                if len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    return held.select("hashes", "places").mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def vertical_partition(held: DataFrame, words: DataFrame, keep: Filter, total: int, budget: int) -> Partition:
    """Prefixes of one to four words, lengthened wherever one has over ``budget`` occurrences, grouped up to it."""
    bits = min(63, max(4, (SPREAD * total // budget).bit_length()))
    loads, large = np.zeros(1 << bits, np.int64), []
    counts = words.select("h", "n")
    for depth in range(1, DEPTH + 1):
        # A whole suffix is one row a chunk, however often it occurs.
        light = counts.filter(F.col("n") <= budget) if depth < DEPTH else counts.select("h", F.least("n", F.lit(budget)).alias("n"))
        for r in light.groupBy(F.shiftrightunsigned("h", 64 - bits).alias("bucket")).agg(F.sum("n").alias("n")).collect():
            loads[r["bucket"]] += r["n"]
        if depth == DEPTH:
            break
        found = [r["h"] for r in counts.filter(F.col("n") > budget).select("h").collect()]  # fewer than total / budget
        if not found:
            break
        large.append(np.sort(np.array(found, np.int64).view(np.uint64)))
        counts = cut(prefix_counts(held, keep, large))
    group_of, group, load = np.empty(len(loads), np.int32), 0, 0
    for b, n in enumerate(loads.tolist()):
        if load and load + n > budget:
            group, load = group + 1, 0
        group_of[b], load = group, load + n
    return Partition(large, bits, group_of)


def most_common(words: DataFrame) -> np.ndarray:
    """Hashes of at most ``COMMON`` words, those over a count that so many reach, the most frequent first; their numbers count from 1."""
    steps = F.floor(F.log2("n") * 16).cast("int")
    least, held = None, 0
    for r in sorted(words.groupBy(steps.alias("step")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r["step"]):
        held += r["words"]
        if held > COMMON:
            break
        least = r["step"]
    if least is None:
        return np.empty(0, np.uint64)
    found = sorted((-r["n"], r["h"]) for r in words.filter(steps >= least).select("n", "h").collect())
    return np.array([h for _, h in found], np.int64).view(np.uint64)


def grouped_suffixes(held: DataFrame, keep: Filter, partition: Partition, common: np.ndarray) -> DataFrame:
    """(group, n, hashes, suffixes, counts): each chunk's distinct suffixes for a group.

    Numbers up to that of ``common`` are of those words, larger ones of the ``hashes`` sent along.
    """
    by = np.argsort(common)
    ordered = common[by]

    def numbers(hashes: np.ndarray) -> np.ndarray:
        """Of a chunk's words: their numbers among the common ones, or 0."""
        if not len(ordered):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(ordered, hashes), len(ordered) - 1)
        return np.where(ordered[at] == hashes, by[at] + 1, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                hashes, rows = _chunk_suffixes(batch, i, keep)
                rows, counts = distinct(rows, np.ones(len(rows), np.int64))
                if not len(rows):
                    continue
                group, known = partition.groups(hashes[rows]), numbers(hashes)
                order = np.argsort(group, kind="stable")
                starts = np.flatnonzero(np.diff(group[order], prepend=-1))
                out = []
                for a, b in zip(starts, [*starts[1:], len(order)], strict=True):
                    at = order[a:b]
                    cells = rows[at].T.ravel()
                    named = known[cells]
                    rest = np.flatnonzero((named == 0) & (cells != 0))
                    own, place = np.unique(cells[rest], return_inverse=True)
                    named[rest] = len(common) + 1 + place
                    out.append((int(group[at[0]]), len(at), hashes[own].tobytes(), _small(named), _small(counts[at])))
                for j in range(0, len(out), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[j : j + 64], strict=True), (pa.int32(), pa.int64(), *[pa.binary()] * 3), strict=True)], ["group", "n", "hashes", "suffixes", "counts"])

    return held.select("hashes", "places").mapInArrow(run, "group int, n bigint, hashes binary, suffixes binary, counts binary")


def _small(values: np.ndarray) -> bytes:
    """Numbers under 2^32 in few bytes: their first bytes together, then their second ones, and so on."""
    return pa.compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _large(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 4 * n, codec="zstd"), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def distinct(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in lexicographic order, each once, with the sums of their counts."""
    if not len(rows):
        return rows, counts
    wide = rows.astype(np.uint64)
    left, right = (wide[:, c] << np.uint64(32) | wide[:, c + 1] for c in (0, 2))
    order = np.lexsort((right, left))
    left, right = left[order], right[order]
    starts = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])]))
    return rows[order[starts]], np.add.reduceat(counts[order], starts)


def subtree(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], partition: Partition, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(hashes by depth, count) of the nodes of two words or more, from (hashes, suffixes, counts): those with enough leaves, and those that other groups share."""
    hashes = np.unique(np.concatenate([np.zeros(1, np.uint64), *[h for h, _, _ in parts]]))
    numbers = [np.concatenate([[0], np.searchsorted(hashes, h)]).astype(np.uint32) for h, _, _ in parts]  # hashes needn't be sorted
    rows, leaves = distinct(np.concatenate([n[s] for n, (_, s, _) in zip(numbers, parts, strict=True)]), np.concatenate([c for _, _, c in parts]))
    nodes, counts, new = [np.empty((0, DEPTH), np.uint64)], [np.empty(0, np.int64)], np.zeros(len(rows), bool)
    new[0] = True
    for depth in range(1, DEPTH + 1):
        new[1:] |= rows[1:, depth - 1] != rows[:-1, depth - 1]
        starts = np.flatnonzero(new)
        n, heads = np.add.reduceat(leaves, starts), rows[starts]
        real = (heads[:, depth - 1] != 0) & (depth > 1)
        n, heads = n[real], hashes[np.where(np.arange(DEPTH) < depth, heads[real], 0)]
        kept = (n >= least) | partition.spread(heads, depth)
        nodes.append(heads[kept])
        counts.append(n[kept])
    return np.concatenate(nodes), np.concatenate(counts)


def phrases(blobs: DataFrame, partition: Partition, common: np.ndarray) -> DataFrame:
    """(k1, ..., k4, depth, a): the frequent phrases of two words or more by their words' hashes, 0 beyond their end."""

    def run(table: pa.Table) -> pa.Table:
        parts = []
        for i in range(table.num_rows):
            n, h, s, c = (table.column(name)[i].as_py() for name in ("n", "hashes", "suffixes", "counts"))
            own, renamed = np.unique(np.concatenate([[0], _large(s, DEPTH * n)]), return_inverse=True)
            hashes = np.concatenate([np.zeros(1, np.uint64), common, np.frombuffer(h, np.uint64)])[own[1:]]
            parts.append((hashes, renamed[1:].reshape(DEPTH, -1).T, _large(c, n).astype(np.int64)))
        nodes, counts = subtree(parts, partition)
        return pa.table({**{k: pa.array(nodes[:, d].copy().view(np.int64)) for d, k in enumerate(KEYS)}, "a": pa.array(counts, pa.int64())})

    nodes = blobs.groupBy("group").applyInArrow(run, "k1 bigint, k2 bigint, k3 bigint, k4 bigint, a bigint")
    whole = nodes.groupBy(*KEYS).agg(F.sum("a").alias("a")).filter(F.col("a") >= LEAST)
    return whole.withColumn("depth", sum((F.col(k) != 0).cast("int") for k in KEYS))


def _part(first: int, stop: int) -> list:
    """The words from ``first`` up to before ``stop`` as keys q1 to q4."""
    return [(F.col(KEYS[first + i]) if first + i < stop else F.lit(0).cast("bigint")).alias(f"q{i + 1}") for i in range(DEPTH)]


def scored(found: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates that no longer one covers, with l, r and score of their lowest-scoring cut."""
    asked = F.array(*[
        F.when(F.col("depth") == d, F.struct(F.lit(2 * k + side).alias("cell"), *_part(0, k) if side == 0 else _part(k, d)))
        for d in range(2, DEPTH + 1) for k in range(1, d) for side in (0, 1)
    ])
    known = found.select(*[F.col(k).alias(f"q{i}") for i, k in enumerate(KEYS, 1)], F.col("a").alias("f"))
    single = words.select(F.col("h").alias("q1"), *[F.lit(0).cast("bigint").alias(f"q{i}") for i in range(2, DEPTH + 1)], F.col("n").alias("f"))
    requests = found.select(*KEYS, "a", "depth", F.inline(F.array_compact(asked)))
    answers = requests.join(known.unionByName(single), [f"q{i}" for i in range(1, DEPTH + 1)])
    at = lambda cell: F.max(F.when(F.col("cell") == cell, F.col("f"))).alias(f"f{cell}")
    cells = answers.groupBy(*KEYS, "a", "depth").agg(*[at(2 * k + side) for k in range(1, DEPTH) for side in (0, 1)])
    ratio = lambda k: F.expr(f"CAST(CAST(a AS DECIMAL(20)) * {SCALE} div CAST(f{2 * k} + f{2 * k + 1} AS DECIMAL(20)) AS BIGINT)")
    cuts = F.array_compact(F.array(*[F.when(F.col("depth") > k, F.struct(ratio(k).alias("score"), F.lit(k).alias("k"), F.col(f"f{2 * k}").alias("l"), F.col(f"f{2 * k + 1}").alias("r"))) for k in range(1, DEPTH)]))
    inner = F.array(*[F.when(F.col("depth") == d, F.struct(*_part(i, i + n))) for d in range(3, DEPTH + 1) for n in range(2, d) for i in range(d - n + 1)])
    around = found.filter(F.col("depth") > 2).select(F.col("a").alias("f"), F.inline(F.array_compact(inner))).groupBy(*[F.col(f"q{i}").alias(k) for i, k in enumerate(KEYS, 1)]).agg(F.max("f").alias("longer"))
    open_ = cells.join(around, list(KEYS), "left").filter(F.col("longer").isNull() | (F.col("longer").cast("decimal(20)") * 100 < F.col("a").cast("decimal(20)") * COVERED))
    return open_.select(*KEYS, "a", F.array_min(cuts).alias("cut")).select(*KEYS, "a", "cut.l", "cut.r", "cut.score")


def best(candidates: DataFrame, words: DataFrame, held: DataFrame, top: int = TOP) -> DataFrame:
    """Each language's first candidates, in words.

    Ranks without the words leave the first ``top`` and their ties, of which every task keeps its own first
    before they meet; only their words are looked up.
    """
    by_lang = Window.partitionBy("lang")
    named = candidates.join(words.select(F.col("h").alias("k1"), "lang"), "k1")
    first = cut(named.withColumn("at", F.rank().over(by_lang.orderBy(F.desc("score"), F.desc("a")))).filter(F.col("at") <= top))
    wanted = cut(first.select(F.explode(F.array(*KEYS)).alias("h")).filter("h <> 0").distinct())
    spellings = cut(spelled(held, wanted))
    for i, k in enumerate(KEYS, 1):
        first = first.join(spellings.select(F.col("h").alias(k), F.col("word").alias(f"w{i}")), k, "left")
    first = first.withColumn("phrase", F.concat_ws(" ", *[f"w{i}" for i in range(1, DEPTH + 1)]))
    ranked = first.withColumn("rank", F.row_number().over(by_lang.orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("bigint")).filter(F.col("rank") <= top)
    return ranked.join(language_totals(held), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(df: DataFrame, lang: str = "lang", text: str = "text", top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two to four words.

    Null texts are empty and null languages ``und``; empty texts and texts of any length, repeated
    rows (which count again) and empty tables (which give no rows) are whole input. Ties in score go by
    count and then by phrase. Other columns are left out, whatever their names. The chunks are deleted
    once the result, at most ``top`` rows a language, is written.
    """
    spark = df.sparkSession
    small_batches(spark)
    folder = f"{shared_dir(spark)}/phrases-{uuid.uuid4().hex}"
    seed = 0
    while True:
        held, words = _read(spark, df, lang, text, f"{folder}/{seed}", seed)
        if words.filter("clash").isEmpty():
            break
        seed += 1  # two words share a hash: another one
    stats = words.agg(F.count("*").alias("words"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    keep = Filter(words, stats["words"])
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    budget = min(GROUP_SUFFIXES, max(1, stats["n"] // (2 * tasks)))
    partition = vertical_partition(held, words, keep, stats["n"], budget)
    common = most_common(words)
    found = cut(phrases(grouped_suffixes(held, keep, partition, common), partition, common))
    out = cut(best(scored(found, words), words, held, top))
    remove(spark, folder)
    return out


def _read(spark: SparkSession, df: DataFrame, lang: str, text: str, path: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """Chunks, and words that are frequent or share a hash."""
    chunks(df, lang, text, seed).write.option("compression", "zstd").parquet(path)
    held = spark.read.schema(CHUNK).parquet(path)
    words = word_counts(held).groupBy("h").agg(F.sum("n").alias("n"), F.min("lang").alias("lang"), (F.min("other") != F.max("other")).alias("clash"))
    return held, cut(words.filter((F.col("n") >= LEAST) | F.col("clash")))


def oracle() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH piece AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM
  (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents)),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM piece GROUP BY lang),
found AS MATERIALIZED (SELECT lang, w, count(*)::BIGINT AS f FROM
  (SELECT lang, ws[s + 1 : s + size] AS w FROM (SELECT lang, ws, size, unnest(range(len(ws) - size + 1)) AS s FROM piece, (SELECT unnest(range(1, {DEPTH + 1})) AS size) WHERE len(ws) >= size))
  GROUP BY lang, w HAVING count(*) >= {LEAST}),
cuts AS (SELECT lang, w, f, unnest(range(1, len(w))) AS k FROM found WHERE len(w) > 1),
valued AS (SELECT c.lang, c.w, c.f AS a, c.k, x.f AS l, y.f AS r, ({SCALE} * c.f::HUGEINT // (x.f + y.f))::BIGINT AS score
  FROM cuts c JOIN found x ON x.lang = c.lang AND x.w = c.w[1 : c.k] JOIN found y ON y.lang = c.lang AND y.w = c.w[c.k + 1 :]),
lowest AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1),
inside AS (SELECT lang, w[i + 1 : i + m] AS w, max(f) AS longer FROM (SELECT lang, w, f, m, unnest(range(len(w) - m + 1)) AS i FROM (SELECT lang, w, f, unnest(range(2, len(w))) AS m FROM found WHERE len(w) > 2)) GROUP BY ALL)
SELECT lang, rank, phrase, a, l, r, n, score FROM
  (SELECT lang, array_to_string(w, ' ') AS phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(w, ' ')) AS rank
   FROM lowest LEFT JOIN inside USING (lang, w) WHERE longer IS NULL OR 100 * longer::HUGEINT < {COVERED} * a::HUGEINT) JOIN totals USING (lang)
WHERE rank <= {TOP}
"""
