"""Benchmark decontamination by a prefix-filtered set join with exact verification.

A benchmark item is cut into windows of ``WINDOW`` consecutive words (an item of fewer words is one
window), a window into shingles of ``SHINGLE`` words. Shingles are ordered by how often they occur
in the documents. Full containment of a window needs every one of its shingles, so the necessary
prefix is one shingle: its rarest. Documents meet windows on that shingle only; a pair goes on if
the window fits between the text's start and end when laid over the meeting place (positional and
length bounds), and counts if its words are equal there, word by word.

The benchmark is processed in blocks of at most ``BLOCK_BYTES`` of text, each a broadcast of bounded
size (arrays of some twenty times the text), against all documents. One block needs no shuffle of documents. With more blocks, what each
block finds is written to the shared folder and united by the text's digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.columns import column_function, cut, free_name, plain_words, quoted, small_batches

WINDOW = 13
SHINGLE = 5
#: Contaminated: at least one word in this many is hit.
SHARE = 20
BLOCK_BYTES = 16 << 20
#: Pairs of a place and a window that are compared at once.
PAIRS = 1 << 16

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 22


def rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every run of k ids."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = (h + ids[i : i + n].astype(np.uint64) + np.uint64(1)) * _BASE
        h ^= h >> np.uint64(29)
    return h


class Block:
    """The windows of some benchmark items as flat arrays and, once ``order`` has set it, their prefix index.

    Words are numbered and items laid end to end; a window is a start and a length there. So a block
    takes a few dozen bytes a word, whatever its windows overlap.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int, shingle: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[str] = []
        words, starts, lengths, owners = [], [], [], []
        at = 0
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in plain_words(text)]
            if not ids:
                continue
            n = max(1, len(ids) - window + 1)
            words.append(np.array(ids, np.int32))
            starts.append(np.arange(at, at + n, dtype=np.int64))
            lengths.append(np.full(n, min(window, len(ids)), np.int32))
            owners.append(np.full(n, len(self.names), np.int32))
            self.names.append(item)
            at += len(ids)
        flat = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        self.words, self.starts, self.lengths, self.owners = flat(words, np.int32), flat(starts, np.int64), flat(lengths, np.int32), flat(owners, np.int32)
        self.shingle = shingle
        self._collapse()
        self.sizes = sorted({min(shingle, int(n)) for n in np.unique(self.lengths)})
        self.hashes = np.unique(np.concatenate([np.empty(0, np.uint64), *[self._shingles(n).ravel() for n in np.unique(self.lengths)]]))
        self._filter(self.hashes)

    def _collapse(self) -> None:
        """Keeps equal windows once: ``owners[first[w]:first[w + 1]]`` are the items of window w."""
        whole = np.zeros(len(self.starts), np.uint64)
        for n in np.unique(self.lengths):
            here = self.lengths == n
            whole[here] = rolling(self.words, int(n))[self.starts[here]]
        by = np.lexsort((self.owners, whole, self.lengths))
        starts, lengths, whole = self.starts[by], self.lengths[by], whole[by]
        same = np.zeros(len(by), bool)
        same[1:] = (lengths[1:] == lengths[:-1]) & (whole[1:] == whole[:-1])
        for i in range(int(lengths.max(initial=0))):
            at = np.flatnonzero(same & (lengths > i))
            same[at] = self.words[starts[at] + i] == self.words[starts[at - 1] + i]
        new = np.flatnonzero(~same)
        self.starts, self.lengths, self.owners = starts[new], lengths[new], self.owners[by]
        self.first = np.append(new, len(by))
        self.window = np.arange(len(new))

    def _shingles(self, length: int) -> np.ndarray:
        """Hashes of the shingles of every window of one length, a row for each."""
        k = min(self.shingle, int(length))
        own = self.starts[self.lengths == length]
        return rolling(self.words, k)[own[:, None] + np.arange(int(length) - k + 1)]

    def _filter(self, hashes: np.ndarray) -> None:
        self.filter = np.zeros(1 << _SLOTS, bool) if len(hashes) else None
        if len(hashes):
            self.filter[hashes >> np.uint64(64 - _SLOTS)] = True

    def order(self, shingles: np.ndarray, counts: np.ndarray) -> None:
        """Indexes every window under its rarest shingle, the first of equals; shingles that aren't given don't occur."""
        seen = np.zeros(len(self.hashes), np.int64)
        seen[np.searchsorted(self.hashes, shingles)] = counts
        rank = np.empty(len(self.hashes), np.int64)
        rank[np.lexsort((self.hashes, seen))] = np.arange(len(self.hashes))
        anchor, offset = np.empty(len(self.starts), np.uint64), np.empty(len(self.starts), np.int64)
        for length in np.unique(self.lengths):
            own = self._shingles(length)
            best = rank[np.searchsorted(self.hashes, own)].argmin(axis=1)
            here = self.lengths == length
            offset[here], anchor[here] = best, own[np.arange(len(own)), best]
        by = np.argsort(anchor, kind="stable")
        self.anchors, self.offsets = anchor[by], offset[by]
        self.starts, self.lengths, self.window = self.starts[by], self.lengths[by], self.window[by]
        self.hashes = np.unique(self.anchors)
        self._filter(self.hashes)

    def meetings(self, ids: np.ndarray, known: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions and hashes of the text's shingles that are among the block's, by shingle length."""
        if self.filter is None:
            return
        for k in self.sizes:
            if len(ids) < k:
                continue
            whole = known[: len(known) - k + 1].copy()
            for i in range(1, k):
                whole &= known[i : i + len(whole)]
            at = np.flatnonzero(whole)
            if len(at):
                h = rolling(ids, k)[at]
                hit = self.filter[h >> np.uint64(64 - _SLOTS)]
                at, h = at[hit], h[hit]
                if len(at):
                    hit = np.isin(h, self.hashes)
                    yield at[hit], h[hit]

    def ids_of(self, words: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, 0) for w in words), np.int64, len(words))

    def count(self, words: list[bytes], into: dict[int, int]) -> None:
        ids = self.ids_of(words)
        for _, h in self.meetings(ids, ids > 0):
            for x, n in zip(*(a.tolist() for a in np.unique(h, return_counts=True)), strict=True):
                into[x] = into.get(x, 0) + n

    def hits(self, words: list[bytes]) -> tuple[list[int], list[str]]:
        """Starts and ends of the verified windows' joined spans, flattened, and the items they are of."""
        ids = self.ids_of(words)
        spans, met = [], set()
        for at, h in self.meetings(ids, ids > 0):
            low, high = (np.searchsorted(self.anchors, h, side) for side in ("left", "right"))
            # Pairs of a place and a window under its shingle, a bounded number at once.
            ends = np.cumsum(high - low)
            for first in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
                pair = np.arange(first, min(first + PAIRS, int(ends[-1])))
                place = np.searchsorted(ends, pair, "right")
                window = high[place] - (ends[place] - pair)
                start = at[place] - self.offsets[window]
                fits = (start >= 0) & (start + self.lengths[window] <= len(ids))
                start, window = start[fits], window[fits]
                equal = np.ones(len(start), bool)
                for i in range(int(self.lengths[window].max(initial=0))):
                    within = equal & (self.lengths[window] > i)
                    equal[within] = ids[start[within] + i] == self.words[self.starts[window[within]] + i]
                spans += set(zip(start[equal].tolist(), (start + self.lengths[window])[equal].tolist(), strict=True))
                met.update(np.unique(self.window[window[equal]]).tolist())
        if not met:
            return [], []
        held = np.zeros(len(self.names), bool)
        for w in met:
            held[self.owners[self.first[w] : self.first[w + 1]]] = True
        return joined(set(spans)), sorted({self.names[i] for i in np.flatnonzero(held)})


def joined(spans: list[tuple[int, int]]) -> list[int]:
    """Disjoint spans that cover the same places, flattened."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def blocks(benchmark: DataFrame, item: str, text: str, window: int, shingle: int, block_bytes: int) -> Iterator[Block]:
    """Blocks of bounded size, read partition by partition; rows without item or text have no windows."""
    held, size = [], 0
    rows = benchmark.select(F.col(item).cast("string"), F.col(text).cast("string")).dropna()
    for item_id, value in rows.toLocalIterator():
        held.append((item_id, value.encode()))
        size += len(held[-1][1])
        if size >= block_bytes:
            yield Block(held, window, shingle)
            held, size = [], 0
    if held:
        yield Block(held, window, shingle)


def ordered(docs: DataFrame, text: str, block: Block) -> Block:
    """The block, its shingles ordered by their counts in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, counts = shared.value, {}
        for batch in batches:
            for value in batch.column(0).cast(pa.binary()).to_pylist():
                here.count(plain_words(value), counts)
        keys = np.array(list(counts), np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(list(counts.values()), pa.int64())], ["shingle", "n"])

    # At most one row for each of the block's shingles comes back.
    totals = docs.select(F.col(text).cast("string")).mapInArrow(counted, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n")).toArrow()
    block.order(totals["shingle"].to_numpy().view(np.uint64), totals["n"].to_numpy())
    shared.destroy()
    return block


def hit_column(docs: DataFrame, text: str, block: Block):
    """Struct of n_words, spans (flattened) and items for the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def make():
        here = shared.value

        def rows(texts):
            words = [plain_words(t) for t in texts]
            return [(len(w), *here.hits(w)) for w in words]

        return rows

    fields = {"n_words": "bigint", "spans": "array<bigint>", "items": "array<string>"}
    return column_function(make, fields)(F.col(text).cast("string"))


def with_hits(docs: DataFrame, benchmark: DataFrame, name: str, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` and a struct ``name`` of n_words, spans and items, over all blocks of the benchmark."""
    small_batches(docs.sparkSession)
    found = None
    pending: Block | None = None
    digest = free_name(docs, f"{name}_text")
    for block in blocks(benchmark, item, item_text, window, shingle, block_bytes):
        if pending is not None:
            part = _found(docs, text, pending)
            found = part if found is None else found.unionByName(part)
        pending = ordered(docs, text, block)
    if found is None:
        return docs.withColumn(name, hit_column(docs, text, pending or Block([], window, shingle)))
    united = found.unionByName(_found(docs, text, pending)).groupBy("digest")
    united = united.agg(F.sort_array(F.flatten(F.collect_list("pairs"))).alias("pairs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("found_items"))
    words = column_function(lambda: lambda texts: [len(plain_words(t)) for t in texts], "bigint")
    merge = column_function(lambda: lambda rows: [joined([(p["a"], p["b"]) for p in r or []]) for r in rows], "array<bigint>")
    met = free_name(docs, f"{name}_found")
    united = united.select(F.col("digest").alias(digest), F.struct("pairs", "found_items").alias(met))
    out = docs.withColumn(digest, F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)).join(united, digest, "left")
    struct = F.struct(words(F.col(text).cast("string")).alias("n_words"), merge(F.col(met).getField("pairs")).alias("spans"), F.coalesce(F.col(met).getField("found_items"), F.array().cast("array<string>")).alias("items"))
    return out.select(*quoted(docs), struct.alias(name))


def _found(docs: DataFrame, text: str, block: Block) -> DataFrame:
    """What one block finds, by the digest of the text."""
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.sha2(value, 256).alias("digest"), hit_column(docs, text, block).alias("h")).filter("size(h.items) > 0")
    ends = F.transform("h.spans", lambda v, i: F.struct((i % 2).alias("odd"), v.alias("a"), F.get("h.spans", i + 1).alias("b")))
    ends = F.transform(F.filter(ends, lambda p: p["odd"] == 0), lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b")))
    return cut(rows.select("digest", ends.alias("pairs"), F.col("h.items").alias("items")).dropDuplicates(["digest"]))


def covered(spans: str):
    """Words within flattened, disjoint spans: ends minus starts."""
    signed = F.transform(spans, lambda v, i: F.when(i % 2 == 1, v).otherwise(-v))
    return F.aggregate(signed, F.lit(0).cast("bigint"), lambda a, v: a + v)


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated, and hit_spans (word starts and ends).

    A null or wordless text has no words, no hits and is clean. Repeated documents each keep their
    row; an item that occurs twice in the benchmark counts once. An empty benchmark hits nothing, an
    empty table gives no rows. Texts of any length are read whole. Of a window's shingles that are
    equally rare the one of the least hash is its prefix. Item ids are compared and sorted as
    strings. Other columns of ``docs`` are not read, whatever their names.
    """
    rows = with_hits(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), benchmark, "hits", **options)
    n_hit = covered("hits.spans")
    out = rows.select("key", F.col("hits.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("hits.items").cast("bigint").alias("n_items"), F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"), F.col("hits.spans").alias("hit_spans"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))).withColumnRenamed("key", key)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the contaminated ones; columns stay as they are, nothing is shuffled for one block."""
    mark = free_name(docs, "hits")
    rows = with_hits(docs, benchmark, mark, text)
    hit = covered(f"{mark}.spans")
    return rows.filter(~((hit > 0) & (SHARE * hit >= F.col(f"{mark}.n_words")))).select(*quoted(docs))
