"""Sum-of-squares packing of tokenized documents into sequences of a fixed length.

Documents stream through each task once. What is longer than a sequence is cut into whole sequences
first; the rest goes, as one piece, to the fill level at which the squared counts of partly filled
windows then sum least (a new window is level 0; a full one counts for nothing), read off an array
of counts by level. Windows leave as soon as they are full. At the end of a task, or when more than
``MOST_OPEN`` are open, the emptiest windows are cut up to fill the fullest; what a task has left
over is cut into sequences of power-of-two lengths, so nothing is padded.

Tokens are those of a ``tokenizers`` file. Its library takes each distinct word once: texts in Latin
letters are split into words, digits, contractions and runs of signs as that file's pattern does, others
at ASCII blanks alone, and the ids are kept in two memos of bounded size.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.bpe import byte_symbols
from lodestar.llm.columns import small_batches

LENGTH = 2048
#: Marks the end of a document.
END_ID = 1
#: Open windows hold their ids until they are full: at most 8 KB each.
MOST_OPEN = 4096
MEMO_WORDS = 500_000
#: Starts the memo's entries for what stands between ASCII blanks of other texts; no word has a line feed.
MIXED, MIXED_MARK = 10, b"\n"
#: Words, digits, contractions and runs of signs, after lower-casing A-Z, of a text that ``plain`` holds of.
PARTS = re.compile(rb"[a-z\x80-\xff]+|[0-9]|'(?:[stmd]|re|ve|ll)|[^\sa-z0-9\x80-\xff]+")
#: Text whose characters beyond ASCII are letters that no normalization and no neighbour changes: U+00C0 to U+017F but for U+00D7, U+00F7 and U+0130.
PLAIN = re.compile(rb"(?:[\x00-\x7f]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|\xc5[\x80-\xbf])*+")


def plain(text: bytes) -> bool:
    return text.isascii() or PLAIN.match(text).end() == len(text)


class WordIds:
    """Packed ids (little-endian unsigned 32-bit) of whole texts, equal to the library's without special tokens."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json"))
        self.library.no_truncation()
        self.library.no_padding()
        self.marks = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.spelled = {b: c for c, b in byte_symbols().items()}
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _encoded(self, text: bytes) -> bytes:
        return np.array(self.library.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, parts: set[bytes]) -> None:
        """Puts the parts' ids into the newer memo. A word goes straight to the library's model, spelled by the characters that stand for its bytes."""
        if len(self.memo) + len(parts) > MEMO_WORDS:
            self.memo, self.older = {}, self.memo
        memo, older, spelled, tokens = self.memo, self.older.get, self.spelled, self.library.model.tokenize
        for p in parts:
            if not (ids := older(p)):
                if p[0] == MIXED:
                    ids = self._encoded(p[1:])
                else:
                    word = p.decode("latin-1") if p.isascii() else p.decode().lower().encode().decode("latin-1")
                    ids = b"".join([t.id.to_bytes(4, "little") for t in tokens(word.translate(spelled))])
            memo[p] = ids

    def packed(self, text: bytes) -> bytes:
        return self.packed_all([text])[0]

    def packed_all(self, texts: list[bytes]) -> list[bytes]:
        """Of each text; words that are new are learned together."""
        split, new = [], set()
        for text in texts:
            if any(m in text for m in self.marks):  # a special token's string stands for itself
                split.append((None, [self._encoded(text)]))
                continue
            parts = PARTS.findall(text.lower()) if plain(text) else [MIXED_MARK + c for c in text.split()]
            found = list(map(self.memo.get, parts))
            if None in found:
                new.update([p for p, ids in zip(parts, found, strict=True) if ids is None])
                split.append((parts, found))
            else:
                split.append((None, [b"".join(found)]))
        if new:
            self._learn(new)
        get = self.memo.get
        return [b"".join(found if parts is None else [ids if ids is not None else get(p) for p, ids in zip(parts, found, strict=True)]) for parts, found in split]


@functools.lru_cache(1)
def word_ids(path: str | None = None) -> WordIds:
    """One for each worker, so that its memos outlive a task."""
    return WordIds(path)


class Packer:
    """Windows by fill level; calls ``put(piece, sequence, offset)`` for every piece of a sequence that is done.

    A piece is (document, start, ids as bytes), four bytes an id.
    """

    def __init__(self, put: Callable, length: int = LENGTH, first: int = 0, most_open: int = MOST_OPEN):
        self.put, self.length, self.next, self.most_open = put, length, first, most_open
        self.counts = np.zeros(length, np.int64)
        self.levels: list[list[list]] = [[] for _ in range(length)]
        self.n_open = 0

    def _done(self, pieces: list) -> None:
        offset = 0
        for piece in pieces:
            self.put(piece, self.next, offset)
            offset += len(piece[2]) // 4
        self.next += 1

    def level_for(self, size: int) -> int:
        """The level, 0 for a new window, after which squared counts sum least; of equals the fullest."""
        counts, top = self.counts, self.length - size
        here = counts[1 : top + 1]
        change = -2 * here
        change[:-1] += 2 * counts[size + 1 :] + 2
        change[-1] += 1
        change[here == 0] = np.iinfo(np.int64).max
        best = top - int(change[::-1].argmin())
        return best if change[best - 1] <= 2 * counts[size] + 1 else 0

    def add(self, document, ids: bytes) -> None:
        whole = len(ids) // 4 // self.length * self.length
        for start in range(0, whole, self.length):
            self._done([(document, start, ids[4 * start : 4 * (start + self.length)])])
        if rest := len(ids) // 4 - whole:
            self._place((document, whole, ids[4 * whole :]), rest)

    def _place(self, piece: tuple, size: int) -> None:
        level = self.level_for(size)
        window = self.levels[level].pop() if level else []
        if level:
            self.counts[level] -= 1
        else:
            self.n_open += 1
        window.append(piece)
        if level + size == self.length:
            self.n_open -= 1
            self._done(window)
            return
        self.levels[level + size].append(window)
        self.counts[level + size] += 1
        if self.n_open > self.most_open:
            self.fill(self.most_open // 2)

    def fill(self, keep: int = 0) -> None:
        """Fills the fullest windows with pieces cut from the emptiest until ``keep`` are open; with 0, also ends the last one."""
        order = [(level, w) for level in range(1, self.length) for w in self.levels[level]]
        at, end = 0, len(order)
        spare = list(order[0][1]) if order else []
        while end - at > max(keep, 1):
            end -= 1
            level, window = order[end]
            need = self.length - level
            while need and (spare or at + 1 < end):
                if not spare:
                    at += 1
                    spare = list(order[at][1])
                    continue
                document, start, ids = spare.pop()
                if (size := len(ids) // 4) > need:
                    spare.append((document, start, ids[: 4 * (size - need)]))
                    start, ids = start + size - need, ids[4 * (size - need) :]
                window.append((document, start, ids))
                need -= len(ids) // 4
            if need:  # nothing is left to cut up
                spare = window
                break
            self._done(window)
        left = [spare] if spare else []
        left += [w for _, w in order[at + 1 : end]]
        self.levels = [[] for _ in range(self.length)]
        self.counts[:] = 0
        self.n_open = 0
        for window in left:
            size = sum(len(ids) // 4 for _, _, ids in window)
            if not keep:
                self._powers(window, size)
            elif size:
                self.levels[size].append(window)
                self.counts[size] += 1
                self.n_open += 1

    def _powers(self, pieces: list, size: int) -> None:
        """Sequences whose lengths are the powers of two that sum to ``size``."""
        pieces = pieces[::-1]
        while size:
            need = 1 << (size.bit_length() - 1)
            size, now = size - need, []
            while need:
                document, start, ids = pieces.pop()
                if len(ids) // 4 > need:
                    pieces.append((document, start + need, ids[4 * need :]))
                    ids = ids[: 4 * need]
                now.append((document, start, ids))
                need -= len(ids) // 4
            self._done(now)


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, length: int = LENGTH) -> DataFrame:
    """One row per piece: ``key``, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the end mark alone, so every row has a piece; repeated rows and null keys
    are documents of their own. Texts of any length are cut as often as needed. An empty table gives no
    rows; other columns are left out, whatever their names. Each task packs what it reads, in its
    order: nothing is shuffled, its sequences are numbered from its partition's number times 2^40, and a
    repeated task packs alike. Up to two sequences' worth of rows a task (under ``length`` tokens) end in sequences of
    power-of-two lengths; all others are full.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, out = word_ids(path), []
        end = np.array([END_ID], "<u4").tobytes()

        def put(piece, sequence, offset):
            (document, tokens), start, ids = piece
            out.append((document, start, len(ids) // 4, zlib.crc32(ids), tokens, sequence, offset))

        packer, key_type = Packer(put, length, TaskContext.get().partitionId() << 40), pa.null()

        def made() -> Iterator[pa.RecordBatch]:
            for i in range(0, len(out), 50_000):
                columns = list(zip(*out[i : i + 50_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], key_type), *[pa.array(c, pa.int64()) for c in columns[1:]]], ["key", *NUMBERS])
            out.clear()

        for batch in batches:
            key_type = batch.schema.field(0).type
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for document, ids in zip(batch.column(0).to_pylist(), words.packed_all(texts), strict=True):
                ids += end
                packer.add((document, len(ids) // 4), ids)
            yield from made()
        packer.fill()
        yield from made()

    out = rows.mapInArrow(run, f"key {kind}, " + ", ".join(f"{n} bigint" for n in NUMBERS))
    return out.select(F.col("key").alias(key), *NUMBERS)


NUMBERS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
