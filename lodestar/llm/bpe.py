"""Byte-level BPE encoding and decoding of whole text columns.

Each word of the split pattern is merged on a contiguous array of part boundaries with the rank
of every adjacent pair beside it: scan for the smallest rank, delete that boundary, refresh the
two neighbouring ranks. Words beyond ``SCAN_BYTES`` take the same merges from a heap, since a
scan would be quadratic there. Words repeat, so a worker keeps the ids of the words it met in two
memos of at most ``MEMO_WORDS``: a full one becomes the older, and words that return move over.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.columns import column_function, small_batches

#: Fixed value: the split pattern of this vocabulary; \s means Unicode white space there.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
SCAN_BYTES = 256
MEMO_WORDS = 400_000


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    """Encoder and decoder for one vocabulary file; small enough to broadcast (its size is the file's)."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        symbols = byte_symbols()
        raw = lambda token: bytes(symbols[c] for c in token)
        self.ids = {raw(token): i for token, i in data["model"]["vocab"].items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"])
        self.ranks = {(raw(a), raw(b)): rank for rank, (a, b) in enumerate(pairs)}
        self.added = {t["content"]: t["id"] for t in data.get("added_tokens") or []}
        self.tokens = {i: token for token, i in self.ids.items()} | {i: t.encode() for t, i in self.added.items()}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.splitter = self.finder = None

    def __getstate__(self):
        return self.__dict__ | {"memo": {}, "older": {}, "splitter": None, "finder": None}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word of the split pattern."""
        if word in self.ids and len(word) == 1:
            return [self.ids[word]]
        cuts = self._scanned(word) if len(word) <= SCAN_BYTES else self._heaped(word)
        return [self.ids[word[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _scanned(self, word: bytes) -> list[int]:
        none, ranks = len(self.ranks), self.ranks
        bounds = list(range(len(word) + 1))
        beside = [ranks.get((word[i : i + 1], word[i + 1 : i + 2]), none) for i in range(len(word) - 1)]
        while beside:
            least = min(beside)
            if least == none:
                break
            at = beside.index(least)
            del bounds[at + 1], beside[at]
            here = word[bounds[at] : bounds[at + 1]]
            if at < len(beside):
                beside[at] = ranks.get((here, word[bounds[at + 1] : bounds[at + 2]]), none)
            if at:
                beside[at - 1] = ranks.get((word[bounds[at - 1] : bounds[at]], here), none)
        return bounds

    def _heaped(self, word: bytes) -> list[int]:
        size, ranks = len(word), self.ranks
        end, before = list(range(1, size + 1)), list(range(-1, size - 1))
        alive = bytearray(b"\1") * size
        queue = [(r, i, i + 1, i + 2) for i in range(size - 1) if (r := ranks.get((word[i : i + 1], word[i + 1 : i + 2]))) is not None]
        heapq.heapify(queue)
        while queue:
            _, a, mid, stop = heapq.heappop(queue)
            if not alive[a] or end[a] != mid or mid >= size or not alive[mid] or end[mid] != stop:
                continue
            alive[mid], end[a] = 0, stop
            here = word[a:stop]
            if stop < size:
                before[stop] = a
                if (r := ranks.get((here, word[stop : end[stop]]))) is not None:
                    heapq.heappush(queue, (r, a, stop, end[stop]))
            if (p := before[a]) >= 0 and (r := ranks.get((word[p:a], here))) is not None:
                heapq.heappush(queue, (r, p, a, stop))
        return [i for i in range(size) if alive[i]] + [size]

    def _ids(self, word: str) -> bytes:
        """Packed ids of a word that the newer memo didn't have when the text began."""
        ids = self.memo.get(word) or self.older.get(word) or np.array(self.merge(word.encode()), "<u4").tobytes()
        if len(word) <= SCAN_BYTES:
            if len(self.memo) >= MEMO_WORDS:
                self.memo, self.older = {}, self.memo
            self.memo[word] = ids
        return ids

    def packed(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        if self.splitter is None:
            self.splitter = regex.compile(PATTERN)
            names = sorted(self.added, key=len, reverse=True)
            self.finder = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        found = []
        for i, part in enumerate(self.finder.split(text) if self.finder else [text]):
            if i % 2:
                found.append(self.added[part].to_bytes(4, "little"))
                continue
            get = self.memo.get
            found.append(b"".join([get(w) or self._ids(w) for w in self.splitter.findall(part)]))
        return b"".join(found)

    def decode(self, packed: bytes) -> str:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(packed, "<u4").tolist()]).decode("utf-8", "replace")


def load(path: str | None = None) -> ByteBpe:
    """The vocabulary at ``path``, by default the installed byte_bpe_50k.json."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return ByteBpe(f.read())


def encode_column(df: DataFrame, text: str = "text", path: str | None = None):
    """Column of ids (array<bigint>) of the whole text; null and empty texts have an empty array."""
    shared = df.sparkSession.sparkContext.broadcast(load(path))

    def make():
        bpe = shared.value
        return lambda texts: [np.frombuffer(bpe.packed((t or b"").decode()), "<u4").tolist() for t in texts]

    small_batches(df.sparkSession)
    return column_function(make, "array<bigint>")(F.col(text).cast("string"))


def decode_column(df: DataFrame, ids: str, path: str | None = None):
    """Column of text from a column of ids; null ids give an empty text. Bytes that are not UTF-8 become U+FFFD."""
    shared = df.sparkSession.sparkContext.broadcast(load(path))

    def make():
        bpe = shared.value
        return lambda rows: [bpe.decode(np.array(r or [], "<u4").tobytes()) for r in rows]

    small_batches(df.sparkSession)
    return column_function(make, "string")(F.col(ids))


def round_trip(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Encodes and decodes every whole text: n_tokens, ids_sha256 and decoded_sha256 per row.

    Null counts as empty (0 tokens). Repeated rows each keep their row; other columns are left out.
    """
    shared = df.sparkSession.sparkContext.broadcast(load(path))

    def make():
        bpe = shared.value

        def rows(texts):
            out = []
            for t in texts:
                packed = bpe.packed((t or b"").decode())
                back = bpe.decode(packed).encode()
                out.append((len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(back).hexdigest()))
            return out

        return rows

    small_batches(df.sparkSession)
    digest = column_function(make, {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"})
    return df.select(F.col(key), digest(F.col(text).cast("string")).alias("d")).select(key, "d.*")
