"""Media columns: signatures are located in stored bytes, formats validated, types corrected, embedded media carved.

An Aho-Corasick automaton finds every magic number in one pass. A hit counts only if the format's
validator confirms structure and lengths from there: chunk tables, checksums, sizes within the
bytes at hand. The declared type gives way to the confirmed one; confirmed media that start behind
the first byte are embedded and can be carved by offset and length.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import struct
import zlib
from collections.abc import Callable

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.columns import column_function, quoted, small_batches

#: Payloads are padded with bytes 255 to a positive multiple of this.
UNIT = 576
SAMPLE_RATE = 8000

#: Magic numbers and where they stand from the start of their file.
MAGIC = {
    "audio/wav": (b"WAVE", 8),
    "image/png": (b"\x89PNG\r\n\x1a\n", 0),
    "image/gif": (b"GIF8", 0),
    "image/bmp": (b"BM", 0),
    "image/jpeg": (b"\xff\xd8\xff", 0),
    "application/gzip": (b"\x1f\x8b\x08", 0),
    "application/pdf": (b"%PDF-", 0),
}


def wav(payload: bytes) -> bytes:
    """The payload as 8-bit mono PCM samples, losslessly."""
    head = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8)
    body = head + struct.pack("<4sI", b"data", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(body), b"WAVE") + body


def wav_data(b: bytes, at: int = 0) -> tuple[int, int, int] | None:
    """Total length, start and length of the samples of the WAV file at ``at``, or None if it isn't one."""
    if b[at : at + 4] != b"RIFF" or b[at + 8 : at + 12] != b"WAVE" or len(b) < at + 12:
        return None
    stop = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    if stop > len(b):
        return None
    p, form, data = at + 12, False, None
    while p + 8 <= stop:
        size = int.from_bytes(b[p + 4 : p + 8], "little")
        if p + 8 + size > stop:
            return None
        form |= b[p : p + 4] == b"fmt " and size >= 16
        if b[p : p + 4] == b"data":
            data = (p + 8, size)
        p += 8 + size + size % 2
    return (stop - at, *data) if form and data else None


class Marks:
    """Places of marks in some bytes, each mark searched for once however often it is asked for."""

    def __init__(self, b: bytes):
        self.b, self.places = b, {}

    def first(self, mark: bytes, at: int) -> int:
        """The first place of a mark from ``at`` on, or -1."""
        if mark not in self.places:
            self.places[mark] = [m.start() for m in re.finditer(re.escape(mark), self.b)]
        places = self.places[mark]
        i = bisect.bisect_left(places, at)
        return places[i] if i < len(places) else -1


class Chains:
    """Where chains of blocks end, by the place of each block: a chain that meets a known place is not walked again."""

    def __init__(self):
        self.known: dict[tuple[str, int], object] = {}

    def end(self, name: str, at: int, step: Callable[[int], tuple[int | None, object]], joined: Callable[[object, object], object] = lambda here, rest: rest):
        """The outcome at ``at``: ``step`` gives the next place and this block's part, or no place and the outcome.

        A chain's outcome is that of its last block, put together backwards by ``joined``.
        """
        path, out = [], None
        while True:
            if (name, at) in self.known:
                out = self.known[name, at]
                break
            after, here = step(at)
            path.append((at, here))
            if after is None:
                out = here
                self.known[name, at] = out
                path.pop()
                break
            at = after
        for place, here in reversed(path):
            out = joined(here, out)
            self.known[name, place] = out
        return out


def _png(b: bytes, at: int, chains: Chains | None = None) -> int:
    """Chunks are followed to the end by their lengths first; only then are their sums taken, each once."""
    chains = chains or Chains()
    if b[at + 8 : at + 16] != b"\0\0\0\rIHDR":
        return 0

    def step(p: int):
        size = int.from_bytes(b[p : p + 4], "big")
        if p + 12 + size > len(b) or not b[p + 4 : p + 8].isalpha():
            return None, 0
        return (None, p + 12 + size) if b[p + 4 : p + 8] == b"IEND" else (p + 12 + size, None)

    def sound(p: int):
        stop = p + 8 + int.from_bytes(b[p : p + 4], "big")
        good = zlib.crc32(memoryview(b)[p + 4 : stop]) == int.from_bytes(b[stop : stop + 4], "big")
        return (stop + 4, True) if good and b[p + 4 : p + 8] != b"IEND" else (None, good)

    end = chains.end("png", at + 8, step)
    return end - at if end and chains.end("sums", at + 8, sound) else 0


def _gif(b: bytes, at: int, chains: Chains | None = None) -> int:
    chains = chains or Chains()
    if b[at + 4 : at + 6] not in (b"7a", b"9a") or at + 13 > len(b):
        return 0

    def data(p: int):
        return (p + b[p] + 1, None) if p < len(b) and b[p] else (None, p + 1)

    def step(p: int):
        """A part's outcome is the place behind the end mark, 0 without one, and whether an image came before it."""
        if p < len(b) and b[p] == 0x3B:
            return None, (p + 1, False)
        if p < len(b) and b[p] == 0x21:
            return chains.end("data", p + 2, data), False
        if p + 10 <= len(b) and b[p] == 0x2C:
            return chains.end("data", p + 11 + (3 << (b[p + 9] & 7) + 1 if b[p + 9] & 128 else 0), data), True
        return None, (0, False)

    first = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 128 else 0)
    end, seen = chains.end("gif", first, step, lambda image, rest: (rest[0], rest[1] or image))
    return end - at if end and seen else 0


def _bmp(b: bytes, at: int) -> int:
    if at + 26 > len(b):
        return 0
    size, spare, start, head = struct.unpack_from("<IIII", b, at + 2)
    return size if spare == 0 and head in (12, 40, 52, 56, 108, 124) and 14 + head <= start <= size <= len(b) - at else 0


def _jpeg(b: bytes, at: int, marks: Marks | None = None, chains: Chains | None = None) -> int:
    marks, chains = marks or Marks(b), chains or Chains()

    def step(p: int):
        """A segment's outcome is the place behind the start of the scan, 0 without one, and whether a frame came before it."""
        size = int.from_bytes(b[p + 2 : p + 4], "big")
        if p + 4 > len(b) or b[p] != 0xFF or size < 2 or p + 2 + size > len(b):
            return None, (0, False)
        kind = b[p + 1]
        if kind == 0xDA:
            return None, (p + 2 + size, False)
        return p + 2 + size, 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)

    scan, frame = chains.end("jpeg", at + 2, step, lambda here, rest: (rest[0], rest[1] or here))
    end = marks.first(b"\xff\xd9", scan) if scan and frame else -1
    return end + 2 - at if end >= 0 else 0


def _gzip(b: bytes, at: int) -> int:
    try:
        unpack = zlib.decompressobj(31)
        rest = memoryview(b)[at:]
        for i in range(0, len(rest), 1 << 16):
            piece = unpack.decompress(rest[i : i + (1 << 16)], 1 << 20)
            while unpack.unconsumed_tail and not unpack.eof:
                piece = unpack.decompress(unpack.unconsumed_tail, 1 << 20)
            if unpack.eof:
                return min(len(rest), i + (1 << 16)) - len(unpack.unused_data)
        del piece
    except zlib.error:
        pass
    return 0


def _pdf(b: bytes, at: int, marks: Marks | None = None) -> int:
    """Up to the last end mark: linearised files and saved updates have several, each after its own startxref."""
    marks = marks or Marks(b)
    size, since, stop = 0, at, len(b)
    while 0 <= (end := marks.first(b"%%EOF", since)) < stop and 0 <= marks.first(b"startxref", since) < end:
        if not size and (other := marks.first(b"%PDF-", end)) >= 0:
            stop = other
        since = end + 5
        size = since - at
    return size


#: Validators of (bytes, place, places of marks, known ends of chains), giving the length or 0.
VALID = {
    "audio/wav": lambda b, at, marks, chains: (wav_data(b, at) or (0,))[0],
    "image/bmp": lambda b, at, marks, chains: _bmp(b, at),
    "application/gzip": lambda b, at, marks, chains: _gzip(b, at),
    "image/png": lambda b, at, marks, chains: _png(b, at, chains),
    "image/gif": lambda b, at, marks, chains: _gif(b, at, chains),
    "image/jpeg": _jpeg,
    "application/pdf": lambda b, at, marks, chains: _pdf(b, at, marks),
}


def automaton() -> ahocorasick.Automaton:
    """Finds the magic numbers; bytes are read as Latin-1 text, a character a byte."""
    found = ahocorasick.Automaton()
    for kind, (magic, offset) in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (kind, offset + len(magic)))
    found.make_automaton()
    return found


def sniffed(b: bytes, finder: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """Type, start and length of every confirmed medium, in order; what lies inside an embedded one isn't told apart."""
    found, inside, marks, chains = [], 0, Marks(b), Chains()
    for end, (kind, back) in finder.iter(b.decode("latin-1")):
        start = end + 1 - back
        if start < 0 or found and 0 < start < inside:
            continue
        if size := VALID[kind](b, start, marks, chains):
            found.append((kind, start, size))
            inside = max(inside, start + size if start else 0)
    return sorted(found, key=lambda x: x[1])


SNIFF = {"media_type": "string", "confirmed": "boolean", "embedded": "array<string>"}


def sniff(df: DataFrame, data: str, declared: str | None = None) -> DataFrame:
    """Adds ``sniffed``: the type that the bytes have, whether it is confirmed, and embedded media as ``type@start+length``.

    Without a confirmed signature at the first byte the declared type stays, unconfirmed. Null bytes
    count as empty and have none.
    """
    small_batches(df.sparkSession)

    def make():
        finder = automaton()

        def rows(values):
            out = []
            for v in values:
                found = sniffed(bytes(v or b""), finder)
                own = next((k for k, start, _ in found if start == 0), None)
                out.append((own, own is not None, [f"{k}@{start}+{size}" for k, start, size in found if start]))
            return out

        return rows

    told = df.withColumn("sniffed", column_function(make, SNIFF)(F.col(data)))
    kind = F.coalesce("sniffed.media_type", F.col(declared) if declared else F.lit("application/octet-stream"))
    return told.withColumn("sniffed", F.col("sniffed").withField("media_type", kind))


def carve(df: DataFrame, data: str) -> DataFrame:
    """One row for each embedded medium: the other columns, media_type, start and content."""
    rows = sniff(df, data).select("*", F.explode("sniffed.embedded").alias("carved"))
    kind, start, size = (F.regexp_extract("carved", r"^(.*)@(\d+)\+(\d+)$", i) for i in (1, 2, 3))
    content = F.substring(F.col(data), start.cast("int") + 1, size.cast("int"))
    return rows.select(*quoted(df), kind.alias("media_type"), start.cast("bigint").alias("start"), content.alias("content"))


def padded(text: bytes | None) -> bytes:
    text = text or b""
    return text + b"\xff" * (UNIT * max(1, -(-len(text) // UNIT)) - len(text))


def stored(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the binary column ``name``: the text's bytes, padded to whole units, as an 8-bit WAV file."""
    small_batches(df.sparkSession)
    store = column_function(lambda: lambda texts: [wav(padded(t)) for t in texts], "binary")
    return df.withColumn(name, store(F.col(text).cast("string")))


FEATURES = {"payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"}


def features(df: DataFrame, data: str, declared: str = "application/octet-stream"):
    """Struct column of what is read back from stored media: payload and media digests, and a feature string.

    The feature names the declared and the confirmed type, the sample count, the least, mean and
    largest sample, and the embedded media. Bytes that aren't sound 8-bit audio have a null payload.
    """

    def make():
        finder = automaton()

        def rows(values):
            out = []
            for v in values:
                b = bytes(v or b"")
                found = sniffed(b, finder)
                own = next((k for k, start, _ in found if start == 0), declared)
                inner = ",".join(f"{k}@{start}+{size}" for k, start, size in found if start) or "none"
                where = wav_data(b) if own == "audio/wav" else None
                p = b[where[1] : where[1] + where[2]] if where else None
                told = f"{declared}->{own};n={len(p)};crc={zlib.crc32(p):08x};min={min(p)};max={max(p)}" if p else f"{declared}->{own}"
                out.append((len(p) if p is not None else None, hashlib.sha256(p).hexdigest() if p is not None else None, zlib.crc32(p[-32:]) if p is not None else None, len(b), hashlib.sha256(b).hexdigest(), f"{told};embedded={inner}"))
            return out

        return rows

    return column_function(make, FEATURES)(F.col(data))


def media_columns(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores every whole text as media, reads it back and describes it; null counts as empty, repeated rows stay."""
    rows = stored(df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")), "text", "media")
    rows = rows.select("key", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), features(rows, "media").alias("f"))
    return rows.select(F.col("key").alias(key), "n_bytes", "f.*")
