"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over characters, whichever they are: an n-gram is the code points of its ``ORDER - 1``
characters of context and of its last one. N-grams are counted over every trusted document; each
task sums its own first, so a task sends each n-gram once at most. Lower orders count distinct left
extensions. Counts meet their contexts' totals in joins sharded by context, order by order, which
gives the discounted part of every seen n-gram and the back-off weight of every seen context. Those
tables grow with the trusted text and stay sharded.

Each task over the documents asks for its distinct n-grams once; the questions meet the sharded
tables in joins, and the answers go to the shared folder by the number of the task that asked.
Scoring reads the answers of its own task there, so no text is shuffled; a task whose rows were
dealt otherwise goes on to the other tasks' answers. The ``SYMBOLS - 1`` most frequent characters
have short symbols, which only makes their n-grams quick to gather and look up.

A document's rate is its mean surprise per character, drawn to its language's median as if
``PRIOR`` median characters were added, so that a few odd words in a short text don't decide. It is
rejected if its rate is over the fence of its language: the upper quartile plus ``REACH`` times the
distance between the quartiles, exact quantiles over all documents in bins of 1/``BINS``. Where a
language has ``LEAST_GOOD`` documents labelled good, toxic or not, the fence is no higher than the
rate that ``GOOD_SHARE`` of them don't exceed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.columns import column_function, cut, free_name, quoted, remove, shared_dir, small_batches

BITS = 6
SYMBOLS = 1 << BITS
ORDER = 4
PRIOR = 200
REACH = 4.0
BINS = 1000
#: The least distance of the fence from the median, in nats per character.
LEAST_REACH = 0.35
#: The share of documents labelled good that a fence keeps, and how many of them it takes to set one.
GOOD_SHARE = 0.999
LEAST_GOOD = 100
#: More trusted keys than this meet the documents in a shuffled join instead of a broadcast one.
BROADCAST_KEYS = 2_000_000
#: More languages than this meet the documents in a shuffled join as well.
MANY_LANGUAGES = 100_000
#: Characters scored at once; bounds the memory of a long text.
CHUNK = 1 << 18
#: Bits of a code point; three are one context.
POINT = 21
#: N-grams with a character outside the alphabet that a task holds before it merges equal ones.
PENDING = 1 << 20


def alphabet(trusted: DataFrame, text: str) -> str:
    """The most frequent characters of all trusted text, most frequent first, ties by code point."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for batch in batches:
            for value in batch.column(0).drop_null().cast(pa.binary()).to_pylist():
                codes, n = np.unique(np.frombuffer(value.decode().encode("utf-32-le"), np.uint32), return_counts=True)
                total[codes] += n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["code", "n"])

    sums = trusted.select(F.col(text).cast("string")).mapInArrow(counted, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    return "".join(chr(r.code) for r in sums.orderBy(F.desc("n"), "code").limit(SYMBOLS - 1).collect())


class Symbols:
    """Maps text to symbols; 0 is every character outside the alphabet."""

    def __init__(self, known: str):
        self.of = np.zeros(0x110000, np.uint8)
        self.of[[ord(c) for c in known]] = np.arange(1, len(known) + 1)
        self.code = np.zeros(SYMBOLS, np.int64)
        self.code[1 : len(known) + 1] = [ord(c) for c in known]

    def windows(self, text: bytes | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """In chunks, the packed n-gram that ends at each character, and the places, contexts and last characters of those with a character outside the alphabet; blanks stand before the text."""
        codes = np.frombuffer((text or b"").decode().encode("utf-32-le"), np.uint32)
        for at in range(0, len(codes), CHUNK):
            own = codes[max(0, at - ORDER + 1) : at + CHUNK]
            if at == 0:
                own = np.concatenate([np.full(ORDER - 1, ord(" "), np.uint32), own])
            small = self.of[own].astype(np.int32)
            packed = np.zeros(len(own) - ORDER + 1, np.int32)
            odd = np.zeros(len(packed), bool)
            outside = small == 0
            for i in range(ORDER):
                packed = (packed << BITS) | small[i : i + len(packed)]
                odd |= outside[i : i + len(packed)]
            places = np.flatnonzero(odd)
            context = np.zeros(len(places), np.int64)
            for i in range(ORDER - 1):
                context = (context << POINT) | own[places + i]
            yield packed, places, context, own[places + ORDER - 1].astype(np.int32)

    def spelled(self, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those of the packed n-grams that lie within the alphabet, with their contexts and last characters."""
        digits = [(packed >> BITS * i) & (SYMBOLS - 1) for i in range(ORDER - 1, -1, -1)]
        inside = np.all([d > 0 for d in digits], axis=0)
        context = np.zeros(int(inside.sum()), np.int64)
        for d in digits[:-1]:
            context = (context << POINT) | self.code[d[inside]]
        return packed[inside], context, self.code[digits[-1][inside]].astype(np.int32)

    def packed(self, context: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Packed n-grams of contexts and last characters, and which of them lie within the alphabet."""
        digits = [self.of[(context >> POINT * i) & ((1 << POINT) - 1)] for i in range(ORDER - 2, -1, -1)] + [self.of[last]]
        out = np.zeros(len(context), np.int32)
        for d in digits:
            out = (out << BITS) | d
        return out, np.all([d > 0 for d in digits], axis=0)


class Spelled:
    """Counts of n-grams given by context and last character."""

    def __init__(self):
        self.held, self.waiting = [], 0

    def add(self, context: np.ndarray, last: np.ndarray) -> None:
        if len(context):
            self.held.append((context, last, np.ones(len(context), np.int64)))
            self.waiting += len(context)
            if self.waiting > PENDING:
                self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        context, last, n = (np.concatenate(c) for c in zip(*self.held, strict=True)) if self.held else (np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64))
        order = np.lexsort((last, context))
        context, last, n = context[order], last[order], n[order]
        first = np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (last[1:] != last[:-1]))) if len(n) else np.empty(0, np.int64)
        merged = context[first], last[first], np.add.reduceat(n, first) if len(n) else n
        self.held, self.waiting = [merged], 0
        return merged


def gathered(rows: DataFrame, text: str, known: str, counted: bool) -> DataFrame:
    """(part, context, last, n): each task's distinct n-grams; n counts them if ``counted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, others, part = Symbols(known), Spelled(), TaskContext.get().partitionId()
        total = np.zeros(SYMBOLS**ORDER, np.int32 if counted else bool)
        for batch in batches:
            for value in batch.column(0).drop_null().cast(pa.binary()).to_pylist():
                for packed, _, context, last in symbols.windows(value):
                    if counted:
                        grams, n = np.unique(packed, return_counts=True)
                        total[grams] += n.astype(np.int32)
                    else:
                        total[packed] = True
                    others.add(context, last)
        packed, context, last = symbols.spelled(np.flatnonzero(total))
        for c, z, n in ((context, last, total[packed].astype(np.int64)), others.merge()):
            for i in range(0, len(c), 1 << 16):
                cells = (np.full(len(c[i : i + (1 << 16)]), part, np.int32), *(v[i : i + (1 << 16)] for v in (c, z, n)))
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in cells], ["part", "context", "last", "n"])

    small_batches(rows.sparkSession)
    return rows.select(F.col(text).cast("string")).mapInArrow(run, "part int, context bigint, last int, n bigint")


def shorter(context: Column, size: int, bits: int) -> Column:
    """The context of an n-gram's last ``size`` characters."""
    return context.bitwiseAND(F.lit((1 << bits * (size - 1)) - 1).cast("bigint"))


def levels(counts: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """From (context, last, n): (size, context, last, value) and (size, context, back) of every length.

    ``value`` is an n-gram's discounted part and ``back`` the back-off weight of a context. All
    lengths share their tables, so that each step is one shuffle whatever the order of the model.
    """
    level = cut(counts.select("context", "last", "n"))
    rows = level.select(F.lit(ORDER).alias("size"), "*")
    for size in range(ORDER - 1, 0, -1):
        level = level.groupBy(shorter(F.col("context"), size, bits).alias("context"), "last").agg(F.count("*").alias("n"))
        rows = rows.unionByName(level.select(F.lit(size).alias("size"), "*"))
    rows = cut(rows)
    cost = F.lit(0.0)
    for met in rows.groupBy("size").agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).collect():
        d = discounts(met.n1, met.n2, met.n3, met.n4)
        own = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        cost = F.when(F.col("size") == met.size, own).otherwise(cost)
    totals = cut(rows.groupBy("size", "context").agg(F.sum("n").alias("total"), F.sum(cost).alias("cost")))
    named = totals.select("size", "context", "total")
    parts = rows.join(named, ["size", "context"]).select("size", "context", "last", ((F.col("n") - cost) / F.col("total")).alias("value"))
    return parts, totals.select("size", "context", (F.col("cost") / F.col("total")).alias("back"))


def surprises(asked: DataFrame, tables: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(context, last, surprise) of the distinct n-grams (context, last) of ``asked``, in nats.

    Every n-gram asks for its ends of all lengths; equal ends of one length are looked up once.
    Characters that no trusted text has are one more character of the lowest order.
    """
    parts, weights = tables
    ends = F.array(*[F.struct(F.lit(size).alias("size"), shorter(F.col("context"), size, POINT).alias("short")) for size in range(1, ORDER + 1)])
    wanted = asked.select("context", "last").distinct().select("context", "last", F.inline(ends))
    told = wanted.select("size", "short", "last").distinct()
    told = told.join(weights.withColumnRenamed("context", "short"), ["size", "short"], "left").join(parts.withColumnRenamed("context", "short"), ["size", "short", "last"], "left")
    met = wanted.join(told, ["size", "short", "last"])
    at = lambda c, size: F.max(F.when(F.col("size") == size, F.col(c))).alias(f"{c}{size}")
    found = met.groupBy("context", "last").agg(*[at(c, size) for size in range(1, ORDER + 1) for c in ("value", "back")])
    p = F.lit(1.0 / (parts.filter("size = 1").count() + 1))
    for size in range(1, ORDER + 1):
        p = F.coalesce(f"value{size}", F.lit(0.0)) + F.coalesce(f"back{size}", F.lit(1.0)) * p
    return found.select("context", "last", (-F.log(F.greatest(p, F.lit(1e-12)))).cast("float").alias("surprise"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Chen and Goodman's discounts for counts of one, two, and three or more."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    estimates = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(e, 0.1), top - 0.1) for e, top in zip(estimates, (1, 2, 3), strict=True))


class Answers:
    """The surprises of the n-grams that one task asked for; of other tasks' as well once one is missing."""

    def __init__(self, folder: str, known: str, part: int):
        self.symbols = Symbols(known)
        self.files, self.folder = pa.fs.FileSystem.from_uri(folder) if ":/" in folder else (pa.fs.LocalFileSystem(), folder)
        names = [f.base_name for f in self.files.get_file_info(pa.fs.FileSelector(self.folder)) if f.base_name.startswith("part=")]
        self.left = sorted(names, key=lambda n: (n != f"part={part}", n))
        self.dense = np.full(SYMBOLS**ORDER, np.nan, np.float32)
        self.others = pa.table({"context": pa.array([], pa.int64()), "last": pa.array([], pa.int32()), "surprise": pa.array([], pa.float32())})
        self.index()

    def load(self) -> None:
        if not self.left:
            raise RuntimeError("the documents changed while they were scored")
        found = pq.read_table(f"{self.folder}/{self.left.pop(0)}", columns=self.others.column_names, filesystem=self.files, partitioning=None)
        packed, inside = self.symbols.packed(found["context"].to_numpy(), found["last"].to_numpy())
        self.dense[packed[inside]] = found["surprise"].to_numpy()[inside]
        self.others = pa.concat_tables([self.others, found.filter(pa.array(~inside)).cast(self.others.schema)])
        self.index()

    def index(self) -> None:
        context, last = self.others["context"].to_numpy(), self.others["last"].to_numpy()
        self.contexts = np.unique(context)
        keys = (np.searchsorted(self.contexts, context) << POINT) | last
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], self.others["surprise"].to_numpy()[order]

    def spelled(self, context: np.ndarray, last: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(context), np.nan, np.float32)
        at = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        key = (at << POINT) | last
        to = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.contexts[at] == context) & (self.keys[to] == key), self.values[to], np.float32(np.nan))

    def score(self, text: bytes | None) -> tuple[float, int]:
        """Total surprise in nats and the number of characters."""
        total, n = 0.0, 0
        for packed, places, context, last in self.symbols.windows(text):
            while True:
                each = self.dense[packed]
                each[places] = self.spelled(context, last)
                if not np.isnan(each).any():
                    break
                self.load()
            total += float(each.sum(dtype=np.float64))
            n += len(packed)
        return total, n


def trusted_rows(docs: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Documents with a label of good quality and none of toxicity or bad quality."""
    trusted = free_name(docs, "trusted_key")
    verdict = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias(trusted)).agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    keys = verdict.filter("q = 1 AND t = 0").select(trusted)
    return docs.join(_cheap(keys, BROADCAST_KEYS), F.col(key) == F.col(trusted), "left_semi")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[str, str]:
    """The folder of the answers to all documents' n-grams under the model of all trusted ones, and the alphabet.

    Without trusted documents every character is equally likely.
    """
    trusted = trusted_rows(docs, labels, key).filter(F.col(text).isNotNull()).select(key, text)
    known = alphabet(trusted, text)
    counts = gathered(trusted, text, known, True).groupBy("context", "last").agg(F.sum("n").alias("n"))
    asked = cut(gathered(docs, text, known, False).select("part", "context", "last"))
    found = asked.join(surprises(asked, levels(counts, POINT)), ["context", "last"])
    folder = f"{shared_dir(docs.sparkSession)}/surprises-{uuid.uuid4().hex}"
    found.repartition("part").write.partitionBy("part").parquet(folder)
    return folder, known


def scored(docs: DataFrame, model: tuple[str, str], text: str):
    """Struct column of nll (total surprise) and n (characters)."""
    small_batches(docs.sparkSession)

    def make():
        answers = Answers(*model, TaskContext.get().partitionId())
        return lambda texts: [answers.score(t) for t in texts]

    return column_function(make, {"nll": "double", "n": "bigint"})(F.col(text).cast("string"))


def _upto(binned: DataFrame) -> DataFrame:
    """Adds the sum of n up to each bin and over all bins of the language."""
    by_rate = Window.partitionBy("lang").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return binned.withColumn("upto", F.sum("n").over(by_rate)).withColumn("all", F.sum("n").over(Window.partitionBy("lang")))


def fences(scores: DataFrame) -> DataFrame:
    """(lang, median, fence) from the quantiles of all rows of (lang, nll, n) with characters."""
    binned = scores.filter("n > 0").groupBy("lang", F.floor(F.col("nll") / F.col("n") * BINS).alias("bin")).agg(F.count("*").alias("n"))
    upto = _upto(binned)
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), (F.col("bin") + 0.5) / BINS))
    quartiles = upto.groupBy("lang").agg(at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"))
    fence = F.greatest(F.col("q3") + REACH * (F.col("q3") - F.col("q1")), F.col("median") + LEAST_REACH)
    return quartiles.select("lang", "median", fence.alias("fence"))


def _rate():
    return (F.col("nll") + PRIOR * F.col("median")) / (F.col("n") + PRIOR)


def labelled_fences(scores: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """``fences`` of rows (key, lang, nll, n), lowered to the quantiles of those labelled good."""
    by_lang = _cheap(fences(scores), MANY_LANGUAGES)
    good = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min("quality").alias("q")).filter("q = 1").select("key")
    rated = scores.filter("n > 0").join(_cheap(good, BROADCAST_KEYS), "key", "left_semi").join(by_lang, "lang")
    upto = _upto(rated.groupBy("lang", F.floor(_rate() * BINS).alias("bin")).agg(F.count("*").alias("n")))
    kept = upto.filter(F.col("all") >= LEAST_GOOD).groupBy("lang").agg(F.min(F.when(F.col("upto") >= GOOD_SHARE * F.col("all"), (F.col("bin") + 1) / BINS)).alias("kept"))
    return by_lang.join(_cheap(kept, MANY_LANGUAGES), "lang", "left").select("lang", "median", F.least("fence", "kept").alias("fence"))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per row: key, n_chars, perplexity, rate, fence and rejected.

    Null and empty texts have no characters: perplexity is null and they are kept, as there is
    nothing against them. Rows without language form a group of their own. Repeated rows stay, equal
    rates fall on the same side of a fence, and texts of any length are read whole, in chunks. Without
    documents there are no rows; without labels every character is equally likely. Other columns of
    ``docs`` are not read.
    """
    spark = docs.sparkSession
    model = fit(docs, labels, key, text)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), scored(docs, model, text).alias("s"))
    rows = cut(rows.select("key", "lang", "s.nll", "s.n"))
    remove(spark, model[0])
    told = rows.join(_cheap(labelled_fences(rows, labels, key), MANY_LANGUAGES), "lang", "left").withColumn("rate", F.when(F.col("n") > 0, _rate()))
    return told.select(F.col("key").alias(key), F.col("n").alias("n_chars"), F.when(F.col("n") > 0, F.exp(F.col("nll") / F.col("n"))).alias("perplexity"), "rate", "fence", F.coalesce(F.col("rate") > F.col("fence"), F.lit(False)).alias("rejected"))


def _cheap(table: DataFrame, most: int) -> DataFrame:
    """The table, written down, with a broadcast hint if it is found to have no more than ``most`` rows."""
    table = cut(table)
    return F.broadcast(table) if table.count() <= most else table


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` without the rows that ``judge`` rejects; columns stay as they are.

    Texts are scored once: documents and scores are written to the shared folder, fences come from
    the scores, and the rows within them are read back. No text is shuffled.
    """
    spark = docs.sparkSession
    model = fit(docs, labels, key, text)
    mark = free_name(docs, "scored")
    path = f"{shared_dir(spark)}/scored-{uuid.uuid4().hex}"
    docs.withColumn(mark, scored(docs, model, text)).write.parquet(path)
    remove(spark, model[0])
    held = spark.read.parquet(path)
    language = F.coalesce(F.col(lang).cast("string"), F.lit(""))
    scores = held.select(F.col(key).alias("key"), language.alias("lang"), F.col(mark).getField("nll").alias("nll"), F.col(mark).getField("n").alias("n"))
    by_lang = free_name(docs, "by_lang")
    fence = _cheap(labelled_fences(scores, labels, key).select(F.struct("lang", "median", "fence").alias(by_lang)), MANY_LANGUAGES)
    out = held.join(fence, language == F.col(f"{by_lang}.lang"), "left")
    rate = (F.col(f"{mark}.nll") + PRIOR * F.col(f"{by_lang}.median")) / (F.col(f"{mark}.n") + PRIOR)
    return out.filter(~F.coalesce((F.col(f"{mark}.n") > 0) & (rate > F.col(f"{by_lang}.fence")), F.lit(False))).select(*quoted(docs))
