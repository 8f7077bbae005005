"""Language identification: averaged embeddings of hashed subwords under a linear softmax.

A text is the mean of the embeddings of its character n-grams, hashed into ``BUCKETS``; a linear
softmax on that mean gives the language. Embeddings and weights are trained by stochastic gradient
descent in numpy on a bounded sample of labelled rows (``SAMPLE_ROWS`` whole texts, an equal share of each language). A part of the
sample is kept apart to calibrate, as whole texts and as short slices: a temperature makes probabilities honest,
and bars on the probability and on the share of n-grams known from training are set so that all but
``REJECT_SHARE`` of correctly recognised texts pass. What is below a bar is rejected.

As the softmax is linear in the mean, a trained model is one table of bucket scores by language.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.columns import column_function, free_name, quoted, small_batches

SAMPLE_ROWS = 4000
BUCKETS = 1 << 16
GRAMS = (1, 2, 3, 4)
WIDTH = 16
EPOCHS = 3
RATE = 0.5
SEED = 7
#: Share of the sample that only calibrates, and of correct texts that rejection may cost.
CALIBRATE = 0.2
REJECT_SHARE = 0.001
#: No threshold for rejection goes above this, so that a confident answer always stands.
HIGHEST_BAR = 0.5
UNKNOWN = "und"
#: Characters hashed at once; bounds the memory of a long text.
CHUNK = 1 << 18


class _Blanks(dict):
    """Maps what is not a letter to a blank, remembering each character once."""

    def __missing__(self, code: int):
        self[code] = code if chr(code).isalpha() else " "
        return self[code]


_ANY = _Blanks()


def code_points(text: bytes | None) -> np.ndarray:
    """Code points of the lower-cased text, every run of other characters than letters one blank; empty without a letter."""
    if not text:
        return np.empty(0, np.uint32)
    words = text.decode("utf-8", "replace").lower().translate(_ANY).split()
    return np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32) if words else np.empty(0, np.uint32)


def buckets_of(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash bucket of every n-gram."""
    size = len(codes) - n + 1
    if size <= 0:
        return np.empty(0, np.uint32)
    h = np.full(size, n * 0x9E3779B1 % (1 << 32), np.uint32)
    for i in range(n):
        h = (h ^ codes[i : i + size]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
    return (h * np.uint32(0x85EBCA6B)) >> np.uint32(16)


def buckets(codes: np.ndarray) -> np.ndarray:
    """Hash bucket of every n-gram of the lengths ``GRAMS``."""
    return np.concatenate([buckets_of(codes, n) for n in GRAMS])


def _weighted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's buckets and their shares of its n-grams, in few bytes."""
    ids, n = np.unique(buckets(codes), return_counts=True)
    return ids.astype(np.uint16), (n / n.sum()).astype(np.float32)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Model:
    """Bucket scores by language and whether a bucket is known, the temperature and the bars for rejection."""

    def __init__(self, languages: list[str], scores: np.ndarray, bias: np.ndarray, known: np.ndarray):
        self.languages, self.bias = languages, bias
        self.scores = np.column_stack([scores, known.astype(scores.dtype)])
        self.temperature, self.bar, self.known_bar = 1.0, 0.0, 0.0

    def measure(self, codes: np.ndarray) -> tuple[np.ndarray, float]:
        """Logits from the mean bucket score, and the share of known n-grams; long texts are taken in chunks."""
        total, n = np.zeros(len(self.languages) + 1), 0
        for start in range(0, len(codes), CHUNK):
            for k in GRAMS:
                own = buckets_of(codes[start : start + CHUNK + k - 1], k)
                n += len(own)
                total += self.scores[own].sum(axis=0) if len(own) < BUCKETS else np.bincount(own, minlength=BUCKETS) @ self.scores
        mean = total / max(n, 1)
        return mean[:-1] + self.bias, float(mean[-1])

    def predict(self, text: bytes | None) -> tuple[str, float, bool]:
        """Language, calibrated probability, and whether it passes the bars; ``und``, 0 and no without a letter."""
        codes = code_points(text)
        if not len(codes) or not self.languages:
            return UNKNOWN, 0.0, False
        logits, known = self.measure(codes)
        p = softmax(logits / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] >= self.bar and known >= self.known_bar)


def train(rows: list[tuple[bytes, str]], epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """A model from (text, language) rows; without any usable row it answers ``und``."""
    rng = np.random.default_rng(seed)
    texts = [(code_points(t), lang) for t, lang in rows]
    texts = [(c, lang) for c, lang in texts if len(c)]
    languages = sorted({lang for _, lang in texts})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), np.zeros(BUCKETS))
    apart = rng.random(len(texts)) < CALIBRATE if len(texts) >= 20 else np.zeros(len(texts), bool)
    examples = []
    for (codes, lang), kept in zip(texts, apart, strict=True):
        if not kept:
            examples.append((codes, languages.index(lang)))
            start = int(rng.integers(0, max(1, len(codes) - 60)))
            examples.append((codes[start : start + int(rng.integers(10, 60))], languages.index(lang)))
    counts = np.bincount([y for _, y in examples], minlength=len(languages))
    share = np.sqrt(counts.max() / np.maximum(counts, 1))
    width = np.random.default_rng(seed + 1)
    emb = width.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    out, bias = np.zeros((WIDTH, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    seen = [(*_weighted(c), y) for c, y in examples if len(c)]
    del examples
    steps, total = 0, epochs * max(1, len(seen))
    for _ in range(epochs):
        for i in rng.permutation(len(seen)):
            ids, weights, y = seen[i]
            rate = RATE * (1 - steps / total) * min(share[y], 3)
            hidden = weights @ emb[ids]
            error = softmax(hidden @ out + bias)
            error[y] -= 1
            back = out @ error
            out -= rate * np.outer(hidden, error).astype(np.float32)
            bias -= rate * 0.1 * error.astype(np.float32)
            emb[ids] -= (rate * 20 * weights)[:, None] * back.astype(np.float32)
            steps += 1
    known = np.zeros(BUCKETS, bool)
    for ids, _, _ in seen:
        known[ids] = True
    model = Model(languages, (emb @ out).astype(np.float64), bias.astype(np.float64), known)
    held = [(c, languages.index(lang)) for (c, lang), kept in zip(texts, apart, strict=True) if kept]
    if held:
        _calibrate(model, held, rng)
    return model


def _calibrate(model: Model, held: list[tuple[np.ndarray, int]], rng: np.random.Generator) -> None:
    for codes, y in list(held):
        size = int(rng.integers(6, 40))
        start = int(rng.integers(0, max(1, len(codes) - size)))
        held.append((codes[start : start + size], y))
    told = [model.measure(c) for c, _ in held]
    z, known, y = np.array([t[0] for t in told]), np.array([t[1] for t in told]), np.array([y for _, y in held])
    grid = np.geomspace(0.02, 20, 141)
    losses = [-np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(losses))])
    p = softmax(z / model.temperature)
    right = p.argmax(axis=1) == y
    if right.any():
        model.bar = float(min(np.quantile(p.max(axis=1)[right], REJECT_SHARE), HIGHEST_BAR))
        model.known_bar = float(min(np.quantile(known[right], REJECT_SHARE), HIGHEST_BAR))


def sample(docs: DataFrame, key: str, text: str, lang: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, lang) of at most ``rows`` labelled whole texts, an equal share of each language; the only rows a model learns from.

    A language's rows are those of the least hashed keys, ties by key and text. Rows of the held-out
    quarter (crc32 of the key mod 4 is 2) and rows without label are never taken. Of more than
    ``rows`` languages the most frequent are learned.
    """
    usable = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(key))
    usable = usable.select(F.xxhash64(F.col(key).cast("string"), F.lit("sample")).alias("h"), F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    counts = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(rows).collect()
    share = max(1, rows // max(1, len(counts)))
    # So few of a language's hashes are under its bound that ranking them is cheap, and with near
    # certainty at least its share of them; a smaller language comes whole.
    wide = share + 8 * math.isqrt(share) + 16
    bounds = docs.sparkSession.createDataFrame([(r.lang, min(1.0, wide / r.n)) for r in counts], "lang string, bound double")
    near = usable.join(F.broadcast(bounds), "lang").filter(F.shiftrightunsigned("h", 24) < F.col("bound") * float(1 << 40))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "key", "text")))
    return ranked.filter(F.col("rank") <= share).select("text", "lang")


def trained(docs: DataFrame, key: str, text: str, lang: str) -> Model:
    """The model of the sample, trained in one task, as the sample is bounded whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((t, label) for batch in batches for t, label in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(rows))], pa.binary())], ["model"])

    made = sample(docs, key, text, lang).repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(made.model) if made else train([])


def held_out(key: str):
    """True where crc32 of the key as text leaves 2 modulo 4; a null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def predicted(docs: DataFrame, model: Model, text: str):
    """Struct column of lang_pred, score and passed; only the text is looked at."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        known = shared.value
        return lambda texts: [known.predict(t) for t in texts]

    return column_function(make, {"lang_pred": "string", "score": "double", "passed": "boolean"})(F.col(text).cast("string"))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per row: the key, held_out, lang_pred, score and rejected.

    Texts that are null or have no letter are ``und`` with score 0 and rejected; without labelled
    rows to learn from all are. Repeated rows stay; null keys are allowed.
    """
    model = trained(docs, key, text, lang)
    rows = docs.select(F.col(key).alias("key"), held_out(key).alias("held_out"), predicted(docs, model, text).alias("p"))
    return rows.select(F.col("key").alias(key), "held_out", "p.lang_pred", "p.score", (~F.col("p.passed")).alias("rejected"))


def keep_identified(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` without the rows whose language is rejected; columns stay as they are."""
    model = trained(docs, key, text, lang)
    mark = free_name(docs, "predicted")
    return docs.withColumn(mark, predicted(docs, model, text)).filter(F.col(mark).getField("passed")).select(*quoted(docs))
