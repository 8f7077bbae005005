"""SimHash near-duplicates within two bits, found by meeting in the middle of Hamming balls.

Copies of a fingerprint collapse first. Each distinct fingerprint then emits every variant within
half the radius (itself and its 64 one-bit flips): two fingerprints at two bits or fewer share a
variant, and those that share one are within two bits. At most 65 distinct fingerprints can meet
on a variant, so no group is unbounded. Each meeting links all to its least fingerprint, every link
is verified, and components are found on those links.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.columns import column_function, cut, quoted, small_batches, spaced_words

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Shingles whose bits are counted at once; bounds the memory of a long text.
CHUNK = 1 << 15


def fingerprint(text: bytes | None, k: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the word shingles, repeats included; no words give 0."""
    words = spaced_words(text)
    if not words:
        return 0
    n = max(1, len(words) - k + 1)
    counts = np.zeros(64, np.int64)
    for start in range(0, n, CHUNK):
        stop = min(n, start + CHUNK)
        part = words[start : stop + k - 1]
        joined = list(map(b" ".join, zip(*(part[i:] for i in range(k)), strict=False))) if len(part) >= k else [b" ".join(part)]
        hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in joined], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def with_fingerprint(df: DataFrame, name: str, text: str = "text") -> DataFrame:
    """``df`` and a bigint column ``name`` with the fingerprint's 64 bits."""
    small_batches(df.sparkSession)
    simhash = column_function(lambda: lambda texts: [_signed(fingerprint(t)) for t in texts], "bigint")
    return df.withColumn(name, simhash(F.col(text).cast("string")))


def near_links(distinct: DataFrame, fp: str = "fp") -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints; they connect all pairs within ``RADIUS`` bits.

    Any two that meet on a variant are within the radius, so each is linked to the least that meets
    there; the distance is verified all the same. Every fingerprint with a neighbour has a link, and
    the links' components are those of all close pairs.
    """
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col(fp).bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)))
    variants = distinct.select(fp, F.explode(F.concat(F.array(fp), flips)).alias("variant"))
    met = variants.withColumn("a", F.min(fp).over(Window.partitionBy("variant")))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col(fp))) <= RADIUS
    return met.filter((F.col("a") < F.col(fp)) & close).select("a", F.col(fp).alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for the ends of the links (a, b) that aren't their component's smallest node, the root.

    Edges point from a node to smaller ones. A round hangs what points to a node onto the least that
    this node points to, then ties a node's smaller neighbours to their least; rounds end when
    nothing moves, after about the logarithm of a component's diameter. A root with many nodes is one
    key of the first join only: that is a sort-merge join, which Spark splits by its skew handling,
    and every other step combines within tasks or sees a node's own smaller neighbours. No links give
    no rows.
    """
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("near"), F.lit(True).alias("moved")).distinct())
    while True:
        least = edges.groupBy(F.col("node").alias("near")).agg(F.min("near").alias("hub"))
        hung = edges.join(least.hint("merge"), "near", "left").select("node", F.coalesce("hub", "near").alias("near"), F.col("hub").isNotNull().alias("up"))
        tied = hung.withColumn("least", F.min("near").over(Window.partitionBy("node")))
        other = F.col("near") > F.col("least")
        own = F.struct(F.col("node").alias("node"), F.col("least").alias("near"), (F.col("up") | other).alias("moved"))
        below = F.when(other, F.struct(F.col("near").alias("node"), F.col("least").alias("near"), F.lit(True).alias("moved")))
        rows = tied.select(F.inline(F.array_compact(F.array(own, below))))
        edges = cut(rows.groupBy("node", "near").agg(F.max("moved").alias("moved")))
        if edges.filter("moved").isEmpty():
            return edges.select("node", F.col("near").alias("root"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``key``, its 16-digit fingerprint, and component_id, the smallest key reachable.

    Null and empty texts have fingerprint 0 and link like any other. Repeated rows stay; a null key
    stays null and is never a component's id unless all its keys are null. Only key and text are read.
    """
    marked = cut(with_fingerprint(df.select(F.col(key).alias("key"), F.col(text).alias("text")), "fp").select("key", "fp"))
    return with_components(marked).select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def with_components(marked: DataFrame) -> DataFrame:
    """Adds component_id to rows of (key, fp).

    Both joins can meet a key that many rows share, a component's root or a common fingerprint; they
    are sort-merge joins, whose skewed partitions Spark splits.
    """
    distinct = cut(marked.groupBy("fp").agg(F.min("key").alias("least")))
    roots = components(near_links(distinct))
    classes = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = classes.join(smallest.hint("merge"), "root").select("fp", "component_id")
    return marked.join(by_fp.hint("merge"), "fp")


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without near-duplicates: of each component the rows with the smallest key stay, one of them if repeated.

    Fingerprints and links travel without the texts; the keys to drop meet the documents in one anti join.
    Rows with a null key are kept, as nothing identifies them.
    """
    marked = cut(with_fingerprint(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "fp").select("key", "fp"))
    # A key that occurs more than once belongs to the least component of its rows.
    keyed = with_components(marked.filter(F.col("key").isNotNull())).groupBy("key").agg(F.min("component_id").alias("component_id"), F.count("*").alias("copies"))
    out = docs.join(keyed.filter("key <> component_id").select(F.col("key").alias(key)), key, "left_anti").select(*quoted(docs))
    if keyed.filter("key = component_id AND copies > 1").isEmpty():
        return out
    return out.filter(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(out.filter(F.col(key).isNull()))
