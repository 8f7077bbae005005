"""Codes of vectors by product quantization, with exact rounds over metric trees.

Vectors are cut into parts, and each part position has a codebook. Tasks gather vectors into blocks
and build, for each part of a block, a metric tree by anchors: points are dealt out to about the
square root of their number of anchors, each new one the point farthest from its own, with only those
points tried that the triangle inequality leaves; anchors merge from the middle upwards by the
smallest joint ball, and are split downwards in the same way. Balls cache sums and counts. A round
walks each tree from its root with a list of candidate entries that children inherit and that
shrinks wherever an entry is farther than another for all of a ball, until one entry owns the whole
ball, whose sums are then added unseen; at the leaves, what is left is compared point by point.
All distances that decide are of integers; balls only rule out what is farther by more than rounding.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.columns import cut, small_batches

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Vectors of a block at most, and components; they bound a task's memory.
BLOCK_ROWS = 4096
BLOCK_CELLS = 1 << 20
#: Balls of so many points aren't split.
LEAF = 32
#: Integer components beyond this could overflow a squared distance.
LARGEST = 1 << 26


@dataclass
class Tree:
    """Balls in order of their depth; a ball's points are ``points[lo:hi]``, its children balls ``child`` to ``child + kids``."""

    points: np.ndarray
    order: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    child: np.ndarray
    kids: np.ndarray
    sums: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [self.points, self.order, self.center, self.radius, self.lo, self.hi, self.child, self.kids, self.sums]


def anchors(x: np.ndarray, wanted: int) -> tuple[np.ndarray, int]:
    """The anchor of each point, and the number of anchors: fewer than wanted if the points run out of distinct places."""
    places = [0]
    owner = np.zeros(len(x), np.int64)
    away = np.sqrt(((x - x[0]) ** 2).sum(axis=1))
    while len(places) < wanted and away.max() > 0:
        new = int(away.argmax())
        apart = np.sqrt(((x[places] - x[new]) ** 2).sum(axis=1))
        near = np.flatnonzero(2 * away >= apart[owner])
        d = np.sqrt(((x[near] - x[new]) ** 2).sum(axis=1))
        stolen = d < away[near]
        owner[near[stolen]], away[near[stolen]] = len(places), d[stolen]
        places.append(new)
    return owner, len(places)


def _split(x: np.ndarray, at: np.ndarray):
    """A nested tree over the points ``at``: an array for a leaf, else a pair of subtrees."""
    if len(at) <= LEAF:
        return at
    own = x[at]
    owner, n = anchors(own, int(np.ceil(np.sqrt(len(at)))))
    if n == 1:
        return at
    by = np.argsort(owner, kind="stable")
    groups = np.split(at[by], np.flatnonzero(np.diff(owner[by])) + 1)
    nodes = [_split(x, g) for g in groups]
    centers = np.array([x[g].mean(axis=0) for g in groups])
    radii = np.array([np.sqrt(((x[g] - c) ** 2).sum(axis=1).max()) for g, c in zip(groups, centers, strict=True)])
    sizes = np.array([len(g) for g in groups], float)
    apart = np.sqrt(((centers[:, None] - centers) ** 2).sum(axis=2))
    joint = np.maximum((apart + radii[:, None] + radii) / 2, np.maximum(radii[:, None], radii))
    np.fill_diagonal(joint, np.inf)
    for _ in range(n - 1):
        i, j = sorted(divmod(int(joint.argmin()), n))
        nodes[i], nodes[j] = (nodes[i], nodes[j]), None
        center = (centers[i] * sizes[i] + centers[j] * sizes[j]) / (sizes[i] + sizes[j])
        radii[i] = max(np.sqrt(((center - centers[k]) ** 2).sum()) + radii[k] for k in (i, j))
        centers[i], sizes[i] = center, sizes[i] + sizes[j]
        gap = np.sqrt(((centers - center) ** 2).sum(axis=1))
        line = np.maximum((gap + radii + radii[i]) / 2, np.maximum(radii, radii[i]))
        line[[i, *[k for k in range(n) if nodes[k] is None]]] = np.inf
        joint[i], joint[:, i] = line, line
        joint[j], joint[:, j] = np.inf, np.inf
    return nodes[0]


def tree_of(points: np.ndarray) -> Tree:
    """The metric tree of one part of a block's integer vectors."""
    x = points.astype(float)
    root = _split(x, np.arange(len(points)))
    order, spans, stack = [], {}, [(root, False)]
    at = 0
    while stack:  # deals out places so that a ball's points are neighbours
        node, over = stack.pop()
        if isinstance(node, np.ndarray):
            spans[id(node)] = (at, at + len(node))
            at += len(node)
            order.append(node)
        elif over:
            spans[id(node)] = (spans[id(node[0])][0], spans[id(node[1])][1])
        else:
            stack += [(node, True), (node[1], False), (node[0], False)]
    order = np.concatenate(order)
    balls, child, kids = [root], [], []
    for node in balls:
        child.append(len(balls))
        kids.append(0 if isinstance(node, np.ndarray) else 2)
        if kids[-1]:
            balls += node
    lo, hi = np.array([spans[id(b)] for b in balls]).T
    sorted_points = points[order]
    running = np.vstack([np.zeros((1, points.shape[1]), np.int64), np.cumsum(sorted_points, axis=0)])
    sums = running[hi] - running[lo]
    center = sums / (hi - lo)[:, None]
    radius = np.array([np.sqrt(((sorted_points[a:b] - c) ** 2).sum(axis=1).max(initial=0)) for a, b, c in zip(lo, hi, center, strict=True)])
    return Tree(sorted_points, order, center, radius, lo, hi, np.array(child), np.array(kids), sums)


def owned(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(balls, their entry) that one entry owns whole, and (places, their entry) of points that were compared alone."""
    k, e = len(entries), entries.astype(float)
    first = np.array([not any((entries[i] == entries[j]).all() for j in range(i)) for i in range(k)])
    between = np.sqrt(((e[:, None] - e) ** 2).sum(axis=2))
    rounding = 1e-9 * max(1.0, np.abs(e).max(initial=0) / SCALE, np.abs(tree.center).max(initial=0) / SCALE)
    ball, mask = np.array([0]), first[None, :]
    whole, whose, places, chosen = [], [], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while len(ball):
        d = ((tree.center[ball][:, None] - e) ** 2).sum(axis=2)
        best = np.where(mask, d, np.inf).argmin(axis=1)
        near = d[np.arange(len(ball)), best]
        slack = rounding * (1 + d + near[:, None])
        mask = mask & ~(d - near[:, None] - 2 * tree.radius[ball][:, None] * between[best] > slack)
        alone = mask.sum(axis=1) == 1
        whole.append(ball[alone])
        whose.append(best[alone])
        leaf = ~alone & (tree.kids[ball] == 0)
        if leaf.any():
            sizes = tree.hi[ball[leaf]] - tree.lo[ball[leaf]]
            at = np.repeat(tree.lo[ball[leaf]] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            exact = ((tree.points[at][:, None] - entries) ** 2).sum(axis=2)
            exact[~np.repeat(mask[leaf], sizes, axis=0)] = np.iinfo(np.int64).max
            places.append(at)
            chosen.append(exact.argmin(axis=1))
        down = ~alone & ~leaf
        first_child = tree.child[ball[down]]
        ball, mask = np.concatenate([first_child, first_child + 1]), np.concatenate([mask[down], mask[down]])
    return np.concatenate(whole), np.concatenate(whose), np.concatenate(places), np.concatenate(chosen)


def totals(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums of the points nearest to each entry."""
    balls, whose, places, chosen = owned(tree, entries)
    counts, sums = np.zeros(len(entries), np.int64), np.zeros(entries.shape, np.int64)
    np.add.at(counts, whose, tree.hi[balls] - tree.lo[balls])
    np.add.at(sums, whose, tree.sums[balls])
    np.add.at(counts, chosen, 1)
    np.add.at(sums, chosen, tree.points[places])
    return counts, sums


def nearest(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the block's vectors in their own order: the nearest entry and its squared distance."""
    balls, whose, places, chosen = owned(tree, entries)
    by_place = np.zeros(len(tree.points), np.int64)
    for ball, entry in zip(balls, whose, strict=True):
        by_place[tree.lo[ball] : tree.hi[ball]] = entry
    by_place[places] = chosen
    far = ((tree.points - entries[by_place]) ** 2).sum(axis=1)
    codes, errors = np.empty_like(by_place), np.empty_like(far)
    codes[tree.order], errors[tree.order] = by_place, far
    return codes, errors


def _packed(trees: list[Tree]) -> bytes:
    out = io.BytesIO()
    np.savez(out, *[a for t in trees for a in t.arrays()])
    return out.getvalue()


def _unpacked(data: bytes) -> list[Tree]:
    with np.load(io.BytesIO(data), allow_pickle=False) as held:
        arrays = [held[f"arr_{i}"] for i in range(len(held.files))]
    return [Tree(*arrays[i : i + 9]) for i in range(0, len(arrays), 9)]


def integers(vectors: list | np.ndarray, width: int) -> np.ndarray:
    """Rows of floor(SCALE * x); every vector must have ``width`` components, and none may be too large to square."""
    if any(len(v) != width for v in vectors):
        raise ValueError(f"vectors must all have {width} components")
    x = np.floor(SCALE * np.array(vectors, float).reshape(len(vectors), width))
    if np.abs(x).max(initial=0) > LARGEST:
        raise ValueError(f"components beyond {LARGEST // SCALE} can't be squared in 64 bits")
    return x.astype(np.int64)


def blocks(rows: DataFrame, width: int) -> DataFrame:
    """(keys, labels, trees): one row for each block of ``rows`` of key, label and vector."""
    key, label = (rows.schema[c].dataType.simpleString() for c in ("key", "label"))
    most = max(1, min(BLOCK_ROWS, BLOCK_CELLS // max(width, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def made(final: bool) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            held.clear()
            stop = len(table) if final else len(table) - len(table) % most
            for i in range(0, stop, most):
                part = table.slice(i, min(most, stop - i))
                x = integers(part.column(2).to_pylist(), width)
                trees = [tree_of(np.ascontiguousarray(p)) for p in np.split(x, PARTS, axis=1)]
                listed = [pa.array([part.column(c).to_pylist()], pa.list_(part.schema.field(c).type)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*listed, pa.array([_packed(trees)], pa.binary())], ["keys", "labels", "trees"])
            held.extend(table.slice(stop).to_batches())

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= most:
                yield from made(False)
        if held:
            yield from made(True)

    return rows.mapInArrow(run, f"keys array<{key}>, labels array<{label}>, trees binary")


def trained(held: DataFrame, codebooks: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks after ``rounds`` rounds: one pass over the blocks each, of which a sum for each task and entry is shuffled."""
    for _ in range(rounds):
        now = list(codebooks)

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            counts = [np.zeros(len(c), np.int64) for c in now]
            sums = [np.zeros(c.shape, np.int64) for c in now]
            for batch in batches:
                for data in batch.column(0):
                    for p, tree in enumerate(_unpacked(data.as_py())):
                        n, s = totals(tree, now[p])
                        counts[p] += n
                        sums[p] += s
            cells = [(p, e, int(n[e]), s[e].tolist()) for p, (n, s) in enumerate(zip(counts, sums, strict=True)) for e in range(len(n)) if n[e]]
            if cells:
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*cells, strict=True), kinds, strict=True)], ["part", "entry", "n", "sums"])

        cells = held.select("trees").mapInArrow(run, "part int, entry int, n bigint, sums array<bigint>")
        long = cells.select("part", "entry", "n", F.posexplode_outer("sums").alias("at", "s")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        codebooks = [c.copy() for c in now]
        for r in long.collect():  # as many rows as the codebooks have numbers
            if r["at"] is not None:
                codebooks[r["part"]][r["entry"], r["at"]] = int(r["s"]) // r["n"]
    return codebooks


def encode(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per kept vector: ``key``, code, error, label_error, codebooks_sha256.

    Vectors that are null, or hold a null or a number that isn't finite, are dropped. All others need
    one length, a multiple of ``PARTS``; others are an error, as are components beyond 16,384. The
    codebooks start from the vectors of the least keys, null keys last and equal keys in the order of
    their vectors; with fewer vectors than entries they are smaller. Repeated rows each count and
    keep their row, equal entries tie to the first, null labels add up together. An empty table
    gives no rows; other columns are left out, whatever their names.

    Blocks are written to the shared folder once; each of the rounds and the last pass read them
    there. Label sums are combined within tasks before they are shuffled, and a label that many rows
    share meets them in a join whose skewed partitions Spark splits.
    """
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vector").isNotNull() & finite)
    start = [r["vector"] for r in rows.orderBy(F.col("key").asc_nulls_last(), "vector").limit(ENTRIES).collect()]
    width = len(start[0]) if start else 0
    if width % PARTS:
        raise ValueError(f"vectors of {width} components can't be cut into {PARTS} equal parts")
    held = cut(blocks(rows, width))
    codebooks = trained(held, np.split(integers(start, width), PARTS, axis=1))
    digest = hashlib.sha256(",".join(str(v) for c in codebooks for v in c.ravel().tolist()).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, labels, data in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                found = [nearest(t, c) for t, c in zip(_unpacked(data.as_py()), codebooks, strict=True)]
                codes = np.column_stack([c for c, _ in found]).astype(np.uint8)
                hexes = codes.tobytes().hex()
                text = [hexes[i : i + 2 * PARTS] for i in range(0, len(hexes), 2 * PARTS)]
                yield pa.RecordBatch.from_arrays([keys.values, labels.values, pa.array(text, pa.string()), pa.array(sum(e for _, e in found), pa.int64())], ["key", "label", "code", "error"])

    kinds = (rows.schema[c].dataType.simpleString() for c in ("key", "label"))
    coded = cut(held.mapInArrow(run, "key {}, label {}, code string, error bigint".format(*kinds)))
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(F.col("key").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle() -> str:
    """The same in SQL, the rounds one after another."""
    def assigned(r: int) -> str:
        return f"a{r} AS MATERIALIZED (SELECT rid, p, x, e, d FROM (SELECT q.rid, q.p, q.x, c.e, list_sum(list_transform(list_zip(q.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts q JOIN c{r} c USING (p)) QUALIFY row_number() OVER (PARTITION BY rid, p ORDER BY d, e) = 1)"

    steps = []
    for r in range(ROUNDS):
        steps.append(assigned(r))
        steps.append(f"s{r} AS (SELECT p, e, pos, sum(v)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT p, e, generate_subscripts(x, 1) AS pos, unnest(x) AS v FROM a{r}) GROUP BY p, e, pos)")
        steps.append(f"m{r} AS (SELECT p, e, list(((s - ((s % n + n) % n)) // n)::BIGINT ORDER BY pos) AS x FROM s{r} GROUP BY p, e)")
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (p, e))")
    steps.append(assigned(ROUNDS))
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS rid, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT rid, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x FROM (SELECT rid, v, unnest(range({PARTS})) AS p FROM kept)),
c0 AS (SELECT p, rid AS e, x FROM parts WHERE rid < {ENTRIES}),
{', '.join(steps)},
coded AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY rid)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM c{ROUNDS}) AS codebooks_sha256
FROM coded JOIN kept USING (rid)
"""
