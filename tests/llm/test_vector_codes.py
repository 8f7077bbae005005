"""Vector codes against plain product quantization."""

import hashlib

import numpy as np
import pytest

from lodestar.llm import vector_codes as vc

KINDS = {
    "spread": lambda rng, n, w: rng.normal(size=(n, w)) * 600,
    "copies": lambda rng, n, w: np.repeat(rng.normal(size=(n // 50 + 1, w)) * 600, 50, axis=0)[:n],
    "one_place": lambda rng, n, w: np.ones((n, w)),
    "ties": lambda rng, n, w: rng.integers(-2, 3, (n, w)),
    "far_from_zero": lambda rng, n, w: rng.integers(-3, 4, (n, w)) + (1 << 25),
}


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("n", [1, 5, 33, 200, 1500])
@pytest.mark.parametrize("width", [1, 3, 8])
def test_trees_give_nearest_entries_and_sums(kind, n, width):
    points = np.floor(KINDS[kind](np.random.default_rng(n), n, width)).astype(np.int64)
    tree = vc._unpacked(vc._packed([vc.tree_of(points)]))[0]
    assert (points[tree.order] == tree.points).all()
    entries = points[:16].copy()
    for _ in range(3):
        far = ((points[:, None] - entries) ** 2).sum(axis=2)
        chosen = far.argmin(axis=1)
        codes, errors = vc.nearest(tree, entries)
        assert (codes == chosen).all() and (errors == far[np.arange(n), chosen]).all()
        counts, sums = vc.totals(tree, entries)
        for e in range(len(entries)):
            assert counts[e] == (chosen == e).sum() and (sums[e] == points[chosen == e].sum(axis=0)).all()
            if counts[e]:
                entries[e] = sums[e] // counts[e]


def test_balls_hold_their_points_and_whole_ones_are_owned():
    rng = np.random.default_rng(1)
    points = np.vstack([rng.normal(size=(400, 4)) * 5 + c for c in (0, 5000, -5000)]).round().astype(np.int64)
    tree = vc.tree_of(points)
    for b in range(len(tree.lo)):
        own = tree.points[tree.lo[b] : tree.hi[b]]
        assert (tree.sums[b] == own.sum(axis=0)).all()
        assert (np.sqrt(((own - tree.center[b]) ** 2).sum(axis=1)) <= tree.radius[b] * (1 + 1e-9)).all()
    balls, _, places, _ = vc.owned(tree, np.array([[0] * 4, [5000] * 4, [-5000] * 4]))
    assert len(places) == 0 and len(balls) <= 40  # three clusters: no point is looked at


def brute(rows):
    """Rows of (key, vector, label) to rows of the contract."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    whole = np.floor(4096 * np.array([r[1] for r in kept], float)).astype(np.int64)
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:16]
    parts = np.split(whole, 8, axis=1)
    books = [p[order].copy() for p in parts]
    for _ in range(6):
        for p, book in zip(parts, books, strict=True):
            near = ((p[:, None] - book) ** 2).sum(axis=2).argmin(axis=1)
            for e in range(len(book)):
                if (near == e).any():
                    book[e] = [int(v) // int((near == e).sum()) for v in p[near == e].sum(axis=0)]
    far = [((p[:, None] - b) ** 2).sum(axis=2) for p, b in zip(parts, books, strict=True)]
    codes, error = np.column_stack([f.argmin(axis=1) for f in far]), sum(f.min(axis=1) for f in far)
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()
    labels = [r[2] for r in kept]
    return sorted(((r[0], "".join(f"{c:02x}" for c in code), int(e), int(sum(x for x, label in zip(error, labels, strict=True) if label == r[2])), digest) for r, code, e in zip(kept, codes, error, strict=True)), key=repr)


SCHEMA = "vec_id long, embedding array<float>, label int, code string, trees string, error int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], SCHEMA)


def test_encode_odd_rows(spark):
    rng = np.random.default_rng(5)
    vector = lambda: np.float32(rng.normal(size=16) * 0.2).tolist()
    rows = [(i, vector(), int(rng.integers(3)) or None) for i in range(70)]
    rows += [(3, rows[3][1], 1), (3, vector(), 2), (None, vector(), 1), (None, vector(), None), rows[9], *[(100 + i, rows[0][1], 7) for i in range(40)]]
    rows += [(200, None, 1), (201, [float("nan"), *vector()[1:]], 1), (202, [float("inf"), *vector()[1:]], 1), (-5, [None, *vector()[1:]], 1), (203, [float("-inf")] * 16, None)]
    got = vc.encode(frame(spark, rows).repartition(3))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_few_vectors_and_none(spark):
    rows = [(1, [0.5] * 8, None), (2, [0.25] * 8, 1), (3, [0.25] * 8, 1)]
    assert sorted(map(tuple, vc.encode(frame(spark, rows)).collect()), key=repr) == brute(rows)
    assert vc.encode(frame(spark, rows).limit(0)).count() == 0
    assert vc.encode(frame(spark, [(1, None, 1)])).count() == 0


def test_blocks_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(vc, "BLOCK_ROWS", 7)
    rows = [(i, [((i * 37) % 11) / 7] * 8, i % 2) for i in range(50)]
    assert sorted(map(tuple, vc.encode(frame(spark, rows).coalesce(1)).collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("rows", [[(1, [0.5] * 8, 1), (2, [0.5] * 16, 1)], [(1, [0.5] * 7, 1)], [(1, [1e6] * 8, 1)]])
def test_vectors_that_cant_be_coded_are_an_error(spark, rows):
    with pytest.raises(Exception, match="component"):
        vc.encode(frame(spark, rows)).collect()
