"""Frame codes against comparing every part with every entry."""

import hashlib
import math

import numpy as np
import pytest

from cohortscale.llm.frame_codes import build_tree, codebooks_digest, compress_frames, nearest_entries, part_codes, part_sums

FRAMES = "frame_id long, pixels array<float>, vendor string, code int, error string"


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, v, [math.floor(4096 * x) for x in p]) for i, p, v in rows if p is not None and all(x is not None and math.isfinite(x) for x in p)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2]) // parts
    cut = lambda s, p: s[p * width : (p + 1) * width]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    books = [[list(cut(s, p)) for _, _, s in kept[:entries]] for p in range(parts)]
    nearest = lambda s, p: min((far(cut(s, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        moved = []
        for p in range(parts):
            groups = [[] for _ in books[p]]
            for _, _, s in kept:
                groups[nearest(s, p)[1]].append(cut(s, p))
            moved.append([[sum(c) // len(g) for c in zip(*g)] if g else e for g, e in zip(groups, books[p])])
        books = moved
    out, by_vendor = [], {}
    for i, v, s in kept:
        best = [nearest(s, p) for p in range(parts)]
        error = sum(b[0] for b in best)
        by_vendor[v] = by_vendor.get(v, 0) + error
        out.append((i, v, "".join(f"{b[1]:02x}" for b in best), error))
    return sorted(((*r, by_vendor[r[1]]) for r in out), key=repr), books


def found(codes):
    return sorted(((r["frame_id"], r["vendor"], r["code"], r["error"], r["vendor_error"]) for r in codes.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 0.3, (5, 16))
    out = [(int(k), (centres[k % 5] + rng.normal(0, 0.02, 16)).astype(np.float32).tolist(), ["a", "b", None][k % 3]) for k in range(300)]
    out += [(400 + k, out[3][1], "a") for k in range(40)] + [(5, out[9][1], "b"), (5, out[9][1], "b"), (None, out[1][1], None)]
    bad = [(-1, None, "a"), (-2, [float("nan")] + [0.0] * 15, "a"), (-3, [None] + [0.0] * 15, "b"), (-4, [float("-inf")] + [0.0] * 15, None)]
    return out + bad + [(500, [0.5] * 16, "z"), (501, [-0.5] * 16, "z")]


def test_codes_match_brute_force(spark, rows):
    frames = spark.createDataFrame([(*r, 1, "x") for r in rows], FRAMES).repartition(4)
    codes, books = compress_frames(frames)
    want, want_books = brute_codes(rows)
    assert books.tolist() == want_books
    assert found(codes) == want
    assert codebooks_digest(books) == hashlib.sha256(",".join(str(x) for p in want_books for e in p for x in e).encode()).hexdigest()


def test_few_frames_and_none(spark, rows):
    few = [r for r in rows[:3]]
    codes, books = compress_frames(spark.createDataFrame([(*r, 1, "x") for r in few], FRAMES), parts=4)
    assert found(codes) == brute_codes(few, parts=4)[0] and books.shape == (4, 3, 4)
    codes, books = compress_frames(spark.createDataFrame([], FRAMES))
    assert codes.count() == 0 and books.size == 0
    codes, _ = compress_frames(spark.createDataFrame([(1, None, "a", 1, "x")], FRAMES))
    assert codes.count() == 0


def test_unequal_frames_are_refused(spark):
    for pixels in ([[0.0] * 16, [0.0] * 8], [[0.0] * 15], [[3e9] * 16]):
        frames = spark.createDataFrame([(k, p, "a", 1, "x") for k, p in enumerate(pixels)], FRAMES)
        with pytest.raises(ValueError):
            compress_frames(frames)


def test_tree_settles_subtrees_whole():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(-20, 20, (200, 4)) + c for c in (0, 5000, -9000)])
    entries = np.array([[0] * 4, [5000] * 4, [-9000] * 4, [5000] * 4])
    tree = build_tree(points)
    assert sorted(tree.order.tolist()) == list(range(600)) and tree.high[0] == 600
    sums, counts = part_sums(tree, points, entries)
    best, error = nearest_entries(points, entries)
    assert counts.tolist() == np.bincount(best, minlength=4).tolist() == [200, 200, 200, 0]
    codes, errors = part_codes(tree, points, entries)
    assert codes.tolist() == best.tolist() and errors.tolist() == error.tolist()
    assert sums.tolist() == [points[best == k].sum(axis=0).tolist() for k in range(4)]
