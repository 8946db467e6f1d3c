import math

import numpy as np
import pytest

from lexiloom.llm import vectors


def brute(rows):
    def usable(v):
        return v is not None and len(v) == 24 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    good = [(i, np.array(v, float)) for i, v in rows if i is not None and usable(v)]
    n = len(good)
    x = np.array([v / np.linalg.norm(v) for _, v in good])
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    root = [i for i, _ in good]
    changed = True
    while changed:
        changed = False
        for a in range(n):
            low = min([root[a], *(root[b] for b in np.flatnonzero(near[a]))])
            if low < root[a]:
                root[a], changed = low, True
    out = {i: (i, int(near[a].sum()), root[a], root[a] == i) for a, (i, _) in enumerate(good)}
    return [out.get(i, (i, 0, i, i is not None)) for i, _ in rows]


def corpus(seed):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((60, 24))
    rows = [(int(k), (base[rng.integers(60)] * rng.choice([1, 3]) + rng.standard_normal(24) * rng.choice([0.05, 0.15, 0.3, 1.0])).astype(np.float32).tolist()) for k in range(800)]
    hot = rng.standard_normal(24)
    rows += [(1000 + k, (hot + rng.standard_normal(24) * 0.12).astype(np.float32).tolist()) for k in range(150)]
    same = rows[5][1]
    rows += [(2000 + k, same) for k in range(20)]
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf"), *[1.0] * 23], [None, *[1.0] * 23], [1.0, 2.0]]
    return rows + [(3000 + k, v) for k, v in enumerate(odd)] + [(None, same)]


def test_recall_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 40)
    monkeypatch.setattr(vectors, "PART", 30)
    rows = corpus(3)
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, component string").repartition(3)
    got = {r.vec_id: tuple(r) for r in vectors.near_duplicates(df).collect()}
    want = {r[0]: r for r in brute(rows)}
    assert got.keys() == want.keys()
    assert got[None] == (None, 0, None, False)
    # None below the threshold, and nearly all above it.
    assert all(got[k][1] <= want[k][1] for k in want if k is not None)
    assert sum(g[1] for g in got.values()) >= 0.98 * sum(w[1] for w in want.values())
    assert sum(got[k] == want[k] for k in want if k is not None) >= 0.98 * len(want)
    assert all(got[3000 + k] == (3000 + k, 0, 3000 + k, True) for k in range(7))


def test_links_between_crowded_groups(spark, monkeypatch):
    # Two groups of near-equal vectors, all of which link, and a third one that does not; lists have no room for the other group.
    monkeypatch.setattr(vectors, "LARGEST", 12)
    rng = np.random.default_rng(8)
    one, side, far = rng.standard_normal((3, 24))
    side -= side @ one / (one @ one) * one
    two = one + side / np.linalg.norm(side) * np.linalg.norm(one) * 0.2
    rows = [(1000 * g + k, (mid + rng.standard_normal(24) * 0.03).tolist()) for g, mid in enumerate((one, two, far)) for k in range(100)]
    got = {r.vec_id: tuple(r) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()}
    want = {r[0]: r for r in brute(rows)}
    assert {w[2] for w in want.values()} == {0, 2000} and want[5][1] == want[1005][1] == 199
    assert got == want


def test_audit_of_few_links(spark, monkeypatch):
    # One pair of vectors links; the audit holds it, and a graph without it is an error.
    monkeypatch.setattr(vectors, "ROUNDS", 2)
    v = np.random.default_rng(5).standard_normal((600, 24))
    v[599] = v[0] + 0.01
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    held, recall = [], vectors._recall
    monkeypatch.setattr(vectors, "_recall", lambda truth, parts: held.append(truth.count()) or recall(truth, parts))
    assert {r.vec_id for r in vectors.near_duplicates(df).where("n_links > 0").collect()} == {0, 599}
    assert held == [2]
    monkeypatch.setattr(vectors, "_recall", lambda truth, parts: 0.5)
    with pytest.raises(RuntimeError):
        vectors.near_duplicates(df)


def test_empty(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_repeated_ids_and_lengths(spark):
    a, b, c = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]
    rows = [(1, a), (1, b), (2, a), (3, b), (4, c), (10, [1.0, 0.0]), (11, [1.0, 0.01]), (12, [0.0, 1.0]), (13, [5.0]), (14, [2.0]), (15, None), (None, a)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in vectors.near_duplicates(df).where("vec_id is not null").collect())
    assert got == [
        (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True),
        (10, 1, 10, True), (11, 1, 10, False), (12, 0, 12, True), (13, 1, 13, True), (14, 1, 13, False), (15, 0, 15, True),
    ]


def test_hot_vectors_and_ties(spark, monkeypatch):
    # Very many rows of one vector, one component with most vectors, and a pair at the threshold itself.
    monkeypatch.setattr(vectors.common, "HOT_ROWS", 5)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "ROWS", 5)
    rng = np.random.default_rng(2)
    hot, other = rng.standard_normal((2, 24))
    rows = [(k, hot.tolist()) for k in range(60)] + [(100 + k, (other + rng.standard_normal(24) * 0.02).tolist()) for k in range(50)]
    tie = np.zeros((2, 24))
    tie[0, 0], tie[1, :2] = 1, (19, math.sqrt(39))
    rows += [(500 + k, v.tolist()) for k, v in enumerate(tie)] + [(600 + k, rng.standard_normal(24).tolist()) for k in range(30)]
    got = {r.vec_id: tuple(r) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()}
    assert got == {r[0]: r for r in brute(rows)} and got[0][1] == 59 and got[500][1] == 1
