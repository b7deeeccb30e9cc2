import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fringe.llm import ann


@pytest.mark.parametrize(("side", "dims", "bits"), [(8, 2, 3), (4, 3, 2), (2, 5, 1)])
def test_hilbert_steps_are_neighbours(side, dims, bits):
    cells = np.array(list(itertools.product(range(side), repeat=dims)))
    keys = ann.hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(side**dims))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def brute(rows, asks, k):
    fine = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q in filter(asks, fine):
        scored = sorted((-(fine[i] * fine[q]).sum(), i) for i in fine if i != q and len(fine[i]) == len(fine[q]))
        if scored:
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def rows(n=900):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 6))
    out = [(i, (centres[i % 12] + rng.normal(size=6) * 0.3).tolist()) for i in range(n)]
    out += [(2000 + i, [1.0, 0.5, 0.0, 0.0, 0.0, 2.0]) for i in range(150)]
    bad = [None, [], [0.0] * 6, [1.0, None, 1.0, 1.0, 1.0, 1.0], [float("nan")] * 6, [float("inf"), 1.0, 1.0, 1.0, 1.0, 1.0], [1.0, 2.0]]
    other = [(4000 + i * 10, rng.normal(size=3).tolist()) for i in range(30)]  # of another dimension
    return out + other + [(3000 + i * 20, v) for i, v in enumerate(bad)] + [(None, [1.0] * 6), out[0]]


def test_no_pair_is_ranked_twice_and_none_beyond_the_windows():
    """Blocks of two orderings against brute force over the pairs within reach in either."""
    rng = np.random.default_rng(5)
    n, reach, k = 300, 40, 7
    v, at = rng.normal(size=(n, 4)), np.stack([rng.permutation(n), rng.permutation(n)], 1)
    ids = pa.array([[i] if i % 3 else [i, 1000 + i] for i in range(n)])
    asks = np.arange(0, n, 3)
    pairs = [list(zip(*(x.tolist() for x in ann._rank_block(v[asks], at[asks], v, at, ids, c, reach, k)), strict=True)) for c in (0, 1)]
    for c in (0, 1):
        for j, q in enumerate(asks):
            near = [i for i in range(n) if abs(at[i, c] - at[q, c]) <= reach and not (c and abs(at[i, 0] - at[q, 0]) <= reach)]
            want = sorted((-(v[i] * v[q]).sum(), m) for i in near for m in ids[i].as_py())[:k]
            assert [(m, s) for w, m, s in pairs[c] if w == j] == [(m, -s) for s, m in want]


def test_recall_against_brute_force_and_ties(spark):
    data = rows()
    df = spark.createDataFrame([(i, v, 1) for i, v in data], "vec_id long, embedding array<double>, rank int")
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, k=10, block_rows=64, recall=0.97).collect()
    want = brute(dict(data).items(), lambda i: i % 20 == 0, 10)
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(found) == set(want) and all(len(found[q]) == len(want[q]) for q in want)
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert all(x == sorted(x, key=lambda p: (-p[1], p[0])) for x in found.values())
    assert [i for i, _ in found[2000]] == list(range(2001, 2011)) and [i for i, _ in found[2020]] == list(range(2000, 2010))


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [0.5, 0.5])], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 3), (0, 2, 20), (20, 1, 3), (20, 2, 0)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(df.where("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(df.where("vec_id = 3"), F.col("vec_id") % 20 == 0).count() == 0
