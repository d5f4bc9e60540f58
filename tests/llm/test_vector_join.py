"""Cosine near duplicates against the full matrix."""
import numpy as np
import pytest

from sitemill.llm import vector_join as V

KIND = "vec_id long, embedding array<float>, label int, u string, n int"


def brute(rows, least):
    ok = [lab is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for _, v, lab, *_ in rows]
    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if o else None for (_, v, *_), o in zip(rows, ok)]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least:
                n[a], n[b] = n[a] + 1, n[b] + 1
                root[find(a)] = find(b)
    low = {}
    for a, r in enumerate(rows):
        if r[0] is not None:
            low[find(a)] = min(r[0], low.get(find(a), r[0]))
    return sorted(((r[0], n[a], low.get(find(a)), r[0] == low.get(find(a))) for a, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("block", [16, 1024])
def test_links_and_components(spark, block):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 12))
    v = [base[rng.integers(60)] + rng.normal(size=12) * rng.choice([0, 0.05, 0.12, 1]) for _ in range(500)]
    rows = [(i, [float(x) for x in w.astype(np.float32)], int(rng.integers(3)), None, None) for i, w in enumerate(v)]
    rows += [(900 + k, rows[3][1], rows[3][2], None, None) for k in range(40)]  # equal to the bit
    rows += [(3, rows[3][1], rows[3][2], None, None), (700, None, 1, None, None), (701, [], 1, None, None), (702, [0.0] * 12, 1, None, None), (703, [float("nan")] * 12, 1, None, None),
             (704, [float("inf")] * 12, 1, None, None), (705, rows[3][1], None, None, None), (706, [1.0, 2.0], 1, None, None), (707, [2.0, 4.0], 1, None, None),
             (None, rows[5][1], rows[5][2], None, None), (708, [None] * 12, 1, None, None), (709, [1e30] * 12, 2, None, None), (710, [1e-30] * 12, 2, None, None)]
    got = V.near_duplicates(spark.createDataFrame(rows, KIND), 0.98, block).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, bool(r.kept)) for r in got), key=str) == brute(rows, 0.98)


def test_empty(spark):
    assert V.near_duplicates(spark.createDataFrame([], KIND)).count() == 0


def test_blocks_meet_each_pair_once():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5))
    x /= np.linalg.norm(x, axis=1)[:, None]
    seen = np.zeros((300, 300), int)
    for i, j, found in V.join_blocks(x, x, x[:, :2], x[:, :2], 0.5, 1.0, True):
        seen[i:i + found.shape[0], j:j + found.shape[1]] += found
    assert (seen + seen.T == ((x @ x.T >= 0.5) & ~np.eye(300, dtype=bool))).all()
