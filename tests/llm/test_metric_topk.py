import math
import random

import numpy as np
import pytest

from kerbline.llm import metric_topk


def brute(rows, k=5):
    clean = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            clean.setdefault(i, set()).add(tuple(math.floor(256 * float(np.float32(x))) for x in v))
    out = {}
    for q in (i for i in clean if i % 50 == 0):
        for u in clean[q]:
            scores = {(-sum(a * b for a, b in zip(u, v)), i) for i in clean if i != q for v in clean[i]}
            out[q] = [(r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def check(spark, rows, **options):
    got = {}
    for r in metric_topk.top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), **options).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = {q: hits for q, hits in brute(rows).items() if hits}
    assert {q: sorted(hits) for q, hits in got.items()} == want


def vectors(n, dim, spreads, seed=0):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(8)]
    return [(i, [x + r.gauss(0, spreads) for x in centres[i % 8]]) for i in range(n)]


@pytest.mark.parametrize("spreads", [0.02, 1.0])
def test_equals_brute_force(spark, spreads):
    check(spark, vectors(1500, 12, spreads), tree_rows=200, group_rows=300)


def test_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(metric_topk, "QUERY_BLOCK", 4)
    check(spark, vectors(900, 6, 0.3), tree_rows=100, group_rows=90)


def test_copies_and_ties(spark):
    rows = [(i, [0.5, -0.25]) for i in range(400)] + [(1000 + i, [float(i % 3), 1.0]) for i in range(300)]
    check(spark, rows, tree_rows=50)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("-inf"), 1.0]), (None, [1.0, 1.0]),
            (5, []), (6, [3.0]), (50, [-1.0, -1.0, 2.0]), (100, [0.0, 0.0]), (7, [1e9, -1e9])]
    check(spark, rows)
    check(spark, [(50, [1.0])])
    check(spark, [(1, [1.0]), (2, [1.0])])


def test_bounds_save_distances():
    m = metric_topk._lifted(np.array([v for _, v in vectors(4000, 8, 0.01)]), 1e3)
    pages = metric_topk.build_tree(m, m[0])
    assert sorted(np.concatenate([p["at"] for p in pages if p["leaf"]]).tolist()) == list(range(4000))
    for p in pages:
        for i, at in enumerate(p["at"]):
            if not p["leaf"]:
                below = [p["child"][i]]
                while below:
                    x = pages[below.pop()]
                    assert (metric_topk._distances(m[x["at"]], m[at]) <= p["radius"][i] + 1e-9).all()
                    below += [] if x["leaf"] else x["child"].tolist()
