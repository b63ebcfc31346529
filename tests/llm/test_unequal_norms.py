"""Neighbours by inner product where vectors differ in length, many queries a part, odd rows."""

import numpy as np
import pytest

from ratecraft.llm import ann


def found(spark, x, k=20, **options):
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    got = ann.search(df, df.where("vec_id % 20 = 0"), ann.fit(df, **options), k=k, block_rows=700, block_queries=40).collect()
    out = {}
    for r in got:
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: [(v, s) for _, v, s in sorted(own)] for q, own in out.items()}


@pytest.mark.parametrize("sigma", [0.0, 0.8, 2.0])
def test_recall_by_inner_product(spark, sigma):
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 1, (40, 24))
    x = centres[rng.integers(0, 40, 6000)] + rng.normal(0, 0.6, (6000, 24))
    x = x / np.linalg.norm(x, axis=1, keepdims=True) * np.exp(rng.normal(0, sigma, (6000, 1)))
    got = found(spark, x, sample=2500, per_part=300)
    hits = 0
    for q in range(0, 6000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        best = set(np.argsort(-s, kind="stable")[:20].tolist())
        assert len(got[q]) == 20 and all(b == pytest.approx(s[v], rel=1e-12) for v, b in got[q])
        assert [b for _, b in got[q]] == sorted((b for _, b in got[q]), reverse=True)
        hits += len(best & {v for v, _ in got[q]})
    assert hits / (300 * 20) >= 0.9


def test_odd_rows_take_no_part(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 1, 4).tolist()) for i in range(60)] + [(100, None), (120, [0.0] * 4), (140, [1.0, None, 2.0, 3.0]), (160, [float("nan")] * 4), (180, [1.0, 2.0]), (None, [1.0] * 4)]
    rows += [(200 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(30)] + [(0, rows[0][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, part int")
    got = ann.search(df, df.where("vec_id % 20 = 0"), ann.fit(df)).collect()
    asked = {0, 20, 40, 200, 220}
    assert {r.query_id for r in got} == asked and len(got) == 20 * len(asked)
    assert not {r.vec_id for r in got} & {100, 120, 140, 160, 180}
    # Ties of equal vectors go to the smaller ids.
    for q in (200, 220):
        own = [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])]
        ties = [v for v in own if v >= 200]
        assert ties == sorted(ties) and q not in ties
    assert ann.fit(df.limit(0)) is None and ann.search(df, df, None).count() == 0
