"""A query whose likely parts are small goes on to others until it has enough candidates."""

from collections import Counter

import numpy as np

from ratecraft.llm import ann


def test_probes_are_topped_up(spark):
    # Two parts by the larger component: 40 vectors in one, 3 in the other.
    rows = [(i, [1.0, 0.002 * i]) for i in range(40)] + [(100 + i, [0.01 * i, 1.0]) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    net = lambda n: ann.Net(np.eye(n, 2), np.zeros(2), 50 * np.eye(2), np.zeros(2))
    router = ann.Router(net(3), net(2), 0.5, 0.0, 0.0, np.arange(3), np.array([r[1] for r in rows[:3]]))
    got = Counter(r.query_id for r in ann.search(df, df.where("vec_id in (0, 100, 101, 102)"), router, k=5).collect())
    assert got == {0: 5, 100: 5, 101: 5, 102: 5}
    assert ann.search(df.limit(0), df, router, k=5).count() == 0
    everything = ann.search(df, df.where("vec_id = 100"), router, k=60).count()
    assert everything == 42
