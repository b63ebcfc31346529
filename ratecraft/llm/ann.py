"""Approximate nearest neighbours by learned partitions of a neighbour graph.

On a bounded sample the exact neighbour graph of inner products is built and cut into balanced parts by
size-constrained label propagation from a balanced clustering.  Of two small softmax classifiers one says under which part a vector is
stored, from its direction and length; the other learns how the neighbours of a query spread over the stored parts, from its
direction alone, for a query's length changes no order.  Every vector of the table is stored under its
most probable part; a query goes to its most probable parts until they hold enough of the
probability, and their vectors are reranked exactly.  How much is enough is set on
sample vectors that the classifier has not seen.  The k-th best inner product with sample vectors of the probed parts bounds a
query's from below, so blocks give on only what reaches it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Net(NamedTuple):
    """A softmax classifier of one hidden layer."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def __call__(self, f: np.ndarray) -> np.ndarray:
        z = np.maximum(f @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


class Router(NamedTuple):
    """Where vectors are stored, where queries go and how much probability they probe; and the sample, by rising id."""

    store: Net
    route: Net
    mass: float
    centre: float
    spread: float
    ids: np.ndarray
    sample: np.ndarray

    def part_of(self, x: np.ndarray) -> np.ndarray:
        return self.store(stored_features(x, self.centre, self.spread)).argmax(1)

    def ranked(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts by falling probability for queries, and the probability before each."""
        p = self.route(unit(x))
        order = np.argsort(-p, axis=1, kind="stable")
        p = np.take_along_axis(p, order, 1)
        return order, np.cumsum(p, 1) - p

    def floor(self, x: np.ndarray, ids: np.ndarray, probed: np.ndarray, k: int) -> np.ndarray:
        """An inner product that k vectors of the probed parts reach: that of sample vectors of other ids, stored there."""
        if len(self.sample) <= k:
            return np.full(len(x), -np.inf)
        out, home = np.empty(len(x)), self.part_of(self.sample)
        for a in range(0, len(x), 512):
            s = x[a : a + 512] @ self.sample.T
            s[(self.ids[None, :] == ids[a : a + 512, None]) | ~probed[a : a + 512][:, home]] = -np.inf
            out[a : a + 512] = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        # Sums taken in another order may differ by rounding.
        return out - 1e-9 * np.linalg.norm(x, axis=1) * np.linalg.norm(self.sample, axis=1).max()


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def stored_features(x: np.ndarray, centre: float, spread: float) -> np.ndarray:
    """Direction, and the length on a logarithmic scale."""
    z = (np.log(np.maximum(np.linalg.norm(x, axis=1), 1e-300)) - centre) / spread if spread > 1e-6 else np.zeros(len(x))
    return np.hstack([unit(x), np.clip(z, -4, 4)[:, None]])


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Exact k of largest inner product with each sample vector, in blocks."""
    out = np.empty((len(x), k), np.int32)
    for a in range(0, len(x), 512):
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 1.3, sweeps: int = 12, seed: int = 5) -> np.ndarray:
    """Parts of at most ``slack`` times the mean size with few graph edges between them."""
    rng = np.random.default_rng(seed)
    n = len(x)
    most = int(np.ceil(slack * n / parts))
    centre = x[rng.permutation(n)[:parts]].copy()
    for _ in range(8):
        near = (x @ centre.T).argmax(1)
        for p in range(parts):
            if (own := near == p).any():
                centre[p] = x[own].mean(0)
                centre[p] /= max(np.linalg.norm(centre[p]), 1e-30)
            else:
                centre[p] = x[rng.integers(n)]
    score = x @ centre.T
    part, size = np.full(n, -1), np.zeros(parts, np.int64)
    for i in np.argsort(-score.max(1)):
        for p in np.argsort(-score[i]):
            if size[p] < most:
                part[i], size[p] = p, size[p] + 1
                break
    least = int(n / parts / slack / 2)
    for _ in range(sweeps):
        moved = 0
        for i in rng.permutation(n):
            votes = np.bincount(part[graph[i]], minlength=parts)
            p, now = int(votes.argmax()), part[i]
            if votes[p] > votes[now] and size[p] < most and size[now] > least:
                part[i] = p
                size[p], size[now] = size[p] + 1, size[now] - 1
                moved += 1
        if moved < n // 200:
            break
    return part


def learn(x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 25, decay: float = 1e-4, seed: int = 9) -> Net:
    """Fits shares of parts to features, by Adam on the cross-entropy."""
    rng = np.random.default_rng(seed)
    d, parts = x.shape[1], target.shape[1]
    theta = [rng.normal(0, (2 / d) ** 0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, (hidden, parts)), np.zeros(parts)]
    m, v = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    step, order = 0, np.arange(len(x))
    for epoch in range(epochs):
        rate = 0.004 * (1 - epoch / epochs) + 1e-4
        rng.shuffle(order)
        for a in range(0, len(order), 256):
            at = order[a : a + 256]
            h = np.maximum(x[at] @ theta[0] + theta[1], 0)
            z = h @ theta[2] + theta[3]
            p = np.exp(z - z.max(1, keepdims=True))
            g = (p / p.sum(1, keepdims=True) - target[at]) / len(at)
            gh = (g @ theta[2].T) * (h > 0)
            grads = [x[at].T @ gh + decay * theta[0], gh.sum(0), h.T @ g + decay * theta[2], g.sum(0)]
            step += 1
            for t, g, i in zip(theta, grads, range(4)):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                t -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Net(*theta)


def enough_mass(router: Router, x: np.ndarray, target: np.ndarray, recall: float) -> float:
    """The least probability to probe at which unseen queries find ``recall`` of their neighbours."""
    ranked, before = router.ranked(x)
    held = np.take_along_axis(target, ranked, 1)
    for mass in np.linspace(0.5, 1.0, 101):
        if (held * (before < mass)).sum(1).mean() >= recall:
            break
    return float(mass)


def usable(column: str) -> Column:
    """Whether a vector has components, all finite, and isn't zero."""
    c = F.col(column)
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return c.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(c, lambda v: v != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def shares(graph: np.ndarray, part: np.ndarray, parts: int) -> np.ndarray:
    """For each row of the graph, how its neighbours spread over parts."""
    out = np.zeros((len(graph), parts), np.float32)
    np.add.at(out, (np.repeat(np.arange(len(graph)), graph.shape[1]), part[graph].ravel()), 1 / graph.shape[1])
    return out


def fit(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", parts: int | None = None, sample: int = 6000, most_sample: int = 30_000, k: int = 20, per_part: int = 1500, recall: float = 0.96
) -> Router | None:
    """Learns the partition on a sample of usable vectors, those of the least hashes of their id.

    By default there is a part for every ``per_part`` vectors of the whole table, at least 8.  The sample has ``sample`` vectors, or 25 a
    part, but at most ``most_sample``, which bounds the parts too: larger tables have larger parts, cut into blocks.  Of vectors of
    several lengths those of the sample's commonest take part.  Returns None when no vector is usable.
    """
    good = vectors.where(usable(vector_col) & F.col(id_col).isNotNull())
    n = good.count()
    if not n:
        return None
    if parts is None:
        parts = max(8, -(-n // per_part))
    size = min(most_sample, max(sample, 25 * parts))
    rows = good.select(id_col, F.col(vector_col).cast("array<double>")).orderBy(F.xxhash64(id_col), id_col).limit(size).collect()
    lengths = Counter(len(r[1]) for r in rows)
    d = max(lengths, key=lambda m: (lengths[m], -m))
    own = dict(sorted(((r[0], r[1]) for r in rows if len(r[1]) == d), key=lambda r: r[0]))
    ids, x = np.array(list(own)), np.array(list(own.values()), np.float64)
    logs = np.log(np.linalg.norm(x, axis=1))
    centre, spread = float(logs.mean()), float(logs.std())
    parts = max(1, min(parts, len(x) // 25))
    if parts == 1:
        nothing = lambda m: Net(np.zeros((m, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
        return Router(nothing(d + 1), nothing(d), 1.0, centre, spread, ids, x)
    graph = neighbour_graph(x, min(k, len(x) - 1))
    # One more component makes all lengths equal, so the largest inner products are the nearest directions.
    reach = np.minimum(np.linalg.norm(x, axis=1) / np.quantile(np.linalg.norm(x, axis=1), 0.99), 1.0)[:, None]
    part = balanced_parts(np.hstack([unit(x) * reach, np.sqrt(1 - reach * reach)]), graph, parts)
    label = np.zeros((len(x), parts), np.float32)
    label[np.arange(len(x)), part] = 0.5
    store = learn(stored_features(x, centre, spread), label + 0.5 * shares(graph, part, parts))
    stored = store(stored_features(x, centre, spread)).argmax(1)
    target = shares(graph, stored, parts)
    order = np.random.default_rng(17).permutation(len(x))
    unseen, seen = order[: len(x) // 6], order[len(x) // 6 :]
    router = Router(store, learn(unit(x[seen]), target[seen]), 1.0, centre, spread, ids, x)
    return router._replace(mass=enough_mass(router, x[unseen], target[unseen], recall)) if len(unseen) else router


def search(
    vectors: DataFrame,
    queries: DataFrame,
    router: Router | None,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    block_rows: int = 4096,
    block_queries: int = 2048,
) -> DataFrame:
    """(query_id, rank, id, score): each query's k nearest vectors found, its own id left out.

    Nearness is the inner product in double precision; ties go to the smaller id.  Vectors that are
    null, zero or hold null or non-finite components take no part, nor do rows with a null id or with another number of components
    than the index has.  Repeated rows of an id count as one vector, that of their first in order.
    A part is cut into blocks of about ``block_rows`` vectors, and its queries into blocks of about ``block_queries``, by a hash of
    the id, so none is gathered.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType.simpleString()
    schema = f"query_id {id_type}, rank int, `{id_col}` {id_type}, score double"
    if router is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(router)  # a few thousand weights a part, and the bounded sample
    d = router.sample.shape[1]

    def good(frame: DataFrame) -> DataFrame:
        own = frame.where(usable(vector_col) & F.col(id_col).isNotNull() & (F.size(vector_col) == d))
        return own.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).groupBy("id").agg(F.min("v").alias("v"))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part = shared.value.part_of(_matrix(batch.column(1))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(part)], ["id", "v", "part"])

    stored = good(vectors).mapInArrow(store, f"id {id_type}, v array<double>, part int")
    counted = {r.part: r["count"] for r in stored.groupBy("part").count().collect()}
    sizes = np.zeros(len(router.route.b2), np.int64)
    sizes[np.array(list(counted), np.int64)] = list(counted.values())

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, own = _matrix(batch.column(1)), shared.value
            order, before = own.ranked(x)
            held = sizes[order]
            # Probing goes on until there are k vectors besides the query.
            row, rank = np.nonzero((before < own.mass + 1e-300) | (np.cumsum(held, 1) - held <= k))
            probed = np.zeros(order.shape, bool)
            probed[row, order[row, rank]] = True
            least = own.floor(x, batch.column(0).to_numpy(zero_copy_only=False), probed, k)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(order[row, rank].astype(np.int32)), pa.array(least[row])], ["id", "v", "part", "least"])

    asked = good(queries).mapInArrow(ask, f"id {id_type}, v array<double>, part int, least double")
    wanted = {r.part: r["count"] for r in asked.groupBy("part").count().collect()}
    # A row a part.
    blocks = F.broadcast(spark.createDataFrame([(p, -(-n // block_rows), -(-wanted.get(p, 1) // block_queries)) for p, n in counted.items()], "part int, blocks int, turns int"))
    dealt = lambda c, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    stored = stored.join(blocks, "part").select("id", "v", "part", dealt("blocks", 1).alias("block"), every("turns").alias("turn"))
    asked = asked.join(blocks, "part").select("id", "v", "least", "part", every("blocks").alias("block"), dealt("turns", 2).alias("turn"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        """The k nearest of one block for each query that probes it, as far as they reach its floor."""
        names = ["query_id", "part", "id", "score"]
        kinds = [left.schema.field("id").type, pa.int32(), right.schema.field("id").type, pa.float64()]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names)
        q, x = (_matrix(t.column("v").combine_chunks()) for t in (left, right))
        who, ids = (t.column("id").to_numpy() for t in (left, right))
        least, part = left.column("least").to_numpy(), left.column("part")[0].as_py()
        out = [(who[:0], ids[:0], np.zeros(0))]
        for a in range(0, len(q), 256):
            # Sums are taken in one order for every pair, so equal vectors tie exactly.
            s = np.einsum("id,jd->ij", q[a : a + 256], x)
            for i, row in enumerate(s, a):
                row[ids == who[i]] = -np.inf
                n = min(k, len(row))
                edge = max(np.partition(row, len(row) - n)[len(row) - n], least[i])
                some = np.flatnonzero((row >= edge) & (row > -np.inf))
                some = some[np.lexsort((ids[some], -row[some]))][:n]
                out.append((np.full(len(some), who[i]), ids[some], row[some]))
        one, two, three = (np.concatenate(c) for c in zip(*out))
        return pa.table([pa.array(one, kinds[0]), pa.array(np.full(len(one), part), kinds[1]), pa.array(two, kinds[2]), pa.array(three, kinds[3])], names)

    near = asked.groupBy("part", "block", "turn").cogroup(stored.groupBy("part", "block", "turn")).applyInArrow(best, f"query_id {id_type}, part int, id {id_type}, score double")
    # The k best of a part's blocks, then of a query's parts.
    top = lambda c: F.slice(F.sort_array(c), 1, k)
    of_part = near.groupBy("query_id", "part").agg(top(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("id")))).alias("best"))
    ranked = of_part.groupBy("query_id").agg(top(F.flatten(F.collect_list("best"))).alias("best"))
    return ranked.select("query_id", F.posexplode("best").alias("r", "b")).select("query_id", (F.col("r") + 1).cast("int").alias("rank"), F.col("b.id").alias(id_col), (-F.col("b.s")).alias("score"))
