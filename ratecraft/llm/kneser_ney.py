"""Quality by perplexity under an interpolated modified Kneser-Ney character model.

Counts come from all trusted text.  Every distinct n-gram of the corpus gets its
probability by joins, order by order, of n-gram counts with context totals.  The
joined table is cut into shards of bounded size; documents are scored against one shard at
a time and the partial sums added.  Documents whose perplexity is above a quantile of
the trusted documents of their language are rejected.  The perplexities of that quantile are held
out: trusted documents fall into folds by a hash of their id, and each is scored by the model of the other folds.

An n-gram packs five symbols of 12 bits each into a long.  White space is one blank; a character below
U+0700 is one symbol, any other one two symbols, the high and the low part of its number, which no other character has.
So every text is coded without loss, whatever its script.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .components import SMALL, Scratch, bit_map, bits_at

WIDTH = 12
#: Characters below this one are one symbol; symbols of high and low parts of the others begin here and after them.
DIRECT, HIGH_PARTS = 0x700, 0x440
#: Folds of the trusted documents; a fold's code takes three bits beside an n-gram of 60.
FOLDS = 5
#: N-grams of one shard: about 100 MB in each Python worker at most.
SHARD_ROWS = 6_000_000
#: log2 of the bits of the map of trusted ids.
MAP_BITS = 24


def symbols(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of code points, and the number of symbols before each of them and after the last."""
    points = np.where((points >= 9) & (points <= 13), 32, points)
    high = points >= DIRECT
    before = np.zeros(len(points) + 1, np.int64)
    np.cumsum(1 + high, out=before[1:])
    if not high.any():
        return points, before
    out = np.empty(int(before[-1]), np.int64)
    out[before[:-1]] = np.where(high, DIRECT + (points >> 10), points)
    out[before[:-1][high] + 1] = DIRECT + HIGH_PARTS + (points[high] & 1023)
    return out, before


def packed(chunk: K.Chunk, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that begins at each symbol, and the offsets of documents in symbols."""
    points = np.frombuffer(chunk.data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    coded, before = symbols(points)
    lead = np.zeros(len(chunk.data) + 1, np.int64)
    np.cumsum((chunk.data & 0xC0) != 0x80, out=lead[1:])
    m = max(0, len(coded) - order + 1)
    out = np.zeros(m, np.int64)
    for j in range(order):
        out |= coded[j : m + j] << WIDTH * (order - 1 - j)
    return out, before[lead[chunk.offsets]]


def _starts(at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of n-grams of each document, and the flat places of all of them; ``at`` counts symbols."""
    n = np.maximum(np.diff(at) - order + 1, 0)
    first = np.repeat(at[:-1] - (np.cumsum(n) - n), n)
    return n, first + np.arange(int(n.sum()))


class _Counter:
    """Sums of two counts by key, merged when many have come together."""

    def __init__(self, most: int = 3_000_000) -> None:
        self.keys, self.counts, self.size, self.most = [], [], 0, most

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if self.size > self.most:
            k, c = self.total()
            self.keys, self.counts, self.size, self.most = [k], [c], len(k), max(self.most, 2 * len(k))

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        self.keys, self.counts = [], []
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return keys[first], np.add.reduceat(counts[order], first)


def count_ngrams(docs: DataFrame, order: int) -> DataFrame:
    """(g, m0, m1 ...): every n-gram of ``_text`` with its count in trusted rows, and in those outside each fold.

    ``_fold`` is 0 for rows that aren't trusted, else the number of the fold.
    """
    own = [f"c{f}" for f in range(1, FOLDS + 1)]

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter()
        for batch in batches:
            folds = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for chunk in K.chunks(batch.column(0)):
                grams, at = packed(chunk, order)
                n, place = _starts(at, order)
                if not len(place):
                    continue
                key = grams[place]
                del grams, place
                key <<= 3
                key |= np.repeat(folds[chunk.first : chunk.first + chunk.n], n)
                key.sort()
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                counter.add(key[first], np.diff(np.r_[first, len(key)]))
        keys, counts = counter.total()
        edge = np.flatnonzero(np.r_[True, keys[1:] >> 3 != keys[:-1] >> 3]) if len(keys) else np.zeros(0, np.int64)
        edge = np.r_[edge, len(keys)]
        for a in range(0, len(edge) - 1, 100_000):
            ends = edge[a : a + 100_001]
            some, c = keys[ends[0] : ends[-1]], counts[ends[0] : ends[-1]]
            # Column 0 takes what no trusted text has, and is not given on.
            out = np.zeros((FOLDS + 1, len(ends) - 1), np.int64)
            out[some & 7, np.repeat(np.arange(len(ends) - 1), np.diff(ends))] = c
            yield pa.RecordBatch.from_arrays([pa.array(keys[ends[:-1]] >> 3), *[pa.array(x) for x in out[1:]]], ["g", *own])

    sums = docs.select("_text", "_fold").mapInArrow(run, "g long, " + ", ".join(f"{c} long" for c in own)).groupBy("g").agg(*[F.sum(c).alias(c) for c in own])
    total = sum((F.col(c) for c in own[1:]), F.col(own[0]))
    return sums.select("g", total.alias("m0"), *[(total - F.col(c)).alias(f"m{f}") for f, c in enumerate(own, 1)])


def _bucket() -> Column:
    """The place of an id in the bit map of trusted ids."""
    return F.shiftrightunsigned(F.xxhash64("id"), 64 - MAP_BITS).alias("bucket")


def _hits(ids: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose last column, a bucket, is in the map; that column goes."""
    for batch in batches:
        hit = pa.array(bits_at(ids.value, batch.column(batch.num_columns - 1).to_numpy()))
        yield pa.RecordBatch.from_arrays([c.filter(hit) for c in batch.columns[:-1]], batch.schema.names[:-1])


def _likely(docs: DataFrame, ids: Broadcast, id_type: str) -> DataFrame:
    """(id, _text) of the documents whose id's hash is that of a known one, so that few other texts are shuffled.

    The map has 2**MAP_BITS bits at any input size; a join decides afterwards.
    """
    return docs.where("id is not null").select("id", "_text", _bucket()).mapInArrow(lambda batches: _hits(ids, batches), f"id {id_type}, _text string")


def discounts(counts: DataFrame) -> list[tuple[float, float, float]]:
    """D1, D2 and D3+ of each model from the numbers of n-grams counted once to four times."""
    r = counts.agg(*[F.count(F.when(F.col(f"m{m}") == i, 1)).alias(f"n{m}_{i}") for m in range(FOLDS + 1) for i in range(1, 5)]).first()
    out = []
    for m in range(FOLDS + 1):
        n = [max(x, 0) for x in r[4 * m : 4 * m + 4]]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        d = [i + 1 - (i + 2) * y * n[i + 1] / n[i] if n[i] else (i + 1) * 0.5 for i in range(3)]
        out.append(tuple(min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)))
    return out


def probabilities(grams: DataFrame, order: int, scratch: Scratch) -> DataFrame:
    """(g, p0, p1 ..., m0, m1 ...) of every n-gram of ``grams`` (g, m0, m1 ...), by each model; lower orders count distinct continuations."""
    models = range(FOLDS + 1)
    levels = [grams]
    for n in range(order - 1, 0, -1):
        mask = (1 << WIDTH * n) - 1
        levels.append(scratch.keep(levels[-1].groupBy(F.col("g").bitwiseAND(F.lit(mask)).alias("g")).agg(*[F.sum((F.col(f"m{m}") > 0).cast("long")).alias(f"m{m}") for m in models])))
    below = None
    for n, level in zip(range(1, order + 1), reversed(levels)):
        cut = []
        for m, (d1, d2, d3) in enumerate(discounts(level)):
            c = F.col(f"m{m}")
            cut.append(F.when(c == 0, 0.0).when(c == 1, d1).when(c == 2, d2).otherwise(d3))
        context = F.shiftright("g", WIDTH).alias("context") if n > 1 else F.lit(0).cast("long").alias("context")
        total = level.where("m0 > 0").groupBy(context).agg(*[F.sum(f"m{m}").alias(f"total{m}") for m in models], *[F.sum(cut[m]).alias(f"spare{m}") for m in models])
        own = level.withColumn("context", context).join(total, "context", "left")
        if below is not None:
            own = own.withColumn("tail", F.col("g").bitwiseAND(F.lit((1 << WIDTH * (n - 1)) - 1))).join(below.select(F.col("g").alias("tail"), *[F.col(f"p{m}").alias(f"lower{m}") for m in models]), "tail")
        p = []
        for m in models:
            lower = F.lit(1.0 / (1 << WIDTH)) if below is None else F.col(f"lower{m}")
            seen = F.coalesce(F.col(f"total{m}"), F.lit(0))
            p.append(F.when(seen == 0, lower).otherwise((F.greatest(F.col(f"m{m}") - cut[m], F.lit(0.0)) + F.col(f"spare{m}") * lower) / seen).alias(f"p{m}"))
        last = below
        below = scratch.keep(own.select("g", *p, *([f"m{m}" for m in models] if n == order else [])))
        scratch.drop(level, *([] if last is None else [last]))
    return below


class Table:
    """From n-gram to value: keys in the order of their hash and where each hash's begin, asked in whole arrays.

    About 16 to 20 bytes a key, with one key for each hash on average.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys))))))
        slot = self._slot(keys)
        order = np.argsort(slot, kind="stable")
        self.keys, self.values = keys[order], values[order].astype(np.float32)
        self.starts = np.zeros((1 << self.bits) + 1, np.uint32)
        np.cumsum(np.bincount(slot, minlength=1 << self.bits), out=self.starts[1:])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, 0 for keys that the table doesn't have."""
        slot = self._slot(keys)
        at, end = self.starts[slot].astype(np.int64), self.starts[slot + 1]
        del slot
        out = np.zeros(len(keys), np.float32)
        left = np.flatnonzero(at < end)
        at, end = at[left], end[left]
        while len(left):
            hit = self.keys[at] == keys[left]
            out[left[hit]] = self.values[at[hit]]
            at += 1
            go = ~hit & (at < end)
            left, at, end = left[go], at[go], end[go]
        return out


def _sums(docs: DataFrame, shared: Broadcast, order: int, id_type: str, ids: Broadcast | None) -> DataFrame:
    """(id, lang, k, n, s): number of n-grams and sum of log-probabilities that this shard has under the model ``_fold``.

    With ``ids``, a bit map, only of the documents in it.
    """
    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches if ids is None else _hits(ids, batches):
            folds = batch.column(4).to_numpy(zero_copy_only=False).astype(np.int64) << 60
            for chunk in K.chunks(batch.column(3)):
                grams, at = packed(chunk, order)
                n, place = _starts(at, order)
                asked = grams[place]
                del grams, place
                asked |= np.repeat(folds[chunk.first : chunk.first + chunk.n], n)
                total = np.zeros(len(asked) + 1)
                np.cumsum(own.get(asked), out=total[1:], dtype=np.float64)
                end = np.cumsum(n)
                cut = [batch.column(i).slice(chunk.first, chunk.n) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*cut, pa.array(n.astype(np.int64)), pa.array(total[end] - total[end - n])], ["id", "lang", "k", "n", "s"])

    if ids is not None:
        docs = docs.where("id is not null")
    return docs.select("id", "lang", F.xxhash64("_text").alias("k"), "_text", "_fold", *([] if ids is None else [_bucket()])).mapInArrow(run, f"id {id_type}, lang string, k long, n long, s double")


def _perplexities(docs: DataFrame, logs: DataFrame, order: int, id_type: str, shard_rows: int, scratch: Scratch, ids: Broadcast | None = None) -> DataFrame:
    """(id, lang, n, perplexity) of each document by the model ``_fold``; ``logs`` (g, logp) has the model's number above an n-gram.

    A shard is on the driver and the executors alone: its sums are written before the next one is taken.
    """
    shards = max(1, -(-logs.count() // shard_rows))
    parts = []
    for i in range(shards):
        some = logs.where(F.pmod(F.xxhash64("g"), F.lit(shards)) == i).toArrow()
        table = docs.sparkSession.sparkContext.broadcast(Table(some.column(0).to_numpy(), some.column(1).to_numpy().astype(np.float32)))  # SHARD_ROWS n-grams at most
        del some
        parts.append(_sums(docs, table, order, id_type, ids))
        if shards > 1:
            parts[-1] = scratch.keep(parts[-1])
            table.destroy()
    sums = parts[0]
    if shards > 1:
        # Equal rows meet in one group; each stands for as many documents as a shard has of it.
        sums = reduce(DataFrame.unionByName, parts).groupBy("id", "lang", "k", "n").agg((F.sum("s") / F.count("*") * shards).alias("s"), (F.count("*") / shards).cast("int").alias("copies"))
        sums = sums.withColumn("copies", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies")
    out = scratch.keep(sums.select("id", "lang", "n", F.when(F.col("n") > 0, F.exp(-F.col("s") / F.col("n"))).alias("perplexity")))
    if shards > 1:
        scratch.drop(*parts)
    return out


def perplexity_filter(
    docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = 5, quantile: float = 0.995, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """Perplexity of every whole text, and whether it is at most its language's threshold.

    ``trusted`` holds the ids of trusted documents in ``id_col``; their texts train the model.  The ``quantile`` of each
    language is taken of all its trusted documents' perplexities by models of the other folds, so no document has a part in the
    counts that its own perplexity for the threshold comes from; the column perplexity is that of the whole model.  The quantile
    is percentile_approx's with an accuracy of 20,000: its rank is off by a twenty thousandth of the texts at most.  Returns
    ``id_col``, lang, n_ngrams, perplexity, threshold and kept.  Only a language without any trusted text of
    ``order`` symbols takes the threshold of all trusted texts, and everything is kept where there are none.
    Null languages form one of their own.  Texts shorter than ``order`` symbols, null ones included, have no
    perplexity and are kept.  Repeated rows come back each; null ids are never trusted.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("_text"))
    known = trusted.select(F.col(id_col).alias("id")).where("id is not null").distinct().withColumn("_known", F.lit(True))
    ids = spark.sparkContext.broadcast(bit_map(known.select(_bucket()), MAP_BITS))
    of_id = (F.pmod(F.xxhash64("id"), F.lit(FOLDS)) + 1).cast("int").alias("_fold")
    marked = _likely(own, ids, id_type).join(known, "id", "left_semi").select("_text", of_id).unionByName(own.select("_text", F.lit(0).alias("_fold")))
    grams = scratch.keep(count_ngrams(marked, order))
    every = probabilities(grams, order, scratch)
    found = scratch.keep(every.select("g", F.log("p0").alias("l0"), *[F.when(F.col("m0") > F.col(f"m{f}"), F.log(f"p{f}")).cast("float").alias(f"l{f}") for f in range(1, FOLDS + 1)]))
    scratch.drop(every)
    # An n-gram that a fold's own texts don't have is never asked of the model without that fold.
    each = F.explode(F.array(*[F.struct(F.col("g").bitwiseOR(F.lit(f << 60)).alias("g"), F.col(f"l{f}").alias("logp")) for f in range(1, FOLDS + 1)])).alias("x")
    out_of_fold = _perplexities(own.withColumn("_fold", of_id), found.select(each).select("x.*").where("logp is not null"), order, id_type, shard_rows, scratch, ids)
    base = scratch.keep(out_of_fold.where("perplexity is not null").join(known, "id").select("perplexity", F.coalesce("lang", F.lit("")).alias("key")))
    level = F.percentile_approx("perplexity", quantile, 20_000)
    by_lang = scratch.keep(base.groupBy("key").agg(level.alias("own")))
    overall = base.agg(level.alias("q")).first().q
    scratch.drop(out_of_fold, base)
    scored = _perplexities(own.withColumn("_fold", F.lit(0)), found.select("g", F.col("l0").alias("logp")), order, id_type, shard_rows, scratch)
    scratch.drop(found)
    # A row a language: few, and counted before they are broadcast. More than that are dealt over parts with the documents.
    scored = scored.withColumn("key", F.coalesce("lang", F.lit("")))
    if by_lang.count() <= SMALL:
        out = scored.join(F.broadcast(by_lang), "key", "left")
    else:
        parts = 32
        spread = by_lang.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        out = scored.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).join(spread, ["key", "part"], "left")
    threshold = F.coalesce("own", F.lit(overall).cast("double"))
    return out.select(F.col("id").alias(id_col), "lang", F.col("n").alias("n_ngrams"), "perplexity", threshold.alias("threshold"), F.coalesce(F.col("perplexity") <= threshold, F.lit(True)).alias("kept"))
