"""Near-duplicate groups by an exact Jaccard join over word n-grams.

1. A count sketch of fixed size gives every shingle a document frequency; shingles
   are ordered by it, rare first, and equal sets become one class.
2. A class emits the prefix of its ordered set; sets that are similar enough share a prefix token.
3. A token's place bounds the size of its partners (length and positional filter in one).  Rows are keyed by
   token and size class, the smaller partner under the next size class too, and a key without partners goes.
4. Merging rounds: every class with rows left goes to one home key.  Classes of a key are dealt into blocks of
   bounded size by a hash of the round, all sets of a block are compared, and linked classes are merged.  A round's
   work is linear in its classes.  Later rounds take the classes of keys that have more than REST_ROWS rows outside their
   largest group, and so could give more pairs than a multiple of their rows; from the third on they must halve those pairs.
5. A pair inside a merged group needs no further link.  All pairs left, of different groups, are
   joined on their prefix tokens, pass a suffix filter (sizes of both sets between fixed pivots of the hash space bound
   their difference), and each is verified once on whole sets.  So no link between groups is missed.
   Of a key's groups the largest meets the others only, never itself.

Identity of shingles and sets rests on 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .components import Scratch, bit_map, bits_at, components

#: log2 of the counters of the frequency sketch: 64 a document, at least and at most so many; and the blocks that it is summed in.
LEAST_SKETCH_BITS, MOST_SKETCH_BITS, BLOCKS = 16, 23, 32
#: log2 of the bits of the map that tells which sets are asked for: it grows with their number, up to 16 MB.
LEAST_MAP_BITS, MOST_MAP_BITS = 20, 27
#: Classes, and items of their sets, that one block of a merging round compares with one another.
BLOCK_CLASSES, BLOCK_ITEMS = 128, 2_000_000
#: Rows outside a key's largest group that the last join takes as they are.
REST_ROWS = 16
#: Rows of one key that a task of the last join takes; a larger key is dealt over several.
KEY_ROWS = 5_000
#: Parts that the rows of one class or component are dealt over in the last joins.
PARTS = 32


def _chunk_sets(batch: pa.RecordBatch, column: int, k: int) -> Iterator[list[np.ndarray]]:
    """The sets of the documents of a batch, a chunk at a time."""
    for chunk in K.chunks(batch.column(column)):
        w = K.words(chunk)
        yield list(K.shingles(K.span_hashes(chunk.data, w.starts, w.ends, lower=True), w.first, k))


def _sets(batch: pa.RecordBatch, column: int, k: int) -> Iterator[np.ndarray]:
    for own in _chunk_sets(batch, column, k):
        yield from own


def _class_id(u: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(u.tobytes(), digest_size=8).digest(), "little", signed=True)


def _bucket(u: np.ndarray, bits: int) -> np.ndarray:
    return (u >> np.uint64(64 - bits)).astype(np.int64)


def frequencies(docs: DataFrame, text_col: str, k: int) -> np.ndarray:
    """Document frequencies of shingles by hash bucket, over all documents, on a logarithmic 16-bit scale.

    A task's share of a counter ends at 255; only the order of frequencies is of use, and any order gives the same links.
    """
    bits = min(MOST_SKETCH_BITS, max(LEAST_SKETCH_BITS, (64 * docs.count()).bit_length()))
    width = (1 << bits) // BLOCKS

    @K.tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for own in _chunk_sets(batch, 0, k):
                np.add.at(total, _bucket(np.concatenate(own), bits), 1)
        total = np.minimum(total, 255).astype(np.uint8)
        parts = [zlib.compress(total[i * width : (i + 1) * width].tobytes(), 1) for i in range(BLOCKS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array(parts, pa.binary())], ["block", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width, np.uint64)
        for raw in pdf["counts"]:
            got = zlib.decompress(raw)
            total += np.frombuffer(got, np.uint8 if len(got) == width else np.uint32)
        packed = zlib.compress(np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes(), 1)
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "counts": [packed]})

    own = docs.select(text_col).mapInArrow(count, "block int, counts binary")
    some = own.groupBy("block", (F.spark_partition_id() % 8).alias("part")).applyInPandas(add, "block int, counts binary")
    out = np.zeros(1 << bits, np.uint16)
    for r in some.groupBy("block").applyInPandas(add, "block int, counts binary").toLocalIterator():
        counts = np.frombuffer(zlib.decompress(bytes(r.counts)), np.uint32)
        out[r.block * width : (r.block + 1) * width] = np.minimum(np.log2(1.0 + counts) * 2000, 65535).astype(np.uint16)
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, frequency: np.ndarray) -> DataFrame:
    """(id, n, rid, pivots, prefix) of every document; rid is null for empty sets."""
    shared = docs.sparkSession.sparkContext.broadcast(frequency)  # 2**MOST_SKETCH_BITS counters at most
    bits = len(frequency).bit_length() - 1

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            n, rid, pivots, prefix = [], [], [], []
            for u in _sets(batch, 1, k):
                n.append(len(u))
                if not len(u):
                    rid.append(None), pivots.append(None), prefix.append(None)
                    continue
                rid.append(_class_id(u))
                pivots.append(np.minimum(np.bincount(_bucket(u, 4), minlength=16), 65535).astype(np.uint16).tobytes())
                p = len(u) + (-percent * len(u) // 100) + 1
                key = often[_bucket(u, bits)].astype(np.uint64) << np.uint64(48) | u >> np.uint64(16)
                some = np.argpartition(key, p - 1)[:p] if p < len(u) else np.arange(len(u))
                order = some[np.lexsort((u[some], key[some]))]
                prefix.append(u[order].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(rid, pa.int64()), pa.array(pivots, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))], ["id", "n", "rid", "pivots", "prefix"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(run, f"id {id_type}, n int, rid long, pivots binary, prefix array<long>")


def sets_of(classes: DataFrame, docs: DataFrame, text_col: str, k: int, scratch: Scratch) -> DataFrame:
    """(rid, items) of the classes (rid): their whole sets, each once.

    A broadcast bit map keeps most other sets from being shuffled; a join decides afterwards.
    """
    n = classes.count()
    bits = min(MOST_MAP_BITS, max(LEAST_MAP_BITS, (8 * n).bit_length()))
    asked = bit_map(classes.select(F.shiftrightunsigned(F.xxhash64("rid"), 64 - bits).alias("k")), bits)
    shared = docs.sparkSession.sparkContext.broadcast(asked)  # 2**MOST_MAP_BITS bits at most

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in _chunk_sets(batch, 0, k):
                some = [u for u in own if len(u)]
                rid = np.array([_class_id(u) for u in some], np.int64)
                hit = np.flatnonzero(bits_at(shared.value, _xx_slots(rid, bits)))
                if len(hit):
                    first = hit[np.unique(rid[hit], return_index=True)[1]]
                    yield pa.RecordBatch.from_arrays([pa.array(rid[first]), pa.array([some[i].view(np.int64) for i in first], pa.list_(pa.int64()))], ["rid", "items"])

    found = docs.select(text_col).mapInArrow(run, "rid long, items array<long>").groupBy("rid").agg(F.first("items").alias("items"))
    return scratch.keep(found.join(scratch.small(classes), "rid", "left_semi"))


def _xx_slots(rid: np.ndarray, bits: int) -> np.ndarray:
    """The map's slot of each class, as Spark's xxhash64 of a long with seed 42 gives it."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    rotl = lambda x, r: x << np.uint64(r) | x >> np.uint64(64 - r)
    h = np.full(len(rid), np.uint64(42), np.uint64) + p5 + np.uint64(8)
    h ^= rotl(rid.view(np.uint64) * p2, 31) * p1
    h = rotl(h, 27) * p1 + p4
    h ^= h >> np.uint64(33)
    h *= p2
    h ^= h >> np.uint64(29)
    h *= p3
    h ^= h >> np.uint64(32)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets are similar enough."""
    one = sets.select(F.col("rid").alias("a"), F.col("items").alias("x"))
    two = sets.select(F.col("rid").alias("b"), F.col("items").alias("y"))
    same = F.size(F.array_intersect("x", "y"))
    return one.join(pairs, "a").join(two, "b").where(100 * same >= percent * (F.size("x") + F.size("y") - same)).select("a", "b")


def overlaps(offsets: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets that lie one after another in ``items``."""
    n = len(offsets) - 1
    out = np.zeros((n, n))
    owner = np.repeat(np.arange(n), np.diff(offsets))
    order = np.argsort(items, kind="stable")
    ranked, owner = items[order], owner[order]
    first = np.r_[True, ranked[1:] != ranked[:-1]]
    number = np.cumsum(first) - 1
    # An item of one set only is in no intersection.
    many = np.bincount(number) > 1
    at = np.flatnonzero(many[number])
    number, owner = (np.cumsum(many) - 1)[number[at]], owner[at]
    width = max(1, (1 << 22) // max(1, n))
    for a in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        lo, hi = np.searchsorted(number, (a, a + width))
        has = np.zeros((n, int(number[hi - 1]) - a + 1), np.float32)
        has[owner[lo:hi], number[lo:hi] - a] = 1
        out += has @ has.T
    return out


def block_roots(rid: np.ndarray, offsets: np.ndarray, items: np.ndarray, percent: int) -> np.ndarray:
    """For each set of a block the least class that links of the block lead to."""
    same = overlaps(offsets, items)
    n = np.diff(offsets)
    linked = 100 * same >= percent * (n[:, None] + n[None, :] - same)
    np.fill_diagonal(linked, True)
    root = rid.copy()
    while True:
        least = np.where(linked, root[None, :], np.iinfo(np.int64).max).min(1)
        if (least == root).all():
            return root
        root = least


def _merged(homes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): classes and those that they are linked with, found inside the blocks of ``homes`` (rid, key, block)."""

    def run(own: pa.Table) -> pa.Table:
        rid, items = own.column("rid").to_numpy(), own.column("items").combine_chunks()
        if isinstance(items, pa.ChunkedArray):
            items = pa.concat_arrays(items.chunks)
        offsets = items.offsets.to_numpy().astype(np.int64)
        root = block_roots(rid, offsets - offsets[0], items.flatten().to_numpy(), percent)
        got = np.flatnonzero(root != rid)
        return pa.table([pa.array(rid[got]), pa.array(root[got])], ["u", "v"])

    return sets.join(homes, "rid").select("rid", "items", "key", "block").groupBy("key", "block").applyInArrow(run, "u long, v long")


def _need(n1: Column, n2: Column, percent: int) -> Column:
    """The least intersection of sets of these sizes that are similar enough."""
    return F.ceil(percent * (n1 + n2) / F.lit(100.0 + percent) - 1e-9)


def _filtered(pairs: DataFrame, meta: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that pass the length and the suffix filter."""
    side = lambda x: meta.select(F.col("rid").alias(x), *[F.col(c).alias(c + x) for c in ("n", "pivots")])
    count = lambda c, i: F.conv(F.hex(F.concat(F.substring(c, 2 * i + 2, 1), F.substring(c, 2 * i + 1, 1))), 16, 10).cast("int")
    apart = sum((F.abs(count("pivotsa", i) - count("pivotsb", i)) for i in range(1, 16)), F.abs(count("pivotsa", 0) - count("pivotsb", 0)))
    na, nb = F.col("na"), F.col("nb")
    fits = (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (apart <= na + nb - 2 * _need(na, nb, percent))
    return side("a").join(pairs, "a").join(side("b"), "b").where(fits).select("a", "b")


def prefix_rows(reps: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(key, rid, n, cap, own, c): prefix tokens of classes by token and size class, where a key has two rows that may be partners.

    ``own`` marks the key of the class's own size, where it takes smaller partners; in all its keys a row with
    cap >= n, n being its size, takes larger ones up to ``cap``.  ``c`` is the number of rows of the key.
    """
    # A token at a place leaves n - place items that can be shared, so a partner has ``cap`` items at most.
    cap = F.expr(f"(n - pos) * {100 + percent} div {percent} - n")
    tokens = reps.select("rid", "n", F.posexplode("prefix").alias("pos", "tok")).select("tok", "rid", (F.shiftleft(F.col("n").cast("long"), 32) + cap).alias("at"))
    n, cap = F.shiftright("at", 32), F.col("at") % (1 << 32)
    # Rows without a partner of a size that suits both are dropped by the least size and the largest cap of their token.
    common = scratch.keep(tokens.groupBy("tok").agg(F.count("*").alias("c"), F.min(n).alias("lo"), F.max(cap).alias("hi")).where("c > 1").drop("c"), few=True)
    rows = tokens.join(scratch.small(common), "tok").where((cap >= F.col("lo")) & (n <= F.col("hi"))).select("tok", "rid", n.alias("n"), cap.alias("cap"))
    size_class = lambda c: F.floor(F.log(c.cast("double")) / math.log(100 / percent) + 1e-9).cast("int")
    own, last = size_class(F.col("n")), size_class(F.greatest("cap", "n"))
    rows = rows.select(F.col("tok"), "rid", "n", "cap", own.alias("b0"), F.explode(F.sequence(own, last)).alias("b"))
    rows = scratch.keep(rows.select(F.xxhash64("tok", "b").alias("key"), "rid", F.col("n").cast("int").alias("n"), F.col("cap").cast("int").alias("cap"), (F.col("b") == F.col("b0")).alias("own")), few=True)
    lead = F.col("cap") >= F.col("n")
    keys = scratch.keep(rows.groupBy("key").agg(F.count("*").alias("c"), F.count_if("own").alias("p"), F.count_if(lead).alias("l")).where("p > 0 and l > 0 and c > 1"), few=True)
    some = (lead & (F.col("p") > F.col("own").cast("int"))) | (F.col("own") & (F.col("l") > lead.cast("int")))
    out = scratch.keep(rows.join(scratch.small(keys), "key").where(some).select("key", "rid", "n", "cap", "own", "c"), few=True)
    scratch.drop(common, rows, keys)
    return out


def _open(rows: DataFrame, comps: DataFrame | None, scratch: Scratch) -> tuple[DataFrame, float, float]:
    """Rows of the keys that hold more than one group, with their group and whether it is the key's largest.

    Also the pairs that these keys can still give, and those of keys with more than REST_ROWS rows outside the largest group (``many``).
    """
    rows = rows.select("key", "rid", "n", "cap", "own")
    if comps is None:
        grouped = rows.withColumn("comp", F.col("rid"))
    else:
        grouped = rows.join(scratch.small(comps), "rid", "left").withColumn("comp", F.coalesce("root", "rid")).drop("root")
    grouped = scratch.keep(grouped, few=True)
    of = grouped.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("c"), F.max(F.struct("c", "comp")).alias("most")).where("most.c < c")
    of = scratch.keep(of.select("key", F.col("c").alias("all"), F.col("most.comp").alias("main"), F.col("most.c").alias("held")), few=True)
    some, many = (F.col("all") - F.col("held")) * F.col("all").cast("double"), F.col("all") - F.col("held") > REST_ROWS
    pairs, crowded = of.agg(F.coalesce(F.sum(some), F.lit(0.0)), F.coalesce(F.sum(F.when(many, some)), F.lit(0.0))).first()
    live = scratch.keep(grouped.join(scratch.small(of), "key").select("key", "rid", "n", "cap", "own", "comp", F.col("all").alias("c"), (F.col("comp") == F.col("main")).alias("main"), many.alias("many")), few=True)
    scratch.drop(grouped, of)
    return live, pairs, crowded


def open_pairs(live: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of classes of different groups whose rows allow them, each smaller row joined with larger ones of its key.

    The rows of a large key are dealt over parts by a hash of their class; the rows outside its largest group go to all parts.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col("c") / KEY_ROWS)).cast("int")
    part = F.pmod(F.xxhash64("rid", F.lit(7)), parts).cast("int")
    one = live.select("key", part.alias("part"), *[F.col(c).alias(c + "1") for c in ("rid", "n", "cap", "own", "comp", "main")])
    two = live.where("not main").select("key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), *[F.col(c).alias(c + "2") for c in ("rid", "n", "cap", "own", "comp")])
    # The smaller partner, or of equal ones that of the lesser id, leads; the other is in the key of its own size.
    leads = F.struct("n1", "rid1") < F.struct("n2", "rid2")
    fits = (F.col("comp1") != F.col("comp2")) & (F.col("n1") <= F.col("cap2")) & (F.col("n2") <= F.col("cap1")) & F.when(leads, F.col("own2")).otherwise(F.col("own1"))
    # Two rows outside the largest group meet from both sides.
    once = F.col("main1") | leads
    return one.join(two, ["key", "part"]).where(fits & once).select(F.least("rid1", "rid2").alias("a"), F.greatest("rid1", "rid2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """Groups documents linked by Jaccard similarity of ``percent``/100 or more on distinct k-word shingles.

    A-Z is folded; words are runs without the bytes 0x20 and 0x09-0x0D; fewer than k words count
    as one shingle.  Returns a row for each row of ``docs``: ``id_col``, n_shingles long,
    class_id long (equal sets share it) and component_id, the least id reachable by links,
    null where all of them are null.  Texts that are null, empty or without words have no shingles, a
    null class and their own id.  Repeated rows come back each; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    signed = scratch.keep(signatures(docs, id_col, text_col, k, percent, frequencies(docs, text_col, k)))
    reps = scratch.keep(signed.where("rid is not null").groupBy("rid").agg(F.first("n").alias("n"), F.first("pivots").alias("pivots"), F.first("prefix").alias("prefix")))
    rows = prefix_rows(reps, percent, scratch)
    meta = scratch.keep(reps.join(scratch.small(scratch.keep(rows.select("rid").distinct(), few=True)), "rid", "left_semi").select("rid", "n", "pivots"), few=True)
    scratch.drop(reps)
    sets = sets_of(meta.select("rid"), docs, text_col, k, scratch)
    # A block holds sets of about one size; how many depends on that size too.
    about = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n").cast("double"))))
    held = F.greatest(F.lit(2.0), F.least(F.lit(float(BLOCK_CLASSES)), F.lit(float(BLOCK_ITEMS)) / about))
    comps, edges, turn = None, None, 0
    live, pairs, crowded = _open(rows, None, scratch)
    many = live
    while pairs and not turn or crowded:
        # In the first round the largest key, then one by chance that like sets agree on.
        rank = F.struct("c", "key", "n") if not turn else F.struct(F.xxhash64("key", F.lit(turn)).alias("h"), "key", "c", "n")
        homes = many.groupBy("rid").agg(F.max(rank).alias("x")).select("rid", "x.key", "x.c", "x.n")
        homes = homes.select("rid", "key", F.pmod(F.xxhash64("rid", F.lit(turn)), F.greatest(F.lit(1), F.ceil(F.col("c") / held))).cast("int").alias("block"))
        found = scratch.keep(_merged(scratch.small(scratch.keep(homes, few=True)), sets, percent), few=True)
        edges = found if edges is None else scratch.keep(edges.unionByName(found), few=True)
        comps = scratch.keep(components(edges, scratch).withColumnRenamed("u", "rid"), few=True)
        before, turn = crowded, turn + 1
        # A key of one group stays so; from the second round on only crowded keys are looked at again.
        seen, pairs, crowded = _open(many, comps, scratch)
        if turn == 1:
            live = seen
        many = scratch.keep(seen.where("many").drop("many"), few=True)
        if turn > 1 and 2 * crowded > before:
            break
    if turn > 1:
        live, pairs, _ = _open(live, comps, scratch)
    if pairs:
        found = scratch.keep(open_pairs(live, percent), few=True)
        candidates = scratch.keep(_filtered(scratch.small(found), meta, percent), few=True)
        links = verify(scratch.small(candidates), sets, percent)
        edges = scratch.keep(edges.unionByName(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), few=True)
        comps = scratch.keep(components(edges, scratch).withColumnRenamed("u", "rid"), few=True)
    scratch.drop(sets, meta, rows, live)
    return _least_ids(signed.select("id", "n", "rid"), comps, id_col, scratch)


def _least_ids(all_docs: DataFrame, comps: DataFrame | None, id_col: str, scratch: Scratch) -> DataFrame:
    """The result's columns of all documents; the rows of one class, and the classes of one component, are dealt over PARTS parts."""
    dealt = all_docs.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int"))
    some = dealt.where("rid is not null").groupBy("rid", "part").agg(F.min("id").alias("low"))
    classes = some.groupBy("rid").agg(F.min("low").alias("low"))
    if comps is not None:
        merged = classes.join(scratch.small(comps), "rid")
        merged = scratch.keep(merged.withColumn("at", F.pmod(F.xxhash64("rid"), F.lit(PARTS)).cast("int")), few=True)
        lowest = merged.groupBy("root").agg(F.min("low").alias("all_low")).withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        merged = scratch.keep(merged.join(lowest, ["root", "at"]).select("rid", "all_low"), few=True)
        classes = classes.join(scratch.small(merged), "rid", "left").select("rid", F.coalesce("all_low", "low").alias("low"))
    found = some.select("rid", "part").join(classes, "rid").select("rid", "part", F.col("low").alias("component_id"))
    out = dealt.join(found, ["rid", "part"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.col("rid").alias("class_id"), F.when(F.col("rid").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
