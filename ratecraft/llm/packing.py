"""Cost-balanced packing of tokenised documents into training sequences.

A window of documents is packed at a time, so memory is bounded and no shuffle is
needed.  Within a window the attention cost of a piece of n tokens is estimated as
``linear * n + quadratic * n**2``.  Documents that fill sequences alone are cut into
whole sequences; what remains is taken in descending order of cost and assigned to the
open sequence of lowest cost that still has room.  A piece that no sequence can
hold whole is cut into the room that is left.  The last, partly filled sequences of
a task are divided at powers of two, which need no padding.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import textkernel as K
from .bpe import encoder, text_batches

#: Sequence ids of one task begin at its partition number times this.
TASK_STRIDE = 1 << 40


def assign(lengths: list[int], n_sequences: int, capacity: int, linear: float, quadratic: float) -> list[list[tuple[int, int, int]]]:
    """Deals pieces to n sequences; returns for each its (piece, start, length) in order.

    The sum of lengths must not exceed n_sequences * capacity.  Ties go to the earlier
    piece and to the sequence of smaller number.
    """
    sequences: list[list[tuple[int, int, int]]] = [[] for _ in range(n_sequences)]
    room = [capacity] * n_sequences
    heap = [(0.0, k) for k in range(n_sequences)]
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    cut: list[int] = []
    for i in order:
        n, aside = lengths[i], []
        if not n:
            continue
        while heap and room[heap[0][1]] < n:
            aside.append(heapq.heappop(heap))
        if heap:
            cost, k = heapq.heappop(heap)
            sequences[k].append((i, 0, n))
            room[k] -= n
            if room[k]:
                heapq.heappush(heap, (cost + linear * n + quadratic * n * n, k))
        else:
            cut.append(i)
        # Lengths only fall, so a sequence without room now may have it for a later piece.
        for x in aside:
            heapq.heappush(heap, x)
    for i in cut:
        start = 0
        while start < lengths[i]:
            # The widest room first: fewest cuts.
            k = max(range(n_sequences), key=lambda k: (room[k], -k))
            n = min(room[k], lengths[i] - start)
            sequences[k].append((i, start, n))
            room[k] -= n
            start += n
    return sequences


def _halves(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """Divides a partly filled sequence into ones whose lengths are powers of two."""
    left = sum(n for _, _, n in pieces)
    todo = list(reversed(pieces))
    while left:
        size = 1 << (left.bit_length() - 1)
        left -= size
        out = []
        while size:
            i, start, n = todo.pop()
            take = min(n, size)
            out.append((i, start, take))
            if take < n:
                todo.append((i, start + take, n - take))
            size -= take
        yield out


def pack(
    docs: DataFrame,
    vocabulary_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 4096,
    eos_id: int = 2,
    window_sequences: int = 128,
    linear: float = 1.0,
    quadratic: float = 1.0 / 4096,
    with_ids: bool = True,
) -> DataFrame:
    """Packs every document's tokens and an end token into sequences of ``capacity`` tokens.

    Returns a row for each piece: ``id_col``, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and ``ids`` array<int> if asked for.  A null or empty text is
    its end token alone.  Repeated rows and null ids are packed as documents of their
    own; other columns are not read.  No tokens are dropped or repeated.  A window
    holds about ``window_sequences * capacity`` tokens, and one document more.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    arrow_id = to_arrow_type(docs.schema[id_col].dataType)
    end = np.array([eos_id], "<u4").tobytes()

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary_path, decoded=False)
        at = TaskContext.get().partitionId() * TASK_STRIDE
        waiting: list[tuple[object, bytes, int]] = []  # id, ids, tokens already given out
        size = 0

        def window(last: bool) -> pa.RecordBatch:
            """Packs what waits into whole sequences; unless it is the last, the rest goes on waiting."""
            nonlocal at, waiting, size
            left = [len(raw) // 4 - gone for _, raw, gone in waiting]
            whole = [n // capacity for n in left]
            sequences = [[(i, k * capacity, capacity)] for i, w in enumerate(whole) for k in range(w)]
            rest = [n - w * capacity for n, w in zip(left, whole)]
            full = sum(rest) // capacity
            keep: list[tuple[object, bytes, int]] = []
            if not last:
                # The latest documents wait, as much as doesn't fill a sequence.
                spare = sum(rest) - full * capacity
                for i in range(len(rest) - 1, -1, -1):
                    if not spare:
                        break
                    take = min(spare, rest[i])
                    spare -= take
                    rest[i] -= take
                    if take:
                        keep.append((*waiting[i][:2], waiting[i][2] + whole[i] * capacity + rest[i]))
                keep.reverse()
            n_open = full if not last else -(-sum(rest) // capacity)
            for got in assign(rest, n_open, capacity, linear, quadratic):
                got = [(i, whole[i] * capacity + start, n) for i, start, n in got]
                sequences += [got] if sum(n for _, _, n in got) == capacity else list(_halves(got))
            columns: list[list] = [[] for _ in names]
            for s in sequences:
                offset = 0
                for i, start, n in s:
                    who, raw, gone = waiting[i]
                    part = raw[4 * (gone + start) : 4 * (gone + start + n)]
                    for c, x in zip(columns, (who, gone + start, n, zlib.crc32(part), len(raw) // 4, at, offset)):
                        c.append(x)
                    if with_ids:
                        columns[7].append(np.frombuffer(part, "<u4").astype(np.int32))
                    offset += n
                at += 1
            waiting, size = keep, sum(len(raw) // 4 - gone for _, raw, gone in keep)
            kinds = [arrow_id, *[pa.int64()] * 6, *[pa.list_(pa.int32())] * with_ids]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            who = batch.column(0).to_pylist()
            for start, some in text_batches([t or "" for t in batch.column(1).to_pylist()]):
                split = [own.split(t) for t in some]
                own.prepare(split)
                for k, ws in enumerate(split):
                    raw = own.encode_split(ws) + end
                    waiting.append((who[start + k], raw, 0))
                    size += len(raw) // 4
                if size >= window_sequences * capacity:
                    yield window(False)
        if waiting:
            yield window(True)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
