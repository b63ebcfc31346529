"""Language identification with error-correcting output codes.

Each language has a codeword; one binary classifier over character n-grams predicts
each bit.  A text goes to the codeword of least weighted logistic loss against the
classifiers' margins, each bit weighted by how well its classifier does on
its training sample, and is flagged as ambiguous when the runner-up is close.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .chargrams import codepoints, grams

UNKNOWN = "und"
ORDERS = (1, 2, 3)


class Model(NamedTuple):
    """weights[2**bits, n_bits], bias[n_bits], code[n_languages, n_bits] of -1 and 1, bit_weight[n_bits]."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    code: np.ndarray
    bit_weight: np.ndarray
    bits: int


def codewords(k: int, most: int = 31) -> np.ndarray:
    """Codewords of k languages: all distinct splits for few, else random ones of the largest least distance found."""
    if k <= 1:
        return np.ones((k, 1))
    if (1 << (k - 1)) - 1 <= most:
        split = np.arange(1, 1 << (k - 1))
        return np.array([np.ones(len(split)), *[1 - 2.0 * (split >> i & 1) for i in range(k - 1)]])
    rng, best, found = np.random.default_rng(7), -1.0, None
    for _ in range(400):
        c = rng.integers(0, 2, (k, most)) * 2.0 - 1
        if (np.abs(c.sum(0)) == k).any():
            continue
        gap = (most - c @ c.T) / 2
        if (least := float(gap[~np.eye(k, dtype=bool)].min())) > best:
            best, found = least, c
    return found


def _letters(points: np.ndarray) -> np.ndarray:
    """Whether each code point is a letter."""
    out = (points >= 97) & (points <= 122)
    for p in np.unique(points[points >= 128]).tolist():
        if chr(p).isalpha():
            out |= points == p
    return out


def histogram(points: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of damped n-gram counts over letters and single blanks, and whether a document has letters."""
    n = len(at) - 1
    letter = _letters(points)
    first = np.zeros(len(points) + 1, bool)
    first[at] = True
    blank_before = np.ones(len(points), bool)
    blank_before[1:] = ~letter[:-1]
    keep = letter | ~blank_before | first[:-1]
    kept = np.zeros(len(points) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    text = np.where(letter, points, 32)[keep].astype(np.uint32)
    edges = kept[at]
    owner = np.repeat(np.arange(n), np.diff(edges))
    out = np.zeros(n << bits, np.float32)
    for k in ORDERS:
        h = grams(text, k, bits)
        inside = owner[: len(h)] == owner[k - 1 :]
        out += np.bincount((owner[: len(h)][inside] << bits) + h[inside], minlength=n << bits).astype(np.float32)
    out = np.log1p(out.reshape(n, 1 << bits))
    norm = np.sqrt((out * out).sum(1))
    total = np.zeros(len(points) + 1, np.int64)
    np.cumsum(letter, out=total[1:])
    return out / np.maximum(norm, 1e-9)[:, None], total[at[1:]] > total[at[:-1]]


def learn(x: np.ndarray, names: list[str], bits: int, steps: int = 120, rate: float = 0.3, l2: float = 1e-6) -> Model:
    """Trains a classifier for each bit on unit rows."""
    languages = sorted(set(names))
    k = len(languages)
    code = codewords(k)
    if k < 2:
        return Model(languages, np.zeros((1 << bits, code.shape[1]), np.float32), np.zeros(code.shape[1]), code, np.ones(code.shape[1]), bits)
    of = np.array([languages.index(n) for n in names])
    share = 1 / np.bincount(of, minlength=k)[of]
    y = (code[of] > 0).astype(np.float32)
    share = (share / share.sum()).astype(np.float32)[:, None]
    # All bits' classifiers take their steps together, by full-batch Adam.
    w = np.zeros(((1 << bits) + 1, code.shape[1]), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = x @ w[:-1] + w[-1]
        gap = share * (1 / (1 + np.exp(-np.clip(z, -80, 80))) - y)
        g = np.vstack([x.T @ gap + np.float32(l2) * w[:-1], gap.sum(0)])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= np.float32(rate) * (m / np.float32(1 - 0.9**step)) / (np.sqrt(v / np.float32(1 - 0.999**step)) + np.float32(1e-8))
    right = (((x @ w[:-1] + w[-1] > 0) == (y > 0)) * share).sum(0)
    good = np.maximum(1e-3, 2 * right - 1).astype(float)
    return Model(languages, w[:-1].copy(), w[-1].astype(float), code, good / good.sum(), bits)


#: Steps of the scale that hashes of ids are counted on, for each halving of the range.
STEPS = 8


def _levels(n_levels: int = 64 * STEPS) -> list[int]:
    """Bounds below which a hash of 63 bits lies at each level, falling by a fixed ratio."""
    return [int(2**63 * 2 ** (-k / STEPS)) for k in range(n_levels)]


def sample_bounds(known: DataFrame, id_col: str, lang_col: str, most: int) -> dict[str, int]:
    """For each language the bound on a hash of ids that about ``most`` rows or a tenth more lie below, from one aggregation."""
    h = F.shiftrightunsigned(F.xxhash64(id_col), 1)
    level = F.least(F.lit(64 * STEPS - 1), F.floor(-F.log2((h + 1).cast("double") / 2.0**63) * STEPS)).cast("int")
    counted: dict[str, dict[int, int]] = {}
    for r in known.groupBy(F.col(lang_col).alias("lang"), level.alias("level")).count().toLocalIterator():
        counted.setdefault(r.lang, {})[r.level] = r["count"]
    out, bounds = {}, _levels()
    for lang, by in counted.items():
        # Levels from the smallest hashes on, until enough rows lie below.
        n, at = 0, 0
        for at in sorted(by, reverse=True):
            n += by[at]
            if n >= most:
                break
        # A level holds hashes of its bound's range; rounding may put one beside it, hence the margin.
        out[lang] = min(2**63 - 1, bounds[at] + (bounds[at] >> 40) + 1) if n >= most else 2**63 - 1
    return out


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bits: int = 12, sample_per_language: int = 400, sample_rows: int = 16_000) -> Model:
    """Trains on at most ``sample_per_language`` whole texts of each language, those of the least hashes of their id.

    With very many languages each has ``sample_rows`` divided by their number, but 4 at least.  Rows with null text or language, and
    texts without letters, take no part.  Give only rows that may be learnt from.  Two passes: one counts hashes by language, one
    makes the features of rows below each language's bound.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    bounds = sample_bounds(known, id_col, lang_col, sample_per_language)
    if not bounds:
        return learn(np.zeros((0, 1 << bits), np.float32), [], bits)
    most = max(4, min(sample_per_language, sample_rows // len(bounds)))
    if most < sample_per_language:
        bounds = sample_bounds(known, id_col, lang_col, most)
    spark = docs.sparkSession

    @K.tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in K.chunks(batch.column(2), 1 << 18):
                points, at = codepoints(chunk)
                for a in range(0, chunk.n, 256):
                    b = min(a + 256, chunk.n)
                    x, has = histogram(points[at[a] : at[b]], at[a : b + 1] - at[a], bits)
                    good = pa.array(np.flatnonzero(has))
                    own = [np.flatnonzero(r) for r in x]
                    places = pa.array([o.astype(np.uint16).tobytes() for o in own], pa.binary())
                    values = pa.array([r[o].astype(np.float16).tobytes() for r, o in zip(x, own)], pa.binary())
                    cut = [batch.column(i).slice(chunk.first + a, b - a).take(good) for i in range(2)]
                    yield pa.RecordBatch.from_arrays([*cut, places.take(good), values.take(good)], ["_h", "_lang", "at", "f"])

    # A row a language; counted above, so it is known to be small.
    below = F.broadcast(spark.createDataFrame(list(bounds.items()), "_lang string, _below long"))
    near = known.select(F.shiftrightunsigned(F.xxhash64(id_col), 1).alias("_h"), F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("_text")).join(below, "_lang").where("_h < _below")
    got = sorted(((r._lang, r._h, bytes(r["at"]), bytes(r.f)) for r in near.select("_h", "_lang", "_text").mapInArrow(rows, "_h long, _lang string, at binary, f binary").toLocalIterator()))
    x, names = np.zeros((len(got), 1 << bits), np.float32), []
    taken: dict[str, int] = {}
    for lang, _, at, f in got:
        if taken.setdefault(lang, 0) < most:
            x[len(names), np.frombuffer(at, np.uint16)] = np.frombuffer(f, np.float16)
            names.append(lang)
            taken[lang] += 1
    return learn(x[: len(names)], names, bits)


def decode(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest codeword of each row, its score, and the runner-up's; ties go to the first language."""
    margin = x @ model.weights + model.bias
    loss = np.logaddexp(0, -margin[:, None, :] * model.code[None]) @ model.bit_weight
    gap = loss - loss.min(1, keepdims=True)
    p = np.exp(-4 * gap)
    p /= p.sum(1, keepdims=True)
    best = loss.argmin(1)
    rows = np.arange(len(x))
    top = p[rows, best]
    p[rows, best] = -1
    return best, top, np.maximum(p.max(1), 0)


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", ambiguous_below: float = 0.2) -> DataFrame:
    """Predicts the language of every whole text: ``id_col``, lang_pred, score double, ambiguous boolean.

    Null texts, texts without letters, and all texts when no language is known get ``und``
    with score 0, flagged as ambiguous.  Repeated rows are predicted each; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits rows of at most 31 weights

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            who = batch.column(0)
            for chunk in K.chunks(batch.column(1), 1 << 18):
                points, at = codepoints(chunk)
                parts = []
                # Rows of histograms are dense, so few documents at a time.
                for a in range(0, chunk.n, 256):
                    b = min(a + 256, chunk.n)
                    x, has = histogram(points[at[a] : at[b]], at[a : b + 1] - at[a], m.bits)
                    if not m.languages:
                        parts.append((np.zeros(b - a, np.int64), np.zeros(b - a), np.zeros(b - a), np.zeros(b - a, bool)))
                    else:
                        parts.append((*decode(m, x), has))
                best, top, second, has = (np.concatenate(p) for p in zip(*parts))
                names = [m.languages[i] if h else UNKNOWN for i, h in zip(best.tolist(), has.tolist())]
                doubt = ~has | (top - second < ambiguous_below)
                yield pa.RecordBatch.from_arrays([who.slice(chunk.first, chunk.n), pa.array(names, pa.string()), pa.array(np.where(has, top, 0.0)), pa.array(doubt)], [id_col, "lang_pred", "score", "ambiguous"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean")
