"""Quality rules: a linear-chain conditional random field over the lines of a text.

Every line gets discrete observation features (symbols, case, punctuation, repetition,
separators, digits, word length).  A two-label chain, content or boilerplate, is trained by gradient
ascent (forward-backward) over a bounded sample of labelled documents.  The labels of lines are hidden there; that of
the document is evidence for each, which a line's looks can outweigh.  Viterbi decoding then
marks the lines of every document, and a document is kept when its content lines hold
enough of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K

CONTENT, BOILER = 0, 1
#: Bins of each feature family, by the order of FEATURES.
FEATURES = ("symbols", "upper", "punctuation", "repeated", "separators", "digits", "word_length")
BINS = 8
N_OBS = BINS * len(FEATURES)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b".,;:!?")] = True
_LOUD = np.zeros(256, bool)
_LOUD[list(b"!?")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PIPE = np.zeros(256, bool)
_PIPE[list(b"|<>{}[]=/\\_~")] = True


class Crf(NamedTuple):
    """observation[N_OBS, 2], transition[2, 2], start[2]."""

    observation: np.ndarray
    transition: np.ndarray
    start: np.ndarray


def _prior() -> Crf:
    """Fixed starting weights, also those used where no labelled documents are at hand."""
    obs = np.zeros((N_OBS, 2))
    at = {name: i * BINS for i, name in enumerate(FEATURES)}
    for name, low in (("symbols", 2), ("upper", 4), ("separators", 3), ("repeated", 1), ("punctuation", 4)):
        obs[at[name] + low : at[name] + BINS, BOILER] = 1.5
    obs[at["symbols"], CONTENT] = 0.5
    return Crf(obs, np.array([[0.5, -0.5], [-0.5, 0.5]]), np.array([0.3, -0.3]))


class Stats(NamedTuple):
    """Per document counts, and per line words and features with the documents' line edges."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    line_words: np.ndarray
    line_first: np.ndarray
    features: np.ndarray


def _bin(x: np.ndarray, edges: tuple[float, ...]) -> np.ndarray:
    return np.searchsorted(np.array(edges), x, "right")


def _repeats(hashes: np.ndarray, first: np.ndarray, window: int = 3) -> np.ndarray:
    """Words of each document inside windows that it holds twice or more."""
    n = len(hashes)
    out = np.zeros(len(first) - 1, np.int64)
    if n < window:
        return out
    rolled = hashes[: n - window + 1] * np.uint64(0x9E3779B97F4A7C15)
    for j in range(1, window):
        rolled = K.mix64(rolled + hashes[j : n - window + 1 + j])
    for d, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if b - a <= window:
            continue
        own = rolled[a : b - window + 1]
        order = np.argsort(own)
        ranked = own[order]
        same = ranked[1:] == ranked[:-1]
        if same.any():
            twice = np.zeros(len(own), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            covered = np.zeros(b - a, bool)
            for j in range(window):
                covered[j : j + len(own)] |= twice
            out[d] = int(covered.sum())
    return out


def statistics(chunk: K.Chunk) -> Stats:
    data = chunk.data
    w = K.words(chunk)
    hashes = K.span_hashes(data, w.starts, w.ends)
    ln = K.lines(chunk)
    starts_char = (data & 0xC0) != 0x80
    run = np.zeros(len(data) + 1, np.int64)
    np.cumsum(starts_char & ~K.SPACE[data], out=run[1:])
    n_words = np.diff(w.first)
    word_chars = run[chunk.offsets[1:]] - run[chunk.offsets[:-1]]
    n_symbols = K.per_document(_SYMBOL[data], chunk.offsets)
    line_word = np.searchsorted(w.starts, ln.starts)
    # No word crosses a newline, so the words of a line begin before the next line does.
    line_end_word = np.searchsorted(w.starts, ln.ends)
    line_words = line_end_word - line_word
    line_hash = K.span_hashes(data, ln.starts, ln.ends)
    owner = np.repeat(np.arange(chunk.n), np.diff(ln.first))
    order = np.lexsort((np.arange(len(owner)), line_hash, owner))
    again = np.zeros(len(owner), bool)
    again[order[1:]] = (line_hash[order][1:] == line_hash[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    again &= line_words > 0
    n_dup = np.bincount(owner[again], minlength=chunk.n)

    def share(flags: np.ndarray, of: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(flags[data], out=total[1:], dtype=np.int32)
        return (total[ln.ends] - total[ln.starts]) / np.maximum(of, 1)

    chars = run[ln.ends] - run[ln.starts]
    letters = share(_LETTER, np.ones(len(chars))).astype(np.int64)
    words_or_1 = np.maximum(line_words, 1)
    features = np.stack(
        [
            _bin(share(_SYMBOL, words_or_1), (0.01, 0.1, 0.3, 0.6, 1.0, 2.0, 3.5)),
            _bin(share(_UPPER, np.maximum(letters, 1)), (0.01, 0.08, 0.2, 0.35, 0.5, 0.7, 0.9)),
            _bin(share(_LOUD, words_or_1), (0.01, 0.1, 0.3, 0.6, 1.0, 1.5, 2.5)),
            np.where(again, 1, 0),
            _bin(share(_PIPE, words_or_1), (0.01, 0.1, 0.3, 0.6, 1.0, 1.5, 2.5)),
            _bin(share(_DIGIT, np.maximum(chars, 1)), (0.01, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8)),
            _bin(chars / words_or_1, (1.5, 2.5, 3.5, 5, 7, 9, 12)),
        ],
        1,
    )
    features += np.arange(len(FEATURES)) * BINS
    return Stats(n_words, word_chars, n_symbols, n_dup, _repeats(hashes, w.first), line_words, ln.first, features)


def viterbi(crf: Crf, features: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Best labels of the lines of documents; all documents advance together. Ties go to content."""
    score = crf.observation[features].sum(1)
    n_lines, back = np.diff(first), np.zeros((len(features), 2), np.int8)
    order = np.argsort(-n_lines, kind="stable")
    heads, sizes = first[:-1][order], n_lines[order]
    best = score[heads] + crf.start if len(heads) else np.zeros((0, 2))
    ends = best.copy()
    for t in range(1, int(sizes[0]) if len(sizes) else 0):
        k = int(np.searchsorted(-sizes, -t, "left"))  # documents with more than t lines
        reach = best[:k, :, None] + crf.transition[None]
        pick = reach.argmax(1)
        best = np.take_along_axis(reach, pick[:, None], 1)[:, 0] + score[heads[:k] + t]
        back[heads[:k] + t] = pick
        ends[:k] = best
    labels = np.zeros(len(features), np.int8)
    now = ends.argmax(1).astype(np.int8)
    for t in range(int(sizes[0]) - 1 if len(sizes) else -1, -1, -1):
        k = int(np.searchsorted(-sizes, -t, "left"))
        at = heads[:k] + t
        labels[at] = now[:k]
        now[:k] = back[at, now[:k]]
    return labels


def _expected(crf: Crf, score: np.ndarray, sizes: np.ndarray, first: np.ndarray, live: list[int], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of all lines, and the weighted expectation of label pairs, of chains of falling length by forward-backward."""
    alpha, beta = np.zeros((len(score), 2)), np.zeros((len(score), 2))
    heads, n = first[:-1], int(sizes[0])
    alpha[heads] = score[heads] + crf.start
    for t in range(1, n):
        at = heads[: live[t]] + t
        alpha[at] = np.logaddexp.reduce(alpha[at - 1][:, :, None] + crf.transition, 1) + score[at]
    for t in range(n - 2, -1, -1):
        at = heads[: live[t + 1]] + t
        beta[at] = np.logaddexp.reduce(crf.transition[None] + (score[at + 1] + beta[at + 1])[:, None, :], 2)
    z = np.repeat(np.logaddexp.reduce(alpha[first[1:] - 1], 1), sizes)
    marginal = np.exp(alpha + beta - z[:, None])
    inner = np.ones(len(score), bool)
    inner[heads] = False
    inner = np.flatnonzero(inner)
    pairs = np.exp(alpha[inner - 1][:, :, None] + crf.transition + (score[inner] + beta[inner])[:, None, :] - z[inner][:, None, None])
    return marginal, (pairs * weight[inner][:, None, None]).sum(0)


def train(sequences: list[np.ndarray], labels: list[int], steps: int = 80, rate: float = 0.15, l2: float = 1e-3, evidence: float = 2.0) -> Crf:
    """Learns from texts whose lines have hidden labels, of which the text's label is evidence.

    Maximises the penalised log of sum over line labels of their probability times exp(``evidence`` times the number of lines
    whose label is the text's).  Its gradient is the difference of two expectations, with and without the evidence, so a line that looks
    like the other class can take its label, and the chain learns from changes of label within texts.  Adam takes the steps.
    """
    prior = _prior()
    if len(set(labels)) < 2:
        return prior
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    sizes = np.array([len(sequences[i]) for i in order])
    y = np.array([labels[i] for i in order])
    flat = np.concatenate([sequences[i] for i in order])
    first = np.concatenate([[0], np.cumsum(sizes)])
    # Clean documents outnumber the others; a wrongly rejected one costs more.
    weight = np.where(y == BOILER, 0.2 / max(1, (y == BOILER).sum()), 0.8 / max(1, (y == CONTENT).sum())) / np.sqrt(sizes)
    line_y, line_w = np.repeat(y, sizes), np.repeat(weight, sizes)
    theta = np.concatenate([x.ravel() for x in prior])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    live = [int(np.searchsorted(-sizes, -t, "left")) for t in range(int(sizes[0]))]
    lean = evidence * np.eye(2)[line_y]
    heads = first[:-1]
    for step in range(1, steps + 1):
        crf = Crf(theta[: 2 * N_OBS].reshape(N_OBS, 2), theta[2 * N_OBS : -2].reshape(2, 2), theta[-2:])
        score = crf.observation[flat].sum(1)
        free, free_pairs = _expected(crf, score, sizes, first, live, line_w)
        held, held_pairs = _expected(crf, score + lean, sizes, first, live, line_w)
        gap = (held - free) * line_w[:, None]
        g_obs = np.zeros((N_OBS, 2))
        for f in range(flat.shape[1]):
            for c in (0, 1):
                g_obs[:, c] += np.bincount(flat[:, f], gap[:, c], N_OBS)
        g = np.concatenate([g_obs.ravel(), (held_pairs - free_pairs).ravel(), gap[heads].sum(0)]) - l2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Crf(theta[: 2 * N_OBS].reshape(N_OBS, 2), theta[2 * N_OBS : -2].reshape(2, 2), theta[-2:])


#: Lines of a chain in training; a longer text is several chains, one after another.
CHAIN_LINES = 512


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_per_class: int = 600) -> Crf:
    """Trains on at most ``sample_per_class`` labelled documents of each class, chosen by a hash of their id.

    All their lines enter the sample, those of a long text in chains of CHAIN_LINES.  Rows with null
    ids, labels or texts take no part; with fewer than two classes the fixed prior weights are returned.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)")
    ids = [x for y in (0, 1) for x in known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample_per_class).collect()]
    if len({x._y for x in ids}) < 2:
        return _prior()
    label = {x._id: x._y for x in ids}
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_id").isin(list(label)) & F.col("_text").isNotNull())

    @K.tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who = batch.column(0)
            for chunk in K.chunks(batch.column(1)):
                s = statistics(chunk)
                out = []
                for a, b in zip(s.line_first[:-1], s.line_first[1:]):
                    out.append(s.features[a:b].astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays([who.slice(chunk.first, chunk.n), pa.array(out, pa.binary())], ["_id", "f"])

    got = sorted((r._id, bytes(r.f)) for r in texts.mapInArrow(rows, f"_id {docs.schema[id_col].dataType.simpleString()}, f binary").toLocalIterator())
    chains, own = [], []
    for i, raw in got:
        lines = np.frombuffer(raw, np.uint8).reshape(-1, len(FEATURES))
        for a in range(0, len(lines), CHAIN_LINES):
            chains.append(lines[a : a + CHAIN_LINES].astype(np.int64))
            own.append(int(label[i] == 0))
    return train(chains, own)


def quality(docs: DataFrame, crf: Crf, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, max_repeat_percent: int = 50, min_content: float = 0.5) -> DataFrame:
    """Counts and verdict of every whole text.

    Returns all columns of ``docs`` and n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words (long), base_failed, content_share (double) and kept, replacing columns of
    those names.  ``kept`` is false where the base rules fail, else whether content lines
    hold at least ``min_content`` of the words.  Null texts count as empty, and fail.
    """
    new = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"
    names = [x.split()[0] for x in new.split(", ")]
    old = [c for c in docs.columns if c not in names]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[F.col(f"`{c}`") for c in old]).schema) + ", " + new
    where = old.index(text_col)

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in K.chunks(batch.column(where)):
                s = statistics(c)
                failed = (s.n_words < min_words) | (100 * s.n_repeat_words > max_repeat_percent * s.n_words)
                label = viterbi(crf, s.features, s.line_first)
                content = K.per_document(np.where(label == CONTENT, s.line_words, 0), s.line_first)
                share = content / np.maximum(s.n_words, 1)
                made = [s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words]
                arrays = [batch.column(i).slice(c.first, c.n) for i in range(len(old))]
                arrays += [pa.array(x.astype(np.int64)) for x in made] + [pa.array(failed), pa.array(share), pa.array(~failed & (share >= min_content))]
                yield pa.RecordBatch.from_arrays(arrays, [*old, *names])

    return docs.select(*[F.col(f"`{c}`") for c in old]).mapInArrow(run, schema)
