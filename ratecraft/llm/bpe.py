"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

Each word is a leaf array of symbols.  The tree holds, for every adjacent pair, the
key ``rank * 2**32 + position`` (or the largest integer where the pair has no merge);
its root is therefore the leftmost pair of the lowest rank.  A merge rewrites three
leaves at most and repairs their paths to the root, and the word is done when the
root holds no pair.  Words are encoded side by side: the trees of all words of a
size class form one matrix, and every step advances each unfinished word by one merge.

White space always separates pieces, so a text is cut at it and each distinct
word is encoded once for as long as a bounded memo holds it.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K

_NONE = np.int64(2**63 - 1)
#: Words, and pieces, that a generation of a memo holds. About 300 bytes each.
MEMO_WORDS = 300_000
#: White space of Unicode, as the tokenizer file's pattern ``\s`` has it.
_WHITE = re.compile("[\t-\r \x85\xa0  -     　]+")
#: Characters that Python counts as white space and the pattern doesn't.
_ODD_SPACE = re.compile("[\x1c-\x1f]")


def _byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """A tokenizer file of BPE with word ends: NFC, lower case, white space dropped."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.suffix = model["end_of_word_suffix"]
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.letters = _byte_letters()
        pairs = [(p if isinstance(p, list) else p.split(" ")) for p in model["merges"]]
        left = np.array([self.ids[a] for a, _ in pairs], np.int64)
        right = np.array([self.ids[b] for _, b in pairs], np.int64)
        made = np.array([self.ids[a + b] for a, b in pairs], np.int64)
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int64), made[order]
        self.size = 1 + max(max(self.ids.values()), max(self.special.values(), default=0))
        self.token = [""] * self.size
        for text, i in [*self.ids.items(), *self.special.items()]:
            self.token[i] = text
        self.first = np.array([self.ids[x] for x in self.letters], np.int64)
        self.last = np.array([self.ids[x + self.suffix] for x in self.letters], np.int64)
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index into ranks and made of each pair, -1 where it has no merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def pieces(self, word: str) -> list[str]:
        """Lower-case pieces of a word without white space; special tokens stay as they are."""
        low = word.lower()
        if word.isascii() or ("Σ" not in word and unicodedata.is_normalized("NFC", word)):
            if low.isalpha():
                return [low]
            if low[-1:] in (",", ".") and low[:-1].isalpha():
                return [low[:-1], low[-1]]
        out = []
        for part in self.split_special.split(word) if self.split_special and "<|" in word else [word]:
            if part in self.special:
                out.append(part)
            elif part:
                # A letter's lower case does not depend on its neighbours here.
                out += self.pattern.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
        return out


def merge_pieces(v: Vocabulary, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Applies all merges to non-empty pieces; returns their ids one after another, and the edges."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    edges = np.zeros(len(pieces) + 1, np.int64)
    np.cumsum(lengths, out=edges[1:])
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    sym = v.first[raw]
    last = edges[1:] - 1
    sym[last] = v.last[raw[last]]
    depth = np.zeros(len(pieces), np.int64)
    longer = lengths > 2
    depth[longer] = np.ceil(np.log2(lengths[longer] - 1)).astype(np.int64)
    out, sizes, order = [], [], []
    ranked = np.argsort(depth, kind="stable")
    cut = np.searchsorted(depth[ranked], np.arange(depth.max(initial=0) + 2))
    for d in range(len(cut) - 1):
        step = max(1, (1 << 19) >> d)
        for a in range(cut[d], cut[d + 1], step):
            some = ranked[a : min(a + step, cut[d + 1])]
            ids, n = _merge_class(v, sym, edges[some], lengths[some], d)
            out.append(ids)
            sizes.append(n)
            order.append(some)
    if not out:
        return np.zeros(0, np.int64), edges
    place, size = np.concatenate(order), np.concatenate(sizes)
    counts = np.empty(len(pieces), np.int64)
    counts[place] = size
    made = np.zeros(len(pieces) + 1, np.int64)
    np.cumsum(counts, out=made[1:])
    flat = np.concatenate(out)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(made[:-1][place], size)
    ids = np.empty(len(flat), np.int64)
    ids[at] = flat
    return ids, made


def _merge_class(v: Vocabulary, symbols: np.ndarray, begin: np.ndarray, lengths: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Merges of pieces with at most 2**depth pairs, one tree a row; leaves stand at 2**depth onward."""
    n, leaves = len(begin), 1 << depth
    width = leaves + 1
    inside = np.arange(width) < lengths[:, None]
    sym = np.where(inside, symbols[np.minimum(begin[:, None] + np.arange(width), len(symbols) - 1)], -1)
    place = np.broadcast_to(np.arange(width), (n, width))
    after = np.where(place + 1 < lengths[:, None], place + 1, -1)
    before = np.where(inside, place - 1, -1)
    tree = np.full((n, 2 * leaves), _NONE, np.int64)
    has = inside[:, 1:]
    found = np.full((n, leaves), -1, np.int64)
    found[has] = v.pair(sym[:, :-1][has], sym[:, 1:][has])
    tree[:, leaves:] = np.where(found >= 0, v.ranks[found] << 32 | np.arange(leaves), _NONE)
    for level in range(depth - 1, -1, -1):
        lo, hi = 1 << level, 2 << level
        tree[:, lo:hi] = np.minimum(tree[:, 2 * lo : 2 * hi : 2], tree[:, 2 * lo + 1 : 2 * hi : 2])
    live = np.flatnonzero(tree[:, 1] != _NONE)

    def put(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        node = leaf + leaves
        tree[rows, node] = value
        while node[0] > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def keyed(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The tree's key of the pair that begins at a place."""
        nxt = after[rows, at]
        hit = np.where(nxt >= 0, v.pair(sym[rows, at], sym[rows, np.maximum(nxt, 0)]), -1)
        return np.where(hit >= 0, v.ranks[hit] << 32 | at, _NONE)

    while len(live):
        at = tree[live, 1] & 0xFFFFFFFF
        gone = after[live, at]
        hit = v.pair(sym[live, at], sym[live, gone])
        sym[live, at] = v.made[hit]
        sym[live, gone] = -1
        nxt = after[live, gone]
        after[live, at] = nxt
        some = nxt >= 0
        before[live[some], nxt[some]] = at[some]
        inner = gone < leaves
        if inner.any():
            put(live[inner], gone[inner], np.full(int(inner.sum()), _NONE))
        put(live, at, keyed(live, at))
        prior = before[live, at]
        some = prior >= 0
        if some.any():
            put(live[some], prior[some], keyed(live[some], prior[some]))
        live = live[tree[live, 1] != _NONE]
    kept = sym >= 0
    return sym[kept], kept.sum(1)


class Memo:
    """Two generations of a dictionary: what is used again outlives the turn to a new one."""

    def __init__(self, most: int) -> None:
        self.most, self.young, self.old = most, {}, {}

    def missing(self, keys: set) -> set:
        """Keys in neither generation; the others are in the young one afterwards."""
        if len(self.young) + len(keys) > self.most:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        left = {k for k in keys if k not in young}
        if old:
            again = {k for k in left if k in old}
            young.update((k, old[k]) for k in again)
            left -= again
        return left


class Encoder:
    """Encodes texts word by word; memos of words and of pieces bound its memory."""

    def __init__(self, vocabulary: Vocabulary, memo_words: int = MEMO_WORDS, decoded: bool = True) -> None:
        self.v, self.decoded = vocabulary, decoded
        self.words, self.parts = Memo(memo_words), Memo(memo_words)

    def learn(self, words: list[str]) -> None:
        """Puts the ids, as bytes, and the decoded text of these words into the memo."""
        v = self.v
        pieces_of, special = v.pieces, v.special
        split = [pieces_of(w) for w in words]
        new = self.parts.missing({p for own in split for p in own})
        parts = self.parts.young
        for p in new & special.keys():
            raw = np.array([special[p]], "<u4").tobytes()
            parts[p] = (raw, p) if self.decoded else raw
            new.discard(p)
        pieces = list(new)
        if pieces:
            ids, edges = merge_pieces(v, [p.encode("utf-8", "surrogatepass") for p in pieces])
            raw, at, token = ids.astype("<u4").tobytes(), edges.tolist(), v.token
            if self.decoded:
                text = [token[i] for i in ids.tolist()]
                for p, a, b in zip(pieces, at, at[1:]):
                    parts[p] = (raw[4 * a : 4 * b], " ".join(text[a:b]))
            else:
                for p, a, b in zip(pieces, at, at[1:]):
                    parts[p] = raw[4 * a : 4 * b]
        young = self.words.young
        for w, own in zip(words, split):
            if len(own) == 1:
                young[w] = parts[own[0]]
            elif not self.decoded:
                young[w] = b"".join([parts[p] for p in own])
            else:
                got = [parts[p] for p in own]
                young[w] = (b"".join([x[0] for x in got]), " ".join([x[1] for x in got]))

    def split(self, text: str) -> list[str]:
        return text.split() if not _ODD_SPACE.search(text) else [x for x in _WHITE.split(text) if x]

    def prepare(self, split: list[list[str]]) -> None:
        """Makes sure that the memo holds every word of these texts."""
        new: set[str] = set()
        for ws in split:
            new.update(ws)
        new = self.words.missing(new)
        if new:
            self.learn(list(new))

    def encode_split(self, ws: list[str]) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, after prepare()."""
        young = self.words.young
        return b"".join([young[w][0] for w in ws] if self.decoded else map(young.__getitem__, ws))

    def decode_split(self, ws: list[str]) -> str:
        """What the ids of encode_split() decode to."""
        young = self.words.young
        return " ".join([x for w in ws if (x := young[w][1])])

    def encode(self, text: str) -> list[int]:
        ws = self.split(text)
        self.prepare([ws])
        return np.frombuffer(self.encode_split(ws), "<u4").tolist()


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, decoded: bool = True) -> Encoder:
    """The encoder of this process for a tokenizer file, kept between tasks."""
    if (path, decoded) not in _encoders:
        _encoders[path, decoded] = Encoder(Vocabulary(path), decoded=decoded)
    return _encoders[path, decoded]


def decode(vocabulary: Vocabulary, ids: list[int]) -> str:
    """Tokens joined by spaces, as a tokenizer without a decoder gives them; special tokens stay."""
    return " ".join([vocabulary.token[i] for i in ids])


def text_batches(texts: list[str], target: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """(start, texts) runs of about ``target`` characters."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= target:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def bpe_encode(docs: DataFrame, vocabulary_path: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, with_text: bool = True) -> DataFrame:
    """Encodes and decodes every whole text.

    Returns ``id_col``, n_tokens long, ids_sha256, decoded_sha256 and, if asked for, ``ids``
    array<int> and ``decoded`` string.  Null and empty texts have no tokens and decode to "".
    Repeated rows give repeated rows; a null id stays null; other columns are not read.
    ``vocabulary_path`` is opened on the executors.
    """
    extra = ", ids array<int>" * with_ids + ", decoded string" * with_text
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}"

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for start, some in text_batches(texts):
                split = [own.split(t) for t in some]
                own.prepare(split)
                n, sha, dec, ids, plain = [], [], [], [], []
                for ws in split:
                    raw, text = own.encode_split(ws), own.decode_split(ws)
                    n.append(len(raw) // 4)
                    sha.append(hashlib.sha256(raw).hexdigest())
                    dec.append(hashlib.sha256(text.encode()).hexdigest())
                    if with_ids:
                        ids.append(np.frombuffer(raw, "<u4").astype(np.int32))
                    if with_text:
                        plain.append(text)
                columns = [batch.column(0).slice(start, len(some)), pa.array(n, pa.int64()), pa.array(sha), pa.array(dec)]
                columns += [pa.array(ids, pa.list_(pa.int32()))] * with_ids + [pa.array(plain, pa.string())] * with_text
                yield pa.RecordBatch.from_arrays(columns, [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids, *["decoded"] * with_text])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
