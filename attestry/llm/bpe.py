"""Byte-level BPE of a whole corpus with a public vocabulary (problem 6).

A pre-token is a run of bytes; its live byte positions form a linked list and a
segment tree over the positions holds, at its root, the leftmost pair of lowest
merge rank. A merge rewrites at most three leaves and their paths to the root.
Many pre-tokens of about the same length are merged side by side in NumPy, one
merge of each a round; very long ones are merged alone. A worker keeps the ids of
pre-tokens it has met, in a bounded cache.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the public vocabulary files lie unless a caller names another place.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

#: Fixed value: the pre-tokenizer pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_NONE = np.iinfo(np.int64).max
_ALONE = 2048  # pre-tokens of more bytes are merged one by one
_CACHED = 400_000  # pre-tokens a worker remembers


def _byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}
    return [letters[b] for b in range(256)]


class ByteBpe:
    """Encoder for one vocabulary file (``model.vocab`` and ``model.merges``)."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.byte_ids = np.array([vocab[c] for c in _byte_alphabet()], dtype=np.int64)
        self.base = max(vocab.values()) + 1
        pairs = np.array([vocab[a] * self.base + vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pair_keys, self.pair_ranks = pairs[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.find = regex.compile(PATTERN).findall
        self.known: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.known.clear()
        self.ids, self.starts, self.filled = np.zeros(1 << 16, np.int32), [0], 0

    @functools.cache  # noqa: B019 - one encoder lives as long as its worker
    def _pairs(self) -> dict[int, int]:
        return dict(zip(self.pair_keys.tolist(), self.pair_ranks.tolist(), strict=True))

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def _merge_many(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """Ids of pieces of at most ``width`` bytes, a power of two."""
        n = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        token = self.byte_ids[flat]
        place = np.arange(width)
        after = np.tile(place + 1, (n, 1))
        before = np.tile(place - 1, (n, 1))
        inside = place[None, :] < (lengths - 1)[:, None]
        tree = np.full((n, 2 * width), _NONE, np.int64)
        rank = self._ranks(token[:, :-1][inside[:, :-1]], token[:, 1:][inside[:, :-1]])
        leaves = np.full(len(rank), _NONE, np.int64)
        rows, cols = np.nonzero(inside[:, :-1])
        leaves[rank >= 0] = rank[rank >= 0] * width + cols[rank >= 0]
        tree[rows, width + cols] = leaves
        for node in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
        live = np.arange(n)
        alive = place[None, :] < lengths[:, None]
        while True:
            best = tree[live, 1]
            more = best != _NONE
            live, best = live[more], best[more]
            if not len(live):
                break
            at, rank = best % width, best // width
            gone = after[live, at]
            nxt = after[live, gone]
            prev = before[live, at]
            token[live, at] = self.merged[rank]
            after[live, at] = nxt
            alive[live, gone] = False
            end = lengths[live]
            has_next, has_prev = nxt < end, prev >= 0
            before[live[has_next], nxt[has_next]] = at[has_next]
            tree[live, width + gone] = _NONE
            for has, left, right in ((has_next, at, nxt), (has_prev, prev, at)):
                row, le = live[has], left[has]
                r = self._ranks(token[row, le], token[row, right[has]])
                tree[row, width + le] = np.where(r >= 0, r * width + le, _NONE)
            tree[live[~has_next], width + at[~has_next]] = _NONE
            row3 = np.concatenate([live, live, live[has_prev]])
            node = np.concatenate([at, gone, prev[has_prev]]) + width
            while node[0] > 1:
                node = node >> 1
                tree[row3, node] = np.minimum(tree[row3, 2 * node], tree[row3, 2 * node + 1])
        return [token[i, :width][alive[i]] for i in range(n)]

    def _merge_one(self, piece: bytes) -> np.ndarray:
        """The same for a single long piece, with plain lists."""
        n = len(piece)
        width = 1 << max(1, (n - 1).bit_length())
        start = self.byte_ids[np.frombuffer(piece, np.uint8)]
        ranks = self._ranks(start[:-1], start[1:])
        tree = [_NONE] * (2 * width)
        tree[width : width + n - 1] = [r * width + i if r >= 0 else _NONE for i, r in enumerate(ranks.tolist())]
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        token, after, before = start.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = self._pairs()

        def put(at: int, value: int) -> None:
            node = width + at
            tree[node] = value
            while node > 1:
                node >>= 1
                low = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == low:
                    break
                tree[node] = low

        def pair(left: int, right: int) -> int:
            r = pairs.get(token[left] * self.base + token[right], -1)
            return r * width + left if r >= 0 else _NONE

        while tree[1] != _NONE:
            at, rank = tree[1] % width, tree[1] // width
            gone = after[at]
            nxt, prev = after[gone], before[at]
            token[at], token[gone], after[at] = int(self.merged[rank]), -1, nxt
            put(gone, _NONE)
            if nxt < n:
                before[nxt] = at
                put(at, pair(at, nxt))
            else:
                put(at, _NONE)
            if prev >= 0:
                put(prev, pair(prev, at))
        return np.array([t for t in token if t >= 0], np.int64)

    def _learn(self, pieces: list[str]) -> None:
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            raw = p.encode("utf-8", "surrogatepass")
            by_width.setdefault(1 << max(1, (len(raw) - 1).bit_length()), []).append((p, raw))
        for width, group in by_width.items():
            step = max(1, (1 << 19) // width)
            for i in range(0, len(group), step):
                part = group[i : i + step]
                if width > _ALONE:
                    done = [self._merge_one(raw) for _, raw in part]
                else:
                    done = self._merge_many([raw for _, raw in part], width)
                for (p, _), ids in zip(part, done, strict=True):
                    end = self.filled + len(ids)
                    if end > len(self.ids):
                        self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.int32)])
                    self.ids[self.filled : end] = ids
                    self.filled = end
                    self.known[p] = len(self.starts) - 1
                    self.starts.append(end)

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array and the offsets of the texts in it.

        Null and empty texts have no ids. No special token is ever produced.
        """
        if len(self.known) > _CACHED:
            self._reset()
        split = [self.find(t) if t else [] for t in texts]
        new = set().union(*split).difference(self.known) if split else set()
        if new:
            self._learn(sorted(new))
        known = self.known
        piece = np.fromiter((known[p] for words in split for p in words), np.int64)
        starts = np.array(self.starts, np.int64)
        sizes = (starts[1:] - starts[:-1])[piece]
        total = np.concatenate([[0], np.cumsum(sizes)])
        source = np.repeat(starts[:-1][piece] - total[:-1], sizes) + np.arange(total[-1])
        words = np.concatenate([[0], np.cumsum([len(w) for w in split])]).astype(np.int64)
        return self.ids[source], total[words]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0].tolist()


_encoders: dict[str, ByteBpe] = {}


def encoder(path: str) -> ByteBpe:
    """The worker's encoder for a vocabulary file, loaded once."""
    if path not in _encoders:
        _encoders[path] = ByteBpe(path)
    return _encoders[path]


def _slices(texts: list[str | None], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of a batch with about ``most`` characters, so that long texts come alone."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > most:
            yield start, i
            start, size = i, 0
        size += len(t or "")
    yield start, len(texts)


def token_ids(documents: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id") -> DataFrame:
    """``<id_col>, ids ARRAY<INT>``: the ids of each row's ``text``, one row for each row.

    Null and empty texts get an empty array. Special-token strings in a text are
    ordinary text. Only the two columns needed are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in _slices(texts):
                ids, ends = bpe.encode_batch(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(id_col).slice(a, b - a), lists], [id_col, "ids"])

    schema = T.StructType([documents.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return documents.select(id_col, "text").mapInArrow(run, schema)


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """All columns but ``text``, and ``n_tokens BIGINT``, the number of ids of ``text``."""

    @F.pandas_udf(T.LongType())
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = encoder(vocabulary)
        for texts in parts:
            texts = [t if isinstance(t, str) else None for t in texts]
            ends = [bpe.encode_batch(texts[a:b])[1] for a, b in _slices(texts)]
            yield pd.Series(np.concatenate([np.diff(e) for e in ends]) if ends else np.zeros(0, np.int64))

    return documents.withColumn("n_tokens", count("text")).drop("text")
