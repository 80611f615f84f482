"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary.

A text is cut by the vocabulary's pattern and each match (a piece) is encoded separately.  A piece that is a vocabulary
entry is that entry.  All other distinct pieces of a slice are encoded together in numpy (if there are but a few of a
size, one by one in plain numbers): each has a segment tree over its byte positions whose leaves hold the rank of the pair that starts there and whose nodes hold the leftmost minimum.
The root names the next merge; a merge unlinks the right part and updates the leaves of the merged part and of its
nearest live neighbour on the left, each in a logarithmic number of steps, so a piece of n bytes takes O(n log n).

Encoded words are kept from slice to slice in a cache of bounded size.  A null is an empty text, which has no tokens.
Every input row gives one row, repeated rows too.  Only doc_id and text are read.  Empty tables give empty results.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.words import map_texts

#: Chunks in a generation of what a worker keeps encoded.
CACHE_PIECES = 80_000
#: Byte positions of the trees that are worked on at once.
TREE_CELLS = 1 << 15
#: Pieces of one size class that are worked on one by one if there are no more.
FEW = 24
_NONE = np.int64(2**62)


class Codec:
    """The ranks of a vocabulary file, and what is derived from them."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        keys, values = [], []
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                left, right = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.values = np.array(keys, np.int64)[order], np.array(values, np.int64)[order]
        # an open hash table of the pairs: the probe sequence of a pair is a run of neighbours
        self.size = 1 << max(4, int(4 * len(self.keys)).bit_length())
        self.table_keys, self.table_values = np.full(self.size, -1, np.int64), np.full(self.size, _NONE)
        left = np.arange(len(self.keys))
        at = self._home(self.keys)
        while len(left):
            free = self.table_keys[at] == -1
            slots, first = np.unique(at[free], return_index=True)
            put = left[free][first]
            self.table_keys[slots], self.table_values[slots] = self.keys[put], self.values[put]
            rest = self.table_keys[at] != self.keys[left]
            left, at = left[rest], (at[rest] + 1) & (self.size - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(65 - self.size.bit_length())).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids when joined; a very large number if there is none."""
        keys = left << 32 | right
        at = self._home(keys)
        found = self.table_keys[at]
        out = np.where(found == keys, self.table_values[at], _NONE)
        more = np.flatnonzero((found != keys) & (found != -1))
        while len(more):
            at[more] = (at[more] + 1) & (self.size - 1)
            found = self.table_keys[at[more]]
            same = found == keys[more]
            out[more[same]] = self.table_values[at[more[same]]]
            more = more[~same & (found != -1)]
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each piece, as the reference algorithm gives them."""
        out: list[tuple[int, ...]] = [()] * len(pieces)
        classes: dict[int, list[int]] = {}
        for i, rank in enumerate(map(self.ranks.get, pieces)):
            if rank is not None:
                out[i] = (rank,)
            elif size := len(pieces[i]):
                depth = (size - 1).bit_length() or 1
                if depth in classes:
                    classes[depth].append(i)
                else:
                    classes[depth] = [i]
        for depth, members in classes.items():
            step = max(1, TREE_CELLS >> depth)
            for k in range(0, len(members), step):
                part = members[k : k + step]
                if len(part) < FEW:  # a call of numpy for each level and merge costs more than it saves
                    found = [self._merge_alone(pieces[i], depth) for i in part]
                else:
                    found = self._merge([pieces[i] for i in part], depth)
                for i, ids in zip(part, found, strict=True):
                    out[i] = ids
        return out

    @cached_property
    def names(self) -> dict[int, str]:
        """The ids in decimal."""
        return {i: str(i) for i in self.bytes_of}

    def _merge_alone(self, piece: bytes, depth: int) -> tuple[int, ...]:
        """The same tree for one piece, in plain numbers: what a merge changes is followed upwards as far as it changes anything."""
        n, width, none, token, ranks = len(piece), 1 << depth, int(_NONE), self.bytes_of, self.ranks
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * width)
        for k in range(n - 1):
            r = ranks.get(piece[k : k + 2])
            if r is not None:
                tree[width + k] = r * width + k
        for node in range(width - 1, 0, -1):
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a < b else b

        def update(at: int, value: int) -> None:
            node = width + at
            while node and tree[node] != value:
                tree[node] = value
                other = tree[node ^ 1]
                value = value if value < other else other
                node >>= 1

        while tree[1] != none:
            at, merged = tree[1] & (width - 1), tree[1] >> depth
            right = after[at]
            follow = after[right]
            ids[at], ids[right], after[at] = merged, -1, follow
            update(right, none)
            r = None
            if follow < n:
                before[follow] = at
                r = ranks.get(token[merged] + token[ids[follow]])
            update(at, none if r is None else r * width + at)
            if (prev := before[at]) >= 0:
                r = ranks.get(token[ids[prev]] + token[merged])
                update(prev, none if r is None else r * width + prev)
        return tuple([i for i in ids if i >= 0])

    def _merge(self, pieces: list[bytes], depth: int) -> list[tuple[int, ...]]:
        rows, width = len(pieces), 1 << depth
        sizes = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(rows, width)
        ids = self.byte_ids[raw]
        place = np.arange(width)
        live = place < sizes[:, None]
        ids[~live] = -1
        after = np.tile(place + 1, (rows, 1))  # the next live position; at the end, the size
        before = np.tile(place - 1, (rows, 1))
        tree = np.full((rows, 2 * width), _NONE)
        both = live[:, :-1] & live[:, 1:]
        ranks = np.full((rows, width), _NONE)
        ranks[:, :-1][both] = self.pair_ranks(ids[:, :-1][both], ids[:, 1:][both])
        # a leaf is rank * width + position: the least is the leftmost of the lowest rank
        tree[:, width:] = np.where(ranks == _NONE, _NONE, ranks * width + place)
        for level in range(depth - 1, -1, -1):
            a, b = 1 << level, 2 << level
            tree[:, a:b] = np.minimum(tree[:, b : 2 * b : 2], tree[:, b + 1 : 2 * b : 2])
        flat, fids, fafter, fbefore = tree.reshape(-1), ids.reshape(-1), after.reshape(-1), before.reshape(-1)

        def update(row: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            node = row * (2 * width) + width + at
            flat[node] = value
            inside = width + at
            base = row * (2 * width)
            for _ in range(depth):
                inside = inside >> 1
                child = base + 2 * inside
                flat[base + inside] = np.minimum(flat[child], flat[child + 1])

        active = np.flatnonzero(flat[1 :: 2 * width] != _NONE)
        while len(active):
            top = flat[active * (2 * width) + 1]
            at = top & (width - 1)
            cell = active * width + at
            right = fafter[cell]
            gone = active * width + right
            fids[cell] = top >> depth
            fids[gone] = -1
            nxt = fafter[gone]
            fafter[cell] = nxt
            inner = nxt < sizes[active]
            fbefore[(active * width + nxt)[inner]] = at[inner]
            update(active, right, np.full(len(active), _NONE))
            value = np.full(len(active), _NONE)
            rank = self.pair_ranks(fids[cell[inner]], fids[(active * width + nxt)[inner]])
            value[inner] = np.where(rank == _NONE, _NONE, rank * width + at[inner])
            update(active, at, value)
            prev = fbefore[cell]
            has = prev >= 0
            if has.any():
                row, prev, cell = active[has], prev[has], cell[has]
                rank = self.pair_ranks(fids[row * width + prev], fids[cell])
                update(row, prev, np.where(rank == _NONE, _NONE, rank * width + prev))
            active = active[flat[active * (2 * width) + 1] != _NONE]
        keep = ids >= 0
        flat_ids, bounds = ids[keep].tolist(), np.concatenate([[0], np.cumsum(keep.sum(1))]).tolist()
        return [tuple(flat_ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def encode(self, text: str, pattern: str = public_tokenizers.PATTERN) -> list[int]:
        pieces = [p.encode() for p in regex.findall(pattern, text)]
        return list(chain.from_iterable(self.encode_pieces(pieces)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


class _Memory:
    """What a worker has encoded: chunk -> (ids in decimal, decoded bytes), in two generations.

    When the younger is full it becomes the older one, and entries that are met again move back; so frequent chunks stay
    and the size is bounded.
    """

    def __init__(self):
        self.young: dict[str, tuple[str, bytes]] = {}
        self.old: dict[str, tuple[str, bytes]] = {}

    def missing(self, chunks: set[str]) -> list[str]:
        new = chunks.difference(self.young)
        if len(self.young) + len(new) > CACHE_PIECES and self.young:
            self.old, self.young = self.young, {}
            new = chunks
        known = new.intersection(self.old)
        self.young.update((c, self.old[c]) for c in known)
        return list(new.difference(known) if known else new)


_MEMORIES: dict[str, _Memory] = {}


def _chunks(text: str | None, plain: bool) -> list[str]:
    """A text cut before each single space between two characters that aren't white space, if ``plain``.

    The pattern always starts a piece at such a space, so chunks can be cut into pieces one by one.  A text with other
    white space next to a space is one chunk.
    """
    if not text:
        return []
    parts = text.split(" ")
    if not plain or len(parts) < 2 or "" in parts or _uneven(text):
        return [text]
    return [parts[0], *[" " + p for p in parts[1:]]]


#: White space other than the plain space and the line feed, which are looked at with their neighbours.
_ODD = [chr(c) for c in range(0x3001) if chr(c).isspace() and c not in (10, 32)]


def _uneven(text: str) -> bool:
    return " \n" in text or "\n " in text or any(c in text for c in _ODD)


def _is_word(chunk: str) -> bool:
    """Whether a chunk is a space and letters of the blocks for European languages: the pattern makes it one piece."""
    return chunk[0] == " " and chunk[1:].isalpha() and max(chunk) < "\u0250"


def _many(texts: list[str | None], path: str, pattern: str):
    """For each text the ids in decimal joined by one space, and the bytes they decode to."""
    own, memory = codec(path), _MEMORIES.setdefault(path + pattern, _Memory())
    plain = pattern == public_tokenizers.PATTERN
    cut = [_chunks(t, plain) for t in texts]
    new = memory.missing(set(chain.from_iterable(cut)))
    names, decode, young = own.names, own.bytes_of.__getitem__, memory.young
    words = [c for c in new if _is_word(c)] if plain else []
    for chunk, ids in zip(words, own.encode_pieces([c.encode() for c in words]), strict=True):
        young[chunk] = " ".join([names[i] for i in ids]), b"".join([decode(i) for i in ids])
    find = regex.compile(pattern).findall
    rest = [c for c in new if c not in young] if words else new
    pieces = [find(c) for c in rest]
    distinct = list(set(chain.from_iterable(pieces)))
    known = dict(zip(distinct, own.encode_pieces([p.encode() for p in distinct]), strict=True))
    for chunk, parts in zip(rest, pieces, strict=True):
        ids = list(chain.from_iterable([known[p] for p in parts]))
        young[chunk] = " ".join([names[i] for i in ids]), b"".join([decode(i) for i in ids])
    get = young.__getitem__
    for chunks in cut:
        if chunks:
            ids, decoded = zip(*map(get, chunks), strict=True)
            yield " ".join(ids), b"".join(decoded)
        else:
            yield "", b""


def _digests(path: str, pattern: str):
    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        n, ids_sha, decoded_sha = [], [], []
        for ids, decoded in _many(piece.column("text").to_pylist(), path, pattern):
            n.append(ids.count(" ") + 1 if ids else 0)
            ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
            decoded_sha.append(hashlib.sha256(decoded).hexdigest())
        return pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_column(documents: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, column: str = "text", into: str = "ids") -> DataFrame:
    """The documents with the token ids of a text column as an array column."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    @F.pandas_udf("array<int>")
    def ids(texts):
        import pandas as pd

        return pd.Series([np.array(x[0].split(), np.int32) for x in _many(texts.where(texts.notna(), None).tolist(), path, pattern)])

    return documents.withColumn(into, ids(F.col(column)))


def decode_column(documents: DataFrame, path: str | None = None, column: str = "ids", into: str = "decoded") -> DataFrame:
    """The documents with an array column of token ids decoded to text; bytes that aren't UTF-8 become U+FFFD."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    @F.pandas_udf("string")
    def text(ids):
        import pandas as pd

        own = codec(path)
        return pd.Series([None if x is None else own.decode(x).decode("utf-8", "replace") for x in ids])

    return documents.withColumn(into, text(F.col(column)))


def digest_tokens(documents: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Counts and digests of the ids and of the bytes they decode to, for each row of (doc_id, text)."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return map_texts(documents.select("doc_id", "text"), _digests(path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
