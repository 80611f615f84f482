"""SentencePiece BPE encoding and decoding with the pieces of a public model, over a table of distinct marked words.

A text gets a marker (U+2581) in front and one for each space.  Where no piece has a marker after another character, no merge
crosses the place before a marker, so a text is cut there into marked words.  The distinct ones of a slice are segmented,
each once, into a table (marked word, ids, decoded text); ids come back to the texts by the words' positions.  A table
outlives its slice: a worker keeps two generations of bounded size, so frequent words aren't segmented again.  The table
is a task's own, since looking each word's position up in a table of the corpus would move more bytes than the corpus has.
White space that is in no piece but its own cuts words too.

Segmentation merges, again and again, the leftmost adjacent pair whose piece has the best score; characters that are no piece become
byte pieces.  Words of one length are segmented together in numpy, a merge of each in a step; long ones wait on a heap.  Models of another kind, with pieces of users, a normalisation or markers at word ends are refused.  If a piece
has a marker inside, a text is one chunk.

A null is an empty text, which has no tokens.  Every input row gives one row, repeated rows too.  Only doc_id and text are read.
Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.words import map_texts

MARK = "▁"
#: Marked words in a generation of a worker's table, and how many characters they may have.
TABLE_WORDS, WORD_CHARS = 150_000, 64
#: Characters up to which words are segmented together, and cells of one such table.
SHORT, CELLS = 40, 1 << 18
#: A pair's value is the rank of its piece, in the upper bits, and the piece's code.
_BITS, _NONE = 24, np.int64(2**62)


class Codec:
    """The pieces of a model file, and what is derived from them."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds, spec = type(model.pieces[0]), model.normalizer_spec
        if model.trainer_spec.model_type != model.trainer_spec.BPE or not model.trainer_spec.byte_fallback:
            raise ValueError("the model must be a BPE model with byte fallback")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the model must leave texts as they are but for markers in front of words")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("the model has pieces of its user's own")
        self.surface = [p.piece for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        scores = sorted({p.score for p in model.pieces if p.type == kinds.NORMAL}, reverse=True)
        place = {s: k for k, s in enumerate(scores)}
        self.rank = {p.piece: place[p.score] for p in model.pieces if p.type == kinds.NORMAL}
        self.byte_of = {i: int(p.piece[3:5], 16) for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.byte_ids = {b: i for i, b in self.byte_of.items()}
        self.unknown = {i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN}
        self.silent = {i for i, p in enumerate(model.pieces) if p.type == kinds.CONTROL}
        self.unknown_surface = model.trainer_spec.unk_surface
        inner = [p for p in self.ids if MARK in p.lstrip(MARK)]
        joined = set(chain.from_iterable(p for p in self.ids if len(p) > 1))
        pairs = sorted((self._code(p[:k]) << 32 | self._code(p[k:]), r << _BITS | self.ids[p]) for p, r in self.rank.items() for k in range(1, len(p)) if all(len(x) == 1 or x in self.ids for x in (p[:k], p[k:])))
        self.keys, self.values = np.array([k for k, _ in pairs] or [-1], np.int64), np.array([v for _, v in pairs] or [_NONE], np.int64)
        self.decimal, self.says = _Filled(self._decimal), _Filled(self._says)
        own = "".join(c for c in "\t\n\v\f\r" if c not in joined)  # each a word of its own
        word = f"{MARK}*[^{MARK}{own}]+|{MARK}+" + (f"|[{own}]" if own else "")
        self.words = re.compile(r"(?s).+" if inner else word).findall

    def _code(self, part: str) -> int:
        """The id of a piece; a character that is none has a code beyond all ids."""
        found = self.ids.get(part)
        return len(self.surface) + ord(part) if found is None else found

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The values of pairs of codes; _NONE where no piece joins them."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], _NONE)

    def _together(self, words: list[str], n: int) -> list[list[int]]:
        """The codes of words of n characters.  All that still have a pair to merge merge one in each step, so they stay equally long."""
        chars, where = np.unique(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), return_inverse=True)
        codes = np.array([self._code(chr(c)) for c in chars.tolist()], np.int64)[where].reshape(len(words), n)
        out: list[list[int]] = [[]] * len(words)
        rows, values = np.arange(len(words)), self._pairs(codes[:, :-1], codes[:, 1:])
        while True:
            width = values.shape[1]
            at = (values >> _BITS).argmin(1) if width else np.zeros(len(rows), np.int64)
            best = values[np.arange(len(rows)), at] if width else np.full(len(rows), _NONE)
            live = best != _NONE
            for i, found in zip(rows[~live].tolist(), codes[~live].tolist(), strict=True):
                out[i] = found
            rows, codes, values, at, best = rows[live], codes[live], values[live], at[live], best[live]
            if not len(rows):
                return out
            each = np.arange(len(rows))
            codes[each, at] = best & ((1 << _BITS) - 1)
            keep = np.ones(codes.shape, bool)
            keep[each, at + 1] = False
            codes = codes[keep].reshape(len(rows), width)
            keep = np.ones(values.shape, bool)
            keep[each, at] = False
            values = values[keep].reshape(len(rows), width - 1)
            for side in (at - 1, at):  # the pairs that the merged piece ends and starts
                k = np.flatnonzero((side >= 0) & (side < width - 1))
                values[k, side[k]] = self._pairs(codes[k, side[k]], codes[k, side[k] + 1])

    def _ids(self, code: int) -> list[int]:
        return [code] if code < len(self.surface) else [self.byte_ids[b] for b in chr(code - len(self.surface)).encode()]

    def _decimal(self, code: int) -> str:
        return ",".join(map(str, self._ids(code)))

    def _says(self, code: int) -> str:
        return self.spoken(self._ids(code))

    def rows(self, words: list[str]) -> list[tuple[str, str]]:
        """For each marked word its ids in decimal, joined by commas, and what they say."""
        out: list[tuple[str, str]] = [("", "")] * len(words)
        decimal, says = self.decimal.__getitem__, self.says.__getitem__
        sizes: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            sizes.setdefault(len(word), []).append(i)
        for n, members in sizes.items():
            step = max(1, CELLS // n)
            for k in range(0, len(members), step):
                part = [words[i] for i in members[k : k + step]]
                found = self._together(part, n) if n <= SHORT else [list(map(self._code, self._alone(w))) for w in part]
                for i, codes in zip(members[k : k + step], found, strict=True):
                    out[i] = ",".join(map(decimal, codes)), "".join(map(says, codes))
        return out

    def segment(self, word: str) -> list[int]:
        """The ids of a marked word."""
        return [int(i) for i in self.rows([word])[0][0].split(",")]

    def _alone(self, word: str) -> list[str]:
        """The pieces of a long word in n log n steps: pairs wait in a heap, and one whose parts have changed since is passed over."""
        n, rank = len(word), self.rank.get
        parts: list[str] = list(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(r, k, k + 1, 2) for k in range(n - 1) if (r := rank(word[k : k + 2])) is not None]
        heapify(waiting)

        def push(a: int, b: int) -> None:
            if a >= 0 and b < n and (r := rank(parts[a] + parts[b])) is not None:
                heappush(waiting, (r, a, b, len(parts[a]) + len(parts[b])))

        while waiting:
            _, a, b, size = heappop(waiting)
            if not parts[a] or not parts[b] or len(parts[a]) + len(parts[b]) != size:
                continue
            parts[a] += parts[b]
            parts[b] = ""
            after[a] = after[b]
            if after[b] < n:
                before[after[b]] = a
            push(before[a], a)
            push(a, after[a])
        return [p for p in parts if p]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.segment, self.marked(text))))

    def marked(self, text: str | None) -> list[str]:
        """The marked words of a text, in order."""
        return self.words(MARK + text.replace(" ", MARK)) if text else []

    def spoken(self, ids) -> str:
        """What ids say inside a text: markers are spaces, runs of byte pieces are UTF-8, one replacement for each wrong byte."""
        found, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                found.append(_utf8(bytes(run)))
                run.clear()
            if i not in self.silent:
                found.append(self.unknown_surface if i in self.unknown else self.surface[i].replace(MARK, " "))
        return "".join(found) + (_utf8(bytes(run)) if run else "")

    def decode(self, ids) -> str:
        """The text of ids; the marker that starts the first piece isn't part of it."""
        ids = list(ids)
        first = next((i for i in ids if i not in self.silent), None)
        text = self.spoken(ids)
        return text[1:] if first is not None and first not in self.byte_of and first not in self.unknown and self.surface[first].startswith(MARK) else text


def _utf8(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        found, at = [], 0
        while at < len(raw):
            for n in range(1, 5):
                try:
                    found.append(raw[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    pass
            else:
                found.append("�")
                at += 1
        return "".join(found)


class _Filled(dict):
    """A dict whose values come from their keys when they are first asked for."""

    def __init__(self, of):
        self.of = of

    def __missing__(self, key):
        self[key] = value = self.of(key)
        return value


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


class _Table:
    """A worker's marked words: word -> (ids in decimal, joined by commas; what they say), in two generations."""

    def __init__(self, own: Codec):
        self.own = own
        self.young: dict[str, tuple[str, str]] = {}
        self.old: dict[str, tuple[str, str]] = {}

    def hold(self, words: set[str]) -> dict[str, tuple[str, str]]:
        """A table that has these words."""
        new = words.difference(self.young)
        if len(self.young) + len(new) > TABLE_WORDS and self.young:
            self.old, self.young = self.young, {}
            new = words
        table, long = self.young, {}
        known = {w: row for w in new if (row := self.old.get(w)) is not None}
        fresh = list(new.difference(known)) if known else list(new)
        for word, row in chain(known.items(), zip(fresh, self.own.rows(fresh), strict=True)):
            if len(word) <= WORD_CHARS:
                table[word] = row
            else:
                long[word] = row
        return table | long if long else table


_TABLES: dict[str, _Table] = {}


def _many(texts: list[str | None], path: str):
    """For each text its ids in decimal, joined by commas, and what they decode to."""
    own = codec(path)
    cut = [own.marked(t) for t in texts]
    get = _TABLES.setdefault(path, _Table(own)).hold(set(chain.from_iterable(cut))).__getitem__
    for words in cut:
        if words:
            ids, said = zip(*map(get, words), strict=True)
            yield ",".join(ids), "".join(said)[1:]  # without the marker in front
        else:
            yield "", ""


def _digests(path: str):
    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        n, ids_sha, decoded_sha = [], [], []
        for ids, decoded in _many(piece.column("text").to_pylist(), path):
            n.append(ids.count(",") + 1 if ids else 0)
            ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
            decoded_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
        return pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_column(documents: DataFrame, path: str | None = None, column: str = "text", into: str = "ids") -> DataFrame:
    """The documents with the token ids of a text column as an array column."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    @F.pandas_udf("array<int>")
    def ids(texts):
        import pandas as pd

        return pd.Series([np.array(x[0].split(",") if x[0] else [], np.int32) for x in _many(texts.where(texts.notna(), None).tolist(), path)])

    return documents.withColumn(into, ids(F.col(column)))


def decode_column(documents: DataFrame, path: str | None = None, column: str = "ids", into: str = "decoded") -> DataFrame:
    """The documents with an array column of token ids decoded to text; a null stays one."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    @F.pandas_udf("string")
    def text(ids):
        import pandas as pd

        own = codec(path)
        return pd.Series([None if x is None else own.decode(x) for x in ids])

    return documents.withColumn(into, text(F.col(column)))


def digest_pieces(documents: DataFrame, path: str | None = None) -> DataFrame:
    """Counts and digests of the ids and of the text they decode to, for each row of (doc_id, text)."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    return map_texts(documents.select("doc_id", "text"), _digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op12_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"))
